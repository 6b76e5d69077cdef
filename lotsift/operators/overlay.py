"""Overlay of polygon layers: which zones a parcel meets, touching ones included, and what follows for it.

Boxes meet through a pyramid of tiles. A box lies on the level whose tiles are as wide as it, so it touches four of them at most, however
large it is; two boxes meet on the level of the larger one, where the smaller one's tiles are found by equality. Only
ids and boxes go through the tiles. Shapes join the pairs that are left, many pairs of a zone with one copy of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import repair as shapes
from ..functions.clipping import SHAPES, overlap_areas
from ..functions.geometry import area
from ..functions.text import canonical, normal
from ..session import checkpoint
from .spatial import BELOW_SHARE, BOX, MULTIPLE, _box_of, alike, dominant_alike, first_alike, placed

#: What is told of every parcel of a layer of which no parcel meets a zone.
NONE_AT_ALL = "No intersection with PZZ"
#: Pairs of a zone, or of several, that are compared in one group.
PAIRS = 20_000
#: Tiles are not made finer than for boxes of this width.
FINEST = 1e-9


@F.arrow_udf(ArrayType(ArrayType(ArrayType(ArrayType(DoubleType())))))
def repaired(geometry: pa.Array) -> pa.Array:
    """The multipolygon, rebuilt where its rings cross, touch or overlap."""
    return shapes.repaired(geometry)


def _level() -> Column:
    """The level whose tiles, of side 2 to its power, are at least as wide and high as the box."""
    return F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(FINEST)))).cast("int")


def _levels(boxes: DataFrame) -> list[int]:
    """The levels of a layer; there are no more than a double's exponents."""
    return sorted(r[0] for r in boxes.select(_level().alias("l")).distinct().collect() if r[0] is not None)


def _on_tiles(boxes: DataFrame, others: list[int]) -> DataFrame:
    """Rows of the boxes with each tile they touch (level, tx, ty), on their own level (home) and on the other layer's coarser ones."""
    own = boxes.withColumn("own", _level()).where("own is not null")
    levels = F.array_union(F.array("own"), F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("own")))

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.pow(F.lit(2.0), "level")), F.floor(F.col(hi) / F.pow(F.lit(2.0), "level")))

    return own.withColumn("level", F.explode(levels)).withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))


def meeting(left: DataFrame, right: DataFrame, left_id: str = "pid", right_id: str = "zid") -> DataFrame:
    """Pairs of ids whose closed boxes (x0, y0, x1, y1) meet, each once."""
    a = _on_tiles(left.select(left_id, *BOX), _levels(right))
    b = _on_tiles(right.select(right_id, *BOX), _levels(left))
    b = b.select(right_id, "level", "tx", "ty", *[F.col(c).alias(f"r_{c}") for c in ("own", *BOX)])
    side = F.pow(F.lit(2.0), "level")
    meet = F.expr("x0 <= r_x1 and r_x0 <= x1 and y0 <= r_y1 and r_y0 <= y1 and level = greatest(own, r_own)")
    first = (F.col("tx") == F.floor(F.greatest("x0", "r_x0") / side)) & (F.col("ty") == F.floor(F.greatest("y0", "r_y0") / side))
    return a.join(b, ["level", "tx", "ty"]).where(meet & first).select(left_id, right_id)


def _beside(pairs: DataFrame, left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """work(left rows, right rows, which) of groups of pairs (pid, zid) with the rows of both ids; which: the right row of each left one.

    A zone of many pairs is in several groups, so that none grows with a zone's popularity.
    """
    pairs = checkpoint(pairs)
    blocks = pairs.groupBy("zid").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("blocks"))
    groups = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / PAIRS))
    group = F.pmod(F.xxhash64("zid", "block"), F.lit(groups)).alias("g")
    near = pairs.join(blocks, "zid").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).drop("blocks")
    asked = near.join(left, "pid").select(group, F.col("zid").alias("z"), *left.columns)
    held = right.join(blocks, "zid").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select(group, *right.columns).dropDuplicates(["g", "zid"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        zones = b["zid"].combine_chunks() if len(b) else pa.array([], a.schema.field("z").type)
        which = pc.index_in(a["z"].combine_chunks(), zones) if len(a) else pa.array([], pa.int32())
        return work(a, b, which.to_numpy(zero_copy_only=False))

    return asked.groupBy("g").cogroup(held.groupBy("g")).applyInArrow(run, schema)


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return (column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)).cast(SHAPES) if len(table) else pa.array([], SHAPES)


def _settled(size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Areas on a grid of a power of two, a billionth of the parcel at most: equal ones come out equal, whatever way they were clipped."""
    with np.errstate(divide="ignore", invalid="ignore"):
        step = 2.0 ** np.floor(np.log2(1e-9 * own))
        return np.where(step > 0, np.round(size / step) * step, size)


def fragments(parcels: DataFrame, zones: DataFrame) -> DataFrame:
    """(pid, zid, code, area, parcel_area) of each parcel (pid, shape) and zone (zid, code, shape) that have a point in common.

    Shapes are repaired first; those that cover nothing meet nothing. Zones that only touch a parcel count, with area 0. Ids are those of
    their rows alone.
    """
    left = checkpoint(parcels.select("pid", repaired("shape").alias("shape")).where("shape is not null"))
    right = checkpoint(zones.select("zid", "code", repaired("shape").alias("shape")).where("shape is not null"))
    pairs = meeting(left.select("pid", *_box_of("shape")), right.select("zid", *_box_of("shape")))
    kinds = {c: t for f in (left, right) for c, t in f.dtypes}

    def work(a: pa.Table, b: pa.Table, which: np.ndarray) -> pa.Table:
        one, two = _whole(a, "shape"), _whole(b, "shape")
        cut = overlap_areas(one, two, which) if len(a) else np.zeros(0)
        own = a["own"].to_numpy()
        # Less than a billionth of the parcel is what rounding leaves of a touch, and no difference between two areas.
        cut = _settled(cut, own)
        cut[cut <= 1e-9 * own] = 0.0
        apart = np.flatnonzero(cut == 0)
        met = cut > 0
        if len(apart):
            met[apart] = shapes.touch(one.take(pa.array(apart)), two, which[apart])
        keep = np.flatnonzero(met)
        code = b["code"].combine_chunks().take(pa.array(which[keep])) if len(b) else pa.array([], pa.string())
        picked = a.take(pa.array(keep))
        return pa.table({"pid": picked["pid"], "zid": picked["z"], "code": code, "area": pa.array(cut[keep]), "parcel_area": picked["own"]})

    return _beside(pairs, left.select("pid", "shape", area(F.col("shape")).alias("own")), right, work, f"pid {kinds['pid']}, zid {kinds['zid']}, code {kinds['code']}, area double, parcel_area double")


def first_holding(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points (pid, px, py) with the first zone (zid, code, shape), by order of zid, that holds them strictly inside; null if none does."""
    # Of zones with one shape the first stands for all, of points at one place the one of least id.
    shapes_of = first_alike(zones.where("shape is not null"), "shape")
    right = checkpoint(shapes_of.select("zid", "code", repaired("shape").alias("shape")).where("shape is not null"))
    every, points = points, checkpoint(alike(points.select("pid", "px", "py"), "pid", "px", "py"))
    dots = points.select("pid", *[F.col(p).alias(c) for c, p in zip(BOX, ("px", "py", "px", "py"), strict=True)])
    pairs = meeting(dots, right.select("zid", *_box_of("shape")))
    kinds = {c: t for f in (points, right) for c, t in f.dtypes}

    def work(a: pa.Table, b: pa.Table, which: np.ndarray) -> pa.Table:
        x, y = (a[c].to_numpy().astype(np.float64) for c in ("px", "py"))
        keep = np.flatnonzero(shapes.covers(_whole(b, "shape"), x, y, which)) if len(a) else np.empty(0, dtype=np.int64)
        code = b["code"].combine_chunks().take(pa.array(which[keep])) if len(b) else pa.array([], pa.string())
        picked = a.take(pa.array(keep))
        return pa.table({"pid": picked["pid"], "zid": picked["z"], "code": code})

    hits = _beside(pairs, points.select("pid", "px", "py"), right, work, f"pid {kinds['pid']}, zid {kinds['zid']}, code {kinds['code']}")
    return placed(every, points.join(hits, "pid").drop("pid"))


def notes(rows: DataFrame, met: DataFrame, least: float = 0.5) -> DataFrame:
    """rows (n_codes, share, ..) with the note on a parcel's zones: null where it has one zone or none, NONE_AT_ALL for all if no parcel of the layer met any."""
    any_met = met.limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))
    note = F.when(~F.col("_any"), NONE_AT_ALL).when((F.col("n_codes") > 1) & (F.col("share") < least), BELOW_SHARE).when(F.col("n_codes") > 1, MULTIPLE)
    # One row.
    return rows.crossJoin(F.broadcast(any_met)).withColumn("note", note).drop("_any")


def zone_attributes(parcels: DataFrame, zones: DataFrame, use: str | None = None, name: str | None = None) -> DataFrame:
    """parcels (pid, shape, ..) with the zone that covers most of them, its share, all codes met in order of area, and the note.

    zones: (zid, code, shape, and a column `name` of their names). Codes and names are stripped; blank ones are none. With `use`, a column of
    the parcels with the text of their use, also the keys for checks: zone_key (canonical use, code) and comparison_key (and the codes met).
    """
    layer = zones.withColumn("code", normal("code"))
    met: list[DataFrame] = []

    def meet(one: DataFrame, two: DataFrame) -> DataFrame:
        met.append(checkpoint(fragments(one, two)))
        return met[0]

    found = dominant_alike(parcels, layer.withColumn("code", F.nullif("code", F.lit(""))), meet, "shape")
    if name:
        named = layer.select(F.col("zid").alias("actual_zid"), F.nullif(normal(name), F.lit("")).alias("actual_name"))
        found = found.join(named, "actual_zid", "left")
    blank = F.nullif(F.col("intersect_codes"), F.lit(""))
    out = parcels.join(notes(found.withColumn("intersect_codes", blank), met[0]), "pid", "left")
    if use:
        out = canonical(out, use, "canonical_use")
        head = F.concat_ws(" || ", F.coalesce("canonical_use", F.lit("")), F.coalesce("actual_code", F.lit("")))
        out = out.withColumn("zone_key", head).withColumn("comparison_key", F.concat_ws(" || ", head, F.coalesce("intersect_codes", F.lit(""))))
    return out
