"""Lookups in catalogues of zones and hierarchies of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

SECTIONS = ["main", "conditional", "auxiliary"]
PRIORITY = {"main": 3, "conditional": 2, "auxiliary": 1}


def section_priority(section: Column | str) -> Column:
    s = F.col(section) if isinstance(section, str) else section
    return F.when(s == "main", 3).when(s == "conditional", 2).when(s == "auxiliary", 1).otherwise(0)


def section_order(section: Column | str) -> Column:
    """Position in the list of sections, in which the first one that allows decides."""
    return 3 - section_priority(section)


def shorter_prefixes(code: Column | str) -> Column:
    """The dotted prefixes of a code, longest first, without the code itself."""
    parts = F.split(F.col(code) if isinstance(code, str) else code, r"\.")
    n = F.size(parts)
    counts = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(counts, lambda k: F.array_join(F.slice(parts, 1, k), "."))


def resolve_zones(rows: DataFrame, zones: DataFrame, code: str = "zone_code") -> DataFrame:
    """rows with ref_code and outcome: the zone of the code, else the only zone with it as base code.

    zones: (zone_code, base_code). Outcomes: missing (no code), exact, base_unique, not_found.
    """
    exact = zones.select(F.col("zone_code").alias("_e")).distinct()
    base = zones.groupBy(F.col("base_code").alias("_b")).agg(F.min("zone_code").alias("_only"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    c = F.coalesce(F.trim(code), F.lit(""))
    joined = rows.withColumn("_c", c).join(exact, F.col("_c") == F.col("_e"), "left").join(base, F.col("_c") == F.col("_b"), "left")
    outcome = (
        F.when(F.col("_c") == "", "missing").when(F.col("_e").isNotNull(), "exact").when(F.col("_only").isNotNull(), "base_unique").otherwise("not_found")
    )
    ref = F.when(outcome == "exact", F.col("_e")).when(outcome == "base_unique", F.col("_only"))
    return joined.withColumn("ref_code", ref).withColumn("outcome", outcome).drop("_c", "_e", "_b", "_only", "_n")


def by_prefix(rows: DataFrame, table: DataFrame, code: str, value: str, out: str) -> DataFrame:
    """rows with the table's value (code, value) of their code, else of its longest prefix that has one; an empty list is none."""
    probes = rows.select(F.col(code).alias("_code")).distinct().select(
        "_code", F.posexplode(F.concat(F.array("_code"), shorter_prefixes("_code"))).alias("_at", "_try")
    )
    held = table.select(F.col("code").alias("_try"), F.col(value).alias("_value")).where("_value is not null")
    if table.schema[value].dataType.typeName() == "array":
        held = held.where(F.size("_value") > 0)
    best = probes.join(held, "_try").groupBy("_code").agg(F.min_by("_value", "_at").alias(out))
    return rows.join(best, rows[code] == best["_code"], "left").drop("_code")


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(code, descendant) for every code of edges (code, parent), itself included; cycles end by themselves.

    A pair at level L > span, span a power of two, goes through a code at level span of the first; so each round joins the pairs at just that level with all
    pairs found, gives the pairs up to twice as far, and leaves out those known. Paths double in length from round to round, a tree of any depth takes its logarithm
    in rounds, and in a tree every pair is made once. With a depth, only descendants so many levels down, and no round beyond.
    """
    nodes = edges.select("code", F.col("code").alias("descendant"), F.lit(0).alias("level"))
    down = edges.where("parent is not null").select(F.col("parent").alias("code"), F.col("code").alias("descendant"), F.lit(1).alias("level"))
    codes = edges.select("code").distinct()
    reach = checkpoint(nodes.union(down.join(codes, "code", "left_semi")).groupBy("code", "descendant").agg(F.min("level").alias("level")))
    span = 1
    while depth is None or span < depth:
        far = reach.where(F.col("level") == span).select("code", F.col("descendant").alias("_via"))
        on = reach.where("level > 0").select(F.col("code").alias("_via"), "descendant", (F.col("level") + span).alias("level"))
        longer = far.join(on, "_via").groupBy("code", "descendant").agg(F.min("level").alias("level"))
        new = checkpoint(longer.join(reach.select("code", "descendant"), ["code", "descendant"], "left_anti"))
        if new.isEmpty():
            break
        reach, span = reach.union(new), 2 * span
    return (reach if depth is None else reach.where(F.col("level") <= depth)).select("code", "descendant")


def leaf_paths(edges: DataFrame) -> DataFrame:
    """(code, path) of the leaves of a forest (code, parent); a path joins the codes from the root with >.

    Each round puts before every path the path of the code that it hangs from, so a forest of any depth takes
    its logarithm in rounds. Codes on a cycle have no root, so neither they nor what hangs from them have paths.
    """
    parents = edges.select(F.col("parent").alias("code")).where("code is not null").distinct()
    paths = checkpoint(edges.select("code", F.col("parent").alias("above"), F.col("code").alias("path")))
    most, reached = paths.count(), 1
    while reached <= 2 * most and not paths.where("above is not null").isEmpty():
        up = paths.select(F.col("code").alias("above"), F.col("above").alias("_next"), F.col("path").alias("_before"))
        open_paths = paths.where("above is not null").join(up, "above").select("code", F.col("_next").alias("above"), F.concat_ws(">", "_before", "path").alias("path"))
        paths, reached = checkpoint(paths.where("above is null").union(open_paths)), 2 * reached
    return paths.where("above is null").select("code", "path").join(parents, "code", "left_anti")


def allowing_section(rows: DataFrame, allowed: DataFrame, code: str, zone: str) -> DataFrame:
    """rows with the first section of the zone that allows the code: by the code itself, an umbrella of it, or a child.

    allowed: (zone, section, allowed_code). The dotted relation becomes two equi-joins on prefixes.
    """
    keys = rows.select(F.col(zone).alias("_z"), F.col(code).alias("_c")).where("_z is not null and _c is not null").distinct()
    a = allowed.select(F.col("zone").alias("_z"), section_order("section").alias("_o"), "section", "allowed_code")
    up = keys.withColumn("_p", F.explode(F.concat(F.array("_c"), shorter_prefixes("_c"))))
    over = up.join(a.withColumnRenamed("allowed_code", "_p"), ["_z", "_p"])
    down = a.withColumn("_c", F.explode(shorter_prefixes("allowed_code")))
    under = keys.join(down, ["_z", "_c"])
    hits = over.select("_z", "_c", "_o", "section").union(under.select("_z", "_c", "_o", "section"))
    first = hits.groupBy("_z", "_c").agg(F.min_by("section", "_o").alias("section"))
    return rows.join(first, (rows[zone] == first["_z"]) & (rows[code] == first["_c"]), "left").drop("_z", "_c")


def banded_code(kind: Column, floors: Column, banded: int, codes: dict[int, tuple[str, str | None]], bands: list[tuple], fallback: str) -> Column:
    """Use code of a type of object; the banded type's is that of the first band its whole number of floors fits."""
    number = F.when(floors.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(floors.cast("string")).cast("int"))
    by_floor = F.when(number.isNull(), fallback)
    for most, code, *_ in bands:
        by_floor = by_floor.otherwise(F.lit(code)) if most is None else by_floor.when(number <= most, code)
    table = F.create_map(*[F.lit(x) for k, (_, c) in codes.items() if c for x in (k, c)])
    return F.when(kind == banded, by_floor).otherwise(F.element_at(table, kind))


def summary_status(found: Column, confidence: Column) -> Column:
    return F.when(found.isNull(), "no_mapping").when(F.coalesce(confidence, F.lit("none")).isin("low", "none"), "low_confidence").otherwise("ok")
