"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Each of M projections sorts the vectors along a random direction, within cells that the signs of a
few further directions give, so that the rows near a query stay few as the table grows. Two
vectors collide in a projection if they share its cell and each lies in the window around the
other. The projections come in tables: those of one table share the first signs of their cells, so a vector
travels once a table, not once a projection. From the chances at the threshold follow the number of tables and the
largest count of collisions that keeps the wanted share of true pairs; pairs with that count are verified by cosine in
double precision.

The collisions of a pair in all projections are counted where it is met first, so every pair is
counted and verified once and none is sent anywhere: a block of vectors sends each vector's
number of links and its links to one vector of its connected group.
Equal vectors are one vector with a weight; groups that hold many are compared in blocks.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, frugal_group

COSINE = 0.95
#: Share of the pairs at just the threshold that counting must keep.
RECALL = 0.9995
#: Half-width of a window, for directions of standard normal coordinates and unit vectors.
WINDOW = 0.6
#: Vectors of a cell, on average, and of a table's group of cells, which one task holds.
CELL, GROUP = 96, 8192
#: Projections of a table.
PER_TABLE = 6
BLOCK = 16384
MOST_BITS = 40


def _hits(coarse: float, fine: float, tables: int, least: int) -> float:
    """Chance of fewer than `least` collisions, by those of a table's shared signs and of one projection's rest."""
    one = np.array([coarse * math.comb(PER_TABLE, k) * fine**k * (1 - fine) ** (PER_TABLE - k) for k in range(PER_TABLE + 1)])
    one[0] += 1 - coarse
    total = np.ones(1)
    for _ in range(tables):
        total = np.convolve(total, one)[: least + PER_TABLE]
    return float(total[:least].sum())


def shared_bits(n: int, bits: int) -> int:
    """How many of a cell's sign bits a table's projections have in common, for n vectors."""
    return min(bits, max(0, round(math.log2(max(1, n) / GROUP))))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """Sign bits of a cell, projections, and the least number of collisions, for n vectors."""
    bits = min(MOST_BITS, max(0, round(math.log2(max(1, n) / CELL))))
    shared = shared_bits(n, bits)
    near = NormalDist(0, math.sqrt(2 - 2 * cosine))
    sign = 1 - math.acos(cosine) / math.pi
    coarse, fine = sign**shared, sign ** (bits - shared) * (near.cdf(WINDOW) - near.cdf(-WINDOW))
    tables, least = 1, 2
    while _hits(coarse, fine, tables, least) > 1 - recall:
        tables += 1
    while _hits(coarse, fine, tables, least + 1) <= 1 - recall:
        least += 1
    return bits, tables * PER_TABLE, least


def directions(dim: int, shared: int, own: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines to sort along, and normals of the tables' and of the projections' sign planes."""
    r = np.random.Generator(np.random.PCG64([17, dim]))
    m = tables * PER_TABLE
    return r.normal(size=(m, dim)), r.normal(size=(tables * shared, dim)), r.normal(size=(m * own, dim))


def _signs(x: np.ndarray, normals: np.ndarray, bits: int) -> np.ndarray:
    """Numbers (rows, sets) of the sides of each set of so many planes."""
    if not bits:
        return np.zeros((len(x), 1), dtype=np.int64)
    return (x @ normals.T > 0).reshape(len(x), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def groups(x: np.ndarray, shared: int, own: int, tables: int) -> np.ndarray:
    """The group (rows, tables) of unit vectors in each table."""
    return np.broadcast_to(_signs(x, directions(x.shape[1], shared, own, tables)[1], shared), (len(x), tables))


def codes(x: np.ndarray, shared: int, own: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (rows, projections) and positions (rows, projections) of unit vectors."""
    lines, _, planes = directions(x.shape[1], shared, own, tables)
    rest = np.broadcast_to(_signs(x, planes, own), (len(x), len(lines)))
    return (np.repeat(groups(x, shared, own, tables), PER_TABLE, axis=1) << own) + rest, x @ lines.T


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    # Numbers are brought near 1 first, as squares of very large or small ones can't be held; twice, as the smallest have few digits.
    for _ in range(2):
        x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, which names each index's least connected one, after the links (a, b)."""
    while True:
        u, v = parent[a], parent[b]
        apart = u != v
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _links(x, cells, at, t, least, cosine, first, second):
    """Index pairs (of rows first x second, both in one cell of projection t) that are links met first in t."""
    window = np.abs(at[first, t][:, None] - at[second, t][None, :]) <= WINDOW
    window &= cells[first, t][:, None] == cells[second, t][None, :]
    i, j = np.nonzero(window)
    i, j = first[i], second[j]
    ok = i < j
    i, j = i[ok], j[ok]
    found = []
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        hit = (cells[a] == cells[b]) & (np.abs(at[a] - at[b]) <= WINDOW)
        ok = (hit.sum(axis=1) >= least) & ~hit[:, :t].any(axis=1)
        a, b = a[ok], b[ok]
        ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        found.append((a[ok], b[ok]))
    return found


def _block(shared: int, own_bits: int, tables: int, least: int, cosine: float):
    def run(key, rows):
        table, i, j = key[1], key[3], key[4]
        x = _units(rows["vector"])
        cells, at = codes(x, shared, own_bits, tables)
        ids, weights, chunk = rows["rep"].to_numpy(), rows["weight"].to_numpy(), rows["chunk"].to_numpy()
        counts, parent = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for t in range(table * PER_TABLE, (table + 1) * PER_TABLE):
            order = np.lexsort((at[:, t], cells[:, t]))
            cut = np.flatnonzero(np.diff(cells[order, t], prepend=-1, append=-1))
            for lo, hi in zip(cut, cut[1:], strict=False):
                own = order[lo:hi]
                along = at[own, t]
                for s in range(0, len(own), 512):
                    # The cell is sorted: only rows up to the window's end can collide with these.
                    left, right = np.searchsorted(along, [along[s] - WINDOW, along[min(s + 511, len(own) - 1)] + WINDOW], side="left")
                    near = own[left : right + 1]
                    for a, b in _links(x, cells, at, t, least, cosine, own[s : s + 512], near):
                        if i != j:
                            across = chunk[a] != chunk[b]
                            a, b = a[across], b[across]
                        np.add.at(counts, a, weights[b])
                        np.add.at(counts, b, weights[a])
                        parent = _join(parent, a, b)
        linked = np.flatnonzero(counts)
        return pd.DataFrame({"rep": ids[linked], "links": counts[linked], "root": ids[parent[linked]]})

    return run


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id (smallest id reachable over links), kept.

    Vectors of equal values link with each other. A vector that is null, empty, zero or holds
    null or non-finite numbers links with nothing; vectors of different lengths don't either. Vectors of
    any length and of numbers of any size are compared. Rows that repeat an id are vectors of their own. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    number = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast(f"array<{number}>").alias("vector"))
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vector", lambda e: e != 0), F.lit(False)) & F.col("id").isNotNull()
    marked = rows.withColumn("usable", usable)
    good = marked.where("usable")
    # A zero of either sign is the same number.
    same = good.withColumn("vector", F.transform("vector", lambda e: e + F.lit(0.0).cast(number)))
    # A class has a number of its own, as vectors of different values may have one id.
    classes = checkpoint(
        same.groupBy("vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight")).withColumn("rep", F.monotonically_increasing_id())
    )
    n = classes.count()
    bits, m, least = plan(n, cosine, recall)
    shared, tables = shared_bits(n, bits), m // PER_TABLE
    own_bits = bits - shared

    def spread(parts):
        for part in parts:
            for dim, own in part.groupby(part["vector"].map(len)):
                for s in range(0, len(own), 2048):
                    piece = own.iloc[s : s + 2048]
                    held = groups(_units(piece["vector"]), shared, own_bits, tables)
                    for t in range(tables):
                        out = piece[["rep", "weight", "vector"]].copy()
                        out["dim"], out["t"], out["cell"] = dim, t, held[:, t]
                        yield out

    dealt = classes.select("rep", "weight", "vector").mapInPandas(spread, f"rep bigint, weight bigint, vector array<{number}>, dim int, t int, cell bigint")
    where = ["dim", "t", "cell"]
    sizes = dealt.groupBy(*where).count().where(F.col("count") > BLOCK)
    chunks = F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    blocks = (
        dealt.join(sizes, where, "left")
        .select("*", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("rep", "weight", "vector", *where, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    found = checkpoint(
        blocks.groupBy(*where, "i", "j").applyInPandas(
            frugal_group(_block(shared, own_bits, tables, least, cosine)), "rep bigint, links bigint, root bigint"
        )
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = checkpoint(
        classes.join(links, "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vector", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("label", "rep").alias("label"))
    )
    lowest = placed.groupBy("label").agg(F.min("low").alias("component"))
    named = placed.join(lowest, "label").select("vector", "links", "component")
    linked = same.select("id", "vector").join(named, "vector").select("id", "links", "component")
    alone = marked.where("not usable").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return linked.union(alone).select(
        F.col("id").alias(vec_id),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
