"""Vector recall and the deterministic ranking of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint

#: Queries of a block, and bytes of its matrix, at most; cells of one product.
BROADCAST_ROWS, BLOCK_BYTES, CELLS = 20_000, 64 << 20, 4 << 20
#: Of blocks that meet each other: rows, from and to, bytes at most; cells of one product.
PAIR_ROWS, PAIR_BYTES, PAIR_CELLS = (512, 16_384), 16 << 20, 1 << 20


def unit(vector: Column | str) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda e: e.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    return F.when(length > 0, F.transform(v, lambda e: e / length)).otherwise(v)


def dot(a: Column | str, b: Column | str) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)


def _first(query: np.ndarray, score: np.ndarray, code: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each query, ties by code; nan comes before all numbers, as in SQL."""
    order = np.lexsort((np.unique(code, return_inverse=True)[1], -score, ~np.isnan(score), query))
    q = query[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    within = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
    return order[within < most]


def _best_of(vectors: np.ndarray, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of entries that can be among the `most` best of a query.

    A matrix product picks them, with a little slack for its rounding; their scores are then summed in the order of the dimensions, as an expression
    in Spark or SQL sums them, so equal vectors have equal scores.
    """
    rough = vectors @ asked.T
    least = np.partition(rough, max(0, len(rough) - most), axis=0)[max(0, len(rough) - most)] - 1e-9
    entry, query = np.nonzero(rough >= least)
    return query, entry, _summed(vectors, entry, asked, query)


def _summed(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of one and rows j of two, added dimension by dimension."""
    score = np.zeros(len(i))
    with np.errstate(invalid="ignore"):
        for k in range(one.shape[1]):
            score += one[i, k] * two[j, k]
    return score


def recall(queries: DataFrame, entries: DataFrame, most: int, key: str = "query", code: str = "code", group: str | None = None) -> DataFrame:
    """The `most` entries (code, vector) of highest dot product for each query (query, qvector), ties by code.

    A stated set of queries against all entries, in blocks of queries of bounded size: each block is a matrix that goes to the entries' tasks, which
    multiply whole batches of entries with it and send on no more than `most` rows a query. Entries and queries whose vectors are null, or of
    another length than the other side's, have no products. With `group`, a column of both sides, only rows whose groups are equal meet.
    """
    n = queries.count()
    first = queries.where("qvector is not null").select(F.size("qvector").alias("n")).first()
    dim = max(1, first["n"]) if first else 1
    size = max(1, min(BROADCAST_ROWS, BLOCK_BYTES // (8 * dim)))
    blocks = max(1, -(-n // size))
    kinds = {key: queries.schema[key].dataType.simpleString(), code: entries.schema[code].dataType.simpleString()}
    among = F.col(group) if group else F.lit(0)
    vectors = entries.where("vector is not null").select(code, F.col("vector").cast("array<double>").alias("vector"), among.alias("group")).where("group is not null")
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        # Some `size` rows.
        held = part.where("qvector is not null").select(key, F.col("qvector").cast("array<double>").alias("qvector"), among.alias("group")).toArrow()
        keys = held[key].combine_chunks()
        alike: dict[tuple, tuple[list, list]] = {}
        for i, (v, g) in enumerate(zip(held["qvector"].to_pylist(), held["group"].to_pylist(), strict=True)):
            ids, own = alike.setdefault((g, len(v)), ([], []))
            ids.append(i)
            own.append(v)
        asked = {(g, k): (np.array(i), np.array(v, dtype=np.float64).reshape(len(v), k)) for (g, k), (i, v) in alike.items()}

        def run(batches: Iterator[pa.RecordBatch], asked=asked, keys=keys) -> Iterator[pa.RecordBatch]:
            query, score, codes = np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)
            for batch in batches:
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                kinds_of = batch.column(2).dictionary_encode()
                numbers, groups = kinds_of.indices.to_numpy(zero_copy_only=False), kinds_of.dictionary.to_pylist()
                for n, k in np.unique(np.stack([numbers, sizes], axis=1), axis=0).tolist() if len(batch) else ():
                    if (groups[n], k) not in asked or not k:
                        continue
                    own = batch.take(pa.array(np.flatnonzero((sizes == k) & (numbers == n))))
                    matrix = own.column(1).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, k)
                    known = np.flatnonzero(np.isfinite(matrix).all(axis=1))
                    names = np.array(own.column(0).to_pylist(), dtype=object)
                    ids, block = asked[groups[n], k]
                    step = max(1, CELLS // len(block))
                    for s in range(0, len(known), step):
                        at = known[s : s + step]
                        q, e, x = _best_of(matrix[at], block, most)
                        query, score, codes = np.concatenate([query, ids[q]]), np.concatenate([score, x]), np.concatenate([codes, names[at[e]]])
                        if len(query) > 2 * most * len(keys) + 10_000:
                            keep = _first(query, score, codes, most)
                            query, score, codes = query[keep], score[keep], codes[keep]
            keep = _first(query, score, codes, most)
            for s in range(0, len(keep), 50_000):
                at = keep[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(query[at])), pa.array(codes[at].tolist(), kind), pa.array(score[at])], names=[key, code, "score"])

        kind = to_arrow_type(entries.schema[code].dataType)
        scored = vectors.mapInArrow(run, f"{key} {kinds[key]}, {code} {kinds[code]}, score double")
        w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(code))
        top = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)
        out = top if out is None else out.union(top)
    return out


def _few_alike(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that can be among the `most` best others of any row: of equal vectors the first `most` + 1 ids, of each id `most` rows."""
    n, k = vectors.shape
    shape = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, 8 * k))).ravel(), return_inverse=True)[1] if k else np.zeros(n, dtype=np.int64)
    order = np.lexsort((ids, shape))
    other = np.diff(shape[order], prepend=-1) != 0
    fresh = other | (np.diff(ids[order], prepend=-1) != 0)
    nth, at = np.cumsum(fresh), np.arange(n)
    start, shown = np.flatnonzero(other), np.flatnonzero(fresh)
    nth_id = nth - np.repeat(nth[start], np.diff(start, append=n))
    within = at - np.repeat(shown, np.diff(shown, append=n))
    return np.sort(order[(nth_id <= most) & (within < most)])


def _best_others(asked: np.ndarray, keys: np.ndarray, entries: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the `most` best entries of each query whose ids differ from its key, ties by id.

    As in _best_of a product picks what can be among them: one in single precision of queries of length 1 and entries of length 1 at most, with a slack above its
    rounding. A vector that isn't finite is compared with all; what a zero vector finds depends on ids alone.
    """
    few = _few_alike(entries, ids, most)
    entries, ids = entries[few], ids[few]
    with np.errstate(over="ignore", invalid="ignore"):
        long, wide = (np.sqrt((v * v).sum(axis=1)) for v in (asked, entries))
        odd = ~np.isfinite(wide)
        near = (asked / np.where(long > 0, long, 1)[:, None]).astype(np.float32)
        far = (entries / (wide.max(initial=0, where=~odd) or 1)).astype(np.float32).T
    slack = 2 * (asked.shape[1] + 2) * np.finfo(np.float32).eps
    plain = odd.copy()
    plain[_few_alike(entries[:, :0], ids, most)] = True
    shared = np.isin(keys, ids)
    step, found = max(1, PAIR_CELLS // max(1, len(ids))), [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    cells = np.empty((step, len(ids)), dtype=np.float32)
    for s in range(0, len(asked) if len(ids) else 0, step):
        part, own, length = asked[s : s + step], keys[s : s + step], long[s : s + step]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.matmul(near[s : s + step], far, out=cells[: len(part)])
        rough[:, odd] = -np.inf
        among = np.flatnonzero(shared[s : s + step])
        if len(among):
            row, column = np.nonzero(own[among, None] == ids)
            rough[among[row], column] = -np.inf
        rows, taken = np.arange(len(part)), []
        for _ in range(most):
            at = rough.argmax(axis=1)
            taken.append((at, rough[rows, at]))
            rough[rows, at] = -np.inf
        for at, best in reversed(taken):
            rough[rows, at] = best
        hits = rough >= (taken[-1][1] - slack)[:, None]
        hits[:, odd] = True
        hits[~np.isfinite(length)] = True
        hits[~part.any(axis=1)] = plain
        query, entry = np.divmod(np.flatnonzero(hits), len(ids))
        other = own[query] != ids[entry]
        query, entry = query[other], entry[other]
        score = _summed(entries, entry, part, query)
        keep = _first(query, score, ids[entry], most)
        found.append((query[keep] + s, few[entry[keep]], score[keep]))
    query, entry, score = (np.concatenate(v) for v in zip(*found, strict=True))
    return query, entry, score


def best_others(rows: DataFrame, most: int, group: str, key: str = "key", code: str = "pos") -> DataFrame:
    """(key, code, score): for each row (key, group, vector) the `most` others of its group of highest dot product, ties by code; others are those with another key.

    All rows ask and all are asked, so the work grows with the square of a group. Rows are dealt to blocks of bounded size, and two blocks of a group meet in one
    task for both ways; a group is sent as often as it has blocks. There are as few as give each task of a shuffle some pairs of blocks, or as their size allows.
    A row without a product, as its vector or those of all others are null, comes with its first other and a null score. A vector that holds nulls counts as null.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    rows = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, F.col(group).alias("group"), "vector")
    held = rows.where("vector is not null and not exists(vector, x -> x is null)")
    sizes = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"))
    told = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n"), F.max("dim")).first()
    all_pairs, n, dim = (int(v or 0) for v in told)
    least, largest = PAIR_ROWS
    # Tasks go by pairs and rows: bytes alone would put too many products into one.
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(all_pairs // (16 * PAIR_CELLS), n // largest)))
    side = max(1, min(max(least, int((all_pairs / tasks) ** 0.5)), largest, PAIR_BYTES // (8 * max(1, dim))))
    # Groups of more than `side` rows, so one row for as many rows of the table at most.
    large = sizes.where(F.col("n") > side).select("group", F.ceil(F.col("n") / side).alias("blocks"))
    dealt = held.join(F.broadcast(large), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(key, "group", "vector", F.size("vector").alias("dim"), "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    def run(cell: tuple, table: pa.Table) -> pa.Table:
        _, k, low, high = (c.as_py() for c in cell)
        block, names = table["block"].to_numpy(), table[key].combine_chunks()
        vectors = table["vector"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(block), k)
        ids = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        out = []
        for i, j in ((one, two),) if low == high else ((one, two), (two, one)):
            q, e, x = _best_others(vectors[i], ids[i], vectors[j], ids[j], most)
            out.append(pa.table({key: names.take(pa.array(i[q])), code: names.take(pa.array(j[e])), "score": x}))
        return pa.concat_tables(out)

    name = kind.simpleString()
    cells = ["group", "dim", "low", "high"]
    scored = met.repartition(tasks, *cells).groupBy(*cells).applyInArrow(run, f"{key} {name}, {code} {name}, score double")
    # The first two keys of each group: one of them is another than a row's own, if there is any.
    ends = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("group").orderBy(key))).where("nth <= 2")
    ends = ends.groupBy("group").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    first = rows.join(ends, "group").select(key, F.when(F.col(key) == F.col("a"), F.col("b")).otherwise(F.col("a")).alias(code), F.lit(None).cast("double").alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(code))
    every = scored.unionByName(first.where(F.col(key) != F.col(code)))
    return every.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def rerank_score(score: Column, name_overlap: Column, text_overlap: Column, profile_rank: Column, exactish: Column, code: Column) -> Column:
    """The weighted sum of recall, common words, profile, near-equality and how specific the code is."""
    dots = F.length(code) - F.length(F.regexp_replace(code, r"\.", ""))
    return score + name_overlap * 0.9 + text_overlap * 0.55 + F.least(profile_rank, F.lit(100)) / 100.0 * 0.45 + exactish + F.least(dots, F.lit(3)) * 0.03


def near_equal(query: Column, name: Column) -> Column:
    both = (query != "") & (name != "")
    return F.when(both & (query == name), 0.5).when(both & (name.contains(query) | query.contains(name)), 0.22).otherwise(0.0)


def ranked(rows: DataFrame, key: str, *by: Column) -> DataFrame:
    """rows with `place` from 1 in each key's order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by)).cast("bigint"))


def placed(rows: DataFrame, *by: Column) -> DataFrame:
    """rows with `place` from 1 in the order of the whole table, which is sorted by ranges; no task holds more than one of them.

    The sorted rows are written once, so that a range's first place, the count of rows before it, fits the rows as they lie.
    """
    packed = rows.sort(*by).select(F.struct("*").alias("row")).withColumn("number", F.monotonically_increasing_id())
    part = F.shiftright("number", 33)
    lying = checkpoint(packed.select("row", part.alias("part"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")))
    sizes = lying.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition, so the window and what is broadcast are as small as the number of partitions.
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lying.join(F.broadcast(before), "part").select("row.*", (F.col("before") + F.col("inside") + 1).alias("place"))


def needs_model(top: DataFrame, key: str = "query", gap: float = 0.16, least_rank: int = 85) -> DataFrame:
    """(key, gap, ask): whether the ranking of (key, place, score, profile_rank, confidence, n_words) is too close to settle.

    It is settled by a gap to the second, a high profile rank, a sure profile and a text of more than four words.
    """
    firsts = top.groupBy(key).agg(
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("one"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("two"),
        F.max(F.when(F.col("place") == 1, F.col("profile_rank"))).alias("rank"),
        F.max(F.when(F.col("place") == 1, F.col("confidence"))).alias("confidence"),
        F.max(F.when(F.col("place") == 1, F.col("n_words"))).alias("n_words"),
    )
    apart = F.col("one") - F.coalesce("two", F.lit(0.0))
    settled = (apart >= gap) & (F.col("rank") >= least_rank) & F.col("confidence").isin("strong", "medium") & (F.col("n_words") > 4)
    return firsts.select(key, apart.alias("gap"), (~settled).alias("ask"))


def promoted(rows: DataFrame, key: str, generic: str, name: str) -> DataFrame:
    """rows (key, code, name, place) with the generic code first; it is added where a key lacks it, and the others keep their order."""
    lacking = rows.groupBy(key).agg(F.max((F.col("code") == generic).cast("int")).alias("has")).where("has = 0")
    added = lacking.select(key, F.lit(generic).alias("code"), F.lit(name).alias("name"), F.lit(0).alias("place"))
    every = rows.select(key, "code", "name", F.col("place").cast("int").alias("place")).union(added)
    return ranked(every, key, F.col("code") != generic, F.col("place"))


def merged_order(candidates: DataFrame, chosen: DataFrame, key: str, most: int) -> DataFrame:
    """The candidates (key, code, place) in the order of chosen (key, code, choice): known chosen codes first, then the rest, `most` in all."""
    first = chosen.groupBy(key, "code").agg(F.min("choice").alias("choice"))
    every = candidates.join(first, [key, "code"], "left")
    out = ranked(every.drop("rank"), key, F.col("choice").isNull(), F.col("choice"), F.col("place").alias("p"))
    return out.where(F.col("place") <= most)


def serialized(rows: DataFrame, key: str, code: str = "code", name: str = "name", place: str = "place") -> DataFrame:
    """(key, candidates): `code name` of each row in order, joined by commas."""
    items = F.sort_array(F.collect_list(F.struct(place, F.concat_ws(" ", F.col(code), F.col(name)).alias("t"))))
    return rows.groupBy(key).agg(items.alias("i")).select(key, F.array_join(F.transform("i", lambda s: s["t"]), ", ").alias("candidates"))


def review_marks(rows: DataFrame, allowed: Column) -> Column:
    """Status of a row: manual review if it isn't allowed though one of its candidates is; the verdict stays."""
    from ..functions.text import MANUAL_REVIEW, label

    return F.when((F.col("verdict") == "not_allowed") & allowed, MANUAL_REVIEW).otherwise(label("verdict"))
