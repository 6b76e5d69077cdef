"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so half the hash evaluations fill a signature; each agrees with a probability equal to
the Jaccard similarity. Bands of the signature give candidate buckets, and every link is
confirmed on the full shingle sets of both texts.

Buckets are never expanded into all pairs. Documents with equal sets form one class. In each
bucket a hub (the document that shares most buckets) is held against the others. Of what is still
unconnected then, small buckets give their pairs; large ones are cut into blocks that hold the
sets, and a block confirms its pairs where they first meet and sends on no more links than join its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, WordHashes, checkpoint, components, frugal, frugal_group, lower_words_of, mix, stored

_U = np.uint64
SHINGLE_WORDS = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 64 permutations give 128 values; a pair of similarity 0.75 misses all 32 bands of 4 with p = 5e-6.
PERMUTATIONS = 64
BAND_ROWS = 4
#: Of the 128 one-byte sketch values, so many agree for all but 3e-7 of pairs of similarity 0.75.
SKETCH_LEAST = 72
#: Buckets of more documents than this are compared block by block; a block's half holds so many documents or shingles.
SMALL_BUCKET = 48
BLOCK, BLOCK_SHINGLES = 1024, 400_000

_seeds = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, size=(2, PERMUTATIONS), dtype=np.int64).astype(_U)
_MULTIPLIERS, _XORS = _seeds[0] | _U(1), _seeds[1]
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it has fewer words."""
    words = lower_words_of(text)
    if not words:
        return np.empty(0, dtype=_U)
    h = hashes.of(words)
    if len(h) < SHINGLE_WORDS:
        return mix((h * _PLACES[: len(h)]).sum(keepdims=True) + _U(len(h)))
    n = len(h) - SHINGLE_WORDS + 1
    total = np.zeros(n, dtype=_U)
    for i, place in enumerate(_PLACES):
        total += mix(h[i : i + n]) * place
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, interleaved."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=_U)
    high = np.zeros(PERMUTATIONS, dtype=_U)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096, None] ^ _XORS) * _MULTIPLIERS
        np.minimum(low, part.min(axis=0), out=low)
        np.maximum(high, part.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def _bands(sig: np.ndarray) -> np.ndarray:
    # Minimum and maximum of one permutation go to different bands.
    rows = mix(np.concatenate([sig[0::2], sig[1::2]])).reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=_U)
    for i in range(BAND_ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WORD_HASHES
    for part in parts:
        rows = []
        for i, text in zip(part["id"], part["text"], strict=True):
            s = shingle_set(text, hashes)
            if len(s):
                sig = signature(s)
                keep = mix(np.array([s.sum(), np.bitwise_xor.reduce(s) + _U(len(s))], dtype=_U)).tobytes()
                rows.append((i, len(s), keep, _bands(sig), (mix(sig) >> _U(56)).astype(np.uint8).tobytes()))
            else:
                rows.append((i, 0, None, None, None))
        yield pd.DataFrame(rows, columns=["id", "n", "set_key", "bands", "sketch"])


def _similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WORD_HASHES
    last, held = None, None
    for part in parts:
        keep = []
        for ta, tb in zip(part["ta"], part["tb"], strict=True):
            # An id may have several texts, so it is the text that tells whether the set is at hand.
            if held is None or ta != last:
                last, held = ta, shingle_set(ta, hashes)
            other = shingle_set(tb, hashes)
            both = len(np.intersect1d(held, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(held) + len(other) - both))
        yield part.loc[keep, ["a", "b"]]


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold; texts: (id, text)."""
    first = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = first.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "ta", "tb").mapInPandas(frugal(_similar), f"a {kind}, b {kind}")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.select(F.col("node").alias("id"), "label")
    return buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _undecided(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets whose documents aren't yet all connected, with the bucket's size and its number of shingles."""
    mixed = (
        buckets.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo != hi")
        .select("key", "size", "mass")
    )
    return buckets.join(mixed, "key")


def _hub_pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's hub with the documents that aren't connected to it; the rows without hubs."""
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    rows = buckets.join(degree, "id")
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("id", "label"), F.struct("degree", "id")).alias("hub"))
    rows = rows.drop("degree", "size", "mass").join(hubs, "key").where("id != hub.id")
    pairs = rows.where("label != hub.label").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    return pairs, rows.drop("hub")


def _sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WORD_HASHES
    for part in parts:
        yield pd.DataFrame({"id": part["id"], "shingles": [shingle_set(t, hashes).tobytes() for t in part["text"]]})


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    found = one[np.minimum(at, len(one) - 1)] == flat
    return np.add.reduceat(found, np.cumsum([0] + [len(o) for o in others[:-1]]), dtype=np.int64)


def _block_links(key, rows):
    """Links of one block (two chunks of one bucket) that join documents of different labels, no more than join them."""
    band_key, i, j = key
    rows = rows.sort_values(["chunk", "id"], ignore_index=True)
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
    bands = np.stack(rows["bands"].to_numpy())
    here = (bands == band_key).argmax(axis=1)
    sets = [np.frombuffer(b, dtype=_U) for b in rows["shingles"]]
    ids, chunk, label = (rows[c].to_numpy() for c in ("id", "chunk", "label"))
    label = label.copy()
    links = []
    for r in range(len(rows) if i == j else int((chunk == i).sum())):
        other = np.arange(r + 1, len(rows)) if i == j else np.flatnonzero(chunk == j)
        other = other[label[other] != label[r]]
        other = other[(sketch[other] == sketch[r]).sum(axis=1) >= SKETCH_LEAST]
        # A pair that meets in more than one bucket is confirmed in the first.
        other = other[(bands[other] == bands[r]).argmax(axis=1) == here[r]]
        for s in range(0, len(other), 256):
            part = other[s : s + 256]
            both = _overlaps(sets[r], [sets[k] for k in part])
            sizes = np.array([len(sets[k]) for k in part])
            for k in part[100 * both >= PERCENT * (len(sets[r]) + sizes - both)]:
                if label[k] != label[r]:
                    links.append((ids[r], ids[k]))
                    label[label == label[k]] = label[r]
    return pd.DataFrame(links, columns=["a", "b"])


def _rest_links(buckets: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among documents of one bucket that aren't connected yet."""
    small, large = buckets.where(F.col("size") <= SMALL_BUCKET), buckets.where(F.col("size") > SMALL_BUCKET)
    left, right = (small.select("key", F.col("id").alias(i), F.col("label").alias(f"l{i}")) for i in "ab")
    few = left.join(right, "key").where("a < b and la != lb").select("a", "b").distinct()
    large = checkpoint(large)
    kind = buckets.schema["id"].dataType.simpleString()
    sets = texts.join(large.select("id").distinct(), "id", "left_semi").mapInPandas(frugal(_sets), f"id {kind}, shingles binary")
    n = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    chunk = F.pmod(F.xxhash64("id", "key"), n).cast("int")
    spread = (
        large.join(known.select("id", "bands", "sketch").join(sets, "id"), "id")
        .select("key", "id", "label", "sketch", "bands", "shingles", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        .select("*", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    return confirm(few, texts).union(spread.groupBy("key", "i", "j").applyInPandas(frugal_group(_block_links), f"a {kind}, b {kind}"))


def _shared_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of rows that share an id but not their set."""
    odd = usable.groupBy("id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("two")).where("one != two").select("id", "one")
    rows = usable.select("id", "set_key").join(odd, "id").where("set_key != one").select("one", "set_key").distinct()
    reps = rows.join(classes.select(F.col("set_key").alias("one"), F.col("rep").alias("a")), "one")
    return reps.join(classes.select("set_key", F.col("rep").alias("b")), "set_key").select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable over links), kept.

    A null or blank text has the empty set and links with nothing, so it is kept; rows that
    share an id count as one document: those with a set get the same component, which joins what their sets
    link with. A null id gives a null component and is kept. The set of a text of any length is taken whole. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    signed = checkpoint(
        base.mapInPandas(frugal(_sign), "id string, n int, set_key binary, bands array<bigint>, sketch binary").withColumn("id", F.col("id").cast(kind))
    )
    usable = signed.where("n > 0 and id is not null")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("rep"))
    firsts = usable.join(classes.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"]).dropDuplicates(["id", "set_key"])
    rows = firsts.select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    buckets = checkpoint(rows.join(shared, "key").select("key", "id", "n"))
    wanted = buckets.select("id").distinct()
    texts = stored(base.withColumn("id", F.col("id").cast(kind)).join(wanted, "id", "left_semi"))

    pairs, rest = _hub_pairs(checkpoint(_undecided(buckets.withColumn("label", F.col("id")))))
    links = checkpoint(confirm(pairs, texts))
    open_rows = checkpoint(_undecided(_labelled(rest.select("key", "id", "n"), components(links))))
    labels = components(links.union(_rest_links(open_rows, firsts, texts)).union(_shared_ids(usable, classes)))

    named = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component")
    )
    return (
        signed.select("id", "n", "set_key")
        .join(named, "set_key", "left")
        .select(
            F.col("id").alias(doc_id),
            F.col("n").cast("bigint").alias("n_shingles"),
            F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), "id").alias("component_id"),
        )
        .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))
    )
