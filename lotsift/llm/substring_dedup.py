"""Removal of word runs that occur more than once in the corpus, by fixed-block anchors.

Any run of 35 words holds a whole one of the 18-word blocks laid end to end from its
document's start. So it suffices to index these non-overlapping blocks and to probe them with
every rolling 18-word window: a run that has a second occurrence holds a block that is hit. A hit
is then extended to the 35-word runs around it, each of which counts only if its own words have a
second start; runs that overlap join to the maximal exact repeats.

Both steps ask the same of the whole corpus, "does this hash occur twice or more?". Batches
of documents, packed as they lie side by side, send their hashes, sorted and made distinct, as packed rows to as many buckets
of the hash space; each bucket answers every batch with one bit per question. A passage that
a third of all documents hold costs one entry per batch, and no pair of documents is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, WindowHashes, batches, dealt, frugal, frugal_group, unpacked, words_of

_U = np.uint64
RUN_WORDS = 35
#: The longest block of which any run holds a whole one: 2 * 18 - 1 = 35.
BLOCK_WORDS = (RUN_WORDS + 1) // 2
#: Batches of text whose hashes meet in one bucket come to about this many bytes of text.
BUCKET_TEXT_BYTES = 12 << 20

_words, _windows = WORD_HASHES, WindowHashes()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def _places(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half and 32 more bits of the hash in the low half."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32) << _U(32)) | (h & _U(0xFFFFFFFF))


def _blocks(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rolling windows, and the indexes of those that are blocks."""
    rolling = _places(_windows.of(h, BLOCK_WORDS), buckets)
    return rolling, np.arange(0, len(rolling), BLOCK_WORDS)


def _around(hit: np.ndarray, n_runs: int) -> np.ndarray:
    """Starts of the runs that hold one of the blocks hit, as flags."""
    edge = np.zeros(n_runs + 1, dtype=np.int32)
    first = np.maximum(hit * BLOCK_WORDS - (RUN_WORDS - BLOCK_WORDS), 0)
    after = np.minimum(hit * BLOCK_WORDS + 1, n_runs)
    np.add.at(edge, np.minimum(first, n_runs), 1)
    np.add.at(edge, after, -1)
    return np.cumsum(edge[:-1]) > 0


def _packed(g: int, owner: np.ndarray, keys: np.ndarray, width: int, extra: dict) -> pd.DataFrame:
    """A row for each bucket with the keys (sorted by bucket) that go there and bits about each."""
    present, start, count = np.unique(owner, return_index=True, return_counts=True)
    rows = []
    for b, i, j in zip(present.tolist(), start, start + count, strict=True):
        rows.append([b, g, keys[i:j].astype(f"<u{width}").tobytes(), *(_bits(x[i:j]) for x in extra.values())])
    return pd.DataFrame(rows, columns=["bucket", "g", "keys", *extra])


def _probe(buckets: int):
    def one(g: int, batch: bytes) -> pd.DataFrame:
        rolling, asked = [], []
        for text in unpacked(batch)[1]:
            places, index = _blocks(_words.of(words_of(text)), buckets)
            rolling.append(places)
            asked.append(places[index])
        keys, counts = np.unique(np.concatenate(rolling), return_counts=True)
        question = np.zeros(len(keys), dtype=bool)
        question[np.searchsorted(keys, np.concatenate(asked))] = True
        return _packed(g, keys >> _U(32), keys & _U(0xFFFFFFFF), 4, {"many": counts > 1, "asks": question})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, batch in zip(part["g"], part["batch"], strict=True):
                yield one(g, batch)

    return run


def _answer(width: int):
    """The bits, in order, of the keys asked for: whether they occur twice or more in all batches of the bucket."""

    def run(pdf):
        keys = [np.frombuffer(k, dtype=f"<u{width}") for k in pdf["keys"]]
        many = np.concatenate([_flags(m, len(k)) for m, k in zip(pdf["many"], keys, strict=True)])
        flat = np.concatenate(keys)
        distinct, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
        often = counts > 1
        often[place[many]] = True
        often, at, rows = often[place], 0, []
        for g, k, asks in zip(pdf["g"], keys, pdf["asks"], strict=True):
            mine = often[at : at + len(k)]
            rows.append((g, int(pdf["bucket"].iloc[0]), _bits(mine[_flags(asks, len(k))])))
            at += len(k)
        return pd.DataFrame(rows, columns=["g", "bucket", "bits"])

    return run


def _told(keys: np.ndarray, owner: np.ndarray, answers: pd.DataFrame) -> np.ndarray:
    """Flags of the sorted keys from the answers of their buckets."""
    asked = answers["bucket"].to_numpy().astype(owner.dtype)
    first, after = np.searchsorted(owner, asked), np.searchsorted(owner, asked, side="right")
    out = np.zeros(len(keys), dtype=bool)
    for i, j, data in zip(first, after, answers["bits"], strict=True):
        out[i:j] = _flags(data, j - i)
    return out


def _candidates(texts, answers: pd.DataFrame, buckets: int):
    """For each text: its words, the hashes of its runs, and the starts of those around a block that was hit."""
    held = []
    for text in texts:
        words = words_of(text)
        h = _words.of(words)
        places, index = _blocks(h, buckets)
        held.append((words, h, places[index]))
    asked = np.unique(np.concatenate([x[2] for x in held]))
    hit = _told(asked, asked >> _U(32), answers)
    for words, h, blocks in held:
        n = max(0, len(h) - RUN_WORDS + 1)
        found = np.flatnonzero(hit[np.searchsorted(asked, blocks)]) if n else np.empty(0, dtype=np.int64)
        starts = np.nonzero(_around(found, n))[0] if len(found) else found
        yield words, starts, _windows.of(h, RUN_WORDS)[starts] if len(starts) else np.empty(0, dtype=_U)


def _owner(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(buckets)) >> _U(32)


def _extend(buckets: int):
    def run(key, docs, answers):
        texts = unpacked(docs["batch"].iloc[0])[1] if len(docs) else []
        runs = [h for _, _, h in _candidates(texts, answers, buckets)] if texts else []
        keys, counts = np.unique(np.concatenate(runs) if runs else np.empty(0, dtype=_U), return_counts=True)
        return _packed(key[0], _owner(keys, buckets), keys, 8, {"many": counts > 1, "asks": np.ones(len(keys), bool)})

    return run


def _cut(buckets: int):
    def run(key, docs, answers):
        first, second = (answers[answers["round"] == r] for r in (1, 2))
        ids, texts = unpacked(docs["batch"].iloc[0])
        held = list(_candidates(texts, first, buckets))
        keys = np.unique(np.concatenate([h for _, _, h in held])) if held else np.empty(0, dtype=_U)
        twice = _told(keys, _owner(keys, buckets), second)
        rows = []
        for i, (words, starts, h) in zip(ids, held, strict=True):
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            again = starts[twice[np.searchsorted(keys, h)]] if len(starts) else starts
            np.add.at(edge, again, 1)
            np.add.at(edge, again + RUN_WORDS, -1)
            kept = np.nonzero(np.cumsum(edge[:-1]) == 0)[0] if len(again) else range(len(words))
            text = b" ".join([words[k] for k in kept] if len(again) else words)
            rows.append((i, len(words), len(words) - len(kept), text.decode("utf-8")))
        return pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept_text"])

    return run


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, and kept_text, the kept words joined by a space.

    A word goes if it lies in a run of 35 words of one document whose words start anywhere
    else too, in the same document or another; runs are judged on the input. Null or blank text
    has no words and an empty kept_text. Rows that repeat an id are documents of their own, so
    equal ones repeat each other; of rows that share a run each loses it. A text of any length is read whole. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    rows, n = batches(docs, doc_id, text)
    buckets = max(1, math.ceil(n * (4 << 20) / BUCKET_TEXT_BYTES))
    packed = "bucket int, g bigint, keys binary, many binary, asks binary"
    answer = "g bigint, bucket int, bits binary"
    placed = dealt(rows, "g", n)
    hits = dealt(rows.mapInPandas(frugal(_probe(buckets)), packed), "bucket", buckets).groupBy("bucket").applyInPandas(frugal_group(_answer(4)), answer)
    extended = placed.groupBy("g").cogroup(hits.groupBy("g")).applyInPandas(frugal_group(_extend(buckets)), packed)
    runs = dealt(extended, "bucket", buckets).groupBy("bucket").applyInPandas(frugal_group(_answer(8)), answer)
    told = hits.withColumn("round", F.lit(1)).union(runs.withColumn("round", F.lit(2)))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = placed.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(
        frugal_group(_cut(buckets)), "id string, n_words bigint, n_removed bigint, kept_text string"
    )
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)
