"""Language-model scores of whole texts with a weighted backoff automaton.

The model is a word n-gram model with Dirichlet smoothing at every order down to a smoothed unigram:
p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), h' being h without its oldest word, and
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
As an automaton: a state per history h, an arc for each n-gram hw seen in training, with weight
log10 p(w | h), and a failure arc with weight log10(mu / (c(h) + mu)) to the state of h', down to the root,
whose arcs weigh log10 p(w). One left-to-right traversal of a text carries the state and adds up the
weights; the texts of a batch are traversed side by side.

Counts cover every training text and no model ever lies in one place: batches of documents
send their distinct n-grams with their own counts, packed, to buckets of the hash space; each
bucket adds up and answers every batch with the corpus counts of the n-grams it sent. From
the answers a batch compiles the part of the automaton that its own texts can reach. N and V are added up by
themselves, from one row a bucket.

A word is its 64-bit hash. A longer n-gram has 48 bits within its bucket, whose share of the corpus is bounded;
so at any size some 10^-8 of them share the count of another one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, batches, dealt, frugal, frugal_group, lower_words_of, mix, numbers, planes, stored, unnumbers, unpacked, unplanes

_U = np.uint64
#: Weight of the next lower order, in tokens, for bigrams and all longer n-grams.
MU = 50.0
MU_LONGER = 2.0
ORDER = 3
ADDED = 0.1
#: A document whose crc32 of the id as text gives this remainder isn't learned from.
FOLDS, HELD_OUT = 10, 0
_END = _U(0x5851F42D4C957F2D)
_START = _U(0x14057B7EF767814F)
BUCKET_TEXT_BYTES = 12 << 20

_words = WORD_HASHES


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, then the end."""
    return np.append(_words.of(lower_words_of(text)), _END)


def _pairs(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(history) * _U(0x9E3779B97F4A7C15) + word)


class _Batch:
    """The distinct n-grams of a batch by order (from 1), their own counts in training texts, and which stands where in its texts."""

    def __init__(self, ids: list, texts: list, order: int):
        tokens = [_tokens(t) for t in texts]
        self.lengths = np.array([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        learned = np.repeat([not held_out(i) for i in ids], self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.texts_learned = sum(not held_out(i) for i in ids)
        self.keys, self.at, self.counts = [], [], []
        gram = flat
        for k in range(order):
            if k:
                history = np.roll(gram, 1)
                history[self.first] = _START
                gram = _pairs(history, flat)
            keys, at = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(at[learned], minlength=len(keys)))


def _bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(((keys >> _U(32)) * _U(buckets)) >> _U(32), np.arange(buckets + 1))


def _within(keys: np.ndarray, buckets: int) -> np.ndarray:
    """48 bits of sorted keys within their bucket, which rise with the key."""
    return (((keys >> _U(32)) * _U(buckets)) & _U(0xFFFFFFFF)) << _U(16) | (keys >> _U(16)) & _U(0xFFFF)


def _send(buckets: int, order: int):
    def one(g: int, data: bytes) -> pd.DataFrame:
        batch = _Batch(*unpacked(data), order)
        cuts = [_bucket_cuts(keys, buckets) for keys in batch.keys]
        longer = [_within(keys, buckets) for keys in batch.keys[1:]]
        rows = []
        for b in np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist():
            own = [slice(c[b], c[b + 1]) for c in cuts]
            grams = [planes(batch.keys[0][own[0]], 8), *(numbers(np.diff(x[s], prepend=_U(0))) for x, s in zip(longer, own[1:], strict=True))]
            rows.append((b, g, grams, [numbers(c[s]) for c, s in zip(batch.counts, own, strict=True)]))
        return pd.DataFrame(rows, columns=["bucket", "g", "grams", "counts"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, data in zip(part["g"], part["batch"], strict=True):
                yield one(g, data)

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by distinct key, and the place of every key given among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return np.bincount(at, weights=np.concatenate(counts).astype(np.float64), minlength=len(distinct)), at


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a bucket answers to each batch: corpus counts in the order asked; and under g = -1 its share of V and N."""
    bucket, told, known, n = int(pdf["bucket"].iloc[0]), [], 0, 0
    for k in range(len(pdf["grams"].iloc[0])):
        if k:
            keys = [np.cumsum(unnumbers(x[k]), dtype=_U) for x in pdf["grams"]]
        else:
            keys = [unplanes(x[k], 8) for x in pdf["grams"]]
        total, at = _totals(keys, [unnumbers(x[k]) for x in pdf["counts"]])
        if not k:
            known, n = int((total > 0).sum()), int(total.sum())
        answers = total[at].astype(np.int64)
        told.append([numbers(x) for x in np.split(answers, np.cumsum([len(x) for x in keys])[:-1])])
    rows = [(g, bucket, list(counts), 0, 0) for g, *counts in zip(pdf["g"], *told, strict=True)]
    return pd.DataFrame([*rows, (-1, bucket, [], known, n)], columns=["g", "bucket", "counts", "known", "n"])


class BackoffAutomaton:
    """The automaton of a bigram model with its arcs spelled out, for one text at a time.

    States are histories (numbered words, and -1 for a text's start); the root has no number.
    arcs: weight by state * n_words + word; failure: weight by state; root: weight by word.
    """

    def __init__(self, n_words: int, arcs: dict[int, float], failure: list[float], root: list[float]):
        self.n_words, self.arcs, self.failure, self.root = n_words, arcs, failure, root

    def score(self, tokens: list[int]) -> float:
        """log10 probability of the tokens: an arc where the state has one, else failure and then the root's arc."""
        arcs, failure, root, n = self.arcs.get, self.failure, self.root, self.n_words
        state, total = -1, 0.0
        for word in tokens:
            weight = arcs(state * n + word)
            total += failure[state] + root[word] if weight is None else weight
            state = word
        return total


class Automaton:
    """The part of the automaton that a batch can reach.

    arcs[k]: weight of the arc of each (k + 1)-gram of the batch, nan where training has none (the root, k = 0, has all);
    failure[k]: weight of the failure arc of each history of k words, the last entry being a text's start.
    """

    def __init__(self, arcs: list[np.ndarray], failure: list[np.ndarray | None]):
        self.arcs, self.failure = arcs, failure

    @classmethod
    def compiled(cls, batch: _Batch, counts: list[np.ndarray], texts: int, p: np.ndarray, mus: list[float]) -> Automaton:
        """From the corpus counts of the batch's n-grams, the number of training texts and the unigrams' probabilities p."""
        arcs, failure = [np.log10(p)], [None]
        for k, mu in enumerate(mus, 1):
            where = np.zeros(len(counts[k]), dtype=np.int64)
            where[batch.at[k]] = np.arange(len(batch.at[k]))
            before = batch.at[k - 1][where - 1]
            of = np.where(np.isin(where, batch.first), float(texts), counts[k - 1][before])
            p = (counts[k] + mu * p[batch.at[k - 1][where]]) / (of + mu)
            arcs.append(np.where(counts[k] > 0, np.log10(p), np.nan))
            failure.append(np.log10(mu / (np.append(counts[k - 1], texts) + mu)))
        return cls(arcs, failure)

    def traverse(self, batch: _Batch) -> np.ndarray:
        """log10 probability of each text: at every token an arc of the state, or failure arcs down to a state that has one."""
        total = np.zeros(len(batch.at[0]))
        standing = np.arange(len(total))
        for k in range(len(self.arcs) - 1, 0, -1):
            weight = self.arcs[k][batch.at[k][standing]]
            has = ~np.isnan(weight)
            total[standing[has]] += weight[has]
            standing = standing[~has]
            state = batch.at[k - 1][standing - 1]
            state[np.isin(standing, batch.first)] = -1
            total[standing] += self.failure[k][state]
        total[standing] += self.arcs[0][batch.at[0][standing]]
        return np.add.reduceat(total, batch.first)


def _score(mus: list[float], n: int, v: int, texts: int):
    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(key, docs, answers):
        if not len(docs):
            return pd.DataFrame(columns=names)
        ids, raw = unpacked(docs["batch"].iloc[0])
        batch = _Batch(ids, raw, len(mus) + 1)
        answers = answers.sort_values("bucket")
        counts = [np.concatenate([unnumbers(x[k]) for x in answers["counts"]]).astype(np.float64) for k in range(len(mus) + 1)]
        p = (counts[0] + ADDED) / (n + ADDED * (v + 1))
        at, first = batch.at[0], batch.first
        known = np.add.reduceat((counts[0] > 0)[at].astype(np.int64), first)
        base = np.add.reduceat(np.log10(p)[at], first)
        score = Automaton.compiled(batch, counts, texts, p, mus).traverse(batch)
        return pd.DataFrame(dict(zip(names, (ids, [held_out(i) for i in ids], batch.lengths, known, n, base, score), strict=True)))

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu: float = MU, order: int = 2, mu_longer: float = MU_LONGER) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z in lower case, and one end. A null or blank text is the end
    alone; a text of any length is scored whole. Rows that repeat an id each count and are each scored; a null id counts
    as the text "None" in the fold. Without training texts every token is unknown. Other columns, whatever their
    names, are ignored. An empty table gives an empty result.
    """
    rows, n = batches(docs, doc_id, text)
    buckets = max(1, math.ceil(n * (4 << 20) / BUCKET_TEXT_BYTES))
    sent = rows.mapInPandas(frugal(_send(buckets, order)), "bucket int, g bigint, grams array<binary>, counts array<binary>")
    told = stored(
        dealt(sent, "bucket", buckets).groupBy("bucket").applyInPandas(frugal_group(_add_up), "g bigint, bucket int, counts array<binary>, known bigint, n bigint")
    )
    # crc32 gives a null for a null id, which Python sees as the text None.
    fold = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("None")).cast("binary")), F.lit(FOLDS))
    texts = docs.where(fold != HELD_OUT).count()
    v, tokens = told.where("g = -1").agg(F.sum("known"), F.sum("n")).first()
    mus = [mu, *[mu_longer] * (order - 2)][: order - 1]
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = dealt(rows, "g", n).groupBy("g").cogroup(told.where("g >= 0").select("g", "bucket", "counts").groupBy("g")).applyInPandas(
        frugal_group(_score(mus, tokens or 0, v or 0, texts)),
        "id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return scored.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)
