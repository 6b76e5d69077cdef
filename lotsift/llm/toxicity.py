"""Toxicity of texts by maximum-scoring segments of token log-odds.

A token is scored by the log-odds of the toxic label among labelled documents that hold it, against all of
them. The odds have Dirichlet priors in a chain: the whole corpus is the prior of a word's first three code points,
these of its first four, and so on up to the word, so an unseen word of a known stem has its stem's
odds. A step of the chain that the counts don't call for (a likelihood-ratio test) keeps those before it.

From each score a drift is taken, so a clean text loses as it goes on. One scan in linear time finds every maximal
scoring segment of a text (Ruzzo and Tompa); extreme-value theory tells how many segments of a score or more chance
would give in a clean text of n tokens, E = K n exp(-lambda s) (Karlin and Altschul). Lambda solves
sum p(s) exp(lambda s) = 1 over the scores of clean tokens, K is the likeliest value for the best segments of clean
documents. A document's evidence is the sum of -ln E over its segments of different wording with E below 1, and a
logistic curve over it, fitted on labelled documents that took no part in the counts, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: A document whose crc32 of the id as text gives HELD_OUT mod FOLDS isn't learned from; those with CALIBRATES fit the curve, the rest are counted.
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 4
#: Labelled documents of each label that are learned from at most, those of the lowest hashes; their whole texts count.
MOST_LABELLED = 20_000
#: Features that the model looks at at most, and documents that hold each at least.
MOST_FEATURES, LEAST_DOCS = 300_000, 5
#: Code points of the shortest and the longest stem.
STEMS = (3, 8)
#: Documents that a prior counts as.
PRIOR = 4.0
#: Least likelihood-ratio statistic (chi-squared, one degree) for odds other than the stem's before: p = 0.0005.
LEAST_G2 = 12.0
DRIFT = 0.5
#: A passage is reported if chance gives at most this many as good ones in a text of its length.
MOST_CHANCE = 0.05
#: Scores are counted in steps of this size for lambda.
STEP = 0.05

_BLANKS = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs of characters other than ASCII marks, blanks and controls."""
    if not text:
        return []
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).decode().split()


def features_of(word: str) -> list[str]:
    """Stems of the word from short to long, and the word, which an end mark sets apart from a stem."""
    return [*(word[:k] for k in range(STEMS[0], min(len(word), STEMS[1]) + 1)), word + "$"]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in order, in time linear in the scores (Ruzzo and Tompa).

    A segment found is kept on a stack with the sums before it and up to its end and with the place of the nearest
    one below it whose sum before is lower; only positive scores can begin or end one, so the others are skipped.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, first, last, below = [], [], [], [], []
    for k, low, high in zip(up.tolist(), sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        start, j = k, len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = below[j]
            if j < 0 or right[j] >= high:
                break
            # The new one joins all from j on into one segment.
            start, low, before = first[j], left[j], below[j]
            del left[j:], right[j:], first[j:], last[j:], below[j:]
            j = before
        left.append(low)
        right.append(high)
        first.append(start)
        last.append(k)
        below.append(j)
    return [(i, j, b - a) for i, j, a, b in zip(first, last, left, right, strict=True)]


def unlike(words: list[str], found: list[tuple[int, int, float]]) -> list[float]:
    """Scores of the segments, those of equal words once: a text that repeats itself has no more evidence for that."""
    return list({tuple(words[a : b + 1]): score for a, b, score in found}.values())


def lowest_root(values: np.ndarray, shares: np.ndarray) -> float:
    """The lambda > 0 with sum shares exp(lambda values) = 1; the mean must be below 0 and some value above."""
    low, high = 0.0, 1.0
    while (shares * np.exp(np.minimum(high * values, 600))).sum() < 1:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 at least) of the curve for labels y, with a weak pull of the slope to 0.2."""
    a, b = 0.0, 0.2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        gradient = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - (b - 0.2)])
        curve = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        step = np.clip(np.linalg.solve(curve, gradient), -1, 1)
        a, b = a + step[0], max(0.0, b + step[1])
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def odds_table(counts: dict[str, tuple[int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Log-odds against all documents of the features (documents with label 0, with label 1) whose odds differ from their stem's."""
    share = (toxic + 0.5) / (clean + toxic + 1)
    base = math.log(share / (1 - share))
    held: dict[str, float] = {}
    out = {}

    def before(feature: str) -> float:
        stem = feature[:-1]
        while len(stem) >= STEMS[0]:
            if stem in held:
                return held[stem]
            stem = stem[:-1]
        return share

    for feature in sorted(counts, key=lambda f: (len(f), f.endswith("$"), f)):
        none, some = counts[feature]
        n, prior = none + some, before(feature)
        g2 = 2 * sum(k * math.log(k / (n * p)) for k, p in ((some, prior), (none, 1 - prior)) if k)
        if g2 >= LEAST_G2:
            held[feature] = t = (some + PRIOR * prior) / (n + PRIOR)
            out[feature] = math.log(t / (1 - t)) - base
    return out


class TokenScores(dict):
    """Score of each word seen, from its longest feature in the table; emptied when it holds many."""

    def __init__(self, table: dict[str, float]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        found = next((self.table[f] for f in reversed(features_of(word)) if f in self.table), 0.0) - DRIFT
        if len(word) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.float64, count=len(words))


@dataclass
class Model:
    """Log-odds of features; lambda and K of chance segments; intercept and slope of the curve over evidence."""

    table: dict[str, float]
    rate: float
    k: float
    intercept: float
    slope: float

    def chance(self, score: float, n: int) -> float:
        """Segments of this score or more that a clean text of n tokens is expected to have."""
        return self.k * n * math.exp(-min(self.rate * score, 700))

    def evidence(self, scores: list[float], n: int) -> float:
        return sum(max(0.0, -math.log(max(self.chance(s, n), 1e-300))) for s in scores)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def _fold(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that hold each feature; the empty feature is in all."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def told() -> pd.DataFrame:
        every = list(held[0].keys() | held[1].keys())
        out = pd.DataFrame({"feature": every, "clean": [held[0][f] for f in every], "toxic": [held[1][f] for f in every]})
        for c in held:
            c.clear()
        return out

    for part in parts:
        for text, toxic in zip(part["text"], part["toxic"], strict=True):
            found = {""}
            for word in set(tokens_of(text)):
                found.update(features_of(word))
            held[toxic].update(found)
            if len(held[0]) + len(held[1]) > 400_000:
                yield told()
    if held[0] or held[1]:
        yield told()


def _measure(table: dict[str, float]):
    """Of each labelled text: number of tokens, scores of its segments, and its token scores by step with their numbers."""
    known = TokenScores(table)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for h, text, toxic in zip(part["h"], part["text"], part["toxic"], strict=True):
                words = tokens_of(text)
                scores = known.of(words)
                steps, n = np.unique(np.round(scores / STEP).astype(np.int64), return_counts=True)
                rows.append((h, int(toxic), len(scores), unlike(words, segments(scores)), steps, n))
            yield pd.DataFrame(rows, columns=["h", "toxic", "n", "found", "steps", "times"])

    return run


def _calibrated(table: dict[str, float], rows: list) -> Model:
    """The model of a table and of measured labelled texts."""
    clean = [r for r in rows if not r["toxic"] and r["n"]]
    times: Counter = Counter()
    for r in clean:
        times.update(dict(zip(r["steps"], r["times"], strict=True)))
    # One chance token for each score that the table can give, so that lambda is finite.
    times.update({round((x - DRIFT) / STEP): 1 for x in table.values() if x > DRIFT} or {1: 1})
    times[round(-DRIFT / STEP)] += 100
    values = np.array(list(times), dtype=np.float64) * STEP
    shares = np.array(list(times.values()), dtype=np.float64) / sum(times.values())
    # Without a mean below 0 there is no lambda: such scores can't tell anything.
    rate = lowest_root(values, shares) if (values * shares).sum() < 0 else 1e-3
    weight = sum(r["n"] * math.exp(-min(rate * max(r["found"], default=0.0), 700)) for r in clean)
    model = Model(table, rate, max(1e-12, len(clean) / weight if weight else 1e-2), 0.0, 0.0)
    if rows:
        x = np.array([model.evidence(r["found"], r["n"]) for r in rows])
        model.intercept, model.slope = logistic(x, np.array([r["toxic"] for r in rows], dtype=np.float64))
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """The model of the labelled documents outside the held-out fold.

    Labels other than 0 and 1 are none; an id with several has the largest. Of each label at most `most` ids are
    learned from, in the order of their hashes; all rows of such an id count.
    """
    marks = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("toxic"))
        .where("toxic in (0, 1) and id is not null")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .where(_fold("id") != HELD_OUT)
        .withColumn("h", F.xxhash64("id", F.lit(13)))
    )
    picked = None
    for label in (0, 1):
        own = marks.where(F.col("toxic") == label).orderBy("h", "id").limit(most)
        picked = own if picked is None else picked.union(own)
    # At most 2 * most rows.
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(picked), "id")
    held = (
        chosen.where(_fold("id") != CALIBRATES)
        .select("text", "toxic")
        .mapInPandas(frugal(_count), "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    )
    every = held.where("feature = ''").first()
    if every is None:
        return _calibrated({}, [])
    weight = F.col("clean") / F.lit(max(1, every["clean"])) + F.col("toxic") / F.lit(max(1, every["toxic"]))
    rows = held.where("feature != ''").orderBy(weight.desc(), F.length("feature"), "feature").limit(MOST_FEATURES).collect()
    table = odds_table({r["feature"]: (r["clean"], r["toxic"]) for r in rows}, every["clean"], every["toxic"])
    measured = (
        chosen.where(_fold("id") == CALIBRATES)
        .select(F.xxhash64("id", "text").alias("h"), "text", "toxic")
        .mapInPandas(frugal(_measure(table)), "h bigint, toxic int, n bigint, found array<double>, steps array<bigint>, times array<bigint>")
        .orderBy("h")
        .limit(2 * most)
        .collect()
    )
    return _calibrated(table, measured)


def toxic_passages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, passages (first and last token, score, chance: all with chance of MOST_CHANCE at most), score and predicted.

    The score lies between 0 and 1; predicted is 1 from 0.5 on. A null, empty or blank text has no token and the score of no evidence. A text
    of any length is read whole, in one scan. Rows are independent, so repeated ones get equal results.
    Columns of docs that have the names of results are replaced; an empty table gives an empty result.
    """
    made = ("n_tokens", "passages", "score", "predicted")
    names = [c for c in docs.columns if c not in made]
    result = "n_tokens bigint, passages array<struct<first:bigint,last:bigint,score:double,chance:double>>, score double, predicted int"
    schema = docs.select(*names).schema
    for field in docs.sparkSession.createDataFrame([], result).schema:
        schema = schema.add(field)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
    known = TokenScores(model.table)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for i in range(0, len(whole), 1024):
                part = whole.slice(i, 1024)
                sizes, found, p = [], [], []
                for value in part.column(text):
                    words = tokens_of(value.as_py())
                    scores = known.of(words)
                    n, own = len(scores), segments(scores)
                    sizes.append(n)
                    told = [(a, b, s, model.chance(s, n)) for a, b, s in own]
                    found.append([dict(zip(("first", "last", "score", "chance"), x, strict=True)) for x in told if x[3] <= MOST_CHANCE])
                    p.append(model.probability(model.evidence(unlike(words, own), n)))
                columns = [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], names=[*names, *made])

    return docs.select(*names).mapInArrow(frugal(run), schema)


def toxicity_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """One row per row of docs: id, held_out (not learned from, by its fold), score, predicted, n_tokens and passages.

    Learned from the labels; without any, or without one of both labels, scores follow the labels' shares alone. A null id is in no fold
    and isn't learned from. Repeated rows each have a row, with equal results. Null and empty texts have a score too. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, doc_id, text, toxic)
    out = toxic_passages(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), model, "_text")
    return out.select(
        F.col("_id").alias(doc_id), F.coalesce(_fold("_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "n_tokens", "passages"
    )
