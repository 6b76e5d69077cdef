"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads segments of 96 bytes from both ends, gives every byte position a
distribution over the languages, and a document's is the mean over its letters. It is trained here,
in numpy, by backpropagation through time.

Fitting uses a bounded sample: of each language, the different documents of lowest hash of their id and text, at
most SAMPLE_DOCS of them (less where the languages are so many that SAMPLE_ALL is reached), and of each at most
SAMPLE_CHARS consecutive characters. Of more than MOST_LANGUAGES labels the most frequent are learned. Prediction reads every byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal

SEGMENT = 96
HIDDEN = 8
SAMPLE_DOCS = 1200
SAMPLE_CHARS = 384
#: Languages that are learned, the most frequent ones, and documents of the sample in all: a dozen for each of so many languages.
MOST_LANGUAGES = 1000
SAMPLE_ALL = 12_000
STEPS = 320
MINIBATCH = 384
#: Segments that go through the network together.
WIDE = 4096
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


@dataclass
class Direction:
    """One direction's weights: of bytes (256 x H) and of the state (H x H) for reset gate, update gate and candidate, and to the languages."""

    bytes: list[np.ndarray]
    state: list[np.ndarray]
    out: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.bytes, *self.state, self.out]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.bias]


def _new(languages: list[str]) -> Network:
    r = np.random.Generator(np.random.PCG64(11))

    def normal(a: int, b: int, s: float) -> np.ndarray:
        return r.normal(0, s, (a, b)).astype(np.float32)

    def direction() -> Direction:
        return Direction([normal(256, HIDDEN, 0.4) for _ in range(3)], [normal(HIDDEN, HIDDEN, 0.4) for _ in range(3)], normal(HIDDEN, len(languages), 0.4))

    return Network(languages, direction(), direction(), np.zeros(len(languages), dtype=np.float32))


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place: the network's sigmoid, of which a gate is a half plus a half."""
    np.abs(x, out=room)
    room += np.float32(1)
    x /= room


def _run(d: Direction, x: np.ndarray, order: range, trace: list | None = None) -> np.ndarray:
    """States (time, width, H) after each byte of x (time, width), read in the given order."""
    width, half = x.shape[1], np.float32(0.5)
    states = np.empty((len(x), width, HIDDEN), dtype=np.float32)
    h = np.zeros((width, HIDDEN), dtype=np.float32)
    r, z, n, q, room = (np.empty_like(h) for _ in range(5))
    for t in order:
        if trace is not None:
            r, z, n, q = (np.empty_like(h) for _ in range(4))
        for gate, table, weights in zip((r, z), d.bytes, d.state, strict=False):
            np.take(table, x[t], axis=0, out=gate, mode="clip")
            np.matmul(h, weights, out=room)
            gate += room
            _squash(gate, room)
            gate *= half
            gate += half
        np.take(d.bytes[2], x[t], axis=0, out=n, mode="clip")
        np.matmul(h, d.state[2], out=q)
        np.multiply(r, q, out=room)
        n += room
        _squash(n, room)
        if trace is not None:
            trace.append((t, h, r, z, q, n))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return states


def _through_time(d: Direction, x: np.ndarray, trace: list, above: np.ndarray) -> list[np.ndarray]:
    """Gradients of the direction's weights of bytes and of the state; above: of the loss by state (time, width, H)."""
    by_byte = [np.empty_like(above) for _ in range(3)]
    by_state = [np.zeros_like(w) for w in d.state]
    carried = np.zeros_like(above[0])
    for t, h, r, z, q, n in reversed(trace):
        dh = above[t] + carried
        dn = dh * (1 - z) * np.square(1 - np.abs(n))
        dr = dn * q * 0.5 * np.square(1 - np.abs(2 * r - 1))
        dz = dh * (h - n) * 0.5 * np.square(1 - np.abs(2 * z - 1))
        carried = dh * z
        for k, (grad, inner) in enumerate(((dr, dr), (dz, dz), (dn, dn * r))):
            by_byte[k][t] = grad
            by_state[k] += h.T @ inner
            carried += inner @ d.state[k].T
    flat = x.ravel()
    tables = [
        np.stack([np.bincount(flat, weights=g[:, :, f].ravel(), minlength=256) for f in range(HIDDEN)], axis=1).astype(np.float32)
        for g in by_byte
    ]
    return [*tables, *by_state]


def _distributions(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Probabilities (languages, time, width)."""
    p = net.ahead.out.T @ ahead.reshape(-1, HIDDEN).T
    p += net.back.out.T @ back.reshape(-1, HIDDEN).T
    p += net.bias[:, None]
    np.clip(p, -30, 30, out=p)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    return p.reshape(-1, *ahead.shape[:2])


def fit(segments: np.ndarray, letters: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Train on segments (count, SEGMENT) of bytes; the cross-entropy of each letter's label is minimised by Adam."""
    net = _new(languages)
    order = np.random.Generator(np.random.PCG64(5))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    there, back_again = range(SEGMENT), range(SEGMENT - 1, -1, -1)
    for step in range(1, steps + 1):
        pick = order.integers(0, len(segments), size=MINIBATCH)
        x, y = np.ascontiguousarray(segments[pick].T).astype(np.intp), labels[pick]
        weight = letters[pick].T[:, :, None].astype(np.float32)
        weight /= max(1.0, float(weight.sum()))
        one, two = [], []
        ahead, back = _run(net.ahead, x, there, one), _run(net.back, x, back_again, two)
        wrong = np.ascontiguousarray(_distributions(net, ahead, back).transpose(1, 2, 0))
        wrong[:, np.arange(len(y)), y] -= 1
        wrong *= weight
        grads = []
        for d, states, trace in ((net.ahead, ahead, one), (net.back, back, two)):
            grads += _through_time(d, x, trace, wrong @ d.out.T)
            grads.append(states.reshape(-1, HIDDEN).T @ wrong.reshape(-1, len(languages)))
        grads.append(wrong.sum(axis=(0, 1)))
        rate = 0.02 * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + np.float32(1e-6))
    return net


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _segments(data: bytes) -> np.ndarray:
    short = -len(data) % SEGMENT
    return np.frombuffer(data + b" " * short, dtype=np.uint8).reshape(-1, SEGMENT)


def _pooled(net: Network, segments: np.ndarray) -> np.ndarray:
    """Sum over each segment's letters of their distributions (segments, languages)."""
    out = np.empty((len(segments), len(net.languages)))
    for i in range(0, len(segments), WIDE):
        x = np.ascontiguousarray(segments[i : i + WIDE].T).astype(np.intp)
        ahead, back = _run(net.ahead, x, range(SEGMENT)), _run(net.back, x, range(SEGMENT - 1, -1, -1))
        p = _distributions(net, ahead, back)
        p *= _LETTER[x]
        out[i : i + WIDE] = p.sum(axis=1).T
    return out


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its mean probability for each text; `und` and 0 where there is no letter."""
    kept, parts = [], []
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            kept.append(i)
            parts.append(_segments(text.encode("utf-8", "replace")))
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if not kept or not net.languages:
        return out
    sums = _pooled(net, np.concatenate(parts))
    ends = np.cumsum([len(p) for p in parts])
    pooled = np.add.reduceat(sums, np.concatenate([[0], ends[:-1]]), axis=0)
    pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-9)
    for i, p in zip(kept, pooled, strict=True):
        best = int(p.argmax())
        out[i] = (net.languages[best], float(p[best]))
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Fit on the sample of documents outside the held-out fold that have text and language."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    usable = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        (fold != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    # The text is hashed with the id, so that rows of one id don't enter or leave together.
    hashed = usable.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)))
    unlike = F.approx_count_distinct("h").alias("unlike")
    frequent = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), unlike).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in frequent)
    each = min(SAMPLE_DOCS, SAMPLE_ALL // max(1, len(languages)))
    start = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    # Only hashes that can be among the lowest are ranked, so tasks send about the sample and no more; a language of few different documents sends all.
    least = F.create_map(*[F.lit(x) for r in frequent for x in (r["lang"], int(min(1.0, (2.0 * each + 100) / max(1, r["unlike"])) * (1 << 40)))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "part"))
    sample = []
    if languages:
        sample = (
            hashed.where(F.col("h") <= F.element_at(least, F.col("lang")))
            .select("lang", "h", "id", F.substring("text", start.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("part"))
            .dropDuplicates(["lang", "h"])
            .withColumn("rank", rank)
            .where(F.col("rank") <= each)
            .select("lang", "part", "rank")
            .collect()
        )
    segments, labels = [], []
    for row in sorted(sample, key=lambda r: (r["lang"], r["rank"])):
        own = _segments(row["part"].encode("utf-8", "replace"))
        segments.append(own)
        labels += [languages.index(row["lang"])] * len(own)
    if len(languages) < 2:
        net = _new(languages)
        return net
    x = np.concatenate(segments)
    return fit(x, _LETTER[x], np.array(labels), languages)


def identify(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with lang_pred, a language that the network learned or `und`, and score, from 0 to 1; all columns stay.

    Null and empty text and text without a letter are `und` with score 0; a text of any length is read whole. Rows are independent of
    each other, so repeated rows get equal results; of equally likely languages the first by name is told. Columns of docs that have the
    names of results are replaced, all others stay; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for i in range(0, len(whole), 512):
                part = whole.slice(i, 512)
                found = predict(net, part.column(text).to_pylist())
                made = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(frugal(run), schema)


def languages_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out (not learned from, by its fold), lang_pred and score.

    A null id is in no held-out fold and isn't learned from. Null, empty and letterless texts are `und` with score 0; a
    text of any length is read whole. Equally frequent labels rank by name. Repeated rows each have a
    row, with equal results; an empty table, or one without two labels, gives empty results or `und`'s. Other columns are ignored.
    """
    net = train(docs, doc_id, text, lang)
    out = identify(docs.select(doc_id, text), net, doc_id, text)
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return out.select(doc_id, F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
