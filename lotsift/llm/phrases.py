"""Phrases whose words come together more often than apart, mined with compressed position bitmaps.

The corpus is written once as shards: some MB of texts laid in one line of positions, a word a position and a gap at
each end of a piece. In a shard every word has a bitmap of its positions, byte-aligned and compressed: only bytes that
are not zero are kept, with their places. A phrase's bitmap holds the positions of its last word. To extend it, it is
shifted by one and ANDed with the bitmaps of the words that have bits in the same bytes; popcounts give the longer phrases'
numbers in the shard. As gaps have no bits, no phrase leaves its piece. Phrases are walked depth-first: a stretch of first
words goes down to the longest phrases before the next one begins, so few bitmaps are held at once.

Popcounts are summed over shards: a shard sends the phrases it met, as hashes with popcounts, packed, to buckets of the
hash space, and a bucket answers each shard with the totals of those that are frequent in the corpus. Only they are extended:
words first, then pairs, then triples and fours whose pairs are all frequent. The first shard that holds a frequent phrase spells it out,
with the totals of its parts, which it holds as well. Hashes of phrases have 64 bits and include the language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_HASHES, checkpoint, dealt, frugal, frugal_group, mix, numbers, stored, unnumbers

_U = np.uint64
#: Occurrences of a candidate at least, words of one at most, and phrases that are returned for a language.
LEAST, LONGEST, BEST = 30, 4, 2000
#: A phrase goes if a longer one around it has this share, in percent, of its occurrences.
COVERED = 80
UNIT = 2_000_000
#: Bytes of text in a shard, and of the shards' texts whose hashes meet in one bucket.
SHARD_BYTES, BUCKET_TEXT_BYTES = 8 << 20, 12 << 20
#: Bytes of bitmaps that are walked side by side.
STRETCH = 200_000
#: Candidates of a language that are ranked in one task.
RANKED = 50_000

_MARKS = bytes(10 if chr(x) in ".,;:!?\n\x0b\x0c\r" else x for x in range(256))


class _Shard:
    """Texts on their way to a shard: one line of word numbers from 1, 0 being a gap; words are numbered by language."""

    def __init__(self) -> None:
        self.known: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.lang_of: list[int] = []
        self.lines: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        raw = text.encode("utf-8", "replace").lower().translate(_MARKS)
        self.size += len(raw)
        if lang not in self.known:
            self.known[lang] = _Numbered(self, len(self.langs))
            self.langs.append(lang)
        # No word holds a mark, so the comma can stand for gaps.
        tokens = raw.replace(b"\n", b" , ").replace(b"\t", b" ").split(b" ")
        line = np.fromiter(map(self.known[lang].__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.lines.append(np.append(line[line >= 0], 0))

    def row(self) -> dict:
        line = np.concatenate(self.lines)
        lang_of = np.array([-1, *self.lang_of])
        n = np.bincount(lang_of[line[line > 0]], minlength=len(self.langs))
        return {"langs": self.langs, "n": n.tolist(), "lang_of": numbers(lang_of[1:]), "words": b" ".join(self.words), "line": numbers(line)}


class _Numbered(dict):
    """Number of each word of one language in a shard; the empty word is none."""

    def __init__(self, shard: _Shard, lang: int):
        super().__init__({b",": 0, b"": -1})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        self.shard.words.append(word)
        self.shard.lang_of.append(self.lang)
        self[word] = at = len(self.shard.words)
        return at


_SHARD = "g bigint, langs array<string>, n array<bigint>, lang_of binary, words binary, line binary"
_SHARD_ARROW = pa.schema([("g", pa.int64()), ("langs", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("lang_of", pa.binary()), ("words", pa.binary()), ("line", pa.binary())])


def shards_of(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SHARD_BYTES) -> DataFrame:
    """The corpus as shards, written once, of rows that lie side by side; a longer text is a shard of its own."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, held = TaskContext.get().partitionId() << 33, 0, _Shard()
        for part in parts:
            for own, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                held.add(own, value.as_py())
                if held.size >= size:
                    yield pa.RecordBatch.from_pylist([{"g": place + made} | held.row()], _SHARD_ARROW)
                    made, held = made + 1, _Shard()
        if held.lines:
            yield pa.RecordBatch.from_pylist([{"g": place + made} | held.row()], _SHARD_ARROW)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text)).where(F.col(text) != "")
    return stored(rows.mapInArrow(frugal(pack), _SHARD))


def joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return mix(mix(first) * _U(0x9E3779B97F4A7C15) + word)


class Totals:
    """Corpus totals of frequent phrases by hash, and whether this shard is to spell one out."""

    def __init__(self, told: pd.DataFrame):
        keys = [np.cumsum(unnumbers(k), dtype=_U) for k in told["keys"]]
        named = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(told["named"], keys, strict=True)]
        flat = np.concatenate([np.empty(0, _U), *keys])
        order = np.argsort(flat)
        self.keys = flat[order]
        self.totals = np.concatenate([np.empty(0, np.int64), *(unnumbers(x).astype(np.int64) for x in told["totals"])])[order]
        self.named = np.concatenate([np.empty(0, np.uint8), *named])[order].astype(bool)

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Totals, 0 for phrases that aren't frequent."""
        at, found = self._at(hashes)
        return np.where(found, self.totals[at], 0) if len(self.keys) else np.zeros(len(hashes), dtype=np.int64)

    def mine(self, hashes: np.ndarray) -> np.ndarray:
        at, found = self._at(hashes)
        return found & self.named[at] if len(self.keys) else found


class Bitmaps:
    """Positions of every word of a line, compressed: word, byte number and byte, for bytes that are not zero; and the same by byte number."""

    def __init__(self, line: np.ndarray):
        at = np.flatnonzero(line)
        at = at[np.argsort(line[at], kind="stable")]
        word, byte = line[at], at >> 3
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (byte[1:] != byte[:-1])])) if len(at) else at
        self.word, self.byte = word[first], byte[first]
        self.bits = np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first) if len(at) else np.empty(0, np.uint8)
        order = np.argsort(self.byte, kind="stable")
        self.words_at, self.bits_at = self.word[order], self.bits[order]
        self.start = np.searchsorted(self.byte[order], np.arange((len(line) >> 3) + 3))

    def extended(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, byte, bits) of all words that follow, from entries of phrases' bitmaps: shift by one, then AND."""
        low, high = (bits << 1).astype(np.uint8), bits >> 7
        a, b = np.flatnonzero(low), np.flatnonzero(high)
        phrase, byte, bits = np.concatenate([phrase[a], phrase[b]]), np.concatenate([byte[a], byte[b] + 1]), np.concatenate([low[a], high[b]])
        n = self.start[byte + 1] - self.start[byte]
        entry = np.repeat(np.arange(len(n)), n)
        other = np.arange(len(entry)) + np.repeat(self.start[byte] - np.cumsum(n) + n, n)
        both = bits[entry] & self.bits_at[other]
        some = np.flatnonzero(both)
        entry = entry[some]
        return phrase[entry], self.words_at[other[some]], byte[entry], both[some]


class Line:
    """A shard with its frequent words only, numbered from 0 in `hashes`."""

    def __init__(self, row, totals: Totals | None):
        spelled = row["words"].split(b" ") if row["words"] else []
        self.langs, self.n = list(row["langs"]), list(row["n"])
        lang_of = unnumbers(row["lang_of"]).astype(np.int64) if spelled else np.empty(0, np.int64)
        salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], dtype=_U)
        hashes = mix(WORD_HASHES.of(spelled) + mix(salts)[lang_of]) if spelled else np.empty(0, _U)
        line = unnumbers(row["line"]).astype(np.int64)
        if totals is None:
            self.hashes, self.counts = hashes, np.bincount(line, minlength=len(hashes) + 1)[1:]
            return
        often = np.flatnonzero(totals.of(hashes))
        renumbered = np.zeros(len(hashes) + 1, dtype=np.int64)
        renumbered[often + 1] = np.arange(1, len(often) + 1)
        self.hashes, self.lang_of = hashes[often], lang_of[often]
        self.spelled = [spelled[i] for i in often.tolist()]
        self.bitmaps = Bitmaps(renumbered[line])

    def walk(self, totals: Totals, settled: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words by column, hashes, popcounts) of phrases of 2 to `longest` words, depth-first in stretches of first words.

        Totals of phrases up to `settled` words are known: of these the frequent ones are given and extended; of longer
        ones those whose pairs are all frequent, as far as pairs are known.
        """
        maps, n = self.bitmaps, len(self.hashes)
        ends = np.flatnonzero(np.diff(maps.word, append=n + 1)) + 1
        start = 0
        while start < len(maps.word):
            # The first words whose bytes fit in a stretch; one word at least.
            end = int(ends[max(np.searchsorted(ends, start + STRETCH, side="right") - 1, np.searchsorted(ends, start, side="right"))])
            entry = maps.word[start:end] - 1
            first, phrase = np.unique(entry, return_inverse=True)
            words, hashes, byte, bits = first[:, None], self.hashes[first], maps.byte[start:end], maps.bits[start:end]
            start = end
            for length in range(2, longest + 1):
                phrase, word, byte, bits = maps.extended(phrase, byte, bits)
                if not len(phrase):
                    break
                key = phrase * (n + 1) + word
                order = np.argsort(key, kind="stable")
                key, byte, bits = key[order], byte[order], bits[order]
                begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                counts = np.add.reduceat(np.bitwise_count(bits), begins, dtype=np.int64)
                parent, last = key[begins] // (n + 1), key[begins] % (n + 1) - 1
                words = np.concatenate([words[parent], last[:, None]], axis=1)
                hashes = joined(hashes[parent], self.hashes[last])
                if length <= settled:
                    ok = totals.of(hashes) > 0
                elif settled >= 2:
                    ok = totals.of(joined(self.hashes[words[:, -2]], self.hashes[last])) > 0
                else:
                    ok = np.ones(len(hashes), dtype=bool)
                phrase = np.repeat(np.where(ok, np.cumsum(ok) - 1, -1), np.diff(begins, append=len(key)))
                words, hashes, counts = words[ok], hashes[ok], counts[ok]
                stay = phrase >= 0
                phrase, byte, bits = phrase[stay], byte[stay], bits[stay]
                if length > settled or settled == longest:
                    yield words, hashes, counts

    def part(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of these words."""
        out = self.hashes[words[:, 0]]
        for k in range(1, words.shape[1]):
            out = joined(out, self.hashes[words[:, k]])
        return out


def _packets(g: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """A row for each bucket, with the sorted keys that go there and their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cuts = np.searchsorted(((keys >> _U(32)) * _U(buckets)) >> _U(32), np.arange(buckets + 1))
    rows = [(b, g, numbers(np.diff(keys[i:j], prepend=_U(0))), numbers(counts[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
    return pd.DataFrame(rows, columns=["bucket", "g", "keys", "counts"])


def _send_words(buckets: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                line = Line(row, None)
                yield _packets(row["g"], line.hashes, line.counts, buckets)

    return run


def _send_phrases(buckets: int, settled: int, longest: int):
    def run(key, shard, told):
        if not len(shard):
            return pd.DataFrame(columns=["bucket", "g", "keys", "counts"])
        totals = Totals(told)
        met = list(Line(shard.iloc[0], totals).walk(totals, settled, longest))
        keys = np.concatenate([np.empty(0, _U), *(x[1] for x in met)])
        return _packets(int(shard["g"].iloc[0]), keys, np.concatenate([np.empty(0, np.int64), *(x[2] for x in met)]), buckets)

    return run


def _add_up(least: int):
    """What a bucket tells each shard: its keys that are frequent in all, their totals, and a bit for those that it is the first to hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        keys = [np.cumsum(unnumbers(k), dtype=_U) for k in pdf["keys"]]
        flat = np.concatenate(keys)
        distinct, first, at = np.unique(flat, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, at, np.concatenate([unnumbers(c) for c in pdf["counts"]]).astype(np.int64))
        named = np.zeros(len(flat), dtype=bool)
        named[first] = True
        ends = np.cumsum([len(k) for k in keys])
        rows = []
        for g, i, j in zip(pdf["g"], np.concatenate([[0], ends[:-1]]), ends, strict=True):
            own = i + np.flatnonzero(total[at[i:j]] >= least)
            if len(own):
                rows.append((g, numbers(np.diff(flat[own], prepend=_U(0))), numbers(total[at[own]].astype(_U)), np.packbits(named[own]).tobytes()))
        return pd.DataFrame(rows, columns=["g", "keys", "totals", "named"])

    return run


def scores(a: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """floor(UNIT * a / beside), exactly: in 64 bits where they hold the product, else in whole numbers of any size."""
    if len(a) and int(a.max()) > (1 << 62) // UNIT:
        return np.array([UNIT * x // y for x, y in zip(a.tolist(), beside.tolist(), strict=True)], dtype=np.int64)
    return UNIT * a // beside


def _spelled(line: Line, totals: Totals, words: np.ndarray, hashes: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Candidates with their lowest-scoring cut, and the hashes of phrases within them that they cover."""
    size = words.shape[1]
    a = totals.of(hashes)
    best = left = right = None
    for k in range(1, size):
        l, r = totals.of(line.part(words[:, :k])), totals.of(line.part(words[:, k:]))
        score = scores(a, l + r)
        lower = np.ones(len(a), dtype=bool) if best is None else score < best
        best, left, right = (np.where(lower, x, y) if y is not None else x for x, y in ((score, best), (l, left), (r, right)))
    covered = [np.empty(0, _U)]
    for length in range(2, size):
        for i in range(size - length + 1):
            inner = line.part(words[:, i : i + length])
            covered.append(inner[100 * a >= COVERED * totals.of(inner)])
    text = [b" ".join([line.spelled[w] for w in own]).decode("utf-8") for own in words.tolist()]
    lang = [line.langs[i] for i in line.lang_of[words[:, 0]].tolist()]
    return pd.DataFrame({"lang": lang, "phrase": text, "key": hashes.view(np.int64), "a": a, "l": left, "r": right, "score": best}), np.concatenate(covered)


_FOUND = ["kind", "lang", "phrase", "key", "a", "l", "r", "score", "n"]


def _spell(longest: int):
    """Rows of kind 0, candidates; 1, keys of covered phrases; 2, the languages' words."""

    def run(key, shard, told):
        if not len(shard):
            return pd.DataFrame(columns=_FOUND)
        totals = Totals(told)
        line = Line(shard.iloc[0], totals)
        out = [pd.DataFrame({"kind": 2, "lang": line.langs, "n": line.n})]
        for words, hashes, _ in line.walk(totals, longest, longest):
            mine = totals.mine(hashes)
            if mine.any():
                found, covered = _spelled(line, totals, words[mine], hashes[mine])
                out += [found.assign(kind=0), pd.DataFrame({"kind": 1, "key": covered.view(np.int64)})]
        rows = pd.concat(out, ignore_index=True).reindex(columns=_FOUND)
        for c in ("key", "a", "l", "r", "score", "n"):
            rows[c] = rows[c].astype("Int64")
        return rows.astype({"lang": object, "phrase": object}).where(rows.notna(), None)

    return run


def _first(rows: DataFrame, n: DataFrame, best: int) -> DataFrame:
    """The best phrases of each language, ranked.

    Languages of many candidates are cut in rounds: shares of some RANKED rows each keep their own best.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    while (most := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > max(RANKED, 4 * best):
        share = F.pmod(F.xxhash64("phrase"), F.lit(math.ceil(most / RANKED)))
        rank = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
        rows = checkpoint(rows.withColumn("share", share).withColumn("rank", rank).where(F.col("rank") <= best).drop("share", "rank"))
    entry = F.struct((-F.col("score")).alias("score"), (-F.col("a")).alias("a"), "phrase", "l", "r")
    both = rows.select("lang", entry.alias("e"), F.lit(None).cast("bigint").alias("n")).unionByName(n.select("lang", F.lit(None).alias("e"), "n"))
    ranked = both.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("e")), 1, best).alias("found"), F.sum("n").alias("n"))
    out = ranked.select("lang", "n", F.posexplode("found").alias("rank", "e"))
    return out.select(
        "lang", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("e.phrase").alias("phrase"), (-F.col("e.a")).alias("a"), F.col("e.l").alias("l"), F.col("e.r").alias("r"), "n", (-F.col("e.score")).alias("score")
    )


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, best: int = BEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The best phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A candidate has 2 to LONGEST words and a >= least occurrences, overlapping ones included. Cut after some word, its parts have l and r
    occurrences and it scores floor(UNIT * a / (l + r)); the lowest-scoring cut counts, of equal ones the first. A candidate goes
    if its words lie side by side in a longer one with COVERED percent of its occurrences or more. Ranks follow score, a
    and the phrase's bytes. n is the language's number of words.

    A null language is `und`; null and empty texts have no words. A text of any length is read whole, repeated rows count each.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    shards = shards_of(docs, lang, text, shard_bytes)
    n = shards.count()
    buckets = max(1, math.ceil(n * shard_bytes / BUCKET_TEXT_BYTES))
    packet, answer = "bucket int, g bigint, keys binary, counts binary", "g bigint, keys binary, totals binary, named binary"

    def added(sent: DataFrame) -> DataFrame:
        return stored(dealt(sent, "bucket", buckets).groupBy("bucket").applyInPandas(frugal_group(_add_up(least)), answer))

    placed = dealt(shards, "g", n)
    told = added(shards.mapInPandas(frugal(_send_words(buckets)), packet))
    for settled, longest in ((1, 2), (2, LONGEST)):
        sent = placed.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(frugal_group(_send_phrases(buckets, settled, longest)), packet)
        told = told.union(added(sent))
    kinds = "kind int, lang string, phrase string, key bigint, a bigint, l bigint, r bigint, score bigint, n bigint"
    found = stored(placed.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(frugal_group(_spell(LONGEST)), kinds))
    covered = found.where("kind = 1").select("key").distinct()
    left = checkpoint(found.where("kind = 0").join(covered, "key", "left_anti").select("lang", "phrase", "a", "l", "r", "score"))
    return _first(left, found.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("n")), best)
