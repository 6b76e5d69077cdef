"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Words of one length are points: their place in alphabetical order and their place in the order of their
reversals. For an edit at position i the words that fit are those that begin with the word's first i code points, an
interval of the first order, and end with the code points after the edit, an interval of the second. A wavelet tree over
the points reports those in both intervals; the words of the same length are replacements, those one longer insertions, and
deletions are insertions seen from the other side.

Two words one edit apart share all before and all after it. So words meet in groups that have in common what lies
outside an interval of edit positions: first the halves of a word, and a group that holds many words is split into the groups of
half its interval, down to a single position, which leaves no more words than pairs of letters. Every pair is found in
just one group, and a group sends on each word's number of near words and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, frugal

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words have at least so many code points and occurrences; a form has so many times the word's.
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: A run whose key this divides loses a code point.
DIVISOR = 31
#: Words of a group beyond which it is split; rows of a task.
MOST_GROUP, TASK_ROWS = 2048, 200_000


def words_in(text: str | None, doc_id) -> Counter:
    """The words of a text of LEAST_LENGTH code points or more, with the planted slips, and their numbers.

    With h the crc32 of `<doc_id>:<run>`, a run whose h DIVISOR divides loses its code point h % length. A null id plants nothing.
    """
    if not isinstance(text, str):
        return Counter()
    runs = Counter(RUN_LONG.findall(text.encode("utf-8", "replace").lower().decode()))
    if doc_id is None:
        return runs
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DIVISOR == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


#: Shorter runs can't give words, so only maximal runs of this length or more are looked for.
RUN_LONG = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()

    def told() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": np.fromiter(held.values(), np.int64, len(held))})

    for part in parts:
        for i, text in zip(part["id"], part["text"], strict=True):
            held.update(words_in(text, None if pd.isna(i) else i))
            if len(held) > 300_000:
                yield told()
                held.clear()
    yield told()


def words_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words with LEAST_N occurrences or more."""
    raw = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = raw.mapInPandas(frugal(_count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_N)


class WaveletTree:
    """A wavelet tree over a permutation, level by level: how many of the first k values of a level have bit 0."""

    def __init__(self, values: np.ndarray):
        self.height = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros = []
        for level in range(self.height - 1, -1, -1):
            zero = (values >> level) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [least, after) at places [lo, hi), of all queries side by side."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64)
        for depth, zeros in enumerate(self.zeros):
            width = self.height - 1 - depth
            a, b = zeros[lo], zeros[hi]
            n = zeros[-1]
            query, lo, hi = np.concatenate([query, query]), np.concatenate([a, n + lo - a]), np.concatenate([b, n + hi - b])
            value = np.concatenate([2 * value, 2 * value + 1])
            ok = (lo < hi) & (value << width < after[query]) & (value + 1 << width > least[query])
            query, lo, hi, value = query[ok], lo[ok], hi[ok], value[ok]
        return query, value


def _letters(words: np.ndarray) -> np.ndarray:
    """Code points of words (latin-1, of one length at most, shorter ones end in zeros) as a matrix."""
    return words.view(np.uint8).reshape(len(words), words.dtype.itemsize)


class _Order:
    """Entries sorted by group, length class and letters; which of them are points; where neighbours begin to differ."""

    def __init__(self, group: np.ndarray, kind: np.ndarray, words: np.ndarray, points: int):
        order = np.lexsort((words, kind, group))
        letters = _letters(words)[order]
        differs = letters[1:] != letters[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), letters.shape[1])
        apart = (np.diff(group[order]) != 0) | (np.diff(kind[order]) != 0)
        self.same = np.concatenate([[-1], np.where(apart, -1, first)])
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.points = np.concatenate([[0], np.cumsum(order < points)])
        #: The points in order, and the rank of each among them.
        self.sorted = order[order < points]
        self.rank = np.empty(points, dtype=np.int64)
        self.rank[self.sorted] = np.arange(points)

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the ranks [lo, hi) of the points of its group and class with its first `length` letters."""
        cut = np.concatenate([np.flatnonzero(self.same < length), [len(self.same)]])
        part = np.searchsorted(cut, self.place, side="right") - 1
        return self.points[cut[part]], self.points[cut[part + 1]]


def pairs_of(length: int, lo: int, hi: int, group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of words of a group one edit apart at a position in [lo, hi), both ways.

    words: latin-1, of this length or one more. An edit is seen from the word of this length: replacements, and insertions, of
    which only the first place counts among those that give the same word.
    """
    sizes = np.char.str_len(words)
    short = np.flatnonzero(sizes == length)
    # Points are all words, of class 0 (replacements) and 1 (insertions); short words enter class 1 as queries only.
    n = len(words)
    entries = np.concatenate([words, words[short]])
    groups = np.concatenate([group, group[short]])
    kinds = np.concatenate([(sizes > length).astype(np.int8), np.ones(len(short), dtype=np.int8)])
    letters = _letters(words)
    back = np.zeros((len(words), letters.shape[1]), dtype=np.uint8)
    long = sizes > length
    back[long, : length + 1] = letters[long, length::-1] if length + 1 <= letters.shape[1] else 0
    back[short, :length] = letters[short, length - 1 :: -1]
    reversals = back.reshape(-1).view(words.dtype)
    forward = _Order(groups, kinds, entries, n)
    backward = _Order(groups, kinds, np.concatenate([reversals, reversals[short]]), n)
    tree = WaveletTree(backward.rank[forward.sorted])
    found = []
    for i in range(lo, hi):
        for query, asked, rest in ((short, short, length - i - 1), (n + np.arange(len(short)), short, length - i)):
            if rest < 0:
                continue
            a, b = (x[query] for x in forward.interval(i))
            c, d = (x[query] for x in backward.interval(rest))
            least = 2 if asked is query else 1  # a word lies in its own class itself
            use = np.flatnonzero((b - a >= least) & (d - c >= least))
            which, value = tree.report(a[use], b[use], c[use], d[use])
            word, other = asked[use[which]], backward.sorted[value]
            if asked is query:
                ok = word != other
                found.append((word[ok], other[ok]))
            else:
                ok = letters[other, i] != letters[word, i - 1] if i else np.ones(len(word), dtype=bool)
                found += [(word[ok], other[ok]), (other[ok], word[ok])]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each word of a task's groups: the number of near words met there, and the n and the form of the best."""
    held = [p for p in parts if len(p)]
    if not held:
        return
    for (length, lo, hi), rows in pd.concat(held, ignore_index=True).groupby(["length", "lo", "hi"], sort=False):
        # A group of one word has no pairs.
        rows = rows[rows.groupby("g")["g"].transform("size") > 1]
        if not len(rows):
            continue
        words = np.array([w.encode("latin-1") for w in rows["word"]], dtype=f"S{length + 1}")
        n = rows["n"].to_numpy()
        a, b = pairs_of(int(length), int(lo), int(hi), rows["g"].to_numpy(), words)
        if not len(a):
            continue
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(words, kind="stable")] = np.arange(len(words))
        order = np.lexsort((place[b], -n[b], a))
        who, first, count = np.unique(a[order], return_index=True, return_counts=True)
        best = b[order][first]
        names = rows["word"].to_numpy(dtype=object)
        yield pd.DataFrame({"word": pd.Series(names[who], dtype=object), "n_near": count, "best_n": n[best], "best": pd.Series(names[best], dtype=object)})


def _grouped(rows: DataFrame) -> DataFrame:
    """The group of each row's word for its length of query and interval of edits: what lies before and after the interval."""
    after = F.greatest(F.col("length") - F.col("hi"), F.lit(0))
    head = F.expr("substring(word, 1, lo)")
    tail = F.when(after > 0, F.expr("right(word, greatest(length - hi, 0))")).otherwise("")
    return rows.withColumn("g", F.xxhash64("length", "lo", "hi", head, F.lit("|"), tail))


def _groups(words: DataFrame, most: int) -> DataFrame:
    """Rows (word, n, length, lo, hi, g): each word once for each interval of edits of words of its length and of one less."""
    both = words.withColumn("size", F.length("word")).withColumn("length", F.explode(F.array("size", F.col("size") - 1)))
    half = (F.col("length") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("length") + 1).alias("hi")))
    rows = both.where(F.col("length") >= LEAST_LENGTH).select("word", "n", "length", F.explode(spans).alias("span"))
    rows = _grouped(rows.select("word", "n", "length", "span.*"))
    while True:
        hot = checkpoint(rows.groupBy("g", "lo", "hi").count().where((F.col("count") > most) & (F.col("hi") - F.col("lo") > 1)).select("g", F.lit(True).alias("hot")))
        if hot.isEmpty():
            return rows
        marked = rows.join(hot, "g", "left")
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        split = marked.where("hot").select("word", "n", "length", F.explode(halves).alias("span")).select("word", "n", "length", "span.*")
        rows = marked.where("hot is null").drop("hot").select("word", "n", "length", "lo", "hi", "g").union(_grouped(split).select("word", "n", "length", "lo", "hi", "g"))


def near_words(words: DataFrame, most: int = MOST_GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones; best is the most frequent, the first in order of code points among equals."""
    rows = _groups(words, most)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // TASK_ROWS))
    met = rows.repartition(parts, "g").mapInPandas(frugal(_near), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES, most: int = MOST_GROUP) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, if that is `times` the word's n or more; its root is the end of
    the chain of forms, the word itself if it has none. Each step of a chain multiplies n, so chains are short and
    have no cycles. Null and empty texts have no words; a run of any length is a word. Rows that repeat an id each count, with equal slips; with a
    null id none is planted. Of equally frequent near words the first in order of code points is the form.
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    words = checkpoint(words_of(docs, doc_id, text))
    near = near_words(words, most)
    has = F.col("best_n") >= times * F.col("n")
    told = checkpoint(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(has, F.col("best")).alias("form"),
            F.when(has, F.col("best_n")).alias("form_n"),
        )
    )
    # Chains are followed twice as far in each round.
    ends = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ends = checkpoint(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            break
        ends = ends.select("word", "root")
    return told.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
