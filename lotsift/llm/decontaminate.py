"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a document by k = m * rate edits. Cut
into k + 1 pieces, one of them must stand in the passage unchanged; so all pieces are searched
exactly, in one pass of an Aho-Corasick automaton, and each hit is verified with Myers' bit-parallel
edit distance on the text around it.

Items are compared with A-Z in lower case and runs of white space as one space. They travel
to the tasks in slices of bounded size; however many slices there are, each document meets all items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Bytes of item text that go to the tasks at once.
SLICE_BYTES = 8 << 20


def normal(text: str | None) -> str:
    return b" ".join(text.encode("utf-8", "replace").lower().split()).decode() if text else ""


def budget(item: str, rate: float = EDIT_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, rate: float = EDIT_RATE) -> list[tuple[int, str]]:
    """Offsets and texts of budget + 1 pieces of about equal length."""
    n = budget(item, rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item for Myers' algorithm: a mask of its places for each character."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def ends(self, text: str, most: int) -> tuple[int, int] | None:
        """Least distance of the item to a passage of the text and that passage's first end; None above `most`."""
        full, top = (1 << self.length) - 1, 1 << self.length - 1
        up, down, score = full, 0, self.length
        best = None
        find = self.masks.get
        for j, c in enumerate(text, 1):
            eq = find(c, 0)
            x = eq | down
            d = (((eq & up) + up) ^ up) | x
            h_up = down | ~(d | up) & full
            h_down = up & d
            if h_up & top:
                score += 1
            elif h_down & top:
                score -= 1
            h_up = h_up << 1 & full
            h_down = h_down << 1 & full
            up = h_down | ~(x | h_up) & full
            down = h_up & x
            if score <= most:
                best, most = (score, j), score - 1
        return best


class Matcher:
    """The automaton of all pieces of some items (item_id, text) and their patterns."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = [(i, n) for i, t in items if (n := normal(t))]
        self.budgets = [budget(t, rate) for _, t in self.items]
        self.patterns: dict[int, Pattern] = {}
        self.backwards: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, rate):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best passage: least distance, then first end; places in the normal text."""
        text = normal(text)
        if not self.items or not text:
            return []
        #: For each item, the windows that hits ask to verify; hits on one diagonal share theirs.
        windows: dict[int, dict[int, None]] = {}
        for last, (n, owners) in self.automaton.iter(text):
            for k, offset in owners:
                windows.setdefault(k, {})[last + 1 - n - offset] = None
        out = []
        for k, starts in windows.items():
            item_id, item = self.items[k]
            most = self.budgets[k]
            if k not in self.patterns:
                self.patterns[k], self.backwards[k] = Pattern(item), Pattern(item[::-1])
            best = None
            for lo, hi in _joined(sorted(starts), len(item), most, len(text)):
                got = self.patterns[k].ends(text[lo:hi], most if best is None else best[0] - 1)
                if got:
                    best = (got[0], lo + got[1])
                    if not got[0]:
                        break
            if best:
                distance, end = best
                back = self.backwards[k].ends(text[max(0, end - len(item) - most) : end][::-1], distance)
                out.append((item_id, distance, end - back[1] if back else max(0, end - len(item)), end))
        return out


def _joined(starts: list[int], length: int, most: int, n: int) -> Iterator[tuple[int, int]]:
    """The windows from most before each start to most beyond the item, those that overlap joined."""
    lo, hi = None, None
    for s in starts:
        a, b = max(0, s - most), min(n, s + length + most)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def contaminations(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE
) -> DataFrame:
    """A row for each row of docs and item found in it: id, item_id, distance, start, end.

    Start and end are places in the text with A-Z in lower case and white space squeezed. An
    item that is null or blank is found nowhere, as is anything in a null or empty text. Repeated
    rows are each reported; repeated items as often as they occur. Of places of one item that are equally near the first is told. A text of any length is
    searched whole. Other columns, whatever their names, are ignored; an empty table of documents or items gives an empty result.
    """
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("length(text) > 0")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / SLICE_BYTES))
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    out = None
    for k in range(slices):
        own = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k).collect()
        held = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in own])

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held.value, rate)
            for part in parts:
                rows = [(i, *m) for i, t in zip(part["id"], part["text"], strict=True) for m in matcher.matches(t)]
                yield pd.DataFrame(rows, columns=["id", "item", "distance", "start", "end"])

        found = source.mapInPandas(frugal(run), "id string, item string, distance int, start int, end int")
        out = found if out is None else out.union(found)
    return out.select(
        F.col("id").cast(kinds[0]).alias(doc_id), F.col("item").cast(kinds[1]).alias("item_id"), "distance", "start", "end"
    )
