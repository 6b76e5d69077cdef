"""Encoding and decoding by a SentencePiece model as a weighted finite-state transducer.

The model compiles to three machines. The normaliser has two states, within a gap and outside, and arcs that
read a character and write it, a word mark or nothing. The pieces are arcs that read a piece's characters;
the byte fallback has an arc for each character that is no piece. An input is composed with all
three, and its encoding is the shortest path through the composition in the tropical semiring
(weights add up along a path, the least one counts).

In a unigram model the arc of a piece weighs minus its score. In a merge (BPE) model the states
are the piece read last, and an arc to the next piece weighs nothing if merging the text of both
gives just these two, else infinity. A sequence of pieces is the merge result of its text
exactly if each neighbouring pair is, so every start of an input has one path of finite weight, its own encoding,
and one state a place suffices.

Paths are taken segment by segment: a text is cut wherever no piece has two such characters
side by side (before a word mark, between a word and its punctuation), so paths of its segments don't affect each other.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Bytes that a worker's kept segments take, about.
KEPT_BYTES = 96 << 20
#: A longer segment is worked out each time.
KEPT_LONGEST = 64
#: Arcs whose weights a worker keeps, of some 150 bytes each; then it starts anew.
KEPT_ARCS = 200_000
INFINITE = float("inf")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if b < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            n, i = _varint(data, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Normaliser:
    """The machine that turns spaces into word marks; where the model squeezes, a run of them into one mark, and none at the end.

    arcs: (state, whether a space or mark is read) to (state, what is written), where None stands for the character itself.
    A squeezing machine writes the mark of a gap when it reads the character after it.
    """

    OUTSIDE, GAP = 0, 1

    def __init__(self, squeeze: bool):
        out, gap = self.OUTSIDE, self.GAP
        if squeeze:
            self.arcs = {(out, True): (gap, ()), (gap, True): (gap, ()), (out, False): (out, (None,)), (gap, False): (out, (MARK, None))}
        else:
            self.arcs = {(out, True): (out, (MARK,)), (out, False): (out, (None,))}
        #: A machine of one state that writes a character for each is a table.
        self.table = None if squeeze else {ord(" "): MARK}

    def write(self, raw: str) -> str:
        if self.table is not None:
            return raw.translate(self.table)
        state, written = self.OUTSIDE, []
        for c in raw:
            state, symbols = self.arcs[state, c == " " or c == MARK]
            written += [c if x is None else x for x in symbols]
        return "".join(written)


#: What stands at one end of a piece as merging goes on, and the score of what it is merged into next.
Spine = list[tuple[str, float]]


class Kept(dict):
    """Results of a function by text, young ones and old: young ones of half the bytes become the old, and those before go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, text: str) -> bytes:
        if len(text) > KEPT_LONGEST:
            return self.make(text)
        value = self.old.get(text)
        if value is None:
            value = self.make(text)
        if self.size >= KEPT_BYTES // 2:
            self.old, self.size = dict(self), 0
            self.clear()
        self[text] = value
        self.size += sys.getsizeof(text) + sys.getsizeof(value) + 50
        return value

    def release(self) -> None:
        """Give back what is kept, as the worker may turn to other stages."""
        self.clear()
        self.old, self.size = {}, 0


class Arcs(dict):
    """Weights of a merge model's arcs by the pieces before and after, each worked out when first asked for."""

    def __init__(self, weight):
        super().__init__()
        self.weight = weight

    def __missing__(self, pair: tuple[int, int]) -> float:
        if len(self) >= KEPT_ARCS:
            self.clear()
        found = self[pair] = self.weight(*pair)
        return found


class Transducer:
    """The compiled model; encode() and decode() map a text to packed little-endian 32-bit ids and back."""

    def __init__(self, model: bytes):
        names, scores, kinds = [], [], []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.merges = trainer.get(3, UNIGRAM) == MERGES
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, MERGES) or USER in kinds:
            raise ValueError("only unigram and merge models without user-defined pieces can be compiled")
        if normaliser.get(2):
            raise ValueError("the model has a character map; only identity normalisers can be compiled")
        if trainer.get(3, UNIGRAM) == UNIGRAM and max(scores) > 0:
            raise ValueError("a piece's score is no logarithm of a probability")
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.scores = scores
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == BYTE}
        self.longest = max(map(len, self.ids))
        self.unknown_cost = 10.0 - min(scores)
        self.names = names
        self.out = [b"" if k == CONTROL else n.replace(MARK, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.out[self.unknown] = " ⁇ ".encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.normaliser = Normaliser(self.squeeze)
        self.segments = self._cutter()
        #: All starts of pieces, the states of the machine that reads them, each with the piece that it is (-1: none).
        self.starts = {name[:k]: -1 for name in self.ids for k in range(1, len(name))} | self.ids
        #: Of pieces met so far: how merging makes them at their left and right end.
        self.ends: dict[int, tuple[Spine, Spine] | None] = {}
        self.arcs = Arcs(self._weight)
        self.paths = Kept(self._segment)

    def _cutter(self):
        """A function that cuts a text between characters that no piece has side by side; None if a mark can follow another character.

        A segment takes the spaces and marks before it.
        """
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            return None
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for name in self.ids:
            name = name.lstrip(MARK)
            for x, y in zip(name, name[1:], strict=False):
                group[root(x)] = root(y)
        members: dict[str, list[str]] = {}
        for c in group:
            members.setdefault(root(c), []).append(c)
        classes = ["".join(map(re.escape, m)) for m in sorted(members.values(), key=len, reverse=True) if len(m) > 1]
        rest = "".join(classes)
        gap = f"[ {MARK}]"
        return re.compile("|".join([*(f"{gap}*[{c}]+" for c in classes), f"{gap}*[^ {MARK}{rest}]", f"{gap}+"]), re.S).findall

    def _merge(self, text: str) -> tuple[Spine, Spine] | None:
        """How merging makes a piece of its characters: at its left and its right end what stands there and what it is merged into.

        None if merging makes something else of them. The highest-scoring neighbours whose
        concatenation is a piece merge, leftmost first, until none are left.
        """
        symbols = [(c, INFINITE, [c], [c]) for c in text]
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                j = self.ids.get(symbols[i][0] + symbols[i + 1][0])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if at < 0:
                return None
            one, two = symbols[at : at + 2]
            if best > min(one[1], two[1]):
                raise ValueError("a piece scores above one that it is merged from")
            whole = one[0] + two[0]
            symbols[at : at + 2] = [(whole, best, [*one[2], whole], [*two[3], whole])]

        def spine(names: list[str]) -> Spine:
            scores = [*(self.scores[self.ids[n]] for n in names[1:]), -INFINITE]
            return list(zip(names, scores, strict=True))

        return spine(symbols[0][2]), spine(symbols[0][3])

    def _weight(self, a: int, b: int) -> float:
        """Weight of a merge model's arc from the state of piece a (-1: start, or a character that is no piece) that reads piece b.

        Merging goes by falling scores, and two pieces stay apart unless, on the way, what stands at a's right
        end and at b's left end makes a piece that comes before either's own next merge.
        """
        ends = self.ends
        for piece in (a, b):
            if piece >= 0 and piece not in ends:
                ends[piece] = self._merge(self.names[piece])
        if ends[b] is None:
            return INFINITE
        if a < 0:
            return 0.0
        right, left = ends[a][1], ends[b][0]
        i = j = 0
        find, scores = self.ids.get, self.scores
        while True:
            x, next_x = right[i]
            y, next_y = left[j]
            joint = find(x + y)
            # Of equal scores the leftmost merge comes first.
            if joint is not None and next_x < scores[joint] >= next_y:
                return INFINITE
            if next_x >= next_y:
                if next_x == -INFINITE:
                    return 0.0
                i += 1
            else:
                j += 1

    def _fallback(self, char: str) -> list[int]:
        data = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def shortest_path(self, text: str) -> list[int]:
        """Ids along the path of least weight through the composition of a normal text with pieces and fallback.

        No arc weighs less than nothing, so paths are grown lightest first and of equal ones the furthest (Dijkstra). What an arc
        of a merge model weighs, nothing or infinity, is worked out when its turn comes.
        """
        n, starts, arcs, lazy = len(text), self.starts.get, self.arcs, self.merges
        #: Of each place reached: where the last arc began and its piece (-1: none).
        came: dict[int, tuple[int, int]] = {}
        ahead: list[tuple[float, int, int, int]] = [(0.0, 0, 0, -1)]
        while n not in came:
            here, at, begin, piece = heappop(ahead)
            at = -at
            if at in came or (lazy and piece >= 0 and arcs[came[begin][1], piece] == INFINITE):
                continue
            came[at] = begin, piece
            end = at + 1
            while end <= n and (found := starts(text[at:end])) is not None:
                if found >= 0 and end not in came:
                    heappush(ahead, (here if lazy else here - self.scores[found], -end, at, found))
                end += 1
            if at < n and text[at] not in self.ids:
                heappush(ahead, (here if lazy else here + self.unknown_cost, -at - 1, at, -1))
        parts, end = [], n
        while end:
            begin, piece = came[end]
            parts.append([piece] if piece >= 0 else self._fallback(text[begin]))
            end = begin
        return [i for part in reversed(parts) for i in part]

    def _segment(self, raw: str) -> bytes:
        """Packed ids of a segment as it stands in the text: normaliser, then pieces and fallback."""
        ids = self.shortest_path(self.normaliser.write(raw))
        return struct.pack(f"<{len(ids)}i", *ids)

    def release(self) -> None:
        """Give back what is kept of inputs."""
        self.paths.release()
        self.arcs.clear()

    def encode(self, text: str) -> bytes:
        if not (text.strip(" " + MARK) if self.squeeze else text):
            return b""
        if self.squeeze:
            text = text.lstrip(" " + MARK)
        if self.prefix:
            text = " " + text
        if self.segments is None:
            return self._segment(text)
        return b"".join(map(self.paths.__getitem__, self.segments(text)))

    def decode(self, ids: bytes) -> str:
        out = self.out
        data = b"".join([out[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _read(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def _add(docs: DataFrame, names: dict[str, pa.DataType], make, release=lambda: None) -> DataFrame:
    """docs with columns that make(batch) gives; columns of docs with their names are replaced. release() ends a task."""
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema
    for name, kind in names.items():
        schema = schema.add(name, "binary" if kind == pa.binary() else "string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in parts:
                for i in range(0, len(whole), 1000):
                    batch = whole.slice(i, 1000)
                    made = make(batch)
                    new = [pa.array(v, type=t) for v, t in zip(made, names.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *names])
        finally:
            release()

    return docs.mapInArrow(frugal(run), schema)


def encode_texts(docs: DataFrame, text: str = "text", model_path: str = DEFAULT_MODEL, decoded: bool = False) -> DataFrame:
    """docs with ids, the text's piece ids as packed little-endian 32-bit numbers, and on request what they decode to.

    The model file is read on the driver and travels with the job. Null text has null ids,
    an empty one or one of spaces none. A text of any length is encoded whole. All other columns stay, but for those named as the results,
    which they replace; rows are independent of each other, so repeated ones get equal results,
    and an empty table gives an empty one. Of paths of equal weight the one with longer pieces first is taken.
    """
    model = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def make(batch: pa.RecordBatch) -> list[list]:
        t = compiled(model.value)
        ids = [None if x is None else t.encode(x) for x in batch.column(text).to_pylist()]
        return [ids, [None if x is None else t.decode(x) for x in ids]] if decoded else [ids]

    return _add(docs, {"ids": pa.binary()} | ({"decoded": pa.string()} if decoded else {}), make, lambda: compiled(model.value).release())


def decode_ids(rows: DataFrame, ids: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """rows with decoded, the text of the packed ids; null for null, empty for none.

    Ids of any number are decoded; repeated rows are decoded alike. A column `decoded` is replaced, all others stay; an empty table gives an empty one.
    """
    model = rows.sparkSession.sparkContext.broadcast(_read(model_path))

    def make(batch: pa.RecordBatch) -> list[list]:
        t = compiled(model.value)
        return [[None if x is None else t.decode(x) for x in batch.column(ids).to_pylist()]]

    return _add(rows, {"decoded": pa.string()}, make)
