"""GeoJSON collections read in pieces and written in pieces.

A document is split like any text, at braces instead of lines, so one large layer is read by many tasks. What a brace means depends on all that
comes before: whether it lies in a string, how deep, in which member of the document. Each block first tells what it does to that state for either start
(inside a string or not); the blocks' answers are chained, and then every block knows its start. Features that two blocks share are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
_OPEN, _CLOSE, _BRACE, _END, _QUOTE = (ord(c) for c in "[]{}\"")
#: Depth within a feature's braces: the document, its list, the feature.
_FEATURE = 3


class _Scan:
    """Brackets of a text that comes in parts, with the depth after each, from a given start."""

    def __init__(self, quoted: bool = False, depth: int = 0):
        self.quoted, self.depth = int(quoted), depth

    def brackets(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, characters and depths after them of the brackets outside strings. A part ends outside of escapes."""
        text = np.frombuffer(_ESCAPED.sub(b"..", data) if b"\\" in data else data, np.uint8)
        inside = (np.cumsum(text == _QUOTE) + self.quoted) & 1
        up = (text == _BRACE) | (text == _OPEN)
        at = np.flatnonzero((up | (text == _END) | (text == _CLOSE)) & (inside == 0))
        depth = self.depth + np.cumsum(np.where(up[at], 1, -1))
        if len(text):
            self.quoted = int(inside[-1])
        if len(at):
            self.depth = int(depth[-1])
        return at, text[at], depth


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """(path, start) of each block of this task with its text in parts; rows of a block lie together."""
    pending: list = []

    def rows() -> Iterator[tuple[tuple[str, int], bytes]]:
        for batch in batches:
            path, start = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [0, *[k for k in range(1, len(path)) if (path[k], start[k]) != (path[k - 1], start[k - 1])], len(path)]
            values = batch.column(2).to_pylist()
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i < j:
                    # The reader has taken the brace off every row.
                    yield (path[i], start[i]), "".join(v + "}" for v in values[i:j]).encode()

    source = rows()

    def parts(key: tuple[str, int], first: bytes) -> Iterator[bytes]:
        yield first
        for other, data in source:
            if other != key:
                pending.append((other, data))
                return
            yield data

    while True:
        head = pending.pop() if pending else next(source, None)
        if head is None:
            return
        own = parts(*head)
        yield head[0], own
        for _ in own:
            pass


def _effect(parts: Iterator[bytes]) -> tuple[bool, int, bool, int]:
    """For a start outside and one inside a string: whether the block ends inside one, and by how much it changes the depth."""
    both = _Scan(), _Scan(quoted=True)
    for data in parts:
        for scan in both:
            scan.brackets(data)
    return tuple(x for s in both for x in (bool(s.quoted), s.depth))


def _members(data: bytes, at: np.ndarray, depth: np.ndarray, char: np.ndarray) -> list[tuple[int, str]]:
    """Places where members of the document open, with their names."""
    out = []
    for k in np.flatnonzero((depth == 2) & ((char == _OPEN) | (char == _BRACE))).tolist():
        found = _KEY.search(data, max(0, int(at[k]) - 500), int(at[k]))
        out.append((int(at[k]), found[1].decode("utf-8", "replace") if found and char[k] == _OPEN else ""))
    return out


def _owned(parts: Iterator[bytes], quoted: bool, depth: int) -> tuple[int, int, str | None]:
    """Features that begin before any member opens in this block, those that begin in `features` after that, and the last member's name."""
    scan, before, own, member = _Scan(quoted, depth), 0, 0, None
    for data in parts:
        at, char, deep = scan.brackets(data)
        starts = at[(char == _BRACE) & (deep == _FEATURE)]
        opened = _members(data, at, deep, char)
        cuts = np.searchsorted(starts, [a for a, _ in opened])
        for name, n in zip([member, *(m for _, m in opened)], np.diff([0, *cuts, len(starts)]), strict=True):
            before += int(n) if name is None else 0
            own += int(n) if name == "features" else 0
        member = opened[-1][1] if opened else member
    return before, own, member


def _features(parts: Iterator[bytes], quoted: bool, depth: int, member: str, n: int) -> Iterator[tuple[int, bool, bytes]]:
    """(number, whole, text) of the features of a block; a part of one that another block shares isn't whole."""
    scan, held, open_now, whole = _Scan(quoted, depth), [], depth >= _FEATURE and member == "features", False
    number = n - 1
    for data in parts:
        at, char, deep = scan.brackets(data)
        events = [(a, "member", m) for a, m in _members(data, at, deep, char)]
        events += [(int(a), "start", "") for a in at[(char == _BRACE) & (deep == _FEATURE)]]
        events += [(int(a), "end", "") for a in at[(char == _END) & (deep == _FEATURE - 1)]]
        begin = 0
        for place, what, name in sorted(events):
            if what == "member":
                member = name
            elif what == "start" and member == "features":
                number, begin, open_now, whole = number + 1, place, True, True
            elif what == "end" and open_now:
                held.append(data[begin : place + 1])
                yield number, whole, b"".join(held)
                held, open_now = [], False
        if open_now:
            held.append(data[begin:])
    if open_now:
        yield number, False, b"".join(held)


def _told(f: Callable, schema: pa.Schema):
    """A task's function that gives the rows of f(key, parts) for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _blocks(batches):
            rows = []
            for row in f(key, parts):
                rows.append(row)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


_EFFECT = pa.schema([("path", pa.string()), ("start", pa.int64()), ("q0", pa.bool_()), ("d0", pa.int64()), ("q1", pa.bool_()), ("d1", pa.int64())])
_OWNED = pa.schema([("path", pa.string()), ("start", pa.int64()), ("before", pa.int64()), ("own", pa.int64()), ("member", pa.string())])
_PIECE = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("whole", pa.bool_()), ("start", pa.int64()), ("text", pa.string())])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, feature) of the features of FeatureCollections, each document read by as many tasks as it has splits; feature is a variant.

    ord numbers a document's features from 0. Objects in other members of a document aren't features, and what isn't JSON has none; a feature
    that isn't JSON itself is null. The driver sees two small rows for each split of a file.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    effects = rows.mapInArrow(_told(lambda key, parts: [(*key, *_effect(parts))], _EFFECT), "path string, start bigint, q0 boolean, d0 bigint, q1 boolean, d1 bigint").collect()
    state: dict[tuple[str, int], tuple[bool, int]] = {}
    now: dict[str, tuple[bool, int]] = {}
    for r in sorted(effects, key=lambda r: (r["path"], r["start"])):
        quoted, depth = now.get(r["path"], (False, 0))
        state[r["path"], r["start"]] = quoted, depth
        now[r["path"]] = (r["q1"], depth + r["d1"]) if quoted else (r["q0"], depth + r["d0"])
    owned = rows.mapInArrow(_told(lambda key, parts: [(*key, *_owned(parts, *state[key]))], _OWNED), "path string, start bigint, before bigint, own bigint, member string").collect()
    begin: dict[tuple[str, int], tuple[str, int]] = {}
    at: dict[str, tuple[str, int]] = {}
    for r in sorted(owned, key=lambda r: (r["path"], r["start"])):
        member, n = at.get(r["path"], ("", 0))
        begin[r["path"], r["start"]] = member, n
        n += r["own"] + (r["before"] if member == "features" else 0)
        at[r["path"]] = (member if r["member"] is None else r["member"], n)

    def pieces(key, parts):
        for number, whole, text in _features(parts, *state[key], *begin[key]):
            yield key[0], number, whole, key[1], text.decode("utf-8", "replace")

    found = rows.mapInArrow(_told(pieces, _PIECE), "path string, ord bigint, whole boolean, start bigint, text string")
    shared = found.where("not whole").groupBy("path", "ord").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = shared.select("path", "ord", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return found.where("whole").select("path", "ord", "text").union(joined).select("path", "ord", F.try_parse_json("text").alias("feature"))


def with_properties(feature: Column, properties: dict[str, Column]) -> Column:
    """The feature, a variant, with these properties added to its own; they replace those of the same names."""
    own = F.coalesce(F.try_variant_get(feature, "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(own, lambda k, _: ~k.isin(*properties))
    added = F.create_map(*[x for name, c in properties.items() for x in (F.lit(name), F.coalesce(F.parse_json(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))))])
    values = F.transform_values(added, lambda _, v: F.variant_get(v, "$.v", "variant"))
    rest = F.struct(F.lit("Feature").alias("type"), F.map_concat(kept, values).alias("properties"), F.try_variant_get(feature, "$.geometry", "variant").alias("geometry"))
    return F.parse_json(F.to_json(rest, {"ignoreNullFields": "false"}))


def write_collection(rows: DataFrame, feature: str, path: str, files: int | None = None) -> None:
    """The features (a column of variants) as FeatureCollections: each file written is a whole one; with files=1 there is just one.

    Rows of a null feature are left out. Files are written side by side by their tasks; nothing passes the driver.
    """

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(['{"type":"FeatureCollection","features":['])], names=["value"])
        first = True
        for batch in batches:
            lines = [v for v in batch.column(0).to_pylist() if v is not None]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("" if first and not k else ",") + v for k, v in enumerate(lines)])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["value"])

    texts = rows.select(F.to_json(feature).alias("value"))
    (texts if files is None else texts.coalesce(files)).mapInArrow(framed, "value string").write.text(path)
