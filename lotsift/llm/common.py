"""Pieces that several corpus operators share: checkpoints, words and hashes, batches, connected components."""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
#: Bytes of text in one batch handed to Python.
BATCH_BYTES = 4 << 20
#: Edges of a graph in one file of a checkpoint.
EDGES_OF_A_FILE = 100_000


_trimmed = [0.0]


def give_back() -> None:
    """Return freed memory to the system; a worker outlives its tasks, and what it holds adds up beside the executor's heap."""
    _trimmed[0] = time.monotonic()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(f):
    """A function of an iterator of parts that gives memory back when the task ends."""

    @functools.wraps(f)
    def run(parts):
        try:
            yield from f(parts)
        finally:
            give_back()

    return run


def frugal_group(f):
    """A function of a group that gives memory back after it, once a second at most."""
    # Spark tells by the number of parameters whether a key is wanted and whether groups come in pairs.
    n = len(inspect.signature(f).parameters)

    def after(out):
        if time.monotonic() - _trimmed[0] > 1:
            give_back()
        return out

    if n == 1:
        return lambda a: after(f(a))
    return (lambda a, b: after(f(a, b))) if n == 2 else (lambda a, b, c: after(f(a, b, c)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        if not sc.master.startswith(("local[", "local")) or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lotsift-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; Spark removes it when nothing uses it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpoint, as a compressed table, for texts. The folder's owner removes it after the job."""
    path = f"{shared_folder(df.sparkSession)}/lotsift-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class WordHashes(dict):
    """64-bit hash of each word, kept for short words seen before; emptied when it holds `limit` of them (some 15 MB)."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))


#: The one that all operators of a worker share.
WORD_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() without arguments cuts at just these bytes."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As words_of, with A-Z alone in lower case; bytes.lower() leaves all else."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class WindowHashes:
    """Hashes of every run of `size` words, from prefix sums of a polynomial over Z/2^64 with an odd base."""

    def __init__(self) -> None:
        self.up = self.down = _powers(_BASE, 1)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def of(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes)
        if n < size:
            return np.empty(0, dtype=_U)
        self.grow(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


def _packed(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(batch: bytes) -> tuple[list[str | None], list[str | None]]:
    """Ids and texts of a batch."""
    table = pa.ipc.open_stream(batch).read_all()
    return table["id"].to_pylist(), table["text"].to_pylist()


def batches(docs: DataFrame, key: str, text: str, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(g, batch): rows as they come, packed and compressed until a batch has batch_bytes of text (or 50,000 rows); and how many there are.

    A batch holds whatever rows lie side by side, so no id or text, however frequent, makes a large one; only a
    text longer than batch_bytes does. Batches are written once, to the shared folder, so that all passes over them
    see the same ones, also after executors are lost. The id is the key as text.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place + made], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["g", "batch"])

        for part in parts:
            part = pa.RecordBatch.from_arrays(part.columns, names=["id", "text"])
            lengths = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy()
            start = 0
            for i, length in enumerate(lengths.tolist()):
                size, rows = size + length, rows + 1
                if size >= batch_bytes or rows >= 50_000:
                    held.append(part.slice(start, i + 1 - start))
                    yield ready()
                    held, size, rows, made, start = [], 0, 0, made + 1, i + 1
            if start < len(part):
                held.append(part.slice(start))
        if held:
            yield ready()

    made = stored(docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(frugal(pack), "g bigint, batch binary"))
    return made, made.count()


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """df partitioned by a column of n values, some eight of them a task."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 8))
    return df.repartition(min(max(1, n), parts), by)


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the smallest one connected to it here."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    names, kinds = None, None
    for part in parts:
        names, kinds = part.schema.names, part.schema.types
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 500_000:
            yield _stars(root, find, names, kinds)
            root.clear()
    if root:
        yield _stars(root, find, names, kinds)


def _stars(root: dict, find, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kinds[k]) for k in (0, 1)], names=names)


def _is_star_forest(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, and no v is a u: then every node's v is its label."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b), for nodes with an edge.

    Partitions first reduce their edges to stars. Large-star and small-star rounds then join a
    node's neighbours to its smallest one, so that chains shrink quickly and a hub's edges stay spread over
    rows, until only stars are left. A round's edges are no more than those before it, so they are written in as few files as these need.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = checkpoint(e.mapInArrow(frugal(_forest), e.schema).distinct())
    files = max(1, math.ceil(e.count() / EDGES_OF_A_FILE))
    while not _is_star_forest(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = checkpoint(
            small.where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
            .coalesce(files)
        )
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as many bytes as the largest one needs, plane by plane, so that small ones leave zeros, which shuffles compress."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + planes(values, width)


def unnumbers(data: bytes) -> np.ndarray:
    return unplanes(data[1:], data[0])


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Little-endian bytes, plane by plane: small numbers leave planes of zeros, which shuffles compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(data: bytes, width: int = 4) -> np.ndarray:
    cut = np.frombuffer(data, dtype=np.uint8).reshape(width, len(data) // width).T
    out = np.zeros((len(cut), 8), dtype=np.uint8)
    out[:, :width] = cut
    return out.view("<u8").ravel()
