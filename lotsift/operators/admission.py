"""Capacity admission with release, as a scan over tables of what a stretch of events does to every load.

With a capacity of C a load is one of 0 to C, so any stretch of reservations and releases is a table of C + 1 entries, the load after it
for each load before. Tables of neighbouring stretches compose, in any order of work, so a queue may lie in many tasks: each
first makes the table of its part, the tables are chained, and then every task folds its part from the load that it starts with.
Within a task stretches of a queue are folded side by side in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .ledger import CAPACITY

#: A table has an entry a load, so capacities are bounded.
MOST_CAPACITY = 4096


def _after(load: np.ndarray, amount: np.ndarray, release: np.ndarray, capacity: int) -> np.ndarray:
    """Load after one event: a reservation that fits adds to it, a release takes from it down to 0, an amount that is null (-1) does nothing."""
    taken = np.where(load + amount <= capacity, load + amount, load)
    return np.where(amount < 0, load, np.where(release, np.maximum(load - amount, 0), taken))


def _blocks(amount: np.ndarray, release: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The events as a matrix (stretches, steps) of about as many stretches as steps; the last one is filled up with events that do nothing."""
    n = len(amount)
    steps = max(1, int(np.sqrt(n)))
    rows = -(-n // steps)
    a, r = np.full(rows * steps, -1, dtype=np.int64), np.zeros(rows * steps, dtype=bool)
    a[:n], r[:n] = amount, release
    return a.reshape(rows, steps), r.reshape(rows, steps)


def tables_of(amount: np.ndarray, release: np.ndarray, capacity: int) -> np.ndarray:
    """The tables (stretch, load before) of the blocks of these events."""
    a, r = _blocks(amount, release)
    load = np.broadcast_to(np.arange(capacity + 1), (len(a), capacity + 1))
    for k in range(a.shape[1]):
        load = _after(load, a[:, k, None], r[:, k, None], capacity)
    return load


def composed(tables: np.ndarray) -> np.ndarray:
    """The table of all stretches one after the other, halving their number in each round."""
    while len(tables) > 1:
        odd = tables[-1:] if len(tables) % 2 else tables[:0]
        tables = np.concatenate([np.take_along_axis(tables[1::2], tables[: len(tables) // 2 * 2 : 2], axis=1), odd])
    return tables[0]


def folded(amount: np.ndarray, release: np.ndarray, start: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each event's amount could be reserved, and the load after it."""
    tables = tables_of(amount, release, capacity)
    first = np.empty(len(tables), dtype=np.int64)
    for k in range(len(tables)):
        first[k] = start
        start = int(tables[k, start])
    a, r = _blocks(amount, release)
    load, fits, loads = first, np.empty(a.shape, dtype=bool), np.empty(a.shape, dtype=np.int64)
    for k in range(a.shape[1]):
        fits[:, k] = load + a[:, k] <= capacity
        loads[:, k] = load = _after(load, a[:, k], r[:, k], capacity)
    return fits.ravel()[: len(amount)], loads.ravel()[: len(amount)]


def _events(batch: pa.RecordBatch, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    # Amounts beyond the capacity never fit, and release all; they need not be held exactly.
    amount = batch.column("amount").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.minimum(amount, capacity + 1), batch.column("releases").fill_null(False).to_numpy(zero_copy_only=False)


def _runs(queue: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of rows of one queue."""
    codes = queue.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def admissions_with_release(events: DataFrame, queue: str, order: list[str], amount: str, releases: str, capacity: int = CAPACITY) -> DataFrame:
    """events with `admitted` (null for releases) and `load` after each, taken by `order` within a queue.

    A reservation is admitted if the load and its amount fit the capacity; a release (`releases` is true) lowers the load, to 0 at
    least. Events without an amount do nothing and have null admitted; amounts are whole numbers from 0. Events of
    equal order are taken as they lie, so order should tell them apart. A null queue is a queue. Rows are sorted in ranges of queue and
    order, so a queue of any length is spread over tasks; the driver sees two small tables for each of them. An empty table gives an empty result.
    """
    if not 0 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"capacity must lie between 0 and {MOST_CAPACITY}")
    names = [c for c in events.columns if c not in ("admitted", "load")]
    made = events.select(*names, F.col(queue).alias("_q"), F.col(amount).cast("bigint").alias("_a"), F.col(releases).cast("boolean").alias("_r"))
    # A number given stays, so few rows are spread as well.
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpoint(made.repartitionByRange(parts, queue, *order).sortWithinPartitions(queue, *order))

    def renamed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [batch.schema.get_field_index(c) for c in ("_q", "_a", "_r")]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in keep], names=["queue", "amount", "releases"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first and of the last queue of this part: its table."""
        first = last = None
        for whole in batches:
            batch = renamed(whole)
            for i, j in _runs(batch.column(0)):
                part = batch.slice(i, j - i)
                own = composed(tables_of(*_events(part, capacity), capacity))
                name = part.column(0)[0].as_py()
                if last is not None and last[0] == [name]:
                    last = ([name], own[last[1]])
                    if first is not None and not first[2]:
                        first = (*last, False)
                else:
                    if first is not None:
                        first = (first[0], first[1], True)
                    last = ([name], own)
                    first = first or (*last, False)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([first[0] == last[0]]), pa.array([first[1].tolist()]), pa.array([last[1].tolist()]), pa.array(first[0], kind), pa.array(last[0], kind)],
            names=["part", "whole", "first", "last", "first_queue", "last_queue"],
        )

    kind = pa.array([], _arrow(events, queue)).type
    told = rows.mapInArrow(ends, f"part int, whole boolean, first array<bigint>, last array<bigint>, first_queue {events.schema[queue].dataType.simpleString()}, last_queue {events.schema[queue].dataType.simpleString()}")
    start, before, load = {}, None, 0
    for t in sorted(told.collect(), key=lambda t: t["part"]):
        start[t["part"]] = load if before == [t["first_queue"]] else 0
        if t["whole"]:
            load = t["last"][start[t["part"]]]
        else:
            load = t["last"][0]
        before = [t["last_queue"]]

    schema = events.select(*names).schema.add("admitted", "boolean").add("load", "long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue_now, load = None, start.get(TaskContext.get().partitionId(), 0)
        for whole in batches:
            batch = renamed(whole)
            fits, loads = [], []
            for i, j in _runs(batch.column(0)):
                part = batch.slice(i, j - i)
                name = [part.column(0)[0].as_py()]
                if queue_now is not None and name != queue_now:
                    load = 0
                queue_now = name
                a, r = _events(part, capacity)
                f, after = folded(a, r, load, capacity)
                load = int(after[-1])
                fits.append(pa.array(f, mask=r | (a < 0)))
                loads.append(pa.array(after))
            columns = [whole.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(fits), pa.concat_arrays(loads)], schema=pa.schema([*(whole.schema.field(c) for c in names), ("admitted", pa.bool_()), ("load", pa.int64())]))

    return rows.mapInArrow(fold, schema)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
