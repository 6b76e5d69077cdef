"""Lives of tasks from an event stream: changes of status in order of time, one end each, and state that goes when its time is over.

Rows may come late and in any order, in any number of batches. A row waits in the state of its task until the watermark has passed its time;
then all rows before it have come, and it is judged in its turn. The first terminal status ends a task: it is told once, and what follows it is
no longer told. A task's state goes when nothing has come for it for a while of event time.

Tasks share buckets, each one key of the stream: calls to the state cost much more than rows do, so a bucket's rows of a batch go in and out as one packed table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What Spark needs for state with timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Rows that are handed on at a time.
PIECE = 10_000
#: Keys that the tasks share.
BUCKETS = 2048
_WAITING = pa.schema([("micros", pa.int64()), ("event_id", pa.int64()), ("task", pa.string()), ("status", pa.string())])
_LAST = pa.schema([("task", pa.string()), ("status", pa.string()), ("ended", pa.bool_()), ("micros", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


class _Lives(StatefulProcessor):
    def __init__(self, terminal: tuple[str, ...], keep_ms: int):
        self.terminal, self.keep_ms = terminal, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Packed rows with the earliest of their times; the tasks' last statuses with the time at which the first of them may go.
        self.waiting = handle.getListState("waiting", "low long, rows binary")
        self.last = handle.getValueState("last", "until long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        soonest, passed = None, timerValues.getCurrentWatermarkInMs()
        # A large batch of one bucket passes piece by piece.
        for part in rows:
            part = part[part["micros"] // 1000 >= passed]
            if not len(part):
                continue
            low = int(part["micros"].min())
            self.waiting.appendList([(low, _packed(pa.Table.from_pandas(part[_WAITING.names], _WAITING, preserve_index=False)))])
            soonest = low if soonest is None else min(soonest, low)
        if soonest is not None:
            self.handle.registerTimer(max(soonest // 1000, passed) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        until = now_ms * 1000
        held = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [_unpacked(rows) for low, rows in held if low <= until]
        told = []
        if due:
            rows = pa.concat_tables(due).sort_by([("micros", "ascending"), ("event_id", "ascending"), ("status", "ascending")])
            n = int((rows["micros"].to_numpy() <= until).sum())
            rest = [(low, packed) for low, packed in held if low > until]
            if n < len(rows):
                rest.append((rows["micros"][n].as_py(), _packed(rows.slice(n).combine_chunks())))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(max(min(low for low, _ in rest) // 1000, now_ms) + 1)
            else:
                self.waiting.clear()
            told = self._settle(rows.slice(0, n), now_ms)
        elif self.last.exists() and self.last.get()[0] <= now_ms:
            self._settle(_WAITING.empty_table(), now_ms)
        for i in range(0, len(told), PIECE):
            yield pd.DataFrame(told[i : i + PIECE], columns=["task", "event_id", "status", "ended"])

    def _settle(self, rows: pa.Table, now_ms: int) -> list[tuple]:
        """What is told of rows in their order; the tasks' last statuses are brought up to them, and those whose time is over go."""
        known = {}
        if self.last.exists():
            before = _unpacked(self.last.get()[1])
            known = {t: (s, e, m) for t, s, e, m in zip(*(before[c].to_pylist() for c in _LAST.names), strict=True)}
        told = []
        for micros, event_id, task, now in zip(*(rows[c].to_pylist() for c in _WAITING.names), strict=True):
            status, ended, seen = known.get(task, (None, False, None))
            if seen is not None and micros // 1000 > seen // 1000 + self.keep_ms:
                status, ended = None, False
            if not ended and now is not None and now != status:
                status, ended = now, now in self.terminal
                told.append((task, event_id, now, ended))
            known[task] = (status, ended, micros)
        # What is still to come for a task that goes lies beyond its time.
        kept = [(t, *v) for t, v in known.items() if v[2] // 1000 + self.keep_ms >= now_ms]
        if kept:
            # Tasks go some at a time: what is kept a little longer changes nothing.
            goes = min(r[3] for r in kept) // 1000 + self.keep_ms + max(1, self.keep_ms // 8)
            self.last.update((goes, _packed(pa.table([list(c) for c in zip(*kept, strict=True)], schema=_LAST))))
            self.handle.registerTimer(max(goes, now_ms) + 1)
        elif self.last.exists():
            self.last.clear()
        return told

    def close(self) -> None:
        pass


def lives(events: DataFrame, task: str, status: str, terminal: tuple[str, ...], delay: str = "1 day", keep: str = "2 days", buckets: int = BUCKETS) -> DataFrame:
    """(task, event_id, status, ended) of the stream (ts, event_id, task, status): changes of status by (ts, event_id), up to a task's first terminal one.

    Rows are told once the watermark, `delay` behind the latest time seen, has passed them; rows that come later than that, and rows without a time, are left
    out, as in any windowed count. Null statuses change nothing. A task for which no row has come for more than `keep` is forgotten, and begins anew with the next one,
    whatever the batches are.
    The waiting rows of a bucket's tasks, those of one delay, are held together when they are put in order.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.withWatermark("ts", delay).where("ts is not null")
    rows = rows.select("ts", F.unix_micros("ts").alias("micros"), "event_id", F.col(task).cast("string").alias("task"), F.col(status).alias("status"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Lives(terminal, keep_ms), outputStructType="task string, event_id long, status string, ended boolean", outputMode="Append", timeMode="EventTime"
    )


def reports(spark: SparkSession, ended: DataFrame, results: DataFrame, key: str, folder: str) -> DataFrame:
    """One report per task that ended: the stream's ends joined with the tasks' results, each written once, whatever batches are run again.

    Each batch writes to a folder of its own number, so that a batch that is repeated after a failure writes over itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = batch.where("ended").select(F.col("task"), F.col("status"))
        done.join(results.withColumnRenamed(key, "task"), "task", "left").write.mode("overwrite").parquet(f"{folder}/reports/batch={number}")

    query = ended.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = ended.where("ended").select("task", "status").schema
    for field in results.drop(key).schema:
        schema = schema.add(field)
    return spark.read.schema(schema).parquet(f"{folder}/reports").drop("batch")
