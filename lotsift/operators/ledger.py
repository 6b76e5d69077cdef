"""Queries over the ledger of jobs: states, capacity, idempotency, files, overrides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

# States of a job and the states that may follow.
TRANSITIONS = {
    "queued": ("waiting_capacity", "running", "failed"),
    "waiting_capacity": ("running", "failed"),
    "running": ("finished", "failed"),
    "failed": ("queued",),
}
CAPACITY = 20


def public_tasks(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """Tasks with their idempotency key, if any, without those of scenarios (keys that start with sc:)."""
    return tasks.join(keys, "task_id", "left").where(F.col("key").isNull() | ~F.col("key").startswith("sc:"))


def running_priority(tasks: DataFrame, recorded: int = 0) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col("status") == "running", F.col("priority"))), F.lit(0))
    return tasks.agg(total.cast("bigint").alias("running_sum"), (total != recorded).alias("drifted"))


def stale_files(files: DataFrame, referenced: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Files (path, modified) older than so many hours that no result refers to."""
    return files.join(referenced, "path", "left_anti").where(F.col("modified") <= now - F.expr(f"interval {hours} hours"))


def status_changes(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Events whose status differs from the one before of the same key, the first one included."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("previous", F.lag(status).over(w)).where(F.col("previous").isNull() | (F.col("previous") != F.col(status)))


def invalid_transitions(events: DataFrame, allowed: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Changes of status (source, target) that `allowed` doesn't list."""
    w = Window.partitionBy(key).orderBy(*order)
    moves = events.withColumn("source", F.lag(status).over(w)).withColumn("target", F.col(status)).where("source is not null and source <> target")
    return moves.join(allowed.select("source", "target"), ["source", "target"], "left_anti")


def admissions(requests: DataFrame, group: str, order: str, priority: str, capacity: int = CAPACITY) -> DataFrame:
    """Requests with `admitted` and the sum reserved after each, taken in order within a group.

    A request is admitted if the sum so far and its priority fit the capacity; a null priority has null `admitted` and reserves nothing.
    Each group is a queue of its own: its rows lie sorted in one partition and are folded as they pass, so a task holds a batch and one sum, however long the queue.
    """
    kind, key = requests.schema[order].dataType, requests.schema[group].dataType
    rows = requests.select(group, F.col(order).alias("o"), F.col(priority).cast("bigint").alias("p"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list = []
        total = 0
        for batch in batches:
            fits, sums = [], []
            for name, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if queue != [name]:
                    queue, total = [name], 0
                fit = None if p is None else total + p <= capacity
                total += p if fit else 0
                fits.append(fit)
                sums.append(total)
            made = [batch.column(0), batch.column(1), pa.array(fits, type=pa.bool_()), pa.array(sums, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["g", "o", "admitted", "reserved"])

    schema = StructType([StructField("g", key), StructField("o", kind), StructField("admitted", BooleanType()), StructField("reserved", LongType())])
    folded = rows.repartition(group).sortWithinPartitions(group, "o", "p").mapInArrow(fold, schema)
    return folded.select(F.col("g").alias(group), F.col("o").alias(order), "admitted", "reserved")


def first_writers(requests: DataFrame, key: str, *order: str) -> DataFrame:
    """The first request of each key; later ones are answered by it."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def effective_config(base: DataFrame, overrides: DataFrame, *order: str) -> DataFrame:
    """(name, value, overridden) of base (name, value) under the latest override (name, value, deleted) of each name."""
    last = overrides.groupBy("name").agg(F.max_by(F.struct("value", "deleted"), F.struct(*order)).alias("o")).select("name", F.when(~F.col("o.deleted"), F.col("o.value")).alias("over"))
    return base.join(last, "name", "left").select("name", F.coalesce("over", "value").alias("value"), F.col("over").isNotNull().alias("overridden"))


def parsed_key(key: Column | str) -> Column:
    """Struct of a scenario key sc:id:year:source:type-N:upd-...:m-...; null where it has another form."""
    c = F.col(key) if isinstance(key, str) else key
    form = r"^sc:(\d+):(\d+):([^:]+):type-([^:]+):upd-(.*):m-([^:]+)$"

    def part(i: int) -> Column:
        return F.regexp_extract(c, form, i)

    return F.when(
        c.rlike(form),
        F.struct(
            part(1).cast("bigint").alias("scenario_id"), part(2).cast("int").alias("year"), part(3).alias("source"), part(4).alias("type"), part(5).alias("updated"), part(6).alias("mapping")
        ),
    )


def last_messages(messages: DataFrame, key: str, order: str, most: int = 10, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """The last messages of each conversation by users and assistants, in order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return messages.where(F.col("role").isin(*roles)).withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def waiting_seconds(created: Column, started: Column) -> Column:
    return F.greatest(F.unix_micros(started.cast("timestamp")) - F.unix_micros(created.cast("timestamp")), F.lit(0)) / 1e6
