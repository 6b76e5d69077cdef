"""The event log as a stream: changes of status with state, first writers, and counts in windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may come, and how long a key's state is kept without news.
DELAY = "1 day"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream of files, with an instant for its time."""
    path = f"{sf_dir}/events.parquet"
    # A stream reads folders; as a pattern, the path also names a single file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def status_changes(events: DataFrame) -> DataFrame:
    """(event_id, user_id, event_type) of events whose type differs from the user's one before, by event_id in each batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("event_id")
        changed = rows["event_type"].ne(rows["event_type"].shift(1, fill_value=last if last is not None else ""))
        state.update((rows["event_type"].iloc[-1],))
        yield rows.loc[changed, ["event_id", "user_id", "event_type"]]

    return (
        events.select("event_id", "user_id", "event_type")
        .groupBy("user_id")
        .applyInPandasWithState(step, "event_id long, user_id long, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)
    )


def first_writers(events: DataFrame, key: str, kept: str = DELAY) -> DataFrame:
    """The first event of each key within the time that state is kept."""
    return events.withWatermark("ts", kept).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their values by window and type; a window closes when the watermark has passed it."""
    grouped = events.withWatermark("ts", DELAY).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def session_lengths(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", DELAY).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and return what it wrote in the output mode (append or complete); its files lie in the shared folder."""
    from ..session import shared_folder

    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
