"""Lives from streams in several batches against one pass over the sorted events."""

import datetime as dt
import random
import uuid

import pytest

from lotsift.streaming import lifecycle as L

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, event_id long, job string, state string"


def plain(rows, terminal=("done",)):
    out, last, ended, seen = [], {}, set(), {}
    for at, i, job, state in sorted(r for r in rows if r[0] is not None):
        if at - seen.get(job, at) > dt.timedelta(days=2):
            ended.discard(job)
            last.pop(job, None)
        seen[job] = at
        if state is not None and job not in ended and last.get(job) != state:
            last[job] = state
            if state in terminal:
                ended.add(job)
            out.append((job, i, state, state in terminal))
    return sorted(out)


def streamed(spark, tmp_path, batches, **more):
    """Each batch a file, read one at a time; a last one far ahead lets the watermark pass all of them."""
    folder = tmp_path / uuid.uuid4().hex
    for k, rows in enumerate([*batches, [(START + dt.timedelta(days=400), -1, "flush", "x")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / "in" / f"{k:03}"))
        for f in (folder / "in" / f"{k:03}").glob("*.parquet"):
            f.rename(folder / f"{k:03}.parquet")
            import os

            os.utime(folder / f"{k:03}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))
    out = L.lives(stream, "job", "state", ("done",), **more)
    query = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(str(folder / "out")).collect() if r.task != "flush"), progress


def events(n, jobs, seed, hours):
    r = random.Random(seed)
    return [(START + dt.timedelta(seconds=r.randrange(hours * 3600)), i, f"j{r.randrange(jobs)}", r.choice(["queued", "running", "running", None, "failed"] + ["done"] * (r.random() < 0.2))) for i in range(n)]


@pytest.mark.parametrize("jobs", [1, 15])
def test_out_of_order_batches_give_the_lives_of_one_pass(spark, tmp_path, jobs):
    rows = events(400, jobs, jobs, 20)
    random.Random(1).shuffle(rows)
    got, _ = streamed(spark, tmp_path, [rows[i::4] for i in range(4)])
    assert got == plain(rows)
    assert jobs == 1 or sum(r[3] for r in got) > 3


def test_lives_with_gaps_of_all_lengths(spark, tmp_path):
    rows = events(300, 6, 9, 24 * 60)
    random.Random(2).shuffle(rows)
    rows.sort(key=lambda r: r[0] + dt.timedelta(hours=random.Random(r[1]).randrange(20)))
    got, _ = streamed(spark, tmp_path, [rows[i : i + 75] for i in range(0, 300, 75)])
    assert got == plain(rows) and len(got) > 30


def test_state_goes_after_its_time(spark, tmp_path):
    early = [(START + dt.timedelta(hours=1), 1, "a", "running"), (START + dt.timedelta(hours=2), 2, "b", "queued")]
    later = [(START + dt.timedelta(days=30), 3, "b", "queued")]
    got, progress = streamed(spark, tmp_path, [early, later])
    # After so long, b begins anew.
    assert got == [("a", 1, "running", False), ("b", 2, "queued", False), ("b", 3, "queued", False)]
    kept = progress[-1].stateOperators[0].customMetrics
    assert progress[-1].stateOperators[0].numRowsTotal <= 4, kept


def test_rows_after_the_end_and_rows_too_late(spark, tmp_path):
    h = dt.timedelta(hours=1)
    batches = [[(START + 3 * h, 3, "a", "done"), (START + h, 1, "a", "running")], [(START + 4 * h, 4, "a", "queued"), (START + 2 * h, 2, "a", "running"), (None, 9, "a", "failed")], [(START + 100 * h, 5, "b", "x")], [(START + 2 * h, 6, "c", "late")]]
    got, _ = streamed(spark, tmp_path, batches)
    assert got == [("a", 1, "running", False), ("a", 3, "done", True), ("b", 5, "x", False)]


def test_each_end_has_one_report(spark, tmp_path):
    rows = events(200, 10, 3, 10)
    folder = tmp_path / "r"
    for k in range(2):
        spark.createDataFrame(rows[k::2] + [(START + dt.timedelta(days=400 + k), -1 - k, "flush", "x")] * k, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    results = spark.createDataFrame([(f"j{i}", i * 1.5) for i in range(5)], "job string, share double")
    got = L.reports(spark, L.lives(stream, "job", "state", ("done",)), results, "job", str(folder)).collect()
    ends = [t for t, _, _, e in plain(rows) if e]
    assert sorted(r.task for r in got) == sorted(ends)
    assert all(r.share == (int(r.task[1:]) * 1.5 if int(r.task[1:]) < 5 else None) for r in got)


def test_waiting_rows_are_packed(spark, tmp_path):
    rows = events(3000, 40, 5, 20)
    got, progress = streamed(spark, tmp_path, [rows])
    assert got == plain(rows)
    # One row of state for a bucket's rows of a batch, not one for each of 3000.
    assert max(p.stateOperators[0].numRowsTotal for p in progress) < 500


def test_few_buckets_of_many_tasks(spark, tmp_path):
    rows = events(400, 60, 8, 12 * 24)
    rows.sort(key=lambda r: r[0] + dt.timedelta(hours=random.Random(r[1]).randrange(20)))
    got, progress = streamed(spark, tmp_path, [rows[i : i + 100] for i in range(0, 400, 100)], buckets=3)
    assert got == plain(rows) and len(got) > 100
    assert progress[-1].stateOperators[0].numRowsTotal <= 4
