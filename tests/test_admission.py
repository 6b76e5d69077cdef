"""Admission with release against a fold of one event after the other."""

import random

import numpy as np
import pytest

from lotsift.operators import admission as A


def plain(events, capacity=20):
    """{key: (admitted, load)} of events (queue, key, amount, releases)."""
    load, out = {}, {}
    for q, k, a, r in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1])):
        now, fits = load.get(q, 0), None
        if a is not None and r:
            now = max(0, now - a)
        elif a is not None:
            fits = now + a <= capacity
            now += a if fits else 0
        load[q] = now
        out[k] = (fits, now)
    return out


def run(spark, events, **more):
    df = spark.createDataFrame(events, "queue string, key long, amount long, releases boolean")
    return {r.key: (r.admitted, r.load) for r in A.admissions_with_release(df, "queue", ["key"], "amount", "releases", **more).collect()}


def test_policy():
    def one(load, amount, release, capacity=10):
        fits, after = A.folded(np.array([amount]), np.array([release]), load, capacity)
        return bool(fits[0]), int(after[0])

    assert one(8, 5, False) == (False, 8)
    assert one(7, 3, True)[1] == 4
    assert one(1, 3, True)[1] == 0
    assert one(5, 5, False) == (True, 10)


def test_tables_compose_in_any_order():
    r = np.random.default_rng(1)
    amount, release = r.integers(0, 9, 1000), r.random(1000) < 0.5
    whole = A.composed(A.tables_of(amount, release, 20))
    a, b, c = (A.composed(A.tables_of(amount[s], release[s], 20)) for s in (slice(0, 300), slice(300, 555), slice(555, None)))
    assert whole.tolist() == c[b[a]].tolist() == (c[b])[a].tolist()
    for start in (0, 7, 20):
        assert A.folded(amount, release, start, 20)[1][-1] == whole[start]


@pytest.mark.parametrize("queues", [1, 2, 40])
def test_as_one_event_after_the_other(spark, queues):
    r = random.Random(queues)
    events = [(f"q{r.randrange(queues)}", k, r.randrange(0, 30) if r.random() < 0.95 else None, r.random() < 0.45) for k in range(3000)]
    assert run(spark, events) == plain(events)
    assert run(spark, events, capacity=3) == plain(events, 3)


def test_one_queue_is_spread_over_tasks(spark):
    events = [("q", k, k % 7, k % 3 == 0) for k in range(4000)]
    df = spark.createDataFrame(events, "queue string, key long, amount long, releases boolean")
    out = A.admissions_with_release(df, "queue", ["key"], "amount", "releases")
    sizes = [len(p) for p in out.select("key").rdd.glom().collect()]
    assert max(sizes) < 2500 and sum(sizes) == 4000, "no task holds the queue"


def test_nulls_empty_and_clashing_names(spark):
    events = [(None, 1, 5, False), (None, 2, 5, None), ("", 3, None, True), ("", 4, 100, False), ("", 5, 100, True), ("x", 6, 20, False), ("x", 7, 1, False)]
    assert run(spark, events) == plain(events)
    assert run(spark, []) == {}
    odd = spark.createDataFrame([("q", 1, 2, True, 7, 8.0, "z")], "queue string, key long, amount long, releases boolean, load int, part double, first string")
    row = A.admissions_with_release(odd, "queue", ["key"], "amount", "releases").first()
    assert (row.load, row.part, row["first"], row.admitted) == (0, 8.0, "z", None)
    with pytest.raises(ValueError):
        A.admissions_with_release(odd, "queue", ["key"], "amount", "releases", capacity=10**6)
