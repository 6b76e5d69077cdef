import datetime as dt
import random

import pytest

from lotsift.llm.url_filter import evaluate, intervals, url_host, url_path

LOG = "category string, verdict string, host string, prefix string, day date, change string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("HTTP://User@WWW.Example.COM:8080/A/b?q#f", "example.com", "/A/b"),
        ("https://m.x.org", "m.x.org", "/"),
        ("https://x.org.?q=/a", "x.org", "/"),
        ("no url", None, "/"),
        (None, None, None),
        ("http://", None, "/"),
    ],
)
def test_parts_of_urls(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "u string").select(url_host("u").alias("h"), url_path("u").alias("p")).first()
    assert row.h == host and (url is None or row.p == path)


def test_against_replaying_the_log(spark):
    r = random.Random(5)
    hosts, prefixes = ["a.com", "b.a.com", "c.b.a.com", "d.org"], ["/", "/x", "/x/y"]
    log = [(r.choice("pq"), r.choice(["block", "allow"]), r.choice(hosts), r.choice(prefixes), day(r.randrange(40)), r.choice(["add", "remove"])) for _ in range(120)]
    pages = [(i, f"http://{r.choice(hosts)}{r.choice(['', '/x', '/x/y/z', '/q'])}", day(r.randrange(-3, 44))) for i in range(300)]
    got = {x.page_id: (x.n_active, x.categories, x.blocked) for x in evaluate(spark.createDataFrame(pages, "page_id int, url string, fetched_on date"), spark.createDataFrame(log, LOG)).collect()}
    for i, url, at in pages:
        active = {}
        for e in sorted((x for x in log if x[4] <= at), key=lambda x: (x[4], x[5] == "add")):
            active[e[:4]] = e[5] == "add"
        rest = url[7:]
        host, path = (rest.split("/", 1)[0], "/" + rest.split("/", 1)[1]) if "/" in rest else (rest, "/")
        on = [k for k, v in active.items() if v and (host == k[2] or host.endswith("." + k[2])) and path.startswith(k[3])]
        blocked = any(k[1] == "block" for k in on) and not any(k[1] == "allow" for k in on)
        assert got[i] == (len(on), ",".join(sorted({k[0] for k in on})), blocked)


def test_intervals_of_odd_logs(spark):
    log = [("c", "block", "H.com", None, day(1), "remove"), ("c", "block", "h.com", None, day(2), "add"), ("c", "block", "h.com", None, day(2), "add"), ("c", "block", "h.com", None, day(3), "add"),
           ("c", "block", "h.com", None, day(4), "remove"), ("c", "block", None, None, day(1), "add"), ("c", "block", "h.com", None, None, "add"), ("c", "block", "h.com", None, day(5), None)]
    got = [(r.host, r.prefix, r.valid_from, r.valid_until) for r in intervals(spark.createDataFrame(log, LOG)).collect()]
    assert got == [("h.com", "/", day(2), day(4))]


def test_nulls_repeats_and_columns(spark):
    rows = spark.createDataFrame([(1, None, day(1), 0), (2, "http://h.com/", None, 0), (3, "http://h.com/", day(2), 0), (3, "http://h.com/", day(2), 0), (None, "http://h.com/", day(2), 0)], "page_id long, url string, fetched_on date, host int")
    log = spark.createDataFrame([("c", "block", "h.com", "/", day(1), "add")], LOG)
    got = sorted((r.page_id or 0, r.n_active, r.blocked) for r in evaluate(rows, log).collect())
    assert got == [(0, 1, True), (1, 0, False), (2, 0, False), (3, 1, True), (3, 1, True)]
    assert evaluate(rows.where("false"), log).count() == 0
    assert all(not r.blocked for r in evaluate(rows, log.where("false")).collect())


def test_hosts_of_the_list_take_the_form_of_captures(spark):
    log = spark.createDataFrame([("c", "block", "WWW.Bad.com.", "/", day(1), "add")], LOG)
    rows = spark.createDataFrame([(1, "http://www.bad.com/x", day(2), "q"), (2, "http://a.bad.com/" + "y" * 100_000, day(2), "q"), (3, "http://notbad.com/", day(2), "q")], "page_id int, url string, fetched_on date, domain string")
    assert {r.page_id: r.blocked for r in evaluate(rows, log).collect()} == {1: True, 2: True, 3: False}


def test_empty_tables(spark):
    from lotsift.llm.url_filter import evaluate

    captures = spark.createDataFrame([], "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame([], "category string, verdict string, host string, prefix string, day date, change string")
    assert evaluate(captures, entries).count() == 0
