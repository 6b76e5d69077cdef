"""Queries of the ledger, of its events and of chats and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import outer_json
from ..operators import admission, ledger, reports
from ..streaming import events as streams
from ..streaming import lifecycle
from .spatial_lookup import _VERDICTS, _verdicts
from .views import table

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_KEYS = "(select c_custkey as task_id, case when c_custkey % 5 = 0 then 'sc:' || c_custkey else 'user:' || c_custkey end as key from customer where c_custkey % 3 <> 0)"
_PUBLIC = f"(select o_orderkey as task_id, o_orderdate, o_orderstatus, key from orders o left join {_KEYS} k on o_orderkey = task_id where key is null or not starts_with(key, 'sc:'))"


def _public(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey as task_id", "case when c_custkey % 5 = 0 then concat('sc:', c_custkey) else concat('user:', c_custkey) end as key")
    return ledger.public_tasks(table(spark, d, "orders").selectExpr("o_orderkey as task_id", "o_orderdate", "o_orderstatus"), keys)


@_query(f"select task_id, key, o_orderstatus from {_PUBLIC} p where o_orderstatus = 'O' order by o_orderdate desc, task_id limit 50 offset 20")
def q20_task_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _public(spark, d).where("o_orderstatus = 'O'").orderBy(F.col("o_orderdate").desc(), "task_id")
    return rows.offset(20).limit(50).select("task_id", "key", "o_orderstatus")


@_query("select cast(coalesce(sum(cast(substr(o_orderpriority, 1, 1) as bigint)) filter (where o_orderstatus = 'O'), 0) as bigint) as running_sum, coalesce(sum(cast(substr(o_orderpriority, 1, 1) as bigint)) filter (where o_orderstatus = 'O'), 0) <> 20 as drifted from orders")
def q21_running_priority(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("finished").alias("status"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"))
    return ledger.running_priority(tasks, 20)


@_query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderdate <= (select max(o_orderdate) from orders) - interval 168 hours""")
def q22_stale_antijoin(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    files = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("modified"))
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return ledger.stale_files(files, used, now.cast("timestamp_ntz")).select(F.col("path").alias("o_orderkey"))


@_query("""select cast(floor(greatest(epoch_us(s) - epoch_us(o_orderdate), 0) / 1e6 / 864000) as bigint) as bucket, count(*) as n from orders join (select l_orderkey, min(l_shipdate) as s from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def q23_queue_wait_histogram(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"))
    waits = table(spark, d, "orders").join(starts, "o_orderkey").select(ledger.waiting_seconds(F.col("o_orderdate"), F.col("s")).alias("w"))
    return waits.groupBy(F.floor(F.col("w") / 864000).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query("select event_id, user_id, event_type from events where event_id > 500 order by ts, event_id limit 200")
def q41_event_tail(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_id > 500")
    return e.orderBy("ts", "event_id").limit(200).select("event_id", "user_id", "event_type")


@_query("""select event_id, user_id, event_type, previous from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where previous is null or previous <> event_type""")
def q42_status_change(spark: SparkSession, d: str) -> DataFrame:
    return ledger.status_changes(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "event_type", "previous")


_QUEUE = "(select o_orderkey, o_custkey % 200 as grp, cast(substr(o_orderpriority, 1, 1) as bigint) as p, row_number() over (partition by o_custkey % 200 order by o_orderkey) as i from orders)"


@_query(f"""with recursive q as materialized (select * from {_QUEUE} x), f as (select grp, i, o_orderkey, p <= 20 as admitted, case when p <= 20 then p else 0 end as reserved from q where i = 1
union all select q.grp, q.i, q.o_orderkey, f.reserved + q.p <= 20, case when f.reserved + q.p <= 20 then f.reserved + q.p else f.reserved end from f join q on q.grp = f.grp and q.i = f.i + 1)
select grp, o_orderkey, admitted, cast(reserved as bigint) as reserved from f""")
def q43_capacity_admission(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 200 as grp", "cast(substr(o_orderpriority, 1, 1) as bigint) as p")
    return ledger.admissions(r, "grp", "o_orderkey", "p").select("grp", "o_orderkey", "admitted", "reserved")


_ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "error"), ("error", "view")]


@_query(f"""select event_id, source, target from (select event_id, event_type as target, lag(event_type) over (partition by user_id order by ts, event_id) as source from events) e
where source is not null and source <> target and (source, target) not in (values {', '.join(map(str, _ALLOWED))})""")
def q44_invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame(_ALLOWED, "source string, target string")
    return ledger.invalid_transitions(table(spark, d, "events"), F.broadcast(allowed), "user_id", "event_type", "ts", "event_id").select("event_id", "source", "target")


@_query("select k, event_id, user_id from (select get_k as k, event_id, user_id, row_number() over (partition by get_k order by ts, event_id) as r from (select *, cast(json_extract(props, '$.k') as bigint) as get_k from events)) where r = 1")
def q45_first_writer_idempotency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_id", "user_id", "ts")
    return ledger.first_writers(e, "k", "ts", "event_id").select("k", "event_id", "user_id")


@_query("""with b as (select 'u' || u as name, 'base' || u as value from (select distinct user_id % 60 as u from events)), o as (select 'u' || (user_id % 50) as name, arg_max(event_type, ts * 0 + event_id) as value, arg_max(event_id % 4 = 0, event_id) as deleted from (select *, 0 as z from events) e group by 1)
select name, coalesce(case when not deleted then o.value end, b.value) as value, coalesce(not deleted, false) as overridden from b left join o using (name)""".replace("ts * 0 + event_id", "event_id"))
def q46_override_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    base = e.selectExpr("user_id % 60 as u").distinct().selectExpr("concat('u', u) as name", "concat('base', u) as value")
    over = e.selectExpr("concat('u', user_id % 50) as name", "event_type as value", "event_id % 4 = 0 as deleted", "event_id")
    return ledger.effective_config(base, over, "event_id")


@_query("""select conv_id, string_agg(turn || ':' || role, ',' order by turn) as history from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations where role in ('user', 'assistant')) where r <= 10 group by 1""")
def q47_chat_last_n(spark: SparkSession, d: str) -> DataFrame:
    last = ledger.last_messages(table(spark, d, "conversations"), "conv_id", "turn")
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat_ws(":", s["turn"].cast("string"), s["role"]))
    return last.groupBy("conv_id").agg(F.array_join(items, ",").alias("history"))


@_query("""select doc_id, fit, case when length(text) > 240 then rtrim(substr(text, 1, 239)) || '…' else text end as reason from (select doc_id, text, case doc_id % 3 when 0 then 'wrong' when 1 then 'unclear' else 'correct' end as fit from documents) where fit <> 'correct' order by doc_id limit 60""")
def q48_problem_objects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id", "case doc_id % 3 when 0 then 'wrong' when 1 then 'unclear' else 'correct' end as fit", "text as reason")
    return reports.problem_rows(rows, [F.col("doc_id")])


@_query("select event_id, user_id, cast(json_extract(props, '$.k') as bigint) as k from events where lower(event_type) = 'error' and user_id = 8 order by event_id desc limit 100")
def q53_log_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where((F.lower("event_type") == "error") & (F.col("user_id") == 8))
    good = e.withColumn("k", F.from_json("props", "k bigint")["k"])
    return good.orderBy(F.col("event_id").desc()).limit(100).select("event_id", "user_id", "k")


@_query("""select event_id, event_type || case when cast(json_extract(props, '$.k') as bigint) > 0 then ', ' || cast(json_extract(props, '$.k') as bigint) || ' этажей' else '' end as use_text, cast(user_id as varchar) as zone_code from events""")
def q54_json_features(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.features import object_text

    body = F.concat(F.lit('{"properties":{"physical_object_type":{"name":"'), "event_type", F.lit('"},"zone":'), F.col("user_id").cast("string"), F.lit(',"properties":{"Количество этажей":'), F.get_json_object("props", "$.k"), F.lit("}}}"))
    e = table(spark, d, "events").select("event_id", outer_json(body).alias("feature"))
    return e.select("event_id", object_text(F.col("feature")).alias("use_text"), F.try_variant_get("feature", "$.properties.zone", "string").alias("zone_code"))


@_query(f"select count(*) as total from {_PUBLIC} p where o_orderstatus = 'O'")
def q67_page_total(spark: SparkSession, d: str) -> DataFrame:
    return _public(spark, d).where("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("total"))


@_query(f"""with v as (select coalesce(zone, '__no_zone__') as zone, count(*) as n, count(*) filter (where verdict = 'not_allowed') as w from {_VERDICTS} x group by 1)
select string_agg(zone || ': ' || w || ' of ' || n || ' wrong', chr(10) order by w desc, n desc, zone) as summary from v""")
def q81_summary_text(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_lines(reports.fit_report(_verdicts(spark, d)))


@_query("""with k as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by key order by o_orderkey) as r, first_value(o_orderkey) over (partition by key order by o_orderkey) as answered_by
from (select *, sha256(o_custkey || ':' || o_orderpriority) as key from orders)) select o_orderkey, answered_by, r > 1 as reused from k""")
def q89_cache_key_reuse(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority"), 256)
    rows = table(spark, d, "orders").select("o_orderkey", key.alias("key"))
    first = ledger.first_writers(rows, "key", "o_orderkey").withColumnRenamed("o_orderkey", "answered_by")
    return rows.join(first, "key").select("o_orderkey", "answered_by", (F.col("o_orderkey") != F.col("answered_by")).alias("reused"))


@_query("select user_id, min(event_id) as event_id from events where event_type = 'purchase' group by 1")
def q90_terminal_report(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "events").where("event_type = 'purchase'")
    return ledger.first_writers(done.select("user_id", "event_id"), "user_id", "event_id")


@_query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as previous from events) where previous is null or previous <> event_type""")
def q93_stream_status_change(spark: SparkSession, d: str) -> DataFrame:
    """q42 as a stream of files with state for each user, run until all input is read."""
    return streams.run_to_table(spark, streams.status_changes(streams.event_stream(spark, d)), "status_change")


@_query("""select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 2) as total from events group by all""")
def q94_stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_to_table(spark, streams.windowed_counts(streams.event_stream(spark, d)), "hourly", "complete")


_CAPACITY_EVENTS = """(select o_custkey % 40 as queue, o_orderdate as moment, 2 * o_orderkey as event_id, 1 + o_orderkey % 6 as amount, false as releases from orders
union all select o_custkey % 40, o_orderdate + cast(1 + o_orderkey % 5 as integer) * interval 1 day, 2 * o_orderkey + 1, 1 + o_orderkey % 6, true from orders)"""


@_query(f"""with recursive e as materialized (select *, row_number() over (partition by queue order by moment, event_id) as i from {_CAPACITY_EVENTS} x),
walk(queue, i, event_id, admitted, load) as (
select queue, i, event_id, case when not releases then amount <= 20 end, case when releases then 0 when amount <= 20 then amount else 0 end from e where i = 1
union all select e.queue, e.i, e.event_id, case when not releases then load + amount <= 20 end,
case when releases then greatest(load - amount, 0) when load + amount <= 20 then load + amount else load end from walk w join e on e.queue = w.queue and e.i = w.i + 1)
select event_id, queue, admitted, cast(load as bigint) as load from walk""")
def q100_admission_with_release(spark: SparkSession, d: str) -> DataFrame:
    """Each order reserves some of its queue's capacity of 20 and gives it back some days later."""
    o = table(spark, d, "orders")
    ask = o.selectExpr("o_custkey % 40 as queue", "o_orderdate as moment", "2 * o_orderkey as event_id", "1 + o_orderkey % 6 as amount", "false as releases")
    back = o.selectExpr("o_custkey % 40", "o_orderdate + make_interval(0, 0, 0, int(1 + o_orderkey % 5))", "2 * o_orderkey + 1", "1 + o_orderkey % 6", "true")
    return admission.admissions_with_release(ask.union(back), "queue", ["moment", "event_id"], "amount", "releases").select("event_id", "queue", "admitted", "load")


_LIVES_SQL = """(with e as materialized (select event_id, ts, user_id || ':' || (event_id % 3) as task, event_type as status from events where ts < (select max(ts) from events) - interval 1 day),
p as (select *, lag(status) over w as before, lag(ts) over w as seen from e window w as (partition by task order by ts, event_id)),
s as (select *, sum(case when seen is null or ts - seen > interval 2 days then 1 else 0 end) over (partition by task order by ts, event_id) as life from p),
d as (select *, min(case when status = 'purchase' then row(ts, event_id) end) over (partition by task, life) as done from s)
select task, event_id, status, status = 'purchase' as ended from d
where (before is null or before <> status or seen is null or ts - seen > interval 2 days) and (done is null or row(ts, event_id) <= done))"""


def _lives(spark: SparkSession, d: str) -> DataFrame:
    e = streams.event_stream(spark, d).selectExpr("ts", "event_id", "concat(user_id, ':', event_id % 3) as task", "event_type as status")
    return lifecycle.lives(e, "task", "status", ("purchase",))


@_query(f"select task, event_id, status, ended from {_LIVES_SQL} l")
def q101_stream_lives(spark: SparkSession, d: str) -> DataFrame:
    """Changes of status up to each task's purchase, from the stream, in order of time; what lies within a day of the end still waits."""
    return streams.run_to_table(spark, _lives(spark, d), "lives")


@_query(f"select task, status, cast(n as bigint) as n from (select task, status from {_LIVES_SQL} l where ended) l left join (select user_id || ':' || (event_id % 3) as task, count(*) as n from events group by 1) using (task)")
def q102_stream_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report, once, for each end that the stream tells."""
    import uuid

    from ..session import shared_folder

    counts = table(spark, d, "events").groupBy(F.expr("concat(user_id, ':', event_id % 3)").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return lifecycle.reports(spark, _lives(spark, d), counts, "task", f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}")


@_query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type from events) group by all")
def q103_stream_first_writers(spark: SparkSession, d: str) -> DataFrame:
    """One event of each kind for a user, from the stream: the first that comes is kept, later ones are answered by it."""
    keyed = streams.event_stream(spark, d).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    kept = streams.run_to_table(spark, streams.first_writers(keyed, "key", "60 days").select("user_id", "event_type"), "first-writers")
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
