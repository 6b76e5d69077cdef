"""Queries of vector recall and of the ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leading_codes
from ..operators import lookup, matching, ranking
from .views import table

QUERIES, ORACLES = {}, {}
#: Every so-manieth vector is a query, against all vectors.
EACH = 10


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("concat(label, '.', vec_id) as code", "vec_id", "label", "embedding as vector")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") % EACH == 0).selectExpr("vec_id as query", "embedding as qvector")


_DOT = "list_inner_product(q.embedding::double[], e.embedding::double[])"
_SCORES = f"(select q.vec_id as query, e.label || '.' || e.vec_id as code, e.vec_id, e.label, {_DOT} as score from embeddings q, embeddings e where q.vec_id % {EACH} = 0)"


def _top_sql(n: int) -> str:
    return f"(select * from (select *, row_number() over (partition by query order by score desc, code) as rank from {_SCORES} s) where rank <= {n})"


@_query(f"select query, code, rank, round(score, 6) as score from {_top_sql(5)} t")
def q35_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.recall(_queries(spark, d), _entries(spark, d), 5)
    return top.select("query", "code", "rank", F.round("score", 6).alias("score"))


@_query(f"""with s as (select q.vec_id as key, e.vec_id as pos, {_DOT} as score from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id),
r as (select *, coalesce(lead(score) over w, -1.0) as second, row_number() over w as r from s window w as (partition by key order by score desc, pos))
select key, pos, round(score, 6) as score, round(score - second, 6) as margin, score >= 0.4 and score - second >= 0.035 as direct from r where r = 1""")
def q36_vector_in_zone_margin(spark: SparkSession, d: str) -> DataFrame:
    """Every vector asks all others of its label."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vector"))
    best = matching.with_margin(ranking.best_others(v, 2, "label"))
    return best.select("key", "pos", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), ((F.col("score") >= 0.4) & (F.col("margin") >= 0.035)).alias("direct"))


_RERANKED = f"""(select t.query, t.code, t.score, t.vec_id, p_name, t.vec_id % 101 as profile_rank, score + 0.9 * (case when contains(p_name, 'plate') then 1.0 else 0 end) + 0.55 * (case when contains(p_name, 'blue') then 1.0 else 0 end)
 + 0.45 * least(t.vec_id % 101, 100) / 100.0 + (case when p_name = 'blue plate' then 0.5 when contains('blue plate', p_name) or contains(p_name, 'blue plate') then 0.22 else 0.0 end) + 0.03 * least(length(t.code) - length(replace(t.code, '.', '')), 3) as rerank
 from {_top_sql(20)} t left join part on p_partkey = t.vec_id)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.recall(_queries(spark, d), _entries(spark, d), 20).withColumn("vec_id", F.substring_index("code", ".", -1).cast("bigint"))
    rows = top.join(table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), "p_name"), "vec_id", "left")
    rank = (F.col("vec_id") % 101).alias("profile_rank")
    name = F.coalesce("p_name", F.lit(""))
    score = ranking.rerank_score(
        F.col("score"), F.contains(name, F.lit("plate")).cast("double"), F.contains(name, F.lit("blue")).cast("double"), F.col("vec_id") % 101, ranking.near_equal(F.lit("blue plate"), name), F.col("code")
    )
    return rows.select("query", "code", "score", "vec_id", "p_name", rank, score.alias("rerank"))


_PLACED = f"(select *, row_number() over (partition by query order by rerank desc, score desc, profile_rank desc, code desc) as place from {_RERANKED.replace('case when contains(p_name', 'case when contains(coalesce(p_name, %s)').replace('%s', chr(39) * 2)} r)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(_reranked(spark, d), "query", F.col("rerank").desc(), F.col("score").desc(), F.col("profile_rank").desc(), F.col("code").desc())


@_query(f"select query, code, place, round(rerank, 6) as rerank from {_PLACED} p where place <= 5")
def q37_deterministic_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).where("place <= 5").select("query", "code", "place", F.round("rerank", 6).alias("rerank"))


@_query(f"""with t as (select query, max(case when place = 1 then rerank end) as a, max(case when place = 2 then rerank end) as b, max(case when place = 1 then profile_rank end) as k from {_PLACED} p group by 1)
select query, round(a - coalesce(b, 0), 6) as gap, not (a - coalesce(b, 0) >= 0.16 and k >= 60 and query % 3 <> 0 and query % 7 > 4) as ask from t""")
def q38_rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    top = _placed(spark, d).select("query", "place", F.col("rerank").alias("score"), "profile_rank", F.when(F.col("query") % 3 == 0, "weak").otherwise("strong").alias("confidence"), (F.col("query") % 7).alias("n_words"))
    return ranking.needs_model(top, least_rank=60).select("query", F.round("gap", 6).alias("gap"), "ask")


@_query(f"""with t as (select query, case when vec_id % 4 = 0 then '2.0' else code end as code, rank from {_top_sql(5)} x), u as (select query, code, min(rank) as place from t group by 1, 2),
a as (select * from u union all select query, '2.0', 0 from u group by query having count(*) filter (where code = '2.0') = 0)
select query, code, row_number() over (partition by query order by code <> '2.0', place) as place from a""")
def q39_promote_generic(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.recall(_queries(spark, d), _entries(spark, d), 5)
    code = F.when(F.substring_index("code", ".", -1).cast("bigint") % 4 == 0, "2.0").otherwise(F.col("code"))
    rows = top.select("query", code.alias("code"), "rank").groupBy("query", "code").agg(F.min("rank").alias("place")).withColumn("name", F.col("code"))
    return ranking.promoted(rows, "query", "2.0", "2.0").select("query", "code", "place")


@_query(f"""select query, string_agg(case when p_name is null then code else code || ' ' || p_name end, ', ' order by place) as candidates, string_agg(code, '/' order by place) as codes from {_PLACED} p where place <= 5 group by 1""")
def q40_candidate_serialize(spark: SparkSession, d: str) -> DataFrame:
    texts = ranking.serialized(_placed(spark, d).where("place <= 5"), "query", "code", "p_name")
    return texts.withColumn("codes", F.array_join(leading_codes("candidates"), "/"))


@_query(f"""with t as (select * from {_top_sql(8)} x), c as (select query, code, rank as place, case when vec_id % 3 = 0 then vec_id % 5 end as choice from t)
select query, code, place from (select query, code, row_number() over (partition by query order by choice is null, choice, place) as place from c) where place <= 5""")
def q64_external_order_merge(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.recall(_queries(spark, d), _entries(spark, d), 8).select("query", "code", F.col("rank").alias("place"))
    number = F.substring_index("code", ".", -1).cast("bigint")
    chosen = top.where(number % 3 == 0).select("query", "code", (number % 5).alias("choice"))
    out = ranking.ranked(top.join(chosen, ["query", "code"], "left"), "query", F.col("choice").isNull(), F.col("choice"), F.col("place"))
    return out.where("place <= 5").select("query", "code", "place")


@_query(f"""with t as (select *, label in (select n_nationkey from nation where n_nationkey % 2 = 0) as present, vec_id % 101 as prank from {_top_sql(20)} x where score >= 0.2)
select query, code, place from (select query, code, row_number() over (partition by query order by round(score, 1) desc, present desc, prank desc, code desc) as place from t) where place <= 5""")
def q65_vector_shortlist(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.recall(_queries(spark, d), _entries(spark, d), 20).where("score >= 0.2")
    parts = F.split("code", r"\.")
    present = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("label"), F.lit(True).alias("present"))
    rows = top.withColumn("label", parts[0]).join(F.broadcast(present), "label", "left").withColumn("prank", parts[1].cast("bigint") % 101)
    out = ranking.ranked(rows, "query", F.round("score", 1).desc(), F.coalesce("present", F.lit(False)).desc(), F.col("prank").desc(), F.col("code").desc())
    return out.where("place <= 5").select("query", "code", "place")
