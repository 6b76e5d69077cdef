"""Queries of text normalisation, matching and catalogues."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import BRIDGE_BLOCKS, INTENTS, PROFILE_PATTERNS, PROFILE_RULES
from ..operators import catalog, classifier, compiled, decisions, lookup, matching, ports, ranking, rulebook
from ..operators.tfidf import top_weights
from ..session import shared_folder
from .views import table

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def plain_sql(x: str) -> str:
    """SQL of a plain text."""
    n = f"regexp_replace(coalesce({x}, ''), '^[ \\t\\n\\r\\x0B\\f]+|[ \\t\\n\\r\\x0B\\f]+$', '', 'g')"
    t = f"replace(lower(case when lower({n}) in ('', 'nan', 'none', 'null') then '' else {n} end), 'ё', 'е')"
    for p in ("[\"''`«»]", "[()\\[\\]{}:;,.!?]", "[\\\\/]", "[-_]+"):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '[ \\t\\n\\r\\x0B\\f\\x{{85}}\\x{{A0}}]+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '[0-9a-zа-яё]+')"


_PART = f"(select p_partkey, p_name, p_size, array_to_string({words_sql(plain_sql('p_name'))}, ' ') as canon from part)"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return T.canonical(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type", "p_brand"), "p_name", "canon")


@_query(f"select doc_id, {plain_sql('text')} as plain from documents")
def q25_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.plain("text").alias("plain"))


@_query(f"""select 'd' || doc_id as id, len(w) as n_tokens, array_to_string(w[1:20], ' ') as head from (select doc_id, {words_sql(plain_sql('text'))} as w from documents) x
union all select 'p' || p_partkey, len(w), array_to_string(w[1:20], ' ') from (select p_partkey, {words_sql(plain_sql('p_name'))} as w from part) x""")
def q26_tokenize_canonical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), T.tokens(T.plain("text")).alias("w"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey"), T.tokens(T.plain("p_name")))
    return docs.union(parts).select("id", F.size("w").cast("bigint").alias("n_tokens"), F.array_join(F.slice("w", 1, 20), " ").alias("head"))


_TWO = """(select p_partkey, p_name, p_name || ' ' || p_type || ' ' || p_brand as b, lag(p_name) over (order by p_partkey) as a0 from part)"""


@_query(f"""with t as (select p_partkey, list_distinct({words_sql("lower(p_name || ' ' || p_type)")}) as a, list_distinct({words_sql("lower(p_type || ' ' || p_brand || ' ' || p_name)")}) as b from part)
select p_partkey, cast(len(list_intersect(a, b)) as double) as overlap, round(len(list_intersect(a, b)) / len(a), 6) as coverage, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) as jaccard from t""")
def q27_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = T.tokens(F.lower(F.concat_ws(" ", "p_name", "p_type")))
    b = T.tokens(F.lower(F.concat_ws(" ", "p_type", "p_brand", "p_name")))
    rows = table(spark, d, "part").select("p_partkey", T.overlap(a, b).alias("o"))
    return rows.select("p_partkey", F.col("o.overlap").alias("overlap"), F.round("o.coverage", 6).alias("coverage"), F.round("o.jaccard", 6).alias("jaccard"))


def exactish_sql(a: str, b: str) -> str:
    ta, tb = (f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))" for x in (a, b))
    return f"""({a} <> '' and {b} <> '' and ({a} = {b} or ((starts_with({a}, {b}) or starts_with({b}, {a})) and least(length({a}), length({b})) >= 10
 and least(length({a}), length({b})) / greatest(length({a}), length({b}), 1) >= 0.7)
 or (len(list_intersect({ta}, {tb})) >= 2 and len(list_intersect({ta}, {tb})) / len(list_distinct({ta} || {tb})) >= 0.55)))"""


_NAMES = f"(select distinct p.canon || ' lot ' || lower(p_type) as canon from {_PART} p join part using (p_partkey))"


@_query(f"select a.canon as one, b.canon as two from {_NAMES} a, {_NAMES} b where a.canon < b.canon and string_split(a.canon, ' ')[1] = string_split(b.canon, ' ')[1] and {exactish_sql('a.canon', 'b.canon')}")
def q28_exactish_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names with the same first word that are almost exact matches."""
    names = _part(spark, d).select(F.concat_ws(" lot ", "canon", F.lower("p_type")).alias("canon")).distinct().withColumn("first", T.split_words("canon")[0])
    pairs = names.withColumnRenamed("canon", "one").join(names.withColumnRenamed("canon", "two"), "first")
    return pairs.where((F.col("one") < F.col("two")) & T.exactish("one", "two")).select("one", "two")


@_query(f"select a.canon as one, b.canon as two from {_NAMES} a, {_NAMES} b where a.canon < b.canon and {exactish_sql('a.canon', 'b.canon')}")
def q97_exactish_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of names that are almost exact matches, whatever their first words."""
    return matching.exactish_pairs(_part(spark, d).select(F.concat_ws(" lot ", "canon", F.lower("p_type")).alias("canon")))


@_query()
def q29_sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d).withColumn("other", F.lower(F.concat_ws(" ", "p_type", "p_name")))
    scored = T.with_ratio(p, "canon", "other", "ratio")
    score = T.match_score(F.col("ratio"), T.overlap(T.split_words("canon"), T.split_words("other")))
    return scored.select("p_partkey", F.round("ratio", 6).alias("ratio"), F.round(score, 6).alias("score"))


@_query()
def q30_stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(T.plain("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("stem", T._stems("word"))


# The profile rules, applied to English words for these tables.
_RULES = [("metal", "strong", "plate|rod|gear"), ("finish", "medium", "red|blue|hot"), ("size", "weak", "small|medium|large|economy"), ("metal", "weak", "ring|bolt"), ("promo", "medium", "promo")]


def _scores_sql(c: str) -> str:
    def hit(p: str, w: int) -> str:
        return f"case when regexp_matches({c}, '{p}') then {w} else 0 end"

    w = rulebook.WEIGHTS
    order: dict[str, list[str]] = {}
    for f, weight, p in _RULES:
        order.setdefault(f, []).append(hit(p, w[weight]))
    return " union all ".join(f"select '{f}' as family, {i} as place, {' + '.join(h)} as score" for i, (f, h) in enumerate(order.items()))


@_query(f"""select p_partkey, coalesce(arg_min(family, -score * 100 + place), 'unknown') as family,
case when max(score) is null then 'weak' when max(score) >= 100 then 'strong' when max(score) >= 60 then 'medium' else 'weak' end as confidence
from (select p_partkey, lower(p_type || ' ' || p_name) as c from part) p left join lateral ({_scores_sql('p.c')}) s on score > 0 group by 1""")
def q31_profile_rules(spark: SparkSession, d: str) -> DataFrame:
    p = rulebook.profile(F.lower(F.concat_ws(" ", "p_type", "p_name")), _RULES)
    return table(spark, d, "part").select("p_partkey", p["family"].alias("family"), p["confidence"].alias("confidence"))


_HINTS = [("standard|medium", None, ["usual size", "mill"]), ("small", "economy", ["compact"]), ("promo", None, ["offer", "sale"]), ("s", "t", ["no t"])]


@_query(f"""select p_partkey, array_to_string(list_concat({', '.join(f"case when regexp_matches(c, '{p}')" + (f" and not regexp_matches(c, '{g}')" if g else '') + f" then {h!r} else []::varchar[] end" for p, g, h in _HINTS[:2])},
{', '.join(f"case when regexp_matches(c, '{p}')" + (f" and not regexp_matches(c, '{g}')" if g else '') + f" then {h!r} else []::varchar[] end" for p, g, h in _HINTS[2:])}), ' | ') as hints from (select p_partkey, lower(p_type) as c from part) p""")
def q32_hint_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(rulebook.hints(F.lower("p_type"), _HINTS), " | ").alias("hints"))


_CODE = r"(?:^|[^0-9:.])([0-9]{1,2}(?:[.][0-9]{1,2}){1,3})(?:$|[^0-9:.])"


@_query(f"""with e as (select event_id, 'код ' || (event_id % 5) || '.' || (event_id % 30) || case when event_id % 2 = 0 then '.1' else '' end || ' или ' || (event_id % 5) || '.' || (event_id % 25) || ' ;' as t from events),
x as (select event_id, t, generate_subscripts(c, 1) as i, unnest(c) as code from (select event_id, t, regexp_extract_all(t, '{_CODE}', 1) as c from e) y),
k as (select n_regionkey || '.' || n_nationkey as code from nation)
select event_id, arg_max(code, (length(code) - length(replace(code, '.', ''))) * 1000 - i) as code from x join k using (code) group by 1""")
def q33_explicit_code_extract(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.lit("код "), (F.col("event_id") % 5), F.lit("."), (F.col("event_id") % 30), F.when(F.col("event_id") % 2 == 0, ".1").otherwise(""), F.lit(" или "), (F.col("event_id") % 5), F.lit("."), (F.col("event_id") % 25), F.lit(" ;")]
    e = table(spark, d, "events").select("event_id", F.concat(*[p.cast("string") for p in parts]).alias("t"))
    found = e.select("event_id", F.posexplode(F.regexp_extract_all("t", F.lit(_CODE), F.lit(1))).alias("i", "code"))
    known = table(spark, d, "nation").selectExpr("concat(n_regionkey, '.', n_nationkey) as code")
    dots = F.length("code") - F.length(F.regexp_replace("code", r"\.", ""))
    return found.join(F.broadcast(known), "code").groupBy("event_id").agg(F.max_by("code", F.struct(dots, -F.col("i"))).alias("code"))


@_query("""with e as (select event_id, case event_id % 8 when 0 then 'Allowed' when 1 then 'allowed_extra' when 2 then 'not_allowed' when 3 then 'ALLOWED_MAIN' when 4 then null when 5 then 'maybe' when 6 then 'allowed' else 'unclear' end as v,
case event_id % 3 when 0 then 'main' when 1 then '' else 'auxiliary' end as s, case event_id % 5 when 0 then 'условно' when 1 then 'auxiliary use' else 'plain' end as r from events),
c as (select event_id, lower(trim(coalesce(v, ''))) as v, s, r from e),
o as (select event_id, case when v in ('allowed_main','allowed_conditional','allowed_auxiliary','not_allowed','unclear','no_actual_zone','no_zone_metadata') then v
when v = 'allowed' or starts_with(v, 'allowed_') then case when s <> '' then 'allowed_' || s when contains(r, 'услов') then 'allowed_conditional' when contains(r, 'auxiliary') then 'allowed_auxiliary' else 'allowed_main' end else 'unclear' end as verdict from c)
select event_id, verdict, case verdict when 'allowed_main' then 'Разрешен' when 'allowed_conditional' then 'Условно разрешен' when 'allowed_auxiliary' then 'Разрешен как вспомогательный' when 'not_allowed' then 'Не разрешен' else 'Требуется ручная проверка' end as status from o""")
def q34_verdict_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr(
        "event_id",
        "case event_id % 8 when 0 then 'Allowed' when 1 then 'allowed_extra' when 2 then 'not_allowed' when 3 then 'ALLOWED_MAIN' when 4 then null when 5 then 'maybe' when 6 then 'allowed' else 'unclear' end as v",
        "case event_id % 3 when 0 then 'main' when 1 then '' else 'auxiliary' end as s", "case event_id % 5 when 0 then 'условно' when 1 then 'auxiliary use' else 'plain' end as r",
    )
    out = e.select("event_id", T.verdict("v", "s", "r", F.lit("")).alias("verdict"))
    return out.withColumn("status", T.label("verdict"))


@_query("""with t as materialized (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as w from documents where doc_id % 1 = 0),
tf as materialized (select doc_id, w, count(*) as tf from t group by 1, 2), n as (select count(distinct doc_id) as n from tf),
df as materialized (select w, count(*) as df from tf group by 1), x as (select doc_id, w, tf * (ln((1 + n) / (1.0 + df)) + 1) as v from tf join df using (w), n),
l as (select doc_id, sqrt(sum(v * v)) as len from x group by 1)
select doc_id, count(*) as n_terms, round(max(v / len), 6) as top_weight from x join l using (doc_id) group by 1""")
def q51_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Superseded by q115_tfidf_every: here documents without words don't count in n."""
    top = top_weights(table(spark, d, "documents"), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))
    return top.withColumn("top_weight", F.round("top_weight", 6))


_BROKEN = """(select 'N' || (p_partkey % 25) as zone_code, p_partkey, case p_partkey % 4 when 0 then 'a description that stands in the code field ' || p_partkey when 1 then '' else (p_size % 9) || '.' || (p_partkey % 4) end as vri_code,
 p_name as vri_name, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then '' else 'about ' || p_type end as vri_description from part)"""
_REFERENCE = """(select name_key, arg_min(code, -n * 1000000000 + f) as ref_code, 'usual ' || name_key as ref_description from (select lower(p_name) as name_key, (p_size % 9) || '.' || (p_partkey % 4) as code, count(*) as n, min(p_partkey) as f from part where p_partkey % 4 > 1 group by 1, 2) group by 1)"""
_CLASSIFIER = "(select '3.' || k as code, 'Class ' || k as name, case when k < 2 then 'class text ' || k else '' end as description from (values (0), (1), (2), (3)) v(k))"
_SANE = f"""(with j as (select b.*, c.name as c_name, c.description as c_desc, ref_code, ref_description,
 vri_code <> '' and not regexp_full_match(vri_code, '[0-9]+([.][0-9]+)*') and length(vri_code) >= 32 and (vri_description = '' or vri_description = vri_name or vri_description = vri_code) as moved
 from {_BROKEN} b left join {_CLASSIFIER} c on b.vri_code = c.code left join {_REFERENCE} r on r.name_key = lower(b.vri_name)),
k as (select *, case when moved then vri_code else vri_description end as d1, c_name is not null and lower(vri_name) <> lower(c_name) as renamed, c_name is not null as aligned,
 not regexp_full_match(vri_code, '[0-9]+([.][0-9]+)*') and coalesce(ref_code, '') <> '' as coded from j),
m as (select *, case when renamed then c_name else vri_name end as n1, c_name is not null and coalesce(c_desc, '') <> '' and d1 <> c_desc as described1 from k),
o as (select *, case when described1 then c_desc else d1 end as d2 from m)
select zone_code, p_partkey, case when coded then ref_code else vri_code end as vri_code, n1 as vri_name, case when n1 <> '' and (d2 = '' or d2 = n1) and coalesce(ref_description, '') <> '' then ref_description else d2 end as vri_description,
 moved, aligned, renamed, described1 or (n1 <> '' and (d2 = '' or d2 = n1) and coalesce(ref_description, '') <> '') as described, coded from o)"""


def _sane(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    broken = part.selectExpr(
        "concat('N', p_partkey % 25) as zone_code", "p_partkey", "lower(p_name) as name_key",
        "case p_partkey % 4 when 0 then concat('a description that stands in the code field ', p_partkey) when 1 then '' else concat(p_size % 9, '.', p_partkey % 4) end as vri_code",
        "p_name as vri_name", "case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then '' else concat('about ', p_type) end as vri_description",
    )
    usual = catalog.modal(part.where("p_partkey % 4 > 1").selectExpr("lower(p_name) as name_key", "concat(p_size % 9, '.', p_partkey % 4) as code", "p_partkey"), "name_key", "code", "p_partkey")
    reference = usual.select("name_key", F.col("code").alias("ref_code"), F.concat(F.lit("usual "), "name_key").alias("ref_description"))
    classifier = spark.range(4).selectExpr("concat('3.', id) as code", "concat('Class ', id) as name", "case when id < 2 then concat('class text ', id) else '' end as description")
    return catalog.sanitized(broken, classifier, reference)


@_query(f"select zone_code, p_partkey, vri_code, vri_name, vri_description, moved, aligned, renamed, described, coded, moved or renamed or described or coded as repaired from {_SANE} s")
def q52_catalog_sanitize(spark: SparkSession, d: str) -> DataFrame:
    names = ["zone_code", "p_partkey", "vri_code", "vri_name", "vri_description", "moved", "aligned", "renamed", "described", "coded", "repaired"]
    return _sane(spark, d).select(*names)


@_query(f"""select count(distinct zone_code) as zones_total, count(*) as items_total, count(*) filter (where moved or renamed or described or coded) as items_repaired, count(*) filter (where coded) as code_filled, count(*) filter (where renamed) as name_aligned,
count(*) filter (where described) as description_filled, count(*) filter (where moved) as description_moved, count(*) filter (where aligned) as alignments from {_SANE} s""")
def q92_sanitation_stats(spark: SparkSession, d: str) -> DataFrame:
    counts = {"items_repaired": "repaired", "code_filled": "coded", "name_aligned": "renamed", "description_filled": "described", "description_moved": "moved", "alignments": "aligned"}
    return _sane(spark, d).agg(
        F.count_distinct("zone_code").alias("zones_total"), F.count(F.lit(1)).alias("items_total"), *[F.count_if(c).alias(n) for n, c in counts.items()]
    )


# Zone items: each name once per zone. Queries: every part's name in the zone of its key.
_ZITEMS = f"""(select zone, canon as name_canon, min(p_partkey) as pos, arg_min(p_name, p_partkey) as name, arg_min(section, p_partkey) as section, arg_min(code, p_partkey) as code
 from (select 'N' || (p_partkey % 25) as zone, canon, p_partkey, p_name, case p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section, case when p_size % 10 = 0 then '2.0' else p_size || '.' || (p_partkey % 3) end as code from {_PART} p where p_partkey % 3 <> 0) x group by 1, 2)"""
_ASK = f"(select p_partkey as key, 'N' || (p_partkey % 27) as zone, canon, canon as short from {_PART} p where p_partkey % 3 = 0)"


def _zone_items(spark: SparkSession, d: str, which: str = "p_partkey % 3 <> 0") -> DataFrame:
    p = _part(spark, d).where(which).selectExpr(
        "concat('N', p_partkey % 25) as zone", "canon", "p_partkey", "p_name", "case p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section",
        "case when p_size % 10 = 0 then '2.0' else concat(p_size, '.', p_partkey % 3) end as code",
    )
    first = F.min_by(F.struct("p_name", "section", "code"), "p_partkey").alias("f")
    g = p.groupBy("zone", F.col("canon").alias("name_canon")).agg(F.min("p_partkey").alias("pos"), first)
    return g.select("zone", "name_canon", "pos", F.col("f.p_name").alias("name"), F.col("f.section").alias("section"), F.col("f.code").alias("code"), F.lit("").alias("desc_short"))


def _ask(spark: SparkSession, d: str, which: str = "p_partkey % 3 = 0") -> DataFrame:
    return _part(spark, d).where(which).selectExpr("p_partkey as key", "concat('N', p_partkey % 27) as zone", "canon", "canon as short")


_PRIO = "case section when 'main' then 3 when 'conditional' then 2 else 1 end"
_EXACT = f"""(select key, name, code, section from (select key, name, code, section, row_number() over (partition by key order by {_PRIO} desc, name desc, code desc) as r
 from {_ASK} a join {_ZITEMS} i using (zone) where {exactish_sql('canon', 'name_canon')}) where r = 1)"""


@_query(f"select key, name, code, section from {_EXACT} e")
def q59_zone_exact_match(spark: SparkSession, d: str) -> DataFrame:
    """Over two thirds of the parts as items and a third that asks; superseded by q111_exact_match_whole."""
    return matching.exact_matches(_ask(spark, d), _zone_items(spark, d))


_SCORED = f"""(with t as (select a.key, i.pos, i.section, i.code, list_distinct(string_split(canon, ' ')) as q, list_distinct(string_split(name_canon, ' ')) as n from {_ASK} a join {_ZITEMS} i using (zone)),
 m as (select *, len(list_intersect(q, n)) as ov, len(list_intersect(q, n)) / len(q) as cov, len(list_intersect(q, n)) / len(list_distinct(q || n)) as jac from t)
 select *, greatest(least(1.0, cov * 0.97), least(1.0, jac * 1.08)) as score from m)"""
_MARGIN = f"""(select key, pos, section, code, ov, cov, score, coalesce(lead(score) over w, -1.0) as second, row_number() over w as r from {_SCORED} s window w as (partition by key order by score desc, pos))"""


@_query(f"select key, pos, round(score, 6) as score, round(second, 6) as second, score >= 0.93 and cov >= 0.6 and ov >= 2 and score - second >= 0.035 as strong from {_MARGIN} m where r = 1")
def q60_string_margin(spark: SparkSession, d: str) -> DataFrame:
    """Over two thirds of the parts as items and a third that asks; superseded by q112_string_margin_whole."""
    best = matching.best_items(_ask(spark, d), _zone_items(spark, d), ratio=False)
    return best.select("key", "pos", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), matching.strong_string(best).alias("strong"))


_PATTERNS = {"guard": "old", "indicator": "plate|bolt", "qualifier": "red|small"}
_GENERIC_ASK = "(select p_partkey as key, 'N' || (p_partkey % 27) as zone, lower(p_name) as canon from part)"


def _generic_sql(ask: str) -> str:
    return f"""(select key, arg_max(section, case section when 'main' then 3 when 'conditional' then 2 else 1 end) as section from (select * from {ask} q where regexp_matches(canon, 'plate|bolt')
 and not regexp_matches(canon, 'old') and not regexp_matches(canon, 'red|small')) g left join (select * from {_ZITEMS} z where code = '2.0') i using (zone) group by 1)"""


@_query(f"""select key, case when section is null then 'unclear' else 'allowed_' || section end as verdict,
case when section is null then 'residential_unspecified_generic_manual' else 'residential_unspecified_generic_in_zone' end as method from {_generic_sql(_GENERIC_ASK)} g""")
def q61_generic_subtype_rule(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").selectExpr("p_partkey as key", "concat('N', p_partkey % 27) as zone", "lower(p_name) as canon")
    return matching.generic_use(asked, _zone_items(spark, d), **_PATTERNS).select("key", "verdict", "method")


@_query("""select p_partkey as key, case when p_partkey % 9 = 0 then 'no_actual_zone' when n_nationkey is null then 'no_zone_metadata' else 'has_zone' end as status
from part left join nation on n_nationkey = p_partkey % 27 and p_partkey % 9 <> 0""")
def q62_zone_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey as key", "case when p_partkey % 9 = 0 then '' else cast(p_partkey % 27 as string) end as zone")
    zones = table(spark, d, "nation").selectExpr("cast(n_nationkey as string) as zone_code", "cast(null as string) as base_code")
    out = lookup.resolve_zones(rows, zones, "zone")
    status = F.when(F.col("outcome") == "missing", "no_actual_zone").when(F.col("outcome") == "not_found", "no_zone_metadata").otherwise("has_zone")
    return out.select("key", status.alias("status"))


@_query("""with hits as (select b.item_id, p_partkey, row_number() over (partition by b.item_id order by p_partkey) as r from (select item_id, lower(split_part(text, ' ', 1)) as w from benchmark
union all select 1000 + item_id, 'part' from benchmark) b join part on lower(p_name) = w or lower(split_part(p_name, ' ', 1)) = w)
select item_id, p_partkey, r as place, 'exact' as source from hits where r <= 5 union all select item_id, item_id % 10, 6, 'recall' from benchmark""")
def q63_exact_classifier_hits(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.lower(F.split("text", " ")[0]).alias("w"))
    asked = b.union(b.select(F.col("item_id") + 1000, F.lit("part")))
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.split("p_name", " ")[0]).alias("plain"))
    keys = part.select("p_partkey", F.explode(F.array_distinct(F.array("name", "plain"))).alias("w"))
    hits = ranking.ranked(asked.join(keys, "w"), "item_id", F.col("p_partkey")).where("place <= 5").select("item_id", "p_partkey", "place", F.lit("exact").alias("source"))
    return hits.unionByName(b.select("item_id", (F.col("item_id") % 10).alias("p_partkey"), F.lit(6).alias("place"), F.lit("recall").alias("source")))


@_query(f"select canon, count(*) as n, string_agg(p_partkey, ',' order by p_partkey) as rows from {_PART} p where p_size % 2 = 0 group by 1")
def q66_unique_query_groups(spark: SparkSession, d: str) -> DataFrame:
    wrong = _part(spark, d).where("p_size % 2 = 0")
    return wrong.groupBy("canon").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("rows"))


@_query("select r_name, substr(sha256(string_agg(n_name, '|' order by n_nationkey)), 1, 8) as version from nation join region on n_regionkey = r_regionkey group by 1")
def q68_content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), "|")
    return rows.groupBy("r_name").agg(F.substring(F.sha2(ordered, 256), 1, 8).alias("version"))


@_query(f"""select p_partkey, canon || ' || ' || 'Z' || (p_partkey % 9) as actual_key, canon || ' || ' || 'Z' || (p_partkey % 9) || ' || ' || 'Z' || (p_partkey % 9) || ' | Z' || (p_size % 4) as comparison_key from {_PART} p""")
def q71_canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d).withColumn("zone", F.expr("concat('Z', p_partkey % 9)")).withColumn("met", F.expr("concat('Z', p_partkey % 9, ' | Z', p_size % 4)"))
    return p.select("p_partkey", T.comparison_key("canon", "zone").alias("actual_key"), T.comparison_key("canon", "zone", "met").alias("comparison_key"))


@_query(f"""with w as (select doc_id, {words_sql(plain_sql('text'))} as w from documents), k as (select doc_id, w, list_filter(w, lambda x: x not in ('the', 'of', 'and', 'to', 'de', 'que', 'und')) as kept from w)
select doc_id, array_to_string((case when len(kept) > 0 then kept else w end)[1:24], ' ') as short from k""")
def q72_short_description(spark: SparkSession, d: str) -> DataFrame:
    stops = ["the", "of", "and", "to", "de", "que", "und"]
    return table(spark, d, "documents").select("doc_id", T.short_description(T.tokens(T.plain("text")), 24, stops).alias("short"))


@_query("select doc_id, case when length(text) > 80 then rtrim(substr(text, 1, 79)) || '…' else text end as cut from documents")
def q73_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated("text", 80).alias("cut"))


@_query("""select p_partkey, array_to_string(list_filter([trim(x) for x in regexp_split_to_array(t, '\\s*\\|\\s*|;\\s*|,\\s*')], lambda y: lower(y) not in ('', 'nan', 'none', 'null')), '/') as codes
from (select p_partkey, p_size || '.1 | ' || p_brand || '; nan,  ' || p_type || ' ,, ' || p_partkey as t from part) p""")
def q74_split_codes(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.col("p_size").cast("string"), F.lit(".1 | "), "p_brand", F.lit("; nan,  "), "p_type", F.lit(" ,, "), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.code_list(t), "/").alias("codes"))


@_query("""select doc_id, regexp_matches(lower(text), 'license|licensed|password|token') and (regexp_matches(lower(source), '1') or length(trim(text)) >= 800 or contains(text, '"')) as hard from documents""")
def q75_hard_case_flag(spark: SparkSession, d: str) -> DataFrame:
    hard = F.lower("text").rlike("license|licensed|password|token") & (F.lower("source").rlike("1") | (F.length(F.trim("text")) >= 800) | F.contains("text", F.lit('"')))
    return table(spark, d, "documents").select("doc_id", hard.alias("hard"))


_RANKS = {"metal": [("standard", 100), ("promo|large", 60)], "finish": [("medium|small", 90)], "size": [("small", 40)]}


@_query("""with p as (select p_partkey, lower(p_type) as c, case when p_partkey % 3 = 0 then 'metal' when p_partkey % 3 = 1 then 'finish' else 'other' end as family from part),
r as (select p_partkey, family, case family when 'metal' then greatest(case when regexp_matches(c, 'standard') then 100 else 0 end, case when regexp_matches(c, 'promo|large') then 60 else 0 end)
when 'finish' then case when regexp_matches(c, 'medium|small') then 90 else 0 end else 0 end as rank from p)
select p_partkey, rank, row_number() over (partition by family order by rank desc, p_partkey) as place from r""")
def q76_profile_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "lower(p_type) as c", "case when p_partkey % 3 = 0 then 'metal' when p_partkey % 3 = 1 then 'finish' else 'other' end as family")
    scored = rows.withColumn("rank", rulebook.profile_rank(F.col("family"), F.col("c"), _RANKS))
    return ranking.ranked(scored, "family", F.col("rank").desc(), F.col("p_partkey")).select("p_partkey", "rank", "place")


@_query("""with p as (select doc_id, text, case when regexp_matches(lower(text), 'license') then 'legal' when regexp_matches(lower(text), 'token|password') then 'secret' when regexp_matches(lower(text), 'the ') then 'prose' else 'unknown' end as intent,
[x for x in [trim(y) for y in regexp_split_to_array(text, '[\\n.;]')] if length(x) >= 10 and regexp_matches(x, 'tion')] as good from documents)
select doc_id, intent, case when not regexp_matches(text, '[0-9]{8}') then substr(good[1], 1, 220) end as phrase from p""")
def q77_intents_and_evidence(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    intent = rulebook.first_match(low, [("legal", "license"), ("secret", "token|password"), ("prose", "the ")])
    return table(spark, d, "documents").select("doc_id", intent.alias("intent"), rulebook.evidence(F.col("text"), "tion", "[0-9]{8}").alias("phrase"))


@_query("""select p_partkey, case when contains(lower(p_type), 'medium') then 'metal' when contains(lower(p_name), 'a') then 'named' when contains(lower(p_brand), '3') then 'third' else 'unknown' end as family from part""")
def q78_keyword_family(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.lower("p_type").contains("medium"), "metal").when(F.lower("p_name").contains("a"), "named").when(F.lower("p_brand").contains("3"), "third").otherwise("unknown")
    return table(spark, d, "part").select("p_partkey", family.alias("family"))


@_query("""with i as (select 'N' || (p_partkey % 25) as zone_code, case p_partkey % 5 when 0 then 'conditional' when 1 then 'auxiliary' else 'main' end as section, p_partkey, (p_size % 9) || '.' || (p_partkey % 4) || ' — ' || p_name as t from part),
s as (select zone_code, section, case section when 'main' then 0 when 'conditional' then 1 else 2 end as o, section || ': ' || string_agg(t, ' ; ' order by p_partkey) || '.' as line from i group by 1, 2)
select zone_code, string_agg(line, ' ' order by o) as retrieval_text from s group by 1""")
def q79_text_renderers(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").selectExpr(
        "concat('N', p_partkey % 25) as zone_code", "case p_partkey % 5 when 0 then 'conditional' when 1 then 'auxiliary' else 'main' end as section", "p_partkey as pos",
        "concat(p_size % 9, '.', p_partkey % 4) as vri_code", "p_name as vri_name", "'' as vri_description",
    )
    return catalog.retrieval_text(items)


@_query("""select n_nationkey, 'Zone ' || n_name || ':' || chr(10) || string_agg(r || '. ' || vri || ' — ' || case when length(p_name) > 12 then rtrim(substr(p_name, 1, 11)) || '…' else p_name end, chr(10) order by r) as prompt
from (select p_partkey % 25 as k, row_number() over (partition by p_partkey % 25 order by p_partkey) as r, (p_size % 9) || '.' || (p_partkey % 4) as vri, p_name from part) p join nation on k = n_nationkey where r <= 8 group by 1, n_name""")
def q80_prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("cast(p_partkey % 25 as int) as n_nationkey", "p_partkey", "concat(p_size % 9, '.', p_partkey % 4) as vri", "p_name")
    top = ranking.ranked(p, "n_nationkey", F.col("p_partkey")).where("place <= 8")
    line = F.format_string("%d. %s — %s", "place", "vri", T.truncated("p_name", 12))
    lists = top.groupBy("n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))
    named = lists.join(table(spark, d, "nation"), "n_nationkey")
    return named.select("n_nationkey", F.concat(F.lit("Zone "), "n_name", F.lit(":\n"), "lines").alias("prompt"))


@_query("""with e as (select event_id, case event_id % 3 when 0 then '{"code":"' || event_id || '","name":"n"}' when 1 then 'say {"code":"' || event_id || '"} now' else 'none' end as raw,
case when event_id % 2 = 0 then 'sc:' || user_id || ':2024:OSM:type-' || (event_id % 5) || ':upd-2024-01-01T00:00:m-ab12' else 'other:' || event_id end as key from events)
select event_id, case when event_id % 3 < 2 then cast(event_id as varchar) end as code, try_cast(nullif(regexp_extract(key, '^sc:([0-9]+):', 1), '') as bigint) as scenario_id,
nullif(regexp_extract(key, ':type-([^:]+):', 1), '') as type, nullif(regexp_extract(key, ':m-([^:]+)$', 1), '') as mapping from e""")
def q85_json_shapes_and_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ledger import parsed_key

    e = table(spark, d, "events").selectExpr(
        "event_id", """case event_id % 3 when 0 then concat('{"code":"', event_id, '","name":"n"}') when 1 then concat('say {"code":"', event_id, '"} now') else 'none' end as raw""",
        "case when event_id % 2 = 0 then concat('sc:', user_id, ':2024:OSM:type-', event_id % 5, ':upd-2024-01-01T00:00:m-ab12') else concat('other:', event_id) end as key",
    )
    parsed = e.select("event_id", F.try_variant_get(T.outer_json("raw"), "$.code", "string").alias("code"), parsed_key("key").alias("k"))
    return parsed.select("event_id", "code", F.col("k.scenario_id").alias("scenario_id"), F.col("k.type").alias("type"), F.col("k.mapping").alias("mapping"))


@_query("""with s as (select p_partkey % 25 as zone, p_partkey, case p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section,
100 * case p_size % 3 when 0 then 3 when 1 then 2 else 1 end + case when p_size % 10 = 1 then 25 else 0 end + 10 as score, p_name from part where regexp_matches(lower(p_type), 'standard'))
select zone, arg_max(p_partkey, score::bigint * 10000000 + p_partkey) as best, max(score) as score, max(score) >= 235 as auto from s group by 1""")
def q86_coverage_and_bridge_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where(F.lower("p_type").rlike("standard")).selectExpr(
        "p_partkey % 25 as zone", "p_partkey", "case p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section", "p_size"
    )
    score = lookup.section_priority("section") * 100 + F.when(F.col("p_size") % 10 == 1, 25).otherwise(0) + 10
    best = rows.withColumn("score", score).groupBy("zone").agg(F.max(F.struct("score", "p_partkey")).alias("b"))
    return best.select("zone", F.col("b.p_partkey").alias("best"), F.col("b.score").alias("score"), (F.col("b.score") >= 235).alias("auto"))


@_query(f"""select key, case when e.key is not null then 'allowed_' || section else 'unclear' end as verdict, coalesce(e.code, '') as code from {_ASK} a left join {_EXACT} e using (key)""")
def q87_no_model_heuristics(spark: SparkSession, d: str) -> DataFrame:
    """Over two thirds of the parts as items and a third that asks; superseded by q113_no_model_whole."""
    asked, found = _ask(spark, d), matching.exact_matches(_ask(spark, d), _zone_items(spark, d))
    rows = asked.select("key").join(found, "key", "left")
    return rows.select("key", F.when(F.col("section").isNull(), "unclear").otherwise(matching.allowed("section")).alias("verdict"), F.coalesce("code", F.lit("")).alias("code"))


@_query(f"""with a as (select *, zone in (select 'N' || n_nationkey from nation) as known from {_ASK} x), g as (select * from {_generic_sql("(select key, zone, canon from " + _ASK + " z)")} s),
e as (select * from {_EXACT} x), m as (select * from {_MARGIN} y where r = 1 and score >= 0.93 and cov >= 0.6 and ov >= 2 and score - second >= 0.035)
select a.key, case when not known then 'no_zone_metadata' when g.key is not null then case when g.section is null then 'unclear' else 'allowed_' || g.section end when e.key is not null then 'allowed_' || e.section
when m.key is not null then 'allowed_' || m.section else 'not_allowed' end as verdict,
case when not known then 'no_zone_metadata' when g.key is not null then case when g.section is null then 'residential_unspecified_generic_manual' else 'residential_unspecified_generic_in_zone' end
when e.key is not null then 'actual_zone_exact' when m.key is not null then 'actual_zone_fast_string' else 'actual_zone_not_allowed' end as method
from a left join g on a.key = g.key left join e on a.key = e.key left join m on a.key = m.key""")
def q49_cascade_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Over two thirds of the parts as items and a third that asks; superseded by q114_cascade_whole."""
    zones = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as zone_code", "cast(null as string) as base_code")
    out = matching.cascade(_ask(spark, d), zones, _zone_items(spark, d), ratio=False, **_PATTERNS)
    return out.select("key", "verdict", "method")


def _held(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder, so that what follows doesn't compute them again."""
    path = f"{shared_folder(rows.sparkSession)}/lotsift-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _every_other(key: str = "key") -> Column:
    """Whether the model stand-in answers a key: every other one, by hash."""
    return F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(2)) == 0


def _model(rows: DataFrame) -> DataFrame:
    """A model stand-in: half of what it answers is conditionally allowed; the keys that it fails on are left out."""
    yes = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(4)) == 0
    return rows.where(_every_other()).select(
        "key", F.when(yes, "allowed_conditional").otherwise("not_allowed").alias("verdict"), F.when(yes, "9.0").otherwise("").alias("code")
    )


def _by_vector(items: DataFrame, t: matching.Thresholds = matching.Thresholds()) -> matching.Port:
    """A vector port: the nearest item of the zone, if it is near enough and apart from the second. Each distinct text gets its vector once."""
    held = items.join(_held(ports.hash_vectors(items.select("name_canon").distinct(), "name_canon", "vector", 64)), "name_canon")

    def ask(rows: DataFrame) -> DataFrame:
        rows = _held(rows)
        asked = rows.join(_held(ports.hash_vectors(rows.select("canon").distinct(), "canon", "qvector", 64)), "canon").select("key", "zone", "qvector")
        best = matching.with_margin(asked.join(held, "zone").withColumn("score", ranking.dot("vector", "qvector")))
        sure = (F.col("score") >= t.vector) & (F.col("margin") >= t.vector_margin)
        return _held(best.where(sure).select("key", matching.allowed("section").alias("verdict"), "code"))

    return ask


@_query()
def q91_classify_only_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the whole cascade for each distinct name and zone, and the best codes for the names that are not allowed.

    The ports are a hash port for vectors and a model that answers every other key. Names not allowed are ranked among all
    embeddings; where the ranking is close the model orders the candidates, again for every other name, and the
    generic code comes first for names of no dwelling type.
    """
    part = _part(spark, d)
    asked = part.selectExpr("concat('N', p_partkey % 27) as zone", "canon").distinct()
    asked = _held(asked.select(F.concat_ws("|", "zone", "canon").alias("key"), "zone", "canon", F.col("canon").alias("short")))
    zones = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as zone_code", "cast(null as string) as base_code")
    items = _held(_zone_items(spark, d))
    verdicts = matching.cascade(asked, zones, items, vector=_by_vector(items), model=ports.failing_closed(_model), ratio=False, **_PATTERNS)
    verdicts = _held(verdicts.join(asked.select("key", "canon"), "key"))

    names = verdicts.where("verdict = 'not_allowed'").select(F.col("canon").alias("query")).distinct()
    entries = table(spark, d, "embeddings").select(F.concat_ws(".", "label", "vec_id").alias("code"), ranking.unit("embedding").alias("vector"))
    vec_id = F.substring_index("code", ".", -1).cast("bigint")
    top = ranking.recall(_held(ports.hash_vectors(names, "query", "qvector", 64)), entries, 20).withColumn("vec_id", vec_id)
    known = part.select(F.col("p_partkey").alias("vec_id"), F.col("canon").alias("name"), F.lower("p_type").alias("text"))
    rows = top.join(known, "vec_id", "left").fillna("", ["name", "text"]).withColumn("profile_rank", F.col("vec_id") % 101)
    words = T.split_words("query")
    by_name, by_text = (T.overlap(words, T.split_words(c))["coverage"] for c in ("name", "text"))
    rank = ranking.rerank_score(F.col("score"), by_name, by_text, F.col("profile_rank"), ranking.near_equal(F.col("query"), F.col("name")), F.col("code"))
    order = F.col("rerank").desc(), F.col("score").desc(), F.col("profile_rank").desc(), F.col("code").desc()
    placed = _held(ranking.ranked(rows.withColumn("rerank", rank), "query", *order))

    sure = F.when(F.col("profile_rank") >= 85, "strong").otherwise("weak").alias("confidence")
    gate = ranking.needs_model(placed.select("query", "place", F.col("rerank").alias("score"), "profile_rank", sure, F.size(words).alias("n_words"))).select("query", "ask")
    answered = gate.where(F.col("ask") & _every_other("query")).select("query")
    # The model's own order: by number, so that it differs from the ranking.
    chosen = placed.join(answered, "query", "left_semi").where("vec_id % 3 = 0").select("query", "code", F.col("vec_id").alias("choice"))
    five = ranking.merged_order(placed.select("query", "code", "name", "place"), chosen, "query", 5).select("query", "code", "name", "place")
    generic = T.residential_unspecified("query", **_PATTERNS)
    first = ranking.promoted(five.where(generic), "query", "2.0", "generic").where("place <= 5").select("query", "code", "name", "place")
    best = ranking.serialized(first.unionByName(five.where(~generic)), "query").join(gate, "query")
    best = best.withColumn("answered", F.col("ask") & _every_other("query")).withColumn("verdict", F.lit("not_allowed"))
    out = verdicts.join(best.withColumnRenamed("query", "canon"), ["canon", "verdict"], "left")
    return out.select("key", "verdict", "code", "method", "ask", "answered", "candidates")


#: The rule tables of the domain as they are; tests apply them to Russian texts.
DOMAIN_RULES = (PROFILE_RULES, PROFILE_PATTERNS, INTENTS, BRIDGE_BLOCKS)


# Every distinct name asks in its zone, and all parts' names are items; an item's description is the name of the part after it, and zones are called like two parts.
_ALL_ASK = f"(select distinct 'N' || (p_partkey % 27) || '|' || canon as key, 'N' || (p_partkey % 27) as zone, canon from {_PART} p)"
_ALL_ITEMS = f"""(select zone, canon as name_canon, min(k) as pos, arg_min(name, k) as name, arg_min(section, k) as section, arg_min(code, k) as code, arg_min(about, k) as about from (
select 'N' || (p.p_partkey % 25) as zone, p.canon, p.p_partkey as k, p.p_name as name, case p.p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section,
p.p_size || '.' || (p.p_partkey % 3) as code, case when p.p_size % 2 = 0 then coalesce(n.canon, '') else '' end as about from {_PART} p left join {_PART} n on n.p_partkey = p.p_partkey + 1) x group by 1, 2)"""
_ALL_ZONES = f"(select 'N' || a.p_partkey as zone, a.canon as zone_name, coalesce(b.canon, '') as zone_summary from {_PART} a left join {_PART} b on b.p_partkey = a.p_partkey * 7 where a.p_partkey < 23)"


def _metric_sql(a: str, b: str) -> tuple[str, str, str]:
    """SQL of the shared words, their share of a's, and the score of two texts."""
    x, y = (f"list_distinct(string_split({c}, ' '))" for c in (a, b))
    both, some = f"len(list_intersect({x}, {y}))", f"{a} <> '' and {b} <> ''"
    n = f"(case when {some} then {both} else 0 end)"
    cov = f"(case when {some} then {both} / len({x}) else 0 end)"
    return n, cov, f"(case when {some} then greatest(least(1.0, {both} / len({x}) * 0.97), least(1.0, {both} / len(list_distinct({x} || {y})) * 1.08)) else 0 end)"


_BY_NAME, _BY_DESC = _metric_sql("canon", "name_canon"), _metric_sql("canon", "about")
_ZONE_SCORE, _SUMMARY_SCORE = _metric_sql("canon", "zone_name")[2], _metric_sql("canon", "zone_summary")[2]
_DECISIONS_SQL = f"""(with pairs as materialized (select a.key, a.zone, a.canon, i.* exclude (zone), {_BY_NAME[0]} as n_ov, {_BY_NAME[1]} as n_cov, {_BY_NAME[2]} as n_score,
  {_BY_DESC[0]} as d_ov, {_BY_DESC[1]} as d_cov, {_BY_DESC[2]} as d_score, {exactish_sql('canon', 'name_canon')} as is_exact from {_ALL_ASK} a join {_ALL_ITEMS} i using (zone) where canon <> ''),
scored as (select *, greatest(n_score, least(1.0, d_score * 0.98)) as score, about <> '' and d_score > 0 and d_cov >= 0.85 and d_ov >= greatest(2, least(4, len(string_split(canon, ' ')))) and length(canon) >= 10 and contains(about, canon) as is_direct from pairs),
ordered as (select *, lead(score) over w as next_score, row_number() over w as r from scored window w as (partition by key order by score desc, pos)),
best as (select *, score - coalesce(next_score, -1.0) as margin from ordered where r = 1),
exact as (select key, arg_min(name, pos) as x_name, arg_min(section, pos) as x_section from pairs where is_exact group by 1),
direct as (select key, max(row({_PRIO}, d_score, name, code, section)) as m from scored where is_direct group by 1),
zoned as (select b.*, x_name, x_section, m, {_ZONE_SCORE} as z_score, {_SUMMARY_SCORE} as s_score from best b left join exact using (key) left join direct using (key)
  left join (select zone as z_zone, zone_name, zone_summary from {_ALL_ZONES} z) on z_zone = zone),
told as (select *, case when x_name is not null then 'exact_name' when m is not null then 'direct_description'
  when margin >= 0.035 and (n_score >= 0.93 and n_cov >= 0.6 and n_ov >= 2 or d_score >= 0.9 and d_cov >= 0.5 and d_ov >= 2) then 'high'
  when score >= 0.46 and (coalesce(z_score, 0) >= 0.91 or coalesce(s_score, 0) >= 0.88) then 'zone_semantic_high'
  when n_score >= 0.88 and n_cov >= 0.45 or d_score >= 0.84 and d_cov >= 0.4 or score >= 0.46 and (coalesce(z_score, 0) >= 0.86 or coalesce(s_score, 0) >= 0.82) then 'borderline' else 'weak' end as confidence from zoned)
select key, confidence, confidence not in ('borderline', 'weak') as direct,
'allowed_' || case confidence when 'exact_name' then x_section when 'direct_description' then m[5] else section end as verdict,
case confidence when 'exact_name' then x_name when 'direct_description' then m[3] else name end as name, round(margin, 6) as margin from told)"""


@_query(f"select * from {_DECISIONS_SQL} d")
def q104_string_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What strings alone decide about every distinct name in its zone, by all six outcomes; shares of words only, so that SQL can follow."""
    p = _held(_part(spark, d))
    asked = p.selectExpr("concat('N', p_partkey % 27) as zone", "canon").distinct().selectExpr("concat(zone, '|', canon) as key", "zone", "canon", "canon as short")
    after = p.selectExpr("p_partkey - 1 as p_partkey", "canon as about")
    rows = p.join(after, "p_partkey", "left").selectExpr(
        "concat('N', p_partkey % 25) as zone", "canon", "p_partkey", "p_name", "case p_size % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section",
        "concat(p_size, '.', p_partkey % 3) as code", "case when p_size % 2 = 0 then coalesce(about, '') else '' end as about",
    )
    first = F.min_by(F.struct("p_name", "section", "code", "about"), "p_partkey").alias("f")
    items = rows.groupBy("zone", F.col("canon").alias("name_canon")).agg(F.min("p_partkey").alias("pos"), first)
    text = F.col("f.about")
    items = items.select("zone", "name_canon", "pos", F.col("f.p_name").alias("name"), F.col("f.section").alias("section"), F.col("f.code").alias("code"), *[text.alias(c) for c in ("desc_canon", "desc_short", "desc_long")])
    second = p.where("p_partkey % 7 = 0").selectExpr("p_partkey div 7 as p_partkey", "canon as zone_summary")
    zones = p.where("p_partkey < 23").join(second, "p_partkey", "left").selectExpr("concat('N', p_partkey) as zone", "canon as zone_name", "coalesce(zone_summary, '') as zone_summary", "'' as zone_text")
    out = decisions.string_decisions(asked, items, zones, ratio=False)
    return out.select("key", "confidence", "direct", "verdict", "name", F.round("margin", 6).alias("margin"))


_REVIEW_ROWS = """(select p_partkey, case when p_partkey % 4 = 0 then 'allowed_main' else 'not_allowed' end as verdict, (p_size % 7) || case when p_partkey % 2 = 0 then '.' || (p_partkey % 5) else '' end || case when p_partkey % 3 = 0 then '.9' else '' end as zone,
(p_partkey % 13) || '.1 first, ' || (p_partkey % 11) || '.2 second, none, ' || (p_size % 9) || '.1' as top from part)"""
_REVIEW_CODES = """(select distinct (p_size % 6) || case when p_partkey % 3 <> 0 then '.' || (p_partkey % 4) else '' end as zone, case when p_size % 6 > 0 then (p_partkey % 10) || '.' || (1 + p_partkey % 2) end as code from part where p_partkey % 5 = 0)"""


@_query(f"""with sets as materialized (select zone, list(code) filter (where code is not null) as codes from {_REVIEW_CODES} c group by 1),
rows as (select *, string_split(zone, '.') as parts from {_REVIEW_ROWS} r),
known as (select r.p_partkey, case when o.codes is not null then o.codes else coalesce(b2.codes, case when b2.zone is null then b1.codes end) end as codes from rows r
left join sets o on o.zone = r.zone left join sets b2 on len(parts) > 2 and b2.zone = array_to_string(parts[1:2], '.') left join sets b1 on len(parts) > 1 and b1.zone = parts[1]),
found as (select r.p_partkey, r.verdict, list_filter(list_transform(string_split(top, ','), lambda x: regexp_extract(trim(x), '^([0-9]+(\\.[0-9]+)*)\\b', 1)), lambda y: y <> '' and list_contains(codes, y)) as hits from rows r join known using (p_partkey))
select p_partkey, verdict, case when verdict = 'not_allowed' and len(hits) > 0 then array_to_string(hits, ', ') end as allowed_codes,
case when verdict = 'not_allowed' and len(hits) > 0 then 'Требуется ручная проверка' else 'status' end as status from found""")
def q105_manual_review(spark: SparkSession, d: str) -> DataFrame:
    """Rows that aren't allowed though one of their candidates is allowed in their zone, or in the zone that its code falls back to."""
    p = table(spark, d, "part")
    rows = p.selectExpr(
        "p_partkey", "case when p_partkey % 4 = 0 then 'allowed_main' else 'not_allowed' end as verdict",
        "concat(p_size % 7, case when p_partkey % 2 = 0 then concat('.', p_partkey % 5) else '' end, case when p_partkey % 3 = 0 then '.9' else '' end) as zone",
        "concat(p_partkey % 13, '.1 first, ', p_partkey % 11, '.2 second, none, ', p_size % 9, '.1') as top", "'status' as status", "cast(null as string) as reason",
    )
    codes = p.where("p_partkey % 5 = 0").selectExpr("concat(p_size % 6, case when p_partkey % 3 <> 0 then concat('.', p_partkey % 4) else '' end) as zone", "case when p_size % 6 > 0 then concat(p_partkey % 10, '.', 1 + p_partkey % 2) end as code")
    return decisions.manual_review(rows, codes.distinct(), "zone", "top").select("p_partkey", "verdict", "allowed_codes", "status")


def _service(row: dict) -> dict:
    """A service that fails by rule."""
    if row["n"] % 7 == 0:
        raise TimeoutError(f"no answer for {row['n']}")
    return {"verdict": "allowed_main" if row["n"] % 2 else None, "code": str(row["n"] % 9), "method": "actual_zone_llm"}


@_query("""select p_partkey, case when p_partkey % 7 = 0 then 'not_allowed' when p_partkey % 2 = 1 then 'allowed_main' else 'unclear' end as verdict, case when p_partkey % 7 > 0 then cast(p_partkey % 9 as varchar) end as code,
case when p_partkey % 7 = 0 then 'error' else 'actual_zone' end as scope, case when p_partkey % 7 = 0 then 'error' else 'actual_zone_llm' end as method, case when p_partkey % 7 = 0 then 'Внутренняя ошибка классификации: no answer for ' || p_partkey end as reason from part""")
def q106_row_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a failing service decides: an error is that row's verdict and no other's."""
    rows = table(spark, d, "part").selectExpr("p_partkey as key", "p_partkey as n")
    return decisions.decided(rows, _service).select(F.col("key").alias("p_partkey"), "verdict", "code", "scope", "method", "reason")


def _orders(query: str, short: list[dict]) -> list:
    """A model that puts the last five first, is cut short once on every third query and always on every fifth."""
    n = int(query)
    if n % 5 == 0:
        raise ValueError("finish_reason: length")
    if n % 3 == 0 and len(short) > 5:
        return ["only one"]
    return [c["code"] for c in short][::-1][:5]


@_query("""with c as (select l_suppkey % 97 as query, l_partkey as code, row_number() over (partition by l_suppkey % 97 order by l_partkey) as place from (select distinct l_suppkey % 97 as l_suppkey, l_partkey from lineitem)),
s as (select *, count(*) over (partition by query) as n from c where place <= 20), t as (select *, least(n, case when query % 3 = 0 then 5 else 20 end) as m from s)
select cast(query as varchar) as query, cast(code as varchar) as code, case when query % 5 = 0 then place else m + 1 - place end as place, case when query % 5 = 0 then 3 when query % 3 = 0 then 2 else 1 end as tries from t
where case when query % 5 = 0 then place <= 5 else place <= m and m + 1 - place <= 5 end""")
def q107_model_choice(spark: SparkSession, d: str) -> DataFrame:
    """Five candidates of each supplier group in a model's order, which is asked again where it is cut short and done without where it fails."""
    pairs = table(spark, d, "lineitem").selectExpr("l_suppkey % 97 as q", "l_partkey").distinct()
    placed = ranking.ranked(pairs, "q", F.col("l_partkey")).where("place <= 20")
    rows = placed.select(F.col("q").cast("string").alias("query"), F.col("l_partkey").cast("string").alias("code"), F.lit("").alias("name"), "place")
    return decisions.chosen_by_model(rows, _orders).select("query", "code", "place", "tries")


_CLASSIFIER_SQL = """(with e as (select n_regionkey as doc, case when s_suppkey % 11 = 0 then 'none' else (s_nationkey % 4) || '.' || (s_suppkey % 6) end as code, 'kind ' || (s_suppkey % 9) as name, cast(s_suppkey as varchar) as description, s_suppkey as pos
from supplier join nation on n_nationkey = s_nationkey) select * from e where code <> 'none')"""


@_query(f"""with e as materialized (select * from {_CLASSIFIER_SQL} e), c as (select code, arg_max(description, pos) as description from e group by 1),
n as (select name, code, arg_min(description, pos) as description from e group by 1, 2), s as (select name, arg_min(code, row(length(code), code)) as code, arg_min(description, row(length(code), code)) as description from n group by 1),
a as (select p_partkey, (p_partkey % 5) || '.' || (p_size % 8) as code, case when p_partkey % 4 = 0 then 'other' else 'kind ' || (p_size % 12) end as name from part)
select p_partkey, coalesce(b.code, s.code, c.code) as ref_code, coalesce(b.description, s.description, c.description) as ref_description,
case when b.code is not null then 'code_and_name' when s.code is not null then 'name' when c.code is not null then 'code' end as how
from a left join c on c.code = a.code left join n b on b.name = a.name and b.code = a.code left join s on s.name = a.name""")
def q108_classifier_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Codes and names of parts in a classifier that comes as five documents of three shapes."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    code = F.expr("case when s_suppkey % 11 = 0 then 'none' else concat(s_nationkey % 4, '.', s_suppkey % 6) end")
    item = F.struct(code.alias("code"), F.expr("concat('kind ', s_suppkey % 9)").alias("name"), F.col("s_suppkey").cast("string").alias("description"))
    held = s.groupBy(F.col("n_regionkey").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("e")))).alias("a"))
    listed = F.transform("a", lambda x: x["e"])
    named = F.map_from_entries(F.transform("a", lambda x: F.struct(F.concat(F.lit("k"), x["s_suppkey"].cast("string")), x["e"])))
    text = F.when(F.col("doc") % 3 == 0, F.to_json(listed)).when(F.col("doc") % 3 == 1, F.to_json(F.struct(listed.alias("entries")))).otherwise(F.to_json(F.struct(named.alias("by_code"))))
    # The documents' entries stand in one order by their numbers.
    entries = classifier.entries_of(held.select("doc", text.alias("value")), key="doc").withColumn("pos", F.col("description").cast("bigint")).drop("doc")
    asked = table(spark, d, "part").selectExpr("p_partkey", "concat(p_partkey % 5, '.', p_size % 8) as code", "case when p_partkey % 4 = 0 then 'other' else concat('kind ', p_size % 12) end as name")
    return classifier.meant_entries(asked, entries, "code", "name").select("p_partkey", "ref_code", "ref_description", "how")


# Uses as a register has them, with the family, confidence and type that the domain's rules give them, and whether they may be decided without a person.
_USES = [
    ("Трансформаторная подстанция", "communal_engineering", "strong", None, False),
    ("Школа", "education_school", "strong", None, False),
    ("Детский сад", "education_preschool", "strong", None, False),
    ("Магазин", "retail", "strong", None, False),
    ("Гараж", "garage", "strong", None, False),
    ("Гостиница", "hotel", "strong", None, False),
    ("Индивидуальное жилищное строительство", "residential_individual", "strong", "individual", True),
    ("Многоквартирный дом", "residential_multifamily", "strong", "multifamily", True),
    ("Склад", "industrial", "medium", None, False),
    ("Жилая застройка", "residential_unspecified", "weak", "unspecified", False),
    ("Офис", "business", "medium", None, False),
    ("Стадион", "sport", "strong", None, False),
    ("Тротуар", "street_network", "strong", None, False),
    ("nan", "unknown", "none", None, False),
    ("Прочее", "unknown", "weak", None, False),
]
_USES_SQL = "(values " + ", ".join(f"({k}, '{u}', '{f}', '{c}', {'null' if t is None else repr(t)}, {str(a).lower()})" for k, (u, f, c, t, a) in enumerate(_USES)) + ") u(k, use, family, confidence, subtype, auto)"


@_query(f"select p_partkey, use, family, confidence, subtype, auto from part join {_USES_SQL} on k = p_partkey % {len(_USES)}")
def q109_domain_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of registered uses by the domain's own rules."""
    uses = F.array(*[F.lit(u) for u, *_ in _USES])
    rows = table(spark, d, "part").select("p_partkey", F.element_at(uses, (F.col("p_partkey") % len(_USES) + 1).cast("int")).alias("use"))
    out = compiled.profiles(T.canonical(rows, "use", "canon"), "canon")
    return out.select("p_partkey", "use", *[F.col(f"profile.{c}").alias(c) for c in ("family", "confidence", "subtype", "auto")])


# Items by number, with the families whose rule they serve: utilities, streets and outbuildings.
_COVER_ITEMS = [("Коммунальное обслуживание", "communal_engineering"), ("Проезд и тротуар", "street_network"), ("Гаражи", "household_outbuilding"), ("Торговля", "none")]
_COVER_ITEMS_SQL = "(values " + ", ".join(f"({k}, '{n}', '{f}')" for k, (n, f) in enumerate(_COVER_ITEMS)) + ") t(k, item, serves)"


@_query(f"""with items as (select s_suppkey % 25 as zone, s_suppkey, case s_suppkey % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section, item || ' ' || s_suppkey as name,
case s_suppkey % 5 when 0 then '3.1' when 1 then '7.2' else '9.9' end as code, serves, item from supplier join {_COVER_ITEMS_SQL} on k = s_suppkey % {len(_COVER_ITEMS)}),
asks as (select p_partkey as key, p_partkey % 25 as zone, family from part join {_USES_SQL} on k = p_partkey % {len(_USES)} where family in ('communal_engineering', 'street_network')),
pairs as (select key, name, code, section, {_PRIO} as p, {_PRIO} * 100 + case when (family = 'communal_engineering' and code = '3.1') or (family = 'street_network' and code = '7.2') then 25 else 0 end
 + case when family = 'street_network' then 10 else 0 end as score from asks a join items i using (zone) where serves = family)
select key, 'allowed_' || (max(row(score, p, name, code, section)))[5] as verdict, (max(row(score, p, name, code, section)))[3] as name, cast((max(row(score, p, name, code, section)))[1] as integer) as score from pairs group by 1""")
def q110_domain_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Uses that an item of their zone covers by the domain's narrow rules."""
    uses = F.array(*[F.lit(u) for u, *_ in _USES])
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 25).alias("zone"), F.element_at(uses, (F.col("p_partkey") % len(_USES) + 1).cast("int")).alias("use"))
    named = F.element_at(F.array(*[F.lit(n) for n, _ in _COVER_ITEMS]), (F.col("s_suppkey") % len(_COVER_ITEMS) + 1).cast("int"))
    items = table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 25).alias("zone"), F.expr("case s_suppkey % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end").alias("section"),
        F.concat_ws(" ", named, F.col("s_suppkey").cast("string")).alias("name"), F.expr("case s_suppkey % 5 when 0 then '3.1' when 1 then '7.2' else '9.9' end").alias("code"),
    )
    out = compiled.covered(T.canonical(rows, "use", "canon").select("key", "zone", "canon"), T.canonical(items, "name", "canon"))
    return out.select("key", "verdict", "name", "score")


def _whole(sql: str) -> str:
    """SQL over all parts, as items and as those that ask."""
    return sql.replace(" where p_partkey % 3 <> 0", "").replace(" where p_partkey % 3 = 0", "")


@_query(_whole(ORACLES["q59_zone_exact_match"]))
def q111_exact_match_whole(spark: SparkSession, d: str) -> DataFrame:
    """The best exact item of each part's zone, all parts asking and all their names being items."""
    return matching.exact_matches(_ask(spark, d, "true"), _zone_items(spark, d, "true"))


@_query(_whole(ORACLES["q60_string_margin"]))
def q112_string_margin_whole(spark: SparkSession, d: str) -> DataFrame:
    """The best item by shared words of each part's zone, with its margin, over all parts."""
    best = matching.best_items(_ask(spark, d, "true"), _zone_items(spark, d, "true"), ratio=False)
    return best.select("key", "pos", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), matching.strong_string(best).alias("strong"))


@_query(_whole(ORACLES["q87_no_model_heuristics"]))
def q113_no_model_whole(spark: SparkSession, d: str) -> DataFrame:
    """What exact names alone decide about all parts."""
    asked = _held(_ask(spark, d, "true"))
    rows = asked.select("key").join(matching.exact_matches(asked, _zone_items(spark, d, "true")), "key", "left")
    return rows.select("key", F.when(F.col("section").isNull(), "unclear").otherwise(matching.allowed("section")).alias("verdict"), F.coalesce("code", F.lit("")).alias("code"))


@_query(_whole(ORACLES["q49_cascade_end_to_end"]))
def q114_cascade_whole(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the cascade for all parts."""
    zones = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as zone_code", "cast(null as string) as base_code")
    out = matching.cascade(_held(_ask(spark, d, "true")), zones, _zone_items(spark, d, "true"), ratio=False, **_PATTERNS)
    return out.select("key", "verdict", "method")


@_query(ORACLES["q51_tfidf"].replace("(select count(distinct doc_id) as n from tf)", "(select count(distinct doc_id) as n from documents)"))
def q115_tfidf_every(spark: SparkSession, d: str) -> DataFrame:
    """The number of terms and the top weight of each document with words, all documents counting."""
    top = top_weights(table(spark, d, "documents"), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)), every=True)
    return top.withColumn("top_weight", F.round("top_weight", 6))
