"""The queries of the corpus operators: each reads a whole table, applies one operator and derives its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import fit, recover_parts, transcripts_of
from .decontaminate import contaminations
from .embedding_dedup import near_vectors
from .language_id import languages_of
from .license_scan import licences
from .lm_score import ORDER, score_texts
from .minmax_dedup import near_duplicates
from .phrases import collocations
from .sentencepiece_fst import encode_texts
from .spelling import variants
from .substring_dedup import repeated_runs
from .toxicity import toxicity_of
from .url_filter import evaluate


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(_table(spark, sf_dir, "documents"), bare=True)
    return found.select("doc_id", "line", "license_id", F.round("saved", 6).alias("saved"), "differences")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_texts(docs, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_runs(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), order=ORDER)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation parsed by a model counted from those whose crc32(conv_id as text) mod 3 is not 1."""
    raw = transcripts_of(_table(spark, sf_dir, "conversations"))
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3))
    out = recover_parts(raw.drop("turns"), fit(raw.where(fold != 1)))
    return out.select(
        "conv_id", "part", "n_turns", "continued", F.array_join("roles", ",").alias("roles"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256")
    )


#: The log of a block and allow list: category, verdict, host, path prefix, day, change.
URL_LIST = [
    ("spam", "block", "spam-farm.example.org", "/", "2023-11-01", "add"),
    ("spam", "block", "spam-farm.example.org", "/", "2024-09-15", "remove"),
    ("pharma", "block", "cheap-pills.example.com", "/", "2024-03-10", "add"),
    ("pharma", "block", "cheap-pills.example.com", "/", "2024-06-10", "remove"),
    ("pharma", "block", "cheap-pills.example.com", "/", "2024-08-01", "add"),
    ("translated", "block", "example.net", "/de/", "2024-02-01", "add"),
    ("translated", "block", "example.net", "/de/", "2024-11-01", "remove"),
    ("mirror", "block", "tionsh.example.net", "/", "2024-05-20", "add"),
    ("partner", "allow", "tionsh.example.net", "/es/", "2024-07-01", "add"),
    ("blog", "block", "blog.tionble.example.com", "/fr/", "2024-01-01", "add"),
    ("archive", "block", "example.org", "/en/9", "2024-04-01", "add"),
    ("archive", "block", "example.org", "/en/9", "2024-04-01", "remove"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as captured on a day of 2024 that its page_id gives, as the table has no dates."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    entries = spark.createDataFrame(URL_LIST, "category string, verdict string, host string, prefix string, day string, change string")
    out = evaluate(captures, entries.withColumn("day", F.col("day").cast("date")))
    return out.select("page_id", "host", F.col("n_active").cast("bigint").alias("n_active"), "categories", "blocked")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_tokens", F.size("passages").cast("bigint").alias("n_passages"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_chat_format": op9_chat_format,
    "op10_url_filter": op10_url_filter,
    "op11_phrases": op11_phrases,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}

_LIST_SQL = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in URL_LIST)

ORACLES: dict[str, str] = {
    "op3_minmax_dedup": """
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as materialized (
  select doc_id, case when w is null or len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from words),
shingles as materialized (select doc_id, unnest(s) as x from sets),
rare as materialized (select x, list(doc_id) as ids from shingles group by x having count(*) > 1),
pairs as materialized (
  select a, b, count(*) as n_both from
    (select unnest(ids) as a, ids from rare) t, lateral (select unnest(t.ids) as b) u where a < b group by a, b),
links as materialized (
  select a, b from pairs join sets p on p.doc_id = a join sets q on q.doc_id = b
  where 100 * n_both >= 75 * (len(p.s) + len(q.s) - n_both)),
edges as materialized (select a, b from links union all select b, a from links),
reach(doc_id, low) as (
  select doc_id, doc_id from documents union select e.b, r.low from reach r join edges e on e.a = r.doc_id where r.low < e.b),
least_of as (select doc_id, min(low) as component_id from reach group by doc_id)
select d.doc_id, cast(len(s) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join sets using (doc_id) join least_of using (doc_id)
""",
    "op4_substring_dedup": """
with words as materialized (
  select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
runs as materialized (
  select doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as p from words where len(w) >= 35)),
again as materialized (select h from runs group by h having count(*) > 1),
gone as (select distinct doc_id, unnest(range(p, p + 35)) as i from runs join again using (h)),
kept as (select doc_id, list(w[i] order by i) as k, count(*) as n from
  (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words) anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256
from words left join kept using (doc_id)
""",
    "op11_phrases": """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sizes as (select lang, sum(len(w)) as n from words group by lang),
grams as (select lang, w[i:i + k - 1] as g from (
  select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)),
f as materialized (select lang, g, count(*) as f from grams group by lang, g having count(*) >= 30),
cands as materialized (select lang, g, f as a from f where len(g) > 1),
cuts as (
  select c.lang, c.g, a, k, p.f as l, s.f as r, (cast(2000000 as hugeint) * a) // (p.f + s.f) as score
  from (select *, unnest(range(1, len(g))) as k from cands) c
  join f p on p.lang = c.lang and p.g = c.g[1:k] join f s on s.lang = c.lang and s.g = c.g[k + 1:len(c.g)]),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_grams as (
  select lang, a as of_longer, g[i:i + k - 1] as part from (
    select lang, a, g, k, unnest(range(1, len(g) - k + 2)) as i from cands, (select unnest([2, 3]) as k) where len(g) > k)),
covered as (select distinct c.lang, c.g from inner_grams i join cands c on c.lang = i.lang and c.g = i.part where 100 * of_longer >= 80 * c.a),
ranked as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank
  from lowest anti join covered using (lang, g))
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  cast(n as bigint) as n, cast(score as bigint) as score
from ranked join sizes using (lang) where rank <= 2000
""",
    "op10_url_filter": f"""
with log as (select * from (values {_LIST_SQL}) t(category, verdict, host, prefix, day, change)),
states as (select category, verdict, host, prefix, cast(day as date) as day, max(change = 'add') as is_on from log group by all),
turns as (select *, coalesce(lag(is_on) over e, false) as before from states window e as (partition by category, verdict, host, prefix order by day)),
spans as (select *, lead(day) over (partition by category, verdict, host, prefix order by day) as until from turns where is_on <> before),
pages2 as (
  select page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.|\\.$', '', 'g'), '') as host,
    coalesce(nullif(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') as path,
    date '2024-01-01' + cast((page_id * 37) % 366 as integer) as at from pages),
hits as (
  select page_id, category, verdict from pages2 p join spans s
  on (p.host = s.host or ends_with(p.host, '.' || s.host)) and starts_with(p.path, s.prefix)
  and s.is_on and p.at >= s.day and (s.until is null or p.at < s.until)),
found as (
  select page_id, count(*) as n, array_to_string(list_sort(list_distinct(list(category))), ',') as categories,
    bool_or(verdict = 'allow') as allowed, bool_or(verdict = 'block') as listed from hits group by page_id)
select p.page_id, p.host, cast(coalesce(n, 0) as bigint) as n_active, coalesce(categories, '') as categories,
  coalesce(listed, false) and not coalesce(allowed, false) as blocked
from pages2 p left join found f using (page_id)
""",
}
