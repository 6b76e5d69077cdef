"""From raw documents to token ids: five stages, each written out and read again before the next."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotsift.llm.common import shared_folder
from lotsift.llm.decontaminate import contaminations
from lotsift.llm.language_id import UNDETERMINED, identify, train
from lotsift.llm.minmax_dedup import near_duplicates
from lotsift.llm.sentencepiece_fst import encode_texts
from lotsift.llm.substring_dedup import repeated_runs

#: A document in no language known, or less sure of it than this, goes.
LEAST_LANGUAGE_SCORE = 0.4


def _free(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number that tells its rows apart, and that column's name.

    The numbers follow the rows' places, and a stage computes them more than once: docs must lie in the same order each time they are read, as files do, which is how
    run() hands them on. A table that comes out of a shuffle has to be written first.
    """
    row = _free(docs, "row_number")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled ones among them teach.

    Null, empty and letterless texts go, as their language can't be told; a long text is read whole. Repeated rows
    share their fate. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    aside = {c: _free(docs, f"_{c}") for c in docs.columns if c in ("lang_pred", "score")}
    found = identify(docs.withColumnsRenamed(aside), train(docs))
    sure = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one of smallest doc_id, of equal ones the first row; a null doc_id comes last.

    Rows are told apart by their place, so an id that different texts share, or that is missing, decides nothing else.
    Null and blank texts are in no group and stay, long ones are compared whole. Columns stay as they are, whatever
    their names; an empty table stays empty.
    """
    rows, row = _numbered(docs)
    texts = rows.select(F.col(row).alias("row"), "doc_id", "text")
    groups = near_duplicates(texts.select("row", "text"), "row").select("row", F.coalesce("component_id", "row").alias("component"))
    named = texts.select("row", "doc_id").join(groups, "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = named.groupBy("component").agg(first.alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated runs; those without any go, and a text that lost none stays as it is.

    So null and blank texts stay, repeated long texts go, and a long text is cut whole. n_chars, where there is one, is counted anew; all other
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    rows, row = _numbered(docs)
    cut = repeated_runs(rows.select(row, "text"), row).where("n_removed > 0")
    words, kept = _free(rows, "words_kept"), _free(rows, "text_kept")
    cut = cut.select(row, (F.col("n_words") - F.col("n_removed")).alias(words), F.col("kept_text").alias(kept))
    joined = rows.join(cut, row, "left").where(F.coalesce(F.col(words), F.lit(1)) > 0)
    out = joined.withColumn("text", F.coalesce(F.col(kept), F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(words).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and blank texts hold none and stay, long ones are searched whole; repeated rows share their fate. Columns
    stay as they are, whatever their names; an empty table stays empty, and an empty benchmark removes nothing.
    """
    rows, row = _numbered(docs)
    found = contaminations(rows.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row).select(row).distinct()
    return rows.join(found, row, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the packed 32-bit token ids, null for a null text.

    A long text is encoded whole, repeated rows have a row each, other columns go, and an empty table gives an empty one.
    """
    coded = encode_texts(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Neither the trained network nor the transducer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the documents lie in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def through(docs: DataFrame, k: int) -> DataFrame:
        out = STAGES[k][1](spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{k}-{STAGES[k][0]}")
        return spark.read.parquet(path)

    return reduce(through, range(len(STAGES)), spark.read.parquet(f"{sf_dir}/documents.parquet"))
