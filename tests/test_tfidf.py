"""Weights of words against the queries' SQL, and where the work on words is done."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lotsift.operators.tfidf import tfidf, top_weights
from lotsift.plans.texts import ORACLES, QUERIES

ROWS = [(1, "aa bb bb cc"), (1, "bb zz zz"), (2, "aa aa bb"), (3, None), (4, "1 2 x"), (None, "aa cc dd"), (5, "dd ee Ee"), (6, "")]


@pytest.mark.parametrize("query", ["q51_tfidf", "q115_tfidf_every"])
def test_null_and_repeated_ids_as_in_sql(spark, tmp_path, query):
    path = str(tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", ROWS)
    db.execute(f"copy documents to '{path}' (format parquet)")
    got = sorted(tuple(r) for r in QUERIES[query](spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(ORACLES[query]).fetchall()) and len(got) == 3


def test_words_are_taken_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200).coalesce(1)
        # The word of a row is the task that takes it.
        words = F.array(F.spark_partition_id().cast("string"))
        assert tfidf(rows, "id", words).select("word").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("every", [False, True])
def test_top_weights_are_the_largest_of_all_weights(spark, every):
    rows = spark.createDataFrame(ROWS, "k long, text string").withColumn("words", F.split("text", " "))
    weights = {}
    for k, word, w in tfidf(rows, "k", F.col("words"), every).collect():
        weights.setdefault(k, {})[word] = w
    top = {r.k: (r.n_terms, round(r.top_weight, 12)) for r in top_weights(rows, "k", F.col("words"), every).collect()}
    assert top == {k: (len(w), round(max(w.values()), 12)) for k, w in weights.items()}


def test_no_words_at_all(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "k long, words array<string>")
    assert top_weights(rows, "k", F.col("words")).count() == tfidf(rows, "k", F.col("words"), every=True).count() == 0
