"""Every stage of the pipeline against brute force on its own input."""

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as P
from lotsift.llm.decontaminate import budget, normal
from lotsift.llm.sentencepiece_fst import DEFAULT_MODEL

from .test_decontaminate import distances
from .test_minmax_dedup import exact as near_groups
from .test_substring_dedup import exact as cut


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The documents before the first stage and after each, all read again from Parquet."""
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return [(d.columns, {r.doc_id: r for r in d.collect()}) for d in out]


def test_columns(steps):
    for columns, _ in steps[1:-1]:
        assert columns == steps[0][0]


def test_language_keeps_clean_documents(steps):
    (_, before), (_, after) = steps[:2]
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_near_duplicates(steps):
    (_, before), (_, after) = steps[1:3]
    groups = near_groups([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (_, low) in groups.items() if i == low}


def test_substrings(steps):
    (_, before), (_, after) = steps[2:4]
    want = {i: (n, gone, text) for i, n, gone, text in cut([(i, r.text) for i, r in before.items()])}
    assert set(after) == {i for i, (n, gone, _) in want.items() if gone < n or not gone}
    for i, r in after.items():
        n, gone, text = want[i]
        assert r.text == (text if gone else before[i].text) and r.n_chars == len(r.text)


def test_benchmark(steps, spark, sf_dir):
    (_, before), (_, after) = steps[3:5]
    items = [normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, r in before.items():
        text = normal(r.text)
        if any(x in text for x in items):
            assert i not in after
        if i not in after:
            assert any(distances(x, text).min() <= budget(x) for x in items)


def test_tokens(steps):
    (_, before), (_, after) = steps[4:6]
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    assert set(before) == set(after)
    for i, r in after.items():
        ids = np.frombuffer(r.ids, "<i4").tolist()
        assert ids == library.encode(before[i].text) and r.n_tokens == len(ids)


def test_nulls_repeats_and_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(30).union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (None, "the and of that", None, None, 5), (10**9, "12 34", "en", "s", 5)], docs.schema))
    out = odd
    for name, stage in P.STAGES:
        out = spark.createDataFrame(stage(spark, out, sf_dir).collect(), stage(spark, out, sf_dir).schema)
    ids = [r.doc_id for r in out.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 10**9 not in ids
    empty = docs.where("false")
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_gives_the_same(spark, sf_dir, steps):
    got = {r.doc_id: r for r in P.run(spark, sf_dir).collect()}
    assert got == steps[-1][1]


def test_near_duplicates_with_shared_and_missing_ids(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(7, one), (7, two), (5, one), (None, two), (None, three), (None, three), (9, None), (9, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/docs")
    got = P.near_dedup(spark, spark.read.parquet(f"{tmp_path}/docs"), sf_dir).collect()
    key = {one: "one", two: "two", three: "three", None: "null", "": "empty"}
    assert sorted((str(r.doc_id), key[r.text]) for r in got) == [("5", "one"), ("7", "two"), ("9", "empty"), ("9", "null"), ("None", "three")]


def test_columns_of_any_name_stay(spark, sf_dir):
    """Columns that stages use themselves, or lack, come back as they were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).drop("n_chars")
    odd = ["row", "first", "kept_text", "n_words", "n_removed", "lang_pred", "score", "row_number", "component", "words_kept", "id"]
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in odd])
    out = spark.createDataFrame(wide.collect(), wide.schema)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, out, sf_dir)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}{r.doc_id}" for c in odd), name
        out = spark.createDataFrame(rows, wide.schema)
    assert P.tokens(spark, out, sf_dir).count() == out.count()


def test_very_long_text(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()
    long = " ".join(f"the and of that x{i}" for i in range(20_000))
    out = spark.createDataFrame([*some, (10**8, long, "en", "s", len(long))], schema)
    for name, stage in P.STAGES:
        got = stage(spark, out, sf_dir)
        out = spark.createDataFrame(got.collect(), got.schema)
        assert out.where(f"doc_id = {10**8}").count() == 1, name
