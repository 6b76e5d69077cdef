"""Repeated runs against a count of every window."""

import random
from collections import Counter

import pytest

from lotsift.llm.substring_dedup import RUN_WORDS, repeated_runs


def exact(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + RUN_WORDS]) for w in words for i in range(len(w) - RUN_WORDS + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for p in range(len(w) - RUN_WORDS + 1) if seen[tuple(w[p : p + RUN_WORDS])] > 1 for k in range(p, p + RUN_WORDS)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def check(spark, rows):
    got = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", range(4))
def test_passages_at_all_offsets(spark, seed):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(40):
        a = r.randrange(50)
        part = passage[a : a + r.choice([17, 18, 34, 35, 36, 40])]
        rows.append((i, " ".join([f"a{r.random()}" for _ in range(r.randrange(40))] + part + [f"b{r.random()}" for _ in range(r.randrange(40))])))
    rows.append((100, " ".join(["same"] * 80)))
    rows.append((101, " ".join(["loop", "of", "three"] * 20)))
    check(spark, rows)


def test_nulls_blanks_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (None, "short text")])


def test_many_batches(spark, monkeypatch):
    from lotsift.llm import common, substring_dedup

    real = common.batches
    monkeypatch.setattr(substring_dedup, "batches", lambda d, k, t: real(d, k, t, 600))
    monkeypatch.setattr(substring_dedup, "BUCKET_TEXT_BYTES", 8 << 20)
    r = random.Random(9)
    passage = " ".join(f"q{i}" for i in range(45))
    check(spark, [(i, f"{r.random()} {passage if i % 3 == 0 else ''} " + " ".join(str(r.random()) for _ in range(30))) for i in range(60)])


def test_empty_and_clashing_columns(spark):
    assert repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b", 3, "x", 4)], "doc_id long, text string, g int, id string, bucket int")
    assert [tuple(r) for r in repeated_runs(odd).collect()] == [(1, 2, 0, "a b")]


def test_very_long_texts(spark):
    from lotsift.llm.substring_dedup import repeated_runs

    long = " ".join(f"w{i}" for i in range(120_000))
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"{long} {shared}"), (2, f"{shared} tail")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (120_050, 50), 2: (51, 50)}
