"""Segments against all segments, extreme values against formulas, labels of documents held out."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotsift.llm import toxicity as T


def maximal(s):
    """The best segment, then the same left and right of it: the definition of maximal scoring segments."""
    if not len(s):
        return []
    best = max(((sum(s[i : j + 1]), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i, len(s))), default=None)
    if best[0] <= 0:
        return []
    i, j = best[3:]
    return maximal(s[:i]) + [(i, j, best[0])] + [(a + j + 1, b + j + 1, x) for a, b, x in maximal(s[j + 1 :])]


def close(got, want):
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert [x[:2] for x in got] == [x[:2] for x in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9).filter(bool), max_size=24))
def test_segments_are_the_maximal_ones(numbers):
    # Small different fractions, so that no two segments tie.
    s = [x + 1e-4 * 2.0 ** -k for k, x in enumerate(numbers)]
    close(T.segments(np.array(s)), maximal(s))


def test_segments_take_linear_time_on_long_rising_and_falling_texts():
    n = 200_000
    rising = np.tile([1.0, -0.5], n)
    assert len(T.segments(rising)) == 1
    falling = np.tile([1.0, -1.5], n)
    assert len(T.segments(falling)) == n


def test_lambda_and_chance():
    values, shares = np.array([1.0, -1.0]), np.array([0.2, 0.8])
    assert T.lowest_root(values, shares) == pytest.approx(math.log(4), rel=1e-6)
    m = T.Model({}, 1.0, 0.5, 0.0, 1.0)
    assert m.chance(2.0, 10) == pytest.approx(5 * math.exp(-2))
    assert m.evidence([0.1, 9.0], 10) == pytest.approx(9 - math.log(5))


def test_priors_come_down_the_stem():
    table = T.odds_table({"bad": (0, 50), "badge$": (40, 0), "badly$": (0, 9), "the$": (900, 100)}, 900, 100)
    assert table["bad"] > 3 and table["badge$"] < 0
    assert "badly$" not in table and "the$" not in table, "their counts are as the stem's or the corpus'"
    scores = T.TokenScores(table)
    assert scores["badly"] == scores["badness"] == table["bad"] - T.DRIFT and scores["other"] == -T.DRIFT


def test_logistic_curve():
    x = np.repeat([0.0, 10.0], 50)
    a, b = T.logistic(x, (x > 5).astype(float))
    assert a < 0 < b and 1 / (1 + math.exp(-a - b * 10)) > 0.9


def test_tokens():
    assert T.tokens_of("Ab,c ÈT\tx_y!") == ["ab", "c", "èt", "x", "y"] and T.tokens_of(None) == T.tokens_of(" ") == []


BAD, FINE = ["moronic", "moron", "scummy"], [f"{a}{b}" for a in ("lorem", "ipsum", "dolor", "sit") for b in ("us", "a", "it", "o", "e")]


def corpus(n=600):
    r = np.random.Generator(np.random.PCG64(1))
    rows, labels = [], []
    for i in range(n):
        words = list(r.choice(FINE, 60))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                words[int(r.integers(60))] = BAD[int(r.integers(3))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return T.toxicity_of(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_finds_toxic_texts_held_out_and_leaves_others(spark):
    rows, labels = corpus()
    got = run(spark, rows, labels)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == int(r.doc_id % 6 == 0), r
        words = T.tokens_of(text[r.doc_id])
        assert r.n_tokens == len(words)
        if r.predicted:
            assert r.passages and all(words[p["first"]] in BAD and words[p["last"]] in BAD for p in r.passages)


def test_labels_held_out_are_never_learned(spark):
    rows, labels = corpus(240)
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert sorted(run(spark, rows, labels)) == sorted(run(spark, rows, wrong))


def test_nulls_long_ties_repeats(spark):
    rows, labels = corpus(240)
    long = " ".join(FINE * 3000)
    odd = [(None, "moron moronic scummy moron"), (1000, None), (1001, ""), (1002, " ,.!"), (1003, long), (1004, long + " moron scummy moronic moron"), (6, "moron scummy moron")]
    more = [(None, 1, 1), (3, 1, None), (3, 1, 7), (9, 1, 0), (9, 1, 0), (99999, 0, 1)]
    got = run(spark, rows + odd + odd, labels + more)
    assert len(got) == len(rows) + 2 * len(odd)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_tokens), set()).add((r.score, r.predicted, r.held_out))
    assert all(len(v) == 1 for v in by.values()), "equal rows have equal results"
    assert {next(iter(v))[1] for k, v in by.items() if k[0] in (1000, 1001, 1002, 1003)} == {0}
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert [r.predicted for r in got if r.doc_id in (None, 1004)] == [1] * 4
    assert all(len(r.passages) == 1 for r in got if r.doc_id == 1004), "the passage at the end of a long text"


def test_empty_tables_one_label_and_clashing_names(spark):
    assert run(spark, [], []) == []
    assert all(r.score == 0.5 for r in run(spark, [(1, "a"), (2, None)], []))
    rows, labels = corpus(120)
    assert {r.predicted for r in run(spark, rows, [(i, 0, 0) for i, _ in rows])} == {0}
    docs = spark.createDataFrame([(1, "a b", 7, "x", 2.0, "h")], "doc_id long, text string, score int, toxic string, id double, h string")
    labels = spark.createDataFrame([(1, 0, "y")], "doc_id long, toxic int, text string")
    assert T.toxicity_of(docs, labels).columns == ["doc_id", "held_out", "score", "predicted", "n_tokens", "passages"]
    assert T.toxicity_of(docs, labels).count() == 1
    kept = T.toxic_passages(docs, T.Model({}, 1.0, 1.0, 0.0, 1.0))
    assert kept.columns == ["doc_id", "text", "toxic", "id", "h", "n_tokens", "passages", "score", "predicted"] and kept.first().score == 0.5


def test_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.toxicity_of(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.93 * len(rows) and rows
