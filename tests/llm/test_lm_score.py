"""Scores against the same model counted in one dictionary."""

import math
from collections import Counter

import pytest

from lotsift.llm.lm_score import ADDED, MU, BackoffAutomaton, held_out, score_texts


def exact(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c, b, starts = Counter(), Counter(), 0
    for i, w in tokens:
        if not held_out(i):
            c.update(w)
            b.update(zip(["start", *w[:-1]], w, strict=True))
            starts += 1
    n, v = sum(c.values()), len(c)

    def p(w):
        return (c[w] + ADDED) / (n + ADDED * (v + 1))

    out = []
    for i, w in tokens:
        score, h = 0.0, "start"
        for x in w:
            of = starts if h == "start" else c[h]
            score += math.log10((b[(h, x)] + MU * p(x)) / (of + MU))
            h = x
        out.append((i, held_out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), score))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted((tuple(r) for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = exact([(str(i) if i is not None else None, t) for i, t in rows])
    for g, w in zip(got, sorted(want, key=lambda x: str((int(x[0]) if x[0] is not None else None, *x[1:]))), strict=True):
        assert str(g[0]) == str(w[0]) and g[1:5] == w[1:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)
    got = [r for r in score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got), "the bigram must help on texts held out"


def test_many_batches(spark, monkeypatch):
    from lotsift.llm import common, lm_score

    real = common.batches
    monkeypatch.setattr(lm_score, "batches", lambda d, k, t: real(d, k, t, 300))
    check(spark, [(i, f"the cat {i % 7} sat on the mat {i % 3}") for i in range(80)])


def test_nulls_blanks_repeated_and_null_ids(spark):
    check(spark, [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (12, "A B c")])
    rows = score_texts(spark.createDataFrame([(None, "x"), (1, "x y")], "doc_id long, text string")).collect()
    assert len(rows) == 2 and all(math.isfinite(r.score) for r in rows)


def test_empty_and_clashing_columns(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, g int, n int")
    assert score_texts(odd).count() == 1


def test_only_held_out_texts(spark):
    ids = [i for i in range(200) if held_out(i)][:3]
    rows = score_texts(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_automaton_takes_the_failure_arc():
    a = BackoffAutomaton(2, {-1 * 2 + 0: -1.0}, [-0.5, -0.25, -2.0], [-3.0, -4.0])
    assert a.score([0, 1]) == -1.0 + (-0.5 - 4.0)
    assert a.score([1]) == -2.0 - 4.0


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown word, after any history."""
    rows = [(1, "a b a c"), (2, "b a b"), (3, "c")]
    rows = [(i, t) for i, t in rows if not held_out(i)]
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    probes = [(1000 + k, w) for k, w in enumerate(vocabulary + ["zzz"])]
    probes = [(i + 10_000 * next(m for m in range(1, 500) if held_out(i + 10_000 * m)), w) for i, w in probes]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows + probes + [(next(i for i in range(10**7, 10**7 + 500) if held_out(i)), "")], "doc_id long, text string")).collect()}
    ends = [r for r in got.values() if r.n_tokens == 1]
    c = Counter(x for _, t in rows for x in [*t.split(), None])
    b = Counter(y for _, t in rows for y in zip(["start", *t.split()], [*t.split(), None], strict=True))
    n, v = sum(c.values()), len(c)
    total = sum((b[("start", w)] + MU * (c[w] + ADDED) / (n + ADDED * (v + 1))) / (len(rows) + MU) for w in [*vocabulary, None, "zzz"])
    assert total == pytest.approx(1) and len(ends) == 1


def recursive(rows, order, mu, mu_longer):
    """Scores by the recursive formula over counts of word tuples."""
    tokens = [(i, (t or "").encode().lower().split() + ["end"]) for i, t in rows]
    c, starts = Counter(), 0
    padded = lambda w: ["start"] * (order - 1) + w
    for i, w in tokens:
        if not held_out(i):
            starts += 1
            for k in range(len(w)):
                for m in range(1, order + 1):
                    c[tuple(padded(w)[k + order - m : k + order])] += 1
    n = sum(v for g, v in c.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in c)

    def p(gram):
        if len(gram) == 1:
            return (c[gram] + ADDED) / (n + ADDED * (v + 1))
        of = starts if gram[-2] == "start" else c[gram[:-1]]
        m = mu if len(gram) == 2 else mu_longer
        return (c[gram] + m * p(gram[1:])) / (of + m)

    return {i: sum(math.log10(p(tuple(padded(w)[k : k + order]))) for k in range(len(w))) for i, w in tokens}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_chain_of_failure_arcs_against_the_recursive_formula(spark, order, monkeypatch):
    import random

    from lotsift.llm import common, lm_score

    real = common.batches
    monkeypatch.setattr(lm_score, "batches", lambda d, k, t: real(d, k, t, 400))
    r = random.Random(order)
    rows = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(0, 12)))) for i in range(120)] + [(500, None)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=order, mu=7.0, mu_longer=0.5).collect()
    want = recursive(rows, order, 7.0, 0.5)
    assert len(got) == len(rows)
    for x in got:
        assert x.score == pytest.approx(want[x.doc_id], rel=1e-9), (x, want[x.doc_id])


def test_longer_histories_help_and_tell_copies_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    two, three = (score_texts(docs, order=k).where("held_out").agg({"score": "sum"}).first()[0] for k in (2, 3))
    assert three > two


def test_counts_beyond_32_bits_and_keys_in_order():
    from lotsift.llm.common import numbers, unnumbers
    from lotsift.llm.lm_score import _bucket_cuts, _within

    import numpy as np

    for values in ([2**32 + 5, 0, 7], [], [255], [256], [2**63]):
        assert unnumbers(numbers(np.array(values, dtype=np.uint64))).tolist() == values
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    cuts = _bucket_cuts(keys, 37)
    for a, b in zip(cuts, cuts[1:]):
        own = _within(keys[a:b], 37)
        assert (np.diff(own.astype(np.int64)) > 0).all()


def test_very_long_text_and_hot_id(spark):
    rows = [(1, "a b c d " * 50_000)] + [(7, "x y z")] * 300
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()
    assert len(got) == 301 and {r.n_tokens for r in got} == {200_001, 4} and len({r.score for r in got}) == 2


def test_scores_tell_texts_from_their_words_shuffled(spark):
    """Of held-out texts of twenty words or more, at least 0.9 score above the same words in another order, by the query's order."""
    import random

    from lotsift.llm.lm_score import ORDER

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(1)
    held = [(i, t) for i, t in rows if held_out(i) and t and len(t.split()) >= 20]
    # Ids that are held out as well: a shuffled text must not be learned from.
    free = (i for i in range(10**6, 2 * 10**6) if held_out(i))
    mixed = {next(free): (i, " ".join(r.sample(t.split(), len(t.split())))) for i, t in held}
    table = spark.createDataFrame([*rows, *((k, t) for k, (_, t) in mixed.items())], "doc_id long, text string")
    score = {x.doc_id: x.score for x in score_texts(table, order=ORDER).collect()}
    better = sum(score[i] > score[k] for k, (i, _) in mixed.items())
    assert len(mixed) > 50 and better >= 0.9 * len(mixed), (better, len(mixed))
