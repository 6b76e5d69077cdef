"""Gradients by differences, accuracy on documents held out, and edge cases."""

import numpy as np
import pytest

from lotsift.llm import language_id as L


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return L.train(docs)


def test_accuracy_on_held_out_documents(spark, net):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "text", "lang").collect()
    rows = [r for r in rows if L.held_out(r.doc_id)]
    found = L.predict(net, [r.text for r in rows])
    assert np.mean([f[0] == r.lang for f, r in zip(found, rows, strict=True)]) >= 0.97
    assert all(0 <= s <= 1 for _, s in found)


def test_nulls_and_texts_without_letters(net):
    assert L.predict(net, [None, "", " \n", "123 !?", "٣", "€"]) == [("und", 0.0)] * 6
    lang, score = L.predict(net, ["x"])[0]
    assert lang in net.languages and 0 < score <= 1
    long = "the thing and that " * 20_000
    assert L.predict(net, [long, "the"])[0][0] == "en"


def test_result_does_not_depend_on_company(net):
    texts = ["und die der sich", "que la los ción", "the and of"]
    alone = [L.predict(net, [t])[0] for t in texts]
    together = L.predict(net, texts)
    for a, b in zip(alone, together, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-5)


def test_query_columns(spark):
    docs = spark.createDataFrame([(i, "der und die ist nicht" if i % 2 else "the and of that with", "de" if i % 2 else "en") for i in range(40)] + [(40, None, "de"), (None, "the and", None), (41, "7", None)], "doc_id long, text string, lang string")
    got = L.languages_of(docs).collect()
    assert len(got) == 43 and {r.lang_pred for r in got} <= {"de", "en", "und"}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == L.held_out(r.doc_id)
    assert all(type(r.doc_id) is int for r in got if r.doc_id is not None)
    assert L.languages_of(docs.where("false")).count() == 0


def test_columns_pass_through(spark, net):
    rows = spark.createDataFrame([(1, "the and", 2**60 + 1, "old"), (None, None, None, None)], "doc_id long, text string, n long, lang_pred string")
    got = L.identify(rows, net).collect()
    assert got[0].n == 2**60 + 1 and got[0].lang_pred == "en" and got[1].lang_pred == "und"


def test_gradients(monkeypatch):
    """Backpropagation through time against finite differences."""
    monkeypatch.setattr(L, "SEGMENT", 7)
    net = L._new(["a", "b", "c"])
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    r = np.random.default_rng(0)
    x, y = r.integers(97, 101, (7, 5)), np.array([0, 1, 2, 0, 1])

    def loss():
        ahead, back = L._run(net.ahead, x, range(7)), L._run(net.back, x, range(6, -1, -1))
        p = L._distributions(net, ahead, back).transpose(1, 2, 0).astype(np.float64)
        return -np.log(p[:, np.arange(5), y]).mean()

    one, two = [], []
    ahead, back = L._run(net.ahead, x, range(7), one), L._run(net.back, x, range(6, -1, -1), two)
    wrong = np.ascontiguousarray(L._distributions(net, ahead, back).transpose(1, 2, 0))
    wrong[:, np.arange(5), y] -= 1
    wrong /= 35
    for d, trace in ((net.ahead, one), (net.back, two)):
        grads = L._through_time(d, x, trace, wrong @ d.out.T)
        for weights, g in zip([*d.bytes, *d.state], grads, strict=True):
            spots = [(98, 2), (99, 5)] if weights.shape[0] == 256 else [(1, 2), (6, 0)]
            for i, j in spots:
                old = weights[i, j]
                weights[i, j] = old + 1e-2
                up = loss()
                weights[i, j] = old - 1e-2
                down = loss()
                weights[i, j] = old
                assert g[i, j] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_forward_pass_against_plain_loops(net):
    """Every state and distribution by the network's equations, one number at a time."""
    data = L._segments("the and der die que, été".encode())
    x = np.ascontiguousarray(data.T).astype(np.intp)
    bend = lambda v: v / (1 + abs(v))
    states = {}
    for name, d, order in (("ahead", net.ahead, range(L.SEGMENT)), ("back", net.back, range(L.SEGMENT - 1, -1, -1))):
        h = [0.0] * L.HIDDEN
        for t in order:
            b = int(x[t, 0])
            into = [[sum(h[i] * float(w[i, j]) for i in range(L.HIDDEN)) for j in range(L.HIDDEN)] for w in d.state]
            r, z = ([0.5 + 0.5 * bend(float(d.bytes[k][b, j]) + into[k][j]) for j in range(L.HIDDEN)] for k in (0, 1))
            n = [bend(float(d.bytes[2][b, j]) + r[j] * into[2][j]) for j in range(L.HIDDEN)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(L.HIDDEN)]
            states[name, t] = h
    total = np.zeros(len(net.languages))
    for t in range(L.SEGMENT):
        v = np.array([sum(states["ahead", t][i] * float(net.ahead.out[i, k]) + states["back", t][i] * float(net.back.out[i, k]) for i in range(L.HIDDEN)) + float(net.bias[k]) for k in range(len(net.languages))])
        p = np.exp(v) / np.exp(v).sum()
        c = int(x[t, 0])
        if chr(c).isalpha() and c < 128 or c >= 128:
            total += p
    assert L._pooled(net, data)[0] == pytest.approx(total, abs=1e-3)


def test_many_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(L, "SAMPLE_ALL", 9)
    monkeypatch.setattr(L, "STEPS", 2)
    seen = []
    monkeypatch.setattr(L, "fit", lambda x, letters, labels, languages, **k: seen.append((len(labels), languages)) or L._new(languages))
    rows = [(i, "the and of that", f"l{min(i % 7, 4)}") for i in range(70)]
    L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen[0][0] == 9 and len(seen[0][1]) == 3 and "l4" in seen[0][1]


def test_many_rows_of_one_id_do_not_lose_a_language(spark, monkeypatch):
    from lotsift.llm import language_id as L

    free = next(i for i in range(1000) if not L.held_out(i))
    english = [(10_000 + i, f"the quick brown fox number {i} jumps over", "en") for i in range(3000)]
    french = [(free, f"le renard brun saute et la maison {i} est belle", "fr") for i in range(3000)]
    same = [(free, "der braune Fuchs und das Haus", "de")] * 500
    monkeypatch.setattr(L, "SAMPLE_DOCS", 40)
    seen = {}
    monkeypatch.setattr(L, "fit", lambda x, letters, labels, languages: seen.update(n=[(labels == k).sum() for k in range(len(languages))], names=languages))
    L.train(spark.createDataFrame(english + french + same, "doc_id long, text string, lang string"))
    assert seen["names"] == ["de", "en", "fr"] and seen["n"][0] == 1 and seen["n"][1] >= 40 and seen["n"][2] >= 40


def test_empty_table_repeated_and_long_rows(spark):
    from lotsift.llm import language_id as L

    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.languages_of(empty).count() == 0
    net = L._new(["de", "en"])
    rows = [(1, "ab " * 60_000), (1, "ab " * 60_000), (2, "12 !"), (3, "")]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    assert len(got) == 4 and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id > 1)
