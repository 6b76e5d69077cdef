"""Matches against the full table of edit distances."""

import random

import numpy as np
import pytest

from lotsift.llm.decontaminate import Matcher, Pattern, budget, contaminations, normal, pieces


def distances(item, text):
    """Least distance of the item to a passage that ends at each place."""
    row = list(range(len(item) + 1))
    out = [row[-1]]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        out.append(row[-1])
    return np.array(out)


@pytest.mark.parametrize("seed", range(60))
def test_myers_equals_the_table(seed):
    r = random.Random(seed)
    item = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
    text = "".join(r.choice("abcd") for _ in range(r.randrange(0, 200)))
    want = distances(item, text)[1:] if text else np.array([], dtype=int)
    got = Pattern(item).ends(text, len(item))
    if len(want) and want.min() <= len(item):
        assert got == (want.min(), int(want.argmin()) + 1)


def damage(r, text, edits):
    for _ in range(edits):
        k = r.randrange(len(text))
        kind = r.randrange(3)
        text = text[:k] + ("#" if kind < 2 else "") + text[k + (kind != 1) :]
    return text


@pytest.mark.parametrize("seed", range(25))
def test_all_passages_within_the_budget_are_found(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "rho", "tau", "of", "the"]
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(4)]
    matcher = Matcher(items)
    text = " ".join(r.choice(words) for _ in range(60))
    for k, item in items:
        text += " " + damage(r, item, r.randrange(0, budget(item) + 3)) + " " + " ".join(r.choice(words) for _ in range(20))
    found = {m[0]: m for m in matcher.matches(text)}
    for k, item in items:
        d = distances(item, normal(text))
        if d.min() <= budget(item):
            assert found[k][1] == d.min() and found[k][3] == int(d.argmin())
            _, least, start, end = found[k]
            assert distances(item, normal(text)[start:end])[-1] == least
        else:
            assert k not in found


def test_pieces_cover_the_item():
    for n in (1, 5, 12, 13, 100, 333):
        item = "x" * n
        parts = pieces(item)
        assert len(parts) == budget(item) + 1 and "".join(p for _, p in parts) == item and all(p for _, p in parts)


def test_query_on_rows(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in contaminations(docs, items).collect()}
    texts = {r.doc_id: normal(r.text) for r in docs.collect()}
    bench = [(r.item_id, normal(r.text)) for r in items.collect()]
    assert {(d, i) for d, t in texts.items() for i, b in bench if b in t} <= got
    for d, i in got:
        item = dict(bench)[i]
        assert distances(item, texts[d]).min() <= budget(item)


def test_slices_nulls_and_columns(spark, monkeypatch):
    import lotsift.llm.decontaminate as D

    monkeypatch.setattr(D, "SLICE_BYTES", 30)
    items = spark.createDataFrame([(1, "a quick brown fox jumps"), (2, None), (3, "  "), (1, "a quick brown fox jumps"), (4, "over the lazy dogs now")], "item_id int, text string")
    docs = spark.createDataFrame(
        [(1, "so A QUICK  brown\nfox jumps it", 5), (2, None, 5), (3, "", 5), (3, "over the lazy dog now", 5), (None, "over the lazy dogs now", 5)], "doc_id long, text string, item int"
    )
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in contaminations(docs, items).collect())
    assert got == [(0, 4, 0), (1, 1, 0), (1, 1, 0), (3, 4, 1)]
    assert contaminations(docs.where("false"), items).count() == 0
    assert contaminations(docs, items.where("false")).count() == 0


def test_very_long_texts_and_empty_tables(spark):
    from lotsift.llm.decontaminate import contaminations

    item = "the quick brown fox jumps over the lazy dog while nobody looks at it"
    long = "filler words stand here " * 40_000
    docs = spark.createDataFrame([(1, long + item + " " + long), (2, long), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = contaminations(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, 7, 0)]
    assert contaminations(docs.limit(0), items).count() == 0 == contaminations(docs, items.limit(0)).count()
