"""The transducer against the library that defines the result."""

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lotsift.llm.sentencepiece_fst import DEFAULT_MODEL, Normaliser, Transducer, _read, decode_ids, encode_texts

HARD = ["", " ", "  ", "a  b   c\n\n d\t\x00x", "日本語テキスト 漢字", "😀 emoji▁mark", "<s> </s> <0x0A> <unk>", " lead", "trail ", "⁇", "a" * 700, " " * 70, "\r\n", "▁▁x", "x▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


@pytest.fixture(scope="module")
def own():
    return Transducer(_read(DEFAULT_MODEL))


def same(own, library, text):
    ids = np.frombuffer(own.encode(text), "<i4").tolist()
    assert ids == library.encode(text)
    assert own.decode(own.encode(text)) == library.decode(ids)


def test_hard_texts(own, library):
    for text in HARD:
        same(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abc dehto ▁\nTé中<>0x12.,;") + ["the", "ing", " ", "tion"]), max_size=60).map("".join))
def test_random_texts(text):
    own, library = test_random_texts.pair
    same(own, library, text)


test_random_texts.pair = None


@pytest.fixture(autouse=True)
def _pair(own, library):
    test_random_texts.pair = (own, library)


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in encode_texts(docs, decoded=True).collect():
        assert np.frombuffer(r.ids, "<i4").tolist() == library.encode(r.text)
        assert r.decoded == r.text and r.source is not None


def test_nulls_columns_and_decode(spark):
    rows = spark.createDataFrame([(1, None, b"old"), (2, "", b"old"), (2, "", b"old"), (None, "x y", None)], "doc_id long, text string, ids binary")
    got = encode_texts(rows)
    assert got.columns == ["doc_id", "text", "ids"]
    back = sorted(str((r.text, r.decoded)) for r in decode_ids(got).collect())
    assert back == ["('', '')", "('', '')", "('x y', 'x y')", "(None, None)"]
    assert encode_texts(rows.where("doc_id = 9")).count() == 0


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            import struct

            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3, value])
    return out


def test_unigram_model_takes_the_lightest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -5.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -2.5, 1), ("ba", -9.0, 1)]
    model = b"".join(_message((1, _message((1, n.encode()), (2, s), (3, k)))) for n, s, k in pieces)
    model += _message((2, _message((3, 1))), (3, _message((3, 1), (4, 0))))
    t = Transducer(model)
    scores = {n: s for n, s, k in pieces if k == 1}
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("ab ") for _ in range(r.randrange(1, 9)))
        shown = "▁" + text.replace(" ", "▁")

        def best(s):
            return 0.0 if not s else max((scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=-1e9)

        ids = np.frombuffer(t.encode(text), "<i4").tolist()
        assert "".join(pieces[i][0] for i in ids) == shown
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best(shown))


def merged(ids, scores, text):
    """Merging by its definition."""
    symbols = list(text)
    while True:
        pairs = [(-scores[ids[a + b]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in ids]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_arcs_weigh_what_merging_says(own):
    r = random.Random(5)
    names = sorted(own.ids)
    short = [n for n in names if len(n) <= 4]
    told = {0.0: 0, float("inf"): 0}
    for k in range(6000):
        a, b = r.choice(short if k % 2 else names), r.choice(short if k % 3 else names)
        if merged(own.ids, own.scores, a) != [a]:
            continue
        weight = own._weight(own.ids[a], own.ids[b])
        assert (weight == 0.0) == (merged(own.ids, own.scores, a + b) == [a, b]), (a, b)
        told[weight] += 1
    assert min(told.values()) > 100


def test_one_segmentation_of_finite_weight(own, library):
    """Of all ways to cut a short text into pieces and fallback bytes, one has neighbours that merging leaves apart: the result."""
    r = random.Random(6)

    def ways(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            if s[:k] in own.ids or (k == 1 and s not in own.ids):
                for rest in ways(s[k:]):
                    yield [s[:k], *rest]

    def finite(way):
        whole = all(merged(own.ids, own.scores, p) == [p] for p in way)
        return whole and all(merged(own.ids, own.scores, a + b) == [a, b] for a, b in zip(way, way[1:], strict=False))

    for _ in range(150):
        text = "".join(r.choice(["t", "h", "e", "in", "g", " ", "s", "😀", "an", "o", "n"]) for _ in range(r.randrange(1, 7)))
        good = [w for w in ways(own.normaliser.write(" " + text)) if finite(w)]
        assert len(good) == 1
        ids = [i for p in good[0] for i in ([own.ids[p]] if p in own.ids else own._fallback(p))]
        assert ids == np.frombuffer(own.encode(text), "<i4").tolist() == library.encode(text)


def test_normaliser_by_its_arcs():
    assert Normaliser(True).write("  a▁ b ") == "▁a▁b" and Normaliser(False).write(" a  ") == "▁a▁▁"


def test_results_kept_are_bounded_and_right(own, monkeypatch):
    monkeypatch.setattr("lotsift.llm.sentencepiece_fst.KEPT_BYTES", 4000)
    fresh = Transducer(_read(DEFAULT_MODEL))
    text = " ".join(f"word{i % 97} x{i}" for i in range(3000)) + " " + "y" * 90
    assert fresh.encode(text) == own.encode(text)
    assert len(fresh.paths) + len(fresh.paths.old) < 100 and "y" * 90 not in str(fresh.paths)


def test_very_long_ties_repeats_and_clashing_columns(spark, library):
    long = "ab cd " * 200_000 + "e" * 50_000
    rows = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, "e", "b"), (2, "e", "b")], "doc_id long, text string, decoded string")
    got = encode_texts(rows, decoded=True).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 2]
    for r in got:
        assert np.frombuffer(r.ids, "<i4").tolist() == library.encode(r.text) and r.decoded == library.decode(library.encode(r.text))
