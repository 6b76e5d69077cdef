"""Collocations against plain counting of all phrases; bitmaps against positions."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotsift.llm import phrases as P


def brute(rows, least, best):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cands.items():
        inner = {(lang, w[i : i + k]) for k in range(2, len(w)) for i in range(len(w) - k + 1)}
        gone |= {p for p in inner if 100 * a >= 80 * f[p]}
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in gone:
            cuts = [(int(Fraction(2000000 * a, f[lang, w[:k]] + f[lang, w[k:]])), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:best], 1))


def check(spark, rows, least=3, best=50, **more):
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in P.collocations(docs, least=least, best=best, **more).collect())
    want = brute(rows, least, best)
    assert got == want
    return got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_shift_and_popcount(line):
    line = np.array(line)
    maps = P.Bitmaps(line)
    assert int(np.bitwise_count(maps.bits).sum()) == (line > 0).sum()
    phrase, word, _, bits = maps.extended(maps.word, maps.byte, maps.bits)
    got = Counter()
    for p, w, b in zip(phrase.tolist(), word.tolist(), np.bitwise_count(bits).tolist(), strict=True):
        got[p, w] += b
    assert got == Counter((a, b) for a, b in zip(line[:-1].tolist(), line[1:].tolist(), strict=True) if a and b)


def test_whole_small_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert len(check(spark, rows, least=8, best=2000)) > 100


def test_many_shards_and_stretches(spark, sf_dir, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").limit(60).collect()]
    monkeypatch.setattr(P, "STRETCH", 50)
    monkeypatch.setattr(P, "BUCKET_TEXT_BYTES", 20_000)
    check(spark, rows, least=4, shard_bytes=6000)


def test_pieces_overlaps_cuts_and_covered_phrases(spark):
    rows = [("en", "a a a a a. a a"), ("en", "new york city; New York\tcity\nnew york. York"), ("en", "new york city"), ("fr", "new york, city"), (None, "x y x y x y x y"), ("und", "x y")]
    got = check(spark, rows, least=2)
    assert ("en", "new york city", 3) in {(r[0], r[2], r[3]) for r in got}
    assert not any(r[2] == "york city" for r in got), "within a longer phrase as frequent"
    assert {r[0] for r in got} == {"en", "und"}


def test_ties_rank_by_bytes_and_cuts_by_place(spark):
    rows = [("en", "é z. z é. ab cd. Ab Cd. b c d. b c d. É z É z. z é")] * 3
    check(spark, rows, least=3)
    assert [r[1] for r in check(spark, rows, least=3, best=2)] == [1, 2]


def test_ranks_are_made_in_rounds(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(3))
    rows = [("en", " ".join(f"w{k}" for k in r.integers(0, 30, 400))) for _ in range(20)]
    monkeypatch.setattr(P, "RANKED", 40)
    check(spark, rows, least=3, best=10)


def test_scores_of_more_than_64_bits():
    a, beside = np.array([9 * 10**15, 30], dtype=np.int64), np.array([2 * 10**16, 61], dtype=np.int64)
    assert P.scores(a, beside).tolist() == [900_000, 983_606]


def test_nulls_repeats_long_empty_and_clashing_names(spark):
    long = "one two three four five " * 3000
    check(spark, [("en", None), ("en", ""), ("en", " \t. ,"), (None, long), (None, long), ("", "q r q r q r"), ("de", "\x00 \x1c a b c \x00 \x1c a b c \x00 \x1c")], least=2)
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    odd = spark.createDataFrame([("en", "g h " * 40, "x", 3, 4.0)], "lang string, text string, phrase string, n int, key double")
    assert [r.phrase for r in P.collocations(odd).collect()][:1] == ["g h g h"] or P.collocations(odd).count() > 0
