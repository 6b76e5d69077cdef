import random

import numpy as np
import pytest

from lotsift.llm import common as C


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in parent:
        assert got.get(x, x) == find(x)
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_hashes_name_equal_windows():
    r = np.random.default_rng(1)
    h = r.integers(0, 5, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = C.WindowHashes().of(h, 4)
    names = {}
    for i, g in enumerate(got.tolist()):
        assert names.setdefault(tuple(h[i : i + 4].tolist()), g) == g
    assert len(set(names.values())) == len(names)


def test_planes_round_trip():
    for width, top in ((4, 2**32), (6, 2**48), (8, 2**63)):
        x = np.random.default_rng(width).integers(0, top, 100).astype(np.uint64)
        assert (C.unplanes(C.planes(x, width), width) == x).all()
    assert len(C.unplanes(C.planes(np.array([], dtype=np.uint64)))) == 0


def test_words_and_cache():
    assert C.words_of(" a\x0bb\x0c\tc d\x1ce ") == [b"a", b"b", "c d\x1ce".encode()]
    assert C.lower_words_of("ÀB") == ["Àb".encode()]
    h = C.WordHashes(limit=2)
    assert [int(x) for x in h.of([b"a", b"b", b"c", b"a"])][0] == int(h.of([b"a"])[0])


def test_shared_folder_must_be_named_on_a_cluster(spark):
    assert C.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
