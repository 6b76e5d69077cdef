"""Repaired shapes against even-odd covers, overlays and tiles against nested loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotsift.functions import geometry as G
from lotsift.functions import repair as R
from lotsift.functions.clipping import SHAPES, overlap_areas
from lotsift.operators import overlay

BOW_TIE = [[[(0, 0), (10, 10), (10, 0), (0, 10)]]]
TWO_PARTS = [[[(0, 0), (6, 0), (6, 10), (0, 10)]], [[(2, 0), (8, 0), (8, 10), (2, 10)]]]
WITH_HOLE = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]]


def size(shape):
    return sum(abs(R._signed(np.array(r[0]))) - sum(abs(R._signed(np.array(h))) for h in r[1:]) for r in shape or [])


def fixed(*shapes):
    return R.repaired(pa.array(shapes, SHAPES)).to_pylist()


def cover(shape, x, y):
    """Points that an odd number of some polygon's rings go round."""
    out = np.zeros(len(x), dtype=bool)
    for polygon in shape or []:
        odd = np.zeros(len(x), dtype=bool)
        for ring in polygon:
            p = np.array(ring, dtype=float)
            for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
                if a[1] != b[1]:
                    odd ^= ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
        out |= odd
    return out


def test_known_shapes():
    bow, two, hole, nothing, flat = fixed(BOW_TIE, TWO_PARTS, WITH_HOLE, None, [[[(0, 0), (1, 1), (2, 2)]]])
    assert size(bow) == 50 and len(bow) == 2
    assert size(two) == 80 and len(two) == 1 and len(two[0][0]) == 5, "no points where parts met"
    assert hole == [[[list(map(float, p)) for p in r] for r in WITH_HOLE[0]]], "a valid shape stays as it is"
    assert nothing is None and flat is None
    part, = fixed([[[(0, 0), (10, 0), (10, 10), (0, 10)], [(5, 5), (15, 5), (15, 8), (5, 8)]]])
    assert size(part) == 100, "what a hole has outside its shell is covered once"
    inner, = fixed([[[(0, 0), (9, 0), (9, 9), (0, 9)]], [[(2, 2), (4, 2), (4, 4), (2, 4)]]])
    assert size(inner) == 81 and len(inner) == 1
    touching, = fixed([[[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 1), (1, 2)]]])
    assert size(touching) == pytest.approx(14.5)


@pytest.mark.parametrize("kind", ["grid", "free", "far"])
def test_random_rings_cover_the_same(kind):
    r = random.Random(kind)

    def point():
        x, y = (r.randrange(9), r.randrange(9)) if kind == "grid" else (r.random() * 9, r.random() * 9)
        return (x + 6e6, y + 3e5) if kind == "far" else (x, y)

    raw = [[[[point() for _ in range(r.randrange(3, 9))] for _ in range(r.randrange(1, 3))] for _ in range(r.randrange(1, 4))] for _ in range(250)]
    g = np.random.default_rng(1)
    x, y = g.random(1500) * 9, g.random(1500) * 9
    x, y = (x + 6e6, y + 3e5) if kind == "far" else (x, y)
    found = fixed(*raw)
    for shape, out in zip(raw, found, strict=True):
        assert (cover(shape, x, y) != cover(out, x, y)).mean() <= (0.002 if kind == "far" else 0)
        # Polygons that don't overlap have areas that add up to what is covered.
        assert size(out) / 81 == pytest.approx(cover(shape, x, y).mean(), abs=0.06)
    again = R.repaired(pa.array(found, SHAPES)).to_pylist()
    assert [size(a) for a in again] == pytest.approx([size(a) for a in found], abs=1e-6)


def test_areas_of_repaired_shapes():
    assert overlap_areas(R.repaired(pa.array([BOW_TIE, TWO_PARTS], SHAPES)), pa.array([[[[(0, 0), (10, 0), (10, 10), (0, 10)]]]] * 2, SHAPES)).tolist() == [50, 80]
    one, two = pa.array([BOW_TIE, WITH_HOLE, BOW_TIE], SHAPES), pa.array([[[[(0, 0), (2, 0), (2, 2), (0, 2)]]], [[[(0, 0), (20, 0), (20, 20), (0, 20)]]]], SHAPES)
    which = np.array([1, 0, 0])
    one = R.repaired(one)
    assert overlap_areas(one, two, which).tolist() == overlap_areas(one, two.take(pa.array(which))).tolist()


def test_touch_and_cover():
    square = [[[(0, 0), (4, 0), (4, 4), (0, 4)]]]
    others = [[[[(4, 0), (6, 0), (6, 4), (4, 4)]]], [[[(4, 4), (6, 4), (6, 6)]]], [[[(4.1, 0), (6, 0), (6, 4)]]], [[[(1, 1), (2, 1), (2, 2)]]], [[[(2, 4), (3, 5), (1, 5)]]]]
    assert R.touch(pa.array([square] * 5, SHAPES), pa.array(others, SHAPES)).tolist() == [True, True, False, False, True]
    assert R.touch(pa.array([square] * 2, SHAPES), pa.array(others, SHAPES), np.array([2, 1])).tolist() == [False, True]
    x, y = np.array([2.0, 0.5, 0.0, 5.0, 4.0]), np.array([2.0, 0.5, 1.0, 5.0, 4.0])
    assert R.covers(pa.array([WITH_HOLE], SHAPES), x, y, np.zeros(5, dtype=int)).tolist() == [False, True, False, False, False]
    r = random.Random(3)
    for _ in range(40):
        shape = [[[(r.randrange(6), r.randrange(6)) for _ in range(6)]]]
        x, y = np.array([r.randrange(12) / 2 for _ in range(60)]), np.array([r.randrange(12) / 2 for _ in range(60)])
        want = [G.contains(shape, a, b) for a, b in zip(x, y, strict=True)]
        assert R.covers(pa.array([shape] * 60, SHAPES), x, y).tolist() == want


def test_points_inside_are_inside():
    r = random.Random(4)
    shapes = [[[[(r.random(), r.random()) for _ in range(r.randrange(3, 7))] for _ in range(2)] for _ in range(r.randrange(1, 3))] for _ in range(200)] + [None, []]
    for shape, (x, y) in zip(shapes, R.points_inside(pa.array(shapes, SHAPES)).tolist(), strict=True):
        want = G.inside_point(shape)
        assert (want is None and x != x) or (x, y) == pytest.approx(want)


def boxes(n, seed, wide=()):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, h = r.choice([0, 1, 3, 17, 200]), r.choice([0, 1, 2, 40])
        x, y = r.randrange(-300, 300), r.randrange(-300, 300)
        out.append((i, *map(float, (x, y, x + w, y + h))))
    return out + [(n + k, *map(float, (-s, -s, s, s))) for k, s in enumerate(wide)]


def test_boxes_of_all_sizes_meet_as_in_a_nested_loop(spark):
    a, b = boxes(150, 1, (10**6,)), boxes(120, 2, (10**9, 5))
    left = spark.createDataFrame(a, "pid long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "zid long, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in overlay.meeting(left, right).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want
    tiles = overlay._on_tiles(right, []).groupBy("zid").count().agg(F.max("count")).first()[0]
    assert tiles <= 4, "a zone of any size lies on four tiles at most"


PARCELS = [
    (1, [[[(0, 0), (4, 0), (4, 4), (0, 4)]]]),
    (2, BOW_TIE),
    (3, [[[(100, 100), (101, 100), (101, 101)]]]),
    (4, TWO_PARTS),
    (5, None),
    (6, [[[(20, 0), (24, 0), (24, 4), (20, 4)]]]),
]
ZONES = [
    (10, " A ", [[[(-2, 0), (3, 0), (3, 4), (-2, 4)]]]),
    (11, "B", [[[(4, 0), (8, 0), (8, 4), (4, 4)]]]),
    (12, "C", [[[(3, -5), (5, -5), (5, 9), (3, 9)]]]),
    (13, "nan", [[[(21, 1), (22, 1), (22, 2), (21, 2)]]]),
    (14, "A", [[[(24, 4), (30, 4), (30, 8)]]]),
]
SHAPE = "array<array<array<array<double>>>>"


def layer(spark, rows, schema):
    as_lists = [tuple([[[list(map(float, p)) for p in ring] for ring in polygon] for polygon in v] if isinstance(v, list) else v for v in r) for r in rows]
    return spark.createDataFrame(as_lists, schema)


def attributes(spark, parcels, zones):
    p = layer(spark, [(*r, "Жилая застройка") for r in parcels], f"pid long, shape {SHAPE}, use string")
    return {r.pid: r for r in overlay.zone_attributes(p, layer(spark, zones, f"zid long, code string, shape {SHAPE}"), use="use").collect()}


def test_touching_zones_and_blank_codes(spark):
    got = attributes(spark, PARCELS, ZONES)
    assert (got[1].actual_code, got[1].n_codes, got[1].intersect_codes, got[1].area, got[1].share) == ("A", 3, "A | C | B", 12, 0.75)
    assert got[1].note == overlay.MULTIPLE
    assert (got[3].n_codes, got[3].actual_code, got[3].note, got[3].intersect_codes) == (0, None, None, None)
    assert got[5].n_codes == 0 and got[5].note is None
    assert (got[6].actual_code, got[6].n_codes, got[6].intersect_codes, got[6].area) == (None, 1, "A", 1), "a zone without a code can be the largest one"
    assert got[2].note == overlay.BELOW_SHARE and got[4].n_codes == 3
    assert got[1].comparison_key == got[1].zone_key + " || A | C | B" and got[1].zone_key.endswith(" || A")
    assert got[3].comparison_key.endswith(" ||  || ")


def test_a_layer_that_meets_nothing(spark):
    got = attributes(spark, PARCELS[2:3], ZONES)
    assert got[3].note == overlay.NONE_AT_ALL and got[3].n_codes == 0
    assert attributes(spark, [], ZONES) == {}


def test_zones_of_many_pairs_are_split(spark, monkeypatch):
    r = random.Random(8)
    parcels = [(i, [[[(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)]]]) for i in range(80) for x, y in [(r.randrange(50), r.randrange(50))]]
    p = layer(spark, parcels, f"pid long, shape {SHAPE}")
    z = layer(spark, [*ZONES, (15, "W", [[[(-5, -5), (60, -5), (60, 60), (-5, 60)]]])], f"zid long, code string, shape {SHAPE}")
    want = sorted(tuple(x) for x in overlay.fragments(p, z).collect())
    monkeypatch.setattr(overlay, "PAIRS", 7)
    assert sorted(tuple(x) for x in overlay.fragments(p, z).collect()) == want
    assert sum(x[1] == 15 for x in want) == 80
    dots = spark.createDataFrame([(i, float(i % 9) + 0.5, float(i % 7) + 0.5) for i in range(90)], "pid long, px double, py double")
    got = {(x.px, x.py): x.zid for x in overlay.first_holding(dots, z).collect()}
    for (x, y), zid in got.items():
        assert zid == min((k for k, _, s in ZONES if G.contains(s, x, y)), default=15)


def test_equal_areas_tie_whatever_way_they_are_clipped(spark):
    # Both zones cover the whole parcel; one is clipped in triangles, whose areas add up to a little more or less.
    parcel = [[[(0.1, 0.1), (13.4, 0.1), (13.4, 7.3), (0.1, 7.3)]]]
    box = [[[(-1.0, -1.0), (20.0, -1.0), (20.0, 9.0), (-1.0, 9.0)]]]
    stepped = [[[(-3.0, -3.0), (33.0, -3.0), (33.0, 7.7), (29.1, 7.7), (29.1, 31.0), (-3.0, 31.0)]]]
    p = spark.createDataFrame([(k, parcel) for k in range(3)], f"pid bigint, shape {G.MULTIPOLYGON}")
    for codes in (("A", "B"), ("B", "A")):
        z = spark.createDataFrame([(1, codes[0], box), (2, codes[1], stepped)], f"zid bigint, code string, shape {G.MULTIPOLYGON}")
        rows = overlay.zone_attributes(p, z).collect()
        assert {(r["actual_code"], r["intersect_codes"]) for r in rows} == {("A", "A | B")} and len(rows) == 3


def test_areas_settle_on_a_grid_that_keeps_exact_ones():
    own = np.array([760.0, 760.0, 0.0])
    assert overlay._settled(np.array([418.5000000001, 0.0625, 3.0]), own).tolist() == [418.5, 0.0625, 3.0]
