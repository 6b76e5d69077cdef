"""Geometry by hand, tile joins against nested loops, features in and out."""

import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotsift.functions import geometry as G
from lotsift.operators import spatial
from lotsift.sources import features

SQUARE = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]]
RING = [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]]
L_SHAPE = [[[(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]]]


def test_overlap_areas():
    assert G.overlap_area(SQUARE, [[[(2, 2), (6, 2), (6, 6), (2, 6)]]]) == pytest.approx(4)
    assert G.overlap_area(SQUARE, RING) == pytest.approx(12)
    assert G.overlap_area(RING, [[[(1, 1), (3, 1), (3, 3), (1, 3)]]]) == pytest.approx(0)
    assert G.overlap_area(L_SHAPE, [[[(0, 0), (2, 0), (2, 2), (0, 2)]]]) == pytest.approx(3)
    assert G.overlap_area(SQUARE, [[[(4, 0), (6, 0), (6, 4), (4, 4)]]]) == 0
    assert G.overlap_area(None, SQUARE) == 0


def test_overlap_of_random_shapes_is_symmetric_and_bounded():
    r = random.Random(2)
    for _ in range(60):
        def shape():
            n, cx, cy = r.randrange(3, 9), r.random() * 3, r.random() * 3
            return [[[(cx + (0.5 + r.random()) * math.cos(6.283 * i / n), cy + (0.5 + r.random()) * math.sin(6.283 * i / n)) for i in range(n)]]]

        a, b = shape(), shape()
        both = G.overlap_area(a, b)
        assert both == pytest.approx(G.overlap_area(b, a), abs=1e-9)
        assert -1e-9 <= both <= min(abs(G._signed(a[0][0])), abs(G._signed(b[0][0]))) + 1e-9
        assert G.overlap_area(a, a) == pytest.approx(abs(G._signed(a[0][0])))


def by_triangles(one, two):
    """The area by clipping every pair of triangles of both, one at a time."""

    def fan(shape):
        for polygon in shape:
            for k, ring in enumerate(polygon):
                way = (1 if G._signed(ring) > 0 else -1) * (-1 if k else 1)
                for i in range(1, len(ring) - 1):
                    t = [ring[0], ring[i], ring[i + 1]]
                    if turn := G._signed(t):
                        yield way * (1 if turn > 0 else -1), t if turn > 0 else t[::-1]

    def cut(ring, t):
        for k in range(3):
            (ax, ay), (bx, by) = t[k], t[(k + 1) % 3]
            side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ring]
            out = []
            for i, p in enumerate(ring):
                if (side[i] >= 0) != (side[i - 1] >= 0):
                    f, q = side[i - 1] / (side[i - 1] - side[i]), ring[i - 1]
                    out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
                if side[i] >= 0:
                    out.append(p)
            ring = out
            if len(ring) < 3:
                return 0.0
        return G._signed(ring)

    return sum(s * t * cut(a, b) for s, a in fan(one) for t, b in fan(two))


def test_overlaps_of_a_batch_against_pairs_of_triangles():
    r = random.Random(11)

    def star(cx, cy, low, n):
        return [(cx + (low + r.random()) * math.cos(6.283185 * i / n), cy + (low + r.random()) * math.sin(6.283185 * i / n)) for i in range(n)]

    def shape():
        cx, cy, n = r.random() * 3, r.random() * 3, r.choice([3, 4, 5, 8, 13])
        polygons = [[star(cx, cy, 0.6, n), *([[(cx + 0.3 * x, cy + 0.3 * y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]] if r.random() < 0.4 else [])]]
        if r.random() < 0.3:
            polygons.append([star(cx + 6, cy, 0.2, 4)])
        if r.random() < 0.5:
            polygons = [[ring[::-1] for ring in p] for p in polygons]
        return polygons

    one, two = [shape() for _ in range(200)], [shape() for _ in range(200)]
    got = G.overlap_areas(pa.array([None, *one, one[0]], G.SHAPES), pa.array([two[0], *two, []], G.SHAPES))
    assert got[0] == got[-1] == 0
    for a, b, x in zip(one, two, got[1:], strict=False):
        assert x == pytest.approx(max(0.0, by_triangles(a, b)), abs=1e-9)


def test_polygon_overlay_and_containment(spark):
    shapes = lambda rows, names: spark.createDataFrame(rows, f"{names}, shape {G.MULTIPOLYGON}")
    plain = lambda s: [[[list(map(float, p)) for p in ring] for ring in polygon] for polygon in s]
    p = shapes([(1, plain(SQUARE)), (2, plain([[[(20, 20), (21, 20), (21, 21)]]])), (3, None)], "pid int")
    z = shapes([(1, "A", plain(RING)), (2, "B", plain(L_SHAPE)), (3, "C", plain([[[(4, 0), (9, 0), (9, 9)]]]))], "zid int, code string")
    got = {(r.pid, r.zid): (r.area, r.parcel_area) for r in spatial.polygon_overlaps(p, z).collect()}
    assert got == {(1, 1): (pytest.approx(12), 16.0), (1, 2): (pytest.approx(7), 16.0)}
    best = {r.pid: (r.actual_code, r.intersect_codes) for r in spatial.dominant(p, spatial.polygon_overlaps(p, z)).collect()}
    assert best == {1: ("A", "A | B"), 2: (None, None), 3: (None, None)}
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.5, 2.0), (3, 1.0, 1.0), (4, 50.0, 0.0)], "pid int, px double, py double")
    assert {r.pid: r.code for r in spatial.containing_polygons(points, z).collect()} == {1: None, 2: "A", 3: None, 4: None}


def test_points():
    assert G.contains(SQUARE, 1, 1) and not G.contains(SQUARE, 4, 1) and not G.contains(RING, 2, 2)
    for shape in (SQUARE, RING, L_SHAPE):
        assert G.contains(shape, *G.inside_point(shape))
    assert G.inside_point([]) is None


def test_utm_and_mercator(spark):
    row = spark.range(1).select(*G.to_utm(F.lit(30.3), F.lit(59.9), G.utm_zone(F.lit(30.3))), *G.from_web_mercator(F.lit(3372980.5), F.lit(8371966.0))).first()
    assert row[0] == pytest.approx(348967, abs=150) and row[1] == pytest.approx(6643200, abs=1500)
    assert row[2] == pytest.approx(30.3, abs=0.01) and row[3] == pytest.approx(59.9, abs=0.1)


def test_tile_join_equals_nested_loop(spark):
    r = random.Random(7)

    def boxes(n):
        return [(i, f"Z{i % 5}", x := r.randrange(-50, 50), y := r.randrange(-50, 50), x + r.randrange(0, 30), y + r.randrange(0, 30)) for i in range(n)]

    a, b = boxes(60), boxes(40)
    left = spark.createDataFrame([(p[0], *p[2:]) for p in a], "pid int, x0 int, y0 int, x1 int, y1 int")
    right = spark.createDataFrame(b, "zid int, code string, x0 int, y0 int, x1 int, y1 int")
    want = {(p[0], z[0]): max(0, min(p[4], z[4]) - max(p[2], z[2])) * max(0, min(p[5], z[5]) - max(p[3], z[3])) for p in a for z in b if p[2] <= z[4] and z[2] <= p[4] and p[3] <= z[5] and z[3] <= p[5]}
    for side in (3.0, 11.0, 500.0):
        rows = spatial.overlaps(left, right, side).collect()
        assert len(rows) == len(want) and {(x.pid, x.zid): x.area for x in rows} == want


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": SQUARE[0]}, "properties": {"physical_object_type": {"name": "Жилой дом"}, "properties": {"Количество этажей": 5}}},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": RING[0]}]}, "properties": {"physical_object_type": {"name": ""}}},
        {"type": "Feature", "geometry": None, "properties": {"physical_object_type": {"name": "Гараж"}, "Количество этажей": 0, "functional_zone_type": {"id": 7, "nickname": "", "name": "n"}}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    f = features.read_geojson(spark, str(tmp_path / "a.geojson"))
    rows = f.select("ord", features.object_text(F.col("feature")).alias("t"), G.area(features.geometry_of(F.col("feature"))).alias("a"), features.zone_code(F.col("feature")).alias("z"), features.zone_name(F.col("feature")).alias("n")).orderBy("ord").collect()
    assert [r.t for r in rows] == ["Жилой дом, 5 этажей", "неизвестный объект", "Гараж"]
    assert [r.a for r in rows] == [16.0, 12.0, None]
    assert (rows[2].z, rows[2].n) == ("7", "n")
    out = f.select("ord", features.geometry_of(F.col("feature")).alias("g"))
    features.write_geojson_lines(out, "g", str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(b["properties"]["ord"] for b in back) == [0, 1, 2] and back[0]["geometry"]["type"] == "MultiPolygon"
    assert features.format_of("X.GPKG") == "gpkg" and features.format_of(None) == "geojson"


def test_places_are_compared_once_whatever_their_copies(spark):
    p = spark.range(300).selectExpr("id as pid", "id % 3 * 10 as x0", "0L as y0", "id % 3 * 10 + 8 as x1", "8L as y1")
    z = spark.range(200).selectExpr("id as zid", "concat('Z', id % 5) as code", "id % 2 * 5 as x0", "0L as y0", "id % 2 * 5 + 10 as x1", "6L as y1")
    compared = []

    def meet(one, two):
        out = spatial.overlaps(one, two)
        compared.append((one.count(), two.count(), out.count()))
        return out

    got = spatial.dominant_alike(p, z, meet, *spatial.BOX)
    assert compared == [(3, 2, 4)], "three places of parcels, two of zones"
    want = spatial.dominant(p, spatial.overlaps(p, z))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r["actual_zid"] for r in got.collect() if r["pid"] % 3 == 0} == {0}, "the first zone of the place stands for its copies"


def test_points_at_one_place_meet_zones_once(spark):
    points = spark.range(400).selectExpr("id as pid", "id % 2 * 50.0D + 5 as px", "5.0D as py").union(spark.sql("select 400L, cast(null as double), 1.0D"))
    z = spark.range(300).selectExpr("id as zid", "concat('Z', id) as code", "0L as x0", "0L as y0", "10L as x1", "10L as y1")
    placed = spatial.containing(points, z)
    assert placed.count() == 401
    assert {(r["pid"] % 2 if r["pid"] < 400 else None, r["zid"], r["code"]) for r in placed.collect()} == {(0, 0, "Z0"), (1, None, None), (None, None, None)}
    assert spatial.first_alike(z, *spatial.BOX).count() == 1


def test_parcels_of_one_key_are_one_row_as_in_sql(spark, sf_dir, tmp_path):
    import duckdb

    from lotsift.plans.catalogue import ORACLES, QUERIES

    c = duckdb.connect()
    # Its join of inequalities loses rows that match nothing; the plain loop keeps them.
    c.execute("set nested_loop_join_threshold=1000000000")
    c.execute(f"copy (from '{sf_dir}/supplier.parquet') to '{tmp_path}/supplier.parquet'")
    some = "case when p_partkey % 9 = 0 then null else p_partkey end as p_partkey"
    c.execute(f"copy (select * replace ({some}) from '{sf_dir}/part.parquet' union all select * replace (p_size + 99 as p_size) from '{sf_dir}/part.parquet' where p_partkey % 4 = 0) to '{tmp_path}/part.parquet'")
    for t in ("part", "supplier"):
        c.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    want = c.execute(ORACLES["q96_point_in_polygon"]).fetchall()
    assert any(z is None for _, z, _ in want) and any(z is not None for _, z, _ in want)
    assert sorted(map(str, map(tuple, QUERIES["q96_point_in_polygon"](spark, str(tmp_path)).collect()))) == sorted(map(str, want))
