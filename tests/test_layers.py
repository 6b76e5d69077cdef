"""Layers of every format with two points near St. Petersburg in EPSG:3857, and what the GeoPackage source reads."""

import math
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith

from lotsift.functions.geometry import from_utm, to_utm
from lotsift.sources import gpkg, vector_files

WHERE = {"a": (30.3, 59.9), "b": (30.4, 60.0)}


def mercator(lon, lat):
    return 6378137.0 * math.radians(lon), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def wkb(x, y):
    return struct.pack("<BIdd", 1, 1, x, y)


def box_wkb(x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<dd", *p) for p in ring)


def write_gpkg(path, rows, crs=3857, index=True, header=1):
    """rows: (name, height, flag, well-known binary or None, box)."""
    db = sqlite3.connect(path)
    db.executescript(
        """create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer);
        create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer);
        create table "the layer" (fid integer primary key, geom blob, name text(20), height double, flag boolean, "odd""one" integer);"""
    )
    db.execute("insert into gpkg_spatial_ref_sys values ('x', 1, 'epsg', ?)", (crs,))
    db.execute("insert into gpkg_geometry_columns values ('the layer', 'geom', 'GEOMETRY', 1, 0, 0)")
    if index:
        db.execute('create virtual table "rtree_the layer_geom" using rtree(id, minx, maxx, miny, maxy)')
    for k, (name, height, flag, shape, box) in enumerate(rows, 1):
        blob = shape
        if shape is not None:
            head = struct.pack("<dddd", box[0], box[2], box[1], box[3]) if header else b""
            blob = b"GP\0" + bytes([1 | header << 1]) + struct.pack("<i", crs) + head + shape
        db.execute('insert into "the layer" values (?, ?, ?, ?, ?, ?)', (k * 3, blob, name, height, flag, k))
        if index and box:
            db.execute('insert into "rtree_the layer_geom" values (?, ?, ?, ?, ?)', (k * 3, box[0], box[2], box[1], box[3]))
    db.commit()
    db.close()


def grid(path, n=200, **more):
    rows = [(f"n{k % 7}", k / 2, k % 2, box_wkb(k, k, k + 1.5, k + 2), (k, k, k + 1.5, k + 2)) for k in range(n)] + [("nothing", None, None, None, None)]
    write_gpkg(path, rows, 4326, **more)


@pytest.mark.parametrize("kind", ["gpkg", "gml", "kml", "parquet"])
def test_every_format_in_degrees(spark, tmp_path, kind):
    path, points = str(tmp_path / f"t.{kind}"), {n: mercator(*p) for n, p in WHERE.items()}
    crs = "EPSG:3857"
    if kind == "gpkg":
        write_gpkg(path, [(n, 1.0, 1, wkb(*p), (*p, *p)) for n, p in points.items()])
    elif kind == "gml":
        members = "".join(f'<ogr:featureMember>\n<ogr:t gml:id="t.{n}"><ogr:geometryProperty><gml:Point srsName="EPSG:3857"><gml:pos>{x} {y}</gml:pos></gml:Point></ogr:geometryProperty>\n<ogr:name>{n}</ogr:name></ogr:t>\n</ogr:featureMember>' for n, (x, y) in points.items())
        open(path, "w").write(f'<?xml version="1.0"?><ogr:FeatureCollection xmlns:gml="g" xmlns:ogr="o"><gml:boundedBy/>{members}</ogr:FeatureCollection>')
    elif kind == "kml":
        crs = "EPSG:4326"
        marks = "".join(f"<Placemark><name>{n}</name><Point><coordinates>{x},{y}</coordinates></Point></Placemark>" for n, (x, y) in WHERE.items())
        open(path, "w").write(f"<kml><Document>{marks}</Document></kml>")
    else:
        spark.createDataFrame([(n, bytearray(wkb(*p))) for n, p in points.items()], "name string, geometry binary").write.parquet(path)
    got = {r.name: r.geometry[0][0][0] for r in vector_files.read_layer(spark, path, crs).select("name", "geometry").collect()}
    assert got.keys() == WHERE.keys()
    for n, p in WHERE.items():
        assert got[n] == pytest.approx(p, abs=1e-6)


def test_gml_polygons_and_latitude_first(spark, tmp_path):
    ring = "59 30 59 31 60 31 59 30"
    hole = "59.1 30.1 59.1 30.2 59.2 30.2 59.1 30.1"
    text = f'<c><gml:featureMember><t><gml:name>p</gml:name><g><gml:Polygon srsName="urn:ogc:def:crs:EPSG::4326"><gml:exterior><gml:LinearRing><gml:posList>{ring}</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing><gml:posList srsDimension="2">{hole}</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></g></t></gml:featureMember></c>'
    (tmp_path / "x.gml").write_text(text)
    row = vector_files.read_layer(spark, str(tmp_path / "x.gml")).first()
    assert row.name == "p" and len(row.geometry[0]) == 2
    assert row.geometry[0][0] == [[30, 59], [31, 59], [31, 60], [30, 59]] and row.geometry[0][1][0] == [30.1, 59.1]


@pytest.mark.parametrize("zone, south", [(36, False), (1, False), (60, True)])
def test_utm_and_back(spark, zone, south):
    lon = [zone * 6 - 183 + d for d in (-3.0, -1.2, 0.0, 2.9)]
    df = spark.createDataFrame([(x, y) for x in lon for y in (0.5, 33.3, 59.9, 79.0)], "lon double, lat double")
    x, y = to_utm(F.col("lon"), F.col("lat"), F.lit(zone))
    back = from_utm(F.col("x"), F.col("y") + (10_000_000 if south else 0), zone, south)
    for r in df.select("*", x.alias("x"), y.alias("y")).select("lon", "lat", back[0].alias("a"), back[1].alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-7)


def test_gpkg_by_ranges_of_rows(spark, tmp_path):
    path = str(tmp_path / "g.gpkg")
    grid(path)
    rows, crs = gpkg.read_gpkg(spark, path, tasks=5)
    assert crs == "EPSG:4326" and rows.rdd.getNumPartitions() == 5
    assert rows.dtypes == [("fid", "bigint"), ("name", "string"), ("height", "double"), ("flag", "boolean"), ('odd"one', "bigint"), ("wkb", "binary"), *[(c, "double") for c in gpkg.BOX]]
    got = {r.fid: r for r in rows.collect()}
    assert len(got) == 201 and got[603].wkb is None and got[603].x0 is None
    assert (got[30].name, got[30].height, got[30].flag, got[30].x0, got[30].y1) == ("n2", 4.5, True, 9, 11)
    layer = vector_files.read_layer(spark, path).where("fid = 30").first()
    assert layer.geometry == [[[[9, 9], [10.5, 9], [10.5, 11], [9, 11], [9, 9]]]]


@pytest.mark.parametrize("index, header", [(True, 1), (False, 1), (True, 0)])
def test_gpkg_conditions_reach_the_file(spark, tmp_path, index, header):
    path = str(tmp_path / "g.gpkg")
    grid(path, index=index, header=header)
    rows, _ = gpkg.read_gpkg(spark, path)
    every = rows.collect()
    asked = [r for r in every if r.name in ("n1", "n2") and r.height is not None and r.height < 60]
    assert sorted(rows.where("name in ('n1', 'n2') and height < 60").collect()) == sorted(asked) and asked
    near = [r for r in every if r.x0 is not None and r.x1 >= 50 and r.x0 <= 55 and r.y1 >= 51]
    assert sorted(rows.where("x1 >= 50 and x0 <= 55 and y1 >= 51").collect()) == sorted(near)
    reader = gpkg.GpkgReader(path, gpkg.Layer.of(path, None), 3)
    given = [In(("name",), ("n1", "n2")), LessThan(("height",), 60.0), GreaterThanOrEqual(("x1",), 50.0), LessThanOrEqual(("x0",), 55.0), GreaterThanOrEqual(("x0",), 3.0), EqualTo(("flag",), True), StringStartsWith(("name",), "n")]
    assert list(reader.pushFilters(given)) == given
    assert len(reader.where) == (4 if index else 2)
    read = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [k for k in range(200) if k % 7 in (1, 2) and k / 2 < 60 and (not index or (k + 1.5 >= 50 and k <= 55))]
    assert sorted(r["odd\"one"] - 1 for r in read) == want, "rows that don't fit aren't read"


def test_what_is_no_layer(spark, tmp_path):
    (tmp_path / "x.gpkg").write_bytes(b"not a database at all, but longer than its header would be" * 40)
    for path in ("x.gpkg", "missing.gpkg"):
        with pytest.raises(ValueError):
            vector_files.read_layer(spark, str(tmp_path / path))
    grid(str(tmp_path / "y.gpkg"), 0)
    assert gpkg.read_gpkg(spark, str(tmp_path / "y.gpkg"))[0].count() == 1
    with pytest.raises(gpkg.Unreadable):
        gpkg.read_gpkg(spark, str(tmp_path / "y.gpkg"), "no such layer")
