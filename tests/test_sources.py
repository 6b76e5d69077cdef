import json
import struct

import pytest
from pyspark.sql import functions as F

from lotsift.functions.geometry import area
from lotsift.sources import tables, vector_files


def wkb(polygons, order="<"):
    flag = b"\x01" if order == "<" else b"\x00"

    def polygon(rings):
        out = flag + struct.pack(order + "II", 3, len(rings))
        for ring in rings:
            out += struct.pack(order + "I", len(ring)) + b"".join(struct.pack(order + "dd", *p) for p in ring)
        return out

    return polygon(polygons[0]) if len(polygons) == 1 else flag + struct.pack(order + "II", 6, len(polygons)) + b"".join(map(polygon, polygons))


SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
HOLED = [SQUARE[0], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]


@pytest.mark.parametrize("order", ["<", ">"])
def test_wkb(spark, tmp_path, order):
    rows = [("a", wkb([SQUARE], order)), ("b", wkb([SQUARE, HOLED], order)), ("c", None), ("p", (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "Idd", 1, 5.0, 6.0))]
    path = str(tmp_path / "x.geoparquet")
    spark.createDataFrame(rows, "name string, geometry binary").write.parquet(path)
    layer = vector_files.read_layer(spark, path)
    got = {r.name: r.a for r in layer.select("name", area(F.col("geometry")).alias("a")).collect()}
    assert got["a"] == 16 and got["b"] == 16 + 15 and got["c"] is None
    assert {r.name for r in vector_files.require_polygons(layer).collect()} == {"a", "b"}


def test_kml(spark, tmp_path):
    (tmp_path / "x.kml").write_text(
        """<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,1 4,0,1 4,4,1 0,4,1 0,0,1</coordinates></LinearRing></outerBoundaryIs>
        <innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,2</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
        <Placemark><name>p</name><Point><coordinates>30.3,59.9</coordinates></Point></Placemark></Document></kml>"""
    )
    rows = {r.name: r for r in vector_files.read_layer(spark, str(tmp_path / "x.kml")).select("name", "geometry", area(F.col("geometry")).alias("a")).collect()}
    assert rows["a"].a == 15 and rows["p"].geometry == [[[[30.3, 59.9]]]]


def test_projection(spark, tmp_path):
    x, y = 3372980.5, 8371966.0
    rows = spark.createDataFrame([([[[[x, y]]]],)], "g array<array<array<array<double>>>>").select(vector_files.to_degrees(F.col("g"), "EPSG:3857").alias("d")).first()
    assert rows.d[0][0][0] == pytest.approx([30.3, 59.9], abs=0.1)
    with pytest.raises(ValueError):
        vector_files.to_degrees(F.col("g"), "EPSG:2154")
    with pytest.raises(ValueError):
        vector_files.read_layer(spark, "x.gpkg")


def test_uploads_and_zones(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    got = {r.path[-6:]: r.reason for r in tables.invalid_json(spark, str(tmp_path), "object").collect()}
    assert got == {"b.json": "not an object", "c.json": "not JSON"}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert tables.too_large(files, 6).count() == 1
    zones = spark.createDataFrame([(2020, "A", 1), (2020, "A", 2), (2021, "A", 1)], "year int, source string, functional_zone_type_id int")
    zones.write.partitionBy("year", "source").parquet(str(tmp_path / "z"))
    assert tables.functional_zones(spark, str(tmp_path / "z"), 2020, "A", 2).count() == 1
    assert tables.available_sources(spark, str(tmp_path / "z")).count() == 2


def test_ledger_tables_and_listing(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    tasks = [(k, f"t{k}", "c", "z", "l", "v", None if k == 1 else False, "use", None, None, None if k == 1 else 5, None if k == 1 else "finished", None, None, None, at + dt.timedelta(hours=k % 3), None, None) for k in range(1, 6)]
    spark.createDataFrame(tasks, tables.LEDGER["pipeline_tasks"]).write.parquet(str(tmp_path / "pipeline_tasks.parquet"))
    spark.createDataFrame([(1, "sc:7:2024:OSM", "t2"), (2, "user:1", "t3")], tables.LEDGER["task_idempotency_keys"]).write.parquet(str(tmp_path / "task_idempotency_keys.parquet"))
    spark.createDataFrame([(1, "max_priority", "20", None)], tables.LEDGER["config"]).write.parquet(str(tmp_path / "config.parquet"))
    assert tables.read_ledger(spark, str(tmp_path), "config").first().py_type == "str"
    rows = tables.task_listing(spark, str(tmp_path)).collect()
    assert [r.external_id for r in rows] == ["t5", "t4", "t1", "t3"] and len(rows[0]) == 19
    first = next(r for r in rows if r.id == 1)
    assert (first.include_pzz_check, first.pzz_zone_code_col, first.pzz_zone_name_col, first.priority, first.status) == (True, "Индекс_зоны", "Код_объекта", 1, "queued")
    assert {r.external_id: r.key for r in rows}["t3"] == "user:1"
