"""Collections read in pieces of all sizes against whole parses, and round trips."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lotsift.sources import geojson as J


def collection(n, seed):
    r = random.Random(seed)
    tricky = ["plain", 'a "quoted" } {', "back\\slash\\", "}{][", '\\"', "ключ: {значение}", "", '"features":[{']
    features = []
    for i in range(n):
        ring = [[r.randrange(99) / 7, r.randrange(99)] for _ in range(r.randrange(1, 30))]
        f = {"type": "Feature", "id": i, "properties": {"name": r.choice(tricky), "deep": {"a": [{"b": r.choice(tricky)}, {}]}}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        features.append(f if r.random() < 0.9 else {})
    return {"type": "FeatureCollection", "name": '{"features":[{"no":1}]}', "others": [{"no": 2}, {"features": [{"no": 3}]}], "crs": {"properties": {"features": [{"no": 4}]}}, "features": features, "after": [{"no": 5}], "bbox": [1, 2, 3, 4]}


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in held.items():
        spark.conf.set(k, v)


def read(spark, path):
    rows = J.read_features(spark, path).select("path", "ord", F.to_json("feature").alias("f")).collect()
    return sorted((r.path.rsplit("/", 1)[-1], r.ord, json.loads(r.f)) for r in rows) if all(r.f for r in rows) else rows


@pytest.mark.parametrize("size", [60, 500, 4000, 10**8])
def test_pieces_give_the_features_of_a_whole_parse(spark, tmp_path, small_splits, size):
    docs = {"a.geojson": collection(40, 1), "b.json": collection(7, 2), "c.json": {"type": "FeatureCollection", "features": []}, "d.json": {"features": {"x": {"y": 1}}}}
    for k, (name, doc) in enumerate(docs.items()):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=k % 2 == 0, indent=[None, 1, 2, None][k]) + "\n" * k)
    small_splits(size)
    tasks = J.read_features(spark, str(tmp_path)).rdd.getNumPartitions()
    assert size > 4000 or tasks > 4, "one document is read by several tasks"
    got = read(spark, str(tmp_path))
    want = [(name, i, f) for name, doc in docs.items() if isinstance(doc["features"], list) for i, f in enumerate(doc["features"])]
    assert [(n, i) for n, i, _ in got] == [(n, i) for n, i, _ in sorted(want, key=lambda x: x[:2])]
    assert got == sorted(want, key=lambda x: x[:2])


def test_what_is_not_a_collection(spark, tmp_path):
    (tmp_path / "x.json").write_text("no json } at all {")
    (tmp_path / "y.json").write_text("")
    (tmp_path / "z.json").write_text('[{"features":[{"a":1}]}]')
    assert read(spark, str(tmp_path)) == []


@pytest.mark.parametrize("files", [None, 1])
def test_round_trip_with_verdicts(spark, tmp_path, files):
    doc = collection(30, 5)
    (tmp_path / "in.json").write_text(json.dumps(doc))
    rows = J.read_features(spark, str(tmp_path / "in.json")).repartition(3)
    verdict = {"verdict": F.when(F.col("ord") % 2 == 0, "not_allowed"), "name": F.concat(F.lit('n"'), F.col("ord")), "n": F.col("ord")}
    J.write_collection(rows.withColumn("out", J.with_properties(F.col("feature"), verdict)), "out", str(tmp_path / "out"), files)
    written = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert len(written) == (3 if files is None else 1) and all(w["type"] == "FeatureCollection" for w in written)
    back = {r["properties"]["n"]: r for _, _, r in read(spark, str(tmp_path / "out"))}
    assert len(back) == 30
    for i, f in enumerate(doc["features"]):
        own = f.get("properties", {}) | {"verdict": "not_allowed" if i % 2 == 0 else None, "name": f'n"{i}', "n": i}
        assert back[i] == {"type": "Feature", "properties": own, "geometry": f.get("geometry")}
