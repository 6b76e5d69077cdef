"""The scenario source against a small service on this machine that notes what it is asked."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from lotsift.sources import scenario_service as S

SOURCES = [(2020, "OSM"), (2020, "PZZ"), (2021, "OSM")]


def zone(scenario, year, source, kind):
    return {"type": "Feature", "properties": {"functional_zone_id": kind, "functional_zone_type": {"id": kind, "name": f"t{kind}"}, "year": year, "source": source}, "geometry": {"type": "Point", "coordinates": [scenario, kind]}}


@pytest.fixture(scope="module")
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            params = dict(parse_qsl(url.query))
            parts = url.path.split("/")
            scenario, kind = int(parts[4]), parts[5] if len(parts) > 5 else "info"
            asked.append((scenario, kind, params, self.headers.get("Authorization")))
            status, body = 200, None
            if scenario == 13:
                status, body = 404, {"detail": "no such scenario"}
            elif kind == "info":
                body = {"id": scenario, "name": f"s{scenario}", "updated_at": f"2024-01-0{scenario}T00:00:00"}
            elif kind == "functional_zone_sources":
                body = [{"year": y, "source": s} for y, s in SOURCES]
            elif kind == "functional_zones":
                kinds = [int(params["functional_zone_type_id"])] if "functional_zone_type_id" in params else [1, 2, 3]
                body = {"type": "FeatureCollection", "features": [zone(scenario, int(params["year"]), params["source"], k) for k in kinds] if (int(params["year"]), params["source"]) in SOURCES else []}
            else:
                kinds = [int(params["physical_object_type_id"])] if "physical_object_type_id" in params else [4, 5]
                body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"physical_object_type": {"physical_object_type_id": k, "name": "дом"}}, "geometry": None} for k in kinds]}
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def zones_asked(asked):
    return sorted((s, int(p["year"]), p["source"], p.get("functional_zone_type_id")) for s, k, p, _ in asked if k == "functional_zones")


def test_conditions_reach_the_service(spark, service):
    base, asked = service
    asked.clear()
    rows = S.read_scenarios(spark, base, "functional_zones", [1, 2], token="t0").where("year = 2020 and source = 'OSM' and functional_zone_type_id = 2").collect()
    assert zones_asked(asked) == [(1, 2020, "OSM", "2"), (2, 2020, "OSM", "2")], "one request a scenario, with all three"
    assert not any(k == "functional_zone_sources" for _, k, _, _ in asked) and {a for *_, a in asked} == {"Bearer t0"}
    assert sorted((r.scenario_id, r.functional_zone_type_id, r.updated_at) for r in rows) == [(1, 2, "2024-01-01T00:00:00"), (2, 2, "2024-01-02T00:00:00")]


def test_years_and_sources_are_read_side_by_side(spark, service):
    base, asked = service
    rows = S.read_scenarios(spark, base, "functional_zones", [1, 2])
    assert rows.rdd.getNumPartitions() == 6
    asked.clear()
    got = rows.where("year = 2020").select("scenario_id", "year", "source", "ord", F.variant_get("feature", "$.properties.functional_zone_type.name", "string").alias("name")).collect()
    assert len(got) == 2 * 2 * 3 and {r.year for r in got} == {2020} and {r.name for r in got} == {"t1", "t2", "t3"}
    assert zones_asked(asked) == sorted((s, 2020, c, None) for s in (1, 2) for c in ("OSM", "PZZ"))
    asked.clear()
    assert S.read_scenarios(spark, base, "functional_zones", [1]).where("year in (2020, 2021, 1999) and source in ('OSM')").count() == 6
    assert zones_asked(asked) == [(1, y, "OSM", None) for y in (1999, 2020, 2021)]


def test_objects_by_type_and_scenario(spark, service):
    base, asked = service
    asked.clear()
    rows = S.read_scenarios(spark, base, "physical_objects", [1, 2, 3]).where("physical_object_type_id = 4 and scenario_id in (2, 3)").collect()
    assert sorted(r.scenario_id for r in rows) == [2, 3]
    assert sorted((s, p.get("physical_object_type_id")) for s, k, p, _ in asked if k == "physical_objects_with_geometry") == [(2, "4"), (3, "4")]
    assert S.read_scenarios(spark, base, "physical_objects", [1]).where("physical_object_function_id = 7").count() == 2
    assert S.read_scenarios(spark, base, "physical_objects", []).count() == 0


def test_sources_and_freshness(spark, service):
    base, _ = service
    held = S.read_scenarios(spark, base, "sources", [1])
    assert sorted((r.year, r.source) for r in held.collect()) == SOURCES
    info = S.read_scenarios(spark, base, "info", [1, 2])
    results = spark.createDataFrame([(1, "2024-01-01T00:00:00", "a"), (2, "2023-12-31T00:00:00", "b"), (9, None, "c")], "scenario_id long, updated_at string, name string")
    assert sorted(r.name for r in S.stale(results, info).collect()) == ["b", "c"]


def test_refusals_come_with_their_words(spark, service):
    base, _ = service
    with pytest.raises(Exception, match="404: no such scenario"):
        S.read_scenarios(spark, base, "info", [13]).collect()
