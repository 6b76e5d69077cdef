"""Zones and objects of scenarios from their service, as a data source: conditions become the service's own parameters, scenarios and years are read side by side."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# The service's paths, and for each kind of layer the columns that the service can filter by.
PATHS = {
    "info": "/api/v1/scenarios/{id}",
    "sources": "/api/v1/scenarios/{id}/functional_zone_sources",
    "functional_zones": "/api/v1/scenarios/{id}/functional_zones",
    "physical_objects": "/api/v1/scenarios/{id}/physical_objects_with_geometry",
}
FILTERS = {"functional_zones": ("functional_zone_type_id",), "physical_objects": ("physical_object_type_id", "physical_object_function_id")}
_SCHEMAS = {
    "info": "scenario_id bigint, name string, updated_at string, info string",
    "sources": "scenario_id bigint, year bigint, source string",
    "functional_zones": "scenario_id bigint, year bigint, source string, functional_zone_type_id bigint, updated_at string, ord bigint, feature string",
    "physical_objects": "scenario_id bigint, physical_object_type_id bigint, physical_object_function_id bigint, updated_at string, ord bigint, feature string",
}


class ServiceError(RuntimeError):
    """The service's answer to a request that it refused."""

    def __init__(self, status: int, detail: str):
        super().__init__(f"{status}: {detail}")
        self.status = status


@dataclass
class Service:
    base: str
    token: str | None = None
    seconds: float = 30.0

    def get(self, kind: str, scenario: int, **params) -> object:
        """The JSON that the service answers; its own words where it refuses."""
        query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        url = self.base.rstrip("/") + PATHS[kind].format(id=scenario) + (f"?{query}" if query else "")
        asked = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as refused:
            body = refused.read().decode("utf-8", "replace")
            try:
                body = json.loads(body).get("detail", body)
            except (ValueError, AttributeError):
                pass
            raise ServiceError(refused.code, str(body)) from refused


@dataclass
class _Part(InputPartition):
    scenario: int
    params: dict = field(default_factory=dict)


def _number(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        return None


class ScenarioReader(DataSourceReader):
    """One part for each scenario, and for zones for each year and source of it that is asked for."""

    def __init__(self, service: Service, kind: str, scenarios: list[int]):
        self.service, self.kind, self.scenarios = service, kind, scenarios
        self.asked: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {"scenario_id", *({"year", "source"} if self.kind in ("functional_zones", "sources") else ()), *FILTERS.get(self.kind, ())}
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if name in known:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.asked[name] = self.asked[name] & values if name in self.asked else values
            # The service's filter is taken at its word no more than others; Spark looks at the rows again.
            yield f

    def _wanted(self, name: str, value) -> bool:
        return name not in self.asked or value in self.asked[name]

    def partitions(self) -> list[InputPartition]:
        out = []
        for scenario in self.scenarios:
            if not self._wanted("scenario_id", scenario):
                continue
            steps: list[dict] = [{}]
            if self.kind == "functional_zones":
                if {"year", "source"} <= self.asked.keys():
                    steps = [{"year": y, "source": s} for y in sorted(self.asked["year"]) for s in sorted(self.asked["source"])]
                else:
                    held = self.service.get("sources", scenario)
                    steps = [{"year": h["year"], "source": h["source"]} for h in held if self._wanted("year", h["year"]) and self._wanted("source", h["source"])]
            for name in FILTERS.get(self.kind, ()):
                # The service takes one value at a time.
                steps = [s | {name: v} for s in steps for v in sorted(self.asked[name])] if name in self.asked else steps
            out += [_Part(scenario, s) for s in steps]
        return out or [_Part(-1)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.scenario < 0:
            return
        if self.kind == "sources":
            for held in self.service.get("sources", part.scenario):
                yield part.scenario, _number(held.get("year")), held.get("source")
            return
        info = self.service.get("info", part.scenario)
        stamp = info.get("updated_at")
        if self.kind == "info":
            yield part.scenario, info.get("name"), stamp, json.dumps(info, ensure_ascii=False)
            return
        found = self.service.get(self.kind, part.scenario, **part.params)
        for n, feature in enumerate(found.get("features") or []):
            own = feature.get("properties") or {}
            text = json.dumps(feature, ensure_ascii=False)
            if self.kind == "functional_zones":
                kind = (own.get("functional_zone_type") or {}).get("id")
                yield part.scenario, part.params["year"], part.params["source"], _number(kind), stamp, n, text
            else:
                kind = (own.get("physical_object_type") or {}).get("physical_object_type_id")
                # A function is known only where it was asked for.
                yield part.scenario, _number(kind), part.params.get("physical_object_function_id"), stamp, n, text


class ScenarioSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lotsift_scenarios"

    def schema(self) -> str:
        return _SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> ScenarioReader:
        service = Service(self.options["base"], self.options.get("token") or None, float(self.options.get("seconds", 30)))
        return ScenarioReader(service, self.options["kind"], [int(x) for x in self.options["scenarios"].split(",") if x])


def read_scenarios(spark: SparkSession, base: str, kind: str, scenarios: list[int], token: str | None = None) -> DataFrame:
    """Rows of a kind (a key of PATHS) for these scenarios; feature and info are variants, updated_at the scenario's freshness stamp.

    Conditions on scenario_id, year, source and the ids of FILTERS (equal, or in a list) go to the service. Zones without a condition on both year and source are
    those of all the years and sources that the scenario has. What the service refuses ends the job with its words.
    """
    spark.dataSource.register(ScenarioSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("lotsift_scenarios").options(base=base, kind=kind, scenarios=",".join(map(str, scenarios)), token=token or "").load()
    made = {c: F.try_parse_json(c) for c in ("feature", "info") if c in rows.columns}
    return rows.withColumns(made) if made else rows


def stale(results: DataFrame, info: DataFrame) -> DataFrame:
    """Results (scenario_id, updated_at, ..) made from another state of their scenario than the service has now; of scenarios it doesn't have, all."""
    now = info.select("scenario_id", F.col("updated_at").alias("_now"), F.lit(True).alias("_there"))
    rows = results.join(now, "scenario_id", "left")
    return rows.where(F.col("_there").isNull() | ~F.col("updated_at").eqNullSafe(F.col("_now"))).drop("_now", "_there")
