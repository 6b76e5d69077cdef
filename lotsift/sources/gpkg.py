"""GeoPackage layers as a data source: ranges of rows read side by side, conditions handed to the file's own tables and box index."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

BOX = ("x0", "y0", "x1", "y1")
#: Columns of the box index that a condition on a box column needs; an index holds boxes a little larger than they are.
_INDEX = {"x0": "minx", "y0": "miny", "x1": "maxx", "y1": "maxy"}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Doubles in a geometry's header by its kind of box.
_BOX_DOUBLES = (0, 4, 6, 6, 8)
ROWS = 5000


class Unreadable(ValueError):
    """A file that can't be read as a layer."""


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str):
    if not os.path.exists(path):
        raise Unreadable(f"{path} isn't there, or not on this machine")
    return closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True))


@dataclass
class Layer:
    """A table of features: its geometry column, key, system of coordinates, other columns with Spark's types, and box index, if any."""

    table: str
    geometry: str
    key: str
    crs: str
    columns: dict[str, str]
    index: str | None

    @classmethod
    def of(cls, path: str, name: str | None) -> Layer:
        try:
            with _opened(path) as db:
                found = db.execute(
                    "select g.table_name, g.column_name, coalesce(s.organization, '') || ':' || coalesce(s.organization_coordsys_id, '') from gpkg_geometry_columns g left join gpkg_spatial_ref_sys s on s.srs_id = g.srs_id order by g.table_name"
                ).fetchall()
                found = [f for f in found if name is None or f[0] == name]
                if not found:
                    raise Unreadable(f"{path} has no layer {name or ''}".rstrip())
                table, geometry, crs = found[0]
                info = db.execute(f"pragma table_info({_quoted(table)})").fetchall()
                key = next((c[1] for c in info if c[5]), "rowid")
                index = f"rtree_{table}_{geometry}"
                has_index = db.execute("select count(*) from sqlite_master where name = ?", (index,)).fetchone()[0]
        except sqlite3.DatabaseError as error:
            raise Unreadable(f"{path} isn't a GeoPackage: {error}") from error
        return cls(table, geometry, key, crs.upper(), {c[1]: _kind(c[2]) for c in info if c[1] != geometry}, index if has_index else None)


def _kind(declared: str) -> str:
    """Spark's type of a declared one."""
    word = (declared or "").upper().split("(")[0].strip()
    if word in ("BOOLEAN",):
        return "boolean"
    if word in ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT"):
        return "bigint"
    if word in ("FLOAT", "DOUBLE", "REAL"):
        return "double"
    return "binary" if word == "BLOB" else "string"


def parted(blob: bytes | None) -> tuple[bytes | None, tuple[float | None, ...]]:
    """Well-known binary and box (x0, y0, x1, y1) of a geometry as the file holds it; no box where its header has none."""
    if not blob or blob[:2] != b"GP":
        return None, (None,) * 4
    flags = blob[3]
    n = _BOX_DOUBLES[min(flags >> 1 & 7, 4)]
    if flags >> 4 & 1:
        return None, (None,) * 4
    box = struct.unpack_from(("<" if flags & 1 else ">") + "4d", blob, 8) if n else None
    return blob[8 + 8 * n :], (box[0], box[2], box[1], box[3]) if box else (None,) * 4


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class GpkgReader(DataSourceReader):
    """Reads ranges of keys; conditions that it understands go into the file's query."""

    def __init__(self, path: str, layer: Layer, tasks: int):
        self.path, self.layer, self.tasks = path, layer, tasks
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if type(f) in _COMPARED and name in self.layer.columns and self.layer.columns[name] in ("bigint", "double", "string"):
                self.where.append(f"{_quoted(name)} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and name in self.layer.columns and self.layer.columns[name] in ("bigint", "string"):
                self.where.append(f"{_quoted(name)} in ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            elif type(f) in _COMPARED and name in BOX and self.layer.index and self._outward(f, name):
                self.where.append(f"{_quoted(self.layer.key)} in (select id from {_quoted(self.layer.index)} where {_INDEX[name]} {_COMPARED[type(f)]} ?)")
                self.values.append(f.value)
            # Spark looks at every row again: types of a file's values may be other than declared, and boxes of the index are rounded.
            yield f

    @staticmethod
    def _outward(f: Filter, name: str) -> bool:
        """Whether rounding boxes outward can only let more rows through."""
        return isinstance(f, (LessThan, LessThanOrEqual)) if name in ("x0", "y0") else isinstance(f, (GreaterThan, GreaterThanOrEqual))

    def partitions(self) -> list[InputPartition]:
        key = _quoted(self.layer.key)
        with _opened(self.path) as db:
            low, high = db.execute(f"select min({key}), max({key}) from {_quoted(self.layer.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.tasks)
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        columns = self.layer.columns
        names = [*columns, self.layer.geometry]
        where = " and ".join([f"{_quoted(self.layer.key)} between ? and ?", *self.where])
        with _opened(self.path) as db:
            rows = db.execute(f"select {', '.join(map(_quoted, names))} from {_quoted(self.layer.table)} where {where}", [partition.first, partition.last, *self.values])
            while part := rows.fetchmany(ROWS):
                made = [pa.array([_value(r[k], kind) for r in part], _ARROW[kind]) for k, kind in enumerate(columns.values())]
                shapes = [parted(r[-1]) for r in part]
                made += [pa.array([s for s, _ in shapes], pa.binary()), *(pa.array([b[k] for _, b in shapes], pa.float64()) for k in range(4))]
                yield pa.RecordBatch.from_arrays(made, names=[*columns, "wkb", *BOX])


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _value(v, kind: str):
    """A value as its declared type; files may hold others, which are null unless they can be read as it."""
    if v is None or kind == "binary":
        return v if v is None or isinstance(v, bytes) else None
    try:
        return {"bigint": int, "double": float, "string": lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x), "boolean": bool}[kind](v)
    except ValueError:
        return None


class GpkgSource(DataSource):
    """spark.read.format("lotsift_gpkg").option("layer", ..).option("tasks", ..).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "lotsift_gpkg"

    def _layer(self) -> Layer:
        return Layer.of(self.options["path"], self.options.get("layer"))

    def schema(self) -> str:
        own = [f"`{c}` {k}" for c, k in self._layer().columns.items()]
        return ", ".join([*own, "wkb binary", *(f"{c} double" for c in BOX)])

    def reader(self, schema) -> GpkgReader:
        return GpkgReader(self.options["path"], self._layer(), int(self.options.get("tasks", 8)))


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, tasks: int | None = None) -> tuple[DataFrame, str]:
    """The rows of a layer (the first by name, if none is named) and its system of coordinates.

    Columns are the table's own, the geometry as well-known binary `wkb`, and the box of each, where the file has it. The file
    lies where driver and executors can open it by this path.
    """
    found = Layer.of(path, layer)
    spark.dataSource.register(GpkgSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("lotsift_gpkg").option("tasks", str(tasks or spark.sparkContext.defaultParallelism)).option("layer", found.table)
    return reader.load(path), found.crs
