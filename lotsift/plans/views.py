"""The domain's tables as views of the generic test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pid", "(p_partkey*37)%1000 as x0", "(p_partkey*91)%1000 as y0", "(p_partkey*37)%1000+p_size as x1", "(p_partkey*91)%1000+5+p_partkey%40 as y1"
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as zid", "concat('Z', s_nationkey) as code", "(s_suppkey*53)%1000 as x0", "(s_suppkey*29)%1000 as y0",
        "(s_suppkey*53)%1000+60+s_suppkey%80 as x1", "(s_suppkey*29)%1000+60+s_suppkey%50 as y1",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes r, r.n and r.n.s of regions, nations and suppliers, each with its parent."""
    region = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as string) as code", "cast(null as string) as parent")
    n = table(spark, sf_dir, "nation").selectExpr("concat(n_regionkey, '.', n_nationkey) as code", "cast(n_regionkey as string) as parent")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "concat(n_regionkey, '.', n_nationkey, '.', s_suppkey) as code", "concat(n_regionkey, '.', n_nationkey) as parent"
    )
    return region.union(n).union(s)


PARCELS_SQL = """(select p_partkey as pid, (p_partkey*37)%1000 as x0, (p_partkey*91)%1000 as y0, (p_partkey*37)%1000+p_size as x1,
  (p_partkey*91)%1000+5+p_partkey%40 as y1 from part)"""
ZONES_SQL = """(select s_suppkey as zid, 'Z' || s_nationkey as code, (s_suppkey*53)%1000 as x0, (s_suppkey*29)%1000 as y0,
  (s_suppkey*53)%1000+60+s_suppkey%80 as x1, (s_suppkey*29)%1000+60+s_suppkey%50 as y1 from supplier)"""
OVERLAP_SQL = f"""(select p.pid, z.zid, z.code, (least(p.x1,z.x1)-greatest(p.x0,z.x0))*(least(p.y1,z.y1)-greatest(p.y0,z.y0)) as area,
  (p.x1-p.x0)*(p.y1-p.y0) as parea from {PARCELS_SQL} p join {ZONES_SQL} z on p.x0<=z.x1 and z.x0<=p.x1 and p.y0<=z.y1 and z.y0<=p.y1)"""
EDGES_SQL = """(select cast(r_regionkey as varchar) as code, cast(null as varchar) as parent from region
  union all select n_regionkey || '.' || n_nationkey, cast(n_regionkey as varchar) from nation
  union all select n_regionkey || '.' || n_nationkey || '.' || s_suppkey, n_regionkey || '.' || n_nationkey from supplier join nation on s_nationkey = n_nationkey)"""
