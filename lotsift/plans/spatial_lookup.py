"""Queries of the spatial joins and of lookups in catalogues and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import MULTIPOLYGON, area, to_utm
from ..functions.rules import FLOOR_BANDS, FLOOR_FALLBACK, TYPE_CODES
from ..functions.text import is_code, is_placeholder, normal
from ..operators import catalog, lookup, overlay, reports, spatial
from .views import EDGES_SQL, OVERLAP_SQL, PARCELS_SQL, ZONES_SQL, edges, parcels, table, zones

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RANKED = f"(select *, row_number() over (partition by pid order by area desc, code, zid) as rn from {OVERLAP_SQL} o)"


@_query(f"""select p.pid, r.code as actual_code, coalesce(a.n, 0) as n_codes, r.area, round(cast(r.area as double)/r.parea, 6) as share
from {PARCELS_SQL} p left join {_RANKED} r on p.pid=r.pid and rn=1
left join (select pid, count(distinct code) as n from {OVERLAP_SQL} o group by pid) a on p.pid=a.pid""")
def q01_overlay_dominant_zone(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    out = spatial.dominant_alike(p, zones(spark, d), spatial.overlaps, *spatial.BOX)
    return out.select("pid", "actual_code", F.col("n_codes").cast("bigint").alias("n_codes"), "area", F.round("share", 6).alias("share"))


@_query(f"""with o as (select pid, code, max(area) as area, max(parea) as parea from {OVERLAP_SQL} o group by pid, code),
a as (select pid, string_agg(code, ' | ' order by area desc, code) as intersect_codes, count(*) as n, max(area)/max(parea) as share from o group by pid)
select p.pid, intersect_codes, case when n > 1 and share < 0.5 then 'Dominant zone share is below threshold; parcel intersects multiple PZZ zones.'
when n > 1 then 'Parcel intersects multiple PZZ zones.' else '' end as note from {PARCELS_SQL} p left join a using (pid)""")
def q02_overlay_intersect_codes(spark: SparkSession, d: str) -> DataFrame:
    """Notes by boxes, empty where there is nothing to note; superseded by q98_repaired_overlay, whose notes are null there."""
    p = parcels(spark, d)
    out = spatial.dominant_alike(p, zones(spark, d), spatial.overlaps, *spatial.BOX)
    return out.select("pid", "intersect_codes", spatial.overlay_note(F.col("share"), F.col("n_codes")).alias("note"))


_CENTRES = f"(select pid, (x0+x1)/2.0 as px, (y0+y1)/2.0 as py from {PARCELS_SQL} p)"


def _boxes(of: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"select {of}, {x0}*1.0::double as ax, {y0}*1.0::double as ay, {x1}*1.0::double as cx, {y1}*1.0::double as cy"


# What each kind of shape covers, as boxes that don't overlap: whole, with a hole, a corner missing, two quarters that meet in the middle, two overlapping parts.
_SHAPE_KINDS = [
    [("x0", "y0", "x1", "y1")],
    [("x0", "y0", "x0+w", "y1"), ("x1-w", "y0", "x1", "y1"), ("x0+w", "y0", "x1-w", "y0+h"), ("x0+w", "y1-h", "x1-w", "y1")],
    [("x0", "y0", "x1", "y0+2*h"), ("x0", "y0+2*h", "x0+2*w", "y1")],
    [("x0", "y0", "x0+2*w", "y0+2*h"), ("x0+2*w", "y0+2*h", "x1", "y1")],
    [("x0", "y0", "x1", "y1")],
]


def _covered_sql(table_sql: str, of: str, key: str) -> str:
    rows = f"(select *, (x1-x0)*0.25::double as w, (y1-y0)*0.25::double as h from {table_sql} t)"
    return "(" + " union all ".join(f"{_boxes(of, *box)} from {rows} t where {key} % 5 = {k}" for k, kind in enumerate(_SHAPE_KINDS) for box in kind) + ")"


def _broken(df: DataFrame, key: str) -> DataFrame:
    """Boxes as shapes of five kinds, some of them invalid: see _SHAPE_KINDS for what they cover."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in spatial.BOX)
    w, h = (x1 - x0) * 0.25, (y1 - y0) * 0.25

    def ring(*points):
        return F.array(*[F.array(x, y) for x, y in points])

    def box(a, b, c, d):
        return ring((a, b), (c, b), (c, d), (a, d), (a, b))

    kinds = [
        F.array(F.array(box(x0, y0, x1, y1))),
        F.array(F.array(box(x0, y0, x1, y1), box(x0 + w, y0 + h, x1 - w, y1 - h))),
        F.array(F.array(ring((x0, y0), (x1, y0), (x1, y0 + 2 * h), (x0 + 2 * w, y0 + 2 * h), (x0 + 2 * w, y1), (x0, y1)))),
        F.array(F.array(ring((x0, y0), (x0 + 2 * w, y0), (x0 + 2 * w, y1), (x1, y1), (x1, y0 + 2 * h), (x0, y0 + 2 * h)))),
        F.array(F.array(box(x0, y0, x1 - w, y1)), F.array(box(x0 + w, y0, x1, y1))),
    ]
    kind = F.col(key) % 5
    shape = F.when(kind == 0, kinds[0])
    for k in range(1, 5):
        shape = shape.when(kind == k, kinds[k])
    return df.withColumn("shape", shape.cast(MULTIPOLYGON))


_PIECES_SQL = f"""(select p.pid, z.zid, z.code, sum(greatest(0, least(p.cx, z.cx) - greatest(p.ax, z.ax)) * greatest(0, least(p.cy, z.cy) - greatest(p.ay, z.ay))) as area
  from {_covered_sql(PARCELS_SQL, 'pid', 'pid')} p join {_covered_sql(ZONES_SQL, 'zid, code', 'zid')} z
  on p.ax <= z.cx and z.ax <= p.cx and p.ay <= z.cy and z.ay <= p.cy group by all)"""


@_query(f"""with f as materialized (select * from {_PIECES_SQL} f),
own as (select pid, sum((cx-ax)*(cy-ay)) as own from {_covered_sql(PARCELS_SQL, 'pid', 'pid')} p group by pid),
best as (select *, row_number() over (partition by pid order by area desc, code, zid) as rn from f),
codes as (select pid, code, max(area) as area, arg_min(zid, -area) as zid from f group by pid, code),
listed as (select pid, string_agg(code, ' | ' order by area desc, code) as intersect_codes, count(*) as n from codes group by pid)
select p.pid, b.code as actual_code, coalesce(n, 0) as n_codes, intersect_codes, round(b.area, 4) as area, round(b.area / own + 1e-9, 4) as share,
case when n > 1 and b.area / own < 0.5 then 'Dominant zone share is below threshold; parcel intersects multiple PZZ zones.'
when n > 1 then 'Parcel intersects multiple PZZ zones.' end as note
from {PARCELS_SQL} p join own using (pid) left join best b on p.pid = b.pid and rn = 1 left join listed l on p.pid = l.pid""")
def q98_repaired_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The zone that dominates each parcel, from shapes with holes, corners, crossings and overlapping parts; touching zones count, notes are null where there is nothing to note."""
    p, z = _broken(parcels(spark, d), "pid"), _broken(zones(spark, d), "zid")
    out = overlay.zone_attributes(p.select("pid", "shape"), z.select("zid", "code", "shape"))
    return out.select("pid", "actual_code", F.col("n_codes").cast("bigint").alias("n_codes"), "intersect_codes", F.round("area", 4).alias("area"), F.round(F.col("share") + _UP, 4).alias("share"), "note")


@_query(f"""select p.pid, min(zid) as zid, arg_min(code, zid) as code from (select pid, (x0+x1)/2.0 + 0.3 as px, (y0+y1)/2.0 + 0.3 as py from {PARCELS_SQL} p) p
left join {_covered_sql(ZONES_SQL, 'zid, code', 'zid')} z on px > ax and px < cx and py > ay and py < cy group by p.pid""")
def q99_point_in_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The first zone that holds each parcel's middle, a little moved, from repaired shapes."""
    points = parcels(spark, d).selectExpr("pid", "(x0+x1)/2.0D + 0.3D as px", "(y0+y1)/2.0D + 0.3D as py")
    return overlay.first_holding(points, _broken(zones(spark, d), "zid").select("zid", "code", "shape")).select("pid", "zid", "code")


@_query(f"""select c.pid, min(zid) as zid, arg_min(code, zid) as code from {_CENTRES} c left join {ZONES_SQL} z
on px > x0 and px < x1 and py > y0 and py < y1 group by c.pid""")
def q03_point_in_zone(spark: SparkSession, d: str) -> DataFrame:
    points = parcels(spark, d).selectExpr("pid", "(x0+x1)/2.0D as px", "(y0+y1)/2.0D as py")
    return spatial.containing(points, zones(spark, d)).select("pid", "zid", "code")


def _octagon(cut: float = 0.25):
    """A box with its corners cut off, as a multipolygon."""
    w, h = (F.col("x1") - F.col("x0")) * cut, (F.col("y1") - F.col("y0")) * cut
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in spatial.BOX)
    points = [(x0 + w, y0), (x1 - w, y0), (x1, y0 + h), (x1, y1 - h), (x1 - w, y1), (x0 + w, y1), (x0, y1 - h), (x0, y0 + h)]
    return F.array(F.array(F.array(*[F.array(*p) for p in points]))).cast(MULTIPOLYGON)


# Many areas lie just halfway between two rounded values; a billionth more takes all of these up, in Spark and in SQL alike.
_UP = 1e-9


# An octagon lies below three lines and above three: of two octagons, the height they share at x is the least of six lines less the
# greatest of six others. It is straight between the places where two of the lines meet, so trapezoids give its area.
_CLIP_SQL = f"""(with pairs as (select p.pid, z.zid, z.code, greatest(p.x0,z.x0)*1.0::double as lo, least(p.x1,z.x1)*1.0::double as hi,
    [p.x0*1.0::double,p.y0,p.x1,p.y1] as a, [z.x0*1.0::double,z.y0,z.x1,z.y1] as b
    from {PARCELS_SQL} p join {ZONES_SQL} z on p.x0<=z.x1 and z.x0<=p.x1 and p.y0<=z.y1 and z.y0<=p.y1),
  boxes as (select pid, zid, unnest([a, b]) as v from pairs),
  sides as (select pid, zid, v[1] as x0, v[2] as y0, v[3] as x1, v[4] as y1, (v[3]-v[1])*0.25 as w, (v[4]-v[2])*0.25 as h from boxes),
  lines as (select pid, zid, unnest([1,1,1,-1,-1,-1]) as dir, unnest([0.0::double, h/w, -h/w, 0.0::double, -h/w, h/w]) as m,
    unnest([y1, y1-h-x0*h/w, y1-h+x1*h/w, y0, y0+h+x0*h/w, y0+h-x1*h/w]) as c from sides),
  cuts as (select distinct l.pid, l.zid, (r.c-l.c)/(l.m-r.m) as x from lines l join lines r on l.pid=r.pid and l.zid=r.zid and l.m<>r.m
    union select pid, zid, unnest([lo, hi]) from pairs),
  used as (select cuts.pid, cuts.zid, x from cuts join pairs using (pid, zid) where x between lo and hi),
  heights as (select u.pid, u.zid, u.x, greatest(0, min(case when dir=1 then m*u.x+c end)-max(case when dir=-1 then m*u.x+c end)) as tall
    from used u join lines using (pid, zid) group by all),
  steps as (select pid, zid, x, tall, lead(x) over w as x2, lead(tall) over w as tall2 from heights window w as (partition by pid, zid order by x)),
  areas as (select pid, zid, sum(coalesce((x2-x)*(tall+tall2)/2, 0)) as area from steps group by all)
  select pairs.pid, pairs.zid, pairs.code, area, (a[3]-a[1])*(a[4]-a[2])*0.875 as parcel_area from pairs join areas using (pid, zid))"""


@_query(f"select pid, zid, round(area + 1e-9, 6) as area, round(parcel_area + 1e-9, 6) as parcel_area from {_CLIP_SQL} c")
def q04_polygon_clip_area(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, as many as there are; each pair of different boxes is clipped once."""
    p, z = parcels(spark, d), zones(spark, d)
    one, two = (spatial.alike(t, key, *spatial.BOX).withColumn("shape", _octagon()) for t, key in ((p, "pid"), (z, "zid")))
    pairs = spatial.touching(one, two, spatial.tile_side(two))
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pid", "r_zid")
    clipped = spatial.intersection_area("shape", "r_shape")
    cut = pairs.select(*spatial.BOX, *[f"r_{c}" for c in spatial.BOX], F.round(clipped + _UP, 6).alias("area"), F.round(area(F.col("shape")) + _UP, 6).alias("parcel_area"))
    z = z.select("zid", *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    return cut.join(z, [f"r_{c}" for c in spatial.BOX]).join(p, spatial.BOX).select("pid", "zid", "area", "parcel_area")


@_query(f"""with c as (select * from {_CLIP_SQL} c where area > 1e-9), r as (select *, row_number() over (partition by pid order by round(area + 1e-9, 6) desc, code, zid) as rn from c)
select p.pid, r.code as actual_code, coalesce(n, 0) as n_codes, round(r.area + 1e-9, 6) as area, round(r.area/r.parcel_area + 1e-9, 6) as share
from {PARCELS_SQL} p left join r on p.pid = r.pid and rn = 1 left join (select pid, count(distinct code) as n from c group by pid) a on p.pid = a.pid""")
def q95_polygon_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The zone that dominates each parcel, by the areas of real polygons; zones that only touch are left out here, q98_repaired_overlay counts them."""

    def meet(p: DataFrame, z: DataFrame) -> DataFrame:
        pieces = spatial.polygon_overlaps(*(t.withColumn("shape", _octagon()) for t in (p, z)))
        return pieces.where("area > 1e-9").withColumn("area", F.round(F.col("area") + _UP, 6))

    out = spatial.dominant_alike(parcels(spark, d), zones(spark, d), meet, *spatial.BOX)
    return out.select("pid", "actual_code", F.col("n_codes").cast("bigint").alias("n_codes"), "area", F.round(F.col("share") + _UP, 6).alias("share"))


@_query(f"""select c.pid, min(zid) as zid, arg_min(code, zid) as code from {_CENTRES} c left join {ZONES_SQL} z
on px > x0 and px < x1 and py > y0 and py < y1 and 4*(px-x0)*(y1-y0) + 4*(py-y0)*(x1-x0) > (x1-x0)*(y1-y0) and 4*(x1-px)*(y1-y0) + 4*(py-y0)*(x1-x0) > (x1-x0)*(y1-y0)
and 4*(px-x0)*(y1-y0) + 4*(y1-py)*(x1-x0) > (x1-x0)*(y1-y0) and 4*(x1-px)*(y1-y0) + 4*(y1-py)*(x1-x0) > (x1-x0)*(y1-y0) group by c.pid""")
def q96_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    points = parcels(spark, d).selectExpr("pid", "(x0+x1)/2.0D as px", "(y0+y1)/2.0D as py")
    found = spatial.containing_polygons(points, zones(spark, d).withColumn("shape", _octagon()))
    # Parcels of one key are one row, with the first zone of any of them.
    return found.groupBy("pid").agg(F.min("zid").alias("zid"), F.min_by("code", "zid").alias("code"))


@_query(f"select p.pid from {PARCELS_SQL} p where pid not in (select pid from {OVERLAP_SQL} o)")
def q05_overlay_no_match(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    one, two = spatial.alike(p, "pid", *spatial.BOX), spatial.alike(zones(spark, d), "zid", *spatial.BOX)
    met = spatial.touching(one, two, spatial.tile_side(two)).select(spatial.BOX).distinct()
    return p.join(met, spatial.BOX, "left_anti").select("pid")


_ZONE_CODES = """(select n_regionkey || '.' || n_nationkey as zone_code, case when n_nationkey % 3 = 0 then 'B' || n_nationkey else 'G' || n_regionkey end as base_code from nation)"""
_ASKED = """(select s_suppkey, case s_suppkey % 5 when 0 then '' when 1 then 'B' || s_nationkey when 2 then 'G' || (s_nationkey % 5) when 3 then 'X'
  else n_regionkey || '.' || n_nationkey end as zone_code from supplier join nation on s_nationkey = n_nationkey)"""


def _zone_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").selectExpr(
        "concat(n_regionkey, '.', n_nationkey) as zone_code", "case when n_nationkey % 3 = 0 then concat('B', n_nationkey) else concat('G', n_regionkey) end as base_code"
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    return s.selectExpr(
        "s_suppkey",
        "case s_suppkey % 5 when 0 then '' when 1 then concat('B', s_nationkey) when 2 then concat('G', s_nationkey % 5) when 3 then 'X' else concat(n_regionkey, '.', n_nationkey) end as zone_code",
    )


@_query(f"""with b as (select base_code, min(zone_code) as only_code from {_ZONE_CODES} z group by 1 having count(*) = 1)
select s_suppkey, case when a.zone_code = '' then null when z.zone_code is not null then a.zone_code else only_code end as ref_code,
case when a.zone_code = '' then 'missing' when z.zone_code is not null then 'exact' when only_code is not null then 'base_unique' else 'not_found' end as outcome
from {_ASKED} a left join {_ZONE_CODES} z on a.zone_code = z.zone_code left join b on a.zone_code = b.base_code""")
def q06_zone_reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    return lookup.resolve_zones(_asked(spark, d), _zone_codes(spark, d)).select("s_suppkey", "ref_code", "outcome")


@_query("""with k as (select p_name, p_type, min(p_partkey) as rep, count(*) as n from part group by 1, 2)
select l_orderkey, l_linenumber, rep as verdict_of, n from lineitem join part on l_partkey = p_partkey join k using (p_name, p_type)""")
def q07_distinct_key_joinback(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    keys = part.groupBy("p_name", "p_type").agg(F.min_by("p_partkey", "p_partkey").alias("verdict_of"), F.count(F.lit(1)).alias("n"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return lines.join(part.select("p_partkey", "p_name", "p_type"), "p_partkey").join(keys, ["p_name", "p_type"]).select("l_orderkey", "l_linenumber", "verdict_of", "n")


_TYPES = "(select p_partkey, case p_partkey % 4 when 0 then 4 when 1 then 8 when 2 then 5 else 99 end as kind, case when p_partkey % 7 = 0 then 'x' else cast(p_size as varchar) end as floors from part)"


@_query(f"""select p_partkey, case kind when 4 then case when floors = 'x' then '2.1' when cast(nullif(floors,'x') as int) <= 4 then '2.1.1'
when cast(nullif(floors,'x') as int) <= 8 then '2.5' else '2.6' end when 8 then '4.9.1' end as use_code from {_TYPES} t""")
def q08_floor_band_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr(
        "p_partkey", "case p_partkey % 4 when 0 then 4 when 1 then 8 when 2 then 5 else 99 end as kind", "case when p_partkey % 7 = 0 then 'x' else cast(p_size as string) end as floors"
    )
    return t.select("p_partkey", lookup.banded_code(F.col("kind"), F.col("floors"), 4, TYPE_CODES, FLOOR_BANDS, FLOOR_FALLBACK).alias("use_code"))


_ALLOWED = """(select 'R' || r_regionkey as zone, 'main' as section, cast(r_regionkey as varchar) as allowed_code from region where r_regionkey < 2
  union all select 'R' || n_regionkey, case when n_nationkey % 2 = 0 then 'conditional' else 'auxiliary' end, n_regionkey || '.' || n_nationkey from nation
  union all select 'R' || ((n_regionkey + 1) % 5), 'main', n_regionkey || '.' || n_nationkey || '.7' from nation where n_nationkey % 3 = 0)"""


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    a = region.where("r_regionkey < 2").selectExpr("concat('R', r_regionkey) as zone", "'main' as section", "cast(r_regionkey as string) as allowed_code")
    b = nation.selectExpr("concat('R', n_regionkey)", "case when n_nationkey % 2 = 0 then 'conditional' else 'auxiliary' end", "concat(n_regionkey, '.', n_nationkey)")
    c = nation.where("n_nationkey % 3 = 0").selectExpr("concat('R', (n_regionkey + 1) % 5)", "'main'", "concat(n_regionkey, '.', n_nationkey, '.7')")
    return a.union(b).union(c)


_OBJECTS = """(select s_suppkey, n_regionkey || '.' || n_nationkey || case when s_suppkey % 2 = 0 then '.' || s_suppkey else '' end as code, 'R' || (s_suppkey % 5) as zone
  from supplier join nation on s_nationkey = n_nationkey)"""


def _objects(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    return s.selectExpr("s_suppkey", "concat(n_regionkey, '.', n_nationkey, case when s_suppkey % 2 = 0 then concat('.', s_suppkey) else '' end) as code", "concat('R', s_suppkey % 5) as zone")


@_query(f"""select o.s_suppkey, arg_min(section, case section when 'main' then 0 when 'conditional' then 1 else 2 end) as section from {_OBJECTS} o left join {_ALLOWED} a
on a.zone = o.zone and (allowed_code = code or starts_with(code, allowed_code || '.') or starts_with(allowed_code, code || '.')) group by 1""")
def q09_hierarchical_allow(spark: SparkSession, d: str) -> DataFrame:
    return lookup.allowing_section(_objects(spark, d), _allowed(spark, d), "code", "zone").select("s_suppkey", "section")


@_query(f"""with c as (select s_suppkey, n_regionkey || '.' || n_nationkey || '.' || s_suppkey as code, n_regionkey, n_nationkey, n_name, r_name from supplier
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select s_suppkey, code, case when s_suppkey % 10 = 0 then 'own ' || s_suppkey when n_nationkey % 2 = 0 then n_name when n_regionkey <> 3 then r_name end as zone_name from c""")
def q10_prefix_zone_fallback(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).selectExpr("s_suppkey", "concat(n_regionkey, '.', n_nationkey, '.', s_suppkey) as code")
    own = coded.where("s_suppkey % 10 = 0").selectExpr("code", "concat('own ', s_suppkey) as name")
    nation = table(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("concat(n_regionkey, '.', n_nationkey)", "n_name")
    region = table(spark, d, "region").where("r_regionkey <> 3").selectExpr("cast(r_regionkey as string)", "r_name")
    return lookup.by_prefix(coded, own.union(nation).union(region), "code", "name", "zone_name")


_CLOSURE = f"""with recursive e as materialized (select * from {EDGES_SQL} x), reach(code, descendant) as (
  select code, code from e union select r.code, e.code from reach r join e on e.parent = r.descendant)"""


@_query(f"{_CLOSURE} select code, descendant from reach")
def q11_code_closure(spark: SparkSession, d: str) -> DataFrame:
    return lookup.closure(edges(spark, d))


@_query(f"""{_CLOSURE}, s as (select 'R' || (n_regionkey % 2) as zone, case n_nationkey % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section,
n_regionkey || '.' || n_nationkey as code from nation),
h as (select zone, descendant as code, arg_min(section, case section when 'main' then 0 when 'conditional' then 1 else 2 end) as section from s join reach using (code) group by 1, 2)
select z.zone, e.code, section from e cross join (select distinct zone from s) z left join h on h.zone = z.zone and h.code = e.code""")
def q12_section_presence(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    sections = table(spark, d, "nation").selectExpr(
        "concat('R', n_regionkey % 2) as zone", "case n_nationkey % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section", "concat(n_regionkey, '.', n_nationkey) as code"
    )
    held = sections.join(lookup.closure(e), "code").groupBy("zone", "descendant").agg(F.min_by("section", lookup.section_order("section")).alias("section"))
    both = F.array_sort(F.lit(["R0", "R1"]))
    asked = e.select("code", F.explode(both).alias("zone"))
    return asked.join(held.withColumnRenamed("descendant", "code"), ["zone", "code"], "left").select("zone", "code", "section")


_ITEMS = """(select 'N' || (p_partkey % 25) as zone_code, case p_partkey % 5 when 0 then 'conditional' when 1 then 'auxiliary' else 'main' end as section,
  (p_size % 9) || '.' || (p_partkey % 4) as vri_code, p_name as vri_name, p_partkey from part)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(
        "concat('N', p_partkey % 25) as zone_code", "case p_partkey % 5 when 0 then 'conditional' when 1 then 'auxiliary' else 'main' end as section",
        "concat(p_size % 9, '.', p_partkey % 4) as vri_code", "p_name as vri_name", "p_partkey",
    )


@_query(f"""with s as (select zone_code, string_agg(distinct vri_code, ',' order by vri_code) as codes from {_ITEMS} i where section <> 'conditional' group by 1),
z as (select 'N' || n_nationkey as zone_code, 'G' || (n_nationkey % 7) as base_code, n_nationkey as pos from nation)
select zone_code as code, coalesce(codes, '') as codes from z left join s using (zone_code) union all select base_code, arg_min(coalesce(codes, ''), pos) from z left join s using (zone_code) group by base_code""")
def q13_allowed_code_sets(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "nation").selectExpr("concat('N', n_nationkey) as zone_code", "concat('G', n_nationkey % 7) as base_code", "n_nationkey as pos")
    return catalog.allowed_codes(_items(spark, d), z).select("code", F.array_join("codes", ",").alias("codes"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Zones with an array of items for each section, in order of part."""
    item = F.struct("vri_code", "vri_name", F.lit("").alias("vri_description"))
    groups = _items(spark, d).groupBy("zone_code")
    arrays = [
        F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == s, F.struct("p_partkey", item.alias("i"))))), lambda x: x["i"]).alias(s) for s in lookup.SECTIONS
    ]
    return groups.agg(*arrays)


def _agg(section: str, expr: str, sep: str) -> str:
    return f"coalesce(string_agg({expr}, '{sep}' order by p_partkey) filter (where section = '{section}'), '')"


@_query(
    f"select zone_code, {', '.join(f"{_agg(s, 'vri_name', ' | ')} as {s}_names, {_agg(s, 'vri_code', ' | ')} as {s}_codes, {_agg(s, "vri_code || ' | ' || vri_name", ' ; ')} as {s}_full" for s in lookup.SECTIONS)}, count(*) as n_items from {_ITEMS} i group by 1"
)
def q14_catalog_flatten(spark: SparkSession, d: str) -> DataFrame:
    nested = _nested(spark, d)
    n = catalog.flat_items(nested).groupBy("zone_code").agg(F.count(F.lit(1)).alias("n_items"))
    return catalog.zone_rows(nested).join(n, "zone_code")


@_query("""with c as (select c_nationkey, c_mktsegment, count(*) as n, min(c_custkey) as f from customer group by 1, 2)
select n_name, c_mktsegment, n from (select *, row_number() over (partition by c_nationkey order by n desc, f) as r from c) join nation on c_nationkey = n_nationkey where r = 1""")
def q15_modal_attributes(spark: SparkSession, d: str) -> DataFrame:
    usual = catalog.modal(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return usual.join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).select("n_name", "c_mktsegment", "n")


_VERDICTS = """(select o_orderkey as ord, case when o_orderkey % 11 = 0 then null else n_name end as zone, n_name as zone_name,
  case o_orderstatus when 'F' then 'allowed_main' when 'O' then 'not_allowed' else 'unclear' end as verdict
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return o.selectExpr(
        "o_orderkey as ord", "case when o_orderkey % 11 = 0 then null else n_name end as zone", "n_name as zone_name",
        "case o_orderstatus when 'F' then 'allowed_main' when 'O' then 'not_allowed' else 'unclear' end as verdict",
    )


@_query(f"""with v as (select coalesce(zone, '__no_zone__') as zone, ord, zone_name, case when verdict like 'allowed%' then 'correct' when verdict = 'not_allowed' then 'wrong' else 'unclear' end as fit from {_VERDICTS} x)
select zone, grouping(zone) = 1 as overall, count(*) as n_total, count(*) filter (where fit='correct') as n_correct, count(*) filter (where fit='wrong') as n_wrong,
count(*) filter (where fit='unclear') as n_unclear, case when grouping(zone) = 0 then arg_min(zone_name, ord) end as zone_name, min(ord) as first_ord from v group by grouping sets ((zone), ())""")
def q16_zone_fit_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.fit_report(_verdicts(spark, d))


@_query(f"""select ord, zone_name, verdict, (select count(*) - 10 from {_VERDICTS} x where verdict = 'not_allowed') as more from {_VERDICTS} v where verdict = 'not_allowed' order by ord limit 10""")
def q17_object_fit_report(spark: SparkSession, d: str) -> DataFrame:
    wrong = _verdicts(spark, d).where("verdict = 'not_allowed'").select("ord", "zone_name", "verdict")
    return reports.capped(wrong, [F.col("ord")], 10)


@_query("select count(*) as n_total, count(quality) as n_with, count(*) - count(quality) as n_without from documents left join labels using (doc_id)")
def q18_classify_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return reports.candidate_summary(rows, F.col("quality").cast("string"))


@_query("""select n_nationkey, case when n_nationkey % 4 = 0 then 'no_mapping' when n_regionkey in (0, 3) then 'low_confidence' else 'ok' end as status,
case when n_nationkey % 4 <> 0 then r_name end as summary from nation join region on n_regionkey = r_regionkey""")
def q19_zone_summary_lookup(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "nation").where("n_nationkey % 4 <> 0").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey", "r_name as summary", "case n_regionkey when 0 then 'low' when 3 then null when 1 then 'high' else 'medium' end as confidence"
    )
    joined = table(spark, d, "nation").select("n_nationkey").join(F.broadcast(mapping), "n_nationkey", "left")
    return joined.select("n_nationkey", lookup.summary_status(F.col("summary"), F.col("confidence")).alias("status"), "summary")


@_query("""with m as (select n_nationkey as code, n_name as name from nation where n_nationkey % 2 = 0), o as (select s_nationkey as code, arg_min(s_name, s_suppkey) as name from supplier group by 1)
select code, name, false as stub from m union all select code, name, true from o where code not in (select code from m)""")
def q24_stub_union(spark: SparkSession, d: str) -> DataFrame:
    mapped = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    observed = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    stubs = observed.join(mapped, "code", "left_anti")
    return mapped.withColumn("stub", F.lit(False)).union(stubs.withColumn("stub", F.lit(True)))


@_query(f"""select p.pid, coalesce(section, case when z.zid is null then 'no_actual_zone' when use_code is null then 'unclear' else 'not_allowed' end) as verdict from {_CENTRES} p
left join (select c.pid, min(zid) as zid from {_CENTRES} c join {ZONES_SQL} z on px > x0 and px < x1 and py > y0 and py < y1 group by 1) z on p.pid = z.pid
join (select p_partkey as pid, case p_partkey % 3 when 0 then case when p_size <= 4 then '2.1.1' when p_size <= 8 then '2.5' else '2.6' end when 1 then '6.9' end as use_code from part) u on u.pid = p.pid
left join (select zid as k, 'allowed_' || case when zid % 3 = 0 then 'main' when zid % 3 = 1 then 'conditional' else 'auxiliary' end as section from {ZONES_SQL} q where zid % 4 <> 0) s
on k = z.zid and (use_code = '2.1.1' or use_code like '2.5%' or use_code = '2.6') and k % 2 = 1""")
def q50_scenario_verdict(spark: SparkSession, d: str) -> DataFrame:
    points = parcels(spark, d).selectExpr("pid", "(x0+x1)/2.0D as px", "(y0+y1)/2.0D as py")
    placed = spatial.containing(points, zones(spark, d)).select("pid", "zid")
    typed = table(spark, d, "part").selectExpr("p_partkey as pid", "case p_partkey % 3 when 0 then 4 when 1 then 29 else 5 end as kind", "p_size")
    coded = typed.select("pid", lookup.banded_code(F.col("kind"), F.col("p_size"), 4, TYPE_CODES, FLOOR_BANDS, FLOOR_FALLBACK).alias("use_code"))
    allowed = zones(spark, d).where("zid % 4 <> 0 and zid % 2 = 1").selectExpr("zid as zone", "case zid % 3 when 0 then 'main' when 1 then 'conditional' else 'auxiliary' end as section", "'2' as allowed_code")
    rows = lookup.allowing_section(placed.join(coded, "pid"), allowed, "use_code", "zid")
    verdict = (
        F.when(F.col("zid").isNull(), "no_actual_zone")
        .when(F.col("use_code").isNull(), "unclear")
        .when(F.col("section").isNotNull(), F.concat(F.lit("allowed_"), "section"))
        .otherwise("not_allowed")
    )
    return rows.select("pid", verdict.alias("verdict"))


@_query("""select vec_id, code, row_number() over (order by vec_id) as place from (select vec_id, case when vec_id % 3 = 0 then label || '.x' else label || '.' || (vec_id % 7) end as code, vec_id % 100 / 100.0 as score from embeddings)
where regexp_full_match(code, '[0-9]+([.][0-9]+)*') and score >= 0.52""")
def q55_valid_code_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").selectExpr("vec_id", "case when vec_id % 3 = 0 then concat(label, '.x') else concat(label, '.', vec_id % 7) end as code", "vec_id % 100 / 100.0D as score")
    good = rows.where(is_code("code") & (F.col("score") >= 0.52)).dropDuplicates(["vec_id"])
    from ..operators.ranking import placed

    return placed(good, F.col("vec_id")).select("vec_id", "code", "place")


@_query("""select p_partkey, case when lower(trim(t)) in ('', '-', 'nan', 'none', 'null') then 'unnamed' else trim(t) end as zone_name, 'unclear' as verdict, null::varchar as reason
from (select p_partkey, case p_partkey % 6 when 0 then ' NaN ' when 1 then '-' when 2 then null when 3 then '' else ' ' || p_brand || ' ' end as t from part) x where t is not null or true""".replace("case when lower(trim(t)) in", "case when t is null or lower(trim(t)) in"))
def q56_blank_and_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 6 when 0 then ' NaN ' when 1 then '-' when 2 then null when 3 then '' else concat(' ', p_brand, ' ') end as t")
    named = rows.select("p_partkey", F.when(is_placeholder("t"), "unnamed").otherwise(normal("t")).alias("zone_name"))
    defaults = {"verdict": F.lit("unclear"), "reason": F.lit(None).cast("string")}
    return named.withColumns({c: v for c, v in defaults.items() if c not in named.columns})


@_query(f"""select p.pid as "Номер", r.code as "Код_зоны", round(r.area / r.parea, 6) as "Доля" from {PARCELS_SQL} p left join {_RANKED} r on p.pid = r.pid and rn = 1""")
def q57_result_projection(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    out = spatial.dominant_alike(p, zones(spark, d), spatial.overlaps, *spatial.BOX).withColumn("share", F.round("share", 6))
    names = {"pid": "Номер", "actual_code": "Код_зоны", "share": "Доля", "verdict": "Вердикт_ПЗЗ"}
    return out.select([F.col(a).alias(b) for a, b in names.items() if a in out.columns])


@_query("""select s_suppkey as zone_id, cast(s_nationkey as varchar) as zone_code, coalesce(nullif(case when s_suppkey % 3 = 0 then '' else 'nick ' || s_nationkey end, ''), s_name) as zone_name,
n_name as summary from supplier left join nation on s_nationkey = n_nationkey and n_nationkey % 5 <> 0""")
def q58_zones_info(spark: SparkSession, d: str) -> DataFrame:
    zone = F.struct(F.col("s_nationkey").alias("id"), F.expr("case when s_suppkey % 3 = 0 then '' else concat('nick ', s_nationkey) end").alias("nickname"))
    features = table(spark, d, "supplier").select("s_suppkey", F.struct(zone.alias("functional_zone_type"), F.col("s_name").alias("name")).alias("properties"))
    flat = features.select(
        F.col("s_suppkey").alias("zone_id"), F.col("properties.functional_zone_type.id").cast("string").alias("zone_code"),
        F.coalesce(F.nullif("properties.functional_zone_type.nickname", F.lit("")), "properties.name").alias("zone_name"),
    )
    mapping = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("zone_code"), F.col("n_name").alias("summary"))
    return flat.join(F.broadcast(mapping), "zone_code", "left").select("zone_id", "zone_code", "zone_name", "summary")


@_query("""select kind, count(*) as n from (select case p_partkey % 4 when 0 then 'MultiPolygon' when 1 then 'GeometryCollection' when 2 then 'Point' else 'Polygon' end as kind from part
union all select 'Polygon' from supplier) group by 1""")
def q69_shape_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.expr("case p_partkey % 4 when 0 then 'MultiPolygon' when 1 then 'GeometryCollection' when 2 then 'Point' else 'Polygon' end").alias("kind"))
    return a.union(table(spark, d, "supplier").select(F.lit("Polygon"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query("""with m as (select code, arg_max(name, pos) as name from (select n_regionkey || '.' || (n_nationkey % 3) as code, n_name as name, n_nationkey as pos from nation where n_nationkey % 4 <> 0
union all select cast(r_regionkey as varchar), r_name, 100 + r_regionkey from region) x where name <> '' group by 1),
a as (select s_suppkey, (s_suppkey % 5) || '.' || (s_nationkey % 3) || '.' || s_suppkey as code from supplier)
select s_suppkey, code, (select arg_max(m.name, length(m.code)) from m where m.code = a.code or starts_with(a.code, m.code || '.')) as display_name from a""")
def q70_display_name_map(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").where("n_nationkey % 4 <> 0").selectExpr("concat(n_regionkey, '.', n_nationkey % 3) as code", "n_name as name", "n_nationkey as pos")
    b = table(spark, d, "region").selectExpr("cast(r_regionkey as string)", "r_name", "100 + r_regionkey")
    names = a.union(b).where("name <> ''").groupBy("code").agg(F.max_by("name", "pos").alias("name"))
    asked = table(spark, d, "supplier").selectExpr("s_suppkey", "concat(s_suppkey % 5, '.', s_nationkey % 3, '.', s_suppkey) as code")
    return lookup.by_prefix(asked, names, "code", "name", "display_name")


@_query()
def q82_projected_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of each parcel, read as thousandths of a degree from (30, 59), in the UTM zone of the layer's centre."""
    p = parcels(spark, d).selectExpr("pid", *[f"{30 if c[0] == 'x' else 59}.0D + {c} / 1000.0D as {c}" for c in spatial.BOX])
    centre = p.agg(F.min("x0"), F.max("x1")).first()
    zone = F.lit(int(((centre[0] + centre[1]) / 2 + 180) // 6) + 1)
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    ring = F.array(*[F.array(*to_utm(F.col(x), F.col(y), zone)) for x, y in corners])
    return p.select("pid", F.round(area(F.array(F.array(ring))), 2).alias("area_m2"))


@_query()
def q83_inside_point(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).select("pid", _octagon().alias("shape")).withColumn("point", spatial.representative("shape"))
    return p.select("pid", F.col("point")[0].alias("px"), F.col("point")[1].alias("py"), spatial.holds("shape", F.col("point")[0], F.col("point")[1]).alias("inside"))


@_query(f"""with recursive e as materialized (select * from {EDGES_SQL} x), walk(code, path) as (select code, code from e where parent is null union all
select e.code, w.path || '>' || e.code from walk w join e on e.parent = w.code) select code, path from walk where code not in (select parent from e where parent is not null)""")
def q84_tree_leaf_paths(spark: SparkSession, d: str) -> DataFrame:
    return lookup.leaf_paths(edges(spark, d))


@_query("""select s_suppkey, year, exists (select 1 from (values (2020, 'A'), (2021, 'B'), (2023, 'A')) v(y, s) where y = year and s = source) as known,
(select string_agg(y || ':' || s, ',' order by y, s) from (values (2020, 'A'), (2021, 'B'), (2023, 'A')) v(y, s)) as alternatives
from (select s_suppkey, 2019 + s_suppkey % 5 as year, case when s_nationkey % 2 = 0 then 'A' else 'B' end as source from supplier)""")
def q88_source_exists(spark: SparkSession, d: str) -> DataFrame:
    held = spark.createDataFrame([(2020, "A"), (2021, "B"), (2023, "A")], "year bigint, source string")
    asked = table(spark, d, "supplier").selectExpr("s_suppkey", "2019 + s_suppkey % 5 as year", "case when s_nationkey % 2 = 0 then 'A' else 'B' end as source")
    every = held.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("year", "source"))), lambda s: F.concat_ws(":", s["year"], s["source"])), ",").alias("alternatives"))
    found = asked.join(F.broadcast(held.withColumn("known", F.lit(True))), ["year", "source"], "left")
    return found.crossJoin(F.broadcast(every)).select("s_suppkey", "year", F.coalesce("known", F.lit(False)).alias("known"), "alternatives")
