"""Catalogues of zones: flattening, allowed codes, and the repair of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_code, normal
from .lookup import SECTIONS, section_order

ITEM = "struct<vri_code:string,vri_name:string,vri_description:string>"
#: A code this long that isn't one is a description in the wrong field.
MISPLACED = 32


def flat_items(zones: DataFrame) -> DataFrame:
    """(zone_code, section, pos, vri_code, vri_name, vri_description) of zones with three arrays of items."""
    out = None
    for section in SECTIONS:
        rows = zones.select("zone_code", F.lit(section).alias("section"), F.posexplode(section).alias("pos", "i"))
        rows = rows.select("zone_code", "section", "pos", *[normal(F.col(f"i.{f}")).alias(f) for f in ("vri_code", "vri_name", "vri_description")])
        out = rows if out is None else out.union(rows)
    return out


def zone_rows(zones: DataFrame) -> DataFrame:
    """One row per zone: for each section its names and codes joined by |, and its full items joined by ;."""

    def texts(section: str) -> list[Column]:
        items = F.col(section)

        def field(name: str) -> Column:
            return F.array_join(F.filter(F.transform(items, lambda i: normal(i[name])), lambda t: t != ""), " | ")

        def chunk(i: Column) -> Column:
            parts = F.array(*[normal(i[f]) for f in ("vri_code", "vri_name", "vri_description")])
            return F.array_join(F.filter(parts, lambda t: t != ""), " | ")

        full = F.array_join(F.filter(F.transform(items, chunk), lambda t: t != ""), " ; ")
        return [field("vri_name").alias(f"{section}_names"), field("vri_code").alias(f"{section}_codes"), full.alias(f"{section}_full")]

    return zones.select("zone_code", *[c for s in SECTIONS for c in texts(s)])


def allowed_codes(items: DataFrame, zones: DataFrame, conditional: bool = False) -> DataFrame:
    """(code, codes): the sorted set of codes that each zone allows, and each base code the set of its first zone.

    items: (zone_code, section, vri_code); zones: (zone_code, base_code, pos).
    """
    wanted = ["main", "auxiliary", *(["conditional"] if conditional else [])]
    sets = items.where(F.col("section").isin(*wanted) & (F.col("vri_code") != "")).groupBy("zone_code").agg(F.array_sort(F.collect_set("vri_code")).alias("codes"))
    every = zones.join(sets, "zone_code", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    own = every.groupBy(F.col("zone_code").alias("code")).agg(F.max_by("codes", "pos").alias("codes"))
    base = every.where("base_code is not null").groupBy(F.col("base_code").alias("code")).agg(F.min_by("codes", "pos").alias("codes"))
    return own.union(base.join(own, "code", "left_anti"))


def modal(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent non-blank value of each key, the first seen of a tie."""
    counts = rows.where(F.trim(value) != "").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("f"), value)).alias("b")
    return counts.groupBy(key).agg(best).select(key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def sanitized(items: DataFrame, classifier: DataFrame, reference: DataFrame) -> DataFrame:
    """Items (.., vri_code, vri_name, vri_description, name_key) after their repair, with what was done as flags.

    classifier: (code, name, description) of valid codes; reference: (name_key, ref_code, ref_description), the usual
    attributes of items of a name. A description in the code field moves to its own field; what the
    classifier knows of a code replaces name and description; what is still missing comes from the reference.
    """
    n = {f: normal(f) for f in ("vri_code", "vri_name", "vri_description")}
    base = items.select(*[c for c in items.columns if c not in n], *[c.alias(f) for f, c in n.items()])
    base = base.withColumn("original_name", F.col("vri_name")).withColumn("original_description", F.col("vri_description"))
    c = classifier.select(F.col("code").alias("vri_code"), F.col("name").alias("c_name"), F.col("description").alias("c_desc"))
    joined = base.join(c, "vri_code", "left").join(reference, "name_key", "left")
    code, desc, name = F.col("vri_code"), F.col("vri_description"), F.col("vri_name")
    moved = (code != "") & ~is_code(code) & (F.length(code) >= MISPLACED) & ((desc == "") | (desc == name) | (desc == code))
    d1 = F.when(moved, code).otherwise(desc)
    known = F.col("c_name").isNotNull()
    renamed = known & (F.col("c_name") != "") & (F.lower(name) != F.lower("c_name"))
    n1 = F.when(renamed, F.col("c_name")).otherwise(name)
    described = known & (F.coalesce("c_desc", F.lit("")) != "") & (d1 != F.col("c_desc"))
    d2 = F.when(described, F.col("c_desc")).otherwise(d1)
    coded = ~is_code(code) & (F.coalesce("ref_code", F.lit("")) != "")
    filled = (n1 != "") & ((d2 == "") | (d2 == n1)) & (F.coalesce("ref_description", F.lit("")) != "")
    keep = [x for x in base.columns if x not in n]
    return joined.select(
        *keep,
        F.when(coded, F.col("ref_code")).otherwise(code).alias("vri_code"),
        n1.alias("vri_name"),
        F.when(filled, F.col("ref_description")).otherwise(d2).alias("vri_description"),
        moved.alias("moved"),
        known.alias("aligned"),
        renamed.alias("renamed"),
        (described | filled).alias("described"),
        coded.alias("coded"),
    ).withColumn("repaired", F.col("moved") | F.col("renamed") | F.col("described") | F.col("coded"))


def retrieval_text(items: DataFrame) -> DataFrame:
    """(zone_code, retrieval_text): every section's items as `code name description`, in the sections' order."""
    part = F.concat_ws(" — ", *[F.nullif(f, F.lit("")) for f in ("vri_code", "vri_name", "vri_description")])
    rows = items.select("zone_code", section_order("section").alias("o"), "section", "pos", part.alias("t")).where("t <> ''")
    sections = rows.groupBy("zone_code", "o", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("a"))
    lines = sections.select("zone_code", "o", F.concat("section", F.lit(": "), F.array_join(F.transform("a", lambda s: s["t"]), " ; "), F.lit(".")).alias("line"))
    return lines.groupBy("zone_code").agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("a")).select(
        "zone_code", F.array_join(F.transform("a", lambda s: s["line"]), " ").alias("retrieval_text")
    )
