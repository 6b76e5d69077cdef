"""The national classifier: entries from documents of any of its shapes, and the entry that a code and a name together mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("code", "name", "description", "parent_code", "top_level_code", "name_plain")


def entries_of(documents: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """Valid entries (pos, code, name, description, parent_code, top_level_code, name_plain) of classifier documents, and their document's `key`.

    A document is a list of entries, an object with a list `entries`, or, where that is missing or empty, one with an object `by_code` of entries; anything else,
    a flat object of codes too, has none. pos is the entry's place in its document. What isn't an object, has no valid code or no name is left out; a missing plain name is
    the name.
    """
    keep = [key] if key else []
    v = F.try_parse_json(text)
    docs = documents.select(*keep, F.col(text).alias("_text"), v.alias("_doc"))
    listed, inner = F.try_variant_get("_doc", "$", "array<variant>"), F.try_variant_get("_doc", "$.entries", "array<variant>")
    # A variant's members lie in the order of their names; their place in the document is that of its text. A map of the text is read once, whereas to look up each name
    # in the variant's map would read that map once a name.
    named = F.try_variant_get("_doc", "$.by_code", "map<string,variant>").isNotNull()
    in_order = F.when(named, F.map_values(F.from_json(F.get_json_object("_text", "$.by_code"), "map<string,variant>")))
    chosen = F.when(listed.isNotNull(), listed).when(F.size(inner) > 0, inner).otherwise(in_order)
    rows = docs.select(*keep, F.posexplode(chosen).alias("pos", "_entry"))
    own = rows.select(*keep, "pos", *[T.normal(F.try_variant_get("_entry", f"$.{f}", "string")).alias(f) for f in FIELDS])
    good = own.where(T.is_code("code") & (F.col("name") != ""))
    return good.withColumn("name_plain", F.when(F.col("name_plain") != "", F.col("name_plain")).otherwise(F.col("name")))


def by_code(entries: DataFrame) -> DataFrame:
    """One entry a code, the last of a document."""
    rest = [c for c in entries.columns if c != "code"]
    return entries.groupBy("code").agg(F.max_by(F.struct(*rest), "pos").alias("e")).select("code", "e.*")


def by_name(entries: DataFrame) -> DataFrame:
    """(name_key, pos, code, ..) of every entry under the canonical form of its name and of its plain name."""
    keyed = T.canonical(T.canonical(entries, "name", "_one"), "name_plain", "_two")
    keys = F.array_distinct(F.filter(F.array("_one", "_two"), lambda k: k != ""))
    return keyed.withColumn("name_key", F.explode(keys)).drop("_one", "_two")


def meant_entries(rows: DataFrame, entries: DataFrame, code: str, name: str) -> DataFrame:
    """rows with ref_code, ref_name, ref_description and how the entry was found: code_and_name, name, code, or null where there is none.

    An entry of the name with the code is meant before all; else the entry of the name of the shortest, then smallest code, even if the code says
    another; else the code's. Of entries of one name and code the first of the document counts. A code that has no valid form means nothing.
    """
    asked = T.canonical(rows.withColumn("_code", T.normal(code)), name, "_canon")
    shape = F.struct("code", "name", "description")
    known = by_code(entries).select(F.col("code").alias("_code"), shape.alias("_coded"))
    first = by_name(entries).groupBy("name_key", "code").agg(F.min_by(shape, "pos").alias("e"))
    names = first.groupBy(F.col("name_key").alias("_canon")).agg(
        F.map_from_entries(F.collect_list(F.struct("code", "e"))).alias("_of"), F.min_by("e", F.struct(F.length("code"), "code")).alias("_named")
    )
    joined = asked.join(known, (asked["_code"] == known["_code"]) & T.is_code(asked["_code"]), "left").drop(known["_code"]).join(names, "_canon", "left")
    both = F.when(F.col("_coded").isNotNull(), F.try_element_at("_of", "_code"))
    how = F.when(both.isNotNull(), "code_and_name").when(F.col("_named").isNotNull(), "name").when(F.col("_coded").isNotNull(), "code")
    entry = F.coalesce(both, "_named", "_coded")
    made = joined.withColumn("_e", entry).withColumn("how", how)
    return made.select(*rows.columns, F.col("_e.code").alias("ref_code"), F.col("_e.name").alias("ref_name"), F.col("_e.description").alias("ref_description"), "how")
