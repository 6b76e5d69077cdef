"""URL filtering by lists that change over time.

A list is a log of dated entries: on a date an entry (a host, which covers its subdomains, or
a host and path prefix) is added to a category or removed from it. Each entry's log becomes
validity intervals [from, until), and an as-of join finds for each capture the entries active when it
was fetched. A capture is looked up by the host itself and each parent domain, so the join is
an equality on the host with the interval and the path prefix as further conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


def url_host(url: str | Column) -> Column:
    """Host in lower case, without user, port, a leading www. and a trailing dot; null if there is none."""
    host = F.regexp_extract(F.trim(F.col(url) if isinstance(url, str) else url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return plain_host(host)


def plain_host(host: str | Column) -> Column:
    """A host in lower case without a leading www. and a trailing dot; null if nothing is left."""
    c = F.col(host) if isinstance(host, str) else host
    return F.nullif(F.regexp_replace(F.lower(c), r"^www\.|\.$", ""), F.lit(""))


def url_path(url: str | Column) -> Column:
    """Path without query and fragment; / where it is empty."""
    path = F.regexp_extract(F.trim(F.col(url) if isinstance(url, str) else url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(category, verdict, host, prefix, valid_from, valid_until) of a log (category, verdict, host, prefix, day, change).

    change is `add` or `remove`; valid_until is null while the entry lasts. Days given twice
    count once, the removal first, so a removal and an addition on one day leave the entry in. An
    addition of what is there or a removal of what isn't changes nothing. Entries without host or day are void. Hosts
    are brought to the form of url_host, so that an entry for www.x.org. is one for x.org.
    """
    log = entries.select(
        "category", "verdict", plain_host(F.trim("host")).alias("host"), F.coalesce("prefix", F.lit("/")).alias("prefix"), "day", (F.col("change") == "add").alias("on")
    ).where("host is not null and day is not null and on is not null")
    entry = ["category", "verdict", "host", "prefix"]
    states = log.groupBy(*entry, "day").agg(F.max("on").alias("on"))
    line = Window.partitionBy(*entry).orderBy("day")
    turns = states.withColumn("before", F.coalesce(F.lag("on").over(line), F.lit(False))).where("on != before")
    return (
        turns.withColumn("valid_until", F.lead("day").over(line))
        .where("on")
        .select(*entry, F.col("day").alias("valid_from"), "valid_until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """One row per row of captures: key, host, n_active (entries that match and were active), categories, blocked.

    An active entry that allows outweighs all that block. Captures without a host or date
    match nothing and aren't blocked. Repeated captures are each evaluated: a row number of their own
    isn't needed, as rows equal in key, url and date have equal results. A URL of any length is matched
    whole. Other columns, whatever their names, are ignored; no captures give no rows, and an empty list blocks nothing.
    """
    base = captures.select(F.col(key).alias("k"), url_host(url).alias("host"), url_path(url).alias("path"), F.col(fetched).alias("at"))
    #: Equal lookups are made once, so a host with a third of all captures is looked up as often as it has paths and dates.
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked = base.where("host is not null and at is not null").select("host", "path", "at").distinct()
    probes = looked.withColumn("domain", F.explode(domains))
    spans = intervals(entries).withColumnRenamed("host", "domain")
    hits = probes.join(spans, "domain").where(
        F.expr("at >= valid_from and (valid_until is null or at < valid_until) and startswith(path, prefix)")
    )
    found = hits.groupBy("host", "path", "at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max(F.col("verdict") == ALLOW).alias("allowed"),
        F.max(F.col("verdict") == BLOCK).alias("listed"),
    )
    return base.join(found, ["host", "path", "at"], "left").select(
        F.col("k").alias(key),
        "host",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        (F.coalesce("listed", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("blocked"),
    )
