"""Aggregate reports of verdicts, and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated, verdict_class


def fit_report(rows: DataFrame, zone: str = "zone", verdict: str = "verdict", order: str = "ord", name: str = "zone_name") -> DataFrame:
    """Counts of correct, wrong and unclear objects for each zone and in all (zone null, overall true), in one pass.

    Zones come by wrong, then total, then first appearance; a row without zone counts in __no_zone__.
    """
    fit = verdict_class(verdict)
    base = rows.select(F.coalesce(zone, F.lit("__no_zone__")).alias("zone"), fit.alias("fit"), F.col(order).alias("ord"), F.col(name).alias("zone_name"))
    counts = [F.count_if(F.col("fit") == f).alias(f"n_{f}") for f in ("correct", "wrong", "unclear")]
    out = base.groupingSets([["zone"], []], "zone").agg(
        F.grouping("zone").cast("boolean").alias("overall"), F.count(F.lit(1)).alias("n_total"), *counts, F.min_by("zone_name", "ord").alias("zone_name"), F.min("ord").alias("first_ord")
    )
    return out.withColumn("zone_name", F.when(~F.col("overall"), F.col("zone_name")))


def capped(rows: DataFrame, by: list[Column], most: int, out: str = "more") -> DataFrame:
    """The first `most` rows of a report in an order, each with how many more there are."""
    n = rows.count()
    return rows.orderBy(*by).limit(most).withColumn(out, F.lit(max(0, n - most)).cast("bigint"))


def problem_rows(rows: DataFrame, by: list[Column], most: int = 60, chars: int = 240) -> DataFrame:
    """Objects whose fit is wrong or unclear, at most so many, reasons cut to so many characters."""
    bad = rows.where(F.col("fit").isin("wrong", "unclear"))
    return bad.orderBy(*by).limit(most).withColumn("reason", truncated("reason", chars))


def candidate_summary(rows: DataFrame, candidates: Column) -> DataFrame:
    has = F.coalesce(F.length(F.trim(candidates)) > 0, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(has).alias("n_with"), F.count_if(~has).alias("n_without"))


def grounding(report_json: Column, problems_json: Column, most: int = 12_000) -> Column:
    """The whole report where it is short enough, else its problem objects."""
    return F.when(F.length(report_json) <= most, report_json).otherwise(problems_json)


def summary_lines(report: DataFrame) -> DataFrame:
    """One text of all zones of a fit report, worst first."""
    line = F.format_string("%s: %d of %d wrong", F.col("zone"), F.col("n_wrong"), F.col("n_total"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n_wrong")).alias("w"), (-F.col("n_total")).alias("t"), "zone", line.alias("line"))))
    return report.where("not overall").agg(ordered.alias("a")).select(F.array_join(F.transform("a", lambda s: s["line"]), "\n").alias("summary"))
