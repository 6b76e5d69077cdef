"""What names and descriptions alone decide about a use in a zone, and what happens where a service fails.

All pairs of a query with the items of its zone are scored once; the six outcomes of the string step follow from them in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lookup import section_priority
from .matching import Thresholds, allowed, direct_description, scored_items

MANUAL_REASON = "Среди Top-кандидатов есть ВРИ, разрешённые в фактической зоне: "
FAILED_REASON = "Внутренняя ошибка классификации: "


@dataclass(frozen=True)
class Borders:
    """From where a string match is at the border, and zones decide with it."""

    name: float = 0.88
    name_coverage: float = 0.45
    desc: float = 0.84
    desc_coverage: float = 0.40
    zone_name: float = 0.86
    zone_summary: float = 0.82


def _score(rows: DataFrame, left: str, right: str, out: str, ratio: bool) -> DataFrame:
    """rows with the cheap score of two canonical texts as struct `out` (score, ratio, overlap, coverage); zeros if either is empty."""
    rows = T.with_ratio(rows, left, right, "_ratio") if ratio else rows.withColumn("_ratio", F.lit(0.0))
    words = T.overlap(T.split_words(left), T.split_words(right))
    made = F.struct(T.match_score(F.col("_ratio"), words).alias("score"), F.col("_ratio").alias("ratio"), words["overlap"].alias("overlap"), words["coverage"].alias("coverage"))
    return rows.withColumn(out, made).drop("_ratio")


def string_decisions(queries: DataFrame, items: DataFrame, zones: DataFrame, ratio: bool = True, t: Thresholds = Thresholds(), b: Borders = Borders()) -> DataFrame:
    """(key, confidence, direct, verdict, name, code, score, margin) for each query whose zone has items and whose text has words.

    queries: (key, zone, canon, short); items: (zone, section, name, code, name_canon, desc_canon, desc_short, desc_long, pos), desc_short and desc_long being the first 24 and
    48 words of the description; zones: (zone, zone_name, zone_summary, zone_text), canonical. Confidence, in order: exact_name, of the first item that is almost the text;
    direct_description, where an item's description covers the text, by section, score and name; high, by name or description and a margin to the
    second; zone_semantic_high, where the zone's own name or summary fits as well; borderline; weak. `direct` tells whether the outcome decides. Without
    `ratio` only shares of common words count.
    """
    asked = queries.where("canon <> ''").withColumn("short", F.coalesce(F.nullif("short", F.lit("")), "canon"))
    pairs = scored_items(asked, items, ratio)
    pairs = _score(_score(pairs, "canon", "desc_canon", "full", ratio), "canon", "desc_long", "brief", ratio)
    better = F.when(F.col("full.score") >= F.col("brief.score"), F.col("full")).otherwise(F.col("brief"))
    pairs = pairs.withColumn("covers", better)
    is_direct = direct_description(F.col("canon"), F.col("desc_canon"), F.col("covers.score"), F.col("covers"), F.col("covers.ratio"), t)
    pairs = pairs.withColumn("is_exact", T.exactish("canon", "name_canon")).withColumn("is_direct", is_direct)
    found = ("name", "code", "section", "score", "name_score", "desc_score", "by_name", "by_desc")
    one = F.struct("score", (-F.col("pos")).alias("pos"), *[c for c in found if c != "score"])
    direct = F.struct(section_priority("section").alias("p"), F.col("covers.score").alias("score"), "name", "code", "section")
    best = pairs.groupBy("key").agg(
        F.min_by(F.struct("name", "code", "section"), F.when(F.col("is_exact"), F.col("pos"))).alias("exact"),
        F.max(F.when(F.col("is_direct"), direct)).alias("direct"),
        F.max(one).alias("best"),
        # Of equally good items the second best is as good as the best.
        F.sort_array(F.collect_set(F.struct("score", (-F.col("pos")).alias("pos"))), asc=False).alias("scores"),
        F.first("zone").alias("zone"),
        F.first("canon").alias("canon"),
        F.first("short").alias("short"),
    )
    rows = best.withColumn("second", F.when(F.size("scores") > 1, F.col("scores")[1]["score"]).otherwise(-1.0)).drop("scores").join(zones, "zone", "left").fillna("", ["zone_name", "zone_summary", "zone_text"])
    for left, right, out in (("canon", "zone_name", "by_zone"), ("short", "zone_summary", "by_summary"), ("short", "zone_text", "by_text")):
        rows = _score(rows, left, right, out, ratio)
    x = {c: F.col(f"best.{c}") for c in found}
    margin = F.col("best.score") - F.col("second")
    apart = margin >= t.margin
    name_strong = (x["name_score"] >= t.name_strong) & (x["by_name"]["coverage"] >= t.name_coverage) & (x["by_name"]["overlap"] >= t.overlap) & apart
    desc_strong = (x["desc_score"] >= t.desc_strong) & (x["by_desc"]["coverage"] >= t.desc_coverage) & (x["by_desc"]["overlap"] >= t.overlap) & apart

    def zone(name: float, summary: float) -> Column:
        fits = (F.col("by_zone.score") >= name) | (F.col("by_summary.score") >= summary) | (F.col("by_text.score") >= summary)
        return (x["score"] >= t.zone_candidate) & fits

    border = ((x["name_score"] >= b.name) & (x["by_name"]["coverage"] >= b.name_coverage)) | ((x["desc_score"] >= b.desc) & (x["by_desc"]["coverage"] >= b.desc_coverage)) | zone(b.zone_name, b.zone_summary)
    confidence = (
        F.when(F.col("exact").isNotNull(), "exact_name")
        .when(F.col("direct").isNotNull(), "direct_description")
        .when(name_strong | desc_strong, "high")
        .when(zone(t.zone_name, t.zone_summary), "zone_semantic_high")
        .when(border, "borderline")
        .otherwise("weak")
    )
    rows = rows.withColumn("confidence", confidence)

    def chosen(column: str) -> Column:
        by = F.when(F.col("confidence") == "exact_name", F.col(f"exact.{column}")).when(F.col("confidence") == "direct_description", F.col(f"direct.{column}"))
        return by.otherwise(x[column])

    score = F.when(F.col("confidence") == "exact_name", 1.0).when(F.col("confidence") == "direct_description", F.col("direct.score")).otherwise(x["score"])
    return rows.select(
        "key", "confidence", (~F.col("confidence").isin("borderline", "weak")).alias("direct"), allowed(chosen("section")).alias("verdict"), chosen("name").alias("name"), chosen("code").alias("code"), score.alias("score"), margin.alias("margin")
    )


def zone_codes_for_review(allowed_codes: DataFrame, zone: str = "zone", code: str = "code") -> DataFrame:
    """(zone, codes) of the codes (zone, code) that a zone allows; a zone without any is there with an empty set if it has a row with a null code."""
    return allowed_codes.groupBy(F.trim(zone).alias("zone")).agg(F.collect_set(code).alias("codes"))


def manual_review(rows: DataFrame, allowed_codes: DataFrame, zone: str, candidates: str) -> DataFrame:
    """rows (verdict, status, reason, a zone and its candidates as text) with has_allowed and allowed_codes: the candidates, in order, that the zone allows.

    Only rows that aren't allowed count. A zone whose own set is empty or missing falls back to its code's longest start at a stop that is known, be
    its set empty or not. Marked rows have the status of manual review and a reason more; the verdict stays.
    """
    sets = zone_codes_for_review(allowed_codes)
    own = F.trim(F.coalesce(F.col(zone), F.lit("")))
    asked = rows.select(own.alias("own")).distinct().where("own <> ''").withColumn("steps", F.coalesce(_starts("own"), F.array().cast("array<string>")))
    direct = sets.where(F.size("codes") > 0)
    at = asked.join(direct.withColumnRenamed("zone", "own"), "own", "left")
    back = at.where("codes is null").select("own", F.posexplode("steps").alias("place", "zone")).join(sets, "zone").groupBy("own").agg(F.min_by("codes", "place").alias("behind"))
    known = at.join(back, "own", "left").select("own", F.coalesce("codes", "behind").alias("_codes"))
    found = F.when(F.lower(F.trim("verdict")) == "not_allowed", F.filter(T.leading_codes(candidates), lambda c: F.array_contains("_codes", c)))
    marked = rows.withColumn("_own", own).join(known.withColumnRenamed("own", "_own"), "_own", "left").withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    has, listed = F.size("_found") > 0, F.array_join("_found", ", ")
    more = F.concat(F.lit(MANUAL_REASON), listed, F.lit("."))
    before = F.trim(F.coalesce("reason", F.lit("")))
    out = marked.withColumn("has_allowed", has).withColumn("allowed_codes", F.when(has, listed))
    out = out.withColumn("reason", F.when(has, F.trim(F.concat_ws(" ", F.nullif(before, F.lit("")), more))).otherwise(F.col("reason")))
    return out.withColumn("status", F.when(has, T.MANUAL_REVIEW).otherwise(F.col("status"))).drop("_own", "_codes", "_found")


def _starts(code: str) -> Column:
    """The starts of a dotted code at its stops, longest first; null where it has none."""
    parts = F.split(code, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda k: F.array_join(F.slice(parts, 1, k), ".")))


# Words in the message of an error after which a model is asked again, how often, and among how many.
RETRY_MARKS = ("empty assistant content", "content", "finish_reason", "length", "reasoning", "json")
TRIES, SHORTLIST, CHOSEN = 3, 20, 5


class NotRetried(RuntimeError):
    """An error of a service that asking again doesn't mend."""


def may_retry(error: BaseException | str) -> bool:
    """Whether the message has one of the marks; none is no reason to ask again."""
    message = str(error).strip().lower()
    return bool(message) and any(mark in message for mark in RETRY_MARKS)


def decided(rows: DataFrame, decide: Callable[[dict], dict], key: str = "key") -> DataFrame:
    """(key, verdict, code, name, method, scope, reason) of decide(row) for each row; a row on which it fails isn't allowed, with the error as its reason.

    decide gives verdict, code, name, method and reason; it is called once a row, in the tasks, and an error in one row touches no other.
    """
    columns = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for values in part.itertuples(index=False, name=None):
                row = dict(zip(columns, values, strict=True))
                try:
                    got = decide(row)
                    out.append((row[key], got.get("verdict") or "unclear", got.get("code"), got.get("name"), got.get("method"), "actual_zone", got.get("reason")))
                except Exception as error:  # noqa: BLE001  whatever a service raises ends here
                    out.append((row[key], "not_allowed", None, None, "error", "error", f"{FAILED_REASON}{error}"))
            yield pd.DataFrame(out, columns=["key", "verdict", "code", "name", "method", "scope", "reason"], dtype=object)

    kind = rows.schema[key].dataType.simpleString()
    made = rows.mapInPandas(run, f"key {kind}, verdict string, code string, name string, method string, scope string, reason string")
    return made.withColumnRenamed("key", key)


def _five(ask: Callable[[str, list[dict]], list], query: str, candidates: list[dict]) -> tuple[list[dict], int, str | None]:
    """The five chosen for a query, in how many tries, and the last error if they all failed."""
    error = None
    for attempt in range(1, TRIES + 1):
        short = candidates[: SHORTLIST if attempt == 1 else CHOSEN]
        try:
            codes = [c for c in (str(x).strip() for x in ask(query, short) or []) if c][:CHOSEN]
            if len(codes) != CHOSEN:
                raise ValueError(f"LLM returned unexpected ranked_codes length: {len(codes)}")
            by: dict[str, dict] = {}
            for item in short:
                by.setdefault(item["code"], item)
            order = [*dict.fromkeys(c for c in codes if c in by), *by]
            return [by[c] for c in dict.fromkeys(order)][:CHOSEN], attempt, None
        except Exception as failure:
            if not may_retry(failure):
                raise NotRetried(str(failure)) from failure
            error = str(failure)
    return candidates[:CHOSEN], TRIES, error


def chosen_by_model(candidates: DataFrame, ask: Callable[[str, list[dict]], list], key: str = "query") -> DataFrame:
    """(query, code, name, place, tries, error): five candidates (query, code, name, place) a query, in the order that the model gives.

    ask(query, candidates) gives five codes; it is asked up to three times, after the first with the first five candidates only. Codes it makes
    up are passed over, and places left are filled in order. An error whose message has none of RETRY_MARKS ends the job; a query
    whose tries all failed keeps its first five. Each query is one row here, of the SHORTLIST first candidates.
    """
    item = F.struct("place", "code", "name")
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= SHORTLIST)
    asked = first.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for query, items in zip(part[key], part["items"], strict=True):
                five, tries, error = _five(ask, query, [{"code": i["code"], "name": i["name"]} for i in items])
                out += [(query, i["code"], i["name"], n, tries, error) for n, i in enumerate(five, 1)]
            yield pd.DataFrame(out, columns=[key, "code", "name", "place", "tries", "error"]).astype({"error": object, "code": object, "name": object})

    return asked.mapInPandas(run, f"{key} {candidates.schema[key].dataType.simpleString()}, code string, name string, place bigint, tries int, error string")
