"""Rule tables compiled once: an automaton of what the patterns must contain names the few that are worth trying on a text.

From each pattern follow literals of which a match has one at least. All tables' literals stand in one automaton, so a text is read once, and
only patterns whose literals it has are matched. Distinct texts are read once each; what was found is a list of the patterns' numbers, from which
families, intents and decisions follow as expressions.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.rules import BRIDGE_BLOCKS, BRIDGE_EQUIVALENT, BRIDGE_HINTS, COVERAGE, INTENTS, PROFILE_INTENTS, PROFILE_RULES
from ..functions.text import canonical, normal
from .lookup import section_priority
from .matching import allowed, answered_once
from .rulebook import WEIGHTS

#: Literals shorter than this would occur in nearly every text.
LEAST = 2


def required(pattern: str) -> list[str] | None:
    """Literals of which every match of the pattern has one at least, as long as can be; None where no such list follows."""

    def of(sequence) -> list[str] | None:
        found: list[list[str]] = []
        run = ""
        for kind, value in [*sequence, (None, None)]:
            if kind is K.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append([run])
            run = ""
            inner = None
            if kind is K.BRANCH:
                each = [of(x) for x in value[1]]
                inner = None if any(x is None for x in each) else [y for x in each for y in x]
            elif kind is K.SUBPATTERN:
                inner = of(value[3])
            elif kind in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
                inner = of(value[2])
            if inner:
                found.append(inner)
        good = [f for f in found if min(map(len, f)) >= LEAST]
        return max(good, key=lambda f: min(map(len, f))) if good else None

    return of(_parser.parse(pattern))


class Rules:
    """Patterns by number, with the automaton of their literals."""

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p) for p in patterns]
        owners: dict[str, list[int]] = {}
        self.always = []
        for k, p in enumerate(patterns):
            literals = required(p)
            if literals is None:
                self.always.append(k)
            for x in set(literals or ()):
                owners.setdefault(x, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for x, ks in owners.items():
            self.automaton.add_word(x, ks)
        if owners:
            self.automaton.make_automaton()
        self.tried = 0

    def found(self, text: str | None) -> list[int]:
        if not text:
            return []
        likely = set(self.always)
        if len(self.automaton):
            for _, ks in self.automaton.iter(text):
                likely.update(ks)
        self.tried += len(likely)
        return [k for k in sorted(likely) if self.patterns[k].search(text)]


def with_found(df: DataFrame, text: str, patterns: list[str], out: str) -> DataFrame:
    """df with the numbers of the patterns that occur in a column of texts, in order; each distinct text is read once."""
    held: list[Rules] = []

    @F.arrow_udf(ArrayType(IntegerType()))
    def numbers(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Rules(patterns))
        return pa.array([held[0].found(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    read = df.select(F.col(text).alias("_t")).distinct().withColumn(out, numbers("_t"))
    return df.join(read, df[text].eqNullSafe(read["_t"]), "left").drop("_t")


def _any(found: Column | str, numbers: list[int]) -> Column:
    return F.arrays_overlap(F.col(found) if isinstance(found, str) else found, F.array(*map(F.lit, numbers)))


def profiles(df: DataFrame, canon: str, rules: list[tuple[str, str, str]] = PROFILE_RULES, out: str = "profile") -> DataFrame:
    """df with struct `out` (family, confidence, source, subtype, residential, auto) of a canonical text.

    The family of the highest sum of weights, the first of a tie; auto tells whether a dwelling may be decided without a person: it needs a type
    other than unspecified, as does any other use by this rule.
    """
    rows = with_found(df, canon, [p for *_, p in rules], "_hit")
    families = list(dict.fromkeys(f for f, *_ in rules))
    scores = []
    for place, family in enumerate(families):
        own = [F.when(F.array_contains("_hit", k), WEIGHTS[w]).otherwise(0) for k, (f, w, _) in enumerate(rules) if f == family]
        scores.append(F.struct(sum(own[1:], own[0]).alias("score"), F.lit(-place).alias("place"), F.lit(family).alias("family")))
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["score"] > 0))
    rows = rows.withColumn("_best", best)
    empty, none = F.col(canon) == "", F.col("_best").isNull()
    family = F.when(empty | none, "unknown").otherwise(F.col("_best.family"))
    score = F.col("_best.score")
    confidence = F.when(empty, "none").when(none, "weak").when(score >= 100, "strong").when(score >= 60, "medium").otherwise("weak")
    subtype = F.when(family.startswith("residential_"), F.substring_index(family, "residential_", -1))
    made = F.struct(
        family.alias("family"),
        confidence.alias("confidence"),
        F.when(empty, "empty").when(none, "unknown").otherwise("regex").alias("source"),
        subtype.alias("subtype"),
        (family.startswith("residential_") | (family == "residential")).alias("residential"),
        (~empty & subtype.isNotNull() & (subtype != "unspecified")).alias("auto"),
    )
    return rows.withColumn(out, F.when(F.col(canon).isNotNull(), made)).drop("_hit", "_best")


def covered(queries: DataFrame, items: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """(key, family, verdict, name, code, score) of queries (key, zone, canon) whose family's rule and an item of the zone cover them.

    items: (zone, section, name, code, canon), canon of all of an item's texts. The best item: by section, a code that the family prefers (or a child of one,
    by children (parent, code)), and whether its text would be asked about too; of equals the last name. Queries with one zone and text meet the items once.
    """
    return answered_once(queries, lambda asked: _covered(asked, items, children), "zone", "canon").drop("zone", "canon")


def _covered(queries: DataFrame, items: DataFrame, children: DataFrame | None) -> DataFrame:
    families = list(COVERAGE)
    asked = profiles(queries, "canon").withColumn("family", F.col("profile.family")).where(F.col("family").isin(*families))
    asked = with_found(asked, "canon", [COVERAGE[f]["query"] for f in families], "_q")
    number = F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(k))])
    asked = asked.withColumn("_n", F.element_at(number, F.col("family"))).where(F.array_contains("_q", F.col("_n"))).select("key", "zone", "family", "_n")
    held = with_found(items.withColumnRenamed("canon", "_text").where("_text <> ''"), "_text", [*(COVERAGE[f]["item"] for f in families), *(COVERAGE[f]["query"] for f in families)], "_i")
    codes = queries.sparkSession.createDataFrame([(f, c) for f in families for c in COVERAGE[f]["codes"]], "family string, code string")
    if children is not None:
        more = codes.join(children.select(F.col("parent").alias("code"), F.col("code").alias("child")), "code").select("family", F.col("child").alias("code"))
        codes = codes.union(more).distinct()
    pairs = asked.join(held, "zone").where(F.array_contains("_i", F.col("_n")))
    pairs = pairs.join(codes.withColumn("_preferred", F.lit(True)), ["family", "code"], "left")
    priority = section_priority("section")
    score = priority * 100 + F.when(F.col("_preferred"), 25).otherwise(0) + F.when(F.array_contains("_i", F.col("_n") + len(families)), 10).otherwise(0)
    best = pairs.groupBy("key", "family").agg(F.max(F.struct(score.alias("score"), priority.alias("p"), "name", "code", "section")).alias("b"))
    return best.select("key", "family", allowed(F.col("b.section")).alias("verdict"), F.col("b.name").alias("name"), F.col("b.code").alias("code"), F.col("b.score").alias("score"))


_INTENT_PATTERNS = [(name, p) for name, own in INTENTS.items() for p in own]
#: A zone's text with these words in this order is a historical park before all rules.
_FIRST = "историческ.*парк"


def _intent(found: str, patterns: list[tuple[str, str]]) -> Column:
    out = F.lit("unknown")
    for name in reversed(list(INTENTS)):
        out = F.when(_any(found, [k for k, (n, _) in enumerate(patterns) if n == name]), name).otherwise(out)
    return out


def bridged(queries: DataFrame, zones: DataFrame) -> DataFrame:
    """(key, zone_intent, object_intent, evidence) of queries (key, zone, canon) that a zone's purpose decides as allowed.

    zones: (zone, zone_name, zone_heading, zone_summary, main_full, retrieval). The purposes of zone and use are equal, or belong together and the zone's texts say
    so; a phrase of ten characters or more of these texts supports the use's purpose, and nothing in them forbids new building.
    """
    patterns = [p for _, p in _INTENT_PATTERNS]
    z = zones.select("zone", *[normal(c).alias(c) for c in ("zone_name", "zone_heading", "zone_summary", "main_full", "retrieval")])
    z = canonical(z.withColumn("_about", F.concat_ws(" ", "zone_name", "zone_heading", "zone_summary")), "_about", "_zone_canon")
    z = canonical(z.withColumn("_all", F.concat_ws(" ", "main_full", "retrieval")), "_all", "_text_canon")
    z = with_found(z, "_zone_canon", [*patterns, _FIRST], "_z")
    z = with_found(z, "_text_canon", [*BRIDGE_BLOCKS, *BRIDGE_HINTS], "_b")
    own = F.when(F.col("_zone_canon") == "", "unknown").when(_any("_z", [len(patterns)]), "historical_park").otherwise(_intent("_z", _INTENT_PATTERNS))
    n = len(BRIDGE_BLOCKS)
    z = z.select("zone", own.alias("zone_intent"), _any("_b", list(range(n))).alias("_blocked"), _any("_b", list(range(n, n + len(BRIDGE_HINTS)))).alias("_linked"), "main_full", "retrieval")
    # Phrases in order: those of the main uses, then those of the other text.
    cut = F.concat(*[F.split(c, r"[\n.;]") for c in ("main_full", "retrieval")])
    phrases = z.where("not _blocked").select("zone", F.posexplode(cut).alias("place", "_raw")).select("zone", "place", normal("_raw").alias("phrase")).where(F.length("phrase") >= 10)
    phrases = with_found(canonical(phrases, "phrase", "_phrase_canon"), "_phrase_canon", patterns, "_p")
    supported = F.filter(F.array(*[F.when(_any("_p", [k for k, (x, _) in enumerate(_INTENT_PATTERNS) if x == name]), name) for name in INTENTS]), lambda x: x.isNotNull())
    evidence = phrases.select("zone", "place", "phrase", F.explode(supported).alias("object_intent")).groupBy("zone", "object_intent").agg(F.min_by(F.substring("phrase", 1, 220), "place").alias("evidence"))
    asked = with_found(profiles(queries, "canon"), "canon", patterns, "_o")
    family = F.col("profile.family")
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in PROFILE_INTENTS.items() for x in kv]), family)
    purpose = F.when(family.startswith("residential_"), family).when(family == "residential", "residential_unspecified").otherwise(F.coalesce(mapped, _intent("_o", _INTENT_PATTERNS)))
    asked = asked.select("key", "zone", purpose.alias("object_intent"))
    rows = asked.join(z, "zone").where("zone_intent <> 'unknown' and object_intent <> 'unknown' and not _blocked")
    together = F.col("zone_intent").isin(*BRIDGE_EQUIVALENT) & F.col("object_intent").isin(*BRIDGE_EQUIVALENT) & F.col("_linked")
    rows = rows.where((F.col("zone_intent") == F.col("object_intent")) | together)
    return rows.join(evidence, ["zone", "object_intent"]).select("key", "zone_intent", "object_intent", "evidence")
