"""Rule tables as column expressions, without a pass over the data for each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"strong": 100, "medium": 70, "weak": 35}


def search(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, with word characters and boundaries of any script."""
    return c.rlike("(?U)" + pattern)


def family_scores(canon: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Array of (score, -place, family) of the families whose patterns occur, scores of one family added up."""
    order: dict[str, list[tuple[int, str]]] = {}
    for family, weight, pattern in rules:
        order.setdefault(family, []).append((WEIGHTS[weight], pattern))
    items = []
    for place, (family, own) in enumerate(order.items()):
        score = reduce(lambda a, b: a + b, [F.when(search(canon, p), w).otherwise(0) for w, p in own])
        items.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(family).alias("family")))
    return F.filter(F.array(*items), lambda s: s["score"] > 0)


def profile(canon: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (family, confidence): the best score, the first family of a tie; unknown and weak where no rule fits."""
    best = F.array_max(family_scores(canon, rules))
    score = best["score"]
    confidence = F.when(score >= 100, "strong").when(score >= 60, "medium").otherwise("weak")
    empty = canon == ""
    return F.struct(
        F.when(empty | score.isNull(), "unknown").otherwise(best["family"]).alias("family"),
        F.when(empty, "none").when(score.isNull(), "weak").otherwise(confidence).alias("confidence"),
    )


#: Keys whose patterns also count for a family.
FURTHER_KEYS = {
    "education_preschool": ["education"],
    "education_school": ["education"],
    "education_professional": ["education"],
    "residential_multifamily": ["residential_unspecified", "residential_mid", "residential_high", "residential_low"],
    "public_admin": ["business"],
    "defense_security": ["public_admin"],
    "street_network": ["public_land", "transport"],
    "household_outbuilding": ["garage", "residential_individual", "residential_blocked", "residential_low", "residential_unspecified"],
    "public_safety": ["public_admin", "communal_engineering"],
    "hotel": ["business"],
    "recreation": ["culture"],
}


def candidate_keys(family: str) -> list[str]:
    more = FURTHER_KEYS.get(family, ["residential_unspecified"] if family.startswith("residential_") else [])
    return [family, *more]


def profile_rank(family: Column, text: Column, patterns: dict[str, list[tuple[str, int]]]) -> Column:
    """The highest rank of the family's keys whose pattern occurs in the text; 0 without one."""
    out = F.lit(0)
    for name in patterns:
        own = [F.when(search(text, p), r).otherwise(0) for key in candidate_keys(name) for p, r in patterns.get(key, [])]
        if own:
            out = F.when(family == name, F.greatest(F.lit(0), *own) if len(own) > 1 else own[0]).otherwise(out)
    return out


def hints(canon: Column, rules: list[tuple[str, str | None, list[str]]]) -> Column:
    """Phrases, in the rules' order, of those whose pattern occurs and whose guard doesn't."""
    parts = []
    for pattern, guard, phrases in rules:
        ok = search(canon, pattern)
        if guard:
            ok &= ~search(canon, guard)
        parts.append(F.when(ok, F.array(*map(F.lit, phrases))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def first_match(c: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The name of the first rule (name, pattern) that occurs."""
    out = None
    for name, pattern in rules:
        out = F.when(search(c, pattern), name) if out is None else out.when(search(c, pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def evidence(text: Column, pattern: str, block: str, least: int = 10, most: int = 220) -> Column:
    """First phrase of a text, cut at stops, semicolons and line ends, that holds the pattern; null where the block pattern occurs."""
    phrases = F.transform(F.split(text, r"[\n.;]"), lambda p: F.trim(p))
    good = F.filter(phrases, lambda p: (F.length(p) >= least) & search(p, pattern))
    return F.when(~search(text, block), F.substring(F.get(good, F.lit(0)), 1, most))
