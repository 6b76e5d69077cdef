"""Text expressions of the matching rules, as columns; only stems and sequence ratios need Python, once for each distinct value."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .rules import CANON_A, CANON_B, DWELLING_INDICATOR, NON_DWELLING_GUARD, STOP_STEMS, TYPE_QUALIFIER
from .stemmer import stem

#: A token of a normal text, and what separates words inside the patterns that use \b with Cyrillic.
TOKEN = "[0-9a-zа-яё]+"
_SPACE = "[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F\\x85\\xA0]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal(x: Column | str) -> Column:
    """Stripped text; null and nan, none, null in any case are empty."""
    t = F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")
    return F.when(F.lower(t).isin("", "nan", "none", "null"), "").otherwise(t)


def is_placeholder(x: Column | str) -> Column:
    return F.lower(normal(x)).isin("", "-", "—", "–", "nan", "none", "null")


def plain(x: Column | str) -> Column:
    """Normal text in lower case, ё as е, quotes, brackets, stops, slashes and dashes as spaces, and these squeezed."""
    t = F.regexp_replace(F.lower(normal(x)), "ё", "е")
    for pattern in ("[\"'`«»]", "[()\\[\\]{}:;,.!?]", "[\\\\/]", "[-_]+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, f"{_SPACE}+", " "))


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(0))


def _rewritten(t: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.trim(F.regexp_replace(c, "(?U)" + r[0], r[1])), rules, t)


def rewritten_a(x: Column | str) -> Column:
    """Plain text after the ordered rewrites of the general form."""
    return _rewritten(plain(x), CANON_A)


def rewritten_b(x: Column | str) -> Column:
    """Plain text after those of the conservative form, which first drops shares, "existing" and outbuildings."""
    first = [
        (r"\b\d+/\d+\b", " "),
        (r"\b\d+\s*доли\b", " "),
        (r"\bсуществующ(?:его|ий|ая|ие)?\b", " "),
        (r"\bнадворн(?:ыми|ые|ая|ого)?\s+постройк(?:ами|и|а|ой)?\b", " "),
    ]
    t = reduce(lambda c, r: F.regexp_replace(c, "(?U)" + r[0], r[1]), first, plain(x))
    return F.regexp_replace(_rewritten(t, CANON_B), " +", " ")


@F.pandas_udf(StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: stem("индивидуальный" if w == "ижс" else w))


def canonical(df: DataFrame, source: str, out: str, form: str = "a", key: str | None = None) -> DataFrame:
    """df with column `out`: stems of the source's rewritten text joined by a space.

    Words are stemmed once each: distinct texts give distinct words, whose stems are joined back.
    """
    rewrite = rewritten_a if form == "a" else rewritten_b
    texts = df.select(F.col(source).alias("_text")).distinct().withColumn("_words", tokens(rewrite("_text")))
    words = texts.select("_text", F.posexplode("_words").alias("_at", "_word"))
    known = words.select("_word").distinct().withColumn("_stem", _stems("_word"))
    ordered = words.join(known, "_word").where("_stem <> ''").groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("_at", "_stem"))).alias("_all"))
    forms = ordered.select("_text", F.array_join(F.transform("_all", lambda s: s["_stem"]), " ").alias(out))
    left = df.withColumn("_key", F.col(source))
    return left.join(forms, left["_key"].eqNullSafe(forms["_text"]), "left").drop("_key", "_text").withColumn(out, F.coalesce(out, F.lit("")))


def stemmed(words: Column | str) -> Column:
    """Stems of an array of words, where a table of distinct words would cost more than it saves."""
    return _stem_arrays(_c(words))


@F.pandas_udf(ArrayType(StringType()))
def _stem_arrays(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [s for s in (stem("индивидуальный" if w == "ижс" else w) for w in ws) if s])


def split_words(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), " "), lambda w: w != "")


def overlap(left: Column, right: Column) -> Column:
    """Struct (overlap, coverage, jaccard) of two arrays of words as sets; zeros if either is empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    both = F.size(F.array_intersect(a, b)).cast("double")
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    zero = F.lit(0.0)
    return F.struct(
        F.when(empty, zero).otherwise(both).alias("overlap"),
        F.when(empty, zero).otherwise(both / F.greatest(F.size(a), F.lit(1))).alias("coverage"),
        F.when(empty, zero).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).alias("jaccard"),
    )


def exactish(left: Column | str, right: Column | str) -> Column:
    """Whether two canonical texts are equal, one the long start of the other, or share most of their words."""
    a, b = _c(left), _c(right)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    o = overlap(split_words(a), split_words(b))
    start = (a.startswith(b) | b.startswith(a)) & (short >= 10) & (short / F.greatest(long, F.lit(1)) >= 0.7)
    return (a != "") & (b != "") & ((a == b) | start | ((o["overlap"] >= 2) & (o["jaccard"] >= 0.55)))


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2 M / T of the matching blocks of two texts; 0 if either is empty."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)])


def with_ratio(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """df with the sequence ratio of two columns, computed once for each distinct pair."""
    pairs = df.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct().withColumn(out, sequence_ratio("_l", "_r"))
    return df.join(pairs, df[left].eqNullSafe(pairs["_l"]) & df[right].eqNullSafe(pairs["_r"]), "left").drop("_l", "_r")


def match_score(ratio: Column, words: Column) -> Column:
    """The cheap score: the best of ratio, 0.97 coverage and 1.08 jaccard, the latter two at most 1."""
    one = F.lit(1.0)
    return F.greatest(ratio, F.least(one, words["coverage"] * 0.97), F.least(one, words["jaccard"] * 1.08))


def short_description(words: Column, most: int = 24, stops: list[str] = STOP_STEMS) -> Column:
    """The first words that aren't stops; the first words of all if none are left."""
    kept = F.filter(words, lambda w: ~w.isin(*stops))
    return F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, most), " ")


def truncated(x: Column | str, most: int) -> Column:
    """At most `most` characters, the last of them … where the text is cut."""
    c = _c(x)
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def code_list(x: Column | str) -> Column:
    """Codes of a text that joins them with |, ; or commas."""
    return F.filter(F.transform(F.split(normal(x), r"\s*\|\s*|;\s*|,\s*"), normal), lambda p: p != "")


def leading_codes(x: Column | str) -> Column:
    """The dotted code that starts each part of a comma-separated text, where one does."""
    found = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda p: F.regexp_extract(F.trim(p), r"^(\d+(?:\.\d+)*)\b", 1))
    return F.filter(found, lambda p: p != "")


def is_code(x: Column | str) -> Column:
    return normal(x).rlike(r"^\d+(\.\d+)*$")


def verdict(raw: Column | str, section: Column | str, reason: Column | str, name: Column | str) -> Column:
    """A canonical verdict for a raw one; `allowed` and `allowed_...` are resolved by section, then by words."""
    v, s, r, n = (F.lower(normal(x)) for x in (raw, section, reason, name))
    canonical_set = ["allowed_main", "allowed_conditional", "allowed_auxiliary", "not_allowed", "unclear", "no_actual_zone", "no_zone_metadata"]
    starts = v.startswith("allowed_")
    words = F.concat_ws(" ", F.when(starts, v).otherwise(""), r, n)
    by_words = (
        F.when(words.rlike("услов|conditional"), "allowed_conditional")
        .when(words.rlike("вспомог|auxiliary"), "allowed_auxiliary")
        .otherwise("allowed_main")
    )
    by_section = F.when(s.isin("main", "conditional", "auxiliary"), F.concat(F.lit("allowed_"), s)).otherwise(by_words)
    return F.when(v.isin(*canonical_set), v).when((v == "allowed") | starts, by_section).otherwise("unclear")


LABELS = {
    "allowed": "Разрешен",
    "allowed_main": "Разрешен",
    "allowed_conditional": "Условно разрешен",
    "allowed_auxiliary": "Разрешен как вспомогательный",
    "not_allowed": "Не разрешен",
    "unclear": "Требуется ручная проверка",
    "no_actual_zone": "Нет пересечения с ПЗЗ",
    "no_zone_metadata": "Нет описания зоны в шаблоне",
}
MANUAL_REVIEW = LABELS["unclear"]


def label(x: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(s) for p in LABELS.items() for s in p])
    return F.coalesce(F.element_at(pairs, _c(x)), F.lit(MANUAL_REVIEW))


def verdict_class(x: Column | str) -> Column:
    v = F.coalesce(_c(x), F.lit(""))
    return F.when(v.startswith("allowed_"), "correct").when(v == "not_allowed", "wrong").otherwise("unclear")


def residential_unspecified(canon: Column | str, guard: str = NON_DWELLING_GUARD, indicator: str = DWELLING_INDICATOR, qualifier: str = TYPE_QUALIFIER) -> Column:
    """A dwelling without storeys or building type: guard absent, indicator present, qualifier absent."""
    c = _c(canon)
    return (c != "") & ~c.rlike("(?U)" + guard) & c.rlike("(?U)" + indicator) & ~c.rlike("(?U)" + qualifier)


def comparison_key(*parts: Column | str) -> Column:
    return F.concat_ws(" || ", *[_c(p) for p in parts])


def outer_json(x: Column | str) -> Column:
    """The text as JSON, or its part from the first brace to the last; null if neither parses."""
    c = _c(x)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))
