"""The text rules on hand-made and Russian texts."""

import pytest
from pyspark.sql import functions as F

from lotsift.functions import rules
from lotsift.functions import text as T
from lotsift.functions.stemmer import stem
from lotsift.operators import rulebook


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("в", "в"), ("вавиловка", "вавиловк"), ("вагнера", "вагнер"), ("вагон", "вагон"), ("вагона", "вагон"), ("важная", "важн"), ("важнейшие", "важн"), ("важничал", "важнича"),
        ("валандался", "валанда"), ("валентина", "валентин"), ("жилой", "жил"), ("строительство", "строительств"), ("размещение", "размещен"), ("гараж", "гараж"), ("steel", "steel"),
        ("противоестественном", "противоестествен"), ("радость", "радост"), ("объектов", "объект"), ("территории", "территор"),
    ],
)
def test_stems_of_the_published_vocabulary(word, want):
    assert stem(word) == want


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [(None, ""), (" NaN ", ""), ("none", ""), ("  a ", "a"), ("null", ""), ("nullable", "nullable")])
def test_normal(spark, raw, want):
    assert one(spark, T.normal("c0"), raw) == want


def test_plain(spark):
    assert one(spark, T.plain("c0"), ' Ёлка «дом»/сад (а), б-в__г ') == "елка дом сад а б в г"


def test_canonical_forms(spark):
    df = spark.createDataFrame([("Для размещения индивидуального жилого дома",), ("для ИЖС",), (None,), ("для ИЖС",)], "t string")
    got = sorted({(r.t or "", r.a) for r in T.canonical(df, "t", "a").collect()})
    assert got == [("", ""), ("Для размещения индивидуального жилого дома", "размещен индивидуальн жил дом"), ("для ИЖС", "индивидуальн жилищн строительств")]
    assert T.canonical(df, "t", "a").count() == 4


def test_exactish(spark):
    assert one(spark, T.exactish("c0", "c1"), "a b c d", "a b c e") is True
    assert one(spark, T.exactish("c0", "c1"), "a b", "a c") is False
    assert one(spark, T.exactish("c0", "c1"), "", "") is False
    assert one(spark, T.exactish("c0", "c1"), "abcdefghij", "abcdefghijklmn") is True


def test_truncated_and_codes(spark):
    assert one(spark, T.truncated("c0", 5), "abcdefg") == "abcd…"
    assert one(spark, T.truncated("c0", 5), "abcde") == "abcde"
    assert one(spark, T.leading_codes("c0"), "2.1 name, x, 12.0.1 other") == ["2.1", "12.0.1"]
    assert one(spark, T.code_list("c0"), "1.0 | 2.0;nan, 3") == ["1.0", "2.0", "3"]


def test_residential_without_type(spark):
    for text, want in (("размещен жил дом", True), ("малоэтажн жил дом", False), ("обслуживан жил застройк", False), ("гараж", False), ("мкд", True)):
        assert one(spark, T.residential_unspecified("c0"), text) is want


def test_profiles_and_hints(spark):
    p = rulebook.profile(F.col("c0"), rules.PROFILE_RULES)
    assert one(spark, p["family"], "трансформаторн подстанц") == "communal_engineering"
    assert one(spark, p["confidence"], "жил дом") == "weak"
    assert one(spark, p["family"], "") == "unknown"
    hints = one(spark, rulebook.hints(F.col("c0"), rules.HINT_RULES), "гараж")
    assert hints == ["размещение гаражей для собственных нужд", "хранение автотранспорта", "гараж индивидуальный"]
    assert one(spark, rulebook.hints(F.col("c0"), rules.HINT_RULES), "служебн гараж") == []
    rank = rulebook.profile_rank(F.lit("sport"), F.col("c0"), rules.PROFILE_PATTERNS)
    assert one(spark, rank, "спорт") == 100


def test_verdicts(spark):
    v = T.verdict("c0", "c1", "c2", F.lit(""))
    for args, want in ((("allowed", "main", ""), "allowed_main"), (("allowed", "", "условно"), "allowed_conditional"), (("what", "", ""), "unclear"), (("Not_Allowed", "main", ""), "not_allowed")):
        assert one(spark, v, *args) == want
    assert one(spark, T.label("c0"), "no_actual_zone") == "Нет пересечения с ПЗЗ"


def test_outer_json(spark):
    assert one(spark, F.to_json(T.outer_json("c0")), 'so {"a":1} it') == '{"a":1}'
    assert one(spark, F.to_json(T.outer_json("c0")), "none") is None
