"""String decisions, review marks and failing services against plain loops over the same rules."""

import random
from difflib import SequenceMatcher

import pytest

from lotsift.operators import decisions as D
from lotsift.operators.matching import Thresholds

PRIORITY = {"main": 3, "conditional": 2, "auxiliary": 1}
WORDS = ["склад", "дом", "магазин", "рынок", "гараж", "сад", "школ", "спорт", "парк", "офис", "завод", "связь"]


def metrics(a, b, ratio):
    if not a or not b:
        return {"score": 0.0, "ratio": 0.0, "overlap": 0, "coverage": 0.0}
    x, y = set(a.split()), set(b.split())
    r = SequenceMatcher(None, a, b).ratio() if ratio else 0.0
    both = len(x & y)
    return {"score": max(r, min(1, both / len(x) * 0.97), min(1, both / len(x | y) * 1.08)), "ratio": r, "overlap": both, "coverage": both / len(x)}


def exactish(a, b):
    if not a or not b:
        return False
    x, y = set(a.split()), set(b.split())
    short, long = sorted((len(a), len(b)))
    start = (a.startswith(b) or b.startswith(a)) and short >= 10 and short / long >= 0.7
    return a == b or start or (len(x & y) >= 2 and len(x & y) / len(x | y) >= 0.55)


def plain(query, items, zone, ratio, t=Thresholds(), b=D.Borders()):
    canon, short = query["canon"], query["short"] or query["canon"]
    if not canon or not items:
        return None
    direct, best, second = [], None, -1.0
    for i in sorted(items, key=lambda i: i["pos"]):
        if exactish(canon, i["name_canon"]):
            return "exact_name", i["name"], i["section"], 1.0
        full, brief = metrics(canon, i["desc_canon"], ratio), metrics(canon, i["desc_long"], ratio)
        m = full if full["score"] >= brief["score"] else brief
        phrase = len(canon) >= 10 and canon in i["desc_canon"]
        if i["desc_canon"] and m["coverage"] >= t.direct_coverage and m["overlap"] >= max(2, min(4, len(canon.split()))) and (phrase or m["ratio"] >= t.direct_ratio):
            direct.append((PRIORITY[i["section"]], m["score"], i["name"], i["section"]))
        n, d = metrics(canon, i["name_canon"], ratio), metrics(short, i["desc_short"], ratio)
        score = max(n["score"], min(1.0, d["score"] * 0.98))
        if best is None or score > best[0]:
            second = best[0] if best else second
            best = (score, n, d, i)
        elif score > second:
            second = score
    if direct:
        p, s, name, section = max(direct)
        return "direct_description", name, section, s
    score, n, d, i = best
    margin = score - second
    z = [metrics(canon, zone["zone_name"], ratio)["score"], metrics(short, zone["zone_summary"], ratio)["score"], metrics(short, zone["zone_text"], ratio)["score"]]

    def by_zone(a, c):
        return score >= t.zone_candidate and (z[0] >= a or z[1] >= c or z[2] >= c)

    if margin >= t.margin and ((n["score"] >= t.name_strong and n["coverage"] >= t.name_coverage and n["overlap"] >= 2) or (d["score"] >= t.desc_strong and d["coverage"] >= t.desc_coverage and d["overlap"] >= 2)):
        kind = "high"
    elif by_zone(t.zone_name, t.zone_summary):
        kind = "zone_semantic_high"
    elif (n["score"] >= b.name and n["coverage"] >= b.name_coverage) or (d["score"] >= b.desc and d["coverage"] >= b.desc_coverage) or by_zone(b.zone_name, b.zone_summary):
        kind = "borderline"
    else:
        kind = "weak"
    return kind, i["name"], i["section"], score


@pytest.mark.parametrize("ratio", [True, False])
def test_string_decisions(spark, ratio):
    r = random.Random(4)

    def phrase(lo, hi):
        return " ".join(r.choice(WORDS) for _ in range(r.randrange(lo, hi)))

    items = [
        {"zone": f"Z{z}", "section": r.choice(list(PRIORITY)), "name": f"name{z}.{k}", "code": f"{k}.{z}", "name_canon": phrase(1, 6), "desc_canon": (long := phrase(0, 30)), "desc_short": " ".join(long.split()[:5]), "desc_long": " ".join(long.split()[:9]), "pos": k}
        for z in range(6)
        for k in range(5)
    ]
    zones = [{"zone": f"Z{z}", "zone_name": phrase(0, 4), "zone_summary": phrase(0, 5), "zone_text": phrase(1, 5)} for z in range(5)]
    queries = [{"key": f"k{k}", "zone": f"Z{r.randrange(8)}", "canon": (c := phrase(0, 7)), "short": r.choice(["", c])} for k in range(400)]
    want = {}
    for q in queries:
        zone = next((z for z in zones if z["zone"] == q["zone"]), {"zone_name": "", "zone_summary": "", "zone_text": ""})
        if (got := plain(q, [i for i in items if i["zone"] == q["zone"]], zone, ratio)) is not None:
            want[q["key"]] = got
    rows = D.string_decisions(*(spark.createDataFrame(x) for x in (queries, items, zones)), ratio=ratio).collect()
    assert {x.key for x in rows} == want.keys()
    seen = set()
    for x in rows:
        kind, name, section, score = want[x.key]
        assert (x.confidence, x.name, x.verdict) == (kind, name, f"allowed_{section}") and x.score == pytest.approx(score), x
        assert x.direct == (kind not in ("borderline", "weak"))
        seen.add(kind)
    assert len(seen) >= 5, seen


def test_review_marks(spark):
    allowed = [("1.2", "2.1"), ("1.2", "3.4"), ("1", "5.0"), ("7", None), ("7.1.2", None), ("9", "4.4")]
    rows = [
        ("a", "not_allowed", "1.2", "3.4 x, 9.9 y, 2.1 z", "why"),
        ("b", "not_allowed", "1.2.5", "2.1 x", None),
        ("c", "not_allowed", "1.3", "5.0 x, 2.1 y", " "),
        ("d", "allowed_main", "1.2", "2.1 x", "why"),
        ("e", "not_allowed", "7.1.2.3", "2.1 x", "why"),
        ("f", "not_allowed", None, "2.1 x", "why"),
        ("g", " Not_Allowed ", " 9 ", "4.4 x", "why"),
        ("h", "not_allowed", "8.8", "2.1 x", "why"),
        ("i", "not_allowed", "1.2", None, "why"),
    ]
    df = spark.createDataFrame(rows, "id string, verdict string, zone string, top string, reason string").selectExpr("*", "'s' as status")
    got = {r.id: r for r in D.manual_review(df, spark.createDataFrame(allowed, "zone string, code string"), "zone", "top").collect()}
    assert {k: r.allowed_codes for k, r in got.items()} == {"a": "3.4, 2.1", "b": "2.1", "c": "5.0", "d": None, "e": None, "f": None, "g": "4.4", "h": None, "i": None}
    assert got["a"].status == "Требуется ручная проверка" and got["a"].verdict == "not_allowed" and got["d"].status == "s"
    assert got["a"].reason == "why " + D.MANUAL_REASON + "3.4, 2.1." and got["b"].reason == D.MANUAL_REASON + "2.1." == got["b"].reason
    assert got["h"].reason == "why" and len(got) == 9


def test_a_row_that_fails_touches_no_other(spark):
    calls = spark.sparkContext.accumulator(0)

    def decide(row):
        calls.add(1)
        if row["n"] % 5 == 0:
            raise KeyError(f"row {row['n']}")
        return {"verdict": "allowed_main" if row["n"] % 2 else None, "code": "1.0", "method": "port", "reason": "r"}

    rows = {r.key: r for r in D.decided(spark.range(100).selectExpr("id as key", "id as n"), decide).collect()}
    assert len(rows) == 100 and calls.value == 100, "each row asks once"
    for k, r in rows.items():
        if k % 5 == 0:
            assert (r.verdict, r.method, r.scope, r.code) == ("not_allowed", "error", "error", None) and f"row {k}" in r.reason
        else:
            assert (r.verdict, r.scope) == ("allowed_main" if k % 2 else "unclear", "actual_zone")


def test_model_is_asked_again_with_five(spark):
    cands = [(f"q{q}", f"{k}.{q}", f"n{k}", k) for q in range(6) for k in range(1, 26)]
    df = spark.createDataFrame(cands, "query string, code string, name string, place long")
    calls = spark.sparkContext.accumulator(0)

    def ask(query, short):
        calls.add(1)
        codes = [c["code"] for c in short]
        if query == "q0":
            return codes[::-1][:5]
        if query == "q1" and len(short) == 20:
            return codes[:3]
        if query == "q2":
            raise ValueError("finish_reason is length")
        if query == "q3":
            return ["made up", codes[4], codes[4], " ", codes[2], "x", "y"]
        return [codes[1], codes[0], "no", "such", "codes"]

    got = {}
    for r in sorted(D.chosen_by_model(df, ask).collect(), key=lambda r: (r.query, r.place)):
        got.setdefault(r.query, []).append((r.code, r.tries, r.error))
    assert [c for c, _, _ in got["q0"]] == ["20.0", "19.0", "18.0", "17.0", "16.0"]
    assert [c for c, _, _ in got["q1"]] == ["2.1", "1.1", "3.1", "4.1", "5.1"] and got["q1"][0][1] == 2
    assert [c for c, _, _ in got["q2"]] == [f"{k}.2" for k in range(1, 6)] and got["q2"][0][1:] == (3, "finish_reason is length")
    assert [c for c, _, _ in got["q3"]] == ["5.3", "3.3", "1.3", "2.3", "4.3"]
    assert calls.value == 1 + 2 + 3 + 1 + 1 + 1

    def broken(query, short):
        raise OSError("connection refused")

    with pytest.raises(Exception, match="connection refused"):
        D.chosen_by_model(df, broken).collect()
    assert not D.may_retry("") and D.may_retry("bad JSON") and not D.may_retry("timeout")
