"""Classifier documents of every shape, and lookups against the rules in plain Python."""

import json
import random
import time

from lotsift.operators import classifier as C


def entry(code, name, **more):
    return {"code": code, "name": name, **more}


def read(spark, docs):
    df = spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False) if not isinstance(d, str) else d) for k, d in docs.items()], "doc string, value string")
    out = {}
    for r in sorted(C.entries_of(df, key="doc").collect(), key=lambda r: (r.doc, r.pos)):
        out.setdefault(r.doc, []).append((r.pos, r.code, r.name, r.name_plain))
    return out


def test_shapes(spark):
    three = [entry("2.0", " Жилая застройка ", description="d", name_plain="жилая"), entry("x", "bad code"), "text", 5, None, entry("2.1", ""), entry("2.0", "Again"), entry(3, "number")]
    valid = [(0, "2.0", "Жилая застройка", "жилая"), (6, "2.0", "Again", "Again"), (7, "3", "number", "number")]
    got = read(
        spark,
        {
            "list": three,
            "entries": {"entries": three, "by_code": {"9": entry("9", "no")}},
            "by_code": {"entries": [], "by_code": {"z": entry("7.1", "z"), "a": entry("7.1", "a"), "m": "text", "b": entry("1", "b")}},
            "flat": {"2.0": {"name": "n"}, "2.1": {"name": "m"}},
            "empty": {},
            "null": "null",
            "broken": "{]",
            "cycle": [entry("1", "a", parent_code="2"), entry("2", "b", parent_code="1")],
        },
    )
    assert got["list"] == valid == got["entries"]
    assert got["by_code"] == [(0, "7.1", "z", "z"), (1, "7.1", "a", "a"), (3, "1", "b", "b")], "in the order of the text"
    assert got.keys() == {"list", "entries", "by_code", "cycle"} and len(got["cycle"]) == 2


def test_last_duplicate_wins_by_code(spark):
    df = spark.createDataFrame([(json.dumps([entry("1", "a"), entry("2", "b"), entry("1", "c")]),)], "value string")
    assert {r.code: r.name for r in C.by_code(C.entries_of(df)).collect()} == {"1": "c", "2": "b"}


def meant(code, name, entries):
    coded = {e["code"]: e for e in entries}.get(code)
    named = {}
    for e in entries:
        if name and name in (e["name"].lower(), e.get("name_plain", e["name"]).lower()):
            named.setdefault(e["code"], e)
    if coded and code in named:
        return named[code], "code_and_name"
    if named:
        return min(named.values(), key=lambda e: (len(e["code"]), e["code"])), "name"
    return (coded, "code") if coded else (None, None)


def test_lookup_by_code_and_name(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    entries = [entry(r.choice(["1", "1.2", "1.10", "2", "2.4.1", "10"]), r.choice(words), **({"name_plain": r.choice(words)} if r.random() < 0.4 else {}), description=str(k)) for k in range(14)]
    asked = [(i, c, n) for i, (c, n) in enumerate((c, n) for c in ["1", "1.2", "2.4.1", "9.9", "bad", "", None] for n in [*words, "omega", "", None])]
    df = spark.createDataFrame([(json.dumps(entries),)], "value string")
    rows = C.meant_entries(spark.createDataFrame(asked, "id long, code string, name string"), C.entries_of(df), "code", "name").collect()
    assert len(rows) == len(asked)
    for x in rows:
        e, how = meant(x.code, x.name or "", entries)
        assert (x.how, x.ref_code, x.ref_description) == (how, e and e["code"], e and e["description"]), x


def test_a_document_of_many_names_is_read_once(spark):
    named = {f"k{k * 7919 % 12_000}": entry(f"1.{k}", f"n{k}") for k in range(12_000)}
    began = time.monotonic()
    rows = read(spark, {"large": {"by_code": named}})["large"]
    # Reading the map once for each name took minutes.
    assert time.monotonic() - began < 60
    assert [(pos, name) for pos, _, name, _ in rows] == [(k, f"n{k}") for k in range(12_000)]


def test_named_entries_of_odd_documents(spark):
    got = read(
        spark,
        {
            "odd": '{"by_code": {"b": null, "\\u044f \\"q\\"": {"code": "1", "name": "\\u044f \\\\ \\"q\\""}, "a": [1], "": {"code": 2.50, "name": "n"}}}',
            "twice": '{"by_code": {"a": {"code": "1", "name": "x"}, "a": {"code": "2", "name": "y"}}}',
            "not": '{"by_code": [{"code": "1", "name": "x"}]}',
        },
    )
    assert got == {"odd": [(1, "1", 'я \\ "q"', 'я \\ "q"'), (3, "2.5", "n", "n")]}
