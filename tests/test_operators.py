"""Operators on small tables made by hand."""

import pytest
from pyspark.sql import functions as F

from lotsift.functions import text
from lotsift.functions.rules import FLOOR_BANDS, FLOOR_FALLBACK, TYPE_CODES
from lotsift.operators import ledger, lookup, matching, ports, ranking


def test_floor_bands(spark):
    floors = [("4", "2.1.1"), ("5", "2.5"), ("8", "2.5"), ("9", "2.6"), (None, "2.1"), ("5.0", "2.1"), ("x", "2.1")]
    rows = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(floors)], "i int, f string").select("i", lookup.banded_code(F.lit(4), F.col("f"), 4, TYPE_CODES, FLOOR_BANDS, FLOOR_FALLBACK).alias("c"))
    assert [r.c for r in rows.orderBy("i").collect()] == [w for _, w in floors]
    other = spark.range(1).select(lookup.banded_code(F.lit(29), F.lit("1"), 4, TYPE_CODES, FLOOR_BANDS, FLOOR_FALLBACK).alias("c"))
    assert other.first().c == "6.9"


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "code string, parent string")
    got = {(r.code, r.descendant) for r in lookup.closure(e, 6).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "c")}


def test_admission(spark):
    rows = spark.createDataFrame([("g", 1, 8), ("g", 2, 5), ("g", 3, 2), ("h", 1, 11)], "g string, o int, p int")
    got = sorted((r.g, r.o, r.admitted, r.reserved) for r in ledger.admissions(rows, "g", "o", "p", 10).collect())
    assert got == [("g", 1, True, 8), ("g", 2, False, 8), ("g", 3, True, 10), ("h", 1, False, 0)]


def test_admission_over_batches_equals_a_plain_fold(spark):
    rows = spark.range(25_000).select(F.expr("if(id % 3 = 0, null, concat('q', id % 2))").alias("g"), "id", F.expr("if(id % 7 = 0, null, id % 5)").alias("p"))
    want, sums = {}, {}
    for g, i, p in sorted(((r.g, r.id, r.p) for r in rows.collect()), key=lambda r: r[1]):
        s = sums.get(g, 0)
        fits = None if p is None else s + p <= 6000
        sums[g] = s + p if fits else s
        want[i] = (g, fits, sums[g])
    got = {r.id: (r.g, r.admitted, r.reserved) for r in ledger.admissions(rows, "g", "id", "p", 6000).collect()}
    assert got == want


def test_exactish_pairs_equal_all_pairs(spark):
    names = ["", "a b", "b a", "b a c", "a b c d", "d c b a", "x y z", "long start here", "long start", "long start her", "long starts", "a a b", "p q r s t", "t s q u v", "p q r s w"]
    rows = spark.createDataFrame([(n,) for n in [*names, "a b", None]], "canon string")
    got = sorted((r.one, r.two) for r in matching.exactish_pairs(rows).collect())
    pairs = spark.createDataFrame([(x, y) for x in set(names) for y in set(names) if x < y], "one string, two string")
    assert got == sorted((r.one, r.two) for r in pairs.where(text.exactish("one", "two")).collect()) and len(got) > 6


def test_places_in_the_whole_table(spark):
    rows = spark.range(5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("n"), F.lit("x").alias("number"))
    got = ranking.placed(rows.drop("number"), F.col("n").desc()).collect()
    assert {r.n: r.place for r in got} == {n: 5000 - n for n in range(5000)}
    assert sorted(r.place for r in ranking.placed(spark.range(4).select(F.lit(1).alias("n")), F.col("n")).collect()) == [1, 2, 3, 4]
    assert ranking.placed(rows.drop("number").where("n < 0"), F.col("n")).count() == 0
    assert ranking.placed(rows, F.col("n")).columns == ["n", "number", "place"]
    assert {r.number for r in ranking.placed(rows, F.col("n")).collect()} == {"x"}


def test_transitions():
    assert "finished" not in ledger.TRANSITIONS["queued"] and "finished" in ledger.TRANSITIONS["running"]


def test_cascade_order_and_closed_failure(spark):
    q = [("k1", "", "x"), ("k2", "Z9", "x"), ("k3", "Z1", "жил дом"), ("k4", "Z1", "alpha beta gamma"), ("k5", "Z1", "something else"), ("k6", "Z2", "жил дом"), ("k7", "B1", "alpha beta gamma"), ("k8", "Z2", "odd thing")]
    queries = spark.createDataFrame([(k, z, c, c) for k, z, c in q], "key string, zone string, canon string, short string")
    zones = spark.createDataFrame([("Z1", "B1"), ("Z2", "B2"), ("Z3", "B2")], "zone_code string, base_code string")
    items = spark.createDataFrame([("Z1", "main", "жил дом", "2.0", "жил дом", "", 1), ("Z1", "conditional", "Alpha", "3.1", "alpha beta gamma", "", 2), ("Z2", "main", "Other", "4.0", "other", "", 1)],
                                  "zone string, section string, name string, code string, name_canon string, desc_short string, pos int")

    def model(rows):
        return rows.where("key = 'k8'").select("key", F.lit("allowed_auxiliary").alias("verdict"), F.lit("9").alias("code"))

    got = {r.key: (r.verdict, r.method) for r in matching.cascade(queries, zones, items, model=ports.failing_closed(model)).collect()}
    assert got == {
        "k1": ("no_actual_zone", "no_actual_zone"), "k2": ("no_zone_metadata", "no_zone_metadata"), "k3": ("allowed_main", "residential_unspecified_generic_in_zone"),
        "k4": ("allowed_conditional", "actual_zone_exact"), "k5": ("not_allowed", "actual_zone_llm"), "k6": ("unclear", "residential_unspecified_generic_manual"),
        # A base code finds the zone's data but not its items.
        "k7": ("not_allowed", "actual_zone_llm"), "k8": ("allowed_auxiliary", "actual_zone_llm"),
    }


def test_recall_in_blocks_equals_one(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q, e = v.where("vec_id % 50 = 0").selectExpr("vec_id as query", "embedding as qvector"), v.selectExpr("cast(vec_id as string) as code", "embedding as vector")
    want = {(r.query, r.code, r.rank) for r in ranking.recall(q, e, 3).collect()}
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 4)
    assert {(r.query, r.code, r.rank) for r in ranking.recall(q, e, 3).collect()} == want


def test_unit_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(ranking.unit("v").alias("u")).collect()
    assert r[0].u == pytest.approx([0.6, 0.8]) and r[1].u == [0.0, 0.0]


def test_scenario_key(spark):
    row = spark.createDataFrame([("sc:5:2024:OSM:type-3:upd-2024-01-01T00:00:m-ab",), ("sc:5",), (None,)], "k string").select(ledger.parsed_key("k").alias("p")).collect()
    assert row[0].p.scenario_id == 5 and row[0].p.updated == "2024-01-01T00:00" and row[1].p is None and row[2].p is None


def test_deep_and_tangled_hierarchies(spark):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 200)]
    e = spark.createDataFrame(chain, "code string, parent string")
    got = lookup.closure(e)
    assert got.count() == 200 * 201 // 2 and got.where("code = 'n0'").count() == 200
    assert lookup.closure(e, 3).where("code = 'n0'").count() == 4
    [leaf] = lookup.leaf_paths(e).collect()
    assert leaf.code == "n199" and leaf.path == ">".join(f"n{i}" for i in range(200))
    # Diamonds: 2 ** 30 paths from top to bottom.
    tangled = [("d0", None)] + [(f"{x}{i}", f"d{i - 1}") for i in range(1, 31) for x in "lr"] + [(f"d{i}", f"{x}{i}") for i in range(1, 31) for x in "lr"]
    assert lookup.closure(spark.createDataFrame(tangled, "code string, parent string")).where("code = 'd0'").count() == 91
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("r", None), ("s", "r")], "code string, parent string")
    assert [tuple(r) for r in lookup.leaf_paths(loop).collect()] == [("s", "r>s")]


def test_prefix_falls_back_from_empty_sets(spark):
    rows = spark.createDataFrame([("1.2.3",), ("1.2",), ("9",)], "zone string")
    sets = spark.createDataFrame([("1.2.3", []), ("1.2", None), ("1", ["x"])], "code string, allowed array<string>")
    assert {r.zone: r.found for r in lookup.by_prefix(rows, sets, "zone", "allowed", "found").collect()} == {"1.2.3": ["x"], "1.2": ["x"], "9": None}


def test_ports_are_asked_once_a_key(spark, tmp_path):
    queries = spark.createDataFrame([(f"k{i}", "Z", f"thing {i}", f"thing {i}") for i in range(10)], "key string, zone string, canon string, short string")
    zones = spark.createDataFrame([("Z", "B")], "zone_code string, base_code string")
    items = spark.createDataFrame([("Z", "main", "other", "4.0", "other", "", 1)], "zone string, section string, name string, code string, name_canon string, desc_short string, pos int")

    def port(name, answers):
        def ask(rows):
            def run(parts):
                for part in parts:
                    for key in part["key"]:
                        with open(f"{tmp_path}/{name}", "a") as f:
                            f.write(key + "\n")
                    some = part[part["key"].isin(answers)]
                    yield some.assign(verdict="allowed_main", code="1")[["key", "verdict", "code"]]

            return rows.mapInPandas(run, "key string, verdict string, code string")

        return ask

    out = matching.cascade(queries, zones, items, vector=port("vector", ["k1", "k2"]), model=ports.failing_closed(port("model", ["k3"])))
    got = {r.key: r.method for r in out.collect()}
    assert len(got) == 10 and out.count() == 10 and got["k1"] == "actual_zone_fast_embed" and got["k3"] == got["k9"] == "actual_zone_llm"
    asked = {n: (tmp_path / n).read_text().split() for n in ("vector", "model")}
    assert sorted(asked["vector"]) == sorted(f"k{i}" for i in range(10))
    assert sorted(asked["model"]) == sorted(f"k{i}" for i in range(10) if i not in (1, 2))


def test_streams_read_folders_and_single_files(spark, tmp_path):
    from lotsift.plans.catalogue import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("q93_stream_status_change", "q94_stream_hourly_counts"):
        want, got = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in ("/root/testdata/sf0.001", str(tmp_path)))
        assert want and got == want


def test_queries_alike_are_compared_once(spark):
    queries = spark.range(90).selectExpr("id as key", "concat('N', id % 2) as zone", "concat('red plate ', id % 3) as canon", "case when id % 3 > 0 then 'x' end as short")
    seen = []

    def answer(asked):
        seen.append(asked.count())
        return asked.selectExpr("key", "concat(zone, canon) as told")

    got = matching.answered_once(queries, answer, "zone", "canon", "short")
    assert seen == [6]
    assert sorted(map(tuple, got.select("key", "told").collect())) == [(k, f"N{k % 2}red plate {k % 3}") for k in range(90)]


def test_recall_within_groups_against_all_pairs(spark):
    rows = [(k, k % 3 if k != 7 else None, [float((k * 7 + d * 5) % 11 - 5) for d in range(4)]) for k in range(60)]
    v = spark.createDataFrame(rows, "id bigint, label int, vector array<double>")
    asked = v.where("id % 5 = 0 or id = 7").selectExpr("id as query", "label", "vector as qvector")
    got = {(r.query, r.code, r["rank"]) for r in ranking.recall(asked, v.withColumnRenamed("id", "code"), 3, group="label").collect()}
    want = set()
    for k, g, q in rows:
        if k % 5 == 0 and g is not None:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), c) for c, h, x in rows if h == g)
            want |= {(k, c, n + 1) for n, (_, c) in enumerate(scored[:3])}
    assert got == want


def test_every_vector_asks_all_others_of_its_zone(spark, sf_dir):
    from lotsift.plans.vectors import q36_vector_in_zone_margin

    asked = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r.key for r in q36_vector_in_zone_margin(spark, sf_dir).collect()) == sorted(asked)


@pytest.mark.parametrize(("rows_of_block", "cells"), [((512, 16_384), 1 << 20), ((5, 5), 20)])
def test_best_others_against_all_pairs(rows_of_block, cells, spark, monkeypatch):
    monkeypatch.setattr(ranking, "PAIR_ROWS", rows_of_block)
    monkeypatch.setattr(ranking, "PAIR_CELLS", cells)
    rows = [(k, k % 3 if k != 7 else None, [float((k * 7 + d * 5) % 11 - 5) for d in range(4)]) for k in range(60)]
    # Copies, a repeated id and row, zero vectors, one that isn't finite, none at all, nulls, a zone with one row and one without vectors.
    rows += [(k, 1, [1.0, 2.0, 3.0, 4.0]) for k in range(60, 75)] + [(3, 0, [9.0, 0.0, 0.0, 1.0]), (6, 0, rows[6][2]), (None, 0, rows[6][2])]
    rows += [(k, 2, [0.0] * 4) for k in range(80, 86)] + [(90, 2, [float("nan")] * 4), (91, 2, None), (92, 2, [1.0, None, 0.0, 0.0]), (93, 5, [1.0] * 4), (94, 6, None), (95, 6, None)]
    got = ranking.best_others(spark.createDataFrame(rows, "key bigint, label int, vector array<float>"), 2, "label").collect()

    def order(r):
        return (r[1] is None, r[1] == r[1], -r[1] if r[1] is not None and r[1] == r[1] else 0, r[0])

    for k in {r[0] for r in rows} - {None}:
        pairs = []
        for a, g, q in rows:
            for b, h, x in rows if a == k and g is not None else ():
                if b is not None and b != k and g == h:
                    pairs.append((b, None if q is None or x is None or None in q + x else sum(i * j for i, j in zip(q, x, strict=True))))
        scored = sorted(pairs, key=order)
        # Others without a product count only where there is no one else, and then the first.
        want = [s for n, s in enumerate(scored[:2]) if n == 0 or s[1] is not None]
        own = sorted(((r.pos, r.score) for r in got if r.key == k), key=order)
        assert [o[0] for o in own][: len(want)] == [w[0] for w in want] and [repr(o[1]) for o in own][: len(want)] == [repr(w[1]) for w in want], k
    assert len({r.key for r in got}) == len({r[0] for r in rows} - {None, 7, 93})
