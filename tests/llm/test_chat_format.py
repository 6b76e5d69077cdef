import json
from itertools import product

import numpy as np
import pytest

from lotsift.llm import chat_format as C


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return C.transcripts_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")).cache()


@pytest.fixture(scope="module")
def model(raw):
    return C.fit(raw)


def test_roles_of_the_table_are_recovered(spark, model):
    held = C.transcripts_of(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    got = {r.conv_id: r.roles for r in C.recover(held, model).collect()}
    want = {r.conv_id: [t.role for t in r.turns] for r in held.collect()}
    exact = np.mean([got[k] == want[k] for k in want])
    assert exact >= 0.6
    roles = [(a, b) for k in want if len(got[k]) == len(want[k]) for a, b in zip(got[k], want[k], strict=True)]
    assert np.mean([a == b for a, b in roles]) >= 0.95


def test_marked_transcripts_round_trip(model):
    turns = [("system", "Be brief."), ("user", "How are you?\nTell me."), ("assistant", "Fine.\nAnd you?"), ("user", "Well.")]
    for style in C.STYLES:
        text = "\n\n".join(style[C.ROLES.index(r)] + t for r, t in turns)
        assert C.parse(model, text) == turns
    closed = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" if False else f"<|im_start|>{r}\n{t}\n<|im_end|>\n" for r, t in turns)
    assert C.parse(model, closed) == turns
    assert json.loads(C.render(turns))[1] == {"role": "user", "content": "How are you?\nTell me."}


def test_viterbi_equals_trying_all_paths():
    r = np.random.default_rng(3)
    for _ in range(20):
        m = C.Model.of(r.random(C.STATES), r.random((C.STATES, C.STATES)), r.random((C.STATES, C.SYMBOLS)))
        symbols = r.integers(0, C.SYMBOLS, 5).tolist()

        def weight(p):
            return m.first[p[0]] + sum(m.next[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(m.symbol[a, b] for a, b in zip(p, symbols, strict=True))

        best = max(weight(p) for p in product(range(C.STATES), repeat=5))
        assert weight(C.path(m, symbols)) == pytest.approx(best)


def test_nulls_repeats_and_columns(spark, model):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "\n\n", 1), (4, "User: hi", 1), (4, "User: hi", 1), (None, "Q: x", 1)], "conv_id long, transcript string, n_turns int")
    got = sorted((r.conv_id or 0, r.n_turns, r.rendered) for r in C.recover(rows, model).collect())
    assert got[0][:2] == (0, 1) and [g[:2] for g in got[1:4]] == [(1, 0), (2, 0), (3, 0)]
    assert got[4] == got[5] == (4, 1, '[{"role": "user", "content": "hi"}]')
    assert C.recover(rows.where("false"), model).count() == 0


def test_messages_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "user", None), (1, 0, "system", "s"), (1, 1, "user", None), (None, 0, "odd", "t")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.role for t in r.turns] for r in C.transcripts_of(rows).collect()}
    assert got == {1: ["system", "user", "user"], None: ["odd"]}
    assert C.fit(C.transcripts_of(rows.where("false"))).first.shape == (C.STATES,)


def test_long_transcript(model):
    text = "\n\n".join(f"User: line {i}\n\nAssistant: answer {i}." for i in range(3000))
    assert len(C.parse(model, text)) == 6000


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_TURNS", 4)
    rows = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m {i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    got = {r.part: len(r.turns) for r in C.transcripts_of(rows).collect()}
    assert got == {0: 4, 1: 4, 2: 2}


def test_parts_are_parsed_as_one_conversation(spark, model, monkeypatch):
    """Joined parts against the whole conversation in one piece, and the path's chance against Viterbi's over all lines."""
    import random

    r = random.Random(4)
    rows = []
    for c in range(25):
        for i in range(r.randrange(1, 40)):
            lines = [f"line {c} {i} {k}{r.choice(['?', '.', ''])}" for k in range(r.randrange(1, 4))]
            rows.append((c, i, r.choice(["user", "assistant", "system"]), "\n".join(lines)))
    rows += [(None, 0, "user", "alone"), (None, 0, "user", "alone")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {x.conv_id: json.loads(x.rendered) for x in C.recover(C.transcripts_of(messages), model).where("conv_id is not null").collect()}
    monkeypatch.setattr(C, "PART_TURNS", 3)
    got = C.recover_parts(C.transcripts_of(messages), model).orderBy("conv_id", "part").collect()
    assert [x.n_turns for x in got if x.conv_id is None] == [1, 1]
    joined, carried = {}, 0
    for x in got:
        if x.conv_id is None:
            continue
        turns = json.loads(x.rendered)
        assert len(turns) == x.n_turns + x.continued
        if x.continued:
            carried += 1
            assert turns[0]["role"] == joined[x.conv_id][-1]["role"]
            joined[x.conv_id][-1]["content"] += "\n\n" + turns.pop(0)["content"]
        joined.setdefault(x.conv_id, []).extend(turns)
    assert carried and joined.keys() == whole.keys()
    # Of equally likely paths the whole and the parts may take another one.
    other = [c for c in whole if joined[c] != whole[c]]
    assert len(other) <= 3
    texts = {x.conv_id: [] for x in got}
    for x in C.transcripts_of(messages).where("conv_id is not null").orderBy("conv_id", "part").collect():
        texts[x.conv_id].append([y.symbol for y in C.lines_of(x.transcript) if not y.blank])

    def weight(p, symbols):
        return model.first[p[0]] + sum(model.next[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(model.symbol[a, b] for a, b in zip(p, symbols, strict=True))

    for c, parts in texts.items():
        if c is not None:
            ends = C.joints([C.transfer(model, s) for s in parts])
            one = sum((C.path(model, s, a, b) for s, (a, b) in zip(parts, ends, strict=True)), [])
            assert weight(one, sum(parts, [])) == pytest.approx(weight(C.path(model, sum(parts, [])), sum(parts, [])), abs=1e-9)


def test_chained_transfers_equal_the_whole_path():
    r = np.random.default_rng(9)
    for _ in range(30):
        m = C.Model.of(r.random(C.STATES), r.random((C.STATES, C.STATES)), r.random((C.STATES, C.SYMBOLS)))
        parts = [r.integers(0, C.SYMBOLS, r.integers(0, 5)).tolist() for _ in range(5)]
        ends = C.joints([C.transfer(m, p) if p else None for p in parts])
        assert sum((C.path(m, p, a, b) for p, (a, b) in zip(parts, ends, strict=True)), []) == C.path(m, sum(parts, []))


def test_roles_of_whole_conversations(spark, model):
    """Accuracy over all conversations, each role held against the one at its place; missing and surplus turns count as wrong."""
    held = C.transcripts_of(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    got = {r.conv_id: r.roles for r in C.recover_parts(held, model).collect()}
    want = {r.conv_id: [t.role for t in r.turns] for r in held.collect()}
    right = sum(a == b for k in want for a, b in zip(got[k], want[k]))
    assert right >= 0.8 * sum(max(len(got[k]), len(want[k])) for k in want)


def test_columns_with_any_names_stay(spark):
    from lotsift.llm.chat_format import fit, recover_parts, transcripts_of

    rows = [(1, k, r, f"text {k}") for k in range(600) for r in ["user" if k % 2 else "assistant"]]
    raw = transcripts_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    odd = raw.drop("turns").selectExpr("*", "7 as _entry", "8 as _leave", "9 as entry", "'x' as t", "1 as chances")
    got = recover_parts(odd, fit(raw)).collect()
    assert len(got) == 3 and all((r._entry, r._leave, r.entry, r.t, r.chances) == (7, 8, 9, "x", 1) for r in got)
    empty = recover_parts(odd.limit(0), fit(raw))
    assert empty.count() == 0
