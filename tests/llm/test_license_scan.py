import random

import pytest

from lotsift.llm import license_scan as S

PROSE = "ononedeshe the ofthouanan eran esstth and thor of the"


@pytest.mark.parametrize(("license_id", "text"), [(k, t) for k, ts in S.TEMPLATES.items() for t in ts if "*" not in t])
def test_each_template_is_found_in_prose(license_id, text):
    document = f"{PROSE}.\n{text}\n{PROSE}."
    found = [x for _, block in S.blocks(document) for x in S.scan(block)]
    assert found and found[0][0] == license_id and found[0][2] == 0


def test_wrapped_and_changed_wording():
    mit = S.TEMPLATES["MIT"][-1]
    words = mit.split()
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert [x[0] for _, b in S.blocks(lines) for x in S.scan(b)] == ["MIT"]
    r = random.Random(1)
    changed = [w if r.random() > 0.05 else "other" for w in words]
    found = [x for _, b in S.blocks(" ".join(changed)) for x in S.scan(b)]
    assert [x[0] for x in found] == ["MIT"] and 0 < found[0][2] <= 0.12 * len(words)


def test_versions_and_clauses_are_told_apart():
    for a, b in (("GPL-3.0", "GPL-2.0"), ("CC-BY-4.0", "CC-BY-NC-4.0"), ("BSD-2-Clause", "BSD-3-Clause")):
        for x in (a, b):
            found = [f[0] for _, block in S.blocks(S.TEMPLATES[x][0]) for f in S.scan(block)]
            assert found == [x]


def test_placeholders_and_plain_texts():
    assert [x[0] for _, b in S.blocks("Copyright (c) 2021 Some Holder Ltd. All rights reserved.") for x in S.scan(b)] == ["Proprietary"]
    assert not [x for _, b in S.blocks("They got a licence to sell fish.\nNo copyright talk here.") for x in S.scan(b)]
    assert list(S.blocks("")) == [] and list(S.blocks("no cue at all\n\n")) == []


def test_differences_by_hand():
    t = "a b c d".split()
    assert S.differences(t, "x a b c d y".split()) == (0, 4)
    assert S.differences(t, "a b q c d".split()) == (1, 4)
    assert S.differences(t, "a c d".split()) == (1, 3)
    assert S.differences(t, "z".split()) == (4, 0)


def test_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.license_id) for r in S.licences(docs).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {(r.doc_id, lines[x]) for r in docs.collect() for x in r.text.split("\n") if x in lines}
    assert want and got == want


def test_nulls_repeats_and_columns(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Licensed under the MIT License.", 1), (3, "Licensed under the MIT License.", 1), (None, "Licensed under the ISC License.", 1)], "doc_id long, text string, line int")
    assert sorted((r.doc_id or 0, r.license_id) for r in S.licences(rows).collect()) == [(0, "ISC"), (3, "MIT"), (3, "MIT")]
    assert S.licences(rows.where("false")).count() == 0


def test_lines_together_and_inside_prose():
    two = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."
    assert [(x[0], x[1]) for x in S.passages(two)] == [(0, "Apache-2.0"), (1, "MIT")]
    for n in (50, 100, 1000, 20000):
        prose = (PROSE + " ") * (n // len(PROSE) + 1)
        for license_id in ("MIT", "GPL-3.0", "AGPL-3.0"):
            text = f"{prose}{S.TEMPLATES[license_id][0]} {prose}"
            assert [x[0] for _, b in S.blocks(text) for x in S.scan(b)] == [license_id]
    every = [(k, t) for k, ts in S.TEMPLATES.items() for t in ts if "*" not in t]
    found = [x[1] for x in S.passages(f" {PROSE}\n".join(t for _, t in every))]
    assert [found.count(k) for k in S.TEMPLATES] == [sum(x == k for x, _ in every) for k in S.TEMPLATES]


def test_passage_begins_in_one_line_and_ends_far_below():
    mit = S.TEMPLATES["MIT"][-1].split()
    text = f"{PROSE} {mit[0]}\n" + "\n\n".join(mit[1:])
    assert [(x[0], x[1], x[3]) for x in S.passages("\n" * 7 + text)] == [(7, "MIT", 0)]


def test_seven_notices_on_seven_lines():
    names = ["MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "CC-BY-4.0", "CC0-1.0", "MPL-2.0"]
    assert [(x[0], x[1]) for x in S.passages("\n".join(S.TEMPLATES[k][0] for k in names))] == list(enumerate(names))
    sixty = "\n".join(["this licence software copyright work is subject to terms"] * 60)
    assert [x[:2] for x in S.passages(f"{sixty}\n{S.TEMPLATES['MIT'][0]}")] == [(60, "MIT")]


def test_bare_notices_on_request(spark):
    text = f"{PROSE}\nAll rights reserved.\n{PROSE}"
    assert S.passages(text) == [] and [x[:2] for x in S.passages(text, bare=True)] == [(1, "Proprietary")]
    full = "Copyright 2020 Some Holder. All rights reserved."
    assert [x[1] for x in S.passages(full, bare=True)] == ["Proprietary"]
    assert S.licences(spark.createDataFrame([(1, text)], "doc_id long, text string"), bare=True).count() == 1


def every_passage(text):
    """(template's text, fewest differences) of all templates by aligning each to the whole text, word by word."""
    words = S._words(text)
    out = set()
    for k, ts in S.TEMPLATES.items():
        for t in ts:
            template = S.Template(k, t).words
            wrong, _ = S.differences(template, words)
            if wrong <= int(S.MOST_DIFFERENT * len(template)):
                out.add((k, t, wrong))
    return out


def test_compression_loses_nothing_that_differences_confirm():
    """Each template with as many words changed, dropped or added as may be, in prose and next to other notices, against brute force."""
    r = random.Random(8)
    every = [(k, t) for k, ts in S.TEMPLATES.items() for t in ts]
    cue = S._cue
    checked = 0
    for k, t in every * 6:
        words = [w if w != "*" else "2020 Some Holder" for w in t.split()]
        most = int(S.MOST_DIFFERENT * len(S.Template(k, t).words))
        for _ in range(r.randrange(most + 1)):
            i = r.randrange(len(words))
            words[i : i + 1] = r.choice([["other"], [], [words[i], "more"]])
        near = r.choice(every)[1].replace("*", "2021 X") if r.random() < 0.5 else PROSE
        passage = " ".join(words)
        if not cue.search(passage):
            continue
        want = every_passage(passage)
        _, starts = None, [m.start() for m in S._WORD.finditer(passage)]
        spans = [w for w in S._words(f"{PROSE} {passage} {near}")]
        places = [i for i, w in enumerate(spans) if cue.search(w)] + [i for i in range(len(spans)) if cue.search(" ".join(spans[i : i + 4]))]
        got = {(S._compiled()[0][n].template.text, wrong) for n, wrong, _ in S._confirmed(spans, sorted(set(places)), False)}
        for _, text, wrong in want:
            assert any(x == text and y <= wrong for x, y in got), (text, passage)
            checked += 1
    assert checked > 100


def test_very_long_text():
    text = f"{PROSE} " * 40_000 + S.TEMPLATES["MIT"][-1] + f" {PROSE}" * 1000
    assert [x[1] for x in S.passages(text)] == ["MIT"]


def test_empty_table(spark):
    from lotsift.llm.license_scan import licences

    assert licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
