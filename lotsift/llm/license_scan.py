"""Licence scan by conditional compression, confirmed by word differences.

Around every cue, such as the word licence, blocks of about a template's length are cut, of words without their layout, so
that a passage like the template lies whole in one of them. Every block is compressed with zstandard, plainly and with the
template as raw dictionary, and templates are ranked by the bytes saved, as a share of what the template saves on
its own text. All templates above a share that any passage within the allowed
differences reaches are winners, and each is confirmed or ruled out by exact word
differences: with k differing words allowed a passage holds one of k + 1 pieces word for word, from which it is aligned to both sides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words of a template that may differ, as a share of its words.
MOST_DIFFERENT = 0.12
#: Most words that a * takes without a difference.
STAR = 12
LEVEL = 3
#: Least share of a template's own saving that makes it a winner; tests hold passages with all differences allowed against it.
LEAST_SAVED = 0.15

CUE = r"(?i)licen[sc]|copyright|\(c\) ?\d{4}|©|spdx|permission is hereby|redistribution and use|all rights reserved|public domain|creative commons|\bcc[ -]?(?:by|0)\b|warrant(?:y|ies)"

# Public licence notices. * stands for any few words, such as a year and a holder.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["Copyright * All rights reserved."],
}
# Notices that reserve rights and name neither licence nor holder; found on request.
BARE: dict[str, list[str]] = {"Proprietary": ["All rights reserved."]}

_WORD = re.compile(r"[\w.+-]+")


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".+-") for x in _WORD.findall(text.lower())) if w]


@dataclass(frozen=True)
class Template:
    license_id: str
    text: str

    @property
    def words(self) -> list[str]:
        return ["*" if w == "*" else w for part in self.text.split() for w in ([part] if part == "*" else _words(part))]


def _pieces(words: list[str], wanted: int) -> list[tuple[int, int]]:
    """(begin, end) of at least so many pieces without *, none of which overlap, as long as they can be."""
    stars = [-1, *(i for i, w in enumerate(words) if w == "*"), len(words)]
    runs = [(a + 1, b) for a, b in zip(stars, stars[1:], strict=False) if b > a + 1]
    length = next(n for n in range(len(words), 0, -1) if sum((b - a) // n for a, b in runs) >= wanted)
    return [(i, i + length) for a, b in runs for i in range(a, b - length + 1, length)]


_plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


@dataclass(frozen=True)
class Compiled:
    """A template's words, what compresses with it as dictionary, the bytes that saves on its own text, and the words that a passage can have."""

    template: Template
    words: list[str]
    compressor: zstandard.ZstdCompressor
    own: int
    most: int
    bare: bool


@lru_cache(maxsize=1)
def _compiled() -> tuple[list[Compiled], dict[str, list[tuple[int, int, list[str]]]], dict[int, list[int]]]:
    """Templates; by its first word each piece of them: template's number, piece's place in it, piece; templates' numbers by the words that a passage can have."""
    out, seeds, sizes = [], {}, {}
    for license_id, texts, bare in [*((k, v, False) for k, v in TEMPLATES.items()), *((k, v, True) for k, v in BARE.items())]:
        for text in texts:
            t = Template(license_id, text)
            words = t.words
            data = " ".join(w for w in words if w != "*").encode()
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False)
            allowed = int(MOST_DIFFERENT * len(words))
            for a, b in _pieces(words, allowed + 1):
                seeds.setdefault(words[a], []).append((len(out), a, words[a:b]))
            most = len(words) + allowed + STAR * words.count("*")
            sizes.setdefault(most, []).append(len(out))
            out.append(Compiled(t, words, compressor, len(_plain.compress(data)) - len(compressor.compress(data)), most, bare))
    return out, seeds, sizes


_cue = re.compile(CUE)


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(first line's number, text) of what is scanned in one piece: a text with a cue, else nothing."""
    if _cue.search(text):
        yield 0, text


def _align(template: list[str], words: list[str], anywhere: bool = False) -> tuple[int, list[int]]:
    """Fewest words added, removed or changed between the template and a passage that begins with the words (or anywhere); places of the words met."""
    n = len(words)
    rows = [[0] * (n + 1) if anywhere else list(range(n + 1))]
    for w in template:
        last = rows[-1]
        if w == "*":
            row = [min(last[max(0, j - STAR) : j + 1]) for j in range(n + 1)]
        else:
            row = [last[0] + 1, *(min(last[j] + (words[j] != w), last[j + 1] + 1) for j in range(n))]
        for j in range(n):
            if row[j] + 1 < row[j + 1]:
                row[j + 1] = row[j] + 1
        rows.append(row)
    wrong = min(rows[-1])
    i, j, met = len(template), rows[-1].index(wrong), []
    while i:
        here, last, w = rows[i][j], rows[i - 1], template[i - 1]
        if w == "*":
            back = next((s for s in range(min(STAR, j) + 1) if last[j - s] == here), None)
            i, j = (i, j - 1) if back is None else (i - 1, j - back)
        elif j and words[j - 1] == w and last[j - 1] == here:
            i, j = i - 1, j - 1
            met.append(j)
        elif j and last[j - 1] + 1 == here:
            i, j = i - 1, j - 1
        elif last[j] + 1 == here:
            i -= 1
        else:
            j -= 1
    return wrong, met[::-1]


def differences(template: list[str], block: list[str]) -> tuple[int, int]:
    """Words added, removed or changed between the template and the block's passage that fits it best; words of the template met.

    * takes up to 12 words.
    """
    wrong, met = _align(template, block, anywhere=True)
    return wrong, len(met)


def ranked(words: list[str], numbers: list[int]) -> list[tuple[float, int]]:
    """(share saved, template's number) of those of the templates that win a block, best first."""
    templates = _compiled()[0]
    data = " ".join(words).encode("utf-8", "replace")
    plain = len(_plain.compress(data))
    shares = [((plain - len(templates[k].compressor.compress(data))) / templates[k].own, k) for k in numbers]
    return sorted((x for x in shares if x[0] >= LEAST_SAVED), key=lambda x: (-x[0], x[1]))


def _blocks_around(cues: list[int], most: int) -> list[tuple[int, int]]:
    """(begin, end) of blocks of words, about a quarter longer than a passage, of which one holds any passage with a cue."""
    step = max(1, most // 4)
    return [(s, s + most + step) for s in sorted({s for i in cues for s in range(max(0, i - most + 1) // step * step, i + 1, step)})]


def _confirmed(words: list[str], cues: list[int], bare: bool) -> Iterator[tuple[int, int, list[int]]]:
    """(template's number, words different, places of the words met) of passages that are like a template that won their block."""
    templates, _, sizes = _compiled()
    for most, numbers in sizes.items():
        numbers = [k for k in numbers if bare or not templates[k].bare]
        for begin, end in _blocks_around(cues, most):
            block = words[begin:end]
            if winners := {k for _, k in ranked(block, numbers)}:
                for number, wrong, met in _alike(block, winners):
                    yield number, wrong, [begin + x for x in met]


def _alike(words: list[str], numbers: set[int]) -> Iterator[tuple[int, int, list[int]]]:
    """(template's number, words different, places of the words met) of passages of a block that are like one of the templates."""
    templates, seeds, _ = _compiled()
    for i, word in enumerate(words):
        for number, at, piece in seeds.get(word, ()):
            if number not in numbers or words[i : i + len(piece)] != piece:
                continue
            template = templates[number].words
            most = int(MOST_DIFFERENT * len(template))
            before, after = template[:at][::-1], template[at + len(piece) :]
            left, right = (len(x) + most + STAR * x.count("*") for x in (before, after))
            end = i + len(piece)
            wrong_before, met_before = _align(before, words[max(0, i - left) : i][::-1])
            if wrong_before > most:
                continue
            wrong_after, met_after = _align(after, words[end : end + right])
            if wrong_before + wrong_after > most:
                continue
            met = [*(i - 1 - x for x in reversed(met_before)), *range(i, end), *(end + x for x in met_after)]
            yield number, wrong_before + wrong_after, met


def passages(text: str, bare: bool = False) -> list[tuple[int, str, float, int, str]]:
    """(line, license, share saved, words different, template) of the licences of a text, by place, best first.

    Of passages of one licence that share words, the one with most words met stands for all. One whose words are
    mostly those of another licence's passage with fewer differences, or as many on more words, is only its look-alike.
    """
    templates = _compiled()[0]
    spans = [(m, w.lower()) for m, w in ((m, m.group().strip(".+-")) for m in _WORD.finditer(text)) if w]
    starts = [m.start() for m, _ in spans]
    cues = sorted({min(bisect_right(starts, m.end() - 1) - 1, len(spans) - 1) for m in _cue.finditer(text)} - {-1}) if spans else []
    found = {}
    for number, wrong, met in _confirmed([w for _, w in spans], cues, bare):
        found.setdefault((number, met[0], met[-1]), (number, wrong, met))
    kept = {}
    for number, wrong, met in sorted(found.values(), key=lambda x: (-len(x[2]), x[1], x[0])):
        same = kept.setdefault(templates[number].template.license_id, [])
        places = set(met)
        if all(places.isdisjoint(other) for _, _, other in same):
            same.append((number, wrong, places))
    out = []
    for license_id, same in kept.items():
        for number, wrong, places in same:
            if any(w < wrong and 2 * len(places & other) > len(places) for k, x in kept.items() if k != license_id for _, w, other in x):
                continue
            template, compressor = templates[number].template, templates[number].compressor
            first = spans[min(places)][0].start()
            data = text[first : spans[max(places)][0].end()].lower().encode("utf-8", "replace")
            saved = 1 - len(compressor.compress(data)) / len(_plain.compress(data))
            out.append((first, saved, (text.count("\n", 0, first), license_id, saved, wrong, template.text)))
    return [x for _, _, x in sorted(out, key=lambda x: (x[0], -x[1], x[2][1]))]


def scan(block: str) -> list[tuple[str, float, int, str]]:
    """(license, share saved, words different, template) of a block's passages."""
    return [x[1:] for x in passages(block)]


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bare: bool = False) -> DataFrame:
    """A row for each licence and passage: id, line (of the passage's start, from 0), license_id, saved, differences, template.

    With `bare`, notices that reserve all rights and name neither licence nor holder count as well. Only documents with a cue leave the JVM; these are read whole, however long. Null and blank texts have no rows; repeated rows have
    theirs each. Passages rank by place, ties by bytes saved and then by name. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (i, first + line, *found) for i, t in zip(part["id"], part["text"], strict=True) for first, block in blocks(t) for line, *found in passages(block, bare)
            ]
            yield pd.DataFrame(rows, columns=["id", "line", "license_id", "saved", "differences", "template"])

    held = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(CUE))
    found = held.mapInPandas(run, "id string, line int, license_id string, saved double, differences int, template string")
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)
