"""Recovery of speaker roles from raw transcripts, and their canonical form.

Every line of a transcript becomes a symbol from its speaker marker ("User:", "### Response:",
"<|im_start|>assistant", ...), whether a blank line stands before it, and how it ends. A hidden Markov
model whose states are a role's first line and its further lines is counted from labelled
transcripts; Viterbi's path through it names the role of every line, marked or not. Lines of one turn
are joined, markers dropped, and the turns written in one form.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

ROLES = ("system", "user", "assistant")
#: State 2r is the first line of role r's turn, state 2r + 1 a further line of it.
STATES = 2 * len(ROLES)
SMOOTHING = 0.1

# Names that transcripts give to speakers.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompt", "instruction", "input", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "chatbot", "response", "output"),
}
_ROLE = {name: r for r, role in enumerate(ROLES) for name in SPEAKERS[role]}
_NAMES = "|".join(sorted(_ROLE, key=lambda n: (-len(n), n)))
#: A speaker's name in a tag, under hashes, in brackets, bold, or before a colon; group `name` and the rest of the line.
_MARKERS = [
    re.compile(rf"^\s*<\|(?:im_start\|>)?\s*(?P<name>{_NAMES})(?:\|>)?\s*(?P<rest>.*)$", re.I),
    re.compile(rf"^\s*#{{2,4}}\s*(?P<name>{_NAMES})\s*:?\s*(?P<rest>.*)$", re.I),
    re.compile(rf"^\s*\[(?P<name>{_NAMES})\]\s*:?\s*(?P<rest>.*)$", re.I),
    re.compile(rf"^\s*\*\*(?P<name>{_NAMES})\s*:?\*\*\s*:?\s*(?P<rest>.*)$", re.I),
    re.compile(rf"^\s*(?P<name>{_NAMES})\s*[:>]\s*(?P<rest>.*)$", re.I),
]
_CLOSING = re.compile(r"^\s*<\|(?:im_end|end)\|>\s*$", re.I)
_OTHER = re.compile(r"^\s*[A-Z][\w .-]{0,20}:\s")
#: Marker (none, one for each role, an unknown name) x after a blank line or at the start x ending (question, stop, other).
MARKER_KINDS, SYMBOLS = 2 + len(ROLES), (2 + len(ROLES)) * 2 * 3


@dataclass(frozen=True)
class Line:
    symbol: int
    text: str
    blank: bool


def marker(line: str) -> tuple[int | None, str]:
    """Role number of a line's speaker marker, and the rest of the line."""
    for m in _MARKERS:
        if found := m.match(line):
            return _ROLE[found["name"].lower()], found["rest"]
    return None, line


def lines_of(transcript: str) -> list[Line]:
    """The transcript's lines with their symbols; lines that only close a turn are dropped, and a marker alone marks the next line."""
    out, blank, waiting = [], True, None
    for raw in transcript.split("\n"):
        if _CLOSING.match(raw):
            blank = True
            continue
        if not raw.strip():
            out.append(Line(-1, "", True))
            blank = True
            continue
        role, rest = marker(raw)
        if role is not None and not rest.strip():
            waiting = role
            continue
        if role is None and waiting is not None:
            role, rest = waiting, raw
        waiting = None
        kind = 0 if role is None else 1 + role
        if role is None and _OTHER.match(raw):
            kind = MARKER_KINDS - 1
        end = rest.rstrip()[-1:]
        ending = 0 if end in ("?", "？") else 1 if end in (".", "!", "。") else 2
        out.append(Line((kind * 2 + blank) * 3 + ending, rest, False))
        blank = False
    return out


@dataclass(frozen=True)
class Model:
    """Logarithms of the chances of first states, of next states and of symbols."""

    first: np.ndarray
    next: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(first: np.ndarray, following: np.ndarray, symbol: np.ndarray) -> Model:
        allowed = np.ones((STATES, STATES), dtype=bool)
        for r in range(len(ROLES)):
            allowed[[s for s in range(STATES) if s // 2 != r], 2 * r + 1] = False
        start = np.array([s % 2 == 0 for s in range(STATES)])

        def logs(counts: np.ndarray, ok: np.ndarray) -> np.ndarray:
            c = np.where(ok, counts + SMOOTHING, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(c / c.sum(axis=-1, keepdims=True))

        # Marker and ending are taken as independent, so a marker counts with an ending that its state never had.
        parts = symbol.reshape(STATES, -1, 3)
        marks, endings = (logs(parts.sum(axis=k), np.array(True)) for k in (2, 1))
        return Model(logs(first, start), logs(following, allowed), (marks[:, :, None] + endings[:, None, :]).reshape(STATES, -1))


def path(model: Model, symbols: list[int], entry: int | None = None, leave: int | None = None) -> list[int]:
    """Viterbi's states for the symbols, after the state `entry` and up to the state `leave` where these are given; of equally likely ones, the lowest."""
    if not symbols:
        return []
    score, back = (model.first if entry is None else model.next[entry]) + model.symbol[:, symbols[0]], []
    for s in symbols[1:]:
        ways = score[:, None] + model.next
        came = ways.argmax(axis=0)
        back.append(came)
        score = ways[came, np.arange(STATES)] + model.symbol[:, s]
    out = [int(score.argmax()) if leave is None else leave]
    for came in reversed(back):
        out.append(int(came[out[-1]]))
    return out[::-1]


def transfer(model: Model, symbols: list[int]) -> np.ndarray:
    """Best log chance of a path through the symbols by the state before them (the last row: none, the start) and the last state."""
    score = np.vstack([model.next, model.first]) + model.symbol[:, symbols[0]]
    for s in symbols[1:]:
        score = (score[:, :, None] + model.next).max(axis=1) + model.symbol[:, s]
    return score


def joints(transfers: list[np.ndarray | None]) -> list[tuple[int | None, int | None]]:
    """(state before, last state) of each part on the best path through all, in order; None for a part without lines, and before the first."""
    held = [k for k, t in enumerate(transfers) if t is not None]
    out: list[tuple[int | None, int | None]] = [(None, None)] * len(transfers)
    if not held:
        return out
    score, back = transfers[held[0]][-1], []
    for k in held[1:]:
        ways = score[:, None] + transfers[k][:-1]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    last = int(score.argmax())
    for k, came in zip(reversed(held[1:]), reversed(back), strict=True):
        out[k] = int(came[last]), last
        last = out[k][0]
    out[held[0]] = None, last
    return out


def parse(model: Model, transcript: str | None, entry: int | None = None, leave: int | None = None) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript; blank lines inside a turn stay, those around it go."""
    return _turns(model, transcript, entry, leave)[0]


def _turns(model: Model, transcript: str | None, entry: int | None, leave: int | None) -> tuple[list[tuple[str, str]], bool]:
    """Turns of a transcript or a part of one, and whether the first goes on with the turn of the part before."""
    if not transcript:
        return [], False
    lines = lines_of(transcript)
    found = path(model, [x.symbol for x in lines if not x.blank], entry, leave)
    states = iter(found)
    turns: list[tuple[str, list[str]]] = []
    waiting = 0
    for line in lines:
        if line.blank:
            waiting += 1
            continue
        state = next(states)
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [line.text]))
        else:
            turns[-1][1].extend([""] * waiting + [line.text])
        waiting = 0
    return [(role, "\n".join(text).strip()) for role, text in turns], entry is not None and bool(found) and found[0] % 2 == 1


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form: a JSON list of messages."""
    return json.dumps([{"role": r, "content": t} for r, t in turns], ensure_ascii=False)


_COUNTS = "kind string, a int, b int, n bigint"


def fit(labelled: DataFrame, transcript: str = "transcript", turns: str = "turns") -> Model:
    """Count the model from transcripts and their true turns, an array of (role, text) in order.

    A transcript whose lines can't be told apart by its turns' line counts is left out. Counts
    are added up by Spark; only the fixed-size tables reach the driver.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n: dict[tuple[str, int, int], int] = {}
            for text, known in zip(part["t"], part["k"], strict=True):
                symbols = [x.symbol for x in lines_of(text or "") if not x.blank]
                states = []
                for turn in known if known is not None else []:
                    r = ROLES.index(turn["role"]) if turn["role"] in ROLES else 1
                    count = max(1, sum(1 for x in (turn["text"] or "").split("\n") if x.strip()))
                    states += [2 * r] + [2 * r + 1] * (count - 1)
                if not states or len(states) != len(symbols):
                    continue
                seen = [("first", states[0], 0), *(("next", a, b) for a, b in zip(states, states[1:], strict=False)), *(("symbol", a, b) for a, b in zip(states, symbols, strict=True))]
                for x in seen:
                    n[x] = n.get(x, 0) + 1
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "a", "b", "n"])

    rows = labelled.select(F.col(transcript).alias("t"), F.col(turns).alias("k")).mapInPandas(run, _COUNTS)
    tables = {"first": np.zeros((STATES, 1)), "next": np.zeros((STATES, STATES)), "symbol": np.zeros((STATES, SYMBOLS))}
    for row in rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[row["kind"]][row["a"], row["b"]] += row["n"]
    return Model.of(tables["first"][:, 0], tables["next"], tables["symbol"])


def recover(transcripts: DataFrame, model: Model, transcript: str = "transcript") -> DataFrame:
    """transcripts with roles (array, in order), rendered (canonical JSON) and n_turns in place of the transcript.

    All other columns stay, but for those with the results' names. A null or blank transcript has no
    turns and renders as []. Rows are independent, so repeated rows get equal results; of equally likely paths one is taken,
    the same for equal transcripts. A transcript of any length is parsed whole; an empty table gives an empty result.
    """
    made = {"roles": pa.list_(pa.string()), "rendered": pa.string(), "n_turns": pa.int32()}
    kept = [c for c in transcripts.columns if c not in (*made, transcript)]
    schema = transcripts.select(*kept).schema.add("roles", ArrayType(StringType())).add("rendered", "string").add("n_turns", IntegerType())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            turns = [parse(model, t) for t in part.column(transcript).to_pylist()]
            new = [[[r for r, _ in t] for t in turns], [render(t) for t in turns], [len(t) for t in turns]]
            columns = [pa.array(v, k) for v, k in zip(new, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *made])

    return transcripts.select(*kept, transcript).mapInArrow(run, schema)


def recover_parts(parts: DataFrame, model: Model, key: str = "conv_id", place: str = "part", transcript: str = "transcript") -> DataFrame:
    """As recover, for conversations in parts (key, place, transcript): Viterbi's path runs through all parts of a conversation.

    Each part of a conversation of several gives its best log chances from any state before it to any last state, a matrix of fixed
    size; these are chained in order of place, and every part is then parsed between the states that the best path has at its ends. `continued` tells
    that a part's first turn goes on with the last one of the part before; it isn't counted in n_turns. Parts
    without a key are transcripts of their own. Of equally likely paths any may be taken. A marker at a part's end without text after it marks nothing.
    Other columns stay whatever their names, but for those with the results' names; a part of any length is read whole, and an empty table gives an empty result.
    """
    several = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    long = parts.join(several, key, "left_semi").select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(transcript).alias("t"))
    kinds = {c: parts.schema[c].dataType.simpleString() for c in (key, place)}

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = [[x.symbol for x in lines_of(t or "") if not x.blank] for t in batch.column(2).to_pylist()]
            made = pa.array([transfer(model, s).tobytes() if s else None for s in symbols], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["key", "place", "chances"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        ends = joints([None if b is None else np.frombuffer(b).reshape(-1, STATES) for b in rows["chances"]])
        return rows[["key", "place"]].assign(**{n: pd.array([e[k] for e in ends], dtype="Int32") for k, n in enumerate(("entry", "leave"))})

    steps = long.mapInArrow(matrices, f"key {kinds[key]}, place {kinds[place]}, chances binary")
    ends = steps.groupBy("key").applyInPandas(chain, f"key {kinds[key]}, place {kinds[place]}, entry int, leave int")
    # Names that no column of the parts has.
    entry, leave = (n + "_" * (1 + max(map(len, parts.columns))) for n in ("entry", "leave"))
    ends = ends.select(F.col("key").alias(key), F.col("place").alias(place), F.col("entry").alias(entry), F.col("leave").alias(leave))
    made = {"roles": pa.list_(pa.string()), "rendered": pa.string(), "n_turns": pa.int32(), "continued": pa.bool_()}
    kept = [c for c in parts.columns if c not in (*made, transcript)]
    schema = parts.select(*kept).schema.add("roles", ArrayType(StringType())).add("rendered", "string").add("n_turns", IntegerType()).add("continued", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_turns(model, *x) for x in zip(*(batch.column(c).to_pylist() for c in (transcript, entry, leave)), strict=True)]
            new = [[[r for r, _ in t] for t, _ in found], [render(t) for t, _ in found], [len(t) - c for t, c in found], [c for _, c in found]]
            columns = [pa.array(v, k) for v, k in zip(new, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *made])

    return parts.select(*kept, transcript).join(ends, [key, place], "left").select(*kept, transcript, entry, leave).mapInArrow(run, schema)


#: How each style marks the roles of ROLES.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System\n", "### Instruction:\n", "### Response:\n"),
    ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n"),
    ("**System:** ", "**Human:** ", "**AI:** "),
    ("[context] ", "Q: ", "A: "),
)


#: Turn numbers of one part of a conversation; a longer one is a row for each part.
PART_TURNS = 256


def transcripts_of(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, part, transcript, turns) of a table of messages: each conversation as raw text in a style that its key picks.

    Turns stand in order of number, then role and text; every seventh turn of a key's cycle has lost its
    marker and only a blank line precedes it. Part k holds the turn numbers from 256 k, so that no
    conversation needs to fit one task; messages without a number are in part 0. A message without a key is a
    transcript of its own. Repeated messages stand side by side; other columns are ignored, and an empty table gives an empty result.
    """
    place = F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))])
    styles = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    style = F.pmod(F.xxhash64(key), F.lit(len(STYLES))).cast("int")
    number = F.coalesce(F.element_at(place, F.col(role)), F.lit(1))
    lost = F.pmod(F.xxhash64(key, turn), F.lit(7)) == 0
    mark = F.when(lost, F.lit("")).otherwise(F.element_at(F.element_at(styles, style + 1), number + 1))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = messages.select(
        F.col(key).alias("key"),
        F.coalesce(F.floor(F.col(turn) / PART_TURNS), F.lit(0)).cast("bigint").alias("part"),
        F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("own"),
        F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), body.alias("text"), F.concat(mark, body).alias("line")).alias("m"),
    )
    held = rows.groupBy("key", "part", "own").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return held.select(
        F.col("key").alias(key),
        "part",
        F.array_join(F.transform("m", lambda m: m["line"]), "\n\n").alias("transcript"),
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"),
    )
