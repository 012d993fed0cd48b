"""Conversation repair: the cheapest edits that make turns follow the grammar `(system? (user assistant)+)?`, by layers of cost.

A turn has a fault, the first that holds of: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that is no white space is not one of `.!?`). Edits and their costs: Keep 0, Rerole to user or assistant 3, Delete 4,
Insert an empty user or assistant turn anywhere 3; a truncated turn that stays costs 3 more; blank and duplicate turns must be deleted.

For each turn there is a column of layers. Layer c is a set of grammar states, one bit each: those from which the rest of the conversation can
be accepted at cost c. A column is one integer, four bits a layer, so an edit moves the states of all layers at once and is shifted by its cost.
A state stays only in its first layer, and leading empty layers are an offset, so a column fits a machine word however long the conversation.
The first layer of the first column that has the start state is the cost; the audit follows bits forward, least letter first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = 1 << START | 1 << ASSISTANT
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
_STATES = 4
_EVERY = [sum(1 << (_STATES * layer + state) for layer in range(64)) for state in range(_STATES)]
"""The bit of a state in each layer."""

Turn = tuple[str, str]


def faults(turns: Sequence[Turn]) -> list[str]:
    """Of each (role, text): blank, duplicate, truncated or nothing."""
    seen: set[Turn] = set()
    out = []
    for turn in turns:
        body = turn[1].rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if turn in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(turn)
    return out


def _before(column: int, letters: str) -> int:
    """The states, layer by layer, that one of the letters leads to a state of column."""
    out = 0
    for (state, letter), to in NEXT.items():
        if letter in letters:
            found = column & _EVERY[to]
            out |= found << (state - to) if state >= to else found >> (to - state)
    return out


def _first_layers(column: int) -> int:
    """The column with each state in its first layer only."""
    out = 0
    for every in _EVERY:
        found = column & every
        out |= found & -found
    return out


def layers(initials: Sequence[str], marks: Sequence[str]) -> list[tuple[int, int]]:
    """Columns of all turns and of the end, each as the cost of its first layer and the layers from there on."""
    column, base = ACCEPTING, 0
    out = []
    for i in range(len(initials), -1, -1):
        if i < len(initials):
            after, column = column, column << (_STATES * DELETE)
            if marks[i] in ("", "truncated"):
                stay = _before(after, "ua") << (_STATES * REROLE)
                stay |= _before(after, initials[i]) if initials[i] else 0
                column |= stay << (_STATES * TRUNCATED) if marks[i] else stay
        for _ in range(_STATES):
            column |= _before(column, "ua") << (_STATES * INSERT)
        column = _first_layers(column)
        skip = ((column & -column).bit_length() - 1) // _STATES
        column, base = column >> (_STATES * skip), base + skip
        out.append((base, column))
    return out[::-1]


def _layer(column: tuple[int, int], state: int) -> int:
    found = column[1] & _EVERY[state]
    return column[0] + (found.bit_length() - 1) // _STATES if found else -1


def trace(turns: Sequence[Turn], marks: Sequence[str]) -> tuple[int, str, list[Turn]]:
    """Cost, audit (initials of the cheapest edits in order, the least string of them) and the repaired turns."""
    initials = [role[:1] if role[:1] in ("s", "u", "a") else "" for role, _ in turns]
    columns = layers(initials, marks)
    cost = left = _layer(columns[0], START)
    i, state, audit, out = 0, START, [], []
    while i < len(turns) or left:
        stays = i < len(turns) and marks[i] in ("", "truncated")
        extra = TRUNCATED if stays and marks[i] else 0
        letter = "a" if state == USER else "u"
        moves = [("D", DELETE, i + 1, state, None)] if i < len(turns) else []
        moves.append(("I", INSERT, i, NEXT[state, letter], (NAMES[letter], "")))
        if stays:
            if (state, initials[i]) in NEXT:
                moves.append(("K", extra, i + 1, NEXT[state, initials[i]], turns[i]))
            moves.append(("R", REROLE + extra, i + 1, NEXT[state, letter], (NAMES[letter], turns[i][1])))
        name, price, i, state, turn = next(m for m in moves if m[1] <= left and _layer(columns[m[2]], m[3]) == left - m[1])
        left -= price
        audit.append(name)
        if turn is not None:
            out.append(turn)
    return cost, "".join(audit), out


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(turns: Sequence[dict]) -> tuple:
    """The columns of repair for one conversation's turns in order."""
    pairs = [(t["role"], t["text"]) for t in turns]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    marks = faults(pairs)
    cost, audit, out = trace(pairs, marks)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(pairs, pairs[1:]))  # noqa: B905
    return gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, [{"role": r, "text": t} for r, t in out]


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (turns by fault),
    illegal (neighbours whose role initials may not follow each other), cost, audit and repaired, the turns after the edits.

    A conversation is one example and stays in one row; its turns are ordered by turn (nulls first), then role and text. Null role or text is one
    space; a null conv is a conversation of its own. A role whose initial is not s, u or a, empty ones included, cannot be kept. Repeated rows are
    duplicates. Other columns are left out, and an empty table gives no rows. Time and memory grow linearly with a conversation's turns.
    """
    space = F.lit(" ")
    fields = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    kind = rows.schema["conv"]
    pair = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField(conv, kind.dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired", T.ArrayType(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [repaired(t) for t in batch.column(1).to_pylist()]
            values = list(zip(*rows, strict=True)) or [()] * (len(_COUNTS) + 2)
            kinds = [pa.int64()] * len(_COUNTS) + [pa.string(), pa.list_(_TURN)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults by a checksum of conversation and turn: rows dropped, emptied, cut short, repeated or of another role. A null counts as one space."""
    space = F.lit(" ")
    known = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))).alias("copy"))
    return rows.drop("copy")


def digest(turns: Column) -> Column:
    """SHA-256 of `role:text` of the turns, joined by newlines."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)
