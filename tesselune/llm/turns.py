"""Conversations put in order by error-correcting Earley parsing (Aho and Peterson 1972, with weights).

A weighted grammar says in which order roles may speak. Beside reading a row as it is, the parser may read it as
another role, delete it, or insert a row that is not there. Every item of the chart keeps its least (cost, audit):
the audit has an initial for each edit, in order. The completed start symbol over all rows gives the repair.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Role initials of a conversation: nothing, or pairs of user and assistant after at most one system row. Each rule is
#: left-linear, so a column of the chart holds a bounded number of items however many rows there are.
ROLES = (
    ("start", ()),
    ("start", ("pairs",)),
    ("pairs", ("asked", "a")),
    ("asked", ("u",)),
    ("asked", ("opened", "u")),
    ("asked", ("pairs", "u")),
    ("opened", ("s",)),
)
#: What edits cost; a row that is cut off costs ``CUT`` more unless it goes.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Initials of the roles that rerole and insert give.
GIVEN = {"u": "user", "a": "assistant"}
_WHITE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

Best = tuple[int, str]
Item = tuple[int, int, int]


def parse(rows: tuple[tuple[str, int], ...], grammar: tuple[tuple[str, tuple[str, ...]], ...] = ROLES, start: str = "start") -> Best | None:
    """The least (cost, audit) that makes rows of (initial, fault) a sentence of the grammar; the audit's ties go to the least by ASCII.

    A symbol without rules is a terminal. An item is (rule, dot, column of origin); its value covers the rows from its
    origin on. Rows that go are passed by items that wait for a terminal, and by the completed start symbol.
    """
    rules: dict[str, list[int]] = {}
    for k, (head, _) in enumerate(grammar):
        rules.setdefault(head, []).append(k)
    columns: list[dict[Item, Best]] = []
    waiting: list[dict[str, list[Item]]] = []  # by the symbol after the dot
    ready: dict[Item, Best] = {(k, 0, 0): (0, "") for k in rules[start]}
    for i in range(len(rows) + 1):
        chart: dict[Item, Best] = {}
        wants: dict[str, list[Item]] = {}
        done: dict[tuple[str, int], Best] = {}
        columns.append(chart)
        waiting.append(wants)
        agenda: deque[Item] = deque()

        def offer(item: Item, value: Best, chart: dict[Item, Best] = chart, agenda: deque[Item] = agenda) -> None:
            if item not in chart or value < chart[item]:
                chart[item] = value
                agenda.append(item)

        for item, value in ready.items():
            offer(item, value)
        while agenda:
            item = agenda.popleft()
            rule, dot, origin = item
            head, body = grammar[rule]
            cost, audit = chart[item]
            if dot == len(body):
                if (head, origin) in done and done[head, origin] <= (cost, audit):
                    continue
                done[head, origin] = cost, audit
                for k, at, begun in list(waiting[origin].get(head, ())):
                    before = columns[origin][k, at, begun]
                    offer((k, at + 1, begun), (before[0] + cost, before[1] + audit))
                continue
            symbol = body[dot]
            kept = wants.setdefault(symbol, [])
            if item not in kept:
                kept.append(item)
            if symbol in rules:
                for k in rules[symbol]:
                    offer((k, 0, i), (0, ""))
                if (symbol, i) in done:
                    inner = done[symbol, i]
                    offer((rule, dot + 1, origin), (cost + inner[0], audit + inner[1]))
            elif symbol in GIVEN:
                offer((rule, dot + 1, origin), (cost + INSERT, audit + "I"))
        if i == len(rows):
            return done.get((start, 0))
        initial, fault = rows[i]
        more = CUT if fault == TRUNCATED else 0
        ready = {}

        def shift(item: Item, value: Best, ready: dict[Item, Best] = ready) -> None:
            if item not in ready or value < ready[item]:
                ready[item] = value

        for item, (cost, audit) in chart.items():
            rule, dot, origin = item
            head, body = grammar[rule]
            if dot == len(body):
                if head == start and origin == 0:
                    shift(item, (cost + DELETE, audit + "D"))
                continue
            symbol = body[dot]
            if symbol in rules:
                continue
            shift(item, (cost + DELETE, audit + "D"))
            if fault not in (BLANK, DUPLICATE):
                if symbol == initial:
                    shift((rule, dot + 1, origin), (cost + more, audit + "K"))
                if symbol in GIVEN:
                    shift((rule, dot + 1, origin), (cost + REROLE + more, audit + "R"))
    return None


@lru_cache(1 << 16)
def _parse_short(rows: tuple[tuple[str, int], ...]) -> Best:
    return parse(rows)


def faults(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row: blank, the same role and text as an earlier row, or text that ends without ``.!?``."""
    seen, out = set(), []
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(_WHITE)[-1:]
        out.append(BLANK if not end else DUPLICATE if (role, text) in seen else SOUND if end in ".!?" else TRUNCATED)
        seen.add((role, text))
    return out


def repaired(roles: list[str], texts: list[str], audit: str) -> list[tuple[str, str]]:
    """The rows that the edits leave; roles given follow the pattern of the grammar's pairs."""
    out: list[tuple[str, str]] = []
    at = turn = 0
    for edit in audit:
        given = GIVEN["ua"[turn % 2]]
        role, text = (given, "") if edit == "I" else (roles[at], texts[at])
        at += edit != "I"
        if edit == "D":
            continue
        out.append((role if edit == "K" else given, text))
        turn += not (edit == "K" and role[:1] == "s")
    return out


_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, there, turn, role, text) sorted by conversation and place to a row for each conversation."""
    names = ["conv_id", *(f.split()[0] for f in _SCHEMA.split(", "))]

    def row(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
        told, found = [t for t in turns if t is not None], faults(roles, texts)
        initials = [r[:1] for r in roles]
        coded = tuple(zip(initials, found, strict=True))
        cost, audit = _parse_short(coded) if len(coded) <= 16 else parse(coded)
        return (
            max(told) - min(told) + 1 - len(set(told)) if told else 0,
            found.count(BLANK),
            found.count(DUPLICATE),
            found.count(TRUNCATED),
            sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            [{"role": r, "text": t} for r, t in repaired(roles, texts, audit)],
        )

    def table(ids: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names)

    held: tuple[list, list, list] = [], [], []
    current, begun, kind = None, False, pa.int64()
    for batch in batches:
        kind, ids, rows = batch.column(0).type, [], []
        for conv, there, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv != current:
                if begun:
                    ids.append(current)
                    rows.append(row(*held))
                current, begun, held = conv, True, ([], [], [])
            if there:
                for column, value in zip(held, (turn, role, text), strict=True):
                    column.append(value)
        if ids:
            yield table(ids, rows, kind)
    if begun:
        yield table([current], [row(*held)], kind)


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there_col: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), a row for each conversation.

    Rows of a conversation go by turn, nulls first; those of one turn by role and then text, in order of bytes. Null
    roles and texts are read as one space; a null conv_id is a conversation of its own. A row whose ``there_col`` is
    false only names its conversation, which then has a row even if it has no other: zeros, an empty audit, no rows.
    blank, duplicate and truncated count rows by their first fault: no character but space and ``\\t`` to ``\\r``; role and
    text of an earlier row; a last such character other than ``.!?``. illegal counts neighbours whose role initials are
    not su, ua or au; gaps the turns missing between the least and the greatest. cost and audit are of the cheapest
    edits that make the initials ``(s?(ua)+)?``: K keeps a row, R gives it the role user or assistant, D deletes it (blank
    and duplicate rows always go), I inserts an empty one. An empty table gives no rows; other columns are ignored.
    A conversation is parsed in one task, which holds one conversation's text at a time.
    """
    tune(rows.sparkSession)
    there = F.col(there_col) if there_col else F.lit(True)
    own = rows.select(
        F.col(conv_col).alias("conv_id"), there.alias("there"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    kind = own.schema["conv_id"].dataType.simpleString()
    own = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return own.mapInArrow(_repairs, f"conv_id {kind}, {_SCHEMA}")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by rule: (conv_id, turn, role, text, there), by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (``there`` is false then), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 gives it the role
    user. Nulls, in the key too, are read as one space; a null turn stays null.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("fault") == 3).cast("int")))
    return out.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("there"), copies.alias("copy")).drop("copy")
