"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is: one optional system turn, then user and assistant in turns, the assistant
last.  Each source turn is kept, relabelled, merged into the turn before, or preceded by an empty
turn; dynamic programming over the automaton of legal turns picks the cheapest choices.

Costs add up and each turn is a small table (state before -> state after), so tables of consecutive
turns multiply in the (min, +) sense.  A conversation is cut into blocks of turn numbers: every block
makes its table on its own, one narrow row per block is then folded along the conversation, and with
the states at its borders fixed every block picks its own actions.  So neither the text nor the turns
of one conversation ever have to be in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]
# Legal successors of a state.
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
NEVER = 1 << 50
TURNS_PER_BLOCK = 1024


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Template:
    """Marks of a rendered turn.  The opening of a mark inside a text is broken by a space."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    joint: str = "\n\n"
    marks: tuple[tuple[str, str], ...] = (("<|im_", "< |im_"),)


@lru_cache(maxsize=8)
def steps(costs: Costs) -> dict[str | None, list[list[tuple[int, bool, str]]]]:
    """For each source role, [state before][role after]: (cost, merged?, inserted role or '').

    Ties go to the plain continuation, then to merging, then to the first insertion.
    """
    table: dict[str | None, list[list[tuple[int, bool, str]]]] = {}
    for source in (*ROLES, None):
        table[source] = []
        for state in STATES:
            row = []
            for role in ROLES:
                relabel = 0 if role == source else costs.relabel
                options = [(relabel, False, "")] if role in NEXT[state] else []
                if role == state:
                    options.append((relabel + costs.merge, True, ""))
                options += [
                    (relabel + costs.insert, False, between)
                    for between in NEXT[state]
                    if role in NEXT[between]
                ]
                row.append(min(options, key=lambda o: o[0], default=(NEVER, False, "")))
            table[source].append(row)
    return table


def closing(costs: Costs) -> list[tuple[int, tuple[str, ...]]]:
    """For each last state, the cost and the empty turns that end the conversation legally."""
    ends = [("user", "assistant"), ("user", "assistant"), ("assistant",), ()]
    return [(costs.insert * len(e), e) for e in ends]


def _known(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def block_table(roles: list[str | None], costs: Costs) -> list[int]:
    """Cheapest cost from each state before the turns to each state after them, row by row."""
    table = steps(costs)
    found = []
    for entry in range(4):
        now = [NEVER] * 4
        now[entry] = 0
        for role in roles:
            row = table[role]
            now = [NEVER, *(min(now[q] + row[q][r][0] for q in range(4)) for r in range(3))]
        found += [min(x, NEVER) for x in now]
    return found


def fold(tables: list[list[int]], costs: Costs) -> list[tuple[int, int]]:
    """States (before, after) of each block on the cheapest way through all of them."""
    best, back = [0, NEVER, NEVER, NEVER], []
    for table in tables:
        options = [[best[q] + table[4 * q + r] for q in range(4)] for r in range(4)]
        back.append([min(range(4), key=lambda q, o=o: o[q]) for o in options])
        best = [min(o) for o in options]
    ends = closing(costs)
    state = min(range(4), key=lambda r: best[r] + ends[r][0])
    found = []
    for row in reversed(back):
        found.append((row[state], state))
        state = row[state]
    return found[::-1]


def choose(roles: list[str | None], entry: int, leave: int, costs: Costs) -> list[tuple[int, str, bool, str]]:
    """(cost, role, merged?, inserted role) of each turn, given the states at the borders."""
    table = steps(costs)
    now, back = [NEVER] * 4, []
    now[entry] = 0
    for role in roles:
        row = table[role]
        options = [[now[q] + row[q][r][0] for q in range(4)] for r in range(3)]
        back.append([0] + [min(range(4), key=lambda q, o=o: o[q]) for o in options])
        now = [NEVER, *map(min, options)]
    state, found = leave, []
    for role, row in zip(reversed(roles), reversed(back), strict=True):
        before = row[state]
        found.append((table[role][before][state - 1][0], ROLES[state - 1], *table[role][before][state - 1][1:]))
        state = before
    return found[::-1]


def _grouped(batches: Iterable[pa.RecordBatch], names: list[str], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``keys`` columns, across batches."""
    group, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if row[:keys] != group and rows:
                yield group, rows
                rows = []
            group = row[:keys]
            rows.append(row)
    if rows:
        yield group, rows


def repair(
    conversations: DataFrame,
    costs: Costs | None = None,
    template: Template | None = None,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """One row per source turn: ``conv_id, block, position, turn, role`` (as given), ``new_role,
    action, inserted, cost, piece``.

    The pieces of a conversation, in the order of block and position, joined, are its rendered text;
    the cost of the empty turns at the end is in its last row.  Turns are ordered by turn number,
    then role, then text; nulls come last among turns.  Unknown and null roles have to be relabelled.
    A null text is an empty turn; repeated rows are turns of their own; rows with a null conv_id are
    one conversation.  Columns beyond conv_id, turn, role and text are ignored.
    """
    costs, template = costs or Costs(), template or Template()
    kind = conversations.schema["conv_id"].dataType.simpleString()
    block = F.coalesce(
        F.floor(F.col("turn") / turns_per_block).cast("long"), F.lit((1 << 62)).cast("long")
    )
    source = conversations.select("conv_id", block.alias("block"), F.col("turn").cast("long"), "role", "text")
    dealt = source.repartition("conv_id", "block")
    order = ["conv_id", "block", F.col("turn").asc_nulls_last(), "role", "text"]

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, number), rows in _grouped(batches, ["conv_id", "block", "role"], 2):
            table = block_table([_known(r[2]) for r in rows], costs)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": number, "costs": table}], made)

    conv_field = pa.field("conv_id", _arrow(kind))
    made = pa.schema([conv_field, ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
    block_rows = dealt.sortWithinPartitions(*order).mapInArrow(
        tables, f"conv_id {kind}, block long, costs array<long>"
    )

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _grouped(batches, ["conv_id", "block", "costs"], 1):
            states = fold([r[2] for r in rows], costs)
            yield pa.RecordBatch.from_pylist(
                [
                    {"conv_id": conv, "block": r[1], "entry": a, "leave": b, "last": i == len(rows) - 1}
                    for i, (r, (a, b)) in enumerate(zip(rows, states, strict=True))
                ],
                bordered,
            )

    bordered = pa.schema(
        [conv_field, ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]
    )
    border_rows = (
        block_rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInArrow(borders, f"conv_id {kind}, block long, entry int, leave int, last boolean")
    ).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "leave", "last")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    joined = dealt.join(border_rows, same).drop("c", "b")

    names = ["conv_id", "block", "turn", "role", "text", "entry", "leave", "last"]
    out = pa.schema(
        [
            conv_field, ("block", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()),
            ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()),
            ("inserted", pa.string()), ("cost", pa.int64()), ("piece", pa.string()),
        ]
    )

    def opened(role: str) -> str:
        return template.before.format(role=role)

    def rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, number), rows in _grouped(batches, names, 2):
            entry, leave, last = rows[0][5:]
            chosen = choose([_known(r[3]) for r in rows], entry, leave, costs)
            found, started = [], entry > 0
            for position, (row, (cost, role, merged, inserted)) in enumerate(zip(rows, chosen, strict=True)):
                text = row[4] or ""
                for mark, broken in template.marks:
                    text = text.replace(mark, broken)
                piece = template.joint + text
                if not merged:
                    empty = opened(inserted) + template.after if inserted else ""
                    piece = (template.after if started else "") + empty + opened(role) + text
                started = True
                added = [inserted] if inserted else []
                if last and position == len(rows) - 1:
                    more, roles = closing(costs)[leave]
                    cost += more
                    added += [f"{r} at the end" for r in roles]
                    piece += template.after + "".join(opened(r) + template.after for r in roles)
                relabelled = "relabel" if _known(row[3]) != role else "keep"
                action = relabelled if not merged else "merge" if relabelled == "keep" else "relabel and merge"
                found.append(
                    {
                        "conv_id": conv, "block": number, "position": position, "turn": row[2], "role": row[3],
                        "new_role": role, "action": action, "inserted": ", ".join(added), "cost": cost, "piece": piece,
                    }
                )
            yield pa.RecordBatch.from_pylist(found, out)

    return joined.sortWithinPartitions(*order).mapInArrow(
        rendered,
        f"conv_id {kind}, block long, position long, turn long, role string, new_role string, "
        "action string, inserted string, cost long, piece string",
    )


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
