"""Minimum-cost repair of the roles of conversations, and their rendering as chat text.

Legal turns: an optional system turn, then user and assistant in turn, an assistant turn last. A turn may be kept, merged into
the one before it (which has its role), relabelled, and preceded by empty turns; each has a cost, and a shortest path over the
automaton's states is sought. A turn is a small (min, +) matrix over the states, and so is any run of turns: a conversation may
lie in many partitions, whose matrices are combined before each partition writes out its own turns.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import shared_dir, ship, shuffle_width

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: The legal next states of each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40


@cache
def inserted(a: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """The least cost, and the empty turns, to come from state a to each state by insertions alone."""
    done: dict[int, tuple[int, tuple[int, ...]]] = {}
    queue = [(0, (), a)]
    while queue:
        cost, path, s = heapq.heappop(queue)
        if s not in done:
            done[s] = (cost, path)
            for t in NEXT[s]:
                heapq.heappush(queue, (cost + INSERT, (*path, t), t))
    return done


@cache
def moves(role: str | None) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state before, state after) to (cost, action, empty turns before) of a turn; of equal costs the first in order."""
    own, out = ROLES.get(role or "", -1), {}
    for a in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            label = 0 if t == own else RELABEL
            ways = [(cost + label, "keep" if not label else "relabel", path) for s, (cost, path) in inserted(a).items() if t in NEXT[s]]
            if a == t:
                ways.append((MERGE + label, "merge" if not label else "relabel and merge", ()))
            if ways:
                out[a, t] = min(ways)
    return out


def closing(a: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns to end legally in state a."""
    return (0, ()) if a == START else inserted(a)[ASSISTANT]


def advance(vector: list[int], role: str | None) -> list[int]:
    new = [FAR] * 4
    for (a, t), (cost, _, _) in moves(role).items():
        new[t] = min(new[t], vector[a] + cost)
    return new


def matrix(roles: list[str | None]) -> list[int]:
    """16 costs: from each state before the run to each state after it."""
    out = []
    for a in range(4):
        v = [FAR] * 4
        v[a] = 0
        for r in roles:
            v = advance(v, r)
        out += v
    return out


FRESH = (0, FAR, FAR, FAR)


def traced(roles: list[str | None], start: tuple[int, ...]) -> tuple[list[int], list[list[int]]]:
    """Costs of the states after the turns, and for each turn and state after it the state before it, of equal ones the least; ``start``: the
    costs of the states before the turns."""
    v, back = list(start), []
    for r in roles:
        new, came = [FAR] * 4, [-1] * 4
        for (a, t), (cost, _, _) in moves(r).items():
            if v[a] + cost < new[t]:
                new[t], came[t] = v[a] + cost, a
        back.append(came)
        v = new
    return v, back


def cheapest_end(v: list[int]) -> int:
    return min(range(4), key=lambda s: (v[s] + closing(s)[0], s))


def repair(roles: list[str | None], start: tuple[int, ...] = FRESH, end: int | None = None) -> tuple[int, list[tuple[int, str, tuple[int, ...]]], tuple[int, ...], int]:
    """(cost, (state, action, empty turns before) of each turn, empty turns at the end, state before); start: the costs of the states before;
    end: the state to reach, None to close."""
    v, back = traced(roles, start)
    last = end if end is not None else cheapest_end(v)
    tail = () if end is not None else closing(last)[1]
    cost = v[last] + (closing(last)[0] if end is None else 0)
    path, s = [], last
    for r, came in zip(reversed(roles), reversed(back), strict=True):
        a = came[s]
        _, action, before = moves(r)[a, s]
        path.append((s, action, before))
        s = a
    return cost, path[::-1], tail, s


def entered(rows: list[tuple]) -> dict[tuple[int, object], tuple[tuple[int, ...], bool]]:
    """(partition, conversation) to the costs of the states before it, and whether it ends there, of those that lie in several partitions."""
    parts: dict[object, list] = {}
    for conv, pid, costs in sorted(rows, key=lambda r: r[1]):
        parts.setdefault(conv, []).append((pid, np.array(costs).reshape(4, 4)))
    out = {}
    for conv, own in parts.items():
        v = np.array(FRESH)
        for k, (pid, m) in enumerate(own) if len(own) > 1 else ():
            out[pid, conv] = (tuple(v.tolist()), k == len(own) - 1)
            v = (v[:, None] + m).min(0)
    return out


def boundaries(across: dict, turns: list[tuple]) -> dict[tuple[int, object], tuple[tuple[int, ...], int | None]]:
    """(partition, conversation) to the costs of the states before it and the state after it, None at its end; ``turns``: for each the state
    before it for each state after it, and its last state, if it ends there. The last state of a conversation settles all others, one
    partition after the other: of equally cheap ways the one that a single partition would take."""
    out, parts = {}, {}
    for conv, pid, before, last in sorted(turns, key=lambda r: -r[1]):
        parts.setdefault(conv, []).append((pid, before, last))
    for conv, own in parts.items():
        after = None
        for pid, before, last in own:
            out[pid, conv] = (across[pid, conv][0], after)
            after = before[last if after is None else after]
    return out


_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    """A text in which nothing reads as a control marker: ``<|`` gets a backslash between, ``<\\|`` one more, and so on."""
    return _MARK.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    """The text that ``escaped`` was given."""
    return _ESCAPED.sub(r"<\1|", text)


def _runs(batches):
    """The conversations of a partition, each as (conv_id, turns, roles, texts)."""
    own, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if rows and row[0] != own:
                yield own, rows
                rows = []
            own = row[0]
            rows.append(row[1:])
    if rows:
        yield own, rows


_OUT = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def repaired(conversations: DataFrame, width: int | None = None) -> DataFrame:
    """The legal turns of every conversation at the least cost.

    One row a turn of the input and a row for each empty turn: conv_id, block and place (their order), turn (null for an empty
    turn), role, text, action (keep, merge, relabel, relabel and merge, insert) and rendered; the rendered pieces of a
    conversation in order are its chat text, in which ``<|`` stands for a control marker alone (see ``escaped``). A conversation may be
    longer than a task can hold, so its pieces are never put together here. Turns are in order of turn, role, the text's first 64 characters and a hash of it (nulls first);
    partitions are cut along the same order, so ties and repeated rows have a fixed one, whatever the number of partitions (``width``). Unknown and null roles are relabelled; a null text is empty; a null conv_id is a conversation like any
    other. Only these four columns are read. An empty table gives no rows.

    Rows are dealt out by ranges of conversation and turn, so a conversation of any length is shared by many tasks; two
    matrices a partition, at most, and then as many maps from the state after to that before, meet on the driver. Of equally cheap repairs
    the same is chosen however turns are dealt out.
    """
    spark = conversations.sparkSession
    ship(spark)
    shared_dir(spark)
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), F.xxhash64("text")]
    dealt = rows.repartitionByRange(width or shuffle_width(spark), *order)
    base = dealt.sortWithinPartitions(*order, "text").checkpoint()

    def summed(batches):
        first = last = None
        for conv, rows in _runs(batches):
            last = (conv, [r[1] for r in rows])
            first = first or last
        ends = [first, last] if first is not last else [first]
        ends = [(c, matrix(roles)) for c, roles in filter(None, ends)]
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in ends], pa.int64()), pa.array([pid] * len(ends), pa.int32()), pa.array([m for _, m in ends], pa.list_(pa.int64()))], ["conv", "pid", "costs"])

    across = entered([tuple(r) for r in base.mapInArrow(summed, "conv long, pid int, costs array<long>").collect()])

    def turned(batches):
        pid = TaskContext.get().partitionId()
        for conv, rows in _runs(batches) if any(p == pid for p, _ in across) else ():
            if (pid, conv) in across:
                start, ends = across[pid, conv]
                v, back = traced([r[1] for r in rows], start)
                before = list(range(4))
                for came in reversed(back):
                    before = [came[s] if s >= 0 else -1 for s in before]
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([pid], pa.int32()), pa.array([before], pa.list_(pa.int32())), pa.array([cheapest_end(v) if ends else None], pa.int32())], ["conv", "pid", "before", "last"])

    turns = base.mapInArrow(turned, "conv long, pid int, before array<int>, last int").collect() if across else []
    held = spark.sparkContext.broadcast(boundaries(across, [tuple(r) for r in turns]))

    def written(batches):
        pid = TaskContext.get().partitionId()
        out: list[tuple] = []

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in _OUT]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        for conv, rows in _runs(batches):
            start, end = held.value.get((pid, conv), (FRESH, None))
            _, path, tail, state = repair([r[1] for r in rows], start, end)
            place, opened = 0, state != START
            for (turn, _, text), (state, action, before) in zip(rows, path, strict=True):
                for s in before:
                    out.append((conv, pid, place, None, NAMES[s], "", "insert", ("<|end|>\n" if opened else "") + f"<|{NAMES[s]}|>\n"))
                    place, opened = place + 1, True
                text = text or ""
                head = "\n" if action.endswith("merge") else ("<|end|>\n" if opened else "") + f"<|{NAMES[state]}|>\n"
                out.append((conv, pid, place, turn, NAMES[state], text, action, head + escaped(text)))
                place, opened = place + 1, True
            for s in tail:
                out.append((conv, pid, place, None, NAMES[s], "", "insert", f"<|end|>\n<|{NAMES[s]}|>\n"))
                place += 1
            if end is None and out:
                out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
            if len(out) > 5000:
                yield flush()
        yield flush()

    return base.mapInArrow(written, "conv_id long, block int, place long, turn long, role string, text string, action string, rendered string")
