"""Cheapest repair of conversations: Viterbi over the states of a role grammar, with survivors that coalesce.

Rows of a conversation, in order, are kept, given another role or deleted, and empty rows are inserted, until their roles
read ``(s?(ua)+)?``. The states are what may come next: nothing yet, after the system row, after a user row,
after an assistant row. Each state keeps its cheapest way there; ways form a tree of backpointers with reference
counts. Once all states descend from one node, all edits up to it are certain: they are emitted and forgotten, so memory
holds unresolved rows only. Of equally cheap ways the one whose edit initials come first stays. Ways of equal cost are
compared over their whole unresolved suffixes: as two ways that took the same rows are never the beginning of one
another, the order of the survivors, kept up to date row by row, decides for all that follows.

A conversation need not fit a task. Rows are sorted in ranges over (conversation, turn, role, text). What lies
whole inside a range is settled where it was sorted. A conversation that crosses a border, or is long, is settled in three
steps: every range tells for each state it may be entered in which states it can be left in, at what cost and in which
order (16 cells); these are folded along the conversation; and each range is gone through again, from the state it is
then known to be entered in to the one it is left in.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidewire.storage import Scratch, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted row leads from each state, and its role.
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Where a kept row leads: (state, initial of its role) -> state.
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: Rows of a conversation that a task holds before it leaves the rest to the steps for long ones.
_LONG = 2048


class Move(NamedTuple):
    edits: str
    cost: int
    to: int


def _moves() -> dict[tuple[int, str, str], list[Move]]:
    """What can be done with a row: (state before, initial of its role, fault) -> insertions and the row's own edit."""
    out = {}
    for state, initial, fault in itertools.product(range(4), ("s", "u", "a", ""), ("", BLANK, TRUNCATED)):
        moves = [Move("D", DELETE, state)]
        if fault != BLANK:  # an insertion before a deletion is as cheap after it, and comes first there
            more = CUT if fault == TRUNCATED else 0
            at = state
            for n in range(3):
                if (at, initial) in _KEPT:
                    moves.append(Move("I" * n + "K", n * INSERT + KEEP + more, _KEPT[at, initial]))
                moves.append(Move("I" * n + "R", n * INSERT + REROLE + more, _NEXT[at][0]))
                at = _NEXT[at][0]
        out[state, initial, fault] = moves
    return out


_MOVES = _moves()
#: What it costs at most to go on from one state as another would: the roles that lead there are inserted, and a system
#: row that only a beginning can keep is deleted. A way that is dearer than another by more can never win.
_IMITATE = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0,
    (SYSTEM, START): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
}
#: Insertions that end a conversation well.
_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class _Node:
    """The edits of one row on a way; ``refs`` counts the nodes that go on from it and the states that end in it."""

    __slots__ = ("edits", "kids", "parent", "refs")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


class Survivors:
    """The cheapest way to each state. ``emit`` gets each row's edits, in order, as soon as they are certain."""

    def __init__(self, emit: Callable[[str], None] | None = None, start: int = START):
        self.root, self.emit = _Node(None, ""), emit
        self.root.refs = 1
        self.live: dict[int, tuple[int, int, _Node]] = {start: (0, 0, self.root)}  # state -> cost, place in the order, node
        self.open = self.most = 0  # rows not yet certain, and the most there were

    def step(self, initial: str, fault: str) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, place, _) in self.live.items():
            for m in _MOVES[state, initial, fault]:
                way = (cost + m.cost, place, m.edits, state)
                if m.to not in best or way < best[m.to]:
                    best[m.to] = way
        best = {t: w for t, w in best.items() if all(t == o or w[0] <= x[0] + _IMITATE[o, t] for o, x in best.items())}
        order = {w: i for i, w in enumerate(sorted(w[1:3] for w in best.values()))}
        old, self.live = self.live, {}
        for to, (cost, place, edits, state) in best.items():
            node = _Node(old[state][2], edits) if self.emit else self.root
            node.refs += 1
            self.live[to] = (cost, order[place, edits], node)
        if self.emit:
            for _, _, node in old.values():
                self._release(node)
            self.open += 1
            while self.root.refs == 1 and self.root.kids:  # all states descend from one child
                self._certain(self.root.kids[0])
            self.most = max(self.most, self.open)

    def delete(self, rows: int) -> None:
        """``rows`` rows that have to go, where nothing is emitted: all ways grow alike."""
        self.live = {s: (c + rows * DELETE, p, n) for s, (c, p, n) in self.live.items()}

    def _certain(self, node: _Node) -> None:
        self.root, node.parent = node, None
        self.open -= 1
        self.emit(node.edits)

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:  # a way on which no state goes on
            up = node.parent
            up.kids.remove(node)
            up.refs -= 1
            node = up

    def finish(self, state: int | None = None) -> tuple[int, int]:
        """End in ``state``, or at the end of the conversation: emit what is left, return (cost, insertions at the end)."""
        ends = {state: 0} if state is not None else _END
        ways = {s: (c + INSERT * ends[s], p) for s, (c, p, _) in self.live.items() if s in ends}
        to = min(ways, key=ways.get)
        path, node = [], self.live[to][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for n in reversed(path):
            self._certain(n)
        return ways[to][0], ends[to]


def fold(before: list, cells: list) -> tuple[list, list[int | None]]:
    """Survivors (cost, place) before a range and the range's 16 cells -> those after it, and the state each came from."""
    best: list = [None] * 4
    for a, b in itertools.product(range(4), range(4)):
        if before[a] is not None and cells[4 * a + b] is not None:
            way = (before[a][0] + cells[4 * a + b][0], before[a][1], cells[4 * a + b][1], a)
            best[b] = way if best[b] is None else min(best[b], way)
    order = sorted(w[1:3] for w in best if w is not None)
    return [w and (w[0], order.index(w[1:3])) for w in best], [w and w[3] for w in best]


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


class EditRows:
    """Edit rows of complete, ordered conversations as record batches; what ``repair`` returns."""

    FIELDS = "at long, sub long, edit string, turn {turn}, old_role string, role string, text string, fault string, cost long"

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += 100 + len(row[7] or "")

    def take(self, end: bool = False) -> list[tuple]:
        """Rows to hand out, when there are many or at the end."""
        if not end and self.size < 1_000_000:
            return []
        out, self.rows, self.size = self.rows, [], 0
        return out


class Digests:
    """One row a conversation from its edit rows in order: counts, cost, edits in a row, and a hash of what is left."""

    FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self):
        self.conv, self.done = (), []

    def add(self, row: tuple) -> None:
        conv, _, _, edit, turn, old, role, text, fault, cost = row
        if self.conv != (conv,):
            self._close()
            self.conv, self.faults, self.illegal, self.cost, self.audit = (conv,), {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}, 0, 0, []
            self.first = self.last = self.before = None
            self.turns, self.hash, self.begun = 0, hashlib.sha256(), False
        self.cost += cost
        self.audit.append(edit)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            self.illegal += self.before is not None and self.before[:1] + old[:1] not in ("su", "ua", "au")
            self.before = old
            if turn is not None and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.first = turn if self.first is None else self.first
        if edit != "D":
            self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
            self.begun = True

    def _close(self) -> None:
        if self.conv:
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            self.done.append((*self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()))

    def take(self, end: bool = False) -> list[tuple]:
        if end:
            self._close()
            self.conv = ()
        elif len(self.done) < 2000:
            return []
        out, self.done = self.done, []
        return out


class _Repair:
    """One conversation, or its part in one range, on its way through the survivors to a sink of edit rows."""

    def __init__(self, sink, conv, state: int = START):
        self.sink, self.conv, self.state, self.at = sink, conv, state, -1
        self.waiting: deque[tuple] = deque()
        self.survivors = Survivors(self._certain, state)

    def take(self, at: int, turn, role: str, text: str, fault: str, n: int) -> None:
        for copy in range(n):
            own = fault if copy == 0 or fault == BLANK else DUPLICATE
            self.waiting.append((at, 4 * copy, turn, role, text, own))
            self.survivors.step(_initial(role), BLANK if own == DUPLICATE else own)

    def _certain(self, edits: str) -> None:
        at, sub, turn, old, text, fault = self.waiting.popleft()
        for i, e in enumerate(edits, sub):
            cut = CUT if fault == TRUNCATED else 0
            if e == "D":
                self.sink.add((self.conv, at, i, e, turn, old, None, text, fault, DELETE))
            elif e == "K":
                self.state = _KEPT[self.state, _initial(old)]
                self.sink.add((self.conv, at, i, e, turn, old, old, text, fault, KEEP + cut))
            else:
                self.state, role = _NEXT[self.state]
                more = (None, None, role, "", None, INSERT) if e == "I" else (turn, old, role, text, fault, REROLE + cut)
                self.sink.add((self.conv, at, i, e, *more))
        self.at = at

    def finish(self, state: int | None = None) -> None:
        _, more = self.survivors.finish(state)
        for i in range(more):
            self.state, role = _NEXT[self.state]
            self.sink.add((self.conv, self.at, (1 << 62) + i, "I", None, None, role, "", None, INSERT))


def _tuples(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield from zip(*[c.to_pylist() for c in b.slice(i, rows).columns], strict=True)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sorted_ranges(make_sink, schema: pa.Schema, long: int):
    """A sorted range: settled rows of the conversations that lie whole inside, the others' rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, raw = make_sink(), []
        width = len(schema) - 7

        def out(end: bool = False):
            for rows in [sink.take(end)]:
                if rows:
                    columns = [list(c) for c in zip(*rows, strict=True)]
                    yield _batch([columns[0], *[[None] * len(rows)] * 6, *columns[1:]], schema)
            if raw and (end or len(raw) >= 1000):
                columns = [list(c) for c in zip(*raw, strict=True)]
                yield _batch([*columns, *[[None] * len(raw)] * width], schema)
                raw.clear()

        held, conv, whole = [], None, False
        for row in _tuples(batches):
            if conv != (row[0],):
                if conv is not None and whole:
                    one = _Repair(sink, conv[0])
                    for r in held:
                        one.take(*r[1:])
                    one.finish()
                else:
                    raw.extend(held)
                # the first conversation of a range may have begun before it
                held, whole, conv = [], conv is not None, (row[0],)
            held.append(row)
            if len(held) > long or not whole:
                raw.extend(held)
                held, whole = [], False
            yield from out()
        raw.extend(held)  # and the last may go on
        yield from out(True)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order -> for each part cost and place of the way between each two states."""

    def cells(conv, block, four) -> tuple:
        flat = [x for s in four for t in range(4) for x in (s.live[t][:2] if t in s.live else (-1, -1))]
        return conv, block, flat

    key, four, done, types = None, [], [], None
    for b in batches:
        types = b.schema
        for conv, block, _, initial, fault, n in _tuples(iter([b])):
            if key != (conv, block):
                if key:
                    done.append(cells(*key, four))
                key, four = (conv, block), [Survivors(None, s) for s in range(4)]
            for s in four:
                s.step(initial, BLANK if fault == DUPLICATE else fault)
                s.delete(n - 1)
    if key:
        done.append(cells(*key, four))
        columns = list(zip(*done, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], types.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["conv_id", "block", "cells"])


def _along(parts):
    """The parts of one conversation (16 cells each) -> the states each is entered and left in (null: the end)."""
    parts = parts.sort_values("block")
    state, ways = [(0, 0), None, None, None], []
    for flat in parts["cells"]:
        pairs = [None if flat[i] < 0 else (int(flat[i]), int(flat[i + 1])) for i in range(0, 32, 2)]
        state, came = fold(state, pairs)
        ways.append(came)
    to = min((s for s in range(4) if state[s] is not None), key=lambda s: (state[s][0] + INSERT * _END[s], state[s][1]))
    enter, leave = [], [None]
    for came in reversed(ways):
        to = came[to]
        enter.append(to)
        leave.append(to)
    return parts.assign(enter=enter[::-1], leave=leave[:-1][::-1])[["conv_id", "block", "enter", "leave"]].astype({"leave": "Int64"})


def _known_parts(sink_of, schema: pa.Schema):
    """Rows of parts in order, with the states they are entered and left in -> edit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, key, one, leave = sink_of(), None, None, None
        for conv, block, at, turn, role, text, fault, n, enter, to in _tuples(batches):
            if key != (conv, block):
                if one:
                    one.finish(leave)
                key, one, leave = (conv, block), _Repair(sink, conv, enter), to
            one.take(at, turn, role, text, fault, n)
            if rows := sink.take():
                yield _batch([list(c) for c in zip(*rows, strict=True)], schema)
        if one:
            one.finish(leave)
        if rows := sink.take(True):
            yield _batch([list(c) for c in zip(*rows, strict=True)], schema)

    return run


def _digest(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Digests()
        for row in _tuples(batches):
            sink.add(row)
            if rows := sink.take():
                yield _batch([list(c) for c in zip(*rows, strict=True)], schema)
        if rows := sink.take(True):
            yield _batch([list(c) for c in zip(*rows, strict=True)], schema)

    return run


def faults(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, n)`` with the ``fault`` of the first of n equal rows: blank, duplicate (role and
    text were there at an earlier turn), truncated, or empty. Further copies of a row that is not blank are duplicates."""
    scratch = Scratch(rows.sparkSession, "faults")
    say = [F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)]
    keyed = scratch.put(rows.select("*", say[0].alias("__a"), say[1].alias("__b"), F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("__t")))
    firsts = scratch.put(keyed.groupBy("conv_id", "__a", "__b").agg(F.min("__t").alias("__f")), narrow=True)
    one, other = keyed.alias("k").hint("merge"), firsts.alias("f").hint("merge")
    both = one.join(other, F.col("k.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("k.__a") == F.col("f.__a")) & (F.col("k.__b") == F.col("f.__b")))
    bare = F.rtrim(F.col("k.text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", BLANK).when(F.col("k.__t") != F.col("f.__f"), DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise("")
    return both.select("k.conv_id", "k.turn", "k.role", "k.text", fault.alias("fault"), "k.n")


def repair(df: DataFrame, *, digest: bool = False, long: int = _LONG) -> DataFrame:
    """``df(conv_id, turn, role, text)`` to edit rows, or with ``digest`` to one row a conversation.

    An edit row: ``conv_id``, ``at`` and ``sub`` (their order in the conversation), ``edit`` (K, R, D or I), ``turn`` and
    ``old_role`` (null for I), ``role`` (null for D), ``text``, ``fault``, ``cost``. See ``Digests`` for the other form.

    Rows go by turn, null first, then role and text; a null role or text counts as one blank; a null ``conv_id`` is one
    conversation; rows equal in all four are copies, each but the first a duplicate; other columns are not looked at. Empty
    texts are blank and go; very long ones are read whole. An empty table gives an empty one. A conversation of any length
    is settled range by range (more than ``long`` rows are never held); only its digest, whose hash is serial by
    definition, passes one task, as a stream.
    """
    scratch = Scratch(df.sparkSession, "conversations")
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = df.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = ["conv_id", "turn", "role"]
    ranged = faults(rows).repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    ranged = ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text", "fault", "n")

    kinds = {c: ranged.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    kept = (Digests.FIELDS if digest else EditRows.FIELDS).format(**kinds)
    first = f"conv_id {kinds['conv_id']}"
    raw = f"o_at long, o_turn {kinds['turn']}, o_role string, o_text string, o_fault string, o_n long"
    sink = Digests if digest else EditRows
    arrow = lambda ddl: to_arrow_schema(_parse_datatype_string(ddl))
    both = f"{first}, {raw}, {kept}"
    settled = scratch.put(ranged.mapInArrow(_sorted_ranges(sink, arrow(both), long), both))
    names = [x.strip().split(" ")[0] for x in f"{first}, {kept}".split(",")]
    whole = settled.where("o_at is null").select(*names)

    block = F.shiftright("o_at", 33)
    open_ = settled.where("o_at is not null").select("conv_id", block.alias("block"), F.col("o_at").alias("at"), F.col("o_turn").alias("turn"), F.col("o_role").alias("role"), F.col("o_text").alias("text"), F.col("o_fault").alias("fault"), F.col("o_n").alias("n"))
    letter = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("")
    thin = open_.select("conv_id", "block", "at", letter.alias("initial"), "fault", "n").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    parts = scratch.put(thin.mapInArrow(_cells, f"{first}, block long, cells array<long>"), narrow=True)
    states = scratch.put(parts.groupBy("conv_id").applyInPandas(_along, f"{first}, block long, enter int, leave int"), narrow=True)
    o, s = open_.alias("o").hint("merge"), states.alias("s").hint("merge")
    placed = o.join(s, F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o.block") == F.col("s.block")))
    placed = placed.select("o.conv_id", "o.block", "o.at", "o.turn", "o.role", "o.text", "o.fault", "o.n", "s.enter", "s.leave")
    placed = placed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    edits = EditRows.FIELDS.format(**kinds)
    parted = placed.mapInArrow(_known_parts(EditRows, arrow(f"{first}, {edits}")), f"{first}, {edits}")
    if digest:
        parted = parted.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").mapInArrow(_digest(arrow(f"{first}, {kept}")), f"{first}, {kept}")
    return whole.unionByName(parted)


def damage(df: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of conversation and turn: one in twenty each is dropped, emptied, loses its
    full stops, is repeated, or becomes the user's. Nulls count as one blank (a null turn stays null in the order)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = df.select("conv_id", "turn", kind.alias("kind"), text("role").alias("role"), text("text").alias("text")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), twice.alias("copy")).drop("copy")


def op12(spark, sf_dir):
    """Every conversation damaged, repaired at least cost, and told in one row."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = Scratch(spark, "repaired").put(repair(damage(rows), digest=True), narrow=True)
    names = rows.select("conv_id").distinct()
    n, g = names.alias("n").hint("merge"), got.alias("g").hint("merge")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [F.coalesce(F.col(f"g.{c}"), F.lit(none.get(c, 0))).alias(c) for c in got.columns[1:]]
    return n.join(g, F.col("n.conv_id").eqNullSafe(F.col("g.conv_id")), "left").select("n.conv_id", *columns)
