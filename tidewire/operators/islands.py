"""Greedy leaders without loops as long as a chain: a problem is cut where nothing reaches across, and each island
settles in one scan in visit order.

Two kinds of cut. Rows that match within a span of time are sorted by group and time in key ranges; a gap longer than
the span is a cut, and a scan needs the leaders of the last span only. Rows that match by given edges are cut into
connected components.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.storage import Scratch

_DAY = 86400e6


class _Scan:
    """Leaders within reach while rows of one group pass, newest first."""

    def __init__(self, days: float, factor: float, group=None, leaders: list[tuple] = ()):
        self.days, self.factor, self.group, self.leaders = days, factor, group, list(leaders)
        self.last = self.leaders[-1][0] if self.leaders else None

    def cut(self, group, t: int) -> bool:
        """Whether nothing before reaches this row."""
        return self.last is None or self.group != group or (self.last - t) / _DAY > self.days

    def take(self, group, t: int, m: float, row):
        """The row's leader."""
        if self.group != group:
            self.group, self.leaders = group, []
        self.last = t
        while self.leaders and (self.leaders[0][0] - t) / _DAY > self.days:
            self.leaders.pop(0)
        for _, size, who in self.leaders:
            if max(size, m) / min(size, m) <= self.factor:
                return who
        self.leaders.append((t, m, row))
        return row

    def reach(self) -> list[tuple]:
        return [x for x in self.leaders if (x[0] - self.last) / _DAY <= self.days]


class _WordScan(_Scan):
    """The same for rows with sets of words, which match from ``factor`` words in common on: leaders are found by word."""

    def __init__(self, days: float, factor: int, group=None, leaders: list[tuple] = ()):
        super().__init__(days, factor, group, leaders)
        self._start(leaders)

    def _start(self, leaders) -> None:
        self.leaders, self.gone, self.by_word = deque(), 0, {}
        for x in leaders:
            self._add(x)

    def _add(self, leader: tuple) -> None:
        for w in leader[1]:
            self.by_word.setdefault(w, deque()).append(self.gone + len(self.leaders))
        self.leaders.append((leader[0], frozenset(leader[1]), leader[2]))

    def take(self, group, t: int, m: list[str], row):
        if self.group != group:
            self.group = group
            self._start(())
        self.last = t
        while self.leaders and (self.leaders[0][0] - t) / _DAY > self.days:
            for w in self.leaders.popleft()[1]:  # the oldest is first in each list
                self.by_word[w].popleft()
                if not self.by_word[w]:
                    del self.by_word[w]
            self.gone += 1
        lists = sorted((self.by_word[w] for w in m if w in self.by_word), key=len)
        # who shares that many words is beside the longest lists in another one too
        for i in sorted(set().union(*lists[: max(0, len(lists) - self.factor + 1)])):
            _, words, who = self.leaders[i - self.gone]
            if len(words.intersection(m)) >= self.factor:
                return who
        self._add((t, m, row))
        return row

    def reach(self) -> list[tuple]:
        return [(t, sorted(m), who) for t, m, who in self.leaders if (t - self.last) / _DAY <= self.days]


def _rows(batches: Iterator[pa.RecordBatch], columns: int, size: int = 5000) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield from zip(*[b.column(i).slice(at, size).to_pylist() for i in range(columns)], strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first_pass(scan_from: Callable[..., _Scan], schema: pa.Schema):
    """A sorted range: rows with leaders, but those of its first island without; and one row that describes the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, out, first, n, open_ = scan_from(), [], None, None, True
        for n, group, t, id_, m in _rows(batches, 5):
            cut = scan.cut(group, t)
            open_ = open_ and (first is None or not cut)
            first = first or (group, t)
            leader = scan.take(group, t, m, id_)
            out.append((n, group, t, id_, m, None if open_ else leader, open_, None, None))
            if len(out) == 5000:
                yield _table(out, schema)
                out = []
        if first:
            edge = [{"t": t, "m": m, "id": i} for t, m, i in scan.reach()]
            out.append((n, scan.group, scan.last, None, None, None, open_, {"group": first[0], "t": first[1]}, edge))
        yield _table(out, schema)

    return run


def _again(scan_from: Callable[..., _Scan], known, schema: pa.Schema, ends: bool):
    """Open rows of ranges in order, with the leaders that reach in: their leaders, or what reaches on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coming, scan, at, out = known.value, None, None, []

        def close():
            if scan is not None and ends:
                out.append((at, [{"t": t, "m": m, "id": i} for t, m, i in scan.reach()]))

        for n, group, t, id_, m in _rows(batches, 5):
            if n != at:
                close()
                at, scan = n, scan_from(*coming.get(n, (None, [])))
            leader = scan.take(group, t, m, id_)
            if not ends:
                out.append((id_, leader))
                if len(out) == 5000:
                    yield _table(out, schema)
                    out = []
        close()
        yield _table(out, schema)

    return run


def leaders_in_time(rows: DataFrame, days: float, factor: float) -> DataFrame:
    """``rows(group, t, id, m)`` -> ``(id, leader)``: newest first (then by id), each row follows the first leader of its
    group within ``days`` whose ``m`` is within ``factor``, or becomes one. ``t``: microseconds; nothing is null.

    No pair is made: a leader meets the rows of its span as they pass, and leaders within one span differ by more than
    the factor, so they are few. What one range leaves to the next is their list. Where a group goes on without a gap
    through several ranges, these run side by side on what is known of the list, and again where it has changed, until it
    has not: greedy choices forget where they came from, so that takes few turns, and never more than there are ranges.
    """
    return _in_time(rows.withColumn("m", F.col("m").cast("double")), days, partial(_Scan, days, factor))


def word_leaders_in_time(rows: DataFrame, days: float, least_shared: int) -> DataFrame:
    """``leaders_in_time`` where ``m`` is an array of distinct words and rows match that share ``least_shared`` of them.

    Rows are compared with the leaders of their span only, found by their rarer words there; rows that follow one leader
    are never compared with each other, so any number of them that match one another makes no pairs.
    """
    return _in_time(rows, days, partial(_WordScan, days, least_shared))


def _in_time(rows: DataFrame, days: float, scan_from: Callable[..., _Scan]) -> DataFrame:
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "islands")
    kinds = {c: rows.schema[c].dataType for c in ("group", "id", "m")}
    group, id_, m_ = (kinds[c].simpleString() for c in ("group", "id", "m"))
    arrow = {c: to_arrow_type(k) for c, k in kinds.items()}
    edge = pa.list_(pa.struct([("t", pa.int64()), ("m", arrow["m"]), ("id", arrow["id"])]))
    begin = pa.struct([("group", arrow["group"]), ("t", pa.int64())])
    full = pa.schema([("n", pa.int32()), ("group", arrow["group"]), ("t", pa.int64()), ("id", arrow["id"]), ("m", arrow["m"]), ("leader", arrow["id"]), ("open", pa.bool_()), ("first", begin), ("edge", edge)])
    ddl = f"n int, `group` {group}, t long, id {id_}, m {m_}, leader {id_}, open boolean, first struct<`group`:{group},t:bigint>, edge array<struct<t:bigint,m:{m_},id:{id_}>>"
    order = [F.col("group"), F.col("t").desc(), F.col("id")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.spark_partition_id().alias("n"), "group", "t", "id", "m")
    at = scratch.put(ranged.mapInArrow(_first_pass(scan_from, full), ddl))
    open_ = at.where("open and id is not null").select("n", "group", "t", "id", "m")

    ranges = at.where("first is not null").select("n", "group", "t", "open", "first", "edge").orderBy("n").collect()
    edges = {r["n"]: (r["group"], [tuple(x) for x in r["edge"]]) for r in ranges}

    def coming() -> dict:
        out = {}
        for before, r in zip(ranges, ranges[1:], strict=False):
            own, leaders = edges[before["n"]]
            near = [x for x in leaders if own == r["first"]["group"] and (x[0] - r["first"]["t"]) / _DAY <= days]
            if near:
                out[r["n"]] = (own, near)
        return out

    def sorted_(df):
        return df.repartition("n").sortWithinPartitions("n", *order)

    whole, used = {r["n"] for r in ranges if r["open"]}, {}
    while changed := [n for n in whole if coming().get(n) != used.get(n)]:
        used |= {n: coming().get(n) for n in changed}
        known = spark.sparkContext.broadcast({n: used[n] for n in changed if used[n]})
        schema = pa.schema([("n", pa.int32()), ("edge", edge)])
        told = sorted_(open_.where(F.col("n").isin(changed))).mapInArrow(_again(scan_from, known, schema, True), f"n int, edge array<struct<t:bigint,m:{m_},id:{id_}>>")
        for r in told.collect():  # one row a range
            edges[r["n"]] = (edges[r["n"]][0], [tuple(x) for x in r["edge"]])
    known = spark.sparkContext.broadcast(coming())
    last = pa.schema([("id", arrow["id"]), ("leader", arrow["id"])])
    return at.where("not open").where("id is not null").select("id", "leader").union(sorted_(open_).mapInArrow(_again(scan_from, known, last, False), f"id {id_}, leader {id_}"))


def _settle(schema: pa.Schema):
    """Edges ``(island, a, b)`` by island, a's order and b's order, b before a -> ``(a, leader)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, node, leader, members, out = None, None, None, set(), []
        for here, a, b in _rows(batches, 3):
            if (here, a) != (island, node):
                if node is not None and leader is not None:
                    out.append((node, leader))
                    members.add(node)
                if here != island:
                    members = set()
                island, node, leader = here, a, None
                if len(out) >= 5000:
                    yield _table(out, schema)
                    out = []
            if leader is None and b not in members:
                leader = b
        if leader is not None:
            out.append((node, leader))
        yield _table(out, schema)

    return run


def settle_islands(edges: DataFrame) -> DataFrame:
    """``edges(island, a, oa, b, ob)``, b before a in the order of ``oa`` and ``ob`` -> ``(id, leader)`` of all members.

    An island is scanned by one task, which remembers the members of the island."""
    kind = edges.schema["a"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("leader", to_arrow_type(kind))])
    at = edges.repartition("island").sortWithinPartitions("island", "oa", "a", "ob").select("island", "a", "b")
    return at.mapInArrow(_settle(schema), f"id {kind.simpleString()}, leader {kind.simpleString()}")
