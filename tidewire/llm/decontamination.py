"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once from the benchmark and sent to the tasks, which stream the words of
every document through it, tracking the longest match that ends at each word. Stretches without enough
consecutive known words are skipped before any step is taken. A benchmark of more words than one automaton
may have is taken in several, one pass after another, with what the passes found written in between, so that a
worker never holds two.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import byte_slices
from tidewire.storage import Scratch, table

#: In UTF-8, [^\x00-\x2F\x3A-\x60\x7B-\x7F] is digits, a-z and every byte above ASCII; bytes.lower() changes A-Z only.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and anything above ASCII."""
    return _WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state.

    A window is ``window`` consecutive words of an item, or a whole item of fewer words. Once built, a state is
    a few integers: its first edge, its suffix link, its length and the item whose window ends in it; only
    states with more edges or more windows have a dictionary entry.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items}, key=lambda x: (x is None, x or ""))
        self._next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
        ends = self._windows(items)
        self.least = min((min(window, len(ws)) for _, ws in items if ws), default=1)
        self.word, self.to = array("i"), array("i")
        self.more: dict[int, dict[int, int]] = {}
        self.one = array("i")
        self.many: dict[int, tuple[tuple[int, tuple[int, ...]], ...]] = {}
        for s, edges in enumerate(self._next):
            w, t = next(iter(edges.items()), (-1, -1))
            self.word.append(w)
            self.to.append(t)
            if len(edges) > 1:
                self.more[s] = edges
            own = ends.get(s, {})
            single = len(own) == 1 and len(own.get(window, ())) == 1
            self.one.append(next(iter(own[window])) if single else -2 if own else -1)
            if own and not single:
                self.many[s] = tuple(sorted(((k, tuple(sorted(v))) for k, v in own.items()), reverse=True))
        del self._next

    def _windows(self, items) -> dict[int, dict[int, set[int]]]:
        """State -> window length -> items whose windows end in it or in a suffix of it."""
        at = {name: i for i, name in enumerate(self.names)}
        ends: dict[int, dict[int, set[int]]] = {}
        for name, ws in items:
            state, length, k = 0, 0, min(self.window, len(ws))
            for w in ws:
                state, length = self._next[state][self.ids[w]], length + 1
                while self.link[state] >= 0 and self.len[self.link[state]] >= k:
                    state = self.link[state]
                length = min(length, self.len[state])
                if length >= k > 0:
                    ends.setdefault(state, {}).setdefault(k, set()).add(at[name])
        # what ends in a state also ends in all states whose strings have it as a suffix
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            above = ends.get(self.link[s])
            if above:
                own = ends.setdefault(s, {})
                for k, v in above.items():
                    own[k] = own[k] | v if k in own else v
        return ends

    def _add(self, last: int, w: int) -> int:
        if w in self._next[last]:
            q = self._next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self._next[p]:
            self._next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self._next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, edges: dict, link: int) -> int:
        self._next.append(edges)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.len[p] + 1, dict(self._next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self._next[p].get(w) == q:
            self._next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word intervals (half-open, merged, ascending) of a document, and the places of the items found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(ws) < self.least:
            return spans, found
        ids = np.fromiter(map(self.ids.get, ws, [-1] * len(ws)), np.int64, len(ws))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        runs = known.reshape(-1, 2)
        word, to, more, link, size, one, window = self.word, self.to, self.more, self.link, self.len, self.one, self.window
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():
            state = length = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while True:  # the longest suffix of the read words that some item contains
                    if word[state] == w:
                        state, length = to[state], length + 1
                        break
                    if state in more and w in more[state]:
                        state, length = more[state][w], length + 1
                        break
                    if not state:
                        length = 0
                        break
                    state = link[state]
                    length = size[state]
                e = one[state]
                if e >= 0:
                    if length >= window:
                        _append(spans, i - window, i)
                        found.add(e)
                elif e == -2:
                    hit = [x for x in self.many[state] if x[0] <= length]  # longest first: it covers the shorter ones
                    if hit:
                        _append(spans, i - hit[0][0], i)
                        for _, items in hit:
                            found.update(items)
        return _merge(spans, []), found


def _append(spans: list[tuple[int, int]], a: int, b: int) -> None:
    if spans and spans[-1][0] <= a <= spans[-1][1]:
        spans[-1] = (spans[-1][0], b)
    else:
        spans.append((a, b))


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, max_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items as word lists, in blocks of at most ``max_words`` words (one item at least); the driver holds one block."""
    block, n = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        if not (ws := words(r["t"])):
            continue
        if block and n + len(ws) > max_words:
            yield block
            block, n = [], 0
        block.append((r["i"], ws))
        n += len(ws)
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(shared, text: str, keep: list[str], before: bool):
    """The columns ``keep`` with words, spans and items of each row; spans and items of earlier passes are added to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in batches:
            for part in byte_slices(b, text):
                n, spans, items = [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    ws = words(t)
                    new, found = auto.scan(ws) if auto else ([], set())
                    names = [auto.names[x] for x in sorted(found)]
                    if before:
                        new = _merge([(x["start"], x["end"]) for x in part.column("__spans")[i].as_py()], new)
                        names = sorted({*part.column("__items")[i].as_py(), *names}, key=lambda x: (x is None, x or ""))
                    n.append(len(ws))
                    spans.append([{"start": s, "end": e} for s, e in new])
                    items.append(names)
                made = [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, "__n", "__spans", "__items"])

    return run


def find_contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 500_000, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) plus ``__n`` (words), ``__spans`` (hit word intervals) and
    ``__items`` (item ids found, sorted).

    A window is ``window`` consecutive words of an item, an item of fewer words is one window; null or
    wordless items and texts match nothing; repeated items count once; items without an id hit like others and
    are all one null at the end of ``__items``. Equal rows stay separate rows; very long texts are read whole,
    one at a time; columns of ``df`` named like the new ones are replaced. ``max_words`` bounds one automaton.
    """
    made = ["__n", "__spans", "__items"]
    keep = [c for c in (keep if keep is not None else df.columns) if c not in made]
    out, scratch, before = df.select(*dict.fromkeys([*keep, text])), Scratch(df.sparkSession, "contamination"), False
    blocks = item_blocks(benchmark, item, item_text, max_words)
    block = next(blocks, None)
    while True:
        after = next(blocks, None)
        cols = keep if after is None else list(dict.fromkeys([*keep, text]))
        kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols), "__n long, __spans array<struct<start:int,end:int>>, __items array<string>"])
        shared = df.sparkSession.sparkContext.broadcast(Automaton(block, window) if block else None)
        found = out.mapInArrow(_scan(shared, text, cols, before), kinds)
        if after is None:
            return found
        done = scratch.put(found)
        if before:
            scratch.drop(out)
        out, block, before = done, after, True


def _without(t: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans, and without what stands between the words of a span."""
    data = t.encode()
    where = [m.span() for m in _WORD.finditer(data.lower())]
    kept, last = [], 0
    for s, e in spans:
        kept.append(data[last : where[s][0]])
        last = where[e - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def _clean(shared, text: str, max_coverage: float):
    """Scan and cut in one: slices without a hit pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in batches:
            at = b.schema.get_field_index(text)
            for part in byte_slices(b, text):
                texts, stay, cut = part.column(at).to_pylist(), np.ones(part.num_rows, bool), False
                for i, t in enumerate(texts):
                    ws = words(t)
                    spans = auto.scan(ws)[0]
                    if spans:
                        stay[i] = sum(e - s for s, e in spans) <= len(ws) * max_coverage
                        texts[i], cut = _without(t, spans), True
                if cut:
                    part = part.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                yield part if stay.all() else part.filter(pa.array(stay))

    return run


def _cut(text: str):
    """Texts of one-automaton passes cut at the spans the passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            for part in byte_slices(b, text):
                texts, spans = part.column(at).to_pylist(), part.column("__spans").to_pylist()
                if any(spans):
                    texts = [_without(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans, strict=True)]
                    part = part.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                yield part

    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", max_coverage: float = 0.5, item: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 500_000) -> DataFrame:
    """The rows of ``df`` with hit spans removed from their texts; rows hit over more than ``max_coverage`` go.

    Spans are those of windows of ``window`` words, the length limit. Clean rows, null and empty texts among
    them, are returned unchanged; equal rows fare alike; very long texts are read whole, one at a time; an empty table or
    benchmark changes nothing; other columns, whatever their names, pass as they are.
    """
    blocks = item_blocks(benchmark, item, item_text, max_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return df
    if second is None:
        shared = df.sparkSession.sparkContext.broadcast(Automaton(first, window))
        return df.mapInArrow(_clean(shared, text, max_coverage), df.schema)
    own = {c: f"__own{c}" for c in ("__n", "__spans", "__items") if c in df.columns}
    hit = find_contamination(df.withColumnsRenamed(own), benchmark, text=text, item=item, item_text=item_text, window=window, max_words=max_words)
    hit = Scratch(df.sparkSession, "contamination").put(hit)
    covered = F.aggregate("__spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    kept = hit.where((F.size("__spans") == 0) | (covered <= F.col("__n") * max_coverage))
    cut = kept.mapInArrow(_cut(text), kept.schema).drop("__n", "__spans", "__items")
    return cut.withColumnsRenamed({v: k for k, v in own.items()}).select(*df.columns)


def op6(spark, sf_dir):
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hit.select("doc_id", F.col("__n").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def sha256_of_items(items: list[str]) -> str:
    """What ``op6`` gives for a set of items; for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
