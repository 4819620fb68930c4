"""Near-duplicate detection with ProbMinHash sketches of weighted word shingles.

A text is the multiset of its five-word shingles, weighted by frequency. Each shingle is a Poisson process
whose rate is its weight: its arrivals (exponential gaps, seeded by the shingle) fall into random registers,
a register keeps the earliest arrival, and a shingle stops when its next arrival is later than every
register's. Two texts agree in a register with the probability of their probability Jaccard similarity.
Registers are banded. Small bands are compared pair by pair; the texts of a large one with its most central text.
Large bands that then still hold different classes are compared in full, their connected texts too, block by
block, where an upper bound of the similarity of all pairs is one matrix product. So every two texts that share a
band are compared or are in one class already, and every link is verified on the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import chunks, mix, shingles, word_hashes
from tidewire.operators.graph import connected_components
from tidewire.storage import Scratch, table

_U = np.uint64
#: Bytes of text that a worker looks at together.
_CHUNK = 300_000


def weighted(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk: hash, text, weight; and for each text two hashes of its word sequence."""
    words, first = word_hashes(data, off)
    h, text = shingles(words, first, k)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(h)))
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(words)) - first[owner]).astype(np.uint64)
    keys = []
    for salt in (0x51ED270B, 0xB5297A4D):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + mix(place + _U(salt))), out=sums[1:])
        keys.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)))
    return h[at], text[at], weight, keys[0], keys[1]


def prob_minhash(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Registers (texts x m) of the shingles ``h`` of weight ``weight``; 0 where a text has none."""
    time = np.full(n_texts * m, np.inf)
    kept = np.zeros(n_texts * m, np.uint64)
    single = np.bincount(text, minlength=n_texts)[text] == 1  # a lone shingle fills all registers
    kept.reshape(n_texts, m)[text[single]] = h[single][:, None]
    h, text, weight = h[~single], text[~single], weight[~single]
    arrival, base, draw = np.zeros(len(h)), text * m, 0
    while len(h):
        draw += 1
        r = mix(h ^ mix(np.full(1, draw, np.uint64)))
        arrival = arrival - np.log(((r >> _U(12)).astype(np.float64) + 0.5) / float(1 << 52)) / weight
        at = base + (mix(r) % _U(m)).astype(np.int64)
        better = arrival < time[at]
        a, t, x = at[better], arrival[better], h[better]
        order = np.argsort(-t, kind="stable")  # of several in one register the earliest is written last
        time[a[order]], kept[a[order]] = t[order], x[order]
        # a shingle goes on while it can still come before the latest register of its text
        open_ = np.unique(text)
        bar = np.full(n_texts, np.inf)
        bar[open_] = time.reshape(n_texts, m)[open_].max(axis=1)
        live = arrival < bar[text]
        h, text, weight, arrival, base = h[live], text[live], weight[live], arrival[live], base[live]
    return kept.reshape(n_texts, m)


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in chunks(b, "text", _CHUNK):
                h, text, weight, k1, k2 = weighted(data, off, k)
                n = np.bincount(text, minlength=part.num_rows)
                reg = prob_minhash(h, text, weight.astype(float), part.num_rows, bands * rows).reshape(part.num_rows, bands, rows)
                band = np.tile(np.arange(bands, dtype=np.uint64), (part.num_rows, 1))
                for j in range(rows):
                    band = mix(band + reg[:, :, j])
                at = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(band[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n), lists], names=["id", "th", "k1", "k2", "n", "bands"])

    return run


def _content(k: int):
    """Rows ``(k1, k2, h, w)``: the shingles of a text, ascending, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in chunks(b, "text", _CHUNK):
                h, text, weight, k1, k2 = weighted(data, off, k)
                at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(weight.astype(np.int32)))], names=["k1", "k2", "h", "w"])

    return run


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard: sum over shared d of 1 / sum_e max(a_e / a_d, b_e / b_d).

    With equal weights it is the Jaccard similarity of the sets. By order of a_e / b_e every inner sum is a
    suffix sum of a plus a prefix sum of b.
    """
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    a, b = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    if (a == a[0]).all() and (b == b[0]).all():
        return float(len(a) / (max(a.sum() / a[0], b.sum() / b[0]) + only_a / a[0] + only_b / b[0]))
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    sum_a = np.append(np.cumsum(a[::-1])[::-1], 0.0)
    sum_b = np.append(0.0, np.cumsum(b))
    above = np.searchsorted(ratio, ratio, side="right")
    return float((1 / ((sum_a[above] + only_a) / a + (sum_b[above] + only_b) / b)).sum())


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {}
            for c in ("ha", "wa", "hb", "wb"):
                x = b.column(c)
                cols[c] = (x.offsets.to_numpy(), x.values.to_numpy())
            get = lambda c, i: cols[c][1][cols[c][0][i] : cols[c][0][i + 1]]
            sims = np.array([similarity(get("ha", i), get("wa", i), get("hb", i), get("wb", i)) for i in range(b.num_rows)])
            ok = pa.array(sims >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(sims).filter(ok)], names=["a", "b", "similarity"])

    return run


def _bounds(hs: list[np.ndarray], ws: list[np.ndarray]) -> np.ndarray:
    """What share of the row's text's weight lies on shingles that the column's text has too (n x n)."""
    n = len(hs)
    text = np.repeat(np.arange(n), [len(x) for x in hs])
    share = np.concatenate([w / w.sum() for w in ws]).astype(np.float32)
    _, col, held = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    # shingles of many texts as dense columns
    many = np.cumsum(held > 32) - 1
    dense = np.flatnonzero(held[col] > 32)
    at = many[col[dense]]
    dense = dense[np.argsort(at, kind="stable")]
    at = np.sort(at)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, 1024):
        part = slice(*np.searchsorted(at, (c, c + 1024)))
        x = np.zeros((n, 1024), np.float32)
        x[text[dense[part]], at[part] - c] = share[dense[part]]
        common += x @ (x > 0).astype(np.float32).T
    # shingles of few texts pair by pair
    few = np.flatnonzero((held[col] > 1) & (held[col] <= 32))
    few = few[np.argsort(col[few], kind="stable")]
    for step in range(1, 32):
        i, j = few[:-step], few[step:]
        same = col[i] == col[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        np.add.at(common, (text[i], text[j]), share[i])
        np.add.at(common, (text[j], text[i]), share[j])
    return common


def _across(least: float):
    """Links that connect the components of the texts ``(node, comp, h, w)`` of one group, as far as they can be.

    With P and Q the shares of two texts' weight on what they have in common, 1 / (1 / P + 1 / Q - 1) is at least
    their similarity, and equal to it where all weights are one. Pairs that reach it are compared exactly, the
    closest first; a pair whose components other links have connected by then adds nothing and is left out.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        comp, node = group.column("comp").to_numpy(), group.column("node").to_numpy()
        hs, ws = ([x.values.to_numpy() for x in group.column(c)] for c in ("h", "w"))
        common, found = _bounds(hs, ws), []
        names, part = np.unique(comp, return_inverse=True)
        above = list(range(len(names)))

        def root(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        xs, ys, bs = [], [], []
        for at in range(0, len(node), 256):
            with np.errstate(divide="ignore"):
                bound = 1 / (1 / common[at : at + 256] + 1 / common[:, at : at + 256].T - 1)
            x, y = np.nonzero((bound >= least - 1e-3) & (part[at : at + 256, None] < part[None, :]))
            xs.append(x + at)
            ys.append(y)
            bs.append(bound[x, y])
        x, y, bound = np.concatenate(xs), np.concatenate(ys), np.concatenate(bs)
        order = np.argsort(-bound, kind="stable")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = root(part[i]), root(part[j])
            if p != q and (same := similarity(hs[i], ws[i], hs[j], ws[j])) >= least:
                above[p] = q
                found.append((node[i], node[j], same, comp[i], comp[j]))
        cols = list(zip(*found, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "similarity", "ca", "cb"])

    return run


def _blocks(member: DataFrame, limit: int, floor: int = 256) -> DataFrame:
    """``(unit, node, comp)``: each unit holds two blocks of a band, and every two texts of a band that are in
    different components meet in one.

    ``member``: rows ``(band, node, comp, n)``. A block has about ``limit`` shingles (a text counts for at
    least ``floor``). Components of more are cut into blocks of their own, not compared with one another.
    """
    weight = F.sum(F.greatest("n", F.lit(floor)))
    parts = member.groupBy("band", "comp").agg(weight.alias("t")).withColumn("own", F.when(F.col("t") > limit, F.col("comp")))
    cuts = parts.groupBy("band", "own").agg(F.ceil(F.sum("t") / limit).alias("cuts"))
    blocks = cuts.select("band", "own", F.explode(F.sequence(F.lit(0), F.col("cuts").cast("int") - 1)).alias("i"))
    a, b = blocks.select("band", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "i").alias("x")), blocks.select("band", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), "i").alias("y"))
    units = a.hint("merge").join(b.hint("merge"), "band").where("x <= y and (x.own <> y.own or x.own = -1)")
    units = units.withColumn("unit", F.struct("band", "x", "y"))
    sides = units.select("band", F.col("x").alias("block"), "unit").union(units.where("x <> y").select("band", F.col("y").alias("block"), "unit"))
    placed = member.hint("merge").join(parts.select("band", "comp", "own").hint("merge"), ["band", "comp"])
    placed = placed.withColumn("of", F.coalesce("own", F.lit(-1))).hint("merge").join(cuts.select("band", F.coalesce("own", F.lit(-1)).alias("of"), "cuts").hint("merge"), ["band", "of"])
    placed = placed.select("band", F.struct(F.col("of").alias("own"), F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("i")).alias("block"), "node", "comp")
    return placed.hint("merge").join(sides.hint("merge"), ["band", "block"]).select("unit", "node", "comp")


def near_duplicates(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5, small_band: int = 8, block: int = 1 << 18) -> DataFrame:
    """``(row_id, text_hash, class_id, links, class_size, first)``, one row per row of ``df``.

    Texts with equal word sequences, and chains of texts at least ``least`` similar, are one class; its id is
    the smallest row id in it. ``links``: verified links of the text to different texts found on the way
    (each class is connected by them). ``text_hash`` tells rows with equal ids apart, ``first`` marks the class's
    representative. A text of fewer than
    ``shingle`` words is one shingle; a null, empty or wordless text is like no other and a class of its own.
    Rows with a null id are rows like others; very long texts are one row of memory at a time; equal rows are
    one class; an empty table gives an empty one; other columns of ``df`` are not looked at.
    With 24 bands of 5 registers a pair at similarity 0.8 shares a band with probability 0.99993.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "minhash")
    docs = df.select(F.col(row_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    made = f"id {kind}, th long, k1 long, k2 long, n long, bands array<long>"
    sketch = scratch.put(docs.mapInArrow(_sketch(shingle, bands, rows), made).withColumn("row", F.monotonically_increasing_id()))

    # one node per distinct word sequence, named by a row that has it
    one = F.min(F.struct("row", "id", "th", "bands")).alias("r")
    nodes = sketch.where("n > 0").groupBy("k1", "k2").agg(one)
    nodes = scratch.put(nodes.select("k1", "k2", F.col("r.row").alias("node"), "r.id", "r.th", "r.bands"))
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = scratch.put(spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), narrow=True)
    member = scratch.put(spread.hint("merge").join(shared.hint("merge"), "band").select("band", "node", "size"), narrow=True)
    few, many = member.where(F.col("size") <= small_band), member.where(F.col("size") > small_band)

    # small bands pair by pair; of a large one all texts with the most central: the one whose bands hold the most
    # texts, as the original of a group of edited copies does
    listed = few.groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("l"))
    pair = F.explode(F.expr("flatten(transform(l, (a, i) -> transform(slice(l, i + 2, size(l)), b -> struct(a as a, b as b))))"))
    pairs = listed.select(pair.alias("p")).select("p.a", "p.b")
    central = scratch.put(many.groupBy("node").agg(F.sum("size").alias("score")), narrow=True)
    large = scratch.put(many.hint("merge").join(central.hint("merge"), "node").select("band", "node", "score"), narrow=True)
    best = large.groupBy("band").agg(F.max(F.struct("score", -F.col("node"))).alias("b"))
    lead = scratch.put(best.select("band", (-F.col("b.col2")).alias("lead")), narrow=True)
    star = large.hint("merge").join(lead.hint("merge"), "band").where("node <> lead")
    pairs = pairs.union(star.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))
    pairs = scratch.put(pairs.distinct(), narrow=True)

    # shingles of the texts that share a band with any other
    asked = member.select("node").distinct().hint("merge").join(nodes.select("node", "id", "th", "k1", "k2").hint("merge"), "node")
    asked = scratch.put(asked, narrow=True)
    rows_of = asked.select(F.col("id").alias("i"), F.col("th").alias("t")).hint("merge")
    near = docs.hint("merge").join(rows_of, docs["id"].eqNullSafe(F.col("i")) & (docs["th"] == F.col("t")), "left_semi")
    content = near.select("text").mapInArrow(_content(shingle), "k1 long, k2 long, h array<long>, w array<int>").dropDuplicates(["k1", "k2"])
    content = scratch.put(content.hint("merge").join(asked.select("node", "k1", "k2").hint("merge"), ["k1", "k2"]).select("node", "h", "w"))

    own = content.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    other = content.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    both = pairs.hint("merge").join(own.hint("merge"), "a").hint("merge").join(other.hint("merge"), "b")
    links = scratch.put(both.mapInArrow(_verify(least), "a long, b long, similarity double"), narrow=True)
    parts = scratch.put(connected_components(links), narrow=True)
    scratch.collect_garbage()

    # large bands that still hold several classes: all their texts of different classes against one another
    whole = large.hint("merge").join(parts.hint("merge"), "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"))
    whole = scratch.put(whole, narrow=True)
    open_ = whole.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    open_ = scratch.put(open_, narrow=True)
    if not open_.isEmpty():
        lengths = scratch.put(content.select("node", F.size("h").alias("n")), narrow=True)
        left = whole.hint("merge").join(open_.hint("merge"), "band").hint("merge").join(lengths.hint("merge"), "node")
        units = scratch.put(_blocks(scratch.put(left, narrow=True), block), narrow=True)
        filled = units.hint("merge").join(content.hint("merge"), "node").select("unit", "node", "comp", "h", "w")
        more = scratch.put(filled.groupBy("unit").applyInArrow(_across(least), "a long, b long, similarity double, ca long, cb long"), narrow=True)
        if not more.isEmpty():
            links = links.union(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")).dropDuplicates(["a", "b"])
            # components of components
            joined = scratch.put(connected_components(more, "ca", "cb").select(F.col("node").alias("was"), F.col("component").alias("now")), narrow=True)
            apart = parts.union(joined.select("was", "was")).distinct()
            merged = apart.hint("merge").join(joined.hint("merge"), apart["component"] == F.col("was"), "left")
            parts = scratch.put(merged.select("node", F.coalesce("now", "component").alias("component")), narrow=True)
    scratch.drop(content)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    known = nodes.select("k1", "k2", "node").hint("merge").join(parts.hint("merge"), "node", "left").hint("merge").join(scratch.put(degree, narrow=True).hint("merge"), "node", "left")
    known = scratch.put(known.select("k1", "k2", F.coalesce("component", "node").alias("part"), F.coalesce("links", F.lit(0)).alias("links")), narrow=True)
    rowed = sketch.select("id", "th", "k1", "k2", "n", "row").hint("merge").join(known.hint("merge"), ["k1", "k2"], "left")
    rowed = scratch.put(rowed.select("id", "th", "links", F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("row")).alias("part")), narrow=True)
    sizes = scratch.put(rowed.groupBy("part").agg(F.min(F.struct("id", "th")).alias("one"), F.count(F.lit(1)).alias("class_size")), narrow=True)
    scratch.drop(sketch, nodes, shared, member, large, pairs, asked)
    out = rowed.hint("merge").join(sizes.hint("merge"), "part")
    first = F.struct("id", "th").eqNullSafe(F.col("one"))
    return out.select(F.col("id").alias(row_id), F.col("th").alias("text_hash"), F.col("one.id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "class_size", first.alias("first"))


def deduplicate(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate class of ``df``, with all its columns: the smallest id's.

    Rows equal in id and text count as one row, of which one stays whatever its other columns say.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    found = scratch.put(near_duplicates(df, row_id=row_id, text=text, **options))
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    gone = scratch.put(found.where(~F.col("first")).select(F.col(row_id).alias("__id"), F.col("text_hash").alias("__th")).distinct())
    kept = df.join(gone, F.col(row_id).eqNullSafe(F.col("__id")) & (hashed == F.col("__th")), "left_anti")
    twice = found.where("first and class_size > 1").groupBy(row_id, "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept.dropDuplicates([row_id, text]) if not twice.isEmpty() else kept


def op2(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "class_size")
