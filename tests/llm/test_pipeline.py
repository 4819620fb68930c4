"""The pipeline's stages, each against what it has to do to its own input."""

from collections import Counter

import corpus_pipeline
from tidewire.llm.decontamination import words
from tidewire.storage import Scratch, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    scratch = Scratch(spark, "test")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.put(stage(spark, docs, sf))
        seen[name] = (docs.toPandas(), out.toPandas())
        assert out.columns[: len(columns)] == columns
        docs = out

    before, after = seen["language_id"]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) >= 0.98 * len(before)

    before, after = seen["near_dedup"]
    assert after["text"].is_unique and set(before["text"].str.split().str.join(" ")) >= set(after["text"].str.split().str.join(" "))
    assert len(after) < len(before)

    before, after = seen["decontamination"]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        ws = words(r["text"])
        k = min(10, len(ws))
        windows |= {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if k else set()
    sizes = {len(w) for w in windows}

    def hit(t):
        ws = words(t)
        return any(tuple(ws[i : i + k]) in windows for k in sizes for i in range(len(ws) - k + 1))

    clean = {i: t for i, t in zip(before["doc_id"], before["text"], strict=True) if not hit(t)}
    got = dict(zip(after["doc_id"], after["text"], strict=True))
    assert all(got[i] == t for i, t in clean.items())
    assert any(got.get(i) != t for i, t in zip(before["doc_id"], before["text"], strict=True))
    assert (after["n_chars"] == after["text"].str.len()).all()

    before, after = seen["mixing"]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and max(Counter(after["doc_id"]).values()) <= 3

    before, after = seen["sharding"]
    assert len(before) == len(after) and sorted(before["doc_id"]) == sorted(after["doc_id"])
    sizes = after.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in after.groupby("shard"))


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
