"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every text. Expectation-maximisation over the
counts of vote patterns (at most 3**8, whatever the corpus size) estimates the class prior, how often each labeller
says what in each class, and the rate of false alarms that all labellers share; the posterior of a pattern is a
soft label. Soft labels of a bounded sample train a linear scorer over hashed byte n-grams: log odds per bucket as
a start, then logistic regression on the soft labels in every part of the sample, the parts' weights averaged.
The scorer scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import chunks
from tidewire.storage import Scratch, table

BUCKETS = 1 << 15
#: Bytes of text that a worker looks at together, a step of the training too.
_CHUNK = 300_000
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("capitals", "exclamations", "symbols", "digits", "word_length", "length", "sentences", "repeats")


def _classes() -> np.ndarray:
    """For every byte: upper case, lower case, exclamation, markup symbol, digit, sentence end, word space."""
    out = np.zeros((7, 256), np.float32)
    out[0, 65:91] = out[1, 97:123] = 1
    out[2, ord("!")] = 1
    out[3, [ord(c) for c in "|#{}<>=*~^_\\$%&@+"]] = 1
    out[4, 48:58] = 1
    out[5, [ord(c) for c in ".?"]] = 1
    out[6, [32, 9, 10, 11, 12, 13]] = 1
    return out


_CLASS = _classes()


def _votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Votes of all labellers on all texts of a chunk; an empty text is bad to each."""
    n = np.diff(off)
    text = np.repeat(np.arange(len(n)), n)
    upper, lower, bang, symbol, digit, stop, space = (np.bincount(text, weights=c[data], minlength=len(n)) for c in _CLASS)
    size = np.maximum(n, 1)
    words = space + 1
    letters = np.maximum(upper + lower, 1)
    lines = [set(), 0]
    repeated = np.zeros(len(n))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = [x for x in data[a:b].tobytes().split(b"\n") if x]
        repeated[i] = 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0

    def vote(bad, good):
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    out = np.stack(
        [
            vote(upper / letters > 0.5, False),
            vote(bang / words > 0.2, False),
            vote(symbol / size > 0.02, symbol / size < 0.004),
            vote(digit / size > 0.1, False),
            vote((size / words > 14) | (size / words < 2.5), (size / words > 4) & (size / words < 10)),
            vote(words < 5, False),
            vote((stop / words < 0.02) | (stop / words > 0.5), (stop / words > 0.04) & (stop / words < 0.3)),
            vote(repeated > 0.5, False),
        ],
        axis=1,
    )
    out[n == 0] = BAD
    return out


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for b in batches:
        for _, data, off in chunks(b, "text", _CHUNK):
            total += np.bincount(_pattern(_votes(data, off)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, strength: float = 1000.0) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: (P(good), P(vote | class) as labeller x class x vote, P(good | pattern)).

    It starts from the share of good votes, a bad one counting twice; an abstention is a third vote, as some
    labellers only ever call a text bad. Everything is estimated from the counts. A labeller's rate of bad votes on
    good texts is drawn to the mean rate of all labellers, by a prior of ``strength`` times the data: with rates of
    their own, EM spends its two classes on telling one kind of bad text from all others. Without rows the prior
    is one half and the rates are even.
    """
    k = len(LABELLERS)
    if not counts.sum():
        return 0.5, np.full((k, 2, 3), 1 / 3), np.full(len(patterns), 0.5)
    votes = (patterns[:, None] // 3 ** np.arange(k)) % 3
    post = (1 + (votes == GOOD).sum(axis=1)) / (2 + (votes == GOOD).sum(axis=1) + 2 * (votes == BAD).sum(axis=1))
    prior, table_ = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for v in (ABSTAIN, BAD, GOOD):
            table_[:, :, v] = np.stack([(weight[c][:, None] * (votes == v)).sum(axis=0) + 1.0 for c in (0, 1)], axis=1)
        table_ /= table_.sum(axis=2, keepdims=True)
        shared = table_[:, 1, BAD].mean()
        bad = (table_[:, 1, BAD] * weight[1].sum() + shared * strength * counts.sum()) / (weight[1].sum() + strength * counts.sum())
        table_[:, 1, [ABSTAIN, GOOD]] *= ((1 - bad) / (1 - table_[:, 1, BAD]))[:, None]
        table_[:, 1, BAD] = bad
        logs = [np.log(p) + sum(np.log(table_[j, c, votes[:, j]]) for j in range(k)) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, table_, post


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 4-grams of every text, and their texts."""
    if len(data) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    code = ((x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:-3]
    ok = np.arange(len(code)) + 4 <= off[text + 1]
    return code[ok].astype(np.int64), text[ok]


def _odds(shared):
    """The soft-labelled n-gram shares of both classes, for log odds per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        soft, total = shared.value, np.zeros((2, BUCKETS))
        for b in batches:
            for _, data, off in chunks(b, "text", _CHUNK):
                p = soft[_pattern(_votes(data, off))]
                code, text = _buckets(data, off)
                share = 1 / np.maximum(np.bincount(text, minlength=len(p)), 1)
                total[1] += np.bincount(code, weights=(p * share)[text], minlength=BUCKETS)
                total[0] += np.bincount(code, weights=((1 - p) * share)[text], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0].tobytes(), total[1].tobytes()], pa.binary())], names=["label", "sums"])

    return run


def descend(weights: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float) -> np.ndarray:
    """Logistic regression on soft labels from ``weights`` on, by AdaGrad over groups ``(bucket, text, label)``.

    A text's features are the shares of its n-grams; a bias is the last weight. The scale of the start is fitted
    first, as log odds of shares are far from a margin's size.
    """
    w = np.append(weights, 0.0)
    shares = [1 / np.maximum(np.bincount(text, minlength=len(y)), 1) for _, text, y in groups]
    margin = lambda g, s: np.bincount(g[1], weights=w[g[0]], minlength=len(g[2])) * s + w[-1]
    if groups:
        scale, w[-1] = _calibrate(np.concatenate([margin(g, s) for g, s in zip(groups, shares, strict=True)]), np.concatenate([g[2] for g in groups]))
        w[:-1] *= scale
    seen = np.full(len(w), 1e-8)
    for _ in range(epochs):
        for g, s in zip(groups, shares, strict=True):
            off = 1 / (1 + np.exp(-np.clip(margin(g, s), -30, 30))) - g[2]
            grad = np.append(np.bincount(g[0], weights=(off * s)[g[1]], minlength=len(w) - 1), off.sum()) / max(len(off), 1)
            seen += grad**2
            w -= rate * grad / np.sqrt(seen)
    return w


def _train(shared, epochs: int, rate: float):
    """The weights that one part of the sample leads to, and its number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, soft = shared.value
        groups = []
        for b in batches:
            for _, data, off in chunks(b, "text", _CHUNK):
                code, text = _buckets(data, off)
                groups.append((code.astype(np.uint16), text.astype(np.int32), soft[_pattern(_votes(data, off))]))
        n = sum(len(g[2]) for g in groups)
        w = descend(weights, groups, epochs, rate)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["n", "weights"])

    return run


def _apply(shared):
    """Rows ``(id, size, grams, score, weak)``: bytes, n-grams, the scorer's P(good) and the labellers' posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, soft = shared.value
        for b in batches:
            for part, data, off in chunks(b, "text", _CHUNK):
                code, text = _buckets(data, off)
                n = np.bincount(text, minlength=part.num_rows)
                margin = np.bincount(text, weights=weights[code], minlength=part.num_rows) / np.maximum(n, 1) + weights[-1]
                made = [pa.array(1 / (1 + np.exp(-np.clip(margin, -700, 700)))), pa.array(soft[_pattern(_votes(data, off))])]
                counts = [pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *counts, *made], names=["id", "size", "grams", "score", "weak"])

    return run


def _calibrate(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and intercept by Newton's method on the soft-label logistic loss, slightly regularised."""
    spread = float(margin.std()) or 1.0
    x = np.stack([margin / spread, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) + 1e-3 * len(label) * w * [1, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + (1e-3 * len(label) + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def score_quality(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", threshold: float = 0.5, sample_rows: int = 20_000, parts: int = 8, epochs: int = 5, rate: float = 0.3) -> DataFrame:
    """``(row_id, score, weak_label, kept)``, one row per row of ``df``.

    ``score`` is the scorer's P(good), ``weak_label`` the labellers' posterior, ``kept`` is score >=
    ``threshold``. The labellers' accuracies come from all rows; the scorer is fitted on about ``sample_rows``
    rows (twice that at most), chosen by a hash of id and text, so reruns agree. A null or empty text is bad (score
    0); a text without a four-byte gram has its weak label as score. Rows with a null id are rows like others, equal
    rows get equal scores, and so does a text whose score is the threshold (kept); very long texts are read whole, one at
    a time; an empty table gives an empty one; other columns, whatever their names, are not looked at.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "quality")
    docs = df.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    seen = docs.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
    order = np.argsort(patterns)
    _, _, post = fit_labellers(patterns[order], counts[order])
    soft = np.full(3 ** len(LABELLERS), 0.5)
    soft[patterns[order]] = post

    share = min(1.0, sample_rows / max(1, int(counts.sum())))
    key = F.xxhash64(F.lit(11), "id", "text")
    picked = docs.where((F.pmod(key, F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.length("text") > 0)).limit(2 * sample_rows)
    sample = scratch.put(picked.select("text", key.alias("key")).repartition(parts, "key"))
    sums = sample.select("text").mapInArrow(_odds(spark.sparkContext.broadcast(soft)), "label int, sums binary").collect()
    total = np.stack([sum((np.frombuffer(r["sums"]) for r in sums if r["label"] == c), np.zeros(BUCKETS)) for c in (0, 1)])
    total += 0.01 * total.sum() / total.size + 1e-9
    start = np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())
    tuned = sample.select("text").repartition(parts).mapInArrow(_train(spark.sparkContext.broadcast((start, soft)), epochs, rate), "n long, weights binary").where("n > 0").collect()
    tuned.sort(key=lambda r: (r["n"], r["weights"]))
    weights = sum(r["n"] * np.frombuffer(r["weights"]) for r in tuned) / sum(r["n"] for r in tuned) if tuned else np.append(start, 0.0)

    shared = spark.sparkContext.broadcast((weights, soft))
    kinds = f"id {docs.schema['id'].dataType.simpleString()}, size long, grams long, score double, weak double"
    scored = scratch.put(docs.mapInArrow(_apply(shared), kinds))
    score = F.when(F.col("size") == 0, 0.0).when(F.col("grams") > 0, F.col("score")).otherwise(F.col("weak"))
    return scored.select(F.col("id").alias(row_id), score.alias("score"), F.col("weak").alias("weak_label"), (score >= threshold).alias("kept"))


def op1(spark, sf_dir):
    """Quality of every document."""
    return score_quality(table(spark, sf_dir, "documents"))
