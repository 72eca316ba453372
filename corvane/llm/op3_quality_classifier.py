"""Quality classifier: histogram gradient-boosted trees over document statistics, kept as flat
arrays of complete binary trees for vectorised traversal.

The trees are fitted on labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most about
`max_rows` of them, chosen by a hash of doc_id; every row is scored. Statistics come from the
whole text only: labels, lang, source and doc_id are never inputs of a score.

Null or empty text: all statistics 0, scored like any other. Null quality: not a label. Several
labels of a doc_id: the smallest counts. Without labels, or with one class only, every score is
the smoothed share of label 1 (0.5 without any). Null doc_id: held_out false."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .op10_quality_rules import base_counts

MAX_ROWS = 40_000
DEPTH, ROUNDS, RATE, BINS, PENALTY, LEAST = 4, 80, 0.15, 64, 2.0, 8.0

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "mark": b"!?.,;:'\"",
    "symbol": b"#*$%&|<>{}[]=+/\\_~^@",
    "blank": [0x20, *range(0x09, 0x0E)],
    "wide": range(0x80, 0x100),
    "shout": b"!",
    "stop": b".",
    "comma": b",",
    "rule": b"|",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
FEATURES = [*_CLASSES, "bytes", "words", "word_chars", "word_spread", "word_longest", "distinct_words", "distinct_pairs", "top_word", "line_bytes", "lines", "dup_lines", "repeats", "symbols", "upper_words", "mark_words"]


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest, per document."""
    order = np.argsort(tv.mix(h + doc.astype(np.uint64) * tv.MULT))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n), most


def statistics(text: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, off = tv.text_bytes(text)
    n = len(off) - 1
    spans = tv.words(data, off)
    h = tv.span_hash(data, spans.start, spans.end)
    size = np.diff(off).astype(float)
    base = base_counts(data, off, spans, h)
    words, length = spans.count.astype(float), (spans.end - spans.start).astype(float)
    per = np.maximum(words, 1)
    out = [tv.per_doc(table[data], off) / np.maximum(size, 1) for table in _TABLES.values()]
    mean = np.bincount(spans.doc, length, n) / per
    longest = np.zeros(n)
    np.maximum.at(longest, spans.doc, length)
    distinct, most = _distinct(h, spans.doc, n)
    pair = tv.run_hash(h, 2)
    inside = spans.doc[: len(pair)] == spans.doc[1 : 1 + len(pair)]
    pairs, _ = _distinct(pair[inside], spans.doc[: len(pair)][inside], n)
    feeds = tv.per_doc(data == 10, off) + 1.0
    last = data[spans.end - 1]
    upper = np.concatenate([[0], np.cumsum(_TABLES["upper"][data])])
    lower = np.concatenate([[0], np.cumsum(_TABLES["lower"][data])])
    shouted = (upper[spans.end] - upper[spans.start] > 1) & (lower[spans.end] == lower[spans.start])
    out += [
        np.log1p(size), np.log1p(words), base["word_chars"] / per,
        np.sqrt(np.maximum(np.bincount(spans.doc, length**2, n) / per - mean**2, 0)), longest,
        distinct / per, pairs / np.maximum(words - 1, 1), most / per, size / feeds, np.log(feeds),
        base["n_dup_lines"] / feeds, base["n_repeat_words"] / per, base["n_symbols"] / per,
        np.bincount(spans.doc, shouted, n) / per, np.bincount(spans.doc, (_TABLES["mark"] | _TABLES["symbol"])[last], n) / per,
    ]
    return np.stack(out, axis=1).astype(np.float32)


@dataclass
class Trees:
    """feature, threshold and value of node k of tree t at [t, k]; its children at 2k+1, 2k+2.
    A row goes right where its feature is greater than the threshold."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over quantile bins."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    nodes, leaves = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    feature, threshold, value = (np.zeros((ROUNDS, k), t) for k, t in ((nodes, np.int64), (nodes, np.float32), (leaves, float)))
    threshold[:] = np.inf
    if len(np.unique(y)) < 2:
        return Trees(prior, feature[:0], threshold[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), prior)
    for t in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            shape = (width, x.shape[1], BINS)
            gs = np.bincount(cell, np.repeat(g, x.shape[1]), width * x.shape[1] * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, x.shape[1]), width * x.shape[1] * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + PENALTY) + (all_g - gs) ** 2 / (all_h - hs + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(hs < LEAST / 4) | (all_h - hs < LEAST / 4)] = 0
            for k in range(width):
                f, b = divmod(int(gain[k].argmax()), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        total_g, total_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = RATE * total_g / (total_h + PENALTY)
        raw += value[t, node]
    return Trees(prior, feature, threshold, value)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.blocks(batches):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(fold() != 1).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = int(min(1.0, max_rows / max(1, usable.count())) * (1 << 62))
    # at most about max_rows rows of 12 bytes, so this broadcast is bounded
    sample = F.broadcast(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < F.lit(share)))
    table = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "quality").mapInArrow(_featurise, "quality int, x array<float>").toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = table["quality"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees however the rows arrive
    return fit(x[order], y[order])


def classify(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.blocks(batches):
            s = shared.value.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, train(docs, labels))
