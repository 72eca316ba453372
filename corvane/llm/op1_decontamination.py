"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased in A-Z. A document and a benchmark item that
share a run of SEED words are a candidate pair. Their tiling marks, again and again, the longest
matches of words not marked yet (found by Karp-Rabin hashes of all runs of TILE words and joined
along diagonals; of equal length the first in the document, then in the item) until none is left.
Coverage is the marked share of the item's words; at `threshold` and above the document is
contaminated, in whatever order the passages stand.

The benchmark is read in blocks of at most about `block_chars` characters, one broadcast of that
bound each, and every block meets all documents, so its size is not limited. Null or empty texts
share no words with anything. An item with fewer than SEED words is a candidate where all of
them stand in sequence. Null doc_id: reported as null. Repeated rows: a result each. Empty
tables: no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

SEED, TILE, THRESHOLD, BLOCK_CHARS = 5, 5, 0.6, 20_000_000
SCHEMA = "doc_id long, item_id long, n_item_words long, n_tiled long, n_tiles long, longest_tile long, coverage double"


def word_hashes(text: pa.Array) -> tuple[np.ndarray, tv.Spans]:
    data, off = tv.text_bytes(text)
    data = tv.LOWER[data]
    spans = tv.words(data, off, tv.NOT_ALNUM)
    return tv.span_hash(data, spans.start, spans.end), spans


@dataclass
class Items:
    """A block of the benchmark: word hashes, and the sorted seeds with their items."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: (filter, hash, item)

    @staticmethod
    def of(table: pa.Table) -> Items:
        h, spans = word_hashes(table.column("text").combine_chunks())
        words = [h[spans.first[i] : spans.first[i + 1]] for i in range(table.num_rows)]
        seeds = {}
        for n in range(1, SEED + 1):
            run = tv.run_hash(h, n)
            whole = (spans.doc[: len(run)] == spans.doc[n - 1 : n - 1 + len(run)]) & ((spans.count[spans.doc[: len(run)]] == n) | (n == SEED))
            found, item = run[whole], spans.doc[: len(run)][whole]
            if len(found):
                order = np.lexsort((item, found))
                may = np.zeros(1 << 20, bool)
                may[found >> np.uint64(44)] = True
                seeds[n] = may, found[order], item[order]
        return Items(table.column("item_id").to_pylist(), words, seeds)

    def candidates(self, h: np.ndarray, spans: tv.Spans) -> list[tuple[int, int]]:
        """(document, item) pairs that share a seed."""
        pairs: set[tuple[int, int]] = set()
        for n, (may, seed, item) in self.seeds.items():
            run = tv.run_hash(h, n)
            at = np.flatnonzero(may[run >> np.uint64(44)])
            at = at[spans.doc[at] == spans.doc[at + n - 1]]
            lo, hi = np.searchsorted(seed, run[at], "left"), np.searchsorted(seed, run[at], "right")
            for doc, a, b in np.unique(np.stack([spans.doc[at], lo, hi], axis=1)[hi > lo], axis=0).tolist():
                pairs.update((doc, int(i)) for i in item[a:b])
        return sorted(pairs)


class _Runs:
    """Karp-Rabin hashes of all runs of n words without a marked one, for any n."""

    _BASE = 0x9FB21C651E98DF25

    def __init__(self, words: np.ndarray, longest: int):
        self.words, self.free = words, np.ones(len(words), bool)
        self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(longest, self._BASE, np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(words * self.power[: len(words)]))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash), by start; powers make up for where a run starts."""
        if len(self.words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marked = np.append(0, np.cumsum(~self.free))
        at = np.flatnonzero(marked[n:] == marked[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.power[len(self.power) - 1 - at]


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiling of two sequences of word hashes.

    The greatest length at which a run of the item is one of the document is found by halving, as
    every longer match holds shorter ones; then all matches of that length are marked, the first
    in the document first, of these the first in the item. Hashes that agree are compared word by
    word. Memory stays within a few numbers a word, however often words repeat."""
    least = min(least, len(item))
    out: list[tuple[int, int, int]] = []
    if not least:
        return out
    longest = max(len(item), len(doc))
    a, b = _Runs(item, longest), _Runs(doc, longest)

    def matches(n: int) -> list[tuple[int, int]]:
        """(start in doc, start in item) of matches of n free words, marked as they are found."""
        (i, hi), (j, hj) = a.of(n), b.of(n)
        order = np.argsort(hi, kind="stable")
        hi, i = hi[order], i[order]
        where = np.searchsorted(hi, hj)
        has = np.flatnonzero(hi[np.minimum(where, max(len(hi) - 1, 0))] == hj) if len(hi) else np.zeros(0, np.int64)
        found, next_at = [], {}
        for x, at in zip(j[has].tolist(), where[has].tolist()):
            if not (b.free[x] and b.free[x + n - 1]):
                continue
            k = next_at.get(at, at)
            while k < len(hi) and hi[k] == hi[at] and not (a.free[i[k]] and a.free[i[k] + n - 1]):
                k += 1
            next_at[at] = k  # starts that are taken stay taken
            while k < len(hi) and hi[k] == hi[at]:
                y = int(i[k])
                if a.free[y : y + n].all() and np.array_equal(item[y : y + n], doc[x : x + n]):
                    found.append((x, y))
                    a.free[y : y + n] = b.free[x : x + n] = False
                    break
                k += 1
        return found

    def shared(n: int) -> bool:
        return bool(np.isin(a.of(n)[1], b.of(n)[1]).any())

    most = min(len(item), len(doc))
    while most >= least and shared(least):
        low, high = least, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        found = matches(low)
        out += [(y, x, low) for x, y in found]
        # nothing of this length is left; without a true match its hash was a coincidence
        most = low if found else low - 1
    return out


def scan(items: Items, text: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, item, tiles) of every candidate pair of a block of texts."""
    h, spans = word_hashes(text)
    for doc, item in items.candidates(h, spans):
        yield doc, item, tiles(items.words[item], h[spans.first[doc] : spans.first[doc + 1]])


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator:
    """Broadcasts of Items, together the whole benchmark."""
    chars = benchmark.agg(F.coalesce(F.sum(F.char_length("text") + 8), F.lit(0))).first()[0]
    n = -(-chars // block_chars)
    for k in range(n):
        part = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Items.of(part.toArrow()))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """SCHEMA: a row for each document and benchmark item with coverage >= threshold."""
    out = None
    for block in benchmark_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in tv.blocks(batches):
                ids, rows = batch.column("doc_id").to_pylist(), []
                for doc, item, found in scan(block.value, batch.column("text")):
                    n, tiled = len(block.value.words[item]), sum(x[2] for x in found)
                    if found and tiled >= threshold * n:
                        rows.append((ids[doc], block.value.ids[item], n, tiled, len(found), max(x[2] for x in found), tiled / n))
                if rows:
                    types = [pa.int64()] * 6 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [x.split()[0] for x in SCHEMA.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all columns, that cover no benchmark item."""
    for block in benchmark_blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in tv.blocks(batches):
                clean = np.ones(batch.num_rows, bool)
                for doc, item, found in scan(block.value, batch.column("text")):
                    if found and sum(x[2] for x in found) >= threshold * len(block.value.words[item]):
                        clean[doc] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
