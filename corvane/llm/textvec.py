"""Vectorised text helpers for Arrow batches inside tasks: whole texts as one byte array with
offsets, word spans from a byte table, hashes of any span, and exact comparison of spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULT = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Not a word byte for words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about size bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Spans:
    """Spans of bytes: start, end, and first[d]..first[d+1] are those of document d."""

    def __init__(self, start: np.ndarray, end: np.ndarray, off: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> Spans:
    """Maximal runs of bytes outside the separator table, none across documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Spans(start, end, off)


def lines(data: np.ndarray, off: np.ndarray) -> Spans:
    """Lines between line feeds; a text of n line feeds has n + 1."""
    feed = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], feed + 1]), kind="stable")
    end = np.sort(np.concatenate([off[1:], feed]), kind="stable")
    out = Spans.__new__(Spans)
    out.start, out.end = start, end
    feeds = np.searchsorted(feed, off)
    out.count = np.diff(feeds) + 1
    out.first = np.concatenate([[0], np.cumsum(out.count)])
    out.doc = np.repeat(np.arange(len(off) - 1), out.count)
    return out


#: How many of eight bytes count, from the first, little-endian.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def wide_eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; lanes are independent. Eight bytes at a time go through a
    mixer that is not linear, spans of over 64 bytes through BLAKE2b, so that texts made of
    repeated or exchanged parts don't collide. Where equal bytes decide a result, equal_spans
    or exact_codes follows."""
    n = end - start
    h = mix(n.astype(np.uint64) + np.uint64((2 * lane + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    wide = wide_eights(data)
    open_, at = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(open_):
        left = n[open_] - at
        part = wide[start[open_] + at] & _MASK[np.minimum(left, 8)]
        h[open_] = mix((h[open_] ^ part) * MULT)
        open_, at = open_[left > 8], at + 8
    long = np.flatnonzero(n > _LONG)
    if len(long):
        raw, salt = memoryview(np.ascontiguousarray(data)), bytes([lane])
        digest = b"".join(hashlib.blake2b(raw[a:b], digest_size=8, salt=salt).digest() for a, b in zip(start[long].tolist(), end[long].tolist()))
        h[long] = np.frombuffer(digest, np.uint64)
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a and from b agree, for each."""
    out, wide, at = np.ones(len(a), bool), wide_eights(data), 0
    open_ = np.flatnonzero((n > 0) & (a != b))
    while len(open_) and at < 512:
        left = n[open_] - at
        differ = ((wide[a[open_] + at] ^ wide[b[open_] + at]) & _MASK[np.minimum(left, 8)]) != 0
        out[open_[differ]] = False
        open_, at = open_[~differ & (left > 8)], at + 8
    for k in open_.tolist():
        i, j, m = int(a[k]), int(b[k]), int(n[k])
        out[k] = np.array_equal(data[i + at : i + m], data[j + at : j + m])
    return out


def exact_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, first): spans of these bytes have one code exactly if their bytes are equal; first[code]
    is a span that has it. h: their hashes."""
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    n, like = end - start, first[code]
    odd = np.flatnonzero((n != n[like]) | ~equal_spans(data, start, start[like], np.minimum(n, n[like])))
    if len(odd):  # two texts share a hash
        known: dict[bytes, int] = {}
        more = []
        for k in odd.tolist():
            text = data[start[k] : end[k]].tobytes()
            if text not in known:
                known[text] = len(first) + len(more)
                more.append(k)
            code[k] = known[text]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return code, first


def window_hash(data: np.ndarray, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """span_hash of the spans of one length from each place, without BLAKE2b."""
    wide = wide_eights(data)
    h = np.full(len(at), np.uint64((2 * lane + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    for k in range(0, length, 8):
        part = wide[at + k] & _MASK[min(8, length - k)]
        h = mix((h ^ part) * MULT)
    return h


def shingle_codes(code: np.ndarray, spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, document) of every n-word run, equal exactly where all words are; a document with
    fewer words, but some, has its whole sequence as one."""
    last = spans.first[1:][spans.doc]
    at = np.flatnonzero((np.arange(len(code)) + n <= last) | ((spans.count[spans.doc] < n) & (np.arange(len(code)) == spans.first[spans.doc])))
    width = int(code.max()) + 2 if len(code) else 1
    number = code[at].astype(np.int64) + 1
    for j in range(1, n):
        there = at + j < last[at]
        word = np.where(there, code[np.minimum(at + j, max(len(code) - 1, 0))] + 1, 0)
        if j > 1:
            number = np.unique(number, return_inverse=True)[1]
        number = number * width + word
    return number, spans.doc[at]


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i], ..., h[i+n-1] for every i that has them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(out)]
    return mix(out + np.uint64(n))


def shingles(h: np.ndarray, spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every n-word run inside a document; a document with fewer words, but
    some, has its whole sequence as one."""
    run = run_hash(h, n)
    whole = spans.doc[: len(run)] == spans.doc[n - 1 : n - 1 + len(run)]
    hashes, doc = [run[whole]], [spans.doc[: len(run)][whole]]
    for m in range(1, n):
        short = np.flatnonzero(spans.count == m)
        if len(short):
            at = spans.first[short]
            out = np.zeros(len(short), np.uint64)
            for j in range(m):
                out = out * np.uint64(0x9FB21C651E98DF25) + h[at + j]
            hashes.append(mix(out + np.uint64(m)))
            doc.append(short)
    hashes, doc = np.concatenate(hashes), np.concatenate(doc)
    order = np.argsort(doc, kind="stable") if len(doc) and np.any(doc[1:] < doc[:-1]) else slice(None)
    return hashes[order], doc[order]


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over off[d]..off[d+1]."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[off[1:]] - sums[off[:-1]]
