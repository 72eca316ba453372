"""Spelling variants: the words of a corpus with their counts, how many words are one edit away
from each, and the more frequent form that a word is a variant of.

Two words are near if one inserted, deleted or replaced code point turns one into the other. One
edit leaves half of a word intact, so near words share their first half (neighbours in the sorted
dictionary) or their last half (neighbours in the dictionary of reversed words). A block of words
that share a half is scanned if it is small; a larger one is subdivided: the edit lies in a window
of the word, and the window is halved until the block is small or one place is left, where the
alphabet bounds it. Which blocks are large is counted level by level with a map-side combine and
told to the tasks in a bit table of fixed size; a bit that is set by chance subdivides a block that
could have been scanned, and no pair is lost. A pair belongs to the window that holds the first
place where the two words differ, so it is found once, and every pair is verified by code points.

Null and empty texts have no words. A null doc_id counts as an empty one. Rows with one doc_id, and
repeated rows, count each. A tie between forms goes to the smallest in code-point order. Empty
tables give no rows. Only doc_id and text are read, so extra columns of any name do no harm."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, keep, keep_counted
from .textvec import LOWER, Spans, blocks, equal_spans, exact_codes, mix, span_hash, text_bytes, wide_eights

#: Words in a block that is scanned as it is, bits of the table of large blocks, pairs verified at a time.
SCANNED, BITS, PAIRS = 96, 1 << 22, 1 << 20
#: Bytes of text whose words are counted at a time.
COUNTED = 4 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8; any continuation byte follows it

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def letter_runs(low: np.ndarray, off: np.ndarray) -> Spans:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF] in UTF-8, none across documents."""
    lead = low == LEAD
    inside = LETTER[low] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return Spans(np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1, off)


def crc32_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span after the bytes whose CRC-32 is state."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    open_, at = np.flatnonzero(end > start), 0
    while len(open_):
        c = out[open_]
        out[open_] = CRC[(c ^ data[start[open_] + at]) & np.uint32(255)] ^ (c >> np.uint32(8))
        at += 1
        open_ = open_[start[open_] + at < end[open_]]
    return out ^ np.uint32(0xFFFFFFFF)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of UTF-8 as strings."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    at = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data[at])]).cast(pa.string())


def _count(typo_every: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, size=COUNTED):
            data, off = text_bytes(batch.column("text"))
            low = LOWER[data]
            runs = letter_runs(low, off)
            code, first = exact_codes(low, runs.start, runs.end, span_hash(low, runs.start, runs.end))
            total = np.bincount(code, minlength=len(first))
            if typo_every:
                pair, at, n = np.unique(runs.doc * max(len(first), 1) + code, return_index=True, return_counts=True)
                ids = ["" if d is None else str(d) for d in batch.column("doc_id").to_pylist()]
                state = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], np.uint32)
                h = crc32_on(state[runs.doc[at]], low, runs.start[at], runs.end[at])
                hit = np.flatnonzero(h % np.uint32(typo_every) == 0)
                np.subtract.at(total, code[at[hit]], n[hit])
                typos: Counter[str] = Counter()
                for k in hit.tolist():
                    word = low[runs.start[at[k]] : runs.end[at[k]]].tobytes().decode()
                    place = int(h[k]) % len(word)
                    if len(word) > least:
                        typos[word[:place] + word[place + 1 :]] += int(n[k])
                yield pa.record_batch([pa.array(list(typos), pa.string()), pa.array(list(typos.values()), pa.int64())], ["word", "n"])
            leads = np.concatenate([[0], np.cumsum(low == LEAD)])
            start, end = runs.start[first], runs.end[first]
            counted = np.flatnonzero((total > 0) & (end - start - leads[end] + leads[start] >= least))
            yield pa.record_batch([_strings(low, start[counted], end[counted]), pa.array(total[counted].astype(np.int64))], ["word", "n"])

    return run


def word_counts(docs: DataFrame, typo_every: int | None = None, least: int = 5, often: int = 3) -> DataFrame:
    """(word, n): the lower-cased letter runs of at least `least` code points found at least `often`
    times. typo_every: where it divides the CRC-32 of `<doc_id>:<run>`, the run loses the code
    point at that number modulo its length, which plants misspellings at known places."""
    found = docs.select("doc_id", "text").mapInArrow(_count(typo_every, least), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _hash(letters: np.ndarray) -> np.ndarray:
    """A hash of every row of letters."""
    h = np.full(len(letters), letters.shape[1], np.uint64)
    for k in range(letters.shape[1]):
        h = (h + letters[:, k]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return mix(h)


def windows(letters: np.ndarray, shorter: int, large: list[np.ndarray], counting: bool) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(rows, lo, hi, key): the blocks of words of one length among words of `shorter` and one more
    code points. Words of a block agree outside the places lo to hi of the shorter ones. large has a
    bit table for each level whose large blocks are known; counting: the blocks of the next level,
    else those to scan."""
    todo = [(np.arange(len(letters)), 0, shorter, 0)]
    while todo:
        rows, lo, hi, level = todo.pop()
        middle = (lo + hi) // 2
        for a, b in ((lo, middle), (middle, hi)):
            kept = letters.shape[1] - (shorter - b)
            place = mix(np.array([shorter << 40 | a << 20 | b], np.uint64))
            key = mix(mix(_hash(letters[rows, :a]) + place) ^ _hash(letters[rows, kept:]))
            split = large[level][(key % np.uint64(BITS)).astype(np.int64)] & (b - a > 1) if level < len(large) else np.zeros(len(rows), bool)
            if split.any():
                todo.append((rows[split], a, b, level + 1))
            if (level == len(large)) if counting else not split.all():
                yield rows[~split], a, b, key[~split]


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letters): the batch's words by length; every code point is one byte of Latin-1."""
    data, off = text_bytes(batch.column(at))
    size = np.diff(off)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, data[off[rows][:, None] + np.arange(n)]


def _tables(known) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool) for x in known.value]


def _sized(known, least: int):
    """The keys of the blocks of the next level, counted inside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = _tables(known)
        for batch in batches:
            keys = [key for n, _, letters in _by_length(batch, 0) for m in (n - 1, n) if m >= least for *_, key in windows(letters, m, large, True)]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _members(known, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = _tables(known)
        for batch in batches:
            for n, at, letters in _by_length(batch, 0):
                for m in (n - 1, n):
                    for rows, lo, hi, key in windows(letters, m, large, False) if m >= least else ():
                        took = pa.array(at[rows])
                        where = [pa.array(np.full(len(rows), x, np.int32)) for x in (m, lo, hi)]
                        yield pa.record_batch([pa.array(key.view(np.int64)), *where, batch.column(0).take(took), batch.column(1).take(took)], ["key", "m", "lo", "hi", "w", "n"])

    return run


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the n bytes from a and from b agree before the first that differs."""
    out, wide, open_ = np.zeros(len(a), np.int64), wide_eights(data), np.flatnonzero(n > 0)
    while len(open_):
        x = wide[a[open_] + out[open_]] ^ wide[b[open_] + out[open_]]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        out[open_] += same
        open_ = open_[(same == 8) & (out[open_] < n[open_])]
    return np.minimum(out, n)


def near_pairs(group: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): the near pairs of words inside each group of equal numbers, which stand together. Of a
    group's pairs, a bounded number is compared at a time."""
    n = len(group)
    last = np.searchsorted(group, group, "right")
    left = last - np.arange(n) - 1
    ends = np.cumsum(left)
    size = np.diff(off)
    first = 0
    while first < n:
        past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        k = left[first:past]
        i = np.repeat(np.arange(first, past), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        first = past
        alike = (m[i] == m[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j]) & (np.minimum(size[i], size[j]) == m[i])
        i, j = i[alike], j[alike]
        i, j = np.where(size[i] > size[j], j, i), np.where(size[i] > size[j], i, j)
        short, longer = m[i].astype(np.int64), size[j] - size[i]
        same = common_prefix(data, off[i], off[j], short)
        here = (lo[i] <= same) & ((same < hi[i]) | ((same == short) & (hi[i] == short))) & ((longer == 1) | (same < short))
        i, j, same, short, longer = i[here], j[here], same[here], short[here], longer[here]
        skip = 1 - longer
        rest = equal_spans(data, off[i] + same + skip, off[j] + same + 1, short - same - skip)
        yield i[rest], j[rest]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of blocks that stand together in a partition, both ways."""
    rest: pa.Table | None = None

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        data, off = text_bytes(batch.column(4))
        key, m, lo, hi = (batch.column(k).to_numpy() for k in range(4))
        for i, j in near_pairs(np.cumsum(np.diff(key, prepend=key[:1]) != 0), m, lo, hi, data, off):
            a, b = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
            if len(a):
                yield pa.record_batch([batch.column(4).take(a), batch.column(4).take(b), batch.column(5).take(b)], ["w", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch], rest.schema)])
        key = table.column(0).to_numpy()
        cut = int(np.flatnonzero(key == key[-1])[0])  # the last block may go on
        if cut:
            yield from links(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield from links(rest)


def _large(sizes: DataFrame) -> bytes | None:
    """The bit table of the blocks to subdivide; None if there are none. At most BITS / 32 numbers reach the driver."""
    full = sizes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > SCANNED)
    bits = full.select(F.expr(f"pmod(key, {BITS})").alias("bit"))  # BITS divides 2**64, so signs do no harm
    rows = bits.groupBy(F.expr("bit div 32").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits")).collect()
    if not rows:
        return None
    table = np.zeros(BITS, bool)
    for slot, bits in rows:
        table[32 * slot : 32 * slot + 32] = [bits >> k & 1 for k in range(32)]
    return zlib.compress(np.packbits(table).tobytes())


def near_words(words: DataFrame, least: int = 5) -> DataFrame:
    """words(word, n), of letters up to U+00FF -> (word, n_near, form, form_n): the number of near
    words and the most frequent of them, for words that have one."""
    spark = words.sparkSession
    latin = words.select(F.encode("word", "ISO-8859-1").alias("w"), "n")
    known: list[bytes] = []
    while True:
        told = spark.sparkContext.broadcast(known)
        table = _large(latin.mapInArrow(_sized(told, least), "key bigint, n bigint"))
        if table is None:
            break
        known = [*known, table]
    members = latin.mapInArrow(_members(told, least), "key bigint, m int, lo int, hi int, w binary, n bigint")
    links = members.repartition("key").sortWithinPartitions("key").mapInArrow(_scan, "w binary, near binary, near_n bigint")
    near = links.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return near.select(text("w").alias("word"), "n_near", text("best.near").alias("form"), (-F.col("best.n")).alias("form_n"))


def followed(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root): the last word that is reached by following forms, which
    must not lead in a circle. Pointers are doubled, so rounds grow with the logarithm of a chain."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = now.join(up, "root", "left")
        after, n = keep_counted(went.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", "moved")
        discard(now)
        now = after.drop("moved")
        if not n:
            return now


def variants(docs: DataFrame, typo_every: int | None = None, least: int = 5, often: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its form, the most frequent near word if
    that is at least `times` as frequent, and the root that following forms leads to."""
    words = keep(word_counts(docs, typo_every, least, often), "words")
    near = words.join(near_words(words, least), "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    found = keep(near.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")), "variants")
    discard(words)
    roots = followed(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo_every=97)


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) AS BIGINT) - 64] END))),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS short, left(word, i - 1) || '?' || substr(word, i + 1) AS hole FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.short = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS at FROM pairs),
forms AS (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.at = 1),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
