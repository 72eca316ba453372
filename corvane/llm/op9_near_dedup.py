"""Near-duplicates by SuperMinHash, banding, verification on full sets and union-find.

A document's set is its distinct word shingles; documents of the same words (by a 128-bit BLAKE2b
of them, lower-cased) are one class, which only its smallest doc_id represents. SuperMinHash gives each shingle
a random rank order of the signature's slots, so that slots are filled without repetition; levels
run for all shingles of a block at once and a document stops once all its slots hold a smaller
level. Bands of ROWS slots make buckets, each with its smallest doc_id as pivot. A document is first
compared with the pivot that most of its buckets have; then, in buckets that still span several
components, with the bucket's pivot and with another one. What then still spans several is
compared in full, those outside the bucket's largest component with all, in cells of two blocks of
about CELL members each (fewer where sets are large), so that no bucket is one task's work and no
pair list is written. A pair with a pivot is first judged by its signatures: one that agrees in fewer
slots than five standard deviations below the threshold is none. Links count if threshold[1] * intersection >= threshold[0] * union, by the words themselves and not their hashes.

Banding and signatures each miss a link at the threshold with a probability under 1e-6. Keys of
over skew.HOT rows are dealt to more tasks the more rows they have: which they are stands in a table
of at most skew.SLOTS rows, which is broadcast. Null or empty text, or
without words: empty set, linked with nothing. Null doc_id: n_shingles, a null component_id,
kept. Repeated rows: the same result on each. Of rows with one doc_id and several texts the text with
the smallest digest stands for the doc_id, in any order of rows; all of them get its component.
Empty tables: no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import dealt, hot_slots
from ..session import discard, keep
from . import textvec as tv
from .graph import components

SLOTS, ROWS, CELL, CELL_SHINGLES = 64, 3, 256, 2_000_000
_LEVEL = np.uint32(25)


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, document) of the distinct shingles of a block, by document and hash; its documents."""
    data, off = tv.text_bytes(text)
    data = tv.LOWER[data]
    spans = tv.words(data, off)
    h, doc = tv.shingles(tv.span_hash(data, spans.start, spans.end), spans, n)
    bits = max(1, int(len(off) - 1).bit_length())
    order = np.argsort((doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new], len(off) - 1


def word_digests(text: pa.Array) -> np.ndarray:
    """Two 64-bit numbers a document: BLAKE2b of its words, A-Z lower-cased, joined by spaces."""
    raw = [b" ".join(t.lower().split()) for t in text.fill_null("").cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in raw), np.int64).reshape(-1, 2)


def exact_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, document) of the distinct shingles of a block, by document: two shingles have one
    number, from 0, exactly if their words agree."""
    data, off = tv.text_bytes(text)
    data = tv.LOWER[data]
    spans = tv.words(data, off)
    code, _ = tv.exact_codes(data, spans.start, spans.end, tv.span_hash(data, spans.start, spans.end))
    number, doc = tv.shingle_codes(code, spans, n)
    number = np.unique(number, return_inverse=True)[1]
    width = int(number.max()) + 1 if len(number) else 1
    doc, number = np.divmod(np.unique(doc * width + number), width)
    return number, doc, len(off) - 1


def superminhash(h: np.ndarray, doc: np.ndarray, n_docs: int, m: int = SLOTS) -> np.ndarray:
    """Signatures of m slots: level of the slot's smallest shingle in the upper 7 bits, its
    random fraction in the rest. Slots of a document without shingles hold the maximum."""
    sig = np.full(n_docs * m, 0xFFFFFFFF, np.uint32)
    rows = ranks = None
    for j in range(m):
        r = tv.mix(h + np.uint64((j + 1) * int(tv.MULT) & (1 << 64) - 1))
        k = j + ((r >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if ranks is None:
            slot = k
        else:
            slot = ranks[rows, k].astype(np.int64)
            ranks[rows, k] = ranks[rows, j]
        value = (np.uint32(j) << _LEVEL) | (r & np.uint64((1 << 25) - 1)).astype(np.uint32)
        np.minimum.at(sig, doc * m + slot, value)
        worst = sig.reshape(n_docs, m).max(axis=1)
        going = (worst >> _LEVEL > j)[doc]
        if not going.any():
            break
        if ranks is None:
            h, doc, k = h[going], doc[going], k[going]
            ranks, rows = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1)), np.arange(len(h))
            ranks[rows, k] = 0
        elif not going.all():
            h, doc, ranks = h[going], doc[going], ranks[going]
            rows = np.arange(len(h))
    return sig.reshape(n_docs, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key of every band of a signature."""
    n = sig.shape[1] // rows
    part = sig[:, : n * rows].astype(np.uint64).reshape(len(sig), n, rows)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(sig), n)).copy()
    for i in range(rows):
        key = tv.mix(key * tv.MULT + part[:, :, i] + np.uint64(1))
    return key


def _sign(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.blocks(batches):
            h, doc, n_docs = shingle_sets(batch.column("text"), shingle)
            count = np.bincount(doc, minlength=n_docs)
            digest = word_digests(batch.column("text"))
            sig = superminhash(h, doc, n_docs)
            keys = bands(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(count.astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "keys", "sig"],
            )

    return sign


def _likely(least: int):
    """Rows (a, b, sig_a, sig_b) -> the (a, b) whose signatures agree in so many slots at least."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(tv.text_bytes(batch.column(c))[0].tobytes(), np.uint32).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select(["a", "b"])

    return likely


def least_slots(threshold: tuple[int, int]) -> int:
    """Slots in which the signatures of a pair at the threshold agree, less five standard deviations."""
    t = threshold[0] / threshold[1]
    return int(SLOTS * t - 5 * (SLOTS * t * (1 - t)) ** 0.5)


def _verify(shingle: int, threshold: tuple[int, int]):
    """Rows (a, b, text_a, text_b) -> the linked (a, b)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.blocks(batches, "text_a"):
            # each text once, however many pairs it has here
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_index=True)
            both = pa.concat_arrays([batch.column("text_a").cast(pa.large_string()), batch.column("text_b").cast(pa.large_string())])
            number, doc, _ = exact_sets(both.take(pa.array(at)), shingle)
            a, b, size = np.searchsorted(ids, a), np.searchsorted(ids, b), np.bincount(doc, minlength=len(ids))
            width = int(number.max(initial=0)) + 1
            key = doc * width + number
            pair = np.repeat(np.arange(len(a)), size[a])
            mine = number[np.arange(len(pair)) + ((np.cumsum(size) - size)[a] - (np.cumsum(size[a]) - size[a]))[pair]]
            probe = b[pair] * width + mine
            found = key[np.minimum(np.searchsorted(key, probe), len(key) - 1)] == probe
            same = np.bincount(pair[found], minlength=len(a))
            union = size[a] + size[b] - same
            yield batch.filter(pa.array(threshold[1] * same >= threshold[0] * union)).select(["a", "b"])

    return verify


def _compare_cell(shingle: int, threshold: tuple[int, int]):
    """All members of a cell -> links between its two sides, a spanning forest of them only."""

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("cid", "ascending"), ("side", "ascending")])
        ids, label, side = (cell.column(c).to_numpy() for c in ("cid", "label", "side"))
        new = np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)]
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        left, right = np.zeros(len(first), bool), np.zeros(len(first), bool)
        left[which[side == 0]], right[which[side == 1]] = True, True
        code, doc, n = exact_sets(cell.column("text").take(pa.array(first)), shingle)
        ids, label, size = ids[first], label[first], np.bincount(doc, minlength=len(first))
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        # a shingle that one member alone has links nothing
        shared = np.bincount(code)[code] > 1 if len(code) else np.zeros(0, bool)
        code, doc = np.unique(code[shared], return_inverse=True)[1], doc[shared]
        same, width = np.zeros((n, n), np.float32), 4096
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            at = slice(*np.searchsorted(code, [lo, lo + width]))
            has = np.zeros((n, width), np.float32)
            has[doc[at], code[at] - lo] = 1
            same += has @ has.T
        linked = threshold[1] * same >= threshold[0] * (size[:, None] + size[None, :] - same)
        linked &= (left[:, None] & right[None, :]) & (label[:, None] != label[None, :])
        a, b = np.nonzero(linked)
        root = {int(x): int(x) for x in label}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(int(label[i])), find(int(label[j]))
            if x != y:
                root[x] = y
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return compare


def class_labels(docs: DataFrame, shingle: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(sets, classes): a row (doc_id, n_shingles, h1, h2) for each document, where h1 and h2 name its
    class, and of each class of several documents, or linked with another, (h1, h2, label, copies)."""
    signed = keep(docs.select("doc_id", "text").mapInArrow(_sign(shingle), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary"), "signed")
    one = F.struct("h1", "h2", F.col("n_shingles").alias("n"))
    several = keep(signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(one).alias("one"), F.max(one).alias("other")).where("one <> other").select("doc_id", "one"), "several", small=True)
    spoken = signed.drop("keys", "sig").join(several, "doc_id", "left")
    sets = spoken.select("doc_id", "n_shingles", F.coalesce("one.h1", "h1").alias("h1"), F.coalesce("one.h2", "h2").alias("h2"), F.coalesce("one.n", "n_shingles").alias("n"))
    classes = keep(sets.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")), "classes")
    rows = signed.join(classes.select("h1", "h2", F.col("cid").alias("doc_id")), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"])
    placed = keep(rows.select(F.col("doc_id").alias("cid"), "n_shingles", F.explode("keys").alias("key")), "placed")
    full = keep(placed.groupBy("key").agg(F.count("*").alias("members"), F.min("cid").alias("pivot")).where("members > 1"), "full", small=True)
    slots = keep(hot_slots(full, ["key"], "members"), "slots", small=True)
    told, placed_ = dealt(full, ["key"], slots, None), placed
    placed = keep(dealt(placed, ["key"], slots, "cid").join(told, ["key", "salt"]), "buckets", small=True)
    discard(placed_, full)
    labels = keep(placed.select("cid", F.col("cid").alias("label")).distinct(), "labels", small=True)
    members = labels.select("cid")
    signatures = keep(rows.select(F.col("doc_id").alias("cid"), "sig").join(members, "cid", "left_semi"), "signatures")
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(members, "cid", "left_semi")
    if not several.isEmpty():
        told = texts.join(several.select(F.col("doc_id").alias("cid"), "one"), "cid", "left")
        texts = told.mapInArrow(_standing, "cid long, text string")
    texts = keep(texts.dropDuplicates(["cid"]), "texts")

    def met(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
        """Pairs with both sides' columns; a pivot of many pairs meets them in many tasks."""
        slots = keep(hot_slots(pairs.groupBy("b").agg(F.count("*").alias("n")), ["b"], "n"), "slots", small=True)
        with_a = dealt(pairs, ["b"], slots, "a").join(table.select(F.col("cid").alias("a"), F.col(what).alias(f"{what}_a")), "a")
        pivots = table.select(F.col("cid").alias("b"), F.col(what).alias(f"{what}_b")).join(pairs.select("b").distinct(), "b", "left_semi")
        return with_a.join(dealt(pivots, ["b"], slots, None), ["b", "salt"]).select("a", "b", f"{what}_a", f"{what}_b")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs", small=True)
        likely = keep(met(pairs, signatures, "sig").mapInArrow(_likely(least_slots(threshold)), "a long, b long"), "likely", small=True)
        discard(pairs)
        return met(likely, texts, "text").mapInArrow(_verify(shingle, threshold), "a long, b long")

    def merged(found: DataFrame, labels: DataFrame) -> DataFrame:
        """Only links between different labels go on, as links of the labels."""
        found = keep(found.distinct(), "links", small=True)
        of = lambda end: labels.select(F.col("cid").alias(end), F.col("label").alias(f"label_{end}"))
        new = found.join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        if found.isEmpty():
            return labels
        joined = components(new.distinct()).select(F.col("v").alias("label"), F.col("label").alias("low"))
        return keep(labels.join(joined, "label", "left").select("cid", F.coalesce("low", "label").alias("label")), "labels", small=True)

    # first each document meets the pivot that most of its buckets have, the likeliest link
    first = placed.where("cid <> pivot").groupBy(F.col("cid").alias("a")).agg(F.mode("pivot", True).alias("b"))
    labels = merged(verified(first), labels)
    for turn in range(2):
        here = keep((placed.where("members > 2") if turn else placed).select("key", "salt", "cid", "pivot").join(labels, "cid"), "here", small=True)
        # the pivot comes from the bucket's largest label or another each turn: a hash decides
        pivot = F.min_by("cid", F.xxhash64("cid", F.lit(turn))) if turn else F.min("pivot")
        spread = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), pivot.alias("pivot"))
        named = spread.where("low <> high").join(labels.select(F.col("cid").alias("pivot"), F.col("label").alias("of")), "pivot")
        pairs = here.drop("pivot").join(dealt(named.select("key", "pivot", "of"), ["key"], slots, None), ["key", "salt"]).where("label <> of").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
        labels = merged(verified(pairs.distinct()), labels)
        discard(here)
    labels = merged(_full_compare(placed, labels, texts, slots, shingle, threshold), labels)
    discard(placed, texts, signatures)
    joined = classes.join(labels, "cid", "left").withColumn("component_id", F.coalesce("label", "cid"))
    return sets, joined.where("copies > 1 or component_id <> cid").select("h1", "h2", "component_id", "copies")


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, text, one) -> those whose text has the digest that stands for its doc_id, if one does."""
    for batch in batches:
        one = batch.column("one")
        known = np.array([x is None for x in one.to_pylist()], bool)
        wanted = np.array([(0, 0) if x is None else (x["h1"], x["h2"]) for x in one.to_pylist()], np.int64).reshape(-1, 2)
        yield batch.filter(pa.array(known | (word_digests(batch.column("text")) == wanted).all(axis=1))).select(["cid", "text"])


def _open_rows(here: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows of the buckets that span several labels, with the bucket's largest label, its members
    and what they weigh; buckets with the same members count once."""
    by_label = here.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("cid")).alias("mark"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("mark2"))
    buckets = by_label.groupBy("key").agg(
        F.max_by("label", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("weight").alias("weight"), F.count("*").alias("labels"), F.bit_xor("mark").alias("mark"), F.bit_xor("mark2").alias("mark2")
    ).where("labels > 1")
    once = buckets.groupBy("all", "mark", "mark2").agg(F.min("key").alias("key"), F.min_by("main", "key").alias("main"), F.min_by("most", "key").alias("most"), F.min_by("weight", "key").alias("weight"))
    return here.join(dealt(once.select("key", "main", "all", "most", "weight"), ["key"], slots, None), ["key", "salt"])


def _full_compare(placed: DataFrame, labels: DataFrame, texts: DataFrame, slots: DataFrame, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between components inside buckets of three and more members: those outside the
    bucket's largest component against all, block by block."""
    here = placed.where("members > 2").select("key", "salt", "cid", "n_shingles").join(labels, "cid")
    rows = keep(_open_rows(here, slots), "open", small=True)
    cells = F.greatest(F.ceil(F.col("all") / CELL), F.ceil(F.col("weight") / CELL_SHINGLES))
    few = F.greatest(F.ceil((F.col("all") - F.col("most")) / CELL), F.ceil(F.col("weight") / CELL_SHINGLES))
    block = lambda n: F.pmod(F.xxhash64("cid"), n)
    left = rows.where("label <> main").withColumn("i", block(few)).withColumn("j", F.explode(F.sequence(F.lit(0), cells - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", block(cells)).withColumn("i", F.explode(F.sequence(F.lit(0), few - 1))).withColumn("side", F.lit(1))
    both = left.select("key", "i", "j", "side", "cid", "label").unionByName(right.select("key", "i", "j", "side", "cid", "label"))
    return both.join(texts, "cid").groupBy("key", "i", "j").applyInArrow(_compare_cell(shingle, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for each row of docs."""
    sets, classes = class_labels(docs, shingle, threshold)
    # copies of one text meet their class in many tasks
    slots = keep(hot_slots(classes, ["h1", "h2"], "copies"), "slots", small=True)
    out = dealt(sets, ["h1", "h2"], slots, "doc_id").join(dealt(classes.drop("copies"), ["h1", "h2"], slots, None), ["h1", "h2", "salt"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that are the first of their group, with all columns."""
    gone = near_duplicates(docs, shingle, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


#: All pairs that share a shingle are counted here, so this is for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
