"""Removal of repeated byte strings by per-shard suffix arrays, merged across shards.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
doc_id. Documents are written once as a table of shards of about SHARD_BYTES, bucketed by shard,
so that every later pass reads its shards without shuffling texts. Copies of whole texts are
found by digest and take no further part. Three passes decide the rest:

1. The anchor of a string is the smallest hash of its ANCHOR-byte substrings, so equal strings
   have equal anchors and neighbouring strings mostly share one: they form a stretch. Shards send
   their sorted anchors, cut by range; a range's runs are merged and each learns which of its
   anchors another shard has.
2. Of anchors seen elsewhere, or in two documents of the shard, stretches are compared as wholes:
   whether an anchor has different stretches anywhere, and whether a smaller document has the
   same stretch. Inside long repeats this settles everything.
3. For what is left a shard builds a suffix array over its distinct stretches, by
   Larsson-Sadakane refinement, and Kasai common prefixes, so that equal strings stand together;
   it sends each distinct string's hash and smallest doc_id once, sorted and cut by range. Runs
   are merged and each learns, by binary search, which strings start in a smaller document.

Inside a shard stretches and strings are compared byte by byte; between shards by two independent
64-bit hashes. Nothing depends on how often a string occurs: a shard sends it once. Ranges and
buckets are as many as the texts' bytes ask for, so that no task's share grows with them. Null or empty text: no
bytes. Null doc_id: after all others. Repeated rows: a row each, none removes bytes of its twin.
Texts under LENGTH bytes are never changed. Empty tables: no rows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import dealt, hot_slots
from ..session import drop, keep, shared_dir
from . import textvec as tv

LENGTH, ANCHOR, SHARD_BYTES = 50, 32, 4 << 20
BUCKET_BYTES, RANGE_BYTES = 64 << 20, 32 << 20
_LAST, _CHUNK = np.iinfo(np.int64).max, 1 << 15
RUN = "pass int, p int, shard long, n long, keys binary, checks binary, values binary"
REPLY = "shard long, pass int, p int, n long, bits binary"
RESULT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def suffix_array(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes of all regions; end[i] is where position i's region ends. Equal
    suffixes stand in the order of their regions."""
    n = len(data)
    left = end - np.arange(n)
    wide = np.zeros(n + 6, np.int64)
    wide[:n] = data
    wide[:n] += 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key *= 257
        key += wide[j : n + j]
    near = np.flatnonzero(left < 7)
    key[near] -= key[near] % 257 ** (7 - left[near])  # nothing beyond the region's end
    order = np.argsort(key, kind="stable")
    sorted_key, h = key[order], 7
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    last = np.concatenate([first[1:], [True]]) if n else first
    slots = np.flatnonzero(~(first & last))
    while len(slots):
        at = order[slots]
        beyond = at + h >= end[at]
        second = np.where(beyond, at, rank[np.minimum(at + h, n - 1)] + n)
        group = rank[at]
        moved = np.lexsort((second, group))
        at, group, second = at[moved], group[moved], second[moved]
        order[slots] = at
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        last = np.concatenate([first[1:], [True]])
        slots = slots[~(first & last)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix of order shares with the one before. Kasai: where
    the bytes before two neighbours agree it is one less than their predecessors'; the rest are
    measured eight bytes at a time, then in pieces."""
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    at = np.arange(n)
    start = np.concatenate([[True], at[1:] >= end[:-1]])
    other = np.maximum(before, 0)
    measured = np.flatnonzero(start | (before < 0) | start[other] | (data[at - 1] != data[other - 1]))
    mine, theirs = measured, before[measured]
    has = theirs >= 0
    mine, theirs = mine[has], theirs[has]
    most = np.minimum(end[mine] - mine, end[theirs] - theirs)
    lo, open_ = np.zeros(len(mine), np.int64), np.arange(len(mine))
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.zeros(n + 9, np.uint64)
    for j in range(8):
        words[: n + 8] |= wide[j : n + 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    for _ in range(12):  # eight bytes at a time; few prefixes are longer
        differ = words[mine[open_] + lo[open_]] ^ words[theirs[open_] + lo[open_]]
        high = differ & ~(differ >> np.uint64(1))  # so that rounding can't reach the next power of two
        equal = np.where(differ == 0, 8, 7 - (np.frexp(high.astype(np.float64))[1] - 1) // 8)
        lo[open_] += equal
        open_ = open_[(differ == 0) & (lo[open_] < most[open_])]
        if not len(open_):
            break
    lo = np.minimum(lo, most)
    for k in open_.tolist():  # the few long ones, in pieces that double
        i, j, at_, size, limit = int(mine[k]), int(theirs[k]), int(lo[k]), 128, int(most[k])
        while at_ < limit:
            size = min(size, limit - at_)
            same = data[i + at_ : i + at_ + size] == data[j + at_ : j + at_ + size]
            if not same.all():
                at_ += int(same.argmin())
                break
            at_, size = at_ + size, 2 * size
        lo[k] = at_
    shared = np.zeros(n, np.int64)
    shared[mine] = lo
    known = np.full(n, -n, np.int64)
    known[measured] = shared[measured] + measured
    out[:] = (np.maximum.accumulate(known) - at)[order]
    return out


_powers: dict[str, np.ndarray] = {}


def _anchor_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i <= n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        for key, base in (("up", int(tv.MULT)), ("down", pow(int(tv.MULT), -1, 1 << 64))):
            table = np.full(max(n + 1, SHARD_BYTES + (1 << 20)), base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit anchor, first string start, end of starts) of each stretch of neighbouring strings
    with one anchor inside a document. Anchors only say what is worth comparing."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    k = min(ANCHOR, length)
    up, down = _anchor_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    width, low = length - k + 1, np.empty(n, np.uint64)
    for a in range(0, n, _CHUNK):  # pieces that stay in the processor's cache
        b = min(n, a + _CHUNK)
        m = b - a + width - 1
        h = sums[a + k : a + k + m] - sums[a : a + m]
        h *= down[a : a + m]
        h ^= h >> np.uint64(32)
        h *= tv.MULT
        h ^= h >> np.uint64(29)
        h *= tv.MULT
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            h = np.minimum(h[:-step], h[step:])
            reach += step
        h *= tv.MULT  # minima are small; ranges must hold equally many
        np.right_shift(h, np.uint64(16), out=low[a:b])
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[1:-1] = low[1:] != low[:-1]
    edge[off[:-1][off[:-1] < n]] = True
    stops = np.maximum(off[1:] - length + 1, off[:-1])  # no string starts from here to the document's end
    edge[stops[stops < n]] = True
    at = np.flatnonzero(edge[:-1])
    to = np.append(at[1:], n)
    doc = np.searchsorted(off, at, "right") - 1
    inside = at < stops[doc]
    return low[at[inside]], at[inside], to[inside]


def _planes(keys: np.ndarray, size: int) -> bytes:
    """Sorted numbers byte by byte, the first bytes of all together: they compress well."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _runs(shard: int, keys: np.ndarray, bits: int, turn: int, ranges: int, values: np.ndarray | None = None, checks: np.ndarray | None = None) -> list[tuple]:
    """A shard's sorted keys, and checks and values if any, cut at the borders of the ranges by
    binary search."""
    borders = np.array([(p << bits) // ranges for p in range(1, ranges)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
    out = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[p], cut[p + 1]
        blob = b""
        if values is not None:
            base = int(values[a:b].min())
            spread = values[a:b].astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
            size = max(1, (int(spread.max()).bit_length() + 7) // 8)
            blob = np.int64(base).tobytes() + bytes([size]) + _planes(spread, size)
        out.append((turn, p, shard, int(b - a), _planes(keys[a:b], bits // 8), b"" if checks is None else checks[a:b].astype("<u8").tobytes(), blob))
    return out


def _values(raw: bytes, n: int) -> np.ndarray:
    return (_numbers(raw[9:], n, raw[8]) + np.frombuffer(raw, np.int64, 1).astype(np.uint64)).astype(np.int64)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(values), kinds[kind]) for (name, kind), values in zip(fields, columns)})


def _least(which: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, _LAST)
    np.minimum.at(out, which, rank)
    return out


class Shard:
    """A shard's rows in a fixed order and, of those that aren't copies, the anchors."""

    def __init__(self, table: pa.Table, replies: pa.Table, length: int):
        table = table.take(pa.array(table.column("row").to_numpy().argsort()))
        self.number, self.length = table.column("shard")[0].as_py(), length
        self.ids, self.sizes = table.column("doc_id").combine_chunks(), np.diff(tv.text_bytes(table.column("text"))[1])
        mine = replies.filter(pc.equal(replies.column("pass"), 0))
        self.copy = np.isin(table.column("row").to_numpy(), mine.column("p").to_numpy())
        table = table.filter(pa.array(~self.copy))
        self.rank = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
        self.data, self.off = tv.text_bytes(table.column("text"))
        self.anchor, self.start, self.stop = anchors(self.data, self.off, length)
        self.keys, self.which = np.unique(self.anchor, return_inverse=True)
        self.doc = self.rank[np.searchsorted(self.off, self.start, "right") - 1]
        self.several = _least(self.which, self.doc, len(self.keys)) < -_least(self.which, -self.doc, len(self.keys))


class Stretches:
    """Of anchors seen elsewhere or in several documents: distinct stretches and anchors."""

    def __init__(self, shard: Shard, replies: pa.Table):
        wanted = (_bits(replies, 1, len(shard.keys)) | shard.several)[shard.which]
        self.start, self.stop, self.doc = shard.start[wanted], shard.stop[wanted], shard.doc[wanted]
        self.keys, self.key = np.unique(shard.anchor[wanted], return_inverse=True)
        end = self.stop + shard.length - 1
        hashed, check = (tv.span_hash(shard.data, self.start, end, lane) for lane in range(2))
        code, first = tv.exact_codes(shard.data, self.start, end, hashed)
        order = np.lexsort((check[first], hashed[first]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.span, self.spans, self.checks = place[code], hashed[first][order], check[first][order]
        self.least = _least(self.span, self.doc, len(self.spans))
        # a 63-bit mark of an anchor's one stretch; 0 where the shard has several
        low, high = np.full(len(self.keys), ~np.uint64(0)), np.zeros(len(self.keys), np.uint64)
        mark = (check >> np.uint64(1)) | np.uint64(1)
        np.minimum.at(low, self.key, mark)
        np.maximum.at(high, self.key, mark)
        self.mark = np.where(low == high, low, np.uint64(0))

    def settle(self, replies: pa.Table) -> None:
        """open: stretches whose strings must be looked at; gone: those that a smaller document has."""
        multi, smaller = _bits(replies, 2, len(self.keys)), _bits(replies, 3, len(self.spans))
        self.gone = smaller[self.span] | (self.doc > self.least[self.span])
        self.open = multi[self.key] & ~self.gone


def _strings(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Every string start of the stretches."""
    size = stop - start
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def distinct_strings(shard: Shard, stretches: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, smallest document), by hash and check, of the distinct strings in open stretches."""
    length = shard.length
    one = np.zeros(len(stretches.start), bool)
    opened = np.flatnonzero(stretches.open)
    one[opened[np.unique(stretches.span[opened], return_index=True)[1]]] = True
    start, stop = stretches.start[one], stretches.stop[one]
    doc = np.searchsorted(shard.off, start, "right")
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != stop[:-1]) | (doc[1:] != doc[:-1])
    start, stop = start[new], stop[np.append(new[1:], True)] if len(start) else stop
    size = stop - start + length - 1
    place, end = _strings(start, stop + length - 1), np.repeat(np.cumsum(size), size)
    data = shard.data[place]
    order = suffix_array(data, end)
    whole = end[order] - order >= length
    group = np.cumsum(common_prefixes(data, end, order) < length)[whole]
    at = place[order[whole]]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(shard.rank[np.searchsorted(shard.off, at, "right") - 1], first)
    hashed, check = (tv.window_hash(shard.data, at[first], length, lane) for lane in range(2))
    by_hash = np.lexsort((check, hashed))
    return hashed[by_hash], check[by_hash], least[by_hash]


def removed_starts(shard: Shard, stretches: Stretches, replies: pa.Table) -> np.ndarray:
    """Starts of all strings that also start in a smaller document."""
    at = _strings(stretches.start[stretches.open], stretches.stop[stretches.open])
    hashed, check = (tv.window_hash(shard.data, at, shard.length, lane) for lane in range(2))
    order = np.lexsort((check, hashed))
    new = np.ones(len(at), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (check[order][1:] != check[order][:-1])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    rank, n = shard.rank[np.searchsorted(shard.off, at, "right") - 1], int(new.sum())
    smaller = _bits(replies, 4, n)[which] | (rank > _least(which, rank, n)[which])
    return np.concatenate([_strings(stretches.start[stretches.gone], stretches.stop[stretches.gone]), at[smaller]])


def _bits(replies: pa.Table, turn: int, n: int) -> np.ndarray:
    """The answers to a shard's sorted keys, in their order."""
    out, at = np.zeros(n, bool), 0
    rows = sorted((r for r in replies.to_pylist() if r["pass"] == turn), key=lambda r: r["p"])
    for r in rows:
        out[at : at + r["n"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"])
        at += r["n"]
    assert at == n, "a shard's keys and their answers differ"
    return out


def _merge(runs: pa.Table) -> pa.Table:
    """The answers to the runs of one pass and range. 1: which keys another run has. 2: which have
    more than one mark in all runs. 3 and 4: which have a smaller value in another run."""
    rows = runs.to_pylist()
    turn = rows[0]["pass"]
    keys = [_numbers(r["keys"], r["n"], 6 if turn < 3 else 8) for r in rows]
    if turn == 1:
        merged = np.sort(np.concatenate(keys), kind="stable")
        again = merged[1:][merged[1:] == merged[:-1]]
        bits = [_among(k, again) for k in keys]
    else:
        values = [_values(r["values"], r["n"]) for r in rows]
        checks = [np.frombuffer(r["checks"], "<u8") if turn > 2 else np.zeros(r["n"], np.uint64) for r in rows]
        all_keys, all_checks, all_values = np.concatenate(keys), np.concatenate(checks), np.concatenate(values)
        order = np.lexsort((all_checks, all_keys)) if turn > 2 else np.argsort(all_keys, kind="stable")
        sorted_keys, sorted_checks = all_keys[order], all_checks[order]
        first = np.flatnonzero(np.concatenate([[True], (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_checks[1:] != sorted_checks[:-1])]))
        known, known_checks, low = sorted_keys[first], sorted_checks[first], np.minimum.reduceat(all_values[order], first)
        if turn == 2:
            several = (np.maximum.reduceat(all_values[order], first) > low) | (low == 0)
            bits = [several[np.searchsorted(known, k)] for k in keys]
        else:
            bits = [low[_place(known, known_checks, k, c)] < v for k, c, v in zip(keys, checks, values)]
    return _table([(r["shard"], turn, r["p"], r["n"], np.packbits(x).tobytes()) for r, x in zip(rows, bits)], REPLY)


def _place(known: np.ndarray, known_checks: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where each key with its check stands; keys that agree stand together, by check."""
    at = np.searchsorted(known, keys)
    while True:
        wrong = known_checks[at] != checks
        if not wrong.any():
            return at
        at += wrong


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _shard_table(docs: DataFrame, shard_bytes: int, buckets: int) -> DataFrame:
    """docs(doc_id, text) with shard and row, kept as a table bucketed by shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, row = TaskContext.get().partitionId() << 32, 0, 0
        for batch in tv.blocks(batches):
            size = len(tv.text_bytes(batch.column("text"))[0])
            if held and held + size > shard_bytes:
                shard, held = shard + 1, 0
            held += size
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(row, row + n, dtype=np.int32)), batch.column("doc_id"), *(batch.column(c) for c in ("text", "digest", "size"))], ["shard", "row", "doc_id", "text", "digest", "size"])
            row += n

    spark = docs.sparkSession
    name = f"corvane_shards_{uuid.uuid4().hex}"
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"digest": F.md5("text"), "size": F.octet_length("text")})
    rows = known.mapInArrow(cut, "shard long, row int, doc_id long, text string, digest string, size int")
    rows.write.bucketBy(buckets, "shard").option("compression", "zstd").option("path", f"{shared_dir(spark)}/corvane/{name}").saveAsTable(name)
    atexit.register(_dropped, spark, name)
    return spark.table(name)


def _dropped(spark: SparkSession, name: str) -> None:
    try:
        path = f"{shared_dir(spark)}/corvane/{name}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(spark, path)
    except Exception:  # the session has ended before
        pass


def _copies(shards: DataFrame, length: int) -> DataFrame:
    """REPLY rows of pass 0: the rows whose whole text, no shorter than length, a smaller document has."""
    rank = F.coalesce("doc_id", F.lit(_LAST)).alias("rank")
    rows = shards.where(F.col("size") >= length).select("shard", "row", "digest", rank)
    first = rows.groupBy("digest").agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.count("*").alias("n")).where("least < most")
    first = keep(first, "digests", small=True)
    slots = keep(hot_slots(first, ["digest"], "n"), "slots", small=True)
    found = dealt(rows, ["digest"], slots, "rank").join(dealt(first.select("digest", "least"), ["digest"], slots, None), ["digest", "salt"]).where("rank > least")
    return found.selectExpr("shard", "0 as pass", "row as p", "0L as n", "cast('' as binary) as bits")


def removed_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """RESULT for each row of docs(doc_id, text): the removed byte spans and what is left."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # shards share buckets beyond what a table may have
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    buckets, ranges = min(most, max(parts, -(-size // BUCKET_BYTES))), max(2 * parts, -(-size // RANGE_BYTES))
    shards = _shard_table(docs, shard_bytes, buckets)

    def visit(replies: DataFrame, f, schema: str) -> DataFrame:
        empty = _result([], [], [], [], []) if schema == RESULT else _table([], schema)

        def one(table: pa.Table, known: pa.Table) -> pa.Table:
            return f(Shard(table, known, length), known) if table.num_rows else empty

        texts = shards.select("shard", "row", "doc_id", "text")
        return texts.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(one, schema)

    def answered(runs: DataFrame, name: str) -> DataFrame:
        dealt = runs.repartition(max(parts, ranges // 4), "pass", "p")
        return keep(dealt.groupBy("pass", "p").applyInArrow(_merge, REPLY), name, small=True)

    def send_anchors(shard: Shard, known: pa.Table) -> pa.Table:
        return _table(_runs(shard.number, shard.keys, 48, 1, ranges), RUN)

    def send_stretches(shard: Shard, known: pa.Table) -> pa.Table:
        s = Stretches(shard, known)
        marked = _runs(shard.number, s.keys, 48, 2, ranges, s.mark.astype(np.int64))
        return _table(marked + _runs(shard.number, s.spans, 64, 3, ranges, s.least, s.checks), RUN)

    def send_strings(shard: Shard, known: pa.Table) -> pa.Table:
        s = Stretches(shard, known)
        s.settle(known)
        hashed, check, least = distinct_strings(shard, s)
        return _table(_runs(shard.number, hashed, 64, 4, ranges, least, check), RUN)

    def remove(shard: Shard, known: pa.Table) -> pa.Table:
        s = Stretches(shard, known)
        s.settle(known)
        at = removed_starts(shard, s, known)
        cover = np.zeros(len(shard.data) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover)[:-1] > 0
        # copies stand among the others again
        live = np.flatnonzero(~shard.copy)
        size = np.where(shard.copy, 0, shard.sizes)
        off = np.concatenate([[0], np.cumsum(size)])
        edge = np.zeros(len(gone) + 1, bool)
        edge[off] = True
        before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
        start, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        doc = live[np.searchsorted(shard.off, start, "right") - 1]
        whole = np.flatnonzero(shard.copy)
        start, end = np.concatenate([start - off[doc], np.zeros(len(whole), np.int64)]), np.concatenate([end - off[doc], shard.sizes[whole]])
        doc = np.concatenate([doc, whole])
        order = np.argsort(doc, kind="stable")
        kept = shard.data[~gone]
        left = np.concatenate([[0], np.cumsum(~gone)])[off]
        return _result(shard.ids, shard.sizes, (start[order], end[order], np.searchsorted(doc[order], np.arange(len(shard.ids) + 1))), kept, left)

    zero = keep(_copies(shards, length), "copies", small=True)
    one = zero.unionByName(answered(visit(zero, send_anchors, RUN), "anchor-replies"))
    two = one.unionByName(answered(visit(one, send_stretches, RUN), "stretch-replies"))
    three = two.unionByName(answered(visit(two, send_strings, RUN), "string-replies"))
    return visit(three, remove, RESULT)


def _result(ids, sizes, spans, kept, left) -> pa.Table:
    if not len(sizes):
        spans, kept, left = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    start, end, first = spans
    of_doc = pa.array(first.astype(np.int32))
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.asarray(sizes, np.int64)),
        "starts": pa.ListArray.from_arrays(of_doc, pa.array(start)), "ends": pa.ListArray.from_arrays(of_doc, pa.array(end)),
        "kept": pa.BinaryArray.from_buffers(pa.binary(), len(left) - 1, [None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())]),
    }
    return pa.table(columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
