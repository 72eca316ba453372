"""Token ids in files, compressed by Re-Pair grammars.

Documents are dealt to shards by ranges of doc_id and encoded in ascending doc_id order, each
followed by END. A shard is written as blocks of about BLOCK_TOKENS ids. In a block frequent
pairs of neighbouring symbols are replaced by new symbols, round by round until no pair has LEAST
places: a round takes pairs from the commonest down, as long as no symbol is both a left and a
right one, so that no two replacements overlap; a pair of equal symbols is taken where no other
pair has the symbol, at every other place of a run from the left. A block row of the Parquet files
has the rules, the lengths to which they expand (so that any range of ids can be decoded alone)
and what is left of the sequence.

Texts are encoded by the tokenizers library; pieces between white space, and between a letter and
a mark, don't influence each other there and are encoded once for many places; pieces are the same
if their bytes are. A text that has the string of a special token (in this very case) is encoded
by the library as a whole, so that it becomes that token's id, as the library does unless its
encode_special_tokens is set; `special=False` sets it, and such strings are ordinary text.

Order: doc_id, then a hash of the text, then the text, so rows of one doc_id, or of none, are cut
into ranges too. Null or empty text: END only. Null doc_id: before all others. Repeated rows: each
is encoded, one after another. Empty tables: no rows."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import partitions
from ..session import drop_at_exit, shared_dir
from . import textvec as tv

END, BLOCK_TOKENS, LEAST = 2, 1 << 20, 8
MAX_CACHED, RULED, BLOCK_BYTES = 400_000, 2000, 4 << 20
SCHEMA = "shard int, block int, n_tokens long, doc_ids binary, no_id binary, lengths binary, base int, rules binary, expansions binary, sequence binary"
_RULE = b"|"
#: 1: a letter, 2: a mark that ends a word.
_KIND = np.zeros(256, np.uint8)
_KIND[range(0x61, 0x7B)] = 1
_KIND[list(b"!#$%&()*+,-./:;<=>?@[]^_`{|}~")] = 2


class PieceEncoder:
    """Ids of texts as bytes of unsigned 32-bit integers, by way of pieces."""

    def __init__(self, file: bytes, special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = not special
        names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.size = self.tokenizer.get_vocab_size()
        (self.rule,) = self.ids(["|"])[0]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, pieces: set[bytes]) -> None:
        new = []
        for p in pieces:
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                self.young[p] = ids
        # many pieces as one text: a rule between them shows where each one's ids end
        plain = [p for p in new if _RULE not in p]
        for k in range(0, len(plain), RULED):
            part = plain[k : k + RULED]
            text = b" | ".join([b"", *part, b""]).decode("utf-8", "replace")
            ids = np.array(self.ids([text])[0], np.uint32)
            at = (4 * np.flatnonzero(ids == self.rule)).tolist()
            raw = ids.tobytes()
            if len(at) == len(part) + 1:
                self.young.update(zip(part, (raw[i + 4 : j] for i, j in zip(at, at[1:]))))
            else:  # a piece that gives the rule's id without having it
                self.alone(part)
        self.alone([p for p in new if _RULE in p])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, pieces: list[bytes]) -> None:
        for p, ids in zip(pieces, self.ids([p.decode("utf-8", "replace") for p in pieces])):
            self.young[p] = np.array(ids, np.uint32).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        data, off = tv.text_bytes(texts)
        whole = self.with_special(data, off)
        data = tv.LOWER[data]
        # a piece ends at white space, at the text's end and between a letter and a mark
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~tv.SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        kind = _KIND[data]
        cut[1:-1] |= (kind[:-1] == 1) & (kind[1:] == 2)
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        raw = data.tobytes()
        # each distinct piece of the block is looked up once
        which, some = tv.exact_codes(data, start, end, tv.span_hash(data, start, end))
        pieces = [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
        if len(self.young) > MAX_CACHED:
            self.old, self.young = self.young, {}
        unknown = set(pieces).difference(self.young)
        if unknown:
            self.learn(unknown)
        found = list(map(self.young.__getitem__, pieces))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, size = (np.cumsum(size) - size)[which], size[which]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), np.uint32)[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, off)]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k, got in zip(whole, self.ids([texts[k].as_py() for k in whole])):
            out[k] = np.array(got, np.uint32).tobytes()
        return out

    def with_special(self, data: np.ndarray, off: np.ndarray) -> list[int]:
        """The texts that have the string of a special token."""
        if self.special is None:
            return []
        found = ((m.start(), m.end()) for m in self.special.finditer(memoryview(np.ascontiguousarray(data))))
        docs = ((int(np.searchsorted(off, a, "right")) - 1, b) for a, b in found)
        return sorted({d for d, b in docs if b <= off[d + 1]})


_SLOT_BITS = 20


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * tv.MULT) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def repair(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansions, sequence): rule k replaces symbol base + k by two earlier symbols and
    expands to expansions[k] ids. No pair is left that could be replaced at `least` places."""
    seq, rules, sizes = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], np.ones(base, np.int64)
    # a pair gets rarer only, so places of rare pairs are left out until a new symbol comes to them
    live = np.ones(max(len(seq) - 1, 0), bool)
    while True:
        # of a run of one symbol every other place, from the left
        at = np.flatnonzero(live)
        same = at[seq[at] == seq[at + 1]]
        nth = np.arange(len(same))
        head = np.maximum.accumulate(np.where(np.diff(same, prepend=-2) != 1, nth, 0))
        odd = same[(nth - head) % 2 == 1]
        if len(odd):
            even = live.copy()
            even[odd] = False
            at = np.flatnonzero(even)
        key = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        slot = _slot(key)
        some = np.bincount(slot, minlength=1 << _SLOT_BITS)[slot] >= least
        live[at[~some]] = False
        at, key = at[some], key[some]
        ordered = np.sort(key)
        first_at = np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(first_at, len(ordered)))
        often = times >= least
        pairs, times = ordered[first_at[often]], times[often]
        if not len(pairs):
            break
        slots: set[int] = set()
        taken = []
        commonest = np.argsort(-times, kind="stable")
        a_s, b_s = (pairs[commonest] >> np.uint64(32)).tolist(), (pairs[commonest] & np.uint64(0xFFFFFFFF)).tolist()
        left, right, slot = bytearray(len(sizes)), bytearray(len(sizes)), _slot(pairs[commonest]).tolist()
        for k, (a, b, s) in enumerate(zip(a_s, b_s, slot)):
            # pairs that share a slot wait for the next round; a pair of equal symbols has them alone
            if not right[a] and not left[b] and (a != b or not (left[a] or right[b])) and s not in slots:
                left[a] = right[b] = 1
                slots.add(s)
                taken.append(k)
        chosen = pairs[commonest[taken]]
        first, second = (chosen >> np.uint64(32)).astype(np.int64), (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        table = np.zeros(1 << _SLOT_BITS, np.int32)
        table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
        rank = table[_slot(key)]
        found = chosen[rank] == key
        hit = at[found]
        seq[hit] = (len(sizes) + rank[found]).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        live[hit] = True
        live[np.maximum(hit - 1, 0)] = True
        # the place after a pair becomes its new symbol's
        seq, live = seq[stay], np.append(live, False)[stay]
        live = live[:-1]
        rules.append(np.stack([first, second], axis=1).astype(np.uint32))
        sizes = np.concatenate([sizes, sizes[first] + sizes[second]])
    return np.concatenate(rules), sizes[base:].astype(np.uint32), seq


def expand(rules: np.ndarray, base: int, sequence: np.ndarray) -> np.ndarray:
    """The ids of a sequence of symbols: the rules are expanded, then copied to their places."""
    deep = sequence >= base
    if not deep.any():
        return sequence.astype(np.uint32)
    ends_in, flat = _expanded(rules, base)
    rule = sequence[deep].astype(np.int64) - base
    size = np.ones(len(sequence), np.int64)
    size[deep] = ends_in[rule + 1] - ends_in[rule]
    ends = np.cumsum(size)
    out = np.repeat(sequence.astype(np.uint32), size)
    _copy(flat, ends_in[rule], out, (ends - size)[deep], size[deep])
    return out


def _copy(source: np.ndarray, begin: np.ndarray, target: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Copies n[k] ids from begin[k] of source to at[k] of target, for all k."""
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    target[np.repeat(at, n) + inner] = source[np.repeat(begin, n) + inner]


def _expanded(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids): rule k gives ids[bounds[k] : bounds[k + 1]]. A rule's parts are earlier ones;
    it is copied together from theirs, so that each is expanded once."""
    sizes, levels, todo = np.zeros(len(rules), np.int64), [], np.arange(len(rules))
    while len(todo):
        parts = rules[todo].astype(np.int64) - base
        size = np.where(parts < 0, 1, sizes[np.maximum(parts, 0)])
        ready = (size > 0).all(axis=1)
        sizes[todo[ready]] = size[ready].sum(axis=1)
        levels.append(todo[ready])
        todo = todo[~ready]
    bounds = np.append(0, np.cumsum(sizes))
    out = np.zeros(bounds[-1], np.uint32)
    for level in levels:
        at = bounds[level]
        for symbol in rules[level].astype(np.int64).T:
            plain = symbol < base
            out[at[plain]] = symbol[plain]
            part = symbol[~plain] - base
            _copy(out, bounds[part], out, at[~plain], sizes[part])
            at = at + np.where(plain, 1, sizes[np.maximum(symbol - base, 0)])
    return bounds, out


def decode_range(rules: np.ndarray, expansions: np.ndarray, base: int, sequence: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of a block; only the symbols that cover them are expanded."""
    size = np.ones(len(sequence), np.int64)
    deep = sequence >= base
    size[deep] = expansions[sequence[deep] - base]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(rules, base, sequence[a:b])[lo - skipped : hi - skipped]


_encoders: dict[str, PieceEncoder] = {}


def _encoder(file: bytes, special: bool) -> PieceEncoder:
    key = f"{hashlib.sha256(file).hexdigest()} {special}"
    if key not in _encoders:
        _encoders[key] = PieceEncoder(file, special)
    return _encoders[key]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, block_tokens: int = BLOCK_TOKENS, special: bool = True) -> None:
    """Writes docs(doc_id, text) as block files (SCHEMA) under path."""
    import public_tokenizers

    spark = docs.sparkSession
    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), _encoder(file.value, special)
        last = np.array([end], np.uint32).tobytes()
        base, held, ids, n, block = max(encoder.size, end + 1), [], [], 0, 0

        def packed() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], np.uint32)
            rules, expansions, sequence = repair(np.frombuffer(b"".join(held), np.uint32), base)
            known, missing = np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids])
            blobs = [known, np.packbits(missing), lengths], [rules, expansions, sequence.astype(np.uint16) if base + len(rules) <= 1 << 16 else sequence]
            columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs[0]), pa.array([base], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs[1])]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in tv.blocks(batches, size=BLOCK_BYTES):
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                held.append(got + last)
                ids.append(doc_id)
                n += len(got) // 4 + 1
                if n >= block_tokens:
                    yield packed()
                    held, ids, n, block = [], [], 0, block + 1
        if held:
            yield packed()

    shards = partitions(docs.select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    ordered = rows.repartitionByRange(shards, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, rules, expansions, sequence) of a block row."""
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    kind = np.uint16 if row["base"] + len(rules) <= 1 << 16 else np.uint32
    return np.frombuffer(row["lengths"], np.uint32), rules, np.frombuffer(row["expansions"], np.uint32), np.frombuffer(row["sequence"], kind)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on request, ids array<long> of the written files."""
    stored = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, rules, _, sequence = unpack(row)
                got = expand(rules, row["base"], sequence)
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(lengths)).astype(bool)
                raw = memoryview(got.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(lengths)
                columns = [pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=missing), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(got.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    docs = stored.mapInArrow(run, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    # one row a shard goes through the window over all; blocks only meet their shard's
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stored.select("shard", "block", inside.alias("block_start")).join(shards.drop("n"), "shard")
    placed = docs.join(blocks, ["shard", "block"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = drop_at_exit(spark, f"{shared_dir(spark)}/corvane/tokens-{uuid.uuid4().hex}")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
