"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are
compatible: BPE of the two tokens' bytes gives the two again. Encoding is thus a walk through a
nondeterministic transducer whose hypotheses are (tokens not yet sure, bytes of a token begun).
Sets of hypotheses are its deterministic states, built when first reached; what all hypotheses
agree on is emitted, so lookahead is bounded by the longest token. Each match of the pattern is
encoded separately. Decoding takes ids in any portions; a UTF-8 state machine holds back the
bytes of a character that isn't complete yet.

Null or empty text: no ids, digests of nothing. Null doc_id and repeated rows: a row each."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv

#: What White_Space has; Python's own \s differs.
_SPACE = r"\t-\r \x85\xa0  -     　"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII marks but the apostrophe, which may begin a match together with letters.
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&()*+,-./:;<=>?@[]^_`{|}~")] = True
#: First bytes of the white space beyond ASCII.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
MAX_CACHED, MAX_MOVES, MAX_HOPES, ASKED = 300_000, 300_000, 48, 16


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places inside texts at which two matches of the pattern always meet, if white space is
    ASCII: before and after a lone line feed, before a lone space, between a letter and a mark."""
    blank = np.ones(len(data) + 4, bool)
    blank[2:-2] = _BLANK[data]
    before2, before, here, after = blank[:-4], blank[1:-3], blank[2:-2], blank[3:-1]
    lone = here & ~before & ~after & ((data == 10) | (data == 32))
    cut = lone.copy()
    cut[1:] |= (lone & (data == 10))[:-1]
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    cut[off[:-1][off[:-1] < len(data)]] = False
    # a text's first and last bytes have no neighbours
    for edge in (off[:-1], off[1:] - 1):
        edge = edge[(edge >= 0) & (edge < len(data))]
        odd = edge[_BLANK[data[edge]]]
        cut[odd] = False
        cut[np.minimum(odd + 1, len(data) - 1)] &= ~_BLANK[data[odd]]
    return np.flatnonzero(cut)


class Transducer:
    """encode(piece) -> ids of one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.fits: dict[int, bool] = {}
        self.sorted = sorted(ranks)
        self.longest = max(map(len, ranks))
        self.hopes: dict[tuple[int, bytes], bool] = {}
        self.spines: dict[int, tuple[tuple[bytes, int, int], ...]] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: (last sure token or -1, hypotheses (tokens not yet sure, bytes of a token begun)).
        self.states = [(-1, (((), b""),))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.asked: dict[int, int] = {}

    def merged(self, token: bytes) -> list[tuple[int, int, int]]:
        """The merges of BPE over a token's own bytes: (place of the left part, rank, place after)."""
        parts, at, out = [token[i : i + 1] for i in range(len(token))], list(range(len(token) + 1)), []
        while len(parts) > 1:
            ranked = [(self.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del at[i + 1]
            out.append((at[i], rank, at[i + 1]))
        return out

    def spine(self, t: int, right: bool) -> tuple[tuple[bytes, int, int], ...]:
        """The parts that stand at one edge of a token while its bytes are merged, each with the
        rank that made it and the rank of the merge that takes it up."""
        key = t << 1 | right
        if key not in self.spines:
            b = self.token[t]
            edge = [(b[-1:] if right else b[:1], -1)] + [(b[i:j], rank) for i, rank, j in self.merged(b) if (j == len(b) if right else i == 0)]
            taken = [rank for _, rank in edge[1:]] + [len(self.token) + 1]
            self.spines[key] = tuple((x, made, up) for (x, made), up in zip(edge, taken))
        return self.spines[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the seam: parts x and y that stand at the seam together would
        merge before either is taken up (of equal ranks the left one goes first)."""
        if a < 0:
            return True
        key = a << 20 | b
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > MAX_MOVES:
                self.fits.clear()
            ranks, left, right = self.ranks, self.spine(a, True), self.spine(b, False)
            i = j = 0
            fits = True
            while True:
                x, _, up_x = left[i]
                y, _, up_y = right[j]
                rank = ranks.get(x + y)
                if rank is not None and rank < up_x and rank <= up_y:
                    fits = False
                    break
                if up_x <= up_y:
                    i += 1
                    if i == len(left):
                        break
                else:
                    j += 1
                    if j == len(right):
                        break
            self.fits[key] = fits
        return fits

    def hope(self, a: int, begun: bytes) -> bool:
        """Whether a token that begins so can follow token a. Answers may be too hopeful, for
        short beginnings; hopeless hypotheses only delay what is sure and multiply states."""
        key = (a, begun)
        found = self.hopes.get(key)
        if found is None:
            if len(self.hopes) > MAX_MOVES:
                self.hopes.clear()
            lo, hi = bisect_right(self.sorted, begun), bisect_left(self.sorted, begun + b"\xff" * 8)
            found = self.hopes[key] = hi > lo and (hi - lo > MAX_HOPES or any(self.compatible(a, self.ranks[t]) for t in self.sorted[lo:hi]))
        return found

    def move(self, state: int, byte: bytes) -> tuple[int, tuple[int, ...]]:
        """Determinises one step."""
        last, hypotheses = self.states[state]
        begun, whole, ranks = [], None, self.ranks
        for p, b in hypotheses:
            b += byte
            a = p[-1] if p else last
            if whole is None:
                t = ranks.get(b)
                if t is not None and self.compatible(a, t):
                    whole = p + (t,)
            if self.hope(a, b):
                begun.append((p, b))
        begun.append((whole, b""))
        sure, shortest = 0, min((p for p, _ in begun), key=len)
        if len(begun) > 1:
            for x in shortest:
                if any(p[sure] != x for p, _ in begun):
                    break
                sure += 1
        else:
            sure = len(shortest)
        new = (shortest[sure - 1] if sure else last, tuple((p[sure:], b) for p, b in begun))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, shortest[:sure]

    def simulate(self, state: int, rest: bytes) -> list[int]:
        """Runs all hypotheses of a state side by side to the end, without new states."""
        last, hypotheses = self.states[state]
        head = max((b for _, b in hypotheses), key=len)
        text, known = head + rest, len(head)
        before = {known - len(b): p for p, b in hypotheses}
        tokens = {at: p[-1] if p else last for at, p in before.items()}
        back: dict[int, int] = {}
        starts, ranks, compatible, longest = sorted(before), self.ranks, self.compatible, self.longest
        for end in range(known + 1, len(text) + 1):
            if end - starts[0] > longest:
                starts = [x for x in starts if end - x <= longest]
            for start in starts:
                t = ranks.get(text[start:end])
                if t is not None and compatible(tokens[start], t):
                    tokens[end], back[end] = t, start
                    starts.append(end)
                    break
        out, at = [], len(text)
        while at in back:
            out.append(tokens[at])
            at = back[at]
        return [*before[at], *out[::-1]]

    def encode(self, piece: bytes) -> list[int]:
        """A move is determinised when it has been asked for ASKED times."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > MAX_MOVES:
            self.reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            step = moves.get(key)
            if step is None:
                times = self.asked.get(key, 0)
                if times < ASKED:
                    if len(self.asked) > MAX_MOVES:
                        self.asked.clear()
                    self.asked[key] = times + 1
                    return out + self.simulate(state, piece[i:])
                step = moves[key] = self.move(state, piece[i : i + 1])
            state = step[0]
            if step[1]:
                out += step[1]
        out += next(p for p, b in self.states[state][1] if not b)
        return out


class Utf8Machine:
    """Feeds bytes, gives complete characters: the state is how many bytes the last character
    still needs and what it has. Bytes that cannot be UTF-8 become U+FFFD."""

    #: Bytes that follow a first byte, by the first byte's upper five bits.
    FOLLOW = [0] * 24 + [1] * 4 + [2] * 2 + [3] + [0]

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                keep = back if self.FOLLOW[byte >> 3] >= back else 0
                break
        done, self.held = (data[:-keep], data[-keep:]) if keep else (data, b"")
        return done.decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.transducer = Transducer(self.ranks)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.token[i] = b
        self.decimal = [b"%d" % i for i in range(len(self.token))]
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.young: dict[bytes, list[int]] = {}
        self.old: dict[bytes, list[int]] = {}

    def part(self, data: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(data.decode("utf-8", "replace")):
            out += self.transducer.encode(piece.encode())
        return out

    def lookup(self, chunk: bytes) -> list[int]:
        """Not in the young part of the cache: the old part or the transducer."""
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.part(chunk)
        if len(self.young) >= MAX_CACHED:
            self.old, self.young = self.young, {}
        self.young[chunk] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> Iterator[list[int]]:
        """The ids of each text of a block; null is the empty text."""
        data, off = tv.text_bytes(texts)
        raw = data.tobytes()
        places = cuts(data, off)
        first = np.searchsorted(places, off)
        for d, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if _WIDE_SPACE.search(raw, lo, hi):
                yield self.part(raw[lo:hi])
                continue
            ends = places[first[d] : first[d + 1]].tolist()
            out: list[int] = []
            for at in [*ends, hi]:
                chunk = raw[lo:at]
                ids = self.young.get(chunk)
                out += self.lookup(chunk) if ids is None else ids
                lo = at
            yield out

    def encode(self, text: bytes) -> list[int]:
        return next(self.encode_all(pa.array([text], pa.binary())))

    def decode(self, ids: Iterable[int], portion: int = 4096) -> Iterator[str]:
        machine, ids = Utf8Machine(), iter(ids)
        while part := list(islice(ids, portion)):
            yield machine.feed(b"".join(map(self.token.__getitem__, part)))
        yield machine.end()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids array<int> of each row."""
    vocabulary, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value, pattern)
        for batch in tv.blocks(batches):
            rows = []
            for got in c.encode_all(batch.column("text")):
                shown = hashlib.sha256(b" ".join(map(c.decimal.__getitem__, got))).hexdigest()
                back = hashlib.sha256()
                for part in c.decode(got):
                    back.update(part.encode())
                rows.append((len(got), shown, back.hexdigest(), got if ids else None))
            n, shown, back, lists = zip(*rows)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(shown), pa.array(back)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids array<int>; null ids give the empty text."""
    vocabulary, pattern = _vocabulary(tokens.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary.value, pattern)
        for batch in batches:
            texts = ["".join(c.decode(x or [])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
