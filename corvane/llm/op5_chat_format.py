"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines by Viterbi,
then turns are rendered in one canonical form.

A state is a role together with whether the line is the first of its turn. A line is observed as
one of CELLS cells: kind of speaker marker, length, how it begins, whether it asks. Emissions,
starts, continuations and role changes are counted over all labelled turns and smoothed; scores
are whole numbers, so sums don't depend on how they are grouped.

Turns are sorted over range partitions and packed into blocks of at most BLOCK turns. A
conversation inside one block is decoded there. One over several blocks, however long, is cut:
each block becomes a max-plus matrix from its entry state to its exit state, neighbouring matrices
are multiplied in levels until few are left, and on the way back down every block gets its entry
and exit state and is decoded between them. No task holds more than 1 << FAN_BITS matrices of a
conversation.

Starts and role changes are counted along that order, so turns may begin anywhere and have gaps.

Null or empty text: an empty line. Null turn: before all others. Null conv_id: a conversation
like any other. Ties and repeated rows: ordered by text, each kept. Null or unknown roles: never
counted and never right. Without labelled turns all states are equally likely a priori, but
markers still decide. Empty tables: no rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import partitions
from ..session import keep

ROLES = ["system", "user", "assistant"]
BLOCK, BLOCK_CHARS, SCALE, PRIOR, FAN_BITS = 256, 1 << 20, 1000, 200.0, 8
STATES = 2 * len(ROLES)  # 2 * role: first line of a turn; 2 * role + 1: a later line
CELLS = 4 * 4 * 3 * 2

# Speaker markers at the beginning of a line, by role.
MARKERS = {
    "system": ["System:", "SYSTEM:", "### System:", "<|system|>", "[SYS]"],
    "user": ["User:", "Human:", "### Instruction:", "<|user|>", "Q:", "[INST]"],
    "assistant": ["Assistant:", "AI:", "Bot:", "### Response:", "<|assistant|>", "A:", "[/INST]"],
}
_MARKER = re.compile(r"\s*(?:" + "|".join(f"(?P<{role}>{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})" for role, names in MARKERS.items()) + r")[ \t]*")

BLOCKS = "conv_id long, at long, open boolean, texts array<string>, roles array<string>"
PIECES = "conv_id long, piece long, n_turns long, n_lines long, n_right long, n_known long, lines_crc long, rendered string"


def observe(line: str) -> tuple[int, int]:
    """(cell, end of the marker) of a line."""
    found = _MARKER.match(line)
    end = found.end() if found else 0
    marker = 1 + ROLES.index(found.lastgroup) if found else 0
    rest = line[end:].rstrip()
    size = 0 if not rest else 1 if len(rest) < 40 else 2 if len(rest) < 200 else 3
    begin = 2 if rest[:1].isupper() else 1 if rest[:1].islower() else 0
    return ((marker * 4 + size) * 3 + begin) * 2 + rest.endswith("?"), end


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Model:
    """Scores: start[state], change[state, next state], emit[state, cell]."""

    start: np.ndarray
    change: np.ndarray
    emit: np.ndarray

    @staticmethod
    def of(emit: np.ndarray, starts: np.ndarray, turns: np.ndarray) -> Model:
        """From counts: emit[state, cell], starts[role], turns[role, next role]."""
        n = len(ROLES)
        prior = np.full((STATES, CELLS), 0.1)
        for role in range(n):
            block = slice((1 + role) * CELLS // 4, (2 + role) * CELLS // 4)
            prior[2 * role, block] += PRIOR / (CELLS // 4)
            prior[1::2, : CELLS // 4] += PRIOR / (CELLS // 4) / n
        score = lambda x: np.round(SCALE * np.log(x)).astype(np.int64)
        e = emit + prior
        first, later = emit[0::2].sum(axis=1) + 1, emit[1::2].sum(axis=1) + 1
        stay, to = later / (first + later), (turns + 1) / (turns + 1).sum(axis=1, keepdims=True)
        change = np.full((STATES, STATES), 1e-12)
        for role in range(n):
            change[2 * role : 2 * role + 2, 2 * role + 1] = stay[role]
            change[2 * role : 2 * role + 2, 0::2] = (1 - stay[role]) * to[role]
        start = np.full(STATES, 1e-12)
        start[0::2] = (starts + 1) / (starts + 1).sum()
        return Model(score(start), score(change), score(e / e.sum(axis=1, keepdims=True)))

    def matrix(self, cells: np.ndarray, first: bool) -> np.ndarray:
        """Best score of the cells by (state before them, last state); at the beginning of a
        conversation each row is the same."""
        best = np.where(np.eye(STATES, dtype=bool), 0, -(1 << 50))
        for k, cell in enumerate(cells.tolist()):
            step = np.broadcast_to(self.start, (STATES, STATES)) if first and not k else (best[:, :, None] + self.change).max(axis=1)
            best = step + self.emit[:, cell]
        return best

    def decode(self, cells: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """The best states of the cells; before: the state that they follow (None: they begin the
        conversation); last: the state in which they must end."""
        back = np.zeros((len(cells), STATES), np.int64)
        score = self.start if before is None else self.change[before]
        for k, cell in enumerate(cells.tolist()):
            if k:
                step = score[:, None] + self.change
                back[k] = step.argmax(axis=0)
                score = step[back[k], np.arange(STATES)]
            score = score + self.emit[:, cell]
        out = np.zeros(len(cells), np.int64)
        state = int(score.argmax()) if last is None else last
        for k in range(len(cells) - 1, -1, -1):
            out[k] = state
            state = back[k, state]
        return out


def train(blocks: DataFrame) -> Model:
    """Counts over all turns of blocks with known roles: what reaches the driver is one row a state
    and cell, one a role, and one a pair of roles."""
    n = len(ROLES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, pairs = np.zeros((STATES, CELLS), np.int64), np.zeros((n, n), np.int64)
        for batch in batches:
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                known = [ROLES.index(r) if r in ROLES else None for r in roles]
                for role, text in zip(known, texts):
                    for k, line in enumerate(_lines(text) if role is not None else ()):
                        cells[2 * role + (k > 0), observe(line)[0]] += 1
                for a, b in zip(known, known[1:]):
                    if a is not None and b is not None:
                        pairs[a, b] += 1
        for kind, table in (("emit", cells), ("pair", pairs)):
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(a), pa.string()), "a": pa.array(a), "b": pa.array(b), "n": pa.array(table[a, b])})

    counted = blocks.select("roles", "texts").mapInArrow(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    emit, starts, pairs = np.zeros((STATES, CELLS)), np.zeros(n), np.zeros((n, n))
    for r in counted.collect():
        (emit if r["kind"] == "emit" else pairs)[r["a"], r["b"]] += r["n"]
    # a block's first turn follows the block before it, or begins the conversation
    along = Window.partitionBy("conv_id").orderBy("at")
    ends = blocks.select("conv_id", "at", F.element_at("roles", 1).alias("role"), F.element_at("roles", -1).alias("last"))
    edges = ends.select(F.lag("at").over(along).isNull().alias("begins"), F.lag("last").over(along).alias("before"), "role")
    for r in edges.where(F.col("role").isin(ROLES)).groupBy("begins", "before", "role").agg(F.count("*").alias("n")).where(F.col("begins") | F.col("before").isin(ROLES)).collect():
        if r["begins"]:
            starts[ROLES.index(r["role"])] += r["n"]
        else:
            pairs[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["n"]
    return Model.of(emit, starts, pairs)


def pack_turns(turns: DataFrame) -> DataFrame:
    """BLOCKS of turns(conv_id, turn, text[, role]): turns in order; a block is open unless its conversation lies inside it."""
    known = F.col("role") if "role" in turns.columns else F.lit(None)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("text", F.lit("")).alias("text"), known.cast("string").alias("role"))
    parts = partitions(rows)
    order = ["conv_id", "turn", "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held, conv, chars, first, cut, fresh = [], None, 0, True, False, True
        ready: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal held, chars, at
            ready.append((conv, at, not whole, [x for x, _ in held], [y for _, y in held]))
            held, chars, at = [], 0, at + 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
            out = pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*ready), kinds)], [x.split()[0] for x in BLOCKS.split(", ")])
            ready.clear()
            return out

        size = 0
        for batch in batches:
            for c, text, role in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("role").to_pylist()):
                if fresh:
                    conv, fresh = c, False
                elif c != conv:
                    close(not first and not cut)
                    conv, first, cut = c, False, False
                elif len(held) >= BLOCK or chars > BLOCK_CHARS:
                    cut = True
                    close(False)
                held.append((text, role))
                chars += len(text)
                size += len(text)
                if size > 1 << 22 and ready:
                    yield flush()
                    size = 0
        if held:
            close(False)
        if ready:
            yield flush()

    return keep(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "text", "role").mapInArrow(pack, BLOCKS), "chat-blocks")


def render(texts: list[str], states: np.ndarray, ends: list[int], first: bool, last: bool) -> str:
    """Canonical turns of lines with their states: <|im_start|>role, content, <|im_end|>."""
    out = []
    for k, (line, state) in enumerate(zip(texts, states.tolist())):
        if state % 2 == 0 or (first and not k):
            if k or not first:
                out.append("<|im_end|>\n")
            out.append(f"<|im_start|>{ROLES[state // 2]}\n{line[ends[k]:]}")
        else:
            out.append("\n" + line)
    return "".join(out) + ("<|im_end|>\n" if last and texts else "")


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _best_way(outer: np.ndarray | None, inner: np.ndarray, before: int | None, last: int | None) -> list[int]:
    """The last state of each of a row of matrices, on the best way from the state before (None: the
    first begins the conversation, with scores outer) to the state last (None: any)."""
    score, back = outer if before is None else inner[0][before], []
    for m in inner[1:]:
        step = score[:, None] + m
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    ends = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    return ends[::-1]


_NODE, _FOUND = "conv_id long, at long, inner array<long>, outer array<long>", "conv_id long, at long, before int, last int"


def _matrices(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by("at")
    inner, outer = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("inner", "outer"))
    return table, inner.reshape(-1, STATES, STATES), outer.reshape(-1, STATES)


def _placed(table: pa.Table, ends: list[int], before: int | None) -> pa.Table:
    return pa.table({"conv_id": table.column("conv_id"), "at": table.column("at"), "before": pa.array([before, *ends[:-1]], pa.int32()), "last": pa.array(ends, pa.int32())})


def entry_states(nodes: DataFrame, level: int = 1) -> DataFrame:
    """_FOUND: the states before and at the end of each node of _NODE, whose at is its order."""

    def whole(table: pa.Table) -> pa.Table:
        table, inner, outer = _matrices(table)
        return _placed(table, _best_way(outer[0], inner, None, None), None)

    def product(table: pa.Table) -> pa.Table:
        table, inner, outer = _matrices(table)
        total, first = inner[0], outer[0]
        for m in inner[1:]:
            total, first = _times(total, m), (first[:, None] + m).max(axis=0)
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "at": table.column("at").slice(0, 1), "inner": pa.array([total.ravel().tolist()], pa.list_(pa.int64())), "outer": pa.array([first.tolist()], pa.list_(pa.int64()))})

    def inside(table: pa.Table, parent: pa.Table) -> pa.Table:
        table, inner, outer = _matrices(table)
        before, last = parent.column("before")[0].as_py(), parent.column("last")[0].as_py()
        return _placed(table, _best_way(outer[0], inner, before, last), before)

    most = nodes.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= 1 << FAN_BITS or FAN_BITS * level > 62:
        return nodes.groupBy("conv_id").applyInArrow(whole, _FOUND)
    group = F.shiftright("at", FAN_BITS * level).alias("group")
    parents = keep(nodes.groupBy("conv_id", group).applyInArrow(product, _NODE), "matrices")
    found = entry_states(parents, level + 1)
    return nodes.groupBy("conv_id", group).cogroup(found.groupBy("conv_id", group)).applyInArrow(inside, _FOUND)


def parse_transcripts(blocks: DataFrame, model: Model) -> DataFrame:
    """PIECES of blocks: the rendered pieces of a conversation, in the order of piece, are the
    whole; roles only count how many lines are right."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def cells_of(texts: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
        lines = [x for t in texts for x in _lines(t)]
        seen = [observe(x) for x in lines]
        return lines, np.array([c for c, _ in seen], np.int64), [e for _, e in seen]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, at = batch.column("conv_id"), batch.column("at")
            seen = [cells_of(t)[1] for t in batch.column("texts").to_pylist()]
            inner = [shared.value.matrix(c, False).ravel().tolist() for c in seen]
            outer = [shared.value.matrix(c, True)[0].tolist() for c in seen]
            yield pa.RecordBatch.from_arrays([conv, at, pa.array(inner, pa.list_(pa.int64())), pa.array(outer, pa.list_(pa.int64()))], ["conv_id", "at", "inner", "outer"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines, cells, ends = cells_of(r["texts"])
                states = model.decode(cells, r["before"], r["last"])
                known = [role for t, role in zip(r["texts"], r["roles"]) for _ in _lines(t)]
                got = [ROLES[s // 2] for s in states.tolist()]
                right = sum(a == b for a, b in zip(got, known))
                crc = sum(zlib.crc32(f"{g}:{s % 2}:{line}".encode()) for g, s, line in zip(got, states.tolist(), lines))
                begins = int((states % 2 == 0).sum()) + (r["before"] is None and bool(len(states)) and int(states[0] % 2))
                rows.append((r["conv_id"], r["piece"], begins, len(lines), right, sum(k in ROLES for k in known), crc, render(lines, states, ends, r["before"] is None, r["ends"])))
            kinds = [pa.int64()] * 7 + [pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    whole = blocks.where("not open").selectExpr("conv_id", "1L as piece", "texts", "roles", "cast(null as int) before", "cast(null as int) last", "true ends")
    open_ = blocks.where("open")
    nodes = keep(open_.select("conv_id", "at", "texts").mapInArrow(matrices, _NODE), "matrices")
    along = Window.partitionBy("conv_id").orderBy("at")
    order = nodes.select("at", F.row_number().over(along).cast("long").alias("piece"), F.lead("at").over(along).isNull().alias("ends"))
    cut = open_.join(entry_states(nodes).select("at", "before", "last"), "at").join(order, "at").select(whole.columns)
    return whole.unionByName(cut).mapInArrow(decode, PIECES)


def held_out(conv_id: str = "conv_id") -> Column:
    """Every third conversation, by a hash, is kept from the training."""
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: one marker style a conversation, and every fourth turn
    or so, by a hash, without its marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))

    def marker(role: str) -> Column:
        return F.element_at(F.array(*map(F.lit, MARKERS[role][:5])), (style + 1).cast("int"))

    named = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0, "")
    for role in ROLES:
        named = named.when(F.col("role") == role, F.concat(marker(role), F.lit(" ")))
    return conversations.select("conv_id", "turn", "role", F.concat(named.otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece of a conversation: rendered, and how many of its lines have the right role."""
    blocks = pack_turns(transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return parse_transcripts(blocks, train(blocks.where(~held_out()))).withColumn("held_out", held_out())
