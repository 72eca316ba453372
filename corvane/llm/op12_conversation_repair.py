"""Repair of conversations: the cheapest edits (keep, change the role, delete, insert) that make the
roles of a conversation's turns, by their first letters, read `(s?(ua)+)?`, with turns that are
blank or repeated deleted and turns that break off paid for.

Every turn is a 4x4 matrix over the states of that expression (nothing yet, after s, after u, after
a). An element is (cost, audit): the cheapest edits from one state to another and their letters,
the ASCII-least among equals; the turn's matrix holds the closure over inserts before it. The
matrices are multiplied as a tree: inside a block of at most 4096 turns with the letters
themselves, above that with the rank of an element's letters among those of its node. As inserts
stand before turns, all audits of a node have the same number of turns and end with one, so that
none is a prefix of another and ranks order them as letters would; a node takes 32 numbers however
long the conversation. On the way down every block gets the states it begins and ends in.

Turns are sorted once over all partitions, so a conversation of any length spreads over tasks. Only
the digest of a conversation's whole text is made in order, by one task that streams it.

Nulls count as one space, except that a null turn sorts first and has no number, and that a null
conv_id names a conversation of its own. Ties of turn are ordered by role and text in code points;
equal rows are interchangeable. An empty role has no initial and cannot be kept. Repeated rows are
duplicates. Empty tables give no rows. Columns other than conv_id, turn, role and text are not read."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, keep

#: Bits of a place inside a block and inside a sorted partition, which is the next level of the tree; bits that a level above takes together.
BLOCK_BITS, PARTITION_BITS, FAN_BITS = 12, 33, 10
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after a role's initial (1 s, 2 u, 3 a) from each state.
AFTER = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: State after one insert, and how many inserts make a state an end.
INSERTED, CLOSING = {0: 2, 1: 2, 2: 3, 3: 2}, {0: 0, 1: 2, 2: 1, 3: 0}
LEGAL = {(1, 2), (2, 3), (3, 2)}
Element = tuple[int, str] | None


def _turn(kind: int) -> list[Element]:
    """The matrix of one turn. kind: 0 has to go; else 1 + 2 * initial + whether it breaks off."""
    out: list[Element] = [None] * 16

    def offer(i: int, j: int, cost: int, audit: str) -> None:
        if out[4 * i + j] is None or (cost, audit) < out[4 * i + j]:
            out[4 * i + j] = (cost, audit)

    for i in range(4):
        at, cost, audit = i, 0, ""
        for _ in range(3):  # a third insert leads back to a state that one has reached
            offer(i, at, cost + DELETE, audit + "D")
            if kind:
                initial, extra = (kind - 1) // 2, TRUNCATED * ((kind - 1) % 2)
                if (at, initial) in AFTER:
                    offer(i, AFTER[at, initial], cost + KEEP + extra, audit + "K")
                for new in (2, 3):
                    if (at, new) in AFTER:
                        offer(i, AFTER[at, new], cost + REROLE + extra, audit + "R")
            at, cost, audit = INSERTED[at], cost + INSERT, audit + "I"
    return out


TURNS = [_turn(kind) for kind in range(9)]


def times(a: list[Element], b: list[Element]) -> list[Element]:
    """The product over (min, +) of (cost, audit)."""
    out: list[Element] = []
    for i in range(4):
        for j in range(4):
            found = [(x[0] + y[0], x[1] + y[1]) for k in range(4) if (x := a[4 * i + k]) and (y := b[4 * k + j])]
            out.append(min(found, default=None))
    return out


def product(kinds: bytes) -> list[Element]:
    """The product of the turns' matrices, halves first; short ones recur and are remembered."""
    return _short(kinds) if len(kinds) <= 16 else times(product(kinds[: len(kinds) // 2]), product(kinds[len(kinds) // 2 :]))


@functools.lru_cache(1 << 16)
def _short(kinds: bytes) -> list[Element]:
    return TURNS[kinds[0]] if len(kinds) == 1 else times(product(kinds[: len(kinds) // 2]), product(kinds[len(kinds) // 2 :]))


def ranked(elements: list) -> tuple[list[int], list[int]]:
    """(costs, ranks) of elements, -1 where there is none; equal audits have equal ranks."""
    order = {audit: k for k, audit in enumerate(sorted({x[1] for x in elements if x}))}
    return [x[0] if x else -1 for x in elements], [order[x[1]] if x else -1 for x in elements]


@functools.lru_cache(1 << 16)
def _short_ranked(kinds: bytes) -> tuple[list[int], list[int]]:
    return ranked(product(kinds))


def node(kinds: bytes) -> tuple[list[int], list[int]]:
    return _short_ranked(kinds) if len(kinds) <= 16 else ranked(product(kinds))


def merged(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The product of two nodes, whose audits are ranks."""
    (ac, ar), (bc, br) = a, b
    out = []
    for i in range(4):
        for j in range(4):
            found = [(ac[4 * i + k] + bc[4 * k + j], (ar[4 * i + k], br[4 * k + j])) for k in range(4) if ac[4 * i + k] >= 0 and bc[4 * k + j] >= 0]
            out.append(min(found, default=None))
    return ranked(out)


def route(nodes: list[tuple[list[int], list[int]]], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states that each of the nodes begins and ends in on the least way from entry to exit_."""
    best, back = {entry: (0, 0)}, []
    for cost, rank in nodes:
        found, came = {}, {}
        for i, (c, r) in best.items():
            for j in range(4):
                if cost[4 * i + j] >= 0:
                    way = (c + cost[4 * i + j], (r, rank[4 * i + j]))
                    if j not in found or way < found[j]:
                        found[j], came[j] = way, i
        order = {x: k for k, x in enumerate(sorted({x[1] for x in found.values()}))}
        best = {j: (x[0], order[x[1]]) for j, x in found.items()}
        back.append(came)
    out = []
    for came in reversed(back):
        out.append((came[exit_], exit_))
        exit_ = came[exit_]
    return out[::-1]


def ending(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """(cost, state) of the least way from nothing to an end, with the inserts that close it."""
    ways = [(cost[j] + INSERT * CLOSING[j], rank[j], j) for j in range(4) if cost[j] >= 0]
    total, _, j = min(ways)
    return total, j


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with damage at places known by the CRC-32 of `<conv_id>:<turn>` modulo 20: 0 is
    dropped, 1 loses its text, 2 its marks [.!?], 3 comes twice, 4 becomes the user's."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def in_order(turns: DataFrame, block_bits: int) -> DataFrame:
    """The turns sorted over all partitions, with their place and block."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("any", F.monotonically_increasing_id())  # equal rows go to several partitions too
    by = ["conv_id", "turn", "role", "text", "any"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("any").withColumn("pos", F.monotonically_increasing_id())
    end = F.rtrim("text", F.lit(SPACES))
    return placed.select("*", F.shiftright("pos", block_bits).alias("block"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))


SEGMENT = (
    "conv_id bigint, g bigint, n bigint, kinds binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int, low bigint, high bigint, turns bigint, cost array<int>, rank array<int>"
)
NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
ARROW = pa.schema([(n, pa.list_(pa.int32()) if n in ("cost", "rank") else pa.binary() if n == "kinds" else pa.int32() if n in ("head", "tail") else pa.int64()) for n in NAMES])


def _segments(block: tuple, table: pa.Table) -> pa.Table:
    """A block's turns -> the parts of conversations in it. Rows with mark tell the places where a role
    and text come first."""
    rows = table.sort_by("pos")
    marks = set(rows.filter(pc.field("mark"))["pos"].to_pylist())
    rows = rows.filter(~pc.field("mark"))
    conv, turn, pos, initial, blank, cut = (rows[c].to_pylist() for c in ("conv_id", "turn", "pos", "initial", "blank", "cut"))
    out, first = [], 0
    for last in range(1, len(conv) + 1):
        if last < len(conv) and conv[last] == conv[first]:
            continue
        here = range(first, last)
        again = [not blank[k] and pos[k] not in marks for k in here]
        broken = [not blank[k] and not a and cut[k] for k, a in zip(here, again)]
        kinds = bytes(0 if blank[k] or a else 1 + 2 * initial[k] + b for k, a, b in zip(here, again, broken))
        known = [t for t in turn[first:last] if t is not None]
        illegal = sum((initial[k - 1], initial[k]) not in LEGAL for k in range(first + 1, last))
        out.append((conv[first], block[0].as_py(), last - first, kinds, sum(blank[first:last]), sum(again), sum(broken), illegal, initial[first], initial[last - 1], min(known, default=None), max(known, default=None), len(set(known)), *node(kinds)))
        first = last
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), ARROW.types)] if out else [pa.array([], t) for t in ARROW.types], schema=ARROW)


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring parts of a conversation as one."""
    cost, rank = merged((a["cost"], a["rank"]), (b["cost"], b["rank"]))
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    lows, highs = ([x[k] for x in (a, b) if x[k] is not None] for k in ("low", "high"))
    return out | {
        "conv_id": a["conv_id"], "g": a["g"], "kinds": None, "head": a["head"], "tail": b["tail"], "cost": cost, "rank": rank,
        "illegal": a["illegal"] + b["illegal"] + ((a["tail"], b["head"]) not in LEGAL), "low": min(lows, default=None), "high": max(highs, default=None),
        "turns": a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"]),
    }


def _merge(shift: int):
    def run(table: pa.Table) -> pa.Table:
        whole = functools.reduce(joined, table.select(NAMES).sort_by("g").to_pylist())
        return pa.Table.from_pylist([whole | {"g": whole["g"] >> shift}], ARROW)

    return run


def _descend(table: pa.Table) -> pa.Table:
    rows = table.sort_by("g").to_pylist()
    ways = route([(r["cost"], r["rank"]) for r in rows], rows[0]["entry"], rows[0]["exit"])
    return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "g": pa.array([r["g"] for r in rows], pa.int64()), "entry": pa.array([w[0] for w in ways], pa.int32()), "exit": pa.array([w[1] for w in ways], pa.int32())})


def _same(a: str, b: str) -> object:
    return F.expr(f"{a}.conv_id <=> {b}.conv_id")


class Repair:
    """The cheapest repair of turns(conv_id, turn, role, text). stats: a row a conversation; edits():
    what happens in every block; digests() and turns(): the repaired conversations."""

    def __init__(self, turns: DataFrame, block_bits: int = BLOCK_BITS):
        rows = self.rows = keep(in_order(turns, block_bits), "turns")
        text = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        first = rows.where("NOT blank").groupBy("conv_id", text.alias("text")).agg(F.min("pos").alias("pos"))
        initial = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in zip("sua", (1, 2, 3)) for x in p)), F.left("role", F.lit(1))), F.lit(0))
        slim = rows.select("block", "pos", "conv_id", "turn", initial.alias("initial"), "blank", "cut", F.lit(False).alias("mark"))
        marks = first.select(F.shiftright("pos", block_bits).alias("block"), "pos", F.lit(True).alias("mark"))
        self.segments = keep(slim.unionByName(marks, allowMissingColumns=True).groupBy("block").applyInArrow(_segments, SEGMENT), "segments")
        self._climb(PARTITION_BITS - block_bits)

    def _climb(self, shift: int) -> None:
        """Up the tree until every conversation is one node, and down again."""
        spread = self.segments.groupBy("conv_id").count().where("count > 1")
        one = self.segments.alias("s").join(spread.alias("c"), _same("s", "c"), "left_anti")
        now = keep(self.segments.alias("s").join(spread.alias("c"), _same("s", "c"), "left_semi"), "nodes")
        levels = []
        while not now.groupBy("conv_id").count().where("count > 1").isEmpty():
            levels.append((now, shift))
            now = keep(now.groupBy("conv_id", F.shiftright("g", shift).alias("up")).applyInArrow(_merge(shift), SEGMENT), "nodes")
            shift = FAN_BITS
        end = F.udf(lambda cost, rank: ending(cost, rank), "cost bigint, exit int")
        roots = one.unionByName(now).withColumn("end", end("cost", "rank"))
        gaps = F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).alias("gaps")
        self.stats = keep(roots.select("conv_id", "n", gaps, "blank", "duplicate", "truncated", "illegal", F.col("end.cost").alias("cost"), F.col("end.exit").alias("exit"), "g"), "stats")
        state = self.stats.alias("r").join(now.alias("n"), F.expr("r.conv_id <=> n.conv_id"), "left_semi").select("conv_id", "g", F.lit(0).alias("entry"), "exit")
        for nodes, shift in reversed(levels):
            up = state.select(F.col("conv_id").alias("of"), F.col("g").alias("up"), "entry", "exit")
            below = nodes.withColumn("up_", F.shiftright("g", shift)).join(up, F.expr("conv_id <=> of AND up_ = up"))
            state = keep(below.groupBy("conv_id", "up").applyInArrow(_descend, "conv_id bigint, g bigint, entry int, exit int"), "states")
        single = one.alias("s").join(self.stats.alias("r"), _same("s", "r")).select("s.conv_id", "s.g", F.lit(0).alias("entry"), "r.exit", "s.kinds")
        several = self.segments.alias("s").join(state.alias("r"), F.expr("s.conv_id <=> r.conv_id AND s.g = r.g")).select("s.conv_id", "s.g", "r.entry", "r.exit", "s.kinds")
        self.states = single.unionByName(several) if levels else single
        discard(*(nodes for nodes, _ in levels))

    def edits(self) -> DataFrame:
        """(conv_id, block, entry, audit): the edits of each part of a conversation."""
        audit = F.udf(lambda kinds, i, j: product(bytes(kinds))[4 * i + j][1], "string")
        return self.states.select("conv_id", F.col("g").alias("block"), "entry", audit("kinds", "entry", "exit").alias("audit"))

    def _replay(self, near: list[str], kept: bool, schema: str) -> DataFrame:
        told = self.edits().select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), "entry", "audit")
        rows = self.rows.select("conv_id", "block", "pos", "turn", "role", "text")
        return told.unionByName(rows, allowMissingColumns=True).repartition(*near).sortWithinPartitions("conv_id", "block", "pos").mapInArrow(_replayed(kept), schema)

    def turns(self) -> DataFrame:
        """(conv_id, pos, step, turn, role, text, edit): the repaired conversations' turns without the
        inserts that close a conversation, which have no turn after them; ordered by pos and step."""
        return self._replay(["block"], True, "conv_id bigint, pos bigint, step int, turn bigint, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """(conv_id, audit, repaired_sha256): one task streams each conversation."""
        return self._replay(["conv_id"], False, "conv_id bigint, audit string, repaired_sha256 string")


def _replayed(kept: bool):
    """The edits carried out on turns in order; a part's edits come before its turns."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        audit, at, state = "", 0, 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "pos", "entry", "audit", "turn", "role", "text")]
            for conv, pos, entry, told, turn, role, text in zip(*columns):
                if pos < 0:
                    audit, at, state = told, 0, entry
                    yield conv, None, None, None, None, told, state
                    continue
                step = 0
                while audit[at] == "I":
                    yield conv, pos, step, None, ("assistant" if state == 2 else "user"), "", "I"
                    state, at, step = INSERTED[state], at + 1, step + 1
                if audit[at] != "D":
                    new = role if audit[at] == "K" else "assistant" if state == 2 else "user"
                    state = AFTER[state, "sua".index(new[0]) + 1]
                    yield conv, pos, step, turn, new, text, audit[at]
                at += 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("step", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        held = []
        for x in steps(batches):
            if x[1] is not None:
                held.append(x)
            if len(held) == 2000:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                held = []
        if held:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> None:
            for _ in range(CLOSING[state]):
                audits.append("I")
                add("assistant" if len(last) and last[0] == "u" else "user", "")
            held.append((now, "".join(audits), digest.hexdigest()))

        def add(role: str, text: str) -> None:
            nonlocal last, some
            digest.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
            last, some = role, True

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in held], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])

        open_, now, audits, digest, last, some, state = False, None, [], None, "", False, 0
        for conv, pos, _, _, role, text, edit in steps(batches):
            if pos is None:
                if not open_ or conv != now:
                    if open_:
                        close()
                        if len(held) >= 2000:
                            yield out()
                            held.clear()
                    open_, now, audits, digest, last, some, state = True, conv, [], hashlib.sha256(), "", False, 0
                audits.append(text)
                continue
            add(role, text)
            state = AFTER[state, "sua".index(role[0]) + 1]
        if open_:
            close()
        if held:
            yield out()

    return rows if kept else digests


def repaired(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """A row a conversation: faults, the cost and letters of its cheapest edits, and the SHA-256 of the
    repaired `role:text`, joined by newlines."""
    repair = Repair(turns, block_bits)
    both = repair.stats.alias("s").join(repair.digests().alias("d"), _same("s", "d"))
    return both.select("s.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repaired(damaged(turns)).alias("r")
    all_ = turns.select("conv_id").distinct().alias("c").join(found, _same("c", "r"), "left")
    zero = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select("c.conv_id", *zero, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same by dynamic programming over turns and states; the texts go along, so this is for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: CAST(unicode(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) % 20 AS d FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE d <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial FROM damaged),
told AS (
  SELECT *, shown = '' AS blank, shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(shown, 1) NOT IN ('.', '!', '?') AS cut,
    coalesce((lag(initial) OVER (PARTITION BY conv_id ORDER BY i), initial) NOT IN ((1, 2), (2, 3), (3, 2)) AND i > 1, false) AS illegal FROM ordered),
faults AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM told GROUP BY conv_id),
after AS (SELECT * FROM (VALUES (0, 1, 1), (0, 2, 2), (1, 2, 2), (2, 3, 3), (3, 2, 2)) v(s1, r, s2)),
moves AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (0, 1, 2, 'I', ['user:']), (0, 2, 3, 'II', ['user:', 'assistant:']), (1, 0, 1, '', []), (1, 1, 2, 'I', ['user:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
  (2, 0, 2, '', []), (2, 1, 3, 'I', ['assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']), (3, 0, 3, '', []), (3, 1, 2, 'I', ['user:']), (3, 2, 3, 'II', ['user:', 'assistant:'])) v(s, t, s1, ia, it)),
options AS (
  SELECT conv_id, i, s1, s1 AS s2, 2 AS price, 'D' AS letter, []::VARCHAR[] AS said FROM told, (SELECT unnest(range(4)) AS s1)
  UNION ALL SELECT conv_id, i, s1, s2, CASE WHEN cut THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM told JOIN after ON r = initial WHERE NOT blank AND NOT again
  UNION ALL SELECT conv_id, i, s1, s2, CASE WHEN cut THEN 6 ELSE 1 END, 'R', [CASE r WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] FROM told, after WHERE r > 1 AND NOT blank AND NOT again),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS s, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS x FROM faults
  UNION ALL
  SELECT o.conv_id, o.i, o.s2::BIGINT, min({'c': (x.c + 5 * t + price)::BIGINT, 'a': x.a || ia || letter, 't': list_concat(list_concat(x.t, it), said)})
  FROM dp JOIN moves m ON m.s = dp.s JOIN options o ON o.conv_id IS NOT DISTINCT FROM dp.conv_id AND o.i = dp.i + 1 AND o.s1 = m.s1 GROUP BY o.conv_id, o.i, o.s2),
ends AS (
  SELECT f.conv_id, min({'c': x.c + 5 * len(e.ea), 'a': x.a || e.ea, 't': list_concat(x.t, e.et)}) AS x
  FROM faults f JOIN dp ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND dp.i = f.n JOIN (VALUES (0, '', []), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) e(s, ea, et) ON e.s = dp.s GROUP BY f.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
