"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base kinds are found by pattern and check (see PATTERNS). High-recall generators propose further,
overlapping spans: words with a digit and numbers with separators. A candidate has format and
context features of a few values each, so all candidates of a corpus fall into at most
prod(SIZES) cells. Cells are counted over all rows with a distant label: the span overlaps a
checked base span, or its name stands before it (a secret's before a word, a contact's or an
account's before a number); no feature tells what a label rests on: those names are no cue of
theirs, and checks of base spans are not repeated. Boosted regression trees are fitted to the
cells' weighted counts. Only candidates outside base spans can be added, so only they calibrate:
their scores are pooled where adjacent ones violate the order, and the threshold of each generator
is the smallest score of a pool whose share of named ones, with half a named one among one more
candidate added to it, reaches `precision`. That rule holds at every size; at 0.95 it takes nine
named candidates without another. The trees become one SQL expression. Selected candidates that overlap no base span are added as
kind secret or number; where two overlap, secret goes first.

Positions are code points, end exclusive. Null or empty text: no spans. Null doc_id and repeated
rows: a row each. Without candidates of both labels nothing is added."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

# The base patterns by kind, with loops that never give back (nothing that follows
# could use it) and starts only where a leftmost match can start, so that they stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+",
    "number": r"(?<![0-9+(])[+(]?[0-9][\x20().0-9-]{5,}[0-9]",
}
#: A cheap test that must hold before a pattern is run at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "secret": r"[0-9][A-Za-z0-9_-]{5}|[A-Za-z0-9_-]{5}[0-9]", "number": r"[0-9][\x20().0-9-]{5}"}
SECRET_NAMES = r"(?i)(?:token|secret|password|passwd|api_?key|access_?key|credential)\W{0,4}$"
CUES = r"(?i)(?:tel|phone|call|fax|mobile|contact|card|account|iban|ssn|host|server|address|mail)\W{0,4}$"
KINDS = ["email", "ip", "card", "phone", "secret", "number"]
FEATURES = ["generator", "size", "digits", "hex", "parts", "opens", "cue", "assigned", "quoted"]
SIZES = [2, 4, 5, 2, 3, 2, 2, 2, 2]
PRECISION, ROUNDS, RATE, DEPTH = 0.95, 24, 0.3, 3
_SPAN = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a pattern with their places: those before are the lengths of what the pattern
    splits the text into, and of the matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value")))
    placed = F.aggregate(
        between,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("at"),
            F.array_append(acc["spans"], F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("end"), m["value"].alias("value"))).cast(_SPAN).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), placed).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, back.substr(i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), back.substr(i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _described(text: Column, span: Column, generator: int) -> Column:
    """A candidate with its features, numbered 0..SIZES[i]-1."""
    value = span["value"]
    length, digits = F.char_length(value), F.length(_digits(value))
    before = F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(F.lit(24), span["start"]))
    step = lambda x, *limits: sum(((x >= n).cast("int") for n in limits), F.lit(0))
    features = [
        F.lit(generator),
        step(length, 16, 20, 28) if generator == 0 else step(digits, 9, 12, 16),
        F.floor(4 * digits / length).cast("int"),
        F.rlike(value, F.lit("^[0-9a-f]+$")).cast("int"),
        F.least(F.lit(2), F.size(F.regexp_extract_all(value, F.lit(r"[\x20()._-]+"), F.lit(0)))),
        F.rlike(value, F.lit(r"^[+(]")).cast("int"),
        F.rlike(before, F.lit(CUES)).cast("int") if generator == 0 else F.lit(0),
        F.rlike(before, F.lit(r"[=:]\s?[\x22\x27]?$")).cast("int"),
        F.rlike(before, F.lit(r"[\x22\x27]$")).cast("int"),
    ]
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.lit(list(GENERATORS)[generator]).alias("kind"),
        F.struct(*(x.cast("int").alias(n) for n, x in zip(FEATURES, features))).alias("f"), F.rlike(before, F.lit((SECRET_NAMES, CUES)[generator])).alias("named"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """docs with base (checked spans with their kind) and proposed (described candidates)."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns({f"_{k}": found(F.col("text"), k, p) for k, p in (PATTERNS | GENERATORS).items()})

    def checked(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda s: _passes(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def described(generator: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: _described(F.col("text"), s, generator))

    base = F.concat(*map(checked, PATTERNS))
    proposed = F.concat(*(described(g, k) for g, k in enumerate(GENERATORS)))
    out = out.withColumn("base", base).withColumn("proposed", proposed)
    return out.drop(*(f"_{k}" for k in PATTERNS | GENERATORS))


def _boost(cells: list[tuple[tuple[int, ...], float, float]]) -> list[tuple]:
    """Trees over weighted cells (features, positives, negatives): nested (feature, limit, at most,
    above) with values as leaves."""
    score = [0.0] * len(cells)
    trees = []

    def grow(rows: list[int], depth: int):
        g = sum(pull[i] for i in rows)
        h = sum(weight[i] for i in rows)
        best = (1e-6, None)
        if depth:
            for f, size in enumerate(SIZES):
                for limit in range(size - 1):
                    left = [i for i in rows if cells[i][0][f] <= limit]
                    if 0 < len(left) < len(rows):
                        gl, hl = sum(pull[i] for i in left), sum(weight[i] for i in left)
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if gain > best[0]:
                            best = (gain, (f, limit, left))
        if best[1] is None:
            value = RATE * g / (h + 1)
            for i in rows:
                score[i] += value
            return value
        f, limit, left = best[1]
        inside = set(left)
        return f, limit, grow(left, depth - 1), grow([i for i in rows if i not in inside], depth - 1)

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        pull = [pos * (1 - q) - neg * q for q, (_, pos, neg) in zip(p, cells)]
        weight = [(pos + neg) * q * (1 - q) for q, (_, pos, neg) in zip(p, cells)]
        trees.append(grow(list(range(len(cells))), DEPTH))
    return trees


def _value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if features[f] <= limit else high
    return tree


def _threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """The smallest score whose calibrated share of positives reaches precision, infinite if none."""
    pools: list[list[float]] = []
    for s, pos, neg in sorted(x for x in scored if x[1] + x[2]):
        pools.append([s, pos, neg])
        while len(pools) > 1 and pools[-2][1] * sum(pools[-1][1:]) >= pools[-1][1] * sum(pools[-2][1:]):
            s0, p0, n0 = pools.pop(-2)
            pools[-1] = [s0, pools[-1][1] + p0, pools[-1][2] + n0]
    return min((s for s, pos, neg in pools if pos + 0.5 >= precision * (pos + neg + 1)), default=math.inf)


def train(proposed: DataFrame, precision: float = PRECISION) -> tuple[list, list[float]]:
    """(trees, threshold of each generator) from rows with base and proposed. What reaches the
    driver is a count of each cell, at most prod(SIZES)."""
    one = proposed.select("base", F.explode("proposed").alias("c"))
    over, named = _overlaps(F.col("c"), F.col("base")), F.col("c.named")
    count = lambda what, name: F.count_if(what).cast("double").alias(name)
    counted = one.groupBy(*(F.col(f"c.f.{n}").alias(n) for n in FEATURES)).agg(count(named | over, "pos"), count(~(named | over), "neg"), count(named & ~over, "free_pos"), count(~named & ~over, "free_neg"))
    rows = sorted((tuple(r[n] for n in FEATURES), r["pos"], r["neg"], r["free_pos"], r["free_neg"]) for r in counted.collect())
    cells = [r[:3] for r in rows]
    if not any(c[1] for c in cells) or not any(c[2] for c in cells):
        return [], [math.inf] * len(GENERATORS)
    trees = _boost(cells)
    scored = [(r[0][0], sum(_value(t, r[0]) for t in trees), r[3], r[4]) for r in rows]
    return trees, [_threshold([x[1:] for x in scored if x[0] == g], precision) for g in range(len(GENERATORS))]


def _expression(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, limit, low, high = tree
    return F.when(f[FEATURES[feature]] <= limit, _expression(low, f)).otherwise(_expression(high, f))


def select_spans(proposed: DataFrame, model: tuple[list, list[float]]) -> DataFrame:
    """Adds spans: base spans and the candidates that the model selects, by kind and start."""
    trees, thresholds = model
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    if all(map(math.isinf, thresholds)):
        return proposed.withColumn("spans", F.col("base"))
    score = lambda c: sum((_expression(t, c["f"]) for t in trees), F.lit(0.0))

    def chosen(kind: str, limit: float) -> Column:
        if math.isinf(limit):
            return F.filter("base", lambda s: F.lit(False))
        good = F.filter("proposed", lambda c: (c["kind"] == kind) & (score(c) >= limit - 1e-9) & ~_overlaps(c, F.col("base")))
        return F.transform(good, plain)

    out = proposed.withColumns({f"_{kind}": chosen(kind, limit) for kind, limit in zip(GENERATORS, thresholds)})
    numbers = F.filter("_number", lambda c: ~_overlaps(c, F.col("_secret")))
    return out.withColumn("spans", F.concat("base", "_secret", numbers)).drop("_secret", "_number")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of docs."""
    proposed = keep(candidates(docs.select("doc_id", "text")).drop("text"), "pii")
    out = select_spans(proposed, train(proposed, precision))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs with [KIND] in place of every span in text; of overlapping spans the first to start
    names the whole. A null text stays null."""
    # a row goes along as one value, so that no column of it can clash
    held = docs.select(F.struct("*").alias("_row"), "text")
    proposed = keep(candidates(held), "redact")  # found once, for the training and for the texts
    out = select_spans(proposed, train(proposed, precision))
    spans = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("text")
    redacted = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["done"]).otherwise(F.concat(acc["done"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("done"),
        ),
        lambda acc: F.concat(acc["done"], text.substr(acc["at"] + 1, F.char_length(text))),
    )
    changed = F.when(F.size("spans") > 0, redacted).otherwise(F.col("_row.text"))
    return out.select(F.col("_row").withField("text", changed).alias("_row")).select("_row.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
