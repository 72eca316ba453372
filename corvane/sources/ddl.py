"""Tables and indexes out of DDL texts, and the length of an index's key. A text is scanned once for
the parentheses that belong together and the commas between its items, past comments and quotes; what
takes two texts, an index and its table, is a join."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_width

LIMIT, UNKNOWN = 200, 8

PART = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'?|"(?:[^"]|"")*"?|`[^`]*`?|[(),;]|[^\s(),;'"`/-]+|[/-]""", re.S)
# Words that begin an item of a table which is no column, and that end a column's type.
NO_COLUMN = frozenset("constraint primary unique foreign check exclude like key index fulltext spatial".split())
AFTER_TYPE = frozenset("not null default primary unique references check constraint generated collate comment auto_increment on as".split())
FOUND = "kind string, name string, table_name string, at int, column_name string, data_type string"


def _bare(name: str) -> str:
    """A name without quotes and schema."""
    return re.sub(r'["`]', "", name).rpartition(".")[2]


def parsed(text: str) -> list[tuple]:
    """(kind, name, table, place, column, type): the columns of CREATE TABLE and of CREATE INDEX."""
    words = [m[0] for m in PART.finditer(text) if not m[0].startswith(("--", "/*"))]
    low = [w.lower() for w in words]
    out, k = [], 0
    while k < len(words):
        if low[k] != "create":
            k += 1
            continue
        stop = next((j for j in range(k, len(words)) if words[j] in ("(", ";")), len(words))
        head = low[k:stop]
        kind = "table" if "table" in head else "index" if "index" in head else None
        if kind is None or stop == len(words) or words[stop] == ";":
            k = max(stop, k + 1)
            continue
        named = [w for w in words[k + head.index(kind) + 1 : stop] if w.lower() not in ("if", "not", "exists", "concurrently", "only")]
        names: list[str] = []
        for w in named:
            if names and (names[-1].endswith(".") or w.startswith(".")):
                names[-1] += w
            elif w.lower() not in ("on", "using"):
                names.append(w)
        table = names[-1] if kind == "table" and names else names[1] if len(names) > 1 else ""
        depth, items, now = 1, [], []
        k = stop + 1
        while k < len(words) and depth:
            w = words[k]
            depth += (w == "(") - (w == ")")
            if not depth or depth == 1 and w == ",":
                items.append(now)
                now = []
            else:
                now.append(w)
            k += 1
        place = 0
        for item in [*items, now] if depth else items:
            if not item or kind == "table" and item[0].lower() in NO_COLUMN:
                continue
            place += 1
            end = next((j for j, w in enumerate(item) if j and w.lower() in AFTER_TYPE and "(" not in _open(item[:j])), len(item))
            shown = re.sub(r"\s*([(),])\s*", r"\1", " ".join(item[1:end])) if kind == "table" else None
            out.append((kind, _bare(names[0]) if names else "", _bare(table), place, _bare(item[0]), shown))
    return out


def _open(words: list[str]) -> list[str]:
    """The parentheses that are still open after the words."""
    left: list[str] = []
    for w in words:
        if w == "(":
            left.append(w)
        elif w == ")" and left:
            left.pop()
    return left


def columns(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, kind, name, table_name, at, column_name, data_type): a row a column that a CREATE TABLE
    declares or a CREATE INDEX names. Texts that are null or declare neither give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            found = [(k, x) for k, t in enumerate(batch.column(1).to_pylist()) for x in parsed(t or "")]
            ids = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[j] for _, x in found], t) for j, t in enumerate(types))], [id_, *(c.split()[0] for c in FOUND.split(", "))])

    rows = texts.select(id_, text)
    return rows.mapInArrow(run, f"{id_} {dict(rows.dtypes)[id_]}, {FOUND}")


def key_lengths(indexes: DataFrame, tables: DataFrame, id_: str) -> DataFrame:
    """(id, table_name, breakdown, key_length, exceeds): the key of each index over a known table, by
    the declared widths of its columns; columns that the table lacks count 8. Names meet in lower
    case. Both are rows of columns()."""
    lower = lambda c: F.lower(c)
    declared = tables.where("kind = 'table'").groupBy(lower("table_name").alias("t"), lower("column_name").alias("c")).agg(F.min("data_type").alias("data_type"))
    known = declared.select("t").distinct()
    named = indexes.where("kind = 'index'").select(id_, "table_name", "at", "column_name", lower("table_name").alias("t"), lower("column_name").alias("c"))
    both = named.join(known, "t", "left_semi").join(declared, ["t", "c"], "left")
    width = F.coalesce(F.when(F.col("data_type").isNotNull(), key_width("data_type")), F.lit(UNKNOWN))
    keys = both.withColumn("w", width).groupBy(id_, "table_name").agg(F.array_sort(F.collect_list(F.struct("at", "column_name", "w"))).alias("parts"), F.sum("w").cast("long").alias("key_length"))
    shown = F.array_join(F.transform("parts", lambda x: F.concat(x["column_name"], F.lit("("), x["w"].cast("string"), F.lit(")"))), " + ")
    return keys.select(id_, "table_name", shown.alias("breakdown"), "key_length", (F.col("key_length") > LIMIT).alias("exceeds"))


def guarded(warning: Column | str, lengths: str = "exceeds", breakdown: str = "breakdown", total: str = "key_length") -> Column:
    """A suggestion's warning with what is said where its key is too long."""
    # The words of the warning.
    said = F.concat(F.lit("⚠️ 该 DDL 新建索引键长 = "), F.col(breakdown), F.lit(" = "), F.col(total).cast("string"), F.lit(f" > {LIMIT}，不建议执行"))
    old = F.col(warning) if isinstance(warning, str) else warning
    return F.when(F.col(lengths), F.concat_ws(" | ", old, said)).otherwise(old)
