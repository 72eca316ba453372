"""Columns that statements compare for equality, by their table: names and aliases of FROM and JOIN are
read scope by scope, so that a subquery's alias means its own table first and the outer ones then."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import top_per

TOKEN = re.compile(r"""--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*'?|[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*|"[^"]*"|[#$]\{[^}]*\}|<>|!=|<=|>=|\|\||[^\s]""", re.S)
NAME = re.compile(r"[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)*")
# Words of SQL that end a table's alias or are no column.
RESERVED = frozenset(
    "select from where and or not in is null on using join inner left right full outer cross natural group order by having limit offset union all intersect except set values update delete insert into as case when then else end "
    "between like exists distinct for asc desc lateral with".split()
)
FROM_WORDS = frozenset(("from", "join", "update", "into"))


def equalities(sql: str) -> list[tuple[str, str]]:
    """Distinct (table, column), in lower case, of columns beside = or before IN in conditions; a
    column without a qualifier belongs to the scope's only table, else to none."""
    words = [m[0] for m in TOKEN.finditer(sql) if not m[0].startswith(("--", "/*"))]
    low = [w.lower() for w in words]
    new = lambda up: {"names": {}, "tables": [], "clause": "", "found": [], "opens": 0, "up": up}
    scopes = [new(None)]
    every = [*scopes]
    k = 0
    while k < len(words):
        w, scope = low[k], scopes[-1]
        if w == "(":
            if k + 1 < len(words) and low[k + 1] in ("select", "with"):
                scopes.append(new(scope))
                every.append(scopes[-1])
            else:
                scope["opens"] += 1
        elif w == ")":
            if scope["opens"]:
                scope["opens"] -= 1
            elif len(scopes) > 1:
                scopes.pop()
                scope = scopes[-1]
                if scope["clause"] in FROM_WORDS:  # a derived table's alias is no table
                    k += 1 if k + 1 < len(words) and low[k + 1] == "as" else 0
                    if k + 1 < len(words) and NAME.fullmatch(words[k + 1]) and low[k + 1] not in RESERVED:
                        scope["names"][low[k + 1]] = None
                        scope["tables"].append(None)
                        k += 1
        elif w in FROM_WORDS or w == "," and scope["clause"] == "from" and not scope["opens"]:
            scope["clause"] = "from" if w in (",", "from") else w
            if k + 1 < len(words) and (NAME.fullmatch(words[k + 1]) or words[k + 1].startswith('"')) and low[k + 1] not in RESERVED:
                table = low[k + 1].strip('"').rpartition(".")[2]
                scope["tables"].append(table)
                scope["names"][table] = table
                k += 1
                if k + 1 < len(words) and low[k + 1] == "as":
                    k += 1
                if k + 1 < len(words) and NAME.fullmatch(words[k + 1]) and low[k + 1] not in RESERVED:
                    scope["names"][low[k + 1]] = table
                    k += 1
        elif w in ("union", "intersect", "except") and not scope["opens"]:
            scopes[-1] = new(scope["up"])
            every.append(scopes[-1])
        elif w in ("where", "on", "having", "set", "select", "group", "order", "values"):
            scope["clause"] = w
        elif w == "=" and scope["clause"] in ("where", "on", "having"):
            for j in (k - 1, k + 1):
                called = j + 1 < len(words) and words[j + 1] == "("
                if 0 <= j < len(words) and NAME.fullmatch(words[j]) and low[j] not in RESERVED and not called:
                    scope["found"].append(low[j])
        elif w == "in" and scope["clause"] in ("where", "on", "having") and NAME.fullmatch(words[k - 1]) and low[k - 1] not in RESERVED:
            scope["found"].append(low[k - 1])
        k += 1
    out: list[tuple[str, str]] = []
    for scope in every:  # a subquery can stand before the FROM whose aliases it uses
        for name in scope["found"]:
            qualifier, _, column = name.rpartition(".")
            qualifier, at = qualifier.rpartition(".")[2], scope
            if qualifier:
                while at and qualifier not in at["names"]:
                    at = at["up"]
                table = at["names"][qualifier] if at else None
            else:
                table = scope["tables"][0] if len(scope["tables"]) == 1 else None
            if table and (table, column) not in out:
                out.append((table, column))
    return out


def predicates(rows: DataFrame, id_: str, sql: str) -> DataFrame:
    """(id, table_name, fields): for each statement and table the sorted columns that it compares for
    equality; a table without any has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, x) for k, t in enumerate(batch.column(1).to_pylist()) for x in equalities(t or "")]
            ids = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for _, x in found], pa.string()), pa.array([x[1] for _, x in found], pa.string())], [id_, "table_name", "field"])

    two = rows.select(id_, sql)
    one = two.mapInArrow(run, f"{id_} {dict(two.dtypes)[id_]}, table_name string, field string")
    return one.groupBy(id_, "table_name").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def access_patterns(rated: DataFrame, found: DataFrame, id_: str, top: int = 10) -> DataFrame:
    """(table_name, rank, fields, n, ratings): of every table the `top` commonest sets of compared
    columns, equals by their names, with how many statements of each rating have them; rated(id,
    rating), where a null rating is UNKNOWN. Rows are counted by rating first, then by set."""
    by_rating = found.join(rated.select(id_, F.coalesce("rating", F.lit("UNKNOWN")).alias("rating")), id_).groupBy("table_name", "fields", "rating").agg(F.count("*").alias("k"))
    sets = by_rating.groupBy("table_name", "fields").agg(F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "rating", F.col("k").cast("string")))), ",").alias("ratings"))
    return top_per(sets, ["table_name"], top, F.desc("n"), F.col("fields")).select("table_name", "rank", "fields", "n", "ratings")
