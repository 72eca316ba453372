"""Parsers of source files, metadata, logs and plans as Column expressions and windows. Where a
format nests, XPath or a regular expression finds the parts and posexplode makes rows of them."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalar import renamed
from ..operators.windows import best, carried

MAX_KB = 500


def java_files(spark: SparkSession, roots: list[str], max_kb: int = MAX_KB, glob: str = "*.java") -> DataFrame:
    """path, content of Java files outside tests; content is null where a file is too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    return raw.where(java_path("path")).select("path", F.when(F.col("length") <= max_kb * 1024, F.decode("content", "UTF-8")).alias("content"))


def java_path(path: str) -> Column:
    p = F.col(path)
    return ~p.contains("/test/") & (p.contains("/src/main/java/") | p.contains("/target/gen/"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a CSV file: quoted line breaks, trimmed cells, missing ones empty, no byte-order mark."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in raw.columns))


def raw_cell(cells: list[str]) -> Column:
    """The third cell, else the first that has an arrow and bracket, else all that aren't blank."""
    all_ = F.array(*cells)
    third = F.when(F.trim(F.coalesce(F.get(all_, F.lit(2)), F.lit(""))) != "", F.get(all_, F.lit(2)))
    arrow = F.get(F.filter(all_, lambda x: x.contains("->[")), F.lit(0))
    return F.coalesce(third, arrow, F.array_join(F.filter(all_, lambda x: F.trim(x) != ""), " "))


def call_kind(scope: Column, name: Column) -> Column:
    """Kind of a call by the text before its name, in order of precedence."""
    # Methods of Object.
    of_object = name.isin("equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone")
    blank = F.coalesce(scope, F.lit("")) == ""
    return (
        F.when(blank & ~of_object, "SELF_CALLS").when(blank, F.lit(None))
        .when(F.rlike(scope, F.lit(r"^SysUtil\.getInstance\(\w+\.class\)$")), "SYS_UTIL_CALLS")
        .when(F.rlike(scope, F.lit(r"(^|\.)\w*Dao$")), "DAO_CALLS").otherwise("CALLS")
    )


def _root(xml: str | None, strict: bool = False) -> tuple[str, dict, list] | None:
    """The root (tag, attributes that aren't blank, trimmed, and children) of an XML text; None if it
    is broken. strict: attributes as they stand, and a DOCTYPE counts as broken."""
    top: tuple[str, dict, list] = ("", {}, [])
    open_ = [top]

    def start(tag: str, attributes: dict) -> None:
        element = (tag, attributes if strict else {k: v.strip() for k, v in attributes.items() if v.strip()}, [])
        open_[-1][2].append(element)
        open_.append(element)

    def refuse(*_) -> None:
        raise ValueError("DOCTYPE")

    parser = expat.ParserCreate()
    if strict:
        parser.StartDoctypeDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler = start, lambda tag: open_.pop()
    try:
        parser.Parse(xml or "", True)
    except (expat.ExpatError, ValueError):
        return None
    return top[2][0]


def _flow(xml: str | None) -> tuple[str | None, list[tuple], list[tuple]]:
    """(tx, nodes, edges) of a flow file; tx is None where the root isn't a flowtran with an id."""
    root = _root(xml)
    if root is None or root[0] != "flowtran" or "id" not in root[1]:
        return None, [], []
    tx, nodes, edges = root[1]["id"], [], {}
    text = lambda x: "null" if x is None else x  # as the reference joins its keys

    def node(key: str, kind: str, attributes: dict, order: int | None) -> str:
        nodes.append((tx, key, kind, *(attributes.get(c) for c in ("id", "longname", "test", "method", "serviceName")), order))
        return key

    def named(tag: str, order: int, attributes: dict) -> str:
        return f"{tag}:{order}:{text(attributes.get('id'))}"

    flow = next((x for x in root[2] if x[0] == "flow"), None)
    if flow is not None:
        key = node(f"TX:{tx}:FLOW", "flow", flow[1], None)
        edges[("HAS_FLOW", f"TX:{tx}", key)] = None
        # containers still to be walked: (parent's key, its edge to steps, element)
        todo = [(key, "HAS_STEP", flow)]
        while todo:
            parent, relation, container = todo.pop()
            before, order = None, 0
            for child in container[2]:
                tag, attributes, _ = child
                if tag not in ("method", "service", "case"):
                    todo.append((parent, relation, child))  # transparent: its steps are the parent's, in an order of their own
                    continue
                order += 1
                key = node(f"TX:{tx}:{named(tag.upper(), order, attributes)}", tag, attributes, order)
                edges[(relation, parent, key)] = None
                if tag == "service":
                    name = attributes.get("serviceName")
                    kind, dot, operation = (name or "").partition(".")
                    edges[("CALLS_SERVICE", key, f"SVOP:{text(kind if dot else name)}.{text(operation if dot else attributes.get('id'))}")] = None
                elif tag == "case":
                    for k, when in enumerate((x for x in child[2] if x[0] == "when"), 1):
                        branch = node(f"{key}:{named('WHEN', k, when[1])}", "when", when[1], k)
                        edges[("HAS_BRANCH", key, branch)] = None
                        todo.append((branch, "EXECUTES", when))
                if before:
                    edges[("NEXT", before, key)] = None
                before = key
    return tx, nodes, [(tx, *e) for e in edges]


def _flows(flows: DataFrame, part: int, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for xml in batch.column(0).to_pylist() for x in _flow(xml)[part]]
            kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    return flows.select("xml").mapInArrow(run, schema)


def flow_nodes(flows: DataFrame) -> DataFrame:
    """Flows, methods, services, cases and whens of flow files(xml) with their keys; ord counts the
    steps of one element, or the branches of a case. Broken files and other roots give nothing."""
    return _flows(flows, 1, "tx string, key string, kind string, id string, longname string, test string, method string, service_name string, ord long")


def flow_edges(flows: DataFrame) -> DataFrame:
    """Distinct (tx, edge, src, dst) of flow files(xml): HAS_FLOW, HAS_STEP, HAS_BRANCH from a case,
    EXECUTES from a when, CALLS_SERVICE, and NEXT between steps that follow each other in one element.
    Elements of other names pass their steps to their parent; NEXT neither enters nor leaves them."""
    return _flows(flows, 2, "tx string, edge string, src string, dst string").distinct()


@F.pandas_udf(StringType())
def flow_tx(xml: pd.Series) -> pd.Series:
    """The id of a flowtran root, else null."""
    roots = xml.map(_root)
    return roots.map(lambda x: x[1].get("id") if x and x[0] == "flowtran" else None)


def flow_steps(flows: DataFrame) -> DataFrame:
    """(tx, pos, step) of the simplified <flow> files of op_src05_flow_edges: steps at any depth, in
    the order of the file. Real files: flow_nodes and flow_edges."""
    step = F.posexplode(F.xpath("xml", F.lit("//step/@id"))).alias("pos", "step")
    return flows.select(F.xpath_string("xml", F.lit("/flow/@id")).alias("tx"), step)


def next_edges(steps: DataFrame) -> DataFrame:
    after = F.lead("step").over(Window.partitionBy("tx").orderBy("pos"))
    return steps.select("tx", F.col("step").alias("src"), after.alias("dst")).where("dst IS NOT NULL")


_TABLES = "seq long, pos long, path string, table_id string, longname string, package_path string, schema_id string, outer_class_fqn string, dao_class string"


def schema_tables(files: DataFrame) -> DataFrame:
    """Tables (_TABLES) of files(seq, path, xml) whose root is a schema with id and package; pos
    counts them within a file. Broken files give nothing."""
    names = [c.split()[0] for c in _TABLES.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in _TABLES.split(", ")]

    def tables(row: dict) -> Iterator[tuple]:
        tag, attributes, children = _root(row["xml"]) or ("", {}, [])
        schema, package = attributes.get("id"), next((attributes[c] for c in ("package", "packagePath", "package_name") if c in attributes), None)
        if tag.lower() != "schema" or not schema or not package:
            return
        found = [x[1] for x in children if x[0].lower() == "table" and "id" in x[1]]
        for pos, x in enumerate(found):
            t = x["id"]
            yield row["seq"], pos, row["path"], t, x.get("longname", x.get("name", t)), package, schema, f"{package}.{schema}", f"{t[0].upper() if len(t[0].upper()) == 1 else t[0]}{t[1:]}Dao"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for row in batch.to_pylist() for x in tables(row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    return files.select(F.col("seq").cast("long").alias("seq"), "path", "xml").mapInArrow(run, _TABLES)


def first_tables(tables: DataFrame, key: str) -> DataFrame:
    """The first seen table of each dao_class or table_id."""
    return best(tables, [key], F.asc("seq"), F.asc("path"), F.asc("pos"))


@F.pandas_udf(StringType())
def root_id(xml: pd.Series) -> pd.Series:
    """The id of a file's root (<sqls id>, <schema id>), null where it is missing, empty or broken."""
    roots = xml.map(lambda x: _root(x, strict=True))
    return roots.map(lambda x: x[1].get("id") or None if x else None)


def schema_id(xml: str, path: str) -> Column:
    """The id of a schema file's root, else the file's name before .tables.xml."""
    name = F.regexp_extract(path, r"([^/\\]*)\.tables\.xml$", 1)
    return F.coalesce(root_id(xml), F.when(F.col(path).endswith(".tables.xml"), name))


def looked_up(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """module for names(name): by the id of index(id, module, seq) as it stands, else in lower case;
    the last scanned counts."""
    last = lambda key: index.groupBy(key.alias("_id")).agg(F.max_by("module", "seq").alias("_m"))
    exact, lower = last(F.col("id")), last(F.lower("id")).select(F.col("_id").alias("_low"), F.col("_m").alias("_n"))
    joined = names.join(exact, F.col(name) == F.col("_id"), "left").join(lower, F.lower(name) == F.col("_low"), "left")
    return joined.withColumn("module", F.coalesce("_m", "_n")).drop("_id", "_m", "_low", "_n")


def inferred_fqn(path: str) -> Column:
    """Full name of the class of a large Java file, by its path."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    after = lambda marker: F.nullif(F.regexp_extract(p, f"^.*?/{marker}/(.*)\\.java$", 1), F.lit(""))
    return F.replace(F.coalesce(*map(after, ("src/main/java", "target/gen", "generated-sources"))), F.lit("/"), F.lit("."))


def first_seen(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    return best(df, key, F.asc(seq))


def last_put(df: DataFrame, key: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """(last row of each key, keys with several modules)."""
    return best(df, key, F.desc(seq)), df.groupBy(*key).agg(F.count_distinct("module").alias("n_modules")).where("n_modules > 1")


def merged_definitions(df: DataFrame) -> DataFrame:
    """(id, title, path, impl) over rows(id, seq, priority, title, path, impl): the last title that
    isn't blank, the path of the highest priority (the later of equals), the first impl."""
    when = lambda c, order: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(*order, F.col(c).alias("v")))
    return df.groupBy("id").agg(
        F.max(when("title", [F.col("seq")]))["v"].alias("title"), F.max(when("path", [F.col("priority"), F.col("seq")]))["v"].alias("path"),
        F.min(when("impl", [F.col("seq")]))["v"].alias("impl"),
    )


def key_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(oid, name, n) of primary keys(oid, indkey text): names in order; an expression (position 0
    or less) or an unknown column makes the key invalid."""
    parts = indexes.select("oid", F.posexplode(F.split(F.trim("indkey"), r"\s+")).alias("pos", "n")).withColumn("attnum", F.col("n").cast("int"))
    named = parts.join(columns, ["oid", "attnum"], "left")
    one = named.groupBy("oid").agg(F.bool_and((F.col("attnum") > 0) & F.col("attname").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "attname"))).alias("c"))
    return one.where("ok").select("oid", F.array_join(F.transform("c", lambda x: x["attname"]), ",").alias("names"), F.size("c").alias("n"))


def index_columns(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """(oid, names) of indexes with <expr> and <unknown#n> where a position has no column."""
    parts = indexes.select("oid", F.posexplode(F.split(F.trim("indkey"), r"\s+")).alias("pos", "n")).withColumn("attnum", F.col("n").cast("int"))
    shown = F.coalesce("attname", F.when(F.col("attnum") <= 0, "<expr>").otherwise(F.concat(F.lit("<unknown#"), F.col("n"), F.lit(">"))))
    named = parts.join(columns, ["oid", "attnum"], "left").withColumn("shown", shown)
    return named.groupBy("oid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), ",").alias("names"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct, null_frac, top_frac) in one pass over counts by value."""
    total = df.agg(F.count("*").alias("total"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    by_value = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    out = by_value.groupBy("column_name").agg(F.count("v").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"))
    return out.join(F.broadcast(total)).select("column_name", "n_distinct", (F.col("nulls") / F.col("total")).alias("null_frac"), (F.col("top") / F.col("total")).alias("top_frac"))  # one row


def git_numstat(lines: DataFrame) -> DataFrame:
    """(repo, path, email, adds, dels, commits) of log lines(repo, line_no, line): a header
    'hash|email' holds for the lines after it; binary files count no lines. Shortened as the SQL of
    op_src18_git_log is; git_history does the whole job."""
    header = F.rlike("line", F.lit(r"^[0-9a-f]+\|"))
    head = F.struct(F.lower(F.substring_index("line", "|", -1)).alias("email"), F.substring_index("line", "|", 1).alias("commit"))
    along = carried(lines.withColumn("h", F.when(header, head)), "h", ["repo"], "line_no").where(~header).select("repo", "line", "h.*")
    parts = F.split("line", "\t")
    count = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("long"), F.lit(0))
    return along.groupBy("repo", F.get(parts, F.lit(2)).alias("path"), "email").agg(F.sum(count(0)).alias("adds"), F.sum(count(1)).alias("dels"), F.count_distinct("commit").alias("commits"))


def git_history(lines: DataFrame) -> DataFrame:
    """(repo, path, email, author_name, adds, dels, commits, first_epoch, last_epoch) of lines(repo,
    line_no, line) of log --no-merges --numstat: a header '>>>COMMIT hash name email epoch', split by
    tabs, holds for the lines after it. Lines whose counts aren't whole numbers (binary files) and
    lines before the first header are skipped, renamed files have their new path, commits counts
    the lines and author_name is the first in the log."""
    cells, marker = F.split("line", "\t", -1), F.col("line").startswith(">>>COMMIT\t")
    epoch = F.trim(F.get(cells, F.lit(4)))
    header = F.struct(F.get(cells, F.lit(2)).alias("name"), F.get(cells, F.lit(3)).alias("email"), F.when(F.rlike(epoch, F.lit(r"^[+-]?\d+$")), epoch.try_cast("long")).alias("epoch"))
    along = carried(lines.withColumn("h", F.when(marker & (F.size(cells) >= 5), header)), "h", ["repo"], "line_no").where(~marker & F.col("h").isNotNull())
    parts = F.split("line", "\t", 3)
    count = lambda k: F.when(F.rlike(F.trim(F.get(parts, F.lit(k))), F.lit(r"^[+-]?\d+$")), F.trim(F.get(parts, F.lit(k))).try_cast("int"))
    whole = along.select("repo", "line_no", "h.*", count(0).alias("a"), count(1).alias("d"), F.trim(renamed(F.trim(F.get(parts, F.lit(2))))).alias("path")).where("a IS NOT NULL AND d IS NOT NULL AND path IS NOT NULL")
    return whole.groupBy("repo", "path", "email").agg(F.min_by("name", "line_no").alias("author_name"), F.sum("a").alias("adds"), F.sum("d").alias("dels"), F.count("*").alias("commits"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def git_blame(lines: DataFrame) -> DataFrame:
    """(repo, path, email, owned_lines) of incremental blame lines(repo, line_no, line): 'hash start
    result n' begins a block, author-mail and filename lines describe it."""
    head = F.regexp_extract("line", r"^[0-9a-f]{6,} \d+ \d+ (\d+)$", 1)
    marked = lines.withColumn("block", F.when(head != "", F.col("line_no"))).withColumn("n", F.when(head != "", head.try_cast("long")))
    within = carried(marked, "block", ["repo"], "line_no").where("block IS NOT NULL")
    value = lambda name: F.max(F.when(F.col("line").startswith(f"{name} "), F.substring_index("line", f"{name} ", -1)))
    one = within.groupBy("repo", "block").agg(F.max("n").alias("n"), F.lower(F.translate(value("author-mail"), "<>", "")).alias("email"), value("filename").alias("path"))
    return one.groupBy("repo", "path", "email").agg(F.sum("n").alias("owned_lines"))


def service_kind(path: Column | str) -> Column:
    """Kind by the suffix of a service type's file."""
    return F.regexp_extract(path, r"\.(pbs|pcs|pbcb|pbcp|pbcc|pbct|serviceType)\.xml$", 1)


def metadata_roots(paths: DataFrame) -> DataFrame:
    """One root a module: the smallest path outside target that ends at the resources folder."""
    root = F.regexp_extract("path", r"^(.*/src/main/resources)/", 1)
    found = paths.where(~F.col("path").contains("/target/")).withColumn("root", root).where("root <> ''")
    return found.groupBy(F.regexp_extract("root", r"([^/]+)/src/main/resources$", 1).alias("module")).agg(F.min("root").alias("root"))


def cached_operations(types: DataFrame, operations: DataFrame) -> DataFrame:
    """(key, name): type.operation for each operation, the type alone where it has none."""
    joined = types.join(operations, "type_id", "left")
    return joined.select(F.concat_ws(".", "type_id", "op_id").alias("key"), F.coalesce("op_name", "type_name").alias("name"))


def masked(sql: Column | str) -> Column:
    """The statement with literals and comments blanked."""
    text = F.col(sql) if isinstance(sql, str) else sql
    return F.regexp_replace(F.regexp_replace(text, r"--[^\n]*|(?s)/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")


def parameter_columns(sql: Column | str) -> Column:
    """Columns that the ? of a statement are compared with, in order, comma-joined."""
    found = F.regexp_extract_all(masked(sql), F.lit(r"(?i)([a-z_]\w*)\s*(?:=|<>|<=|>=|<|>|\blike\b|\bin\s*\(|\bbetween\b)\s*\?"), F.lit(1))
    return F.array_join(found, ",")


def filled(sql: Column | str, literal: str) -> Column:
    """? outside literals and comments replaced by a literal: the text is split at what must stay,
    and only the parts between are changed."""
    text = F.col(sql) if isinstance(sql, str) else sql
    keep = r"(?s)'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/"
    between = F.transform(F.split(text, keep, -1), lambda x: F.replace(x, F.lit("?"), F.lit(literal)))
    kept = F.regexp_extract_all(text, F.lit(keep), F.lit(0))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), kept.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")


def plan_facts(plan: Column | str) -> Column:
    """Facts of a plan tree as JSON text: node types at any depth, tables, and whether it scans in
    sequence, sorts or joins."""
    text = F.col(plan) if isinstance(plan, str) else plan
    nodes = F.regexp_extract_all(text, F.lit(r'"Node Type"\s*:\s*"([^"]+)"'), F.lit(1))
    tables = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"Relation Name"\s*:\s*"([^"]+)"'), F.lit(1))))
    has = lambda part: F.exists(nodes, lambda x: x.contains(part))
    return F.struct(F.array_join(nodes, ",").alias("nodes"), F.array_join(tables, ",").alias("tables"), has("Seq Scan").alias("seq_scan"), has("Index").alias("index_scan"), has("Sort").alias("sorts"), (has("Join") | has("Nested Loop")).alias("joins"))


def plan_result(plan: Column | str) -> Column:
    """All facts of a plan as JSON text, of the first of a list: names in the order of the tree, each
    once. ok is false for what isn't a plan; never says that the top node's filter is always false."""
    text = F.col(plan) if isinstance(plan, str) else plan
    top = F.coalesce(F.get_json_object(text, "$[0]['Plan']"), F.get_json_object(text, "$['Plan']"))
    ok = top.isNotNull()
    tree = F.coalesce(top, F.lit(""))
    names = lambda key: F.array_distinct(F.regexp_extract_all(tree, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)+)"'), F.lit(1)))
    number = lambda key, kind: F.coalesce(F.get_json_object(tree, f"$['{key}']").try_cast("double"), F.lit(0.0)).cast(kind)
    nodes = names("Node Type")
    has = lambda test: F.exists(nodes, test)
    return F.struct(
        ok.alias("ok"),
        number("Total Cost", "double").alias("cost"),
        number("Plan Rows", "long").alias("n_rows"),
        number("Plan Width", "int").alias("width"),
        F.array_join(nodes, ",").alias("nodes"),
        F.array_join(names("Relation Name"), ",").alias("tables"),
        F.array_join(names("Index Name"), ",").alias("indexes"),
        has(lambda x: x.contains("Seq Scan")).alias("seq_scan"),
        has(lambda x: x.contains("Index Scan") | x.contains("Index Only Scan")).alias("index_scan"),
        has(lambda x: x == "Sort").alias("sorts"),
        has(lambda x: x.contains("Join") | (x == "Nested Loop")).alias("joins"),
        F.coalesce(F.lower(F.trim(F.get_json_object(tree, "$['One-Time Filter']"))) == "false", F.lit(False)).alias("never"),
    )


def salvaged(answer: Column | str) -> Column:
    """JSON text from a model's answer: no thoughts and fences, from the first brace on, illegal
    escapes dropped; braces that are still open are closed."""
    text = F.col(answer) if isinstance(answer, str) else answer
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    cut = F.regexp_extract(bare, r"(?s)(\{.*)", 1)
    legal = F.regexp_replace(cut, r'\\(?![\\"/bfnrtu])', "")
    end = F.regexp_extract(legal, r"(?s)^(.*\})", 1)
    whole = F.when(F.try_parse_json(end).isNotNull(), end)
    missing = F.greatest(F.lit(0), F.char_length(F.regexp_replace(legal, r"[^{]", "")) - F.char_length(F.regexp_replace(legal, r"[^}]", "")))
    closed = F.concat(F.trim(legal), F.repeat(F.lit("}"), missing))
    return F.coalesce(whole, F.when(F.try_parse_json(closed).isNotNull(), closed))
