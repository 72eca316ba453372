"""Parsers over texts made from the test tables, and write modes."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, table, view
from ..functions import scalar
from ..operators import dashboards, writes
from ..session import keep, shared_dir
from ..sources import java, xlsx
from ..sources import parsers as P

PLAN = Plan()


def made(spark, sf_dir, sql):
    text, _, name = sql.rpartition(" FROM ")
    return spark.sql(text.replace("{", "{{").replace("}", "}}") + " FROM {src}", src=table(spark, sf_dir, name))


N = "CAST({} AS VARCHAR(20))".format
CELLS = f"SELECT event_id AS k, event_type AS a, CASE WHEN event_id % 3 = 0 THEN concat('x->[', {N('user_id')}) ELSE ' ' END AS b, CASE WHEN event_id % 2 = 0 THEN {N('event_id')} ELSE ' ' END AS c, 'z' AS d FROM events"


@PLAN.query("op_src13_raw_cell", f"WITH s AS ({CELLS}) SELECT k, CASE WHEN trim(c) <> '' THEN c WHEN contains(b, '->[') THEN b WHEN trim(b) <> '' THEN concat_ws(' ', a, b, d) ELSE concat_ws(' ', a, d) END AS cell FROM s")
def src13(spark, sf_dir):
    return made(spark, sf_dir, CELLS).select("k", P.raw_cell(["a", "b", "c", "d"]).alias("cell"))


@PLAN.query("op_src12_csv", f"WITH s AS ({CELLS}) SELECT k::VARCHAR AS k, a, trim(b) AS b, trim(c) AS c FROM s")
def src12(spark, sf_dir):
    """Written as CSV, read back with trimmed cells; missing ones are empty."""
    path = f"{shared_dir(spark)}/corvane/csv-{uuid.uuid4().hex}"
    made(spark, sf_dir, CELLS).select("k", "a", "b", "c").write.option("header", True).csv(path)
    return P.csv_rows(spark, path)


JAVA = f"SELECT c_custkey AS k, concat('public class Cls', {N('c_custkey')}, CASE WHEN c_custkey % 2 = 0 THEN ' extends Base' ELSE '' END, ' implements Api', {N('c_nationkey')}, ' {{ @Statement(sql = \"select \" + \"', {N('c_custkey')}, '\") void m() {{ // throw A.E9999(1)', chr(10), 'throw Err.E', {N('1000 + c_custkey % 50')}, '(x); }} }}') AS content FROM customer".replace("{{", "{").replace("}}", "}")


@PLAN.query("op_src03_declarations", f"WITH s AS ({JAVA}) SELECT k, 'class' AS kind, 'Cls' || k AS name, CASE WHEN k % 2 = 0 THEN 'Base' ELSE '' END AS parent, 'Api' || regexp_extract(content, 'Api([0-9]+)', 1) AS interfaces FROM s")
def src03(spark, sf_dir):
    found = keep(java.facts(made(spark, sf_dir, JAVA).select(F.col("k").cast("string").alias("path"), "content")), "facts")
    parents = lambda fact, name: found.where(F.col("fact") == fact).select("path", "pos", F.array_join("items", ", ").alias(name))
    whole = java.types(found).join(parents("extends", "parent"), ["path", "pos"], "left").join(parents("implements", "interfaces"), ["path", "pos"], "left")
    return whole.select(F.col("path").cast("long").alias("k"), "kind", "name", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("interfaces", F.lit("")).alias("interfaces"))


CALLS = "SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SysUtil.getInstance(Api.class)' WHEN 2 THEN 'pkg.AccountDao' WHEN 3 THEN 'helper' ELSE '' END AS scope, CASE event_id % 7 WHEN 0 THEN 'toString' ELSE 'run' END AS name FROM events"


@PLAN.query("op_src04_call_kinds", f"WITH s AS ({CALLS}) SELECT k, CASE WHEN coalesce(scope, '') = '' AND name <> 'toString' THEN 'SELF_CALLS' WHEN coalesce(scope, '') = '' THEN NULL WHEN k % 5 = 1 THEN 'SYS_UTIL_CALLS' WHEN k % 5 = 2 THEN 'DAO_CALLS' ELSE 'CALLS' END AS kind FROM s")
def src04(spark, sf_dir):
    return made(spark, sf_dir, CALLS).select("k", P.call_kind(F.col("scope"), F.col("name")).alias("kind"))


@PLAN.query("op_src10_statements", f"WITH s AS ({JAVA}) SELECT k, 'select ' || k AS q FROM s")
def src10(spark, sf_dir):
    found = keep(java.facts(made(spark, sf_dir, JAVA).select(F.col("k").cast("string").alias("path"), "content")), "facts")
    return java.statements(found).select(F.col("path").cast("long").alias("k"), F.col("sql").alias("q"))


@PLAN.query("op_src20_throws", f"WITH s AS ({JAVA}) SELECT k, 'E' || (1000 + k % 50) AS code FROM s")
def src20(spark, sf_dir):
    found = keep(java.facts(made(spark, sf_dir, JAVA).select(F.col("k").cast("string").alias("path"), "content")), "facts")
    return java.thrown(found).select(F.col("path").cast("long").alias("k"), "code")


FLOW = f"SELECT o_orderkey AS k, concat('<flow id=\"TX', {N('o_orderkey')}, '\"><block><step id=\"a', {N('o_custkey')}, '\"/></block><step id=\"b\"/><case><when><step id=\"c\"/></when></case></flow>') AS xml FROM orders"


@PLAN.query("op_src05_flow_edges", f"WITH s AS ({FLOW}) SELECT 'TX' || k AS tx, regexp_extract(xml, 'id=.(a[0-9]+)', 1) AS src, 'b' AS dst FROM s UNION ALL SELECT 'TX' || k, 'b', 'c' FROM s")
def src05(spark, sf_dir):
    return P.next_edges(P.flow_steps(made(spark, sf_dir, FLOW)))


@PLAN.query("op_src21_tx_id", f"WITH s AS ({FLOW}) SELECT k, 'TX' || k AS tx FROM s")
def src21(spark, sf_dir):
    return made(spark, sf_dir, FLOW).select("k", F.xpath_string("xml", F.lit("/flow/@id")).alias("tx"))


FLOWTRAN = f"SELECT o_orderkey AS k, concat('<', CASE WHEN o_orderkey % 10 = 0 THEN 'flow' ELSE 'flowtran' END, ' id=\"TX', {N('o_orderkey')}, '\"><flow id=\"f\"><method id=\"a', {N('o_custkey')}, '\" method=\"m\"/><loop><service id=\"s\" serviceName=\"T', {N('o_custkey % 7')}, '.op\"/><method id=\"n\"/></loop><case id=\"c\"><when id=\"w1\" test=\"x\"><method id=\"x\"/><service id=\"y\"/></when><when id=\"w2\"><if><method id=\"z\"/></if></when></case><method id=\"e\"/></flow>', CASE WHEN o_orderkey % 10 = 1 THEN '' WHEN o_orderkey % 10 = 0 THEN '</flow>' ELSE '</flowtran>' END) AS xml FROM orders"
_FLOWTRAN = f"SELECT 'TX' || k AS tx, 'TX:TX' || k AS t, regexp_extract(xml, 'id=.(a[0-9]+)', 1) AS a, regexp_extract(xml, '(T[0-9]+)[.]op', 1) AS s FROM ({FLOWTRAN}) WHERE k % 10 > 1"


@PLAN.query("op_src05_flow_graph", f"WITH s AS ({_FLOWTRAN}) SELECT tx, edge, replace(t || src, '$a', a) AS src, CASE WHEN edge = 'CALLS_SERVICE' THEN replace(dst, '$s', s) ELSE replace(t || dst, '$a', a) END AS dst FROM s CROSS JOIN (VALUES ('HAS_FLOW', '', ':FLOW'), ('HAS_STEP', ':FLOW', ':METHOD:1:$a'), ('HAS_STEP', ':FLOW', ':SERVICE:1:s'), ('HAS_STEP', ':FLOW', ':METHOD:2:n'), ('HAS_STEP', ':FLOW', ':CASE:2:c'), ('HAS_STEP', ':FLOW', ':METHOD:3:e'), ('CALLS_SERVICE', ':SERVICE:1:s', 'SVOP:$s.op'), ('NEXT', ':SERVICE:1:s', ':METHOD:2:n'), ('NEXT', ':METHOD:1:$a', ':CASE:2:c'), ('NEXT', ':CASE:2:c', ':METHOD:3:e'), ('HAS_BRANCH', ':CASE:2:c', ':CASE:2:c:WHEN:1:w1'), ('HAS_BRANCH', ':CASE:2:c', ':CASE:2:c:WHEN:2:w2'), ('EXECUTES', ':CASE:2:c:WHEN:1:w1', ':METHOD:1:x'), ('EXECUTES', ':CASE:2:c:WHEN:1:w1', ':SERVICE:2:y'), ('NEXT', ':METHOD:1:x', ':SERVICE:2:y'), ('CALLS_SERVICE', ':SERVICE:2:y', 'SVOP:null.y'), ('EXECUTES', ':CASE:2:c:WHEN:2:w2', ':METHOD:1:z')) AS e(edge, src, dst)")
def src05_graph(spark, sf_dir):
    """Flow files as the reference reads them; a tenth has another root, a tenth is broken off."""
    return P.flow_edges(made(spark, sf_dir, FLOWTRAN))


@PLAN.query("op_src05_flow_nodes", f"WITH s AS ({_FLOWTRAN}) SELECT tx, t || replace(key, '$a', a) AS key, kind, replace(id, '$a', a) AS id, NULL::VARCHAR AS longname, test, method, CASE WHEN id = 's' THEN s || '.op' END AS service_name, ord::BIGINT AS ord FROM s CROSS JOIN (VALUES (':FLOW', 'flow', 'f', NULL, NULL, NULL), (':METHOD:1:$a', 'method', '$a', NULL, 'm', 1), (':SERVICE:1:s', 'service', 's', NULL, NULL, 1), (':METHOD:2:n', 'method', 'n', NULL, NULL, 2), (':CASE:2:c', 'case', 'c', NULL, NULL, 2), (':CASE:2:c:WHEN:1:w1', 'when', 'w1', 'x', NULL, 1), (':CASE:2:c:WHEN:2:w2', 'when', 'w2', NULL, NULL, 2), (':METHOD:1:x', 'method', 'x', NULL, NULL, 1), (':SERVICE:2:y', 'service', 'y', NULL, NULL, 2), (':METHOD:1:z', 'method', 'z', NULL, NULL, 1), (':METHOD:3:e', 'method', 'e', NULL, NULL, 3)) AS e(key, kind, id, test, method, ord)")
def src05_nodes(spark, sf_dir):
    return P.flow_nodes(made(spark, sf_dir, FLOWTRAN))


@PLAN.query("op_src21_flowtran_id", f"SELECT k, CASE WHEN k % 10 > 1 THEN 'TX' || k END AS tx FROM ({FLOWTRAN})")
def src21_flowtran(spark, sf_dir):
    return made(spark, sf_dir, FLOWTRAN).select("k", P.flow_tx("xml").alias("tx"))


SCHEMAS = f"SELECT p_partkey AS seq, concat('/m/S', {N('p_partkey')}, '.tables.xml') AS path, concat('<schema id=\"S', {N('p_partkey')}, '\" package=\"k.p', {N('p_size')}, '\"><table id=\"t', {N('p_partkey % 50')}, '\" longname=\"L', {N('p_partkey')}, '\"/><x><table id=\"no\"/></x><Table id=\"u', {N('p_partkey')}, '\" name=\" \"/><table/>', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '</schema>' END) AS xml FROM part"


@PLAN.query("op_src07_schema_tables", f"WITH s AS (SELECT *, regexp_extract(xml, 'k[.]p[0-9]+') AS package_path, 'S' || seq AS schema_id FROM ({SCHEMAS}) WHERE seq % 7 > 0), t AS (SELECT *, 0::BIGINT AS pos, 't' || (seq % 50) AS table_id, 'L' || seq AS longname FROM s UNION ALL SELECT *, 1, 'u' || seq, 'u' || seq FROM s) SELECT seq, pos, path, table_id, longname, package_path, schema_id, package_path || '.' || schema_id AS outer_class_fqn, upper(table_id[1]) || substr(table_id, 2) || 'Dao' AS dao_class FROM t QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY seq) = 1")
def src07_tables(spark, sf_dir):
    """Tables of schema files, the first of each DAO name; a seventh of the files is broken off."""
    return P.first_tables(P.schema_tables(made(spark, sf_dir, SCHEMAS)), "dao_class")


CANDIDATES = f"SELECT o_orderkey AS seq, CASE WHEN o_custkey % 16 > 0 THEN concat('p', {N('o_custkey % 16')}) END AS project, CASE WHEN o_custkey % 9 > 0 THEN concat('C', {N('o_custkey % 300')}) END AS class_fqn, concat('f', {N('o_orderkey')}) AS source_file, repeat('x', CAST(190 + o_orderkey % 20 AS INT)) AS sql FROM orders"


@PLAN.query("op_src28_preview", f"WITH c AS ({CANDIDATES}), k AS (SELECT coalesce(class_fqn, '(unknown)') AS name, count(*) AS n, min(seq) AS seq FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, seq, name) AS ord FROM k), f AS (SELECT *, row_number() OVER (ORDER BY seq) AS ord FROM c) SELECT 'total' AS part, NULL::BIGINT AS ord, NULL::VARCHAR AS name, count(*) AS n, NULL::VARCHAR AS source_file, NULL::VARCHAR AS sql FROM c UNION ALL SELECT 'project', NULL, coalesce(project, '(unknown)') AS name, count(*), NULL, NULL FROM c GROUP BY 3 UNION ALL SELECT 'class', ord, name, n, NULL, NULL FROM r WHERE ord <= 10 UNION ALL SELECT 'sample', ord, class_fqn, NULL, source_file, CASE WHEN length(sql) > 200 THEN substr(sql, 1, 200) || '...' ELSE sql END FROM f WHERE ord <= 5")
def src28_preview(spark, sf_dir):
    """Total, counts by project, ten classes and five samples of a scan."""
    return dashboards.scan_preview(made(spark, sf_dir, CANDIDATES))


FILES = f"SELECT p_partkey AS k, concat('/m', {N('p_size')}, '-bcc', CASE WHEN p_partkey % 5 = 0 THEN '/target' ELSE '' END, '/src/main/resources/f', {N('p_partkey')}, CASE p_partkey % 3 WHEN 0 THEN '.pbs.xml' WHEN 1 THEN '.pbcb.xml' ELSE '.txt' END) AS path FROM part"


@PLAN.query("op_src06_service_kinds", f"WITH s AS ({FILES}) SELECT k, CASE k % 3 WHEN 0 THEN 'pbs' WHEN 1 THEN 'pbcb' ELSE '' END AS kind FROM s")
def src06(spark, sf_dir):
    return made(spark, sf_dir, FILES).select("k", P.service_kind("path").alias("kind"))


@PLAN.query("op_src24_roots", f"WITH s AS ({FILES}) SELECT regexp_extract(path, '^/([^/]+)/', 1) AS module, min(regexp_extract(path, '^(.*/src/main/resources)/', 1)) AS root FROM s WHERE NOT contains(path, '/target/') GROUP BY 1")
def src24(spark, sf_dir):
    return P.metadata_roots(made(spark, sf_dir, FILES))


@PLAN.query("op_src07_first_table", ctes("slow_raw") + " SELECT abstract_sql, arg_min(seq, seq) AS seq FROM slow_raw GROUP BY 1")
def src07(spark, sf_dir):
    """The first definition of a table counts."""
    return P.first_seen(view(spark, sf_dir, "slow_raw").select("abstract_sql", "seq"), ["abstract_sql"], "seq")


MODULES = ctes("slow_raw") + ", m AS (SELECT abstract_sql AS id, seq, service_name || (seq % 2) AS module FROM slow_raw)"


@PLAN.query("op_src08_last_module", MODULES + " SELECT id, arg_max(module, seq) AS module, count(DISTINCT module) > 1 AS conflict FROM m GROUP BY 1")
def src08(spark, sf_dir):
    """The last scanned counts; conflicts are reported."""
    m = view(spark, sf_dir, "slow_raw").select(F.col("abstract_sql").alias("id"), "seq", F.concat("service_name", (F.col("seq") % 2).cast("string")).alias("module"))
    last, several = P.last_put(m, ["id"], "seq")
    return last.join(several, "id", "left").select("id", "module", F.col("n_modules").isNotNull().alias("conflict"))


@PLAN.query("op_src09_exact_then_lower", ctes("slow_raw") + ", k AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN upper(service_name) ELSE service_name END AS name FROM slow_raw), i AS (SELECT DISTINCT service_name AS name, 'm-' || service_name AS module FROM slow_raw) SELECT seq, coalesce(a.module, b.module) AS module FROM k LEFT JOIN i a ON a.name = k.name LEFT JOIN i b ON b.name = lower(k.name)")
def src09(spark, sf_dir):
    raw = view(spark, sf_dir, "slow_raw")
    names = raw.select("seq", F.when(F.col("seq") % 2 == 0, F.upper("service_name")).otherwise(F.col("service_name")).alias("name"))
    index = raw.select(F.col("service_name").alias("name")).distinct().withColumn("module", F.concat(F.lit("m-"), "name"))
    exact = names.join(index.withColumnRenamed("module", "_a"), "name", "left")
    lower = exact.join(index.select(F.col("name").alias("low"), F.col("module").alias("_b")), F.lower("name") == F.col("low"), "left")
    return lower.select("seq", F.coalesce("_a", "_b").alias("module"))


@PLAN.query("op_src22_symbols", ctes("slow_raw") + " SELECT service_name AS name, arg_min(abstract_sql, seq) AS first_fqn, arg_max(abstract_sql, seq) AS last_fqn FROM slow_raw GROUP BY 1")
def src22(spark, sf_dir):
    """Simple names keep the first symbol, full ones the last."""
    return view(spark, sf_dir, "slow_raw").groupBy(F.col("service_name").alias("name")).agg(F.min(F.struct("seq", "abstract_sql"))["abstract_sql"].alias("first_fqn"), F.max(F.struct("seq", "abstract_sql"))["abstract_sql"].alias("last_fqn"))


DEFS = ctes("slow_raw") + ", d AS (SELECT abstract_sql AS id, seq, seq % 3 AS priority, CASE WHEN seq % 4 > 0 THEN exec_params ELSE ' ' END AS title, 'p' || seq AS path, CASE WHEN seq % 5 > 0 THEN 'i' || seq END AS impl FROM slow_raw)"


@PLAN.query("op_src25_merged_definitions", DEFS + " SELECT id, arg_max(title, seq) FILTER (trim(title) <> '') AS title, arg_max(path, priority * 100000000 + seq) AS path, arg_min(impl, seq) FILTER (impl IS NOT NULL) AS impl FROM d GROUP BY 1")
def src25(spark, sf_dir):
    s = F.col("seq")
    d = view(spark, sf_dir, "slow_raw").select(F.col("abstract_sql").alias("id"), "seq", (s % 3).alias("priority"), F.when(s % 4 > 0, F.col("exec_params")).otherwise(" ").alias("title"), F.concat(F.lit("p"), s.cast("string")).alias("path"), F.when(s % 5 > 0, F.concat(F.lit("i"), s.cast("string"))).alias("impl"))
    return P.merged_definitions(d)


@PLAN.query("op_src26_cached_operations", ctes("reached") + ", t AS (SELECT DISTINCT class_fqn AS type_id, 't' || class_fqn AS type_name FROM reached), o AS (SELECT DISTINCT class_fqn AS type_id, method_name AS op_id, CASE WHEN method_name <> 'm1' THEN 'o' || method_name END AS op_name FROM reached WHERE class_fqn < 'C3') SELECT concat_ws('.', type_id, op_id) AS key, coalesce(op_name, type_name) AS name FROM t LEFT JOIN o USING (type_id)")
def src26(spark, sf_dir):
    r = view(spark, sf_dir, "reached")
    types = r.select(F.col("class_fqn").alias("type_id"), F.concat(F.lit("t"), "class_fqn").alias("type_name")).distinct()
    ops = r.where("class_fqn < 'C3'").select(F.col("class_fqn").alias("type_id"), F.col("method_name").alias("op_id"), F.when(F.col("method_name") != "m1", F.concat(F.lit("o"), "method_name")).alias("op_name")).distinct()
    return P.cached_operations(types, ops)


COLS = "WITH c AS (SELECT s_suppkey AS oid, unnest([1, 2, 3])::INT AS attnum FROM supplier), cols AS (SELECT oid, attnum, 'c' || attnum AS attname FROM c), idx AS (SELECT s_suppkey AS oid, CASE s_suppkey % 4 WHEN 0 THEN '1 3' WHEN 1 THEN '2' WHEN 2 THEN '3 0' ELSE '1 9' END AS indkey FROM supplier)"


def catalog(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    cols = s.select(F.col("s_suppkey").alias("oid"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attnum")).withColumn("attname", F.concat(F.lit("c"), F.col("attnum").cast("string")))
    k = F.col("s_suppkey") % 4
    return s.select(F.col("s_suppkey").alias("oid"), F.when(k == 0, "1 3").when(k == 1, "2").when(k == 2, "3 0").otherwise("1 9").alias("indkey")), cols


@PLAN.query("op_src14_columns", COLS + " SELECT oid, count(*) AS n, max(attname) AS last_name FROM cols GROUP BY 1")
def src14(spark, sf_dir):
    return catalog(spark, sf_dir)[1].groupBy("oid").agg(F.count("*").alias("n"), F.max("attname").alias("last_name"))


@PLAN.query("op_src15_key_columns", COLS + " SELECT oid, CASE oid % 4 WHEN 0 THEN 'c1,c3' ELSE 'c2' END AS names, CASE oid % 4 WHEN 0 THEN 2 ELSE 1 END::INT AS n FROM idx WHERE oid % 4 < 2")
def src15(spark, sf_dir):
    return P.key_columns(*catalog(spark, sf_dir))


@PLAN.query("op_src16_index_columns", COLS + " SELECT oid, CASE oid % 4 WHEN 0 THEN 'c1,c3' WHEN 1 THEN 'c2' WHEN 2 THEN 'c3,<expr>' ELSE 'c1,<unknown#9>' END AS names FROM idx")
def src16(spark, sf_dir):
    return P.index_columns(*catalog(spark, sf_dir))


STAT = "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL) / count(*) AS null_frac, (SELECT max(n) FROM (SELECT count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY {c})) / count(*) AS top_frac FROM items"


@PLAN.query("op_src17_column_stats", ctes("items") + " " + " UNION ALL ".join(STAT.format(c=c) for c in ("project", "rating", "env")))
def src17(spark, sf_dir):
    return P.column_stats(view(spark, sf_dir, "items"), ["project", "rating", "env"])


@PLAN.query("op_src23_column_sample", ctes("items") + " SELECT task_id, min(rating) AS sample FROM items GROUP BY 1")
def src23(spark, sf_dir):
    """One value that isn't null a group; the smallest, so that it is always the same."""
    return view(spark, sf_dir, "items").groupBy("task_id").agg(F.min("rating").alias("sample"))


@PLAN.query("op_src18_git_log", "SELECT o_orderkey % 16 AS repo, 'src/F' || (l_partkey % 300) || '.java' AS path, 'u' || (o_custkey % 50) || '@b' AS email, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS adds, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END)::BIGINT AS dels, count(DISTINCT o_orderkey) AS commits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def src18(spark, sf_dir):
    """Logs of sixteen repositories: a header for each order, a line for each of its items."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = orders.select((F.col("o_orderkey") % 16).alias("repo"), (F.col("o_orderkey") * 100000).alias("line_no"), F.concat(F.lower(F.hex("o_orderkey")), F.lit("|U"), (F.col("o_custkey") % 50).cast("string"), F.lit("@b")).alias("line"))
    tab, dash = F.lit("\t"), F.col("l_linenumber") == 1
    cell = lambda c: F.when(dash, "-").otherwise(F.col(c).cast("long").cast("string"))
    line = F.concat(cell("l_quantity"), tab, cell("l_linenumber"), tab, F.lit("src/F"), (F.col("l_partkey") % 300).cast("string"), F.lit(".java"))
    body = items.select((F.col("l_orderkey") % 16).alias("repo"), (F.col("l_orderkey") * 100000 + 1 + F.col("l_partkey") % 90000).alias("line_no"), line.alias("line"))
    return P.git_numstat(head.unionByName(body))


@PLAN.query("op_src18_git_history", "SELECT repo, path, email, min_by(name, line_no) AS author_name, sum(adds)::BIGINT AS adds, sum(dels)::BIGINT AS dels, count(*) AS commits, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM (SELECT o_orderkey % 16 AS repo, CASE l_partkey % 3 WHEN 0 THEN 'src/F' WHEN 1 THEN 'src/new/F' ELSE 'lib/F' END || (l_partkey % 300) || '.java' AS path, 'U' || (o_custkey % 50) || '@b' AS email, 'n' || o_custkey AS name, o_orderkey * 100000 + l_linenumber AS line_no, l_quantity::BIGINT AS adds, l_linenumber AS dels, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END AS epoch FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 1) GROUP BY 1, 2, 3")
def src18_history(spark, sf_dir):
    """As op_src18_git_log, with binary first items, renames in two forms and headers of the
    reference; a fifth of them without an epoch."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tab, part = F.lit("\t"), F.col("l_partkey")
    epoch = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 1000).cast("string")).otherwise("?")
    text = F.concat(F.lit(">>>COMMIT\t"), F.lower(F.hex("o_orderkey")), F.lit("\tn"), F.col("o_custkey").cast("string"), F.lit("\tU"), (F.col("o_custkey") % 50).cast("string"), F.lit("@b\t"), epoch)
    head = orders.select((F.col("o_orderkey") % 16).alias("repo"), (F.col("o_orderkey") * 100000).alias("line_no"), text.alias("line"))
    cell = lambda c: F.when(F.col("l_linenumber") == 1, "-").otherwise(F.col(c).cast("long").cast("string"))
    folder = F.when(part % 3 == 0, "src/F").when(part % 3 == 1, "src/{old => new}/F").otherwise("src/X => lib/F")
    line = F.concat(cell("l_quantity"), tab, cell("l_linenumber"), tab, folder, (part % 300).cast("string"), F.lit(".java"))
    body = items.select((F.col("l_orderkey") % 16).alias("repo"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber")).alias("line_no"), line.alias("line"))
    return P.git_history(head.unionByName(body))


@PLAN.query("op_src19_git_blame", "SELECT o_orderkey % 16 AS repo, 'F' || (o_custkey % 200) AS path, 'u' || (o_custkey % 50) || '@b' AS email, sum(1 + o_orderkey % 90)::BIGINT AS owned_lines FROM orders GROUP BY 1, 2, 3")
def src19(spark, sf_dir):
    """A block of three lines for each order."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lines = F.array(text("abcdef 1 1 ", 1 + key % 90), text("author-mail <U", cust % 50, "@b>"), text("filename F", cust % 200))
    rows = table(spark, sf_dir, "orders").select((key % 16).alias("repo"), key.alias("o"), F.posexplode(lines).alias("i", "line"))
    return P.git_blame(rows.select("repo", (F.col("o") * 10 + F.col("i")).alias("line_no"), "line"))


SQLS = f"SELECT o_orderkey AS k, concat('select * from t where a = ? and b in (?) -- x = ?', chr(10), ' and c between ? and 9 and d = ''e = ?'' and f', {N('o_custkey % 9')}, ' like ?') AS q, o_custkey % 9 AS n FROM orders"


@PLAN.query("op_sc13_parameter_columns", f"WITH s AS ({SQLS}) SELECT k, 'a,b,c,f' || n AS names FROM s")
def sc13(spark, sf_dir):
    return made(spark, sf_dir, SQLS).select("k", P.parameter_columns("q").alias("names"))


@PLAN.query("op_sc15_filled", f"WITH s AS ({SQLS}) SELECT k, 'select * from t where a = 1 and b in (1) -- x = ?' || chr(10) || ' and c between 1 and 9 and d = ''e = ?'' and f' || n || ' like 1' AS q FROM s")
def sc15(spark, sf_dir):
    return made(spark, sf_dir, SQLS).select("k", P.filled("q", "1").alias("q"))


PLANS = f"SELECT o_orderkey AS k, concat('{{\"Plan\": {{\"Node Type\": \"', CASE WHEN o_orderkey % 2 = 0 THEN 'Hash Join' ELSE 'Sort' END, '\", \"Plans\": [{{\"Node Type\": \"Seq Scan\", \"Relation Name\": \"t', {N('o_custkey % 5')}, '\"}}, {{\"Node Type\": \"Index Scan\", \"Relation Name\": \"a\"}}]}}}}') AS plan, o_custkey % 5 AS n FROM orders".replace("{{", "{").replace("}}", "}")


@PLAN.query("op_sc23_plan_facts", f"WITH s AS ({PLANS}) SELECT k, CASE WHEN k % 2 = 0 THEN 'Hash Join' ELSE 'Sort' END || ',Seq Scan,Index Scan' AS nodes, 'a,t' || n AS tables, true AS seq_scan, true AS index_scan, k % 2 = 1 AS sorts, k % 2 = 0 AS joins FROM s")
def sc23(spark, sf_dir):
    return made(spark, sf_dir, PLANS).select("k", P.plan_facts("plan").alias("f")).select("k", "f.*")


TREES = f"SELECT o_orderkey AS k, o_custkey AS n, CASE o_orderkey % 4 WHEN 0 THEN concat('[{{\"Plan\": {{\"Node Type\": \"Nested Loop\", \"Total Cost\": ', {N('o_custkey')}, '.5, \"Plan Rows\": ', {N('o_orderkey')}, ', \"Plan Width\": 8, \"Plans\": [{{\"Node Type\": \"Seq Scan\", \"Relation Name\": \"t', {N('o_custkey % 5')}, '\", \"Filter\": \"(x = 1)\"}}, {{\"Node Type\": \"Index Only Scan\", \"Index Name\": \"i1\", \"Relation Name\": \"a\"}}, {{\"Node Type\": \"Seq Scan\", \"Relation Name\": \"a\"}}]}}}}]') WHEN 1 THEN '{{\"Plan\": {{\"Node Type\": \"Incremental Sort\", \"One-Time Filter\": \" False \"}}}}' WHEN 2 THEN '[{{\"Plan' END AS plan FROM orders"


@PLAN.query("op_sc23_plan_result", f"SELECT k, k % 4 < 2 AS ok, CASE WHEN k % 4 = 0 THEN n + 0.5::DOUBLE ELSE 0 END AS cost, CASE WHEN k % 4 = 0 THEN k ELSE 0 END AS n_rows, CASE WHEN k % 4 = 0 THEN 8 ELSE 0 END::INT AS width, CASE k % 4 WHEN 0 THEN 'Nested Loop,Seq Scan,Index Only Scan' WHEN 1 THEN 'Incremental Sort' ELSE '' END AS nodes, CASE WHEN k % 4 = 0 THEN 't' || (n % 5) || ',a' ELSE '' END AS tables, CASE WHEN k % 4 = 0 THEN 'i1' ELSE '' END AS indexes, k % 4 = 0 AS seq_scan, k % 4 = 0 AS index_scan, false AS sorts, k % 4 = 0 AS joins, k % 4 = 1 AS never FROM ({TREES})")
def sc23_result(spark, sf_dir):
    """Facts of plan trees; a quarter is broken off and a quarter missing."""
    return made(spark, sf_dir, TREES).select("k", P.plan_result("plan").alias("f")).select("k", "f.*")


@PLAN.query("op_src27_plan_input", f"WITH s AS ({PLANS}) SELECT n, count(*) AS plans FROM s GROUP BY 1")
def src27(spark, sf_dir):
    """Plans are an input column; here those that read each table."""
    facts = made(spark, sf_dir, PLANS).select("n", P.plan_facts("plan")["seq_scan"].alias("seq"))
    return facts.where("seq").groupBy("n").agg(F.count("*").alias("plans"))


ANSWERS = f"SELECT o_orderkey AS k, concat('<think>{{no}}</think> ```json ', CASE o_orderkey % 3 WHEN 0 THEN concat('{{\"a\": ', {N('o_custkey')}, '}} ``` done') WHEN 1 THEN concat('{{\"a\": {{\"b\": ', {N('o_custkey')}) ELSE 'nothing' END) AS t, o_custkey AS n FROM orders".replace("{{", "{").replace("}}", "}")


@PLAN.query("op_sc27_salvaged", f"WITH s AS ({ANSWERS}) SELECT k, CASE k % 3 WHEN 0 THEN '{{\"a\": ' || n || '}}' WHEN 1 THEN '{{\"a\": {{\"b\": ' || n || '}}' || '}}' END AS json FROM s".replace("{{", "{").replace("}}", "}"))
def sc27(spark, sf_dir):
    return made(spark, sf_dir, ANSWERS).select("k", P.salvaged("t").alias("json"))


REP = ctes("slow_raw")


@PLAN.query("op_snk01_full_rebuild", REP + " SELECT service_name, count(*) AS n FROM slow_raw GROUP BY 1")
def snk01(spark, sf_dir):
    """Written twice; the second overwrites the first."""
    path = f"{shared_dir(spark)}/corvane/full-{uuid.uuid4().hex}"
    counted = view(spark, sf_dir, "slow_raw").groupBy("service_name").agg(F.count("*").alias("n"))
    writes.published(counted.limit(0), path)
    writes.published(counted, path)
    return spark.read.schema(counted.schema).parquet(path)


@PLAN.query("op_snk02_partition_overwrite", REP + ", d AS (SELECT service_name, abstract_sql, count(*) AS n FROM slow_raw GROUP BY 1, 2) SELECT service_name, abstract_sql, CASE WHEN service_name = 'click' THEN n + 1000 ELSE n END AS n FROM d")
def snk02(spark, sf_dir):
    """Only the partitions of the second write are replaced."""
    path = f"{shared_dir(spark)}/corvane/parts-{uuid.uuid4().hex}"
    counted = view(spark, sf_dir, "slow_raw").groupBy("service_name", "abstract_sql").agg(F.count("*").alias("n"))
    writes.published(counted, path, "service_name")
    writes.published(counted.where("service_name = 'click'").withColumn("n", F.col("n") + 1000), path, "service_name")
    return spark.read.schema("abstract_sql string, n long, service_name string").parquet(path)


@PLAN.query("op_snk13_export", REP + " SELECT service_name, abstract_sql, max(cost_ms)::VARCHAR AS max_cost FROM slow_raw GROUP BY 1, 2")
def snk13(spark, sf_dir):
    path = f"{shared_dir(spark)}/corvane/export-{uuid.uuid4().hex}"
    top = view(spark, sf_dir, "slow_raw").groupBy("service_name", "abstract_sql").agg(F.max("cost_ms").alias("max_cost"))
    writes.exported(top, path, ["service_name", "abstract_sql", "max_cost"])
    return P.csv_rows(spark, path)


@PLAN.query("op_src01_java_files", f"WITH s AS ({JAVA}) SELECT count(*) AS n FROM s WHERE k % 3 = 0")
def src01(spark, sf_dir):
    """Files written below src/main/java and src/test/java; only the first are read. A file has many
    classes, but never so many that it is too large to be read as a source."""
    path = f"{shared_dir(spark)}/corvane/java-{uuid.uuid4().hex}"
    files = made(spark, sf_dir, JAVA)
    for k, folder in enumerate(("src/main/java", "src/test/java", "docs")):
        files.where(F.col("k") % 3 == k).select("content").write.option("lineSep", "\u0001").option("maxRecordsPerFile", 1000).text(f"{path}/{folder}")
    return java.types(java.facts(P.java_files(spark, [path], glob="*.txt"))).agg(F.count("*").alias("n"))


@PLAN.query("op_src11_first_sheet", REP + " SELECT abstract_sql, exec_params, max(cost_ms) AS cost FROM slow_raw GROUP BY 1, 2")
def src11(spark, sf_dir):
    """A sheet's five columns as CSV, its header skipped."""
    path = f"{shared_dir(spark)}/corvane/sheet-{uuid.uuid4().hex}"
    view(spark, sf_dir, "slow_raw").select("service_name", "abstract_sql", "exec_params", "cost_raw", "source_location").write.option("header", True).csv(path)
    from ..functions.scalar import cost

    return P.csv_rows(spark, path).groupBy("abstract_sql", "exec_params").agg(F.max(cost("cost_raw")).alias("cost"))


@PLAN.query("op_snk11_all_or_nothing", REP + " SELECT service_name, count(*) AS n FROM slow_raw GROUP BY 1")
def snk11(spark, sf_dir):
    """A write that fails on one row leaves the table as it was."""
    path = f"{shared_dir(spark)}/corvane/whole-{uuid.uuid4().hex}"
    counted = view(spark, sf_dir, "slow_raw").groupBy("service_name").agg(F.count("*").alias("n"))
    writes.staged(counted, path)
    writes.staged(counted.withColumn("n", F.col("n") + 1), path, F.col("n") < 0)
    return spark.read.schema(counted.schema).parquet(f"{path}/{writes.current(spark, path)}")


@PLAN.query("op_snk12_snapshot", REP + " SELECT round, count(*) AS n FROM slow_raw GROUP BY 1")
def snk12(spark, sf_dir):
    """Two snapshots; readers take the newest that is complete."""
    path = f"{shared_dir(spark)}/corvane/snap-{uuid.uuid4().hex}"
    counted = view(spark, sf_dir, "slow_raw").groupBy("round").agg(F.count("*").alias("n"))
    writes.staged(counted.where("n < 0"), path)
    writes.staged(counted, path)
    return spark.read.schema(counted.schema).parquet(f"{path}/{writes.current(spark, path)}")


@PLAN.query("op_snk10_once_a_day", ctes("tasks") + " SELECT env, count(*) FILTER (status = 'RUNNING') = 0 AS may_begin FROM tasks GROUP BY 1")
def snk10(spark, sf_dir):
    """Environments in which a run may begin."""
    return view(spark, sf_dir, "tasks").groupBy("env").agg((F.count_if(F.col("status") == "RUNNING") == 0).alias("may_begin"))


@PLAN.query(
    "op_snk10_runs",
    ctes("items", "tasks") + ", e AS (SELECT env, count(*) FILTER (status = 'RUNNING') > 0 AS running FROM tasks WHERE env <> '' GROUP BY 1) SELECT e.env, id, CASE WHEN running THEN 1 ELSE 2 END::INT AS attempt FROM e, items WHERE running OR id % 2 = 0",
)
def snk10_runs(spark, sf_dir):
    """Two runs a day for each environment: the second overwrites the first's rows, unless the first
    has been claimed again and is running."""
    path = f"{shared_dir(spark)}/corvane/runs-{uuid.uuid4().hex}"
    items = view(spark, sf_dir, "items").select("id")
    tasks = view(spark, sf_dir, "tasks").where("env <> ''").groupBy("env").agg((F.count_if(F.col("status") == "RUNNING") > 0).alias("running"))
    for env, running in tasks.collect():  # a row an environment
        writes.begin(spark, path, env, "2026-01-01")
        writes.finish(spark, path, env, "2026-01-01", items.withColumn("attempt", F.lit(1)))
        if running:
            writes.begin(spark, path, env, "2026-01-01")
        if writes.begin(spark, path, env, "2026-01-01"):
            writes.finish(spark, path, env, "2026-01-01", items.where("id % 2 = 0").withColumn("attempt", F.lit(2)))
    return spark.read.parquet(f"{path}/items").select("env", "id", "attempt")


def workbook(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet of shared strings; empty cells are left out."""
    shared = {x: k for k, x in enumerate(dict.fromkeys(c for r in rows for c in r if c))}
    cell = lambda r, c, x: f'<c r="{chr(65 + c)}{r}" t="s"><v>{shared[x]}</v></c>' if x else ""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{k}">' + "".join(cell(k, c, x) for c, x in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(table: pa.Table) -> pa.Table:
    rows = [["" if x is None else str(x) for x in r.values()] for r in table.drop_columns(["book"]).to_pylist()]
    return pa.table({"path": [f"book{table.column('book')[0].as_py()}.xlsx"], "content": pa.array([workbook([list(table.column_names[1:]), *rows])], pa.binary())})


@PLAN.query("op_src11_workbooks", f"WITH s AS ({CELLS}) SELECT 'book' || (k % 50) || '.xlsx' AS path, k::VARCHAR AS k, a, coalesce(b, '') AS b, c FROM s")
def src11_workbooks(spark, sf_dir):
    """Rows of fifty workbooks, header skipped and empty cells kept."""
    cells = made(spark, sf_dir, CELLS).select((F.col("k") % 50).alias("book"), "k", "a", "b", "c")
    books = cells.groupBy("book").applyInArrow(_workbooks, "path string, content binary")
    return xlsx.rows(books, ["k", "a", "b", "c"]).drop("row")


INDEXED = f"SELECT p_partkey AS seq, concat('/w/', CASE p_partkey % 3 WHEN 0 THEN 'loan-bcc' ELSE 'dept-bcc' END, '/f', {N('p_partkey')}, '.tables.xml') AS path, CASE p_partkey % 8 WHEN 0 THEN 'broken <' WHEN 1 THEN '<schema/>' ELSE concat('<schema id=\"S', {N('p_partkey % 60')}, '\"><x/></schema>') END AS xml FROM part"


@PLAN.query(
    "op_src08_module_index",
    f"WITH s AS ({INDEXED}), i AS (SELECT 'S' || (seq % 60) AS id, seq, regexp_extract(path, '[a-z]+-bcc') AS module FROM s WHERE seq % 8 > 1) SELECT id, arg_max(module, seq) AS module, count(DISTINCT module) > 1 AS conflict FROM i GROUP BY 1",
)
def src08_index(spark, sf_dir):
    """Modules by the ids of files' roots, out of their text: the last scanned wins, conflicts are told."""
    files = made(spark, sf_dir, INDEXED).select("seq", P.root_id("xml").alias("id"), scalar.module_of("path").alias("module")).where("id IS NOT NULL")
    last, conflicts = P.last_put(files, ["id"], "seq")
    return last.join(conflicts, "id", "left").select("id", "module", F.col("n_modules").isNotNull().alias("conflict"))


@PLAN.query(
    "op_src09_schema_lookup",
    f"WITH s AS ({INDEXED}), i AS (SELECT CASE WHEN seq % 8 > 1 THEN 'S' || (seq % 60) ELSE 'f' || seq END AS id, seq, regexp_extract(path, '[a-z]+-bcc') AS module FROM s), e AS (SELECT id, arg_max(module, seq) AS module FROM i GROUP BY 1), l AS (SELECT lower(id) AS id, arg_max(module, seq) AS module FROM i GROUP BY 1), "
    "n AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'S' || (c_custkey % 80) WHEN 1 THEN 's' || (c_custkey % 80) ELSE 'F' || (c_custkey % 50) END AS name FROM customer) SELECT k, name, coalesce(e.module, l.module) AS module FROM n LEFT JOIN e ON e.id = name LEFT JOIN l ON l.id = lower(name)",
)
def src09_lookup(spark, sf_dir):
    """Names looked up among schema files, which are named by their root or else by the file: as they
    stand, then in lower case."""
    index = made(spark, sf_dir, INDEXED).select("seq", P.schema_id("xml", "path").alias("id"), scalar.module_of("path").alias("module"))
    name = lambda c, m: F.concat(F.lit(c), (F.col("c_custkey") % m).cast("string"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, name("S", 80)).when(F.col("c_custkey") % 3 == 1, name("s", 80)).otherwise(name("F", 50)).alias("name"))
    return P.looked_up(names, index).select("k", "name", "module")
