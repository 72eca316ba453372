"""Facts of Java sources, which are made from the test tables: nested types, literals and comments
that look like code, look-ups of services, throws in anonymous classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..operators import backfill
from ..session import keep
from ..sources import java, where
from .ingest import N, made

PLAN = Plan()


def _source(*lines: str) -> str:
    """One text of lines in which <expression> stands for its value."""
    parts = []
    for line in lines:
        for k, x in enumerate(line.replace(">>", "\x02").replace("<<", "\x01").replace("<", "\x00").replace(">", "\x00").split("\x00")):
            x = x.replace("\x01", "<").replace("\x02", ">")
            parts.append(N(x) if k % 2 else "'" + x.replace("\\", "', chr(92), '") + "'")  # a backslash is an escape in one dialect only
        parts.append("chr(10)")
    return ", ".join(p for p in parts if p != "''")


K, NAT = "c_custkey", "c_nationkey"
FILES = (
    f"SELECT {K} AS k, {NAT} AS n, concat('src/C', {N(K)}, '.java') AS path, concat("
    + _source(
        f"package com.corp.m<{NAT}>;",
        f"import com.corp.api.Api<{NAT}>; import com.corp.svc.*;",
        f"/* class Hidden<{K}> {{ */ // interface Hidden {{",
        f'@Note("class Fake<{K}> {{ }}") public class Cls<{K}><<T extends Comparable<<T>>>> extends Base<{K} % 7><<T>> implements Api<{NAT}>, com.other.Plain {{',
        f"  private Map<<String, List<<T>>>> api<{K}>, more; private Ord<{K} % 5>Dao store = new Ord<{K} % 5>Dao();",
        f"  static class In<{K}> {{ int size(List<<String>> a, final int... b) {{ return helper(a); }} }}",
        f'  @Statement(desc = "d, sql", sql = ("select " + "<{K}>\\t\\"x\\"")) @Override',
        "  public void run(String s) {",
        f"    Svc<{K} % 3> v = SysUtil.getInstance(Svc<{K} % 3>.class);",
        f"    v.open(helper(s)); SysUtil.getInstance(Svc9.class).ping(); store.find(1); api<{K}>.load(); Util.go(); A.LogDao.put(); toString();",
        f'    String t = "// no comment"; if (s == null) throw Err.E<1000 + {K} % 50>(s,  t); // throw Err.E9999(s)',
        f"    new Thread(new Runnable() {{ public void call() {{ throw Err.Sub.A<100 + {NAT}>(); }} }});",
        "  }",
    )
    + f", CASE WHEN {K} % 3 = 0 THEN concat("
    + _source(f"  enum Color<{K}> {{ RED {{ void f() {{ throw Err.E0001(); }} }}; void g() {{ }} }}")
    + ") ELSE concat("
    + _source(f"  record Pt<{K}>(int x) implements Api<{NAT}> {{ }} interface I<{K}> {{ void h(int[] a); }}")
    + ") END, '}') AS content FROM customer"
)
#: The same texts without comments and literals, by regular expressions.
MASKED = f"WITH s AS ({FILES}), m AS (SELECT *, regexp_replace(content, '\"(?:[^\"\\\\\\n]|\\\\.)*\"|/\\*.*?\\*/|//[^\\n]*', '', 'gs') AS code, regexp_extract(content, 'package ([a-z0-9.]+);', 1) AS package FROM s)"


def found(spark, sf_dir):
    return keep(java.facts(made(spark, sf_dir, FILES).select("path", "content")), "facts")


@PLAN.query(
    "op_src03_types",
    MASKED + " SELECT path, kind, package || '.' || name AS fqn FROM (SELECT path, package, unnest(regexp_extract_all(code, '\\b(class|interface|enum|record)\\s+(\\w+)', 1)) AS kind, unnest(regexp_extract_all(code, '\\b(class|interface|enum|record)\\s+(\\w+)', 2)) AS name FROM m)",
)
def src03_types(spark, sf_dir):
    """Every declared type, nested ones by their package; literals and comments declare none."""
    return java.types(found(spark, sf_dir)).select("path", "kind", "fqn")


@PLAN.query(
    "op_src03_methods",
    f"""WITH s AS ({FILES}), f AS (SELECT k, path, 'com.corp.m' || n || '.' AS p FROM s)
    SELECT path, p || 'Cls' || k || '#run(String)' AS signature, CAST(7 AS INTEGER) AS line FROM f
    UNION ALL SELECT path, p || 'In' || k || '#size(List,int)', 6 FROM f
    UNION ALL SELECT path, CASE WHEN k % 3 = 0 THEN p || 'Color' || k || '#g()' ELSE p || 'I' || k || '#h(int[])' END, 14 FROM f""",
)
def src03_methods(spark, sf_dir):
    return java.methods(found(spark, sf_dir)).where("signature IS NOT NULL").select("path", "signature", "line")


@PLAN.query(
    "op_src03_type_edges",
    MASKED + ", d AS (SELECT package, regexp_extract(code, 'class (\\w+)<', 1) AS name, regexp_extract(code, 'extends (Base\\d+)', 1) AS parent, unnest(string_split(regexp_extract(code, 'implements ([\\w., ]+) \\{', 1), ', ')) AS api FROM m) "
    "SELECT 'IMPLEMENTS' AS etype, package || '.' || name AS src, CASE WHEN api LIKE 'Api%' THEN 'com.corp.api.' || api ELSE api END AS dst FROM d UNION SELECT 'EXTENDS', package || '.' || name, package || '.' || parent FROM d",
)
def src03_type_edges(spark, sf_dir):
    """Parents by import, by any file's type, or in the own package."""
    return java.type_edges(found(spark, sf_dir))


@PLAN.query(
    "op_src04_calls",
    f"""WITH s AS ({FILES}), f AS (SELECT k, 'com.corp.m' || n AS p, 'com.corp.m' || n || '.Cls' || k AS c, 'com.corp.m' || n || '.Cls' || k || '#run(String)' AS caller FROM s)
    SELECT p || '.In' || k || '#size(List,int)' AS caller, 'SELF_CALLS' AS etype, p || '.In' || k AS target, 'helper' AS method_name, CAST(6 AS INTEGER) AS line_no FROM f
    UNION ALL SELECT caller, 'SELF_CALLS', c, 'helper', 10 FROM f
    UNION ALL SELECT caller, 'SYS_UTIL_CALLS', p || '.Svc' || (k % 3), 'open', 10 FROM f
    UNION ALL SELECT caller, 'SYS_UTIL_CALLS', p || '.Svc9', 'ping', 10 FROM f
    UNION ALL SELECT caller, 'DAO_CALLS', 'Ord' || (k % 5) || 'Dao#find', 'find', 10 FROM f
    UNION ALL SELECT caller, 'CALLS', p || '.Map', 'load', 10 FROM f
    UNION ALL SELECT caller, 'CALLS', p || '.Util', 'go', 10 FROM f
    UNION ALL SELECT caller, 'DAO_CALLS', 'LogDao#put', 'put', 10 FROM f
    UNION ALL SELECT caller, 'CALLS', p || '.Err', 'E' || (1000 + k % 50), 11 FROM f""",
)
def src04_calls(spark, sf_dir):
    """Calls out of source text, by the seven forms."""
    return java.calls(found(spark, sf_dir))


@PLAN.query("op_src10_sqls", f"WITH s AS ({FILES}) SELECT path, 'com.corp.m' || n || '.Cls' || k AS class_fqn, 'select ' || k || chr(9) || '\"x\"' AS sql, false AS oversized FROM s")
def src10_sqls(spark, sf_dir):
    return java.statements(found(spark, sf_dir)).select("path", "class_fqn", "sql", "oversized")


@PLAN.query(
    "op_src20_thrown",
    MASKED + ", t AS (SELECT path, k, package, unnest(regexp_extract_all(code, 'throw ([\\w.]+)\\.([A-Z]\\d+)\\(', 1)) AS scope, unnest(regexp_extract_all(code, 'throw ([\\w.]+)\\.([A-Z]\\d+)\\(', 2)) AS code FROM m) "
    "SELECT path, code, scope, package || CASE WHEN code = 'E0001' THEN '.Color' ELSE '.Cls' END || k AS class_fqn, CASE WHEN code = 'E0001' THEN 'f' WHEN scope = 'Err' THEN 'run' ELSE 'call' END AS method_name FROM t",
)
def src20_thrown(spark, sf_dir):
    """Error codes thrown, with the innermost named type and method around them."""
    return java.thrown(found(spark, sf_dir)).select("path", "code", "scope", "class_fqn", "method_name")


#: Statements with aliases, joins and subqueries.
SQLS = f"""SELECT doc_id AS id, CASE doc_id % 10 WHEN 3 THEN NULL WHEN 1 THEN 'POOR' WHEN 2 THEN 'POOR' ELSE 'GOOD' END AS rating,
  concat('select o.id, (select max(x.v) from Rates x where x.k = o.k and x.day >= ?) from ', CASE doc_id % 3 WHEN 0 THEN 'corp.Orders o' ELSE 'orders as o join cust c on c.id = o.cust_id' END,
    ' where o.a', {N('doc_id % 13')}, CASE doc_id % 2 WHEN 0 THEN ' = ? and ' ELSE ' in (1, 2) or ' END, 'o.note <> ? and lower(o.b) = ? and exists (select 1 from items where order_id = o.id) -- and o.z = 1') AS sql FROM documents"""


@PLAN.query(
    "op_agg24_predicates",
    f"""WITH s AS ({SQLS}), p AS (
      SELECT id, rating, 'rates' AS table_name, 'k' AS fields FROM s UNION ALL SELECT id, rating, 'items', 'order_id' FROM s UNION ALL SELECT id, rating, 'cust', 'id' FROM s WHERE id % 3 <> 0
      UNION ALL SELECT id, rating, 'orders', 'a' || (id % 13) || CASE WHEN id % 3 = 0 THEN '' ELSE ',cust_id' END || ',id,k' FROM s),
    r AS (SELECT table_name, fields, coalesce(rating, 'UNKNOWN') AS rating, count(*) AS k FROM p GROUP BY ALL),
    t AS (SELECT table_name, fields, sum(k)::BIGINT AS n, string_agg(rating || '=' || k, ',' ORDER BY rating) AS ratings FROM r GROUP BY ALL)
    SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY n DESC, fields) AS rank, fields, n, ratings FROM t QUALIFY rank <= 10""",
)
def agg24_predicates(spark, sf_dir):
    """How statements reach each table: the ten commonest sets of compared columns, by rating."""
    sqls = made(spark, sf_dir, SQLS)
    return where.access_patterns(sqls, where.predicates(sqls, "id", "sql"), "id")


@PLAN.query(
    "op_gr25_chain_snippets",
    f"""WITH s AS ({FILES}), c AS (SELECT k % 40 AS tx, k AS ord, 'N' || k AS node, path, CASE k % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'size' ELSE 'gone' END AS method_name, content FROM s),
    m AS (SELECT *, CASE method_name WHEN 'run' THEN regexp_extract(content, '(?s)@Statement.*?\n  [}}]') ELSE regexp_extract(content, 'int size.*?helper.*?; [}}]') END AS body, row_number() OVER (PARTITION BY tx ORDER BY ord) AS rank FROM c WHERE method_name <> 'gone')
    SELECT tx, rank, node, path, method_name, CASE method_name WHEN 'run' THEN 7 ELSE 6 END::INT AS start_line, CASE method_name WHEN 'run' THEN 13 ELSE 6 END::INT AS end_line, CASE WHEN length(body) > 100 THEN left(body, 100) || chr(10) || '// ... snippet truncated ...' ELSE body END AS content FROM m WHERE rank <= 3""",
)
def gr25_chain(spark, sf_dir):
    """The first three nodes of every chain whose method is found, with its text."""
    files = made(spark, sf_dir, FILES)
    method = F.element_at(F.array(F.lit("run"), F.lit("size"), F.lit("gone")), (F.col("k") % 3 + 1).cast("int"))
    chain = files.select((F.col("k") % 40).alias("tx"), F.col("k").alias("ord"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("node"), "path", method.alias("method_name"))
    return java.snippets(chain, found(spark, sf_dir), files, 3, 100)


#: Service types of two interfaces a package and their operations; a third has no metadata.
SERVICES = f"SELECT concat('ST', {N('n_nationkey')}, '_0') AS service_id, concat(' com.corp.m', {N('n_nationkey')}, '.Svc0 ') AS interface_fqn, concat('ST', {N('n_nationkey')}, '_1') AS other_id, concat('com.corp.m', {N('n_nationkey')}, '.Svc1') AS other_fqn FROM nation"


def services(spark, sf_dir):
    both = made(spark, sf_dir, SERVICES)
    return both.select("service_id", F.trim("interface_fqn").alias("interface_fqn")).union(both.select("other_id", "other_fqn"))


@PLAN.query(
    "op_join12_operations",
    f"WITH s AS ({FILES}) SELECT 'com.corp.m' || n || '.Cls' || k || '#run(String)' AS caller, 'SVOP:ST' || n || '_' || (k % 3) || '.open' AS operation, 'open' AS method_name, CAST(10 AS INTEGER) AS line_no FROM s WHERE k % 3 < 2",
)
def join12_operations(spark, sf_dir):
    """Look-ups in source text lead to the operations that service metadata declares."""
    facts, types = found(spark, sf_dir), services(spark, sf_dir)
    offered = types.select("service_id", F.concat(F.lit("SVOP:"), "service_id", F.lit(".open")).alias("operation"), F.lit("open").alias("method_name"))
    return backfill.operations(java.calls(facts), java.methods(facts), types, offered)


@PLAN.query(
    "op_join12_interfaces",
    f"WITH s AS ({FILES}), v AS ({SERVICES}), d AS (SELECT DISTINCT 'com.corp.m' || n || '.I' || k AS fqn, 'I' || k AS simple_name FROM s WHERE k % 3 > 0) SELECT fqn, simple_name, true AS declared FROM d UNION ALL SELECT DISTINCT trim(interface_fqn), 'Svc0', false FROM v UNION ALL SELECT DISTINCT other_fqn, 'Svc1', false FROM v",
)
def join12_interfaces(spark, sf_dir):
    """Interfaces of the sources, and those that only metadata names."""
    declared = java.types(found(spark, sf_dir)).where("kind = 'interface'").select("fqn", F.col("name").alias("simple_name"))
    return backfill.interfaces(declared, services(spark, sf_dir))


@PLAN.query(
    "op_agg30_code_stats",
    f"""WITH s AS ({FILES}), c AS (SELECT count(*) AS n, count(*) FILTER (k % 3 > 0) AS i, count(DISTINCT k % 5) AS d FROM s)
    SELECT unnest(['classCount', 'interfaceCount', 'methodCount', 'tableNodeCount', 'daoNodeCount', 'transactionCount', 'flowMethodStepCount', 'flowServiceStepCount', 'serviceTypeCount', 'serviceOperationCount', 'callsEdgeCount', 'sysUtilEdgeCount', 'daoEdgeCount', 'tableDaoEdgeCount', 'selfCallEdgeCount', 'implementsCount']) AS name,
      unnest([2 * n, i, 2 * n + i, 0, d + 1, 0, 0, 0, 0, 0, 3 * n, 2 * n, 2 * n, 0, 2 * n, 2 * n]) AS n FROM c""",
)
def agg30_code(spark, sf_dir):
    """The sixteen counts of the sources' graph: methods of classes and interfaces, calls by their form."""
    facts = found(spark, sf_dir)
    called = keep(java.calls(facts), "calls")
    label = F.when(F.col("kind") == "class", "Class").when(F.col("kind") == "interface", "Interface")
    nodes = java.types(facts).select(label.alias("label"), F.col("fqn").alias("id")).where("label IS NOT NULL")
    nodes = nodes.union(java.methods(facts).where("owner_kind IN ('class', 'interface')").select(F.lit("Method"), "signature")).union(called.where("etype = 'DAO_CALLS'").select(F.lit("DaoMethod"), "target"))
    return backfill.stats(nodes, called.select("etype").unionByName(java.type_edges(facts).select("etype")))
