"""Call-graph traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, view
from ..operators import graph as G
from ..operators import impact as I
from ..operators import model as M

PLAN = Plan()
CALLS = ctes("calls")
# (seed, node, depth) by DuckDB; UNION stops at repeated rows, depth bounds the rest
INNER = "SELECT src, dst FROM calls WHERE etype IN ('CALLS', 'SELF_CALLS', 'SYS_UTIL_CALLS') AND dst LIKE 'M%'"


def walk(edges: str, seeds: str, most: int) -> str:
    return f"e AS ({edges}), walk AS ({seeds} UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.depth < {most}), near AS (SELECT seed, node, min(depth)::INT AS depth FROM walk GROUP BY 1, 2)"


METHODS = "SELECT DISTINCT src AS seed, src AS node, 0 AS depth FROM calls"


def calls(spark, sf_dir):
    return view(spark, sf_dir, "calls")


def methods(spark, sf_dir):
    return calls(spark, sf_dir).select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()


def inner(spark, sf_dir):
    return calls(spark, sf_dir).where(F.col("etype").isin("CALLS", "SELF_CALLS", "SYS_UTIL_CALLS") & F.col("dst").startswith("M"))


FACTS = ctes("call_facts", "impl_methods", "implements", "operations", "flow_steps")
RESOLVED = f"""{FACTS}, inner_calls AS (SELECT src, dst FROM call_facts WHERE etype IN ('CALLS', 'SELF_CALLS', 'SYS_UTIL_CALLS') AND label = 'Method'),
by_class AS (SELECT class_fqn, name, min(code) AS code FROM implements JOIN impl_methods USING (signature) GROUP BY 1, 2),
code_of AS (
  SELECT f.src, (SELECT min(i.code) FROM implements i WHERE i.signature = f.dst) AS code FROM call_facts f WHERE label = 'Method'
  UNION ALL SELECT f.src, k.code FROM call_facts f JOIN by_class k ON k.class_fqn = f.dst AND k.name = f.method_name WHERE label = 'Class'
  UNION ALL SELECT f.src, (SELECT min(p.code) FROM operations p WHERE p.interface_fqn = f.dst AND p.method_name = f.method_name) FROM call_facts f WHERE label = 'Interface'
  UNION ALL SELECT f.src, p.code FROM call_facts f JOIN operations p ON p.code = f.dst WHERE label = 'ServiceOperation'),
targets AS (
  SELECT c.src, c.code AS target, CASE WHEN lower(p.node_kind) LIKE 'pbc%' THEN 'COMPONENT' ELSE 'SERVICE' END AS kind FROM code_of c JOIN operations p USING (code)
  UNION SELECT src, dst, 'TABLE' FROM call_facts WHERE label = 'DaoMethod' AND trim(dst) <> '' AND trim(method_name) <> '')"""
SEEN = """w1 AS (SELECT m AS seed, m AS node, 0 AS depth FROM starts UNION SELECT w.seed, e.dst, w.depth + 1 FROM w1 w JOIN inner_calls e ON e.src = w.node WHERE w.depth < 7), near1 AS (SELECT DISTINCT seed, node FROM w1)"""


@PLAN.query("op_gr06_boundary_targets", f"{RESOLVED}, starts AS (SELECT DISTINCT src AS m FROM calls), {SEEN} SELECT DISTINCT seed, target, kind FROM near1 JOIN targets ON src = node")
def gr06(spark, sf_dir):
    return M.direct_targets(facts(spark, sf_dir), methods(spark, sf_dir))


def facts(spark, sf_dir):
    return M.Facts(*(view(spark, sf_dir, x) for x in ("call_facts", "implements", "impl_methods", "operations")))


@PLAN.query("op_gr07_dao_tables", f"{CALLS}, {walk(INNER.replace(chr(39) + 'SELF_CALLS' + chr(39) + ', ' + chr(39) + 'SYS_UTIL_CALLS' + chr(39), chr(39) + 'SELF_CALLS' + chr(39)), METHODS, 8)} SELECT DISTINCT n.seed, c.dst AS target FROM near n JOIN calls c ON c.src = n.node WHERE c.etype = 'DAO_CALLS'")
def gr07(spark, sf_dir):
    return G.dao_tables(calls(spark, sf_dir), methods(spark, sf_dir))


@PLAN.query("op_gr05_step_reach", f"{CALLS}, {walk(INNER, METHODS, 24)} SELECT seed, node, depth FROM near")
def gr05(spark, sf_dir):
    return G.reach(inner(spark, sf_dir), methods(spark, sf_dir), 24)


@PLAN.query("op_gr10_chain_methods", f"{CALLS}, {walk(INNER, METHODS, 8)} SELECT DISTINCT seed, node FROM near")
def gr10(spark, sf_dir):
    return G.reach(inner(spark, sf_dir), methods(spark, sf_dir), 8).select("seed", "node")


PATHS = """, e AS (SELECT {src} AS src, {dst} AS dst, etype || ':' || line_no AS eid FROM calls WHERE {test}), p AS (SELECT DISTINCT src AS start, src AS at, []::VARCHAR[] AS used, [src] AS nodes, 0 AS length FROM calls
  UNION ALL SELECT p.start, e.dst, list_append(p.used, e.eid), list_append(p.nodes, e.dst), p.length + 1 FROM p JOIN e ON e.src = p.at WHERE p.length < {most} AND NOT list_contains(p.used, e.eid)) SELECT start, length::INT AS length, array_to_string(nodes, ',') AS nodes FROM p WHERE length > 0"""


def _edges(df):
    return df.select(F.concat("etype", F.lit(":"), F.col("line_no").cast("string")).alias("eid"), "src", "dst")


@PLAN.query("op_gr01_forward_paths", CALLS + PATHS.format(src="src", dst="dst", test="true", most=5))
def gr01(spark, sf_dir):
    return G.paths(_edges(calls(spark, sf_dir)), methods(spark, sf_dir), 5)


@PLAN.query("op_gr02_reverse_paths", CALLS + PATHS.format(src="dst", dst="src", test="etype IN ('CALLS', 'SELF_CALLS')", most=4))
def gr02(spark, sf_dir):
    back = calls(spark, sf_dir).where("etype IN ('CALLS', 'SELF_CALLS')")
    turned = _edges(back).select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.paths(turned, methods(spark, sf_dir), 4)


@PLAN.query("op_gr04_subgraph", CALLS + PATHS.format(src="src", dst="dst", test="etype IN ('CALLS', 'DAO_CALLS')", most=6))
def gr04(spark, sf_dir):
    return G.paths(_edges(calls(spark, sf_dir).where("etype IN ('CALLS', 'DAO_CALLS')")), methods(spark, sf_dir), 6)


@PLAN.query("op_gr03_weighted_calls", f"""{CALLS}, p AS (SELECT DISTINCT src AS seed, src AS node, 0 AS length FROM calls UNION ALL SELECT p.seed, c.dst, p.length + 1 FROM p JOIN calls c ON c.src = p.node AND c.etype = 'CALLS' WHERE p.length < 15)
  SELECT seed, c.dst AS target, count(*) AS call_count FROM p JOIN calls c ON c.src = p.node AND c.etype = 'DAO_CALLS' GROUP BY 1, 2""")
def gr03(spark, sf_dir):
    return G.weighted_dao_calls(calls(spark, sf_dir), methods(spark, sf_dir), 15)


CLASSES = CALLS + ", impl AS (SELECT src, 'I' || (line_no % 9) AS dst FROM calls WHERE etype = 'SYS_UTIL_CALLS'), ext AS (SELECT src, dst FROM calls WHERE etype = 'CALLS')"


@PLAN.query("op_gr20_implementers", CLASSES + ", w AS (SELECT dst AS iface, src AS node, 0 AS depth FROM impl UNION SELECT w.iface, ext.src, w.depth + 1 FROM w JOIN ext ON ext.dst = w.node WHERE w.depth < 6) SELECT DISTINCT iface, node AS cls FROM w")
def gr20(spark, sf_dir):
    c = calls(spark, sf_dir)
    impl = c.where("etype = 'SYS_UTIL_CALLS'").select("src", F.concat(F.lit("I"), (F.col("line_no") % 9).cast("string")).alias("dst"))
    return G.implementers(impl, c.where("etype = 'CALLS'").select("src", "dst"))


@PLAN.query("op_set02_implementers_union", CLASSES + " SELECT src, dst FROM impl UNION SELECT ext.src, impl.dst FROM ext JOIN impl ON impl.src = ext.dst")
def set02(spark, sf_dir):
    c = calls(spark, sf_dir)
    impl = c.where("etype = 'SYS_UTIL_CALLS'").select("src", F.concat(F.lit("I"), (F.col("line_no") % 9).cast("string")).alias("dst"))
    ext = c.where("etype = 'CALLS'").select("src", F.col("dst").alias("parent"))
    return impl.union(ext.join(impl.withColumnRenamed("src", "parent"), "parent").select("src", "dst")).distinct()


@PLAN.query("op_gr21_neighbourhood", CALLS + """, e AS (SELECT src, dst FROM calls UNION SELECT dst, src FROM calls), w AS (SELECT 'M13' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3), near AS (SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1)
  SELECT node, depth, (SELECT count(*) FROM near) > 200 AS truncated FROM near ORDER BY depth, node LIMIT 200""")
def gr21(spark, sf_dir):
    """At most 200 nodes within three hops."""
    return G.neighbourhood(calls(spark, sf_dir), "M13", 9, 200)[0]


@PLAN.query("op_agg30_graph_stats", CALLS + " SELECT etype, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM calls GROUP BY 1")
def agg30(spark, sf_dir):
    return G.counts(calls(spark, sf_dir))


@PLAN.query("op_snk08_merged_edges", CALLS + " SELECT etype, src, dst, min(line_no) AS line_no FROM (SELECT * FROM calls UNION ALL SELECT etype, src, dst, line_no + 1 FROM calls) GROUP BY 1, 2, 3")
def snk08(spark, sf_dir):
    c = calls(spark, sf_dir)
    return G.merged_edges(c.unionByName(c.withColumn("line_no", F.col("line_no") + 1)))


@PLAN.query("op_gr08_transaction_model", f"""{RESOLVED}, starts AS (SELECT signature AS m FROM implements UNION SELECT signature FROM flow_steps WHERE signature IS NOT NULL), {SEEN},
w2 AS (SELECT m AS seed, m AS node, 0 AS depth FROM starts UNION SELECT w.seed, f.dst, w.depth + 1 FROM w2 w JOIN call_facts f ON f.src = w.node AND f.label = 'Method' AND f.etype IN ('CALLS', 'SELF_CALLS') WHERE w.depth < 8),
leads AS (SELECT seed, target, kind FROM near1 JOIN targets ON src = node UNION SELECT seed, dst, 'TABLE' FROM w2 JOIN call_facts f ON f.src = w2.node WHERE f.label = 'DaoMethod' AND trim(dst) <> ''),
nodes AS (SELECT tx, CASE WHEN prefix LIKE 'pbc%' OR prefix LIKE 'PBC%' THEN 'COMPONENT' ELSE 'SERVICE' END AS kind, CASE WHEN prefix = 'method' THEN code || '#' || signature ELSE code END AS code, signature FROM flow_steps
  UNION SELECT n.tx, l.kind, l.target, i.signature FROM nodes n JOIN leads l ON l.seed = n.signature LEFT JOIN implements i ON i.code = l.target WHERE l.kind <> 'TABLE' AND (n.kind = 'SERVICE' OR l.kind = 'COMPONENT'))
SELECT DISTINCT tx, kind, code FROM nodes UNION SELECT n.tx, 'TABLE', l.target FROM nodes n JOIN leads l ON l.seed = n.signature AND l.kind = 'TABLE'""")
def gr08(spark, sf_dir):
    """From call facts and flow steps to the services, components and tables of each transaction."""
    return I.model(M.layers_of(facts(spark, sf_dir), view(spark, sf_dir, "flow_steps")))
