"""Implied relations, attribution, lookups, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, view
from ..operators import imports, writes
from ..operators import relations as X
from ..session import keep
from .ingest import N, made

PLAN = Plan()
ER = ctes("key_sets", "table_columns") + """, sized AS (SELECT table_name, key_id, count(*) AS key_columns, string_agg(column_name, ',' ORDER BY column_name) AS join_columns, min(column_name) AS one FROM key_sets GROUP BY 1, 2),
rel AS (SELECT k.table_name AS from_table, k.key_id, c.table_name AS to_table, s.join_columns, s.key_columns, CASE WHEN s.key_columns = 1 AND s.one IN ('name') THEN 'LOW' ELSE 'HIGH' END AS confidence
  FROM key_sets k JOIN table_columns c ON k.column_name = c.column_name AND k.table_name <> c.table_name JOIN sized s ON s.table_name = k.table_name AND s.key_id = k.key_id GROUP BY ALL HAVING count(*) = s.key_columns)"""


def er(spark, sf_dir):
    return X.containment(view(spark, sf_dir, "key_sets"), view(spark, sf_dir, "table_columns"), ["name"])


@PLAN.query("op_join09_containment", ER + " SELECT * FROM rel")
def join09(spark, sf_dir):
    return er(spark, sf_dir)


@PLAN.query("op_gr23_degrees", ER + " SELECT table_name, count(*) AS degree FROM (SELECT from_table AS table_name FROM rel UNION ALL SELECT to_table FROM rel) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
def gr23(spark, sf_dir):
    """At most 500 tables."""
    return X.degrees(er(spark, sf_dir), 500)


@PLAN.query("op_gr22_column_roles", ER + ", one AS (SELECT *, unnest(string_split(join_columns, ',')) AS column_name FROM rel) SELECT table_name, column_name, max(k)::INT AS is_key, max(f)::INT AS is_fk FROM (SELECT from_table AS table_name, column_name, 1 AS k, 0 AS f FROM one UNION ALL SELECT to_table, column_name, 0, 1 FROM one) GROUP BY 1, 2")
def gr22(spark, sf_dir):
    return X.column_roles(er(spark, sf_dir))


@PLAN.query("op_set01_endpoints", ER + " SELECT from_table AS table_name FROM rel UNION ALL SELECT to_table FROM rel")
def set01(spark, sf_dir):
    r = er(spark, sf_dir)
    return r.select(F.col("from_table").alias("table_name")).union(r.select("to_table"))


@PLAN.query("op_agg29_column_tables", ctes("table_columns") + " SELECT column_name, count(DISTINCT table_name) AS n_tables FROM table_columns GROUP BY 1")
def agg29(spark, sf_dir):
    return view(spark, sf_dir, "table_columns").groupBy("column_name").agg(F.count_distinct("table_name").alias("n_tables"))


@PLAN.query("op_snk05_decisions_kept", ER + ", old AS (SELECT from_table, to_table, join_columns, CASE length(to_table) % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'IGNORED' ELSE 'AUTO' END AS status FROM rel) SELECT r.from_table, r.to_table, r.join_columns, CASE WHEN o.status IN ('CONFIRMED', 'IGNORED') THEN o.status ELSE 'AUTO' END AS status FROM rel r LEFT JOIN old o USING (from_table, to_table, join_columns)")
def snk05(spark, sf_dir):
    key = ["from_table", "to_table", "join_columns"]
    new = er(spark, sf_dir).select(*key)
    n = F.length("to_table") % 3
    return writes.decisions_kept(new, new.withColumn("status", F.when(n == 0, "CONFIRMED").when(n == 1, "IGNORED").otherwise("AUTO")), key)


@PLAN.query("op_snk06_stale_purged", ER + ", t AS (SELECT from_table, to_table, join_columns, CASE length(to_table) % 2 WHEN 0 THEN 'CONFIRMED' ELSE 'AUTO' END AS status FROM rel) SELECT * FROM t WHERE status <> 'AUTO' OR from_table NOT LIKE 't1%'")
def snk06(spark, sf_dir):
    key = ["from_table", "to_table", "join_columns"]
    table = er(spark, sf_dir).select(*key, F.when(F.length("to_table") % 2 == 0, "CONFIRMED").otherwise("AUTO").alias("status"))
    return writes.stale_purged(table, table.where("from_table NOT LIKE 't1%'"), key)


ATTR = ctes("throws", "reached") + ", a AS (SELECT throw_seq, error_code, error_scope, t.class_fqn, t.method_name, line_no, tx_id, domain_key, component_code, CASE WHEN r.class_fqn IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS match_status FROM throws t LEFT JOIN reached r USING (class_fqn, method_name))"


def attr(spark, sf_dir):
    return X.attributed(view(spark, sf_dir, "throws"), view(spark, sf_dir, "reached"))


@PLAN.query("op_join06_attribution", ATTR + " SELECT * FROM a")
def join06(spark, sf_dir):
    return attr(spark, sf_dir).select("throw_seq", "error_code", "error_scope", "class_fqn", "method_name", "line_no", "tx_id", "domain_key", "component_code", "match_status")


@PLAN.query("op_agg27_codes_per_tx", ATTR + " SELECT tx_id, count(*) AS n, count(DISTINCT error_code) AS n_codes FROM a WHERE match_status = 'MATCHED' GROUP BY 1")
def agg27(spark, sf_dir):
    return X.codes_per_transaction(attr(spark, sf_dir))


@PLAN.query("op_srt07_export_order", ATTR + " SELECT domain_key, tx_id, error_code, line_no FROM a ORDER BY domain_key NULLS FIRST, tx_id NULLS FIRST, error_code, line_no NULLS FIRST")
def srt07(spark, sf_dir):
    return attr(spark, sf_dir).select("domain_key", "tx_id", "error_code", "line_no").orderBy(*(F.asc_nulls_first(c) for c in ("domain_key", "tx_id", "error_code", "line_no")))


@PLAN.query("op_join10_polymorphic", ctes("throws", "reached") + """, calls AS (SELECT throw_seq AS call_id, CASE throw_seq % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'CLASS' ELSE 'OTHER' END AS label, class_fqn, method_name FROM throws),
  ops AS (SELECT class_fqn, method_name, min(component_code) AS operation FROM reached GROUP BY 1, 2), by_class AS (SELECT class_fqn, min(component_code) AS operation FROM reached GROUP BY 1)
  SELECT call_id, label, operation FROM calls JOIN ops USING (class_fqn, method_name) WHERE label = 'METHOD' UNION ALL SELECT call_id, label, operation FROM calls JOIN by_class USING (class_fqn) WHERE label = 'CLASS'""")
def join10(spark, sf_dir):
    k = F.col("throw_seq") % 3
    calls = view(spark, sf_dir, "throws").select(F.col("throw_seq").alias("call_id"), F.when(k == 0, "METHOD").when(k == 1, "CLASS").otherwise("OTHER").alias("label"), "class_fqn", "method_name")
    ops = view(spark, sf_dir, "reached").withColumnRenamed("component_code", "operation")
    return X.polymorphic(calls, {"METHOD": (ops, ["class_fqn", "method_name"]), "CLASS": (ops, ["class_fqn"])})


@PLAN.query("op_join11_prefer_method", ctes("throws", "reached") + """, m AS (SELECT DISTINCT class_fqn, method_name FROM reached), c AS (SELECT DISTINCT class_fqn FROM reached), l AS (SELECT throw_seq AS src, class_fqn, method_name FROM throws)
  SELECT src, class_fqn || '#' || method_name AS target, 'METHOD' AS kind FROM l JOIN m USING (class_fqn, method_name) UNION ALL SELECT src, class_fqn, 'CLASS' FROM l JOIN c USING (class_fqn) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.class_fqn = l.class_fqn AND m.method_name = l.method_name)""")
def join11(spark, sf_dir):
    links = view(spark, sf_dir, "throws").select(F.col("throw_seq").alias("src"), "class_fqn", "method_name")
    r = view(spark, sf_dir, "reached")
    return X.specific_else_class(links, r.select("class_fqn", "method_name").distinct(), r.select("class_fqn").distinct())


LOOK = ctes("pool", "applications") + ", state AS (SELECT id, project_name AS svc, sql_hash, status FROM applications), batch AS (SELECT id, 'p' || (id % 6) AS svc, sql_hash FROM pool)"


@PLAN.query("op_join14_state_lookup", LOOK + """, e AS (SELECT svc, sql_hash, arg_max(status, id) AS a FROM state WHERE svc <> '' GROUP BY 1, 2), l AS (SELECT sql_hash, arg_max(status, id) AS b FROM state WHERE svc = '' GROUP BY 1)
  SELECT id, batch.svc, batch.sql_hash, coalesce(a, b) AS status FROM batch LEFT JOIN e USING (svc, sql_hash) LEFT JOIN l USING (sql_hash)""")
def join14(spark, sf_dir):
    state = view(spark, sf_dir, "applications").select("id", F.col("project_name").alias("svc"), "sql_hash", "status")
    batch = view(spark, sf_dir, "pool").select("id", F.concat(F.lit("p"), (F.col("id") % 6).cast("string")).alias("svc"), "sql_hash")
    return X.state_lookup(batch, state)


@PLAN.query("op_join15_fallback_sources", ctes("reached", "throws") + ", a AS (SELECT class_fqn, min(component_code) AS name FROM reached GROUP BY 1), b AS (SELECT class_fqn, min(tx_id) AS name FROM reached GROUP BY 1) SELECT throw_seq, class_fqn, coalesce(a.name, b.name) AS name FROM throws LEFT JOIN a USING (class_fqn) LEFT JOIN b USING (class_fqn)")
def join15(spark, sf_dir):
    r = view(spark, sf_dir, "reached")
    a, b = r.groupBy("class_fqn").agg(F.min("component_code").alias("name")), r.groupBy("class_fqn").agg(F.min("tx_id").alias("name"))
    return X.preferred(view(spark, sf_dir, "throws").select("throw_seq", "class_fqn"), a, b, "class_fqn", "name")


@PLAN.query("op_join08_not_loaded", ctes("throws", "reached") + " SELECT DISTINCT class_fqn FROM throws WHERE class_fqn NOT IN (SELECT class_fqn FROM reached)")
def join08(spark, sf_dir):
    return view(spark, sf_dir, "throws").select("class_fqn").distinct().join(view(spark, sf_dir, "reached"), "class_fqn", "left_anti")


@PLAN.query("op_set04_retained", ctes("throws", "reached") + " SELECT class_fqn FROM throws INTERSECT SELECT class_fqn FROM reached")
def set04(spark, sf_dir):
    return view(spark, sf_dir, "throws").select("class_fqn").intersect(view(spark, sf_dir, "reached").select("class_fqn"))


@PLAN.query("op_set08_second_overrides", ctes("throws", "reached") + ", a AS (SELECT class_fqn, min(method_name) AS v FROM throws GROUP BY 1), b AS (SELECT class_fqn, max(method_name) AS v FROM reached GROUP BY 1) SELECT class_fqn, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (class_fqn)")
def set08(spark, sf_dir):
    a = view(spark, sf_dir, "throws").groupBy("class_fqn").agg(F.min("method_name").alias("v"))
    b = view(spark, sf_dir, "reached").groupBy("class_fqn").agg(F.max("method_name").alias("v"))
    return X.merged_targets(a, b, ["class_fqn"])


UP = ctes("pool", "applications") + ", old AS (SELECT named_sql, sql_hash, min(project) AS project, min(log_day) AS updated FROM pool GROUP BY 1, 2), new AS (SELECT named_sql, sql_hash, min(project_name) AS project, CASE WHEN min(id) % 2 = 0 THEN '19960101' ELSE '19950101' END AS updated FROM applications GROUP BY 1, 2)"


@PLAN.query("op_snk04_upsert", UP + """ SELECT named_sql, sql_hash, CASE WHEN o.updated IS NULL THEN n.project ELSE o.project END AS project, CASE WHEN n.updated IS NULL THEN o.updated ELSE n.updated END AS updated,
  CASE WHEN o.updated IS NULL THEN 'INSERTED' WHEN n.updated IS NULL THEN 'KEPT' WHEN o.updated <> n.updated THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome FROM old o FULL JOIN new n USING (named_sql, sql_hash)""")
def snk04(spark, sf_dir):
    key = ["named_sql", "sql_hash"]
    old = view(spark, sf_dir, "pool").groupBy(*key).agg(F.min("project").alias("project"), F.min("log_day").alias("updated"))
    day = F.when(F.min("id") % 2 == 0, "19960101").otherwise("19950101")
    new = view(spark, sf_dir, "applications").groupBy(*key).agg(F.min("project_name").alias("project"), day.alias("updated"))
    return writes.upserted(old, new, key)


@PLAN.query("op_agg28_import_counters", UP + " SELECT CASE WHEN o.updated IS NULL THEN 'INSERTED' WHEN n.updated IS NULL THEN 'KEPT' WHEN o.updated <> n.updated THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome, count(*) AS n FROM old o FULL JOIN new n USING (named_sql, sql_hash) GROUP BY 1")
def agg28(spark, sf_dir):
    return snk04(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


LINES = f"""SELECT event_id AS k, CASE event_id % 13 WHEN 0 THEN ' ' WHEN 1 THEN 'broken line' WHEN 2 THEN concat('[2026-01-02 03:04:05]x->[', repeat('n', 501), '] [select 1]')
  WHEN 3 THEN concat('[2026-01-02 03:04:05]->[n', {N('user_id % 9')}, '.find] [', repeat('y', CASE WHEN event_id % 26 = 3 THEN 60001 ELSE 60 END), ']') WHEN 4 THEN '[2026-01-02 03:04:05] ->[aEntity.q] [x]'
  ELSE concat('pre [2026-01-02 03:04:0', {N('event_id % 10')}, CASE event_id % 3 WHEN 0 THEN '.12' WHEN 1 THEN '' ELSE 'bad' END, '][W]', chr(10), '->  [n', {N('user_id % 9')}, '.find]  [ select', chr(10), {N('event_id % 40')}, ' ] failed') END AS line FROM events"""
LOADED = f"""WITH s AS ({LINES}), p AS (SELECT k, trim(regexp_extract(line, P, 1)) AS ts, trim(regexp_extract(line, P, 2)) AS named_sql, trim(regexp_extract(line, P, 3), ' ' || chr(10)) AS sql_text FROM s, (SELECT '(?s)\\[([^\\]]+)\\].*?->\\s*\\[([^\\]]+)\\]\\s*\\[(.+?)\\]' AS P) WHERE trim(line) <> ''),
t AS (SELECT *, CASE WHEN named_sql = '' OR sql_text = '' THEN 'MALFORMED' WHEN contains(named_sql, 'Entity') THEN 'ENTITY' WHEN length(named_sql) > 500 THEN 'MALFORMED' WHEN length(sql_text) > 60000 THEN 'OVERSIZE' ELSE 'OK' END AS reason,
  coalesce(try_cast(CASE WHEN ts LIKE '%bad' THEN NULL ELSE left(ts, 19) END AS TIMESTAMP), TIMESTAMP '2026-02-01') AS log_ts FROM p),
b AS (SELECT named_sql, sql_text, max(log_ts) AS log_ts, count(*) AS k FROM t WHERE reason = 'OK' GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN sql_text LIKE '%1' THEN 'INSERTED' WHEN sql_text LIKE '%2' THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome, CASE split_part(named_sql, '.', 1) WHEN 'n1' THEN 'p1' WHEN 'n2' THEN 'p3' ELSE 'other' END AS project FROM b)"""


@PLAN.query(
    "op_agg28_import_report",
    LOADED + """ SELECT 'reason' AS part, reason AS name, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'lines', 'SCANNED', count(*) FROM t UNION ALL SELECT 'lines', 'DUPLICATED', (sum(k) - count(*))::BIGINT FROM d
    UNION ALL SELECT 'outcome', outcome, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'project', project, count(*) FROM d GROUP BY ALL""",
)
def agg28_report(spark, sf_dir):
    """The report of an import: a pool knows all statements but those that end in 1, those that end in 2
    with their newest time."""
    rows = keep(imports.tagged(made(spark, sf_dir, LINES), "line", F.lit("2026-02-01").cast("timestamp")), "lines")
    batch = keep(imports.merged(rows), "batch")
    was = F.when(F.col("sql_text").endswith("2"), F.col("log_ts")).otherwise(F.col("log_ts") - F.expr("INTERVAL 1 DAY"))
    pool = batch.where(~F.col("sql_text").endswith("1")).select("named_sql", "sql_hash", was.alias("log_ts"))
    projects = spark.createDataFrame([(1, "n1", "p1"), (2, "n2", "p2"), (3, "n2", "p3")], "seq long, sqls_id string, project string")  # the last wins
    return imports.report(rows, imports.imported(batch, pool, projects))


@PLAN.query("op_snk07_latest_wins", ctes("slow_raw") + " SELECT abstract_sql, seq, cost_ms FROM slow_raw QUALIFY row_number() OVER (PARTITION BY abstract_sql ORDER BY (seq % 2 = 1) DESC, seq DESC) = 1")
def snk07(spark, sf_dir):
    raw = view(spark, sf_dir, "slow_raw").select("abstract_sql", "seq", "cost_ms")
    return writes.latest(raw.where("seq % 2 = 0"), raw.where("seq % 2 = 1"), ["abstract_sql"])


@PLAN.query("op_agg25_advice", ctes("items") + """, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'SQL' ELSE 'TABLE' END AS scope, CASE WHEN id % 5 > 0 THEN 'idx_' || (id % 17) END AS ddl, 'r' || (id % 3) || lang AS reason, (n_chars > 2000)::INT AS risk FROM items), t AS (SELECT * FROM s WHERE scope = 'TABLE' AND ddl IS NOT NULL),
  f AS (SELECT ddl, reason, min(id) AS first_id FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ddl ORDER BY first_id, reason) AS k FROM f), r AS (SELECT ddl, string_agg(reason, '; ' ORDER BY k) AS reasons FROM k WHERE k <= 3 GROUP BY 1)
  SELECT ddl, count(*) AS n, count(DISTINCT id) AS n_statements, max(risk)::INT AS risk, any_value(reasons) AS reasons FROM t JOIN r USING (ddl) GROUP BY 1""")
def agg25(spark, sf_dir):
    text = lambda p, n: F.concat(F.lit(p), (F.col("id") % n).cast("string"))
    s = view(spark, sf_dir, "items").select("id", F.when(F.col("id") % 4 == 0, "SQL").otherwise("TABLE").alias("scope"), F.when(F.col("id") % 5 > 0, text("idx_", 17)).alias("ddl"), F.concat(text("r", 3), "lang").alias("reason"), (F.col("n_chars") > 2000).cast("int").alias("risk"))
    return X.advice(s)


STEPS = "SELECT CAST(o_orderkey AS BIGINT) AS tx, o_custkey % 30 AS src_field, o_custkey % 17 AS dst_field FROM orders"


@PLAN.query("op_join13_field_mappings", f"WITH m AS ({STEPS}), f AS (SELECT o_orderkey AS tx, unnest(range(0, 20)) AS field FROM orders) SELECT m.tx, 'SOURCE_OF' AS edge, m.src_field AS field FROM m JOIN f ON f.tx = m.tx AND f.field = m.src_field UNION ALL SELECT m.tx, 'TARGETS', m.dst_field FROM m JOIN f ON f.tx = m.tx AND f.field = m.dst_field")
def join13(spark, sf_dir):
    """Mappings whose field exists in the same transaction, at either end. A transaction's fields are one
    row; their number is unknown to the optimizer, so neither side may become a broadcast."""
    orders = view(spark, sf_dir, "orders")
    maps = orders.select(F.col("o_orderkey").alias("tx"), (F.col("o_custkey") % 30).alias("src_field"), (F.col("o_custkey") % 17).alias("dst_field"))
    fields = orders.select(F.col("o_orderkey").alias("tx"), F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")).alias("fields"))
    return X.mapped_fields(maps, fields)


@PLAN.query("op_join12_backfilled", ctes("calls", "reached") + ", known AS (SELECT DISTINCT src AS node FROM calls) SELECT DISTINCT dst AS node, split_part(dst, ':', 1) AS label FROM calls WHERE dst NOT IN (SELECT node FROM known)")
def join12(spark, sf_dir):
    """Nodes that edges point to but no scan has declared."""
    calls = view(spark, sf_dir, "calls")
    missing = calls.select(F.col("dst").alias("node")).distinct().join(calls.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return missing.select("node", F.substring_index("node", ":", 1).alias("label"))


@PLAN.query("op_srt09_sorted_batch", ctes("slow_raw") + " SELECT service_name, abstract_sql, arg_max(seq, round || lpad(seq::VARCHAR, 12, '0')) AS seq FROM slow_raw GROUP BY 1, 2")
def srt09(spark, sf_dir):
    """Sorted by name and text; of equal ones the latest round, and of that the last."""
    rows = view(spark, sf_dir, "slow_raw").select("service_name", "abstract_sql", "round", "seq")
    newest = rows.groupBy("service_name", "abstract_sql").agg(F.max(F.struct("round", "seq"))["seq"].alias("seq"))
    return newest.orderBy("service_name", "abstract_sql")


@PLAN.query("op_gr24_source_pointers", ctes("calls", "reached", "throws") + ", c AS (SELECT class_fqn, min(throw_seq) AS line FROM throws GROUP BY 1), r AS (SELECT class_fqn, min(tx_id) AS tx FROM reached GROUP BY 1) SELECT t.throw_seq, CASE WHEN t.line_no IS NOT NULL THEN t.class_fqn || ':' || t.line_no WHEN r.tx IS NOT NULL THEN 'xml:' || r.tx ELSE t.class_fqn END AS pointer FROM throws t LEFT JOIN r USING (class_fqn)")
def gr24(spark, sf_dir):
    """The line where it is known, else the transaction's file, else the class."""
    r = view(spark, sf_dir, "reached").groupBy("class_fqn").agg(F.min("tx_id").alias("tx"))
    line = F.when(F.col("line_no").isNotNull(), F.concat("class_fqn", F.lit(":"), F.col("line_no").cast("string")))
    xml = F.when(F.col("tx").isNotNull(), F.concat(F.lit("xml:"), "tx"))
    return view(spark, sf_dir, "throws").join(r, "class_fqn", "left").select("throw_seq", F.coalesce(line, xml, F.col("class_fqn")).alias("pointer"))


@PLAN.query("op_gr25_snippets", "SELECT source, doc_id, CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS snippet FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def gr25(spark, sf_dir):
    """The three longest texts of each source, cut to 300 characters. Ids are ranked before texts
    are read, so that no text is shuffled to be dropped."""
    from ..functions.scalar import ellipsis
    from ..operators.windows import top_per

    docs = view(spark, sf_dir, "documents")
    top = top_per(docs.select("source", "doc_id", "n_chars"), ["source"], 3, F.desc("n_chars"), F.asc("doc_id"))
    return docs.select("doc_id", ellipsis("text", 300).alias("snippet")).join(top.select("source", "doc_id"), "doc_id").select("source", "doc_id", "snippet")
