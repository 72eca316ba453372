"""Canonical inputs of the operators as views over the test tables. Each is one SQL text; the few
functions that Spark and DuckDB name differently are written by dialect. Every view covers its
whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {ymd:x}: the day of x as yyyyMMdd; {div:x,n}: whole division.
_DIALECTS = {
    "spark": {"ymd": "date_format({0}, 'yyyyMMdd')", "div": "({0} div {1})"},
    "duckdb": {"ymd": "strftime({0}, '%Y%m%d')", "div": "({0} // {1})"},
}

VIEWS: dict[str, str] = {
    # slow statements: one observation a row
    "slow_raw": """
        SELECT event_id AS seq, {ymd:ts} AS round, event_type AS service_name,
          concat(event_type, '#', CAST(user_id % 50 AS VARCHAR(20))) AS abstract_sql,
          CAST(round(value * 100) AS BIGINT) AS cost_ms, concat(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR(20)), 'ms') AS cost_raw,
          concat('u=', CAST(user_id AS VARCHAR(20))) AS exec_params,
          CASE user_id % 4 WHEN 0 THEN '[[ODB:dept-bcc.q1]]' WHEN 1 THEN ' [nsql:loan-bcc.find] ' WHEN 2 THEN 'platform' ELSE NULL END AS source_location
        FROM events""",
    # state of optimisations: keys with their second smallest round
    "slow_state": """
        SELECT service_name, abstract_sql, round AS optimized_round,
          CASE WHEN abstract_sql LIKE '%5' THEN 'REGRESSED' ELSE 'OPTIMIZED' END AS status,
          CASE WHEN abstract_sql LIKE '%5' THEN round END AS reappeared_round
        FROM (SELECT service_name, abstract_sql, round, row_number() OVER (PARTITION BY service_name, abstract_sql ORDER BY round) AS k
              FROM (SELECT DISTINCT service_name, abstract_sql, round FROM slow_raw WHERE abstract_sql LIKE '%0' OR abstract_sql LIKE '%5') d) r
        WHERE k = 2""",
    # inspected statements
    "items": """
        SELECT d.doc_id AS id, d.doc_id % 7 AS task_id,
          CASE d.doc_id % 5 WHEN 0 THEN 'ccbs-dept-bcc' WHEN 1 THEN 'ccbs-loan-bcc' WHEN 2 THEN 'ccbs-comm-bcc' WHEN 3 THEN 'ccbs-sett-bcc' ELSE 'misc' END AS project,
          CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'prod' ELSE 'test' END AS env,
          concat('n', CAST(d.doc_id % 31 AS VARCHAR(20)), '.find') AS named_sql, concat('h', CAST(d.doc_id % 97 AS VARCHAR(20))) AS sql_hash,
          d.source, d.lang, d.n_chars,
          CASE WHEN l.toxic = 1 THEN 'relation does not exist' WHEN d.doc_id % 10 = 3 THEN '' END AS explain_error,
          CASE WHEN l.quality = 1 THEN 'EXCELLENT' WHEN l.quality = 0 THEN 'POOR' WHEN d.doc_id % 3 = 0 THEN 'GOOD' WHEN d.doc_id % 3 = 1 THEN 'NOT_APPLICABLE' END AS rating,
          CASE d.doc_id % 6 WHEN 0 THEN 'DONE' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'SKIPPED' END AS llm_status,
          CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS is_whitelist,
          CASE d.doc_id % 9 WHEN 0 THEN 'PENDING_L1' WHEN 1 THEN 'PENDING_L2' WHEN 2 THEN 'REJECTED_L1' WHEN 3 THEN 'REJECTED_L2' WHEN 4 THEN 'APPROVED' WHEN 5 THEN 'CANCELLED' END AS whitelist_status,
          CASE WHEN d.doc_id % 9 < 6 THEN d.doc_id % 40 END AS whitelist_app_id,
          CASE WHEN d.doc_id % 3 = 0 THEN 'customer, orders' WHEN d.doc_id % 3 = 1 THEN 'lineitem' ELSE 'orders,lineitem' END AS involved_tables,
          d.doc_id * 10 % 3000 AS est_rows
        FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    # statements of the pool
    "pool": """
        SELECT o_orderkey AS id, concat('n', CAST(o_custkey % 31 AS VARCHAR(20)), '.find') AS named_sql, concat('h', CAST(o_orderkey % 997 AS VARCHAR(20))) AS sql_hash,
          CASE o_custkey % 5 WHEN 0 THEN 'ccbs-dept-bcc' WHEN 1 THEN 'ccbs-loan-bcc' WHEN 2 THEN 'ccbs-comm-bcc' WHEN 3 THEN 'ccbs-sett-bcc' END AS project,
          CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'prod' ELSE 'test' END AS env,
          CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' END AS explain_error,
          CASE o_orderstatus WHEN 'F' THEN 'EXCELLENT' WHEN 'O' THEN 'POOR' END AS rating,
          CASE o_orderkey % 5 WHEN 0 THEN 'DONE' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED' END AS llm_status,
          CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS is_whitelist,
          CASE o_orderkey % 8 WHEN 0 THEN 'PENDING_L1' WHEN 1 THEN 'PENDING_L2' WHEN 2 THEN 'REJECTED_L1' WHEN 3 THEN 'REJECTED_L2' WHEN 4 THEN 'APPROVED' END AS whitelist_status,
          CASE WHEN o_orderkey % 8 < 5 THEN o_orderkey % 40 END AS whitelist_app_id,
          {ymd:o_orderdate} AS log_day, CAST(round(o_totalprice) AS BIGINT) AS est_rows
        FROM orders""",
    "tasks": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, concat('T', n_name) AS task_no, CASE n_regionkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'test' ELSE '' END AS env,
          CASE WHEN n_nationkey % 4 = 3 THEN 'RUNNING' ELSE 'DONE' END AS status,
          CAST(1767225600 + n_nationkey * 3600 AS BIGINT) AS created_s, CAST(1767225600 + n_nationkey * 3600 + 61 * n_nationkey AS BIGINT) AS updated_s
        FROM nation""",
    # approval requests with their three actors
    "applications": """
        SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'HASH' WHEN 1 THEN 'NAMED_SQL' ELSE 'SLOW_SQL' END AS target_type,
          concat('h', CAST(o_orderkey % 97 AS VARCHAR(20))) AS sql_hash, concat('n', CAST(o_custkey % 31 AS VARCHAR(20)), '.find') AS named_sql,
          CASE WHEN o_custkey % 6 = 5 THEN '' ELSE concat('p', CAST(o_custkey % 6 AS VARCHAR(20))) END AS project_name,
          CASE o_orderkey % 6 WHEN 0 THEN 'PENDING_L1' WHEN 1 THEN 'PENDING_L2' WHEN 2 THEN 'REJECTED_L1' WHEN 3 THEN 'REJECTED_L2' WHEN 4 THEN 'APPROVED' ELSE 'CANCELLED' END AS status,
          concat('u', CAST(o_custkey % 20 AS VARCHAR(20))) AS applicant, concat('u', CAST(o_custkey % 7 AS VARCHAR(20))) AS l1_approver, concat('u', CAST(o_custkey % 5 AS VARCHAR(20))) AS l2_approver
        FROM orders""",
    # actions on requests, in event order
    "actions": """
        SELECT event_id AS seq, user_id AS app_id, CASE event_id % 6 WHEN 0 THEN 'SUBMIT' WHEN 1 THEN 'APPROVE_L1' WHEN 2 THEN 'APPROVE_L2' WHEN 3 THEN 'REJECT_L1' WHEN 4 THEN 'REJECT_L2' ELSE 'CANCEL' END AS action
        FROM events""",
    # requests by their number, and actions on them with who acts and which state they expect
    "requests": """
        SELECT c_custkey AS app_id, concat('u', CAST(c_custkey % 20 AS VARCHAR(20))) AS applicant, concat('u', CAST(c_custkey % 7 AS VARCHAR(20))) AS l1_approver, concat('u', CAST(c_custkey % 5 AS VARCHAR(20))) AS l2_approver
        FROM customer WHERE c_custkey % 17 <> 4""",
    "tries": """
        SELECT event_id AS seq, user_id % 150 AS app_id, CASE event_id % 6 WHEN 0 THEN 'SUBMIT' WHEN 1 THEN 'APPROVE_L1' WHEN 2 THEN 'APPROVE_L2' WHEN 3 THEN 'REJECT_L1' WHEN 4 THEN 'REJECT_L2' ELSE 'CANCEL' END AS action,
          concat('u', CAST(CASE WHEN event_id % 11 = 3 THEN 99 WHEN event_id % 6 IN (0, 5) THEN user_id % 150 % 20 WHEN event_id % 6 IN (1, 3) THEN user_id % 150 % 7 ELSE user_id % 150 % 5 END AS VARCHAR(20))) AS actor,
          CASE WHEN event_id % 5 < 3 THEN NULL WHEN event_id % 6 IN (1, 3, 5) THEN 'PENDING_L1' WHEN event_id % 6 = 0 THEN 'NONE' ELSE 'PENDING_L2' END AS expected
        FROM events""",
    # commits of repositories as a topological log: every ninth is a merge, every thirteenth on a side branch
    "commits": """
        SELECT c_nationkey AS repo_id, c_custkey AS seq, concat('s', CAST(c_custkey AS VARCHAR(20))) AS sha,
          CASE WHEN c_custkey + 50 > n THEN NULL ELSE concat('s', CAST(c_custkey + CASE WHEN c_custkey % 13 = 5 THEN 50 ELSE 25 END AS VARCHAR(20))) END AS parent,
          CASE WHEN c_custkey % 9 = 2 AND c_custkey + 100 < n THEN concat('s', CAST(c_custkey + 75 AS VARCHAR(20))) END AS parent2
        FROM (SELECT c_custkey, c_custkey % 25 AS c_nationkey, count(*) OVER () AS n FROM customer)""",
    # code ownership facts
    "owned": """
        SELECT l_linenumber AS repo_id, concat('/x-', p_brand, '/src/main/java/org/bank/', CASE l_partkey % 4 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' WHEN 2 THEN 'comm' ELSE 'sett' END, '/F', CAST(l_partkey AS VARCHAR(20)), '.java') AS file_path,
          CASE l_partkey % 4 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' WHEN 2 THEN 'comm' ELSE 'sett' END AS domain_key,
          s_name AS author_name, concat(CASE l_suppkey % 3 WHEN 0 THEN 'T-' WHEN 1 THEN 'c-' ELSE '' END, 's', CAST(l_suppkey AS VARCHAR(20)), '@bank.org') AS author_email,
          CAST(l_quantity AS BIGINT) AS owned_lines, CAST(round(l_discount * 100) AS BIGINT) AS deleted_lines, CAST(round(l_tax * 100) AS BIGINT) AS added_lines,
          {ymd:l_shipdate} AS last_day, l_orderkey % 60 AS tx_id
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "aliases": """
        SELECT concat(CASE s_suppkey % 3 WHEN 0 THEN 'T-' WHEN 1 THEN 'c-' ELSE '' END, 's', CAST(s_suppkey AS VARCHAR(20)), '@bank.org') AS email, concat('P', CAST(s_suppkey % 5 AS VARCHAR(20))) AS person_name,
          CASE WHEN s_suppkey % 2 = 0 THEN 'STAFF' ELSE 'VENDOR' END AS person_type, CASE WHEN s_suppkey % 4 = 1 THEN 0 ELSE 1 END AS enabled
        FROM supplier WHERE s_suppkey % 10 < 4""",
    "tx_files": "SELECT DISTINCT repo_id, tx_id, file_path FROM owned",
    # error codes thrown in methods, and methods that transactions reach
    "throws": """
        SELECT event_id AS throw_seq, concat('E', CAST(1000 + user_id AS VARCHAR(20))) AS error_code, event_type AS error_scope,
          concat('C', CAST(event_id % 61 AS VARCHAR(20))) AS class_fqn, concat('m', CAST(event_id % 7 AS VARCHAR(20))) AS method_name,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 500 END AS line_no
        FROM events""",
    "reached": """
        SELECT DISTINCT CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat('TX', CAST(c_custkey % 200 AS VARCHAR(20))) END AS tx_id, CASE c_nationkey % 3 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' END AS domain_key,
          concat('C', CAST(c_custkey % 50 AS VARCHAR(20))) AS class_fqn, concat('m', CAST(c_custkey % 5 AS VARCHAR(20))) AS method_name,
          CASE WHEN c_custkey % 2 = 0 THEN concat('pbcb', CAST(c_custkey % 11 AS VARCHAR(20))) END AS component_code
        FROM customer""",
    # tables of a data model with their key sets: an order is a table, its parts are the columns; the
    # first two lines of every fifth are its key
    "key_sets": """
        SELECT DISTINCT concat('t', CAST(l_orderkey AS VARCHAR(20))) AS table_name, 1 AS key_id, concat('c', CAST(l_partkey AS VARCHAR(20))) AS column_name FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <= 2
        UNION ALL SELECT concat('t', CAST(o_orderkey AS VARCHAR(20))), 2, 'name' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey < 200""",
    "table_columns": """
        SELECT DISTINCT concat('t', CAST(l_orderkey AS VARCHAR(20))) AS table_name, concat('c', CAST(l_partkey AS VARCHAR(20))) AS column_name FROM lineitem
        UNION ALL SELECT concat('t', CAST(o_orderkey AS VARCHAR(20))), 'name' FROM orders WHERE o_orderkey % 50 = 0""",
    # calls between methods: chains of eleven within blocks of twelve, with a cycle in each
    "calls": """
        SELECT 'CALLS' AS etype, concat('M', CAST(c_custkey AS VARCHAR(20))) AS src, concat('M', CAST(c_custkey + 1 AS VARCHAR(20))) AS dst, c_custkey AS line_no FROM customer WHERE c_custkey % 12 <> 11
        UNION ALL SELECT 'SELF_CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), concat('M', CAST(c_custkey - 5 AS VARCHAR(20))), c_custkey FROM customer WHERE c_custkey % 12 = 5
        UNION ALL SELECT 'SYS_UTIL_CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), concat('SVOP:', CAST(c_custkey % 40 AS VARCHAR(20))), c_custkey FROM customer WHERE c_custkey % 5 = 2
        UNION ALL SELECT 'DAO_CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), concat('D', CAST(c_nationkey AS VARCHAR(20)), '.m', CAST(c_custkey % 2 AS VARCHAR(20))), c_custkey FROM customer WHERE c_custkey % 3 = 1""",
    # the same calls with what stands at their ends, calls of classes and interfaces by a method's
    # name, and calls that lead from one block to the first method of another
    "call_facts": """
        SELECT etype, src, CASE WHEN etype = 'SYS_UTIL_CALLS' THEN 'ServiceOperation' ELSE 'Method' END AS label, dst, CAST(NULL AS VARCHAR(20)) AS method_name FROM calls WHERE etype <> 'DAO_CALLS'
        UNION ALL SELECT 'DAO_CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), 'DaoMethod', CASE WHEN c_custkey % 21 = 4 THEN ' ' ELSE concat('D', CAST(c_nationkey AS VARCHAR(20))) END, CASE WHEN c_custkey % 15 = 1 THEN '' ELSE 'find' END FROM customer WHERE c_custkey % 3 = 1
        UNION ALL SELECT 'CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), 'Class', concat('K', CAST(c_custkey % 12 AS VARCHAR(20))), concat('f', CAST(c_custkey % 3 AS VARCHAR(20))) FROM customer WHERE c_custkey % 7 = 3
        UNION ALL SELECT 'SYS_UTIL_CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), 'Interface', concat('I', CAST(c_custkey % 20 AS VARCHAR(20))), concat('p', CAST(c_custkey % 4 AS VARCHAR(20))) FROM customer WHERE c_custkey % 11 = 4
        UNION ALL SELECT 'CALLS', concat('M', CAST(c_custkey AS VARCHAR(20))), 'Method', concat('M', CAST(c_custkey % 12 * 12 AS VARCHAR(20))), NULL FROM customer WHERE c_custkey % 13 = 6""",
    "impl_methods": """
        SELECT concat('M', CAST(c_custkey AS VARCHAR(20))) AS signature, concat('K', CAST({div:c_custkey,12} % 12 AS VARCHAR(20))) AS class_fqn, concat('f', CAST({div:c_custkey,12} % 3 AS VARCHAR(20))) AS name FROM customer WHERE c_custkey % 12 = 0 OR c_custkey % 60 = 3""",
    "implements": """
        SELECT concat('SVOP:', CAST({div:c_custkey,12} AS VARCHAR(20))) AS code, concat('M', CAST(c_custkey AS VARCHAR(20))) AS signature FROM customer WHERE c_custkey < 480 AND (c_custkey % 12 = 0 OR c_custkey % 60 = 3)""",
    "operations": """
        SELECT concat('SVOP:', CAST(c_custkey AS VARCHAR(20))) AS code, CASE c_custkey % 4 WHEN 0 THEN 'pbcb' WHEN 1 THEN 'pbs' WHEN 2 THEN 'PBCP' END AS node_kind, concat('I', CAST(c_custkey % 20 AS VARCHAR(20))) AS interface_fqn, concat('p', CAST(c_custkey % 4 AS VARCHAR(20))) AS method_name FROM customer WHERE c_custkey < 40""",
    # flow steps: operations with their methods, and every tenth a method step
    "flow_steps": """
        SELECT o_orderkey AS tx, concat('TX ', CAST(o_orderkey % 90 AS VARCHAR(20))) AS tx_name, CASE o_custkey % 2 WHEN 0 THEN 'dept' END AS domain_key, p.code, coalesce(p.node_kind, 'pbs') AS prefix, i.signature
        FROM orders JOIN operations p ON p.code = concat('SVOP:', CAST(o_custkey % 40 AS VARCHAR(20))) LEFT JOIN implements i ON i.code = p.code
        UNION ALL SELECT o_orderkey, concat('TX ', CAST(o_orderkey % 90 AS VARCHAR(20))), CASE o_custkey % 2 WHEN 0 THEN 'dept' END, concat('step', CAST(o_custkey % 50 AS VARCHAR(20))), 'method', concat('M', CAST(o_custkey AS VARCHAR(20))) FROM orders WHERE o_orderkey % 10 = 0""",
    # direct references of flow steps to services: by operation, and by method
    "service_steps": "SELECT concat('TX:', CAST(o_orderkey AS VARCHAR(20)), ':SERVICE:1') AS step_key, o_orderkey AS tx, o_custkey AS svc FROM orders WHERE o_orderkey % 5 <> 0",
    "method_steps": "SELECT concat('TX:', CAST(o_orderkey AS VARCHAR(20)), ':METHOD:1') AS step_key, o_orderkey AS tx, concat('M', CAST(o_custkey AS VARCHAR(20))) AS signature FROM orders WHERE o_orderkey % 5 = 0",
    "svc_methods": "SELECT c_custkey AS svc, concat('M', CAST(c_custkey AS VARCHAR(20))) AS signature FROM customer WHERE c_custkey % 4 <> 3",
    "svc_domains": "SELECT c_custkey AS svc, CASE WHEN c_custkey % 6 = 0 THEN 'sett' END AS svc_domain FROM customer",
    # layers: a transaction is an order, a service a customer, a component a supplier, a table a part
    "tx_steps": """
        SELECT o_orderkey AS tx, concat('TX ', o_orderpriority, ' ', CAST(o_custkey % 100 AS VARCHAR(20))) AS tx_name, CASE o_custkey % 3 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' ELSE 'comm' END AS domain_key, o_custkey AS svc FROM orders""",
    "comp_steps": """
        SELECT o_orderkey AS tx, concat('TX ', o_orderpriority, ' ', CAST(o_custkey % 100 AS VARCHAR(20))) AS tx_name, CASE o_custkey % 3 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' ELSE 'comm' END AS domain_key, o_orderkey % (SELECT count(*) FROM supplier) AS comp FROM orders WHERE o_orderkey % 9 = 2""",
    "svc_svc": """
        SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE c_custkey % 12 <> 11 AND c_custkey < (SELECT max(c_custkey) FROM customer)
        UNION ALL SELECT c_custkey, c_custkey - 5 FROM customer WHERE c_custkey % 12 = 5""",
    "svc_comp": "SELECT DISTINCT c_custkey AS src, c_custkey % (SELECT count(*) FROM supplier) AS dst FROM customer",
    "comp_comp": """
        SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier WHERE s_suppkey % 6 <> 5 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)""",
    "comp_table": "SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS src, p_partkey AS dst FROM part WHERE p_size > 0",
    "svc_table": "SELECT c_custkey AS src, CAST(c_nationkey AS BIGINT) AS dst FROM customer",
}

_needs = {name: [t for t in [*TABLES, *VIEWS] if t != name and re.search(rf"(?:FROM|JOIN)\s+{t}\b", sql)] for name, sql in VIEWS.items()}


def _written(sql: str, dialect: str) -> str:
    names = _DIALECTS[dialect]
    return re.sub(r"\{(\w+):([^}]*)\}", lambda m: names[m[1]].format(*(x.strip() for x in m[2].split(","))), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fixture view, or a test table by its name. given: tables to use instead, such as streams."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = _written(VIEWS[name], "spark")
    inputs = {}
    for need in _needs[name]:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{need}\b", rf"\1 {{{need}}}", sql)
        inputs[need] = view(spark, sf_dir, need, given)
    return spark.sql(sql, **inputs)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a test table as a stream, one a micro-batch."""
    source = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet")
    return source.option("maxFilesPerTrigger", 1).parquet(sf_dir)


def ctes(*names: str) -> str:
    """WITH ...: the views and what they need, for DuckDB; more can follow after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in TABLES and name not in order:
            for need in _needs[name]:
                add(need)
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_written(VIEWS[n], 'duckdb')})" for n in order)
