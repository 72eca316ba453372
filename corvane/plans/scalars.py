"""Scalar functions over inputs made from the test tables. Each input is one SQL text for both
engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, table, view
from ..functions import predicates as Q
from ..functions import scalar as S
from ..sources import ddl as D
from ..sources import parsers as P

PLAN = Plan()


def made(spark, sf_dir, sql):
    text, _, name = sql.rpartition(" FROM ")
    return spark.sql(text.replace("{", "{{").replace("}", "}}") + " FROM {src}", src=table(spark, sf_dir, name))


def scalar(name: str, source: str, duck: str, /, **columns):
    """A query of key and function columns, made when it runs, and the same in SQL."""

    @PLAN.query(name, f"WITH src AS ({source}) SELECT k, {duck} FROM src")
    def run(spark, sf_dir):
        return made(spark, sf_dir, source).select("k", *(c().alias(n) for n, c in columns.items()))

    run.__doc__ = f"{name}: {', '.join(columns)} of each row."


N = "CAST({} AS VARCHAR(20))".format
scalar("op_sc02_domain_key", f"SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'dept-parent' WHEN 1 THEN 'ccbs-loan-bcc' ELSE 'misc' END AS p, CASE o_orderkey % 3 WHEN 0 THEN 'org.bank.core.sett.x' WHEN 1 THEN 'org.bank' END AS pkg FROM orders",
    "CASE WHEN p = 'dept-parent' THEN 'dept' WHEN p = 'ccbs-loan-bcc' THEN 'loan' WHEN pkg = 'org.bank.core.sett.x' THEN 'sett' ELSE 'platform' END AS domain", domain=lambda: S.domain_key("p", "pkg"))
scalar("op_sc03_biz_kind", "SELECT event_id AS k, concat(CASE event_id % 4 WHEN 0 THEN 'HotSpot-' WHEN 1 THEN 'Batch' WHEN 2 THEN 'online.batch' ELSE '' END, event_type) AS s FROM events",
    "CASE WHEN lower(s) LIKE '%hotspot%' THEN '热点账户' WHEN lower(s) LIKE '%batch%' THEN '批量' WHEN lower(s) LIKE '%online%' THEN '联机' END AS kind", kind=lambda: S.biz_kind("s"))
scalar("op_sc04_cost", f"SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN concat({N('o_custkey')}, ',', {N('o_orderkey % 900 + 100')}, 'ms') WHEN 1 THEN concat('cost=', {N('o_custkey')}, 'ms of 7') WHEN 2 THEN 'n/a' END AS raw FROM orders",
    "coalesce(try_cast(regexp_extract(replace(raw, ',', ''), '([0-9]+)', 1) AS BIGINT), 0) AS cost", cost=lambda: S.cost("raw"))
scalar("op_sc05_text_hash", "SELECT doc_id AS k, text AS t FROM documents", "sha256(trim(t, array_to_string(list_transform(range(33), lambda i: chr(i::INT)), ''))) AS h", h=lambda: S.text_hash("t"))
scalar("op_sc07_valid_round", f"SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN concat('2026-', {N('o_orderkey')}) WHEN 1 THEN '  ' WHEN 2 THEN 'a,b' WHEN 3 THEN '012345678901234567890' END AS r FROM orders",
    "coalesce(trim(r) <> '' AND length(r) <= 20 AND NOT contains(r, ','), false) AS ok", ok=lambda: S.valid_round("r"))
scalar("op_sc08_location", f"SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat(' [ODB:q', {N('o_custkey')}, '] ') WHEN 1 THEN '[[nsql:a.b]]' WHEN 2 THEN 'x.Y' WHEN 3 THEN '[]' WHEN 4 THEN 'odb:z' END AS raw FROM orders",
    "CASE k % 6 WHEN 0 THEN trim(raw, ' []') WHEN 1 THEN 'nsql:a.b' WHEN 2 THEN 'x.Y' WHEN 4 THEN 'odb:z' END AS place, CASE k % 6 WHEN 0 THEN 'ODB' WHEN 1 THEN 'NSQL' WHEN 2 THEN 'PLATFORM' WHEN 4 THEN 'ODB' END AS kind, CASE k % 6 WHEN 0 THEN 'q' || regexp_extract(raw, 'q([0-9]+)', 1) WHEN 1 THEN 'a.b' WHEN 2 THEN 'x.Y' WHEN 4 THEN 'z' END AS name",
    place=lambda: S.location("raw"), kind=lambda: S.location_kind(S.location("raw")), name=lambda: S.after_colon(S.location("raw")))
SQLS = f"SELECT o_orderkey AS k, concat(CASE o_orderkey % 3 WHEN 0 THEN '/* c */ ' WHEN 1 THEN '  ' ELSE '' END, CASE o_orderkey % 7 WHEN 0 THEN 'SELECT a FROM X.Orders o JOIN customer c ON c.id = #id#' WHEN 1 THEN concat('update T1 set a = :v::int where b = $', '{{b}}') WHEN 2 THEN 'DELETE from T2' WHEN 3 THEN 'insert into t3 (a) values (?)' WHEN 4 THEN 'Insert into t4 select * from t5' WHEN 5 THEN 'with q as (select 1) select * from q' ELSE 'explain x' END) AS q FROM orders"
scalar("op_sc10_sql_kind", SQLS, "CASE k % 7 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 3 THEN 'INSERT_VALUES' WHEN 4 THEN 'INSERT_SELECT' WHEN 5 THEN 'SELECT' ELSE 'UNKNOWN' END AS kind", kind=lambda: S.sql_kind("q"))
scalar("op_sc11_placeholders", SQLS, "replace(replace(replace(q, '#id#', '?'), ':v::int', '?::int'), '${b}', '?') AS q2", q2=lambda: S.placeholders("q"))
scalar("op_sc12_table_names", SQLS, "CASE k % 7 WHEN 0 THEN 'orders,customer' WHEN 1 THEN 't1' WHEN 2 THEN 't2' WHEN 3 THEN 't3' WHEN 4 THEN 't4,t5' WHEN 5 THEN 'q' ELSE '' END AS names", names=lambda: S.table_names("q"))
TYPES = f"SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN concat('VARCHAR(', {N('p_size')}, ')') WHEN 1 THEN 'character varying' WHEN 2 THEN 'int4' WHEN 3 THEN 'bigint' WHEN 4 THEN 'timestamp without time zone' WHEN 5 THEN 'date' WHEN 6 THEN 'interval' WHEN 7 THEN 'numeric(10,2)' END AS t, p_size AS n FROM part"
scalar("op_sc14_safe_literal", TYPES, "CASE k % 9 WHEN 2 THEN '1' WHEN 3 THEN '1' WHEN 4 THEN '''2000-01-01 00:00:00''' WHEN 5 THEN '''2000-01-01''' WHEN 6 THEN '1' WHEN 7 THEN '1' ELSE '''X''' END AS lit", lit=lambda: S.safe_literal("t"))
scalar("op_sc26_key_width", TYPES, "CASE k % 9 WHEN 0 THEN n WHEN 1 THEN 1000 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 5 THEN 4 ELSE 8 END::INT AS w, coalesce(CASE k % 9 WHEN 0 THEN n WHEN 1 THEN 1000 ELSE 8 END > 200, false) AS too_long", w=lambda: S.key_width("t"), too_long=lambda: S.key_width("t") > 200)
scalar("op_sc16_share_percent", "SELECT o_orderkey AS k, o_custkey % 97 AS a, o_custkey % 89 AS b FROM orders", "CASE WHEN b = 0 THEN 0.0 ELSE floor(a * 1000.0::DOUBLE / b + 0.5) / 10.0 END AS share", share=lambda: S.share_percent(F.col("a"), F.col("b")))
scalar("op_sc17_person_type", f"SELECT s_suppkey AS k, concat(CASE s_suppkey % 3 WHEN 0 THEN 'T-' WHEN 1 THEN 'c-' ELSE 'x' END, 'a@b') AS e, CASE WHEN s_suppkey % 5 = 0 THEN 'STAFF' END AS a FROM supplier", "coalesce(a, CASE WHEN k % 3 < 2 THEN 'VENDOR' ELSE 'STAFF' END) AS kind", kind=lambda: S.person_type("e", "a"))
scalar("op_sc18_ellipsis", "SELECT doc_id AS k, text AS t FROM documents", "CASE WHEN length(t) > 500 THEN left(t, 497) || '...' ELSE t END AS short", short=lambda: S.ellipsis("t", 500))
LOGS = f"SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN 'broken line' WHEN 1 THEN concat('[2026-01-02 03:04:05][x][W]->[n', {N('user_id')}, '.find] [select', chr(10), '1]') ELSE concat('[2026-01-02 03:04:0', {N('event_id % 10')}, '.12][x]->[a.q] [update t] failed to hit the index') END AS line FROM events"
scalar("op_sc19_log_line", LOGS, "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN regexp_extract(line, '->.([a-z0-9.]+)', 1) ELSE 'a.q' END AS named, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'select' || chr(10) || '1' ELSE 'update t' END AS q", named=lambda: S.log_line("line")["named"], q=lambda: S.log_line("line")["sql"])
scalar("op_sc20_log_time", LOGS, "CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN epoch(timestamp '2026-01-02 03:04:05')::BIGINT ELSE epoch(timestamp '2026-01-02 03:04:00')::BIGINT + k % 10 END AS at", at=lambda: F.unix_timestamp(S.log_time(S.log_line("line")["ts"], F.timestamp_seconds(F.lit(0)))))
scalar("op_sc21_named_project", f"SELECT o_orderkey AS k, concat('n', {N('o_custkey % 9')}, '.find') AS named FROM orders", "CASE split_part(named, '.', 1) WHEN 'n1' THEN 'p1' WHEN 'n2' THEN 'p2' ELSE 'other' END AS project",
    project=lambda: F.coalesce(F.element_at(F.create_map(*map(F.lit, ("n1", "p1", "n2", "p2"))), F.substring_index("named", ".", 1)), F.lit("other")))
scalar("op_sc22_rating", "SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS failed, o_orderkey % 5 = 0 AS seq, o_custkey AS n FROM orders", "CASE WHEN failed THEN NULL WHEN seq OR n >= 1000 THEN 'POOR' ELSE 'EXCELLENT' END AS rating", rating=lambda: S.rating(F.col("failed"), F.lit(False), F.col("seq"), F.col("n")))
scalar("op_sc24_worst_of", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'POOR' WHEN 1 THEN 'GOOD' WHEN 2 THEN 'EXCELLENT' ELSE 'NOT_APPLICABLE' END AS a, CASE o_custkey % 4 WHEN 0 THEN 'POOR' WHEN 1 THEN 'GOOD' WHEN 2 THEN 'EXCELLENT' END AS b FROM orders",
    "CASE WHEN a = 'POOR' OR b = 'POOR' THEN 'POOR' WHEN a = 'GOOD' OR b = 'GOOD' THEN 'GOOD' WHEN a = 'EXCELLENT' OR b = 'EXCELLENT' THEN 'EXCELLENT' END AS worst", worst=lambda: S.worst_of("a", "b"))
scalar("op_sc25_size_skew", "SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) * 7 AS n, (o_custkey % 100) / 100.0 AS p FROM orders", "CASE WHEN n < 10000 THEN 'SMALL' WHEN n < 1000000 THEN 'MEDIUM' ELSE 'LARGE' END AS size, CASE WHEN p > 0.5 THEN 'HIGH' WHEN p > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS skew", size=lambda: S.size_bucket("n"), skew=lambda: S.skew_level("p"))
PATHS = f"SELECT p_partkey AS k, concat('ccbs/x-bcc/loan-bcc/src/main/java/org/bank/', lower(p_name), CASE WHEN p_partkey % 2 = 0 THEN '/{{a => b}}' ELSE '' END, '/F', {N('p_partkey')}, '.java') AS p FROM part"
scalar("op_sc29_package", f"SELECT p_partkey AS k, concat('/r/src/main/java/org/bank', {N('p_size')}, '/F.java') AS p, p_size AS n FROM part", "'org.bank' || n AS package", package=lambda: S.package_of("p"))
scalar("op_sc30_renamed", PATHS, "replace(p, '{a => b}', 'b') AS path", path=lambda: S.renamed("p"))
scalar("op_sc31_module", PATHS, "'loan-bcc' AS module", module=lambda: S.module_of("p"))
scalar("op_sc32_node_kind", f"SELECT s_suppkey AS k, concat(CASE s_suppkey % 5 WHEN 0 THEN 'PbcbX' WHEN 1 THEN 'pbcp' WHEN 2 THEN 'PBS' WHEN 3 THEN 'pcs' ELSE 'z' END, {N('s_suppkey')}) AS n FROM supplier", "CASE k % 5 WHEN 0 THEN 'pbcb' WHEN 1 THEN 'pbcp' WHEN 2 THEN 'pbs' WHEN 3 THEN 'pcs' ELSE 'service' END AS kind, k % 5 < 2 AS component", kind=lambda: S.node_kind("n"), component=lambda: S.is_component("n"))
scalar("op_sc33_table_domain", "SELECT p_partkey AS k, lower(p_name) AS t FROM part", "CASE WHEN contains(replace(replace(t, '-', '_'), ' ', '_'), 'a_') THEN 'dept' WHEN contains(replace(replace(t, '-', '_'), ' ', '_'), 'e') THEN 'loan' END AS domain", domain=lambda: F.when(F.translate("t", "- ", "__").contains("a_"), "dept").when(F.translate("t", "- ", "__").contains("e"), "loan"))
HOMES = f"SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'ccbs-loan-bcc' WHEN 1 THEN 'misc' WHEN 2 THEN ' ' WHEN 3 THEN 'Dept-parent' ELSE 'ccbs-comm-x' END AS module, CASE p_partkey % 4 WHEN 0 THEN 'com.bank.LTdept_x' WHEN 1 THEN 'a.b.c.loan' WHEN 2 THEN concat('a.b.c.d', {N('p_size')}) END AS package, CASE p_partkey % 3 WHEN 0 THEN '/w/kst-1/t.xml' WHEN 1 THEN '/w/stmt/t.xml' ELSE concat('/w/t', {N('p_partkey')}, '.xml') END AS path FROM part"
scalar("op_sc33_domain_rules", HOMES, "CASE WHEN k % 5 = 0 THEN 'loan' WHEN k % 5 = 1 THEN 'platform' WHEN k % 4 = 0 THEN 'deposit' WHEN k % 3 = 0 THEN 'settlement' WHEN k % 5 = 4 OR k % 3 = 1 THEN 'public' WHEN k % 4 = 1 THEN 'loan' ELSE 'platform' END AS domain", domain=lambda: S.table_domain("module", "package", "path"))
scalar("op_sc35_status_label", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING_L1' END AS s FROM orders", "coalesce(CASE s WHEN 'APPROVED' THEN 'approved' WHEN 'PENDING_L1' THEN 'first level' END, '-') AS label", label=lambda: F.coalesce(F.element_at(F.create_map(*map(F.lit, ("APPROVED", "approved", "PENDING_L1", "first level"))), F.col("s")), F.lit("-")))
scalar("op_sc35_whitelist_label", "SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'PENDING_L1' WHEN 1 THEN 'PENDING_L2' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'REJECTED_L1' WHEN 4 THEN 'REJECTED_L2' WHEN 5 THEN 'CANCELLED' WHEN 6 THEN ' ' WHEN 7 THEN 'odd' END AS s FROM orders", "CASE k % 9 WHEN 0 THEN '待一级' WHEN 1 THEN '待二级' WHEN 2 THEN '已通过' WHEN 3 THEN '一级退回' WHEN 4 THEN '二级退回' WHEN 5 THEN '已取消' WHEN 7 THEN 'odd' ELSE '未申请' END AS label", label=lambda: S.whitelist_label("s"))
scalar("op_sc37_build_type", "SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '成功' WHEN 1 THEN '触发失败' END AS a, CASE o_orderkey % 5 WHEN 0 THEN 'Failed' WHEN 1 THEN 'SUCCESS' END AS s FROM orders", "CASE WHEN k % 3 = 0 THEN 'success' WHEN k % 3 = 1 THEN 'error' WHEN k % 5 = 0 THEN 'error' WHEN k % 5 = 1 THEN 'success' ELSE 'running' END AS type", type=lambda: S.build_status("a", "s")["type"])
scalar("op_sc37_build_status", "SELECT o_orderkey AS k, o_orderkey % 4 AS n FROM orders", "CASE n WHEN 0 THEN 'success' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'unknown' END AS status", status=lambda: F.when(F.col("n") == 0, "success").when(F.col("n") == 1, "running").when(F.col("n") == 2, "failed").otherwise("unknown"))
scalar("op_sc38_keyword", "SELECT p_partkey AS k, p_name AS n FROM part", "lower(n) LIKE '%ar%' AS hit", hit=lambda: S.contains_any(" AR ", "n"))
scalar("op_flt10_prefix_blocklist", SQLS, "upper(trim(q)) LIKE 'SELECT%' OR upper(trim(q)) LIKE 'DELETE%' AS blocked", blocked=lambda: S.starts_with_any("q", ["select", "Delete"]))
scalar("op_flt12_extensions", f"SELECT p_partkey AS k, concat(CASE WHEN p_partkey % 4 = 0 THEN '/tmp/' ELSE '/src/' END, {N('p_partkey')}, CASE p_partkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.xml' ELSE '.md' END) AS p FROM part", "k % 3 < 2 AND k % 4 > 0 AS wanted", wanted=lambda: Q.wanted_file("p", ["Java"], ["/tmp/"]))
scalar("op_flt13_packages", f"SELECT p_partkey AS k, concat(CASE p_partkey % 3 WHEN 0 THEN 'org.bank.' WHEN 1 THEN 'com.bank.' ELSE 'net.' END, 'x') AS p FROM part", "k % 3 < 2 AS allowed", allowed=lambda: Q.included_package("p", "org.bank, com.bank"))
scalar("op_flt14_domains", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'dept' WHEN 1 THEN 'loan' WHEN 2 THEN 'x' END AS d FROM customer", "coalesce(d IN ('dept', 'loan', 'platform'), false) AS allowed", allowed=lambda: Q.allowed_domain("d", ["dept", "loan", "platform"]))
scalar("op_src02_size_guard", "SELECT doc_id AS k, text AS t FROM documents", "strlen(t) <= 500 * 1024 AS whole, CASE WHEN strlen(t) <= 4096 THEN length(t) END AS n", whole=lambda: F.octet_length("t") <= 500 * 1024, n=lambda: F.when(F.octet_length("t") <= 4096, F.char_length("t").cast("long")))

MIXED = f"SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN '/no/F.java' ELSE concat('/w/a-bcc', CASE p_partkey % 4 WHEN 0 THEN '/loan-bcc/src' WHEN 1 THEN '/x/dept-bcc' WHEN 2 THEN '/bcc' ELSE '' END, '/F', {N('p_partkey')}, '.java') END AS p FROM part"
scalar("op_sc31_modules", MIXED, "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN 'loan-bcc' WHEN k % 4 = 1 THEN 'dept-bcc' ELSE 'a-bcc' END AS module", module=lambda: S.module_of("p"))
MARKED = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'OPTIMIZED' WHEN 1 THEN 'REGRESSED' WHEN 2 THEN ' ' END AS s, concat('r', CAST(o_custkey % 9 AS VARCHAR(20))) AS a, CASE WHEN o_orderkey % 3 = 0 THEN concat('q', CAST(o_custkey % 7 AS VARCHAR(20))) END AS b FROM orders"
scalar("op_sc35_optimise_label", MARKED, "CASE k % 4 WHEN 0 THEN '已优化@' || a WHEN 1 THEN '优化未生效(' || a || '标→' || coalesce(b, '') || '现)' ELSE '未处理' END AS label, CASE WHEN b IS NULL THEN a ELSE a || '(' || b || ')' END AS who", label=lambda: S.optimise_label("s", "a", "b"), who=lambda: S.optimise_operator("a", "b"))
JSONS = f"""SELECT doc_id AS k, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN 'no json' ELSE concat('[{{{{"severity":"HIGH","type":"T', {N('doc_id % 9')}, '","description":"d"}}}},{{{{"type":"U","scope":"table","reason":"r', {N('doc_id % 7')}, '","newSql":"select ', {N('doc_id')}, '"}}}}]') END AS j FROM documents"""
scalar("op_sc34_formatted", JSONS.replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}"), "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN j ELSE '[HIGH] T' || (k % 9) || ' - d' || chr(10) || '[LOW] U' END AS findings, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN j ELSE '【SQL 级】T' || (k % 9) || repeat(chr(10), 3) || '【表级】U' || chr(10) || '理由：r' || (k % 7) || chr(10) || '新 SQL：select ' || k END AS suggestions", findings=lambda: S.findings_text("j"), suggestions=lambda: S.suggestions_text("j"))
LARGE = f"SELECT p_partkey AS k, concat(CASE p_partkey % 4 WHEN 0 THEN '/r/src/main/java/' WHEN 1 THEN 'C:\\\\r\\\\target\\\\gen\\\\' WHEN 2 THEN '/r/generated-sources/' ELSE '/r/other/' END, 'org/bank/F', {N('p_partkey')}, '.java') AS p FROM part"
scalar("op_src22_inferred_fqn", LARGE.replace("'C:\\\\r\\\\target\\\\gen\\\\'", "concat('C:', chr(92), 'r', chr(92), 'target', chr(92), 'gen', chr(92))"), "CASE WHEN k % 4 < 3 THEN 'org.bank.F' || k END AS fqn", fqn=lambda: P.inferred_fqn("p"))


CHAINS = "SELECT l_orderkey AS k, count(*) AS n_services, count(DISTINCT l_suppkey) + 4 AS n_components, count(DISTINCT l_partkey) + 2 AS n_tables, CASE WHEN l_orderkey % 3 > 0 THEN count(*) END AS n_snippets FROM lineitem GROUP BY 1"


@PLAN.query("op_sc36_chain_findings", f"WITH c AS ({CHAINS}), f AS (SELECT k, 1 AS ord, 'deep-service-chain' AS key, 'serviceCount=' || n_services AS evidence FROM c WHERE n_services >= 8 UNION ALL SELECT k, 2, 'wide-component-fanout', 'componentCount=' || n_components FROM c WHERE n_components >= 10 UNION ALL SELECT k, 3, 'multi-table-access', 'tableCount=' || n_tables FROM c WHERE n_tables >= 8 UNION ALL SELECT k, 4, 'missing-snippets', 'codeSnippets=0' FROM c WHERE n_snippets IS NULL) SELECT k, key, CASE WHEN ord = 4 THEN 'info' ELSE 'medium' END AS severity, evidence FROM f")
def sc36_findings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    chains = lines.agg(F.count("*").alias("a"), (F.count_distinct("l_suppkey") + 4).alias("b"), (F.count_distinct("l_partkey") + 2).alias("c")).withColumn("d", F.when(F.col("k") % 3 > 0, F.col("a")))
    return chains.select("k", F.explode(S.chain_findings("a", "b", "c", "d")).alias("x")).select("k", "x.key", "x.severity", "x.evidence")


RULES = [("n_services", 8, "MANY_SERVICES"), ("n_components", 10, "MANY_COMPONENTS"), ("n_tables", 8, "MANY_TABLES")]


@PLAN.query("op_sc36_chain_rules", "WITH c AS (SELECT l_orderkey AS k, count(*) AS n_services, count(DISTINCT l_suppkey) AS n_components, count(DISTINCT l_partkey) AS n_tables FROM lineitem GROUP BY 1) SELECT k, 'MANY_SERVICES' AS rule FROM c WHERE n_services >= 8 UNION ALL SELECT k, 'MANY_COMPONENTS' FROM c WHERE n_components >= 10 UNION ALL SELECT k, 'MANY_TABLES' FROM c WHERE n_tables >= 8")
def sc36(spark, sf_dir):
    chains = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_services"), F.count_distinct("l_suppkey").alias("n_components"), F.count_distinct("l_partkey").alias("n_tables"))
    broken = F.array_compact(F.array(*(F.when(F.col(c) >= n, rule) for c, n, rule in RULES)))
    return chains.select("k", F.explode(broken).alias("rule"))


@PLAN.query("op_sc09_module_domain", ctes("items") + ", m AS (SELECT * FROM (VALUES ('ccbs-dept-bcc', 'dept'), ('misc', 'other')) v(project, d)) SELECT id, coalesce(m.d, CASE WHEN id % 2 = 0 THEN 'platform' END) AS domain FROM items LEFT JOIN m USING (project)")
def sc09(spark, sf_dir):
    known = F.broadcast(spark.createDataFrame([("ccbs-dept-bcc", "dept"), ("misc", "other")], "project string, d string"))  # two rows
    return view(spark, sf_dir, "items").join(known, "project", "left").select("id", F.coalesce("d", F.when(F.col("id") % 2 == 0, "platform")).alias("domain"))


@PLAN.query("op_sc34_findings_text", ctes("items") + " SELECT id, '1. ' || project || '; 2. ' || named_sql AS findings FROM items")
def sc34(spark, sf_dir):
    """Findings as JSON and then as numbered text."""
    json = F.to_json(F.array(F.struct(F.col("project").alias("text")), F.struct(F.col("named_sql").alias("text"))))
    found = F.from_json(json, "array<struct<text:string>>")
    return view(spark, sf_dir, "items").select("id", F.array_join(F.transform(found, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "; ").alias("findings"))


TABLE_DDL = f"""SELECT o_orderkey AS id, concat('-- CREATE TABLE no (x text)', chr(10), 'create table if not exists corp."T', {N('o_orderkey')}, '" ( id bigint not null, name VARCHAR( ', {N('o_custkey % 300')}, ' ) default ''a, (b'', ',
  'amount numeric(10, 2) check (amount > 0), note text /* , gone int */, "Made at" timestamp with time zone, constraint pk primary key (id, name), unique (amount))') AS ddl FROM orders"""
INDEX_DDL = f"""SELECT o_orderkey AS id, concat('CREATE ', CASE WHEN o_orderkey % 2 = 0 THEN 'UNIQUE ' ELSE '' END, 'INDEX ix ON corp.t', {N('o_orderkey + o_orderkey % 2')}, CASE o_orderkey % 3 WHEN 0 THEN ' using btree (name DESC, id)' WHEN 1 THEN '(amount, other)' ELSE ' (lower(x), NAME)' END) AS ddl FROM orders"""


@PLAN.query("op_sc26_ddl_columns", f"WITH d AS ({TABLE_DDL}), c AS (SELECT * FROM (VALUES (1, 'id', 'bigint'), (2, 'name', NULL), (3, 'amount', 'numeric(10,2)'), (4, 'note', 'text'), (5, 'Made at', 'timestamp with time zone')) v(at_, column_name, t)) SELECT id, 'T' || id AS table_name, at_::INT AS at, column_name, coalesce(t, 'VARCHAR(' || regexp_extract(ddl, 'VARCHAR. ([0-9]+)', 1) || ')') AS data_type FROM d, c")
def sc26_columns(spark, sf_dir):
    """Columns of tables out of DDL, past comments, quotes, checks and constraints."""
    return D.columns(made(spark, sf_dir, TABLE_DDL), "id", "ddl").select("id", "table_name", "at", "column_name", "data_type")


@PLAN.query(
    "op_sc28_length_guard",
    f"WITH t AS (SELECT o_orderkey AS k, o_custkey % 300 AS w FROM orders), i AS (SELECT o_orderkey AS id, o_orderkey + o_orderkey % 2 AS k, o_orderkey % 3 AS kind FROM orders), w AS (SELECT id, t.k, CASE kind WHEN 0 THEN w + 8 WHEN 1 THEN 16 ELSE w + 8 END AS n, CASE kind WHEN 0 THEN 'name(' || w || ') + id(8)' WHEN 1 THEN 'amount(8) + other(8)' ELSE 'lower(8) + NAME(' || w || ')' END AS parts FROM i JOIN t USING (k)) "
    "SELECT id, 't' || k AS table_name, n::BIGINT AS key_length, n > 200 AS exceeds, CASE WHEN n > 200 THEN 'check | ⚠️ 该 DDL 新建索引键长 = ' || parts || ' = ' || n || ' > 200，不建议执行' ELSE 'check' END AS warning FROM w",
)
def sc28(spark, sf_dir):
    """Suggested indexes by the widths of their tables' columns, both out of DDL."""
    tables, indexes = (D.columns(made(spark, sf_dir, sql), "id", "ddl") for sql in (TABLE_DDL, INDEX_DDL))
    return D.key_lengths(indexes, tables, "id").select("id", "table_name", "key_length", "exceeds", D.guarded(F.lit("check")).alias("warning"))
