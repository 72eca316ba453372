"""Inspected statements, the pool and their dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, view
from ..functions import predicates as P
from ..functions import scalar as S
from ..operators import dashboards as D

PLAN = Plan()
LABEL = "CASE WHEN lower(project) LIKE '%dept-bcc%' THEN '存款' WHEN lower(project) LIKE '%loan-bcc%' THEN '贷款' WHEN lower(project) LIKE '%comm-bcc%' THEN '公共' WHEN lower(project) LIKE '%sett-bcc%' THEN '结算' ELSE '其他' END"
ERR = "coalesce(explain_error <> '', false)"
APPLYING = "(is_whitelist = 0 AND whitelist_status IN ('PENDING_L1', 'PENDING_L2', 'REJECTED_L1', 'REJECTED_L2'))"
APPROVED = "(is_whitelist = 1 OR whitelist_status = 'APPROVED')"
PLAIN = "(is_whitelist = 0 AND (whitelist_status IS NULL OR whitelist_status = 'CANCELLED'))"
RATED = "rating IN ('EXCELLENT', 'GOOD', 'POOR')"
BANDS = f"""count(*) FILTER ({ERR} OR (NOT {ERR} AND {RATED})) AS total, count(*) FILTER ({PLAIN} AND {ERR}) AS explain_err, count(*) FILTER ({PLAIN} AND NOT {ERR} AND rating = 'POOR') AS need_fix,
  count(*) FILTER ({APPLYING}) AS wl_applying, count(*) FILTER ({APPROVED}) AS wl_approved"""
POOL_BANDS = BANDS + f", count(*) FILTER (NOT {ERR} AND rating IS NULL) AS unanalysed"
SHOW = f"({ERR} OR coalesce(llm_status IN ('DONE', 'PENDING', 'FAILED'), false))"
POOL_SHOW = f"({SHOW} OR (explain_error IS NULL AND rating IS NULL))"
ENV = "coalesce(env, '') IN ('', 'prod')"
KPI = f"count(*) AS total, count(*) FILTER ({ERR}) AS explain_error, count(*) FILTER (llm_status = 'DONE') AS llm_findings, count(*) FILTER (llm_status = 'PENDING') AS llm_pending, count(*) FILTER (llm_status = 'FAILED') AS llm_error"
ITEMS, POOL, BOTH = ctes("items"), ctes("pool"), ctes("items", "pool")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "items")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pool")


@PLAN.query("op_agg05_domain_dashboard", ITEMS + f" SELECT {LABEL} AS domain, {BANDS} FROM items GROUP BY 1")
def agg05(spark, sf_dir):
    return D.by_domain(items(spark, sf_dir))


@PLAN.query("op_agg06_remediation", ITEMS + f" SELECT {LABEL} AS domain, count(*) FILTER ({ERR}) AS error_count, count(*) FILTER (NOT {ERR} AND rating = 'POOR') AS need_fix, count(*) FILTER (NOT {ERR} AND rating = 'EXCELLENT') AS fine, count(*) FILTER ({APPROVED}) AS exempt FROM items GROUP BY 1")
def agg06(spark, sf_dir):
    return D.remediation(items(spark, sf_dir))


@PLAN.query("op_agg07_pool_dashboard", POOL + f" SELECT {LABEL} AS domain, {POOL_BANDS} FROM pool WHERE {ENV} GROUP BY 1")
def agg07(spark, sf_dir):
    return D.by_domain(pool(spark, sf_dir).where(P.in_env("prod")), unanalysed=True)


@PLAN.query("op_agg08_merged_dashboard", BOTH + f", a AS (SELECT {LABEL} AS domain, {BANDS} FROM items GROUP BY 1 UNION ALL SELECT {LABEL}, {BANDS} FROM pool GROUP BY 1) SELECT domain, sum(total)::BIGINT AS total, sum(explain_err)::BIGINT AS explain_err, sum(need_fix)::BIGINT AS need_fix, sum(wl_applying)::BIGINT AS wl_applying, sum(wl_approved)::BIGINT AS wl_approved FROM a GROUP BY 1")
def agg08(spark, sf_dir):
    return D.added(D.by_domain(items(spark, sf_dir)), D.by_domain(pool(spark, sf_dir)), key=["domain"])


TASKS = ctes("tasks", "items", "pool") + ", newest AS (SELECT id AS task_id, task_no FROM tasks WHERE status = 'DONE' ORDER BY created_s DESC, id DESC LIMIT 20)"


@PLAN.query("op_agg09_trend", TASKS + f" SELECT task_no, {LABEL} AS domain, {BANDS} FROM newest LEFT JOIN items USING (task_id) GROUP BY 1, 2")
def agg09(spark, sf_dir):
    """A report of the latest twenty tasks."""
    return D.trend(view(spark, sf_dir, "tasks"), items(spark, sf_dir), 20)


@PLAN.query("op_agg10_elapsed", ctes("tasks") + " SELECT id, task_no, updated_s - created_s AS elapsed_s FROM tasks WHERE status = 'DONE' ORDER BY created_s DESC, id DESC LIMIT 10")
def agg10(spark, sf_dir):
    """A report of the latest ten tasks."""
    return D.elapsed(view(spark, sf_dir, "tasks"), 10)


@PLAN.query("op_agg11_kpi", BOTH + f", a AS (SELECT {KPI} FROM items UNION ALL SELECT {KPI} FROM pool) SELECT sum(total)::BIGINT AS total, sum(explain_error)::BIGINT AS explain_error, sum(llm_findings)::BIGINT AS llm_findings, sum(llm_pending)::BIGINT AS llm_pending, sum(llm_error)::BIGINT AS llm_error FROM a")
def agg11(spark, sf_dir):
    return D.added(D.kpi(items(spark, sf_dir)), D.kpi(pool(spark, sf_dir)), key=[])


LIST = TASKS + ", of_task AS (SELECT task_id, count(*) AS n_items, count(*) FILTER (rating = 'POOR') AS n_poor FROM items GROUP BY 1), of_env AS (SELECT coalesce(env, '') AS env, count(*) AS n_pool FROM pool GROUP BY 1) SELECT id, task_no, t.env, status, coalesce(n_items, 0) AS n_items, coalesce(n_poor, 0) AS n_poor, coalesce(n_pool, 0) AS n_pool FROM tasks t LEFT JOIN of_task ON id = task_id LEFT JOIN of_env e ON t.env = e.env"


@PLAN.query("op_agg12_task_list", LIST)
def agg12(spark, sf_dir):
    return D.task_list(view(spark, sf_dir, "tasks"), items(spark, sf_dir), pool(spark, sf_dir))


@PLAN.query("op_join04_latest_task_items", TASKS + " SELECT task_no, count(i.id) AS n FROM newest LEFT JOIN items i USING (task_id) GROUP BY 1")
def join04(spark, sf_dir):
    newest = D.latest_tasks(view(spark, sf_dir, "tasks"), 20).select(F.col("id").alias("task_id"), "task_no")
    counted = items(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"))
    return newest.join(counted, "task_id", "left").select("task_no", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@PLAN.query("op_join05_summed_sources", BOTH + ", a AS (SELECT project, count(*) AS n_items FROM items GROUP BY 1), b AS (SELECT project, count(*) AS n_pool FROM pool GROUP BY 1) SELECT a.project, n_items + coalesce(n_pool, 0) AS n FROM a LEFT JOIN b USING (project)")
def join05(spark, sf_dir):
    a = items(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n_items"))
    b = pool(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n_pool"))
    return a.join(b, "project", "left").select("project", (F.col("n_items") + F.coalesce("n_pool", F.lit(0))).alias("n"))


ISSUES = BOTH + f", issues AS (SELECT 'ITEM' AS source, id, task_id, project, named_sql, sql_hash, rating, explain_error, whitelist_status FROM items WHERE {SHOW} UNION ALL SELECT 'POOL', id, NULL, project, named_sql, sql_hash, rating, explain_error, whitelist_status FROM pool WHERE {POOL_SHOW})"


@PLAN.query("op_prj01_issue_shape", ISSUES + " SELECT * FROM issues")
def prj01(spark, sf_dir):
    return D.issues(items(spark, sf_dir), pool(spark, sf_dir))


@PLAN.query("op_set03_issue_counts", ISSUES + " SELECT source, rating, count(*) AS n FROM issues GROUP BY 1, 2")
def set03(spark, sf_dir):
    return D.issues(items(spark, sf_dir), pool(spark, sf_dir)).groupBy("source", "rating").agg(F.count("*").alias("n"))


@PLAN.query("op_srt03_two_source_page", ISSUES + " SELECT source, id, named_sql FROM issues ORDER BY source, id DESC LIMIT 300 OFFSET 100")
def srt03(spark, sf_dir):
    """A page over both sources, items first."""
    return D.issues(items(spark, sf_dir), pool(spark, sf_dir)).select("source", "id", "named_sql").orderBy("source", F.desc("id")).offset(100).limit(300)


@PLAN.query("op_srt02_keyset_page", POOL + " SELECT id, named_sql FROM pool WHERE id < 1000 ORDER BY id DESC LIMIT 200")
def srt02(spark, sf_dir):
    """A page below an id; unlike an offset it stays the same while rows are added."""
    return pool(spark, sf_dir).where("id < 1000").select("id", "named_sql").orderBy(F.desc("id")).limit(200)


@PLAN.query("op_srt06_page_and_total", POOL + " SELECT id, (SELECT count(*) FROM pool) AS total FROM pool ORDER BY id LIMIT 100 OFFSET 200")
def srt06(spark, sf_dir):
    """The third page of at most 100 rows, with the total."""
    rows = pool(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    return rows.select("id").orderBy("id").offset(200).limit(100).join(F.broadcast(total))  # one row


@PLAN.query("op_srt08_case_rank", BOTH + " SELECT id, rating, CASE rating WHEN 'POOR' THEN 3 WHEN 'GOOD' THEN 2 ELSE 1 END AS rank FROM items")
def srt08(spark, sf_dir):
    rank = F.when(F.col("rating") == "POOR", 3).when(F.col("rating") == "GOOD", 2).otherwise(1)
    return items(spark, sf_dir).select("id", "rating", rank.alias("rank")).orderBy(F.desc("rank"), "id")


@PLAN.query("op_flt01_dynamic_filter", ITEMS + " SELECT id, project FROM items WHERE project = 'ccbs-loan-bcc' AND rating = 'POOR'")
def flt01(spark, sf_dir):
    return items(spark, sf_dir).where(P.every([("project", " ccbs-loan-bcc "), ("rating", "POOR"), ("named_sql", "  "), ("env", None)])).select("id", "project")


@PLAN.query("op_flt02_keyword", ITEMS + " SELECT id FROM items WHERE lower(named_sql) LIKE '%n1%' OR lower(project) LIKE '%n1%' OR lower(explain_error) LIKE '%n1%'")
def flt02(spark, sf_dir):
    return items(spark, sf_dir).where(S.contains_any(" N1 ", "named_sql", "project", "explain_error")).select("id")


@PLAN.query("op_flt04_env_or_none", POOL + f" SELECT env, count(*) AS n FROM pool WHERE {ENV} GROUP BY 1")
def flt04(spark, sf_dir):
    return pool(spark, sf_dir).where(P.in_env("prod")).groupBy("env").agg(F.count("*").alias("n"))


@PLAN.query("op_flt05_showable", BOTH + f" SELECT 'ITEM' AS source, count(*) AS n FROM items WHERE {SHOW} UNION ALL SELECT 'POOL', count(*) FROM pool WHERE {POOL_SHOW}")
def flt05(spark, sf_dir):
    a = items(spark, sf_dir).where(P.showable()).agg(F.count("*").alias("n")).select(F.lit("ITEM").alias("source"), "n")
    return a.unionByName(pool(spark, sf_dir).where(P.showable(pool=True)).agg(F.count("*").alias("n")).select(F.lit("POOL").alias("source"), "n"))


@PLAN.query("op_flt06_whitelist_parts", ITEMS + f" SELECT is_whitelist, whitelist_status, count(*) FILTER ({APPROVED}) AS approved, count(*) FILTER ({APPLYING}) AS applying, count(*) FILTER ({PLAIN}) AS plain, count(*) FILTER ({APPROVED} OR {APPLYING}) AS active FROM items GROUP BY 1, 2")
def flt06(spark, sf_dir):
    return items(spark, sf_dir).groupBy("is_whitelist", "whitelist_status").agg(F.count_if(P.wl_approved()).alias("approved"), F.count_if(P.wl_applying()).alias("applying"), F.count_if(P.plain()).alias("plain"), F.count_if(P.wl_active()).alias("active"))


@PLAN.query("op_flt07_scopes", ITEMS + f" SELECT count(*) FILTER ({PLAIN}) AS plain, count(*) FILTER ({APPLYING}) AS applying, count(*) FILTER ({APPROVED}) AS approved, count(*) FILTER (whitelist_status = 'REJECTED_L1') AS rejected, count(*) FILTER ({APPROVED} OR {APPLYING}) AS every FROM items")
def flt07(spark, sf_dir):
    parts = {"plain": P.scope("plain")} | {k: P.scope("wl", k) for k in ("applying", "approved", "rejected")} | {"every": P.scope("wl")}
    return items(spark, sf_dir).agg(*(F.count_if(test).alias(k) for k, test in parts.items()))


APPS = ctes("items", "applications")
MINE = "(status = 'PENDING_L1' AND l1_approver = 'u3') OR (status = 'PENDING_L2' AND l2_approver = 'u3')"


@PLAN.query("op_flt08_mine_to_approve", APPS + f" SELECT id FROM items WHERE whitelist_app_id IN (SELECT id FROM applications WHERE {MINE})")
def flt08(spark, sf_dir):
    mine = view(spark, sf_dir, "applications").where(P.mine_to_approve("u3")).select(F.col("id").alias("whitelist_app_id"))
    return items(spark, sf_dir).join(mine, "whitelist_app_id", "left_semi").select("id")


@PLAN.query("op_join07_mine_slow", APPS + " SELECT id FROM items WHERE whitelist_app_id IN (SELECT id FROM applications WHERE (status IN ('PENDING_L1', 'REJECTED_L2') AND l1_approver = 'u3') OR (status = 'PENDING_L2' AND l2_approver = 'u3'))")
def join07(spark, sf_dir):
    mine = view(spark, sf_dir, "applications").where(P.mine_to_approve("u3", slow=True)).select(F.col("id").alias("whitelist_app_id"))
    return items(spark, sf_dir).join(mine, "whitelist_app_id", "left_semi").select("id")


@PLAN.query("op_flt09_current_approver", ctes("applications") + " SELECT id FROM applications WHERE (status IN ('PENDING_L1', 'REJECTED_L2') AND l1_approver IN ('u1', 'u2')) OR (status = 'PENDING_L2' AND l2_approver IN ('u1', 'u2'))")
def flt09(spark, sf_dir):
    return view(spark, sf_dir, "applications").where(P.current_approver(["u1", "u2"])).select("id")


@PLAN.query("op_flt11_status_alias", ctes("tasks") + " SELECT id, status FROM tasks WHERE status IN ('RUNNING', 'PENDING')")
def flt11(spark, sf_dir):
    return view(spark, sf_dir, "tasks").where(P.status_alias("status", "RUNNING_OR_PENDING")).select("id", "status")


@PLAN.query("op_flt15_to_do", ctes("applications") + " SELECT 'any' AS role, count(*) AS n FROM applications WHERE l1_approver = 'u2' OR l2_approver = 'u2' OR applicant = 'u2' UNION ALL SELECT 'l1', count(*) FROM applications WHERE l1_approver = 'u2' AND status = 'PENDING_L1'")
def flt15(spark, sf_dir):
    apps = view(spark, sf_dir, "applications")
    a = apps.where(P.to_do("any", "u2")).agg(F.count("*").alias("n")).select(F.lit("any").alias("role"), "n")
    return a.unionByName(apps.where(P.to_do("l1", "u2", "PENDING_L1")).agg(F.count("*").alias("n")).select(F.lit("l1").alias("role"), "n"))


@PLAN.query("op_flt18_table_in_list", ITEMS + " SELECT involved_tables, count(*) AS n FROM items WHERE involved_tables LIKE '%item%' GROUP BY 1")
def flt18(spark, sf_dir):
    return items(spark, sf_dir).where(F.col("involved_tables").contains("item")).groupBy("involved_tables").agg(F.count("*").alias("n"))


@PLAN.query("op_flt16_trailing_days", ctes("slow_raw") + " SELECT round, count(*) AS n FROM slow_raw WHERE strptime(round, '%Y%m%d')::DATE >= (SELECT max(strptime(round, '%Y%m%d')::DATE) - 7 FROM slow_raw) GROUP BY 1")
def flt16(spark, sf_dir):
    """The last seven days before as_of, here the newest day."""
    raw = view(spark, sf_dir, "slow_raw").select("round", F.to_date("round", "yyyyMMdd").alias("day"))
    as_of = raw.agg(F.max("day").alias("as_of"))
    return raw.join(F.broadcast(as_of)).where(F.col("day") >= F.date_sub("as_of", 7)).groupBy("round").agg(F.count("*").alias("n"))  # one row


@PLAN.query("op_flt17_same_day", ctes("slow_raw") + " SELECT seq FROM slow_raw WHERE round = (SELECT max(round) FROM slow_raw)")
def flt17(spark, sf_dir):
    raw = view(spark, sf_dir, "slow_raw")
    return raw.join(F.broadcast(raw.agg(F.max("round").alias("round"))), "round", "left_semi").select("seq")  # one row


@PLAN.query("op_prj02_derived_actors", ctes("applications") + " SELECT id, CASE WHEN status IN ('PENDING_L1', 'REJECTED_L2') THEN l1_approver WHEN status = 'PENDING_L2' THEN l2_approver END AS current_approver, CASE WHEN status <> 'CANCELLED' THEN applicant END AS initiator FROM applications")
def prj02(spark, sf_dir):
    now = F.when(F.col("status").isin("PENDING_L1", "REJECTED_L2"), F.col("l1_approver")).when(F.col("status") == "PENDING_L2", F.col("l2_approver"))
    return view(spark, sf_dir, "applications").select("id", now.alias("current_approver"), F.when(F.col("status") != "CANCELLED", F.col("applicant")).alias("initiator"))


@PLAN.query("op_prj03_first_nonblank", BOTH + " SELECT id, CASE WHEN trim(env) <> '' THEN env WHEN trim(explain_error) <> '' THEN explain_error WHEN trim(project) <> '' THEN project END AS name FROM items")
def prj03(spark, sf_dir):
    return items(spark, sf_dir).select("id", S.first_nonblank("env", "explain_error", "project").alias("name"))


@PLAN.query("op_prj04_label_override", ITEMS + f" SELECT id, coalesce(CASE lang WHEN 'en' THEN 'English' END, {LABEL}) AS label FROM items")
def prj04(spark, sf_dir):
    override = F.element_at(F.create_map(F.lit("en"), F.lit("English")), F.col("lang"))
    return items(spark, sf_dir).select("id", F.coalesce(override, S.domain_label("project")).alias("label"))


@PLAN.query("op_sc01_domain_label", POOL + f" SELECT project, {LABEL} AS domain, count(*) AS n FROM pool GROUP BY 1, 2")
def sc01(spark, sf_dir):
    return pool(spark, sf_dir).groupBy("project", S.domain_label("project").alias("domain")).agg(F.count("*").alias("n"))


@PLAN.query("op_agg13_zero_filled", ITEMS + ", kinds AS (SELECT unnest(['DONE', 'PENDING', 'FAILED', 'SKIPPED', 'RETRY']) AS llm_status) SELECT k.llm_status, count(i.id) AS n FROM kinds k LEFT JOIN items i USING (llm_status) GROUP BY 1")
def agg13(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in ("DONE", "PENDING", "FAILED", "SKIPPED", "RETRY")], "llm_status string")
    return D.zero_filled(items(spark, sf_dir).groupBy("llm_status").agg(F.count("*").alias("n")), kinds, "llm_status")


@PLAN.query("op_agg24_access_patterns", ITEMS + """, lists AS (SELECT array_to_string(list_sort(list_transform(string_split(involved_tables, ','), lambda x: trim(x))), ',') AS tables, rating FROM items WHERE involved_tables LIKE '%orders%')
  SELECT tables, count(*) AS n, count(*) FILTER (rating = 'EXCELLENT') AS excellent, count(*) FILTER (rating = 'GOOD') AS good, count(*) FILTER (rating = 'POOR') AS poor FROM lists GROUP BY 1 ORDER BY n DESC, tables LIMIT 10""")
def agg24(spark, sf_dir):
    """The ten commonest lists."""
    return D.access_patterns(items(spark, sf_dir), "orders", 10)


@PLAN.query("op_join16_missing_tables", ITEMS + ", used AS (SELECT DISTINCT trim(unnest(string_split(involved_tables, ','))) AS table_name FROM items) SELECT table_name FROM used WHERE table_name NOT IN ('customer', 'orders')")
def join16(spark, sf_dir):
    known = spark.createDataFrame([("customer",), ("orders",)], "table_name string")
    used = items(spark, sf_dir).select(F.explode(F.split("involved_tables", ",")).alias("t")).select(F.trim("t").alias("table_name")).distinct()
    return used.join(known, "table_name", "left_anti")


@PLAN.query("op_join17_newest_application", APPS + ", newest AS (SELECT sql_hash, id AS app_id, status AS app_status FROM applications WHERE status <> 'CANCELLED' QUALIFY row_number() OVER (PARTITION BY sql_hash ORDER BY id DESC) = 1) SELECT i.id, app_id, app_status FROM items i LEFT JOIN newest USING (sql_hash)")
def join17(spark, sf_dir):
    """The newest application of a hash that isn't cancelled; one aggregation instead of a window."""
    newest = view(spark, sf_dir, "applications").where("status <> 'CANCELLED'").groupBy("sql_hash").agg(F.max(F.struct("id", "status")).alias("top"))
    return items(spark, sf_dir).join(newest, "sql_hash", "left").select("id", F.col("top.id").alias("app_id"), F.col("top.status").alias("app_status"))


@PLAN.query("op_agg26_pending_by_category", ctes("applications") + " SELECT target_type, count(*) FILTER (status = 'PENDING_L1') AS pending_l1, count(*) FILTER (status = 'PENDING_L2') AS pending_l2 FROM applications GROUP BY 1")
def agg26(spark, sf_dir):
    s = F.col("status")
    return view(spark, sf_dir, "applications").groupBy("target_type").agg(F.count_if(s == "PENDING_L1").alias("pending_l1"), F.count_if(s == "PENDING_L2").alias("pending_l2"))


@PLAN.query("op_agg33_totals", BOTH + " SELECT (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM pool) AS n_pool, (SELECT count(DISTINCT sql_hash) FROM pool) AS n_hashes")
def agg33(spark, sf_dir):
    a = items(spark, sf_dir).agg(F.count("*").alias("n_items"))
    b = pool(spark, sf_dir).agg(F.count("*").alias("n_pool"), F.count_distinct("sql_hash").alias("n_hashes"))
    return a.crossJoin(b)  # one row each


@PLAN.query("op_agg31_top_counters", POOL + ", t AS (SELECT named_sql, count(*) AS n FROM pool GROUP BY 1 ORDER BY n DESC, named_sql LIMIT 5) SELECT string_agg(named_sql || '=' || n, ', ' ORDER BY n DESC, named_sql) AS summary FROM t")
def agg31(spark, sf_dir):
    """The five commonest names in one text."""
    top = pool(spark, sf_dir).groupBy("named_sql").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "named_sql").limit(5)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "named_sql", "n")))
    return top.agg(F.array_join(F.transform(rows, lambda x: F.concat(x["named_sql"], F.lit("="), x["n"].cast("string"))), ", ").alias("summary"))


@PLAN.query("op_src28_scan_preview", POOL + " SELECT project, count(*) AS n, min(named_sql) AS sample FROM pool GROUP BY 1")
def src28(spark, sf_dir):
    return pool(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.min("named_sql").alias("sample"))
