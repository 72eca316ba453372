"""Slow-statement rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, stream, view
from ..functions import scalar as S
from ..operators import rounds as R
from ..operators import windows as W
from ..streaming.rounds import regressions_to_end

PLAN = Plan()

REP = """rep AS (SELECT round, service_name, abstract_sql, count(*) OVER k AS exec_count, cost_ms AS max_cost_ms, cost_raw AS max_cost_raw, exec_params, source_location,
  row_number() OVER (PARTITION BY round, service_name, abstract_sql ORDER BY cost_ms DESC, seq) AS k FROM slow_raw WINDOW k AS (PARTITION BY round, service_name, abstract_sql)),
facts AS (SELECT * EXCLUDE (k) FROM rep WHERE k = 1),
seen AS (SELECT service_name, abstract_sql, list(DISTINCT round) AS rounds FROM facts GROUP BY ALL),
repeated AS (SELECT f.*, nullif(array_to_string(list_sort(list_filter(rounds, lambda x: x <> round)), ','), '') AS repeat_rounds FROM facts f JOIN seen USING (service_name, abstract_sql)),
flagged AS (SELECT *, CASE length(abstract_sql) % 4 WHEN 0 THEN 'PENDING_L1' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'CANCELLED' END AS whitelist_status,
  CASE service_name WHEN 'click' THEN 'online' WHEN 'view' THEN 'batch' WHEN 'purchase' THEN 'hotspot' WHEN 'signup' THEN NULL ELSE 'misc' END AS biz_type,
  CASE WHEN right(abstract_sql, 1) < '3' THEN 'dept' WHEN right(abstract_sql, 1) < '6' THEN 'loan' ELSE 'comm' END AS domain FROM repeated)"""
SLOW = ctes("slow_raw") + ", " + REP


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.representatives(view(spark, sf_dir, "slow_raw"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.repeat_rounds(facts(spark, sf_dir))
    n, last = F.length("abstract_sql") % 4, F.right("abstract_sql", F.lit(1))
    status = F.when(n == 0, "PENDING_L1").when(n == 1, "APPROVED").when(n == 2, "CANCELLED")
    kind = F.when(F.col("service_name") == "click", "online").when(F.col("service_name") == "view", "batch").when(F.col("service_name") == "purchase", "hotspot").when(F.col("service_name") != "signup", "misc")
    domain = F.when(last < "3", "dept").when(last < "6", "loan").otherwise("comm")
    return out.withColumns({"whitelist_status": status, "biz_type": kind, "domain": domain})


@PLAN.query("op_agg01_representatives", SLOW + " SELECT * FROM facts")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir)


@PLAN.query("op_agg02_repeat_rounds", SLOW + " SELECT round, service_name, abstract_sql, repeat_rounds FROM repeated")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeat_rounds(facts(spark, sf_dir)).select("round", *R.KEY, "repeat_rounds")


@PLAN.query("op_agg03_round_dashboard", SLOW + """ SELECT round, count(*) AS total, count(repeat_rounds) AS repeated, count(*) FILTER (whitelist_status IN ('PENDING_L1', 'PENDING_L2', 'REJECTED_L1', 'REJECTED_L2')) AS applying, count(*) FILTER (whitelist_status = 'APPROVED') AS approved
  FROM flagged GROUP BY round ORDER BY round DESC LIMIT 12""")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the last twelve rounds."""
    return R.round_dashboard(flagged(spark, sf_dir), 12)


@PLAN.query("op_agg04_domain_pivot", SLOW + """ SELECT domain, count(*) FILTER (biz_type = 'online') AS online, count(*) FILTER (biz_type = 'batch') AS batch, count(*) FILTER (biz_type = 'hotspot') AS hotspot, count(*) FILTER (biz_type NOT IN ('online', 'batch', 'hotspot')) AS other, count(*) AS total
  FROM flagged WHERE whitelist_status IS NULL GROUP BY domain""")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_pivot(flagged(spark, sf_dir), ["online", "batch", "hotspot"])


STATE = ctes("slow_raw", "slow_state") + """, keys AS (SELECT service_name, abstract_sql, max(round) AS r FROM slow_raw GROUP BY ALL),
next_state AS (SELECT s.service_name, s.abstract_sql, optimized_round, CASE WHEN r > optimized_round THEN 'REGRESSED' ELSE status END AS status,
  CASE WHEN r > optimized_round THEN greatest(reappeared_round, r) ELSE reappeared_round END AS reappeared_round, (coalesce(r > optimized_round, false) AND status = 'OPTIMIZED')::INT AS counted, (r IS NOT NULL)::INT AS stamped
  FROM slow_state s LEFT JOIN keys USING (service_name, abstract_sql))"""


@PLAN.query("op_st01_regressions", STATE + " SELECT * FROM next_state")
def st01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.regressions(view(spark, sf_dir, "slow_raw"), view(spark, sf_dir, "slow_state"))


@PLAN.query("op_st01_regressions_stream", STATE + " SELECT service_name, abstract_sql, optimized_round, status, reappeared_round FROM next_state")
def st01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the table's files."""
    raw = view(spark, sf_dir, "slow_raw", {"events": stream(spark, sf_dir, "events")})
    return regressions_to_end(raw, view(spark, sf_dir, "slow_state"))


@PLAN.query("op_join03_stamped_facts", STATE + ", " + REP + " SELECT f.round, f.service_name, f.abstract_sql, f.exec_count, n.status AS optimize_status, n.optimized_round, n.reappeared_round FROM facts f LEFT JOIN next_state n USING (service_name, abstract_sql)")
def join03(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = R.regressions(view(spark, sf_dir, "slow_raw"), view(spark, sf_dir, "slow_state"))
    return R.stamped(facts(spark, sf_dir), state).select("round", *R.KEY, "exec_count", "optimize_status", "optimized_round", "reappeared_round")


@PLAN.query("op_flt03_status_none", STATE + ", " + REP + " SELECT service_name, count(*) AS n FROM facts f LEFT JOIN next_state n USING (service_name, abstract_sql) WHERE n.status IS NULL GROUP BY 1")
def flt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = R.stamped(facts(spark, sf_dir), view(spark, sf_dir, "slow_state"))
    return all_.where(R.status_filter("NONE")).groupBy("service_name").agg(F.count("*").alias("n"))


@PLAN.query("op_set05_batch_state", ctes("slow_raw", "slow_state") + " SELECT service_name, abstract_sql, count(*) AS n FROM slow_raw JOIN slow_state USING (service_name, abstract_sql) GROUP BY ALL")
def set05(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = view(spark, sf_dir, "slow_raw").groupBy(*R.KEY).agg(F.count("*").alias("n"))
    return keys.join(view(spark, sf_dir, "slow_state").select(*R.KEY), R.KEY)


@PLAN.query("op_agg34_latest_round", SLOW + " SELECT service_name, abstract_sql, max(round) AS latest_round, count(*) AS n_rounds FROM facts GROUP BY ALL")
def agg34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_round(facts(spark, sf_dir))


@PLAN.query("op_srt01_costliest_page", SLOW + " SELECT round, service_name, abstract_sql, max_cost_ms FROM facts ORDER BY max_cost_ms DESC, round, service_name, abstract_sql LIMIT 500 OFFSET 20")
def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page, its limit of 900 clamped to 500."""
    order = [F.desc("max_cost_ms"), F.asc("round"), F.asc("service_name"), F.asc("abstract_sql")]
    return R.page(facts(spark, sf_dir).select("round", *R.KEY, "max_cost_ms"), order, 900, 20)


@PLAN.query("op_srt05_last_rounds", ctes("slow_raw") + " SELECT round, count(*) AS n FROM slow_raw GROUP BY round ORDER BY round DESC LIMIT 5")
def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five rounds, ascending."""
    counted = view(spark, sf_dir, "slow_raw").groupBy("round").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("round")).limit(5).orderBy("round")


@PLAN.query("op_prj06_dimensions", SLOW + " SELECT 'round' AS dimension, round AS name FROM facts UNION SELECT 'domain', domain FROM flagged UNION SELECT 'biz_type', biz_type FROM flagged")
def prj06(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir)
    named = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in ("round", "domain", "biz_type")))).alias("x")
    return f.select("round", "domain", "biz_type").distinct().select(named).select("x.*").distinct()


@PLAN.query("op_sc06_next_round", ctes("slow_raw") + """, names AS (SELECT CASE seq % 4 WHEN 0 THEN round || '-' || (seq % 12) WHEN 1 THEN round || '-x' WHEN 2 THEN round ELSE round || '-0' || (seq % 3) END AS name, round FROM slow_raw)
  SELECT round, round || '-' || (coalesce(max(try_cast(regexp_extract(name, '^[0-9]{8}-([0-9]+)$', 1) AS INT)), 0) + 1) AS next_round FROM names GROUP BY round""")
def sc06(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "slow_raw")
    k = F.col("seq") % 4
    name = F.when(k == 0, F.concat("round", F.lit("-"), (F.col("seq") % 12).cast("string"))).when(k == 1, F.concat("round", F.lit("-x"))).when(k == 2, F.col("round")).otherwise(F.concat("round", F.lit("-0"), (F.col("seq") % 3).cast("string")))
    return raw.select("round", name.alias("name")).groupBy("round").agg(S.next_round("round", "name").alias("next_round"))


@PLAN.query("op_st04_attempts", ctes("slow_raw") + """, marks AS (SELECT abstract_sql AS key, seq, CASE WHEN seq % 3 = 0 THEN 'MARK' ELSE 'EDIT' END AS kind, exec_params AS note FROM slow_raw),
  numbered AS (SELECT *, sum((kind = 'MARK')::BIGINT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS attempt FROM marks)
  SELECT key, seq, kind, note, attempt::BIGINT AS attempt FROM numbered WHERE attempt > 0 QUALIFY row_number() OVER (PARTITION BY key, attempt ORDER BY seq DESC) = 1""")
def st04(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "slow_raw")
    return R.attempts(raw.select(F.col("abstract_sql").alias("key"), "seq", F.when(F.col("seq") % 3 == 0, "MARK").otherwise("EDIT").alias("kind"), F.col("exec_params").alias("note")))


@PLAN.query("op_snk09_latest_flag", ctes("slow_raw") + " SELECT seq, abstract_sql, (row_number() OVER (PARTITION BY abstract_sql ORDER BY seq DESC) = 1)::INT AS latest FROM slow_raw")
def snk09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_flag(view(spark, sf_dir, "slow_raw").select("seq", "abstract_sql"), ["abstract_sql"], "seq")


@PLAN.query("op_set06_first_of_hash", ctes("slow_raw") + " SELECT seq, abstract_sql FROM slow_raw QUALIFY row_number() OVER (PARTITION BY abstract_sql ORDER BY seq) = 1")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_wins(view(spark, sf_dir, "slow_raw").select("seq", "abstract_sql"), ["abstract_sql"], "seq")


@PLAN.query("op_srt10_two_trails", ctes("slow_raw", "actions") + """ SELECT round AS at, 1 AS source_ord, seq AS id, abstract_sql AS what FROM slow_raw UNION ALL SELECT NULL, 2, seq, action FROM actions""")
def srt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "slow_raw").select(F.col("round").alias("at"), F.lit(1).alias("source_ord"), F.col("seq").alias("id"), F.col("abstract_sql").alias("what"))
    b = view(spark, sf_dir, "actions").select(F.lit(None).cast("string").alias("at"), F.lit(2).alias("source_ord"), F.col("seq").alias("id"), F.col("action").alias("what"))
    return a.unionByName(b).orderBy("at", "source_ord", "id")
