"""Workflow and inspection rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, stream, table, view
from ..operators import workflow as W
from ..streaming import approvals as S

PLAN = Plan()
RULES = ", ".join(f"('{s}', '{a}', '{t}')" for (s, a), t in W.TRANSITIONS.items())
FOLD = ctes("actions") + f""", rules AS (SELECT * FROM (VALUES {RULES}) v(state, action, next)), o AS (SELECT app_id, action, row_number() OVER (PARTITION BY app_id ORDER BY seq) AS k FROM actions),
f AS (SELECT DISTINCT app_id, 0::BIGINT AS k, 'NONE' AS status, 0::BIGINT AS bad FROM actions UNION ALL SELECT f.app_id, o.k, coalesce(r.next, f.status), f.bad + (r.next IS NULL)::BIGINT FROM f JOIN o ON o.app_id = f.app_id AND o.k = f.k + 1 LEFT JOIN rules r ON r.state = f.status AND r.action = o.action)
SELECT app_id, status, k AS n_actions, bad AS n_illegal FROM f QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY k DESC) = 1"""


@PLAN.query("op_st05_approvals", FOLD)
def st05(spark, sf_dir):
    return W.folded(view(spark, sf_dir, "actions"))


@PLAN.query("op_st05_approvals_stream", FOLD)
def st05_stream(spark, sf_dir):
    """The same over a stream of the table's files."""
    actions = view(spark, sf_dir, "actions", {"events": stream(spark, sf_dir, "events")})
    return S.run_to_end(S.approvals(actions), ["app_id"])


ROLES = "CASE WHEN action IN ('SUBMIT', 'CANCEL') THEN applicant WHEN action IN ('APPROVE_L1', 'REJECT_L1') THEN l1_approver ELSE l2_approver END"
DECIDE = ctes("requests", "tries") + f""", rules AS (SELECT * FROM (VALUES {RULES}) v(state, action, next)),
o AS (SELECT t.*, coalesce({ROLES} = actor, false) AS allowed, coalesce(applicant = l1_approver, false) AS skips, row_number() OVER (PARTITION BY t.app_id ORDER BY seq) AS k FROM tries t LEFT JOIN requests USING (app_id)),
f AS (SELECT DISTINCT app_id, 0::BIGINT AS k, 'NONE' AS status, 0::BIGINT AS bad, 0::BIGINT AS denied, 0::BIGINT AS stale FROM tries
  UNION ALL SELECT f.app_id, o.k, CASE WHEN expected <> status OR next IS NULL OR NOT allowed THEN status WHEN skips AND next = 'PENDING_L1' THEN 'PENDING_L2' ELSE next END,
    bad + (NOT coalesce(expected <> status, false) AND next IS NULL)::BIGINT, denied + (NOT coalesce(expected <> status, false) AND next IS NOT NULL AND NOT allowed)::BIGINT, stale + coalesce(expected <> status, false)::BIGINT
  FROM f JOIN o ON o.app_id = f.app_id AND o.k = f.k + 1 LEFT JOIN rules r ON r.state = f.status AND r.action = o.action)
SELECT app_id, status, k AS n_actions, bad AS n_illegal, denied AS n_denied, stale AS n_stale FROM f QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY k DESC) = 1"""


@PLAN.query("op_st05_decided", DECIDE)
def st05_decided(spark, sf_dir):
    """Compare and set: the actor whom the request names, from the state they expect."""
    return W.decided(view(spark, sf_dir, "requests"), view(spark, sf_dir, "tries"))


@PLAN.query("op_st05_decided_stream", DECIDE)
def st05_decided_stream(spark, sf_dir):
    """The same over a stream of the table's files."""
    tries = view(spark, sf_dir, "tries", {"events": stream(spark, sf_dir, "events")})
    return S.run_to_end(S.decisions(view(spark, sf_dir, "requests"), tries), ["app_id"])


REPOS = "SELECT r.repo_id, h.sha AS head, CASE r.repo_id % 5 WHEN 0 THEN h.sha WHEN 1 THEN NULL WHEN 2 THEN 'gone' ELSE b.sha END AS base FROM (SELECT repo_id, min(seq) AS top, min(seq) + 25 * (2 + repo_id % 3) AS bottom FROM {c} GROUP BY repo_id) r JOIN {c} h ON h.repo_id = r.repo_id AND h.seq = r.top LEFT JOIN {c} b ON b.repo_id = r.repo_id AND b.seq = r.bottom"


@PLAN.query(
    "op_st12_modes",
    ctes("commits") + ", repos AS (" + REPOS.format(c="commits") + "), e AS (SELECT repo_id, sha, parent AS up FROM commits UNION ALL SELECT repo_id, sha, parent2 FROM commits), a AS (SELECT repo_id, head AS sha FROM repos UNION SELECT a.repo_id, e.up FROM a JOIN e ON e.repo_id = a.repo_id AND e.sha = a.sha WHERE e.up IS NOT NULL) "
    "SELECT repo_id, CASE WHEN base = head THEN 'UNCHANGED' WHEN EXISTS (SELECT 1 FROM a WHERE a.repo_id = repos.repo_id AND a.sha = repos.base) AND base IN (SELECT sha FROM commits) THEN 'INCREMENTAL' ELSE 'FULL' END AS mode FROM repos",
)
def st12_modes(spark, sf_dir):
    """How each repository is read again: unchanged, incremental, or in full after a rebase."""
    commits = view(spark, sf_dir, "commits")
    repos = spark.sql(REPOS, c=commits)
    return W.modes(repos, commits.select("repo_id", "seq", "sha", F.array_compact(F.array("parent", "parent2")).alias("parents")))


@PLAN.query("op_st06_submitted", ctes("applications") + ", a AS (SELECT sql_hash, min(id) AS first_id FROM applications WHERE status IN ('PENDING_L1', 'PENDING_L2', 'APPROVED') GROUP BY 1) SELECT id, CASE WHEN first_id < id THEN 'DUPLICATE' WHEN applicant = l1_approver THEN 'PENDING_L2' ELSE 'PENDING_L1' END AS first_status FROM applications LEFT JOIN a USING (sql_hash)")
def st06(spark, sf_dir):
    return W.submitted(view(spark, sf_dir, "applications"))


@PLAN.query("op_st07_propagated", ctes("items", "applications") + ", n AS (SELECT sql_hash, arg_max(status, id) AS status, max((status = 'APPROVED')::INT) AS ever FROM applications WHERE target_type = 'HASH' GROUP BY 1) SELECT id, n.status, greatest(is_whitelist, coalesce(ever, 0))::INT AS is_whitelist FROM items LEFT JOIN n USING (sql_hash)")
def st07(spark, sf_dir):
    return W.propagated(view(spark, sf_dir, "items"), view(spark, sf_dir, "applications"), "HASH", "sql_hash")


@PLAN.query("op_st02_marks", ctes("slow_raw", "slow_state") + ", k AS (SELECT service_name, abstract_sql, max(round) AS anchor FROM slow_raw GROUP BY ALL), j AS (SELECT k.*, s.status, s.optimized_round AS r0, abstract_sql LIKE '%3' AS blocked FROM k LEFT JOIN slow_state s USING (service_name, abstract_sql)) SELECT service_name, abstract_sql, CASE WHEN blocked THEN 'REFUSED' WHEN status IS NULL OR status = 'REGRESSED' THEN 'NEW' ELSE 'EDIT' END AS outcome, CASE WHEN NOT blocked AND (status IS NULL OR status = 'REGRESSED') THEN anchor ELSE r0 END AS optimized_round FROM j")
def st02(spark, sf_dir):
    raw = view(spark, sf_dir, "slow_raw")
    return W.marks(raw, view(spark, sf_dir, "slow_state"), raw.where("abstract_sql LIKE '%3'"))


@PLAN.query("op_st03_revoked", ctes("slow_raw", "slow_state") + " SELECT service_name, abstract_sql, CASE WHEN service_name = 'click' THEN 'REVOKED' ELSE status END AS status, CASE WHEN service_name <> 'click' THEN optimized_round END AS optimized_round, CASE WHEN service_name = 'click' THEN 'u1' END AS revoked_by FROM slow_state")
def st03(spark, sf_dir):
    state = view(spark, sf_dir, "slow_state")
    return W.revoked(state, view(spark, sf_dir, "slow_raw").where("service_name = 'click'"), "u1")


@PLAN.query("op_st08_reuse", ctes("pool") + ", d AS (SELECT id, sql_hash, coalesce(env, '') AS env, id * 7 AS at_ FROM pool WHERE llm_status = 'DONE'), r AS (SELECT id, sql_hash, coalesce(env, '') AS env, id * 7 + 100 AS at_ FROM pool), n AS (SELECT r.id, arg_max(d.id, d.at_) AS result FROM r JOIN d ON r.sql_hash = d.sql_hash AND r.env = d.env AND d.at_ BETWEEN r.at_ - 300 AND r.at_ GROUP BY 1) SELECT r.id, result FROM r LEFT JOIN n USING (id)")
def st08(spark, sf_dir):
    pool = view(spark, sf_dir, "pool").withColumn("env", F.coalesce("env", F.lit("")))
    done = pool.where("llm_status = 'DONE'").select("id", "sql_hash", "env", (F.col("id") * 7).alias("at"))
    return W.reused(pool.select("id", "sql_hash", "env", (F.col("id") * 7 + 100).alias("at")), done, 300)


@PLAN.query("op_st09_inspected", ctes("items") + " SELECT id, CASE WHEN is_whitelist = 1 THEN 'WHITELISTED' WHEN id % 8 = 0 THEN 'NOT_APPLICABLE' WHEN explain_error <> '' THEN 'FAILED' WHEN est_rows >= 1000 THEN 'POOR' ELSE 'EXCELLENT' END AS outcome FROM items")
def st09(spark, sf_dir):
    return W.inspected(view(spark, sf_dir, "items").withColumn("kind", F.when(F.col("id") % 8 == 0, "INSERT").otherwise("SELECT")))


@PLAN.query("op_st10_triage", ctes("pool") + " SELECT id, CASE WHEN explain_error <> '' THEN 'KEEP_FAILED' WHEN rating = 'POOR' THEN 'KEEP_PENDING' ELSE 'DELETE' END AS fate FROM pool")
def st10(spark, sf_dir):
    return W.triaged(view(spark, sf_dir, "pool"))


@PLAN.query("op_st11_queue", ctes("pool") + " SELECT id, named_sql FROM pool WHERE rating = 'POOR' AND llm_status = 'PENDING' ORDER BY id LIMIT 5000")
def st11(spark, sf_dir):
    """At most 5000 rows of work."""
    return W.queue(view(spark, sf_dir, "pool"), 5000).select("id", "named_sql")


LINES = "CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R087' ELSE 'C100' END"
DIFF = f"SELECT concat({LINES}, chr(9), 'src/F', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 5 > 2 THEN concat(chr(9), 'src/G', CAST(o_orderkey AS VARCHAR(20))) ELSE '' END) AS line FROM {{orders}}"


@PLAN.query("op_st12_changes", f"WITH d AS ({DIFF.format(orders='orders')}), p AS (SELECT line[1] AS code, string_split(line, chr(9)) AS x FROM d) SELECT x[2] AS path, CASE WHEN code IN ('A', 'M') THEN 'CHANGED' ELSE 'REMOVED' END AS change FROM p WHERE code IN ('A', 'M', 'D', 'R') UNION ALL SELECT x[3], 'CHANGED' FROM p WHERE code IN ('R', 'C')")
def st12(spark, sf_dir):
    return W.changes(spark.sql(DIFF, orders=table(spark, sf_dir, "orders")))
