"""Approval workflow, optimisation marks and inspection rules as folds and precedence chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach

# State and action -> next state; every other pair is illegal and changes nothing.
TRANSITIONS = {
    ("NONE", "SUBMIT"): "PENDING_L1",
    ("CANCELLED", "SUBMIT"): "PENDING_L1",
    ("REJECTED_L1", "SUBMIT"): "PENDING_L1",
    ("PENDING_L1", "APPROVE_L1"): "PENDING_L2",
    ("REJECTED_L2", "APPROVE_L1"): "PENDING_L2",
    ("PENDING_L1", "REJECT_L1"): "REJECTED_L1",
    ("REJECTED_L2", "REJECT_L1"): "REJECTED_L1",
    ("PENDING_L2", "APPROVE_L2"): "APPROVED",
    ("PENDING_L2", "REJECT_L2"): "REJECTED_L2",
    ("PENDING_L1", "CANCEL"): "CANCELLED",
    ("REJECTED_L1", "CANCEL"): "CANCELLED",
}


STATES = ["NONE", *sorted({state for pair in TRANSITIONS for state in (pair[0], TRANSITIONS[pair])} - {"NONE"})]
BLOCK_BITS = 12


#: Who may do what, by the column of the request that names the actor.
ACTORS = {"SUBMIT": "applicant", "CANCEL": "applicant", "APPROVE_L1": "l1_approver", "REJECT_L1": "l1_approver", "APPROVE_L2": "l2_approver", "REJECT_L2": "l2_approver"}
COUNTS = ["bad", "denied", "stale"]


def _move(to, **counts) -> Column:
    number = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(number(to).cast("int").alias("to"), *(number(counts.get(c, 0)).cast("long").alias(c) for c in COUNTS))


def _moves(action: Column) -> Column:
    """What an action does from each state: the place of the next state and what is counted. One
    that is null or not known is illegal everywhere."""
    known = []
    for name in sorted({a for _, a in TRANSITIONS}):
        after = [TRANSITIONS.get((s, name)) for s in STATES]
        known += [F.lit(name), F.array(*(_move(STATES.index(t or s), bad=int(t is None)) for s, t in zip(STATES, after)))]
    return F.coalesce(F.element_at(F.create_map(*known), action), F.array(*(_move(k, bad=1) for k in range(len(STATES)))))


def _guarded(moves: Column, allowed: Column, expected: Column, skips: Column) -> Column:
    """Moves that hold only from the expected state, if one is named, and for an allowed actor. What
    is refused changes nothing and counts as stale, else illegal, else denied. skips: a submission
    passes the first level."""
    l1, l2 = STATES.index("PENDING_L1"), STATES.index("PENDING_L2")
    stays = lambda k, **count: _move(k, **count)
    past = lambda x: F.when(skips & (x["to"] == l1) & (x["bad"] == 0), _move(l2)).otherwise(x)
    return F.transform(moves, lambda x, k: F.when(expected != F.get(F.array(*map(F.lit, STATES)), k), stays(k, stale=1)).when(x["bad"] > 0, x).when(~allowed, stays(k, denied=1)).otherwise(past(x)))


def _then(first: Column, second: Column) -> Column:
    """Moves one after the other."""
    after = lambda x: F.get(second, x["to"])
    return F.transform(first, lambda x: F.struct(after(x)["to"].alias("to"), *((x[c] + after(x)[c]).alias(c) for c in COUNTS)))


def _composed(history: str, moves) -> Column:
    return F.aggregate(history, F.array(*(_move(k) for k in range(len(STATES)))), lambda m, x: _then(m, moves(x)))


def _ends(actions: DataFrame, what: list[str], moves) -> DataFrame:
    """(app_id, n, m) after all actions(app_id, seq, action, ...) in order: their number and the moves
    from every state. A request's history is cut into blocks of at most 4096 rows by ranges of
    (app_id, seq); a block becomes its moves from every state, and moves are joined by block, by
    range and by request, so no history is held in one row."""
    by = ["app_id", "seq", *what]
    ranged = actions.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = ranged.withColumn("at", F.monotonically_increasing_id())  # the range in the upper 31 bits
    placed = placed.select("app_id", F.shiftright("at", 33).alias("range"), F.shiftright("at", BLOCK_BITS).alias("block"), "at", *what)
    rows = placed.groupBy("app_id", "range", "block").agg(F.array_sort(F.collect_list(F.struct("at", *what))).alias("h"), F.count("*").alias("n"))
    rows = rows.select("app_id", "range", "block", "n", _composed("h", moves).alias("m"))
    for keys, order in (["app_id", "range"], "block"), (["app_id"], "range"):
        joined = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "m"))).alias("h"), F.sum("n").alias("n"))
        rows = joined.select(*keys, "n", _composed("h", lambda x: x["m"]).alias("m"))
    return rows.select("app_id", "n", F.get("m", F.lit(STATES.index("NONE"))).alias("end"))


def folded(actions: DataFrame) -> DataFrame:
    """(app_id, status, n_actions, n_illegal) after all actions(app_id, seq, action) in order, those
    of one seq by action. Null seqs come first."""
    rows = _ends(actions, ["action"], lambda x: _moves(x["action"]))
    return rows.select("app_id", F.get(F.array(*map(F.lit, STATES)), F.col("end.to")).alias("status"), F.col("n").alias("n_actions"), F.col("end.bad").alias("n_illegal"))


def attempts(applications: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions with whether their actor may do them and whether a submission passes the first level
    (the applicant approves it themself); applications(app_id, applicant, l1_approver, l2_approver).
    Actions of an unknown request may be done by nobody."""
    both = actions.join(applications.select("app_id", *sorted(set(ACTORS.values()))), "app_id", "left")
    role = F.coalesce(*(F.when(F.col("action") == a, F.col(c)) for a, c in ACTORS.items()))
    return both.select("app_id", "seq", "action", "expected", F.coalesce(role == F.col("actor"), F.lit(False)).alias("allowed"), F.coalesce(F.col("applicant") == F.col("l1_approver"), F.lit(False)).alias("skips"))


def decided(applications: DataFrame, actions: DataFrame) -> DataFrame:
    """(app_id, status, n_actions, n_illegal, n_denied, n_stale) after all actions(app_id, seq, action,
    actor, expected): compare and set. An action holds only from the state that its actor expects (any
    if null) and by the actor whom its request names: the applicant submits and cancels, each level's
    approver decides. A refused one changes nothing and is counted once, as stale, else illegal, else denied."""
    moves = lambda x: _guarded(_moves(x["action"]), x["allowed"], x["expected"], x["skips"])
    rows = _ends(attempts(applications, actions), ["action", "expected", "allowed", "skips"], moves)
    counts = [F.col(f"end.{c}").alias(n) for c, n in zip(COUNTS, ("n_illegal", "n_denied", "n_stale"))]
    return rows.select("app_id", F.get(F.array(*map(F.lit, STATES)), F.col("end.to")).alias("status"), F.col("n").alias("n_actions"), *counts)


def submitted(applications: DataFrame) -> DataFrame:
    """First status of a new request: an applicant who is the first approver passes that level; a
    request for a hash that has an active one with a smaller id is refused."""
    active = applications.where(F.col("status").isin("PENDING_L1", "PENDING_L2", "APPROVED")).groupBy("sql_hash").agg(F.min("id").alias("first_id"))
    both = applications.join(active, "sql_hash", "left")
    refused = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False))
    first = F.when(refused, "DUPLICATE").when(F.col("applicant") == F.col("l1_approver"), "PENDING_L2").otherwise("PENDING_L1")
    return both.select("id", first.alias("first_status"))


def propagated(rows: DataFrame, applications: DataFrame, target: str, key: str) -> DataFrame:
    """Rows with the status of the newest request for their key, and a whitelist flag that, once
    set, stays."""
    newest = applications.where(F.col("target_type") == target).groupBy(key).agg(F.max(F.struct("id", "status")).alias("top"), F.max((F.col("status") == "APPROVED").cast("int")).alias("ever"))
    joined = rows.join(newest, key, "left")
    return joined.select("id", F.col("top.status").alias("status"), F.greatest("is_whitelist", F.coalesce("ever", F.lit(0))).alias("is_whitelist"))


def marks(keys: DataFrame, state: DataFrame, active: DataFrame) -> DataFrame:
    """Outcome of marking keys(service_name, abstract_sql, round) as optimised: refused while a
    request is active; a new attempt with the newest round as its anchor where there is no state
    or it has regressed; else an edit of the latest attempt."""
    key = ["service_name", "abstract_sql"]
    anchor = keys.groupBy(*key).agg(F.max("round").alias("anchor"))
    blocked = active.select(*key).distinct().withColumn("blocked", F.lit(True))
    both = anchor.join(state.select(*key, "status", "optimized_round"), key, "left").join(blocked, key, "left")
    outcome = F.when(F.col("blocked"), "REFUSED").when(F.col("status").isNull() | (F.col("status") == "REGRESSED"), "NEW").otherwise("EDIT")
    return both.select(*key, outcome.alias("outcome"), F.when(outcome == "NEW", F.col("anchor")).otherwise(F.col("optimized_round")).alias("optimized_round"))


def revoked(state: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """State without the revoked keys' rounds, stamped with who did it."""
    key = ["service_name", "abstract_sql"]
    gone = keys.select(*key).distinct().withColumn("gone", F.lit(True))
    both = state.join(gone, key, "left")
    return both.select(*key, F.when(F.col("gone"), "REVOKED").otherwise(F.col("status")).alias("status"), F.when(F.col("gone"), F.lit(None)).otherwise(F.col("optimized_round")).alias("optimized_round"), F.when(F.col("gone"), F.lit(by)).alias("revoked_by"))


def inspected(rows: DataFrame) -> DataFrame:
    """Rules in order of precedence: approved rows are not inspected, inserts don't apply, failures
    have no rating, and so on."""
    path = F.when(F.col("is_whitelist") == 1, "WHITELISTED").when(F.col("kind") == "INSERT", "NOT_APPLICABLE").when(F.coalesce(F.col("explain_error") != "", F.lit(False)), "FAILED").when(F.col("est_rows") >= 1000, "POOR").otherwise("EXCELLENT")
    return rows.select("id", path.alias("outcome"))


def triaged(pool: DataFrame) -> DataFrame:
    """KEEP_FAILED, KEEP_PENDING for sequential scans, DELETE for the rest."""
    fate = F.when(F.coalesce(F.col("explain_error") != "", F.lit(False)), "KEEP_FAILED").when(F.col("rating") == "POOR", "KEEP_PENDING").otherwise("DELETE")
    return pool.select("id", fate.alias("fate"))


def reused(requests: DataFrame, done: DataFrame, seconds: int) -> DataFrame:
    """Each row of requests(id, sql_hash, env, at) with the newest result of done at most `seconds`
    older, of several the largest id. It lies in the request's own stretch of `seconds`, where a
    running maximum finds it, or is the newest of the stretch before; no pairs are made. Null
    hashes, environments and times meet nothing."""
    key = ["sql_hash", "env", "since"]
    since = F.col("at") - F.pmod(F.col("at"), F.lit(seconds))
    result = F.struct("at", F.col("id").alias("result"))
    found = done.where("sql_hash is not null and env is not null and at is not null").select("sql_hash", "env", since.alias("since"), "at", F.lit(0).alias("asks"), F.lit(None).alias("id"), result.alias("top"))
    asked = requests.select("sql_hash", "env", since.alias("since"), "at", F.lit(1).alias("asks"), "id", F.lit(None).alias("top"))
    so_far = Window.partitionBy(*key).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    own = asked.unionByName(found).withColumn("top", F.max("top").over(so_far)).where("asks = 1")
    before = found.groupBy("sql_hash", "env", (F.col("since") + seconds).alias("since")).agg(F.max("top").alias("last"))
    both = own.join(before, key, "left")
    last = F.when(F.col("last.at") >= F.col("at") - seconds, F.col("last.result"))
    return both.select("id", F.coalesce("top.result", last).alias("result"))


def queue(rows: DataFrame, limit: int) -> DataFrame:
    """The next rows to analyse: poor ones that wait, oldest first."""
    return rows.where("rating = 'POOR' AND llm_status = 'PENDING'").orderBy("id").limit(limit)


def changes(lines: DataFrame) -> DataFrame:
    """(path, change) of diff status lines: A, M and T change a path, D removes it, R removes the
    old and changes the new one, C changes the new one."""
    parts = F.split("line", "\t")
    code = F.substring("line", 1, 1)
    one = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
    rows = F.when(code.isin("A", "M", "T"), F.array(one(parts[1], "CHANGED"))).when(code == "D", F.array(one(parts[1], "REMOVED"))).when(code == "R", F.array(one(parts[1], "REMOVED"), one(F.get(parts, 2), "CHANGED"))).when(code == "C", F.array(one(F.get(parts, 2), "CHANGED")))
    return lines.select(F.explode(rows).alias("x")).select("x.*")


def modes(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, mode): how repos(repo_id, head, base) are read again. UNCHANGED where the base is the
    head; INCREMENTAL where it is an ancestor of the head; else FULL (no base, one that is gone, or one
    that a rebase left aside). commits(repo_id, seq, sha, parents): seq is the line of a topological
    log, in which children stand before their parents. So an ancestor stands further down, and the
    search goes from the heads of all repositories at once, only as far down as their bases."""
    name = lambda sha: F.concat_ws(":", "repo_id", sha)
    known = commits.select(name("sha").alias("node"), "seq")
    ends = repos.where("base <> head").select("repo_id", name("head").alias("head"), name("base").alias("base"))
    ends = ends.join(known.select(F.col("node").alias("head"), F.col("seq").alias("top")), "head").join(known.select(F.col("node").alias("base"), F.col("seq").alias("bottom")), "base").where("top < bottom")
    between = commits.join(ends.groupBy("repo_id").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")), "repo_id").where("seq BETWEEN top AND bottom")
    edges = between.select(name("sha").alias("src"), F.explode("parents").alias("parent"), "repo_id").select("src", name("parent").alias("dst"))
    found = reach(edges, ends.select(F.col("repo_id").alias("seed"), F.col("head").alias("node")))
    below = found.join(ends.select(F.col("repo_id").alias("seed"), F.col("base").alias("node")), ["seed", "node"], "left_semi").select(F.col("seed").alias("repo_id"), F.lit("INCREMENTAL").alias("found")).distinct()
    return repos.join(below, "repo_id", "left").select("repo_id", F.when(F.col("base") == F.col("head"), "UNCHANGED").otherwise(F.coalesce("found", F.lit("FULL"))).alias("mode"))
