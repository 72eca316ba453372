"""Conditional sums over inspected statements and the pool, and what joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalar import domain_label

# The ratings.
RATED = ["EXCELLENT", "GOOD", "POOR"]


def _error() -> Column:
    return F.coalesce(F.col("explain_error") != "", F.lit(False))


def bands(unanalysed: bool = False) -> list[Column]:
    """total counts errors whatever their whitelist, else ratings; the rest need plain rows. The
    columns don't add up to the total."""
    rated = ~_error() & F.col("rating").isin(RATED)
    out = [
        F.count_if(_error() | rated).alias("total"),
        F.count_if(P.plain() & _error()).alias("explain_err"),
        F.count_if(P.plain() & ~_error() & (F.col("rating") == "POOR")).alias("need_fix"),
        F.count_if(P.wl_applying()).alias("wl_applying"),
        F.count_if(P.wl_approved()).alias("wl_approved"),
    ]
    return [*out, F.count_if(~_error() & F.col("rating").isNull()).alias("unanalysed")] if unanalysed else out


def by_domain(rows: DataFrame, unanalysed: bool = False) -> DataFrame:
    return rows.groupBy(domain_label("project").alias("domain")).agg(*bands(unanalysed))


def remediation(rows: DataFrame) -> DataFrame:
    return rows.groupBy(domain_label("project").alias("domain")).agg(
        F.count_if(_error()).alias("error_count"), F.count_if(~_error() & (F.col("rating") == "POOR")).alias("need_fix"),
        F.count_if(~_error() & (F.col("rating") == "EXCELLENT")).alias("fine"), F.count_if(P.wl_approved()).alias("exempt"),
    )


def kpi(rows: DataFrame) -> DataFrame:
    """One row; sums of nothing are 0."""
    one = lambda test, name: F.coalesce(F.count_if(test), F.lit(0)).alias(name)
    return rows.agg(
        F.count("*").alias("total"), one(_error(), "explain_error"), one(F.col("llm_status") == "DONE", "llm_findings"),
        one(F.col("llm_status") == "PENDING", "llm_pending"), one(F.col("llm_status") == "FAILED", "llm_error"),
    )


def added(*parts: DataFrame, key: list[str]) -> DataFrame:
    """Field-wise sums of equal tables by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(*(F.sum(c).alias(c) for c in out.columns if c not in key)) if key else out.agg(*(F.sum(c).alias(c) for c in out.columns))


def latest_tasks(tasks: DataFrame, n: int) -> DataFrame:
    return tasks.where("status = 'DONE'").orderBy(F.desc("created_s"), F.desc("id")).limit(n)


def trend(tasks: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Bands by the latest done tasks and domain; a task without items gives a row of zeros."""
    newest = F.broadcast(latest_tasks(tasks, n).select(F.col("id").alias("task_id"), "task_no"))  # n rows
    joined = newest.join(items, "task_id", "left")
    return joined.groupBy("task_no", domain_label("project").alias("domain")).agg(*bands())


def elapsed(tasks: DataFrame, n: int) -> DataFrame:
    """Seconds of the latest done tasks, oldest first."""
    return latest_tasks(tasks, n).select("id", "task_no", (F.col("updated_s") - F.col("created_s")).alias("elapsed_s")).orderBy("id")


def task_list(tasks: DataFrame, items: DataFrame, pool: DataFrame) -> DataFrame:
    """Tasks with counts of their items and of their environment's pool, each counted before it is joined."""
    of_task = items.groupBy("task_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("rating") == "POOR").alias("n_poor"))
    of_env = pool.groupBy(F.coalesce("env", F.lit("")).alias("env")).agg(F.count("*").alias("n_pool"))
    out = tasks.join(of_task, F.col("id") == F.col("task_id"), "left").join(of_env, "env", "left")
    return out.select("id", "task_no", "env", "status", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_items", "n_poor", "n_pool")))


def issue_shape(rows: DataFrame, source: str) -> DataFrame:
    """Items and pool rows in one shape; what a source lacks is null."""
    task = F.col("task_id") if "task_id" in rows.columns else F.lit(None).cast("long")
    return rows.select(F.lit(source).alias("source"), "id", task.alias("task_id"), "project", "named_sql", "sql_hash", "rating", "explain_error", "whitelist_status")


def issues(items: DataFrame, pool: DataFrame) -> DataFrame:
    shown = issue_shape(items.where(P.showable()), "ITEM")
    return shown.unionByName(issue_shape(pool.where(P.showable(pool=True)), "POOL"))


def zero_filled(counts: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    return kinds.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def access_patterns(rows: DataFrame, table: str, n: int) -> DataFrame:
    """Statements that read a table, by their sorted list of tables: the n commonest lists with
    their ratings. The table is found as part of the text, so it also finds longer names."""
    names = F.array_join(F.array_sort(F.transform(F.split("involved_tables", ","), lambda x: F.trim(x))), ",")
    found = rows.where(F.col("involved_tables").contains(table)).groupBy(names.alias("tables"))
    out = found.agg(F.count("*").alias("n"), *(F.count_if(F.col("rating") == r).alias(r.lower()) for r in RATED))
    return out.orderBy(F.desc("n"), "tables").limit(n)


def scan_preview(candidates: DataFrame, sample: int = 5) -> DataFrame:
    """(part, ord, name, n, source_file, sql) over candidates(seq, project, class_fqn, source_file,
    sql): the total, counts by project, the ten commonest classes (the first seen of equals) and
    the first `sample` candidates (50 at most), SQL cut after 200 characters as the report shows it."""
    none = lambda kind: F.lit(None).cast(kind)
    named = lambda c: F.coalesce(F.col(c), F.lit("(unknown)")).alias("name")
    shape = lambda df, part, order, name, n, file, sql: df.select(F.lit(part).alias("part"), order.cast("long").alias("ord"), name.alias("name"), n.alias("n"), file.alias("source_file"), sql.alias("sql"))
    counted = lambda c: candidates.groupBy(named(c)).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    text, n, name = none("string"), F.col("n"), F.col("name")
    total = shape(candidates.agg(F.count("*").alias("n")), "total", none("long"), text, n, text, text)
    projects = shape(counted("project"), "project", none("long"), name, n, text, text)
    top = counted("class_fqn").orderBy(F.desc("n"), "seq", "name").limit(10)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "seq", "name", "n"))).alias("x")).select(F.posexplode("x").alias("pos", "x")).select("pos", "x.*")
    classes = shape(ranked, "class", F.col("pos") + 1, name, n, text, text)
    first = candidates.orderBy("seq").limit(min(max(sample, 0), 50))
    listed = first.agg(F.array_sort(F.collect_list(F.struct("seq", "class_fqn", "source_file", "sql"))).alias("x")).select(F.posexplode("x").alias("pos", "x")).select("pos", "x.*")
    cut = F.when(F.char_length("sql") > 200, F.concat(F.substring("sql", 1, 200), F.lit("..."))).otherwise(F.col("sql"))
    samples = shape(listed, "sample", F.col("pos") + 1, F.col("class_fqn"), none("long"), F.col("source_file"), cut)
    return total.unionByName(projects).unionByName(classes).unionByName(samples)
