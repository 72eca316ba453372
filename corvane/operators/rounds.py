"""Slow statements by round: representatives, repeats, dashboards and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import best

KEY = ["service_name", "abstract_sql"]


def representatives(raw: DataFrame) -> DataFrame:
    """A row per round and key: how often it was seen, and cost, parameters and location of the
    costliest observation, the first one of equal cost. One aggregation, combined before the
    shuffle: costs are ordered together with the negated sequence."""
    chosen = F.max(F.struct("cost_ms", (-F.col("seq")).alias("back"), "cost_raw", "exec_params", "source_location")).alias("top")
    out = raw.groupBy("round", *KEY).agg(F.count("*").alias("exec_count"), chosen)
    return out.select("round", *KEY, "exec_count", F.col("top.cost_ms").alias("max_cost_ms"), F.col("top.cost_raw").alias("max_cost_raw"), F.col("top.exec_params").alias("exec_params"), F.col("top.source_location").alias("source_location"))


def repeat_rounds(facts: DataFrame, round_: str | None = None) -> DataFrame:
    """repeat_rounds: the other rounds that have the key, ascending and comma-joined, null if
    none; for one round or for all."""
    seen = facts.groupBy(*KEY).agg(F.array_sort(F.collect_set("round")).alias("rounds"))
    wanted = facts if round_ is None else facts.where(F.col("round") == round_)
    others = F.array_remove("rounds", F.col("round"))
    return wanted.join(seen, KEY).withColumn("repeat_rounds", F.when(F.size(others) > 0, F.array_join(others, ","))).drop("rounds")


def round_dashboard(facts: DataFrame, last: int) -> DataFrame:
    """Counts of the last rounds, ascending: all keys, repeated ones, those being applied for and
    approved ones."""
    applying = F.col("whitelist_status").isin("PENDING_L1", "PENDING_L2", "REJECTED_L1", "REJECTED_L2")
    counted = facts.groupBy("round").agg(
        F.count("*").alias("total"), F.count("repeat_rounds").alias("repeated"),
        F.count_if(applying).alias("applying"), F.count_if(F.col("whitelist_status") == "APPROVED").alias("approved"),
    )
    return counted.orderBy(F.desc("round")).limit(last).orderBy("round")


def domain_pivot(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows without a whitelist status by domain and kind; 'other' is NOT IN, so null counts nowhere."""
    open_ = facts.where("whitelist_status is null")
    columns = [F.count_if(F.col("biz_type") == k).alias(k) for k in kinds]
    return open_.groupBy("domain").agg(*columns, F.count_if(~F.col("biz_type").isin(kinds)).alias("other"), F.count("*").alias("total"))


def regressions(batch: DataFrame, state: DataFrame) -> DataFrame:
    """State after an import: a key seen in a round after its optimised one has regressed. counted
    marks only OPTIMIZED -> REGRESSED."""
    keys = batch.select(*KEY, F.col("round").alias("r")).distinct().groupBy(*KEY).agg(F.max("r").alias("r"))
    both = state.join(keys, KEY, "left")
    later = F.coalesce(F.col("r") > F.col("optimized_round"), F.lit(False))
    return both.select(
        *KEY, "optimized_round",
        F.when(later, "REGRESSED").otherwise(F.col("status")).alias("status"),
        F.when(later, F.greatest("reappeared_round", "r")).otherwise(F.col("reappeared_round")).alias("reappeared_round"),
        (later & (F.col("status") == "OPTIMIZED")).cast("int").alias("counted"), F.col("r").isNotNull().cast("int").alias("stamped"),
    )


def stamped(facts: DataFrame, state: DataFrame) -> DataFrame:
    """Facts with their state as a view-time join."""
    return facts.join(state.select(*KEY, F.col("status").alias("optimize_status"), "optimized_round", "reappeared_round"), KEY, "left")


def latest_round(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*KEY).agg(F.max("round").alias("latest_round"), F.count("*").alias("n_rounds"))


def status_filter(status: str) -> Column:
    """NONE asks for no status."""
    return F.col("optimize_status").isNull() if status == "NONE" else F.col("optimize_status") == status


def page(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 500) -> DataFrame:
    """A page with its limits clamped to 1..most and 0.."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def attempts(marks: DataFrame) -> DataFrame:
    """History of marks(key, seq, kind): MARK begins a new attempt, EDIT changes the latest one."""
    from pyspark.sql import Window

    along = Window.partitionBy("key").orderBy("seq")
    numbered = marks.withColumn("attempt", F.sum((F.col("kind") == "MARK").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return best(numbered.where("attempt > 0"), ["key", "attempt"], F.desc("seq"))
