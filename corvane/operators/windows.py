"""First, last and best rows of a key, with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def best(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the order must be total."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def first_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    return best(df, key, F.col(seq).asc())


def last_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    return best(df, key, F.col(seq).desc())


def top_per(df: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def carried(df: DataFrame, value: str, key: list[str], seq: str) -> DataFrame:
    """value with nulls filled from the last row before that has one. Rows are dealt in their order, so
    a key of any size spreads over tasks; each part's rows of a key begin with the last value of the
    parts before, a table of a row for each part that does not begin with its key."""
    dealt = keep(df.repartitionByRange(*key, seq).withColumn("_part", F.spark_partition_id()), "in-order")
    lasts = dealt.groupBy(*key, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias("_last"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where("_last IS NOT NULL")
    lasts = lasts.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("_part").alias("_at"), "_last")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    back = Window.partitionBy("_part", *key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn(value, F.last(value, ignorenulls=True).over(back)).join(F.broadcast(lasts), [F.col("_part") == F.col("_at"), *same], "left")
    return filled.withColumn(value, F.coalesce(value, "_last")).select(*df.columns)


def latest_flag(df: DataFrame, key: list[str], seq: str, name: str = "latest") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(F.col(seq).desc())) == 1).cast("int"))
