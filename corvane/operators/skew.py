"""Keys with very many rows, dealt to more tasks the more rows they have, and sizes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes, and slots of the table of keys with more.
HOT, SLOTS = 4096, 1 << 16
#: Rows of a table that may go through the driver.
FEW = 1 << 16


def apart(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for a join of two sides that grow with the input: both are dealt by its keys. The optimizer
    takes the compressed bytes of a kept table for its size, and would send millions of its rows
    through the driver to all executors. With its number of rows, a small table is left to it."""
    return df if rows is not None and rows <= FEW else df.hint("merge")


def hot_slots(counts: DataFrame, key: list[str], n: str, hot: int | None = None) -> DataFrame:
    """(slot, salts) of the keys of counts with over `hot` rows by the column n: a table of at most SLOTS
    rows. A key that shares the slot of a hot one is dealt out with it, which does no harm."""
    hot = hot or HOT
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS)).alias("slot")
    return counts.where(F.col(n) > hot).groupBy(slot).agg(F.ceil(F.max(n) / hot).cast("int").alias("salts"))


def dealt(df: DataFrame, key: list[str], slots: DataFrame, by: str | None) -> DataFrame:
    """df with a salt: rows of a hot key are dealt by the column `by` over the key's salts; without
    it, a row is there for each salt, so that both meet on the key and the salt."""
    there = df.withColumn("slot", F.pmod(F.xxhash64(*key), F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left").drop("slot")
    salts = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64(by), salts).cast("int") if by else F.explode(F.sequence(F.lit(0), salts - 1))
    return there.withColumn("salt", salt).drop("salts")


def partitions(df: DataFrame, mb: int = 64, grows: int = 4) -> int:
    """How many partitions of about mb megabytes df makes, shuffle.partitions at least. Its size is the
    optimizer's estimate, for files their bytes, which grow about so many times as they are read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size * grows // (mb << 20)), 1_000_000))
