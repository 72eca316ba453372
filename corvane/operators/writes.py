"""Write modes as DataFrame merges; publishing them is one atomic overwrite."""

from __future__ import annotations

import os
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import best


def replaced(old: DataFrame, keys: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    """old without the rows of keys, with the fresh ones."""
    return old.join(keys, on, "left_anti").unionByName(fresh)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Three outcomes: INSERTED; UPDATED where updated differs, older or not; UNCHANGED. Nothing
    but updated changes on a row that exists. Old rows outside the batch stay, with KEPT."""
    rest = [c for c in old.columns if c not in (*key, "updated")]
    a, b = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    joined = a.alias("a").join(b.alias("b"), key, "full_outer")
    outcome = F.when(F.col("_old").isNull(), "INSERTED").when(F.col("_new").isNull(), "KEPT").when(~F.col("a.updated").eqNullSafe(F.col("b.updated")), "UPDATED").otherwise("UNCHANGED")
    held = lambda c: F.when(F.col("_old").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*key, *map(held, rest), F.when(F.col("_new").isNull(), F.col("a.updated")).otherwise(F.col("b.updated")).alias("updated"), outcome.alias("outcome"))


def decisions_kept(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """status of people's decisions stays, all else becomes AUTO."""
    decided = old.where(F.col("status").isin("CONFIRMED", "IGNORED")).select(*key, "status")
    return new.join(decided, key, "left").withColumn("status", F.coalesce("status", F.lit("AUTO")))


def stale_purged(table: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Drops AUTO rows whose key isn't live."""
    kept = table.where("status = 'AUTO'").join(live.select(*key).distinct(), key, "left_semi")
    return table.where("status <> 'AUTO'").unionByName(kept.select(table.columns))


def latest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or overwrite by key; within the batch the largest seq counts."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return best(both, key, F.desc("_o"), F.desc("seq")).drop("_o")


def published(df: DataFrame, path: str, *partitions: str) -> None:
    """All or nothing: Spark's commit protocol shows the new table only when every task is done.
    With partitions only those in df are replaced."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def exported(df: DataFrame, path: str, columns: list[Column | str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def _claim(spark: SparkSession, path: str, env: str, day: str) -> str:
    if not env or not env.strip():
        raise ValueError("a run needs an environment")
    return f"{path}/claims/{quote(env, safe='')}/{quote(day, safe='')}"


def begin(spark: SparkSession, path: str, env: str, day: str) -> bool:
    """Claims the day's run of an environment; False where one is running. The claim is a marker that
    only one start can create: by an exclusive open on a local or mounted folder, elsewhere by the
    store's create without overwriting, which name nodes do at once. A finished run's marker is gone, so
    the next start takes its place; one whose driver has died keeps the day until the marker is removed."""
    claim = _claim(spark, path, env, day)
    files, at = _folder(spark, claim)
    files.mkdirs(at(claim).getParent())
    if files.getScheme() == "file":
        try:
            os.close(os.open(at(claim).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(at(claim), False).close()
    except Exception as e:
        if files.exists(at(claim)):
            return False
        raise e
    return True


def finish(spark: SparkSession, path: str, env: str, day: str, rows: DataFrame | None) -> None:
    """Ends a claimed run: its rows take the place of those of the same environment and day, and of no
    others; None leaves what is there. Then the day may be claimed again."""
    if rows is not None:
        published(rows.withColumn("env", F.lit(env)).withColumn("day", F.lit(day)), f"{path}/items", "env", "day")
    claim = _claim(spark, path, env, day)
    files, at = _folder(spark, claim)
    files.delete(at(claim), False)


def staged(df: DataFrame, path: str, wanted: Column | None = None) -> bool:
    """Writes a new version below path and publishes it if all its rows are wanted. A version counts
    once its folder has Spark's _SUCCESS mark, which is the last thing a write does."""
    spark = df.sparkSession
    version = f"v{int((current(spark, path) or 'v0')[1:]) + 1:06d}"
    draft = f"{path}/draft-{version}"
    df.write.mode("overwrite").parquet(draft)
    if wanted is not None and not spark.read.schema(df.schema).parquet(draft).where(~F.coalesce(wanted, F.lit(False))).isEmpty():
        return False
    files, at = _folder(spark, path)
    return files.rename(at(draft), at(f"{path}/{version}"))


def current(spark: SparkSession, path: str) -> str | None:
    """The newest published version, null if none."""
    files, at = _folder(spark, path)
    if not files.exists(at(path)):
        return None
    names = [s.getPath().getName() for s in files.listStatus(at(path))]
    return max((n for n in names if n.startswith("v")), default=None)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at
