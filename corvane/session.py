"""Session defaults and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "corvane", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a new temporary one, but only
    for a local master, whose executors share it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def keep(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: the lineage ends
    there, and a lost executor costs no recomputation. The table goes when the program ends.
    small: rows are few and narrow for the tasks that make them, so they are dealt to fewer that
    write them, as every file costs calls to the store: as many as adaptive execution finds by
    their bytes, or an eighth of the shuffle partitions where it may not merge any."""
    spark = df.sparkSession
    if small:
        sized = all(spark.conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "coalescePartitions.enabled"))
        df = df.hint("rebalance") if sized else df.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._corvane_path = drop_at_exit(spark, path)
    return kept


def discard(*kept: DataFrame | None) -> None:
    """Deletes tables that keep wrote and nothing will read again."""
    for df in kept:
        if path := getattr(df, "_corvane_path", None):
            drop(df.sparkSession, path)


def drop_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the program ends."""
    atexit.register(drop, spark, path)
    return path


def keep_counted(df: DataFrame, name: str, of: str | None = None, small: bool = False) -> tuple[DataFrame, int]:
    """keep, and how many rows it wrote, or in how many the condition `of` holds; the write itself
    counts them."""
    rows = Observation()
    kept = keep(df.observe(rows, F.count(F.expr(f"CASE WHEN {of} THEN 1 END") if of else F.lit(1)).alias("n")), name, small)
    return kept, rows.get["n"]


def drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        pass
