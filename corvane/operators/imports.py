"""Import of logged statements into a pool: every line gets a reason, what is kept is merged inside the
batch and then with the pool, and one pass over outcomes gives the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_line, log_time

# A name's word that drops the line, the longest name and text, the project of unknown names.
ENTITY, NAME_LENGTH, TEXT_LENGTH, OTHER = "Entity", 500, 60_000, "other"


def tagged(lines: DataFrame, line: str, now: Column) -> DataFrame:
    """The lines that are not blank with named_sql, sql_text, sql_hash, log_ts and their reason: OK,
    MALFORMED (no log line, an empty part, a name that is too long), ENTITY or OVERSIZE. A time that
    can't be read is now. Other columns go along, but for those of these names."""
    found = log_line(line)
    blank = F.trim(F.regexp_replace(line, r"\s+", " ")) == ""
    rows = lines.where(F.col(line).isNotNull() & ~blank).withColumns({"named_sql": F.trim(found["named"]), "sql_text": F.trim(found["sql"]), "log_ts": log_time(F.trim(found["ts"]), now)})
    bad = F.col("named_sql").isNull() | F.col("sql_text").isNull()
    reason = (
        F.when(bad, "MALFORMED").when(F.col("named_sql").contains(ENTITY), "ENTITY").when(F.char_length("named_sql") > NAME_LENGTH, "MALFORMED")
        .when(F.char_length("sql_text") > TEXT_LENGTH, "OVERSIZE").when((F.col("named_sql") == "") | (F.col("sql_text") == ""), "MALFORMED").otherwise("OK")
    )
    return rows.withColumn("sql_hash", F.sha2("sql_text", 256)).withColumn("reason", reason)


def merged(rows: DataFrame) -> DataFrame:
    """(named_sql, sql_hash, sql_text, log_ts, k): one row a statement of the tagged rows that are OK,
    with the newest time and how many lines it had."""
    return rows.where("reason = 'OK'").groupBy("named_sql", "sql_hash").agg(F.first("sql_text").alias("sql_text"), F.max("log_ts").alias("log_ts"), F.count("*").alias("k"))


def imported(batch: DataFrame, pool: DataFrame, projects: DataFrame) -> DataFrame:
    """The merged batch with its project, by the part of its name before the first dot, and its
    outcome against pool(named_sql, sql_hash, log_ts): INSERTED, UPDATED (another time) or UNCHANGED."""
    known = pool.groupBy("named_sql", "sql_hash").agg(F.max("log_ts").alias("was"))
    index = projects.groupBy(F.col("sqls_id").alias("_id")).agg(F.max_by("project", "seq").alias("project"))
    both = batch.withColumn("_id", F.substring_index("named_sql", ".", 1)).join(known, ["named_sql", "sql_hash"], "left").join(index, "_id", "left").drop("_id")
    outcome = F.when(F.col("was").isNull(), "INSERTED").when(F.col("was") != F.col("log_ts"), "UPDATED").otherwise("UNCHANGED")
    return both.withColumn("outcome", outcome).withColumn("project", F.coalesce("project", F.lit(OTHER))).drop("was")


def report(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(part, name, n): lines by reason and how many were scanned, lines that repeat a statement, outcomes,
    and statements by project; counters that are zero have no row."""
    part = lambda df, name, key, n: df.select(F.lit(name).alias("part"), key.alias("name"), n.alias("n"))
    reasons = rows.groupBy("reason").agg(F.count("*").alias("n"))
    scanned = rows.agg(F.count("*").alias("n"))
    counted = done.groupBy("outcome").agg(F.count("*").alias("n"))
    again = done.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))
    projects = done.groupBy("project").agg(F.count("*").alias("n"))
    n = F.col("n")
    out = part(reasons, "reason", F.col("reason"), n).unionByName(part(scanned, "lines", F.lit("SCANNED"), n)).unionByName(part(again, "lines", F.lit("DUPLICATED"), n))
    return out.unionByName(part(counted, "outcome", F.col("outcome"), n)).unionByName(part(projects, "project", F.col("project"), n)).where("n > 0")
