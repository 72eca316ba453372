"""Code ownership: summaries by author, transaction and domain, and what merges repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import person_type, share_percent
from .windows import top_per


def with_person(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """person_name and person_type of each fact; an alias counts only if it is enabled."""
    on = aliases.where("enabled = 1").select(F.col("email").alias("author_email"), F.col("person_name").alias("alias_name"), F.col("person_type").alias("alias_type"))
    joined = facts.join(on, "author_email", "left")
    return joined.withColumn("person_name", F.coalesce("alias_name", "author_name")).withColumn("person_type", person_type("author_email", "alias_type"))


def author_summary(people: DataFrame) -> DataFrame:
    return people.groupBy("repo_id", "author_email").agg(
        F.coalesce(F.max("alias_name"), F.max("author_name")).alias("person_name"), F.max("person_type").alias("person_type"),
        F.sum("owned_lines").alias("owned_lines"), F.sum("added_lines").alias("added_lines"), F.count_distinct("file_path").alias("n_files"), F.max("last_day").alias("last_day"),
    )


def by_transaction(people: DataFrame, files: DataFrame) -> DataFrame:
    """A file shared by transactions counts fully for each. Lines are summed per file before the join, so a file
    is one row of its transaction and needs no count of distinct paths."""
    of_file = people.groupBy("repo_id", "file_path", "person_type").agg(F.sum("owned_lines").alias("lines"))
    n_of = files.groupBy("repo_id", "file_path", "tx_id").agg(F.count("*").alias("n"))
    joined = of_file.join(n_of, ["repo_id", "file_path"])
    return joined.groupBy("repo_id", "tx_id", "person_type").agg(F.sum(F.col("lines") * F.col("n")).alias("owned_lines"), F.count("*").alias("n_files"))


def by_domain(people: DataFrame, *more: str) -> DataFrame:
    return people.groupBy("domain_key", *more).agg(F.sum("owned_lines").alias("owned_lines"), F.count_distinct("file_path").alias("n_files"))


def staff_transactions(people: DataFrame, files: DataFrame) -> DataFrame:
    of_file = people.groupBy("repo_id", "file_path", "person_name", "person_type").agg(F.sum("owned_lines").alias("lines"))
    joined = of_file.join(files, ["repo_id", "file_path"]).groupBy("person_name", "tx_id", "person_type").agg(F.sum("lines").alias("owned_lines"))
    return joined.where("person_type = 'STAFF'")


def person_stats(summary: DataFrame, touched: DataFrame, limit: int) -> DataFrame:
    """Authors with the sorted list and number of their transactions; the limit comes after grouping."""
    tx = touched.groupBy("author_email").agg(F.array_sort(F.collect_set("tx_id")).alias("t"))
    out = summary.groupBy("author_email").agg(F.sum("owned_lines").alias("owned_lines"))
    top = out.orderBy(F.desc("owned_lines"), "author_email").limit(limit)
    return top.join(tx, "author_email", "left").select("author_email", "owned_lines", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tx_ids"), F.coalesce(F.size("t"), F.lit(0)).alias("n_tx"))


def domain_pivot(people: DataFrame) -> DataFrame:
    """Lines of staff and vendors by domain with the domain's share of all lines. n_files adds the
    distinct files of both kinds, so a file of both counts twice."""
    both = by_domain(people, "person_type")
    lines = lambda kind: F.sum(F.when(F.col("person_type") == kind, F.col("owned_lines")).otherwise(0))
    one = both.groupBy("domain_key").agg(lines("STAFF").alias("staff"), lines("VENDOR").alias("vendor"), F.sum("owned_lines").alias("total"), F.sum("n_files").alias("n_files"))
    everything = F.sum("total").over(Window.partitionBy())  # one row a domain
    return one.withColumn("share", share_percent(F.col("total"), everything)).withColumn("vendor_share", share_percent(F.col("vendor"), F.col("total")))


def overview(people: DataFrame) -> DataFrame:
    """Share of each kind of person in its repository."""
    one = people.groupBy("repo_id", "person_type").agg(F.sum("owned_lines").alias("owned_lines"))
    return one.withColumn("share", share_percent(F.col("owned_lines"), F.sum("owned_lines").over(Window.partitionBy("repo_id"))))


def merged_top(summary: DataFrame, per_repo: int, top: int) -> DataFrame:
    """Each repository's first rows are merged, then the first of all; an author just below the cut
    of a repository loses that repository's lines. See true_top."""
    kept = top_per(summary, ["repo_id"], per_repo, F.desc("owned_lines"), F.asc("author_email"))
    return true_top(kept, top)


def true_top(summary: DataFrame, top: int) -> DataFrame:
    return summary.groupBy("author_email").agg(F.sum("owned_lines").alias("owned_lines"), F.count_distinct("repo_id").alias("n_repos")).orderBy(F.desc("owned_lines"), "author_email").limit(top)


def snapshot(people: DataFrame, day: Column) -> DataFrame:
    lines = lambda kind: F.coalesce(F.sum(F.when(F.col("person_type") == kind, F.col("owned_lines"))), F.lit(0)).alias(f"{kind.lower()}_lines")
    return people.agg(lines("STAFF"), lines("VENDOR"), F.count_distinct("author_email").alias("n_authors")).withColumn("stat_day", day)
