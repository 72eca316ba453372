"""The ownership cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, view
from ..operators import ownership as O
from ..operators import writes

PLAN = Plan()
PEOPLE = ctes("owned", "aliases", "tx_files") + """, people AS (SELECT o.*, a.person_name AS alias_name, coalesce(a.person_name, author_name) AS person_name,
  coalesce(a.person_type, CASE WHEN regexp_matches(lower(split_part(author_email, '@', 1)), '^[ct]-') THEN 'VENDOR' ELSE 'STAFF' END) AS person_type FROM owned o LEFT JOIN aliases a ON a.email = o.author_email AND a.enabled = 1),
summary AS (SELECT repo_id, author_email, coalesce(max(alias_name), max(author_name)) AS person_name, max(person_type) AS person_type, sum(owned_lines)::BIGINT AS owned_lines, sum(added_lines)::BIGINT AS added_lines, count(DISTINCT file_path) AS n_files, max(last_day) AS last_day FROM people GROUP BY 1, 2)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_person(view(spark, sf_dir, "owned"), view(spark, sf_dir, "aliases"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "tx_files")


@PLAN.query("op_join02_enabled_aliases", PEOPLE + " SELECT person_name, person_type, count(*) AS n FROM people GROUP BY 1, 2")
def join02(spark, sf_dir):
    return people(spark, sf_dir).groupBy("person_name", "person_type").agg(F.count("*").alias("n"))


@PLAN.query("op_join01_file_map", PEOPLE + " SELECT f.tx_id, count(*) AS n, sum(owned_lines)::BIGINT AS owned_lines FROM owned o JOIN tx_files f ON o.repo_id = f.repo_id AND o.file_path = f.file_path GROUP BY 1")
def join01(spark, sf_dir):
    """Rows of a file are counted once before they meet its transactions."""
    facts = view(spark, sf_dir, "owned").groupBy("repo_id", "file_path").agg(F.count("*").alias("n"), F.sum("owned_lines").alias("lines"))
    return facts.join(files(spark, sf_dir), ["repo_id", "file_path"]).groupBy("tx_id").agg(F.sum("n").alias("n"), F.sum("lines").alias("owned_lines"))


@PLAN.query("op_agg14_author_summary", PEOPLE + " SELECT * FROM summary")
def agg14(spark, sf_dir):
    return O.author_summary(people(spark, sf_dir))


@PLAN.query("op_agg15_by_transaction", PEOPLE + " SELECT p.repo_id, f.tx_id, person_type, sum(owned_lines)::BIGINT AS owned_lines, count(DISTINCT p.file_path) AS n_files FROM people p JOIN tx_files f ON p.repo_id = f.repo_id AND p.file_path = f.file_path GROUP BY 1, 2, 3")
def agg15(spark, sf_dir):
    return O.by_transaction(people(spark, sf_dir), files(spark, sf_dir))


@PLAN.query("op_agg16_by_domain", PEOPLE + " SELECT domain_key, person_type, sum(owned_lines)::BIGINT AS owned_lines, count(DISTINCT file_path) AS n_files FROM people GROUP BY 1, 2")
def agg16(spark, sf_dir):
    return O.by_domain(people(spark, sf_dir), "person_type")


@PLAN.query("op_agg17_staff_transactions", PEOPLE + " SELECT person_name, f.tx_id, person_type, sum(owned_lines)::BIGINT AS owned_lines FROM people p JOIN tx_files f ON p.repo_id = f.repo_id AND p.file_path = f.file_path GROUP BY 1, 2, 3 HAVING person_type = 'STAFF'")
def agg17(spark, sf_dir):
    return O.staff_transactions(people(spark, sf_dir), files(spark, sf_dir))


@PLAN.query("op_agg18_by_person_type", PEOPLE + " SELECT person_type, sum(owned_lines)::BIGINT AS owned_lines, sum(n_files)::BIGINT AS n_files FROM summary GROUP BY 1")
def agg18(spark, sf_dir):
    return O.author_summary(people(spark, sf_dir)).groupBy("person_type").agg(F.sum("owned_lines").alias("owned_lines"), F.sum("n_files").alias("n_files"))


@PLAN.query("op_agg19_person_stats", PEOPLE + """, tx AS (SELECT author_email, list_sort(list(DISTINCT tx_id)) AS t FROM owned GROUP BY 1), s AS (SELECT author_email, sum(owned_lines)::BIGINT AS owned_lines FROM summary GROUP BY 1 ORDER BY owned_lines DESC, author_email LIMIT 50)
  SELECT author_email, owned_lines, array_to_string(t, ',') AS tx_ids, len(t)::INT AS n_tx FROM s LEFT JOIN tx USING (author_email)""")
def agg19(spark, sf_dir):
    """The fifty authors with most lines."""
    return O.person_stats(O.author_summary(people(spark, sf_dir)), view(spark, sf_dir, "owned").select("author_email", "tx_id"), 50)


PIVOT = PEOPLE + """, d AS (SELECT domain_key, person_type, sum(owned_lines)::BIGINT AS owned_lines, count(DISTINCT file_path) AS n_files FROM people GROUP BY 1, 2),
one AS (SELECT domain_key, coalesce(sum(owned_lines) FILTER (person_type = 'STAFF'), 0)::BIGINT AS staff, coalesce(sum(owned_lines) FILTER (person_type = 'VENDOR'), 0)::BIGINT AS vendor, sum(owned_lines)::BIGINT AS total, sum(n_files)::BIGINT AS n_files FROM d GROUP BY 1)
SELECT *, floor(total * 1000.0::DOUBLE / (sum(total) OVER ())::BIGINT + 0.5) / 10.0 AS share, CASE WHEN total = 0 THEN 0.0 ELSE floor(vendor * 1000.0::DOUBLE / total + 0.5) / 10.0 END AS vendor_share FROM one"""


@PLAN.query("op_agg20_domain_pivot", PIVOT)
def agg20(spark, sf_dir):
    return O.domain_pivot(people(spark, sf_dir))


@PLAN.query("op_agg21_overview", PEOPLE + ", o AS (SELECT repo_id, person_type, sum(owned_lines)::BIGINT AS owned_lines FROM people GROUP BY 1, 2) SELECT *, floor(owned_lines * 1000.0::DOUBLE / (sum(owned_lines) OVER (PARTITION BY repo_id))::BIGINT + 0.5) / 10.0 AS share FROM o")
def agg21(spark, sf_dir):
    return O.overview(people(spark, sf_dir))


TOP = PEOPLE + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY owned_lines DESC, author_email) AS k FROM summary) SELECT author_email, sum(owned_lines)::BIGINT AS owned_lines, count(DISTINCT repo_id) AS n_repos FROM r WHERE {test} GROUP BY 1 ORDER BY owned_lines DESC, author_email LIMIT 20"


@PLAN.query("op_agg22_merged_top", TOP.replace("{test}", "k <= 10"))
def agg22(spark, sf_dir):
    """The first twenty of the repositories' first ten."""
    return O.merged_top(O.author_summary(people(spark, sf_dir)), 10, 20)


@PLAN.query("op_agg22_true_top", TOP.replace("{test}", "true"))
def agg22_true(spark, sf_dir):
    """The first twenty over all rows."""
    return O.true_top(O.author_summary(people(spark, sf_dir)), 20)


@PLAN.query("op_agg23_snapshot", PEOPLE + " SELECT sum(owned_lines) FILTER (person_type = 'STAFF')::BIGINT AS staff_lines, sum(owned_lines) FILTER (person_type = 'VENDOR')::BIGINT AS vendor_lines, count(DISTINCT author_email) AS n_authors, '2026-01-01' AS stat_day FROM people")
def agg23(spark, sf_dir):
    return O.snapshot(people(spark, sf_dir), F.lit("2026-01-01"))


@PLAN.query("op_srt04_top_owned", PEOPLE + " SELECT author_email, owned_lines FROM summary ORDER BY owned_lines DESC, author_email, repo_id LIMIT 1000")
def srt04(spark, sf_dir):
    """The first 5000, clamped to 1000."""
    return O.author_summary(people(spark, sf_dir)).orderBy(F.desc("owned_lines"), "author_email", "repo_id").limit(min(5000, 1000)).select("author_email", "owned_lines")


@PLAN.query("op_set07_tx_union", PEOPLE + " SELECT author_email, array_to_string(list_sort(list(DISTINCT f.tx_id)), ',') AS tx_ids FROM owned o JOIN tx_files f ON o.repo_id = f.repo_id AND o.file_path = f.file_path GROUP BY 1")
def set07(spark, sf_dir):
    who = view(spark, sf_dir, "owned").select("repo_id", "file_path", "author_email").distinct()
    tx = who.join(files(spark, sf_dir), ["repo_id", "file_path"]).groupBy("author_email").agg(F.array_sort(F.collect_set("tx_id")).alias("t"))
    return tx.select("author_email", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tx_ids"))


CHANGED = PEOPLE + """, changed AS (SELECT DISTINCT file_path FROM owned WHERE domain_key = 'dept'), fresh AS (SELECT repo_id, file_path, author_email, owned_lines + 1 AS owned_lines FROM owned WHERE domain_key = 'dept' AND owned_lines > 10),
  after_ AS (SELECT repo_id, file_path, author_email, owned_lines FROM owned WHERE file_path NOT IN (SELECT file_path FROM changed) UNION ALL SELECT * FROM fresh)"""


@PLAN.query("op_snk03_incremental", CHANGED + " SELECT repo_id, count(*) AS n, sum(owned_lines)::BIGINT AS owned_lines FROM after_ GROUP BY 1")
def snk03(spark, sf_dir):
    """Files of one domain have changed; some of them are gone."""
    old = view(spark, sf_dir, "owned").select("repo_id", "file_path", "author_email", "owned_lines", "domain_key")
    dept = old.where("domain_key = 'dept'")
    fresh = dept.where("owned_lines > 10").withColumn("owned_lines", F.col("owned_lines") + 1)
    after = writes.replaced(old.drop("domain_key"), dept.select("file_path").distinct(), fresh.drop("domain_key"), ["file_path"])
    return after.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("owned_lines").alias("owned_lines"))
