"""Implied relations between tables, attribution joins and lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import dealt, hot_slots
from .windows import best


def containment(key_sets: DataFrame, columns: DataFrame, blacklist: list[str]) -> DataFrame:
    """(from_table, key_id, to_table, join_columns, key_columns, confidence) wherever a table has
    all columns of another one's key. Relational division by column name: no pair of tables is
    formed that shares no column, and columns of very many tables are dealt to several tasks. One
    blacklisted column alone is LOW."""
    keys = key_sets.distinct()
    sized = keys.groupBy("table_name", "key_id").agg(F.count("*").alias("key_columns"), F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("join_columns"), F.min("column_name").alias("one"))
    name, columns = ["column_name"], columns.distinct()
    hot = hot_slots(columns.groupBy(*name).agg(F.count("*").alias("n")), name, "n")
    asked, given = dealt(keys, name, hot, None).withColumnRenamed("table_name", "from_table"), dealt(columns, name, hot, "table_name").withColumnRenamed("table_name", "to_table")
    found = asked.join(given, [*name, "salt"]).where("from_table <> to_table")
    counted = found.groupBy("from_table", "key_id", "to_table").agg(F.count("*").alias("n"))
    out = counted.join(sized.withColumnRenamed("table_name", "from_table"), ["from_table", "key_id"]).where("n = key_columns")
    low = (F.col("key_columns") == 1) & F.col("one").isin(blacklist)
    return out.select("from_table", "key_id", "to_table", "join_columns", "key_columns", F.when(low, "LOW").otherwise("HIGH").alias("confidence"))


def degrees(relations: DataFrame, limit: int) -> DataFrame:
    """Tables by the number of relations at either end."""
    ends = relations.select(F.col("from_table").alias("table_name")).union(relations.select("to_table"))
    return ends.groupBy("table_name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "table_name").limit(limit)


def column_roles(relations: DataFrame) -> DataFrame:
    """Columns of the graph's tables with their roles as key and as reference."""
    one = relations.withColumn("column_name", F.explode(F.split("join_columns", ",")))
    a = one.select(F.col("from_table").alias("table_name"), "column_name", F.lit(1).alias("is_key"), F.lit(0).alias("is_fk"))
    b = one.select(F.col("to_table").alias("table_name"), "column_name", F.lit(0).alias("is_key"), F.lit(1).alias("is_fk"))
    return a.union(b).groupBy("table_name", "column_name").agg(F.max("is_key").alias("is_key"), F.max("is_fk").alias("is_fk"))


def mapped_fields(maps: DataFrame, fields: DataFrame) -> DataFrame:
    """(tx, edge, field) of maps(tx, src_field, dst_field): SOURCE_OF and TARGETS, a row for each field of
    that number in fields(tx, fields), the transaction's fields as an array. They meet by transaction
    before either is unfolded, and by a merge: arrays are larger than the optimizer guesses, too
    large for a broadcast."""
    end = lambda edge, column: F.transform(F.filter("fields", lambda x: x == F.col(column)), lambda x: F.struct(F.lit(edge).alias("edge"), x.alias("field")))
    both = maps.join(fields.hint("merge"), "tx").select("tx", F.explode(F.concat(end("SOURCE_OF", "src_field"), end("TARGETS", "dst_field"))).alias("x"))
    return both.select("tx", "x.edge", "x.field")


def attributed(throws: DataFrame, reached: DataFrame) -> DataFrame:
    """Throws with every transaction that reaches their method, or one UNMATCHED row. A marker
    tells a match; a matched transaction's id can be null itself."""
    hit = reached.withColumn("_hit", F.lit(True))
    joined = throws.join(hit, ["class_fqn", "method_name"], "left")
    return joined.withColumn("match_status", F.when(F.col("_hit").isNull(), "UNMATCHED").otherwise("MATCHED")).drop("_hit")


def codes_per_transaction(attributed_: DataFrame) -> DataFrame:
    return attributed_.where("match_status = 'MATCHED'").groupBy("tx_id").agg(F.count("*").alias("n"), F.count_distinct("error_code").alias("n_codes"))


def preferred(left: DataFrame, exact: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """value from exact, else from fallback."""
    a = exact.select(key, F.col(value).alias("_a"))
    b = fallback.select(key, F.col(value).alias("_b"))
    return left.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def polymorphic(calls: DataFrame, targets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """calls(call_id, label, ...) resolved by the table of their label on its own key; the smallest
    operation counts where there are several."""
    parts = []
    for label, (table, key) in targets.items():
        one = table.groupBy(*key).agg(F.min("operation").alias("operation"))
        parts.append(calls.where(F.col("label") == label).join(one, key).select("call_id", "label", "operation"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def specific_else_class(links: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Links to a method where it exists, the rest to the class."""
    exact = links.join(methods, ["class_fqn", "method_name"]).select("src", F.concat_ws("#", "class_fqn", "method_name").alias("target"), F.lit("METHOD").alias("kind"))
    rest = links.join(methods, ["class_fqn", "method_name"], "left_anti").join(classes, "class_fqn").select("src", F.col("class_fqn").alias("target"), F.lit("CLASS").alias("kind"))
    return exact.unionByName(rest)


def state_lookup(batch: DataFrame, state: DataFrame) -> DataFrame:
    """State by service and hash, else, for rows without a service, by hash alone; the newest counts."""
    exact = best(state.where("svc <> ''"), ["svc", "sql_hash"], F.desc("id")).select("svc", "sql_hash", F.col("status").alias("_a"))
    loose = best(state.where("svc = ''"), ["sql_hash"], F.desc("id")).select("sql_hash", F.col("status").alias("_b"))
    return batch.join(exact, ["svc", "sql_hash"], "left").join(loose, "sql_hash", "left").withColumn("status", F.coalesce("_a", "_b")).drop("_a", "_b")


def merged_targets(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; the second source overrides the first."""
    both = first.withColumn("_p", F.lit(1)).unionByName(second.withColumn("_p", F.lit(2)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_p")))).where("_k = 1").drop("_p", "_k")


def advice(suggestions: DataFrame, reasons: int = 3) -> DataFrame:
    """Table advice by its DDL: how often, by which statements, and at most three reasons, those
    that came first."""
    grouped = suggestions.where("scope = 'TABLE' AND ddl IS NOT NULL").groupBy("ddl")
    first_seen = suggestions.where("scope = 'TABLE' AND ddl IS NOT NULL").groupBy("ddl", "reason").agg(F.min("id").alias("at"))
    kept = first_seen.withColumn("_k", F.row_number().over(Window.partitionBy("ddl").orderBy("at", "reason"))).where(F.col("_k") <= reasons)
    texts = kept.groupBy("ddl").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))
    return grouped.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_statements"), F.max("risk").alias("risk")).join(texts, "ddl")
