"""Transaction models from call facts: what a method calls at its boundary (tables, components,
services), and the services and components that a transaction's flow steps lead to.

Facts: calls(etype, src, label, dst, method_name), where dst is a signature (label Method), a class
or interface (Class, Interface), a logical code (ServiceOperation) or a table (DaoMethod; null or
blank where it is unknown); implements(code, signature); methods(signature, class_fqn, name);
operations(code, node_kind, interface_fqn, method_name)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .graph import dao_tables, reach
from .impact import Layers

DEPTH = 8


@dataclass
class Facts:
    calls: DataFrame
    implements: DataFrame
    methods: DataFrame
    operations: DataFrame


def _given(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def is_component(prefix: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(prefix))), F.lit("pbs")).startswith("pbc")


def _first(df: DataFrame, *key: str) -> DataFrame:
    """One operation a key, the smallest code."""
    return df.where(F.col("code").isNotNull()).groupBy(*key).agg(F.min("code").alias("code"))


def resolved(facts: Facts) -> DataFrame:
    """(node, target, kind): the tables, components and services that single calls lead to. A method
    stands for the operation that it implements, a class or interface together with the called
    method's name for the operation implemented or declared there."""
    c = facts.calls.where(F.col("etype").isin("CALLS", "SYS_UTIL_CALLS", "SELF_CALLS", "DAO_CALLS"))
    of = lambda label: c.where(F.col("label") == label)
    table = of("DaoMethod").where(_given("dst") & _given("method_name")).select(F.col("src").alias("node"), F.col("dst").alias("target"), F.lit("TABLE").alias("kind"))
    impl = facts.implements.select("code", "signature")
    by_method = _first(impl, "signature").withColumnRenamed("signature", "dst")
    by_class = _first(impl.join(facts.methods, "signature"), "class_fqn", "name").toDF("dst", "method_name", "code")
    by_interface = _first(facts.operations, "interface_fqn", "method_name").toDF("dst", "method_name", "code")
    itself = facts.operations.select(F.col("code").alias("dst"), "code").distinct()
    codes = of("Method").join(by_method, "dst").select("src", "code")
    for label, known, on in (("Class", by_class, ["dst", "method_name"]), ("Interface", by_interface, ["dst", "method_name"]), ("ServiceOperation", itself, ["dst"])):
        codes = codes.unionByName(of(label).join(known, on).select("src", "code"))
    kinds = facts.operations.groupBy("code").agg(F.min("node_kind").alias("node_kind"))
    logical = codes.join(kinds, "code", "left").select(F.col("src").alias("node"), F.col("code").alias("target"), F.when(is_component("node_kind"), "COMPONENT").otherwise("SERVICE").alias("kind"))
    return table.unionByName(logical).distinct()


def direct_targets(facts: Facts, starts: DataFrame, most: int = DEPTH) -> DataFrame:
    """(seed, target, kind) within `most` calls of the methods starts(seed, node). A target `most`
    edges away is found, one further isn't; methods that stand for an operation are gone through."""
    inner = facts.calls.where(F.col("etype").isin("CALLS", "SELF_CALLS", "SYS_UTIL_CALLS") & (F.col("label") == "Method") & _given("dst"))
    near = reach(inner, starts.where(_given("node")), most - 1)
    return near.join(resolved(facts), "node").select("seed", "target", "kind").distinct()


def data_targets(facts: Facts, starts: DataFrame, most: int = DEPTH) -> DataFrame:
    """(seed, target) of the tables behind up to `most` calls that aren't utility calls."""
    return dao_tables(facts.calls.where(_given("dst") & F.col("label").isin("Method", "DaoMethod")), starts.where(_given("node")), most)


def _keyed(steps: DataFrame) -> DataFrame:
    """steps with key instead of code: ids of method steps repeat between transactions, so such a
    node is its id together with its methods."""
    sigs = F.array_join(F.array_sort(F.collect_set("signature")), ",")
    methods = steps.where("prefix = 'method'").groupBy("tx", "code").agg(F.concat_ws("#", "code", sigs).alias("key"))
    return steps.join(methods, ["tx", "code"], "left").withColumn("code", F.coalesce("key", "code")).drop("key")


def layers_of(facts: Facts, steps: DataFrame) -> Layers:
    """The layers of all transactions from steps(tx, tx_name, domain_key, code, prefix, signature): a
    row a step and method, signature null where there is none. Steps with a component prefix are
    components, all others root services. A code leads to the targets of all its methods, those
    that implement the operation and those that steps resolve to; components lead to components
    and tables only."""
    steps = keep(_keyed(steps), "steps")
    sigs = steps.select("code", "signature").union(facts.implements.select("code", "signature")).where(_given("signature")).distinct()
    sigs = keep(sigs, "signatures")
    starts = sigs.select(F.col("signature").alias("seed"), F.col("signature").alias("node")).distinct()
    direct = keep(direct_targets(facts, starts).unionByName(data_targets(facts, starts).select("seed", "target", F.lit("TABLE").alias("kind"))).distinct(), "targets")
    links = sigs.join(direct, F.col("signature") == F.col("seed")).select(F.col("code").alias("src"), F.col("target").alias("dst"), "kind").distinct()
    kinds = steps.select("code", F.col("prefix").alias("node_kind")).union(facts.operations.select("code", "node_kind")).groupBy("code").agg(F.max(is_component("node_kind")).alias("comp"))
    links = keep(links.join(kinds.withColumnRenamed("code", "src"), "src"), "links")
    pick = lambda comp, kind: links.where((F.col("comp") == comp) & (F.col("kind") == kind)).select("src", "dst")
    own = steps.withColumn("comp", is_component("prefix"))
    return Layers(
        own.where("not comp").select("tx", "tx_name", "domain_key", F.col("code").alias("svc")).distinct(),
        pick(False, "SERVICE"), pick(False, "COMPONENT"), pick(True, "COMPONENT"), pick(True, "TABLE"), pick(False, "TABLE"),
        own.where("comp").select("tx", "tx_name", "domain_key", F.col("code").alias("comp")).distinct(),
    )
