"""What a code graph gets after its scan: interfaces that only metadata knows, edges whose ends have come
to exist, service operations behind look-ups, and the counts of its nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interfaces(declared: DataFrame, *metadata: DataFrame) -> DataFrame:
    """(fqn, simple_name, declared): the declared interfaces(fqn, simple_name), and those that service
    types or operations(interface_fqn) name; blank names are none."""
    named = [m.select(F.trim("interface_fqn").alias("fqn")) for m in metadata]
    known = declared.select("fqn", "simple_name").groupBy("fqn").agg(F.min("simple_name").alias("simple_name"))
    more = named[0]
    for m in named[1:]:
        more = more.union(m)
    more = more.where("fqn <> ''").distinct().join(known, "fqn", "left_anti")
    return known.withColumn("declared", F.lit(True)).unionByName(more.select("fqn", F.substring_index("fqn", ".", -1).alias("simple_name"), F.lit(False).alias("declared")))


def implements(edges: DataFrame, classes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(src, dst) of the edges(src, dst) whose class and interface exist, each once."""
    a, b = classes.select(F.col("fqn").alias("src")).distinct(), interfaces.select(F.col("fqn").alias("dst")).distinct()
    return edges.select("src", "dst").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def operations(calls: DataFrame, methods: DataFrame, services: DataFrame, operations: DataFrame) -> DataFrame:
    """(caller, operation, method_name, line_no): look-ups (etype SYS_UTIL_CALLS of calls) of a service
    type's interface lead to its operation of that method's name; services(service_id, interface_fqn),
    operations(service_id, operation, method_name). A caller and an operation have one edge, that of the
    first line."""
    found = calls.where("etype = 'SYS_UTIL_CALLS'").join(methods.select(F.col("signature").alias("caller")).distinct(), "caller", "left_semi")
    offered = services.select("service_id", F.col("interface_fqn").alias("target")).join(operations.select("service_id", "operation", "method_name"), "service_id")
    both = found.select("caller", "target", "method_name", "line_no").join(offered, ["target", "method_name"])
    return both.groupBy("caller", "operation").agg(F.min(F.struct("line_no", "method_name")).alias("x")).select("caller", "operation", "x.method_name", "x.line_no")


# The names of the counts, by label of nodes and type of edges.
NODES = {
    "classCount": "Class", "interfaceCount": "Interface", "methodCount": "Method", "tableNodeCount": "Table", "daoNodeCount": "DaoMethod",
    "transactionCount": "Transaction", "flowMethodStepCount": "FlowMethodStep", "flowServiceStepCount": "FlowServiceStep", "serviceTypeCount": "ServiceType", "serviceOperationCount": "ServiceOperation",
}
EDGES = {"callsEdgeCount": "CALLS", "sysUtilEdgeCount": "SYS_UTIL_CALLS", "daoEdgeCount": "DAO_CALLS", "tableDaoEdgeCount": "EXPOSES_DAO", "selfCallEdgeCount": "SELF_CALLS", "implementsCount": "IMPLEMENTS"}


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): the sixteen counts of a graph, zeros too; nodes(label, id) count once each, edges(etype) all."""
    found = nodes.select("label", "id").distinct().groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("etype").alias("kind")).agg(F.count("*").alias("n")))
    names = nodes.sparkSession.createDataFrame(list((NODES | EDGES).items()), "name string, kind string")  # sixteen rows
    return F.broadcast(names).join(found, "kind", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
