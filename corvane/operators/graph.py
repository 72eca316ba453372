"""Reachability over edge tables: level-synchronous frontiers, closures and bounded paths. Every
level is written to the shared folder, so plans stay short and lost executors cost one level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, keep, keep_counted
from .skew import apart


LEVELS, MERGE = 3, 4


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None, tag: str = "seed") -> DataFrame:
    """(tag, node, depth): what each seed of seeds(tag, node) reaches over edges(src, dst), itself
    at depth 0, with the least number of steps; at most `most` steps, or to the fixpoint. Only
    what the last level found new goes on; a table holds LEVELS levels, and every MERGE tables the
    known ones become one, so that reads grow with the levels and not with their square."""
    steps, n_steps = keep_counted(edges.select(F.col("src").alias("node"), "dst").distinct(), "edges")
    known, n_known = keep_counted(seeds.select(tag, "node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = known
    depth, parts = 0, [known]
    while (most is None or depth < most) and not frontier.isEmpty():
        here, found = frontier.select(tag, "node"), None
        for depth in range(depth + 1, min(depth + LEVELS, most or depth + LEVELS) + 1):
            here = here.join(apart(steps, n_steps), "node").select(tag, F.col("dst").alias("node")).distinct()
            level = here.withColumn("depth", F.lit(depth))
            found = level if found is None else found.unionByName(level)
        first = found.groupBy(tag, "node").agg(F.min("depth").alias("depth"))
        new, n_new = keep_counted(first.join(apart(known.select(tag, "node"), n_known), [tag, "node"], "left_anti"), "reach")
        n_known += n_new
        parts.append(new)
        known = known.unionByName(new)
        if len(parts) == MERGE:
            known = keep(known, "reached")
            discard(*parts)
            parts = [known]
            new = known
        frontier = new.where(F.col("depth") == depth)
    discard(steps)
    return known


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """edges(*by, a, b) -> (*by, v, label): the smallest id connected to every v with an edge, inside
    each combination of by. Labels hook to the smallest label that an edge leads to, and pointers
    are jumped, so that depths halve each round."""
    cols = [F.col(c) for c in by]
    both = keep(edges.select(*cols, F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(*cols, "b", "a")).distinct(), "both", small=True)
    labels, n = keep_counted(both.groupBy(*by, "v").agg(F.min("w").alias("w")).select(*by, "v", F.least("v", "w").alias("label")), "labels", small=True)
    while True:
        near, far = labels.withColumnRenamed("label", "near"), labels.select(*by, F.col("v").alias("w"), F.col("label").alias("far"))
        cross = keep(both.where("v < w").join(apart(near, n), [*by, "v"]).join(apart(far, n), [*by, "w"]).where("near <> far").select(*by, "near", "far").distinct(), "cross", small=True)
        if cross.isEmpty():
            discard(both, cross)
            return labels
        # what is left is a graph of labels; its smallest label, the component's smallest id, stays
        hooks = cross.union(cross.select(*by, "far", "near")).groupBy(*by, F.col("near").alias("label")).agg(F.min("far").alias("low"))
        hooked = labels.join(apart(hooks, n), [*by, "label"], "left").select(*by, "v", F.least("label", "low").alias("label"))
        jumped = hooked.join(apart(hooked.select(*by, F.col("v").alias("label"), F.col("label").alias("up")), n), [*by, "label"])
        before, labels = labels, keep(jumped.select(*by, "v", F.least("label", "up").alias("label")), "labels", small=True)
        discard(before, cross)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def paths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """All paths of 1 to `most` edges from starts(node), each edge used once at most; nodes may
    repeat. edges(eid, src, dst). Columns: start, length, nodes (comma-joined)."""
    step = edges.select("eid", F.col("src").alias("at"), "dst")
    here = starts.select(F.col("node").cast("string").alias("start"), F.col("node").alias("at"), F.array().cast("array<string>").alias("used"), F.array(F.col("node").cast("string")).alias("nodes"))
    out = None
    for length in range(1, most + 1):
        here = here.join(step, "at").where(~F.array_contains("used", F.col("eid").cast("string")))
        here = here.select("start", F.col("dst").alias("at"), F.array_append("used", F.col("eid").cast("string")).alias("used"), F.array_append("nodes", F.col("dst").cast("string")).alias("nodes"))
        here = keep(here, "paths")
        one = here.select("start", F.lit(length).alias("length"), F.array_join("nodes", ",").alias("nodes"))
        out = one if out is None else out.unionByName(one)
        if here.isEmpty():
            break
    return out


def dao_tables(calls: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """(seed, target) over up to `most` CALLS or SELF_CALLS and then a DAO_CALLS; SYS_UTIL_CALLS
    are not followed."""
    near = reach(calls.where("etype IN ('CALLS', 'SELF_CALLS')"), starts, most)
    dao = calls.where("etype = 'DAO_CALLS'").select(F.col("src").alias("node"), "dst")
    return near.join(dao, "node").select("seed", F.col("dst").alias("target")).distinct()


def weighted_dao_calls(calls: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """DAO calls of each seed counted over paths of up to `most` CALLS that use no edge twice. Where
    a seed meets no cycle of calls, a number of paths goes along instead of the paths; paths that
    start before a cycle are followed one by one."""
    inner = calls.where("etype = 'CALLS'").select(F.row_number().over(Window.partitionBy("src").orderBy("dst", "line_no")).alias("k"), "src", "dst")
    inner = keep(inner.select(F.concat_ws("#", "src", F.col("k").cast("string")).alias("eid"), "src", "dst"), "calls")
    dao = calls.where("etype = 'DAO_CALLS'").groupBy(F.col("src").alias("node"), F.col("dst").alias("target")).agg(F.count("*").alias("k"))
    # a node is on a cycle that counts if one of its callees leads back to it
    callees = inner.select(F.col("src").alias("seed"), F.col("dst").alias("node")).distinct()
    cyclic = reach(inner, callees, most - 1).where("seed = node").select("node").distinct()
    near = reach(inner, starts, most)
    winding = keep(near.join(cyclic, "node", "left_semi").select("seed").distinct(), "winding")
    step = inner.groupBy(F.col("src").alias("node"), "dst").agg(F.count("*").alias("k"))
    here = starts.join(winding, "seed", "left_anti").select("seed", "node").distinct().withColumn("n", F.lit(1).cast("long"))
    parts = here
    for _ in range(most):
        here = keep(here.join(step, "node").groupBy("seed", F.col("dst").alias("node")).agg(F.sum(F.col("n") * F.col("k")).alias("n")), "weights")
        parts = parts.unionByName(here)
        if here.isEmpty():
            break
    followed = starts.join(winding, "seed", "left_semi").select("seed", "node").distinct()
    if not followed.isEmpty():
        ends = paths(inner, followed.select("node").distinct(), most).select("start", F.element_at(F.split("nodes", ","), -1).alias("end"))
        per = ends.groupBy("start", "end").agg(F.count("*").alias("n")).unionByName(followed.select(F.col("node").alias("start"), F.col("node").alias("end"), F.lit(1).cast("long").alias("n")).distinct())
        parts = parts.unionByName(followed.join(per, F.col("node") == F.col("start")).select("seed", F.col("end").alias("node"), "n"))
    return parts.join(dao, "node").groupBy("seed", "target").agg(F.sum(F.col("n") * F.col("k")).alias("call_count"))


def implementers(implements: DataFrame, extends: DataFrame, most: int = 6) -> DataFrame:
    """(iface, cls): direct implementers and those that inherit from one over up to `most` steps."""
    down = extends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = implements.select(F.col("dst").alias("iface"), F.col("src").alias("node"))
    return reach(down, seeds, most, "iface").select("iface", F.col("node").alias("cls")).distinct()


def neighbourhood(edges: DataFrame, root: Column | str, hops: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within 1..3 hops in either direction, at most cap nodes, nearest first and
    then by name; edges without both ends go. truncated tells that the cap has cut."""
    seeds = edges.sparkSession.range(1).select(F.lit(root).alias("node")).withColumn("seed", F.col("node"))
    near = reach(both_ways(edges), seeds, min(max(1, hops), 3))
    found = near.agg(F.count("*").alias("n_found"))
    kept = near.orderBy("depth", "node").limit(cap).select("node", "depth")
    nodes = kept.join(F.broadcast(found)).select("node", "depth", (F.col("n_found") > cap).alias("truncated"))  # one row
    a, b = kept.select(F.col("node").alias("src")), kept.select(F.col("node").alias("dst"))
    return nodes, edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("etype").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge of each kind and pair of ends; appending keeps one edge a call line instead."""
    return edges.groupBy("etype", "src", "dst").agg(F.min("line_no").alias("line_no"))
