"""Impact of a table, component or service on transactions, for all roots in one job.

A transaction's model holds the services that its root services reach and the components that
those services, or the transaction's own component steps, reach. Components are followed in both
directions, but only inside one model and never from one model into another; services are followed
to their callers, which all lie in the model. Nothing is computed twice for equal inputs:
transactions with the same steps share their roots, roots that reach the same services share what
they reach, transactions that reach the same nodes share a model, connected groups of components with the same members share labels, and tables with the same users
share their rows."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, keep, keep_counted
from .graph import components, reach
from .skew import apart, dealt, hot_slots


@dataclass
class Layers:
    """steps(tx, tx_name, domain_key, svc), comp_steps(tx, tx_name, domain_key, comp) or None, and
    relations (src, dst)."""

    steps: DataFrame
    svc_svc: DataFrame
    svc_comp: DataFrame
    comp_comp: DataFrame
    comp_table: DataFrame
    svc_table: DataFrame
    comp_steps: DataFrame | None = None

    @cached_property
    def below(self) -> DataFrame:
        """(root, svc) of all root services, whatever the transaction."""
        return reach(self.svc_svc, _selves(self.steps, "svc")).select(F.col("seed").alias("root"), F.col("node").alias("svc"))


@dataclass
class Models:
    """alike(tx, r), same(r, m), down(root, svc), heads(root, d), below(d, svc), tops(m, d), seeds(m,
    kind, code), services(m, svc), comps(m, comp, label): r stands for transactions with the same
    steps, d for roots that reach the same services, m for transactions with the same nodes; label is
    the smallest of the components connected with comp inside the model."""

    alike: DataFrame
    same: DataFrame
    down: DataFrame
    heads: DataFrame
    below: DataFrame
    tops: DataFrame
    seeds: DataFrame
    services: DataFrame
    comps: DataFrame | None = None

    @property
    def of_tx(self) -> DataFrame:
        """(tx, m)"""
        return self.alike.join(_unique(self.same), "r").select("tx", "m")

    def widest(self) -> Models:
        """Without models that a larger one holds: what is connected or reached inside a model is so
        inside every model that holds it. A model is compared with one other, the largest that has
        its rarest seed; one that stays beside a larger one costs time and changes nothing."""
        nodes = self.services.select("m", F.lit("S").alias("kind"), F.col("svc").alias("code")).union(self.comps.select("m", F.lit("C"), "comp"))
        size = nodes.groupBy("m").agg(F.count("*").alias("n"))
        at = nodes.join(apart(size), "m").groupBy("kind", "code").agg(F.count("*").alias("held"), F.max(F.struct("n", "m")).alias("big"))
        rarest = self.seeds.join(apart(at), ["kind", "code"]).groupBy("m").agg(F.count("*").alias("n_seeds"), F.min(F.struct("held", "kind", "code", "big"))["big"].alias("big"))
        other = rarest.join(apart(size), "m").where("big.n > n").select("m", "n_seeds", F.col("big.m").alias("other"))
        shared = other.join(apart(self.seeds), "m").join(apart(nodes.withColumnRenamed("m", "other")), ["other", "kind", "code"])
        inside = shared.groupBy("m", "n_seeds").agg(F.count("*").alias("n")).where("n = n_seeds")
        left = keep(size.select("m").join(apart(inside), "m", "left_anti"), "widest")
        of = lambda df, name: keep(df.join(apart(left), "m", "left_semi"), name)
        return replace(self, services=of(self.services, "widest-services"), comps=of(self.comps, "widest-components"))


def _alike(df: DataFrame, key: str, *cols: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, *by, first): the smallest key with the same set of cols, among equal values of by; sets
    are told apart by their size and 128 bits of hashes."""
    h = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), *cols))
    marks = df.select(key, *by, *cols).distinct().groupBy(key, *by).agg(F.count("*").alias("n"), h("a").alias("h1"), h("b").alias("h2"))
    same = marks.groupBy(*by, "n", "h1", "h2").agg(F.min(key).alias("first"))
    return marks.join(_unique(same), [*by, "n", "h1", "h2"]).select(key, *by, "first")


def _unique(df: DataFrame) -> DataFrame:
    """df, with one row a key, for a join with many more rows: each task holds its share of the keys,
    which no frequent key makes larger, and sorts nothing."""
    return df.hint("shuffle_hash")


def _selves(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("seed"), F.col(column).alias("node")).distinct()


def models(layers: Layers, with_comps: bool = True) -> Models:
    """with_comps: components too, which callers of services do without."""
    seeds = layers.steps.select("tx", F.lit("S").alias("kind"), F.col("svc").alias("code"))
    if layers.comp_steps is not None:
        seeds = seeds.union(layers.comp_steps.select("tx", F.lit("C"), "comp"))
    # dealt by their transaction once: repeats go there, and marks are made there
    alike = keep(_alike(seeds.repartition("tx").distinct(), "tx", "kind", "code").withColumnRenamed("first", "r"), "models")
    own = keep(seeds.join(_unique(alike.where("tx = r")), "tx").select("r", "kind", "code").distinct(), "seeds")
    down = layers.below
    # roots stand for what they reach, but callers are asked for one by one
    heads = keep(_alike(down, "root", "svc").withColumnRenamed("first", "d"), "heads") if with_comps else down.select("root", F.col("root").alias("d")).distinct()
    below = down.join(apart(heads.where("root = d")), "root").select("d", "svc") if with_comps else down.withColumnRenamed("root", "d")
    tops = own.where("kind = 'S'").select("r", F.col("code").alias("root"))
    tops = keep(tops.join(apart(heads), "root").select("r", "d").distinct(), "tops") if with_comps else tops.withColumnRenamed("root", "d")
    reached = keep(tops.join(apart(below), "d").select("r", "svc").distinct(), "reached-services")
    nodes = reached.select("r", F.lit("S").alias("kind"), F.col("svc").alias("code")).union(own.where("kind = 'C'"))
    same = keep(_alike(nodes, "r", "kind", "code").withColumnRenamed("first", "m"), "same-nodes")
    first = same.where("r = m")
    services = keep(reached.join(apart(first), "r").select("m", "svc"), "services")
    discard(reached)
    found = Models(alike, same, down, heads, below, tops.join(apart(same), "r").select("m", "d").distinct(), own.join(apart(first), "r").select("m", "kind", "code"), services)
    return replace(found, comps=_comps(layers, found)) if with_comps else found


def _comps(layers: Layers, m: Models) -> DataFrame:
    """(m, comp, label). What a model has of a connected group of components is labelled once for all
    models that have the same of it."""
    links = layers.comp_comp.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    first = m.services.join(apart(layers.svc_comp.select(F.col("src").alias("svc"), F.col("dst").alias("comp"))), "svc").select("m", "comp")
    first = keep(first.union(m.seeds.where("kind = 'C'").select("m", "code")).distinct(), "first-components")
    below = reach(layers.comp_comp, _selves(first, "comp")).select(F.col("seed").alias("comp"), F.col("node").alias("below"))
    comps = first.join(apart(below), "comp").select("m", F.col("below").alias("comp")).distinct()
    whole = components(links).select(F.col("v").alias("comp"), F.col("label").alias("whole"))
    comps = keep(comps.join(apart(whole), "comp", "left").select("m", "comp", F.coalesce("whole", "comp").alias("whole")), "components")
    parts = keep(_alike(comps, "m", "comp", by=("whole",)), "parts")
    shown = comps.join(apart(parts.where("m = first")), ["m", "whole"]).select("m", F.col("comp").alias("a"))
    labels = components(links.join(apart(shown), "a"), ("m",)).select(F.col("m").alias("first"), F.col("v").alias("comp"), "label")
    labelled = keep(comps.join(apart(parts), ["m", "whole"]).join(apart(labels), ["first", "comp"], "left").select("m", "comp", F.coalesce("label", "comp").alias("label")), "labelled")
    discard(first, comps, parts)
    return labelled


def _nodes(m: Models, layers: Layers) -> DataFrame:
    """(m, kind, code): the nodes of each model; a table is there once for each node that uses it."""
    service, comp = m.services.select("m", F.col("svc").alias("code")), m.comps.select("m", F.col("comp").alias("code"))
    used = service.join(apart(layers.svc_table), F.col("code") == F.col("src")).select("m", "dst").union(comp.join(apart(layers.comp_table), F.col("code") == F.col("src")).select("m", "dst"))
    kinds = (("SERVICE", service), ("COMPONENT", comp), ("TABLE", used.withColumnRenamed("dst", "code")))
    return reduce(DataFrame.unionByName, [df.select("m", F.lit(kind).alias("kind"), "code") for kind, df in kinds])


def model(layers: Layers) -> DataFrame:
    """(tx, kind, code): the nodes of each transaction's model, its tables too. Nodes are dealt by their
    model once: repeats go there, and transactions meet them there."""
    m = models(layers)
    return m.of_tx.join(_nodes(m, layers).repartition("m").distinct(), "m").select("tx", "kind", "code")


def layer_counts(layers: Layers) -> DataFrame:
    """One document a transaction: how many nodes its layers have, and the nodes, comma-joined in
    order. Documents are made once a model and then go to all of its transactions."""
    m = models(layers)
    codes = _nodes(m, layers).groupBy("m", "kind").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max(F.col("code").isNull().cast("int")).alias("blank"))
    texts = codes.select("m", "kind", (F.size("codes") + F.col("blank")).cast("long").alias("n"), F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    cols = [x for kind, name in (("SERVICE", "services"), ("COMPONENT", "components"), ("TABLE", "tables")) for x in (F.coalesce(of(kind, "n"), F.lit(0)).alias(f"n_{name}"), F.coalesce(of(kind, "codes"), F.lit("")).alias(name))]
    return m.of_tx.join(texts.groupBy("m").agg(*cols), "m").drop("m")


def component_closure(layers: Layers) -> DataFrame:
    """(tx, comp, label): components with one label are connected, over calls in either direction,
    inside the transaction's model."""
    m = models(layers)
    return m.of_tx.join(apart(m.comps), "m").select("tx", "comp", "label")


def caller_closure(layers: Layers, matched: DataFrame) -> DataFrame:
    """(tx, svc, caller): services of matched(svc) in a transaction's model, and the model's services
    that call them, directly or not, themselves included. A model holds all that its services call, so
    callers are followed from the matched services, without the model."""
    m = models(layers, with_comps=False)
    pairs = _callers(layers, m, matched.select("svc").join(apart(m.services), "svc", "left_semi"))
    return m.of_tx.join(m.services.withColumnRenamed("svc", "caller").join(apart(pairs), "caller"), "m").select("tx", "svc", "caller")


def _alive(layers: Layers, m: Models) -> DataFrame:
    """(src, dst): calls of services that some model has; it has their targets too."""
    return layers.svc_svc.join(apart(m.services.select(F.col("svc").alias("src"))), "src", "left_semi")


def _callers(layers: Layers, m: Models, services: DataFrame) -> DataFrame:
    """(svc, caller): services and those of models that call them, directly or not. What roots reach
    is known, so only the models' other services are followed anew."""
    rest = _selves(m.services, "svc").join(apart(m.down.select(F.col("root").alias("seed")).distinct()), "seed", "left_anti")
    below = m.down.withColumnRenamed("root", "caller").unionByName(reach(layers.svc_svc, rest).select(F.col("seed").alias("caller"), F.col("node").alias("svc")))
    return below.join(apart(services.select("svc").distinct()), "svc", "left_semi").select("svc", "caller")


def transactions_of(hits: DataFrame, named: DataFrame, root: str, on: list[str], item: str) -> DataFrame:
    """Transactions of the roots of hits(root, *on), one a name: the smallest id represents a name,
    with its domain; items are counted over all transactions of the name. named(*on, tx_name, first)."""
    one = _named(hits, named, root, on, item).groupBy(root, "tx_name").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return one.select(root, F.col("first.tx").alias("tx"), "tx_name", F.col("first.domain_key").alias("domain_key"), "n")


def _named(hits: DataFrame, named: DataFrame, root: str, on: list[str], item: str) -> DataFrame:
    return hits.join(apart(named), on).groupBy(root, "tx_name", item).agg(F.min("first").alias("first"))


def _first() -> Column:
    return F.min(F.struct("tx", "domain_key")).alias("first")


class Tables:
    """What the models hold of each class of tables: tables with the same users are one class, named
    by its smallest table."""

    def __init__(self, layers: Layers):
        self.layers, self.models = layers, models(layers)
        users = layers.comp_table.select(F.col("dst").alias("tab"), F.lit("C").alias("kind"), F.col("src").alias("user"))
        users = users.union(layers.svc_table.select("dst", F.lit("S"), "src")).distinct()
        self.classes = keep(_alike(users, "tab", "kind", "user").withColumnRenamed("first", "c"), "table-classes")
        own = keep(users.join(apart(self.classes.where("tab = c")), "tab").select("c", "kind", "user"), "users")
        self.comps = own.where("kind = 'C'").select("c", F.col("user").alias("comp"))
        self.svcs = own.where("kind = 'S'").select("c", F.col("user").alias("svc"))
        m = self.models
        #: (c, m, label): groups of connected components that use the tables
        self.groups = keep(m.comps.join(apart(self.comps), "comp").select("c", "m", "label").distinct(), "groups")
        #: (m, svc, label): services of a model and the groups that they call
        called = m.services.join(apart(layers.svc_comp.select(F.col("src").alias("svc"), F.col("dst").alias("comp"))), "svc")
        self.called = keep(called.join(apart(m.comps), ["m", "comp"]).select("m", "svc", "label").distinct(), "called")

    def spread(self, df: DataFrame) -> DataFrame:
        """A row for each table of the class of every row."""
        return self.classes.join(apart(df), "c").drop("c")

    def spread_edges(self, edges: DataFrame) -> DataFrame:
        """The same of edges(c, src, dst, phase), each once a table. Edges are dealt once, by class; those
        of a class with very many users are dealt to more tasks, by src."""
        users = self.comps.select("c").union(self.svcs.select("c")).groupBy("c").agg(F.count("*").alias("n"))
        slots = keep(hot_slots(users, ["c"], "n"), "hot-classes")
        once = dealt(edges, ["c"], slots, "src").repartition("c", "salt").distinct()
        return dealt(self.classes, ["c"], slots, None).hint("shuffle_hash").join(once, ["c", "salt"]).drop("c", "salt")

    def hits(self) -> DataFrame:
        """(c, m, d): root services, by what they reach, from which in a model a service is reached that
        uses the tables, or calls a component connected to one that does. Hits are dealt once, by
        what names them."""
        m = self.models
        below = m.tops.join(apart(m.below), "d").select("m", "d", "svc")
        over = below.join(apart(self.called), ["m", "svc"]).select("m", "d", "label").distinct()
        both = over.join(apart(self.groups), ["m", "label"]).select("c", "m", "d").union(below.join(apart(self.svcs), "svc").select("c", "m", "d"))
        return both.repartition("m", "d").distinct()

    def _firsts(self, steps: DataFrame, *cols: str) -> DataFrame:
        """(m, d, root, *cols, tx): the first transaction of steps(tx, svc, *cols) for each root and cols."""
        least = steps.join(_unique(self.models.alike), "tx").groupBy("r", F.col("svc").alias("root"), *cols).agg(F.min("tx").alias("tx"))
        known = least.join(_unique(self.models.same), "r").join(_unique(self.models.heads), "root")
        return known.groupBy("m", "d", "root", *cols).agg(F.min("tx").alias("tx"))

    def names(self) -> DataFrame:
        return self._firsts(self.layers.steps, "tx_name", "domain_key").groupBy("m", "d", "root", "tx_name").agg(_first())

    def impact(self) -> DataFrame:
        """(c, tx, tx_name, domain_key, n): transactions_of the hits. Names with their domains are numbered
        (k, and `name` for the name alone), so that sums over hits are made of numbers only. A root
        that has a name in one model and domain is counted before its tables are known; another one
        can meet a table more than once and is counted once there."""
        steps, same = self.layers.steps, lambda a, b: F.col(a).eqNullSafe(F.col(b))
        ids, n_ids = keep_counted(steps.select(F.col("tx_name").alias("of"), F.col("domain_key").alias("domain")).distinct().withColumn("k", F.monotonically_increasing_id()), "domains")
        ids = apart(ids.join(apart(ids.groupBy(F.col("of").alias("other")).agg(F.min("k").alias("name")), n_ids), same("of", "other")).select("of", "domain", "k", "name"), n_ids)
        named = keep(self._firsts(steps.join(ids, same("tx_name", "of") & same("domain_key", "domain")).select("tx", "svc", "k", "name"), "k", "name"), "names")
        shared = apart(*keep_counted(named.groupBy("root", "name").agg(F.count("*").alias("n")).where("n > 1").select("root", "name"), "shared-names"))
        alone = named.join(shared, ["root", "name"], "left_anti").groupBy("m", "d", "k").agg(F.min("tx").alias("tx"), F.count("*").alias("n"))
        hits = keep(self.hits(), "hits")
        sums = hits.join(apart(alone), ["m", "d"]).groupBy("c", "k").agg(F.min("tx").alias("tx"), F.sum("n").alias("n"))
        first = F.struct("tx", F.col("domain").alias("domain_key")).alias("first")
        sums = sums.join(ids, "k").select("c", "of", first, "n")
        again = hits.join(apart(named.join(shared, ["root", "name"], "left_semi")), ["m", "d"]).join(ids.select("k", "of", "domain"), "k")
        again = again.select("c", "of", "root", first).groupBy("c", "of", "root").agg(F.min("first").alias("first"))
        one = sums.unionByName(again.select("c", "of", "first", F.lit(1).cast("long").alias("n"))).groupBy("c", "of").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        return one.select("c", F.col("first.tx").alias("tx"), F.col("of").alias("tx_name"), F.col("first.domain_key").alias("domain_key"), "n")

    def shown(self) -> DataFrame:
        """(c, root, tx): root services and the transactions that represent their names; rows can repeat."""
        named = self.hits().join(apart(self.names()), ["m", "d"])
        return named.select("c", "root", F.min("first.tx").over(Window.partitionBy("c", "tx_name")).alias("tx"))

    def widest(self) -> Tables:
        """The same of the models that no larger one holds, for what no transaction is asked of."""
        t = copy(self)
        t.models = self.models.widest()
        left = t.models.services.select("m").distinct()
        t.groups, t.called = (df.join(apart(left), "m", "left_semi") for df in (self.groups, self.called))
        return t

    def services(self) -> tuple[DataFrame, DataFrame]:
        """(m, label, svc) and (c, svc): services of a model from which a group of its components is
        reached, and those of any model from which services are that use the tables themselves."""
        m = self.models
        up = _callers(self.layers, m, m.services)
        over = self.called.join(apart(up), "svc").select("m", "label", F.col("caller").alias("svc")).distinct().join(apart(m.services), ["m", "svc"], "left_semi")
        return keep(over, "group-services"), keep(self.svcs.join(apart(up), "svc").select("c", F.col("caller").alias("svc")).distinct(), "table-services")


def table_impact(layers: Layers) -> DataFrame:
    """(tab, tx, tx_name, domain_key, n_services): transactions whose root services a table touches."""
    t = Tables(layers)
    return t.spread(t.impact()).withColumnRenamed("n", "n_services")


def _component_hits(layers: Layers) -> DataFrame:
    calls = layers.svc_comp.select(F.col("src").alias("svc"), F.col("dst").alias("comp"))
    return layers.below.join(apart(calls), "svc").select("comp", "root").distinct()


def component_impact(layers: Layers) -> DataFrame:
    """Services that call the component directly, without its closure, and their callers."""
    named = layers.steps.groupBy(F.col("svc").alias("root"), "tx_name").agg(_first())
    return transactions_of(_component_hits(layers), named, "comp", ["root"], "root").withColumnRenamed("n", "n_services")


def orchestration_refs(service_steps: DataFrame, method_steps: DataFrame, implements: DataFrame, transactions: DataFrame, domains: DataFrame) -> DataFrame:
    """(svc, orch, step_type, tx, tx_name, domain_key): flow steps that lead to a service directly, by
    calling its operation or by resolving to a method that implements it.

    service_steps(step_key, tx, svc), method_steps(step_key, tx, signature), implements(svc,
    signature), transactions(tx, tx_name, domain_key), domains(svc, svc_domain). A service step has
    the operation's domain before the transaction's, a method step the other way round."""
    by_method = method_steps.join(implements, "signature").select("step_key", "tx", "svc", F.lit("method").alias("step_type"))
    steps = service_steps.select("step_key", "tx", "svc", F.lit("service").alias("step_type")).unionByName(by_method)
    known = steps.join(transactions, "tx").join(domains, "svc", "left")
    domain = F.when(F.col("step_type") == "service", F.coalesce("svc_domain", "domain_key")).otherwise(F.coalesce("domain_key", "svc_domain"))
    return known.select("svc", F.concat(F.lit("ORCH:"), "step_key").alias("orch"), "step_type", "tx", F.coalesce("tx_name", F.col("tx").cast("string")).alias("tx_name"), domain.alias("domain_key")).distinct()


def upstream(layers: Layers, callable_: DataFrame) -> DataFrame:
    """(root, svc): every service and the callable services that call it, directly or over other
    callable ones, where a transaction reaches them. callable_(svc)."""
    alive = layers.below.select("svc").distinct().join(callable_.select("svc").distinct(), "svc", "left_semi")
    back = layers.svc_svc.join(apart(alive.withColumnRenamed("svc", "src")), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes = layers.svc_svc.select("src").union(layers.svc_svc.select("dst")).union(layers.steps.select("svc")).toDF("svc")
    return reach(back, _selves(nodes, "svc")).select(F.col("seed").alias("root"), F.col("node").alias("svc"))


def service_orchestrations(layers: Layers, callable_: DataFrame, refs: DataFrame) -> DataFrame:
    """(root, orch, step_type, tx, tx_name, domain_key): the orchestration layer of each service."""
    return upstream(layers, callable_).join(apart(refs), "svc").drop("svc").distinct()


def service_impact(layers: Layers, callable_: DataFrame, refs: DataFrame) -> DataFrame:
    """(root, tx, tx_name, domain_key, n_orchestrations): the transactions that a service or its
    callers are orchestrated by."""
    named = refs.groupBy("svc", "orch", "tx_name").agg(_first())
    return transactions_of(upstream(layers, callable_), named, "root", ["svc"], "orch").withColumnRenamed("n", "n_orchestrations")


def table_edges(layers: Layers) -> DataFrame:
    """Edges of every table's graph, each once with the phase that first gave it: table to component
    (1), within components (2), table to service (3), component to service (4), within services
    (5), service to the transaction that represents its name (6). Cross edges point away from the
    table, inner ones from caller to callee."""
    t = Tables(layers)
    w, code = t.widest(), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    m = w.models

    def edge(df: DataFrame, src: Column | None, dst: Column, phase: int) -> DataFrame:
        return df.select("c", (F.lit(None).cast("string") if src is None else src).alias("src"), dst.alias("dst"), F.lit(phase).alias("phase"))

    links = layers.comp_comp.where("src <> dst").join(apart(m.comps.withColumnRenamed("comp", "src")), "src").select("m", "label", "src", "dst")
    calls = m.services.join(apart(layers.svc_comp.select(F.col("src").alias("svc"), F.col("dst").alias("comp"))), "svc").join(apart(m.comps), ["m", "comp"]).select("m", "label", "svc", "comp")
    of_groups, of_tables = (df.withColumnRenamed("svc", "dst") for df in w.services())
    above = _alive(layers, m).where("src <> dst").distinct()
    inner = of_groups.join(apart(above), "dst").join(apart(m.services.withColumnRenamed("svc", "src")), ["m", "src"], "left_semi")
    of_class = lambda df, *cols: w.groups.join(apart(df), ["m", "label"]).select("c", *cols)
    # an edge's ends tell its phase, so no two phases have one edge; edges repeat until they are spread
    parts = [
        edge(t.comps.join(apart(m.comps), "comp", "left_semi"), None, code("C", "comp"), 1),
        edge(of_class(links, "src", "dst"), code("C", "src"), code("C", "dst"), 2),
        edge(t.svcs.join(apart(m.services), "svc", "left_semi"), None, code("S", "svc"), 3),
        edge(of_class(calls, "comp", "svc"), code("C", "comp"), code("S", "svc"), 4),
        edge(of_class(inner, "src", "dst").union(of_tables.join(apart(above), "dst").select("c", "src", "dst")), code("S", "src"), code("S", "dst"), 5),
        edge(t.shown(), code("S", "root"), code("X", "tx"), 6),
    ]
    return t.spread_edges(reduce(DataFrame.unionByName, parts)).select("tab", F.coalesce("src", code("T", "tab")).alias("src"), "dst", "phase")


def export_summary(layers: Layers) -> DataFrame:
    """(tab, n_components, n_services, n_transactions): sizes of the layers of every table's graph, as
    table_edges has them. Nodes are counted by class of tables and without their edges: a service of
    the graph uses the tables, calls one of its components, or calls another of its services."""
    t = Tables(layers)
    w = t.widest()
    of_groups, of_tables = w.services()
    count = lambda df, name: df.groupBy("c").agg(F.count("*").alias(name))
    comps = count(w.groups.join(apart(w.models.comps), ["m", "label"]).select("c", "comp").distinct(), "n_components")
    services = count(w.groups.join(apart(of_groups), ["m", "label"]).select("c", "svc").union(of_tables).distinct(), "n_services")
    shown = t.impact().groupBy("c").agg(F.count_distinct("tx").alias("n_transactions"))
    names = ("n_components", "n_services", "n_transactions")
    sizes = comps.join(services, "c", "full").join(shown, "c", "full").select("c", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    return t.spread(sizes)


def all_roots(layers: Layers, callable_: DataFrame, refs: DataFrame) -> DataFrame:
    """(mode, root, n_transactions, n_domains) of every table, component and service with impact. Only
    names and their first transactions are asked for, so a name's roots, and its orchestrations, are
    not told apart."""
    t = Tables(layers)

    def count(hits: DataFrame, named: DataFrame, root: str, on: list[str]) -> DataFrame:
        one = hits.join(apart(named), on).groupBy(root, "tx_name").agg(F.min("first")["domain_key"].alias("domain_key"))
        return one.groupBy(root).agg(F.count("*").alias("n_transactions"), F.count_distinct("domain_key").alias("n_domains"))

    by_root, by_svc = (df.groupBy(*on, "tx_name").agg(_first()) for df, on in ((layers.steps.withColumnRenamed("svc", "root"), ["root"]), (refs, ["svc"])))
    tables, comps = count(t.hits(), t.names(), "c", ["m", "d"]), count(_component_hits(layers), by_root, "comp", ["root"])
    by_mode = (("table", "tab", t.spread(tables)), ("component", "comp", comps), ("service", "root", count(upstream(layers, callable_), by_svc, "root", ["svc"])))
    rows = [df.select(F.lit(mode).alias("mode"), F.col(root).alias("root"), "n_transactions", "n_domains") for mode, root, df in by_mode]
    return reduce(DataFrame.unionByName, rows)
