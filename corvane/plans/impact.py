"""Impact analysis over all transactions and all roots. The SQL follows each transaction's model by
itself, row by row; the operators share models and tables that are alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Plan
from ..fixtures import ctes, view
from ..operators import impact as I

PLAN = Plan()
BASE = ctes("tx_steps", "comp_steps", "svc_svc", "svc_comp", "comp_comp", "comp_table", "svc_table", "service_steps", "method_steps", "svc_methods", "svc_domains")
#: services ms(tx, svc) and components mc(tx, comp) of each model; {more}: component steps
MODEL = """, ms AS (SELECT DISTINCT tx, svc FROM tx_steps UNION SELECT m.tx, e.dst FROM ms m JOIN svc_svc e ON e.src = m.svc),
mc AS (SELECT ms.tx, s.dst AS comp FROM ms JOIN svc_comp s ON s.src = ms.svc {more} UNION SELECT mc.tx, e.dst FROM mc JOIN comp_comp e ON e.src = mc.comp)"""
PLAIN = BASE + MODEL.format(more="")
WITH_STEPS = BASE + MODEL.format(more="UNION SELECT tx, comp FROM comp_steps") + """, mt AS (SELECT tx, t.dst AS tab FROM ms JOIN svc_table t ON t.src = svc UNION SELECT tx, t.dst FROM mc JOIN comp_table t ON t.src = comp)"""
#: cc(tx, comp, other): connected inside the model; up(tx, svc, caller): callers inside the model
CC = """, cboth AS (SELECT src, dst FROM comp_comp UNION SELECT dst, src FROM comp_comp), cc AS (SELECT tx, comp, comp AS other FROM mc UNION SELECT c.tx, c.comp, e.dst FROM cc c JOIN cboth e ON e.src = c.other JOIN mc ON mc.tx = c.tx AND mc.comp = e.dst)"""
UP = """, up AS (SELECT tx, svc, svc AS caller FROM ms UNION SELECT u.tx, u.svc, e.src FROM up u JOIN svc_svc e ON e.dst = u.caller JOIN ms ON ms.tx = u.tx AND ms.svc = e.src)"""
NAMES = ", names AS (SELECT DISTINCT tx, tx_name, domain_key FROM tx_steps)"
#: cs(tx, comp, svc): services that call what is connected with comp; hit(tab, tx, root)
HIT = PLAIN + CC + UP + NAMES + """, cs AS (SELECT DISTINCT cc.tx, cc.comp, ms.svc FROM cc JOIN svc_comp s ON s.dst = cc.other JOIN ms ON ms.tx = cc.tx AND ms.svc = s.src),
rooted AS (SELECT DISTINCT up.tx, up.svc, up.caller AS root FROM up JOIN tx_steps st ON st.tx = up.tx AND st.svc = up.caller),
over AS (SELECT DISTINCT cs.tx, cs.comp, r.root FROM cs JOIN rooted r ON r.tx = cs.tx AND r.svc = cs.svc),
hit AS (SELECT t.dst AS tab, o.tx, o.root FROM comp_table t JOIN over o ON o.comp = t.src UNION SELECT t.dst, r.tx, r.root FROM svc_table t JOIN rooted r ON r.svc = t.src)"""
TX = "SELECT tab, min(h.tx) AS tx, tx_name, arg_min(domain_key, h.tx) AS domain_key, count(DISTINCT root) AS n_services FROM hit h JOIN names n ON n.tx = h.tx GROUP BY tab, tx_name"
#: services that each root reaches, whatever the transaction
DOWN = """, down AS (SELECT DISTINCT svc AS root, svc FROM tx_steps UNION SELECT d.root, e.dst FROM down d JOIN svc_svc e ON e.src = d.svc)"""
COMP_TX = "SELECT s.dst AS comp, min(tx) AS tx, tx_name, arg_min(domain_key, tx) AS domain_key, count(DISTINCT root) AS n_services FROM svc_comp s JOIN down ON down.svc = s.src JOIN tx_steps t ON t.svc = root GROUP BY 1, tx_name"
#: refs: direct references of steps; u(root, svc): callable callers that some transaction reaches
REFS = """, refs AS (
  SELECT DISTINCT s.svc, 'ORCH:' || step_key AS orch, 'service' AS step_type, t.tx, tx_name, coalesce(svc_domain, domain_key) AS domain_key FROM service_steps s JOIN tx_steps t ON t.tx = s.tx LEFT JOIN svc_domains d ON d.svc = s.svc
  UNION SELECT m.svc, 'ORCH:' || step_key, 'method', t.tx, tx_name, coalesce(domain_key, svc_domain) FROM method_steps s JOIN svc_methods m ON m.signature = s.signature JOIN tx_steps t ON t.tx = s.tx LEFT JOIN svc_domains d ON d.svc = m.svc)""" + DOWN + """,
alive AS (SELECT DISTINCT svc FROM down WHERE svc % 4 <> 0), u AS (SELECT v AS root, v AS svc FROM (SELECT src AS v FROM svc_svc UNION SELECT dst FROM svc_svc UNION SELECT svc FROM tx_steps) UNION SELECT u.root, e.src FROM u JOIN svc_svc e ON e.dst = u.svc WHERE e.src IN (SELECT svc FROM alive))"""
SVC_TX = "SELECT root, min(tx) AS tx, tx_name, arg_min_null(domain_key, (tx, coalesce(domain_key, ''))) AS domain_key, count(DISTINCT orch) AS n_orchestrations FROM u JOIN refs ON refs.svc = u.svc GROUP BY root, tx_name"


def layers(spark, sf_dir, component_steps=False):
    v = lambda name: view(spark, sf_dir, name)
    return I.Layers(v("tx_steps"), v("svc_svc"), v("svc_comp"), v("comp_comp"), v("comp_table"), v("svc_table"), v("comp_steps") if component_steps else None)


def callable_services(spark, sf_dir):
    """Every fourth service stands for a plain method."""
    return view(spark, sf_dir, "svc_svc").select(F.explode(F.array("src", "dst")).alias("svc")).union(view(spark, sf_dir, "tx_steps").select("svc")).distinct().where("svc % 4 <> 0")


def orchestrations(spark, sf_dir):
    v = lambda name: view(spark, sf_dir, name)
    return I.orchestration_refs(v("service_steps"), v("method_steps"), v("svc_methods"), v("tx_steps").select("tx", "tx_name", "domain_key").distinct(), v("svc_domains"))


@PLAN.query("op_gr08_models_of_layers", WITH_STEPS + " SELECT tx, 'SERVICE' AS kind, svc AS code FROM ms UNION ALL SELECT tx, 'COMPONENT', comp FROM mc UNION ALL SELECT tx, 'TABLE', tab FROM mt")
def gr08(spark, sf_dir):
    return I.model(layers(spark, sf_dir, True))


@PLAN.query("op_gr09_chain_documents", WITH_STEPS + """, n AS (SELECT tx, 'S' AS k, svc AS code FROM ms UNION ALL SELECT tx, 'C', comp FROM mc UNION ALL SELECT tx, 'T', tab FROM mt)
SELECT tx, count(*) FILTER (k = 'S') AS n_services, count(*) FILTER (k = 'C') AS n_components, count(*) FILTER (k = 'T') AS n_tables, """
            + ", ".join(f"coalesce(string_agg(code::VARCHAR, ',' ORDER BY code) FILTER (k = '{k}'), '') AS {n}" for k, n in (("S", "services"), ("C", "components"), ("T", "tables"))) + " FROM n GROUP BY tx")
def gr09(spark, sf_dir):
    return I.layer_counts(layers(spark, sf_dir, True))


@PLAN.query("op_gr11_component_closure", PLAIN + CC + " SELECT tx, comp, min(other) AS label FROM cc GROUP BY 1, 2")
def gr11(spark, sf_dir):
    return I.component_closure(layers(spark, sf_dir))


@PLAN.query("op_gr12_caller_closure", PLAIN + UP + " SELECT tx, svc, caller FROM up WHERE svc IN (SELECT src FROM svc_table WHERE dst % 2 = 0)")
def gr12(spark, sf_dir):
    x = layers(spark, sf_dir)
    return I.caller_closure(x, x.svc_table.where("dst % 2 = 0").select(F.col("src").alias("svc")))


@PLAN.query("op_gr13_callable_upstream", BASE + REFS + " SELECT root, svc FROM u")
def gr13(spark, sf_dir):
    return I.upstream(layers(spark, sf_dir), callable_services(spark, sf_dir))


@PLAN.query("op_gr14_table_impact", HIT + " " + TX)
def gr14(spark, sf_dir):
    return I.table_impact(layers(spark, sf_dir))


@PLAN.query("op_gr15_component_impact", BASE + DOWN + " " + COMP_TX)
def gr15(spark, sf_dir):
    return I.component_impact(layers(spark, sf_dir))


@PLAN.query("op_gr16_service_impact", BASE + REFS + " " + SVC_TX)
def gr16(spark, sf_dir):
    return I.service_impact(layers(spark, sf_dir), callable_services(spark, sf_dir), orchestrations(spark, sf_dir))


@PLAN.query("op_gr16_orchestrations", BASE + REFS + " SELECT DISTINCT root, orch, step_type, tx, tx_name, domain_key FROM u JOIN refs ON refs.svc = u.svc")
def gr16_orchestrations(spark, sf_dir):
    return I.service_orchestrations(layers(spark, sf_dir), callable_services(spark, sf_dir), orchestrations(spark, sf_dir))


@PLAN.query("op_gr17_named_transactions", BASE + " SELECT tx_name, min(tx) AS tx, arg_min(domain_key, tx) AS domain_key, count(DISTINCT svc) AS n_services FROM tx_steps GROUP BY 1")
def gr17(spark, sf_dir):
    steps = view(spark, sf_dir, "tx_steps")
    named = steps.groupBy("tx_name").agg(F.min(F.struct("tx", "domain_key")).alias("first"), F.count_distinct("svc").alias("n_services"))
    return named.select("tx_name", F.col("first.tx").alias("tx"), F.col("first.domain_key").alias("domain_key"), "n_services")


#: what holds for every table of a component, or of a service, over all models
EDGES = HIT + """, t AS (""" + TX + """), inner2 AS (SELECT DISTINCT cc.comp, e.src, e.dst FROM cc JOIN comp_comp e ON e.src = cc.other JOIN mc ON mc.tx = cc.tx AND mc.comp = e.dst WHERE e.src <> e.dst),
cross4 AS (SELECT DISTINCT cc.comp, cc.other, ms.svc FROM cc JOIN svc_comp s ON s.dst = cc.other JOIN ms ON ms.tx = cc.tx AND ms.svc = s.src),
above AS (SELECT DISTINCT cs.tx, cs.comp, up.caller FROM cs JOIN up ON up.tx = cs.tx AND up.svc = cs.svc),
inner5 AS (SELECT DISTINCT a.comp, e.src, e.dst FROM above a JOIN svc_svc e ON e.dst = a.caller JOIN ms ON ms.tx = a.tx AND ms.svc = e.src WHERE e.src <> e.dst),
own5 AS (SELECT DISTINCT up.svc, e.src, e.dst FROM up JOIN svc_svc e ON e.dst = up.caller JOIN ms ON ms.tx = up.tx AND ms.svc = e.src WHERE e.src <> e.dst),
edges AS (SELECT t.dst AS tab, 'T' || t.dst AS src, 'C' || t.src AS dst, 1 AS phase FROM comp_table t WHERE t.src IN (SELECT comp FROM mc)
  UNION ALL SELECT t.dst, 'C' || i.src, 'C' || i.dst, 2 FROM comp_table t JOIN inner2 i ON i.comp = t.src
  UNION ALL SELECT t.dst, 'T' || t.dst, 'S' || t.src, 3 FROM svc_table t WHERE t.src IN (SELECT svc FROM ms)
  UNION ALL SELECT t.dst, 'C' || x.other, 'S' || x.svc, 4 FROM comp_table t JOIN cross4 x ON x.comp = t.src
  UNION ALL SELECT t.dst, 'S' || i.src, 'S' || i.dst, 5 FROM comp_table t JOIN inner5 i ON i.comp = t.src
  UNION ALL SELECT t.dst, 'S' || i.src, 'S' || i.dst, 5 FROM svc_table t JOIN own5 i ON i.svc = t.src
  UNION ALL SELECT h.tab, 'S' || h.root, 'X' || t.tx, 6 FROM (SELECT DISTINCT tab, root, tx_name FROM hit JOIN names ON names.tx = hit.tx) h JOIN t ON t.tab = h.tab AND t.tx_name = h.tx_name),
once AS (SELECT tab, src, dst, min(phase)::INT AS phase FROM edges GROUP BY 1, 2, 3)"""


@PLAN.query("op_gr18_edge_set", EDGES + " SELECT * FROM once")
def gr18(spark, sf_dir):
    return I.table_edges(layers(spark, sf_dir))


@PLAN.query("op_gr19_all_roots", HIT + REFS + ", t AS (" + TX + "), c AS (" + COMP_TX + "), s AS (" + SVC_TX + """), r AS (SELECT 'table' AS mode, tab AS root, domain_key FROM t UNION ALL SELECT 'component', comp, domain_key FROM c UNION ALL SELECT 'service', root, domain_key FROM s)
SELECT mode, root, count(*) AS n_transactions, count(DISTINCT domain_key) AS n_domains FROM r GROUP BY 1, 2""")
def gr19(spark, sf_dir):
    return I.all_roots(layers(spark, sf_dir), callable_services(spark, sf_dir), orchestrations(spark, sf_dir))


@PLAN.query("op_agg32_export_summary", EDGES + """, ends AS (SELECT tab, src AS node FROM once UNION SELECT tab, dst FROM once)
SELECT tab, count(*) FILTER (node LIKE 'C%') AS n_components, count(*) FILTER (node LIKE 'S%') AS n_services, count(*) FILTER (node LIKE 'X%') AS n_transactions FROM ends GROUP BY 1""")
def agg32(spark, sf_dir):
    return I.export_summary(layers(spark, sf_dir))


@PLAN.query("op_prj05_catalog", BASE + " SELECT tx_name AS name, domain_key, count(*) AS n FROM tx_steps WHERE lower(tx_name) LIKE '%urgent%' GROUP BY 1, 2")
def prj05(spark, sf_dir):
    steps = view(spark, sf_dir, "tx_steps").where(F.lower("tx_name").contains("URGENT ".strip().lower()))
    return steps.groupBy(F.col("tx_name").alias("name"), "domain_key").agg(F.count("*").alias("n")).orderBy("name", "domain_key")
