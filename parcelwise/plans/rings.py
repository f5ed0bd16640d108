"""Queries on the entity graph."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import training
from ..session import cut_lineage
from ..sources import lens
from .registry import add
from .sql import cte, node, sql

T40, T60, T80 = datetime(1997, 8, 1), datetime(1998, 12, 1), datetime(2000, 4, 1)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hashed_orders(lens.orders(spark, sf_dir))


cte("hashed", "SELECT order_id, seq, ts, outcome_ts, rto, cart_gmv, " + ", ".join(f"{node(k, k)} AS {k}" for k in G.KINDS) + " FROM lens", "lens")
cte("entity_rows", " UNION ALL ".join(f"SELECT order_id, seq, ts, '{k}' AS kind, {k} AS node FROM hashed WHERE {k} IS NOT NULL" for k in G.KINDS), "hashed")
cte("graph_edges", "SELECT a.node AS a, b.node AS b, min((a.ts, a.seq)) AS first FROM entity_rows a JOIN entity_rows b ON a.order_id = b.order_id AND a.node < b.node GROUP BY 1, 2", "entity_rows")
cte("links", "SELECT a AS node, b AS other, first FROM graph_edges UNION ALL SELECT b, a, first FROM graph_edges", "graph_edges")
cte("degrees", "SELECT node, count(*) AS degree, count(*) FILTER (other LIKE 'phone:%') AS phones FROM links GROUP BY 1", "links")


def _guarded(ceiling: int, p: str) -> None:
    """Merge edges, components and ring statistics under one ceiling."""
    cte(f"{p}merge", f"""SELECT DISTINCT phone AS a, device AS b FROM hashed WHERE device IS NOT NULL UNION SELECT DISTINCT phone, vpa FROM hashed WHERE vpa IS NOT NULL
 UNION SELECT phone, addr FROM (SELECT phone, addr, row_number() OVER (PARTITION BY addr ORDER BY f) AS rn FROM
  (SELECT phone, addr, min((ts, seq)) AS f FROM hashed GROUP BY 1, 2)) WHERE rn < {ceiling}""", "hashed")
    cte(f"{p}reach", f"""SELECT DISTINCT node, node AS c FROM entity_rows UNION SELECT r.node, e.other FROM {p}reach r JOIN
 (SELECT a AS node, b AS other FROM {p}merge UNION ALL SELECT b, a FROM {p}merge) e ON e.node = r.c""", "entity_rows", f"{p}merge")
    cte(f"{p}comps", f"SELECT node, min(c) AS component FROM {p}reach GROUP BY 1", f"{p}reach")
    cte(f"{p}stats", f"""SELECT *, CASE WHEN rto + delivered > 0 THEN rto / CAST(rto + delivered AS DOUBLE) ELSE 0e0 END AS rto_rate,
 phones >= 3 AND (phones / greatest(1, devices) >= 2.5 OR (phones / greatest(1, addrs) >= 2.5 AND rto + delivered >= 5 AND rto / greatest(1, rto + delivered) >= 0.45)) AS is_ring
FROM (SELECT component, count(*) AS size, count(*) FILTER (node LIKE 'phone:%') AS phones, count(*) FILTER (node LIKE 'device:%') AS devices,
  count(*) FILTER (node LIKE 'addr:%') AS addrs FROM {p}comps GROUP BY 1)
LEFT JOIN (SELECT component, count(*) AS orders0, count(*) FILTER (rto) AS rto0, count(*) FILTER (NOT rto) AS del0, sum(cart_gmv) AS gmv0
  FROM hashed JOIN {p}comps ON node = phone GROUP BY 1) USING (component), LATERAL (SELECT coalesce(orders0, 0) AS orders, coalesce(rto0, 0) AS rto, coalesce(del0, 0) AS delivered, coalesce(gmv0, 0) AS gmv)""",
        f"{p}comps", "hashed")


for ceiling, prefix in ((6, "g_"), (3, "g3_"), (10, "g10_")):
    _guarded(ceiling, prefix)


def stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = cut_lineage(hashed(spark, sf_dir))
    comps = G.components(h)
    return h, comps, G.ring_statistics(h, comps)


STAT_COLUMNS = ("size", "phones", "devices", "addrs", "orders", "rto", "delivered")
add("d1_order_entities", lambda s, d: G.order_entities(hashed(s, d)).select("order_id", "kind", "node"),
    sql("SELECT order_id, kind, node FROM entity_rows", "entity_rows"))
add("d2_edge_list", lambda s, d: G.edge_list(hashed(s, d)).select("a", "b", "seq"), sql("SELECT a, b, first[2] AS seq FROM graph_edges", "graph_edges"))
add("d3_node_degree", lambda s, d: G.node_degrees(G.edge_list(hashed(s, d))).select("node", "degree"), sql("SELECT node, degree FROM degrees", "degrees"))
add("d3_node_degree_over_time", lambda s, d: G.degrees_over_time(hashed(s, d)),
    sql("""SELECT seq, node, CAST(coalesce(sum(fresh) OVER (PARTITION BY node ORDER BY pos, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS degree
FROM (SELECT seq, node, (ts, seq) AS pos, 0 AS sub, 0 AS fresh FROM entity_rows UNION ALL SELECT NULL, node, first, 1, 1 FROM links) QUALIFY seq IS NOT NULL""", "entity_rows", "links"))
add("d4_address_phone_degree", lambda s, d: G.node_degrees(G.edge_list(hashed(s, d))).filter("node like 'addr:%'").select("node", "phones"),
    sql("SELECT node, phones FROM degrees WHERE node LIKE 'addr:%'", "degrees"))
add("d5_non_bridging_addresses", lambda s, d: G.non_bridging(G.node_degrees(G.edge_list(hashed(s, d)))).select("node", "phones"),
    sql("SELECT node, phones FROM degrees WHERE node LIKE 'addr:%' AND phones >= 6", "degrees"))
add("d6_shared_entities", lambda s, d: G.shared_entities(G.node_degrees(G.edge_list(hashed(s, d)))).select("node", "degree", "phones"),
    sql("SELECT node, degree, phones FROM degrees WHERE (node LIKE 'addr:%' AND (phones >= 25 OR degree >= 50)) OR (node LIKE 'ip:%' AND degree >= 50)", "degrees"))
add("d7_merge_edges", lambda s, d: G.merge_edges(hashed(s, d)).select("a", "b"), sql("SELECT a, b FROM g_merge", "g_merge"))
add("d8_components", lambda s, d: G.components(hashed(s, d)), sql("SELECT node, component FROM g_comps", "g_comps"))
add("d8_components_over_time", lambda s, d: G.components_over_time(hashed(s, d)),
    sql("SELECT node, component FROM g_comps", "g_comps"))
add("d9_ring_statistics", lambda s, d: stats(s, d)[2].select("component", *STAT_COLUMNS, F.round("gmv", 2).alias("gmv"), F.round("rto_rate", 6).alias("rto_rate")),
    sql("SELECT component, " + ", ".join(STAT_COLUMNS) + ", round(gmv, 2) AS gmv, round(rto_rate, 6) AS rto_rate FROM g_stats", "g_stats"))
add("d10_ring_predicate", lambda s, d: stats(s, d)[2].select("component", "is_ring"), sql("SELECT component, is_ring FROM g_stats", "g_stats"))
add("d11_top_rings", lambda s, d: G.top_rings(stats(s, d)[2], 20).select("component", "phones", "orders", F.round("weight", 4).alias("weight")),
    sql("SELECT component, phones, orders, round(weight, 4) AS weight FROM (SELECT *, round(rto_rate, 4) * orders AS weight FROM g_stats WHERE is_ring) "
        "ORDER BY weight DESC, phones DESC, component LIMIT 20", "g_stats"))
add("d12_top_shared_entities", lambda s, d: G.shared_entities(G.node_degrees(G.edge_list(hashed(s, d)))).orderBy(F.desc("degree"), "node").limit(10),
    sql("SELECT node, degree, phones FROM degrees WHERE (node LIKE 'addr:%' AND (phones >= 25 OR degree >= 50)) OR (node LIKE 'ip:%' AND degree >= 50) ORDER BY degree DESC, node LIMIT 10", "degrees"))


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _, st = stats(spark, sf_dir)
    return G.graph_summary(st, G.node_degrees(G.edge_list(h)))


add("d13_graph_summary", graph_summary,
    sql("""SELECT * FROM (SELECT CAST(sum(size) AS BIGINT) AS nodes, count(*) AS components, count(*) FILTER (is_ring) AS rings,
 CAST(sum(phones) FILTER (is_ring) AS BIGINT) AS ring_phones, max(size) AS largest_component, CAST(sum(orders) AS BIGINT) AS orders_ingested FROM g_stats),
 (SELECT count(*) FILTER ((node LIKE 'addr:%' AND (phones >= 25 OR degree >= 50)) OR (node LIKE 'ip:%' AND degree >= 50)) AS shared_entities,
  count(*) FILTER (node LIKE 'addr:%' AND phones >= 6) AS non_bridging_addresses FROM degrees)""", "g_stats", "degrees"))
add("d14_ring_lookup", lambda s, d: (lambda h, c, st: G.ring_lookup(c, st).select("node", "component", "size", "is_ring"))(*stats(s, d)),
    sql("SELECT node, component, size, is_ring FROM g_comps JOIN g_stats USING (component)", "g_comps", "g_stats"))


def _seed(edges: DataFrame) -> str:
    return edges.filter("b like 'phone:%'").agg(F.min("b")).first()[0]


def subgraph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = G.edge_list(hashed(spark, sf_dir))
    return G.subgraph(edges, _seed(edges))


cte("bfs", """SELECT min(b) AS node, 0 AS hop FROM graph_edges WHERE b LIKE 'phone:%' UNION SELECT l.other, hop + 1 FROM bfs JOIN links l ON l.node = bfs.node WHERE hop < 4""", "graph_edges", "links")
cte("near", "SELECT node, min(hop) AS hop FROM bfs GROUP BY 1 ORDER BY 2, 1 LIMIT 120", "bfs")
cte("inner_edges", "SELECT a, b FROM graph_edges WHERE a IN (SELECT node FROM near) AND b IN (SELECT node FROM near)", "graph_edges", "near")
add("d17_neighbourhood", lambda s, d: subgraph(s, d)[0].select("node", "hop"), sql("SELECT node, hop FROM near", "near"))
add("d17_induced_edges", lambda s, d: subgraph(s, d)[1].select("a", "b"), sql("SELECT a, b FROM inner_edges", "inner_edges"))
add("d18_degree_centrality", lambda s, d: subgraph(s, d)[0].select("node", "degree", "centrality"),
    sql("""SELECT node, count(e.a) AS degree, round(count(e.a) / (max(n.n) - 1e0), 3) AS centrality FROM near JOIN (SELECT count(*) AS n FROM near) n ON true
 LEFT JOIN inner_edges e ON e.a = node OR e.b = node GROUP BY 1""", "near", "inner_edges"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per phone: a shared handset is the truth, a shared address makes a resident."""
    return hashed_truth(lens.orders(spark, sf_dir))


def hashed_truth(orders: DataFrame) -> DataFrame:
    h = orders.select(G.node_id("phone", F.col("phone")).alias("phone"), F.col("device").startswith("ds").alias("truth"), F.col("addr").startswith("as").alias("resident"))
    return h.groupBy("phone").agg(F.bool_or("truth").alias("truth"), F.bool_or("resident").alias("resident"))


QUALITY = ("phones", "ring_phones_true", "tp", "fp", "fn", "legit_residents", "residents_condemned")
RATES = ("precision", "recall", "residents_condemned_share")
cte("truth", f"SELECT {node('phone', 'phone')} AS phone, bool_or(device LIKE 'ds%') AS truth, bool_or(addr LIKE 'as%') AS resident FROM lens GROUP BY 1", "lens")


def _quality(p: str) -> str:
    return f"""SELECT *, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall,
 round(residents_condemned / greatest(1, legit_residents), 6) AS residents_condemned_share
FROM (SELECT count(*) AS phones, count(*) FILTER (truth) AS ring_phones_true, count(*) FILTER (flagged AND truth) AS tp, count(*) FILTER (flagged AND NOT truth) AS fp,
 count(*) FILTER (NOT flagged AND truth) AS fn, count(*) FILTER (resident AND NOT truth) AS legit_residents,
 count(*) FILTER (flagged AND resident AND NOT truth) AS residents_condemned
 FROM (SELECT t.*, is_ring AS flagged FROM truth t JOIN {p}comps ON node = t.phone JOIN {p}stats USING (component)))"""


add("d19_detection_quality", lambda s, d: G.detection_quality(G.phone_flags(hashed(s, d), truth(s, d), guard=True)[0]).select(
    *QUALITY, *[F.round(c, 6).alias(c) for c in RATES]), sql(_quality("g_"), "truth", "g_comps", "g_stats"))
add("d20_ceiling_sweep", lambda s, d: G.guard_comparison(hashed(s, d), truth(s, d), (3, 6, 10), naive=False).select(
    "variant", "components", "rings", "largest_component", *QUALITY, *[F.round(c, 6).alias(c) for c in RATES]),
    sql(" UNION ALL ".join(f"SELECT 'guarded@{c}' AS variant, * FROM (SELECT count(*) AS components, count(*) FILTER (is_ring) AS rings, max(size) AS largest_component FROM {p}stats), ({_quality(p)})"
                           for c, p in ((3, "g3_"), (6, "g_"), (10, "g10_"))), "truth", *[f"{p}{x}" for p in ("g3_", "g_", "g10_") for x in ("comps", "stats")]))
add("d20_guard_comparison", lambda s, d: G.guard_comparison(hashed(s, d), truth(s, d)))


# ------------------------------------------------------------------ snapshots
def snapshot(spark: SparkSession, sf_dir: str, order_cutoff=T80, outcome_cutoff=T60) -> DataFrame:
    return G.snapshot(hashed(spark, sf_dir), order_cutoff, outcome_cutoff)


def _snapshot_ctes(p: str, order_cutoff: str, outcome_cutoff: str) -> None:
    cte(f"{p}snap", f"SELECT * REPLACE (CASE WHEN outcome_ts <= TIMESTAMP '{outcome_cutoff}' THEN rto END AS rto) FROM hashed WHERE ts <= TIMESTAMP '{order_cutoff}'", "hashed")
    cte(f"{p}rows", " UNION ALL ".join(f"SELECT order_id, rto, {k} AS node FROM {p}snap WHERE {k} IS NOT NULL" for k in G.KINDS), f"{p}snap")
    cte(f"{p}links", f"SELECT DISTINCT a.node, b.node AS other FROM {p}rows a JOIN {p}rows b ON a.order_id = b.order_id AND a.node <> b.node", f"{p}rows")
    nbr = ", ".join(f"count(*) FILTER (other LIKE '{k}:%') AS nbr_{k}" for k in G.KINDS)
    cte(f"{p}counts", f"""SELECT * FROM (SELECT node, count(*) AS orders, count(*) FILTER (rto) AS rto, count(*) FILTER (NOT rto) AS delivered FROM {p}rows GROUP BY 1)
 JOIN (SELECT node, {nbr} FROM {p}links GROUP BY 1) USING (node)""", f"{p}rows", f"{p}links")
    kinds = ", ".join(f"CASE WHEN node LIKE '{k}:%' THEN 1e0 ELSE 0e0 END AS kind_{k}" for k in G.KINDS)
    logs = ", ".join(f"ln(1 + nbr_{k}) AS nbr_{k}_log" for k in G.KINDS)
    cte(f"{p}feat", f"""SELECT node, {kinds}, ln(1 + {' + '.join(f'nbr_{k}' for k in G.KINDS)}) AS degree_log, ln(1 + orders) AS orders_log, ln(1 + rto + delivered) AS resolved_log,
 (rto + 5 * prior) / (rto + delivered + 5) AS rto_rate_shrunk, {logs} FROM {p}counts, (SELECT coalesce(avg(CAST(rto AS DOUBLE)), 0.2e0) AS prior FROM {p}snap)""", f"{p}counts", f"{p}snap")


_snapshot_ctes("s_", "2000-04-01", "1998-12-01")
SCALED = G.NODE_FEATURES[len(G.KINDS):]
add("d21_two_clock_snapshot", lambda s, d: G.node_counts(snapshot(s, d)), sql("SELECT * FROM s_counts", "s_counts"))
add("d22_node_features", lambda s, d: G.node_features(snapshot(s, d)).select("node", *[F.round(c, 6).alias(c) for c in G.NODE_FEATURES]),
    sql("SELECT node, " + ", ".join(f"round({c}, 6) AS {c}" for c in G.NODE_FEATURES) + " FROM s_feat", "s_feat"))
add("d23_standardiser", lambda s, d: (lambda r: r.select(*[F.round(c, 6).alias(c) for c in r.columns]))(G.standardiser(G.node_features(snapshot(s, d)))),
    sql("SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(greatest(stddev_pop({c}), 1e-3), 6) AS std_{c}" for c in SCALED) + " FROM s_feat", "s_feat"))


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own features with their one-hop and two-hop neighbourhood means."""
    return two_hops(snapshot(spark, sf_dir))


def two_hops(snap: DataFrame) -> DataFrame:
    """Features, edges and first means are written once: each is read by several aggregates and joins."""
    edges = cut_lineage(G.edge_list(snap).select("a", "b"))
    feats = cut_lineage(G.node_features(snap, edges))
    scaled = G.standardise(feats, G.standardiser(feats))
    one = cut_lineage(G.neighbour_mean(edges, scaled, list(SCALED), "_n1"))
    return G.neighbour_mean(edges, one, [c + "_n1" for c in SCALED], "_n2")


HOP_COLUMNS = [*G.NODE_FEATURES, *[c + "_n1" for c in SCALED], *[c + "_n1_n2" for c in SCALED]]
cte("s_scaled", "SELECT node, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SCALED) + " FROM s_feat, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-3) AS s_{c}" for c in SCALED) + " FROM s_feat)", "s_feat")
cte("s_one", "SELECT l.node, " + ", ".join(f"avg({c}) AS {c}" for c in SCALED) + " FROM s_links l JOIN s_scaled x ON x.node = l.other GROUP BY 1", "s_links", "s_scaled")
cte("s_two", "SELECT l.node, " + ", ".join(f"avg({c}) AS {c}" for c in SCALED) + " FROM s_links l JOIN s_one x ON x.node = l.other GROUP BY 1", "s_links", "s_one")
add("d24_neighbour_means", lambda s, d: hops(s, d).select("node", *[(F.round(F.col(c + "_n1"), 5) + 0.0).alias(c + "_n1") for c in SCALED],
                                                         *[(F.round(F.col(c + "_n1_n2"), 5) + 0.0).alias(c + "_n2") for c in SCALED]),
    sql("SELECT a.node, " + ", ".join(f"round(a.{c}, 5) + 0e0 AS {c}_n1, round(b.{c}, 5) + 0e0 AS {c}_n2" for c in SCALED) + " FROM s_one a JOIN s_two b USING (node)", "s_one", "s_two"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lens.orders(spark, sf_dir)
    return G.phone_labels(o.withColumn("phone", G.node_id("phone", F.col("phone"))), T40, T60)


add("d25_node_scorer", lambda s, d: (lambda x, y: training.score_nodes(
    training.fit_node_scorer(x.join(y, "node"), HOP_COLUMNS), x, HOP_COLUMNS))(cut_lineage(hops(s, d)), labels(s, d).withColumnRenamed("phone", "node")))
add("d26_out_of_fold_scores", lambda s, d: training.out_of_fold(cut_lineage(hops(s, d)), labels(s, d).withColumnRenamed("phone", "node"), HOP_COLUMNS))
add("d27_node_labels", labels,
    sql("SELECT phone, CASE WHEN avg(CAST(rto AS DOUBLE)) >= 0.5 THEN 1 ELSE 0 END AS label FROM hashed WHERE ts < TIMESTAMP '1998-12-01' GROUP BY 1 "
        "HAVING min(ts) >= TIMESTAMP '1997-08-01'", "hashed"))

_snapshot_ctes("e1_", "1998-12-01", "1998-12-01")
_snapshot_ctes("e2_", "2000-04-01", "1998-12-01")
_snapshot_ctes("e3_", "2100-01-01", "2000-04-01")


def era_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order gets its phone's shrunk return rate from the snapshot of the order's own era."""
    h = hashed(spark, sf_dir)
    cuts = {"train": (T60, T60), "mid": (T80, T60), "test": (datetime(2100, 1, 1), T80)}
    scores = None
    for era, (oc, rc) in cuts.items():
        x = G.node_features(G.snapshot(h, oc, rc)).select(F.lit(era).alias("era"), "node", F.col("rto_rate_shrunk").alias("score"))
        scores = x if scores is None else scores.unionByName(x)
    return G.era_scores(h, scores, [("train", T60), ("mid", T80), ("test", None)])


add("d28_era_scores", lambda s, d: era_scores(s, d).select("order_id", "era", F.round("score", 6).alias("score")),
    sql("SELECT order_id, era, round(score, 6) AS score FROM (SELECT order_id, phone, CASE WHEN ts < TIMESTAMP '1998-12-01' THEN 'train' WHEN ts < TIMESTAMP '2000-04-01' THEN 'mid' ELSE 'test' END AS era FROM hashed) "
        "LEFT JOIN (SELECT 'train' AS era, node, rto_rate_shrunk AS score FROM e1_feat UNION ALL SELECT 'mid', node, rto_rate_shrunk FROM e2_feat UNION ALL SELECT 'test', node, rto_rate_shrunk FROM e3_feat) s USING (era) WHERE s.node = phone",
        "hashed", "e1_feat", "e2_feat", "e3_feat"))
