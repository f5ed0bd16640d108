"""Graph queries on orders with missing identities, and ring features at a moment with their oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import cut_lineage
from ..sources import lens
from . import rings
from .registry import add
from .sql import cte, node, sql

STAT_COLUMNS = rings.STAT_COLUMNS
RING_COLUMNS = ("ring_size", "ring_phones", "ring_rto_rate", "is_ring", "ring_id", "entity_max_degree", "entity_shared")


# ------------------------------------------------------------------ orders without a phone, cards
def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hashed_orders(lens.partial_orders(spark, sf_dir), G.ALL_KINDS)


cte("lens_partial", """SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN phone END AS phone, CASE WHEN seq % 7 >= 3 THEN device END AS device, CASE WHEN seq % 11 <> 0 THEN addr END AS addr,
 CASE WHEN seq % 5 <> 0 THEN ip END AS ip), card_token AS card FROM lens""", "lens")
cte("p_hashed", "SELECT order_id, seq, ts, outcome_ts, rto, cart_gmv, " + ", ".join(f"{node(k, k)} AS {k}" for k in G.ALL_KINDS) + " FROM lens_partial", "lens_partial")
cte("p_entity_rows", " UNION ALL ".join(f"SELECT order_id, seq, ts, '{k}' AS kind, {k} AS node FROM p_hashed WHERE {k} IS NOT NULL" for k in G.ALL_KINDS), "p_hashed")
cte("p_graph_edges", "SELECT a.node AS a, b.node AS b, min((a.ts, a.seq)) AS first FROM p_entity_rows a JOIN p_entity_rows b ON a.order_id = b.order_id AND a.node < b.node GROUP BY 1, 2", "p_entity_rows")
cte("p_links", "SELECT a AS node, b AS other, first FROM p_graph_edges UNION ALL SELECT b, a, first FROM p_graph_edges", "p_graph_edges")
cte("p_degrees", "SELECT node, count(*) AS degree, count(*) FILTER (other LIKE 'phone:%') AS phones FROM p_links GROUP BY 1", "p_links")


def _hyperedges(p: str, source: str, kinds: tuple[str, ...], ceiling: int = G.ADDR_MERGE_CEILING) -> None:
    """Each order as the list of its nodes that may merge at its moment, straight from the rule."""
    cte(f"{p}closed", f"""SELECT addr, max(f) AS closed FROM (SELECT addr, f, row_number() OVER (PARTITION BY addr ORDER BY f) AS rn
 FROM (SELECT phone, addr, min((ts, seq)) AS f FROM {source} WHERE phone IS NOT NULL AND addr IS NOT NULL GROUP BY 1, 2)) WHERE rn = {ceiling} GROUP BY 1""", source)
    may = ", ".join("CASE WHEN closed IS NULL OR (ts, seq) < closed THEN addr END" if k == "addr" else k for k in kinds if k != "ip")
    cte(f"{p}sets", f"""SELECT *, coalesce(may[1], head) AS hub FROM (SELECT h.*, list_filter([{may}], lambda x: x IS NOT NULL) AS may, coalesce({', '.join(kinds)}) AS head
 FROM {source} h LEFT JOIN {p}closed USING (addr))""", source, f"{p}closed")
    cte(f"{p}merge", f"SELECT a, b, min(f) AS first FROM (SELECT may[1] AS a, unnest(may[2:]) AS b, (ts, seq) AS f FROM {p}sets) GROUP BY 1, 2", f"{p}sets")


_hyperedges("h_", "hashed", G.KINDS)
_hyperedges("ph_", "p_hashed", G.ALL_KINDS)
cte("ph_reach", """SELECT DISTINCT node, node AS c FROM p_entity_rows UNION SELECT r.node, e.other FROM ph_reach r JOIN
 (SELECT a AS node, b AS other FROM ph_merge UNION ALL SELECT b, a FROM ph_merge) e ON e.node = r.c""", "p_entity_rows", "ph_merge")
cte("ph_comps", "SELECT node, min(c) AS component FROM ph_reach GROUP BY 1", "ph_reach")
cte("ph_stats", """SELECT *, CASE WHEN rto + delivered > 0 THEN rto / CAST(rto + delivered AS DOUBLE) ELSE 0e0 END AS rto_rate,
 phones >= 3 AND (phones / greatest(1, devices) >= 2.5 OR (phones / greatest(1, addrs) >= 2.5 AND rto + delivered >= 5 AND rto / greatest(1, rto + delivered) >= 0.45)) AS is_ring
FROM (SELECT component, count(*) AS size, count(*) FILTER (node LIKE 'phone:%') AS phones, count(*) FILTER (node LIKE 'device:%') AS devices,
  count(*) FILTER (node LIKE 'addr:%') AS addrs FROM ph_comps GROUP BY 1)
LEFT JOIN (SELECT component, count(*) AS orders0, sum(cart_gmv) AS gmv0 FROM ph_sets JOIN ph_comps ON node = hub GROUP BY 1) USING (component)
LEFT JOIN (SELECT component, count(*) FILTER (rto) AS rto0, count(*) FILTER (NOT rto) AS del0 FROM ph_sets JOIN ph_comps ON node = head GROUP BY 1) USING (component),
LATERAL (SELECT coalesce(orders0, 0) AS orders, coalesce(rto0, 0) AS rto, coalesce(del0, 0) AS delivered, coalesce(gmv0, 0) AS gmv)""", "ph_comps", "ph_sets")


def partial_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = cut_lineage(partial(spark, sf_dir))
    comps = G.components(h)
    return h, comps, G.ring_statistics(h, comps)


def partial_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_degrees(G.edge_list(partial(spark, sf_dir)))


def partial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _, st = partial_stats(spark, sf_dir)
    return G.graph_summary(st, G.node_degrees(G.edge_list(h)))


SHARED = "(node LIKE 'addr:%' AND (phones >= 25 OR degree >= 50)) OR (node LIKE 'ip:%' AND degree >= 50)"
add("d7_merge_edges_partial", lambda s, d: G.merge_edges(partial(s, d)).select("a", "b").distinct(), sql("SELECT a, b FROM ph_merge", "ph_merge"))
add("d8_components_partial", lambda s, d: G.components(partial(s, d)), sql("SELECT node, component FROM ph_comps", "ph_comps"))
add("d8_components_over_time_partial", lambda s, d: G.components_over_time(partial(s, d)),
    sql("SELECT node, component FROM ph_comps", "ph_comps"))
add("d9_ring_statistics_partial", lambda s, d: partial_stats(s, d)[2].select("component", *STAT_COLUMNS, F.round("gmv", 2).alias("gmv"), F.round("rto_rate", 6).alias("rto_rate")),
    sql("SELECT component, " + ", ".join(STAT_COLUMNS) + ", round(gmv, 2) AS gmv, round(rto_rate, 6) AS rto_rate FROM ph_stats", "ph_stats"))
add("d10_ring_predicate_partial", lambda s, d: partial_stats(s, d)[2].select("component", "is_ring"), sql("SELECT component, is_ring FROM ph_stats", "ph_stats"))
add("d11_top_rings_partial", lambda s, d: G.top_rings(partial_stats(s, d)[2], 20).select("component", "phones", "orders", F.round("weight", 4).alias("weight")),
    sql("SELECT component, phones, orders, round(weight, 4) AS weight FROM (SELECT *, round(rto_rate, 4) * orders AS weight FROM ph_stats WHERE is_ring) "
        "ORDER BY weight DESC, phones DESC, component LIMIT 20", "ph_stats"))
add("d12_top_shared_entities_partial", lambda s, d: G.shared_entities(partial_degrees(s, d)).orderBy(F.desc("degree"), "node").limit(10),
    sql(f"SELECT node, degree, phones FROM p_degrees WHERE {SHARED} ORDER BY degree DESC, node LIMIT 10", "p_degrees"))
add("d13_graph_summary_partial", partial_summary,
    sql(f"""SELECT * FROM (SELECT CAST(sum(size) AS BIGINT) AS nodes, count(*) AS components, count(*) FILTER (is_ring) AS rings,
 CAST(sum(phones) FILTER (is_ring) AS BIGINT) AS ring_phones, max(size) AS largest_component, CAST(sum(orders) AS BIGINT) AS orders_ingested FROM ph_stats),
 (SELECT count(*) FILTER ({SHARED}) AS shared_entities, count(*) FILTER (node LIKE 'addr:%' AND phones >= 6) AS non_bridging_addresses FROM p_degrees)""", "ph_stats", "p_degrees"))
add("d14_ring_lookup_partial", lambda s, d: (lambda h, c, st: G.ring_lookup(c, st).select("node", "component", "size", "is_ring"))(*partial_stats(s, d)),
    sql("SELECT node, component, size, is_ring FROM ph_comps JOIN ph_stats USING (component)", "ph_comps", "ph_stats"))


# ------------------------------------------------------------------ rings as known at a moment
def _moments(p: str, source: str, rows: str, links: str, kinds: tuple[str, ...]) -> None:
    """Everything numbered by position among orders and outcomes; whatever a reading sees is found from it anew."""
    cte(f"{p}events", f"SELECT seq, kind, row_number() OVER (ORDER BY ts, kind, seq) AS pos FROM (SELECT seq, ts, 0 AS kind FROM {source} UNION ALL SELECT seq, outcome_ts, 1 FROM {source})", source)
    cte(f"{p}touched", f"SELECT r.node, r.seq, e.kind, e.pos FROM {rows} r JOIN {p}events e USING (seq)", rows, f"{p}events")
    cte(f"{p}bridges", f"""SELECT node, other, pos FROM (SELECT a AS node, b AS other, first FROM {p}merge UNION ALL SELECT b, a, first FROM {p}merge) m
 JOIN {p}events e ON e.seq = m.first[2] AND e.kind = 0""", f"{p}merge", f"{p}events")
    cte(f"{p}booked", f"""SELECT node, pos, sum(o) OVER w AS o, sum(r) OVER w AS r, sum(dl) OVER w AS dl FROM (SELECT hub AS node, pos, 1 AS o, 0 AS r, 0 AS dl FROM {p}sets JOIN {p}events USING (seq) WHERE kind = 0
  UNION ALL SELECT head, pos, 0, CASE WHEN rto THEN 1 ELSE 0 END, CASE WHEN rto THEN 0 ELSE 1 END FROM {p}sets JOIN {p}events USING (seq) WHERE kind = 1) WINDOW w AS (PARTITION BY node ORDER BY pos)""",
        f"{p}sets", f"{p}events")
    cte(f"{p}linked", f"""SELECT node, pos, max(n) AS degree, max(ph) AS phones FROM (SELECT node, pos, count(*) OVER w AS n, count(*) FILTER (other LIKE 'phone:%') OVER w AS ph
  FROM {links} l JOIN {p}events e ON e.seq = l.first[2] AND e.kind = 0 WINDOW w AS (PARTITION BY node ORDER BY pos)) GROUP BY 1, 2""", links, f"{p}events")
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    for how, at in (("live", "t.pos - 1"), ("seen", "lag(t.pos) OVER (PARTITION BY t.node ORDER BY t.pos)")):
        q = f"{p}{how}_"
        keep = "upto >= born" if how == "live" else "upto IS NOT NULL"
        cte(f"{q}reads", f"SELECT * FROM (SELECT seq, node, kind, {at} AS upto, min(t.pos) OVER (PARTITION BY t.node) AS born FROM {p}touched t) WHERE kind = 0 AND {keep}", f"{p}touched")
        cte(f"{q}reach", f"SELECT DISTINCT node, upto, node AS c FROM {q}reads UNION SELECT r.node, r.upto, b.other FROM {q}reach r JOIN {p}bridges b ON b.node = r.c AND b.pos <= r.upto", f"{q}reads", f"{p}bridges")
        cte(f"{q}rings", f"""SELECT r.node, r.upto, min(c) AS name, count(*) AS size, count(*) FILTER (c LIKE 'phone:%') AS phones, count(*) FILTER (c LIKE 'device:%') AS devices,
 count(*) FILTER (c LIKE 'addr:%') AS addrs, coalesce(sum(b.r), 0) AS rto, coalesce(sum(b.dl), 0) AS dl
 FROM {q}reach r ASOF LEFT JOIN {p}booked b ON b.node = r.c AND r.upto >= b.pos GROUP BY 1, 2""", f"{q}reach", f"{p}booked")
        cte(f"{q}best", f"""SELECT seq, max((size, rate, -rank, phones, is_ring, name)) AS m, max(coalesce(degree, 0)) AS top, bool_or(coalesce(shared, false)) AS shared FROM (
 SELECT *, {SHARED.replace('node', 's.node').replace('phones', 'lp')} AS shared FROM (
  SELECT d.seq, d.node, x.size, x.phones, x.name, CASE WHEN x.rto + x.dl > 0 THEN x.rto / CAST(x.rto + x.dl AS DOUBLE) ELSE 0e0 END AS rate, CASE split_part(d.node, ':', 1) {rank} END AS rank,
   x.phones >= 3 AND (x.phones / greatest(1, x.devices) >= 2.5 OR (x.phones / greatest(1, x.addrs) >= 2.5 AND x.rto + x.dl >= 5 AND x.rto / greatest(1, x.rto + x.dl) >= 0.45)) AS is_ring,
   l.degree, l.phones AS lp FROM {q}reads d JOIN {q}rings x USING (node, upto) ASOF LEFT JOIN {p}linked l ON l.node = d.node AND d.upto >= l.pos) s) GROUP BY 1""", f"{q}reads", f"{q}rings", f"{p}linked")
        cte(f"{q}features", f"""SELECT order_id, seq, CASE WHEN m[1] > 1 THEN m[1] ELSE 0 END AS ring_size, CASE WHEN m[1] > 1 THEN m[4] ELSE 0 END AS ring_phones, CASE WHEN m[1] > 1 THEN m[2] ELSE 0e0 END AS ring_rto_rate,
 coalesce(m[1] > 1 AND m[5], false) AS is_ring, CASE WHEN m[1] > 1 THEN m[6] END AS ring_id, coalesce(top, 0) AS entity_max_degree, coalesce(shared, false) AS entity_shared
FROM {source} LEFT JOIN {q}best USING (seq)""", source, f"{q}best")


_moments("h_", "hashed", "entity_rows", "links", G.KINDS)
_moments("ph_", "p_hashed", "p_entity_rows", "p_links", G.ALL_KINDS)
for _name, _published, _how in (("d15_live_ring_features", False, "live"), ("d16_published_ring_features", True, "seen")):
    add(_name, lambda s, d, p=_published: G.ring_features(rings.hashed(s, d), published=p).select("order_id", "seq", *RING_COLUMNS),
        sql(f"SELECT order_id, seq, {', '.join(RING_COLUMNS)} FROM h_{_how}_features", f"h_{_how}_features"))
    add(_name + "_partial", lambda s, d, p=_published: G.ring_features(partial(s, d), published=p).select("order_id", "seq", *RING_COLUMNS),
        sql(f"SELECT order_id, seq, {', '.join(RING_COLUMNS)} FROM ph_{_how}_features", f"ph_{_how}_features"))
