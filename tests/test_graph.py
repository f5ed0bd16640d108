import random

from order_rows import make_orders

from parcelwise.operators import components as C
from parcelwise.operators import graph as G
from parcelwise.operators.components import component_history, connected_components, final_labels, merge_forest
from pyspark.sql import functions as F


def built(spark, rows, **kw):
    h = G.hashed_orders(make_orders(spark, rows))
    comps = G.components(h, **kw)
    return h, comps, {r["component"]: r for r in G.ring_statistics(h, comps, **kw).collect()}


def comp_of(spark, comps, kind, raw):
    n = spark.range(1).select(G.node_id(kind, F.lit(raw)).alias("n")).first()["n"]
    return comps.filter(F.col("node") == n).first()["component"]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    names = sorted({x for e in edges for x in e} | {"lonely"})
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    got = {r["node"]: r["component"] for r in connected_components(nodes, df).collect()}
    assert got == {n: find(n) for n in names}
    stamped = df.withColumn("ts", F.current_timestamp()).withColumn("seq", F.monotonically_increasing_id())
    history = component_history(nodes.withColumn("ts", F.lit("2000-01-01").cast("timestamp")).withColumn("seq", F.lit(0).cast("long")), stamped)
    assert {r["node"]: r["component"] for r in final_labels(history).collect()} == got


def test_forest_keeps_every_moment_of_a_line_whose_ids_follow_time(spark):
    """Ids and times rise together: the forest has one link a node and every node few labels."""
    n = 300
    names = [f"n{i:04d}" for i in range(n)]
    edges = spark.createDataFrame([(names[i], names[i + 1], n - i, i) for i in range(n - 1)], "a string, b string, ts long, seq long")
    assert merge_forest(edges).count() == n - 1
    nodes = spark.createDataFrame([(x, 0, -1) for x in names], "node string, ts long, seq long")
    history = {}
    rows = component_history(nodes, edges).collect()
    for r in rows:
        history.setdefault(r["node"], []).append((r["ts"], r["seq"], r["label"]))
    assert len(rows) < 20 * n
    for t in (0, 1, 37, 150, 299):
        labels = [max(x for x in history[m] if x[0] <= t)[2] for m in names]
        split = n - 1 - t  # edges from here on are in
        assert len(set(labels[max(0, split + 1):])) <= 1 and len(set(labels)) == max(1, split + 2) - (t == 0)


def test_orders_without_a_phone_merge_and_are_booked(spark):
    rows = [(None, "d1", "a1", "v1", "n", True), ("", "d2", "a2", "v1", "n", True), (None, None, None, None, "n", False), (None, None, "a1", None, None, True)]
    h, comps, stats = built(spark, rows)
    ring = stats[comp_of(spark, comps, "device", "d1")]
    assert ring["component"] == comp_of(spark, comps, "addr", "a2") and (ring["size"], ring["phones"], ring["orders"], ring["rto"]) == (5, 0, 3, 3)
    net = stats[comp_of(spark, comps, "ip", "n")]
    assert (net["size"], net["orders"], net["delivered"]) == (1, 1, 1)


def test_a_closed_address_is_no_bridge_without_a_phone_either(spark):
    rows = [(f"p{i}", f"d{i}", "hostel", None, None, False) for i in range(6)] + [(None, None, "hostel", "v9", None, True), (None, None, "hostel", None, "n", True)]
    h, comps, stats = built(spark, rows)
    assert stats[comp_of(spark, comps, "vpa", "v9")]["size"] == 1 and stats[comp_of(spark, comps, "vpa", "v9")]["orders"] == 1
    hostel = stats[comp_of(spark, comps, "addr", "hostel")]
    # outcomes go to the first node, the last order to the address as nothing of it merges
    assert (hostel["phones"], hostel["orders"], hostel["rto"]) == (5, 6, 2)


def test_household_is_not_a_ring_but_a_syndicate_is(spark):
    rows = [("h1", "home", "homeaddr", None, None, False), ("h2", "home", "homeaddr", None, None, False)]
    rows += [(f"b{i}", f"dev{i % 2}", "drop", None, None, True) for i in range(10)]
    _, comps, stats = built(spark, rows, ceiling=20)
    assert not stats[comp_of(spark, comps, "device", "home")]["is_ring"]
    ring = stats[comp_of(spark, comps, "addr", "drop")]
    assert ring["is_ring"] and (ring["phones"], ring["devices"], ring["rto_rate"]) == (10, 2, 1.0)


def test_ip_never_merges(spark):
    _, comps, stats = built(spark, [("pa", "da", "aa", None, "nat", False), ("pb", "db", "ab", None, "nat", False)])
    assert comp_of(spark, comps, "phone", "pa") != comp_of(spark, comps, "phone", "pb")
    assert stats[comp_of(spark, comps, "ip", "nat")]["size"] == 1


def test_hostel_stops_bridging(spark):
    rows = [(f"res{i}", f"own{i}", "hostel", None, None, False) for i in range(30)]
    rows += [(f"b{i}", f"ringdev{i % 2}", "hostel", "payout", None, True) for i in range(8)]
    h, comps, stats = built(spark, rows)
    hostel = stats[comp_of(spark, comps, "phone", "res0")]
    assert not hostel["is_ring"] and hostel["phones"] <= 6
    assert comp_of(spark, comps, "phone", "res29") != hostel["component"]
    ring = stats[comp_of(spark, comps, "phone", "b0")]
    assert ring["is_ring"] and ring["phones"] == 8
    degrees = G.node_degrees(G.edge_list(h))
    assert G.shared_entities(degrees).count() == 1
    _, naive, naive_stats = built(spark, rows, guard=False)
    assert naive_stats[comp_of(spark, naive, "phone", "res0")]["phones"] == 38
    summary = G.graph_summary(G.ring_statistics(h, comps), degrees).first()
    assert summary["shared_entities"] == 1 and summary["non_bridging_addresses"] == 1 and summary["orders_ingested"] == 38


def test_subgraph_holds_the_neighbourhood(spark):
    h = G.hashed_orders(make_orders(spark, [(f"b{i}", "dev", "drop", None, None, True) for i in range(5)]))
    edges = G.edge_list(h)
    seed = edges.select(F.min("a")).first()[0]
    nodes, inner = G.subgraph(edges, seed)
    assert nodes.count() == 7 and inner.count() == 11
    assert G.neighbourhood(edges, seed, 4).count() == 4


def test_snapshot_hides_later_orders_and_outcomes(spark):
    from datetime import timedelta

    from order_rows import T0
    rows = [("p1", "d1", "a1", None, "i0", True), ("p1", "d1", "a1", None, "i1", True), ("p9", "d9", "a9", None, "i2", False)]
    h = G.hashed_orders(make_orders(spark, rows, step=timedelta(days=3), lag=timedelta(days=1)))
    early = G.snapshot(h, T0 + timedelta(days=4), T0 + timedelta(days=2))
    counts = {r["node"]: r for r in G.node_counts(early).collect()}
    p1 = h.select("phone").first()["phone"]
    assert counts[p1]["orders"] == 2 and counts[p1]["rto"] == 1 and len(counts) == 5
    assert counts[p1]["nbr_ip"] == 2 and counts[p1]["nbr_device"] == 1


def test_mean_over_neighbours_of_ones_is_one(spark):
    h = G.hashed_orders(make_orders(spark, [("p1", "d1", "a1", None, "i1", False), ("p2", "d1", "a2", "v", "i2", True)]))
    edges = G.edge_list(h)
    ones = G.node_counts(h).select("node", F.lit(1.0).alias("x"))
    assert {r["x_n1"] for r in G.neighbour_mean(edges, ones, ["x"]).collect()} == {1.0}


def test_nodes_that_hash_alike_get_another_salt(spark, monkeypatch):
    h = spark.createDataFrame([(str(i), i, f"phone:{i}", f"device:{i % 3}") for i in range(6)], "order_id string, seq long, phone string, device string").selectExpr(
        "*", "timestamp_seconds(seq) AS ts", "timestamp_seconds(seq + 9) AS outcome_ts", "seq % 2 = 0 AS rto")
    code, salts = G._code, []

    def poor(kind, node, salt):
        salts.append(salt)
        return code(kind, F.substring(node, 1, 3) if salt == 0 else node, salt)

    monkeypatch.setattr(G, "_code", poor)
    orders, nodes = G.coded_orders(h)
    assert set(salts) == {0, 1}
    assert nodes.count() == nodes.select("node").distinct().count() == 9
    assert {(r["name"], r["count"]) for r in nodes.collect()} == {(f"phone:{i}", 1) for i in range(6)} | {(f"device:{i}", 2) for i in range(3)}
    assert dict(orders.dtypes)["phone"] == "bigint"


def test_edges_at_hand_give_the_same_counts(spark):
    hashed = G.hashed_orders(make_orders(spark, [(f"p{i % 4}", f"d{i % 3}", f"a{i % 2}", None, "i", i % 2 == 0) for i in range(12)]))
    own, given = G.node_counts(hashed), G.node_counts(hashed, G.edge_list(hashed).select("a", "b"))
    assert sorted(map(str, own.collect())) == sorted(map(str, given.select(*own.columns).collect()))
    assert {r["nbr_device"] for r in own.filter("node like 'phone:%'").collect()} == {3}


def test_settled_edges_leave_the_rounds(spark, monkeypatch):
    """An edge that nothing can move any more is written once, not in every later round."""
    written, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rng = random.Random(3)
    rows = [(rng.randrange(200), rng.randrange(200), i, i) for i in range(300)]
    forest = {(r["node"], r["parent"]) for r in merge_forest(spark.createDataFrame(rows, "a long, b long, ts long, seq long")).collect()}
    kept = [{(r["u"], r["v"]) for r in w.filter("kept").collect()} for w in written[1:]]
    later = [{r["u"] for r in w.collect()} for w in written[1:]]
    assert len(kept) > 2 and kept[0]
    for i, edges in enumerate(kept):
        assert edges <= forest and not {u for u, _ in edges} & set().union(*later[i + 1:])


def test_published_numbers_come_from_codes_and_equal_those_of_names(spark, monkeypatch):
    """What is published of a node, worked out on codes, is what components, statistics and degrees of names say."""
    rng = random.Random(11)
    some = lambda kind, n: None if rng.random() < 0.15 else f"{kind}{rng.randrange(n)}"
    h = G.hashed_orders(make_orders(spark, [(some("p", 25), some("d", 30), some("a", 6), some("v", 12), some("i", 4), rng.random() < 0.5) for _ in range(90)]))
    comps = G.components(h)
    stats, degrees = G.ring_statistics(h, comps), G.node_degrees(G.edge_list(h)).withColumn("shared", G.is_shared(F.col("node"), F.col("degree"), F.col("phones")))
    numbers = ("size", "phones", "devices", "addrs", "orders", "rto", "delivered")
    want = comps.join(stats, "component").join(degrees.select("node", "degree", "shared"), "node", "left").na.fill(0, ["degree"]).na.fill(False, ["shared"])
    want = want.select("node", "component", *numbers, "degree", "shared")
    codes, real = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda nodes, edges: codes.append(dict(nodes.dtypes)["node"]) or real(nodes, edges))
    got = G.published_rings(h).select("node", "r_name", *[f"r_{c}" for c in numbers], "_degree", "_shared")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and codes == ["bigint"]
