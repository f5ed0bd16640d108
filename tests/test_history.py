import random
from datetime import timedelta

import pytest
from order_rows import make_orders
from replay import ring_features, velocity as slow_velocity

from parcelwise.functions.pincodes import with_pin_info
from parcelwise.operators import graph, pit, training
from parcelwise.operators.running import hot_keys, running, running_by_key, with_position
from pyspark.sql import functions as F


def crowd(n, seed, phones=25, hostel=True):
    """Households, a ring on two handsets, a hostel address and a shared network."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        p = rng.randrange(phones)
        ring = p % 5 == 0
        device = f"ringdev{p % 2}" if ring else f"own{p}"
        if rng.random() < 0.1:
            device = f"own{rng.randrange(phones)}"
        addr = "hostel" if hostel and rng.random() < 0.4 else f"home{p // 2}"
        rows.append((f"ph{p}", device, addr, "payout" if ring and rng.random() < 0.3 else None, f"net{p % 3}", rng.random() < (0.8 if ring else 0.2)))
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 8])
def test_velocity_equals_replay(spark, hot_rows):
    orders = make_orders(spark, crowd(120, 3))
    got = {r["seq"]: r for r in pit.velocity(with_pin_info(orders), hot_rows=hot_rows).collect()}
    want = slow_velocity([r.asDict() for r in orders.collect()], 0.965, 0.14)
    assert len(got) == 120
    for seq, w in want.items():
        g = got[seq]
        assert (g["phone_orders_total"], g["phone_orders_30d"], g["device_orders_24h"]) == (w["total"], w["recent"], w["device_recent"])
        assert (g["phone_distinct_devices"], g["device_distinct_phones"], g["addr_distinct_phones"]) == (w["devices"], w["phones_device"], w["phones_addr"])
        for a, b in (("phone_rto_rate", "phone_rate"), ("device_rto_rate", "device_rate"), ("addr_rto_rate", "addr_rate"), ("pin_rto_rate", "delivery_pin_rate"),
                     ("phone_first_seen_days", "tenure"), ("pin_gmv_mean", "pin_mean"), ("pin_serviceability", "serviceability")):
            assert g[a] == pytest.approx(w[b])
        assert g["phone_is_new"] == (w["total"] == 0)


def test_recent_count_saturates_at_forty(spark):
    orders = make_orders(spark, [("p", "d", "a", None, None, False)] * 50, step=timedelta(minutes=5))
    got = {r["seq"]: r for r in pit.velocity(with_pin_info(orders)).collect()}
    assert got[39]["phone_orders_30d"] == 39 and got[49]["phone_orders_30d"] == 40 and got[49]["phone_orders_total"] == 49


def test_outcome_of_the_same_instant_is_invisible(spark):
    orders = make_orders(spark, [("p", "d", "a", None, None, True), ("p", "d", "a", None, None, True)], step=timedelta(days=2), lag=timedelta(days=2))
    got = {r["seq"]: r for r in pit.velocity(with_pin_info(orders)).collect()}
    assert got[1]["phone_rto_rate"] == pytest.approx(0.22)


@pytest.mark.parametrize("published,guard,hot_rows", [(True, True, 1_000_000), (False, True, 10), (True, False, 10)])
def test_ring_features_equal_replay(spark, published, guard, hot_rows):
    orders = make_orders(spark, crowd(90, 11))
    rows = [r.asDict() for r in orders.collect()]
    got = {r["seq"]: (r["ring_size"], r["ring_phones"], round(r["ring_rto_rate"], 9), r["is_ring"], r["entity_max_degree"], r["entity_shared"])
           for r in graph.ring_features(graph.hashed_orders(orders), published=published, guard=guard, hot_rows=hot_rows).collect()}
    assert got == ring_features(rows, published=published, guard=guard)


def holes(orders, seed):
    """The same orders with identifiers missing at random, and a card on some."""
    gone = lambda i, share: F.pmod(F.xxhash64(F.lit(seed + i), "seq"), F.lit(100)) < share
    return orders.withColumns({**{c: F.when(~gone(i, share), F.col(c)) for i, (c, share) in enumerate((("phone", 45), ("device", 50), ("addr", 45), ("ip", 40)))},
                               "card": F.when(gone(9, 30), F.concat(F.lit("c"), F.col("seq") % 7))})


@pytest.mark.parametrize("published,guard,hot_rows,seed", [(True, True, 1_000_000, 1), (False, True, 10, 2), (False, False, 1_000_000, 3)])
def test_rings_without_phones_equal_replay(spark, published, guard, hot_rows, seed):
    orders = holes(make_orders(spark, crowd(110, 5 + seed)), seed)
    rows = [r.asDict() for r in orders.collect()]
    assert any(not any(r[k] for k in ("phone", "device", "addr", "vpa", "card")) for r in rows)
    hashed = graph.hashed_orders(orders, graph.ALL_KINDS)
    got = {r["seq"]: (r["ring_size"], r["ring_phones"], round(r["ring_rto_rate"], 9), r["is_ring"], r["entity_max_degree"], r["entity_shared"])
           for r in graph.ring_features(hashed, published=published, guard=guard, hot_rows=hot_rows).collect()}
    assert got == ring_features(rows, published=published, guard=guard)


def test_new_phone_on_a_ring_device_sees_the_ring_first(spark):
    rows = [(f"b{i}", "dev", "drop", None, None, True) for i in range(6)] + [("new", "dev", "fresh", None, None, False)]
    last = [r for r in graph.ring_features(graph.hashed_orders(make_orders(spark, rows))).collect() if r["seq"] == 6][0]
    assert last["is_ring"] and last["ring_phones"] == 6 and last["entity_max_degree"] >= 6


def test_feature_vector_is_complete(spark):
    o = make_orders(spark, crowd(12, 1)).withColumns({
        "shipping_address": F.lit("12 MG Road Bengaluru"), "items_count": F.lit(1), "weight_grams": F.lit(450.0), "payment_method": F.lit("COD"),
        "payment_switch_from": F.lit(None).cast("string"), "acquisition_channel": F.lit("ORGANIC"), "coupon_applied": F.lit(False),
        "checkout_seconds": F.lit(60.0), "hour_of_day": F.lit(14)})
    o = pit.point_in_time_inputs(o)
    f = pit.assemble_features(o, pit.velocity(o), graph.ring_features(graph.hashed_orders(o)))
    rows = f.collect()
    assert len(pit.FEATURE_NAMES) == 37 and len(rows) == 12
    assert all(r[n] is not None and r[n] == r[n] for r in rows for n in pit.FEATURE_NAMES)


def test_running_aggregates_agree_with_and_without_blocks(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 37 % 5000).alias("ts"), "id")
    aggs = {"s": ("sum", F.col("id")), "lo": ("min", F.col("id")), "hi": ("max", F.col("id"))}
    key = lambda d: {r["id"]: (r["s"], r["lo"], r["hi"]) for r in d.collect()}
    plain = key(running_by_key(df, ["k"], ["ts", "id"], aggs, hot=None))
    split = key(running_by_key(df, ["k"], ["ts", "id"], aggs, hot=hot_keys(df.groupBy("k").count(), 100)))
    whole = key(running(df, ["k"], ["ts", "id"], aggs, block=F.floor(F.unix_seconds("ts") / 600)))
    assert plain == split == whole


def test_position_is_a_global_row_number(spark):
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7919 % 1000 * 3600).alias("ts"), "id")
    got = sorted((r["ts"], r["id"], r["position"]) for r in with_position(df, ["ts", "id"]).collect())
    assert [g[2] for g in got] == list(range(500))


def test_hot_keys_are_told_apart_without_sorting_their_rows(spark):
    """A key's rows in one sorting task are what the ranges are there to avoid."""
    from parcelwise.operators.running import hot_keys, running_by_key

    rows = spark.range(300).selectExpr("id % 3 = 0 AS k", "id")
    hot = hot_keys(rows.groupBy("k").count(), 150)
    former = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the list's estimate is large
    try:
        seen = running_by_key(rows, ["k"], ["id"], {"n": ("sum", F.lit(1))}, hot=hot)
        plan = seen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", former)
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftAnti" in line]
    assert sorted(r["n"] for r in seen.filter("k").collect()) == list(range(100))


def test_asked_orders_have_the_features_they_have_among_all(spark):
    orders = make_orders(spark, crowd(60, 5)).withColumn("odd", F.col("seq") % 2 == 1)
    full, asked = with_pin_info(orders), F.col("odd")
    for hot_rows in (1_000_000, 8):
        want = {tuple(r) for r in pit.velocity(full, hot_rows=hot_rows).filter("seq % 2 = 1").collect()}
        assert want and {tuple(r) for r in pit.velocity(full, hot_rows=hot_rows, of=asked).collect()} == want
    for published in (True, False):
        want = {tuple(r) for r in graph.ring_features(graph.hashed_orders(orders), published=published).filter("seq % 2 = 1").collect()}
        assert want and {tuple(r) for r in graph.ring_features(graph.hashed_orders(orders, of=asked), published=published).collect()} == want


def test_an_order_goes_to_each_of_its_entities_once(spark):
    plan = pit.velocity(with_pin_info(make_orders(spark, crowd(20, 5))))._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 2 and sum("entity" in m for m in moves) == 1 and not any("other" in m for m in moves)


def test_candidates_are_scored_once(spark):
    rows = [(f"o{i}", ["train", "train", "train", "valid", "calib", "conf", "test"][i % 7], i % 3 == 0, float(i % 11), 1, 500.0, 0.2) for i in range(210)]
    data = spark.createDataFrame(rows, "order_id string, split string, rto boolean, x double, pin_tier int, weight_grams double, addr_defect_score double")
    _, scored, _ = training.candidate(data, ["x"], 0.0, max_trees=2, depth=2)
    assert "UDF" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {"p", "split", "pin_tier", "weight_grams", "addr_defect_score"} <= set(scored.columns) and "x" not in scored.columns
    assert {r["split"] for r in scored.select("split").distinct().collect()} == {"valid", "conf", "test"}
