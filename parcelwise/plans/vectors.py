"""The whole feature vector: as a table, explained, and read by the scoring stream."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.economics import price_orders
from ..functions.address import score_addresses
from ..functions.pincodes import with_pin_info
from ..operators import decide as D
from ..operators import graph as G
from ..operators import pit
from ..sources import lens
from ..streaming import jobs as J
from . import moments  # noqa: F401  (rings at a moment)
from .history import _velocity_ctes, features
from .learning import Q0, Q1, drained, event_stream
from .models import decided
from .registry import add
from .sql import again, best_action, cte, node, sql, strlist, values

# ------------------------------------------------------------------ C14, A19
_risk = "(SELECT * FROM (" + values(list(pit.CHANNEL_RISK.items())) + ") t(channel, risk))"
_VECTOR = {
    "gmv_log": "ln(1 + greatest(0, o.cart_gmv))", "items_count": "o.items_count", "weight_grams": "o.weight_grams", "pin_tier": "pins.tier", "pin_serviceability": "v.pin_serviceability",
    "pin_rto_rate": "v.pin_rto_rate", "pin_orders_log": "ln(1 + v.pin_orders)", "addr_defect_score": "a.defect", "addr_tokens": "a.tokens", "addr_has_house_no": "a.house",
    "addr_landmark_only": "a.landmark_only", "addr_state_mismatch": "a.state_mismatch", "addr_junk": "a.junk", "phone_orders_30d": "v.phone_orders_30d",
    "phone_orders_total_log": "ln(1 + v.phone_orders_total)", "phone_rto_rate": "v.phone_rto_rate", "phone_first_seen_days": "v.phone_first_seen_days",
    "phone_distinct_devices": "v.phone_distinct_devices", "device_distinct_phones": "v.device_distinct_phones", "device_orders_24h": "v.device_orders_24h",
    "device_rto_rate": "v.device_rto_rate", "addr_distinct_phones": "v.addr_distinct_phones", "addr_rto_rate": "v.addr_rto_rate",
    "pay_switch_from_failed": "upper(coalesce(o.payment_switch_from, '')) LIKE '%FAILED'", "is_cod": "upper(o.payment_method) = 'COD'", "channel_risk": "coalesce(c.risk, 0.22e0)",
    "coupon_applied": "o.coupon_applied", "checkout_seconds_log": "ln(1 + greatest(0, o.checkout_seconds))", "hour_sin": "sin(2 * pi() * (o.hour_of_day % 24) / 24e0)",
    "hour_cos": "cos(2 * pi() * (o.hour_of_day % 24) / 24e0)", "ring_size_log": "ln(1 + r.ring_size)", "ring_rto_rate": "r.ring_rto_rate", "ring_phones": "r.ring_phones",
    "ring_is_ring": "r.is_ring", "entity_max_degree": "r.entity_max_degree", "entity_shared": "r.entity_shared", "gmv_vs_pin_median": "o.cart_gmv / greatest(50, v.pin_gmv_mean)"}


def _vector_cte(name: str, source: str, vel: str, rings: str, flags: str) -> None:
    cte(name, f"""SELECT o.order_id, o.seq, v.phone_is_new, {', '.join(f'CAST({_VECTOR[n]} AS DOUBLE) AS {n}' for n in pit.FEATURE_NAMES)}
FROM {source} o JOIN {vel} v USING (seq) JOIN {rings} r USING (seq) JOIN pins ON pins.pin = o.delivery_pin JOIN {flags} a ON a.a = o.shipping_address AND a.pin = o.delivery_pin
 LEFT JOIN {_risk} c ON c.channel = upper(o.acquisition_channel)""", source, vel, rings, flags, "pins")


_vector_cte("vector", "lens", "v_vel", "h_seen_features", "addr_flags")


def _columns() -> list[Column]:
    return [(F.round(n, 9) + 0.0).alias(n) for n in pit.FEATURE_NAMES]


VECTOR_SQL = ", ".join(f"round({n}, 9) + 0e0 AS {n}" for n in pit.FEATURE_NAMES)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its feature vector; written by month and read back."""
    orders = pit.point_in_time_inputs(lens.orders(spark, sf_dir))
    made = pit.assemble_features(orders, pit.velocity(orders), G.ring_features(G.hashed_orders(orders)))
    clash = [c for c in made.columns if c in orders.columns and c != "seq"]
    full = orders.drop(*clash).join(made, "seq").withColumnRenamed("phone_is_new", "is_new_customer")
    path = J.run_folder(spark, "features")
    full.withColumn("order_month", F.date_format("ts", "yyyy-MM")).write.partitionBy("order_month").parquet(path)
    return spark.read.parquet(path)


add("c14_feature_vector", lambda s, d: features(s, d).select("order_id", *_columns()), sql(f"SELECT order_id, {VECTOR_SQL} FROM vector", "vector"))
add("a19_feature_table", lambda s, d: feature_table(s, d).select("order_id", F.col("order_month").cast("string").alias("order_month"), "phone", "merchant_id", "rto", "is_new_customer", *_columns()),
    sql(f"SELECT order_id, strftime(ts, '%Y-%m') AS order_month, phone, merchant_id, rto, phone_is_new AS is_new_customer, {VECTOR_SQL} FROM vector JOIN (SELECT seq, ts, phone, merchant_id, rto FROM lens) USING (seq)",
        "vector", "lens"))

# ------------------------------------------------------------------ G18, G19: a fixed linear score over the whole vector stands in for a fitted one
#: feature: weight, mean
LINEAR = {
    "gmv_log": (0.35, 7.0), "items_count": (0.05, 2.5), "weight_grams": (0.0002, 1400.0), "pin_tier": (0.25, 2.5), "pin_serviceability": (-1.5, 0.8), "pin_rto_rate": (1.2, 0.4),
    "pin_orders_log": (-0.05, 5.0), "addr_defect_score": (1.8, 0.5), "addr_tokens": (-0.02, 6.0), "addr_has_house_no": (-0.4, 0.5), "addr_landmark_only": (0.4, 0.2),
    "addr_state_mismatch": (0.5, 0.1), "addr_junk": (0.6, 0.2), "phone_orders_30d": (0.15, 0.3), "phone_orders_total_log": (-0.1, 1.5), "phone_rto_rate": (2.0, 0.4),
    "phone_first_seen_days": (-0.0006, 400.0), "phone_distinct_devices": (0.1, 1.0), "device_distinct_phones": (0.06, 4.0), "device_orders_24h": (0.3, 0.1), "device_rto_rate": (1.1, 0.4),
    "addr_distinct_phones": (0.05, 3.0), "addr_rto_rate": (0.9, 0.4), "pay_switch_from_failed": (0.7, 0.1), "is_cod": (0.1, 0.7), "channel_risk": (0.8, 0.25), "coupon_applied": (0.2, 0.33),
    "checkout_seconds_log": (-0.3, 4.5), "hour_sin": (0.5, 0.0), "hour_cos": (0.45, 0.0), "ring_size_log": (0.12, 2.0), "ring_rto_rate": (0.8, 0.3), "ring_phones": (0.03, 4.0),
    "ring_is_ring": (0.9, 0.2), "entity_max_degree": (0.002, 100.0), "entity_shared": (-0.2, 0.9), "gmv_vs_pin_median": (0.15, 1.0)}
WEIGHTS, MEANS = ({f: x[i] for f, x in LINEAR.items()} for i in (0, 1))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason codes of every order that meets friction; an allowed order needs none."""
    flagged = decided(spark, sf_dir).filter(F.col("action") != "ALLOW_COD").select("order_id", "action")
    return D.reason_codes(flagged.join(features(spark, sf_dir), "order_id"), D.linear_contributions(WEIGHTS, MEANS), ["order_id", "action"])


_codes = {f: code for f, code, _ in D.REASON_CODES}
_rank = {f: i for i, (f, _, _) in enumerate(D.REASON_CODES)}
cte("contrib", " UNION ALL ".join(f"SELECT order_id, action, '{_codes[f]}' AS code, '{f}' AS feature, {_rank[f]} AS i, {f} AS v, {float(w)!r}e0 * ({f} - {float(m)!r}e0) AS c FROM friction"
                                  for f, (w, m) in LINEAR.items()).replace("e-05e0", "e-05"), "friction")
cte("friction", "SELECT action, vector.* FROM vector JOIN (SELECT order_id, action FROM decided WHERE action <> 'ALLOW_COD') USING (order_id)", "vector", "decided")
add("g18_reason_codes", lambda s, d: explained(s, d).select("order_id", "rank", "code", "feature", "direction", "contribution"),
    sql("""SELECT order_id, rank, code, feature, CASE WHEN c > 0 THEN 'RISK_UP' ELSE 'RISK_DOWN' END AS direction, round(c, 4) AS contribution FROM (
 SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY abs(c) DESC, i) AS rank FROM (
  SELECT * FROM contrib WHERE abs(c) >= 0.05e0 QUALIFY row_number() OVER (PARTITION BY order_id, code ORDER BY abs(c) DESC, i) = 1)) WHERE rank <= 4""", "contrib"))
add("g19_explained_only_when_frictioned", lambda s, d: explained(s, d).groupBy("action").agg(F.countDistinct("order_id").alias("orders")),
    sql("SELECT action, count(DISTINCT order_id) AS orders FROM contrib WHERE abs(c) >= 0.05e0 GROUP BY 1", "contrib"))

# ------------------------------------------------------------------ J8: the stream reads its entities' state, scores, decides
PUBLISHED_AT = datetime(2024, 1, 16)
STREAM_KINDS = ("phone", "device", "addr")
SCORE = {"addr_defect_score": 1.8, "phone_rto_rate": 1.5, "phone_orders_30d": 0.02, "device_rto_rate": 1.1, "device_distinct_phones": 0.03, "device_orders_24h": 0.05, "addr_rto_rate": 0.4,
         "pin_rto_rate": 0.7, "phone_first_seen_days": -0.03, "ring_rto_rate": 0.8, "ring_is_ring": 0.4, "entity_max_degree": 0.004, "gmv_log": 0.1}
SCORE_AT_ZERO = -3.4


def stream_orders(ev: DataFrame) -> DataFrame:
    """Events as orders with everything that features and pricing read."""
    k = F.col("seq")
    texts, channels = (F.array(*[F.lit(x) for x in xs]) for xs in (lens.ADDRESS_TEXTS, lens.CHANNELS))
    group = F.floor(F.substring("user", 2, 20).cast("bigint") / 10).cast("bigint")
    return ev.select(
        F.concat(F.lit("e"), k).alias("order_id"), "seq", "ts", (F.col("event_type") == "error").alias("rto"), F.col("user").alias("phone"),
        F.concat("device", F.lit("-"), group).alias("device"), F.col("user").alias("addr"), F.lit("110001").alias("delivery_pin"), F.col("value").alias("cart_gmv"),
        texts[(k % 6).cast("int")].alias("shipping_address"), channels[(k % 8).cast("int")].alias("acquisition_channel"), (1 + k % 4).cast("int").alias("items_count"),
        (150 + (k * 37) % 2500).cast("double").alias("weight_grams"), F.lit("COD").alias("payment_method"), F.when(k % 11 == 0, "CARD_FAILED").alias("payment_switch_from"),
        (k % 3 == 0).alias("coupon_applied"), (10 + (k * 13) % 200).cast("double").alias("checkout_seconds"), ((k * 7) % 24).cast("int").alias("hour_of_day"),
        F.lit(0.18).alias("merchant_margin"), F.lit(300.0).alias("cac"))


def later(orders: DataFrame) -> DataFrame:
    """Outcomes, two hours after their orders."""
    return orders.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 7_200_000_000))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring numbers of every node as of `PUBLISHED_AT`."""
    orders = stream_orders(lens.event_orders(spark, sf_dir)).withColumn("outcome_ts", F.timestamp_micros(F.unix_micros("ts") + 7_200_000_000))
    return G.published_rings(G.snapshot(G.hashed_orders(orders, STREAM_KINDS), PUBLISHED_AT))


PAYLOAD = ("order_id", "ts", "phone", "device", "addr", "delivery_pin", "cart_gmv", "shipping_address", "acquisition_channel", "items_count", "weight_grams", "payment_method",
           "payment_switch_from", "coupon_applied", "checkout_seconds", "hour_of_day", "merchant_margin", "cac")


def scored_reads(rows: DataFrame, rings: DataFrame) -> DataFrame:
    """Decisions for the orders of a micro-batch and their entities' reads: the whole feature vector, score, price, action."""
    orders, counts = J.order_reads(rows)
    vel = pit.velocity_columns(with_pin_info(counts).withColumnsRenamed({"pin_serviceability_prior": "_serv", "pin_rto_prior": "_prior"}))
    hashed = G.hashed_orders(orders.withColumns({"outcome_ts": F.col("ts"), "rto": F.lit(None).cast("boolean")}), STREAM_KINDS)
    vector = pit.assemble_features(score_addresses(orders), vel, G.looked_up_rings(hashed, rings))
    z = F.lit(SCORE_AT_ZERO)
    for name, weight in SCORE.items():
        z = z + weight * F.col(name)
    # the vector brings the address's defects, whose patterns are slow to match
    scored = vector.withColumn("p", F.round(1.0 / (1.0 + F.exp(-z)), 6)).select("seq", "p", "addr_defect_score", F.col("phone_is_new").alias("is_new_customer"), *READ_BACK)
    priced = price_orders(orders.join(scored, "seq").withColumns({"in0": F.col("p") <= Q0, "in1": (1.0 - F.col("p")) <= Q1}))
    return D.resolve(priced).select("order_id", "seq", "p", "certainty", "action", *READ_BACK)


READ_BACK = ("phone_orders_30d", "phone_rto_rate", "phone_first_seen_days", "phone_distinct_devices", "device_orders_24h", "device_rto_rate", "addr_rto_rate", "pin_serviceability",
             "gmv_vs_pin_median", "ring_size_log", "ring_rto_rate", "ring_phones", "entity_max_degree")


def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and outcomes as one stream: state is read before an order is scored and written after."""
    rings = published(spark, sf_dir).withColumn("r_name", F.lit(None).cast("string")).persist()  # read by every micro-batch; its decisions name no ring
    try:
        with J.state_in_rocksdb(spark):
            placed = stream_orders(event_stream(spark, sf_dir))
            resolved = later(stream_orders(event_stream(spark, sf_dir)))
            events = J.read_events(placed, resolved, list(PAYLOAD))
            reads = J.with_orders(J.entity_reads_stream(events), events)
            out = drained(spark, "score", reads, "append", lambda path: J.scoring_sink(J.order_rows, lambda rows: scored_reads(rows, rings), path))
    finally:
        rings.unpersist()
    return spark.read.parquet(out).drop("batch_id")


cte("stream_lens", f"""SELECT 'e' || event_id AS order_id, event_id AS seq, ts, ts + INTERVAL 2 HOUR AS outcome_ts, event_type = 'error' AS rto, 'u' || user_id AS phone,
 'k' || json_extract_string(props, '$.k') || '-' || (user_id // 10) AS device, 'u' || user_id AS addr, '110001' AS delivery_pin, value AS cart_gmv, {strlist(lens.ADDRESS_TEXTS)}[event_id % 6 + 1] AS shipping_address,
 {strlist(lens.CHANNELS)}[event_id % 8 + 1] AS acquisition_channel, 1 + event_id % 4 AS items_count, CAST(150 + (event_id * 37) % 2500 AS DOUBLE) AS weight_grams, 'COD' AS payment_method,
 CASE WHEN event_id % 11 = 0 THEN 'CARD_FAILED' END AS payment_switch_from, event_id % 3 = 0 AS coupon_applied, CAST(10 + (event_id * 13) % 200 AS DOUBLE) AS checkout_seconds,
 (event_id * 7) % 24 AS hour_of_day, 0.18e0 AS merchant_margin, 300e0 AS cac FROM events""")
again("pins", "st_pins", "lens_raw", "stream_lens")
_velocity_ctes("stream_lens", "st_", "st_pins")
again("addr_flags", "st_flags0", "lens_raw", "stream_lens")
again("st_flags0", "st_flags", "pins", "st_pins")
cte("st_snap", "SELECT order_id, seq, ts, CASE WHEN outcome_ts <= TIMESTAMP '2024-01-16' THEN rto END AS rto, " + ", ".join(f"{node(k, k)} AS {k}" for k in STREAM_KINDS)
    + " FROM stream_lens WHERE ts <= TIMESTAMP '2024-01-16'", "stream_lens")
moments._hyperedges("st_", "st_snap", STREAM_KINDS)
cte("st_rows", " UNION ALL ".join(f"SELECT order_id, {k} AS node FROM st_snap WHERE {k} IS NOT NULL" for k in STREAM_KINDS), "st_snap")
cte("st_reach", """SELECT DISTINCT node, node AS c FROM st_rows UNION SELECT r.node, e.other FROM st_reach r JOIN
 (SELECT a AS node, b AS other FROM st_merge UNION ALL SELECT b, a FROM st_merge) e ON e.node = r.c""", "st_rows", "st_merge")
cte("st_comps", "SELECT node, min(c) AS component FROM st_reach GROUP BY 1", "st_reach")
cte("st_numbers", """SELECT *, phones >= 3 AND (phones / greatest(1, devices) >= 2.5 OR (phones / greatest(1, addrs) >= 2.5 AND rto + dl >= 5 AND rto / greatest(1, rto + dl) >= 0.45)) AS is_ring,
 CASE WHEN rto + dl > 0 THEN rto / CAST(rto + dl AS DOUBLE) ELSE 0e0 END AS rate
FROM (SELECT component, count(*) AS size, count(*) FILTER (node LIKE 'phone:%') AS phones, count(*) FILTER (node LIKE 'device:%') AS devices, count(*) FILTER (node LIKE 'addr:%') AS addrs FROM st_comps GROUP BY 1)
LEFT JOIN (SELECT component, count(*) FILTER (rto) AS rto, count(*) FILTER (NOT rto) AS dl FROM st_sets JOIN st_comps ON node = head GROUP BY 1) USING (component)""", "st_comps", "st_sets")
cte("st_degrees", """SELECT a.node, count(DISTINCT b.node) AS degree, count(DISTINCT b.node) FILTER (b.node LIKE 'phone:%') AS phones FROM st_rows a JOIN st_rows b ON a.order_id = b.order_id AND a.node <> b.node GROUP BY 1""", "st_rows")
_st_rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(G.ALL_KINDS))
cte("st_rings", f"""SELECT o.seq, CASE WHEN m[1] > 1 THEN m[1] ELSE 0 END AS ring_size, CASE WHEN m[1] > 1 THEN m[4] ELSE 0 END AS ring_phones, CASE WHEN m[1] > 1 THEN m[2] ELSE 0e0 END AS ring_rto_rate,
 coalesce(m[1] > 1 AND m[5], false) AS is_ring, coalesce(top, 0) AS entity_max_degree, coalesce(shared, false) AS entity_shared FROM stream_lens o LEFT JOIN (
 SELECT x.seq, max((size, rate, -(CASE split_part(node, ':', 1) {_st_rank} END), n.phones, is_ring)) AS m, max(degree) AS top, bool_or(node LIKE 'addr:%' AND (d.phones >= 25 OR degree >= 50)) AS shared
 FROM ({' UNION ALL '.join(f"SELECT seq, {node(k, k)} AS node FROM stream_lens" for k in STREAM_KINDS)}) x JOIN st_comps USING (node) JOIN st_numbers n USING (component) JOIN st_degrees d USING (node) GROUP BY 1) USING (seq)""",
    "stream_lens", "st_comps", "st_numbers", "st_degrees")
_vector_cte("st_vector0", "stream_lens", "st_vel", "st_rings", "st_flags")
again("st_vector0", "st_vector", "pins", "st_pins")
cte("st_scored", "SELECT o.*, v.addr_defect_score, v.phone_is_new AS is_new_customer, " + ", ".join(f"v.{n}" for n in READ_BACK)
    + f", round(1e0 / (1e0 + exp(-({SCORE_AT_ZERO}e0 + {' + '.join(f'{w}e0 * v.{n}' for n, w in SCORE.items())}))), 6) AS p FROM stream_lens o JOIN st_vector v USING (seq)", "stream_lens", "st_vector")
again("pr1", "st_pr1", "cod", "st_scored")
again("pr2", "st_pr2", "pr1", "st_pr1")
again("priced", "st_priced", "pr2", "st_pr2")
cte("st_decided", f"SELECT *, {best_action('0e0')} AS action FROM (SELECT *, CASE WHEN p <= {Q0}e0 AND (1e0 - p) <= {Q1}e0 THEN 'AMBIGUOUS' WHEN p <= {Q0}e0 THEN 'CERTIFIED_LOW' "
    f"WHEN (1e0 - p) <= {Q1}e0 THEN 'CERTIFIED_HIGH' ELSE 'NOVEL' END AS certainty FROM st_priced)", "st_priced")
add("j8_streamed_decisions", lambda s, d: streamed_decisions(s, d).select("order_id", "p", "certainty", "action", *[(F.round(c, 9) + 0.0).alias(c) for c in READ_BACK]),
    sql("SELECT order_id, p, certainty, action, " + ", ".join(f"round({c}, 9) + 0e0 AS {c}" for c in READ_BACK) + " FROM st_decided", "st_decided"))


# ------------------------------------------------------------------ J13: sixty days of order ids, off the heap
def unique_stream(spark: SparkSession, sf_dir: str, again_each: int = 10) -> DataFrame:
    """Events as orders, each `again_each`-th of them sent twice."""
    sent = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir).filter(F.col("seq") % again_each == 0))
    return J.unique_orders(sent.withColumn("order_id", F.concat(F.lit("e"), "seq")), horizon="60 days")


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that pass, distinct ids among them, and ids that the state holds for later repeats."""
    folder = J.run_folder(spark, "unique")
    with J.state_in_rocksdb(spark):
        query = J.start(unique_stream(spark, sf_dir).select("order_id"), J.batch_folder_sink(f"{folder}/out"), f"{folder}/ckpt")
        query.awaitTermination()
    held = J.state_rows(query)
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("orders"), F.countDistinct("order_id").alias("order_ids")).withColumn("ids_held", F.lit(held).cast("bigint"))


add("j13_duplicates_suppressed", suppressed,
    "SELECT count(DISTINCT event_id) AS orders, count(DISTINCT event_id) AS order_ids, count(DISTINCT event_id) AS ids_held FROM events")
