"""Point-in-time features: what was known about an order's phone, device, address and PIN just before it.

Orders, outcomes, first links and look-back probes form one event log keyed by (entity kind, entity). One
running aggregation over that log yields every velocity feature of every entity kind at once.

Position of an event: (ts, kind, seq, sub). Orders (kind 0) come before outcomes (kind 1) of the same
instant, so an outcome counts only for strictly later orders. A probe (kind -1) stands before every order
of its instant; it counts the orders older than the look-back.
"""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_SECONDS, HOT_KEY_ROWS
from ..functions.address import score_addresses
from ..functions.text import clip
from .running import hot_keys, running_by_key, running_in_ranges

# Caps, priors and pseudo-counts of the velocity features.
RECENT_CAP = 40
PHONE_WINDOW_SECONDS = 30 * DAY_SECONDS
DEVICE_WINDOW_SECONDS = DAY_SECONDS
TENURE_CAP_DAYS = 730.0
GLOBAL_RTO_PRIOR = 0.22
K_ENTITY = 3.0
K_PIN = 25.0
DEFAULT_PIN_GMV = 900.0
MIN_PIN_GMV = 50.0

# Prior RTO lift of an acquisition channel.
CHANNEL_RISK = {
    "ORGANIC": 0.15, "DIRECT": 0.14, "WHATSAPP": 0.20, "GOOGLE_ADS": 0.22, "MARKETPLACE": 0.25,
    "META_ADS": 0.30, "INFLUENCER": 0.32, "AFFILIATE": 0.38,
}
DEFAULT_CHANNEL_RISK = 0.22

# The feature vector, in model order.
FEATURE_NAMES = (
    "gmv_log", "items_count", "weight_grams",
    "pin_tier", "pin_serviceability", "pin_rto_rate", "pin_orders_log",
    "addr_defect_score", "addr_tokens", "addr_has_house_no", "addr_landmark_only",
    "addr_state_mismatch", "addr_junk",
    "phone_orders_30d", "phone_orders_total_log", "phone_rto_rate", "phone_first_seen_days",
    "phone_distinct_devices",
    "device_distinct_phones", "device_orders_24h", "device_rto_rate",
    "addr_distinct_phones", "addr_rto_rate",
    "pay_switch_from_failed", "is_cod", "channel_risk", "coupon_applied", "checkout_seconds_log",
    "hour_sin", "hour_cos",
    "ring_size_log", "ring_rto_rate", "ring_phones", "ring_is_ring", "entity_max_degree", "entity_shared",
    "gmv_vs_pin_median",
)

POSITION = ["ts", "kind", "seq", "sub"]
_COUNTS = ("n", "gmv", "rto", "delivered", "links")
# columns of a log row beside its key and position; a row leaves what it does not carry NULL
_OWN = {"n": "int", "gmv": "double", "rto": "int", "delivered": "int", "links": "int", "order_id": "string",
        "at": "timestamp", "serviceability": "double", "prior": "double", "asked": "boolean"}
# those that a row of `entity_rows` brings along
_CARRIED = {c: _OWN[c] for c in ("order_id", "gmv", "serviceability", "prior")}


def smoothed_rate(rto: Column, delivered: Column, prior: Column | float, k: float) -> Column:
    prior = F.lit(prior) if isinstance(prior, float) else prior
    return (rto + prior * k) / (rto + delivered + k)


def event_log(orders: DataFrame, cutoff: datetime | None = None) -> DataFrame:
    """Orders and outcomes as one stream of (ts, kind, seq); events after the cut-off are unseen."""
    placed = orders.select("order_id", "seq", "ts", F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("rto"))
    resolved = orders.select("order_id", "seq", F.col("outcome_ts").alias("ts"), F.lit(1).alias("kind"), "rto")
    log = placed.unionByName(resolved)
    return log if cutoff is None else log.filter(F.col("ts") <= F.lit(cutoff))


def entity_rows(orders: DataFrame, of: Column | None = None) -> DataFrame:
    """A row for each order and entity kind: all that the entity's log says of the order. `of`: the orders whose features are asked for."""
    def row(entity: str, key: str, other: str | None = None, **own: Column) -> Column:
        return F.struct(F.lit(entity).alias("entity"), F.coalesce(F.col(key), F.lit("")).alias("key"),
                        (F.coalesce(F.col(other), F.lit("")) if other else F.lit(None).cast("string")).alias("other"),
                        *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in _CARRIED.items()])

    rows = [row("phone", "phone", "device", order_id=F.col("order_id")), row("device", "device", "phone"), row("addr", "addr", "phone"),
            row("pin", "delivery_pin", gmv=F.col("cart_gmv"), serviceability=F.col("pin_serviceability_prior"), prior=F.col("pin_rto_prior"))]
    return orders.select("seq", "ts", "outcome_ts", "rto", (F.lit(True) if of is None else F.coalesce(of, F.lit(False))).alias("asked"),
                         F.inline(F.array(*rows)))


def entity_log(rows: DataFrame, cutoff: datetime | None = None, *, together: bool = False) -> DataFrame:
    """The event log per entity: order, outcome, probe and first-link rows made of `entity_rows`.

    With `together`, a key's rows lie in one task already and the first of each pair is told there; else pairs are aggregated on their own.
    """
    def event(ts: Column, kind: int, sub: int = 0, **own: Column) -> Column:
        return F.struct(ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in _OWN.items()])

    one, phone, device = F.lit(1), F.col("entity") == "phone", F.col("entity") == "device"
    back = F.when(phone, PHONE_WINDOW_SECONDS * 1_000_000).when(device, DEVICE_WINDOW_SECONDS * 1_000_000)
    first = event(F.col("ts"), 0, 1, links=one)
    events = [event(F.col("ts"), 0, n=one, asked=F.col("asked"), at=F.when(phone, F.col("ts")), **{c: F.col(c) for c in _CARRIED}),
              event(F.col("outcome_ts"), 1, rto=F.col("rto").cast("int"), delivered=(~F.col("rto")).cast("int")),
              F.when(F.col("asked") & (phone | device), event(F.timestamp_micros(F.unix_micros("ts") - back), -1, asked=F.col("asked")))]
    if together:
        turn = F.row_number().over(Window.partitionBy("entity", "key", "other").orderBy("ts", "seq"))
        rows = rows.withColumn("_turn", turn)
        events.append(F.when(F.col("other").isNotNull() & (F.col("_turn") == 1), first))
    log = rows.select("entity", "key", "seq", F.inline(F.array(*events))).filter(F.col("kind").isNotNull())  # an absent event is all NULL
    if not together:
        pairs = rows.filter(F.col("other").isNotNull()).groupBy("entity", "key", "other").agg(F.min(F.struct("ts", "seq")).alias("f"))
        log = log.unionByName(pairs.select("entity", "key", "f.seq", "f.ts").select("entity", "key", "seq", F.inline(F.array(first))))
    # an outcome after the cut-off has not been seen; orders after it were left out by the caller
    return log if cutoff is None else log.filter((F.col("kind") < 1) | (F.col("ts") <= F.lit(cutoff)))


def key_sizes(orders: DataFrame) -> DataFrame:
    """Orders per (entity, key): what decides which keys are cut into ranges."""
    keys = F.array(*[F.struct(F.lit(e).alias("entity"), F.coalesce(F.col(c), F.lit("")).alias("key"))
                     for e, c in (("phone", "phone"), ("device", "device"), ("addr", "addr"), ("pin", "delivery_pin"))])
    return orders.select(F.inline(keys)).groupBy("entity", "key").count()


def velocity(orders: DataFrame, *, cutoff: datetime | None = None, hot_rows: int = HOT_KEY_ROWS, of: Column | None = None) -> DataFrame:
    """Velocity features of every order, one row per order; with `of`, of the orders it marks, among all orders.

    Needs order_id, seq, ts, outcome_ts, rto, phone, device, addr, delivery_pin and cart_gmv, and the
    PIN priors of `with_pin_info`. With a cut-off, later orders are left out and later outcomes unseen.
    """
    if cutoff is not None:
        orders = orders.filter(F.col("ts") <= F.lit(cutoff))
    aggs = {f"_{c}": ("sum", F.col(c)) for c in _COUNTS}
    aggs["_first"] = ("min", F.when(F.col("n") == 1, F.col("ts")))
    keys, rows, hot = ["entity", "key"], entity_rows(orders, of), hot_keys(key_sizes(orders), hot_rows)
    # an order's row goes to its entity once and becomes events there; a hot key's events are cut into ranges instead
    plain = rows if hot is None else rows.join(F.broadcast(hot), keys, "left_anti")
    seen = running_by_key(entity_log(plain.repartition(*keys), cutoff, together=True), keys, POSITION, aggs, hot=None)
    if hot is not None:
        seen = seen.unionByName(running_in_ranges(entity_log(rows.join(F.broadcast(hot), keys, "left_semi"), cutoff), keys, POSITION, aggs))
    reads = seen.filter("asked and ((kind = 0 and sub = 0) or kind = -1)")

    def at(entity: str, col: str, kind: int = 0) -> Column:
        return F.max(F.when((F.col("entity") == entity) & (F.col("kind") == kind), F.col(col)))

    wide = reads.groupBy("seq").agg(
        F.max("order_id").alias("order_id"), F.max("at").alias("ts"),
        F.max("serviceability").alias("_serv"), F.max("prior").alias("_prior"),
        at("phone", "_n").alias("phone_orders_total"),
        (at("phone", "_n") - at("phone", "_n", -1)).alias("_phone_recent"),
        at("phone", "_rto").alias("_phone_rto"), at("phone", "_delivered").alias("_phone_del"),
        at("phone", "_first").alias("_phone_first"), at("phone", "_links").alias("phone_distinct_devices"),
        (at("device", "_n") - at("device", "_n", -1)).alias("_device_recent"),
        at("device", "_rto").alias("_device_rto"), at("device", "_delivered").alias("_device_del"),
        at("device", "_links").alias("device_distinct_phones"),
        at("addr", "_rto").alias("_addr_rto"), at("addr", "_delivered").alias("_addr_del"),
        at("addr", "_links").alias("addr_distinct_phones"),
        at("pin", "_n").alias("pin_orders"), at("pin", "_gmv").alias("_pin_gmv"),
        at("pin", "_rto").alias("_pin_rto"), at("pin", "_delivered").alias("_pin_del"),
    )
    return velocity_columns(wide)


def velocity_columns(wide: DataFrame) -> DataFrame:
    """Velocity features from the counts that an order's entities had just before it, one row per order."""
    rate = {e: smoothed_rate(F.col(f"_{e}_rto"), F.col(f"_{e}_del"), GLOBAL_RTO_PRIOR, K_ENTITY)
            for e in ("phone", "device", "addr")}
    attempts = F.col("_pin_rto") + F.col("_pin_del")
    tenure = (F.unix_micros("ts") - F.unix_micros("_phone_first")) / F.lit(1e6 * DAY_SECONDS)
    return wide.select(
        "order_id", "seq", "ts",
        F.least(F.lit(RECENT_CAP), "_phone_recent").cast("bigint").alias("phone_orders_30d"),
        "phone_orders_total", rate["phone"].alias("phone_rto_rate"),
        F.coalesce(clip(tenure, 0.0, TENURE_CAP_DAYS), F.lit(0.0)).alias("phone_first_seen_days"),
        "phone_distinct_devices", (F.col("phone_orders_total") == 0).alias("phone_is_new"),
        "device_distinct_phones",
        F.least(F.lit(RECENT_CAP), "_device_recent").cast("bigint").alias("device_orders_24h"),
        rate["device"].alias("device_rto_rate"), "addr_distinct_phones", rate["addr"].alias("addr_rto_rate"),
        smoothed_rate(F.col("_pin_rto"), F.col("_pin_del"), F.col("_prior"), K_PIN).alias("pin_rto_rate"),
        F.when(attempts > 0, (F.col("_pin_del") + F.col("_serv") * K_PIN) / (attempts + K_PIN))
        .otherwise(F.col("_serv")).alias("pin_serviceability"),
        "pin_orders",
        F.when(F.col("pin_orders") > 0, F.col("_pin_gmv") / F.col("pin_orders")).otherwise(DEFAULT_PIN_GMV)
        .alias("pin_gmv_mean"),
    )


def log1p_floor(c: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), c.cast("double")))


def payment_fallback(switched_from: Column) -> Column:
    sw = F.upper(F.coalesce(switched_from, F.lit("")))
    return sw.endswith("FAILED") | sw.isin("CARD", "UPI", "NETBANKING")


def channel_risk(channel: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CHANNEL_RISK.items() for x in kv])
    return F.coalesce(table[F.upper(channel)], F.lit(DEFAULT_CHANNEL_RISK))


def hour_angle(hour: Column) -> Column:
    return 2 * F.pi() * F.pmod(hour, F.lit(24)) / 24.0


def basket_vs_locality(gmv: Column, pin_mean: Column) -> Column:
    return gmv / F.greatest(F.lit(MIN_PIN_GMV), pin_mean)


def assemble_features(orders: DataFrame, vel: DataFrame, rings: DataFrame) -> DataFrame:
    """The feature vector, one double column per name, keyed by order_id and seq.

    `orders` carries the address columns, `vel` the velocity columns, `rings` the published ring columns.
    """
    flag = lambda c: F.col(c).cast("double")
    o = orders.drop("pin_serviceability", "pin_rto_rate")
    j = o.join(vel.drop("order_id", "ts"), "seq").join(rings.drop("order_id", "ts"), "seq")
    exprs = {
        "gmv_log": log1p_floor(F.col("cart_gmv")), "items_count": flag("items_count"), "weight_grams": flag("weight_grams"),
        "pin_tier": flag("pin_tier"), "pin_serviceability": F.col("pin_serviceability"), "pin_rto_rate": F.col("pin_rto_rate"),
        "pin_orders_log": log1p_floor(F.col("pin_orders")),
        "phone_orders_total_log": log1p_floor(F.col("phone_orders_total")),
        "pay_switch_from_failed": payment_fallback(F.col("payment_switch_from")).cast("double"),
        "is_cod": (F.upper("payment_method") == "COD").cast("double"),
        "channel_risk": channel_risk(F.col("acquisition_channel")),
        "checkout_seconds_log": log1p_floor(F.col("checkout_seconds")),
        "hour_sin": F.sin(hour_angle(F.col("hour_of_day"))), "hour_cos": F.cos(hour_angle(F.col("hour_of_day"))),
        "ring_size_log": log1p_floor(F.col("ring_size")), "ring_is_ring": flag("is_ring"),
        "gmv_vs_pin_median": basket_vs_locality(F.col("cart_gmv"), F.col("pin_gmv_mean")),
    }
    out = j.select("order_id", "seq", "ts", *[exprs.get(n, flag(n)).alias(n) for n in FEATURE_NAMES], "phone_is_new")
    check_features(out)
    return out


def check_features(df: DataFrame) -> None:
    got = tuple(c for c in df.columns if c in set(FEATURE_NAMES))
    if got != FEATURE_NAMES:
        raise ValueError(f"feature columns differ from the model's list: {got}")


def point_in_time_inputs(orders: DataFrame) -> DataFrame:
    """Orders with address, PIN and entity columns ready for `velocity`."""
    return score_addresses(orders)
