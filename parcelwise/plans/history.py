"""Queries on point-in-time features."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.pincodes import with_pin_info
from ..operators import graph, pit
from ..sources import lens
from .registry import add, made
from .sql import cte, sql

CUTOFF = datetime(1998, 6, 30)


def velocity(spark: SparkSession, sf_dir: str, cutoff: datetime | None = None) -> DataFrame:
    return pit.velocity(with_pin_info(lens.orders(spark, sf_dir)), cutoff=cutoff)


def events_as_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an order of its user that resolves two hours later; users reach the 40-order cap."""
    e = lens.event_orders(spark, sf_dir)
    return e.select(F.concat(F.lit("e"), "seq").alias("order_id"), "seq", "ts",
                    F.timestamp_micros(F.unix_micros("ts") + 7_200_000_000).alias("outcome_ts"), (F.col("event_type") == "error").alias("rto"),
                    F.col("user").alias("phone"), "device", F.col("user").alias("addr"), F.lit("110001").alias("delivery_pin"),
                    F.col("value").alias("cart_gmv"))


def _velocity_ctes(source: str, prefix: str, pins: str) -> tuple[str, ...]:
    """The velocity features of a table of orders, entity by entity."""
    cte(f"{prefix}log", f"""SELECT order_id, seq, ts, 0 AS kind, rto, phone, device, addr, delivery_pin, cart_gmv FROM {source}
 UNION ALL SELECT order_id, seq, outcome_ts, 1, rto, phone, device, addr, delivery_pin, cart_gmv FROM {source}""", source)
    frame = "ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def entity(col: str, back: str | None, pair: str | None) -> str:
        flag = f"kind = 0 AND row_number() OVER (PARTITION BY {col}, {pair}, kind ORDER BY ts, seq) = 1" if pair else "false"
        recent = (f"coalesce(len(list_filter(list(ts) OVER (PARTITION BY {col}, kind ORDER BY ts, seq ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), "
                  f"lambda t: t >= ts - {back})), 0)") if back else "0"
        return f"""SELECT seq, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(dl, 0) AS dl, coalesce(links, 0) AS links, coalesce(g, 0) AS g, first_ts, recent, ts
 FROM (SELECT *, count(*) FILTER (kind = 0) OVER w AS n, count(*) FILTER (kind = 1 AND rto) OVER w AS r, count(*) FILTER (kind = 1 AND NOT rto) OVER w AS dl,
   count(*) FILTER (fresh) OVER w AS links, sum(CASE WHEN kind = 0 THEN cart_gmv ELSE 0 END) OVER w AS g, min(ts) FILTER (kind = 0) OVER w AS first_ts
  FROM (SELECT *, {flag} AS fresh, {recent} AS recent FROM {prefix}log) WINDOW w AS (PARTITION BY {col} {frame})) WHERE kind = 0"""

    cte(f"{prefix}ph", entity("phone", "INTERVAL 30 DAY", "device"), f"{prefix}log")
    cte(f"{prefix}dv", entity("device", "INTERVAL 24 HOUR", "phone"), f"{prefix}log")
    cte(f"{prefix}ad", entity("addr", None, "phone"), f"{prefix}log")
    cte(f"{prefix}pn", entity("delivery_pin", None, None), f"{prefix}log")
    rate = lambda a: f"({a}.r + 0.22e0 * 3) / ({a}.r + {a}.dl + 3)"
    cte(f"{prefix}vel", f"""SELECT o.order_id, o.seq, ph.recent AS phone_orders_30d, ph.n AS phone_orders_total, {rate('ph')} AS phone_rto_rate,
 coalesce(least(730e0, greatest(0e0, (epoch_us(ph.ts) - epoch_us(ph.first_ts)) / 86400000000e0)), 0e0) AS phone_first_seen_days, ph.links AS phone_distinct_devices, ph.n = 0 AS phone_is_new,
 dv.links AS device_distinct_phones, dv.recent AS device_orders_24h, {rate('dv')} AS device_rto_rate, ad.links AS addr_distinct_phones, {rate('ad')} AS addr_rto_rate,
 (pn.r + rtop * 25) / (pn.r + pn.dl + 25) AS pin_rto_rate, CASE WHEN pn.r + pn.dl > 0 THEN (pn.dl + serv * 25) / (pn.r + pn.dl + 25) ELSE serv END AS pin_serviceability,
 pn.n AS pin_orders, CASE WHEN pn.n > 0 THEN pn.g / pn.n ELSE 900e0 END AS pin_gmv_mean
FROM {source} o JOIN {prefix}ph ph USING (seq) JOIN {prefix}dv dv USING (seq) JOIN {prefix}ad ad USING (seq) JOIN {prefix}pn pn USING (seq) JOIN {pins} ON pin = o.delivery_pin""",
        source, pins, *[f"{prefix}{x}" for x in ("ph", "dv", "ad", "pn")])
    return (f"{prefix}vel",)


_velocity_ctes("lens", "v_", "pins")
cte("early", "SELECT * FROM lens WHERE ts <= TIMESTAMP '1998-06-30'", "lens")
cte("seen_log", """SELECT order_id, seq, ts, 0 AS kind, CAST(NULL AS BOOLEAN) AS rto FROM lens UNION ALL SELECT order_id, seq, outcome_ts, 1, rto FROM lens""", "lens")
cte("event_lens", """SELECT 'e' || event_id AS order_id, event_id AS seq, ts, ts + INTERVAL 2 HOUR AS outcome_ts, event_type = 'error' AS rto, 'u' || user_id AS phone,
 'k' || json_extract_string(props, '$.k') AS device, 'u' || user_id AS addr, '110001' AS delivery_pin, value AS cart_gmv FROM events""")
_velocity_ctes("event_lens", "e_", "pins")


def on_velocity(name: str, columns, oracle: str, source=velocity, table: str = "v_vel") -> None:
    add(name, lambda s, d: source(s, d).select("order_id", *made(columns)), sql(f"SELECT order_id, {oracle} FROM {table}", table))


def _r(*cols: str):
    return lambda: [F.round(c, 12).alias(c) for c in cols]


def _rq(*cols: str) -> str:
    return ", ".join(f"round({c}, 12) AS {c}" for c in cols)


add("c1_event_log", lambda s, d: pit.event_log(lens.orders(s, d)).select("order_id", "kind", F.round(text.epoch_seconds(F.col("ts")), 3).alias("at"), "rto"),
    sql("SELECT order_id, kind, round(epoch(ts), 3) AS at, rto FROM seen_log", "seen_log"))
on_velocity("c2_orders_before", ["phone_orders_total", "pin_orders"], "phone_orders_total, pin_orders")
on_velocity("c3_phone_orders_30d", ["phone_orders_30d"], "phone_orders_30d")
on_velocity("c3_phone_orders_30d_at_cap", ["phone_orders_30d", "device_orders_24h", "device_distinct_phones"], "phone_orders_30d, device_orders_24h, device_distinct_phones",
            lambda s, d: pit.velocity(with_pin_info(events_as_orders(s, d))), "e_vel")
on_velocity("c4_device_orders_24h", ["device_orders_24h"], "device_orders_24h")
on_velocity("c5_tenure_days", _r("phone_first_seen_days"), _rq("phone_first_seen_days"))
on_velocity("c6_is_new", ["phone_is_new"], "phone_is_new")
on_velocity("c7_devices_per_phone", ["phone_distinct_devices"], "phone_distinct_devices")
on_velocity("c8_phones_per_device", ["device_distinct_phones"], "device_distinct_phones")
on_velocity("c9_phones_per_address", ["addr_distinct_phones"], "addr_distinct_phones")
on_velocity("c10_resolved_rates", _r("phone_rto_rate", "device_rto_rate", "addr_rto_rate", "pin_rto_rate"),
            _rq("phone_rto_rate", "device_rto_rate", "addr_rto_rate", "pin_rto_rate"))
on_velocity("c11_pin_serviceability", _r("pin_serviceability"), _rq("pin_serviceability"))
# mean times count: a sum of two-decimal amounts has no rounding ties
on_velocity("c12_pin_mean_basket", lambda: ["pin_orders", F.round(F.col("pin_gmv_mean") * F.greatest(F.lit(1), "pin_orders"), 2).alias("pin_gmv")],
            "pin_orders, round(pin_gmv_mean * greatest(1, pin_orders), 2) AS pin_gmv")
# an outcome after the cut-off cannot change an order before it, so the features of early orders stay the same
add("c13_as_of_cutoff", lambda s, d: velocity(s, d, CUTOFF).select("order_id", "phone_orders_total", *_r("phone_rto_rate", "pin_rto_rate")()),
    sql("SELECT order_id, phone_orders_total, " + _rq("phone_rto_rate", "pin_rto_rate") + " FROM v_vel WHERE seq IN (SELECT seq FROM early)", "v_vel", "early"))


def features(spark: SparkSession, sf_dir: str, of: Column | None = None) -> DataFrame:
    """The feature vector of every order; with `of`, of the orders it marks, among all orders."""
    orders = pit.point_in_time_inputs(lens.orders(spark, sf_dir))
    return pit.assemble_features(orders if of is None else orders.filter(of), pit.velocity(orders, of=of), graph.ring_features(graph.hashed_orders(orders, of=of)))
