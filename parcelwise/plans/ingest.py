"""Queries on sources, ingest and sinks, and on scalar expressions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pincodes, text
from ..functions.economics import weight_multiplier
from ..operators import pit, response
from ..operators.decide import serve
from ..sources import ledger, lens, merchant_csv, merchants, requests
from ..streaming.jobs import run_folder
from .registry import add, made
from .sql import cte, entity_hash, pin_info, sql

# ------------------------------------------------------------------ merchant export
# Expressions that read the same in Spark SQL and DuckDB: a messy export made of the whole order table.
_D, _M, _Y = "lpad('' || day(ts), 2, '0')", "lpad('' || month(ts), 2, '0')", "('' || year(ts))"
EXPORT = {
    "Order ID": "CASE WHEN seq % 17 = 0 THEN '' || (seq - 1) ELSE order_id END",  # two lines of one order
    "Order Date": f"CASE WHEN seq % 50 = 0 THEN 'n/a' WHEN seq % 6 = 0 THEN day(ts) || '/' || month(ts) || '/' || {_Y} || ' ' || hour_of_day || ':30' "
                  f"WHEN seq % 3 = 0 THEN {_D} || '/' || {_M} || '/' || {_Y} || ' ' || "
                  f"lpad('' || hour_of_day, 2, '0') || ':30' WHEN seq % 3 = 1 THEN {_Y} || '-' || {_M} || '-' || {_D} "
                  f"ELSE {_D} || '-' || {_M} || '-' || {_Y} END",
    "Delivery Date": f"CASE WHEN seq % 5 = 0 THEN '' ELSE '28/12/' || {_Y} END",
    "Customer Mobile": "'+91 ' || substr('' || (9000000000 + CAST(substr(phone, 2) AS BIGINT)), 1, 5) || ' ' || "
                       "substr('' || (9000000000 + CAST(substr(phone, 2) AS BIGINT)), 6)",
    "Device ID": "CASE WHEN seq % 4 = 0 THEN '' ELSE device END",
    "Client IP": "CASE WHEN seq % 6 = 0 THEN '' ELSE ip END",
    "Ship Address": "CASE WHEN seq % 19 = 0 THEN shipping_address || chr(10) || 'second line' ELSE shipping_address END",
    "Ship Pincode": "CASE WHEN seq % 41 = 0 THEN '12' WHEN seq % 7 = 0 THEN 'PIN ' || delivery_pin ELSE delivery_pin END",
    "Order Amount": "CASE WHEN seq % 53 = 0 THEN 'abc' WHEN seq % 59 = 0 THEN '-5' WHEN seq % 67 = 0 THEN 'nan' "
                    "WHEN seq % 71 = 0 THEN 'Infinity' ELSE '' || cart_gmv END",
    "Qty": "CASE WHEN seq % 6 = 0 THEN '' WHEN seq % 73 = 0 THEN '9999999999' WHEN seq % 79 = 0 THEN 'nan' ELSE '' || items_count END",
    "Payment Mode": "CASE WHEN seq % 61 = 0 THEN 'Barter' WHEN payment_method = 'COD' AND seq % 2 = 0 THEN ' Cash on Delivery ' "
                    "WHEN payment_method = 'COD' THEN 'cod' WHEN payment_method = 'UPI' THEN 'Prepaid' ELSE 'Credit Card' END",
    "UTM Source": "CASE seq % 8 WHEN 0 THEN 'facebook' WHEN 1 THEN 'Google' WHEN 2 THEN 'affiliate' WHEN 3 THEN 'WhatsApp' "
                  "WHEN 4 THEN 'direct' WHEN 5 THEN 'tv' WHEN 6 THEN 'meta_ads' ELSE '' END",
    "Coupon Code": "CASE seq % 4 WHEN 0 THEN 'SAVE10' WHEN 1 THEN '' WHEN 2 THEN 'No' ELSE '0' END",
    "Checkout Duration": "CASE WHEN seq % 9 = 0 THEN 'x' WHEN seq % 83 = 0 THEN 'inf' ELSE '' || checkout_seconds END",
    "Status": "CASE WHEN status = 'F' AND seq % 2 = 0 THEN ' RTO ' WHEN status = 'F' THEN 'returned to sender' "
              "WHEN status = 'O' THEN 'Delivered' WHEN seq % 2 = 0 THEN 'Cancelled' ELSE 'In transit' END",
}
MAPPING = merchant_csv.Mapping(
    columns={"order_id": "Order ID", "ts": "Order Date", "outcome_ts": "Delivery Date", "customer_phone": "Customer Mobile",
             "device_fingerprint": "Device ID", "ip": "Client IP", "shipping_address": "Ship Address", "delivery_pin": "Ship Pincode",
             "cart_gmv": "Order Amount", "items_count": "Qty", "payment_method": "Payment Mode", "acquisition_channel": "UTM Source",
             "coupon_applied": "Coupon Code", "checkout_seconds": "Checkout Duration", "status": "Status"},
    rto=["RTO", "Returned to Sender"], delivered=["Delivered", "Completed"], ignored=["Cancelled"],
    channel_aliases={"facebook": "META_ADS", "google": "GOOGLE_ADS", "whatsapp": "WHATSAPP", "direct": "DIRECT"},
    date_format=["%d/%m/%Y %H:%M", "%Y-%m-%d", "%d-%m-%Y"], outcome_date_format="%d/%m/%Y")


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.raw_orders(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in EXPORT.items()])


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merchant_csv.normalise_orders(export(spark, sf_dir), MAPPING)


cte("export", "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in EXPORT.items()) + " FROM lens_raw", "lens_raw")
cte("typed", """
SELECT "Order ID" AS order_id, try_strptime("Order Date", ['%d/%m/%Y %H:%M', '%Y-%m-%d', '%d-%m-%Y']) AS ts,
 try_strptime("Delivery Date", '%d/%m/%Y') AS given_outcome,
 CASE WHEN lower(trim("Status")) IN ('rto', 'returned to sender') THEN true WHEN lower(trim("Status")) IN ('delivered', 'completed') THEN false END AS rto,
 right(regexp_replace("Customer Mobile", '[^0-9]', '', 'g'), 10) AS phone, "Device ID" AS dev, nullif("Client IP", '') AS ip,
 "Ship Address" AS shipping_address, substr(regexp_replace("Ship Pincode", '[^0-9]', '', 'g'), 1, 6) AS delivery_pin,
 CASE WHEN isfinite(try_cast("Order Amount" AS DOUBLE)) THEN try_cast("Order Amount" AS DOUBLE) END AS cart_gmv, coalesce(try_cast("Qty" AS INTEGER), 1) AS items_count,
 CASE upper(trim("Payment Mode")) WHEN 'CASH ON DELIVERY' THEN 'COD' WHEN 'COD' THEN 'COD' WHEN 'PREPAID' THEN 'UPI' WHEN 'CREDIT CARD' THEN 'CARD' ELSE 'COD' END AS payment_method,
 CASE lower(trim("UTM Source")) WHEN 'facebook' THEN 'META_ADS' WHEN 'google' THEN 'GOOGLE_ADS' WHEN 'whatsapp' THEN 'WHATSAPP' WHEN 'direct' THEN 'DIRECT'
  WHEN 'affiliate' THEN 'AFFILIATE' WHEN 'meta_ads' THEN 'META_ADS' ELSE 'ORGANIC' END AS acquisition_channel,
 lower(trim("Coupon Code")) NOT IN ('', '0', 'false', 'no', 'none', 'nan') AS coupon_applied,
 coalesce(CASE WHEN isfinite(try_cast("Checkout Duration" AS DOUBLE)) THEN try_cast("Checkout Duration" AS DOUBLE) END, 90e0) AS checkout_seconds, trim("Status") AS status FROM export""", "export")
cte("norm", """
SELECT *, coalesce(given_outcome, ts + to_days(6)) AS outcome_ts,
 CASE WHEN dev <> '' THEN dev ELSE 'fp_' || substr(sha1(phone), 1, 24) END AS device, 'acc_' || substr(sha1(phone), 1, 8) AS account_id,
 CAST(hour(ts) AS INTEGER) AS hour_of_day, row_number() OVER (PARTITION BY phone ORDER BY ts, order_id) = 1 AS is_new_customer
FROM typed WHERE ts IS NOT NULL AND rto IS NOT NULL AND cart_gmv > 0 AND length(delivery_pin) = 6""", "typed")
cte("norm_pins", pin_info("norm"), "norm", "state2", "city3", "priors")


def from_export(name: str, columns: list, oracle_columns: str, *needs: str, source: str = "norm") -> None:
    add(name, lambda s, d: normalised(s, d).select("order_id", *made(columns)),
        sql(f"SELECT order_id, {oracle_columns} FROM {source}", *(needs or ("norm",))))


_EPOCH = "round(epoch({0}), 3) AS {1}"


def scan_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the export as CSV, scan it back and normalise it."""
    path = run_folder(spark, "export")
    export(spark, sf_dir).write.option("header", True).option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    raw = merchant_csv.read_export(spark, path, MAPPING)
    return merchant_csv.normalise_orders(raw, MAPPING).select("order_id", "phone", "delivery_pin", "payment_method", "rto", "cart_gmv")


add("a1_mapped_csv_scan", scan_export, sql("SELECT order_id, phone, delivery_pin, payment_method, rto, cart_gmv FROM norm", "norm"))
from_export("a2_tier_stamping", ["delivery_pin", "pin_tier"],
            "delivery_pin, tier AS pin_tier", "norm", "norm_pins", source="norm JOIN norm_pins ON pin = delivery_pin")
add("a3_default_fill", lambda s, d: normalised(s, d).select("order_id", "items_count", "weight_grams", "merchant_margin", "cac",
    F.array_join(F.lit(merchant_csv._typed(export(s, d), MAPPING)[1]), ",").alias("defaults_used")),
    sql("SELECT order_id, items_count, 450e0 AS weight_grams, 0.18e0 AS merchant_margin, 300e0 AS cac, "
        "'cac,card_token,customer_email,hour_of_day,merchant_margin,payment_switch_from,vpa,weight_grams' AS defaults_used FROM norm", "norm"))
add("a4_date_parse", lambda s, d: export(s, d).select(
    F.col("Order ID").alias("order_id"), F.round(text.epoch_seconds(merchant_csv.parse_date(F.col("Order Date"), MAPPING.date_format)), 3).alias("ts_epoch")),
    sql("SELECT order_id, " + _EPOCH.format("ts", "ts_epoch") + " FROM typed", "typed"))
add("a5_epoch_round_trip", lambda s, d: lens.event_orders(s, d).select(
    "seq", F.round(text.epoch_seconds(F.col("ts")), 6).alias("ts_epoch"),
    (F.abs(F.unix_micros(text.from_epoch(text.epoch_seconds(F.col("ts")))) - F.unix_micros("ts")) <= 1).alias("round_trips")),
    "SELECT event_id AS seq, round(epoch_us(ts) / 1e6, 6) AS ts_epoch, true AS round_trips FROM events")
add("a6_status_label", lambda s, d: export(s, d).select(
    F.col("Order ID").alias("order_id"), merchant_csv.label_status(F.col("Status"), MAPPING.rto, MAPPING.delivered).alias("rto")).filter("rto is not null"),
    sql("SELECT order_id, rto FROM typed WHERE rto IS NOT NULL", "typed"))
from_export("a7_outcome_time", lambda: [F.round(text.epoch_seconds(F.col("outcome_ts")), 3).alias("outcome_epoch")], _EPOCH.format("outcome_ts", "outcome_epoch"))
from_export("a8_payment_alias", ["payment_method"], "payment_method")
from_export("a9_channel_alias", ["acquisition_channel"], "acquisition_channel")
from_export("a10_phone_digits", ["phone"], "phone")
from_export("a11_device_fallback", ["device", "account_id"], "device, account_id")
from_export("a12_pin_digits", ["delivery_pin"], "delivery_pin")
from_export("a13_coupon_flag", ["coupon_applied"], "coupon_applied")
from_export("a14_numeric_coercion", ["cart_gmv", "items_count", "checkout_seconds", "hour_of_day"], "cart_gmv, items_count, checkout_seconds, hour_of_day")
add("a15_quality_report", lambda s, d: merchant_csv.ingest_report(export(s, d), MAPPING).drop("defaults_used").withColumns({
    c: F.round(c, 6) for c in ("cod_share", "cod_rto_rate")}),
    sql("""SELECT (SELECT count(*) FROM typed) AS rows_in, (SELECT count(*) FROM typed WHERE ts IS NULL) AS unparseable_date,
 (SELECT count(*) FROM typed WHERE ts IS NOT NULL AND rto IS NULL) AS unlabelled_status,
 (SELECT count(*) FROM typed WHERE ts IS NOT NULL AND rto IS NOT NULL) - (SELECT count(*) FROM norm) AS bad_amount_or_pin,
 (SELECT count(*) FROM norm) AS rows_out, round(avg(CASE WHEN payment_method = 'COD' THEN 1e0 ELSE 0e0 END), 6) AS cod_share,
 round(avg(CAST(rto AS DOUBLE)) FILTER (payment_method = 'COD'), 6) AS cod_rto_rate FROM norm""", "typed", "norm"))
add("a15_ignored_statuses", lambda s, d: merchant_csv.ignored_statuses(export(s, d), MAPPING).withColumnRenamed("count", "n"),
    sql("SELECT status, count(*) AS n FROM typed WHERE status = 'Cancelled' GROUP BY 1", "typed"))
from_export("a16_empty_to_null", ["ip", "vpa", "card_token"], "ip, CAST(NULL AS VARCHAR) AS vpa, CAST(NULL AS VARCHAR) AS card_token")
from_export("a17_first_order_flag", ["phone", "is_new_customer"], "phone, is_new_customer")

# ---- marketplace export
_CATEGORIES = ("T-shirt", "Shirt", "Blazzer", "Trousers", "Perfume", "Wallet", "Socks", "Shoes", "Gadget", "Kurta", "Saree")
_CAT = "CASE seq % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES)) + " END"
MARKETPLACE = {
    "Order ID": "'MK-' || order_id", "Date": "CASE WHEN seq % 2 = 0 THEN lpad('' || month(ts), 2, '0') || '-' || lpad('' || day(ts), 2, '0') || '-' || substr('' || year(ts), 3, 2) "
    "ELSE lpad('' || month(ts), 2, '0') || '-' || lpad('' || day(ts), 2, '0') || '-' || year(ts) END",
    "Status": "CASE WHEN status = 'F' THEN 'Shipped - Returned to Seller' WHEN status = 'O' THEN 'Shipped - Delivered to Buyer' ELSE 'Cancelled' END",
    "Amount": "CASE WHEN seq % 29 = 0 THEN '' WHEN seq % 31 = 0 THEN '0' ELSE '' || cart_gmv END",
    "Qty": "CASE WHEN seq % 37 = 0 THEN '0' ELSE '' || items_count END", "Category": _CAT,
    "ship-city": "CASE WHEN seq % 4 = 0 THEN 'MUMBAI' WHEN seq % 4 = 1 THEN 'new delhi' WHEN seq % 4 = 2 THEN 'Pune' ELSE '' END",
    "ship-state": "CASE WHEN seq % 4 = 1 THEN 'DELHI' ELSE 'maharashtra' END",
    "ship-postal-code": "CASE WHEN seq % 43 = 0 THEN '' WHEN seq % 5 = 0 THEN '' || (seq % 1000 * 97 + 1) || '.0' ELSE delivery_pin END",
}


def marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lens.raw_orders(spark, sf_dir).select(*[F.expr(e).alias(f" {n} ") for n, e in MARKETPLACE.items()])
    return merchant_csv.derive_marketplace(raw)


cte("market", "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in MARKETPLACE.items()) + " FROM lens_raw", "lens_raw")
_title = lambda c: f"array_to_string(list_transform(string_split(\"{c}\", ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
cte("market_derived", f"""
SELECT "Order ID" AS order_id, '9' || translate(substr(sha1("Order ID"), 1, 9), 'abcdef', '123456') AS derived_phone, pc AS postal_code,
 trim({_title('ship-city')} || ', ' || {_title('ship-state')} || ' ' || pc, ', ') AS derived_address,
 CASE "Category" WHEN 'T-shirt' THEN 250e0 WHEN 'Shirt' THEN 300e0 WHEN 'Blazzer' THEN 900e0 WHEN 'Trousers' THEN 450e0 WHEN 'Perfume' THEN 350e0
  WHEN 'Wallet' THEN 200e0 WHEN 'Socks' THEN 100e0 WHEN 'Shoes' THEN 800e0 WHEN 'Kurta' THEN 350e0 WHEN 'Saree' THEN 500e0 ELSE 400e0 END AS derived_weight,
 try_cast("Amount" AS DOUBLE) AS amount, try_cast("Qty" AS DOUBLE) AS qty, "Status" AS status
FROM (SELECT *, CASE WHEN try_cast("ship-postal-code" AS DOUBLE) IS NULL THEN ''
  ELSE lpad('' || CAST(try_cast("ship-postal-code" AS DOUBLE) AS BIGINT), 6, '0') END AS pc FROM market)
WHERE try_cast("Amount" AS DOUBLE) > 0 AND try_cast("Qty" AS DOUBLE) >= 1 AND pc <> ''""", "market")
add("a18_marketplace_derivation", lambda s, d: marketplace(s, d).select(
    F.col("Order ID").alias("order_id"), F.col("Derived Phone").alias("derived_phone"), F.col("`ship-postal-code`").alias("postal_code"),
    F.col("Derived Address").alias("derived_address"), F.col("`Derived Weight (g)`").alias("derived_weight"), F.col("Amount").alias("amount"),
    F.col("Qty").alias("qty")),
    sql("SELECT order_id, derived_phone, postal_code, derived_address, derived_weight, amount, qty FROM market_derived", "market_derived"))
add("a18_status_counts", lambda s, d: lens.raw_orders(s, d).select(F.expr(MARKETPLACE["Status"]).alias("status")).groupBy("status").agg(F.count("*").alias("n")),
    sql('SELECT "Status" AS status, count(*) AS n FROM market GROUP BY 1', "market"))


add("a20_world_summary", lambda s, d: lens.orders(s, d).agg(
    F.count("*").alias("orders"), F.countDistinct("phone").alias("phones"), F.countDistinct("device").alias("devices"),
    F.round(F.avg((F.col("payment_method") == "COD").cast("double")), 6).alias("cod_share"),
    F.round(F.avg(F.when(F.col("payment_method") == "COD", F.col("rto").cast("double"))), 6).alias("cod_rto_rate")),
    sql("SELECT count(*) AS orders, count(DISTINCT phone) AS phones, count(DISTINCT device) AS devices, "
        "round(avg(CASE WHEN payment_method = 'COD' THEN 1e0 ELSE 0e0 END), 6) AS cod_share, "
        "round(avg(CAST(rto AS DOUBLE)) FILTER (payment_method = 'COD'), 6) AS cod_rto_rate FROM lens", "lens"))
add("a20_rto_by_cohort", lambda s, d: lens.orders(s, d).filter("payment_method = 'COD'").groupBy(F.col("merchant_id").alias("cohort")).agg(
    F.round(F.avg(F.col("rto").cast("double")), 6).alias("rto_rate")),
    sql("SELECT merchant_id AS cohort, round(avg(CAST(rto AS DOUBLE)), 6) AS rto_rate FROM lens WHERE payment_method = 'COD' GROUP BY 1", "lens"))


# ------------------------------------------------------------------ ledger
def logged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A decision and an outcome record per order; every action follows from the order id."""
    o = lens.orders(spark, sf_dir)
    action = F.expr("CASE seq % 3 WHEN 0 THEN 'ALLOW_COD' WHEN 1 THEN 'STEP_UP_DEPOSIT' ELSE 'FORCE_PREPAID' END")
    dark = F.col("merchant_id") == "trial_store"
    d = serve(o.withColumn("action", action).withColumn("shadow", dark).withColumn("phone_h", F.col("phone")), shadow=F.col("shadow"))
    decisions = d.select("order_id", "merchant_id", "ts", F.col("action").alias("policy_action"), "served_action", "is_control_cohort",
                         "shadow", "propensity", "draw", F.col("cart_gmv").alias("gmv"))
    return decisions, o.filter("seq % 4 <> 0").select("order_id", "rto")


def through_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = run_folder(spark, "ledger")
    decisions, outcomes = logged(spark, sf_dir)
    ledger.append_ledger(decisions, path, "decision")
    ledger.append_ledger(outcomes, path, "outcome")
    # a torn line, as a crashed writer leaves it
    outcomes.select(F.concat(F.lit('{"kind":"outcome","order_id":"'), "order_id").alias("value")).write.mode("append").text(path)
    return ledger.read_ledger(spark, path)


cte("logged", f"""
SELECT *, CASE WHEN shadow OR control THEN 'ALLOW_COD' ELSE action END AS served,
 CASE WHEN shadow THEN 1e0 WHEN action = 'ALLOW_COD' THEN 1e0 WHEN control THEN 0.05e0 ELSE 1e0 - 0.05e0 END AS propensity
FROM (SELECT *, coalesce(draw < 0.05e0, false) AS control FROM (SELECT *, CASE WHEN action <> 'ALLOW_COD' AND NOT shadow THEN
  CAST(('0x' || substr(sha256(order_id || '|' || phone), 1, 16))::UBIGINT AS DOUBLE) / power(2e0, 64) END AS draw
 FROM (SELECT *, CASE seq % 3 WHEN 0 THEN 'ALLOW_COD' WHEN 1 THEN 'STEP_UP_DEPOSIT' ELSE 'FORCE_PREPAID' END AS action, merchant_id = 'trial_store' AS shadow FROM lens)))""", "lens")
add("a21_ledger_scan", lambda s, d: through_ledger(s, d)[0].select("order_id", "policy_action", "served_action", "is_control_cohort", F.round("propensity", 6).alias("propensity")),
    sql("SELECT order_id, action AS policy_action, served AS served_action, control AS is_control_cohort, round(propensity, 6) AS propensity FROM logged", "logged"))
add("a22_ledger_append", lambda s, d: through_ledger(s, d)[1].select("order_id", "rto"), sql("SELECT order_id, rto FROM lens WHERE seq % 4 <> 0", "lens"))
add("a23_ledger_tally", lambda s, d: ledger.tally(*logged(s, d)),
    sql("SELECT count(*) AS decisions, count(*) FILTER (control) AS control_cohort, count(*) FILTER (shadow) AS shadow, "
        "count(*) FILTER (seq % 4 <> 0) AS outcomes FROM logged", "logged"))
add("a23_served_mix", lambda s, d: ledger.served_mix(logged(s, d)[0]), sql("SELECT served AS served_action, count(*) AS n FROM logged GROUP BY 1", "logged"))
add("a24_recent_sample", lambda s, d: ledger.recent_sample(lens.orders(s, d), 200).select("order_id", "phone", "cart_gmv"),
    sql("""SELECT order_id, phone, cart_gmv FROM (SELECT * FROM lens WHERE payment_method = 'COD' ORDER BY ts DESC, seq DESC LIMIT 15000)
ORDER BY sha256('0|' || order_id), order_id LIMIT 200""", "lens"))


# ------------------------------------------------------------------ merchants: every supplier is one
def supplier_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    econ = F.map_filter(F.create_map(
        F.lit("default_margin"), F.when(k % 2 == 0, (k % 40) / 100.0), F.lit("cac_insult_kappa"), F.when(k % 3 == 0, F.lit(0.7)),
        F.lit("stepup_abandon_rate"), F.when(k % 5 == 0, F.lit(0.18)), F.lit("free_returns"), F.when(k % 17 == 0, F.lit(1.0))),
        lambda _, v: v.isNotNull())
    return lens.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), k).alias("merchant_id"), F.col("s_name").alias("label"), econ.alias("economics"),
        F.when(k % 4 == 0, (k % 13) / 10.0).alias("friction_budget"), F.when(k % 7 == 0, F.lit(-0.1)).when(k % 6 == 0, F.lit(0.02)).alias("epsilon"),
        (k % 10 == 1).alias("shadow"))


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.orders(spark, sf_dir).drop("merchant_margin", "cac").withColumn("merchant_id", F.concat(F.lit("m"), F.col("seq") % 150)) \
        .withColumn("merchant_margin", F.when(F.col("seq") % 9 == 0, 0.5)).withColumn("cac", F.when(F.col("seq") % 8 == 0, 77.0))


cte("shops", """
SELECT 'm' || s_suppkey AS mid, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 40) / 100e0 ELSE 0.18e0 END AS margin,
 CASE WHEN s_suppkey % 3 = 0 THEN 0.7e0 ELSE 0.55e0 END AS kappa, CASE WHEN s_suppkey % 5 = 0 THEN 0.18e0 ELSE 0.11e0 END AS delta_s,
 CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 13) / 10e0 END AS budget,
 CASE WHEN s_suppkey % 7 = 0 THEN -0.1e0 WHEN s_suppkey % 6 = 0 THEN 0.02e0 ELSE 0.05e0 END AS epsilon, s_suppkey % 10 = 1 AS shadow FROM supplier""")
add("a25_merchant_config_join", lambda s, d: merchants.effective(merchants.resolve_merchants(shop_orders(s, d), supplier_config(s, d), "m0")).select(
    "order_id", "merchant_config", "merchant_known", "merchant_margin", "cac", "econ_cac_insult_kappa", "econ_stepup_abandon_rate",
    "merchant_budget", "epsilon", "shadow"),
    sql("""SELECT order_id, mid AS merchant_config, known AS merchant_known, CASE WHEN seq % 9 = 0 THEN 0.5e0 ELSE margin END AS merchant_margin,
 CASE WHEN seq % 8 = 0 THEN 77e0 ELSE 420e0 END AS cac, kappa AS econ_cac_insult_kappa, delta_s AS econ_stepup_abandon_rate, budget AS merchant_budget, epsilon, shadow
FROM (SELECT *, 'm' || (seq % 150) IN (SELECT mid FROM shops) AS known FROM lens) o JOIN shops ON mid = CASE WHEN known THEN 'm' || (seq % 150) ELSE 'm0' END""", "lens", "shops"))
add("a26_config_violations", lambda s, d: merchants.violations(supplier_config(s, d)).select("merchant_id", F.array_join("violations", "; ").alias("violations")),
    """SELECT merchant_id, array_to_string(v, '; ') AS violations FROM (SELECT 'm' || s_suppkey AS merchant_id, list_filter([
 CASE WHEN s_suppkey % 17 = 0 THEN 'unknown economics fields: free_returns' END,
 CASE WHEN s_suppkey % 4 = 0 AND (s_suppkey % 13) > 10 THEN 'friction_budget must be in [0, 1]' END,
 CASE WHEN s_suppkey % 7 = 0 THEN 'epsilon must be in [0, 1]' END], lambda x: x IS NOT NULL) AS v FROM supplier) WHERE len(v) > 0""")


def risk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = lens.raw_orders(spark, sf_dir), F.col("seq")
    return o.select(
        "order_id", F.when(k % 23 == 0, "p1").otherwise(F.concat(F.lit("90000"), "phone")).alias("customer_phone"),
        F.when(k % 19 == 0, "56A034").when(k % 29 == 0, "123").otherwise(F.col("delivery_pin")).alias("delivery_pin"),
        F.when(k % 31 == 0, "").otherwise(F.col("shipping_address")).alias("shipping_address"),
        F.when(k % 13 == 0, 0.0).otherwise(F.col("cart_gmv")).alias("cart_gmv"),
        F.when(k % 17 == 0, 0).when(k % 5 != 0, F.col("items_count")).alias("items_count"), "weight_grams",
        F.rpad("device", 5, "x").alias("device_fingerprint_hash"),
        F.when(k % 37 == 0, "BARTER").when(k % 3 != 0, F.col("payment_method")).alias("payment_method"), "acquisition_channel",
        "checkout_seconds", F.when(k % 41 == 0, 24).otherwise(F.col("hour_of_day")).alias("hour_of_day"),
        F.when(k % 43 == 0, 1.5).alias("merchant_margin"), F.when(k % 47 == 0, -1.0).alias("friction_budget"))


add("a27_request_validation", lambda s, d: requests.check_requests(risk_requests(s, d)).select(
    "order_id", "items_count", "payment_method", F.array_join(F.array_sort("violations"), ",").alias("violations")),
    sql("""SELECT order_id, CASE WHEN seq % 17 = 0 THEN 0 WHEN seq % 5 <> 0 THEN items_count ELSE 1 END AS items_count,
 CASE WHEN seq % 37 = 0 THEN 'BARTER' WHEN seq % 3 <> 0 THEN payment_method ELSE 'COD' END AS payment_method,
 array_to_string(list_sort(list_filter([CASE WHEN seq % 23 = 0 THEN 'customer_phone' END, CASE WHEN seq % 19 = 0 OR seq % 29 = 0 THEN 'delivery_pin' END,
 CASE WHEN seq % 31 = 0 THEN 'shipping_address' END, CASE WHEN seq % 13 = 0 THEN 'cart_gmv' END, CASE WHEN seq % 17 = 0 THEN 'items_count' END,
 CASE WHEN seq % 37 = 0 THEN 'payment_method' END, CASE WHEN seq % 41 = 0 THEN 'hour_of_day' END, CASE WHEN seq % 43 = 0 THEN 'merchant_margin' END,
 CASE WHEN seq % 47 = 0 THEN 'friction_budget' END], lambda x: x IS NOT NULL)), ',') AS violations FROM lens_raw""", "lens_raw"))
add("a27_quarantine_counts", lambda s, d: requests.split_requests(risk_requests(s, d))[1].select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")),
    sql("""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN seq % 23 = 0 THEN 'customer_phone' END, CASE WHEN seq % 19 = 0 OR seq % 29 = 0 THEN 'delivery_pin' END,
 CASE WHEN seq % 31 = 0 THEN 'shipping_address' END, CASE WHEN seq % 13 = 0 THEN 'cart_gmv' END, CASE WHEN seq % 17 = 0 THEN 'items_count' END,
 CASE WHEN seq % 37 = 0 THEN 'payment_method' END, CASE WHEN seq % 41 = 0 THEN 'hour_of_day' END, CASE WHEN seq % 43 = 0 THEN 'merchant_margin' END,
 CASE WHEN seq % 47 = 0 THEN 'friction_budget' END], lambda x: x IS NOT NULL)) AS rule FROM lens_raw) GROUP BY 1""", "lens_raw"))


# ------------------------------------------------------------------ scalar expressions over whole tables
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.scored(merchant_csv.with_first_order_flag(lens.orders(spark, sf_dir)))


def on_scored(name: str, columns: list, oracle_columns: str) -> None:
    add(name, lambda s, d: scored(s, d).select("order_id", *made(columns)), sql(f"SELECT order_id, {oracle_columns} FROM scored", "scored"))


add("b1_clean_str", lambda s, d: export(s, d).select(F.col("Order ID").alias("order_id"), text.clean_str(F.col("Payment Mode")).alias("payment"),
    text.clean_str(F.when(F.col("Client IP") != "", F.col("Client IP"))).alias("ip")),
    sql("""SELECT "Order ID" AS order_id, lower(trim("Payment Mode")) AS payment, "Client IP" AS ip FROM export""", "export"))
add("b2_entity_hash", lambda s, d: lens.orders(s, d).select("order_id", *[text.entity_hash(k, F.col(k)).alias(f"{k}_h") for k in ("phone", "device", "vpa", "ip")]),
    sql("SELECT order_id, " + ", ".join(f"{entity_hash(k, k)} AS {k}_h" for k in ("phone", "device", "vpa", "ip")) + " FROM lens", "lens"))
add("b3_address_normalise", lambda s, d: lens.address_entity(lens.orders(s, d)).select("order_id", "addr"),
    sql("SELECT order_id, trim(regexp_replace(lower(shipping_address), '[^a-z0-9]+', ' ', 'g')) || '|' || delivery_pin AS addr FROM lens", "lens"))
add("b4_pin_lookup", lambda s, d: pincodes.with_pin_info(lens.raw_orders(s, d)).select(
    "order_id", "pin_valid", "pin_state", "pin_city", "pin_tier", "pin_serviceability_prior", "pin_rto_prior"),
    sql("SELECT order_id, valid AS pin_valid, state AS pin_state, city AS pin_city, tier AS pin_tier, serv AS pin_serviceability_prior, rtop AS pin_rto_prior "
        "FROM lens_raw JOIN pins ON pin = delivery_pin", "lens_raw", "pins"))
on_scored("b5_token_count", ["addr_tokens"], "tokens AS addr_tokens")
on_scored("b6_house_number", ["addr_has_house_no"], "house AS addr_has_house_no")
on_scored("b7_street_anchor", ["addr_has_street_anchor"], "street AS addr_has_street_anchor")
on_scored("b8_landmark_only", ["addr_landmark_only"], "landmark_only AS addr_landmark_only")
on_scored("b9_vague_only", ["addr_vague_only"], "vague_only AS addr_vague_only")
on_scored("b10_junk", ["addr_junk"], "junk AS addr_junk")
on_scored("b11_too_short", ["addr_too_short"], "too_short AS addr_too_short")
on_scored("b12_pin_in_text_mismatch", ["addr_pin_mismatch"], "pin_mismatch AS addr_pin_mismatch")
on_scored("b13_state_mismatch", ["addr_state_mismatch"], "state_mismatch AS addr_state_mismatch")
on_scored("b14_defect_score", ["addr_defect_score"], "addr_defect_score")
on_scored("b15_payment_fallback", lambda: [pit.payment_fallback(F.col("payment_switch_from")).alias("switched")], "coalesce(payment_switch_from LIKE '%FAILED', false) AS switched")
on_scored("b16_cyclic_hour", lambda: [F.round(F.sin(pit.hour_angle(F.col("hour_of_day"))), 6).alias("hour_sin"), F.round(F.cos(pit.hour_angle(F.col("hour_of_day"))), 6).alias("hour_cos")],
          "round(sin(2 * pi() * hour_of_day / 24), 6) AS hour_sin, round(cos(2 * pi() * hour_of_day / 24), 6) AS hour_cos")
on_scored("b17_channel_risk", lambda: [pit.channel_risk(F.col("acquisition_channel")).alias("risk")],
          "CASE acquisition_channel WHEN 'ORGANIC' THEN 0.15e0 WHEN 'DIRECT' THEN 0.14e0 WHEN 'WHATSAPP' THEN 0.2e0 WHEN 'GOOGLE_ADS' THEN 0.22e0 "
          "WHEN 'MARKETPLACE' THEN 0.25e0 WHEN 'META_ADS' THEN 0.3e0 WHEN 'INFLUENCER' THEN 0.32e0 WHEN 'AFFILIATE' THEN 0.38e0 ELSE 0.22e0 END AS risk")
on_scored("b18_log_transforms", lambda: [F.round(pit.log1p_floor(F.col(c)), 6).alias(f"{c}_log") for c in ("cart_gmv", "checkout_seconds")],
          "round(ln(1 + cart_gmv), 6) AS cart_gmv_log, round(ln(1 + checkout_seconds), 6) AS checkout_seconds_log")
add("b19_basket_vs_locality", lambda s, d: _with_locality(s, d).select("order_id", F.round(pit.basket_vs_locality(F.col("cart_gmv"), F.col("m")), 6).alias("ratio")),
    sql("SELECT order_id, round(cart_gmv / greatest(50e0, avg(cart_gmv) OVER (PARTITION BY delivery_pin)), 6) AS ratio FROM lens", "lens"))


def _with_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = lens.orders(spark, sf_dir)
    return o.join(o.groupBy("delivery_pin").agg(F.avg("cart_gmv").alias("m")), "delivery_pin")


add("b20_smoothed_rate", lambda s, d: lens.orders(s, d).groupBy("phone").agg(
    F.round(pit.smoothed_rate(F.count_if("rto"), F.count_if(~F.col("rto")), pit.GLOBAL_RTO_PRIOR, pit.K_ENTITY), 6).alias("rate")),
    sql("SELECT phone, round((count(*) FILTER (rto) + 0.22e0 * 3) / (count(*) + 3), 6) AS rate FROM lens GROUP BY 1", "lens"))
on_scored("b21_segment_key", lambda: [response.segment_key(F.col("acquisition_channel"), F.col("pin_tier"), F.col("cart_gmv")).alias("segment")],
          "CASE WHEN acquisition_channel IN ('ORGANIC', 'DIRECT', 'WHATSAPP') THEN 'ORGANIC' WHEN acquisition_channel IN ('GOOGLE_ADS', 'MARKETPLACE') THEN 'SEARCH' "
          "ELSE 'SOCIAL' END || '|T' || pin_tier || '|' || CASE WHEN cart_gmv < 1000 THEN 'low' WHEN cart_gmv < 2500 THEN 'mid' ELSE 'high' END AS segment")
add("b22_uniform_draw", lambda s, d: lens.orders(s, d).select("order_id", F.round(text.uniform_draw(F.concat_ws("|", "order_id", "phone")), 9).alias("u")),
    sql("SELECT order_id, round(CAST(('0x' || substr(sha256(order_id || '|' || phone), 1, 16))::UBIGINT AS DOUBLE) / power(2e0, 64), 9) AS u FROM lens", "lens"))
on_scored("b23_weight_multiplier", lambda: [weight_multiplier(F.col("weight_grams")).alias("multiplier")],
          "CASE WHEN weight_grams <= 500 THEN 1e0 WHEN weight_grams <= 2000 THEN 1.35e0 ELSE 1.9e0 END AS multiplier")
add("b24_probability_clip", lambda s, d: lens.event_orders(s, d).select("seq", text.clip(F.col("value") / 250 - 0.05, 0.001, 0.999).alias("p")),
    "SELECT event_id AS seq, least(0.999e0, greatest(0.001e0, value / 250 - 0.05e0)) AS p FROM events")
add("b25_content_hash", lambda s, d: lens.orders(s, d).select("order_id", F.sha2(F.to_json(F.struct("account_id", "device", "order_id", "phone", "seq")), 256).alias("digest")),
    sql("""SELECT order_id, sha256('{"account_id":"' || account_id || '","device":"' || device || '","order_id":"' || order_id || '","phone":"' || phone || '","seq":' || seq || '}') AS digest FROM lens""", "lens"))
