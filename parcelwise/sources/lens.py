"""Order lens: the driver's star-schema tables seen as an order stream (integer arithmetic only)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import score_addresses
from ..functions.text import normalise_address
from .merchant_csv import with_first_order_flag

# Fixed values of the lens: one delivery PIN per nation key 0..24 (every tier, an unlisted district, an
# unknown state and a malformed one).
NATION_PINS = (
    "110001", "400001", "560034", "600001", "500081", "700091", "302001", "226010", "160017", "641001",
    "682001", "440001", "413001", "431001", "813001", "786001", "364001", "845401", "847201", "851101",
    "271001", "562123", "991234", "012345", "797001",
)
# Fixed values of the lens: address text by order_id mod 6.
ADDRESS_TEXTS = (
    "Flat 402, Prestige Lakeside, Whitefield Main Road, Bengaluru",
    "H.No 12/4 near City Mall, Sector 9, Jaipur",
    "Near Hanuman Temple, Ward 4",
    "Village Rampur post office",
    "asdf",
    "12, MG Road, Mumbai, Maharashtra 400001",
)
CHANNELS = ("ORGANIC", "META_ADS", "GOOGLE_ADS", "AFFILIATE", "INFLUENCER", "WHATSAPP", "MARKETPLACE", "DIRECT")
MERCHANT_OF_SEGMENT = {"AUTOMOBILE": "main_store", "BUILDING": "beauty_store", "FURNITURE": "trial_store"}
UNKNOWN_MERCHANT = "walk_in"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, labelled or not."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    bucket = F.expr("o_custkey div 40").cast("string")
    pins = F.array(*[F.lit(p) for p in NATION_PINS])
    texts = F.array(*[F.lit(t) for t in ADDRESS_TEXTS])
    channels = F.array(*[F.lit(ch) for ch in CHANNELS])
    merchant = F.lit(UNKNOWN_MERCHANT)
    for segment, name in MERCHANT_OF_SEGMENT.items():
        merchant = F.when(F.col("c_mktsegment") == segment, name).otherwise(merchant)
    pay = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"), "COD")
           .when(F.col("o_orderpriority") == "3-MEDIUM", "UPI").otherwise("CARD"))
    joined = o.join(c, ck == F.col("c_custkey"))
    return joined.select(
        k.cast("string").alias("order_id"), k.alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (3 + k % 7) * 86400).alias("outcome_ts"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("rto"),
        F.concat(F.lit("p"), ck).alias("phone"), F.concat(F.lit("acc"), ck).alias("account_id"),
        F.when(ck % 10 < 3, F.concat(F.lit("ds"), bucket)).otherwise(F.concat(F.lit("d"), ck)).alias("device"),
        F.when(ck % 4 == 0, F.concat(F.lit("as"), bucket)).otherwise(F.concat(F.lit("a"), ck)).alias("addr"),
        F.when(ck % 5 == 0, F.concat(F.lit("v"), ck)).alias("vpa"),
        F.concat(F.lit("i"), ck % 37).alias("ip"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("tok"), ck)).alias("card_token"),
        (k % 97 == 0).alias("disputed"), pay.alias("payment_method"),
        F.when(k % 11 == 0, "CARD_FAILED").alias("payment_switch_from"),
        (F.floor(F.col("o_totalprice") * 0.5 + 0.5) / 100.0).alias("cart_gmv"),
        pins[F.col("c_nationkey")].alias("delivery_pin"),
        texts[(k % 6).cast("int")].alias("shipping_address"),
        channels[(k % 8).cast("int")].alias("acquisition_channel"),
        (1 + k % 4).cast("int").alias("items_count"), (150 + (k * 37) % 2500).cast("double").alias("weight_grams"),
        (k % 3 == 0).alias("coupon_applied"), (10 + (k * 13) % 200).cast("double").alias("checkout_seconds"),
        ((k * 7) % 24).cast("int").alias("hour_of_day"), merchant.alias("merchant_id"),
        F.lit(0.18).alias("merchant_margin"), (60 + (k * 29) % 560).cast("double").alias("cac"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status resolves to a label."""
    return raw_orders(spark, sf_dir).filter(F.col("status").isin("F", "O")).drop("status")


def partial_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources without complete identities give them: some lack phone, device, address or network, some carry a card."""
    k = F.col("seq")
    gone = {"phone": k % 3 == 0, "device": k % 7 < 3, "addr": k % 11 == 0, "ip": k % 5 == 0}
    return orders(spark, sf_dir).withColumns({**{c: F.when(~g, F.col(c)) for c, g in gone.items()}, "card": F.col("card_token")})


def address_entity(df: DataFrame) -> DataFrame:
    """Address entity taken from the text, for sources that carry no address key of their own."""
    return df.withColumn("addr", normalise_address(F.col("shipping_address"), F.col("delivery_pin")))


def scored(df: DataFrame) -> DataFrame:
    """Address and PIN columns plus the fixed logistic score `p` (six decimals, stored before any threshold)."""
    df = score_addresses(df)
    z = (F.lit(-1.6) + 1.8 * F.col("addr_defect_score") + 0.25 * (F.col("pin_tier") - 1)
         + F.when(F.col("payment_switch_from").isNotNull(), 0.9).otherwise(0.0)
         + 0.35 * F.log(1.0 + F.col("cart_gmv") / 800.0)
         + F.when(F.col("device").startswith("ds"), 0.6).otherwise(0.0))
    return df.withColumn("p", F.round(1.0 / (1.0 + F.exp(-z)), 6))


def scored_cod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COD orders with their score; a buyer's earliest order (of any payment method) counts as new."""
    flagged = with_first_order_flag(orders(spark, sf_dir))
    return scored(flagged.filter(F.col("payment_method") == "COD"))


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events lens: user as phone, the JSON key as device; everything but 'error' is an order."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id")).alias("user"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("device"), "event_type", "value",
        F.least(F.lit(0.999), F.col("value") / 500).alias("p"))
