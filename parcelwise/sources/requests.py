"""Risk requests: typed schema, rule checks, valid / quarantine split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits

# Enums and defaults of the request contract.
PAYMENT_METHODS = ("COD", "UPI", "CARD", "NETBANKING", "WALLET", "EMI")
CHANNELS = ("ORGANIC", "META_ADS", "GOOGLE_ADS", "AFFILIATE", "INFLUENCER", "WHATSAPP", "MARKETPLACE", "DIRECT")
DEFAULTS = {"merchant_id": "main_store", "items_count": 1, "weight_grams": 450.0, "payment_method": "COD",
            "acquisition_channel": "ORGANIC", "coupon_applied": False, "checkout_seconds": 90.0}

SCHEMA = (
    "order_id string, merchant_id string, customer_phone string, customer_email string, delivery_pin string, "
    "shipping_address string, cart_gmv double, items_count int, weight_grams double, device_fingerprint_hash string, "
    "ip_hash string, vpa string, payment_method string, payment_switch_from string, acquisition_channel string, "
    "coupon_applied boolean, checkout_seconds double, hour_of_day int, is_new_customer boolean, merchant_margin double, "
    "cac double, logistics_loss double, holding_cost double, friction_shadow_price double, friction_budget double, ts timestamp")


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items() if k in df.columns})


def _text(c: str, least: int) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def _range(c: str, lo: float | None = None, hi: float | None = None, *, required: bool = False, above: bool = False) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & ((F.col(c) > lo) if above else (F.col(c) >= lo))
    if hi is not None:
        ok = ok & (F.col(c) <= hi)
    return F.coalesce(ok, F.lit(not required))


def rules() -> dict[str, Column]:
    """Rule name -> TRUE where the row passes."""
    return {
        "customer_phone": _text("customer_phone", 6), "shipping_address": _text("shipping_address", 1),
        "device_fingerprint_hash": _text("device_fingerprint_hash", 4),
        "delivery_pin": F.coalesce((F.length("delivery_pin") == 6) & (F.length(digits(F.col("delivery_pin"))) == 6), F.lit(False)),
        "cart_gmv": _range("cart_gmv", 0, required=True, above=True), "items_count": _range("items_count", 1),
        "weight_grams": _range("weight_grams", 0, above=True), "checkout_seconds": _range("checkout_seconds", 0),
        "hour_of_day": _range("hour_of_day", 0, 23), "merchant_margin": _range("merchant_margin", 0, 1),
        "cac": _range("cac", 0), "logistics_loss": _range("logistics_loss", 0), "holding_cost": _range("holding_cost", 0),
        "friction_shadow_price": _range("friction_shadow_price", 0), "friction_budget": _range("friction_budget", 0, 1),
        "payment_method": F.coalesce(F.col("payment_method").isin(*PAYMENT_METHODS), F.lit(False)),
        "acquisition_channel": F.coalesce(F.col("acquisition_channel").isin(*CHANNELS), F.lit(False)),
    }


def check_requests(df: DataFrame) -> DataFrame:
    """Fill defaults and add `violations`, the names of the broken rules."""
    df = with_defaults(df)
    broken = F.array(*[F.when(~ok, name) for name, ok in rules().items() if name in df.columns])
    return df.withColumn("violations", F.filter(broken, lambda v: v.isNotNull()))


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    checked = check_requests(df)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)
