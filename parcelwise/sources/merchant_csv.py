"""Merchant order export -> internal order schema, with every default and drop reported."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pincodes import with_pin_info
from ..functions.text import phone_digits, pin_digits, stripped, text_flag

# The mapping contract.
REQUIRED = ("order_id", "ts", "customer_phone", "shipping_address", "delivery_pin", "cart_gmv", "payment_method", "status")
DEFAULTS = {"items_count": 1, "weight_grams": 450.0, "acquisition_channel": "ORGANIC", "coupon_applied": False,
            "checkout_seconds": 90.0, "merchant_margin": 0.18, "cac": 300.0, "outcome_lag_days": 6.0}
PAYMENT_ALIASES = {"COD": "COD", "CASH ON DELIVERY": "COD", "CASH": "COD", "UPI": "UPI", "CARD": "CARD", "CREDIT CARD": "CARD",
                   "DEBIT CARD": "CARD", "NETBANKING": "NETBANKING", "NET BANKING": "NETBANKING", "WALLET": "WALLET", "EMI": "EMI",
                   "PREPAID": "UPI"}
KNOWN_CHANNELS = ("ORGANIC", "DIRECT", "WHATSAPP", "GOOGLE_ADS", "MARKETPLACE", "META_ADS", "INFLUENCER", "AFFILIATE")

# Day-first formats tried in order when the mapping names none.
DAY_FIRST_FORMATS = ("%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y", "%d-%m-%Y %H:%M", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S",
                     "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d")
# Strptime directives and their Spark letters.
_STRPTIME = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%p": "a", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS",
             "%z": "xx", "%a": "EEE", "%A": "EEEE", "%j": "D"}

OPTIONAL_IDS = ("ip", "vpa", "card_token", "payment_switch_from", "customer_email")


@dataclass
class Mapping:
    """Column names, status words, channel aliases, date formats and defaults of one merchant."""

    columns: dict[str, str]
    rto: list[str] = field(default_factory=list)
    delivered: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    channel_aliases: dict[str, str] = field(default_factory=dict)
    date_format: str | list[str] | None = None
    outcome_date_format: str | list[str] | None = None
    defaults: dict = field(default_factory=dict)
    multi_line: bool = True

    @classmethod
    def from_json(cls, raw: dict) -> "Mapping":
        st = raw.get("status") or {}
        return cls(columns=dict(raw.get("columns") or {}), rto=list(st.get("rto") or []),
                   delivered=list(st.get("delivered") or []), ignored=list(st.get("drop") or []),
                   channel_aliases=dict(raw.get("channel_aliases") or {}), date_format=raw.get("date_format"),
                   outcome_date_format=raw.get("outcome_date_format"), defaults=dict(raw.get("defaults") or {}),
                   multi_line=bool(raw.get("multi_line", True)))

    def default(self, name: str):
        return {**DEFAULTS, **self.defaults}[name]


def read_export(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    """All-string scan; an empty cell stays an empty string. Quoted cells may hold line breaks unless the mapping says otherwise."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=mapping.multi_line, escape='"').na.fill("")
    check_mapping(raw, mapping)
    return raw


def check_mapping(raw: DataFrame, mapping: Mapping) -> None:
    missing = [name for name in REQUIRED if mapping.columns.get(name) not in raw.columns]
    if missing:
        raise ValueError(f"mapping does not provide required columns {missing}; the export has {raw.columns[:20]}")


def spark_date_format(fmt: str) -> str:
    """A strptime format in Spark's letters; one digit is enough where strptime takes one. An unknown directive is an error."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] != "%":
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
            continue
        directive = fmt[i:i + 2]
        if directive not in _STRPTIME and directive != "%%":
            raise ValueError(f"date format {fmt!r}: {directive!r} is not supported")
        out += _STRPTIME.get(directive, "%")
        i += 2
    return out


def parse_date(c: Column, formats: str | list[str] | None) -> Column:
    """First format that parses wins; NULL when none does."""
    names = DAY_FIRST_FORMATS if not formats else [formats] if isinstance(formats, str) else formats
    text = stripped(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(spark_date_format(f))) for f in names])


def number(c: Column, default: float | Column | None = None) -> Column:
    parsed = stripped(c).try_cast("double")
    parsed = F.when(F.abs(parsed) < float("inf"), parsed)  # neither NaN, which sorts above all numbers, nor infinite
    return parsed if default is None else F.coalesce(parsed, F.lit(default) if not isinstance(default, Column) else default)


def alias_payment(c: Column) -> Column:
    """Known spelling -> method; anything else is treated as COD."""
    table = F.create_map(*[F.lit(x) for kv in PAYMENT_ALIASES.items() for x in kv])
    return F.coalesce(table[F.upper(stripped(c))], F.lit("COD"))


def alias_channel(c: Column, aliases: dict[str, str], default: str) -> Column:
    text = stripped(c)
    known = F.when(F.upper(text).isin(*KNOWN_CHANNELS), F.upper(text)).otherwise(default)
    if not aliases:
        return known
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)])
    return F.coalesce(table[F.lower(text)], known)


def label_status(status: Column, rto: list[str], delivered: list[str]) -> Column:
    """TRUE for a return, FALSE for a delivery, NULL for anything else."""
    s = F.lower(stripped(status))
    return (F.when(s.isin(*[x.lower() for x in rto]), True)
            .when(s.isin(*[x.lower() for x in delivered]), False))


def device_or_phone(device: Column, phone: Column) -> Column:
    """Without a device id every phone gets one device of its own."""
    return F.when(F.length(F.coalesce(device, F.lit(""))) > 0, device).otherwise(
        F.concat(F.lit("fp_"), F.substring(F.sha1(phone), 1, 24)))


def account_of(phone: Column) -> Column:
    return F.concat(F.lit("acc_"), F.substring(F.sha1(phone), 1, 8))


def with_first_order_flag(df: DataFrame, phone: str = "phone") -> DataFrame:
    """TRUE on the earliest order of each phone (ties by seq, which tells rows apart), through one pre-aggregated minimum per phone."""
    first = (df.groupBy(F.col(phone).alias("_phone")).agg(F.min(F.struct("ts", "seq")).alias("_f"))
             .select("_phone", F.col("_f.seq").alias("_first_seq")))
    same = df[phone].eqNullSafe(first["_phone"]) & (df["seq"] == first["_first_seq"])
    return df.join(first, same, "left").withColumn("is_new_customer", F.col("_first_seq").isNotNull()).drop("_first_seq", "_phone")


def with_row_key(df: DataFrame) -> DataFrame:
    """Add `seq`: the order id, with a number behind it where an export repeats the id.

    Repeats are numbered by their content, so the key does not depend on the order of lines; lines equal in all columns are
    numbered among themselves.
    """
    line = F.xxhash64(*[F.col(c) for c in df.columns])
    n = F.row_number().over(Window.partitionBy("order_id").orderBy("ts", "_line"))
    return df.withColumn("_line", line).withColumn("seq", F.when(n == 1, F.col("order_id")).otherwise(F.concat("order_id", F.lit("#"), n))).drop("_line")


def _typed(raw: DataFrame, mapping: Mapping) -> tuple[DataFrame, list[str]]:
    """Every internal column, plus `_label`, before any row is dropped; and the defaults that were used."""
    used: list[str] = []

    def col(name: str, default=None) -> Column:
        source = mapping.columns.get(name)
        if source in raw.columns:
            return F.col(f"`{source}`")
        if default is not None:
            used.append(name)
        return F.lit(None if default is None else str(default))

    d = mapping.default
    ts = parse_date(col("ts"), mapping.date_format)
    outcome = parse_date(col("outcome_ts", ""), mapping.outcome_date_format or mapping.date_format)
    lag = int(float(d("outcome_lag_days")) * 86_400_000_000)
    phone = phone_digits(col("customer_phone"))
    typed = raw.select(
        col("order_id").alias("order_id"), ts.alias("ts"), outcome.alias("_outcome"),
        label_status(col("status"), mapping.rto, mapping.delivered).alias("_label"),
        phone.alias("phone"), col("customer_email", "").alias("customer_email"),
        account_of(phone).alias("account_id"), device_or_phone(col("device_fingerprint", ""), phone).alias("device"),
        col("ip", "").alias("ip"), col("vpa", "").alias("vpa"), col("card_token", "").alias("card_token"),
        col("shipping_address").alias("shipping_address"), pin_digits(col("delivery_pin")).alias("delivery_pin"),
        number(col("cart_gmv")).alias("cart_gmv"),
        F.coalesce(number(col("items_count", d("items_count"))).try_cast("int"), F.lit(int(float(d("items_count"))))).alias("items_count"),
        number(col("weight_grams", d("weight_grams")), float(d("weight_grams"))).alias("weight_grams"),
        alias_payment(col("payment_method")).alias("payment_method"),
        col("payment_switch_from", "").alias("payment_switch_from"),
        alias_channel(col("acquisition_channel", d("acquisition_channel")), mapping.channel_aliases,
                      d("acquisition_channel")).alias("acquisition_channel"),
        text_flag(col("coupon_applied", "")).alias("coupon_applied"),
        number(col("checkout_seconds", d("checkout_seconds")), float(d("checkout_seconds"))).alias("checkout_seconds"),
        number(col("hour_of_day", "")).alias("_hour"),
        F.lit(False).alias("disputed"),
        number(col("merchant_margin", d("merchant_margin")), float(d("merchant_margin"))).alias("merchant_margin"),
        number(col("cac", d("cac")), float(d("cac"))).alias("cac"),
    )
    typed = typed.withColumns({
        "outcome_ts": F.coalesce("_outcome", F.timestamp_micros(F.unix_micros("ts") + F.lit(lag))),
        "hour_of_day": F.coalesce(F.col("_hour").try_cast("int"), F.hour("ts"), F.lit(0)),
        **{c: F.when(F.col(c) != "", F.col(c)) for c in OPTIONAL_IDS},
    }).drop("_outcome", "_hour")
    return typed, sorted(set(used))


def _keep_rule() -> tuple[Column, Column]:
    dated_and_labelled = F.col("ts").isNotNull() & F.col("_label").isNotNull()
    sound = F.coalesce(F.col("cart_gmv") > 0, F.lit(False)) & (F.length("delivery_pin") == 6)
    return dated_and_labelled, sound


def normalise_orders(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """Typed, labelled, filtered orders with PIN tier and first-order flag."""
    check_mapping(raw, mapping)
    typed, _ = _typed(raw, mapping)
    labelled, sound = _keep_rule()
    kept = typed.filter(labelled & sound).withColumnRenamed("_label", "rto")
    # orders of the same instant are told apart by their id, lines of the same order by their content
    return with_first_order_flag(with_pin_info(with_row_key(kept))).withColumn("cohort", F.lit("unknown"))


def ingest_report(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """One row: rows in and out, drops per reason, COD share, COD RTO rate, defaults used."""
    typed, used = _typed(raw, mapping)
    labelled, sound = _keep_rule()
    out = labelled & sound
    cod = out & (F.col("payment_method") == "COD")
    return typed.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("ts").isNull()).alias("unparseable_date"),
        F.count_if(F.col("ts").isNotNull() & F.col("_label").isNull()).alias("unlabelled_status"),
        F.count_if(labelled & ~sound).alias("bad_amount_or_pin"),
        F.count_if(out).alias("rows_out"),
        F.coalesce(F.try_divide(F.count_if(cod), F.count_if(out)), F.lit(0.0)).alias("cod_share"),
        F.coalesce(F.avg(F.when(cod, F.col("_label").cast("double"))), F.lit(0.0)).alias("cod_rto_rate"),
    ).withColumn("defaults_used", F.array(*[F.lit(x) for x in used]).cast("array<string>"))


def ignored_statuses(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """How many rows carry each status the mapping lists as ignored."""
    c = stripped(F.col(f"`{mapping.columns['status']}`"))
    return raw.filter(F.lower(c).isin(*[s.lower() for s in mapping.ignored])).groupBy(c.alias("status")).count()


# Parcel weight guess by product category (grams).
WEIGHT_BY_CATEGORY = {"T-shirt": 250, "Shirt": 300, "Blazzer": 900, "Trousers": 450, "Perfume": 350, "Wallet": 200,
                      "Socks": 100, "Shoes": 800, "Watch": 300, "Kurta": 350, "Saree": 500, "Set": 600,
                      "Western Dress": 400, "Top": 250, "Ethnic Dress": 500, "Bottom": 400, "Dupatta": 200}
DEFAULT_CATEGORY_WEIGHT = 400.0


def derive_marketplace(raw: DataFrame) -> DataFrame:
    """Columns a marketplace report lacks: customer key, padded PIN, address, weight, payment mode.

    Every order line is its own customer: '9' and nine digits taken from the SHA-1 of the order id.
    """
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns])
    pin = number(F.col("`ship-postal-code`")).try_cast("bigint")
    weights = F.create_map(*[F.lit(x) for k, v in WEIGHT_BY_CATEGORY.items() for x in (k, float(v))])
    text = lambda c: F.initcap(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    out = raw.withColumns({
        "Derived Phone": F.concat(F.lit("9"), F.translate(F.substring(F.sha1("`Order ID`"), 1, 9), "abcdef", "123456")),
        "ship-postal-code": F.when(pin.isNull(), "").when(pin >= 1_000_000, pin.cast("string"))
                             .otherwise(F.lpad(pin.cast("string"), 6, "0")),
        "Derived Weight (g)": F.coalesce(weights[F.col("Category")], F.lit(DEFAULT_CATEGORY_WEIGHT)),
        "Derived Payment Mode": F.lit("COD"),
        "Amount": number(F.col("Amount")), "Qty": number(F.col("Qty")),
    })
    address = F.concat(text("ship-city"), F.lit(", "), text("ship-state"), F.lit(" "), F.col("`ship-postal-code`"))
    out = out.withColumn("Derived Address", F.btrim(address, F.lit(", ")))
    return out.filter((F.col("Amount") > 0) & (F.col("Qty") >= 1) & (F.col("`ship-postal-code`") != ""))
