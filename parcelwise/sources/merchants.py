"""Merchant configuration: read, check, and resolve the economics of every order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXPLORATION_EPSILON, Economics
from ..functions.economics import ECON_FIELDS

DEFAULT_MERCHANT = "main_store"
SCHEMA = ("merchant_id string, label string, economics map<string,double>, friction_budget double, "
          "epsilon double, shadow boolean")


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, each with its merchant_id."""
    return spark.read.schema(SCHEMA).json(path)


def violations(config: DataFrame) -> DataFrame:
    """Rows that break a rule, with the broken rules; valid configurations return nothing."""
    fields = F.array(*[F.lit(f) for f in ECON_FIELDS])
    unknown = F.array_sort(F.array_except(F.coalesce(F.map_keys("economics"), F.array().cast("array<string>")), fields))
    share = lambda c: F.coalesce((F.col(c) < 0) | (F.col(c) > 1), F.lit(False))
    broken = F.filter(F.array(
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown economics fields: "), F.array_join(unknown, ","))),
        F.when(share("friction_budget"), "friction_budget must be in [0, 1]"),
        F.when(share("epsilon"), "epsilon must be in [0, 1]")), lambda v: v.isNotNull())
    return config.withColumn("violations", broken).filter(F.size("violations") > 0).select("merchant_id", "violations")


def resolve_merchants(orders: DataFrame, config: DataFrame, default_id: str = DEFAULT_MERCHANT,
                      base: Economics | None = None) -> DataFrame:
    """Attach econ_<field>, budget, epsilon and shadow flag per order.

    An unknown merchant takes the default merchant's row with known=false; a field a merchant leaves out
    takes the global default.
    """
    b = (base or Economics()).to_dict()
    field = lambda f: F.coalesce(F.col("economics")[f], F.lit(float(b[f])))
    table = config.select(F.col("merchant_id").alias("_mid"), *[field(f).alias(f"econ_{f}") for f in ECON_FIELDS],
                          F.col("friction_budget").alias("merchant_budget"),
                          F.coalesce("epsilon", F.lit(EXPLORATION_EPSILON)).alias("epsilon"),
                          F.coalesce("shadow", F.lit(False)).alias("shadow"))
    ids = table.select(F.col("_mid").alias("_known"))
    j = orders.join(ids, F.col("merchant_id") == F.col("_known"), "left")
    j = j.withColumn("merchant_known", F.col("_known").isNotNull()).withColumn(
        "merchant_config", F.coalesce("_known", F.lit(default_id))).drop("_known")
    return j.join(table, F.col("merchant_config") == F.col("_mid"), "left").drop("_mid")


def effective(df: DataFrame) -> DataFrame:
    """Margin and CAC per order: the request's value, else the merchant's, else the global default."""
    own = lambda c, fallback: F.coalesce(F.col(c), F.col(fallback)) if c in df.columns else F.col(fallback)
    return df.withColumns({"merchant_margin": own("merchant_margin", "econ_default_margin"),
                           "cac": own("cac", "econ_default_cac")})
