"""Decision ledger: append-only JSON lines of decisions and outcomes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "kind string, order_id string, merchant_id string, segment string, ts timestamp, p_loss double, certainty string, "
    "policy_action string, served_action string, is_control_cohort boolean, shadow boolean, propensity double, "
    "epsilon double, draw double, gmv double, addr_attribution double, features array<double>, rto boolean, "
    "stepup_result string, prepaid_result string")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, outcomes); lines that are not JSON objects are skipped, all others that are no decision count as outcomes."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    decision = F.coalesce(F.col("kind") == "decision", F.lit(False))
    return rows.filter(decision), rows.filter(~decision)


def append_ledger(df: DataFrame, path: str, kind: str) -> None:
    df.withColumn("kind", F.lit(kind)).write.mode("append").json(path)


def tally(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decisions, control cohort, shadow orders, outcomes."""
    true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    d = decisions.agg(F.count(F.lit(1)).alias("decisions"), true("is_control_cohort").alias("control_cohort"),
                      true("shadow").alias("shadow"))
    o = outcomes.agg(F.count(F.lit(1)).alias("outcomes"))
    return d.withColumn("_k", F.lit(1)).join(o.withColumn("_k", F.lit(1)), "_k").drop("_k")


def served_mix(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("served_action").agg(F.count(F.lit(1)).alias("n"))


def recent_sample(orders: DataFrame, n: int, *, tail: int = 15_000, cohort: str | None = None, seed: int = 0) -> DataFrame:
    """n random COD orders out of the latest `tail`; both limits are the feature (a picker)."""
    recent = orders.filter(F.col("payment_method") == "COD").orderBy(F.desc("ts"), F.desc("seq")).limit(tail)
    if cohort is not None:
        recent = recent.filter(F.col("cohort") == cohort)
    return recent.orderBy(F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), "order_id"), 256), "order_id").limit(n)
