"""Drift monitoring: five-minute windows, rolling hour, stability index and alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CERTAINTIES
from .conformal import AMBIGUOUS, HIGH, NOVEL
from .metrics import HIST_BINS, floor_bin, with_constant

# Window geometry and alert thresholds.
WINDOW_SECONDS, KEEP_WINDOWS, EXPIRE_WINDOWS = 300, 12, 14
EMPTY_SHARE, Z_LIMIT, AMBIGUITY_FLOOR, MIX_RATIO, PSI_LIMIT, MIN_N = 0.03, 4.0, 0.08, 1.5, 0.10, 50
PSI_FLOOR = 1e-4
# Baseline used when no report exists.
FALLBACK_SHARE = {"CERTIFIED_LOW": 0.3, "AMBIGUOUS": 0.5, "CERTIFIED_HIGH": 0.2, "NOVEL": 0.0}

COUNTS = tuple(f"n_{c.lower()}" for c in CERTAINTIES)


def known_certainty(c: Column) -> Column:
    return F.when(c.isin(*CERTAINTIES), c).otherwise(NOVEL)


def window_aggregates(p: str = "p", certainty: str = "certainty") -> list[Column]:
    """n, one count per certainty, and the 20-bin score histogram as an array."""
    b = floor_bin(F.col(p), HIST_BINS)
    cert = known_certainty(F.col(certainty))
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(cert == c).alias(k) for c, k in zip(CERTAINTIES, COUNTS)],
            *[F.count_if(b == i).alias(f"h{i}") for i in range(HIST_BINS)]]


def drift_windows(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """Tumbling five-minute windows: counts by certainty and histogram (columns h0..h19)."""
    return (stream.groupBy(F.window(ts, f"{WINDOW_SECONDS} seconds").alias("w")).agg(*window_aggregates())
            .withColumn("bucket", F.floor(F.unix_seconds("w.start") / WINDOW_SECONDS).cast("bigint")).drop("w"))


_MEASURES = ("n", *COUNTS, *[f"h{i}" for i in range(HIST_BINS)])


def rolling_hour(windows: DataFrame, keep: int = KEEP_WINDOWS) -> DataFrame:
    """Sum over the last 12 buckets ending at each bucket, empty buckets included.

    Each bucket is handed to the 12 hours it belongs to, so no bucket spine and no single-task window is
    needed; only hours up to the last bucket seen are kept.
    """
    last = windows.agg(F.max("bucket").alias("_last"))
    spread = with_constant(windows, last).withColumn("bucket", F.explode(F.sequence(
        F.col("bucket"), F.least(F.col("_last"), F.col("bucket") + keep - 1))))
    return spread.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _MEASURES])


def shares(df: DataFrame) -> DataFrame:
    return df.withColumns({f"share_{c.lower()}": F.coalesce(F.try_divide(F.col(k), F.col("n")), F.lit(0.0))
                           for c, k in zip(CERTAINTIES, COUNTS)})


def baseline(reference: DataFrame | None, spark=None, p: str = "p", certainty: str = "certainty") -> DataFrame:
    """One row: certainty shares (b_share_*), histogram probabilities (b_hist array) and size of a reference sample."""
    agg = reference.agg(*window_aggregates(p, certainty))
    empty = F.col("n") == 0
    out = {f"b_share_{c.lower()}": F.when(empty, FALLBACK_SHARE[c]).otherwise(F.try_divide(F.col(k), F.col("n")))
           for c, k in zip(CERTAINTIES, COUNTS)}
    hist = F.array(*[F.when(empty, 1.0 / HIST_BINS).otherwise(F.try_divide(F.col(f"h{i}"), F.col("n"))) for i in range(HIST_BINS)])
    return agg.select(F.col("n").alias("b_n"), *[c.alias(k) for k, c in out.items()], hist.alias("b_hist"))


def psi(live: Column, base: Column) -> Column:
    """Population stability index of two histograms given as arrays of probabilities."""
    def term(a: Column, b: Column) -> Column:
        x, y = F.greatest(a, F.lit(PSI_FLOOR)), F.greatest(b, F.lit(PSI_FLOOR))
        return (x - y) * F.log(x / y)
    return F.aggregate(F.zip_with(live, base, term), F.lit(0.0), lambda acc, t: acc + t)


def live_hist() -> Column:
    return F.array(*[F.coalesce(F.try_divide(F.col(f"h{i}"), F.col("n")), F.lit(0.0)) for i in range(HIST_BINS)])


def monitor(rolling: DataFrame, base: DataFrame) -> DataFrame:
    """Alerts and status of every rolling hour."""
    df = with_constant(shares(rolling), base)
    df = df.withColumn("score_psi", F.when(F.col("n") > 0, psi(live_hist(), F.col("b_hist"))).otherwise(0.0))
    amb, amb0 = F.col(f"share_{AMBIGUOUS.lower()}"), F.col(f"b_share_{AMBIGUOUS.lower()}")
    hi, hi0 = F.col(f"share_{HIGH.lower()}"), F.col(f"b_share_{HIGH.lower()}")
    empty = F.col(f"share_{NOVEL.lower()}")
    sd = F.sqrt(F.greatest(amb0 * (1 - amb0), F.lit(1e-6)) / F.greatest(F.col("n"), F.lit(1)))
    df = df.withColumn("z_ambiguous", (amb - amb0) / sd)
    z = F.abs("z_ambiguous")

    def alert(cond: Column, code: str, critical: Column | bool, value: Column, limit: Column) -> Column:
        sev = F.when(critical if isinstance(critical, Column) else F.lit(critical), "critical").otherwise("warning")
        return F.when(cond, F.struct(F.lit(code).alias("code"), sev.alias("severity"), F.round(value, 4).alias("value"),
                                     F.round(limit, 4).alias("threshold")))

    alerts = F.filter(F.array(
        alert(empty > EMPTY_SHARE, "MODEL_EPISTEMIC_DRIFT", True, empty, F.lit(EMPTY_SHARE)),
        alert((z > Z_LIMIT) & (F.abs(amb - amb0) > AMBIGUITY_FLOOR), "MODEL_EPISTEMIC_DRIFT", z > 2 * Z_LIMIT, amb, amb0),
        alert((hi0 > 0) & (hi > MIX_RATIO * hi0), "MODEL_RISK_MIX_SHIFT", False, hi, MIX_RATIO * hi0),
        alert(F.col("score_psi") > PSI_LIMIT, "MODEL_SCORE_PSI", F.col("score_psi") > 2.5 * PSI_LIMIT, F.col("score_psi"), F.lit(PSI_LIMIT)),
    ), lambda a: a.isNotNull())
    warm = F.col("n") >= MIN_N
    df = df.withColumn("alerts", F.when(warm, alerts).otherwise(F.filter(alerts, lambda a: F.lit(False))))
    critical = F.exists("alerts", lambda a: a["severity"] == "critical")
    return df.withColumn("status", F.when(~warm, "WARMING").when(critical, "ALERT")
                         .when(F.size("alerts") > 0, "WARN").otherwise("OK"))


def first_alert(placed: DataFrame, base: DataFrame, every: int = 300) -> DataFrame:
    """First position, checked every `every` orders at one order per second, at which the status is ALERT.

    placed: position (0-based), p, certainty. A check at position k sees the buckets of its rolling hour up
    to itself, so each order is booked to the checks that can see it (at most 12 of them).
    """
    if WINDOW_SECONDS != every:
        raise ValueError("checks are aligned with the five-minute windows")
    # at one order per second, bucket b holds exactly the orders 300 b .. 300 b + 299
    per_bucket = placed.groupBy(F.floor(F.col("position") / every).cast("bigint").alias("bucket")).agg(*window_aggregates())
    hours = monitor(rolling_hour(per_bucket), base)
    # a trailing partial bucket is never checked
    last = placed.agg(F.count(F.lit(1)).alias("_n"))
    hours = with_constant(hours, last).filter((F.col("bucket") + 1) * every <= F.col("_n"))
    return hours.agg(F.min(F.when(F.col("status") == "ALERT", (F.col("bucket") + 1) * every)).alias("first_alert_after_orders"),
                     F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "ALERT").alias("alert_checks"))
