"""Split-conformal sets: finite-sample quantiles per cell, applied as two comparisons."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CERTAINTIES, CONFORMAL_ALPHA, CONFORMAL_VARIANTS, UNDERCOVER_TOL
from ..functions.literals import literal_table
from .running import running

LOW, AMBIGUOUS, HIGH, NOVEL = CERTAINTIES
TIERS = (1, 2, 3, 4)


def nonconformity(p: Column, y: Column) -> Column:
    """Score of the observed label; the two forms are kept apart on purpose, down to the last bit."""
    return F.when(y, 1.0 - p).otherwise(1.0 - (1.0 - p))


def cell_quantiles(df: DataFrame, cells: list[str], score: Column, alphas: tuple[float, ...]) -> DataFrame:
    """(cells..., alpha, q, n): the k-th smallest score, k = ceil((n + 1)(1 - alpha)) clipped to [1, n]."""
    counted = df.groupBy(*cells, score.alias("q")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, cells, ["q"], {"_below": ("sum", F.col("_c"))}, block=F.floor(F.col("q") * 1000).cast("bigint"))
    wanted = (counted.groupBy(*cells).agg(F.sum("_c").alias("n"))
              .withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))))
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * (1 - F.col("alpha")))))
    return (ranked.join(wanted.withColumn("_k", k), cells)
            .filter((F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_below") + F.col("_c")))
            .select(*cells, "alpha", "q", "n"))


def calibrate(df: DataFrame, alphas: tuple[float, ...] = (CONFORMAL_ALPHA,), *, p: str = "p", y: str = "rto",
              tier: str = "pin_tier", variants: tuple[str, ...] = CONFORMAL_VARIANTS) -> DataFrame:
    """Quantiles of every variant in one pass: (variant, grp, alpha, q0, q1, n0, n1).

    grp is 0, except for class_x_tier where it is the tier 1..4. A tier without calibration rows falls back
    to the class quantiles; a class without rows gets 1. The table has at most 6 rows per alpha.
    """
    cell = {"marginal": (F.lit(0), F.lit(-1)), "class": (F.lit(0), F.col(y).cast("int")),
            "class_x_tier": (F.col(tier), F.col(y).cast("int"))}
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), cell[v][0].alias("grp"), cell[v][1].alias("cls"))
                      for v in dict.fromkeys((*variants, "class"))])
    long = df.select(F.col(p).alias("_p"), F.col(y).alias("_y"), F.inline(cells))
    q = cell_quantiles(long, ["variant", "grp", "cls"], nonconformity(F.col("_p"), F.col("_y")), alphas)
    pick = lambda c, k: F.max(F.when(F.col("cls").isin(k, -1), F.col(c)))
    wide = q.groupBy("variant", "grp", "alpha").agg(
        F.coalesce(pick("q", 0), F.lit(1.0)).alias("q0"), F.coalesce(pick("q", 1), F.lit(1.0)).alias("q1"),
        F.coalesce(pick("n", 0), F.lit(0)).alias("n0"), F.coalesce(pick("n", 1), F.lit(0)).alias("n1"))
    spine = [(v, g, float(a)) for v in variants for g in (TIERS if v == "class_x_tier" else (0,)) for a in alphas]
    full = literal_table(df.sparkSession, spine, "variant", "grp", "alpha").withColumn("alpha", F.col("alpha").cast("double"))
    fallback = wide.filter("variant = 'class'").select("alpha", F.col("q0").alias("f0"), F.col("q1").alias("f1"))
    out = full.join(wide, ["variant", "grp", "alpha"], "left").join(fallback, "alpha", "left")
    return out.select("variant", "grp", "alpha", F.coalesce("q0", "f0", F.lit(1.0)).alias("q0"),
                      F.coalesce("q1", "f1", F.lit(1.0)).alias("q1"),
                      F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"))


def apply_sets(df: DataFrame, quantiles: DataFrame, *, p: str = "p", tier: str = "pin_tier") -> DataFrame:
    """Add variant, alpha, in0 and in1; one output row per row and (variant, alpha) of the quantile table."""
    q = quantiles.select("variant", "grp", "alpha", "q0", "q1")
    # every variant of the table is offered; a variant reads its own group
    long = df.withColumn("_grps", F.array(F.lit(0), F.col(tier).cast("int")))
    rows = long.withColumn("_g", F.explode("_grps")).drop("_grps")
    j = rows.join(F.broadcast(q), F.col("_g") == F.col("grp")).drop("_g", "grp")
    return j.withColumns({"in0": F.col(p) <= F.col("q0"), "in1": (1.0 - F.col(p)) <= F.col("q1")}).drop("q0", "q1")


def certainty(in0: Column, in1: Column) -> Column:
    return (F.when(in0 & ~in1, LOW).when(in1 & ~in0, HIGH).when(in0 & in1, AMBIGUOUS).otherwise(NOVEL))


def conformal_set(in0: Column, in1: Column) -> Column:
    return F.filter(F.array(F.when(in0, 0), F.when(in1, 1)), lambda v: v.isNotNull())


def set_metrics(df: DataFrame, by: list[str], y: str = "rto") -> DataFrame:
    """Coverage per class and overall, and the mix of set sizes."""
    label, i0, i1 = F.col(y), F.col("in0"), F.col("in1")
    hit = F.when(label, i1).otherwise(i0)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count_if(~label).alias("n0"), F.count_if(label).alias("n1"),
        F.coalesce(share(F.when(~label, i0)), F.lit(0.0)).alias("coverage_class0"),
        F.coalesce(share(F.when(label, i1)), F.lit(0.0)).alias("coverage_class1"),
        share(hit).alias("coverage_marginal"), share(i0 != i1).alias("frac_singleton"),
        share(i0 & i1).alias("frac_ambiguous"), share(~i0 & ~i1).alias("frac_empty"))


def undercovered(by_tier: DataFrame, keys: list[str]) -> DataFrame:
    """Names of the (tier, class) cells whose coverage misses 1 - alpha by more than the tolerance."""
    short = lambda n, c: (F.col(n) > 0) & (F.col(c) < 1 - F.col("alpha") - F.lit(UNDERCOVER_TOL))
    name = lambda c: F.concat(F.lit("tier"), F.col("pin_tier"), F.lit(f"/class{c}"))
    cells = F.filter(F.array(F.when(short("n0", "coverage_class0"), name(0)), F.when(short("n1", "coverage_class1"), name(1))),
                     lambda v: v.isNotNull())
    # four tiers at most per key
    return by_tier.withColumn("_c", cells).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.flatten(F.collect_list("_c"))), ",").alias("undercovered_cells"))


def rto_by_certainty(df: DataFrame, by: list[str] | None = None, y: str = "rto") -> DataFrame:
    return (df.groupBy(*(by or []), certainty(F.col("in0"), F.col("in1")).alias("certainty"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rto_rate")))
