"""Training on Spark ML: weighted trees, isotonic calibration, ablations and the node scorer."""
from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import P_CEIL, P_FLOOR, WEIGHT_TEMPERATURES
from ..functions.text import clip
from ..session import cut_lineage
from .conformal import apply_sets, calibrate
from .decide import resolve
from .evaluate import simulate
from .metrics import calibration_error, ranking_metrics, score_curve, with_constant

# the pooling step travels with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TREES, DEPTH, STEP, SUBSAMPLE = 60, 5, 0.1, 0.85
#: Columns that sets and prices of scored rows read, features or not.
PRICED = ("cart_gmv", "merchant_margin", "cac", "is_new_customer", "weight_grams", "addr_defect_score", "pin_tier")


def instance_weights(priced: DataFrame, gamma: float, y: str = "rto") -> DataFrame:
    """Add `weight`: the rupee cost of misjudging the row, tempered by gamma and scaled to mean 1."""
    raw = F.pow(F.when(F.col(y), F.col("cost_fn")).otherwise(F.col("cost_fp")), F.lit(float(gamma)))
    df = priced.withColumn("_w", raw)
    return with_constant(df, df.agg(F.avg("_w").alias("_m"))).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_trees(df: DataFrame, features: list[str], *, y: str = "rto", weight: str | None = None, max_trees: int = MAX_TREES,
              depth: int = DEPTH, seed: int = 7):
    """Boosted trees on the train slice, stopped early on the valid slice (column `split`)."""
    data = assembled(df.filter(F.col("split").isin("train", "valid")), features).select(
        "features", F.col(y).cast("double").alias("label"), (F.col("split") == "valid").alias("is_valid"),
        *([F.col(weight).alias("w")] if weight else []))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_trees, maxDepth=depth, stepSize=STEP,
                        subsamplingRate=SUBSAMPLE, seed=seed, validationIndicatorCol="is_valid")
    if weight:
        gbt = gbt.setWeightCol("w")
    return gbt.fit(data)


def score_trees(model, df: DataFrame, features: list[str], out: str = "p_raw") -> DataFrame:
    scored = model.transform(assembled(df, features))
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c not in df.columns]
    return scored.withColumn(out, F.round(vector_to_array("probability")[1], 6)).drop(*drop)


@dataclass(frozen=True)
class IsotonicFit:
    """A monotone fit by the ends of its pools: constant inside a pool, a line from one to the next, constant outside."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]

    def of(self, score: Column) -> Column:
        xs, ys = np.array(self.xs), np.array(self.ys)

        @F.pandas_udf("double")
        def value(p: pd.Series) -> pd.Series:
            return pd.Series(np.interp(p, xs, ys)).where(p.notna().to_numpy())

        return value(score.cast("double"))


def pool_adjacent(points: Iterable[tuple[float, float, float, float]], pools: list[list[float]] | None = None) -> list[list[float]]:
    """Points or pools (first score, last score, label sum, weight) in rising order as pools of rising means.

    Pooling in any order ends at the same pools, so those of neighbouring ranges can be pooled again.
    """
    pools = [] if pools is None else pools
    for low, high, total, weight in points:
        pools.append([low, high, total, weight])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, total, weight = pools.pop()
            pools[-1][1] = high
            pools[-1][2] += total
            pools[-1][3] += weight
    return pools


def fit_isotonic(df: DataFrame, score: str = "p_raw", y: str = "rto", weight: str | None = None) -> IsotonicFit:
    """Monotone calibration: ranges of scores are pooled where they lie, what is left of each is pooled once more.

    Rows are summed per distinct (six-decimal) score first, which leaves the fit unchanged.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    points = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(
        F.sum(w * F.col(y).cast("double")).alias("s"), F.sum(w).alias("w"))

    def of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pools: list[list[float]] = []
        for pdf in batches:
            pool_adjacent(zip(pdf["x"], pdf["x"], pdf["s"], pdf["w"], strict=True), pools)
        if pools:
            yield pd.DataFrame(pools, columns=["low", "high", "s", "w"])

    ranges = points.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(of_range, "low double, high double, s double, w double")
    # a range hands on few pools; sorting them here spares a second pass that samples them
    pools = pool_adjacent(sorted(tuple(r) for r in ranges.collect()))
    ends = [(x, total / weight) for low, high, total, weight in pools for x in sorted({low, high})]
    return IsotonicFit(tuple(x for x, _ in ends), tuple(v for _, v in ends))


def knots(model: IsotonicFit) -> tuple[list[float], list[float]]:
    """The model as (x, y) knots, y clipped to [0.001, 0.999]."""
    return list(model.xs), [min(P_CEIL, max(P_FLOOR, v)) for v in model.ys]


def apply_knots(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear value at p, constant outside the knots."""
    ax, ay = F.array(*[F.lit(float(x)) for x in xs]), F.array(*[F.lit(float(y)) for y in ys])
    i = F.size(F.filter(ax, lambda x: x <= p))
    x0, y0 = F.element_at(ax, i), F.element_at(ay, i)
    x1, y1 = F.element_at(ax, i + 1), F.element_at(ay, i + 1)
    return (F.when(i == 0, F.lit(float(ys[0]))).when(i >= len(xs), F.lit(float(ys[-1])))
            .otherwise(y0 + (p - x0) * (y1 - y0) / (x1 - x0)))


def calibrated(model: IsotonicFit, df: DataFrame, score: str = "p_raw", out: str = "p") -> DataFrame:
    """Raw score -> calibrated and clipped probability."""
    return df.withColumn(out, F.round(clip(model.of(F.col(score)), P_FLOOR, P_CEIL), 6))


def candidate(data: DataFrame, features: list[str], gamma: float, **tree_args) -> tuple[DataFrame, DataFrame, object]:
    """Fit one weight temperature. Returns (one metrics row, scored valid/conf/test rows, model).

    data: priced rows with `split`, the features and the pricing columns. The conf slice sets the conformal
    quantiles; VALID P&L selects, TEST metrics report.
    """
    weighted = instance_weights(data, gamma) if gamma > 0 else data.withColumn("weight", F.lit(1.0))
    model = fit_trees(weighted, features, weight="weight", **tree_args)
    raw = score_trees(model, data.filter(F.col("split") != "train"), features)
    iso = fit_isotonic(raw.filter("split = 'calib'"))
    # written once: sets, prices and metrics read it, and none should walk the trees again
    scored = cut_lineage(calibrated(iso, raw.filter("split in ('valid', 'conf', 'test')")).drop(*[f for f in features if f not in PRICED]))
    q = calibrate(scored.filter("split = 'conf'"), variants=("class",))
    return model, scored, q


def candidate_metrics(scored: DataFrame, quantiles: DataFrame, price, gamma: float) -> DataFrame:
    """VALID and TEST P&L of the resolver plus TEST ranking and calibration of one candidate, as one row."""
    acted = resolve(price(apply_sets(scored, quantiles)))
    pnl = simulate(acted.filter("split in ('valid', 'test')"), ["split"]).groupBy().pivot("split", ["valid", "test"]).agg(F.first("pnl_total"))
    test = scored.filter("split = 'test'")
    row = with_constant(with_constant(pnl, ranking_metrics(score_curve(test, "p", "rto"))), calibration_error(test, "p", "rto"))
    return row.select(F.lit(float(gamma)).alias("gamma"), F.col("valid").alias("valid_pnl"), F.col("test").alias("test_pnl"),
                      "auc", "pr_auc", "ece")


def select_candidate(table: DataFrame) -> DataFrame:
    """The candidate with the best VALID P&L; the smallest gamma wins a tie."""
    best = table.agg(F.max(F.struct("valid_pnl", (-F.col("gamma")).alias("neg"))).alias("b"))
    return with_constant(table, best.select((-F.col("b.neg")).alias("_g"))).withColumn(
        "selected", F.col("gamma") == F.col("_g")).drop("_g")


def sweep(data: DataFrame, features: list[str], price, gammas: tuple[float, ...] = WEIGHT_TEMPERATURES, **tree_args) -> DataFrame:
    rows = []
    for g in gammas:
        _, scored, q = candidate(data, features, g, **tree_args)
        rows.append(candidate_metrics(scored, q, price, g))
    return select_candidate(reduce(DataFrame.unionByName, rows))


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """Gain share and rank per feature."""
    gains = model.featureImportances.toArray().tolist()
    ranked = sorted(zip(features, gains), key=lambda kv: (-kv[1], kv[0]))
    rows = [(name, float(gain), i + 1) for i, (name, gain) in enumerate(ranked)]
    return spark.createDataFrame(rows, "feature string, gain_share double, rank int")


def ablation(data: DataFrame, features: list[str], extras: list[list[str]], **tree_args) -> DataFrame:
    """Refit with each list of extra columns: AUC, PR-AUC and the gain share of the extras on TEST."""
    rows = []
    for extra in extras:
        names = features + extra
        model = fit_trees(data.na.fill(0.0, extra) if extra else data, names, **tree_args)
        test = score_trees(model, data.filter("split = 'test'").na.fill(0.0, extra) if extra else data.filter("split = 'test'"), names)
        gain = dict(zip(names, model.featureImportances.toArray().tolist()))
        rows.append(ranking_metrics(score_curve(test, "p_raw", "rto")).withColumns({
            "extra": F.lit(",".join(extra)), "n_features": F.lit(len(names)),
            "extra_gain_share": F.lit(float(sum(gain[e] for e in extra)))}))
    return reduce(DataFrame.unionByName, rows)


# ------------------------------------------------------------------ node scorer
def fit_node_scorer(labelled: DataFrame, columns: list[str], label: str = "label", reg: float = 0.01):
    data = cut_lineage(assembled(labelled, columns).select("features", F.col(label).cast("double").alias("label")))
    return LogisticRegression(regParam=reg, maxIter=50, standardization=False).fit(data)


def score_nodes(model, nodes: DataFrame, columns: list[str], out: str = "score") -> DataFrame:
    scored = model.transform(assembled(nodes, columns))
    return scored.select("node", F.round(vector_to_array("probability")[1], 6).alias(out))


def out_of_fold(nodes: DataFrame, labels: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """Cross-fitted scores: every labelled node is scored by a model that did not see it; others get NULL."""
    data = nodes.join(labels, "node", "left").withColumn("_fold", F.pmod(F.xxhash64("node"), F.lit(folds)))
    # every fold reads the labelled nodes again
    known = cut_lineage(data.filter(F.col("label").isNotNull()))
    held = []
    for f in range(folds):
        model = fit_node_scorer(known.filter(F.col("_fold") != f), columns)
        held.append(score_nodes(model, known.filter(F.col("_fold") == f), columns))
    scores = reduce(DataFrame.unionByName, held)
    return nodes.select("node").join(scores, "node", "left")
