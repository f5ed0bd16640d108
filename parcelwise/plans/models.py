"""Queries on splits, metrics, training and conformal sets."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFORMAL_ALPHAS
from ..functions.economics import price_orders
from ..operators import conformal as C
from ..operators import decide, evaluate, pit, training
from ..operators import metrics as M
from ..session import cut_lineage
from ..sources import lens
from .history import features
from .registry import add
from .sql import best_action, cte, pnl, quantile, sql


def split_frame(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Priced COD orders with their chronological split and a second, flatter score; their position in time only on request."""
    priced = price_orders(lens.scored_cod(spark, sf_dir)).withColumn("p_base", 0.5 * F.col("p") + 0.125)
    return M.chronological_split(priced.select(*[c for c in POLICY_COLUMNS if c in priced.columns]), position=position)


# what pricing, policies and explanations read
POLICY_COLUMNS = (
    "order_id", "seq", "ts", "rto", "phone", "merchant_id", "acquisition_channel", "pin_tier", "p", "p_base", "cart_gmv", "merchant_margin", "cac",
    "is_new_customer", "weight_grams", "addr_defect_score", "addr_has_house_no", "coupon_applied", "checkout_seconds", "hour_of_day",
    "margin", "addr_attribution", "shadow_price", "cost_fn", "cost_fp", "rho_stepup", "rho_prepaid", "tau_star", "tau_soft",
    "cost_allow", "cost_stepup", "cost_prepaid", "position", "split")


def part(spark: SparkSession, sf_dir: str, name: str, position: bool = False) -> DataFrame:
    """One slice, written once: its users read it several times."""
    return cut_lineage(split_frame(spark, sf_dir, position).filter(F.col("split") == name))


def with_sets(df: DataFrame, variants: tuple[str, ...] = ("class",), alphas: tuple[float, ...] = (0.10,)) -> DataFrame:
    """Conformal sets from the conf slice, on every row.

    The scored rows are written once: calibration reads one slice of them and application all of them, and
    neither should parse addresses again.
    """
    df = cut_lineage(df.select(*[c for c in POLICY_COLUMNS if c in df.columns]))
    return C.apply_sets(df, C.calibrate(df.filter("split = 'conf'"), alphas, variants=variants))


def decided(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    return decide.resolve(with_sets(split_frame(spark, sf_dir, position)))


cte("train", "SELECT * FROM split WHERE split = 'train'", "split")
cte("valid", "SELECT *, 0.5e0 * p + 0.125e0 AS p_base FROM split WHERE split = 'valid'", "split")
cte("conf", "SELECT * FROM split WHERE split = 'conf'", "split")
cte("test", "SELECT *, 0.5e0 * p + 0.125e0 AS p_base FROM decided WHERE split = 'test'", "decided")
cte("tested", "SELECT p, rto, count(*) OVER () AS n, count(*) FILTER (rto) OVER () AS np FROM test", "test")

# ------------------------------------------------------------------ E
add("e1_chronological_split", lambda s, d: split_frame(s, d, True).select("order_id", "position", "split"), sql("SELECT order_id, position, split FROM split", "split"))
add("e2_instance_weights", lambda s, d: training.instance_weights(part(s, d, "train"), 0.5).select("order_id", F.round("weight", 6).alias("weight")),
    sql("SELECT order_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT order_id, power(CASE WHEN rto THEN cost_fn ELSE cost_fp END, 0.5e0) AS w FROM train)", "train"))

MODEL_FEATURES = list(pit.FEATURE_NAMES)  # the whole vector, as known just before each order
TREES = {"max_trees": training.MAX_TREES, "depth": training.DEPTH}  # early stopping on the valid slice ends most fits sooner


def modelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split frame with the feature vector of each order, written once because training reads it many times.

    All orders count in the vectors, only COD orders have one made. Both sides lie by `seq` already, which `order_id` repeats.
    """
    keep = ["order_id", "seq", "ts", "rto", "split", "cart_gmv", "merchant_margin", "cac", "is_new_customer", "cost_fn", "cost_fp", "p_base"]
    vector = features(spark, sf_dir, F.col("payment_method") == "COD").select("seq", *MODEL_FEATURES)
    return cut_lineage(split_frame(spark, sf_dir).select(*keep).join(vector, "seq").select(*keep, *MODEL_FEATURES))


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = modelling(spark, sf_dir)
    model = training.fit_trees(data, MODEL_FEATURES, **TREES)
    return training.score_trees(model, data, MODEL_FEATURES)


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cut_lineage(tree_scores(spark, sf_dir))
    return training.calibrated(training.fit_isotonic(raw.filter("split = 'calib'")), raw)


def isotonic_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = training.fit_isotonic(part(spark, sf_dir, "calib"), "p")
    xs, ys = training.knots(model)
    return spark.createDataFrame(list(zip(xs, ys)), "x double, y double").select(F.round("x", 6).alias("x"), F.round("y", 9).alias("y"))


def _isotonic(p: str, source: str, where: str) -> None:
    """The isotonic fit of `rto` on `p` by its max-min formula, and its knots."""
    cte(f"{p}points", f"""SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS ss, sum(w) OVER (ORDER BY x) AS ww
 FROM (SELECT p AS x, count(*) FILTER (rto) AS s, count(*) AS w FROM {source} WHERE {where} GROUP BY 1)""", source)
    cte(f"{p}least", f"""SELECT a.i AS a, b.i AS b, min((b.ss - a.ss + a.s) / CAST(b.ww - a.ww + a.w AS DOUBLE)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m
 FROM {p}points a JOIN {p}points b ON a.i <= b.i""", f"{p}points")
    cte(f"{p}fitted", f"SELECT x, v, sum(fresh) OVER (ORDER BY x) AS pool FROM (SELECT x, v, CASE WHEN round(v, 9) = round(lag(v) OVER (ORDER BY x), 9) THEN 0 ELSE 1 END AS fresh "
        f"FROM (SELECT any_value(x) AS x, max(m) AS v FROM {p}least JOIN {p}points ON i = b GROUP BY b))", f"{p}least", f"{p}points")
    cte(f"{p}knots", f"SELECT DISTINCT unnest([lo, hi]) AS x, v FROM (SELECT min(x) AS lo, max(x) AS hi, max(v) AS v FROM {p}fitted GROUP BY pool)", f"{p}fitted")


_isotonic("iso_", "split", "split = 'calib'")


KNOTS = ([0.05, 0.2, 0.35, 0.5, 0.7, 0.95], [0.001, 0.12, 0.12, 0.41, 0.66, 0.999])
_segments = " ".join(f"WHEN p < {x1}e0 THEN {y0}e0 + (p - {x0}e0) * ({y1}e0 - {y0}e0) / ({x1}e0 - {x0}e0)"
                     for x0, x1, y0, y1 in zip(KNOTS[0], KNOTS[0][1:], KNOTS[1], KNOTS[1][1:]))
add("e3_tree_scores", lambda s, d: tree_scores(s, d).select("order_id", "split", "p_raw"))
add("e4_candidate_selection", lambda s, d: training.sweep(modelling(s, d), MODEL_FEATURES, price_orders, **TREES))
add("e5_isotonic_knots", isotonic_knots, sql("SELECT round(x, 6) AS x, round(least(0.999e0, greatest(0.001e0, v)), 9) AS y FROM iso_knots", "iso_knots"))
add("e6_knot_application", lambda s, d: split_frame(s, d).select("order_id", F.round(training.apply_knots(F.col("p"), *KNOTS), 9).alias("p_cal")),
    sql(f"SELECT order_id, round(CASE WHEN p < 0.05e0 THEN 0.001e0 {_segments} ELSE 0.999e0 END, 9) AS p_cal FROM split", "split"))
add("e7_batch_scores", lambda s, d: calibrated_scores(s, d).select("order_id", "split", "p_raw", "p"))


def test_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_curve(part(spark, sf_dir, "test"), "p", "rto")


cte("curve", """SELECT p AS t, max(np) AS np, (SELECT count(*) FROM test x WHERE x.rto AND x.p >= tested.p) AS tp, (SELECT count(*) FROM test x WHERE x.p >= tested.p) AS flagged,
 count(*) FILTER (rto) AS pos FROM tested GROUP BY p""", "tested", "test")
cte("pr", "SELECT *, tp / CAST(flagged AS DOUBLE) AS pr, tp / CAST(np AS DOUBLE) AS rc FROM curve", "curve")
add("e8_auc_and_average_precision", lambda s, d: M.ranking_metrics(test_curve(s, d)).select(F.round("auc", 9).alias("auc"), F.round("pr_auc", 9).alias("pr_auc")),
    sql("""SELECT (SELECT round((sum(r) FILTER (rto) - max(np) * (max(np) + 1) / 2e0) / (max(np) * CAST(max(n) - max(np) AS DOUBLE)), 9)
 FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM tested)) AS auc,
 (SELECT round(sum(pos / CAST(np AS DOUBLE) * pr), 9) FROM pr) AS pr_auc""", "tested", "pr"))
add("e9_log_loss_and_brier", lambda s, d: part(s, d, "test").agg(F.round(M.log_loss(F.col("p"), F.col("rto")), 9).alias("logloss"),
                                                                F.round(M.brier(F.col("p"), F.col("rto")), 9).alias("brier")),
    sql("SELECT round(avg(-ln(CASE WHEN rto THEN p ELSE 1e0 - p END)), 9) AS logloss, round(avg(power(p - CAST(rto AS DOUBLE), 2)), 9) AS brier FROM test", "test"))
_edge = lambda p, b: f"len(list_filter(range(1, {b}), lambda i: i * (1e0 / {b}) <= {p}))"
add("e10_calibration_error", lambda s, d: M.calibration_error(part(s, d, "test"), "p", "rto").select(F.round("ece", 9).alias("ece")),
    sql(f"SELECT round(sum(n * abs(mp - my)) / sum(n), 9) AS ece FROM (SELECT {_edge('p', 15)} AS b, count(*) AS n, avg(p) AS mp, avg(CAST(rto AS DOUBLE)) AS my FROM test GROUP BY 1)", "test"))
add("e11_decile_curve", lambda s, d: M.decile_curve(test_curve(s, d)).select("decile", F.round("p_mean", 9).alias("p_mean"), F.round("rto_rate", 9).alias("rto_rate"), "n"),
    sql("""SELECT len(list_filter(inner_edges, lambda e: e < p)) AS decile, round(avg(p), 9) AS p_mean, round(avg(CAST(rto AS DOUBLE)), 9) AS rto_rate, count(*) AS n FROM test,
 (SELECT e[2:len(e) - 1] AS inner_edges FROM (SELECT list_sort(list_distinct([quantile_cont(p, x) FOR x IN []])) AS unused, list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM test)) GROUP BY 1"""
        .replace("list_sort(list_distinct([quantile_cont(p, x) FOR x IN []])) AS unused, ", ""), "test"))
add("e12_histograms", lambda s, d: M.histogram(part(s, d, "test"), "p").withColumn("what", F.lit("p")).unionByName(
    M.histogram(part(s, d, "test"), "tau_star").withColumn("what", F.lit("tau_star"))),
    sql(f"SELECT 'p' AS what, {_edge('p', 20)} AS bin, count(*) AS n FROM test GROUP BY 2 UNION ALL SELECT 'tau_star', {_edge('tau_star', 20)}, count(*) FROM test GROUP BY 2", "test"))
add("e13_confusion_metrics", lambda s, d: M.confusion(part(s, d, "test"), F.col("p") >= 0.5, F.col("rto")).select(
    "n", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")]),
    sql("""SELECT n, tp, fp, fn, tn, round((tp + tn) / n, 9) AS accuracy, round(tp / greatest(1, tp + fp), 9) AS precision, round(tp / greatest(1, tp + fn), 9) AS recall,
 round(tn / greatest(1, tn + fp), 9) AS specificity, round(2 * tp / greatest(1, 2 * tp + fp + fn), 9) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND rto) AS tp,
 count(*) FILTER (p >= 0.5 AND NOT rto) AS fp, count(*) FILTER (p < 0.5 AND rto) AS fn, count(*) FILTER (p < 0.5 AND NOT rto) AS tn FROM test)""", "test"))
add("e14_f1_threshold", lambda s, d: M.best_f1(test_curve(s, d)).select("threshold", F.round("f1", 9).alias("f1")),
    sql("SELECT t AS threshold, round(2 * pr * rc / greatest(pr + rc, 1e-9), 9) AS f1 FROM pr ORDER BY 2 * pr * rc / greatest(pr + rc, 1e-9) DESC, t LIMIT 1", "pr"))

cte("cost_bins", f"SELECT len(list_filter(range(0, 91), lambda i: 0.05e0 + i * 0.01e0 < p_base)) AS b, sum({pnl(chr(39) + 'ALLOW_COD' + chr(39))}) AS a, sum({pnl(chr(39) + 'FORCE_PREPAID' + chr(39))}) AS x FROM valid GROUP BY 1", "valid")
cte("t_cost", "SELECT 0.05e0 + i * 0.01e0 AS threshold, pnl_total FROM (SELECT i, round(sum(CASE WHEN b > i THEN x ELSE a END), 4) AS pnl_total FROM cost_bins, range(0, 91) t(i) GROUP BY 1) ORDER BY pnl_total DESC, threshold LIMIT 1", "cost_bins")
add("e15_cost_threshold", lambda s, d: (lambda v: M.best_cost_threshold(v, "p_base", evaluate.order_pnl(F.lit("ALLOW_COD"), F.col("rto")),
    evaluate.order_pnl(F.lit("FORCE_PREPAID"), F.col("rto"))))(part(s, d, "valid")).select(F.round("threshold", 6).alias("threshold"), F.round("pnl_total", 2).alias("pnl_total")),
    sql("SELECT round(threshold, 6) AS threshold, round(pnl_total, 2) AS pnl_total FROM t_cost", "t_cost"))
add("e16_precision_at_recall", lambda s, d: M.precision_at_recall(test_curve(s, d), 0.8).select(F.round("precision", 9).alias("precision"), "threshold"),
    sql("SELECT round(pr, 9) AS precision, t AS threshold FROM pr WHERE rc >= 0.8e0 ORDER BY pr DESC, t LIMIT 1", "pr"))
add("e16_recall_at_precision", lambda s, d: M.recall_at_precision(test_curve(s, d), 0.5).select(F.round("recall", 9).alias("recall")),
    sql("SELECT round(coalesce(max(rc), 0), 9) AS recall FROM pr WHERE pr >= 0.5e0", "pr"))
add("e17_feature_importance", lambda s, d: training.feature_importance(training.fit_trees(modelling(s, d), MODEL_FEATURES, **TREES), MODEL_FEATURES, s))
add("e18_feature_ablation", lambda s, d: training.ablation(modelling(s, d), MODEL_FEATURES, [[], ["p_base"], ["p_base", "cac"]], **TREES))

# ------------------------------------------------------------------ F
cte("alphas", "SELECT unnest([" + ", ".join(f"{a}e0" for a in CONFORMAL_ALPHAS) + "]) AS alpha")
cte("cells", """SELECT variant, grp, cls, s, row_number() OVER (PARTITION BY variant, grp, cls ORDER BY s) AS rn, count(*) OVER (PARTITION BY variant, grp, cls) AS n FROM (
 SELECT 'marginal' AS variant, 0 AS grp, -1 AS cls, CASE WHEN rto THEN 1e0 - p ELSE 1e0 - (1e0 - p) END AS s FROM conf
 UNION ALL SELECT 'class', 0, CAST(rto AS INTEGER), CASE WHEN rto THEN 1e0 - p ELSE 1e0 - (1e0 - p) END FROM conf
 UNION ALL SELECT 'class_x_tier', pin_tier, CAST(rto AS INTEGER), CASE WHEN rto THEN 1e0 - p ELSE 1e0 - (1e0 - p) END FROM conf)""", "conf")
cte("cell_q", "SELECT variant, grp, cls, alpha, s AS q, n FROM cells, alphas WHERE rn = least(n, greatest(1, CAST(ceil((n + 1) * (1 - alpha)) AS BIGINT)))", "cells", "alphas")
cte("q_wide", """SELECT variant, grp, alpha, coalesce(max(q) FILTER (cls IN (0, -1)), 1e0) AS q0, coalesce(max(q) FILTER (cls IN (1, -1)), 1e0) AS q1,
 coalesce(max(n) FILTER (cls IN (0, -1)), 0) AS n0, coalesce(max(n) FILTER (cls IN (1, -1)), 0) AS n1 FROM cell_q GROUP BY 1, 2, 3""", "cell_q")
cte("q_table", """SELECT variant, grp, alpha, q0, q1, n0, n1 FROM q_wide UNION ALL SELECT 'class_x_tier', t, c.alpha, c.q0, c.q1, 0, 0 FROM range(1, 5) r(t), (SELECT * FROM q_wide WHERE variant = 'class') c
 WHERE NOT EXISTS (SELECT 1 FROM q_wide x WHERE x.variant = 'class_x_tier' AND x.grp = t)""", "q_wide")
cte("swept", """SELECT s.*, q.variant, q.alpha, p <= q0 AS in0, (1e0 - p) <= q1 AS in1, CASE WHEN p <= q0 AND (1e0 - p) <= q1 THEN 'AMBIGUOUS' WHEN p <= q0 THEN 'CERTIFIED_LOW'
 WHEN (1e0 - p) <= q1 THEN 'CERTIFIED_HIGH' ELSE 'NOVEL' END AS cert FROM split s JOIN q_table q ON q.grp = CASE q.variant WHEN 'class_x_tier' THEN s.pin_tier ELSE 0 END""", "split", "q_table")
METRICS = ("coverage_class0", "coverage_class1", "coverage_marginal", "frac_singleton", "frac_ambiguous", "frac_empty")
_metric_sql = """count(*) FILTER (NOT rto) AS n0, count(*) FILTER (rto) AS n1, round(coalesce(avg(CAST(in0 AS DOUBLE)) FILTER (NOT rto), 0), 9) AS coverage_class0,
 round(coalesce(avg(CAST(in1 AS DOUBLE)) FILTER (rto), 0), 9) AS coverage_class1, round(avg(CAST(CASE WHEN rto THEN in1 ELSE in0 END AS DOUBLE)), 9) AS coverage_marginal,
 round(avg(CAST(in0 <> in1 AS DOUBLE)), 9) AS frac_singleton, round(avg(CAST(in0 AND in1 AS DOUBLE)), 9) AS frac_ambiguous, round(avg(CAST(NOT in0 AND NOT in1 AS DOUBLE)), 9) AS frac_empty"""


def quantiles(spark: SparkSession, sf_dir: str, variants=("marginal", "class", "class_x_tier"), alphas=CONFORMAL_ALPHAS) -> DataFrame:
    return C.calibrate(part(spark, sf_dir, "conf"), alphas, variants=variants)


def variant_query(name: str, variant: str) -> None:
    add(name, lambda s, d: quantiles(s, d, (variant,)), sql(f"SELECT * FROM q_table WHERE variant = '{variant}'", "q_table"))


def metric_columns() -> list:
    return ["n0", "n1", *[F.round(c, 9).alias(c) for c in METRICS]]


add("f1_finite_sample_quantile", lambda s, d: C.cell_quantiles(part(s, d, "conf").withColumn("c", F.col("rto").cast("int")), ["c"],
    C.nonconformity(F.col("p"), F.col("rto")), CONFORMAL_ALPHAS), sql("SELECT cls AS c, alpha, q, n FROM cell_q WHERE variant = 'class'", "cell_q"))
variant_query("f2_class_calibrator", "class")
add("f2_empirical_coverage", lambda s, d: (lambda df: C.set_metrics(C.apply_sets(df, C.calibrate(df, (0.10,), variants=("class",))), []).select(
    *metric_columns()))(part(s, d, "conf")), sql(f"SELECT {_metric_sql} FROM sets WHERE split = 'conf'", "sets"))
variant_query("f3_marginal_calibrator", "marginal")
variant_query("f4_group_calibrator", "class_x_tier")
add("f5_prediction_sets", lambda s, d: with_sets(split_frame(s, d)).select("order_id", "in0", "in1", F.concat_ws(",", C.conformal_set(F.col("in0"), F.col("in1"))).alias("conformal_set")),
    sql("SELECT order_id, in0, in1, CASE certainty WHEN 'AMBIGUOUS' THEN '0,1' WHEN 'CERTIFIED_LOW' THEN '0' WHEN 'CERTIFIED_HIGH' THEN '1' ELSE '' END AS conformal_set FROM sets", "sets"))
add("f6_set_metrics", lambda s, d: C.set_metrics(with_sets(split_frame(s, d)).filter("split = 'test'"), []).select(*metric_columns()),
    sql(f"SELECT {_metric_sql} FROM sets WHERE split = 'test'", "sets"))
add("f7_coverage_by_tier", lambda s, d: C.set_metrics(with_sets(split_frame(s, d)).filter("split = 'test'"), ["pin_tier"]).select("pin_tier", *metric_columns()),
    sql(f"SELECT pin_tier, {_metric_sql} FROM sets WHERE split = 'test' GROUP BY 1", "sets"))


def sweep_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sets(split_frame(spark, sf_dir), ("marginal", "class", "class_x_tier"), CONFORMAL_ALPHAS)


cte("by_tier", """SELECT variant, alpha, pin_tier, count(*) FILTER (NOT rto) AS n0, count(*) FILTER (rto) AS n1, coalesce(avg(CAST(in0 AS DOUBLE)) FILTER (NOT rto), 0) AS c0,
 coalesce(avg(CAST(in1 AS DOUBLE)) FILTER (rto), 0) AS c1 FROM swept WHERE split = 'test' GROUP BY 1, 2, 3""", "swept")
cte("short_cells", """SELECT variant, alpha, coalesce(string_agg(cell, ',' ORDER BY cell) FILTER (short), '') AS undercovered_cells FROM (
 SELECT variant, alpha, 'tier' || pin_tier || '/class0' AS cell, n0 > 0 AND c0 < 1 - alpha - 0.02e0 AS short FROM by_tier
 UNION ALL SELECT variant, alpha, 'tier' || pin_tier || '/class1', n1 > 0 AND c1 < 1 - alpha - 0.02e0 FROM by_tier) GROUP BY 1, 2""", "by_tier")
add("f7_undercovered_cells", lambda s, d: C.undercovered(C.set_metrics(sweep_sets(s, d).filter("split = 'test'"), ["variant", "alpha", "pin_tier"]), ["variant", "alpha"]),
    sql("SELECT * FROM short_cells", "short_cells"))


def conformal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage on TEST and resolver P&L on VALID and TEST per variant and alpha; the VALID argmax is marked."""
    return sweep_report(sweep_sets(spark, sf_dir))


def sweep_report(sets: DataFrame) -> DataFrame:
    sets = decide.resolve(sets)
    m = C.set_metrics(sets.filter("split = 'test'"), ["variant", "alpha"])
    p = evaluate.simulate(sets.filter("split in ('valid', 'test')"), ["variant", "alpha", "split"])
    wide = p.groupBy("variant", "alpha").agg(*[F.max(F.when(F.col("split") == x, F.round("pnl_total", 2))).alias(f"{x}_pnl") for x in ("valid", "test")])
    best = wide.agg(F.max_by(F.struct("variant", "alpha"), F.struct("valid_pnl", (-F.col("alpha")).alias("a"), "variant")).alias("v"),
                    F.max_by(F.struct("variant", "alpha"), F.struct("test_pnl", (-F.col("alpha")).alias("a"), "variant")).alias("t"))
    me = F.struct("variant", "alpha")
    return (M.with_constant(m.join(wide, ["variant", "alpha"]), best)
            .withColumns({"chosen_on_valid": F.col("v") == me, "best_on_test": F.col("t") == me}).drop("v", "t"))


_act = best_action("0e0", "cert")
add("f8_conformal_sweep", lambda s, d: conformal_sweep(s, d).select("variant", "alpha", *metric_columns(), "valid_pnl", "test_pnl", "chosen_on_valid", "best_on_test"),
    sql(f"""SELECT m.*, valid_pnl, test_pnl, row_number() OVER (ORDER BY valid_pnl DESC, alpha, variant DESC) = 1 AS chosen_on_valid, row_number() OVER (ORDER BY test_pnl DESC, alpha, variant DESC) = 1 AS best_on_test
FROM (SELECT variant, alpha, {_metric_sql} FROM swept WHERE split = 'test' GROUP BY 1, 2) m JOIN (SELECT variant, alpha, round(sum(x) FILTER (split = 'valid'), 2) AS valid_pnl, round(sum(x) FILTER (split = 'test'), 2) AS test_pnl
 FROM (SELECT variant, alpha, split, {pnl('act')} AS x FROM (SELECT *, {_act} AS act FROM swept WHERE split IN ('valid', 'test'))) GROUP BY 1, 2) USING (variant, alpha)""", "swept"))
add("f9_certainty_class", lambda s, d: with_sets(split_frame(s, d)).select("order_id", C.certainty(F.col("in0"), F.col("in1")).alias("certainty")),
    sql("SELECT order_id, certainty FROM sets", "sets"))
add("f10_rto_by_certainty", lambda s, d: C.rto_by_certainty(with_sets(split_frame(s, d)).filter("split = 'test'")).select("certainty", "n", F.round("rto_rate", 9).alias("rto_rate")),
    sql("SELECT certainty, count(*) AS n, round(avg(CAST(rto AS DOUBLE)), 9) AS rto_rate FROM sets WHERE split = 'test' GROUP BY 1", "sets"))


def recalibrated(spark: SparkSession, sf_dir: str, isotonic: bool) -> DataFrame:
    """Fit on the first 30 % of the TEST regime, report coverage on the rest."""
    regime = part(spark, sf_dir, "test", True)
    n = regime.agg(F.floor(0.3 * F.count("*")).alias("_cut"), F.min("position").alias("_first"))
    marked = M.with_constant(regime, n).withColumn("fresh", F.col("position") - F.col("_first") < F.col("_cut"))
    if isotonic:
        marked = training.calibrated(training.fit_isotonic(marked.filter("fresh"), "p"), marked.withColumnRenamed("p", "p_raw"))
    q = C.calibrate(marked.filter("fresh"), (0.10,), variants=("class",))
    return C.set_metrics(C.apply_sets(marked.filter("not fresh"), q), []).select(*metric_columns())


cte("regime", "SELECT *, row_number() OVER (ORDER BY position) - 1 < floor(0.3e0 * count(*) OVER ()) AS fresh FROM test", "test")
cte("regime_q", f"SELECT {quantile('1e0 - (1e0 - p)', 'regime', 'fresh AND NOT rto')} AS r0, {quantile('1e0 - p', 'regime', 'fresh AND rto')} AS r1", "regime")
add("f11_recalibrated_quantiles", lambda s, d: recalibrated(s, d, False),
    sql(f"SELECT {_metric_sql} FROM (SELECT rto, p <= r0 AS in0, (1e0 - p) <= r1 AS in1 FROM regime, regime_q WHERE NOT fresh)", "regime", "regime_q"))
_isotonic("fresh_", "regime", "fresh")
cte("lined", """SELECT x AS x0, v AS v0, coalesce(lead(x) OVER (ORDER BY x), x + 1) AS x1, coalesce(lead(v) OVER (ORDER BY x), v) AS v1 FROM fresh_knots
UNION ALL (SELECT -1, v, x, v FROM fresh_knots ORDER BY x LIMIT 1)""", "fresh_knots")
cte("relearnt", """SELECT r.* REPLACE (round(least(0.999e0, greatest(0.001e0, v0 + (r.p - x0) * ((v1 - v0) / (x1 - x0)))), 6) AS p) FROM regime r ASOF JOIN lined ON r.p >= x0""", "regime", "lined")
cte("relearnt_q", f"SELECT {quantile('1e0 - (1e0 - p)', 'relearnt', 'fresh AND NOT rto')} AS r0, {quantile('1e0 - p', 'relearnt', 'fresh AND rto')} AS r1", "relearnt")
add("f11_recalibrated_scores", lambda s, d: recalibrated(s, d, True),
    sql(f"SELECT {_metric_sql} FROM (SELECT rto, p <= r0 AS in0, (1e0 - p) <= r1 AS in1 FROM relearnt, relearnt_q WHERE NOT fresh)", "relearnt", "relearnt_q"))
