"""Queries on pricing, decisions and policy evaluation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SHADOW_PRICES
from ..functions import economics as X
from ..functions.text import entity_hash
from ..operators import decide as D
from ..operators import evaluate as V
from ..operators import metrics as M
from ..session import cut_lineage
from ..sources import lens
from .ingest import supplier_config
from .models import decided, split_frame, with_sets
from .registry import add, made
from .sql import q, best_action, cte, entity_hash as hash_sql, pnl, quantile, sql, summary


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.price_orders(lens.scored_cod(spark, sf_dir))


def on_priced(name: str, columns, oracle: str) -> None:
    add(name, lambda s, d: priced(s, d).select("order_id", *made(columns)), sql(f"SELECT order_id, {oracle} FROM priced", "priced"))


def _r(digits: int, *cols: str):
    return lambda: [F.round(c, digits).alias(c) for c in cols]


def _rq(digits: int, **cols: str) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in cols.items())


# ------------------------------------------------------------------ G
on_priced("g1_logistics_and_holding", _r(6, "logistics", "holding"), _rq(6, logistics="logistics", holding="holding"))
add("g1_cost_overrides", lambda s, d: X.price_orders(lens.scored_cod(s, d).withColumns({
    "logistics_loss": F.when(F.col("seq") % 10 == 0, 200.0), "holding_cost": F.when(F.col("seq") % 15 == 0, 7.5)})).select("order_id", *_r(6, "logistics", "holding", "cost_fn")()),
    sql("SELECT order_id, round(l, 6) AS logistics, round(h, 6) AS holding, round(l + h + 0.02e0 * cart_gmv, 6) AS cost_fn FROM (SELECT *, CASE WHEN seq % 10 = 0 THEN 200e0 ELSE logistics END AS l, "
        "CASE WHEN seq % 15 = 0 THEN 7.5e0 ELSE holding END AS h FROM priced)", "priced"))
on_priced("g2_cost_of_a_return", _r(6, "cost_fn"), _rq(6, cost_fn="cost_fn"))
on_priced("g3_cost_of_friction", _r(6, "cost_fp"), _rq(6, cost_fp="cost_fp"))
on_priced("g4_address_attribution", _r(9, "addr_attribution", "rho_stepup", "rho_prepaid"), _rq(9, addr_attribution="attr", rho_stepup="rho_s", rho_prepaid="rho_p"))
on_priced("g5_tau_star", _r(9, "tau_star"), _rq(9, tau_star="tau_star"))
add("g5_tau_star_with_price", lambda s, d: X.price_orders(lens.scored_cod(s, d), shadow_price=F.lit(40.0)).select("order_id", *_r(9, "tau_star", "tau_soft")()),
    sql("SELECT order_id, round(least(1e0, (cost_fp + 40) / (cost_fn + cost_fp)), 9) AS tau_star, round(least(1e0, greatest(0e0, (0.11e0 * cost_fp + 6e0 * (1e0 - 0.11e0) + 40) / "
        "(cost_fn * (1e0 - rho_s) + 0.11e0 * cost_fp - 6e0 * 0.11e0))), 9) AS tau_soft FROM priced", "priced"))
on_priced("g6_tau_soft", _r(9, "tau_soft"), _rq(9, tau_soft="tau_soft"))
on_priced("g7_expected_costs", _r(4, "cost_allow", "cost_stepup", "cost_prepaid"), _rq(4, cost_allow="cost_allow", cost_stepup="cost_stepup", cost_prepaid="cost_prepaid"))
cte("elastic", """SELECT *, least(1e0, greatest(0e0, (cost_allow - icpt) / slope)) AS av, least(1e0, greatest(0e0, (cost_prepaid - icpt) / slope)) AS pv,
 least(1e0, greatest(0e0, least((cost_allow - icpt) / slope, (cost_prepaid - icpt) / slope))) AS crit, CASE WHEN (cost_allow - icpt) / slope <= (cost_prepaid - icpt) / slope THEN 'ALLOW_COD' ELSE 'FORCE_PREPAID' END AS binding
FROM (SELECT *, p * rho_s * cost_fn + 6e0 AS icpt, (1e0 - p) * (cost_fp - 6e0) AS slope FROM priced)""", "priced")
add("g8_deposit_elasticity", lambda s, d: X.with_elasticity(priced(s, d)).select("order_id", "binding", *_r(9, "alpha_vs_allow", "alpha_vs_prepaid", "alpha_crit", "headroom", "rupees_per_point")()),
    sql("SELECT order_id, binding, " + _rq(9, alpha_vs_allow="av", alpha_vs_prepaid="pv", alpha_crit="crit", headroom="crit - 0.11e0", rupees_per_point="slope / 100") + " FROM elastic", "elastic"))
add("g9_elasticity_curve", lambda s, d: X.elasticity_curve(X.with_elasticity(priced(s, d)), ["order_id"]).groupBy("alpha").agg(
    *[F.round(F.avg(c), 6).alias(c) for c in ("cost_stepup_at", "profit_stepup", "profit_allow", "profit_prepaid")]),
    sql("SELECT alpha, round(avg(icpt + slope * alpha), 6) AS cost_stepup_at, round(avg(margin - (icpt + slope * alpha)), 6) AS profit_stepup, round(avg(margin - cost_allow), 6) AS profit_allow, "
        "round(avg(margin - cost_prepaid), 6) AS profit_prepaid FROM elastic, (SELECT unnest([" + ", ".join(f"{a}e0" for a in X.ELASTICITY_ALPHAS) + "]) AS alpha) GROUP BY 1", "elastic"))
add("g10_admissible_actions", lambda s, d: decided(s, d).select("order_id", F.array_join(D.admissible(F.col("certainty")), ",").alias("admissible")),
    sql("SELECT order_id, CASE certainty WHEN 'CERTIFIED_LOW' THEN 'ALLOW_COD' WHEN 'AMBIGUOUS' THEN 'ALLOW_COD,STEP_UP_DEPOSIT,FORCE_PREPAID' ELSE 'STEP_UP_DEPOSIT,FORCE_PREPAID' END AS admissible FROM decided", "decided"))
add("g11_resolver", lambda s, d: decided(s, d).select("order_id", "action", F.round("saving_vs_allow", 4).alias("saving_vs_allow")),
    sql("SELECT order_id, action, round(cost_allow - CASE action WHEN 'ALLOW_COD' THEN cost_allow WHEN 'STEP_UP_DEPOSIT' THEN cost_stepup ELSE cost_prepaid END, 4) AS saving_vs_allow FROM decided", "decided"))
add("g12_budget_changed", lambda s, d: D.resolve(with_sets(split_frame(s, d)), F.lit(60.0)).select("order_id", "action", "budget_changed_action"),
    sql(f"SELECT order_id, priced AS action, priced <> action AS budget_changed_action FROM (SELECT order_id, action, {best_action('60e0')} AS priced FROM decided)", "decided"))
_f2 = lambda x: f"CAST(CAST(round(CAST({x} AS DECIMAL(30, 12)), 2) AS DECIMAL(30, 2)) AS VARCHAR)"
_f0 = lambda x: f"CAST(CAST(round(CAST({x} AS DECIMAL(30, 10)), 0) AS BIGINT) AS VARCHAR)"


def _told(template: str, *parts: str) -> str:
    """A sentence with its gaps filled, as SQL."""
    pieces = [q(x) for x in template.split("%s")]
    return " || ".join(x for pair in zip(pieces, [*parts, "''"], strict=True) for x in pair)


_reason = f"""CASE WHEN certainty = 'CERTIFIED_LOW' THEN {_told('Conformal set {0}: deliverability certified at 1-α. P(RTO)=%s ≤ τ*=%s. Frictionless COD.', _f2('p'), _f2('tau_star'))}
 WHEN certainty = 'CERTIFIED_HIGH' THEN {_told('Conformal set {1}: RTO certified at 1-α. P(RTO)=%s > τ*=%s. %s minimises expected loss (₹%s vs ₹%s on ALLOW).', _f2('p'), _f2('tau_star'),
    "CASE WHEN action = 'STEP_UP_DEPOSIT' THEN 'Soft step-up' ELSE 'Prepaid mandate' END",
    _f0("CASE action WHEN 'ALLOW_COD' THEN cost_allow WHEN 'STEP_UP_DEPOSIT' THEN cost_stepup ELSE cost_prepaid END"), _f0('cost_allow'))}
 WHEN certainty = 'NOVEL' THEN {_told('Conformal set ∅: neither label conforms at α — pattern is outside the calibrated support (novel syndicate signature). Escalating to %s rather than guessing.',
    "CASE WHEN action = 'STEP_UP_DEPOSIT' THEN 'step-up' ELSE 'prepaid' END")}
 WHEN action = 'ALLOW_COD' THEN {_told('Conformal set {0,1}: ambiguous. P(RTO)=%s ≤ τ_soft=%s — CAC insult (₹%s) outweighs shipping exposure (₹%s). Allowing COD, flagged for post-delivery review.',
    _f2('p'), _f2('tau_soft'), _f0('cost_fp'), _f0('cost_fn'))}
 WHEN action = 'STEP_UP_DEPOSIT' THEN {_told('Conformal set {0,1}: ambiguous. P(RTO)=%s is %s the hard-block point τ*=%s but above τ_soft=%s. A refundable ₹49 UPI deposit costs ₹%s expected vs ₹%s on ALLOW, without the ₹%s insult of a hard block.',
    _f2('p'), "CASE WHEN p <= tau_star THEN 'below' ELSE 'above' END", _f2('tau_star'), _f2('tau_soft'), _f0('cost_stepup'), _f0('cost_allow'), _f0('cost_fp'))}
 ELSE {_told('Conformal set {0,1} but P(RTO)=%s ≫ τ*=%s; expected loss under step-up (₹%s) still exceeds prepaid (₹%s). Prepaid mandate.', _f2('p'), _f2('tau_star'), _f0('cost_stepup'), _f0('cost_prepaid'))} END
 || CASE WHEN action = 'FORCE_PREPAID' AND attr >= 0.4e0 THEN {_told(" A deposit buys commitment, not deliverability: %s%% of this order's risk is attributed to the address, so step-up residual RTO is %s%%.".replace('%%', '%'),
    _f0('attr * 100'), _f0('rho_s * 100'))} ELSE '' END"""
add("g13_rationale", lambda s, d: D.with_rationale(decided(s, d)).select("order_id", "action", "action_label", "rationale"),
    sql(f"""SELECT order_id, action, CASE action {' '.join(f"WHEN {q(a)} THEN {q(t)}" for a, t in D.ACTION_LABELS.items())} END AS action_label, {_reason} AS rationale FROM decided""", "decided"))


def valid_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frontier(with_sets(split_frame(spark, sf_dir)).filter("split = 'valid'"))


_grid = "(SELECT unnest([" + ", ".join(f"{x}e0" for x in SHADOW_PRICES) + "]) AS shadow_price)"
cte("front", f"SELECT *, {best_action('shadow_price')} AS act FROM sets, {_grid} WHERE split IN ('valid', 'test')", "sets")
cte("front_valid", "SELECT shadow_price, avg(CASE WHEN act <> 'ALLOW_COD' THEN 1e0 ELSE 0e0 END) AS friction_share FROM front WHERE split = 'valid' GROUP BY 1", "front")
add("g14_budget_to_shadow_price", lambda s, d: D.budget_price(supplier_config(s, d).select("merchant_id", "friction_budget"), valid_frontier(s, d)).select(
    "merchant_id", "friction_budget", D.effective_price(F.lit(None).cast("double"), F.col("frontier_price"), F.lit(0.0)).alias("price")),
    sql("""SELECT 'm' || s_suppkey AS merchant_id, budget AS friction_budget, CASE WHEN budget IS NULL THEN 0e0 ELSE
 coalesce((SELECT min(shadow_price) FROM front_valid WHERE friction_share <= budget), (SELECT max(shadow_price) FROM front_valid)) END AS price
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 13) / 10e0 END AS budget FROM supplier)""", "front_valid"))


def served(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Decided orders with a five-percent control band and one shadow merchant."""
    df = decided(spark, sf_dir, position).withColumn("phone_h", entity_hash("phone", F.col("phone")))
    return D.serve(df, shadow=F.col("merchant_id") == "trial_store")


cte("served", f"""SELECT *, CASE WHEN shadow OR control THEN 'ALLOW_COD' ELSE action END AS served_action,
 CASE WHEN shadow OR action = 'ALLOW_COD' THEN 1e0 WHEN control THEN 0.05e0 ELSE 1e0 - 0.05e0 END AS propensity
FROM (SELECT *, NOT shadow AND action <> 'ALLOW_COD' AND CAST(('0x' || substr(sha256(order_id || '|' || {hash_sql('phone', 'phone')}), 1, 16))::UBIGINT AS DOUBLE) / power(2e0, 64) < 0.05e0 AS control
 FROM (SELECT *, merchant_id = 'trial_store' AS shadow FROM decided))""", "decided")
add("g15_control_band", lambda s, d: served(s, d).select("order_id", "is_control_cohort", "served_action"),
    sql("SELECT order_id, control AS is_control_cohort, served_action FROM served", "served"))
add("g16_propensity", lambda s, d: served(s, d).select("order_id", F.round("propensity", 9).alias("propensity")), sql("SELECT order_id, round(propensity, 9) AS propensity FROM served", "served"))
add("g17_ipw_weight", lambda s, d: served(s, d).select("order_id", F.round(D.ipw_weight(F.col("served_action"), F.col("propensity")), 9).alias("weight")),
    sql("SELECT order_id, CASE WHEN served_action = 'ALLOW_COD' THEN least(20e0, round(1 / propensity, 9)) ELSE 0e0 END AS weight FROM served", "served"))

# ------------------------------------------------------------------ H
SUMMARY = {"n": None, "pnl_total": 2, "pnl_per_order": 4, "pnl_per_1000_gmv": 4, "n_allow": None, "n_stepup": None, "n_prepaid": None, "friction_share": 6,
           "rto_shipped": 4, "rto_prevented": 4, "good_lost": 4, "good_frictioned": None, "bad_frictioned": None, "pnl_good": 2, "pnl_bad": 2}


def tidy(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c) if k is None else F.round(c, k).alias(c) for c, k in SUMMARY.items()])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price every COD order, gate it by its conformal set, pick the cheapest admissible action, sum by action."""
    return tidy(V.simulate(decided(spark, sf_dir), ["action"]), "action")


_three = [(f"pnl_{c}", a) for c, a in (("allow", "ALLOW_COD"), ("stepup", "STEP_UP_DEPOSIT"), ("prepaid", "FORCE_PREPAID"))]
on_priced("h1_order_pnl", lambda: [X.order_pnl(F.lit(a), F.col("rto")).cast("float").alias(n) for n, a in _three],
          ", ".join(f"CAST({pnl(repr(a))} AS FLOAT) AS {n}" for n, a in _three))
add("h2_summary_by_action", flagship, sql(summary("action", "decided"), "decided"))
add("h2_summary_by_split", lambda s, d: tidy(V.simulate(decided(s, d), ["split"]), "split"), sql(summary("split", "decided"), "decided"))


def policies(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Every policy's action for every TEST order; thresholds and budget price are tuned on VALID."""
    # thresholds, frontier and policies all read these two slices
    df = cut_lineage(with_sets(split_frame(spark, sf_dir, position)).filter("split in ('valid', 'test')"))
    valid, test = df.filter("split = 'valid'"), df.filter("split = 'test'")
    choices = M.with_constant(V.tuned_thresholds(valid), V.budget_choice(V.frontier(valid)))
    return V.policy_actions(test, choices)


cte("valid_f1", """SELECT t FROM (SELECT t, tp / CAST(f AS DOUBLE) AS pr, tp / CAST(np AS DOUBLE) AS rc FROM (SELECT p_base AS t, (SELECT count(*) FROM valid x WHERE x.rto AND x.p_base >= v.p_base) AS tp,
 (SELECT count(*) FROM valid x WHERE x.p_base >= v.p_base) AS f, (SELECT count(*) FROM valid WHERE rto) AS np FROM (SELECT DISTINCT p_base FROM valid) v))
 ORDER BY 2 * pr * rc / greatest(pr + rc, 1e-9) DESC, t LIMIT 1""", "valid")
cte("lam", "SELECT coalesce(min(shadow_price) FILTER (friction_share <= 0.3e0), max(shadow_price)) AS lam FROM front_valid", "front_valid")
_block = lambda c: f"CASE WHEN {c} THEN 'FORCE_PREPAID' ELSE 'ALLOW_COD' END"
_policy_sql = {
    V.ALLOW_ALL: "'ALLOW_COD'", V.BASE_HALF: _block("p_base > 0.5e0"), V.BASE_F1: _block("p_base > valid_f1.t"), V.BASE_COST: _block("p_base > t_cost.threshold"),
    V.BASE_TAU: _block("p_base > tau_star"), V.FULL_TAU: _block("p > tau_star"), V.FULL: "action", V.BUDGETED: best_action("lam.lam"),
    V.ORACLE: "CASE WHEN NOT rto THEN 'ALLOW_COD' WHEN {} >= {} THEN 'STEP_UP_DEPOSIT' ELSE 'FORCE_PREPAID' END".format(pnl("'STEP_UP_DEPOSIT'", "true"), pnl("'FORCE_PREPAID'", "true")),
}
cte("pol", " UNION ALL ".join(f"SELECT test.* EXCLUDE (action), '{n}' AS policy, {a} AS action FROM test, valid_f1, t_cost, lam" for n, a in _policy_sql.items()),
    "test", "valid_f1", "t_cost", "lam")
add("h3_policy_comparison", lambda s, d: tidy(V.simulate(policies(s, d), ["policy"]), "policy"), sql(summary("policy", "pol"), "pol"))
cte("pol_pnl", f"SELECT policy, sum({pnl('action')}) AS t FROM pol GROUP BY 1", "pol")
add("h4_policy_deltas", lambda s, d: V.with_deltas(V.simulate(policies(s, d), ["policy"])).select(
    "policy", F.round("delta_vs_allow_all", 2).alias("delta_vs_allow_all"), F.round("delta_vs_base_05", 2).alias("delta_vs_base_05"), F.round("uplift_pct_vs_allow_all", 4).alias("uplift_pct_vs_allow_all")),
    sql(f"""SELECT policy, round(t - a, 2) AS delta_vs_allow_all, round(t - b, 2) AS delta_vs_base_05, round(coalesce(100 * (t - a) / nullif(abs(a), 0), 0), 4) AS uplift_pct_vs_allow_all
FROM pol_pnl, (SELECT max(t) FILTER (policy = '{V.ALLOW_ALL}') AS a, max(t) FILTER (policy = '{V.BASE_HALF}') AS b FROM pol_pnl)""", "pol_pnl"))
add("h5_friction_frontier", lambda s, d: tidy(V.frontier(with_sets(split_frame(s, d)).filter("split in ('valid', 'test')"), ["split"]), "split", "shadow_price"),
    sql(summary("split, shadow_price", "front", "act"), "front"))
add("h6_budget_price_on_test", lambda s, d: (lambda df: tidy(V.simulate(D.resolve(M.with_constant(df.filter("split = 'test'"),
    V.budget_choice(V.frontier(df.filter("split = 'valid'")))), F.col("budget_price")), ["budget_price"]), "budget_price"))(with_sets(split_frame(s, d))),
    sql(summary("lam AS budget_price", "(SELECT pol.*, lam.lam FROM pol, lam WHERE policy = '" + V.BUDGETED + "')").replace("GROUP BY lam AS budget_price", "GROUP BY lam"), "pol", "lam"))
_swept = [(V._slug(n), n) for n in V.SWEPT]
_gap = "full_resolver - greatest(base_global_cost, base_tau, full_tau)"
cte("sens", "SELECT g AS stepup_good_abandon, b AS stepup_bad_abandon, " + ", ".join(f"sum(CASE WHEN policy = '{n}' THEN {pnl('action', 'rto', 'g', 'b')} END) AS {c}" for c, n in _swept)
    + " FROM pol, (SELECT unnest([0.06e0, 0.11e0, 0.18e0, 0.25e0, 0.35e0]) AS g), (SELECT unnest([0.4e0, 0.65e0, 0.85e0]) AS b) GROUP BY 1, 2", "pol")
add("h7_sensitivity_grid", lambda s, d: V.sensitivity(policies(s, d)).select("stepup_good_abandon", "stepup_bad_abandon", *[F.round(c, 2).alias(c) for c, _ in _swept],
    F.round("gap", 2).alias("gap"), "full_beats_best_binary"),
    sql("SELECT stepup_good_abandon, stepup_bad_abandon, " + ", ".join(f"round({c}, 2) AS {c}" for c, _ in _swept) + f", round({_gap}, 2) AS gap, {_gap} > 0 AS full_beats_best_binary FROM sens", "sens"))
cte("steps", f"SELECT stepup_good_abandon AS a0, {_gap} AS g0, lead(stepup_good_abandon) OVER w AS a1, lead({_gap}) OVER w AS g1 FROM sens WHERE stepup_bad_abandon = 0.65e0 "
    "WINDOW w AS (ORDER BY stepup_good_abandon)", "sens")
add("h8_portfolio_breakeven", lambda s, d: V.breakeven(V.sensitivity(policies(s, d))).select(F.round("portfolio_alpha_crit", 6).alias("portfolio_alpha_crit")),
    sql("SELECT round(coalesce((SELECT a0 + (a1 - a0) * g0 / (g0 - g1) FROM steps WHERE g0 > 0 AND g1 <= 0 ORDER BY a0 LIMIT 1), "
        "CASE WHEN (SELECT g0 FROM steps ORDER BY a0 DESC LIMIT 1) > 0 THEN 1e0 END), 6) AS portfolio_alpha_crit", "steps"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidate scores, each with its own conformal quantiles and resolver, on TEST."""
    df = split_frame(spark, sf_dir)
    out = None
    for tag, p in (("full", "p"), ("flat", "p_base")):
        own = X.price_orders(df.withColumn("p", F.col(p)))
        acted = D.resolve(with_sets(own)).filter("split = 'test'").withColumn("tag", F.lit(tag))
        out = acted if out is None else out.unionByName(acted)
    return V.simulate(out, ["tag"])


cte("flat0", "SELECT * REPLACE (0.5e0 * p + 0.125e0 AS p) FROM split", "split")
cte("flat", """SELECT * REPLACE (p * cost_fn AS cost_allow, (1e0 - p) * 0.11e0 * cost_fp + p * rho_s * cost_fn + (1e0 - (1e0 - p) * 0.11e0) * 6e0 AS cost_stepup,
 (1e0 - p) * 0.38e0 * cost_fp + (1e0 - (1e0 - p) * 0.38e0) * rho_p * 60e0 AS cost_prepaid) FROM flat0""", "flat0")
cte("flat_q", f"""SELECT {quantile('1e0 - (1e0 - p)', 'flat', "split = 'conf' AND NOT rto")} AS q0, {quantile('1e0 - p', 'flat', "split = 'conf' AND rto")} AS q1""", "flat")
cte("flat_decided", f"""SELECT *, {best_action('0e0', 'cert')} AS action FROM (SELECT flat.*, CASE WHEN p <= q0 AND (1e0 - p) <= q1 THEN 'AMBIGUOUS' WHEN p <= q0 THEN 'CERTIFIED_LOW'
 WHEN (1e0 - p) <= q1 THEN 'CERTIFIED_HIGH' ELSE 'NOVEL' END AS cert FROM flat, flat_q WHERE split = 'test')""", "flat", "flat_q")
add("h9_candidate_table", lambda s, d: tidy(candidates(s, d), "tag"),
    sql(summary("tag", "(SELECT 'full' AS tag, rto, cart_gmv, margin, cost_fn, cost_fp, rho_s, rho_p, action FROM test UNION ALL SELECT 'flat', rto, cart_gmv, margin, cost_fn, cost_fp, rho_s, rho_p, action FROM flat_decided)"),
        "test", "flat_decided"))


# ---- logged decisions: four cycles by position, the latest orders still without an outcome
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cut_lineage(served(spark, sf_dir, True))
    n = df.agg(F.count("*").alias("_n"))
    return M.with_constant(df, n).withColumn("cycle", F.least(F.lit(3), F.floor(F.col("position") * 4 / F.col("_n"))).cast("int")).drop("_n").withColumn("regime", F.lit("ipw"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cycles(spark, sf_dir)
    return V.training_pool(df.drop("rto"), df.filter("seq % 4 <> 0").select("order_id", "rto"), D.ipw_weight(F.col("served_action"), F.col("propensity")))


cte("cyc", "SELECT *, least(3, CAST(floor(position * 4 / count(*) OVER ()) AS INTEGER)) AS cycle, CASE WHEN served_action = 'ALLOW_COD' THEN least(20e0, 1 / propensity) ELSE 0e0 END AS weight FROM served", "served")
add("h10_training_pool", lambda s, d: pool(s, d).select("order_id", "rto", F.round("weight", 6).alias("weight")),
    sql("SELECT order_id, rto, round(weight, 6) AS weight FROM (SELECT *, count(*) OVER () AS n FROM cyc) WHERE position >= n - floor(0.3e0 * n) AND seq % 4 <> 0 AND weight > 0", "cyc"))


def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cycle as three regimes see it: without a control band, with one and inverse weights, and with every label."""
    allowed = lambda c: F.when(F.col(c) == "ALLOW_COD", 1.0).otherwise(0.0)
    regime = lambda name, seen, weight: F.struct(F.lit(name).alias("regime"), F.col(seen).alias("served"), weight.alias("weight"))
    seen = F.inline(F.array(regime("naive", "action", allowed("action")), regime("ipw", "served_action", D.ipw_weight(F.col("served_action"), F.col("propensity"))),
                            regime("oracle", "action", F.lit(1.0))))
    weighted = cycles(spark, sf_dir).drop("regime").select("cycle", "action", "rto", "p", "p_base", seen).withColumnRenamed("served", "served_action")
    return V.retraining_bias(weighted, ["cycle", "regime"], p_true="p_base")


BIAS = ("weighted_rto_rate", "boundary_pred", "boundary_actual", "boundary_gap", "boundary_ece", "friction_share")
cte("regimes", """SELECT cycle, action, p, CAST(rto AS DOUBLE) AS y, 0.5e0 * p + 0.125e0 >= 0.5e0 AS hb, least(7, CAST(floor(p * 8) AS INTEGER)) AS bin, unnest(['naive', 'ipw', 'oracle']) AS regime,
 unnest([action, served_action, action]) AS seen, unnest([CASE WHEN action = 'ALLOW_COD' THEN 1e0 ELSE 0e0 END, weight, 1e0]) AS w FROM cyc""", "cyc")
add("h11_retraining_bias", lambda s, d: bias(s, d).select("cycle", "regime", "boundary_n", "n_control", "training_rows", *[F.round(c, 9).alias(c) for c in BIAS]),
    sql("""SELECT * EXCLUDE (e, n), round(e / nullif(n, 0), 9) AS boundary_ece FROM (SELECT cycle, regime, count(*) FILTER (hb) AS boundary_n, count(*) FILTER (seen = 'ALLOW_COD' AND action <> 'ALLOW_COD') AS n_control, count(*) FILTER (w > 0) AS training_rows,
 round(sum(w * y) / nullif(sum(w), 0), 9) AS weighted_rto_rate, round(avg(p) FILTER (hb), 9) AS boundary_pred, round(avg(y) FILTER (hb), 9) AS boundary_actual,
 round(avg(y) FILTER (hb) - avg(p) FILTER (hb), 9) AS boundary_gap, round(avg(CASE WHEN seen <> 'ALLOW_COD' THEN 1e0 ELSE 0e0 END), 9) AS friction_share, count(*) FILTER (hb) AS n FROM regimes GROUP BY 1, 2)
 LEFT JOIN (SELECT cycle, regime, sum(abs(d)) AS e FROM (SELECT cycle, regime, bin, sum(p - y) AS d FROM regimes WHERE hb GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (cycle, regime)""", "regimes"))
add("h12_control_band_cost", lambda s, d: V.control_band_cost(cycles(s, d), ["cycle"]).select("cycle", "control_orders", F.round("exploration_cost", 2).alias("exploration_cost")),
    sql(f"SELECT cycle, count(*) AS control_orders, round(sum({pnl('action')} - {pnl(repr('ALLOW_COD'))}), 2) AS exploration_cost FROM cyc WHERE control GROUP BY 1", "cyc"))


def band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst cycle and cumulative P&L per band width; one scan serves every width."""
    base = cycles(spark, sf_dir).drop("draw", "is_control_cohort", "served_action", "propensity")
    widths = F.array(*[F.struct(F.lit(e).alias("epsilon"), F.lit(c).alias("cap")) for e, c in ((0.01, 100.0), (0.02, 50.0), (0.05, 20.0))])
    rows = cut_lineage(D.serve(base.select("*", F.inline(widths)), epsilon=F.col("epsilon"), shadow=F.col("merchant_id") == "trial_store"))
    keys = ["epsilon", "cap", "cycle"]
    weighted = rows.withColumn("weight", F.least("cap", D.ipw_weight(F.col("served_action"), F.col("propensity"), 1e9)))
    per = V.retraining_bias(weighted, keys, p_true="p_base").join(M.calibration_error(rows, "p", "rto", keys), keys) \
        .join(V.simulate(rows, keys, action="served_action").select(*keys, F.col("pnl_total").alias("pnl")), keys).join(
        M.ranking_metrics(M.score_curve(rows, "p", "rto", keys), keys).select(*keys, "auc"), keys)
    cost = V.control_band_cost(rows, ["epsilon", "cap"])
    return V.cycle_summary(per, ["epsilon", "cap"]).join(cost, ["epsilon", "cap"], "left")


_draw = f"CAST(('0x' || substr(sha256(order_id || '|' || {hash_sql('phone', 'phone')}), 1, 16))::UBIGINT AS DOUBLE) / power(2e0, 64)"
cte("bands", f"""SELECT *, CASE WHEN shadow OR ctl THEN 'ALLOW_COD' ELSE action END AS srv FROM (SELECT cyc.*, epsilon, cap, NOT shadow AND action <> 'ALLOW_COD' AND {_draw} < epsilon AS ctl
 FROM cyc, (VALUES (0.01e0, 100e0), (0.02e0, 50e0), (0.05e0, 20e0)) w(epsilon, cap))""", "cyc")
_ece_bin = "len(list_filter(range(1, 15), lambda i: i * (1e0 / 15) <= p))"
cte("band_cycles", f"""SELECT * FROM (SELECT epsilon, cap, cycle, abs(avg(CAST(rto AS DOUBLE)) FILTER (0.5e0 * p + 0.125e0 >= 0.5e0) - avg(p) FILTER (0.5e0 * p + 0.125e0 >= 0.5e0)) AS gap, sum({pnl('srv')}) AS pnl FROM bands GROUP BY 1, 2, 3)
 JOIN (SELECT epsilon, cap, cycle, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT epsilon, cap, cycle, {_ece_bin} AS b, count(*) AS n, avg(p) AS mp, avg(CAST(rto AS DOUBLE)) AS my FROM bands GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (epsilon, cap, cycle)
 JOIN (SELECT epsilon, cap, cycle, (sum(r) FILTER (rto) - count(*) FILTER (rto) * (count(*) FILTER (rto) + 1) / 2e0) / (count(*) FILTER (rto) * CAST(count(*) FILTER (NOT rto) AS DOUBLE)) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY epsilon, cap, cycle ORDER BY p) + (count(*) OVER (PARTITION BY epsilon, cap, cycle, p) - 1) / 2e0 AS r FROM bands) GROUP BY 1, 2, 3) USING (epsilon, cap, cycle)""", "bands")
cte("band_summary", f"""SELECT * FROM (SELECT epsilon, cap, max(gap) AS max_abs_boundary_gap, max(ece) AS max_ece, min(auc) AS min_auc, sum(pnl) AS cumulative_pnl FROM band_cycles GROUP BY 1, 2)
 JOIN (SELECT epsilon, cap, count(*) AS control_orders, sum({pnl('action')} - {pnl(repr('ALLOW_COD'))}) AS exploration_cost FROM bands WHERE ctl GROUP BY 1, 2) USING (epsilon, cap)""", "band_cycles", "bands")
add("h13_band_summary", lambda s, d: band_summary(s, d).select("epsilon", "cap", "control_orders", F.round("max_abs_boundary_gap", 6).alias("max_abs_boundary_gap"), F.round("max_ece", 6).alias("max_ece"),
    F.round("min_auc", 6).alias("min_auc"), F.round("cumulative_pnl", 2).alias("cumulative_pnl"), F.round("exploration_cost", 2).alias("exploration_cost")),
    sql("SELECT epsilon, cap, control_orders, round(max_abs_boundary_gap, 6) AS max_abs_boundary_gap, round(max_ece, 6) AS max_ece, round(min_auc, 6) AS min_auc, round(cumulative_pnl, 2) AS cumulative_pnl, round(exploration_cost, 2) AS exploration_cost FROM band_summary", "band_summary"))
add("h13_cheapest_band", lambda s, d: V.cheapest_band(band_summary(s, d)),
    sql("""SELECT epsilon, cap, ok AS acceptable FROM (SELECT *, max_ece <= 0.1 AND min_auc >= 0.75 AS ok FROM band_summary)
ORDER BY ok DESC, CASE WHEN ok THEN exploration_cost ELSE max_ece END, epsilon, cap LIMIT 1""", "band_summary"))
cte("walk", f"SELECT policy, position + 1 AS orders, sum({pnl('action')}) OVER (PARTITION BY policy ORDER BY position) AS x FROM (SELECT * EXCLUDE (position), row_number() OVER (PARTITION BY policy ORDER BY position) - 1 AS position FROM pol)", "pol")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cut_lineage(policies(spark, sf_dir, True))
    first = a.agg(F.min("position").alias("_f"))
    return V.pnl_trajectory(M.with_constant(a, first).withColumn("position", F.col("position") - F.col("_f")))


add("h14_pnl_trajectory", lambda s, d: trajectory(s, d).select("policy", "orders", F.round("pnl", 2).alias("pnl")),
    sql("SELECT policy, orders, round(x, 2) AS pnl FROM walk WHERE orders % 250 = 0", "walk"))
