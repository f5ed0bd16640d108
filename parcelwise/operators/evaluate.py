"""Counterfactual policy evaluation: every policy, sweep and frontier in one pass over the priced orders."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (ACTIONS, ALLOW, FRICTION_BUDGET, PREPAID, SENSITIVITY_BAD_ABANDON, SENSITIVITY_GOOD_ABANDON,
                      SHADOW_PRICES, STEP_UP, BuyerBehaviour)
from ..functions.economics import behaviour_columns, order_pnl, sim_rho
from .conformal import certainty
from .decide import cheapest
from .metrics import best_cost_threshold, best_f1, score_curve, with_constant
from .running import running

ALLOW_ALL, BASE_HALF, BASE_F1, BASE_COST, BASE_TAU = "ALLOW_ALL", "BASE@0.5", "BASE@F1", "BASE@GLOBAL_COST", "BASE@TAU*(x)"
FULL_TAU, FULL, ORACLE = "FULL@TAU*(x)", "FULL", "ORACLE"
BUDGETED = f"FULL@F<={int(FRICTION_BUDGET * 100)}%"


def block_if(condition: Column) -> Column:
    return F.when(condition, PREPAID).otherwise(ALLOW)


def simulate(df: DataFrame, by: list[str], action: str = "action", y: str = "rto",
             sim: dict[str, Column] | BuyerBehaviour | None = None) -> DataFrame:
    """P&L, action mix, expected returns shipped and good buyers lost, per group of priced rows."""
    s = behaviour_columns(sim)
    a, bad = F.col(action), F.col(y)
    rows = df.withColumns({
        "_pnl": order_pnl(a, bad, s),
        "_ship": F.when(~bad, 0.0).when(a == ALLOW, 1.0)
                  .when(a == STEP_UP, (1 - s["stepup_bad_abandon"]) * sim_rho(s, "stepup"))
                  .otherwise((1 - s["prepaid_bad_abandon"]) * sim_rho(s, "prepaid")),
        "_lost": F.when(bad | (a == ALLOW), 0.0).when(a == STEP_UP, s["stepup_good_abandon"]).otherwise(s["prepaid_good_abandon"]),
    })
    frictioned = a != ALLOW
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_pnl").alias("pnl_total"), F.avg("_pnl").alias("pnl_per_order"),
        (1000 * F.sum("_pnl") / F.sum("cart_gmv")).alias("pnl_per_1000_gmv"),
        *[F.count_if(a == x).alias(f"n_{c}") for x, c in zip(ACTIONS, ("allow", "stepup", "prepaid"))],
        F.avg(frictioned.cast("double")).alias("friction_share"),
        F.sum("_ship").alias("rto_shipped"), (F.count_if(bad) - F.sum("_ship")).alias("rto_prevented"),
        F.sum("_lost").alias("good_lost"), F.count_if(frictioned & ~bad).alias("good_frictioned"),
        F.count_if(frictioned & bad).alias("bad_frictioned"),
        F.sum(F.when(~bad, F.col("_pnl")).otherwise(0.0)).alias("pnl_good"),
        F.sum(F.when(bad, F.col("_pnl")).otherwise(0.0)).alias("pnl_bad"))
    return agg


def frontier(df: DataFrame, by: list[str] | None = None, prices: tuple = SHADOW_PRICES) -> DataFrame:
    """Friction share and P&L at every shadow price, from one scan of priced rows with in0 / in1."""
    cert = certainty(F.col("in0"), F.col("in1"))
    grid = df.withColumn("_cert", cert).withColumn("shadow_price", F.explode(F.array(*[F.lit(float(x)) for x in prices])))
    grid = grid.withColumn("action", cheapest(F.col("_cert"), F.col("shadow_price")))
    return simulate(grid, [*(by or []), "shadow_price"])


def budget_choice(front: DataFrame, budget: float = FRICTION_BUDGET) -> DataFrame:
    """One row: the smallest price that meets the budget, else the largest price of the grid."""
    ok = F.min(F.when(F.col("friction_share") <= budget, F.col("shadow_price")))
    return front.agg(F.coalesce(ok, F.max("shadow_price")).alias("budget_price"))


def tuned_thresholds(valid: DataFrame, p_base: str = "p_base", y: str = "rto") -> DataFrame:
    """One row: F1-optimal and cost-optimal global thresholds of the baseline score on VALID."""
    f1 = best_f1(score_curve(valid, p_base, y)).select(F.col("threshold").alias("t_f1"))
    cost = best_cost_threshold(valid, p_base, order_pnl(F.lit(ALLOW), F.col(y)), order_pnl(F.lit(PREPAID), F.col(y)))
    return with_constant(f1, cost.select(F.col("threshold").alias("t_cost")))


def policy_actions(test: DataFrame, choices: DataFrame, p: str = "p", p_base: str = "p_base", y: str = "rto") -> DataFrame:
    """One row per (order, policy). `choices` is the one-row table t_f1, t_cost, budget_price.

    The resolver's thresholds of the two scores are the same column, because tau* does not depend on p.
    """
    df = with_constant(test, choices).withColumn("_cert", certainty(F.col("in0"), F.col("in1")))
    base, full = F.col(p_base), F.col(p)
    perfect = F.when(~F.col(y), ALLOW).when(
        order_pnl(F.lit(STEP_UP), F.lit(True)) >= order_pnl(F.lit(PREPAID), F.lit(True)), STEP_UP).otherwise(PREPAID)
    actions = {
        ALLOW_ALL: F.lit(ALLOW), BASE_HALF: block_if(base > 0.5), BASE_F1: block_if(base > F.col("t_f1")),
        BASE_COST: block_if(base > F.col("t_cost")), BASE_TAU: block_if(base > F.col("tau_star")),
        FULL_TAU: block_if(full > F.col("tau_star")), FULL: cheapest(F.col("_cert"), F.lit(0.0)),
        BUDGETED: cheapest(F.col("_cert"), F.col("budget_price")), ORACLE: perfect,
    }
    df = df.withColumns({f"_a{i}": c for i, c in enumerate(actions.values())})
    pairs = F.array(*[F.struct(F.lit(name).alias("policy"), F.col(f"_a{i}").alias("action")) for i, name in enumerate(actions)])
    keep = [c for c in test.columns if c != "action"]
    return df.select(*keep, F.inline(pairs))


def with_deltas(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """P&L against ALLOW_ALL and against the fixed 0.5 rule."""
    keys = by or []
    pick = lambda name: F.max(F.when(F.col("policy") == name, F.col("pnl_total")))
    ref = summary.groupBy(*keys).agg(pick(ALLOW_ALL).alias("_all"), pick(BASE_HALF).alias("_half"))
    j = summary.join(F.broadcast(ref), keys) if keys else with_constant(summary, ref)
    return j.withColumns({
        "delta_vs_allow_all": F.col("pnl_total") - F.col("_all"), "delta_vs_base_05": F.col("pnl_total") - F.col("_half"),
        "uplift_pct_vs_allow_all": F.coalesce(
            F.try_divide(100 * (F.col("pnl_total") - F.col("_all")), F.abs("_all")), F.lit(0.0))}).drop("_all", "_half")


SWEPT = (ALLOW_ALL, BASE_HALF, BASE_COST, BASE_TAU, FULL_TAU, FULL, BUDGETED)


def sensitivity(actions: DataFrame, y: str = "rto") -> DataFrame:
    """P&L of every policy under 5 x 3 buyer behaviours, pivoted, with the win of the full resolver flagged."""
    grid = F.array(*[F.struct(F.lit(g).alias("stepup_good_abandon"), F.lit(b).alias("stepup_bad_abandon"))
                     for g in SENSITIVITY_GOOD_ABANDON for b in SENSITIVITY_BAD_ABANDON])
    s = {**behaviour_columns(None), "stepup_good_abandon": F.col("stepup_good_abandon"),
         "stepup_bad_abandon": F.col("stepup_bad_abandon")}
    rows = actions.filter(F.col("policy").isin(*SWEPT)).select("*", F.inline(grid))
    totals = rows.groupBy("stepup_good_abandon", "stepup_bad_abandon").agg(*[
        F.sum(F.when(F.col("policy") == name, order_pnl(F.col("action"), F.col(y), s))).alias(_slug(name)) for name in SWEPT])
    binary = F.greatest(*[F.col(_slug(n)) for n in (BASE_COST, BASE_TAU, FULL_TAU)])
    return totals.withColumn("gap", F.col(_slug(FULL)) - binary).withColumn("full_beats_best_binary", F.col("gap") > 0)


def _slug(policy: str) -> str:
    return {ALLOW_ALL: "allow_all", BASE_HALF: "base_05", BASE_COST: "base_global_cost", BASE_TAU: "base_tau",
            FULL_TAU: "full_tau", FULL: "full_resolver", BUDGETED: "full_budgeted"}[policy]


def breakeven(sweep: DataFrame, bad_abandon: float = BuyerBehaviour().stepup_bad_abandon) -> DataFrame:
    """Good-buyer abandonment at which the full resolver stops winning, linearly interpolated.

    1 if it still wins at the end of the grid, NULL if it never does. Works on one row per grid value.
    """
    w = Window.orderBy("stepup_good_abandon")
    col = sweep.filter(F.col("stepup_bad_abandon") == bad_abandon).select(F.col("stepup_good_abandon").alias("a0"), "gap") \
        .withColumn("stepup_good_abandon", F.col("a0"))
    col = col.withColumns({"a1": F.lead("a0").over(w), "g1": F.lead("gap").over(w)})
    cross = (F.col("gap") > 0) & (F.col("g1") <= 0)
    at = F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("gap") / (F.col("gap") - F.col("g1"))
    out = col.agg(F.min_by(F.when(cross, at), F.when(cross, F.col("a0"))).alias("x"),
                  F.max_by("gap", "a0").alias("last"))
    return out.select(F.coalesce("x", F.when(F.col("last") > 0, 1.0)).alias("portfolio_alpha_crit"))


# ------------------------------------------------------------------ logged decisions
def training_pool(decisions: DataFrame, outcomes: DataFrame, weight: Column, window_frac: float = 0.30) -> DataFrame:
    """Decisions with an outcome, their label and weight, from the last `window_frac` of all decisions by position."""
    n = decisions.agg(F.count(F.lit(1)).alias("_n"))
    recent = with_constant(decisions, n).filter(F.col("position") >= F.col("_n") - F.floor(F.lit(window_frac) * F.col("_n")))
    labelled = recent.join(outcomes.select("order_id", "rto"), "order_id").withColumn("weight", weight).drop("_n")
    return labelled.filter("weight > 0")


BOUNDARY_BINS = 8


def retraining_bias(pool: DataFrame, by: list[str], *, p: str = "p", p_true: str = "p_true", boundary: float = 0.5) -> DataFrame:
    """Label rate, boundary gap and calibration error, friction share, training rows and control count per cycle and regime."""
    hb = F.col(p_true) >= boundary
    y = F.col("rto").cast("double")
    # a row for each score bin, then one for each group
    bins = pool.groupBy(*by, F.least(F.lit(BOUNDARY_BINS - 1), F.floor(F.col(p) * BOUNDARY_BINS).cast("int")).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("weight") * y).alias("_wy"), F.sum("weight").alias("_w"), F.count_if(F.col("weight") > 0).alias("_rows"),
        F.count_if(hb).alias("_hb"), F.coalesce(F.sum(F.when(hb, F.col(p))), F.lit(0.0)).alias("_hp"), F.coalesce(F.sum(F.when(hb, y)), F.lit(0.0)).alias("_hy"),
        F.count_if(F.col("served_action") != ALLOW).alias("_friction"),
        F.count_if((F.col("served_action") == ALLOW) & (F.col("action") != ALLOW)).alias("_control"))
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    return bins.groupBy(*by).agg(
        share("_wy", "_w").alias("weighted_rto_rate"), F.sum("_hb").alias("boundary_n"), share("_hp", "_hb").alias("boundary_pred"),
        share("_hy", "_hb").alias("boundary_actual"), (share("_hy", "_hb") - share("_hp", "_hb")).alias("boundary_gap"),
        F.try_divide(F.sum(F.abs(F.col("_hp") - F.col("_hy"))), F.sum("_hb")).alias("boundary_ece"), share("_friction", "_n").alias("friction_share"),
        F.sum("_rows").alias("training_rows"), F.sum("_control").alias("n_control"))


def control_band_cost(served: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What serving ALLOW to the control cohort cost against the policy's own action."""
    lost = order_pnl(F.col("action"), F.col("rto")) - order_pnl(F.lit(ALLOW), F.col("rto"))
    return served.filter("is_control_cohort").groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("control_orders"), F.sum(lost).alias("exploration_cost"))


def cycle_summary(cycles: DataFrame, by: list[str]) -> DataFrame:
    """Worst cycle and cumulative P&L per setting."""
    return cycles.groupBy(*by).agg(
        F.max(F.abs("boundary_gap")).alias("max_abs_boundary_gap"), F.max("ece").alias("max_ece"),
        F.min("auc").alias("min_auc"), F.sum("pnl").alias("cumulative_pnl"))


def cheapest_band(summary: DataFrame, max_ece: float = 0.10, min_auc: float = 0.75) -> DataFrame:
    """Cheapest setting that keeps calibration and ranking, else the one with the smallest worst error."""
    ok = (F.col("max_ece") <= max_ece) & (F.col("min_auc") >= min_auc)
    good = F.min(F.when(ok, F.struct("exploration_cost", "epsilon", "cap")))
    rest = F.min(F.struct("max_ece", "epsilon", "cap"))
    return summary.agg(good.alias("g"), rest.alias("r")).select(
        F.coalesce("g.epsilon", "r.epsilon").alias("epsilon"), F.coalesce("g.cap", "r.cap").alias("cap"),
        F.col("g").isNotNull().alias("acceptable"))


def pnl_trajectory(actions: DataFrame, every: int = 250, y: str = "rto") -> DataFrame:
    """Cumulative P&L per policy after every `every` orders; rows carry `position` in time order."""
    rows = actions.withColumn("_pnl", order_pnl(F.col("action"), F.col(y)))
    # whole steps first, so the running sum goes over one row per step
    steps = rows.groupBy("policy", F.floor(F.col("position") / every).cast("bigint").alias("step")).agg(
        F.sum("_pnl").alias("v"), F.count(F.lit(1)).alias("c"))
    run = running(steps, ["policy"], ["step"], {"pnl": ("sum", F.col("v"))}, block=F.floor(F.col("step") / 1000).cast("bigint"),
                  through_current=True)
    return run.filter(F.col("c") == every).select("policy", ((F.col("step") + 1) * every).alias("orders"), "pnl")
