"""Rupee pricing of one order: cost of a return, cost of friction, thresholds and expected costs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ACTIONS, ALLOW, PREPAID, STEP_UP, BuyerBehaviour, Economics
from .text import clip

# Parcel weight tiers (grams, logistics multiplier).
WEIGHT_TIERS = ((500.0, 1.0), (2000.0, 1.35))
HEAVY_MULTIPLIER = 1.9
REPEAT_BUYER_CAC_SHARE = 0.15
ELASTICITY_ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 13))

ECON_FIELDS = tuple(Economics().to_dict())


def econ_columns(econ: Economics | None = None, df: DataFrame | None = None, prefix: str = "econ_") -> dict[str, Column]:
    """Economics as columns: a per-row `econ_<field>` column where the frame has one, a literal otherwise."""
    present = set(df.columns) if df is not None else set()
    return {k: F.col(prefix + k) if prefix + k in present else F.lit(float(v))
            for k, v in (econ or Economics()).to_dict().items()}


def weight_multiplier(grams: Column) -> Column:
    (light, m1), (medium, m2) = WEIGHT_TIERS
    return F.when(grams <= light, m1).when(grams <= medium, m2).otherwise(HEAVY_MULTIPLIER)


def _column_or(df: DataFrame, name: str, fallback: Column) -> Column:
    return F.coalesce(F.col(name), fallback) if name in df.columns else fallback


def price_orders(df: DataFrame, econ: Economics | None = None, p: str = "p", shadow_price: Column | None = None) -> DataFrame:
    """Price every order.

    Needs cart_gmv, merchant_margin, cac, is_new_customer, weight_grams, addr_defect_score and the
    probability column. Optional per-row columns: logistics_loss, holding_cost, friction_shadow_price
    and econ_<field>.
    """
    e = econ_columns(econ, df)
    gmv, prob = F.col("cart_gmv"), F.col(p)
    logistics = (e["forward_shipping"] + e["reverse_shipping"]) * weight_multiplier(F.col("weight_grams")) \
        + e["packaging_cost"] + e["restocking_cost"]
    lam = shadow_price if shadow_price is not None else _column_or(df, "friction_shadow_price", e["friction_shadow_price"])
    defect = clip(F.col("addr_defect_score").cast("double"), 0.0, 1.0)
    out = df.withColumns({
        "logistics": _column_or(df, "logistics_loss", logistics),
        "holding": _column_or(df, "holding_cost", e["holding_cost_rate"] * gmv),
        "margin": F.col("merchant_margin") * gmv,
        "insult": F.when(F.col("is_new_customer"), F.col("cac") * e["cac_insult_kappa"])
                   .otherwise(F.lit(REPEAT_BUYER_CAC_SHARE) * F.col("cac")),
        "addr_attribution": defect * defect,
        "shadow_price": F.greatest(F.lit(0.0), lam.cast("double")),
    })
    a = F.col("addr_attribution")
    out = out.withColumns({
        "cost_fn": F.col("logistics") + F.col("holding") + e["inventory_lockup_lambda"] * gmv,
        "cost_fp": F.col("margin") + F.col("insult"),
        "rho_stepup": e["stepup_rto_residual"] + (1.0 - e["stepup_rto_residual"]) * a,
        "rho_prepaid": e["prepaid_rto_residual"] + (1.0 - e["prepaid_rto_residual"]) * a,
    })
    fn, fp, sp = F.col("cost_fn"), F.col("cost_fp"), F.col("shadow_price")
    ds, dp, fee = e["stepup_abandon_rate"], e["prepaid_abandon_rate"], e["stepup_friction_cost"]
    q = 1.0 - prob
    soft_num = ds * fp + fee * (1 - ds) + sp
    soft_den = fn * (1 - F.col("rho_stepup")) + ds * fp - fee * ds
    return out.withColumns({
        "tau_star": F.when(fn + fp <= 0, 0.5).otherwise(F.least(F.lit(1.0), (fp + sp) / _nonzero(fn + fp))),
        "tau_soft": F.when(soft_den <= 0, 1.0).otherwise(clip(soft_num / _nonzero(soft_den), 0.0, 1.0)),
        "cost_allow": prob * fn,
        "cost_stepup": q * ds * fp + prob * F.col("rho_stepup") * fn + (1.0 - q * ds) * fee,
        "cost_prepaid": q * dp * fp + (1.0 - q * dp) * F.col("rho_prepaid") * e["prepaid_rto_unit_cost"],
    })


def _nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def cost_map() -> Column:
    """Action -> expected cost of a priced row."""
    return F.map_from_arrays(F.array(*[F.lit(a) for a in ACTIONS]),
                             F.array("cost_allow", "cost_stepup", "cost_prepaid"))


def with_elasticity(df: DataFrame, econ: Economics | None = None, p: str = "p") -> DataFrame:
    """Break-even deposit abandonment of each priced order; NULL where no abandonment rate breaks even."""
    e = econ_columns(econ, df)
    prob, q = F.col(p), 1.0 - F.col(p)
    out = df.withColumns({
        "intercept": prob * F.col("rho_stepup") * F.col("cost_fn") + e["stepup_friction_cost"],
        "slope": q * (F.col("cost_fp") - e["stepup_friction_cost"]),
    })
    slope_ok = F.col("slope") > 1e-9

    def crit(target: Column) -> Column:
        return F.when(slope_ok, (target - F.col("intercept")) / _nonzero(F.col("slope")))

    out = out.withColumns({"_allow": crit(F.col("cost_allow") - F.col("shadow_price")), "_prepaid": crit(F.col("cost_prepaid"))})
    # without a positive slope both break-evens are infinite, so the allow side binds
    return out.withColumns({
        "alpha_vs_allow": F.when(slope_ok, clip(F.col("_allow"), 0.0, 1.0)),
        "alpha_vs_prepaid": F.when(slope_ok, clip(F.col("_prepaid"), 0.0, 1.0)),
        "alpha_crit": F.when(slope_ok, clip(F.least("_allow", "_prepaid"), 0.0, 1.0)),
        "binding": F.when(~slope_ok | (F.col("_allow") <= F.col("_prepaid")), ALLOW).otherwise(PREPAID),
        "rupees_per_point": F.col("slope") / 100.0,
    }).withColumn("headroom", F.col("alpha_crit") - e["stepup_abandon_rate"]).drop("_allow", "_prepaid")


def elasticity_curve(df: DataFrame, keep: list[str], alphas: tuple[float, ...] = ELASTICITY_ALPHAS) -> DataFrame:
    """Profit of each action at each assumed abandonment rate, one row per (order, alpha)."""
    profit = F.col("margin")
    cost = F.col("intercept") + F.col("slope") * F.col("alpha")
    return (df.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
            .select(*keep, "alpha", cost.alias("cost_stepup_at"),
                    (profit - cost - F.col("shadow_price")).alias("profit_stepup"),
                    (profit - F.col("cost_allow")).alias("profit_allow"),
                    (profit - F.col("cost_prepaid") - F.col("shadow_price")).alias("profit_prepaid")))


def order_pnl(action: Column, rto: Column, sim: dict[str, Column] | BuyerBehaviour | None = None) -> Column:
    """Expected contribution of a priced order given the action served and its true outcome."""
    s = behaviour_columns(sim)
    margin, insult, fn = F.col("margin"), F.col("cost_fp") - F.col("margin"), F.col("cost_fn")
    good_step = (1 - s["stepup_good_abandon"]) * (margin - s["friction_cost"]) - s["stepup_good_abandon"] * insult
    good_pre = (1 - s["prepaid_good_abandon"]) * margin - s["prepaid_good_abandon"] * insult
    rs, rp = sim_rho(s, "stepup"), sim_rho(s, "prepaid")
    bad_step = (1 - s["stepup_bad_abandon"]) * (rs * (s["deposit"] - fn) + (1 - rs) * (margin - s["friction_cost"]))
    bad_pre = (1 - s["prepaid_bad_abandon"]) * ((1 - rp) * margin - rp * s["prepaid_rto_unit_cost"])
    good = F.when(action == ALLOW, margin).when(action == STEP_UP, good_step).otherwise(good_pre)
    bad = F.when(action == ALLOW, -fn).when(action == STEP_UP, bad_step).otherwise(bad_pre)
    return F.when(rto, bad).otherwise(good)


def behaviour_columns(sim: dict[str, Column] | BuyerBehaviour | None) -> dict[str, Column]:
    if isinstance(sim, dict):
        return sim
    return {k: F.lit(float(v)) for k, v in vars(sim or BuyerBehaviour()).items()}


def sim_rho(s: dict[str, Column], kind: str) -> Column:
    r = s[f"{kind}_rto_residual"]
    return r + (1 - r) * F.col("addr_attribution")
