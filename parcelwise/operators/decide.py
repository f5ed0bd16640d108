"""From a priced order and its conformal set to an action, a served action and an explanation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (ACTIONS, ALLOW, EXPLORATION_EPSILON, IPW_WEIGHT_CAP, MAX_REASON_CODES, PREPAID,
                      REASON_CODE_MIN_ABS, STEP_UP, Economics)
from ..functions.economics import econ_columns
from ..functions.text import uniform_draw
from .conformal import AMBIGUOUS, HIGH, LOW, NOVEL, certainty

# What the checkout shows for each action.
ACTION_LABELS = {
    ALLOW: "Cash on Delivery available",
    STEP_UP: "Confirm with a refundable ₹49 UPI shipping deposit",
    PREPAID: "Prepaid only for this order (UPI / Card / EMI)",
}


def admissible(cert: Column) -> Column:
    """Actions a certainty class leaves open."""
    return (F.when(cert == LOW, F.array(F.lit(ALLOW)))
            .when(cert == AMBIGUOUS, F.array(*[F.lit(a) for a in ACTIONS]))
            .otherwise(F.array(F.lit(STEP_UP), F.lit(PREPAID))))


def cheapest(cert: Column, shadow_price: Column) -> Column:
    """Cheapest admissible action; friction also pays the shadow price, ties go to the least friction."""
    allow_open, friction_open = cert.isin(LOW, AMBIGUOUS), cert != LOW
    option = lambda cost, rank, open_: F.when(open_, F.struct(F.round(cost, 6).alias("cost"), F.lit(rank).alias("rank")))
    best = F.least(option(F.col("cost_allow"), 0, allow_open),
                   option(F.col("cost_stepup") + shadow_price, 1, friction_open),
                   option(F.col("cost_prepaid") + shadow_price, 2, friction_open))
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), best["rank"] + 1)


def resolve(df: DataFrame, shadow_price: Column | None = None) -> DataFrame:
    """Add certainty, action, saving_vs_allow and budget_changed_action to priced rows with in0 / in1."""
    lam = shadow_price if shadow_price is not None else F.col("shadow_price")
    out = df.withColumn("certainty", certainty(F.col("in0"), F.col("in1"))).withColumn("_lam", lam.cast("double"))
    out = out.withColumns({"action": cheapest(F.col("certainty"), F.col("_lam")),
                           "_free": cheapest(F.col("certainty"), F.lit(0.0))})
    chosen = (F.when(F.col("action") == ALLOW, F.col("cost_allow"))
              .when(F.col("action") == STEP_UP, F.col("cost_stepup")).otherwise(F.col("cost_prepaid")))
    return out.withColumns({
        "saving_vs_allow": F.col("cost_allow") - chosen,
        "unpriced_action": F.col("_free"),
        "budget_changed_action": (F.col("_lam") > 0) & (F.col("_free") != F.col("action")),
    }).drop("_lam", "_free")


def with_rationale(df: DataFrame, econ: Economics | None = None, p: str = "p") -> DataFrame:
    """Add the sentence that explains a resolved row, and the checkout label of its action."""
    f = F.format_string
    e = econ_columns(econ, df)
    prob, tau, soft = F.col(p), F.col("tau_star"), F.col("tau_soft")
    action, cert = F.col("action"), F.col("certainty")
    cost = (F.when(action == ALLOW, F.col("cost_allow")).when(action == STEP_UP, F.col("cost_stepup"))
            .otherwise(F.col("cost_prepaid")))
    low = f("Conformal set {0}: deliverability certified at 1-α. P(RTO)=%.2f ≤ τ*=%.2f. Frictionless COD.", prob, tau)
    high = f("Conformal set {1}: RTO certified at 1-α. P(RTO)=%.2f > τ*=%.2f. %s minimises expected loss (₹%.0f vs ₹%.0f on ALLOW).",
             prob, tau, F.when(action == STEP_UP, "Soft step-up").otherwise("Prepaid mandate"), cost, F.col("cost_allow"))
    novel = f("Conformal set ∅: neither label conforms at α — pattern is outside the calibrated support "
              "(novel syndicate signature). Escalating to %s rather than guessing.",
              F.when(action == STEP_UP, "step-up").otherwise("prepaid"))
    shrug = f("Conformal set {0,1}: ambiguous. P(RTO)=%.2f ≤ τ_soft=%.2f — CAC insult (₹%.0f) outweighs shipping exposure "
              "(₹%.0f). Allowing COD, flagged for post-delivery review.", prob, soft, F.col("cost_fp"), F.col("cost_fn"))
    deposit = f("Conformal set {0,1}: ambiguous. P(RTO)=%.2f is %s the hard-block point τ*=%.2f but above τ_soft=%.2f. A refundable "
                "₹%.0f UPI deposit costs ₹%.0f expected vs ₹%.0f on ALLOW, without the ₹%.0f insult of a hard block.",
                prob, F.when(prob <= tau, "below").otherwise("above"), tau, soft, e["stepup_deposit"],
                F.col("cost_stepup"), F.col("cost_allow"), F.col("cost_fp"))
    block = f("Conformal set {0,1} but P(RTO)=%.2f ≫ τ*=%.2f; expected loss under step-up (₹%.0f) still exceeds prepaid "
              "(₹%.0f). Prepaid mandate.", prob, tau, F.col("cost_stepup"), F.col("cost_prepaid"))
    body = (F.when(cert == LOW, low).when(cert == HIGH, high).when(cert == NOVEL, novel)
            .when(action == ALLOW, shrug).when(action == STEP_UP, deposit).otherwise(block))
    undeliverable = F.when((action == PREPAID) & (F.col("addr_attribution") >= 0.4), f(
        " A deposit buys commitment, not deliverability: %.0f%% of this order's risk is attributed to the address, so "
        "step-up residual RTO is %.0f%%.", F.col("addr_attribution") * 100, F.col("rho_stepup") * 100)).otherwise("")
    budget = F.when(F.col("budget_changed_action"), f(
        " Friction budget: a shadow price of ₹%.0f per frictioned order tipped %s → %s.",
        F.col("shadow_price"), F.col("unpriced_action"), action)).otherwise("")
    labels = F.create_map(*[F.lit(x) for kv in ACTION_LABELS.items() for x in kv])
    return df.withColumns({"rationale": F.concat(body, undeliverable, budget), "action_label": labels[action]})


# ------------------------------------------------------------------ budget, control band, weights
def budget_price(budgets: DataFrame, frontier: DataFrame, budget: str = "friction_budget") -> DataFrame:
    """Add `frontier_price`: the smallest shadow price whose friction share meets the budget, else the largest.

    The frontier has one row per grid price, so it becomes one array that every row filters.
    """
    grid = frontier.agg(F.sort_array(F.collect_list(F.struct("shadow_price", "friction_share"))).alias("_grid"))
    j = budgets.withColumn("_k", F.lit(1)).join(F.broadcast(grid.withColumn("_k", F.lit(1))), "_k").drop("_k")
    meets = F.filter("_grid", lambda r: r["friction_share"] <= F.col(budget))
    price = F.coalesce(F.try_element_at(meets, F.lit(1))["shadow_price"], F.element_at("_grid", -1)["shadow_price"])
    return j.withColumn("frontier_price", F.when(F.col(budget).isNotNull(), price.cast("double"))).drop("_grid")


def effective_price(request_price: Column, frontier_price: Column, configured: Column) -> Column:
    """Request price, else the price of the (request or merchant) budget, else the configured one."""
    return F.coalesce(request_price, frontier_price, configured)


def serve(df: DataFrame, *, epsilon: Column | float = EXPLORATION_EPSILON, shadow: Column | bool = False,
          key: Column | None = None) -> DataFrame:
    """Add draw, is_control_cohort, served_action and propensity.

    A flagged order whose draw falls under epsilon is served ALLOW; a shadow merchant always serves ALLOW.
    """
    eps = F.lit(float(epsilon)) if isinstance(epsilon, (int, float)) else epsilon
    dark = F.lit(shadow) if isinstance(shadow, bool) else shadow
    k = key if key is not None else F.concat_ws("|", "order_id", "phone_h")
    flagged = F.col("action") != ALLOW
    out = df.withColumn("draw", F.when(flagged & ~dark & (eps > 0), uniform_draw(k)))
    out = out.withColumn("is_control_cohort", F.coalesce(F.col("draw") < eps, F.lit(False)))
    out = out.withColumn("served_action", F.when(dark | F.col("is_control_cohort"), ALLOW).otherwise(F.col("action")))
    return out.withColumn("propensity", F.when(dark, 1.0).otherwise(propensity(F.col("action"), F.col("served_action"), eps)))


def propensity(policy: Column, served: Column, epsilon: Column) -> Column:
    return F.when(policy == ALLOW, 1.0).when(served == ALLOW, epsilon).otherwise(1.0 - epsilon)


def ipw_weight(served: Column, prop: Column, cap: float = IPW_WEIGHT_CAP) -> Column:
    """Training weight of an order: only a frictionless shipment carries an untreated label."""
    return F.when((served == ALLOW) & (prop > 0), F.least(F.lit(float(cap)), 1.0 / F.nullif(prop, F.lit(0.0)))).otherwise(0.0)


# ------------------------------------------------------------------ reason codes
# Feature, stable code, text; {0f}, {2f}, {pct} and {int} stand for the feature value.
REASON_CODES = (
    ("gmv_log", "RSK_BASKET_VALUE", "Basket ₹{expm1,}"),
    ("items_count", "RSK_MULTI_ITEM", "{int} items"),
    ("weight_grams", "RSK_PARCEL_WEIGHT", "Parcel {0f} g"),
    ("pin_tier", "RSK_PIN_TIER", "Tier-{int} delivery PIN"),
    ("pin_serviceability", "RSK_PIN_SERVICEABILITY", "PIN delivery success {pct}"),
    ("pin_rto_rate", "RSK_PIN_RTO_HISTORY", "PIN historical RTO {pct}"),
    ("pin_orders_log", "RSK_PIN_VOLUME", "{expm1} prior orders in PIN"),
    ("addr_defect_score", "RSK_ADDR_DEFECT", "Address structurally incomplete (defect {2f})"),
    ("addr_tokens", "RSK_ADDR_LENGTH", "Address has {int} tokens"),
    ("addr_has_house_no", "RSK_ADDR_NO_HOUSE_NO", "House number present"),
    ("addr_landmark_only", "RSK_ADDR_LANDMARK_ONLY", "Address is landmark-only (near/opp/behind)"),
    ("addr_state_mismatch", "RSK_ADDR_PIN_MISMATCH", "City/state text disagrees with PIN"),
    ("addr_junk", "RSK_ADDR_JUNK", "Address contains junk / placeholder tokens"),
    ("phone_orders_30d", "RSK_PHONE_VELOCITY", "{int} orders from this phone in 30d"),
    ("phone_orders_total_log", "RSK_PHONE_TENURE", "{expm1} prior orders on phone"),
    ("phone_rto_rate", "RSK_PHONE_RTO_HISTORY", "Phone historical RTO {pct}"),
    ("phone_first_seen_days", "RSK_NEW_CUSTOMER", "Phone tenure {0f} days"),
    ("phone_distinct_devices", "RSK_PHONE_MULTI_DEVICE", "Phone seen on {int} devices"),
    ("device_distinct_phones", "RSK_DEVICE_MULTI_PHONE", "{int} phones share this device"),
    ("device_orders_24h", "RSK_DEVICE_VELOCITY", "{int} orders from this device in 24h"),
    ("device_rto_rate", "RSK_DEVICE_RTO_HISTORY", "Device historical RTO {pct}"),
    ("addr_distinct_phones", "RSK_ADDR_MULTI_PHONE", "{int} phones ship to this address"),
    ("addr_rto_rate", "RSK_ADDR_RTO_HISTORY", "Address historical RTO {pct}"),
    ("pay_switch_from_failed", "RSK_PAY_FALLBACK_TO_COD", "Switched to COD after failed prepaid attempt"),
    ("is_cod", "RSK_COD", "Cash on delivery"),
    ("channel_risk", "RSK_HIGH_CAC_CHANNEL", "Paid-acquisition channel (prior RTO {pct})"),
    ("coupon_applied", "RSK_COUPON", "Coupon applied"),
    ("checkout_seconds_log", "RSK_CHECKOUT_SPEED", "Checkout in {expm1}s"),
    ("hour_sin", "RSK_ODD_HOUR", "Late-night ordering window"),
    ("hour_cos", "RSK_ODD_HOUR", "Late-night ordering window"),
    ("ring_size_log", "RSK_RING_MEMBER", "Entity linked to a {expm1}-node cluster"),
    ("ring_rto_rate", "RSK_RING_RTO", "Linked cluster RTO {pct}"),
    ("ring_phones", "RSK_RING_PHONES", "{int} phones in linked cluster"),
    ("ring_is_ring", "RSK_SYNDICATE_SUBGRAPH", "Matches syndicate subgraph signature"),
    ("entity_max_degree", "RSK_GRAPH_DEGREE", "Entity degree {int} in graph"),
    ("entity_shared", "RSK_SHARED_ENTITY", "Public/shared entity (hostel, office, PG) — not a ring"),
    ("gmv_vs_pin_median", "RSK_BASKET_VS_LOCALITY", "Basket {1f}× locality median"),
)
NO_HOUSE_NUMBER = "No house / flat number in address"
FIRST_TIME_PHONE = "First-time phone"


def _human(feature: str, template: str, v: Column) -> Column:
    forms = {"{int}": lambda: F.format_string("%d", v.cast("bigint")), "{0f}": lambda: F.format_string("%.0f", v),
             "{1f}": lambda: F.format_string("%.1f", v), "{2f}": lambda: F.format_string("%.2f", v),
             "{pct}": lambda: F.format_string("%.0f%%", v * 100), "{expm1}": lambda: F.format_string("%.0f", F.expm1(v)),
             "{expm1,}": lambda: F.format_string("%,.0f", F.expm1(v))}
    text = F.lit(template)
    for mark, make in forms.items():
        if mark in template:
            before, after = template.split(mark)
            text = F.concat(F.lit(before), make(), F.lit(after))
    if feature == "addr_has_house_no":
        return F.when(v < 0.5, NO_HOUSE_NUMBER).otherwise(text)
    if feature == "phone_first_seen_days":
        return F.when(v < 1, FIRST_TIME_PHONE).otherwise(text)
    return text


def reason_codes(df: DataFrame, contributions: dict[str, Column], keep: list[str], top: int = MAX_REASON_CODES) -> DataFrame:
    """Per row the strongest contributions, one per code, as rows (keep..., rank, code, feature, ...).

    The 37 candidates are ranked inside the row's own array, so nothing is shuffled.
    """
    known = [(f, code, text) for f, code, text in REASON_CODES if f in contributions]
    by_code: dict[str, list[Column]] = {}
    for i, (f, code, _) in enumerate(known):
        by_code.setdefault(code, []).append(F.struct(
            F.abs(contributions[f]).alias("size"), F.lit(-i).alias("first"), F.lit(code).alias("code"), F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("raw"), contributions[f].alias("by")))
    # the strongest of a code stands for it before anything is sorted
    items = F.array(*[F.greatest(*of) if len(of) > 1 else of[0] for of in by_code.values()])
    ranked = F.sort_array(F.filter(items, lambda x: x["size"] >= REASON_CODE_MIN_ABS), asc=False)
    best = df.select(*keep, F.slice(ranked, 1, top).alias("_top"))
    rows = best.select(*keep, F.posexplode("_top").alias("rank", "t")).select(*keep, (F.col("rank") + 1).alias("rank"), "t.*")
    # only what is shown is put into words
    human = F.lit(None).cast("string")
    for f, _, text in known:
        human = F.when(F.col("feature") == f, _human(f, text, F.col("raw"))).otherwise(human)
    return rows.select(*keep, "rank", "code", "feature", F.round("raw", 4).alias("value"), F.round("by", 4).alias("contribution"),
                       F.when(F.col("by") > 0, "RISK_UP").otherwise("RISK_DOWN").alias("direction"), human.alias("human"))


def linear_contributions(coefficients: dict[str, float], means: dict[str, float]) -> dict[str, Column]:
    """Log-odds contribution of each feature of a linear score around its mean."""
    return {f: F.lit(float(w)) * (F.col(f).cast("double") - F.lit(float(means.get(f, 0.0)))) for f, w in coefficients.items()}
