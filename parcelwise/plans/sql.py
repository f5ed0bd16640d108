"""Oracle SQL: named common table expressions, written for DuckDB and independent of the Spark code paths."""
from __future__ import annotations

import re

from ..config import Economics
from ..functions import address as A
from ..functions import pincodes as P
from ..functions.text import HASH_SALT
from ..sources import lens as L

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


def again(name: str, new: str, old_source: str, new_source: str) -> None:
    """A known table expression over another source."""
    needs, body = _CTES[name]
    cte(new, body.replace(old_source, new_source), *[new_source if n == old_source else n for n in needs])


def sql(select: str, *needs: str) -> str:
    """SELECT with the tables it needs, and theirs, in front."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in _CTES[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + select


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def strlist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


E = {k: f"{v!r}e0" for k, v in Economics().to_dict().items()}


def entity_hash(kind: str, col: str) -> str:
    clean = f"lower(trim(coalesce({col}, ''), ' \t\n\r'))"
    return f"substr(sha256({q(HASH_SALT + '|' + kind + '|')} || {clean}), 1, 16)"


def node(kind: str, col: str) -> str:
    return f"CASE WHEN coalesce({col}, '') <> '' THEN {q(kind + ':')} || {entity_hash(kind, col)} END"


merchant_case = " ".join(f"WHEN {q(s)} THEN {q(m)}" for s, m in L.MERCHANT_OF_SEGMENT.items())
cte("lens_raw", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderkey AS seq, o_orderdate AS ts,
 o_orderdate + to_days(CAST(3 + o_orderkey % 7 AS INTEGER)) AS outcome_ts, o_orderstatus AS status, o_orderstatus = 'F' AS rto,
 o_custkey AS custkey, c_nationkey AS nationkey,
 'p' || o_custkey AS phone, 'acc' || o_custkey AS account_id,
 CASE WHEN o_custkey % 10 < 3 THEN 'ds' || (o_custkey // 40) ELSE 'd' || o_custkey END AS device,
 CASE WHEN o_custkey % 4 = 0 THEN 'as' || (o_custkey // 40) ELSE 'a' || o_custkey END AS addr,
 CASE WHEN o_custkey % 5 = 0 THEN 'v' || o_custkey END AS vpa, 'i' || (o_custkey % 37) AS ip,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'tok' || o_custkey END AS card_token,
 o_orderkey % 97 = 0 AS disputed,
 CASE o_orderpriority WHEN '3-MEDIUM' THEN 'UPI' WHEN '4-NOT SPECIFIED' THEN 'CARD' ELSE 'COD' END AS payment_method,
 CASE WHEN o_orderkey % 11 = 0 THEN 'CARD_FAILED' END AS payment_switch_from,
 floor(o_totalprice * 0.5e0 + 0.5e0) / 100e0 AS cart_gmv,
 {strlist(L.NATION_PINS)}[c_nationkey + 1] AS delivery_pin,
 {strlist(L.ADDRESS_TEXTS)}[o_orderkey % 6 + 1] AS shipping_address,
 {strlist(L.CHANNELS)}[o_orderkey % 8 + 1] AS acquisition_channel,
 1 + o_orderkey % 4 AS items_count, CAST(150 + (o_orderkey * 37) % 2500 AS DOUBLE) AS weight_grams,
 o_orderkey % 3 = 0 AS coupon_applied, CAST(10 + (o_orderkey * 13) % 200 AS DOUBLE) AS checkout_seconds,
 (o_orderkey * 7) % 24 AS hour_of_day,
 CASE c_mktsegment {merchant_case} ELSE {q(L.UNKNOWN_MERCHANT)} END AS merchant_id,
 0.18e0 AS merchant_margin, CAST(60 + (o_orderkey * 29) % 560 AS DOUBLE) AS cac
FROM orders JOIN customer ON o_custkey = c_custkey""")
cte("lens", "SELECT * FROM lens_raw WHERE status IN ('F', 'O')", "lens_raw")
cte("flagged", "SELECT *, row_number() OVER (PARTITION BY phone ORDER BY ts, seq) = 1 AS is_new_customer FROM lens", "lens")

# ---- PIN and address
cte("state2", "SELECT * FROM (" + values(list(P.STATE_BY_PREFIX2.items())) + ") t(p2, state)")
cte("city3", "SELECT * FROM (" + values([(k, c, t) for k, (c, t) in P.CITY_BY_PREFIX3.items()]) + ") t(p3, city, tier)")
cte("priors", "SELECT * FROM (" + values([(t, s, r) for t, (s, r) in P.TIER_PRIORS.items()]) + ") t(tier, serv, rtop)")


def pin_info(source: str) -> str:
    """PIN attributes of every distinct `delivery_pin` of a table."""
    return f"""
SELECT pin, wf AND state <> 'Unknown' AS valid, state,
 CASE WHEN NOT wf THEN 'Unknown' ELSE coalesce(c.city, state || ' district (' || substr(pin, 1, 3) || 'xxx)') END AS city, x.tier AS tier,
 CASE WHEN wf THEN pr.serv ELSE 0.8e0 END AS serv, CASE WHEN wf THEN pr.rtop ELSE 0.4e0 END AS rtop
FROM (SELECT d.pin, d.wf, CASE WHEN d.wf THEN coalesce(s.state, 'Unknown') ELSE 'Unknown' END AS state,
  CASE WHEN NOT d.wf THEN 4 WHEN c3.tier IS NOT NULL THEN c3.tier
   WHEN EXISTS (SELECT 1 FROM city3 m WHERE m.tier = 1 AND m.p3[1] = d.pin[1]) THEN 3 ELSE 4 END AS tier
 FROM (SELECT DISTINCT delivery_pin AS pin, regexp_matches(delivery_pin, '^[1-9][0-9]{{5}}$') AS wf FROM {source}) d
 LEFT JOIN state2 s ON s.p2 = substr(d.pin, 1, 2) LEFT JOIN city3 c3 ON c3.p3 = substr(d.pin, 1, 3)) x
LEFT JOIN city3 c ON c.p3 = substr(pin, 1, 3) JOIN priors pr ON pr.tier = x.tier"""


cte("pins", pin_info("lens_raw"), "lens_raw", "state2", "city3", "priors")
cte("places", "SELECT * FROM (" + values(list(A.STATE_OF_PLACE.items())) + ") t(place, state)")
# RE2 has no back-references: four times the same character, spelt out
_FOUR = "|".join(re.escape(chr(c)) * 4 for c in range(33, 127) if not chr(c).isupper()) + "| {4}"


def m(pattern: str) -> str:
    return f"regexp_matches(a, {q(pattern)}, 'i')"


cte("addr_flags", f"""
SELECT *, round(least(1e0, (CASE WHEN NOT house THEN 0.35e0 ELSE 0e0 END) + (CASE WHEN NOT street THEN 0.15e0 ELSE 0e0 END)
  + (CASE WHEN landmark_only THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN vague_only THEN 0.15e0 ELSE 0e0 END)
  + (CASE WHEN too_short THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN junk THEN 0.35e0 ELSE 0e0 END)
  + (CASE WHEN pin_mismatch THEN 0.2e0 ELSE 0e0 END) + (CASE WHEN state_mismatch THEN 0.25e0 ELSE 0e0 END)
  + (CASE WHEN NOT valid THEN 0.3e0 ELSE 0e0 END)), 3) AS defect
FROM (SELECT *, lm AND NOT house AS landmark_only, NOT house AND vg AND tokens <= 8 AS vague_only, jk OR tokens = 0 AS junk,
  tokens < 4 AS too_short, valid AND other_state AS state_mismatch
 FROM (SELECT a, pin, valid, len(list_filter(regexp_split_to_array(lower(a), '[\\s,]+'), lambda x: x <> '')) AS tokens,
   {m(A.HOUSE)} AS house, {m(A.STREET)} AS street, {m(A.LANDMARK)} AS lm, {m(A.VAGUE)} AS vg,
   {m(A.PLACEHOLDER)} OR {m(_FOUR)} AS jk,
   len(list_filter(regexp_extract_all(a, '\\b[1-9]\\d{{5}}\\b'), lambda x: x <> pin)) > 0 AS pin_mismatch,
   EXISTS (SELECT 1 FROM places pl WHERE pl.state <> pins.state AND regexp_matches(lower(a), '\\b' || pl.place || '\\b')) AS other_state
  FROM (SELECT DISTINCT shipping_address AS a, delivery_pin FROM lens_raw) JOIN pins ON pins.pin = delivery_pin))""", "lens_raw", "pins", "places")

cte("scored", """
SELECT f.*, tier AS pin_tier, state AS pin_state, pins.valid AS pin_valid, serv, rtop, defect AS addr_defect_score, tokens, house, street, landmark_only, vague_only,
 junk, too_short, pin_mismatch, state_mismatch,
 round(1e0 / (1e0 + exp(-(-1.6e0 + 1.8e0 * defect + 0.25e0 * (tier - 1) + (CASE WHEN payment_switch_from IS NOT NULL THEN 0.9e0 ELSE 0e0 END)
  + 0.35e0 * ln(1e0 + cart_gmv / 800e0) + (CASE WHEN device LIKE 'ds%' THEN 0.6e0 ELSE 0e0 END)))), 6) AS p
FROM flagged f JOIN pins ON pins.pin = delivery_pin JOIN addr_flags af ON af.a = shipping_address AND af.pin = delivery_pin""",
    "flagged", "pins", "addr_flags")
cte("cod", "SELECT * FROM scored WHERE payment_method = 'COD'", "scored")

# ---- pricing
cte("pr1", f"""
SELECT *, ({E['forward_shipping']} + {E['reverse_shipping']}) * (CASE WHEN weight_grams <= 500 THEN 1e0 WHEN weight_grams <= 2000 THEN 1.35e0 ELSE 1.9e0 END)
  + {E['packaging_cost']} + {E['restocking_cost']} AS logistics, {E['holding_cost_rate']} * cart_gmv AS holding,
 merchant_margin * cart_gmv AS margin, CASE WHEN is_new_customer THEN cac * {E['cac_insult_kappa']} ELSE 0.15e0 * cac END AS insult,
 addr_defect_score * addr_defect_score AS attr FROM cod""", "cod")
cte("pr2", f"""
SELECT *, logistics + holding + {E['inventory_lockup_lambda']} * cart_gmv AS cost_fn, margin + insult AS cost_fp,
 0.1e0 + (1e0 - 0.1e0) * attr AS rho_s, 0.04e0 + (1e0 - 0.04e0) * attr AS rho_p FROM pr1""", "pr1")
cte("priced", """
SELECT *, CASE WHEN cost_fn + cost_fp <= 0 THEN 0.5e0 ELSE least(1e0, cost_fp / (cost_fn + cost_fp)) END AS tau_star,
 CASE WHEN cost_fn * (1e0 - rho_s) + 0.11e0 * cost_fp - 6e0 * 0.11e0 <= 0 THEN 1e0 ELSE
  least(1e0, greatest(0e0, (0.11e0 * cost_fp + 6e0 * (1e0 - 0.11e0)) / (cost_fn * (1e0 - rho_s) + 0.11e0 * cost_fp - 6e0 * 0.11e0))) END AS tau_soft,
 p * cost_fn AS cost_allow,
 (1e0 - p) * 0.11e0 * cost_fp + p * rho_s * cost_fn + (1e0 - (1e0 - p) * 0.11e0) * 6e0 AS cost_stepup,
 (1e0 - p) * 0.38e0 * cost_fp + (1e0 - (1e0 - p) * 0.38e0) * rho_p * 60e0 AS cost_prepaid FROM pr2""", "pr2")

# ---- chronological split of the COD orders
cte("split", """
SELECT *, CASE WHEN position < e1 THEN 'train' WHEN position < e1 + e2 THEN 'valid' WHEN position < e1 + 2 * e2 THEN 'calib'
 WHEN position < e1 + 3 * e2 THEN 'conf' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS position, round_even(0.6e0 * count(*) OVER (), 0) AS e1,
  round_even(0.1e0 * count(*) OVER (), 0) AS e2 FROM priced)""", "priced")


# ---- conformal quantiles
def quantile(score: str, source: str, where: str, alpha: str = "0.1e0") -> str:
    """k-th smallest score, k = ceil((n + 1)(1 - alpha)) clipped to [1, n]; 1 without rows."""
    return (f"coalesce((SELECT s FROM (SELECT {score} AS s, row_number() OVER (ORDER BY {score}) AS rn, count(*) OVER () AS n FROM {source} "
            f"WHERE {where}) WHERE rn = least(n, greatest(1, CAST(ceil((n + 1) * (1e0 - {alpha})) AS BIGINT)))), 1e0)")


cte("class_q", f"""
SELECT {quantile('1e0 - (1e0 - p)', 'split', "split = 'conf' AND NOT rto")} AS q0,
 {quantile('1e0 - p', 'split', "split = 'conf' AND rto")} AS q1""", "split")
cte("sets", """
SELECT s.*, p <= q0 AS in0, (1e0 - p) <= q1 AS in1, CASE WHEN p <= q0 AND (1e0 - p) <= q1 THEN 'AMBIGUOUS' WHEN p <= q0 THEN 'CERTIFIED_LOW'
 WHEN (1e0 - p) <= q1 THEN 'CERTIFIED_HIGH' ELSE 'NOVEL' END AS certainty FROM split s, class_q""", "split", "class_q")


def best_action(lam: str, cert: str = "certainty") -> str:
    """Cheapest admissible action under a shadow price; ties to the least friction."""
    a, s, pp = "round(cost_allow, 6)", f"round(cost_stepup + {lam}, 6)", f"round(cost_prepaid + {lam}, 6)"
    return (f"CASE WHEN {cert} = 'CERTIFIED_LOW' THEN 'ALLOW_COD' WHEN {cert} = 'AMBIGUOUS' AND {a} <= {s} AND {a} <= {pp} THEN 'ALLOW_COD' "
            f"WHEN {s} <= {pp} THEN 'STEP_UP_DEPOSIT' ELSE 'FORCE_PREPAID' END")


cte("decided", f"SELECT *, {best_action('0e0')} AS action FROM sets", "sets")


def pnl(action: str, rto: str = "rto", sga: str = "0.11e0", sba: str = "0.65e0") -> str:
    """Expected contribution of an order given the action and the true outcome."""
    ins = "(cost_fp - margin)"
    return (f"CASE WHEN NOT {rto} THEN CASE {action} WHEN 'ALLOW_COD' THEN margin "
            f"WHEN 'STEP_UP_DEPOSIT' THEN (1e0 - {sga}) * (margin - 6e0) + {sga} * (-{ins}) ELSE (1e0 - 0.38e0) * margin + 0.38e0 * (-{ins}) END "
            f"ELSE CASE {action} WHEN 'ALLOW_COD' THEN -cost_fn "
            f"WHEN 'STEP_UP_DEPOSIT' THEN (1e0 - {sba}) * (rho_s * (-cost_fn + 49e0) + (1e0 - rho_s) * (margin - 6e0)) "
            f"ELSE (1e0 - 0.85e0) * (rho_p * (-60e0) + (1e0 - rho_p) * margin) END END")


def shipped(action: str) -> str:
    return (f"CASE WHEN NOT rto THEN 0e0 WHEN {action} = 'ALLOW_COD' THEN 1e0 WHEN {action} = 'STEP_UP_DEPOSIT' THEN (1e0 - 0.65e0) * rho_s "
            f"ELSE (1e0 - 0.85e0) * rho_p END")


def lost(action: str) -> str:
    return f"CASE WHEN rto OR {action} = 'ALLOW_COD' THEN 0e0 WHEN {action} = 'STEP_UP_DEPOSIT' THEN 0.11e0 ELSE 0.38e0 END"


def summary(by: str, source: str, action: str = "action", rto: str = "rto") -> str:
    """Policy summary with the rounding the queries use."""
    keys = by + ", " if by else ""
    group = f" GROUP BY {by}" if by else ""
    x = pnl(action, rto)
    return (f"SELECT {keys}count(*) AS n, round(sum({x}), 2) AS pnl_total, round(avg({x}), 4) AS pnl_per_order, "
            f"round(1000 * sum({x}) / sum(cart_gmv), 4) AS pnl_per_1000_gmv, "
            f"count(*) FILTER ({action} = 'ALLOW_COD') AS n_allow, count(*) FILTER ({action} = 'STEP_UP_DEPOSIT') AS n_stepup, "
            f"count(*) FILTER ({action} = 'FORCE_PREPAID') AS n_prepaid, "
            f"round(avg(CASE WHEN {action} <> 'ALLOW_COD' THEN 1e0 ELSE 0e0 END), 6) AS friction_share, "
            f"round(sum({shipped(action)}), 4) AS rto_shipped, round(count(*) FILTER (rto) - sum({shipped(action)}), 4) AS rto_prevented, "
            f"round(sum({lost(action)}), 4) AS good_lost, count(*) FILTER ({action} <> 'ALLOW_COD' AND NOT rto) AS good_frictioned, "
            f"count(*) FILTER ({action} <> 'ALLOW_COD' AND rto) AS bad_frictioned, "
            f"round(sum(CASE WHEN NOT rto THEN {x} ELSE 0e0 END), 2) AS pnl_good, round(sum(CASE WHEN rto THEN {x} ELSE 0e0 END), 2) AS pnl_bad "
            f"FROM {source}{group}")
