"""Business constants shared by every transform. All amounts are rupees."""
from __future__ import annotations

from dataclasses import asdict, dataclass

# Action names, ordered from least to most friction.
ALLOW = "ALLOW_COD"
STEP_UP = "STEP_UP_DEPOSIT"
PREPAID = "FORCE_PREPAID"
ACTIONS = (ALLOW, STEP_UP, PREPAID)

# Certainty classes of a conformal set.
CERTAINTIES = ("CERTIFIED_LOW", "AMBIGUOUS", "CERTIFIED_HIGH", "NOVEL")

CONFORMAL_ALPHA = 0.10
EXPLORATION_EPSILON = 0.05
IPW_WEIGHT_CAP = 20.0
MAX_REASON_CODES = 4
REASON_CODE_MIN_ABS = 0.05

P_FLOOR, P_CEIL = 0.001, 0.999
DAY_SECONDS = 86400

# Rows under one key above which its running aggregates are computed in time blocks.
HOT_KEY_ROWS = 1_000_000


@dataclass(frozen=True)
class Economics:
    """Unit economics of one merchant (fixed values)."""

    forward_shipping: float = 95.0
    reverse_shipping: float = 110.0
    packaging_cost: float = 18.0
    restocking_cost: float = 22.0
    holding_cost_rate: float = 0.015
    inventory_lockup_lambda: float = 0.02
    default_margin: float = 0.18
    default_cac: float = 420.0
    cac_insult_kappa: float = 0.55
    stepup_deposit: float = 49.0
    stepup_abandon_rate: float = 0.11
    prepaid_abandon_rate: float = 0.38
    stepup_rto_residual: float = 0.10
    prepaid_rto_residual: float = 0.04
    prepaid_rto_unit_cost: float = 60.0
    stepup_friction_cost: float = 6.0
    friction_shadow_price: float = 0.0

    def to_dict(self) -> dict[str, float]:
        return asdict(self)


@dataclass(frozen=True)
class BuyerBehaviour:
    """Buyer response used to value a policy (fixed values); separate from what the pricing assumes."""

    stepup_good_abandon: float = 0.11
    stepup_bad_abandon: float = 0.65
    stepup_rto_residual: float = 0.10
    prepaid_good_abandon: float = 0.38
    prepaid_bad_abandon: float = 0.85
    prepaid_rto_residual: float = 0.04
    deposit: float = 49.0
    friction_cost: float = 6.0
    prepaid_rto_unit_cost: float = 60.0


# Sweep grids of the policy report.
SHADOW_PRICES = (0, 5, 10, 20, 30, 40, 60, 80, 100, 150, 200, 300, 500, 800)
FRICTION_BUDGET = 0.30
SENSITIVITY_GOOD_ABANDON = (0.06, 0.11, 0.18, 0.25, 0.35)
SENSITIVITY_BAD_ABANDON = (0.40, 0.65, 0.85)
CONFORMAL_ALPHAS = (0.05, 0.10, 0.15, 0.20, 0.30)
CONFORMAL_VARIANTS = ("marginal", "class", "class_x_tier")
UNDERCOVER_TOL = 0.02
WEIGHT_TEMPERATURES = (0.0, 0.5, 1.0)
