"""Structural completeness of a shipping address, as native regex and array expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pincodes import with_pin_info
from .text import digits, stripped

# What counts as a house number, street anchor, landmark, vague place or junk.
HOUSE = (
    r"(?:\b(?:h\.?\s?no|house\s?no|flat|plot|door|shop|unit|villa|apt|apartment|bldg|building|"
    r"floor|blk|block)\b[\s.:#-]*[a-z]?-?\d+[a-z/-]*\d*)|(?:^\s*#?\s*\d{1,5}[a-z/-]?\b)|"
    r"(?:\b\d{1,4}\s*[/-]\s*\d{1,4}\b)"
)
STREET = (
    r"\b(?:road|rd|street|st|lane|marg|nagar|colony|sector|layout|society|enclave|vihar|puram|"
    r"cross|main|phase|extension|extn|gali|chowk|bazaar|market|mohalla|tola|para|pally|nagar|"
    r"gram|village|town|taluk|tehsil|mandal|block|ward|post|po|ps)\b"
)
LANDMARK = r"\b(?:near|nr|opp|opposite|behind|beside|next\s+to|in\s+front\s+of|b/h)\b"
VAGUE = (
    r"\b(?:village|gaon|gram|ward|po|post\s*office|temple|mandir|masjid|church|school|bus\s*stand|"
    r"station|hospital|chowk|main\s*road)\b"
)
PLACEHOLDER = r"\b(?:test|asdf|qwer|xyz|abc|na|n/a|nil|none|null|dummy|xxx)\b"
REPEATED = r"(.)\1{3,}"
PIN_IN_TEXT = r"\b[1-9]\d{5}\b"

# Place names in an address and the state each one implies.
STATE_OF_PLACE = {
    "delhi": "Delhi", "mumbai": "Maharashtra", "thane": "Maharashtra", "pune": "Maharashtra", "nagpur": "Maharashtra",
    "maharashtra": "Maharashtra", "bengaluru": "Karnataka", "bangalore": "Karnataka", "karnataka": "Karnataka",
    "chennai": "Tamil Nadu", "tamil nadu": "Tamil Nadu", "tamilnadu": "Tamil Nadu", "hyderabad": "Telangana",
    "telangana": "Telangana", "kolkata": "West Bengal", "west bengal": "West Bengal", "bengal": "West Bengal",
    "ahmedabad": "Gujarat", "surat": "Gujarat", "gujarat": "Gujarat", "jaipur": "Rajasthan", "rajasthan": "Rajasthan",
    "lucknow": "Uttar Pradesh", "kanpur": "Uttar Pradesh", "uttar pradesh": "Uttar Pradesh", "up": "Uttar Pradesh",
    "patna": "Bihar", "bihar": "Bihar", "kerala": "Kerala", "kochi": "Kerala", "punjab": "Punjab",
    "haryana": "Haryana", "gurgaon": "Haryana", "gurugram": "Haryana", "noida": "Uttar Pradesh",
    "odisha": "Odisha", "bhubaneswar": "Odisha", "assam": "Assam", "guwahati": "Assam", "jharkhand": "Jharkhand",
    "ranchi": "Jharkhand", "madhya pradesh": "Madhya Pradesh", "indore": "Madhya Pradesh", "bhopal": "Madhya Pradesh",
    "chhattisgarh": "Chhattisgarh", "raipur": "Chhattisgarh", "andhra": "Andhra Pradesh", "vizag": "Andhra Pradesh",
    "visakhapatnam": "Andhra Pradesh",
}

# Weight of each defect in the score.
DEFECT_WEIGHTS = {
    "no_house_no": 0.35, "no_street_anchor": 0.15, "landmark_only": 0.15, "vague_only": 0.15, "too_short": 0.15,
    "junk": 0.35, "pin_in_text_mismatch": 0.20, "state_mismatch": 0.25, "pin_invalid": 0.30,
}

# Unicode-aware, case-insensitive matching for every pattern.
_FLAGS = "(?iU)"


def _found(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + pattern)


def _token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.lower(text), r"[\s,]+"), lambda t: t != ""))


def _other_pin_in(text: Column, pin: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + PIN_IN_TEXT), F.lit(0))
    return F.exists(found, lambda p: p != pin)


def _other_state_in(text: Column, state: Column) -> Column:
    """One pass over the text finds every known place; a map literal turns it into a state."""
    places = sorted(STATE_OF_PLACE, key=len, reverse=True)
    pattern = "(?U)\\b(?:" + "|".join(places) + ")\\b"
    states = F.create_map(*[F.lit(x) for kv in STATE_OF_PLACE.items() for x in kv])
    return F.exists(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda t: states[t] != state)


def score_addresses(df: DataFrame, address: str = "shipping_address", pin: str = "delivery_pin") -> DataFrame:
    """Add PIN columns, the address signals (addr_*) and addr_defect_score in [0, 1]."""
    df = with_pin_info(df, pin)
    text = F.col("_addr")
    scanned = df.withColumn("_addr", stripped(F.coalesce(F.col(address), F.lit("")))).withColumns({
        "addr_tokens": _token_count(text),
        "addr_has_house_no": _found(text, HOUSE),
        "addr_has_street_anchor": _found(text, STREET),
        "_landmark": _found(text, LANDMARK),
        "_vague": _found(text, VAGUE),
        "_junk": _found(text, REPEATED) | _found(text, PLACEHOLDER),
        "addr_pin_mismatch": _other_pin_in(text, digits(F.col(pin))),
        "_other_state": _other_state_in(text, F.col("pin_state")),
    })
    house = F.col("addr_has_house_no")
    flagged = scanned.withColumns({
        "addr_landmark_only": F.col("_landmark") & ~house,
        "addr_vague_only": ~house & F.col("_vague") & (F.col("addr_tokens") <= 8),
        "addr_junk": F.col("_junk") | (F.col("addr_tokens") == 0),
        "addr_too_short": F.col("addr_tokens") < 4,
        "addr_state_mismatch": F.col("pin_valid") & F.col("_other_state"),
    })
    defects = {
        "no_house_no": ~house, "no_street_anchor": ~F.col("addr_has_street_anchor"),
        "landmark_only": F.col("addr_landmark_only"), "vague_only": F.col("addr_vague_only"),
        "too_short": F.col("addr_too_short"), "junk": F.col("addr_junk"),
        "pin_in_text_mismatch": F.col("addr_pin_mismatch"), "state_mismatch": F.col("addr_state_mismatch"),
        "pin_invalid": ~F.col("pin_valid"),
    }
    total = F.lit(0.0)
    for name, hit in defects.items():
        total = total + F.when(hit, F.lit(DEFECT_WEIGHTS[name])).otherwise(F.lit(0.0))
    return (flagged.withColumn("addr_defect_score", F.round(F.least(F.lit(1.0), total), 3))
            .drop("_addr", "_landmark", "_vague", "_junk", "_other_state"))
