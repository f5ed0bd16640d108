"""Six-digit postal codes: state, city, tier and cold-start priors as one broadcast lookup."""
from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .literals import literal_table
from .text import digits

# First two digits -> state.
STATE_BY_PREFIX2 = {
    "11": "Delhi", "12": "Haryana", "13": "Haryana", "14": "Punjab", "15": "Punjab", "16": "Punjab",
    "17": "Himachal Pradesh", "18": "Jammu & Kashmir", "19": "Jammu & Kashmir",
    "20": "Uttar Pradesh", "21": "Uttar Pradesh", "22": "Uttar Pradesh", "23": "Uttar Pradesh",
    "24": "Uttar Pradesh", "25": "Uttar Pradesh", "26": "Uttar Pradesh", "27": "Uttar Pradesh",
    "28": "Uttar Pradesh", "30": "Rajasthan", "31": "Rajasthan", "32": "Rajasthan", "33": "Rajasthan",
    "34": "Rajasthan", "36": "Gujarat", "37": "Gujarat", "38": "Gujarat", "39": "Gujarat",
    "40": "Maharashtra", "41": "Maharashtra", "42": "Maharashtra", "43": "Maharashtra", "44": "Maharashtra",
    "45": "Madhya Pradesh", "46": "Madhya Pradesh", "47": "Madhya Pradesh", "48": "Madhya Pradesh",
    "49": "Chhattisgarh", "50": "Telangana", "51": "Andhra Pradesh", "52": "Andhra Pradesh",
    "53": "Andhra Pradesh", "56": "Karnataka", "57": "Karnataka", "58": "Karnataka", "59": "Karnataka",
    "60": "Tamil Nadu", "61": "Tamil Nadu", "62": "Tamil Nadu", "63": "Tamil Nadu", "64": "Tamil Nadu",
    "67": "Kerala", "68": "Kerala", "69": "Kerala", "70": "West Bengal", "71": "West Bengal",
    "72": "West Bengal", "73": "West Bengal", "74": "West Bengal", "75": "Odisha", "76": "Odisha",
    "77": "Odisha", "78": "Assam", "79": "North East", "80": "Bihar", "81": "Bihar", "82": "Bihar",
    "83": "Jharkhand", "84": "Bihar", "85": "Bihar",
}

# First three digits -> (city, tier).
CITY_BY_PREFIX3 = {
    "110": ("New Delhi", 1), "400": ("Mumbai", 1), "401": ("Thane", 1), "560": ("Bengaluru", 1),
    "600": ("Chennai", 1), "500": ("Hyderabad", 1), "700": ("Kolkata", 1), "411": ("Pune", 1),
    "380": ("Ahmedabad", 1), "122": ("Gurugram", 1), "201": ("Noida / Ghaziabad", 1),
    "302": ("Jaipur", 2), "226": ("Lucknow", 2), "160": ("Chandigarh", 2), "641": ("Coimbatore", 2),
    "682": ("Kochi", 2), "440": ("Nagpur", 2), "452": ("Indore", 2), "462": ("Bhopal", 2),
    "395": ("Surat", 2), "390": ("Vadodara", 2), "530": ("Visakhapatnam", 2), "751": ("Bhubaneswar", 2),
    "800": ("Patna", 2), "141": ("Ludhiana", 2), "143": ("Amritsar", 2), "282": ("Agra", 2),
    "208": ("Kanpur", 2), "221": ("Varanasi", 2), "492": ("Raipur", 2), "834": ("Ranchi", 2),
    "781": ("Guwahati", 2), "695": ("Thiruvananthapuram", 2), "620": ("Tiruchirappalli", 2),
    "625": ("Madurai", 2), "575": ("Mangaluru", 2), "580": ("Hubballi", 2), "413": ("Solapur", 3),
    "431": ("Aurangabad", 3), "845": ("Motihari", 4), "847": ("Darbhanga", 4), "851": ("Begusarai", 4),
    "271": ("Gonda", 4), "272": ("Basti", 4), "276": ("Azamgarh", 4), "233": ("Ghazipur", 4),
    "813": ("Bhagalpur", 3), "822": ("Daltonganj", 4), "742": ("Murshidabad", 4), "733": ("Raiganj", 4),
    "786": ("Dibrugarh", 3), "797": ("Kohima", 4), "331": ("Churu", 4), "345": ("Jaisalmer", 4),
    "364": ("Bhavnagar", 3), "370": ("Kutch", 4), "509": ("Mahabubnagar", 4), "515": ("Anantapur", 3),
    "535": ("Vizianagaram", 4), "577": ("Shivamogga", 3), "591": ("Belagavi", 3), "629": ("Nagercoil", 3),
    "673": ("Kozhikode", 2),
}

# Tier -> (delivery prior, RTO prior); a malformed PIN counts as tier 4 with its own priors.
TIER_PRIORS = {1: (0.965, 0.14), 2: (0.94, 0.19), 3: (0.905, 0.26), 4: (0.86, 0.34)}
MALFORMED_TIER, MALFORMED_SERVICEABILITY, MALFORMED_RTO = 4, 0.80, 0.40
UNKNOWN = "Unknown"


_TABLES: WeakKeyDictionary[SparkSession, DataFrame] = WeakKeyDictionary()


def pin_table(spark: SparkSession) -> DataFrame:
    """One row per three-digit prefix 100..999; never more, so it is always safe to broadcast."""
    if spark not in _TABLES:
        _TABLES[spark] = _build(spark)
    return _TABLES[spark]


def _build(spark: SparkSession) -> DataFrame:
    metro_zones = {prefix[0] for prefix, (_, tier) in CITY_BY_PREFIX3.items() if tier == 1}
    rows = []
    for prefix in (str(n) for n in range(100, 1000)):
        state = STATE_BY_PREFIX2.get(prefix[:2], UNKNOWN)
        city, tier = CITY_BY_PREFIX3.get(prefix, (f"{state} district ({prefix}xxx)", 3 if prefix[0] in metro_zones else 4))
        rows.append((prefix, state, city, tier, *TIER_PRIORS[tier]))
    return literal_table(spark, rows, "pin_prefix", "state", "city", "tier", "serviceability_prior", "rto_prior")


def with_pin_info(df: DataFrame, pin: str = "delivery_pin", prefix: str = "pin_") -> DataFrame:
    """Add pin_valid, pin_state, pin_city, pin_tier and the two priors."""
    d = digits(F.col(pin))
    well_formed = (F.length(d) == 6) & ~d.startswith("0")
    key = F.when(well_formed, F.substring(d, 1, 3))
    looked = pin_table(df.sparkSession).select(
        F.col("pin_prefix").alias("_pin_key"), F.col("state").alias("_state"), F.col("city").alias("_city"),
        F.col("tier").alias("_tier"), F.col("serviceability_prior").alias("_serv"), F.col("rto_prior").alias("_rto"))
    added = {
        f"{prefix}valid": F.coalesce(F.col("_state") != UNKNOWN, F.lit(False)),
        f"{prefix}state": F.coalesce("_state", F.lit(UNKNOWN)),
        f"{prefix}city": F.coalesce("_city", F.lit(UNKNOWN)),
        f"{prefix}tier": F.coalesce("_tier", F.lit(MALFORMED_TIER)),
        f"{prefix}serviceability_prior": F.coalesce("_serv", F.lit(MALFORMED_SERVICEABILITY)),
        f"{prefix}rto_prior": F.coalesce("_rto", F.lit(MALFORMED_RTO)),
    }
    kept = [c for c in df.columns if c not in added]
    return (df.withColumn("_pin_lookup", key)
            .join(F.broadcast(looked), F.col("_pin_lookup") == F.col("_pin_key"), "left")
            .select(*kept, *[c.alias(n) for n, c in added.items()]))
