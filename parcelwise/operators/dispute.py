"""Dispute evidence: earlier undisputed transactions of the same card that match the disputed one."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAY_SECONDS, HOT_KEY_ROWS
from ..functions.canonical import canonical_json
from ..functions.text import entity_hash
from .components import first_k
from .running import hot_keys, running_by_key

# Look-back window, minima, elements, default dispute delay.
MIN_PRIOR_DAYS, MAX_PRIOR_DAYS = 120, 365
MIN_PRIOR_TXNS, MIN_MATCH_ELEMENTS = 2, 2
PRIMARY, SECONDARY = ("ip_hash", "device_hash"), ("addr_hash", "account_id")
DEFAULT_DELAY_DAYS = 45
FRAUD_REASON = "10.4"
STANDARD = "Visa CE3.0"
CRITERIA = ("reason_code_10_4", "prior_txns_in_120_365d_window", "prior_txns_undisputed", "prior_txns_with_2_matching_elements_incl_ip_or_device")
NARRATIVE = ("Cardholder credential %s has %d undisputed prior transactions 120–365 days before the dispute, each sharing device fingerprint / IP "
             "and shipping/account identifiers with the disputed transaction. Liability shift requested under Visa CE3.0.")
NO_NARRATIVE = "CE3.0 criteria not satisfied; respond with standard compelling evidence."
BUCKET_SECONDS = 35 * DAY_SECONDS


def card_ledger(orders: DataFrame, *, null_matches: bool = False) -> DataFrame:
    """Card transactions with hashed elements.

    Orders without a card token are left out. A missing IP or device stays NULL and matches nothing;
    `null_matches` hashes it to a constant instead, so two transactions without an IP agree on it.
    """
    def element(kind: str, c: Column) -> Column:
        h = entity_hash(kind, c)
        return h if null_matches else F.when(c.isNotNull(), h)

    return orders.filter((F.col("payment_method") == "CARD") & F.col("card_token").isNotNull()).select(
        F.col("order_id").alias("transaction_id"), "seq", "ts", "card_token", element("ip", F.col("ip")).alias("ip_hash"),
        element("device", F.col("device")).alias("device_hash"), element("addr", F.col("addr")).alias("addr_hash"),
        "account_id", F.col("cart_gmv").alias("amount"),
        F.format_string("%d item(s), %.0f g", F.col("items_count"), F.col("weight_grams")).alias("items"),
        "disputed", (~F.col("rto")).alias("delivered"))


def disputable(ledger: DataFrame, n: int | None = None, min_txns: int = 3) -> DataFrame:
    """Latest transaction of every card with enough transactions; the first n cards if n is given."""
    last = ledger.groupBy("card_token").agg(
        F.count(F.lit(1)).alias("txns"), F.max(F.struct("ts", "seq", "transaction_id")).alias("_l"))
    out = last.filter(F.col("txns") >= min_txns).select("card_token", "txns", F.col("_l.transaction_id").alias("transaction_id"))
    return out if n is None else out.orderBy("card_token").limit(n)


def prior_transactions(disputes: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per (dispute, earlier transaction of its card inside the window).

    disputes: transaction_id, dispute_ts (NULL means `ts` + 45 days), reason_code. The join is on card and
    on a time bucket, so a card with a very long history is spread over its buckets. The output has a row per
    pair; `criteria` and `evidence` answer without forming them.
    """
    d = _located(disputes, ledger)
    lo, hi = _window(F.col("d_ts"))
    bucket = lambda c: F.floor(F.unix_seconds(c) / BUCKET_SECONDS).cast("bigint")
    probe = (d.withColumns({"w_lo": lo, "w_hi": hi})
             .withColumn("_b", F.explode(F.sequence(bucket(F.col("w_lo")), bucket(F.col("w_hi"))))))
    t = ledger.select(*[F.col(c).alias(f"t_{c}") for c in ledger.columns]).withColumn("_tb", bucket(F.col("t_ts")))
    joined = probe.join(t, (F.col("card_token") == F.col("t_card_token")) & (F.col("_b") == F.col("_tb"))
                        & (F.col("t_ts") >= F.col("w_lo")) & (F.col("t_ts") <= F.col("w_hi"))
                        & (F.col("t_transaction_id") != F.col("transaction_id")))
    same = {e: F.coalesce((F.col(f"t_{e}") != "") & (F.col(f"t_{e}") == F.col(e)), F.lit(False)) for e in PRIMARY + SECONDARY}
    elements = F.filter(F.array(*[F.when(same[e], e) for e in PRIMARY + SECONDARY]), lambda v: v.isNotNull())
    primary = same[PRIMARY[0]] | same[PRIMARY[1]]
    out = joined.withColumn("matched_elements", elements)
    return out.withColumn("qualifies", ~F.col("t_disputed") & (F.size("matched_elements") >= MIN_MATCH_ELEMENTS) & primary).select(
        "transaction_id", "d_ts", "t_transaction_id", "t_ts", "t_seq", "t_amount", "t_items", "t_delivered", "t_disputed",
        *[f"t_{e}" for e in PRIMARY + SECONDARY], "matched_elements", "qualifies", _days_before().alias("days_before_dispute"))


def _window(d_ts: Column) -> tuple[Column, Column]:
    back = lambda days: F.timestamp_micros(F.unix_micros(d_ts) - days * DAY_SECONDS * 1_000_000)
    return back(MAX_PRIOR_DAYS), back(MIN_PRIOR_DAYS)


def _located(disputes: DataFrame, ledger: DataFrame) -> DataFrame:
    default = F.timestamp_micros(F.unix_micros("ts") + DEFAULT_DELAY_DAYS * DAY_SECONDS * 1_000_000)
    return (disputes.select("transaction_id", "dispute_ts", "reason_code").join(ledger, "transaction_id")
            .withColumn("d_ts", F.coalesce("dispute_ts", default)))


def _key_sets(card: Column, element: dict[str, Column]) -> list[tuple[str, Column]]:
    """(set name, key) of every element combination; the key is NULL where an element is missing."""
    present = {e: F.when(c != "", c) for e, c in element.items()}
    return [(name, F.concat(card, *[x for e in members for x in (F.lit("|"), present[e])])) for name, members, _ in MATCH_SETS]


def _explode_sets(card: Column, element: dict[str, Column], extra: list[tuple[str, Column]]) -> Column:
    pairs = [*extra, *_key_sets(card, element)]
    return F.inline(F.filter(F.array(*[F.struct(F.lit(n).alias("set"), k.alias("key")) for n, k in pairs]),
                             lambda x: x["key"].isNotNull()))


def _inclusion(members: tuple[str, ...]) -> int:
    """Weight of 'matches at least these elements' in the count of qualifying transactions."""
    subsets = [c for n in range(1, len(members) + 1) for c in combinations(members, n)]
    return sum((-1) ** (len(members) - len(c)) for c in subsets if _qualifies(c))


def _qualifies(members: tuple[str, ...]) -> bool:
    return len(members) >= MIN_MATCH_ELEMENTS and any(e in PRIMARY for e in members)


MATCH_SETS = [("+".join(m), m, _inclusion(m)) for n in range(2, 5) for m in combinations(PRIMARY + SECONDARY, n) if _inclusion(m)]
_WINDOW_SET, _UNDISPUTED_SET = "in_window", "undisputed"


def _own_elements() -> dict[str, Column]:
    return {e: F.coalesce(F.col(e), F.lit("")) for e in PRIMARY + SECONDARY}


def _ledger_log(ledger: DataFrame) -> DataFrame:
    """Every transaction under each key it can be found by; a disputed one only under its card's window."""
    free = lambda k: F.when(~F.col("disputed"), k)
    element = {e: F.when(~F.col("disputed"), c).otherwise("") for e, c in _own_elements().items()}
    sets = _explode_sets(F.col("card_token"), element, [(_WINDOW_SET, F.col("card_token")), (_UNDISPUTED_SET, free(F.col("card_token")))])
    return ledger.select("transaction_id", "ts", "seq", sets)


def _probe_log(d: DataFrame) -> DataFrame:
    sets = _explode_sets(F.col("card_token"), _own_elements(),
                         [(_WINDOW_SET, F.col("card_token")), (_UNDISPUTED_SET, F.col("card_token"))])
    return d.select("transaction_id", "w_lo", "w_hi", sets)


_ORDER = ["ts", "sub", "seq"]


def _counted(ledger_log: DataFrame, probes: DataFrame, hot_rows: int) -> DataFrame:
    """Running count of ledger rows per key. sub: -1 probe before, 0 ledger row, 1 probe after its instant."""
    rows = ledger_log.select("set", "key", "ts", F.lit(0).alias("sub"), "seq", "transaction_id", F.lit(1).alias("n"))
    edge = lambda ts, sub: probes.select("set", "key", F.col(ts).alias("ts"), F.lit(sub).alias("sub"),
                                         F.lit(None).cast(ledger_log.schema["seq"].dataType).alias("seq"), "transaction_id", F.lit(0).alias("n"))
    log = rows.unionByName(edge("w_lo", -1)).unionByName(edge("w_hi", 1))
    return running_by_key(log, ["set", "key"], _ORDER, {"before": ("sum", F.col("n"))},
                          hot=hot_keys(log.groupBy("set", "key").count(), hot_rows))


def _windowed(disputes: DataFrame, ledger: DataFrame) -> DataFrame:
    lo, hi = _window(F.col("d_ts"))
    return _located(disputes, ledger).withColumns({"w_lo": lo, "w_hi": hi})


def criteria(disputes: DataFrame, ledger: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Counts and pass flags of each criterion per dispute, eligibility and the first failure.

    No transaction pair is ever formed: the counts inside a window are differences of running counts at its
    two edges, and the count of qualifying matches is put together by inclusion and exclusion over the
    element combinations. The work grows with transactions plus disputes, however busy one card is.
    """
    d = _windowed(disputes, ledger)
    marks = _counted(_ledger_log(ledger), _probe_log(d), hot_rows).filter("sub <> 0")
    signed = F.col("before") * F.col("sub")
    weight = F.create_map(*[F.lit(x) for name, _, w in MATCH_SETS for x in (name, w)])
    counts = marks.groupBy("transaction_id").agg(
        F.sum(F.when(F.col("set") == _WINDOW_SET, signed).otherwise(0)).alias("_w"),
        F.sum(F.when(F.col("set") == _UNDISPUTED_SET, signed).otherwise(0)).alias("_u"),
        F.sum(F.coalesce(weight[F.col("set")], F.lit(0)) * signed).alias("_m"))
    # the disputed transaction itself is no prior, should a late dispute date put it into its own window
    own = F.array(*[F.when(c != "", e) for e, c in _own_elements().items()])
    size = F.size(F.filter(own, lambda e: e.isNotNull()))
    primary = F.coalesce(F.col(PRIMARY[0]) != "", F.lit(False)) | F.coalesce(F.col(PRIMARY[1]) != "", F.lit(False))
    inside = (F.col("ts") >= F.col("w_lo")) & (F.col("ts") <= F.col("w_hi"))
    minus = lambda cond: F.when(inside & cond, 1).otherwise(0)
    known = d.select("transaction_id", "d_ts", "w_lo", "w_hi", minus(F.lit(True)).alias("_sw"), minus(~F.col("disputed")).alias("_su"),
                     minus(~F.col("disputed") & (size >= MIN_MATCH_ELEMENTS) & primary).alias("_sm"))
    j = disputes.join(known, "transaction_id", "left").join(counts, "transaction_id", "left")
    net = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(0)).cast("bigint")
    j = j.withColumns({"in_window": net("_w", "_sw"), "undisputed": net("_u", "_su"), "matched": net("_m", "_sm")})
    found = F.col("d_ts").isNotNull()
    flags = dict(zip(CRITERIA, (F.col("reason_code") == FRAUD_REASON, *[F.col(n) >= MIN_PRIOR_TXNS for n in ("in_window", "undisputed", "matched")]), strict=True))
    ok = found
    for c in flags.values():
        ok = ok & c
    reason = F.when(~found, "transaction not found in ledger").when(ok, "eligible: two or more qualifying prior transactions")
    for name, c in flags.items():
        reason = reason.when(~c, f"failed: {name}")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return j.select("transaction_id", "reason_code", "in_window", "undisputed", "matched",
                    day("w_lo").alias("window_from"), day("w_hi").alias("window_to"), day("d_ts").alias("dispute_date"),
                    *[(found & c).alias(f"pass_{n}") for n, c in flags.items()], ok.alias("eligible"), reason.alias("reason"))


def newest_matches(disputes: DataFrame, ledger: DataFrame, k: int = MIN_PRIOR_TXNS, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The k newest qualifying transactions per dispute, found by their number under each matching key.

    A qualifying transaction agrees with the dispute on some element pair, so the newest k are among the
    newest k under each pair (k + 1, since the dispute itself may be one of them).
    """
    pair_sets = [name for name, members, _ in MATCH_SETS if len(members) == MIN_MATCH_ELEMENTS]
    d = _windowed(disputes, ledger)
    counted = _counted(_ledger_log(ledger).filter(F.col("set").isin(*pair_sets)),
                       _probe_log(d).filter(F.col("set").isin(*pair_sets)), hot_rows)
    numbered = counted.filter("sub = 0").select("set", "key", F.col("before").alias("idx"), F.col("transaction_id").alias("t_transaction_id"))
    wanted = counted.filter("sub = 1").select("set", "key", "transaction_id", F.explode(
        F.sequence(F.col("before") - (k + 1), F.col("before") - 1)).alias("idx"))
    found = wanted.join(numbered, ["set", "key", "idx"]).filter("t_transaction_id <> transaction_id") \
        .select("transaction_id", "t_transaction_id").distinct()
    t = ledger.select(*[F.col(c).alias(f"t_{c}") for c in ledger.columns])
    own = d.select("transaction_id", "d_ts", "w_lo", *PRIMARY, *SECONDARY)
    j = found.join(t, "t_transaction_id").join(own, "transaction_id").filter(F.col("t_ts") >= F.col("w_lo"))
    same = F.filter(F.array(*[F.when((F.col(f"t_{e}") != "") & (F.col(f"t_{e}") == F.col(e)), e) for e in PRIMARY + SECONDARY]),
                    lambda v: v.isNotNull())
    j = j.withColumn("matched_elements", same).withColumn("days_before_dispute", _days_before())
    return first_k(j, ["transaction_id"], [F.desc("t_ts"), F.desc("t_seq")], k)


def _days_before() -> Column:
    return F.round((F.unix_seconds("d_ts") - F.unix_seconds("t_ts")) / DAY_SECONDS).cast("int")


def _listed(matches: DataFrame) -> DataFrame:
    """Matches of each dispute as an array, newest first."""
    hashes = F.struct(*[F.when(F.array_contains("matched_elements", e), F.col(f"t_{e}")).alias(e) for e in PRIMARY + SECONDARY])
    item = F.struct((-F.unix_micros("t_ts")).alias("newest_first"), (-F.col("t_seq")).alias("last_first"), F.col("t_transaction_id").alias("transaction_id"),
                    F.date_format("t_ts", "yyyy-MM-dd").alias("date"), "days_before_dispute", F.col("t_amount").alias("amount_inr"),
                    F.col("t_items").alias("items"), F.col("t_delivered").alias("delivered"), "matched_elements", hashes.alias("element_hashes"))
    return matches.groupBy("transaction_id").agg(F.sort_array(F.collect_list(item)).alias("_l")).select(
        "transaction_id", F.transform("_l", lambda x: x.dropFields("newest_first", "last_first")).alias("prior_transactions"))


def evidence(disputes: DataFrame, ledger: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Criteria, the disputed transaction, its matches newest first, the number of further ones and the narrative.

    An eligible dispute shows its two newest matches and counts the others. An ineligible one shows all: fewer than two, found by
    number like those, unless it fails by its reason code alone; only such disputes meet their card's window row by row.
    """
    c = criteria(disputes, ledger, hot_rows)
    other_code = c.filter(~F.col("eligible") & (F.col("matched") > MIN_PRIOR_TXNS)).select("transaction_id")
    full = prior_transactions(disputes.join(other_code, "transaction_id", "left_semi"), ledger).filter("qualifies")
    few = newest_matches(disputes, ledger, hot_rows=hot_rows).join(other_code, "transaction_id", "left_anti")
    shown = [c for c in few.columns if c in full.columns]
    lists = _listed(few.select(*shown).unionByName(full.select(*shown)))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    credential = F.concat(F.left("card_token", F.lit(8)), F.lit("…"))
    about = _located(disputes, ledger).select("transaction_id", F.struct(
        "transaction_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("amount").alias("amount_inr"), "items", credential.alias("credential"),
        F.struct(*[text(e).alias(e) for e in PRIMARY + SECONDARY]).alias("elements")).alias("disputed_transaction"))
    j = c.join(lists, "transaction_id", "left").join(about, "transaction_id", "left")
    further = F.when(F.col("eligible"), F.greatest(F.lit(0), F.col("matched") - MIN_PRIOR_TXNS)).otherwise(0).cast("bigint")
    story = F.format_string(NARRATIVE, F.col("disputed_transaction.credential"), F.col("matched"))
    none = F.array().cast(lists.schema["prior_transactions"].dataType)
    return j.withColumns({"prior_transactions": F.coalesce("prior_transactions", none), "additional_prior_transactions": further,
                          "merchant_narrative": F.when(F.col("eligible"), story).otherwise(NO_NARRATIVE)})


def packet() -> Column:
    """The packet of an evidence row as a struct."""
    passed = lambda n: F.col(f"pass_{n}").alias("pass")
    counted = lambda n, c: F.struct(passed(n), F.col(c).alias("count")).alias(n)
    window = F.struct(passed(CRITERIA[1]), F.col("in_window").alias("count"), F.array("window_from", "window_to").alias("window")).alias(CRITERIA[1])
    criteria_ = F.struct(F.struct(passed(CRITERIA[0]), F.col("reason_code").alias("value")).alias(CRITERIA[0]), window,
                         counted(CRITERIA[2], "undisputed"), counted(CRITERIA[3], "matched"))
    shown = F.struct("disputed_transaction", "dispute_date", "prior_transactions", "additional_prior_transactions", "merchant_narrative")
    return F.struct("transaction_id", F.lit(STANDARD).alias("standard"), criteria_.alias("criteria"), shown.alias("evidence"))


def packets(disputes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Evidence with its packet as canonical JSON and the SHA-256 of that; a dispute without a transaction has neither."""
    e = evidence(disputes, ledger).withColumn("_packet", packet())
    text = canonical_json(F.col("_packet"), e.schema["_packet"].dataType, ("element_hashes",))
    e = e.withColumn("packet", F.when(F.col("dispute_date").isNotNull(), text)).drop("_packet")
    return e.withColumn("packet_hash", F.coalesce(F.sha2("packet", 256), F.lit("")))
