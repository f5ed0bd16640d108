"""Queries on buyer response, drift monitoring, streaming and dispute evidence."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CERTAINTIES
from ..functions.economics import price_orders
from ..operators import conformal as C
from ..operators import drift
from ..operators import dispute as K
from ..operators import metrics as M
from ..operators import response as R
from ..operators.running import with_position
from ..session import cut_lineage
from ..sources import lens
from ..sources.state_table import StateTable
from ..streaming import jobs as J
from .models import decided, split_frame
from .registry import add
from .sql import cte, entity_hash, sql

# ------------------------------------------------------------------ I: one served intervention per decided order
ABANDONED = "(seq * 31) % 100 < CASE WHEN action = 'STEP_UP_DEPOSIT' THEN 22 ELSE 45 END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flagged order is an observation; whether the buyer quit follows from the order id."""
    d = decided(spark, sf_dir).filter(F.col("action") != "ALLOW_COD")
    gone = F.expr(ABANDONED)
    return d.select("order_id", "seq", R.segment_key(F.col("acquisition_channel"), F.col("pin_tier"), F.col("cart_gmv")).alias("segment"),
                    F.col("action").alias("served_action"), "p", gone.alias("abandoned"),
                    F.when((F.col("action") == "STEP_UP_DEPOSIT") & ~gone & (F.col("seq") % 4 != 0), F.col("rto")).alias("rto"), "addr_attribution")


cte("obs", f"""SELECT *, 1e0 - pc AS q, CASE WHEN gone THEN 1e0 ELSE 0e0 END AS a, action = 'STEP_UP_DEPOSIT' AS step, w * (1e0 - attr) AS x, y - w * attr AS target FROM (
 SELECT order_id, seq, action, {ABANDONED} AS gone, attr, CAST(rto AS DOUBLE) AS y, action = 'STEP_UP_DEPOSIT' AND NOT ({ABANDONED}) AND seq % 4 <> 0 AS paid, least(0.999e0, greatest(0.001e0, p)) AS pc,
  least(0.999e0, greatest(0.001e0, p)) * (1e0 - 0.65e0) / ((1e0 - least(0.999e0, greatest(0.001e0, p))) * (1e0 - 0.11e0) + least(0.999e0, greatest(0.001e0, p)) * (1e0 - 0.65e0)) AS w,
  CASE WHEN acquisition_channel IN ('ORGANIC', 'DIRECT', 'WHATSAPP') THEN 'ORGANIC' WHEN acquisition_channel IN ('GOOGLE_ADS', 'MARKETPLACE') THEN 'SEARCH' ELSE 'SOCIAL' END
   || '|T' || pin_tier || '|' || CASE WHEN cart_gmv < 1000 THEN 'low' WHEN cart_gmv < 2500 THEN 'mid' ELSE 'high' END AS segment
 FROM decided WHERE action <> 'ALLOW_COD')""", "decided")
_sums = """count(*) FILTER (step) AS n_stepup, count(*) FILTER (paid) AS n_paid, count(*) FILTER (NOT step) AS n_prepaid,
 coalesce(sum(q * q) FILTER (step), 0) AS s11, coalesce(sum(q * pc) FILTER (step), 0) AS s12, coalesce(sum(pc * pc) FILTER (step), 0) AS s22, coalesce(sum(a * q) FILTER (step), 0) AS t1, coalesce(sum(a * pc) FILTER (step), 0) AS t2,
 coalesce(sum(x * x) FILTER (paid), 0) AS ww, coalesce(sum(x * target) FILTER (paid), 0) AS wr,
 coalesce(sum(q * q) FILTER (NOT step), 0) AS q11, coalesce(sum(q * pc) FILTER (NOT step), 0) AS q12, coalesce(sum(pc * pc) FILTER (NOT step), 0) AS q22, coalesce(sum(a * q) FILTER (NOT step), 0) AS u1, coalesce(sum(a * pc) FILTER (NOT step), 0) AS u2"""
cte("rstats", f"SELECT coalesce(segment, '*') AS segment, {_sums} FROM obs GROUP BY GROUPING SETS ((segment), ())", "obs")


def _clip(x: str, lo: str = "0.005e0", hi: str = "0.95e0") -> str:
    return f"least({hi}, greatest({lo}, {x}))"


def _ridge(a: str, b: str, c: str, t1: str, t2: str, k: str, d1: str, d2: str) -> tuple[str, str]:
    det = f"((({a}) + {k}) * (({c}) + {k}) - ({b}) * ({b}))"
    r1, r2 = f"({t1} + {k} * {d1})", f"({t2} + {k} * {d2})"
    return _clip(f"((({c}) + {k}) * {r1} - ({b}) * {r2}) / {det}"), _clip(f"((({a}) + {k}) * {r2} - ({b}) * {r1}) / {det}")


_gs, _gb = _ridge("s11", "s12", "s22", "t1", "t2", "60e0", "0.11e0", "0.65e0")
_gp, _gpb = _ridge("q11", "q12", "q22", "u1", "u2", "60e0", "0.38e0", "0.85e0")
cte("rglobal", f"SELECT n_stepup AS gn, {_gs} AS gs, {_gb} AS gb, {_clip('(wr + 20 * 0.1e0) / (ww + 20)', '0.01e0', '0.99e0')} AS gr, {_gp} AS gp, {_gpb} AS gpb FROM rstats WHERE segment = '*'", "rstats")
_ss, _sb = _ridge("s11", "s12", "s22", "t1", "t2", "15e0", "gs", "gb")
_sp, _ = _ridge("q11", "q12", "q22", "u1", "u2", "15e0", "gp", "gpb")
cte("rest", f"""SELECT segment, CASE WHEN gn < 30 THEN 'prior' WHEN n_stepup < 25 THEN 'global' ELSE 'segment' END AS source, n_stepup, n_paid, n_prepaid,
 CASE WHEN gn < 30 THEN 0.11e0 WHEN n_stepup < 25 THEN gs ELSE {_ss} END AS delta_s, CASE WHEN gn < 30 THEN 0.65e0 WHEN n_stepup < 25 THEN gb ELSE {_sb} END AS delta_bad,
 CASE WHEN gn < 30 THEN 0.1e0 WHEN n_stepup < 25 THEN gr ELSE {_clip('(wr + 20 * gr) / (ww + 20)', '0.01e0', '0.99e0')} END AS rho, CASE WHEN gn < 30 THEN 0.38e0 WHEN n_stepup < 25 THEN gp ELSE {_sp} END AS delta_p
FROM rstats, rglobal WHERE segment <> '*'""", "rstats", "rglobal")
RATES = ("delta_s", "delta_bad", "rho", "delta_p")
_r = lambda cols, k: [F.round(c, k).alias(c) for c in cols]
_rq = lambda cols, k: ", ".join(f"round({c}, {k}) AS {c}" for c in cols)
stats = lambda s, d: R.statistics(observations(s, d))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums stored from the even orders, merged with those of the odd ones."""
    o = cut_lineage(observations(spark, sf_dir))
    return R.merge_statistics(R.statistics(o.filter("seq % 2 = 0")), R.statistics(o.filter("seq % 2 = 1")))


add("a28_estimate_state_merge", lambda s, d: merged(s, d).select("segment", *R.COUNTS, *_r(R.SUMS, 6)), sql(f"SELECT segment, n_stepup, n_paid, n_prepaid, {_rq(R.SUMS, 6)} FROM rstats", "rstats"))
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept as versioned state: three batches, of which the second comes three times, once after the third."""
    o = cut_lineage(observations(spark, sf_dir))
    state = StateTable(spark, J.run_folder(spark, "estimates"), lambda rows: R.merge_statistics(rows.limit(0), rows), max_parts=2)
    for batch in (0, 1, 1, 2, 1):
        state.commit(R.statistics(o.filter(F.col("seq") % 3 == batch)), "outcomes", batch)
    head = state.head()
    return state.read(head).withColumn("version", F.lit(head["version"]).cast("bigint"))


add("a28_estimate_state_replayed", lambda s, d: replayed(s, d).select("segment", "version", *R.COUNTS, *_r(R.SUMS, 6)),
    sql(f"SELECT segment, 3 AS version, n_stepup, n_paid, n_prepaid, {_rq(R.SUMS, 6)} FROM rstats", "rstats"))
add("i1_sufficient_statistics", lambda s, d: stats(s, d).select("segment", "n_stepup", "n_prepaid", *_r(("s11", "s12", "s22", "t1", "t2", "q11", "q12", "q22", "u1", "u2"), 6)),
    sql(f"SELECT segment, n_stepup, n_prepaid, {_rq(('s11', 's12', 's22', 't1', 't2', 'q11', 'q12', 'q22', 'u1', 'u2'), 6)} FROM rstats", "rstats"))
add("i2_residual_statistics", lambda s, d: stats(s, d).select("segment", "n_paid", *_r(("ww", "wr"), 6)), sql("SELECT segment, n_paid, round(ww, 6) AS ww, round(wr, 6) AS wr FROM rstats", "rstats"))
add("i3_ridge_solution", lambda s, d: R._solve(stats(s, d).filter("segment = '*'"), R.KAPPA_GLOBAL, (F.lit(0.11), F.lit(0.65)), F.lit(0.10), (F.lit(0.38), F.lit(0.85)), "").select(*_r(RATES, 9)),
    sql("SELECT round(gs, 9) AS delta_s, round(gb, 9) AS delta_bad, round(gr, 9) AS rho, round(gp, 9) AS delta_p FROM rglobal", "rglobal"))
add("i4_shrunk_estimates", lambda s, d: R.estimates(cut_lineage(stats(s, d))).select("segment", "source", *_r(RATES, 9)), sql(f"SELECT segment, source, {_rq(RATES, 9)} FROM rest", "rest"))


def learned_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up cost of every COD order under its segment's learned rates."""
    est = cut_lineage(R.estimates(cut_lineage(stats(spark, sf_dir))))
    o = split_frame(spark, sf_dir).withColumn("segment", R.segment_key(F.col("acquisition_channel"), F.col("pin_tier"), F.col("cart_gmv")))
    return price_orders(R.with_learned_economics(o, est))


add("i5_learned_economics", lambda s, d: learned_costs(s, d).select("order_id", F.round("econ_stepup_abandon_rate", 9).alias("delta_s"), F.round("cost_stepup", 4).alias("cost_stepup")),
    sql("""SELECT order_id, round(ds, 9) AS delta_s, round((1e0 - p) * ds * cost_fp + p * (r + (1e0 - r) * attr) * cost_fn + (1e0 - (1e0 - p) * ds) * 6e0, 4) AS cost_stepup
FROM (SELECT s.*, coalesce(e.delta_s, 0.11e0) AS ds, coalesce(e.rho, 0.1e0) AS r FROM (SELECT *, CASE WHEN acquisition_channel IN ('ORGANIC', 'DIRECT', 'WHATSAPP') THEN 'ORGANIC' WHEN acquisition_channel IN ('GOOGLE_ADS', 'MARKETPLACE') THEN 'SEARCH' ELSE 'SOCIAL' END
 || '|T' || pin_tier || '|' || CASE WHEN cart_gmv < 1000 THEN 'low' WHEN cart_gmv < 2500 THEN 'mid' ELSE 'high' END AS segment FROM split) s LEFT JOIN rest e ON e.segment = s.segment AND e.source <> 'prior')""", "split", "rest"))
add("i6_estimate_report", lambda s, d: R.report(cut_lineage(stats(s, d))).select("level", "segment", "source", "n_stepup", *RATES),
    sql("""SELECT 0 AS level, 'prior' AS segment, 'prior' AS source, 0 AS n_stepup, 0.11e0 AS delta_s, 0.65e0 AS delta_bad, 0.1e0 AS rho, 0.38e0 AS delta_p
UNION ALL SELECT 1, 'global', 'global', gn, round(gs, 4), round(gb, 4), round(gr, 4), round(gp, 4) FROM rglobal UNION ALL SELECT 2, segment, source, n_stepup, round(delta_s, 4), round(delta_bad, 4), round(rho, 4), round(delta_p, 4) FROM rest""", "rest", "rglobal"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error against the abandonment rate the observations really have per segment."""
    o = cut_lineage(observations(spark, sf_dir))
    truth = o.filter("served_action = 'STEP_UP_DEPOSIT'").groupBy("segment").agg(F.avg(F.col("abandoned").cast("double")).alias("true_delta_s"))
    return R.estimator_quality(R.estimates(cut_lineage(R.statistics(o))), truth)


add("i7_estimator_quality", lambda s, d: quality(s, d).select("segments_learned", *_r(("mae_learned", "mae_prior"), 9)),
    sql("""SELECT count(*) AS segments_learned, round(avg(abs(delta_s - t)), 9) AS mae_learned, round(avg(abs(0.11e0 - t)), 9) AS mae_prior FROM rest
 JOIN (SELECT segment, avg(a) AS t FROM obs WHERE step GROUP BY 1) USING (segment) WHERE source = 'segment'""", "rest", "obs"))

# ------------------------------------------------------------------ J: batch twins
Q0, Q1 = 0.2, 0.9


def scored_events(df: DataFrame) -> DataFrame:
    """Certainty of an event's score under fixed quantiles."""
    return df.withColumn("certainty", C.certainty(F.col("p") <= Q0, (1.0 - F.col("p")) <= Q1))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(lens.event_orders(spark, sf_dir))


cte("ev", """SELECT event_id AS seq, ts, p, least(19, CAST(floor(p * 20) AS INTEGER)) AS h, CASE WHEN p <= 0.2e0 AND (1e0 - p) <= 0.9e0 THEN 'AMBIGUOUS' WHEN p <= 0.2e0 THEN 'CERTIFIED_LOW' WHEN (1e0 - p) <= 0.9e0 THEN 'CERTIFIED_HIGH' ELSE 'NOVEL' END AS certainty,
 CAST(floor(epoch(ts) / 300) AS BIGINT) AS bucket, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM (SELECT *, least(0.999e0, value / 500) AS p FROM events)""")
_counts = "count(*) AS n, " + ", ".join(f"count(*) FILTER (certainty = '{c}') AS {k}" for c, k in zip(CERTAINTIES, drift.COUNTS)) + ", " + ", ".join(f"count(*) FILTER (h = {i}) AS h{i}" for i in range(20))
MEASURES = list(drift._MEASURES)
_hour = "SELECT k AS bucket, " + _counts + " FROM ev JOIN (SELECT unnest(range((SELECT min({b}) FROM ev), (SELECT max({b}) FROM ev) + 1)) AS k) ON {b} BETWEEN k - 11 AND k GROUP BY 1"
add("j1_drift_windows", lambda s, d: drift.drift_windows(events(s, d)).select("bucket", *MEASURES), sql(f"SELECT bucket, {_counts} FROM ev GROUP BY 1", "ev"))
add("j2_rolling_hour", lambda s, d: drift.rolling_hour(drift.drift_windows(events(s, d))).select("bucket", *MEASURES), sql(_hour.format(b="bucket"), "ev"))


def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time order as if one came per second."""
    return with_position(events(spark, sf_dir), ["ts", "seq"])


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling hours of the one-per-second stream against its own first tenth."""
    placed = cut_lineage(placed_events(spark, sf_dir))
    per = placed.groupBy(F.floor(F.col("position") / 300).cast("bigint").alias("bucket")).agg(*drift.window_aggregates())
    return drift.monitor(drift.rolling_hour(per), base_of(placed))


BASE_SHARE = 10  # one event in so many, the oldest


def base_of(placed: DataFrame) -> DataFrame:
    counted = M.with_constant(placed, placed.agg(F.count("*").alias("_all")))
    return drift.baseline(counted.filter(F.col("position") * BASE_SHARE < F.col("_all")).drop("_all"))


cte("base", "SELECT count(*) AS bn, " + ", ".join(f"count(*) FILTER (certainty = '{c}') / CAST(count(*) AS DOUBLE) AS b_{c.lower()}" for c in CERTAINTIES) + ", ["
    + ", ".join(f"count(*) FILTER (h = {i}) / CAST(count(*) AS DOUBLE)" for i in range(20)) + "] AS b_hist FROM ev WHERE position * 10 < (SELECT count(*) FROM ev)", "ev")
cte("hours", _hour.format(b="(position // 300)"), "ev")
cte("psi0", "SELECT *, [" + ", ".join(f"h{i} / CAST(n AS DOUBLE)" for i in range(20)) + "] AS live FROM hours, base", "hours", "base")
cte("mon", """SELECT *, n_ambiguous / CAST(n AS DOUBLE) AS amb, n_certified_high / CAST(n AS DOUBLE) AS hi, n_novel / CAST(n AS DOUBLE) AS emp,
 (n_ambiguous / CAST(n AS DOUBLE) - b_ambiguous) / sqrt(greatest(b_ambiguous * (1 - b_ambiguous), 1e-6) / n) AS z,
 list_sum([(greatest(live[i], 1e-4) - greatest(b_hist[i], 1e-4)) * ln(greatest(live[i], 1e-4) / greatest(b_hist[i], 1e-4)) for i in range(1, 21)]) AS psi FROM psi0""", "psi0")
cte("alerted", """SELECT *, CASE WHEN n < 50 THEN [] ELSE list_filter([CASE WHEN emp > 0.03 THEN 'MODEL_EPISTEMIC_DRIFT/critical' END,
 CASE WHEN abs(z) > 4 AND abs(amb - b_ambiguous) > 0.08 THEN 'MODEL_EPISTEMIC_DRIFT/' || CASE WHEN abs(z) > 8 THEN 'critical' ELSE 'warning' END END,
 CASE WHEN b_certified_high > 0 AND hi > 1.5 * b_certified_high THEN 'MODEL_RISK_MIX_SHIFT/warning' END,
 CASE WHEN psi > 0.1 THEN 'MODEL_SCORE_PSI/' || CASE WHEN psi > 0.25 THEN 'critical' ELSE 'warning' END END], lambda x: x IS NOT NULL) END AS al FROM mon""", "mon")
_status = "CASE WHEN n < 50 THEN 'WARMING' WHEN len(list_filter(al, lambda x: x LIKE '%critical')) > 0 THEN 'ALERT' WHEN len(al) > 0 THEN 'WARN' ELSE 'OK' END"
add("j3_baseline", lambda s, d: (lambda b: b.select("b_n", *[F.round(f"b_share_{c.lower()}", 9).alias(f"share_{c.lower()}") for c in CERTAINTIES],
    F.concat_ws(",", F.transform("b_hist", lambda x: F.round(x * F.col("b_n"), 0).cast("bigint").cast("string"))).alias("hist")))(base_of(placed_events(s, d))),
    sql("SELECT bn AS b_n, " + ", ".join(f"round(b_{c.lower()}, 9) AS share_{c.lower()}" for c in CERTAINTIES)
        + ", array_to_string(list_transform(b_hist, lambda x: CAST(CAST(round(x * bn, 0) AS BIGINT) AS VARCHAR)), ',') AS hist FROM base", "base"))
add("j4_stability_index", lambda s, d: monitored(s, d).select("bucket", F.round("score_psi", 9).alias("score_psi")), sql("SELECT bucket, round(psi, 9) AS score_psi FROM mon", "mon"))
add("j5_alerts", lambda s, d: monitored(s, d).select("bucket", "n", F.array_join(F.transform("alerts", lambda a: F.concat(a["code"], F.lit("/"), a["severity"])), ",").alias("alerts")),
    sql("SELECT bucket, n, array_to_string(al, ',') AS alerts FROM alerted", "alerted"))
add("j6_status", lambda s, d: monitored(s, d).select("bucket", "status"), sql(f"SELECT bucket, {_status} AS status FROM alerted", "alerted"))
add("j7_first_alert", lambda s, d: (lambda x: drift.first_alert(x, base_of(x)))(cut_lineage(placed_events(s, d))),
    sql(f"""SELECT min((bucket + 1) * 300) FILTER (st = 'ALERT') AS first_alert_after_orders, count(*) AS checks, count(*) FILTER (st = 'ALERT') AS alert_checks
FROM (SELECT bucket, {_status} AS st FROM alerted) WHERE (bucket + 1) * 300 <= (SELECT count(*) FROM ev)""", "alerted", "ev"))

# ------------------------------------------------------------------ J: streams over the same files
EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                             T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = J.file_stream(spark, f"{sf_dir}/events.parquet", EVENT_SCHEMA)
    return raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), "user_id").alias("user"),
                      F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("device"), "event_type", "value",
                      F.least(F.lit(0.999), F.col("value") / 500).alias("p"))


def drained(spark: SparkSession, name: str, stream: DataFrame, mode: str, sink_of=J.batch_folder_sink) -> str:
    """Run a stream over everything that is there and return the sink folder."""
    folder = J.run_folder(spark, name)
    query = J.start(stream, sink_of(f"{folder}/out"), f"{folder}/ckpt", mode=mode)
    query.awaitTermination()
    return f"{folder}/out"


def stream_windows(spark: SparkSession, sf_dir: str, build, name: str) -> DataFrame:
    out = drained(spark, name, build(scored_events(event_stream(spark, sf_dir))), "update")
    return J.latest_per_key(spark, out, ["bucket"]).select("bucket", *MEASURES)


add("j1_drift_windows_streamed", lambda s, d: stream_windows(s, d, J.drift_window_stream, "drift"), sql(f"SELECT bucket, {_counts} FROM ev GROUP BY 1", "ev"))
# a stream has no last bucket: its hours also end after the last event, as long as they still see one
add("j2_rolling_hour_streamed", lambda s, d: stream_windows(s, d, J.rolling_hour_stream, "hour"),
    sql("SELECT k AS bucket, " + _counts + " FROM ev, LATERAL (SELECT unnest(range(bucket, bucket + 12)) AS k) GROUP BY 1", "ev"))


def stretched(ev: DataFrame, times: int) -> DataFrame:
    """Events spread over `times` as long a span, from 2024 on."""
    start = 1_704_067_200_000_000
    return ev if times == 1 else ev.withColumn("ts", F.timestamp_micros(F.lit(start) + (F.unix_micros("ts") - start) * times))


def joined_stream(spark: SparkSession, sf_dir: str, days: int = J.PENDING_DAYS, times: int = 1) -> DataFrame:
    """Orders are the non-error events, outcomes the error events that name an order by number."""
    ev = stretched(event_stream(spark, sf_dir), times)
    decisions = ev.filter("event_type <> 'error'").select(
        F.concat(F.lit("e"), "seq").alias("order_id"), "ts", "p", F.expr("CASE seq % 3 WHEN 0 THEN 'ALLOW_COD' WHEN 1 THEN 'STEP_UP_DEPOSIT' ELSE 'FORCE_PREPAID' END").alias("served_action"),
        F.lit("SEARCH|T1|low").alias("segment"), F.lit(0.1).alias("addr_attribution"))
    ev2 = stretched(event_stream(spark, sf_dir), times)
    outcomes = ev2.filter("event_type <> 'error' and seq % 4 <> 0").select(
        F.concat(F.lit("e"), "seq").alias("order_id"), F.timestamp_micros(F.unix_micros("ts") + F.col("seq") % 40 * 86_400_000_000).alias("outcome_ts"), (F.col("seq") % 5 == 0).alias("rto"),
        F.expr("CASE WHEN seq % 3 = 1 THEN CASE WHEN seq % 7 = 0 THEN 'abandoned' ELSE 'paid' END END").alias("stepup_result"),
        F.expr("CASE WHEN seq % 3 = 2 THEN CASE WHEN seq % 5 = 0 THEN 'abandoned' ELSE 'paid' END END").alias("prepaid_result"))
    return J.decisions_with_outcomes(decisions, outcomes, days)


def matched_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(drained(spark, "join", joined_stream(spark, sf_dir), "append")).filter(F.col("rto").isNotNull())


add("j9_decisions_with_outcomes", lambda s, d: matched_outcomes(s, d).select("order_id", "rto"),
    "SELECT 'e' || event_id AS order_id, event_id % 5 = 0 AS rto FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0 AND event_id % 40 <= 30")


# orders still open when the watermark passed their retention (the table spans thirty days, so its span is stretched to ninety),
# and windows that are closed for good
add("j11_expired_orders", lambda s, d: s.read.parquet(drained(s, "join", joined_stream(s, d, times=3), "append")).filter(F.col("rto").isNull()).select(
    "order_id", F.round(F.unix_micros("ts") / 1e6, 3).alias("ts_epoch")),
    """SELECT 'e' || event_id AS order_id, round(epoch_us(t) / 1e6, 3) AS ts_epoch FROM (
 SELECT *, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - 1704067200000000) * 3) AS t FROM events WHERE event_type <> 'error')
WHERE (event_id % 4 = 0 OR event_id % 40 > 30) AND t + INTERVAL 30 DAY < (
 SELECT least(max(t), max(t + to_days(CAST(event_id % 40 AS INTEGER))) FILTER (event_id % 4 <> 0)) - INTERVAL 1 DAY
 FROM (SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - 1704067200000000) * 3) AS t FROM events WHERE event_type <> 'error'))""")


def bounded_pending(spark: SparkSession, sf_dir: str, limit: int = 25, ranges: int = 16) -> DataFrame:
    """Fates under a small bound: every fourth order never has an outcome, the others have one within seven hours."""
    ev = event_stream(spark, sf_dir).filter("event_type <> 'error'")
    own = [(F.col("seq") % ranges).alias("range"), F.concat(F.lit("e"), "seq").alias("order_id")]
    orders = ev.select(*own, F.lit(0).alias("kind"), F.unix_micros("ts").alias("at"), "seq", F.lit(None).cast("boolean").alias("rto"), F.col("value").cast("string").alias("payload"))
    late = F.unix_micros("ts") + (F.col("seq") % 7 + 1) * 3_600_000_000
    ev2 = event_stream(spark, sf_dir).filter("event_type <> 'error' and seq % 4 <> 0")
    outcomes = ev2.select(*own, F.lit(1).alias("kind"), late.alias("at"), "seq", (F.col("seq") % 5 == 0).alias("rto"), F.lit(None).cast("string").alias("payload"))
    with J.state_in_rocksdb(spark):
        return spark.read.parquet(drained(spark, "pending", J.pending_stream(orders.unionByName(outcomes), limit), "append")).drop("batch_id")


cte("waits", """SELECT event_id AS seq, event_id % 16 AS r, epoch_us(ts) AS at, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) + (event_id % 7 + 1) * 3600000000 END AS done,
 row_number() OVER (PARTITION BY event_id % 16 ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'""")
cte("pushed", """SELECT DISTINCT seq FROM (SELECT k.seq, row_number() OVER (PARTITION BY j.r, j.n ORDER BY k.n DESC) AS newer FROM waits j JOIN waits k
 ON j.r = k.r AND k.n <= j.n AND (k.done IS NULL OR k.done >= j.at)) WHERE newer > 25""", "waits")
add("j11_retention_by_count", lambda s, d: bounded_pending(s, d).filter("fate <> 'unknown'").select("order_id", "fate", "rto"),
    sql("""SELECT 'e' || seq AS order_id, 'evicted' AS fate, NULL AS rto FROM pushed UNION ALL
SELECT 'e' || seq, 'outcome', seq % 5 = 0 FROM waits WHERE done IS NOT NULL AND seq NOT IN (SELECT seq FROM pushed)""", "waits", "pushed"))
add("j12_expired_windows", lambda s, d: s.read.parquet(drained(s, "closed", J.drift_window_stream(scored_events(event_stream(s, d))), "append")).select("bucket", *MEASURES),
    sql(f"SELECT bucket, {_counts} FROM ev GROUP BY 1 HAVING (bucket + 1) * 300 <= (SELECT epoch(max(ts)) FROM ev) - 70 * 60", "ev"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that shipped, and interventions the response sums learn from, counted per route."""
    folder = J.run_folder(spark, "routes")
    query = J.start(joined_stream(spark, sf_dir), J.outcome_router(f"{folder}/shipped", f"{folder}/response"), f"{folder}/ckpt")
    query.awaitTermination()
    shipped = spark.read.parquet(f"{folder}/shipped").agg(F.lit("shipped").alias("route"), F.count("*").alias("n"))
    learnt = spark.read.parquet(f"{folder}/response").agg(F.lit("response").alias("route"), F.count("*").alias("n"))
    return shipped.unionByName(learnt)


add("j14_outcome_routing", routed,
    """SELECT 'shipped' AS route, count(*) FILTER (NOT ((event_id % 3 = 1 AND event_id % 7 = 0) OR (event_id % 3 = 2 AND event_id % 5 = 0))) AS n FROM events
 WHERE event_type <> 'error' AND event_id % 4 <> 0 AND event_id % 40 <= 30
UNION ALL SELECT 'response', count(*) FILTER (event_id % 3 <> 0) FROM events WHERE event_type <> 'error' AND event_id % 4 <> 0 AND event_id % 40 <= 30""")


def entity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity state that a stream adds to batch by batch; the source is read in pieces, so that there are several."""
    ev = event_stream(spark, sf_dir).select(
        F.concat(F.lit("e"), "seq").alias("order_id"), (F.col("event_type") == "error").cast("int").alias("kind"), "ts", F.col("user").alias("phone"), "device",
        F.col("user").alias("addr"), F.lit("110001").alias("delivery_pin"), F.col("value").alias("cart_gmv"), (F.col("seq") % 2 == 0).alias("rto"))
    folder = J.run_folder(spark, "entities")
    state = StateTable(spark, f"{folder}/state", J.merge_entity_rows)
    J.start(ev, state.sink("events", J.entity_delta), f"{folder}/ckpt").awaitTermination()
    return J.entity_states(state.read())


_state = lambda e, k, o: f"""SELECT '{e}' AS entity, {k} AS key, count(*) FILTER (event_type <> 'error') AS orders, count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) AS rto,
 count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) AS delivered, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 2) AS gmv,
 least(40, count(*) FILTER (event_type <> 'error')) AS recent, {f"count(DISTINCT {o}) FILTER (event_type <> 'error')" if o else '0'} AS distinct_others FROM x GROUP BY 2"""
add("j10_entity_state", lambda s, d: entity_state(s, d).select("entity", "key", "orders", "rto", "delivered", F.round("gmv", 2).alias("gmv"),
                                                               F.size("recent").cast("bigint").alias("recent"), "distinct_others"),
    "WITH x AS (SELECT *, 'u' || user_id AS u, 'k' || json_extract_string(props, '$.k') AS k, '110001' AS pin FROM events) "
    + " UNION ALL ".join(_state(*a) for a in (("phone", "u", "k"), ("device", "k", "u"), ("addr", "u", "u"), ("pin", "pin", None))))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows of a stream whose second file replays the day before: counted on time and late."""
    folder = J.run_folder(spark, "late")
    ev = lens.event_orders(spark, sf_dir)
    ev.write.mode("append").parquet(f"{folder}/in")
    source = spark.read.parquet(f"{folder}/in").schema
    run = lambda: J.start(spark.readStream.schema(source).parquet(f"{folder}/in"), J.late_splitter(f"{folder}/time", f"{folder}/late", f"{folder}/clock", 86400),
                          f"{folder}/ckpt").awaitTermination()
    run()
    ev.withColumn("seq", F.col("seq") + 1_000_000_000).write.mode("append").parquet(f"{folder}/in")
    run()
    counted = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("route"), F.count("*").alias("n"))
    return counted("time").unionByName(counted("late"))


add("j15_late_rows", late_rows,
    "SELECT CASE WHEN r = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'late' ELSE 'time' END AS route, count(*) AS n FROM events, range(0, 2) t(r) GROUP BY 1")

# ------------------------------------------------------------------ K


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.card_ledger(lens.orders(spark, sf_dir))


def disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest transaction of every busy card, and every order marked disputed (cards or not)."""
    latest = K.disputable(ledger(spark, sf_dir)).select("transaction_id")
    marked = lens.orders(spark, sf_dir).filter("disputed").select(F.col("order_id").alias("transaction_id"))
    n = F.col("transaction_id").cast("bigint")
    return latest.unionByName(marked).distinct().select(
        "transaction_id", F.when(n % 5 == 0, F.to_timestamp(F.lit("2000-06-30"))).alias("dispute_ts"), F.when(n % 13 == 0, "10.1").otherwise("10.4").alias("reason_code"))


cte("cards", f"""SELECT order_id AS transaction_id, seq, ts, card_token, {entity_hash('ip', 'ip')} AS ip_hash, {entity_hash('device', 'device')} AS device_hash, {entity_hash('addr', 'addr')} AS addr_hash,
 account_id, cart_gmv AS amount, items_count || ' item(s), ' || CAST(CAST(weight_grams AS BIGINT) AS VARCHAR) || ' g' AS items, disputed, NOT rto AS delivered FROM lens WHERE payment_method = 'CARD'""", "lens")
cte("latest", "SELECT card_token, count(*) AS txns, arg_max(transaction_id, (ts, seq)) AS transaction_id FROM cards GROUP BY 1 HAVING count(*) >= 3", "cards")
cte("claims", """SELECT *, CASE WHEN CAST(transaction_id AS BIGINT) % 5 = 0 THEN TIMESTAMP '2000-06-30' END AS dispute_ts, CASE WHEN CAST(transaction_id AS BIGINT) % 13 = 0 THEN '10.1' ELSE '10.4' END AS reason_code
FROM (SELECT transaction_id FROM latest UNION SELECT order_id FROM lens WHERE disputed)""", "latest", "lens")
cte("located", "SELECT c.*, dispute_ts, reason_code, coalesce(dispute_ts, ts + to_days(45)) AS d_ts FROM claims JOIN cards c USING (transaction_id)", "claims", "cards")
cte("prior", """SELECT d.transaction_id, d.d_ts, t.transaction_id AS t_id, t.ts AS t_ts, t.seq AS t_seq, t.disputed AS t_disputed, t.amount AS t_amount, t.delivered AS t_delivered, el,
 NOT t.disputed AND len(el) >= 2 AND (t.ip_hash = d.ip_hash OR t.device_hash = d.device_hash) AS qualifies
FROM located d JOIN cards t ON t.card_token = d.card_token AND t.transaction_id <> d.transaction_id AND t.ts BETWEEN d.d_ts - to_days(365) AND d.d_ts - to_days(120),
 LATERAL (SELECT list_filter([CASE WHEN t.ip_hash = d.ip_hash THEN 'ip_hash' END, CASE WHEN t.device_hash = d.device_hash THEN 'device_hash' END, CASE WHEN t.addr_hash = d.addr_hash THEN 'addr_hash' END,
  CASE WHEN t.account_id = d.account_id THEN 'account_id' END], lambda x: x IS NOT NULL) AS el)""", "located", "cards")
cte("verdict", """SELECT *, NOT found AS missing, found AND reason_code = '10.4' AND in_window >= 2 AND undisputed >= 2 AND matched >= 2 AS eligible FROM (
 SELECT c.transaction_id, c.reason_code, l.d_ts, l.d_ts IS NOT NULL AS found, coalesce(w, 0) AS in_window, coalesce(u, 0) AS undisputed, coalesce(m, 0) AS matched FROM claims c LEFT JOIN located l USING (transaction_id)
 LEFT JOIN (SELECT transaction_id, count(*) AS w, count(*) FILTER (NOT t_disputed) AS u, count(*) FILTER (qualifies) AS m FROM prior GROUP BY 1) USING (transaction_id))""", "claims", "located", "prior")
add("k1_card_ledger", lambda s, d: ledger(s, d).select("transaction_id", "card_token", "ip_hash", "device_hash", "addr_hash", "account_id", "amount", "items", "disputed", "delivered"),
    sql("SELECT transaction_id, card_token, ip_hash, device_hash, addr_hash, account_id, amount, items, disputed, delivered FROM cards", "cards"))
add("k2_dispute_candidates", lambda s, d: K.disputable(ledger(s, d)), sql("SELECT card_token, txns, transaction_id FROM latest", "latest"))
add("k2_first_candidates", lambda s, d: K.disputable(ledger(s, d), 10), sql("SELECT card_token, txns, transaction_id FROM latest ORDER BY card_token LIMIT 10", "latest"))
pairs = lambda s, d: K.prior_transactions(disputes(s, d), ledger(s, d))
add("k3_prior_transactions", lambda s, d: pairs(s, d).select("transaction_id", "t_transaction_id", "days_before_dispute"),
    sql("SELECT transaction_id, t_id AS t_transaction_id, CAST(round(epoch(d_ts - t_ts) / 86400) AS INTEGER) AS days_before_dispute FROM prior", "prior"))
add("k4_undisputed_priors", lambda s, d: pairs(s, d).filter(~F.col("t_disputed")).select("transaction_id", "t_transaction_id"),
    sql("SELECT transaction_id, t_id AS t_transaction_id FROM prior WHERE NOT t_disputed", "prior"))
add("k5_element_matches", lambda s, d: pairs(s, d).select("transaction_id", "t_transaction_id", F.array_join("matched_elements", ",").alias("elements"), "qualifies"),
    sql("SELECT transaction_id, t_id AS t_transaction_id, array_to_string(el, ',') AS elements, qualifies FROM prior", "prior"))
add("k6_criteria", lambda s, d: K.criteria(disputes(s, d), ledger(s, d)).select("transaction_id", "reason_code", "in_window", "undisputed", "matched", "window_from", "window_to", "eligible", "reason"),
    sql("""SELECT transaction_id, reason_code, in_window, undisputed, matched, strftime(d_ts - to_days(365), '%Y-%m-%d') AS window_from, strftime(d_ts - to_days(120), '%Y-%m-%d') AS window_to, eligible,
 CASE WHEN missing THEN 'transaction not found in ledger' WHEN eligible THEN 'eligible: two or more qualifying prior transactions' WHEN reason_code <> '10.4' THEN 'failed: reason_code_10_4'
  WHEN in_window < 2 THEN 'failed: prior_txns_in_120_365d_window' WHEN undisputed < 2 THEN 'failed: prior_txns_undisputed' ELSE 'failed: prior_txns_with_2_matching_elements_incl_ip_or_device' END AS reason FROM verdict""", "verdict"))
cte("shown", """SELECT p.* FROM prior p JOIN verdict v USING (transaction_id) WHERE qualifies QUALIFY NOT v.eligible OR row_number() OVER (PARTITION BY transaction_id ORDER BY t_ts DESC, t_seq DESC) <= 2""", "prior", "verdict")
cte("told", f"""SELECT v.*, CASE WHEN eligible THEN replace(replace('{K.NARRATIVE}', '%s', substr(card_token, 1, 8) || '…'), '%d', matched::VARCHAR) ELSE '{K.NO_NARRATIVE}' END AS story
FROM verdict v LEFT JOIN cards c ON c.transaction_id = v.transaction_id""", "verdict", "cards")
add("k7_evidence", lambda s, d: K.evidence(disputes(s, d), ledger(s, d)).select(
    "transaction_id", "eligible", "additional_prior_transactions", "merchant_narrative", "disputed_transaction.credential", F.col("disputed_transaction.amount_inr").alias("amount_inr"),
    F.array_join(F.transform("prior_transactions", lambda x: F.concat(x["transaction_id"], F.lit("@"), x["date"], F.lit("/"), x["days_before_dispute"].cast("string"), F.lit("/"),
                 F.array_join(x["matched_elements"], "+"))), ",").alias("evidence")),
    sql("""SELECT v.transaction_id, eligible, CASE WHEN eligible THEN greatest(0, matched - 2) ELSE 0 END AS additional_prior_transactions, coalesce((SELECT string_agg(t_id || '@' || strftime(t_ts, '%Y-%m-%d') || '/' ||
 CAST(CAST(round(epoch(s.d_ts - t_ts) / 86400) AS INTEGER) AS VARCHAR) || '/' || array_to_string(el, '+'), ',' ORDER BY t_ts DESC, t_seq DESC) FROM shown s WHERE s.transaction_id = v.transaction_id), '') AS evidence,
 story AS merchant_narrative, substr(card_token, 1, 8) || '…' AS credential, amount AS amount_inr FROM told v LEFT JOIN cards c ON c.transaction_id = v.transaction_id""", "told", "shown", "cards"))
_bool = lambda x: f"CASE WHEN {x} THEN 'true' ELSE 'false' END"
_ELEMENTS = ("account_id", "addr_hash", "device_hash", "ip_hash")
_pairs = lambda p, only: "concat_ws(',', " + ", ".join(f"CASE WHEN {only(e)} THEN '\"{e}\":\"' || {p}{e} || '\"' END" for e in _ELEMENTS) + ")"
cte("items", f"""SELECT s.transaction_id, s.t_ts, s.t_seq, '{{"amount_inr":' || t.amount || ',"date":"' || strftime(t.ts, '%Y-%m-%d') || '","days_before_dispute":' || CAST(round(epoch(s.d_ts - s.t_ts) / 86400) AS INTEGER) ||
 ',"delivered":' || {_bool('t.delivered')} || ',"element_hashes":{{' || {_pairs('t.', lambda e: f"list_contains(el, '{e}')")} || '}},"items":"' || t.items || '","matched_elements":["' || array_to_string(el, '","') ||
 '"],"transaction_id":"' || t_id || '"}}' AS item FROM shown s JOIN cards t ON t.transaction_id = s.t_id""", "shown", "cards")
add("k8_packets", lambda s, d: K.packets(disputes(s, d), ledger(s, d)).select("transaction_id", "eligible", "packet_hash", "packet"),
    sql(f"""SELECT transaction_id, eligible, packet, coalesce(sha256(packet), '') AS packet_hash FROM (SELECT v.transaction_id, eligible, CASE WHEN found THEN
 '{{"criteria":{{"prior_txns_in_120_365d_window":{{"count":' || in_window || ',"pass":' || {_bool('in_window >= 2')} || ',"window":["' || strftime(d_ts - to_days(365), '%Y-%m-%d') || '","' || strftime(d_ts - to_days(120), '%Y-%m-%d') ||
 '"]}},"prior_txns_undisputed":{{"count":' || undisputed || ',"pass":' || {_bool('undisputed >= 2')} || '}},"prior_txns_with_2_matching_elements_incl_ip_or_device":{{"count":' || matched || ',"pass":' || {_bool('matched >= 2')} ||
 '}},"reason_code_10_4":{{"pass":' || {_bool("reason_code = '10.4'")} || ',"value":"' || reason_code || '"}}}},"evidence":{{"additional_prior_transactions":' || CASE WHEN eligible THEN greatest(0, matched - 2) ELSE 0 END ||
 ',"dispute_date":"' || strftime(d_ts, '%Y-%m-%d') || '","disputed_transaction":{{"amount_inr":' || c.amount || ',"credential":"' || substr(card_token, 1, 8) || '…","date":"' || strftime(c.ts, '%Y-%m-%d') || '","elements":{{' ||
 {_pairs('c.', lambda e: 'true')} || '}},"items":"' || c.items || '","transaction_id":"' || v.transaction_id || '"}},"merchant_narrative":"' || story || '","prior_transactions":[' ||
 coalesce((SELECT string_agg(item, ',' ORDER BY t_ts DESC, t_seq DESC) FROM items i WHERE i.transaction_id = v.transaction_id), '') || ']}},"standard":"Visa CE3.0","transaction_id":"' || v.transaction_id || '"}}' END AS packet
FROM told v LEFT JOIN cards c ON c.transaction_id = v.transaction_id)""", "told", "items", "cards"))
