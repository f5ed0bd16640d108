"""Splits, ranking metrics, calibration metrics and thresholds, none of which sorts globally in one task.

Everything that needs an order over scores works on the score curve: one row per distinct score with its
label counts and the counts of everything below it.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running, with_position

# Names and shares of the chronological split, grid of the global threshold search.
SPLITS = (("train", 0.6), ("valid", 0.1), ("calib", 0.1), ("conf", 0.1), ("test", 0.1))
COST_THRESHOLDS = 91
THRESHOLD_LOW, THRESHOLD_STEP = 0.05, 0.01
ECE_BINS = 15
HIST_BINS = 20


def with_constant(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row table to every row."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(row.withColumn("_k", F.lit(1))), "_k").drop("_k")


#: Buckets of a histogram that selects a rank, and rows among which the rank is looked up in the end.
RANK_BUCKETS, RANK_ROWS = 4096, 4096


def at_ranks(df: DataFrame, keys: list[Column], ranks_of: Callable[[int], list[int]]) -> list[tuple[int, ...] | None]:
    """The keys of the rows at 0-based ranks by whole-number keys, without a sort; None beyond the last row.

    `ranks_of` gives the ranks for a number of rows.

    A histogram over the first key tells the bucket of each rank, one over that bucket a finer one, and so on through the keys,
    until a bucket has few rows. Every scan reads the keys alone and hands on at most a row for each bucket.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[k.cast("bigint").alias(n) for k, n in zip(keys, names, strict=True)])
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)]).first()
    span, ranks = [(ends[f"min{n}"], ends[f"max{n}"]) for n in names], ranks_of(ends["n"])
    found: list[tuple[int, ...] | None] = [None] * len(ranks)
    # rank, its number inside the interval, keys known, interval of the next one
    open_ = [[i, r, (), *span[0], ends["n"]] for i, r in enumerate(ranks) if r < ends["n"]]

    def inside(known: tuple, low: int, high: int) -> Column:
        cond = F.col(names[len(known)]).between(low, high)
        for n, v in zip(names, known, strict=False):
            cond = cond & (F.col(n) == v)
        return cond

    while any(o[5] > RANK_ROWS for o in open_):
        wide = [o for o in open_ if o[5] > RANK_ROWS]
        widths = [-(-(high - low + 1) // RANK_BUCKETS) for _, _, _, low, high, _ in wide]
        marks = [F.when(inside(known, low, high), F.struct(F.lit(k).alias("k"), F.floor((F.col(names[len(known)]) - low) / w).cast("bigint").alias("b")))
                 for k, ((_, _, known, low, high, _), w) in enumerate(zip(wide, widths, strict=True))]
        counts = rows.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.k", "m.b").count().collect()
        for k, (o, w) in enumerate(zip(wide, widths, strict=True)):
            for _, b, n in sorted(tuple(c) for c in counts if c["k"] == k):
                if o[1] < n:
                    low = o[3] + b * w
                    o[3:] = [low, min(o[4], low + w - 1), n]
                    break
                o[1] -= n
            if o[3] == o[4]:  # the key is known; rows that agree in all keys are alike
                o[2] = (*o[2], o[3])
                o[3:] = [*span[len(o[2])], o[5]] if len(o[2]) < len(names) else [0, 0, 0]
    for i, _, known, *_ in [o for o in open_ if len(o[2]) == len(names)]:
        found[i] = known
    few = [o for o in open_ if len(o[2]) < len(names)]
    if few:
        marks = [F.when(inside(known, low, high), F.lit(k)) for k, (_, _, known, low, high, _) in enumerate(few)]
        picked = rows.select(*names, F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("k")).collect()
        for k, (i, r, *_) in enumerate(few):
            found[i] = sorted(tuple(x)[:-1] for x in picked if x["k"] == k)[r]
    return found


def chronological_split(df: DataFrame, ts: str = "ts", seq: str = "seq", *, position: bool = False) -> DataFrame:
    """Add `split` (60/10/10/10/10 in time order), and on request `position` (0-based), which alone needs the rows in order."""
    keys = [F.unix_micros(ts), F.col(seq).cast("bigint")]
    at, split = F.struct(*keys), F.lit(SPLITS[-1][0])
    edges = at_ranks(df, keys, lambda n: list(accumulate(round(share * n) for _, share in SPLITS[:-1])))
    for (name, _), edge in reversed(list(zip(SPLITS[:-1], edges, strict=True))):
        before = F.lit(True) if edge is None else at < F.struct(*[F.lit(v).cast("bigint") for v in edge])
        split = F.when(before, name).otherwise(split)
    placed = with_position(df, [ts, seq]) if position else df
    return placed.withColumn("split", split)


def score_curve(df: DataFrame, score: str, label: str, by: list[str] | None = None, blocks: int = 1000) -> DataFrame:
    """(by..., score, n, pos, n_below, pos_below) per distinct score in [0, 1]."""
    keys = by or []
    counted = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("pos"))
    return running(counted, keys, ["score"], {"n_below": ("sum", F.col("n")), "pos_below": ("sum", F.col("pos"))},
                   block=F.floor(F.col("score") * blocks).cast("bigint"))


def curve_totals(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    return curve.groupBy(*(by or [])).agg(F.sum("n").alias("total"), F.sum("pos").alias("total_pos"))


def _at_or_above(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, precision and recall of the rule score >= threshold, per distinct threshold."""
    c = with_constant(curve, curve_totals(curve)) if not by else curve.join(curve_totals(curve, by), by)
    c = c.withColumn("tp", F.col("total_pos") - F.col("pos_below")).withColumn(
        "fp", F.col("total") - F.col("n_below") - F.col("tp"))
    return c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn(
        "recall", F.coalesce(F.try_divide(F.col("tp"), F.col("total_pos")), F.lit(1.0)))


def ranking_metrics(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC with half credit for ties, and step-wise average precision, per group."""
    neg = F.col("n") - F.col("pos")
    wins = F.col("pos") * ((F.col("n_below") - F.col("pos_below")) + neg * 0.5)
    c = _at_or_above(curve, by)
    return c.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(wins), F.max("total_pos").cast("double") * (F.max("total") - F.max("total_pos"))).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.max("total_pos").cast("double")).alias("pr_auc"))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(-F.when(y, F.log(p)).otherwise(F.log(1.0 - p)))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), F.lit(2.0)))


def edge_bin(p: Column, bins: int) -> Column:
    """Bin of p among `bins` equal widths whose edges are i * (1 / bins); the last one is closed."""
    step = F.lit(1.0 / bins)
    b = F.floor(p * bins)
    b = F.when(p < b * step, b - 1).when(p >= (b + 1) * step, b + 1).otherwise(b)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)).cast("int")


def floor_bin(p: Column, bins: int = HIST_BINS) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(p * bins))).cast("int")


def calibration_error(df: DataFrame, p: str, y: str, by: list[str] | None = None, bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error per group."""
    keys = by or []
    cells = df.groupBy(*keys, edge_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return cells.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def _value_at(rank: Column) -> Column:
    return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n")), F.col("score")))


def quantile_edges(curve: DataFrame, parts: int = 10) -> DataFrame:
    """One row: distinct linearly interpolated quantile edges of the scores, in order."""
    c = with_constant(curve, curve_totals(curve))
    cols, edges = [], []
    for i in range(parts + 1):
        h = (F.col("total") - 1) * F.lit(i / parts)
        cols += [_value_at(F.floor(h)).alias(f"_lo{i}"), _value_at(F.ceil(h)).alias(f"_hi{i}"),
                 F.max(h - F.floor(h)).alias(f"_w{i}")]
        edges.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}"))
    return c.agg(*cols).select(F.array_distinct(F.array(*edges)).alias("edges"))


def decile_curve(curve: DataFrame, parts: int = 10) -> DataFrame:
    """Mean score, label rate and size per quantile bin; bins are (lo, hi], the first one closed."""
    inner = F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))")
    c = with_constant(curve, quantile_edges(curve, parts))
    c = c.withColumn("decile", F.size(F.filter(inner, lambda e: e < F.col("score"))))
    return c.groupBy("decile").agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("p_mean"),
        (F.sum("pos") / F.sum("n")).alias("rto_rate"), F.sum("n").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = HIST_BINS) -> DataFrame:
    return df.groupBy(edge_bin(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, flag: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    tp, fp = F.count_if(flag & y), F.count_if(flag & ~y)
    fn, tn = F.count_if(~flag & y), F.count_if(~flag & ~y)
    one = F.lit(1)
    out = df.groupBy(*(by or [])).agg(n.alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    t, f_, m, r = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({
        "accuracy": (t + r) / F.col("n"), "precision": t / F.greatest(one, t + f_), "recall": t / F.greatest(one, t + m),
        "specificity": r / F.greatest(one, r + f_), "f1": 2 * t / F.greatest(one, 2 * t + f_ + m)})


def best_f1(curve: DataFrame) -> DataFrame:
    """Score threshold with the highest F1 of the rule score >= threshold; the lowest wins a tie."""
    pr, rc = F.col("precision"), F.col("recall")
    f1 = 2 * pr * rc / F.greatest(pr + rc, F.lit(1e-9))
    c = _at_or_above(curve).withColumn("f1", f1)
    best = c.agg(F.max(F.struct("f1", (-F.col("score")).alias("neg"))).alias("b"))
    return best.select((-F.col("b.neg")).alias("threshold"), F.col("b.f1").alias("f1"))


def precision_at_recall(curve: DataFrame, recall: float) -> DataFrame:
    """Best precision among thresholds that reach the recall, with the lowest such threshold."""
    c = _at_or_above(curve).filter(F.col("recall") >= recall)
    b = c.agg(F.max(F.struct("precision", (-F.col("score")).alias("neg"))).alias("b"))
    return b.select(F.coalesce("b.precision", F.lit(0.0)).alias("precision"), (-F.col("b.neg")).alias("threshold"))


def recall_at_precision(curve: DataFrame, precision: float) -> DataFrame:
    c = _at_or_above(curve).filter(F.col("precision") >= precision)
    return c.agg(F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall"))


def thresholds_below(p: Column) -> Column:
    """How many grid thresholds 0.05, 0.06, ... 0.95 lie strictly below p."""
    at = lambda i: F.lit(THRESHOLD_LOW) + i * F.lit(THRESHOLD_STEP)
    g = F.floor((p - THRESHOLD_LOW) / THRESHOLD_STEP)
    near = sum(((at(g + d) < p).cast("int") for d in (-1, 0, 1)), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(COST_THRESHOLDS), g - 1 + near)).cast("int")


def best_cost_threshold(priced: DataFrame, p: str, pnl_allow: Column, pnl_block: Column) -> DataFrame:
    """Global threshold t of the rule 'block iff p > t' with the highest P&L; the lowest wins a tie.

    One pass: rows are summed per threshold bin, and the 92 bins are accumulated.
    """
    bins = priced.groupBy(thresholds_below(F.col(p)).alias("below")).agg(
        F.sum(pnl_allow).alias("a"), F.sum(pnl_block).alias("b"))
    # threshold i blocks the rows that have more than i thresholds below them; at most 92 x 91 tiny rows
    steps = bins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COST_THRESHOLDS - 1))))
    total = steps.groupBy("i").agg(F.round(F.sum(F.when(F.col("below") > F.col("i"), F.col("b")).otherwise(F.col("a"))), 4).alias("pnl"))
    best = total.agg(F.max(F.struct("pnl", (-F.col("i")).alias("neg"))).alias("m"))
    return best.select((F.lit(THRESHOLD_LOW) - F.col("m.neg") * F.lit(THRESHOLD_STEP)).alias("threshold"),
                       F.col("m.pnl").alias("pnl_total"))
