import math
import random

import pytest

from parcelwise.config import ALLOW, PREPAID, STEP_UP, Economics
from parcelwise.functions.economics import price_orders, with_elasticity
from parcelwise.operators import conformal as C
from parcelwise.operators import decide as D
from parcelwise.operators import evaluate as V
from parcelwise.operators import metrics as M
from parcelwise.operators import training
from pyspark.sql import functions as F

COLS = "cart_gmv double, merchant_margin double, cac double, is_new_customer boolean, weight_grams double, addr_defect_score double, p double"


def grid(spark, ps=(0.02, 0.1, 0.3, 0.5, 0.8, 0.97), defect=0.2):
    rows = [(g, 0.18, c, n, w, defect, p) for g in (300.0, 1500.0, 6000.0) for c in (60.0, 420.0) for n in (True, False) for w in (400.0, 3000.0) for p in ps]
    return spark.createDataFrame(rows, COLS)


def test_tau_star_is_the_cost_ratio_and_the_indifference_point(spark):
    for r in price_orders(grid(spark)).collect():
        assert r["tau_star"] == pytest.approx(r["cost_fp"] / (r["cost_fn"] + r["cost_fp"]))
    at = price_orders(price_orders(grid(spark, (0.5,))).select(*[c.split()[0] for c in COLS.split(", ") if not c.startswith("p ")], F.col("tau_soft").alias("p")))
    for r in at.collect():
        if r["p"] < 1:
            assert r["cost_allow"] == pytest.approx(r["cost_stepup"])


def test_allow_iff_below_tau_soft_when_prepaid_is_dearer(spark):
    df = D.resolve(price_orders(grid(spark)).withColumns({"in0": F.lit(True), "in1": F.lit(True)}))
    for r in df.collect():
        if r["action"] != PREPAID:
            assert (r["action"] == ALLOW) == (r["p"] <= r["tau_soft"] + 1e-9)


def test_gating_and_price_monotonicity(spark):
    base = price_orders(grid(spark))
    order = {ALLOW: 0, STEP_UP: 1, PREPAID: 2}
    acts = {}
    for lam in (0.0, 20.0, 200.0, 5000.0):
        rows = D.resolve(base.withColumns({"in0": F.lit(True), "in1": F.lit(True)}), F.lit(lam)).collect()
        acts[lam] = [order[r["action"]] > 0 for r in rows]
    for a, b in zip((0.0, 20.0, 200.0), (20.0, 200.0, 5000.0)):
        assert all(y <= x for x, y in zip(acts[a], acts[b]))
    low = D.resolve(base.withColumns({"in0": F.lit(True), "in1": F.lit(False)}))
    high = D.resolve(base.withColumns({"in0": F.lit(False), "in1": F.lit(True)}), F.lit(5000.0))
    novel = D.resolve(base.withColumns({"in0": F.lit(False), "in1": F.lit(False)}))
    assert {r["action"] for r in low.collect()} == {ALLOW}
    assert ALLOW not in {r["action"] for r in high.collect()} | {r["action"] for r in novel.collect()}
    assert {r["certainty"] for r in novel.collect()} == {"NOVEL"}


def test_alpha_crit_is_where_the_step_up_stops_winning(spark):
    for r in with_elasticity(price_orders(grid(spark))).collect():
        if r["alpha_crit"] is None or not 0 < r["alpha_crit"] < 1:
            continue
        cost = r["intercept"] + r["slope"] * r["alpha_crit"]
        assert cost == pytest.approx(min(r["cost_allow"], r["cost_prepaid"]))


def test_rationale_is_complete(spark):
    sets = [(True, False), (False, True), (True, True), (False, False)]
    df = price_orders(grid(spark, defect=0.9))
    for a, b in sets:
        rows = D.with_rationale(D.resolve(df.withColumns({"in0": F.lit(a), "in1": F.lit(b)}))).collect()
        assert all(r["rationale"] and r["action_label"] for r in rows)
        assert all(("deliverability" in r["rationale"]) for r in rows if r["action"] == PREPAID)


def test_propensity_and_weights(spark):
    df = spark.createDataFrame([(ALLOW, ALLOW), (STEP_UP, ALLOW), (STEP_UP, STEP_UP)], "a string, s string")
    prop = D.propensity(F.col("a"), F.col("s"), F.lit(0.02))
    rows = df.select(prop.alias("p"), D.ipw_weight(F.col("s"), prop, 100.0).alias("w"), D.ipw_weight(F.col("s"), prop, 20.0).alias("c")).collect()
    assert [r["p"] for r in rows] == [1.0, 0.02, 0.98] and [r["w"] for r in rows] == [1.0, 50.0, 0.0] and rows[1]["c"] == 20.0


def sample(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tier = 1 + i % 4
        p = round(min(0.999, max(0.001, rng.betavariate(1.2 + 0.3 * tier, 3.5))), 6)
        rows.append((i, p, rng.random() < p, tier))
    return spark.createDataFrame(rows, "i int, p double, rto boolean, pin_tier int"), rows


def test_conformal_quantiles_and_coverage(spark):
    df, rows = sample(spark)
    cal, new = df.filter("i div 4 % 2 = 0"), df.filter("i div 4 % 2 = 1")
    q = C.calibrate(cal, (0.05, 0.10, 0.20))
    table = {(r["variant"], r["grp"], r["alpha"]): r for r in q.collect()}
    for (variant, grp, alpha), r in table.items():
        for y, name in ((False, "q0"), (True, "q1")):
            s = sorted((1 - p if t else 1 - (1 - p)) for i, p, t, g in rows if i // 4 % 2 == 0 and (variant == "marginal" or t == y) and (variant != "class_x_tier" or g == grp))
            k = min(len(s), max(1, math.ceil((len(s) + 1) * (1 - alpha))))
            assert r[name] == s[k - 1]
    m = {(r["variant"], r["alpha"]): r for r in C.set_metrics(C.apply_sets(new, q), ["variant", "alpha"]).collect()}
    for (variant, alpha), r in m.items():
        assert r["n0"] + r["n1"] == 2000
        if variant != "marginal":
            assert r["coverage_class0"] >= 1 - alpha - 0.04 and r["coverage_class1"] >= 1 - alpha - 0.05
    assert m[("marginal", 0.10)]["coverage_class1"] < 0.85
    sets = lambda a: {r["i"]: (r["in0"], r["in1"]) for r in C.apply_sets(new, q.filter(f"variant = 'class' and alpha = {a}D")).collect()}
    wide, narrow = sets(0.05), sets(0.20)
    assert all(wide[i][0] >= narrow[i][0] and wide[i][1] >= narrow[i][1] for i in wide)


def test_unseen_tier_falls_back_to_class_quantiles(spark):
    df, _ = sample(spark, 800)
    q = {(r["variant"], r["grp"]): r for r in C.calibrate(df.filter("pin_tier < 4"), (0.10,)).collect()}
    assert (q[("class_x_tier", 4)]["q0"], q[("class_x_tier", 4)]["q1"]) == (q[("class", 0)]["q0"], q[("class", 0)]["q1"])


def test_ranking_metrics_equal_pair_counting(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(120)]
    m = M.ranking_metrics(M.score_curve(spark.createDataFrame(rows, "p double, y boolean"), "p", "y")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert m["auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    ap, prev = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for p, _ in rows)
        ap, prev = ap + (tp / len(pos) - prev) * tp / n, tp / len(pos)
    assert m["pr_auc"] == pytest.approx(ap)


@pytest.mark.parametrize("buckets,few", [(4096, 4096), (4, 10), (2, 0)])
def test_ranks_are_found_without_a_sort(spark, monkeypatch, buckets, few):
    """Ties in time, negative and far keys; the same keys as after a sort."""
    import random
    from parcelwise.operators import metrics
    monkeypatch.setattr(metrics, "RANK_BUCKETS", buckets)
    monkeypatch.setattr(metrics, "RANK_ROWS", few)
    r = random.Random(6)
    rows = [(r.choice([-5, 0, 7, 7, 7, 10 ** 12]), r.randrange(-20, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long")
    want = sorted(rows)
    ranks = [0, 1, 29, 30, 59, 60, 99]
    assert metrics.at_ranks(df, [F.col("a"), F.col("b")], lambda n: ranks) == [want[k] if k < 60 else None for k in ranks]
    assert metrics.at_ranks(df.limit(0), [F.col("a")], lambda n: [0]) == [None]


def test_split_by_edges_equals_split_by_position(spark):
    from datetime import datetime, timedelta
    from parcelwise.operators import metrics
    for n in (1, 2, 5, 37):
        rows = [(datetime(2024, 1, 1) + timedelta(days=i * 7 % 4), i) for i in range(n)]
        out = metrics.chronological_split(spark.createDataFrame(rows, "ts timestamp, seq long"), position=True).collect()
        ends = [round(0.6 * n) + k * round(0.1 * n) for k in range(4)]
        for x in out:
            assert x["split"] == ["train", "valid", "calib", "conf", "test"][sum(x["position"] >= e for e in ends)]


def test_isotonic_is_monotone_and_interpolates(spark):
    df, _ = sample(spark, 1000)
    model = training.fit_isotonic(df, "p")
    xs, ys = training.knots(model)
    assert ys == sorted(ys) and min(ys) >= 0.001 and max(ys) <= 0.999
    probe = spark.createDataFrame([(0.0,), (xs[0],), ((xs[0] + xs[1]) / 2,), (1.0,)], "p double")
    got = [r["v"] for r in probe.select(training.apply_knots(F.col("p"), xs, ys).alias("v")).collect()]
    assert got[0] == ys[0] == got[1] and got[2] == pytest.approx((ys[0] + ys[1]) / 2) and got[3] == ys[-1]


def test_breakeven_interpolates_the_first_sign_change(spark):
    rows = [(0.06, 0.65, 10.0), (0.11, 0.65, 4.0), (0.18, 0.65, -3.0), (0.25, 0.65, -9.0), (0.35, 0.65, -20.0), (0.06, 0.4, -1.0)]
    df = spark.createDataFrame(rows, "stepup_good_abandon double, stepup_bad_abandon double, gap double")
    assert V.breakeven(df).first()[0] == pytest.approx(0.11 + 0.07 * 4 / 7)
    assert V.breakeven(df.withColumn("gap", F.lit(1.0))).first()[0] == 1.0
    assert V.breakeven(df.withColumn("gap", F.lit(-1.0))).first()[0] is None


def test_oracle_policy_is_never_beaten(spark):
    df = price_orders(grid(spark)).withColumns({"rto": F.rand(3) < F.col("p"), "p_base": F.col("p"), "in0": F.lit(True), "in1": F.lit(True)})
    df = spark.createDataFrame(df.collect(), df.schema)
    choices = spark.createDataFrame([(0.4, 0.5, 40.0)], "t_f1 double, t_cost double, budget_price double")
    got = {r["policy"]: r for r in V.with_deltas(V.simulate(V.policy_actions(df, choices), ["policy"])).collect()}
    assert len(got) == 9 and got[V.ALLOW_ALL]["delta_vs_allow_all"] == 0
    best = max(got.values(), key=lambda r: r["pnl_bad"])
    assert got[V.ORACLE]["pnl_good"] == max(r["pnl_good"] for r in got.values()) and best["pnl_bad"] == got[V.ORACLE]["pnl_bad"]
    assert Economics().default_margin == 0.18
