"""The quality classifier: statistics by hand, the fit repeated in memory, held-out accuracy, awkward tables."""
import math
import zlib

import numpy as np
import pytest

from parcelwise.llm import op12_kernel_quality as op

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, fold string, stats string, score double"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, stats string")


def test_statistics_of_a_text():
    s = dict(zip(op.STATISTICS, op.statistics("One two, two two\n\nONE 22## é!\nOne two, two two"), strict=True))
    assert s["words"] == pytest.approx(math.log1p(11)) and s["lines"] == pytest.approx(math.log1p(3))
    assert s["same_lines"] == pytest.approx(1 / 3) and s["top_word"] == pytest.approx(4 / 11) and s["same_next"] == pytest.approx(2 / 11)
    assert s["upper_words"] == pytest.approx(1 / 11) and s["symbols"] == pytest.approx(2 / 36) and s["other_bytes"] == pytest.approx(2 / 36)
    assert s["in_windows"] == pytest.approx(2 / 9) and s["lines_ended"] == pytest.approx(1 / 3)
    for text in ("", " \n\t", "\n\n", "x", "é" * 3, "a\ud800b", "long words " * 200_000):
        assert np.isfinite(op.statistics(text)).all()


def test_pooled_is_the_isotonic_fit():
    """Against the max-min formula."""
    r = np.random.default_rng(1)
    for _ in range(50):
        k = r.integers(1, 25)
        at, w = np.sort(r.choice(100, k, False)).astype(float), r.integers(1, 6, k).astype(float)
        y = w * r.uniform(0, 1, k).round(1)
        want = [max(min(y[a:b + 1].sum() / w[a:b + 1].sum() for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
        assert np.allclose(np.interp(at, *op.pooled(at, w, y)), want)


def test_kernel():
    d = len(op.STATISTICS)
    r = np.random.default_rng(2)
    made = op.Features(np.zeros(d), np.ones(d), r.normal(0, 1 / math.sqrt(2 * d), (d, 20_000)), r.uniform(0, 2 * math.pi, 20_000))
    x = r.normal(0, 1, (6, d))
    z = made.of(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (4 * d))
    assert np.allclose(z @ z.T, want, atol=0.03)


def test_fit_repeated_in_memory(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r for r in op.classify(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    stats = {i: op.statistics(t) for i, t in texts.items()}
    whole = np.array(list(stats.values()))
    r = np.random.default_rng(op.SEED)
    d = whole.shape[1]
    spread = whole.std(0)
    spread[spread < 1e-6] = 1
    w, phases = r.normal(0, 1 / math.sqrt(2 * d), (d, op.FEATURES)), r.uniform(0, 2 * math.pi, op.FEATURES)

    def z(ids):
        x = np.clip((np.array([stats[i] for i in ids]) - whole.mean(0)) / spread, -4, 4)
        return np.hstack([np.cos(x @ w + phases) * math.sqrt(2 / op.FEATURES), np.ones((len(ids), 1))])

    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts}
    learn, tune = [i for i in y if fold[i] > 1], [i for i in y if fold[i] == 1]
    a = z(learn)
    beta = np.linalg.solve(a.T @ a + len(learn) * op.RIDGE * np.diag([1] * op.FEATURES + [0]), a.T @ np.array([y[i] for i in learn]))
    raw = dict(zip(texts, np.round(z(list(texts)) @ beta * op.GRID) / op.GRID, strict=True))
    steps = sorted({raw[i] for i in tune})
    at, level = op.pooled(np.array(steps), np.array([sum(raw[i] == s for i in tune) for s in steps], float), np.array([sum(y[i] for i in tune if raw[i] == s) for s in steps], float))
    want = {i: min(1.0, max(0.0, np.interp(raw[i], at, level))) for i in texts}
    assert all(out[i]["held_out"] == (fold[i] == 0) for i in texts)
    assert sum(abs(out[i]["score"] - want[i]) > 1e-6 for i in texts) <= len(texts) // 100  # a score on the edge of a step may fall to either side
    assert all(out[i]["predicted"] == (out[i]["score"] >= 0.3) for i in texts)
    held = [i for i in y if fold[i] == 0]
    assert sum(out[i]["predicted"] == y[i] for i in held) >= 0.97 * len(held)


def test_awkward_tables(spark, docs):
    r = [(i, i % 2, 0, "s") for i in range(0, 13)] + [(3, None, 0, "s"), (4, 1, 0, "s"), (None, 1, 0, "s"), (999, 1, 0, "s")]
    out = op.classify(docs, labels_of(spark, r)).collect()
    assert sorted(map(repr, [x["doc_id"] for x in out])) == sorted(map(repr, [x["doc_id"] for x in docs.collect()]))
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in out)
    same = {}
    for x in out:
        same.setdefault(x["doc_id"], set()).add(x["score"])
    assert len(same[14]) == 1 and same[3] == same[4] == same[9]  # repeated rows; texts without words


@pytest.mark.parametrize("rows", [[], [(1, None, 0, "s")], [(i, 1, 0, "s") for i in range(15)]])
def test_labels_lacking(spark, docs, rows):
    scores = {x["score"] for x in op.classify(docs, labels_of(spark, rows)).collect()}
    assert all(0 <= s <= 1 for s in scores) and (scores == {0.5} if len(rows) < 2 else min(scores) > 0.9)


def test_held_out_labels_change_nothing(spark, docs):
    rows = [(i, i % 2, 0, "s") for i in range(15)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, s) for i, q, t, s in rows]
    a, b = (sorted((repr(x["doc_id"]), x["score"]) for x in op.classify(docs, labels_of(spark, r)).collect()) for r in (rows, flipped))
    assert a == b


def test_query(spark, folder):
    assert op.query(spark, str(folder / "none")).count() == 0
    assert op.query(spark, str(folder / "full")).columns == ["doc_id", "held_out", "score", "predicted"]
