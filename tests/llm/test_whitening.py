"""Whitening against one eigendecomposition of the whole table and exact integers."""
import math
from fractions import Fraction

import numpy as np
import pytest

from parcelwise.llm import op13_whitening as op
from parcelwise.llm.sums import summed

SCHEMA = "vec_id long, embedding array<float>, component int, n string, whitened string"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "a", "b") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(df):
    """id, integers of remaining rows, straight from the rows."""
    kept = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()
            if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    width = max((len(v) for _, v in kept), default=0)
    return [(i, [math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (width - len(v))) for i, v in kept]


def check(df, out, real=None):
    rows, kept = out.collect(), plain(df)
    n = len(kept)
    sums = [sum(c) for c in zip(*(v for _, v in kept), strict=True)]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for _, v in kept])
    _, sizes, axes = np.linalg.svd(c, full_matrices=False)
    e, axes = sizes ** 2 / n, axes.T
    k = min(8, c.shape[1]) if real is None else real
    assert len(rows) == n * k
    exact = {}
    for i, v in kept:
        exact.setdefault(i, set()).add(str(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))))
    for r in rows:
        assert r["n"] == n and r["identity_error"] < 1e-4
        assert r["deviation_text"] in exact[r["vec_id"]]
        assert r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 1 << 63 else None)
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-6)
    for j in range(k):
        want = sorted((i, w) for (i, _), w in zip(kept, c @ axes[:, j] / math.sqrt(e[j]), strict=True))
        got = sorted((r["vec_id"], r["whitened"]) for r in rows if r["component"] == j + 1)
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(want, got, strict=True)))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([sign * g[1] for g in got], [w[1] for w in want], rtol=1e-6, atol=1e-6)
    return rows


def vectors(seed, n, d):
    r = np.random.default_rng(seed)
    return r.normal(0, 0.2, (n, d)) * np.linspace(3, 0.3, d) + r.normal(0, 5, d)


def test_equals_whole_decomposition(spark):
    df = frame(spark, enumerate(vectors(1, 300, 12).tolist()))
    check(df, op.whiten(df))


def test_awkward_rows(spark):
    v = vectors(2, 60, 10).tolist()
    odd = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9), (904, []), (905, [1.0, 2.0]), (None, v[3]), (5, v[5]),
           (906, [0.0] * 40 + [None])]
    df = frame(spark, list(enumerate(v)) + odd, 5)
    out = op.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"]
    rows = [r for r in out.collect()]
    assert {r["n"] for r in rows} == {64} and {r["component"] for r in rows} == set(range(1, 9))
    check(df.filter("vec_id IS NOT NULL"), op.whiten(df.filter("vec_id IS NOT NULL")))


def test_rank_is_lacking(spark):
    base = vectors(3, 80, 3)
    wide = np.hstack([np.floor(base * 1024) / 1024, np.ones((80, 4)), np.floor(base[:, :1] * 1024) / 512])  # three dimensions in eight
    df = frame(spark, enumerate(wide.tolist()))
    check(df, op.whiten(df), 3)
    few = frame(spark, enumerate(vectors(4, 4, 30).tolist()))  # fewer rows than dimensions
    check(few, op.whiten(few), 3)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 7, [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert op.whiten(frame(spark, rows)).count() == 0


def test_small_component_behind_large_ones(spark):
    """A spread of 1e5 in one direction, of a few units in another: the small one keeps its digits."""
    r = np.random.default_rng(5)
    v = np.stack([r.normal(0, 30_000, 400), r.normal(0, 0.01, 400)], 1)
    df = frame(spark, enumerate(np.stack([v[:, 0], v[:, 0] / 2 + v[:, 1]], 1).tolist()))
    check(df, op.whiten(df))


def test_whole_numbers_beyond_a_long(spark):
    df = frame(spark, [(i, [1e9 * (i % 7), -1e12 * (i % 3), 1e30 * (i == 4)]) for i in range(50)])
    model = op.fit(df)
    assert max(map(abs, model.sums)) > 1 << 52
    rows = op.whiten(df).collect()
    assert any(r["deviation"] is None for r in rows)
    x = np.array([[100_000, 3, 1 << 40], [5, 6, 7]], np.int64)
    m = op.Whitening(3, (300_000, 9, 3 << 20), np.eye(3), np.ones(3), np.ones(3))
    assert m.squares(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, m.sums, strict=True)) for row in x.tolist()]


def test_same_under_other_partitions(spark):
    v = list(enumerate(vectors(6, 200, 9).tolist()))
    a, b = ({(r["vec_id"], r["component"]): r["whitened"] for r in op.whiten(frame(spark, v, p)).collect()} for p in (1, 7))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_sums_of_arrays(spark):
    def partial(batches):
        n = sum(b.num_rows for b in batches)
        return np.full((2, 1 + n % 3), n, np.int64)

    total = summed(spark.range(0, 1000, 1, 9), partial)
    assert total[:, 0].tolist() == [1000, 1000]
    assert summed(spark.range(5), lambda batches: None) is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{sf}/embeddings.parquet"), op.query(spark, sf))
