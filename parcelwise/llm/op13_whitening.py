"""Whitening of embeddings by shifted CholeskyQR.

One pass sums the rows exactly. Then Gram passes: each centres its rows, solves them through the triangular factors found so far and
sums their Gram matrix; its Cholesky factor, shifted in the first pass and wherever rows lack full rank, is the next factor, until the
rows are orthonormal. The composed factor R has the singular values and right vectors of all centred rows, so its decomposition
gives the components; no covariance is formed whose rounding would hide small components behind large ones. A last pass measures
the covariance of the whitened rows.

Only sums of d x d numbers leave the tasks (`sums`), in a tree; R and at most `COMPONENTS` vectors go back with the code.

Defined results: rows whose vector is null or has a null or non-finite entry are dropped. The dimension is the greatest length of the
others; what shorter ones lack counts as zero. Integers of an entry end at `LIMIT` either way. Components whose standard deviation is
below `SMALLEST` of the greatest one cannot be told from rounding and are left out, so rows that are all equal, one row or an empty
table give an empty result. Repeated rows count each time, a null id stays. Where the exact deviation does not fit a long, `deviation`
is null; `deviation_text` always has it. Other columns are not looked at. The sign of a component makes its largest entry positive.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table
from .sums import summed

NAME = "op13_whitening"
ORACLE_SQL = None  # an eigendecomposition; tests compare with one of the whole table and with exact integers
COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LIMIT = 1 << 52
SMALLEST = 1e-11
#: Gram passes at most, and how far the Gram matrix may be from a projection when they end.
PASSES, ORTHONORMAL = 6, 1e-11
SPLIT = 20


def integers(batch: pa.RecordBatch, column: str, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their integers (rows x dimension, or the greatest length in the batch)."""
    vectors = batch.column(column)
    values = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # nulls are NaN
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - sizes])
    width = int(sizes[keep].max(initial=0)) if dimension is None else dimension
    found = np.full((int(keep.sum()), width), OFFSET, np.int64)
    if len(found) and width:
        inside = np.arange(width) < sizes[keep][:, None]
        whole = np.floor(np.clip(SCALE * values[np.repeat(keep, sizes)], -LIMIT, LIMIT)).astype(np.int64)
        found[inside] = whole + OFFSET
    return keep, found


@dataclass(frozen=True)
class Whitening:
    """Rows fitted, sums of their integers, components (one a row), standard deviation and share of each."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: int64, or Python integers where these could overflow."""
        if self.n * (abs(x).max(initial=0).item()) + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(float) / max(1, self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / self.deviations

    def squares(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums) squared, as whole numbers."""
        d = self.offsets(x)
        if d.dtype == object or d.shape[1] * max(abs(d).max(initial=0).item() >> SPLIT, 1 << SPLIT) ** 2 >= 1 << 62:
            return [sum(v * v for v in row) for row in d.astype(object).tolist()]
        high, low = d >> SPLIT, d & ((1 << SPLIT) - 1)
        return [(a << 2 * SPLIT) + (b << SPLIT + 1) + c for a, b, c in zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist(),
                                                                          strict=True)]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular r, column by column."""
    q = np.empty_like(rows)
    for j in range(len(r)):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor, shifted in the first pass or where it must be."""
    d, size = len(gram), np.linalg.norm(gram, 2)
    unit = np.finfo(float).eps / 2
    shift = 11 * (n * d + d * (d + 1)) * unit * size if first else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 11 * d * (d + 1) * unit * size)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    rows = df.select(vector)

    def totals(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((4, 1), np.int64)  # rows; entries, high and low parts of integers by dimension
        for batch in batches:
            keep, x = integers(batch, vector)
            if x.shape[1] > total.shape[1]:
                total = np.pad(total, ((0, 0), (0, x.shape[1] - total.shape[1])))
            w = x.shape[1]
            total[0, 0] += len(x)
            total[1, :w] += len(x)
            total[2, :w] += (x >> SPLIT).sum(0)
            total[3, :w] += (x & ((1 << SPLIT) - 1)).sum(0)
        return total

    total = summed(rows, totals)
    n = 0 if total is None else int(total[0, 0])
    here = total[:, total[1] > 0] if n else np.zeros((4, 0), np.int64)
    sums = tuple((int(h) << SPLIT) + int(low) + (n - int(m)) * OFFSET for m, h, low in here[1:].T)
    d, base = len(sums), Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    nothing = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    if not d:
        return nothing

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            g = np.zeros((d, d))
            for batch in batches:
                q = base.centred(integers(batch, vector, d)[1])
                for r in factors:
                    q = solved(q, r)
                g += q.T @ q
            return g

        return summed(rows, partial)

    factors, composed = [], np.eye(d)
    while len(factors) < PASSES:
        g = gram(factors)
        if not np.trace(g):
            return nothing
        factors.append(factor(g, n, not factors))
        composed = factors[-1] @ composed
        if abs(g @ g - g).max() < ORTHONORMAL:
            break
    _, sizes, axes = np.linalg.svd(composed)
    axes = axes * np.sign(axes[np.arange(d), abs(axes).argmax(1)])[:, None]
    real = [k for k in range(min(d, components)) if sizes[k] > SMALLEST * sizes[0]]
    return Whitening(n, sums, axes[real], sizes[real] / np.sqrt(n), sizes[real] ** 2 / (sizes ** 2).sum())


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured."""
    k, d = len(model.components), len(model.sums)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        g = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(integers(batch, vector, d)[1])
            g[:k] += w.T @ w
            g[k] += w.sum(0)
        return g

    g = summed(df.select(vector), partial) / model.n
    return float(abs(g[:k] - np.outer(g[k], g[k]) - np.eye(k)).max())


ADDED = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def whiten(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component, fitted on all remaining rows."""
    model = fit(df, vector, components)
    error, k, d = identity_error(df, model, vector), len(model.components), len(model.sums)
    schema = T.StructType([df.schema[id_col]] + T.StructType.fromDDL(ADDED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            keep, x = integers(batch, vector, d)
            if not len(x) or not k:
                continue
            at = np.repeat(np.arange(len(x)), k)
            squares = model.squares(x)
            text = pa.array([str(s) for s in squares])
            squares = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            columns = [batch.column(id_col).filter(pa.array(keep)).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                       pa.array(np.full(len(at), model.n)), squares.take(pa.array(at)), pa.array(model.whitened(x).ravel()),
                       pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), error)), text.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return df.select(id_col, vector).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
