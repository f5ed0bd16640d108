"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Every whole text gives a few statistics (length, spelling, symbols, repetition, lines); each is centred and scaled by its mean and
spread over all documents. Cosines of random projections stand for a Gaussian kernel between them: their inner products near its
values as their number grows. The labelled documents of the folds that may be learned from, except one, are summed to the normal
equations of a ridge fit; the fold left out calibrates: its raw scores, counted on a grid of `GRID` steps, are made monotone by
pooling neighbours that violate the order, and scores between two pools lie on the line between their ends.

Only sums leave the tasks: of statistics, of `FEATURES` squared products in a tree (`sums`), and the counts of the grid, whose length
does not grow with the data.

Defined results: a null text is an empty one. A null or repeated doc_id is scored row by row; the checksum of a null id is that of an
empty text. A document with several labels counts by their mean, null labels and labels of unknown documents not at all. Without
labels to learn from every score is 0.5; where calibration lacks rows the raw score is cut to 0 to 1. An empty table gives an empty
table. Extra columns are not looked at.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage
from .common import table, whole
from .sums import summed

NAME = "op12_kernel_quality"
ORACLE_SQL = None  # a fitted kernel; tests look at held-out accuracy and repeat the fit in memory
#: Folds by checksum of the id: one is never learned from, one calibrates, the others fit.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD = 0.3
FEATURES = 256
SEED = 20_240_601
RIDGE = 1e-3
GRID = 4096
REACH = 4.0  # scaled statistics end so many spreads from the mean
STATISTICS = ("words", "chars", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "other_bytes", "white", "distinct", "top_word", "same_next",
              "in_windows", "lines", "line_words", "same_lines", "lines_ended", "upper_words", "odd_words", "entropy", "deflated")

_LOWER, _UPPER, _DIGITS = (np.frombuffer(c, np.uint8) for c in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
_SYMBOLS, _MARKS, _WHITE = (np.frombuffer(c, np.uint8) for c in (b"#*$%&|<>{}[]\\^~_=+@/", b".,;:!?'\"()-", b"\t\n\x0b\x0c\r "))
_ODD = re.compile(rb"[A-Za-z\x80-\xff][^A-Za-z\x80-\xff.,;:!?'\"()\s-]|[!?]{2}")
#: Deflate reads the text in chunks, so that its state stays small.
_CHUNK = 1 << 20


def _deflated(data: bytes) -> int:
    squeeze, size = zlib.compressobj(1), 0
    for i in range(0, len(data), _CHUNK):
        size += len(squeeze.compress(data[i:i + _CHUNK]))
    return size + len(squeeze.flush())


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    words, lines = data.split(), [part for line in data.split(b"\n") if (part := line.strip())]
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(data)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = size - int(by_byte[_WHITE].sum())
    lengths = np.fromiter(map(len, words), float, n)
    counts = Counter(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    shares = by_byte[by_byte > 0] / size
    return [math.log1p(n), math.log1p(size), math.log(lengths.mean()), math.log1p(lengths.std()), by_byte[_UPPER].sum() / solid, by_byte[_DIGITS].sum() / solid,
            by_byte[_MARKS].sum() / solid, by_byte[_SYMBOLS].sum() / solid, by_byte[128:].sum() / solid, (size - solid) / size,
            len(counts) / n ** 0.8, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
            1 - len(set(windows)) / len(windows) if windows else 0.0, math.log1p(len(lines)), math.log(n / len(lines)), 1 - len(set(lines)) / len(lines),
            sum(line.endswith((b".", b"!", b"?", b":")) for line in lines) / len(lines), sum(map(bytes.isupper, words)) / n,
            min(1.0, len(_ODD.findall(data)) / n), -float((shares * np.log(shares)).sum()), math.log(_deflated(data) / size)]


def _fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def with_statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fold, stats) for each row."""
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("fold int, stats array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(2)], kinds.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stats], schema=kinds)

    return docs.select(id_col, _fold(id_col).cast("int").alias("fold"), whole(text_col)).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Features:
    """Mean and spread of each statistic, random directions and phases."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -REACH, REACH)

    def of(self, stats: np.ndarray) -> np.ndarray:
        """Cosines, and a one for the constant term."""
        z = np.cos(self.scaled(stats) @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])


def features(stats: DataFrame, size: int = FEATURES, seed: int = SEED) -> Features:
    """Scaled by all documents; the kernel's width is the distance of two average documents."""
    d = len(STATISTICS)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((3, d))
        for batch in batches:
            s = _matrix(batch)
            total += np.stack([np.full(d, len(s)), s.sum(0), (s * s).sum(0)])
        return total

    total = summed(stats.select("stats"), partial)
    n, mean, square = (total[0], total[1] / np.maximum(1, total[0]), total[2] / np.maximum(1, total[0])) if total is not None else (None, np.zeros(d), np.ones(d))
    variance = square - mean * mean
    spread = np.where(variance > 1e-12, np.sqrt(np.maximum(variance, 1e-12)), 1.0)
    r = np.random.default_rng(seed)
    return Features(mean, spread, r.normal(0, 1 / math.sqrt(2 * d), (d, size)), r.uniform(0, 2 * math.pi, size))


def ridge(labelled: DataFrame, made: Features, strength: float = RIDGE) -> np.ndarray | None:
    """Weights of the features for `y`, from summed normal equations; None without rows."""
    size = len(made.phases) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = made.of(_matrix(batch))
            y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), float)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        return total

    total = summed(labelled.select("stats", "y"), partial)
    if total is None or not total[-1, -2]:
        return None
    n = total[-1, -2]
    penalty = np.full(size, strength * n)
    penalty[-1] = 0
    return np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])


def pooled(scores: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit at rising scores (rows and label sums at each): the ends of its pools and their means."""
    pools: list[list[float]] = []  # weight, sum, first score, last score
    for s, w, y in zip(scores.tolist(), weights.tolist(), sums.tolist(), strict=True):
        pools.append([w, y, s, s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, y, _, end = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += y
            pools[-1][3] = end
    return np.array([p[i] for p in pools for i in (2, 3)]), np.array([p[1] / p[0] for p in pools for _ in range(2)])


@dataclass(frozen=True)
class Quality:
    """A fitted classifier; weights are None where nothing could be learned."""

    made: Features
    weights: np.ndarray | None
    at: np.ndarray
    level: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.round((self.made.of(stats) @ self.weights) * GRID) / GRID

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.at, self.level) if len(self.at) else raw, 0.0, 1.0)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Quality:
    """From the statistics of all documents and the labels of those in the folds that may be learned from."""
    made = features(stats)
    y = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    labelled = cut_lineage(stats.filter(F.col("fold") != HELD_OUT).join(y, id_col).select("fold", "stats", "y"))
    weights = ridge(labelled.filter(F.col("fold") != CALIBRATION), made)
    if weights is None:
        return Quality(made, None, np.zeros(0), np.zeros(0))
    model = Quality(made, weights, np.zeros(0), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(np.clip(model.raw(_matrix(batch)), -1, 2) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["at", "y"])

    counts = labelled.filter(F.col("fold") == CALIBRATION).select("stats", "y").mapInArrow(run, "at long, y double")
    grid = counts.groupBy("at").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("at").collect()  # 3 * GRID rows at most
    if not grid:
        return model
    at, level = pooled(*(np.array([r[c] for r in grid], float) for c in ("at", "n", "y")))
    return Quality(made, weights, at / GRID, level)


def scored(stats: DataFrame, model: Quality, id_col: str = "doc_id") -> DataFrame:
    schema = T.StructType([stats.schema[id_col], *T.StructType.fromDDL("held_out boolean, score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            score = model.scores(_matrix(batch))
            held = np.asarray(batch.column(1)) == HELD_OUT
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=kinds)

    return stats.select(id_col, "fold", "stats").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, whether it was held out, score and verdict of each row."""
    stats = cut_lineage(with_statistics(docs, text_col, id_col))
    return scored(stats, fit(stats, labels, id_col), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
