"""Sums of arrays over all rows of a table: one array a task, added up in a tree and always in the order of the tasks."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the arrays of all others; the driver adds up theirs.
WIDTH = 16


def added(arrays: Iterator[np.ndarray]) -> np.ndarray | None:
    """The sum of arrays of as many rows; missing columns at the right are zeros. None of none."""
    total = None
    for a in arrays:
        if total is None:
            total = a.copy()
            continue
        if a.shape[1] > total.shape[1]:
            total, a = a.copy(), total
        total[:, :a.shape[1]] += a
    return total


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of partial's arrays (two-dimensional, as many rows and the same type everywhere), None if it has none."""
    schema = "part long, kind string, height long, array binary"

    def row(part: int, a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": [part], "kind": [a.dtype.str], "height": [len(a)], "array": [a.tobytes()]})

    def read(kind: str, height: int, array: bytes) -> np.ndarray:
        return np.frombuffer(array, kind).reshape(height, -1)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = partial(batches)
        if a is not None:
            yield row(TaskContext.get().partitionId(), a)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = []

        def arrays() -> Iterator[np.ndarray]:
            for b in batches:
                for r in b.to_pylist():
                    first.append(r["part"])
                    yield read(r["kind"], r["height"], r["array"])

        a = added(arrays())
        if a is not None:
            yield row(first[0], a)

    tasks = df.mapInArrow(of_task, schema)
    few = tasks.repartition(WIDTH, F.col("part") % WIDTH).sortWithinPartitions("part").mapInArrow(of_tasks, schema)
    rows = sorted(few.collect(), key=lambda r: r["part"])
    return added(read(r["kind"], r["height"], bytes(r["array"])) for r in rows)
