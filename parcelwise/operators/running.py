"""Running aggregates that survive hot keys.

A window with an unbounded frame puts a whole key into one task. A key with too many rows is therefore cut
into blocks that follow the order; each block is aggregated on its own, the block totals (one small row per
block) are accumulated, and the two parts are added. Only sums, minima and maxima are allowed: they combine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HOT_KEY_ROWS
from ..session import cut_lineage

Aggs = dict[str, tuple[str, Column]]
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def _frame(through_current: bool) -> tuple[int, int]:
    return Window.unboundedPreceding, 0 if through_current else -1


def running(df: DataFrame, keys: list[str], order: list[str], aggs: Aggs, *, block: Column,
            through_current: bool = False) -> DataFrame:
    """Add running aggregates over (keys, order).

    `aggs` maps an output column to ('sum' | 'min' | 'max', expression). `block` must never decrease along
    `order`. With `through_current=False` a row does not see itself. Sums start at 0, the others at NULL.
    """
    values = {f"_v{i}": expr for i, (_, expr) in enumerate(aggs.values())}
    kinds = [kind for kind, _ in aggs.values()]
    base = df.withColumns({"_block": block, **values})
    totals = base.groupBy(*keys, "_block").agg(*[_AGG[k](f"_v{i}").alias(f"_t{i}") for i, k in enumerate(kinds)])
    # one row per block: small even for the hottest key
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*_frame(False))
    offsets = totals.select(*keys, "_block", *[_AGG[k](f"_t{i}").over(before).alias(f"_o{i}") for i, k in enumerate(kinds)])
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(*_frame(through_current))
    local = base.withColumns({f"_l{i}": _AGG[k](f"_v{i}").over(w) for i, k in enumerate(kinds)})
    out = local.join(offsets, [*keys, "_block"], "left")
    out = out.withColumns({name: _combine(kinds[i], F.col(f"_l{i}"), F.col(f"_o{i}")) for i, name in enumerate(aggs)})
    return out.drop("_block", *values, *[f"_{x}{i}" for i in range(len(aggs)) for x in "lo"])


def running_in_ranges(df: DataFrame, keys: list[str], order: list[str], aggs: Aggs, *, through_current: bool = False,
                      then: Aggs | None = None) -> DataFrame:
    """As `running`, with blocks cut by a range partitioning over (keys, order).

    However the rows of a key are spread over time, the sampled ranges are of similar size. They are written
    before use, because a recomputed sample could cut elsewhere.
    """
    placed = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    for made in (aggs, then or {}):
        placed = running(placed, keys, order, made, block=F.col("_range"), through_current=through_current) if made else placed
    return placed.drop("_range")


def hot_keys(sizes: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame | None:
    """Keys of sizes(keys..., count) with more than `hot_rows` rows; None if there are none.

    At most rows / hot_rows keys pass.
    """
    hot = cut_lineage(sizes.filter(F.col("count") > hot_rows).drop("count"))
    return None if hot.isEmpty() else hot


def running_by_key(df: DataFrame, keys: list[str], order: list[str], aggs: Aggs, *, hot: DataFrame | None,
                   through_current: bool = False, then: Aggs | None = None) -> DataFrame:
    """Running aggregates per key: a plain window for ordinary keys, ranges for the keys in `hot`.

    `then` lists aggregates over the results of the first ones, in the same order.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_frame(through_current))

    def start(kind: str, c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) if kind == "sum" else c

    def plain(rows: DataFrame) -> DataFrame:
        for made in (aggs, then or {}):
            rows = rows.withColumns({name: start(kind, _AGG[kind](expr).over(w)) for name, (kind, expr) in made.items()})
        return rows

    if hot is None:
        return plain(df)
    # short, see `hot_keys`; without the hint its estimate is that of all keys, and a hot key's rows would meet in one sorting task
    hot = F.broadcast(hot)
    split = running_in_ranges(df.join(hot, keys, "left_semi"), keys, order, aggs, through_current=through_current, then=then)
    return plain(df.join(hot, keys, "left_anti")).unionByName(split)


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Global 0-based row number in `order` without a one-task sort."""
    placed = running_in_ranges(df, [], order, {name: ("sum", F.lit(1))})
    return placed.withColumn(name, F.col(name).cast("bigint"))
