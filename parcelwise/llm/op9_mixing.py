"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a pattern offers its words once for
free, a second time at a cost, a third time at a higher one, and so on (convex costs), to the quotas of its sources. The
cheapest flow that fills the quotas says how many words of each pattern to take, and seeded documents are selected
accordingly: all of them as often as whole passes fit, then a seeded selection once more.

Only sums by pattern and by source reach the driver; their number is checked against `MAX_PATTERNS`.

Nulls: a null text has size 0, a null source is a source of its own, last in order; a null doc_id is an id like others.
Rows that repeat id, source and size are taken alike. An empty table gives an empty table. Extra columns stay, but for
columns named like those added.
"""
from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import n_words, table, whole

NAME = "op9_flow_mixing"
WEIGHTS = (5, 2, 1)
BUDGET = Fraction(3, 2)
MAX_COPIES = 2
SEED = 17
#: Patterns and sources are held by the driver: at most so many, a few hundred bytes each.
MAX_PATTERNS = 200_000
#: The seeded order of a pattern has 2 to this power of buckets; the rows of one bucket are ordered by one task.
BUCKET_BITS = 16
#: Cuts in the seeded order: each later one fills, with rows that are small enough, what the one before left.
PASSES = 4
ORACLE_SQL = None  # selection follows from a flow; tests compare with a brute-force mix


def quotas(sizes: dict, weights: dict, budget: Fraction, max_copies: int = MAX_COPIES) -> dict:
    """Words to take from each source: `budget` by weight, none above max_copies times its size, the excess reshared by weight."""
    quota, open_, left = {}, {s for s in sizes if sizes[s] > 0}, Fraction(budget)
    quota |= {s: Fraction(0) for s in sizes if sizes[s] <= 0}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > max_copies * sizes[s]}
        if not over:
            return quota | {s: left * weights[s] / total for s in open_}
        for s in over:
            quota[s] = Fraction(max_copies * sizes[s])
            left -= quota[s]
        open_ -= over
    return quota


def _apart(patterns: list[tuple[tuple, int]]) -> list[list[int]]:
    """Numbers of patterns whose sources hang together, group by group."""
    above: dict = {}

    def top(s):
        while above[s] != s:
            above[s] = above[above[s]]
            s = above[s]
        return s

    for members, _ in patterns:
        for s in members:
            above.setdefault(s, s)
            above[top(s)] = top(members[0])
    groups: dict = {}
    for i, (members, _) in enumerate(patterns):
        groups.setdefault(top(members[0]) if members else (i,), []).append(i)
    return list(groups.values())


def flow(patterns: list[tuple[tuple, int]], quota: dict, max_copies: int = MAX_COPIES) -> list[int]:
    """Words to take from each pattern (members, words), filling integer quotas at the least repetition cost.

    Sources that no pattern ties together do not touch each other's flow, so each group has a flow of its own.
    """
    taken = [0] * len(patterns)
    for group in _apart(patterns):
        some = [patterns[i] for i in group]
        sources = dict.fromkeys(s for members, _ in some for s in members)
        for i, words in zip(group, _flow(some, {s: int(quota.get(s, 0)) for s in sources}, max_copies), strict=True):
            taken[i] = words
    return taken


def _flow(patterns: list[tuple[tuple, int]], need: dict, max_copies: int) -> list[int]:
    """Successive shortest paths with potentials; the n-th copy of a word costs n squared."""
    # residual graph: start -> pattern (max_copies arcs of rising cost) -> source -> end
    arcs: list[list[int]] = []  # to, capacity, cost
    out: dict[object, list[int]] = {}

    def arc(a, b, capacity: int, cost: int) -> int:
        out.setdefault(a, []).append(len(arcs))
        arcs.append([b, capacity, cost])
        out.setdefault(b, []).append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    entry = [[arc("start", ("p", i), words, copy * copy) for copy in range(max_copies)] for i, (_, words) in enumerate(patterns)]
    for i, (members, words) in enumerate(patterns):
        for s in members:
            arc(("p", i), ("s", s), max_copies * words, 0)
    for s, q in need.items():
        arc(("s", s), "end", q, 0)
    potential: dict[object, int] = dict.fromkeys(out, 0)
    while True:
        dist, via, queue, tick = {"start": 0}, {}, [(0, 0, "start")], 0
        while queue:
            d, _, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k in out.get(a, ()):
                b, capacity, cost = arcs[k]
                if capacity > 0 and (new := d + cost + potential[a] - potential[b]) < dist.get(b, 1 << 62):
                    dist[b], via[b] = new, k
                    tick += 1
                    heapq.heappush(queue, (new, tick, b))
        if "end" not in dist:
            return [sum(arcs[k + 1][1] for k in ks) for ks in entry]
        for a in potential:
            potential[a] += dist.get(a, dist["end"])
        path, at = [], "end"
        while at != "start":
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push


def plan(sizes: dict, patterns: list[tuple[tuple, int]], weights: dict, *, budget: Fraction = BUDGET, max_copies: int = MAX_COPIES):
    quota = quotas(sizes, weights, budget * sum(words for _, words in patterns), max_copies)
    return quota, flow(patterns, quota, max_copies)


def rank_weights(sources: list, weights: tuple = WEIGHTS) -> dict:
    """Weights repeat along the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def _members(members: Column) -> Column:
    """Sorted by code point, null last."""
    return F.array_sort(members, lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
                        .when(a < b, -1).when(a > b, 1).otherwise(0))


def _upto(units: DataFrame, state: DataFrame) -> DataFrame:
    """(_m, cut, sum): how far along the seeded order the units behind `after` that are no larger than `gap` fit into `gap`.

    The order goes by bucket: sums of buckets first, then the units of the one bucket in which the words run out.
    """
    open_ = units.join(F.broadcast(state), F.col("__mix_members").eqNullSafe(F.col("__mix_m"))).filter("__mix_tie > after AND _size <= gap")
    bucket = F.shiftright("__mix_tie", 64 - BUCKET_BITS)
    open_ = open_.withColumn("_bucket", bucket)
    sums = open_.groupBy("__mix_m", "_bucket", "gap").agg(F.sum("_size").alias("_sum"), F.max("__mix_tie").alias("_max"))
    along = Window.partitionBy("__mix_m").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_through", F.sum("_sum").over(along))
    whole_ = sums.filter("_through <= gap").groupBy("__mix_m").agg(F.max("_max").alias("cut"), F.max("_through").alias("sum"))
    torn = (sums.filter("_through > gap").groupBy("__mix_m")
            .agg(F.min(F.struct("_bucket", (F.col("_through") - F.col("_sum")).alias("_before"))).alias("_torn")))
    torn = F.broadcast(torn.select(F.col("__mix_m").alias("_t"), "_torn.*"))  # a row for each pattern at most
    inside = open_.join(torn, F.col("__mix_m").eqNullSafe(F.col("_t")) & (open_["_bucket"] == torn["_bucket"]))
    step = Window.partitionBy("__mix_m").orderBy("__mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_through", F.col("_before") + F.sum("_size").over(step)).filter("_through <= gap")
    some = inside.groupBy("__mix_m").agg(F.max("__mix_tie").alias("cut"), F.max("_through").alias("sum"))
    return whole_.unionByName(some).groupBy("__mix_m").agg(F.max("cut").alias("cut"), F.max("sum").alias("sum"))


def mix(df: DataFrame, members: Column, size: Column, identity: list[Column], *, weights: tuple = WEIGHTS, budget: Fraction = BUDGET,
        max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """df with `size`, `source_size` and `target` (sums over the row's sources) and `copies`, how often the mix takes the row.

    `members` is the array of a row's sources; `identity` tells rows apart, equal rows are taken alike. The seeded order is
    a hash of it. A pattern's selection is a few cuts in that order, so rows are marked in one pass without a shuffle:
    what lies before the first cut, then of the rest what is small enough for the words left, and so on, last the one
    row that brings the sum nearest to the quota.
    """
    spark = df.sparkSession
    tie = F.xxhash64(F.lit(seed), *identity)
    marks = {"__mix_members": _members(members), "size": size.cast("bigint"), "__mix_tie": tie}
    units = df.select(*[c.alias(k) for k, c in marks.items()])
    units = cut_lineage(units.groupBy("__mix_members", "__mix_tie").agg(F.sum("size").alias("_size")))
    sums = units.groupBy("__mix_members").agg(F.sum("_size").alias("w"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["__mix_members"]])
    patterns = [(tuple(r["__mix_members"]), int(r["w"])) for r in found]
    sizes: dict = {}
    for m, w in patterns:
        for s in m:
            sizes[s] = sizes.get(s, 0) + w
    quota, taken = plan(sizes, patterns, rank_weights(list(sizes), weights), budget=budget, max_copies=max_copies)
    lowest = -(1 << 63)
    left = {m: t % w if w else 0 for (m, w), t in zip(patterns, taken, strict=True)}
    cuts: dict[tuple, list] = {m: [] for m in left}
    best: dict[tuple, int] = {}
    for _ in range(PASSES):
        state = [(list(m), cuts[m][-1][1] if cuts[m] else lowest, g) for m, g in left.items() if g > 0]
        if not state:
            break
        state = spark.createDataFrame(state, "__mix_m array<string>, after long, gap long")
        for r in _upto(units, state).collect():
            m = tuple(r["__mix_m"])
            cuts[m].append((cuts[m][-1][1] if cuts[m] else lowest, r["cut"], left[m]))
            left[m] -= r["sum"]
    state = [(list(m), cuts[m][-1][1] if cuts[m] else lowest, g) for m, g in left.items() if g > 0]
    if state:
        state = F.broadcast(spark.createDataFrame(state, "__mix_m array<string>, after long, gap long"))
        near = units.join(state, F.col("__mix_members").eqNullSafe(F.col("__mix_m")))
        # not taken: behind the last cut, or too large for every pass; both are behind the first cut or larger than the second gap
        first = spark.createDataFrame([(list(m), c[0][1] if c else lowest, c[1][2] if len(c) > 1 else (1 << 62)) for m, c in cuts.items()],
                                      "_f array<string>, _first long, _second long")
        near = near.join(F.broadcast(first), F.col("__mix_members").eqNullSafe(F.col("_f")))
        near = near.filter((F.col("__mix_tie") > F.col("after")) | ((F.col("__mix_tie") > F.col("_first")) & (F.col("_size") > F.col("_second"))))
        near = near.withColumn("_off", F.abs(F.col("_size") - F.col("gap"))).filter("_off < gap")
        near = near.groupBy("__mix_m").agg(F.min(F.struct("_off", "__mix_tie")).alias("__mix_best"))
        best = {tuple(r["__mix_m"]): r["__mix_best"]["__mix_tie"] for r in near.collect()}
    facts = [(list(m), t // w if w else 0, cuts[m], best.get(m), sum(sizes[s] for s in m), float(sum(quota[s] for s in m)))
             for (m, w), t in zip(patterns, taken, strict=True)]
    facts = spark.createDataFrame(facts, "__mix_m array<string>, __mix_passes long, __mix_cuts array<struct<after: long, upto: long, most: long>>, "
                                         "__mix_best long, source_size long, target double")
    rows = df.select(*[c for c in df.columns if c not in ("size", "source_size", "target", "copies")], *[c.alias(k) for k, c in marks.items()])
    rows = rows.join(F.broadcast(facts), F.col("__mix_members").eqNullSafe(F.col("__mix_m")), "left")  # a row for each pattern
    cut = F.exists("__mix_cuts", lambda c: (F.col("__mix_tie") > c["after"]) & (F.col("__mix_tie") <= c["upto"]) & (F.col("size") <= c["most"]))
    # a cut may start at the lowest number, which a hash can be
    cut = cut | F.exists("__mix_cuts", lambda c: (F.col("__mix_tie") == lowest) & (c["after"] == lowest) & (F.col("size") <= c["most"]))
    once = F.when(cut | F.coalesce(F.col("__mix_best") == F.col("__mix_tie"), F.lit(False)), 1).otherwise(0)
    return rows.withColumn("copies", (F.col("__mix_passes") + once).cast("bigint")).drop("__mix_members", "__mix_m", "__mix_tie", "__mix_passes", "__mix_cuts", "__mix_best")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    size = n_words(whole())
    return mix(docs, F.array("source"), size, [F.col("doc_id"), F.col("source"), size], **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
