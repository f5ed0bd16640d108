"""Connected components: the final ones, and the ones as they stood at any moment.

Both are driver loops over distributed joins whose lineage is cut every round. A component is named after its
smallest node id; over time it is known by its member of lowest priority, a random order.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _fingerprint(df: DataFrame, *cols: str) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of nodes(node), given undirected edges(a, b).

    Each round hangs every larger neighbour of a node under the node's smallest neighbour, then every node
    and its smaller neighbours under the smallest of them. Minima are pre-aggregated; joins are against one
    row per node, so a hub is one skewed join side that adaptive execution splits.
    """
    star = (edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    star = cut_lineage(star)
    mark = _fingerprint(star, "u", "v")
    while True:  # labels only fall, so the rounds end
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        star = cut_lineage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(star, "u", "v")
        if now == mark:
            break
        mark = now
    label = star.select(F.col("u").alias("node"), F.col("v").alias("_root"))
    return (nodes.join(label, "node", "left")
            .select(*nodes.columns, F.coalesce("_root", "node").alias("component")))


def priority(node: Column) -> Column:
    """Random order of nodes: whatever order their ids come in, chains through it stay short."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("node"))


def _is_code(df: DataFrame, node: str) -> bool:
    """Nodes that are numbers are hashes already: their own order is a random one."""
    return isinstance(df.schema[node].dataType, T.LongType)


def _downward(a: Column, b: Column, coded: bool = False) -> list[Column]:
    """An undirected edge as (u, v), v of lower priority."""
    if coded:
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    low, high = F.least(priority(a), priority(b)), F.greatest(priority(a), priority(b))
    return [high["node"].alias("u"), low["node"].alias("v")]


def merge_forest(edges: DataFrame) -> DataFrame:
    """(node, parent, at): a forest that connects the same nodes at every moment as edges(a, b, ts, seq) do.

    Every node keeps its earliest edge to a node of lower priority; its later ones are hung under the end of the earliest, which it
    had reached by then. When no node has two such edges left, each has one parent, and the nodes connected at a moment are those
    whose parents, followed over links no younger, end at the same one. Edges only get fewer and lower; a hub is one skewed join side.
    """
    coded = _is_code(edges, "a")
    lower = edges.filter("a <> b").select(*_downward(F.col("a"), F.col("b"), coded), F.struct("ts", "seq").alias("at"))
    lower = cut_lineage(lower.groupBy("u", "v").agg(F.min("at").alias("at")))
    settled = []
    while True:  # an edge that moves has a lower end than before
        both = F.array(F.struct(F.col("u"), F.struct("at", "v").alias("f"), F.lit(False).alias("below")),
                       F.struct(F.col("v").alias("u"), F.lit(None).alias("f"), F.lit(True).alias("below")))
        first = lower.select(F.inline(both)).groupBy("u").agg(F.min("f").alias("f"), F.count("f").alias("n"), F.max("below").alias("below"))
        met = lower.join(first.filter("n > 0"), "u")
        stays = (F.col("n") == 1) | (F.col("v") == F.col("f.v"))
        ends = _downward(F.col("f.v"), F.col("v"), coded)
        u = F.when(stays, F.col("u")).otherwise(ends[0])
        v = F.when(stays, F.col("v")).otherwise(ends[1])
        # edges move to nodes that were a lower end: a node that is none gets no more, and the edge it keeps leaves the rounds
        hung = met.select(u.alias("u"), v.alias("v"), "at", (~stays).alias("moved"), (stays & ~F.col("below")).alias("kept"))
        now = cut_lineage(hung.groupBy("u", "v").agg(F.min("at").alias("at"), F.max("moved").alias("moved"), F.max("kept").alias("kept")))
        lower = now.filter(~F.col("kept"))
        if lower.filter("moved").isEmpty():
            return reduce(DataFrame.unionByName, [*settled, now]).select(F.col("u").alias("node"), F.col("v").alias("parent"), "at")
        settled.append(now.filter("kept"))


def component_history(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every label a node ever carries: (node, ts, seq, label), the label holding from (ts, seq) on.

    nodes(node, ts, seq) gives each node's first appearance; edges(a, b, ts, seq) the moment each edge came in. The label of a moment
    is the member of the component of lowest priority: the last ancestor in the merge forest that is reached over links no younger.
    All ancestors are found by doubling. With random priorities a node has logarithmically many, however ids and times agree.
    """
    above = merge_forest(edges).select("node", F.col("parent").alias("label"), "at", F.lit(0).alias("fresh"))
    step = 0
    while True:  # a path of 2^step links is covered after that many steps
        via = above.select(F.col("node").alias("label"), F.col("label").alias("_up"), F.col("at").alias("_at"), F.col("fresh").alias("_fresh"))
        # two paths make a new one if one of them is of the last step
        longer = (above.join(via, "label").filter((F.col("fresh") == step) & (F.col("_fresh") >= step - 1) | (F.col("_fresh") == step))
                  .select("node", F.col("_up").alias("label"), F.greatest("at", "_at").alias("at"), F.lit(step + 1).alias("fresh")))
        above = cut_lineage(above.unionByName(longer).groupBy("node", "label").agg(F.min("at").alias("at"), F.min("fresh").alias("fresh")))
        step += 1
        if above.filter(F.col("fresh") == step).isEmpty():
            break
    first = nodes.select("node", F.col("node").alias("label"), F.struct("ts", "seq").alias("at"))
    steps = first.unionByName(above.drop("fresh")).groupBy("node", "at")
    if _is_code(edges, "a"):
        return steps.agg(F.min("label").alias("label")).select("node", "at.ts", "at.seq", "label")
    steps = steps.agg(F.min(priority(F.col("label"))).alias("p"))
    return steps.select("node", "at.ts", "at.seq", F.col("p.node").alias("label"))


def final_labels(history: DataFrame) -> DataFrame:
    """(node, component) after the last event of a history; a component has the name of its smallest node."""
    last = history.groupBy("node").agg(F.min(priority(F.col("label")))["node"].alias("label"))
    names = last.groupBy("label").agg(F.min("node").alias("component"))
    return last.join(names, "label").select("node", "component")


def named_labels(history: DataFrame, names: DataFrame) -> DataFrame:
    """As `final_labels`, for a history of node codes: names(node, name) tells what a code stands for."""
    last = history.groupBy("node").agg(F.min("label").alias("label")).join(names.select("node", "name"), "node")
    smallest = last.groupBy("label").agg(F.min("name").alias("component"))
    return last.join(smallest, "label").select(F.col("name").alias("node"), "component")


def first_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
