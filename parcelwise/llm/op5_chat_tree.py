"""Chat formatting over a prefix tree of conversations.

A turn is written `<s>[INST]role[/INST]text</s>`; control strings inside roles and texts are broken by a backslash, and
backslashes doubled, so that the output reads back exactly. A turn is known by the chain of hashes from its conversation's start,
so conversations that begin alike share their first turns. Turns that follow each other without a fork, and without an end of a
conversation in between, form one node of the tree. Sorting nodes by the chain of nodes from their root is a depth-first walk,
and running sums along it give each node its place in the emitted stream. Shared turns are emitted once, with

* `start`, `length`: the place in the stream; `position`: the position id of its first character, which counts along the
  node's own conversation, not along the stream;
* `attention`: the stream intervals of its ancestors, root first, which the node's characters see besides their own past;
* `loss`: the stream intervals of its assistants' texts.

`read_back` reassembles conversations from stream intervals alone. Positions count code points.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own. Turns are ordered by turn, role, text, null
turns first; repeated rows are repeated turns. An empty table gives an empty tree. Extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_in_ranges
from ..session import cut_lineage
from .common import table

NAME = "op5_chat_tree"
ORACLE_SQL = None  # tests read every conversation back and compare with the rows
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
#: Hex digits of the chain by which a node is sorted among those that follow the same nodes.
HOP = 20
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>")


def escape(text: str) -> str:
    """No control string is left: each has a backslash behind its first character. Backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


def steps_of(conversations: DataFrame) -> DataFrame:
    """A row for each turn of each conversation: conv, n_turns, depth, node (chain of hashes so far), parent, role, formatted, position."""
    turns = (conversations.select(F.col("conv_id").alias("conv"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                                                           F.coalesce("text", F.lit("")).alias("text")).alias("t"))
             .groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    kind = dict(turns.dtypes)["conv"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, turns in zip(pdf["conv"], pdf["turns"], strict=True):
                chain, position = b"", 0
                for depth, t in enumerate(turns):
                    formatted, parent = format_turn(t["role"], t["text"]), chain.hex()
                    chain = blake2b(chain + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    out.append((conv, len(turns), depth, chain.hex(), parent, t["role"], formatted, position))
                    position += len(formatted)
            yield pd.DataFrame(out, columns=["conv", "n_turns", "depth", "node", "parent", "role", "formatted", "position"])

    found = turns.select(F.col("conv").cast("string"), "turns").mapInPandas(
        walk, "conv string, n_turns long, depth int, node string, parent string, role string, formatted string, position long")
    return found.withColumn("conv", F.col("conv").cast(kind))


def paths(steps: DataFrame) -> DataFrame:
    """(conv, nodes, turns): a conversation's tree nodes, root first, each known by its last turn; and (turn, node) of each turn."""
    forks = steps.select("parent", "node").distinct().groupBy("parent").count().filter("count > 1").select(F.col("parent").alias("node"))
    last = forks.unionByName(steps.filter("depth = n_turns - 1").select("node")).distinct().withColumn("last", F.lit(True))
    marked = steps.select("conv", "depth", "node").join(last, "node", "left")
    whole_ = marked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "node", F.coalesce("last", F.lit(False)).alias("last")))).alias("all"))
    whole_ = whole_.withColumn("ends", F.filter("all", lambda t: t["last"]))
    turns = F.transform("all", lambda t: F.struct(t["node"].alias("turn"), F.element_at(F.filter("ends", lambda e: e["depth"] >= t["depth"]), 1)["node"].alias("node")))
    return whole_.select("conv", F.col("ends.node").alias("nodes"), turns.alias("turns"))


def tree(steps: DataFrame, along: DataFrame) -> DataFrame:
    """The emitted nodes, one row each: node, path, start, length, position, attention, loss, formatted."""
    turn = steps.groupBy(F.col("node").alias("turn")).agg(F.min(F.struct("depth", "role", "formatted", "position")).alias("t"))
    of = along.select(F.explode("turns").alias("x")).select("x.turn", "x.node").distinct()
    texts = turn.join(of, "turn").groupBy("node").agg(F.sort_array(F.collect_list("t")).alias("t"))
    learnt = F.filter("t", lambda t: t["role"] == LOSS_ROLE)
    learnt = F.transform(learnt, lambda t: F.struct((t["position"] + F.instr(t["formatted"], "[/INST]") + 6).alias("start"),
                                                    (t["position"] + F.char_length(t["formatted"]) - 4).alias("end")))
    texts = texts.select("node", F.array_join("t.formatted", "").alias("formatted"), F.element_at("t.position", 1).alias("position"), learnt.alias("_loss"))
    texts = cut_lineage(texts.withColumn("length", F.char_length("formatted").cast("bigint")))
    # a node's path: the hashes of the nodes to it, each cut to HOP digits
    hops = F.transform("nodes", lambda n: F.left(n, F.lit(HOP)))
    named = along.withColumn("_hops", hops).select(F.posexplode("nodes").alias("k", "node"), "_hops")
    named = named.select("node", F.array_join(F.slice("_hops", F.lit(1), F.col("k") + 1), "").alias("path")).distinct()
    placed = running_in_ranges(named.join(texts.select("node", "length"), "node"), [], ["path", "node"], {"start": ("sum", F.col("length"))})
    placed = cut_lineage(placed.withColumn("start", F.col("start").cast("bigint")))
    # where a node's ancestors stand; only paths and places meet
    depth = F.length("path") / HOP
    ups = F.transform(F.sequence(F.lit(1), (depth - 1).cast("int")), lambda d: F.substring("path", F.lit(1), HOP * d))
    above = placed.filter(depth > 1).select("path", F.explode(ups).alias("up"))
    spans = placed.select(F.col("path").alias("up"), F.length("path").alias("d"), F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span"))
    above = above.join(spans, "up").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("d", "span"))).alias("a")).select("path", F.col("a.span").alias("attention"))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    placed = placed.join(above, "path", "left").withColumn("attention", F.coalesce("attention", empty))
    out = placed.join(texts.drop("length"), "node")
    moved = F.col("start") - F.col("position")
    return out.withColumn("loss", F.transform("_loss", lambda x: F.struct((x["start"] + moved).alias("start"), (x["end"] + moved).alias("end")))).drop("_loss")


def read_back(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, segments) for each end: its conversation, as array of struct(start, formatted, loss), from stream intervals alone."""
    want = nodes.join(ends, "node").select("node", F.explode(F.array_append(F.col("attention.start"), F.col("start"))).alias("start"))
    return want.join(nodes.select("start", "formatted", "loss"), "start").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "formatted", "loss"))).alias("segments"))


def digest(read: DataFrame) -> DataFrame:
    """The contract's figures of each end, parsed from its segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for node, segments in zip(pdf["node"], pdf["segments"], strict=True):
                turns = parse("".join(s["formatted"] for s in segments))
                learnt = "".join(unescape(s["formatted"][x["start"] - s["start"]:x["end"] - s["start"]]) for s in segments for x in s["loss"])
                whole = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")
                out.append((node, len(turns), sha256(whole).hexdigest(), len(learnt), sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(),
                            sum(len(s["formatted"]) for s in segments)))
            yield pd.DataFrame(out, columns=["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read.mapInPandas(run, "node string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    steps = cut_lineage(steps_of(rows))
    along = cut_lineage(paths(steps))
    ends = along.select("conv", F.element_at("nodes", -1).alias("node"))
    # equal conversations end in one node, which is read back once
    read = digest(read_back(tree(steps, along), ends.select("node").distinct()))
    return ends.join(read, "node").select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
