"""Exact Jaccard join on word shingles, with token-combination prefixes.

A document is the set of its hashed shingles, of four words in the query. Documents of one set form a class, which is joined once. If two sets
are alike enough, a short prefix of each, in an order that both share, holds common shingles:

* the order puts rare shingles first. The frequent ones (met in more than `FREQUENT` prefixes; at most `MAX_FREQUENT` of them,
  the most frequent, are held as such) come last, so that common lines and passages are seldom indexed;
* rare shingles are indexed one by one. A prefix that has too few of them is extended by frequent ones, which are indexed in
  combinations of two. To keep combinations few, frequent shingles are dealt into groups by hash and combined inside a group
  only. Missing shingles can break a rare one each, and all of a group's n only by n - 1 of them, so the prefix is extended
  until rare ones and groups add up to one more than can be missing;
* the number of groups follows the size class of the smaller set, so a set is also indexed by the class of the smallest
  set that it may be linked to.

Classes that share an index entry are candidates if their sizes fit and their sketches, the smallest hashes of a set, do not rule
a link out. They are verified in full, in blocks of at most `BLOCK` sets: connected candidates form a group, a group's sets are
dealt into blocks, and each pair of blocks is compared in one task, which counts the links of each set and emits only those that
connect something new. Where blocks would move more sets than the candidate pairs, pairs are verified instead. An entry of many
sets is dealt into blocks before its sketches are compared. No candidate is dropped for the size of a group; a linked pair is
lost to its sketches with a probability below `MISSED`.

Nulls: a null text is empty; documents without words have size 0 and are linked with nothing. A null doc_id takes part; its
component is the smallest id it reaches, null if there is none. Repeated rows are one class. An empty table gives an empty
table. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from .common import table, whole

NAME = "op2_ngram_join"
WORDS = 4
PERCENT = 85
FREQUENT = 16
#: Hashes held by every task: 8 bytes each.
MAX_FREQUENT = 2_000_000
MAX_SHARED = 4_000_000
BLOCK = 512
#: Hashes in a sketch, and the probability that a linked pair has too few of them in common.
SKETCH, MISSED = 32, 1e-12
#: Entries of up to so many sets are compared pair by pair; larger ones are dealt into blocks.
SMALL_ENTRY = 64
#: Rows of ids sent to every task; beyond this number they are joined by shuffle.
MAX_LISTED = 500_000

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
k AS (SELECT min(doc_id) AS k, list_sort(sh) AS sh, len(sh) AS n FROM s GROUP BY 2, 3),
t AS (SELECT k, n, unnest(sh) AS g FROM k),
p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.k < b.k
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(k, c) AS (SELECT k, k FROM k UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.k),
m AS (SELECT k, min(c) AS c FROM r GROUP BY k)
SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.c END AS component_id
FROM s JOIN k ON k.sh = list_sort(s.sh) JOIN m ON m.k = k.k
"""


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one, without words none."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: folds ASCII, cuts at ASCII white space
    if not found:
        return np.empty(0, "u8")
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), "u8", len(found))
    n = len(h) - words + 1
    out = np.zeros(n, "u8")
    for i in range(words):
        out = (out + h[i:i + n]) * _MULTIPLIERS[i % 4]
        out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[0]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def class_id(own: np.ndarray) -> int:
    return int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def can_miss(n: int, percent: int = PERCENT) -> int:
    """How many of its n shingles a set may lack in one that it is linked to."""
    return n - (percent * n + 99) // 100


def prefix(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return own[:can_miss(len(own), percent) + 1]


def _groups(n: int) -> int:
    return max(1, (1 << (n.bit_length() - 1)) >> 4)


def signatures(own: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The index entries of a set: rare shingles of its prefix, and hashed pairs of frequent ones."""
    n = len(own)
    if 100 * n < percent * (n + 1):  # no other set can be linked, not even one of one more
        return np.empty(0, "u8")
    need = can_miss(n, percent) + 1
    at = np.searchsorted(frequent, own)
    common = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == own
    rare = own[~common][:need]
    need -= len(rare)
    if need <= 0:
        return rare
    out, often = [rare], own[common]
    for groups in {_groups(m) for m in ((percent * n + 99) // 100, n)}:
        group = (often % np.uint64(groups)).astype(np.int64)
        # the rank of each shingle inside its group, in the shared order; each but a group's first counts
        order = np.argsort(group, kind="stable")
        first = np.r_[True, np.diff(group[order]) != 0]
        rank = np.empty(len(often), np.int64)
        rank[order] = np.arange(len(often)) - np.maximum.accumulate(np.where(first, np.arange(len(often)), 0))
        stop = int(np.searchsorted(np.cumsum(rank > 0), need)) + 1
        for g in range(groups):
            part = often[:stop][group[:stop] == g]
            a, b = np.triu_indices(len(part), 1)
            pair = (part[a] * _MULTIPLIERS[1] + part[b]) * _MULTIPLIERS[2] + np.uint64(groups)
            out.append((pair ^ (pair >> np.uint64(31))) * _MULTIPLIERS[3])
    return np.unique(np.concatenate(out))


def sketch(own: np.ndarray) -> np.ndarray:
    """A set's smallest hashes, 32 bits of each; short sets are filled up with zeros, which they then have in common."""
    low = (own[:SKETCH] >> np.uint64(32)).astype("<u4")
    return np.r_[low, np.zeros(SKETCH - len(low), "<u4")]


@cache
def least_common(percent: int = PERCENT) -> int:
    """How many hashes the sketches of linked sets have in common, but for a probability below `MISSED`.

    Those of the smallest hashes of the union that both sets have are in both sketches. Of `SKETCH` hashes each is such a one with
    the sets' likeness, so their number is at least binomial: at 85 percent, fewer than 10 of 32 have 8e-13, fewer than 13 have 1e-9.
    Linked sets of up to about 100 hashes cannot have so few.
    """
    p, below = percent / 100, 0.0
    for m in range(SKETCH + 1):
        below += comb(SKETCH, m) * p**m * (1 - p)**(SKETCH - m)
        if below >= MISSED:
            return m
    return SKETCH


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sketches, row by row, may belong to linked sets."""
    return (a[:, :, None] == b[:, None, :]).any(2).sum(1) >= least_common(percent)


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def _entries(rows: DataFrame, frequent, percent: int, words: int) -> DataFrame:
    """(sig, id) of every row; without `frequent`, its plain prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids = [], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), words)
                if len(own):
                    sigs.append(prefix(own, percent) if frequent is None else signatures(own, frequent.value, percent))
                    ids.append(np.full(len(sigs[-1]), class_id(own), "i8"))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view("i8")), pa.array(np.concatenate(ids))], names=["sig", "id"])

    return rows.select("text").mapInArrow(run, "sig long, id long")


def _listed(df: DataFrame) -> DataFrame:
    """Sent to every task if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_LISTED else df


def _held(df: DataFrame, column: str) -> np.ndarray:
    """A bounded column of hashes as a sorted array."""
    return np.sort(df.select(column).toArrow().column(column).to_numpy().view("u8"))


def _classes(rows: DataFrame, frequent, shared, percent: int, words: int) -> DataFrame:
    """(doc_id, text_hash, id, n, sigs, sketch) of every row; only entries that are shared (or all, if `shared` is None)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sigs", pa.list_(pa.int64())),
                       ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, entries, sketches = [], [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), words)
                sigs = signatures(own, frequent.value, percent)
                if shared is not None and len(sigs):
                    at = np.minimum(np.searchsorted(shared.value, sigs), max(0, len(shared.value) - 1))
                    sigs = sigs[shared.value[at] == sigs] if len(shared.value) else sigs[:0]
                ids.append(class_id(own))
                sizes.append(len(own))
                entries.append(sigs.view("i8"))
                sketches.append(sketch(own).tobytes() if len(sigs) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.int64()),
                                              pa.array(sizes, pa.int64()), pa.array(entries, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=kinds)

    return rows.mapInArrow(run, "doc_id long, text_hash long, id long, n long, sigs array<long>, sketch binary")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, group, blocks, dense, own) of rows with their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "group", "blocks", "dense")), own], names=["id", "group", "blocks", "dense", "own"])

    return rows.select("id", "group", "blocks", "dense", "text").mapInArrow(run, "id long, group long, blocks long, dense boolean, own binary")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all linked sets, as index pairs, and the number of each set's links, connecting or not. If both sides
    (0 and 1) occur, only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    start = np.searchsorted(token[order], np.arange(token.max() + 2))
    begin = np.r_[0, np.cumsum(sizes)]
    forest, out, both = _Forest(len(sets)), [], side.any() and not side.all()
    links = np.zeros(len(sets), "i8")
    for x in range(len(sets)):
        own = token[begin[x]:begin[x + 1]]
        a, n = start[own], start[own + 1] - start[own]
        many = n > 1
        a, n = a[many], n[many]
        if not len(a):
            continue
        places = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(holders[places], minlength=len(sets))
        fits = 100 * common >= percent * (sizes[x] + sizes - common)
        fits[:x + 1] = False
        if both:
            fits &= side != side[x]
        links[x] += fits.sum()
        links += fits
        out += [(x, int(y)) for y in np.flatnonzero(fits) if forest.join(x, int(y))]
    return out, links


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of ids that share an entry and may be linked by size and sketch, from entries of up to SMALL_ENTRY ids."""
    def compare(sig, ids, n, low) -> pa.RecordBatch:
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[begin, len(sig)])
        found = []
        for m in np.unique(size[size > 1]):
            x, y = np.triu_indices(m, 1)
            first = begin[size == m]
            for some in np.array_split(first, max(1, len(first) * len(x) // 20_000)):
                i, j = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[fit], j[fit]
                same = alike(low[i], low[j], percent)
                found.append(np.stack([np.minimum(ids[i], ids[j])[same], np.maximum(ids[i], ids[j])[same]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), "i8")
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last entry of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("sig", "id", "n")]
            now.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(-1, SKETCH))
            now = now if kept is None else [np.concatenate([a, b]) for a, b in zip(kept, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            kept = [a[cut:] for a in now]
            yield compare(*[a[:cut] for a in now]) if cut else compare(*[a[:0] for a in now])
        if kept is not None:
            yield compare(*kept)

    return entries.select("sig", "id", "n", "sketch").repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, "a long, b long").distinct()


def _tie(low: np.ndarray, part: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows with sketches alike that connect the parts (in place), of different sides if there are any."""
    found = []
    for x in range(len(part) - 1):
        rest = part[x + 1:] != part[x]  # only what is not connected yet
        if side is not None:
            rest &= side[x + 1:] != side[x]
        rest = x + 1 + np.flatnonzero(rest)
        for y in rest[alike(np.broadcast_to(low[x], (len(rest), SKETCH)), low[rest], percent)] if len(rest) else ():
            if part[y] != part[x]:
                found.append((x, int(y)))
                part[part == part[y]] = part[x]
    return found


def _low(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), "<u4").reshape(-1, SKETCH)


def _chains(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the sets of large entries whose sketches are alike.

    A block of an entry first connects its own sets to parts. Every part then meets the entry's largest one; near copies of one text
    all end there, so that a group of them costs its length. Only sets of parts that stay apart meet the others block by block.
    """
    dealt = entries.select("sig", "id", "sketch", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.arange(len(pdf))
        _tie(_low(pdf["sketch"]), part, None, percent)
        return pd.DataFrame({"sig": pdf["sig"], "id": pdf["id"], "part": pdf["id"].to_numpy()[part], "sketch": pdf["sketch"]})

    kind = entries.schema["sig"].dataType.simpleString()
    parts = cut_lineage(dealt.groupBy("sig", "block").applyInPandas(inside, f"sig {kind}, id long, part long, sketch binary"))
    of_part = parts.groupBy("sig", "part").agg(F.count("*").alias("n"), F.max(F.when(F.col("id") == F.col("part"), F.col("sketch"))).alias("sketch"))
    main = of_part.groupBy("sig").agg(F.max(F.struct("n", "part", "sketch")).alias("m")).select("sig", F.col("m.part").alias("main"), F.col("m.sketch").alias("main_sketch"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = alike(_low(pdf["sketch"]), _low(pdf["main_sketch"]), percent) | (pdf["part"] == pdf["main"]).to_numpy()
                yield pd.DataFrame({"sig": pdf["sig"], "part": pdf["part"], "main": pdf["main"], "near": near})

    met = cut_lineage(of_part.join(main, "sig").mapInPandas(meet, f"sig {kind}, part long, main long, near boolean"))
    edges = parts.filter("id <> part").select(F.col("part").alias("a"), F.col("id").alias("b"))
    edges = edges.unionByName(met.filter("near AND part <> main").select(F.col("main").alias("a"), F.col("part").alias("b")))
    apart = parts.join(met.select("sig", "part", "near"), ["sig", "part"])
    n_blocks = F.ceil(F.count_if(~F.col("near")) / BLOCK).cast("bigint"), F.ceil(F.count_if("near") / BLOCK).cast("bigint")
    some = apart.groupBy("sig").agg(n_blocks[0].alias("far_blocks"), n_blocks[1].alias("near_blocks")).filter("far_blocks > 0")
    apart = apart.join(_listed(cut_lineage(some)), "sig")
    far, number = apart.filter("NOT near"), F.xxhash64("id")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own, other = F.pmod(number, F.col("far_blocks")), "_other"
    among = far.withColumn(other, each("far_blocks")).select("sig", "part", "id", "sketch", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), own.alias("side"))
    with_near = far.withColumn(other, each("near_blocks")).select("sig", "part", "id", "sketch", own.alias("i"), (-F.col(other) - 1).alias("j"), F.lit(0).cast("bigint").alias("side"))
    near = apart.filter("near").withColumn("i", each("far_blocks")).select(
        "sig", "part", "id", "sketch", "i", (-F.pmod(number, F.col("near_blocks")) - 1).alias("j"), F.lit(1).cast("bigint").alias("side"))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy() if pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
        ids = pdf["id"].to_numpy()
        found = _tie(_low(pdf["sketch"]), pdf["part"].to_numpy(copy=True), side, percent)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"], dtype="int64")

    crossed = among.unionByName(with_near).unionByName(near).groupBy("sig", "i", "j").applyInPandas(between, "a long, b long")
    return edges.unionByName(crossed).distinct()


def _in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members (id, own, group, blocks), and rows (a, null, n) with numbers of links of a, to be
    added up; each pair of blocks is compared in one task."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "own", "block")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        side = (pdf["block"].to_numpy() == j) & (i != j)
        if i != j and (side.all() or not side.any()):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
        one = ~pdf["id"].duplicated().to_numpy()  # repeated rows are one set
        ids, side = pdf["id"].to_numpy()[one], side[one]
        found, n = linked([np.frombuffer(o, "u8") for o in pdf["own"][one]], side, percent)
        pairs = pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found], "n": None}).astype("Int64")
        return pd.concat([pairs, pd.DataFrame({"a": ids[n > 0], "b": None, "n": n[n > 0]}).astype("Int64")])

    return dealt.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long, n long")


def _in_pairs(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members (id, own), one candidate pair at a time."""
    pairs = pairs.join(members.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(members.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = ((np.frombuffer(x, "u8"), np.frombuffer(y, "u8")) for x, y in zip(pdf["own_a"], pdf["own_b"], strict=True))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], int)
            union = (pdf["own_a"].str.len() + pdf["own_b"].str.len()).to_numpy() // 8 - common
            yield pdf.loc[100 * common >= percent * union, ["a", "b"]]

    return pairs.mapInPandas(compare, "a long, b long")


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class_id, n_links, stays) of each row, by shingles of so many words.

    n_links is the number of other classes that the document's class is linked with. One document of each component stays: that
    of the smallest id, ids before null, then of the smallest text hash.
    """
    spark = docs.sparkSession
    rows = _texts(docs, text_col, id_col)
    counts = _entries(rows, None, percent, words).groupBy("sig").agg(F.count("*").alias("c")).filter(F.col("c") > FREQUENT)
    frequent = spark.sparkContext.broadcast(_held(counts.orderBy(F.desc("c"), "sig").limit(MAX_FREQUENT), "sig"))
    met = _entries(rows, frequent, percent, words).groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("sig")
    met = cut_lineage(met)
    small = met.count() <= MAX_SHARED
    shared = spark.sparkContext.broadcast(_held(met, "sig")) if small else None
    classes = cut_lineage(_classes(rows, frequent, shared, percent, words))
    for sent in (frequent, shared):  # nothing reads them again
        if sent is not None:
            sent.destroy()
    kept = cut_lineage(classes.filter(F.size("sigs") > 0).groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "sigs", "sketch")]))
    entries = kept.select("id", "n", "sketch", F.explode("sigs").alias("sig"))
    if not small:
        entries = entries.join(met, "sig")
    large = cut_lineage(entries.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"), F.count("*").alias("m"))
                        .filter(F.col("m") > SMALL_ENTRY).drop("m"))
    pairs = cut_lineage(_candidates(entries.join(_listed(large.select("sig")), "sig", "left_anti"), percent))
    chains = cut_lineage(_chains(entries.join(_listed(large), "sig"), percent))
    # connected candidates form a group
    edges = pairs.unionByName(chains).distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    group = cut_lineage(connected_components(nodes, edges)).select(F.col("node").alias("id"), F.col("component").alias("group"))
    size = group.groupBy("group").agg(F.count("*").alias("size"))
    home = group.withColumnRenamed("id", "a")
    n_pairs = pairs.join(home, "a").groupBy("group").agg(F.count("*").alias("pairs"))
    chained = chains.join(home, "a").select("group").distinct().withColumn("chained", F.lit(True))
    size = size.join(n_pairs, "group", "left").join(chained, "group", "left").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("bigint"))
    # chains do not name all pairs of a large entry, so their groups are compared in blocks
    dense = (F.col("blocks") == 1) | F.coalesce("chained", F.lit(False)) | (F.col("blocks") * F.col("size") <= 2 * F.col("pairs"))
    size = size.withColumn("dense", dense)
    # the set of a class is read from its first document
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    lowest = cut_lineage(classes.groupBy("id").agg(first))
    members = lowest.join(group.join(size, "group"), "id").select("id", "group", "blocks", "dense", F.xxhash64("first.doc_id", "first.text_hash").alias("row"))
    members = cut_lineage(members)
    sets = _sets(rows.withColumn("row", F.xxhash64("doc_id", "text_hash")).join(_listed(members), "row"), words)
    links = _in_blocks(sets.filter("dense").drop("dense"), percent)
    if not members.filter("NOT dense").isEmpty():
        sparse = sets.filter("NOT dense").dropDuplicates(["id"])
        found = cut_lineage(_in_pairs(sparse, pairs.join(members.filter("NOT dense").select(F.col("id").alias("a")), "a"), percent))
        ends = found.select(F.explode(F.array("a", "b")).alias("a"))
        links = links.unionByName(found.withColumn("n", F.lit(None).cast("long"))).unionByName(ends.withColumns({"b": F.lit(None).cast("long"), "n": F.lit(1).cast("long")}))
    links = cut_lineage(links)
    n_links = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    links = links.filter("b IS NOT NULL").select("a", "b").distinct()
    parts = connected_components(n_links.select("node"), links)
    # a row for each class: the first document of its component
    lowest = lowest.withColumnRenamed("first", "low")
    parts = parts.join(n_links, "node").select(F.col("node").alias("id"), "component", "n_links")
    reached = lowest.join(parts, "id").groupBy("component").agg(F.min("low").alias("reached"))
    lowest = lowest.join(parts.join(reached, "component"), "id", "left")
    lowest = lowest.select("id", F.coalesce("reached", "low").alias("first"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = classes.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "id").join(lowest, "id")
    empty = F.col("n_shingles") == 0
    stays = empty | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
                      F.col("id").alias("class_id"), "n_links", stays.alias("stays"))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs without the documents of a component but its first. Of equal rows one stays; documents without words all stay."""
    found = cut_lineage(join(docs, text_col, id_col, percent=percent, words=words).select("doc_id", "text_hash", "n_shingles", "stays"))
    key = ["__join_id", "__join_hash"]

    def listed(rows: DataFrame) -> DataFrame:
        return _listed(cut_lineage(rows.select(F.col("doc_id").alias("__join_i"), F.col("text_hash").alias("__join_h"))))

    rows = docs.withColumns({"__join_id": F.col(id_col).cast("bigint"), "__join_hash": F.xxhash64(whole(text_col))})
    match = F.col("__join_id").eqNullSafe(F.col("__join_i")) & (F.col("__join_hash") == F.col("__join_h"))
    rows = rows.join(listed(found.filter("NOT stays").select("doc_id", "text_hash").distinct()), match, "left_anti")
    again = found.filter("stays AND n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not again.isEmpty():
        again = listed(again)
        rows = rows.join(again, match, "left_anti").unionByName(rows.join(again, match, "left_semi").dropDuplicates(key))
    return rows.drop(*key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
