"""Document fingerprints by spot signatures.

A spot is an anchor, one of a few very common words, with the next two content words behind it; common words in between are
skipped. So that tables and lists, which lack common words, have spots too, a few content words are anchors as well, chosen by
their hash. The set of a text's spots is its fingerprint. A text without a spot takes its words instead, so that every text
with a word has a fingerprint; texts without words share the empty one.

Likeness is the Jaccard similarity of two sets. `near_duplicates` finds all pairs above a threshold: sets are partitioned by
size, so that a set meets only those of its own and the next partition; inside, they are indexed by their globally rarest
spots, as many as must hold a common one, and candidates are verified by size first and then in full. Equal sets form a class,
which takes part once. An entry of many sets is dealt into blocks. The query does not call it, its columns are about neighbours.

Everything is built-in functions. Equal texts have equal fingerprints.

Nulls: a null text is empty. Two empty fingerprints have likeness 1, an empty and another 0. The next document is that of the
next distinct (doc_id, text), null ids first, and the first one's after the last; repeated rows have equal results. An empty
table gives an empty table. Extra columns are ignored.
"""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import successors, table, whole

NAME = "op1_spotsigs"
ORACLE_SQL = None
#: One content word in so many, by its hash, is an anchor as well.
SAMPLED = 8
#: Likeness of near duplicates.
PERCENT = 80
#: Spots of more sets than this get their number by broadcast; entries of more sets than a block are dealt into blocks.
HOT = 10_000
BLOCK = 512
#: Common words of the languages in the corpus, a parameter of every function here.
ANCHORS = {
    "en": "the a an and of to in is are was be that it this for on as by with from at or not".split(),
    "de": "der die das den dem des und ist in im ein eine von zu mit sich auf für nicht als auch aus".split(),
    "fr": "le la les de des du et est un une en que qui dans pour par sur au aux ne pas avec".split(),
    "es": "el la los las de del y en que un una es se por con para su al lo como más no".split(),
}
COMMON = sorted({w for words in ANCHORS.values() for w in words})


def with_signatures(df: DataFrame, text: Column, name: str, common: list[str] = COMMON) -> DataFrame:
    """df with `name`: the sorted distinct 32-bit hashes of the text's spots (chains of two content words)."""
    words, gaps, content, spots = (f"_{name}_{k}" for k in ("words", "gaps", "content", "spots"))
    df = df.withColumn(words, F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))
    # the anchors that stand before each content word, as one string for each; a chain starts behind every one of them.
    # A sampled content word keeps its place and is an anchor before the next one
    marks = F.array_join(F.transform(words, lambda w: F.when(w.isin(common), F.concat(w, F.lit(" ")))
                                       .when(F.pmod(F.hash(w), F.lit(SAMPLED)) == 0, F.concat(F.lit("|"), w, F.lit(" "))).otherwise(F.lit("|"))), "")
    df = df.withColumns({gaps: F.split(marks, r"\|"), content: F.filter(words, lambda w: ~w.isin(common))})
    chains = F.arrays_zip(F.col(gaps).alias("g"), F.col(content).alias("a"), F.slice(content, 2, F.greatest(F.size(content), F.lit(1))).alias("b"))
    full = F.filter(chains, lambda c: c["b"].isNotNull() & (c["g"] != ""))
    hashes = F.transform(full, lambda c: F.transform(F.split(F.rtrim(c["g"]), " "), lambda w: F.hash(w, c["a"], c["b"])))
    df = df.withColumn(spots, F.array_distinct(F.flatten(hashes)))
    alone = F.array_distinct(F.transform(words, lambda w: F.hash(w)))
    return df.withColumn(name, F.array_sort(F.when(F.size(spots) > 0, F.col(spots)).otherwise(alone))).drop(words, gaps, content, spots)


def fingerprint(signatures: Column) -> Column:
    """Eight hex digits a spot."""
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last quarter of a text of n code points replaced by the first as many (or all) of the following one."""
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.left(following, quarter))


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n, sig, next_id, following, following_sig): each row with the id, the prefix (as far as its edit can need
    it) and the signatures of the next distinct document.

    The order is found on narrow keys; texts are shuffled once, prefixes and signatures once more to the row before.
    """
    rows = docs.select("doc_id", whole().alias("text"))
    # null ids stay apart from 0 by the hash, which skips nulls
    rows = rows.withColumns({"i": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "h": F.xxhash64("doc_id", "text"), "n": F.char_length("text")})
    order = successors(rows.select("i", "h", "n"), ["i", "h", "n"])
    asked = order.select(F.col("_next.i").alias("i"), F.col("_next.h").alias("h"), F.col("i").alias("to_i"), F.col("h").alias("to_h"),
                         F.floor(F.col("n") / 4).cast("int").alias("quarter"))
    signed = with_signatures(rows, F.col("text"), "sig")
    own = signed.join(asked, ["i", "h"])
    # both uses read the same columns of `signed`, so that its shuffle is used again
    sent = own.select(F.col("to_i").alias("i"), F.col("to_h").alias("h"), F.col("doc_id").alias("next_id"), F.left("text", F.least("quarter", "n")).alias("following"),
                      F.col("sig").alias("following_sig"))
    sent = sent.groupBy("i", "h").agg(*[F.first(c).alias(c) for c in ("next_id", "following", "following_sig")])  # repeated rows are equal
    return own.select("i", "h", "doc_id", "text", "n", "sig").join(sent, ["i", "h"]).drop("i", "h")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: all pairs of `sets` (id, sig), distinct sets with distinct ids, of that likeness at least."""
    spots = sets.select("id", F.size("sig").alias("n"), F.explode("sig").alias("spot"))
    counts = cut_lineage(spots.groupBy("spot").agg(F.count("*").alias("c")).filter("c > 1"))  # a spot of one set joins nothing
    hot = F.broadcast(counts.filter(F.col("c") > HOT))
    known = spots.join(hot, "spot").unionByName(spots.join(hot, "spot", "left_anti").join(counts.filter(F.col("c") <= HOT), "spot"))
    # the spots of one set alone come first in the order; of the rest the prefix has as many as are left
    rare = known.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "spot"))).alias("order"))
    need = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.size("order"))
    rare = rare.withColumn("need", need.cast("int")).filter("need > 0")
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(log(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    rare = rare.select("id", "n", part.cast("long").alias("part"), F.explode(F.slice(F.col("order.spot"), F.lit(1), F.col("need"))).alias("spot"))
    rare = cut_lineage(rare)
    # a set is met in its own partition, and comes to the next one
    large = rare.groupBy("part", "spot").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    large = cut_lineage(large.select("part", "spot", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    met = rare.join(large, ["part", "spot"], "left").select("part", "spot", F.pmod(F.xxhash64("id"), blocks).alias("block"), F.col("id").alias("y"), F.col("n").alias("ny"))
    comes = rare.withColumn("own", F.col("part")).withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    comes = comes.join(large, ["part", "spot"], "left").select(
        "part", "spot", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("id").alias("x"), F.col("n").alias("nx"), "own")
    fits = (F.col("x") != F.col("y")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((F.col("own") < F.col("part")) | (F.col("x") < F.col("y")))
    pairs = comes.join(met, ["part", "spot", "block"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links) of each row: documents of one fingerprint are a class; n_links is the number of other
    classes of that likeness at least."""
    rows = with_signatures(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")), F.col("text"), "sig")
    rows = cut_lineage(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("sig").alias("class_id"), "sig"))
    sets = cut_lineage(rows.groupBy(F.col("class_id").alias("id")).agg(F.first("sig").alias("sig")))
    n_links = links(sets, percent).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return rows.drop("sig").join(n_links, "class_id", "left").select("doc_id", "text_hash", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_successor(table(spark, sf_dir, "documents"))
    rows = with_signatures(rows.withColumn("edited", edited(F.col("text"), F.col("n"), F.col("following"))), F.col("edited"), "edited_sig")
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("following_sig")).alias("near_next"), "next_id")
