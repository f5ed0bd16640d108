"""What several operators of this subpackage need: tables, words, row keys and neighbours in a global order."""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

#: Words of the contracts: runs of anything but ASCII white space. `bytes.split()` cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: what a later step reads often is made once."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """As many shuffle partitions as the session uses; blocks of work are dealt over them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def successors(df: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of `order` with the next row in that order as struct `_next`; the last row's is the first.

    Rows are cut into ranges, each range is ordered on its own, and the heads of the ranges (one row a range)
    close the gaps; no task sees more than a range. `order` is a key of a few narrow columns.
    """
    at = cut_lineage(df.select(*order).distinct().repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    row = F.struct(*order)
    inside = at.withColumn("_next", F.lead(row).over(Window.partitionBy("_range").orderBy(*order)))
    heads = at.groupBy("_range").agg(F.min(row).alias("_head"))
    turn = Window.orderBy("_range")  # a row for each range
    heads = heads.select("_range", F.lead("_head").over(turn).alias("_after"), F.first("_head").over(turn).alias("_first"))
    return (inside.join(F.broadcast(heads), "_range")
            .withColumn("_next", F.coalesce("_next", "_after", "_first")).drop("_range", "_after", "_first"))
