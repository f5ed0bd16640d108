"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept, as a table, and its decisions take effect there: rejected documents
and all but one of near duplicates go, texts get surrogates, sources are mixed to their weights (a document that is taken twice
is there twice), and what is left is cut and packed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import op2_ngram_join, op7_line_crf, op8_packing, op9_mixing, op10_surrogates
from parcelwise.llm.common import table, written

#: Near duplicates have four fifths of their five-word shingles in common; op2's own query has a contract of its own.
SHINGLE_WORDS, LIKENESS_PERCENT = 5, 80

ORACLE_SQL = None  # the model of the first stage is not expressible; tests compare with a brute-force run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = op7_line_crf.judge_documents(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_ngram_join.one_of_each(docs, words=SHINGLE_WORDS, percent=LIKENESS_PERCENT).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = op10_surrogates.replace_entities(docs)
    length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
    return replaced.withColumn("n_chars", F.when(F.col("n_entities") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = op9_mixing.mix_documents(docs)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram join", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
