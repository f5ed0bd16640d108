"""The pipeline against a run of its stages one document at a time."""
import collections
import re

import corpus_pipeline
import pytest
from awkward_docs import prose
from test_documents import brute_components

from parcelwise.llm import op7_line_crf

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rows = [(i, prose(i, 60 + i) + f"\nMail user{i}@mail.example.com now.", "en", f"src{i % 4}") for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end", "en", "src1") for i in range(6)]  # near copies
    rows += [(200, "x | y | z | " * 60, "en", "src0"), (201, "too short", "en", None), (202, None, None, None), (203, "the same words again and " * 40, "en", "src2")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], COLUMNS)
    df.repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows


def test_stages(spark, corpus):
    sf_dir, rows = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    weights, change = op7_line_crf.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if op7_line_crf.judge_text(r[1] or "", weights, change)[6]} == {*range(40), *range(100, 106)}
    one = stages["n-gram join"](spark, kept, sf_dir).cache()
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute_components(texts)}) == list(range(40))
    clean = stages["personal data"](spark, one, sf_dir).cache()
    assert clean.columns == columns and clean.count() == 40
    for r in clean.collect():
        assert not re.search(r"user\d+@mail", r["text"]) and "@" in r["text"] and r["n_chars"] == len(r["text"])
    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    assert mixed.columns == columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) == 2
    words = {r["doc_id"]: len(r["text"].split()) for r in clean.collect()}
    assert abs(sum(words[d] * n for d, n in times.items()) - 1.5 * sum(words.values())) <= 2 * max(words.values())
    packed = stages["packing"](spark, mixed, sf_dir)
    assert collections.Counter(r["doc_id"] for r in packed.filter("start = 0").collect()) == times
    assert collections.Counter(map(tuple, packed.drop("sequence_id").collect())) == collections.Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id").collect()))


def test_empty(spark, folder):
    assert corpus_pipeline.run(spark, str(folder / "none")).collect() == []


def test_near_copies_of_four_fifths(spark):
    """Five-word likeness of 0.80 to 0.85 links, less does not: a passage appended, words edited."""
    rows, drop = [], set()
    for i, added in enumerate((10, 18, 24, 25, 26, 40)):  # 100 shingles in 100 + added
        text = " ".join(f"d{i}w{k}" for k in range(104))
        rows += [(10 * i, text), (10 * i + 1, text + "".join(f" x{i}y{k}" for k in range(added)))]
        drop |= {10 * i + 1} if added <= 25 else set()
    for i, edits in enumerate((3, 4, 5), 10):  # each edit breaks 5 of 200 shingles: 185/215, 180/220, 175/225
        words = [f"d{i}w{k}" for k in range(204)]
        rows.append((10 * i, " ".join(words)))
        for k in range(edits):
            words[20 + 30 * k] = "edited"
        rows.append((10 * i + 1, " ".join(words)))
        drop |= {10 * i + 1} if edits <= 4 else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["n-gram join"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _ in rows if d not in drop]
