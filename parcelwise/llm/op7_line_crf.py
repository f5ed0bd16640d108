"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

Every line that has a word gets a few discretised features (share of symbols, capitals and digits, length and spelling of
words, repetition inside the line and of the line, end of sentence, position). The Viterbi path through the chain labels
all lines of a text together; the share of words in lines of content decides whether the document is kept. Documents of
fewer than `MIN_WORDS` words or mostly of repeated three-word windows fail before.

The weights are fitted by conditional likelihood on the lines of labelled documents (all lines of a good one are content, of
a bad one boilerplate): at most `SAMPLE` documents of each label, none longer
than `SAMPLE_CHARS`, by a hash of their id. That sample alone reaches the
driver; where labels or one of the two classes lack, the weights are those of `PRIOR`.

Nulls: a null text has no words and fails. A null or repeated doc_id is judged row by row; a document with several labels
counts as bad if one says so. An empty table gives an empty table. Extra columns stay in `judge`, but for those that it adds.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table, whole

NAME = "op7_line_crf"
ORACLE_SQL = None  # tests compare the base figures with plain counts and the labels with an exhaustive search
MIN_WORDS = 50
MAX_REPEATED = 50
#: The fit reads at most so many labelled documents of each class, of those up to so many characters (24 MB at most).
SAMPLE = 300
SAMPLE_CHARS = 10_000
#: Share of words in content lines from which a document is kept.
MIN_CONTENT = 0.5
SYMBOLS = "#*$%&|<>"
FEATURES = ("one", "symbols_some", "symbols_many", "capitals", "digits", "no_lower", "short_words", "long_words", "repeats_some", "repeats_many",
            "seen_before", "no_end", "one_word", "bars")
#: Weight of each feature for boilerplate against content, and of a change of label, where nothing can be fitted.
PRIOR = np.array([-2.0, 1.5, 3.0, 3.0, 0.5, 1.0, 0.2, 0.2, 1.0, 3.0, 0.3, 0.2, 0.0, 2.0])
PRIOR_CHANGE = -1.0


def _white(text: str) -> int:
    return sum(text.count(c) for c in "\t\n\x0b\x0c\r ")


def line_features(line: str, words: list[bytes], seen: bool) -> np.ndarray:
    n = len(words)
    chars = max(1, len(line) - _white(line))
    symbols = sum(line.count(c) for c in SYMBOLS) / chars
    upper = sum(w.isupper() for w in words) / n  # by ASCII letters
    digits = sum(w.isdigit() for w in words) / n
    repeats = 1 - len(set(words)) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    mean = chars / n
    return np.array((1, symbols > 0.01, symbols > 0.05, upper > 0.5 and n > 1, digits > 0.2, not any(c.islower() for c in line), mean < 2.5, mean > 12,
                     repeats > 0.5 and n > 4, same > 0.3, seen, not line.rstrip().endswith((".", "!", "?", ":", '"')), n == 1, line.count("|") / n > 0.2), float)


def chain(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of each line with a word, words in it, and how many lines equal an earlier one."""
    rows, sizes, seen, again = [], [], set(), 0
    for line in text.split("\n"):
        if words := line.encode("utf-8", "surrogatepass").split():
            old = line in seen
            again += old
            seen.add(line)
            rows.append(line_features(line, words, old))
            sizes.append(len(words))
    return np.array(rows).reshape(-1, len(FEATURES)), np.array(sizes, int), again


def viterbi(score: np.ndarray, change: float) -> np.ndarray:
    """The best labels (1: boilerplate); score is a line's weight for 1 against 0, change the weight of a change. Ties go to 0."""
    n = len(score)
    from_other = np.zeros((n, 2), bool)
    best0, best1 = 0.0, score[0]
    for i in range(1, n):
        from_other[i] = best1 + change > best0, best0 + change >= best1
        best0, best1 = max(best0, best1 + change), max(best1, best0 + change) + score[i]
    labels = np.zeros(n, int)
    at = int(best1 > best0)
    for i in range(n - 1, -1, -1):
        labels[i] = at
        if i and from_other[i, at]:
            at = 1 - at
    return labels


def _marginals(score: np.ndarray, change: float) -> tuple[np.ndarray, float]:
    """P(line is boilerplate) and the expected number of changes, by the forward and backward sums."""
    n, step = len(score), np.array([[0.0, change], [change, 0.0]])
    node = np.stack([np.zeros(n), score], 1)
    ahead, back = node.copy(), np.zeros((n, 2))
    for i in range(1, n):
        ahead[i] += np.logaddexp(ahead[i - 1, 0] + step[0], ahead[i - 1, 1] + step[1])
    for i in range(n - 2, -1, -1):
        back[i] = np.logaddexp(step[:, 0] + node[i + 1, 0] + back[i + 1, 0], step[:, 1] + node[i + 1, 1] + back[i + 1, 1])
    total = np.logaddexp(*ahead[-1])
    changes = sum(np.exp(ahead[:-1, a] + change + node[1:, b] + back[1:, b] - total).sum() for a, b in ((0, 1), (1, 0)))
    return np.exp(ahead[:, 1] + back[:, 1] - total), float(changes)


def fit(texts: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights from (text, 1 if good), by steps up the conditional likelihood; each text counts alike, each class alike."""
    chains = [(f, label) for t, label in texts if len(f := chain(t)[0])]
    n = Counter(label for _, label in chains)
    if len(n) < 2:
        return PRIOR, PRIOR_CHANGE
    weights, change, grads = PRIOR.copy(), PRIOR_CHANGE, np.full(len(PRIOR) + 1, 1e-3)
    for _ in range(rounds):
        up, up_change = -ridge * (weights - PRIOR), -ridge * (change - PRIOR_CHANGE)
        for f, label in chains:
            p, changes = _marginals(f @ weights, change)
            share = 1 / (2 * n[label] * len(f))
            up += share * (((1 - label) - p) @ f)
            up_change -= share * changes
        step = np.append(up, up_change)
        grads += step * step
        step = rate * step / np.sqrt(grads)
        weights, change = weights + step[:-1], min(0.0, change + step[-1])
    return weights, change


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i:i + 3] = b"\1\1\1"
    return covered.count(1)


def judge_text(text: str, weights: np.ndarray, change: float) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    n, n_repeat = len(words), repeated(words)
    features, sizes, again = chain(text)
    content = 0.0
    if n:
        content = float(sizes[viterbi(features @ weights, change) == 0].sum() / n)
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n
    return (n, len(text) - _white(text), sum(text.count(c) for c in SYMBOLS), again, n_repeat, failed, not failed and content >= MIN_CONTENT, content)


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights fitted on a bounded sample of labelled documents, the same for each run."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    ids = docs.filter(F.char_length("text") <= SAMPLE_CHARS).select("doc_id").distinct().join(good, "doc_id")
    order = F.xxhash64("doc_id")
    picked = [r for g in (0, 1) for r in ids.filter(F.col("_good") == g).orderBy(order, "doc_id").limit(SAMPLE).collect()]
    if not picked:
        return PRIOR, PRIOR_CHANGE
    few = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["_good"]) for r in picked], "doc_id long, _good int"))
    texts = docs.filter(F.char_length("text") <= SAMPLE_CHARS).join(few, "doc_id").groupBy("doc_id", "_good").agg(F.min(whole()).alias("_t")).orderBy("doc_id").collect()
    return fit([(r["_t"], r["_good"]) for r in texts])


def judge(docs: DataFrame, weights: np.ndarray, change: float, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in `keep`) with the base figures, the share of content and the verdict."""
    added = T.StructType.fromDDL(ADDED)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    rows = docs.select(*keep, *[] if text_col in keep else [F.col(text_col)])
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(added)
        for batch in batches:
            made = [judge_text(t.as_py() or "", weights, change) for t in batch.column(text_col)]
            columns = [pa.array([m[i] for m in made], kinds.field(i).type) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=keep + added.names)

    return rows.mapInArrow(run, schema)


def judge_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return judge(docs, *fitted(docs, labels), keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
