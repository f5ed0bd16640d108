"""Packing by power-of-two decomposition.

Every document becomes token ids plus one end id and is cut into pieces whose lengths are powers of two: as many of
`max_length` as fit, then one for each set bit of the rest, longest first. A piece is a sequence of its own, so no
sequence crosses documents and none is padded. Sequences are numbered by length: a bucket of equal lengths is a run of
consecutive sequence ids, from which batches are read.

Nulls: a null text is empty and gives the end id alone. Rows with a null or repeated doc_id are packed each on its own.
An empty table gives an empty table. Extra columns are ignored.
"""
from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.running import with_position
from ..session import cut_lineage
from .common import table, whole

NAME = "op8_binary_packing"
MAX_LENGTH = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes of words and their ids that a Python worker keeps, with `OVERHEAD` for each entry: half of them new, half from before,
#: which stay if they are met again.
STORE = 56 << 20
OVERHEAD = 200
#: The same where packing has the workers to itself; the pipeline's other stages need the room.
OWN_STORE = 128 << 20
#: Pieces that a task hands on at once.
ROWS = 8192
ORACLE_SQL = None  # tokens are not expressible; tests compare with a plain encoder and cut

#: What the vocabulary's splitter cuts a word into, said for the letters below: letters, one digit, contractions, the rest.
_PARTS = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
#: ASCII that they may hold.
_PLAIN_BYTES = bytes([*range(9, 14), *range(32, 127)])
#: Texts with any other character (marks to compose, further scripts and white space) go the whole way, word by word.
_OTHER = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿĀ-įĲ-ň\u014a-ž]|İ|[ŉĿŀ]")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts, each distinct word encoded once.

    The vocabulary drops white space and never merges over the cuts of its splitter, so a text's ids are those of its
    parts in order. Plain texts are split here and only merged by the vocabulary; all others take the whole way.
    """

    def __init__(self, path: str, store: int = STORE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._young: dict[str | bytes, bytes] = {}
        self._old: dict[str | bytes, bytes] = {}
        self._held, self._store = 0, store

    def _learn(self, word: str | bytes, make: Callable[[str | bytes], bytes]) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            ids = make(word)
        if 2 * self._held > self._store:
            self._old, self._young, self._held = self._young, {}, 0
        self._young[word] = ids
        self._held += OVERHEAD + len(word) + len(ids)
        return ids

    def _merge(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _plain(self, word: str) -> bytes:
        found, known = _PARTS.findall(word), self._young.get
        if len(found) == 1:
            return self._merge(word)
        return b"".join([known(p) or self._learn(p, self._merge) for p in found])

    def _encode(self, word: bytes) -> bytes:
        return array("I", self._whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        rest = text.encode("utf-8", "surrogatepass").translate(None, _PLAIN_BYTES)  # most texts leave little to search
        if "<|" in text or (rest and _OTHER.search(rest.decode("utf-8", "surrogatepass"))):
            make, words = self._encode, text.encode("utf-8", "replace").split()
        else:
            make, words = self._plain, text.lower().split()
        known = self._young.get
        return np.frombuffer(b"".join([known(w) or self._learn(w, make) for w in words]), "u4")


@cache
def encoder(path: str, store: int = STORE) -> WordEncoder:
    """One for each Python worker; it keeps its words from task to task."""
    return WordEncoder(path, store)


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Powers of two, falling, that add up to n; only `max_length` repeats."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, path: str | None = None, end_id: int = END_ID,
           max_length: int = MAX_LENGTH, store: int = STORE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens) for each piece of each row."""
    name = path

    schema = T.StructType.fromDDL("id string, start long, length long, ids_crc32 long, doc_tokens long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kinds, out = encoder(name or vocabulary_path(), store).ids, to_arrow_schema(schema), []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                key, start = key.as_py(), 0
                for length in piece_lengths(len(ids), max_length):
                    out.append((key, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids)))
                    start += length
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole(text_col).alias("text"))
    made = rows.mapInArrow(cut, schema)
    return made.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each piece, with the sequence that it alone fills. Sequences are numbered by rising length."""
    made = cut_lineage(pieces(docs, text_col, id_col, **options))
    numbered = with_position(made, ["length", id_col, "start"], "sequence_id")
    return numbered.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), store=OWN_STORE)
