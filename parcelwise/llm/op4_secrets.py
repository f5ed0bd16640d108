"""Secret scans: a keyword automaton over the whole text, anchored expressions at its hits, checksums last.

One Aho-Corasick pass over the text's bytes in lower case finds where a secret may begin; an expression is matched there
and nowhere else. Kinds whose tokens carry a checksum or a decodable header are reported only if it holds. Runs of hex
digits have no keyword and are searched for as such.

Nulls: a null text is empty. Empty texts give counts of 0. Rows with a null or repeated doc_id are scanned each on their
own, in input order. An empty table gives an empty table. Extra columns are ignored.
"""
from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

NAME = "op4_keyword_secrets"
ORACLE_SQL = None  # the checksums are not expressible; tests compare with the plain expressions

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_ok(found: re.Match) -> bool:
    """The last six letters are the CRC-32 of those between prefix and them, in base 62."""
    body, tail = found[1], found[2]
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.encode() == tail


def _jwt_ok(found: re.Match) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(found[1] + b"=" * (-len(found[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def _any(found: re.Match) -> bool:
    return True


#: kind: keywords in lower case, expression from the keyword on, what must hold of a match. In the order of the kinds.
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    "access": (("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": ((), rb"[0-9a-f]{16,}", _any),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", _crc_ok),
    "npm": (("npm_",), rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", _crc_ok),
    "jwt": (("eyj",), rb"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", _jwt_ok),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[bpars]-[0-9]{8,}-[A-Za-z0-9-]{16,}", _any),
    "stripe": (("sk_live_", "rk_live_"), rb"[sr]k_live_[A-Za-z0-9]{24,}", _any),
    "google": (("aiza",), rb"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", _any),
    "key_block": (("-----begin",), rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", _any),
}
BASE = ("assign", "access", "hex")


@cache
def _automaton():
    import ahocorasick

    found: dict[str, list] = {}
    for kind, (words, expression, holds) in KINDS.items():
        for w in words:
            found.setdefault(w, []).append((kind, re.compile(expression), holds))
    tree = ahocorasick.Automaton()
    for w, entries in found.items():
        tree.add_word(w, (len(w), entries))
    tree.make_automaton()
    return tree, re.compile(KINDS["hex"][1])


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, code points, by start and then by kind as listed; of a kind, none overlap."""
    tree, hexes = _automaton()
    raw = text.encode("utf-8", "surrogatepass")
    found, upto = [], dict.fromkeys(KINDS, 0)
    # one letter for each byte keeps offsets; only ASCII letters have their case folded
    for last, (length, entries) in tree.iter(raw.lower().decode("latin-1")):
        start = last - length + 1
        for kind, expression, holds in entries:
            # what an earlier match of the kind covers is taken, whether or not it held
            if start >= upto[kind] and (m := expression.match(raw, start)):
                upto[kind] = m.end()
                if holds(m):
                    found.append((kind, start, m.end()))
    found += [("hex", m.start(), m.end()) for m in hexes.finditer(raw)]
    if found and not text.isascii():
        found = [(k, a0 := len(raw[:a].decode("utf-8", "surrogatepass")), a0 + len(raw[a:b])) for k, a, b in found]  # matches are ASCII
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans array of struct(kind, start, end, value)) for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans(t)] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "spans": made})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole(text_col).alias("text"))
    made = rows.mapInPandas(run, "id string, spans array<struct<kind: string, start: long, end: long, value: string>>")
    return made.select(F.col("id").cast(kind).alias(id_col), "spans")


def _joined(found) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
