"""Column expressions for identifiers, hashes and booleans."""
from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SALT = os.environ.get("PARCELWISE_HASH_SALT", "parcelwise")
BLANKS = " \t\n\r\x0b\x0c"


def stripped(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def clean_str(c: Column) -> Column:
    """NULL becomes '', everything else is stripped and lower-cased."""
    return F.lower(stripped(F.coalesce(c.cast("string"), F.lit(""))))


def entity_hash(kind: str | Column, c: Column, salt: str = HASH_SALT) -> Column:
    """Salted SHA-256 of a cleaned identifier, first 16 hex characters."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), k, clean_str(c)), 256), 1, 16)


def node_id(kind: str | Column, c: Column, salt: str = HASH_SALT) -> Column:
    """'kind:hash', or NULL for an empty identifier (an order without it has no such node)."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(clean_str(c) != "", F.concat(k, F.lit(":"), entity_hash(kind, c, salt)))


def normalise_address(address: Column, pin: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), "[^a-z0-9]+", " ")
    return F.concat(F.trim(words), F.lit("|"), pin)


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def phone_digits(c: Column) -> Column:
    """Last ten digits."""
    d = digits(c)
    return F.when(F.length(d) > 10, F.substring(d, -10, 10)).otherwise(d)


def pin_digits(c: Column) -> Column:
    """First six digits."""
    return F.substring(digits(c), 1, 6)


def text_flag(c: Column) -> Column:
    """Free-text flag: empty and the usual spellings of 'no' are false."""
    return ~clean_str(c).isin("", "0", "false", "no", "none", "nan")


def uniform_draw(key: Column) -> Column:
    """Deterministic draw in [0, 1): the first 8 bytes of SHA-256(key) over 2^64."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def from_epoch(sec: Column) -> Column:
    return F.timestamp_micros((sec * F.lit(1e6)).cast("bigint"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))
