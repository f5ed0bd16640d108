"""Canonical JSON as column expressions: keys sorted at every level, no white space, text as it is, shortest numbers.

Equal values have equal strings on every engine that follows the same rules, so their hash names a packet.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short escapes of JSON strings, by their order of application.
SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
#: Decimal exponents that are spelt out; numbers outside of them have an exponent.
SPELT_FROM, SPELT_BELOW = -4, 16


def quoted(text: Column) -> Column:
    for raw, escaped in SHORT_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    rest = text
    for code in range(32):
        if chr(code) not in "\n\r\t\b\f":
            rest = F.replace(rest, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), rest).otherwise(text), F.lit('"'))


def shortest(x: Column) -> Column:
    """The fewest digits that give the double back, with a point or an exponent."""
    size = F.abs(x)
    forms = [F.format_string(f"%.{p}e", size) for p in (14, 15, 16)]
    form = F.when(forms[0].try_cast("double") == size, forms[0]).when(forms[1].try_cast("double") == size, forms[1]).otherwise(forms[2])
    digits = F.regexp_replace(F.replace(F.substring_index(form, "e", 1), F.lit("."), F.lit("")), "0+$", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    power = F.substring_index(form, "e", -1).try_cast("int")
    n = F.length(digits)
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))
    inside = F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, n))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    spelt = F.when(power < 0, below).when(n <= power + 1, whole).otherwise(inside)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n)))
    sign = F.when(power < 0, "-").otherwise("+")
    far = F.concat(mantissa, F.lit("e"), sign, F.when(F.abs(power) < 10, F.lpad(F.abs(power).cast("string"), 2, "0")).otherwise(F.abs(power).cast("string")))
    text = F.when(power.between(SPELT_FROM, SPELT_BELOW - 1), spelt).otherwise(far)
    text = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), F.when(size == 0, "0.0").otherwise(text))
    infinite = F.when(x > 0, "Infinity").otherwise("-Infinity")
    return F.when(x.isNull(), None).when(F.isnan(x), "NaN").when(size == F.lit(float("inf")), infinite).otherwise(text)


def canonical_json(value: Column, kind: T.DataType, sparse: tuple[str, ...] = ()) -> Column:
    """The value as canonical JSON. Fields named in `sparse` are structs that leave out what is null; elsewhere null is null."""
    def struct(v: Column, of: T.StructType, dense: bool) -> Column:
        parts = []
        for f in sorted(of.fields, key=lambda f: f.name):
            inner = F.coalesce(struct(v[f.name], f.dataType, False), F.lit("null")) if f.name in sparse else canonical_json(v[f.name], f.dataType, sparse)
            part = F.concat(F.lit(f'"{f.name}":'), inner)
            parts.append(part if dense else F.when(v[f.name].isNotNull(), part))
        return F.when(v.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    if isinstance(kind, T.StructType):
        text = struct(value, kind, True)
    elif isinstance(kind, T.ArrayType):
        of_one = kind.elementType
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, of_one, sparse)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = shortest(value.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = value.cast("string")
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))
