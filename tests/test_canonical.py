"""Canonical JSON against Python's own serialiser."""
import json
import random
import struct

from pyspark.sql import functions as F

from parcelwise.functions.canonical import canonical_json, quoted, shortest


def test_numbers_have_the_fewest_digits(spark):
    r = random.Random(4)
    some = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(1500)] + [round(r.uniform(0, 1e5), 2) for _ in range(1000)]
    some = [x for x in some if x == x and abs(x) > 1e-300 and abs(x) != float("inf")]
    fixed = [0.0, -0.0, 1.0, 0.1, 1e15, 1e16, 1e22, 1e23, 1e-4, 1e-5, 9.999e-5, 100.0, -7.25, 2 / 3, 123456789012345680.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in fixed + some], "x double").select("x", shortest(F.col("x")).alias("t"))
    assert [(r["x"], r["t"]) for r in df.collect() if r["t"] != json.dumps(r["x"])] == []


def test_strings_are_escaped(spark):
    texts = ["", "plain", 'q"\\/', "é漢 …", "".join(map(chr, range(40))), "\x7f"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", quoted(F.col("x")).alias("t"))
    assert [r["t"] for r in df.collect()] == [json.dumps(x, ensure_ascii=False) for x in texts]


def test_keys_are_sorted_at_every_level(spark):
    schema = "z long, a struct<y: array<struct<k: boolean, b: double>>, c: string>, m struct<q: string, p: string>"
    rows = [(1, ([(True, 0.5), (None, None)], "x"), (None, "1")), (None, ([], None), ("2", None)), (3, None, None)]
    df = spark.createDataFrame(rows, schema).select(F.struct("z", "a", "m").alias("v"))
    out = [r[0] for r in df.select(canonical_json(F.col("v"), df.schema["v"].dataType, ("m",))).collect()]
    assert out == ['{"a":{"c":"x","y":[{"b":0.5,"k":true},{"b":null,"k":null}]},"m":{"p":"1"},"z":1}', '{"a":{"c":null,"y":[]},"m":{"q":"2"},"z":null}', '{"a":null,"m":null,"z":3}']
