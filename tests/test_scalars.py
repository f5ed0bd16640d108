import hashlib
import re

import pytest

from parcelwise.functions import address as A
from parcelwise.functions import text
from parcelwise.functions.pincodes import with_pin_info
from parcelwise.operators import decide, pit, response
from pyspark.sql import functions as F

DOCS = "/root/testdata/sf0.001/documents.parquet"


def scored(spark, rows):
    df = spark.createDataFrame(rows, "shipping_address string, delivery_pin string")
    return {r["shipping_address"]: r for r in A.score_addresses(df).collect()}


def test_address_defects_rank_sensibly(spark):
    good, landmark, junk, wrong = ("Flat 402, Prestige Lakeside, Whitefield, Bengaluru 560066", "Near Hanuman Temple, Ward 4", "asdf",
                                   "12, MG Road, Mumbai, Maharashtra 400001")
    got = scored(spark, [(good, "560066"), (landmark, "845401"), (junk, "110001"), (wrong, "560001")])
    assert got[good]["addr_defect_score"] < got[landmark]["addr_defect_score"] < got[junk]["addr_defect_score"]
    assert got[good]["addr_has_house_no"] and not got[landmark]["addr_has_house_no"]
    assert got[landmark]["addr_landmark_only"] and got[junk]["addr_junk"]
    assert got[wrong]["addr_state_mismatch"] and got[wrong]["addr_pin_mismatch"]


def test_address_flags_equal_python_on_whole_documents(spark):
    """Accented prose of any length: the JVM patterns must read Unicode the way Python does."""
    docs = spark.read.parquet(DOCS).select("doc_id", F.col("text").alias("shipping_address"), F.lit("560034").alias("delivery_pin"))
    got = {r["doc_id"]: r for r in A.score_addresses(docs).collect()}
    places = sorted(A.STATE_OF_PLACE, key=len, reverse=True)
    for r in docs.collect():
        t = (r["shipping_address"] or "").strip(text.BLANKS)
        g, low = got[r["doc_id"]], t.lower()
        found = lambda p: bool(re.search(p, t, re.I))
        tokens = len([x for x in re.split(r"[\s,]+", low) if x])
        house = found(A.HOUSE)
        assert g["addr_has_house_no"] == house
        assert g["addr_has_street_anchor"] == found(A.STREET)
        assert g["addr_landmark_only"] == (found(A.LANDMARK) and not house)
        assert g["addr_vague_only"] == (not house and found(A.VAGUE) and tokens <= 8)
        assert g["addr_junk"] == (found(A.REPEATED) or found(A.PLACEHOLDER) or tokens == 0)
        assert g["addr_pin_mismatch"] == any(p != "560034" for p in re.findall(A.PIN_IN_TEXT, t))
        assert g["addr_state_mismatch"] == any(re.search(rf"\b{p}\b", low) and A.STATE_OF_PLACE[p] != "Karnataka" for p in places)


def test_pin_hierarchy(spark):
    df = spark.createDataFrame([("560034",), ("845401",), ("12",), ("562123",), ("991234",), ("060034",)], "delivery_pin string")
    got = {r["delivery_pin"]: r for r in with_pin_info(df).collect()}
    assert (got["560034"]["pin_tier"], got["560034"]["pin_state"]) == (1, "Karnataka")
    assert (got["845401"]["pin_tier"], got["845401"]["pin_state"]) == (4, "Bihar")
    assert not got["12"]["pin_valid"] and (got["12"]["pin_tier"], got["12"]["pin_rto_prior"]) == (4, 0.40)
    assert got["562123"]["pin_valid"] and got["562123"]["pin_tier"] == 3
    assert got["991234"]["pin_tier"] == 4 and not got["991234"]["pin_valid"] and not got["060034"]["pin_valid"]


def test_hashes_are_stable_and_hide_the_value(spark):
    df = spark.createDataFrame([(" 9876543210 ",), ("9876543210",), (None,), ("",)], "v string")
    h = [r["h"] for r in df.select(text.entity_hash("phone", F.col("v")).alias("h")).collect()]
    assert h[0] == h[1] and len(h[0]) == 16 and "9876" not in h[0] and h[2] == h[3]
    assert h[1] == hashlib.sha256(f"{text.HASH_SALT}|phone|9876543210".encode()).hexdigest()[:16]


def test_draw_is_the_hash_fraction_and_hits_its_rate(spark):
    df = spark.range(40000).select(F.concat(F.lit("ord_"), "id").alias("k")).withColumn("u", text.uniform_draw(F.col("k")))
    rows = df.collect()
    assert abs(sum(r["u"] < 0.02 for r in rows) / 40000 - 0.02) < 0.004
    for r in rows[:200]:
        assert r["u"] == int.from_bytes(hashlib.sha256(r["k"].encode()).digest()[:8], "big") / 2**64


def test_segment_keys(spark):
    df = spark.createDataFrame([("META_ADS", 4, 2899.0), ("organic", 1, 499.0), ("GOOGLE_ADS", 2, 1500.0)], "c string, t int, g double")
    assert [r["s"] for r in df.select(response.segment_key(F.col("c"), F.col("t"), F.col("g")).alias("s")).collect()] == \
        ["SOCIAL|T4|high", "ORGANIC|T1|low", "SEARCH|T2|mid"]


def test_reason_codes_cover_the_features_in_order_and_share_one_code(spark):
    assert tuple(f for f, _, _ in decide.REASON_CODES) == pit.FEATURE_NAMES
    df = spark.createDataFrame([("o", 0.7, 0.6, 0.0, 12.0, 1.0)], "id string, hour_sin double, hour_cos double, addr_has_house_no double, phone_first_seen_days double, coupon_applied double")
    rows = decide.reason_codes(df, {"hour_sin": F.lit(0.4), "hour_cos": F.lit(-0.6), "addr_has_house_no": F.lit(0.2), "phone_first_seen_days": F.lit(-0.1),
                                    "coupon_applied": F.lit(0.01)}, ["id"]).orderBy("rank").collect()
    assert [(r["code"], r["feature"], r["direction"]) for r in rows] == [
        ("RSK_ODD_HOUR", "hour_cos", "RISK_DOWN"), ("RSK_ADDR_NO_HOUSE_NO", "addr_has_house_no", "RISK_UP"), ("RSK_NEW_CUSTOMER", "phone_first_seen_days", "RISK_DOWN")]
    assert rows[1]["human"] == "No house / flat number in address" and rows[2]["human"] == "Phone tenure 12 days"


def test_payment_fallback(spark):
    df = spark.createDataFrame([("CARD_FAILED", True), ("upi", True), (None, False), ("COD", False)], "s string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", pit.payment_fallback(F.col("s")).alias("got")).collect())


@pytest.mark.parametrize("raw,want", [("+91 98765 43210", "9876543210"), ("43210", "43210"), ("0-98765-43210", "9876543210")])
def test_phone_digits(spark, raw, want):
    assert spark.range(1).select(text.phone_digits(F.lit(raw)).alias("p")).first()["p"] == want


def test_reason_codes_choose_within_a_code_before_they_sort(spark):
    df = spark.createDataFrame([(1, 0.2, -0.9, 0.3), (2, 0.5, 0.5, 0.01), (3, None, 0.4, None)], "order_id int, hour_sin double, hour_cos double, is_cod double")
    rows = decide.reason_codes(df, {c: F.col(c) for c in ("hour_sin", "hour_cos", "is_cod")}, ["order_id"])
    got = sorted((r["order_id"], r["rank"], r["code"], r["feature"], r["contribution"]) for r in rows.collect())
    assert got == [(1, 1, "RSK_ODD_HOUR", "hour_cos", -0.9), (1, 2, "RSK_COD", "is_cod", 0.3), (2, 1, "RSK_ODD_HOUR", "hour_sin", 0.5), (3, 1, "RSK_ODD_HOUR", "hour_cos", 0.4)]
    assert "exists(" not in rows._jdf.queryExecution().optimizedPlan().toString()
