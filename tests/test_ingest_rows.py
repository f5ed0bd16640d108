"""Ingest keeps rows: repeated order ids, amounts that are no numbers, one-digit dates, quoted line breaks."""
import pytest
from pyspark.sql import functions as F

from parcelwise.sources import merchant_csv as m

COLUMNS = ["Id", "Date", "Phone", "Address", "Pin", "Amount", "Qty", "Weight", "Hour", "Mode", "Status"]
MAPPING = m.Mapping(columns={"order_id": "Id", "ts": "Date", "customer_phone": "Phone", "shipping_address": "Address", "delivery_pin": "Pin", "cart_gmv": "Amount",
                             "items_count": "Qty", "weight_grams": "Weight", "hour_of_day": "Hour", "payment_method": "Mode", "status": "Status"},
                    rto=["RTO"], delivered=["Delivered"], date_format="%d/%m/%Y")


def line(order, phone, date="4/5/2024", amount="100", qty="1", weight="450", hour="9"):
    return (order, date, phone, "1 Road\nTown", "560034", amount, qty, weight, hour, "COD", "Delivered")


def orders(spark, *lines):
    raw = spark.createDataFrame(lines, ", ".join(f"{c} string" for c in COLUMNS))
    return m.normalise_orders(raw, MAPPING), m.ingest_report(raw, MAPPING).first()


def test_repeated_ids_keep_their_rows(spark):
    a, b, c = "9000000001", "9000000002", "9000000003"
    out, report = orders(spark, line("X", a), line("X", b), line("Y", c), line("Y", c, amount="50"))
    rows = out.select("order_id", "phone", "seq", "is_new_customer").collect()
    assert len(rows) == report["rows_out"] == 4 and len({r["seq"] for r in rows}) == 4
    assert sum(r["is_new_customer"] for r in rows) == 3
    assert sorted(r["seq"] for r in rows) == ["X", "X#2", "Y", "Y#2"]


@pytest.mark.parametrize("amount", ["nan", "Infinity", "-Infinity", "abc", ""])
def test_amounts_that_are_no_numbers_drop_the_row(spark, amount):
    out, report = orders(spark, line("X", "9000000001", amount=amount))
    assert out.count() == 0 and report["bad_amount_or_pin"] == 1


def test_cells_that_are_no_numbers_take_the_default(spark):
    out, _ = orders(spark, line("X", "9000000001", qty="9999999999", weight="nan", hour="inf"), line("Y", "9000000002", qty="nan", weight="-inf", hour="99999999999"))
    assert [tuple(r) for r in out.select("items_count", "weight_grams", "hour_of_day").collect()] == [(1, 450.0, 0)] * 2


def test_dates(spark):
    df = spark.createDataFrame([("4/5/2024 3:07 PM", "4 May 2024", "2024-05-04T15:07:00")], "a string, b string, c string")
    got = df.select(*[F.date_format(m.parse_date(F.col(c), f), "yyyy-MM-dd HH:mm").alias(c)
                      for c, f in (("a", "%d/%m/%Y %I:%M %p"), ("b", "%d %b %Y"), ("c", "%Y-%m-%dT%H:%M:%S"))]).first()
    assert tuple(got) == ("2024-05-04 15:07", "2024-05-04 00:00", "2024-05-04 15:07")
    with pytest.raises(ValueError, match="%U"):
        m.spark_date_format("%Y-%U")


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(",".join(COLUMNS) + '\nX,04/05/2024,9000000001,"1 Road\nTown",560034,10,1,450,9,COD,RTO\nY,4/5/2024,9000000002,"2 ""A"" Road",560034,20,1,450,9,COD,Delivered\n')
    raw = m.read_export(spark, str(path), MAPPING)
    assert sorted(r["shipping_address"] for r in m.normalise_orders(raw, MAPPING).collect()) == ["1 Road\nTown", '2 "A" Road']
