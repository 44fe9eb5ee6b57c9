"""Golden cases of string functions and of receipt extraction."""

import pytest
from pyspark.sql import functions as F

from tillwork.functions import receipts as R
from tillwork.functions import strings as S

RECEIPT = """FRESH MART #12
123 MAIN ST
01/05/2024 14:32:10
CHK BRST BNLS  12.99
OLIVE OIL  1,008.50
CASHEWS  6.49
SUBTOTAL 1,027.98
TAX 10.00
TOTAL 1,037.98
VISA 4111111111111234
AMOUNT TENDERED 1,100.00
REF# A1B2C3"""


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first().v


def test_every_field(spark):
    got = R.extract_receipts(spark.createDataFrame([("r", RECEIPT)], "receipt_id string, text string")).first()
    assert (got.store, got.date, got.time, got.subtotal, got.tax, got.total) == ("FRESH MART #12", "2024-01-05", "14:32:10", 1027.98, 10.0, 1100.0)
    assert (got.card, got.payment_method, got.receipt_number) == ("4111", "VISA", "A1B2C3")
    assert [tuple(i) for i in got["items"]] == [("CHK BRST BNLS", "12.99"), ("OLIVE OIL", "1,008.50")]
    fixed = R.extract_receipts(spark.createDataFrame([("r", RECEIPT)], "receipt_id string, text string"), total_rule="last_total").first()
    assert fixed.total == 1037.98


@pytest.mark.parametrize("text", [None, "", "\n \n"])
def test_nothing_to_extract(spark, text):
    got = R.extract_receipts(spark.createDataFrame([("r", text)], "receipt_id string, text string")).first()
    assert (got.store, got.date, got.time, got.card, got.payment_method, got.receipt_number) == ("UNKNOWN", "", "", "cash", "", "")
    assert (got.subtotal, got.tax, got.total, got["items"]) == (None, None, None, [])


@pytest.mark.parametrize(("text", "date"), [("1/5/70", "1970-01-05"), ("1/5/68", "2068-01-05"), ("13/05/2024", ""), ("SEPT 5 2024", ""), ("Sep 5, 2024", "2024-09-05"), ("5 march 2023", "2023-03-05"), ("x 2024-02-30 3-4-2021", "2021-03-04")])
def test_dates(spark, text, date):
    assert one(spark, R.extract_date("t"), t=text) == date


@pytest.mark.parametrize(("text", "time"), [("14:32", ""), ("at 2:32 PM", "2:32 PM"), ("14:32:10 2:00 pm", "2:00 pm")])
def test_times(spark, text, time):
    assert one(spark, R.extract_time("t"), t=text) == time


def test_receipt_number_crosses_lines(spark):
    assert one(spark, R.extract_receipt_number("t"), t="RECEIPT\nTHANKYOU") == "THANKYOU"


@pytest.mark.parametrize(
    ("a", "b", "ratio"),
    [("WALMART", "WAL-MART", 0.9333), ("TRADER JOE'S", "TRADER JOES", 0.9565), ("COSTCO", "COSTCO WHSE", 0.7059), ("WALMART", "WALMART SUPERCENTER", 0.5385), ("TARGET", "COSTCO", 0.1667), ("", "X", 0.0), (None, None, 0.0)],
)
def test_lcs_ratio(spark, a, b, ratio):
    assert one(spark, F.round(S.lcs_ratio("a", "b"), 4), a=a, b=b) == ratio == one(spark, F.round(S.lcs_ratio("b", "a"), 4), a=a, b=b)


@pytest.mark.parametrize(("p", "g", "f1"), [("WHOLE MILK", "milk whole", 1.0), ("MILK MILK", "MILK", 0.6667), ("ORG BANANA", "BANANAS", 0.0), ("BREAD", "", 0.0)])
def test_token_f1(spark, p, g, f1):
    assert one(spark, F.round(S.token_f1("p", "g"), 4), p=p, g=g) == f1


def test_grams(spark):
    assert one(spark, S.char_wb_grams("t"), t="a") == [" a", "a ", " a "]
    assert one(spark, S.char_wb_grams("t"), t="ab") == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert one(spark, S.char_wb_grams("t"), t="") == []


@pytest.mark.parametrize(("c", "route"), [(0.85, "auto"), (0.849999, "verify"), (0.60, "verify"), (0.599999, "human")])
def test_routing(spark, c, route):
    assert spark.range(1).select(S.route(F.lit(c)).alias("r")).first().r == route


def test_parsers(spark):
    assert one(spark, S.parse_date("t"), t=" 3/4/21 ") == "2021-03-04" and one(spark, S.parse_date("t"), t="n/a ") == "n/a"
    assert one(spark, S.parse_time("t"), t="2:05 pm") == "14:05" and one(spark, S.parse_time("t"), t="noon") == "NOON"
    assert one(spark, S.parse_float("t"), t="1,234.567") == 1234.57 and one(spark, S.parse_float("t"), t="x") is None
    assert one(spark, S.norm_str("t"), t=" a-b 1! ") == "AB 1" and one(spark, S.norm_str("t"), t=None) == ""
    assert one(spark, S.strip("t"), t="  a \t") == "a"


def test_scalars(spark):
    shown = lambda v, n, k: spark.range(1).select(S.format_scalar(F.lit(v).cast(k), n, k).alias("v")).first().v
    assert shown(1234.5, "total", "double") == "$1,234.50" and shown(1234567, "n", "bigint") == "1,234,567"
    assert shown(0.25, "share", "double") == "0.25" and shown(None, "total", "double") == "No data found." == shown(float("nan"), "x", "double")
