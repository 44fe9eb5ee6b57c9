"""Spend questions at the right grain: a bill's total counts once, whatever its number of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BILL_COLUMNS = ("serial_no", "bill_file", "store_name", "invoice_date", "total", "card_used", "received_at", "sender", "image_hash")


def bills_of(items: DataFrame) -> DataFrame:
    """One row per serial number with item_count; bill columns are the same on all its rows, so any row's value stands."""
    held = [c for c in BILL_COLUMNS if c in items.columns and c != "serial_no"]
    return items.groupBy("serial_no").agg(*[F.min(c).alias(c) for c in held], F.count(F.when(F.col("item_name") != "Unknown", 1)).alias("item_count"))


def spend_by(df: DataFrame, dims: list, start=None, end=None, grain: str = "bill", date: str = "invoice_date") -> DataFrame:
    """Spend and count by dimensions, of bills (total) or items (item_price), with start <= date < end. df has item rows."""
    rows, amount = (bills_of(df), "total") if grain == "bill" else (df, "item_price")
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col(date) < F.lit(end).cast("date"))
    measures = [F.sum(amount).alias("spend"), F.count("*").alias("n")]
    return rows.groupBy(*dims).agg(*measures) if dims else rows.agg(*measures)


def month(date: str = "invoice_date") -> Column:
    return F.date_format(F.trunc(date, "month"), "yyyy-MM")


def last_month(df: DataFrame, today: str) -> DataFrame:
    """One row: spend and bills of the calendar month before the one of today."""
    first = F.trunc(F.lit(today).cast("date"), "month")
    some = bills_of(df).where((F.col("invoice_date") >= F.add_months(first, -1)) & (F.col("invoice_date") < first))
    return some.agg(F.sum("total").alias("spend"), F.count("*").alias("bills"))


def last_week(df: DataFrame, today: str) -> DataFrame:
    """One row: spend and bills of the seven days up to today."""
    day = F.lit(today).cast("date")
    some = bills_of(df).where((F.col("invoice_date") > F.date_sub(day, 7)) & (F.col("invoice_date") <= day))
    return some.agg(F.sum("total").alias("spend"), F.count("*").alias("bills"))


def category_spend(df: DataFrame, pattern: str) -> DataFrame:
    """One row: spend and items of the categories that hold the pattern, at item grain."""
    some = df.where(F.lower("grocery_category").contains(pattern.lower()))
    return some.agg(F.sum("item_price").alias("spend"), F.count("*").alias("items"))


def most_visited(df: DataFrame, n: int = 1) -> DataFrame:
    """The n stores of most bills, ties to the alphabetically first."""
    return bills_of(df).groupBy("store_name").agg(F.count("*").alias("visits"), F.sum("total").alias("spend")).orderBy(F.desc("visits"), "store_name").limit(n)


def running_spend(df: DataFrame) -> DataFrame:
    """Spend of every month and the running sum within each store."""
    monthly = bills_of(df).groupBy("store_name", month().alias("month")).agg(F.sum("total").alias("spend"))
    w = Window.partitionBy("store_name").orderBy("month")
    return monthly.withColumn("running", F.sum("spend").over(w))


def category_cube(df: DataFrame) -> DataFrame:
    """Item spend by category and month with every subtotal."""
    rows = df.select(F.col("grocery_category").alias("category"), month().alias("month"), "item_price")
    return rows.cube("category", "month").agg(F.sum("item_price").alias("spend"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
