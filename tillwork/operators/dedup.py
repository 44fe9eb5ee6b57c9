"""Duplicate bills: equal image hash, or equal date and total with a similar store name; and serial numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.folders import saved
from tillwork.functions.strings import can_reach, lcs_ratio, strip

THRESHOLD = 0.85


#: What content layers compare: bills of equal _CONTENT are alike one by one, and are one row.
_CONTENT = ["date", "total", "store", "number"]
_OTHER = ["date", "total", "other", "other_number"]


def _keyed(bills: DataFrame) -> DataFrame:
    store = strip(F.upper(F.coalesce("store", F.lit(""))))
    number = strip(F.coalesce("receipt_number", F.lit(""))) if "receipt_number" in bills.columns else F.lit("")
    return bills.select("bill_id", F.nullif("image_hash", F.lit("")).alias("image_hash"), "date", "total", store.alias("store"), number.alias("number"))


def _contents(a: DataFrame) -> DataFrame:
    return a.where("date is not null and total is not null").select(*_CONTENT).distinct()


def _others(a: DataFrame, value: Column) -> DataFrame:
    """A value for each content of a, under the names that the right side of a pair has."""
    return a.groupBy("date", "total", F.col("store").alias("other"), F.col("number").alias("other_number")).agg(value)


def _alike(threshold: float) -> Column:
    """Whether the stores of x and y are alike enough; equal ones that aren't empty are, without a look at their letters."""
    same = (F.col("x.store") == F.col("y.store")) & (F.col("x.store") != "")
    return F.when(same, True).when(can_reach("x.store", "y.store", threshold), lcs_ratio("x.store", "y.store") >= threshold).otherwise(False)


def _meeting(a: DataFrame, b: DataFrame, threshold: float, numbers: bool, once: bool = False) -> DataFrame:
    """Contents of a and b with equal date and total and stores alike enough, of which no two state different receipt numbers.

    Two that state a number meet by it, so that a day's many bills of one total don't all meet. once: every two different contents in one order only.
    """

    def met(left, right, by_number):
        x, y = left.alias("x"), right.alias("y")
        on = (F.col("x.date") == F.col("y.date")) & (F.col("x.total") == F.col("y.total"))
        if by_number:
            on &= F.col("x.number") == F.col("y.number")
        if once:
            on &= F.struct("x.store", "x.number") < F.struct("y.store", "y.number")
        near = x.join(y, on).where(_alike(threshold))
        return near.select("x.date", "x.total", "x.store", "x.number", F.col("y.store").alias("other"), F.col("y.number").alias("other_number"))

    found = met(a, b, True)
    if numbers:  # those without a number meet those with one
        found = found.unionByName(met(a.where("number = ''"), b.where("number <> ''"), False)).unionByName(met(a.where("number <> ''"), b.where("number = ''"), False))
    return found


def _similar(a: DataFrame, b: DataFrame, threshold: float, numbers: bool) -> DataFrame:
    """Pairs of contents of a and b that are alike. Bills of equal content are one row each, so copies make no pairs."""
    return _meeting(_contents(a), _contents(b), threshold, numbers)


def _similar_within(a: DataFrame, threshold: float, numbers: bool) -> DataFrame:
    """_similar of a table with itself: every two different contents are compared once and count both ways."""
    one = _contents(a)
    near = _meeting(one, one, threshold, numbers, once=True)
    turned = near.select("date", "total", F.col("other").alias("store"), F.col("other_number").alias("number"), F.col("store").alias("other"), F.col("number").alias("other_number"))
    own = one.where("store <> ''").select(*_CONTENT, F.col("store").alias("other"), F.col("number").alias("other_number"))
    return near.unionByName(turned).unionByName(own)


def _least(*columns) -> Column:
    return F.array_min(F.array(*columns))


def find_duplicates(new: DataFrame, history: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(bill_id, dup_of, layer) of new bills: the first matching row of history in the order of bill_id, whatever its layer.

    Where the bills have a column receipt_number, two that state different numbers are two purchases and not alike in content; null and empty ones state none.
    """
    a, b = _keyed(new), _keyed(history)
    hashed = b.where("image_hash is not null").groupBy("image_hash").agg(F.min("bill_id").alias("by_hash"))
    firsts = _others(b, F.min("bill_id").alias("first"))
    numbers = "receipt_number" in new.columns or "receipt_number" in history.columns
    content = _similar(a, b, threshold, numbers).join(firsts, _OTHER).groupBy(*_CONTENT).agg(F.min("first").alias("by_content"))
    both = a.join(hashed, "image_hash", "left").join(content, _CONTENT, "left")
    dup = _least("by_hash", "by_content")
    return both.where(dup.isNotNull()).select("bill_id", dup.alias("dup_of"), F.when(F.col("by_hash") == dup, "hash").otherwise("content").alias("layer"))


def resolve_batch(bills: DataFrame, history: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(bill_id, accepted, dup_of, layer): bills in order, each compared with history and with accepted earlier bills only.

    A bill is accepted if no earlier match is. Receipt numbers tell bills apart as in find_duplicates. Each round finds, for every hash and
    every content with those like it, the first accepted bill and the
    first open one; a bill whose first accepted match comes before any open one is
    rejected, and one without earlier matches of either sort is accepted. There are
    as many rounds as the longest chain of duplicates; groups of any size are
    reduced to two numbers a round, and a round reads and writes open bills only.
    """
    keyed = saved(_keyed(bills).withColumn("bill_id", F.col("bill_id").cast("bigint")))
    similar = saved(_similar_within(keyed, threshold, "receipt_number" in bills.columns))
    none = [F.lit(None).cast("bigint").alias("dup_of"), F.lit(None).cast("string").alias("layer")]
    ended = []
    state = keyed.select("*", *none)
    if history is not None:
        state = saved(keyed.join(find_duplicates(bills, history, threshold), "bill_id", "left"))
        ended.append(state.where("dup_of is not null").select("bill_id", F.lit(False).alias("accepted"), "dup_of", "layer"))
        state = state.where("dup_of is null")
    # the first accepted bill of each hash and of each content
    hashes = keyed.select("image_hash", F.col("bill_id").alias("hit")).limit(0)
    contents = _others(keyed.limit(0), F.min("bill_id").alias("hit"))
    while state.take(1):
        wait = F.min("bill_id").alias("wait")
        by_hash = state.where("image_hash is not null").groupBy("image_hash").agg(wait).join(hashes, "image_hash", "left").select("image_hash", F.col("hit").alias("h_hit"), F.col("wait").alias("h_wait"))
        groups = _others(state, wait).join(contents, _OTHER, "full")
        by_content = similar.join(groups, _OTHER).groupBy(*_CONTENT).agg(F.min("hit").alias("c_hit"), F.min("wait").alias("c_wait"))
        seen = state.join(by_hash, "image_hash", "left").join(by_content, _CONTENT, "left")
        earlier = lambda c: F.when(F.col(c) < F.col("bill_id"), F.col(c))
        hit, wait = _least(earlier("h_hit"), earlier("c_hit")), _least(earlier("h_wait"), earlier("c_wait"))
        judged = seen.withColumn("__hit", hit).withColumn("__wait", wait)
        lost = F.col("__hit").isNotNull() & (F.col("__wait").isNull() | (F.col("__wait") > F.col("__hit")))
        won = F.col("__hit").isNull() & F.col("__wait").isNull()
        state = saved(judged.select(
            *keyed.columns,
            F.when(lost, False).when(won, True).alias("accepted"),
            F.when(lost, F.col("__hit")).alias("dup_of"),
            F.when(lost, F.when(F.col("h_hit") == F.col("__hit"), "hash").otherwise("content")).alias("layer"),
        ))
        ended.append(state.where("accepted is not null").select("bill_id", "accepted", "dup_of", "layer"))
        kept = state.where("accepted")
        hit = F.min("hit").alias("hit")
        hashes = saved(hashes.unionByName(kept.where("image_hash is not null").select("image_hash", F.col("bill_id").alias("hit"))).groupBy("image_hash").agg(hit))
        contents = saved(contents.unionByName(_others(kept, F.min("bill_id").alias("hit"))).groupBy(*_OTHER).agg(hit))
        state = state.where("accepted is null").select(*keyed.columns, *none)
    out = bills.sparkSession.createDataFrame([], "bill_id bigint, accepted boolean, dup_of bigint, layer string")
    for part in ended:
        out = out.unionByName(part)
    return out


def drop_known_hashes(new: DataFrame, history: DataFrame) -> DataFrame:
    """New bills whose image is not in history, the first of each image. Bills without one all stay and take no part in the shuffle."""
    blank = F.coalesce("image_hash", F.lit("")) == ""
    first = Window.partitionBy("image_hash").orderBy("bill_id")
    fresh = new.where(~blank).join(history.where("image_hash <> ''").select("image_hash").distinct(), "image_hash", "left_anti")
    one = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return new.where(blank).unionByName(one.select(new.columns))


def next_serial(history: DataFrame, column: str = "serial_no") -> DataFrame:
    """One row: the serial number after the greatest; 1 for an empty table, rows + 1 if none is a number."""
    top = F.max(F.col(column).try_cast("bigint"))
    return history.agg(F.when(F.count("*") == 0, F.lit(1)).otherwise(F.coalesce(top + 1, F.count("*") + 1)).cast("bigint").alias("next_serial"))


def assign_serials(bills: DataFrame, history: DataFrame) -> DataFrame:
    """bills with serial_no: the greatest of history plus their place in the order of bill_id.

    Places come from a count of each range partition and a running number within it, not from one task that numbers all rows.
    """
    start = next_serial(history).first()["next_serial"]
    sorted_ = bills.repartitionByRange("bill_id").sortWithinPartitions("bill_id").withColumn("__p", F.spark_partition_id())
    held = saved(sorted_)
    counts = held.groupBy("__p").agg(F.count("*").alias("n"))
    before = counts.select("__p", (F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy("bill_id"))
    return held.withColumn("__n", place).join(before, "__p").withColumn("serial_no", F.lit(start) - 1 + F.coalesce("before", F.lit(0)) + F.col("__n")).drop("__p", "__n", "before")
