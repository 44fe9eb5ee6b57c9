"""Training-set engineering: filters, seeded splits and caps, class counts and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.folders import saved

#: The 16 classes, in alphabetical order. Fixed values.
LABELS = (
    "Bakery & Flour", "Beverages", "Dairy", "Frozen / Processed", "Fruits", "Grains & Staples", "Herbs", "Meat", "Oils & Fats",
    "Poultry", "Pulses & Beans", "Sauces & Condiments", "Seafood", "Snacks & Ready-to-Eat", "Spices & Seasonings", "Vegetables",
)


def filter_training_rows(df: DataFrame, label: str, text: str, confidence: str = "confidence", keep=("high", "medium"), drop_label: str = "Other") -> DataFrame:
    """Rows with text and label, of sufficient confidence, without the catch-all label."""
    return df.dropna(subset=[text, label]).where(F.col(confidence).isin(*keep)).where(F.col(label) != drop_label)


def check_labels(df: DataFrame, label: str, expected: int = len(LABELS)) -> DataFrame:
    """One row: the number of classes and whether it is the expected one."""
    return df.agg(F.count_distinct(label).alias("classes")).withColumn("ok", F.col("classes") == expected)


def seeded_order(key: str, seed: int = 42) -> Column:
    """A shuffle order that any engine can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _placed(df: DataFrame, groups: list[str], key: str, seed: int) -> DataFrame:
    """df with __place (from 0, in seeded order) and __n within its group, by counts of range partitions; no task takes a whole group."""
    order = seeded_order(key, seed)
    dealt = saved(df.withColumn("__order", order).repartitionByRange(*groups, "__order", key).withColumn("__p", F.spark_partition_id()), "places")
    counts = dealt.groupBy(*groups, "__p").agg(F.count("*").alias("__m"))  # a row for each group and partition
    group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__m").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*groups, "__p", before.alias("__before"), F.sum("__m").over(group).alias("__n"))
    here = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*groups, "__p").orderBy("__order", key)))
    same = (here["__p"] == counts["__p"]) & here[groups[0]].eqNullSafe(counts[groups[0]])
    for g in groups[1:]:
        same &= here[g].eqNullSafe(counts[g])
    placed = here.join(counts, same).select(*[here[c] for c in df.columns], (F.col("__row") + F.col("__before") - 1).alias("__place"), counts["__n"])
    return placed


def stratified_split(df: DataFrame, label: str, key: str, ratios=(0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """df with split (train, val, test) by shares within each label, in seeded order."""
    marked = _placed(df, [label], key, seed)
    train = F.floor(F.col("__n") * F.lit(ratios[0]) + 1e-9)
    val = F.floor(F.col("__n") * F.lit(ratios[0] + ratios[1]) + 1e-9)
    split = F.when(F.col("__place") < train, "train").when(F.col("__place") < val, "val").otherwise("test")
    return marked.withColumn("split", split).drop("__place", "__n")


#: Hexadecimal digits of the seeded order by which a class's rows are counted: 65,536 counts a class at most.
_DIGITS = 4


def cap_per_class(df: DataFrame, label: str, key: str, cap: int = 8000, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each label, the first in seeded order.

    A histogram of the order's first digits gives each class the digits at which it is full. Rows before them stay, rows
    after them go, and only the few rows on them are sorted, so no task sorts a class.
    """
    digits = F.substring("__order", 1, _DIGITS)
    marked = df.withColumn("__order", seeded_order(key, seed)).withColumn("__digits", digits)
    counts = marked.groupBy(F.col(label).alias("__label"), "__digits").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__label").orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = counts.withColumn("__before", before).where((F.col("__before") <= cap) & (F.col("__before") + F.col("__n") > cap))
    edges = saved(full.select("__label", F.col("__digits").alias("__edge"), (cap - F.col("__before")).alias("__room")), "caps")  # a row a class
    met = marked.join(edges, marked[label].eqNullSafe(edges["__label"]), "left")
    whole = met.where(F.col("__edge").isNull() | (F.col("__digits") < F.col("__edge"))).select(df.columns)
    place = F.row_number().over(Window.partitionBy(label, "__digits").orderBy("__order", key))
    edge = met.where(F.col("__digits") == F.col("__edge")).withColumn("__place", place).where("__place <= __room").select(df.columns)
    return whole.unionByName(edge)


def class_counts(df: DataFrame, label: str, split: str, splits=("train", "val", "test"), least: int = 30) -> DataFrame:
    """Rows of each label by split, in total, and whether every split has at least ``least``."""
    counts = [F.count(F.when(F.col(split) == s, 1)).alias(s) for s in splits]
    out = df.groupBy(label).agg(*counts, F.count("*").alias("total"))
    return out.withColumn("enough", F.least(*splits) >= least)


def imbalance(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """One row per label: rows before and after, removed, kept percent, and the ratios of largest to smallest class."""
    b, a = (df.groupBy(label).agg(F.count("*").alias(n)) for df, n in ((before, "before"), (after, "after")))
    both = b.join(a, label, "full").select(label, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    ratio = both.agg((F.max("before") / F.min(F.when(F.col("before") > 0, F.col("before")))).alias("ratio_before"), (F.max("after") / F.min(F.when(F.col("after") > 0, F.col("after")))).alias("ratio_after"))
    made = both.withColumn("removed", F.col("before") - F.col("after")).withColumn("kept_percent", F.round(100 * F.col("after") / F.when(F.col("before") > 0, F.col("before")), 2))
    return made.join(F.broadcast(ratio)).withColumns({c: F.round(c, 4) for c in ("ratio_before", "ratio_after")})  # one row


def class_weights(df: DataFrame, label: str, labels=None) -> DataFrame:
    """(label, n, weight) with weight N / (K n), n taken as 1 for a class without rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if labels is not None:
        wanted = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        counts = wanted.join(counts, "label", "left")
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    n = F.coalesce("n", F.lit(1))
    return counts.join(F.broadcast(total)).select("label", n.alias("n"), F.round(F.col("all") / (F.col("k") * n), 6).alias("weight"))  # one row


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """(label, id) in alphabetical order from 0. Distinct labels only are numbered."""
    one = df.select(F.col(label).alias("label")).where("label is not null").distinct()
    return one.withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)


def prepare(df: DataFrame, label: str, text: str, key: str, cap: int = 8000, seed: int = 42, **filters) -> DataFrame:
    """Filtered rows with split, and downsampled: whether a training row is among its class's first ``cap``."""
    split = stratified_split(filter_training_rows(df, label, text, **filters), label, key, seed=seed)
    placed = _placed(split, [label, "split"], key, seed)
    return placed.withColumn("downsampled", (F.col("split") == "train") & (F.col("__place") < cap)).drop("__place", "__n")
