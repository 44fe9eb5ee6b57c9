"""Evaluation of extraction against gold labels, classification metrics, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.strings import col, f1_of_tokens, norm_str, once, parse_date, parse_float, parse_time, token_f1, tokens

#: Field of a gold label, column of the extraction, kind of comparison. Fixed values.
FIELDS = (
    ("merchant_name", "store", "fuzzy"), ("date", "date", "date"), ("time", "time", "time"), ("subtotal", "subtotal", "float"), ("tax", "tax", "float"),
    ("total", "total", "float"), ("payment_method", "payment_method", "fuzzy"), ("card_last4", "card", "card"), ("receipt_number", "receipt_number", "exact"),
)


def field_score(pred, gold, kind: str = "exact", strict_empty: bool = False) -> Column:
    """1.0, 0.0, or null where gold has no value.

    kinds: exact, float (less than 0.02 apart), time, fuzzy (either text holds the
    other, or token F1 of 0.5), date, card (last four characters). An empty
    prediction is a part of any text, so it scores 1 as fuzzy unless strict_empty.
    """
    p, g = col(pred).cast("string"), col(gold).cast("string")
    none = g.isNull() | (g == "")
    if kind == "float":
        x, y = parse_float(p), parse_float(g)
        good, none = F.coalesce(F.abs(y - x) < 0.02, F.lit(False)), none | y.isNull()
    elif kind == "time":
        good = F.coalesce(parse_time(p) == parse_time(g), F.lit(False)) & (F.coalesce(p, F.lit("")) != "")
    elif kind == "date":
        good = (F.coalesce(p, F.lit("")) != "") & (parse_date(p) == parse_date(g))
    elif kind == "card":
        last = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(4))
        good = last(p) == last(g)
    else:
        x, y = norm_str(p), norm_str(g)
        none = none | (y == "")
        if kind == "fuzzy":
            good = y.contains(x) | x.contains(y) | (token_f1(p, g) >= 0.5)
            if strict_empty:
                good &= x != ""
        else:
            good = x == y
    return F.when(none, F.lit(None).cast("double")).when(good, 1.0).otherwise(0.0)


def match_items(pred: Column, gold: Column, threshold: float = 0.5) -> Column:
    """Struct of precision, recall, f1 of a greedy one-to-one match: each gold name in order takes the best unused prediction, if it reaches the threshold."""
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), tokens)
    start = F.array().cast("array<int>")

    def greedy(pred, gold):
        def take(used, name):
            scored = F.transform(pred, lambda p, i: F.struct(F.when(F.array_contains(used, i), F.lit(-1.0)).otherwise(f1_of_tokens(p, name)).alias("s"), (-i).alias("i")))
            return once(F.array_max(scored), lambda best: F.when(best["s"] >= threshold, F.array_append(used, -best["i"])).otherwise(used))

        return F.size(F.aggregate(gold, start, take)).cast("double")

    def judged(np_, ng, matched):
        p, r = matched / np_, matched / ng
        empty, half = (np_ == 0) & (ng == 0), (np_ == 0) | (ng == 0)
        pick = lambda v: F.when(empty, 1.0).when(half, 0.0).otherwise(v)
        return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))

    # tokens of each name are made once, and each pair of names is compared once
    made = once(F.struct(names(pred).alias("p"), names(gold).alias("g")), lambda t: F.struct(F.size(t["p"]).alias("p"), F.size(t["g"]).alias("g"), greedy(t["p"], t["g"]).alias("matched")))
    return once(made, lambda m: judged(m["p"], m["g"], m["matched"]))


def core_mean(scores: Column) -> Column:
    """Mean of an array without its nulls; 0 if nothing is left."""
    real = F.filter(scores, lambda s: s.isNotNull())
    return F.when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda a, s: a + s) / F.size(real)).otherwise(0.0)


def score_receipts(pred: DataFrame, gold: DataFrame, strict_empty: bool = False) -> DataFrame:
    """One row per receipt with both: field scores (null gold as 0), core_field_mean without them, item scores and overall."""
    p, g = pred.alias("p"), gold.alias("g")
    both = p.join(g, F.col("p.receipt_id") == F.col("g.receipt_id"))
    scores = [field_score(F.col(f"p.{c}"), F.col(f"g.fields.{f}"), kind, strict_empty).alias(f) for f, c, kind in FIELDS]
    items = match_items(F.transform("p.items", lambda i: i["name"]), F.transform("g.items", lambda i: i["name"])).alias("m")
    found = both.select("p.receipt_id", *scores, items, F.size(F.coalesce("p.items", F.array())).alias("pred_item_count"), F.size(F.coalesce("g.items", F.array())).alias("gold_item_count"))
    core = core_mean(F.array(*[f for f, _, _ in FIELDS]))
    return found.withColumn("core_field_mean", core).select(
        "receipt_id", *[F.coalesce(f, F.lit(0.0)).alias(f) for f, _, _ in FIELDS], "core_field_mean",
        F.col("m.precision").alias("item_name_precision"), F.col("m.recall").alias("item_name_recall"), F.col("m.f1").alias("item_name_f1"),
        "pred_item_count", "gold_item_count", (0.7 * F.col("core_field_mean") + 0.3 * F.col("m.f1")).alias("overall_score"),
    )


def summarize_metrics(df: DataFrame, digits: int = 4) -> DataFrame:
    """The mean of every numeric column."""
    numeric = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    return df.agg(*[F.round(F.avg(c), digits).alias(c) for c in numeric])


def _per_class(df: DataFrame, truth: str, pred: str, labels=None) -> DataFrame:
    long = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(truth) == F.col(pred)).cast("int").alias("hit"))
    sums = long.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.t")).alias("tp"))
    if labels is not None:
        wanted = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        sums = wanted.join(sums, "label", "left").fillna(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = sums.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return scored.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def classification_metrics(df: DataFrame, truth: str, pred: str, labels=None) -> DataFrame:
    """One row: accuracy, macro_f1 over the classes of truth or prediction, per_class_f1 (map, over all labels)."""
    per = _per_class(df, truth, pred, labels)
    seen = F.col("support") + F.col("predicted") > 0
    return per.agg(
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg(F.when(seen, F.col("f1"))), 6).alias("macro_f1"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.round("f1", 4).alias("f1"))))).alias("per_class_f1"),
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels) -> DataFrame:
    """One row per true label, one column per predicted label."""
    counts = df.groupBy(F.col(truth).alias("label")).pivot(pred, list(labels)).count()
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return wanted.join(counts, "label", "left").fillna(0)


def classification_report(df: DataFrame, truth: str, pred: str, labels=None) -> DataFrame:
    """Precision, recall, f1 and support of each class, and their macro and weighted averages."""
    per = _per_class(df, truth, pred, labels).select("label", "precision", "recall", "f1", "support")
    means = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in means], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *means, "support")
    weighted = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in means], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *means, "support")
    return per.union(macro).union(weighted).select("label", *[F.round(c, 4).alias(c) for c in means], "support")


def compare_runs(runs: DataFrame) -> DataFrame:
    """(label, model, f1, best): per-class values of every run, and whether a run has the class's best one."""
    long = runs.select("model", F.explode("per_class_f1").alias("label", "f1"))
    return long.withColumn("best", F.rank().over(Window.partitionBy("label").orderBy(F.desc("f1"))) == 1)


def compare_runs_wide(runs: DataFrame, models: list[str]) -> DataFrame:
    long = runs.select("model", F.explode("per_class_f1").alias("label", "f1"))
    return long.groupBy("label").pivot("model", models).agg(F.first("f1"))


def early_stopping(history: DataFrame, patience: int = 3) -> DataFrame:
    """(run, best_epoch, best_f1, stop_epoch) of (run, epoch, val_macro_f1) rows: stop at the patience-th epoch in a row that is no new best, else at the last."""
    order = Window.partitionBy("run").orderBy("epoch")
    before = F.max("val_macro_f1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("best", F.coalesce(F.col("val_macro_f1") > before, F.lit(True)))
    streak = marked.withColumn("block", F.sum(F.col("best").cast("int")).over(order))
    since = F.row_number().over(Window.partitionBy("run", "block").orderBy("epoch")) - 1
    stops = streak.withColumn("since", since)
    stop = stops.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("since") == patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    seen = stops.join(stop, "run").where(F.col("epoch") <= F.col("stop_epoch"))
    best = F.max(F.when(F.col("best"), F.struct("val_macro_f1", (-F.col("epoch")).alias("e"))))
    return seen.groupBy("run").agg(best.alias("b"), F.max("stop_epoch").alias("stop_epoch")).select("run", (-F.col("b.e")).alias("best_epoch"), F.col("b.val_macro_f1").alias("best_f1"), "stop_epoch")
