"""Training of a linear text classifier in epochs, the best of which by validation macro-F1 is kept.

Rows become sparse vectors of hashed character 3-grams once, weighted by inverse
document frequency, and are saved. An epoch begins with the weights of the one
before: every task of Spark improves a copy of them over its rows, and the means
of the copies are the epoch's weights. Weights are classes times features, a
parameter's size whatever the table holds. Each epoch is judged on the
validation rows, training stops by the rule of metrics.early_stopping, and the
model that comes back is the best epoch's, as a table (label, feature, weight).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.folders import saved
from tillwork.operators.classify import _judged
from tillwork.operators.grams import hashed_counts
from tillwork.operators.metrics import classification_metrics, early_stopping

#: Feature of the intercept.
BIAS = -1
#: Entries of vectors that a numpy pass weighs at a time. Fixed value.
ENTRIES = 1 << 20


def hashed_rows(df: DataFrame, key: str, text: str, features: int, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, ids, values) of unit vectors of hashed 3-grams, and (id, idf), fitted on these rows unless it is given."""
    counts = saved(hashed_counts(df, key, text, features), "hashed")
    if idf is None:
        n = counts.agg(F.count("key").alias("n"))

        def held(batches):
            found = np.zeros(features, np.int64)
            for batch in batches:
                found += np.bincount(batch.column("ids").flatten(), minlength=features)
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(found[ids])], ["id", "df"])

        # a task sends ``features`` rows at most
        seen = counts.select("ids").mapInArrow(held, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).join(F.broadcast(n))  # one row
        idf = saved(seen.select("id", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = np.full(features, np.nan)
    for r in idf.collect():  # ``features`` rows at most
        weight[r["id"]] = r["idf"]

    def weigh(batches):
        for batch in batches:
            for part in _parts(batch):
                ids, tf, bounds = _lists(part, "ids", "counts")
                known = ~np.isnan(weight[ids])
                size = np.diff(np.concatenate([[0], np.cumsum(known)])[bounds])
                met = pa.array(size > 0)  # rows without an n-gram that has a weight have no vector
                ids, size = ids[known], size[size > 0]
                value = (1 + np.log(tf[known])) * weight[ids]
                begin = np.cumsum(size) - size
                if len(size):
                    value /= np.repeat(np.sqrt(np.add.reduceat(value * value, begin)), size)
                ends = pa.array(np.append(begin, len(ids)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("key").filter(met), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, value))], ["key", "ids", "values"])

    return counts.select("key", "ids", "counts").mapInArrow(weigh, f"key {counts.schema['key'].dataType.simpleString()}, ids array<int>, values array<double>"), idf


def _parts(batch):
    """Rows of a batch in runs of some ENTRIES ids."""
    ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("ids")), np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ENTRIES, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _lists(batch, *names):
    """The values of list columns of equal lengths, and the bounds of each row's."""
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch.column(names[0])), np.int64))])
    return *(np.asarray(batch.column(c).flatten()) for c in names), bounds


def _softmax(scores):
    e = np.exp(scores - scores.max())
    return e / e.sum()


def _epoch(rows: DataFrame, weights: np.ndarray, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """The mean of the weights that each task reaches from the given ones, and the mean loss on the way."""
    given = rows.sparkSession.sparkContext.broadcast(weights)
    classes = weights.shape[0]

    def run(batches):
        own, loss, n = np.ascontiguousarray(given.value.T), 0.0, 0  # a feature's weights lie together
        for batch in batches:
            ids, values, bounds = _lists(batch, "ids", "values")
            for i, (y, w) in enumerate(zip(batch.column("y").to_pylist(), batch.column("weight").to_pylist())):
                at, x = ids[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]]
                held = own[at]
                p = _softmax(x @ held + own[-1])
                loss, n = loss - w * float(np.log(max(p[y], 1e-300))), n + 1
                p[y] -= 1
                own[at] = held - rate * w * (x[:, None] * p + decay * held)
                own[-1] -= rate * w * p
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(list(own * n)), pa.array([n] * len(own)), pa.array([loss] * len(own))], ["id", "w", "n", "loss"])

    moved = rows.mapInArrow(run, "id int, w array<double>, n long, loss double")
    summed = moved.groupBy("id").agg(F.array(*[F.sum(F.col("w")[c]) for c in range(classes)]).alias("w"), F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    got = summed.collect()  # a row a feature
    given.unpersist()
    made = weights.copy()
    for r in got:
        made[:, r["id"]] = np.array(r["w"]) / r["n"]
    return made, got[0]["loss"] / got[0]["n"] if got else 0.0


def _predicted(rows: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """keep with p, the probabilities of the classes."""
    given = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = np.ascontiguousarray(given.value.T)
        for batch in batches:
            ids, values, bounds = _lists(batch, "ids", "values")
            p = [_softmax(values[a:b] @ w[ids[a:b]] + w[-1]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p, pa.list_(pa.float64()))], [*keep, "p"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "ids", "values").mapInArrow(run, f"{kinds}, p array<double>")


class TrainedModel:
    """labels, the table of weights (label, feature, weight), the inverse frequencies, and the trace (run, epoch, train_loss, val_macro_f1) of all epochs."""

    def __init__(self, labels, features, weights, idf, trace, best_epoch):
        self.labels, self.features, self.weights, self.idf, self.trace, self.best_epoch = labels, features, weights, idf, trace, best_epoch

    def table(self, spark) -> DataFrame:
        rows = [(label, BIAS if j == self.features else j, float(w)) for i, label in enumerate(self.labels) for j, w in enumerate(self.weights[i]) if w]
        return spark.createDataFrame(rows, "label string, feature int, weight double")

    def score(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """df with predicted_label, confidence, all_scores and routing; a text without n-grams is scored by the intercepts."""
        rows, _ = hashed_rows(df, key, text, self.features, self.idf)
        found = _predicted(rows, self.weights, ["key"])
        bare = [float(x) for x in _softmax(self.weights[:, -1])]
        told = df.withColumn("__k", F.col(key)).join(found, F.col("__k") == F.col("key"), "left").withColumn("__p", F.coalesce("p", F.array(*map(F.lit, bare))))
        return _judged(told, self.labels, df.columns)


def train_epochs(
    train: DataFrame, val: DataFrame, key: str, text: str, label: str, weights: DataFrame | None = None, features: int = 1 << 12, epochs: int = 12, patience: int = 3, rate: float = 2.0, decay: float = 1e-5
) -> TrainedModel:
    """The model of the epoch with the greatest validation macro-F1. weights (label, weight): class weights. Rows without text or label take no part."""
    spark = train.sparkSession
    labels = sorted(r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())  # a row a class
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1

    def ready(df, idf):
        real = df.where(F.col(text).isNotNull() & F.col(label).isin(*labels))
        rows, idf = hashed_rows(real, key, text, features, idf)
        of = real.select(F.col(key).alias("key"), F.col(label).alias("truth"), number.alias("y"))
        of = of.join(weights.select(F.col("label").alias("truth"), F.col("weight").cast("double").alias("weight")), "truth", "left").fillna(1.0, ["weight"]) if weights is not None else of.withColumn("weight", F.lit(1.0))
        # an order that mixes the classes
        return saved(rows.join(of, "key").withColumn("mixed", F.xxhash64("key")).repartition("key").sortWithinPartitions("mixed").drop("mixed"), "rows"), idf

    rows, idf = ready(train, None)
    judged, _ = ready(val, idf)
    now, trace, best, kept = np.zeros((len(labels), features + 1)), [], None, 0
    for epoch in range(1, epochs + 1):
        now, loss = _epoch(rows, now, rate / (1 + 0.2 * (epoch - 1)), decay)
        told = _predicted(judged, now, ["truth"]).withColumn("pred", F.element_at(F.array(*map(F.lit, labels)), F.array_position("p", F.array_max("p")).cast("int")))
        f1 = classification_metrics(told, "truth", "pred", labels).first()["macro_f1"] or 0.0
        trace.append(("run", epoch, float(loss), float(f1)))
        history = spark.createDataFrame(trace, "run string, epoch int, train_loss double, val_macro_f1 double")
        verdict = early_stopping(history, patience).first()
        if verdict["best_epoch"] == epoch:
            best, kept = now, epoch
        if verdict["stop_epoch"] < epoch or epoch - kept >= patience:
            break
    return TrainedModel(labels, features, best if best is not None else now, idf, history, kept)
