"""Streaming jobs: bill ingest, bounded duplicate removal, message routing, session history."""

from __future__ import annotations

import heapq
from contextlib import contextmanager
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from tillwork.functions.folders import passing, saved, tidy
from tillwork.functions.messages import route_messages
from tillwork.functions.receipts import extract_receipts
from tillwork.operators.classify import categorize
from tillwork.operators.dedup import assign_serials, resolve_batch
from tillwork.sources import bill_store
from tillwork.sources.tables import bill_rows

SUBMISSION = "bill_id bigint, image_hash string, store string, date date, total decimal(12,2)"
#: What is stored of an accepted bill, of its items, and of the items that enter a review queue.
BILLS = f"{SUBMISSION}, serial_no bigint, bill_file string, sender string, received_at timestamp, time string, subtotal double, tax double, card string, payment_method string, receipt_number string"
ITEMS = (
    "serial_no bigint, bill_id bigint, bill_file string, store_name string, invoice_date date, total decimal(12,2), card_used string, received_at timestamp, sender string, image_hash string, "
    "item_name string, item_price decimal(12,2), grocery_category string, routing string, confidence double"
)
QUEUED = "queue string, serial_no bigint, item_name string, normalized string, predicted_label string, confidence double, routing string"
RECEIPT = "bill_id bigint, bill_file string, sender string, received_at timestamp, image_hash string, text string"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def stored_bills(spark: SparkSession, path: str, schema: str = SUBMISSION) -> DataFrame:
    """Accepted bills of the batches stored so far, with their serial numbers."""
    return bill_store.read(spark, path, "bills", f"{schema}, serial_no bigint")


def _accepted(rows: DataFrame, spark: SparkSession, path: str, log: list[dict]) -> DataFrame:
    """Bills that neither the stored ones nor earlier ones of the batch have, numbered on from the stored ones."""
    number = ", receipt_number string" if "receipt_number" in rows.columns else ""
    history = bill_store.read(spark, path, "bills", f"{SUBMISSION}{number}, serial_no bigint", log)
    compared = _columns(f"{SUBMISSION}{number}")
    accepted = resolve_batch(rows.select(*compared), history.select(*compared)).where("accepted").select("bill_id")
    return assign_serials(rows.join(accepted, "bill_id", "left_semi"), history)


def ingest_batch(batch: DataFrame, batch_id: int, path: str, source: str = "stream") -> int:
    """Stores a batch's accepted submissions; a replayed batch has no further effect, and writers at once don't meet in a version (sources.bill_store)."""
    spark = batch.sparkSession
    with passing(spark):
        rows = saved(batch.select(*_columns(SUBMISSION)), "batch")
        return bill_store.commit(spark, path, f"{source}-{batch_id}", lambda log: {"bills": _accepted(rows, spark, path, log)})


def ingest_receipts(batch: DataFrame, batch_id: int, path: str, model: DataFrame, words: DataFrame, verdicts: DataFrame | None = None, source: str = "stream") -> int:
    """Receipts (RECEIPT) to stored bills, item rows with categories, and review queues, in one commit.

    Fields are extracted once. Each attempt resolves the batch against the bills stored by then and numbers the accepted
    ones. Item names are categorised once each, by a model table and a vocabulary, with a reviewer's verdicts if there are any.
    Tables that are kept on the way go when they have served: those of the resolution once accepted bills are known, others after the commit.
    """
    with passing(batch.sparkSession):
        return _ingested(batch, batch_id, path, model, words, verdicts, source)


def _ingested(batch, batch_id, path, model, words, verdicts, source) -> int:
    spark = batch.sparkSession
    got = extract_receipts(batch.select(*_columns(RECEIPT), F.col("bill_id").alias("receipt_id")))
    typed = got.withColumn("date", F.to_date(F.nullif("date", F.lit("")))).withColumn("total", F.col("total").cast("decimal(12,2)"))
    rows = saved(typed.select(*[c for c in _columns(BILLS) if c != "serial_no"], "items"), "extracted")
    names = bill_rows(rows.select("items")).select("item_name").distinct()
    done, entered = categorize(names, model, words, verdicts)
    done = saved(done.select("input", "normalized", "predicted_label", "confidence", "routing", "final_label"), "categorised")
    entered = saved(entered.select("input", "queue"), "entered")

    def build(log):
        with passing(spark):
            bills = saved(_accepted(rows, spark, path, log), "accepted", outlive=True)
        items = bill_rows(bills).join(done, F.col("item_name") == F.col("input"), "left")
        items = items.withColumns({"store_name": F.col("store"), "invoice_date": F.col("date"), "card_used": F.col("card"), "grocery_category": F.col("final_label")})
        items = saved(items.select(*_columns(ITEMS), "input", "normalized", "predicted_label"), "items")
        queued = items.join(entered, "input").select("queue", *[c for c in _columns(QUEUED) if c != "queue"])
        return {"bills": bills.select(*_columns(BILLS)), "items": items.select(*_columns(ITEMS)), "queues": queued}

    return bill_store.commit(spark, path, f"{source}-{batch_id}", build)


def start_ingest_stream(stream: DataFrame, table_path: str, checkpoint: str, ingest=ingest_batch, **options) -> StreamingQuery:
    """Resolves each micro-batch against all stored bills and stores what is accepted. ingest: ingest_batch for submissions, ingest_receipts (with its options) for receipts."""
    return stream.writeStream.foreachBatch(lambda df, n: ingest(df, n, table_path, **options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, watermark: str, time: str = "arrived", key: str = "image_hash") -> DataFrame:
    """The first submission of each image within the watermark; state is bounded by it, so later copies pass."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def route_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return route_messages(stream, text)


#: Session settings that a query with keyed state starts with. RocksDB holds the state outside the heap; without empty batches, a run over what is there ends.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict):
    """Settings that hold while a query starts, which keeps them; others are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_dedup_stream(stream: DataFrame, watermark: str, path: str, checkpoint: str, time: str = "arrived", key: str = "image_hash") -> StreamingQuery:
    """dedup_stream of what is there into a Parquet table; the keys it remembers are held outside the heap."""
    with _settings(stream.sparkSession, _STATE):
        firsts = dedup_stream(stream, watermark, time, key).writeStream.format("parquet").option("path", path)
        return firsts.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastTurns(StatefulProcessor):
    """Keeps the last ``keep`` rows of a session, in order, for ``ttl`` milliseconds from when they were kept last."""

    def __init__(self, schema: StructType, order: str, keep: int, ttl: int):
        self.schema, self.order, self.keep, self.ttl = schema, order, keep, ttl

    def init(self, handle) -> None:
        self.turns = handle.getListState("turns", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        names = self.schema.names
        at = names.index(self.order)
        seen = chain((tuple(r) for r in self.turns.get()), (tuple(r[n] for n in names) for r in rows))
        last = heapq.nlargest(self.keep, seen, key=lambda r: (r[at] is not None, r[at]))  # holds ``keep`` rows, however many come
        self.turns.put(last[::-1])
        yield Row(session=key[0], held=len(last))

    def close(self) -> None:
        pass


def history_stream(stream: DataFrame, checkpoint: str, pairs: int = 20, session: str = "session_id", order: str = "turn", days: float = 30) -> StreamingQuery:
    """Keeps each session's last 2 * pairs messages as keyed state: a batch reads and writes the sessions it has messages of, and a session that is silent for ``days`` is forgotten."""
    held = StructType([f for f in stream.schema if f.name != session])
    processor = LastTurns(held, order, 2 * pairs, max(1, int(days * 86_400_000)))
    with _settings(stream.sparkSession, _STATE):
        kept = stream.groupBy(session).transformWithState(processor, f"session {stream.schema[session].dataType.simpleString()}, held int", "Update", "ProcessingTime")
        return kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_history(spark: SparkSession, checkpoint: str, session: str = "session_id") -> DataFrame:
    """The messages that history_stream holds, by its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "turns").load()
    alive = state.where(F.col("list_element.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
    return alive.select(F.col(f"key.{session}").alias(session), "list_element.value.*")


#: Rows of a file of in_parts, at least, where a range has more files than one.
FILE_ROWS = 1 << 18


def in_parts(df: DataFrame, order: str, parts: int, path: str) -> DataFrame:
    """Writes df as files of consecutive ranges of ``order`` and reads them as a stream, a range a micro-batch.

    df is worked out once, by all tasks. Ranges have equally many files, each made by a task of its own; rows are dealt in turn, so none is without rows.
    """
    spark = df.sparkSession
    with passing(spark), tidy(spark):
        held = saved(df, "parts")
        top = held.agg(F.max(order)).first()[0] or 0
        part = F.least(F.floor(F.col(order) * parts / (top + 1)), F.lit(parts - 1)).cast("int")
        sizes = {r["part"]: r["count"] for r in held.groupBy(part.alias("part")).count().collect()}  # a row a part
        files = max(1, min(sizes.get(i, 0) for i in range(parts)) // FILE_ROWS)
        for i in range(parts):
            rows = held.where(part == i)
            if files == 1:
                rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={i}")
            else:
                dealt = rows.withColumn("__file", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
                dealt.repartition(files, "__file").write.mode("overwrite").partitionBy("__file").parquet(f"{path}/part={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
