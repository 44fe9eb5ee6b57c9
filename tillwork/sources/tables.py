"""Readers and writers of bills, catalogues, gold labels, run results and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillwork.functions.strings import strip

BILL = (
    "serial_no bigint, bill_file string, store_name string, invoice_date date, total decimal(12,2), card_used string, received_at timestamp_ntz, "
    "sender string, image_hash string, item_name string, item_price decimal(12,2), grocery_category string"
)
GOLD = (
    "receipt_id string, image_file string, fields struct<merchant_name:string,date:string,time:string,subtotal:string,tax:string,total:string,"
    "payment_method:string,card_last4:string,receipt_number:string>, items array<struct<name:string>>"
)
RUN = (
    "model string, method string, test_accuracy double, test_macro_f1 double, per_class_f1 map<string,double>, best_val_macro_f1 double, best_epoch int, "
    "training_history array<struct<epoch:int,train_loss:double,val_loss:double,val_accuracy:double,val_macro_f1:double>>, class_weights map<string,double>"
)
_MISSING = "Not found"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def read_bills(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The bill table; empty if there is none. In CSV, missing values may be spelled out and prices hold commas; rows of under 9 columns are left out."""
    try:
        if fmt != "csv":
            return spark.read.schema(BILL).format(fmt).load(path)
        names = [f.split()[0] for f in BILL.split(", ")]
        raw = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in [*names, "_broken"])).option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False).csv(path)  # short rows are told only where all columns are parsed
    except AnalysisException:
        return spark.createDataFrame([], BILL)
    whole = raw.where(F.col("_broken").isNull() | (F.size(F.split("_broken", ",")) >= 9))
    kinds = dict(f.split() for f in BILL.split(", "))
    return whole.select(*[F.regexp_replace(F.nullif(n, F.lit(_MISSING)), ",", "").try_cast(k).alias(n) if "decimal" in k else F.nullif(n, F.lit(_MISSING)).try_cast(k).alias(n) for n, k in kinds.items()])


def read_any_csv(spark: SparkSession, path: str, view: str = "data") -> DataFrame:
    """Any CSV with a header, types inferred from all of it, as a view. Bare times stay text, as Spark would give them today's date."""
    options = {"header": True, "inferSchema": True, "samplingRatio": 1.0}
    df = spark.read.options(**options).csv(path)
    stamps = [f.name for f in df.schema if f.dataType.simpleString().startswith("timestamp")]
    if stamps:
        raw = spark.read.option("header", True).csv(path)
        odd = raw.agg(*[F.count(F.when(~F.col(f"`{c}`").rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), 1)).alias(c) for c in stamps]).first()
        bare = [c for c in stamps if odd[c] == 0]
        if bare:
            fields = ", ".join(f"`{f.name}` {'string' if f.name in bare else f.dataType.simpleString()}" for f in df.schema)
            df = spark.read.option("header", True).schema(fields).csv(path)
    return register(df, view)


def register(df: DataFrame, view: str = "data") -> DataFrame:
    df.createOrReplaceTempView(view)
    return df


def bill_rows(bills: DataFrame) -> DataFrame:
    """One row per item of bills (with items array of (name, price)); a placeholder row where there is none."""
    item = F.explode_outer(F.when(F.size("items") > 0, F.col("items")))
    rows = bills.withColumn("item", item)
    price = F.regexp_replace(F.col("item.price").cast("string"), ",", "").try_cast("decimal(12,2)")
    return rows.withColumn("item_name", F.coalesce("item.name", F.lit("Unknown"))).withColumn("item_price", price).drop("item", "items")


def append_bills(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def reset_bills(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], BILL).write.mode("overwrite").parquet(path)


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and md5 of the bytes of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("image_hash"))


def read_gold(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """Gold labels, one JSON object a file; with images (column path), only those whose image is there."""
    gold = spark.read.schema(GOLD).option("multiLine", True).json(path)
    if images is None:
        return gold
    return gold.join(images.select(F.element_at(F.split("path", "/"), -1).alias("image_file")).distinct(), "image_file", "left_semi")


def load_inventory(rows: DataFrame) -> DataFrame:
    """Catalogue rows (ord, ingredient, predicted_label): headers and names trimmed, names lower-cased, nulls dropped, the first of each name kept."""
    bare = rows.withColumnsRenamed({c: c.strip() for c in rows.columns}).withColumn("ingredient", F.lower(strip("ingredient")))
    first = Window.partitionBy("ingredient").orderBy("ord")
    named = bare.dropna(subset=["ingredient", "predicted_label"])
    return named.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def append_queues(entries: DataFrame, path: str) -> None:
    """Review entries (with a column queue), a folder a queue; each has a timestamp."""
    stamped = entries if "timestamp" in entries.columns else entries.withColumn("timestamp", F.current_timestamp())
    stamped.write.mode("append").partitionBy("queue").json(path)


def write_metrics(per_receipt: DataFrame, summary: DataFrame, path: str) -> None:
    per_receipt.write.mode("overwrite").json(f"{path}/per_receipt")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_splits(split: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder for each split; beside it, at path-downsampled, the training rows that are marked so, if any column says."""
    split.write.mode("overwrite").partitionBy("split").format(fmt).save(path)
    if "downsampled" in split.columns:
        split.where("downsampled").drop("downsampled").write.mode("overwrite").format(fmt).save(f"{path}-downsampled")


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Run results of the JSON files that are there, with the file's name."""
    found = []
    for p in paths:
        try:
            found.append(spark.read.schema(RUN).option("multiLine", True).json(p).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)))
        except AnalysisException:
            continue
    out = spark.createDataFrame([], f"{RUN}, file string")
    for df in found:
        out = out.unionByName(df)
    return out.where("model is not null")
