"""A corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; n_chars follows the text.
Workers serve one stage after another, so stages leave no vocabularies or words in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm.common import table, written
from tillwork.llm.fertility import quality
from tillwork.llm.packing import pack_documents
from tillwork.llm.secret_scan import redact
from tillwork.llm.simhash import near_duplicates
from tillwork.llm.suffix_dedup import remove_repeats

#: SQL has no tokenizers, multiway differencing or transitive links at this size; tests/llm checks run() by brute force.
ORACLE_SQL = None


def _staying(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and text hash are among the keys (doc_id, text_hash)."""
    stay = keys.select(F.col("doc_id").alias("__kept"), F.col("text_hash").alias("__kept_hash")).distinct()
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    return hashed.join(stay, hashed["doc_id"].eqNullSafe(stay["__kept"]) & (hashed["__hash"] == stay["__kept_hash"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a fertility band reject go, null and empty texts among them; repeated rows fare alike."""
    return _staying(docs, quality(docs, stay=False).where("kept")).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class stays, once if its row is repeated; without ids, every text of a class that has none stays.

    Fingerprints are op6's: three-word shingles, linked at 3 differing bits or fewer, which catches copies of a similarity over about 0.95
    (five-word Jaccard) and few under 0.9. Null and empty texts are one class; ties in doc_id go by the text's hash.
    """
    found = near_duplicates(docs)
    kept = _staying(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    return kept.dropDuplicates(["doc_id", "__hash"]).select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document's go, and with them characters cut in two; a document goes if nothing but blanks is left.

    Null and empty texts lose nothing and stay; rows of equal or no doc_id don't cut each other.
    """
    rest = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # columns of any name ride along
    row = docs.select("doc_id", "text", F.col("text").isNull().alias("__null"), *[F.col(c).alias(n) for c, n in rest.items()])
    done = remove_repeats(row, characters=True, chunk_bytes=4 << 20, pass_bytes=512 << 10).withColumn("__cut", F.size("removed") > 0).withColumn("__left", F.col("kept").cast("string"))
    left = done.where(~F.col("__cut") | F.col("__left").rlike(r"[^\x20\x09-\x0D]"))
    made = {
        "doc_id": F.col("doc_id"),
        "text": F.when(~F.col("__null"), F.col("__left")).alias("text"),
        "n_chars": F.when(F.col("__cut"), F.length("__left").cast("long")).otherwise(F.col(rest["n_chars"])).alias("n_chars"),
    }
    return left.select(*[made[c] if c in made else F.col(rest[c]).alias(c) for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; documents stay, null and empty ones as they are."""
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids (little-endian unsigned 32-bit); null and empty texts are their end token."""
    return pack_documents(docs, stay=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
