"""Exact duplicates by deterministic block naming; native DataFrame functions only.

Texts are lower-cased in A-Z, nothing else, and cut into blocks of a fixed number
of characters. Different blocks are sorted and get an integer each, their name.
Then names of neighbours are paired, different pairs are sorted and named in
turn, and so on, until one name stands for the whole text: after k rounds a name
stands for up to 2^k blocks. Names are given by content, never by a hash, so at
one level equal names mean equal texts. A text of n blocks ends after log2(n)
rounds; its identity is that round's number and its name.

A document that has a block (or a pair) of its own has no copy and leaves at
once. Before contents are sorted, 64-bit hashes of blocks tell most of them: a
hash that one document alone has proves that its block is its own, while equal
hashes prove nothing. So contents are shuffled only of documents all of whose
blocks may be shared.

Every grouping combines within tasks before it shuffles, and joins with names
are between a saved table and rows that Spark may split, so a group of copies
of any size, or a block that a third of all documents share, is no single task.
Each round is written to the shared folder.

Null texts count as empty, and empty texts equal each other. A null doc_id is
smaller than any other. Of rows with equal doc_id and text one stays; rows are
told apart by SHA-256 of both. Very long texts have more rounds; nothing holds
more than one text. An empty table gives no rows. Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import table, written

#: Characters in a block.
BLOCK = 1024


def normal(text: Column) -> Column:
    """The text in lower case, A-Z only; null as empty."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    return F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def blocks(text: Column, block: int = BLOCK) -> Column:
    """The text in pieces of ``block`` characters, the last one shorter; an empty text is one empty piece."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _named(parts: DataFrame, content: list[str]) -> DataFrame:
    """Contents that several documents hold, each with an integer name: its place in the sorted order of its partition, with the partition's number."""
    shared = parts.groupBy(*content).agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    return written(shared.sortWithinPartitions(*content).select(*content, F.monotonically_increasing_id().alias("name")), "names")


def _renamed(parts: DataFrame, content: list[str]) -> DataFrame:
    """Documents (rep, names) by the names of their parts (rep, n, pos, content); those with a part of their own are gone."""
    told = parts.join(_named(parts, content), content).groupBy("rep", "n").agg(F.collect_set(F.struct("pos", "name")).alias("found"))
    whole = told.where(F.size("found") == F.col("n"))
    return written(whole.select("rep", F.transform(F.array_sort("found"), lambda x: x["name"]).alias("names")), "named")


def identities(parts: DataFrame) -> DataFrame:
    """(rep, level, name) of documents given as blocks (rep, n, pos, block); equal level and name mean equal texts. Documents with a part of their own have no row."""
    now, level, ended = _renamed(parts, ["block"]), 0, []
    while True:
        ended.append(now.where(F.size("names") == 1).select("rep", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        going = now.where(F.size("names") > 1)
        if not going.take(1):
            break
        half = F.ceil(F.size("names") / 2).cast("int")
        pair = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.struct(F.get("names", 2 * i).alias("left"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("right")))
        pairs = going.select("rep", half.alias("n"), F.posexplode(pair).alias("pos", "pair")).select("rep", "n", "pos", "pair.left", "pair.right")
        now, level = _renamed(pairs, ["left", "right"]), level + 1
    out = ended[0]
    for rows in ended[1:]:
        out = out.unionByName(rows)
    return out


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id of equal texts), group_size, kept and text_sha256 (of the lower-cased text)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    source = source.withColumn("key", F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)))
    low = source.select("doc_id", "key", normal(F.col("text")).alias("low"))
    hashes = F.transform(blocks(F.col("low"), block), lambda b: F.xxhash64(b))
    rows = written(low.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.sha2("low", 256).alias("text_sha256"), hashes.alias("hashes")), "documents")

    flat = rows.select("row", F.size("hashes").alias("n"), F.explode(F.array_distinct("hashes")).alias("hash"))
    common = written(flat.groupBy("hash").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("hash"), "hashes")
    distinct = F.size(F.array_distinct("hashes"))
    met = flat.join(common, "hash").groupBy("row").agg(F.count("*").alias("met"))
    open_ = rows.select("row", "key", distinct.alias("n")).join(met, "row").where("met = n")
    reps = written(open_.groupBy("key").agg(F.min("row").alias("rep")), "candidates")

    # texts meet their candidates by a merge at any size, so that what is moved grows as the input does
    texts = source.join(reps.hint("merge"), "key").select("rep", blocks(normal(F.col("text")), block).alias("blocks"))
    texts = written(texts, "blocks")
    ids = identities(texts.select("rep", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")))
    # repeated rows are one candidate, so where that one has no name it stands for itself
    named = reps.join(ids, "rep", "left").select("key", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("name", "rep").alias("name"))
    told = written(rows.select("row", "doc_id", "key", "text_sha256").join(named, "key", "left").drop("key"), "told")
    groups = told.where("level is not null").groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
    groups = written(groups.select("level", "name", "group_size", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("kept_row")), "groups")
    out = told.join(groups, ["level", "name"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("kept_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("kept_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op12_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size,
  row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(low) AS text_sha256 FROM t
"""
