"""Token counts: delta-maintained rollups.

A store holds, for every committed batch, a ledger (the latest count of each
document and tokenizer version that the batch touched) and additive deltas by
source, language and tokenizer version. Totals are sums of deltas, and a batch
adds as many deltas as it changes: an insert adds its count, a delete takes away
what the ledger holds, a revision does both. To find what the ledger holds, a
batch reads the keys of all earlier ledgers once; they aren't compacted.

Batches commit idempotently: a batch writes its own folders, overwriting what
an attempt that died has left, and its commit row last; a batch id that is
committed already is skipped. Uncommitted folders are never read. Batches take
effect in the order of their commits, whatever their ids: the commit row holds
its place, and the ledger goes by that. A store has one writer at a time.

Within a batch the change of greatest (seq, op, n_tokens) counts for a document and
tokenizer version, so repeated rows have no effect; deleting what isn't there
has none either; inserting what is there revises it. Null keys, sources and
languages are values like any other; a null count is 0. Empty batches commit.
Other columns are ignored, whatever their names. Texts are counted whole, however
long, by native functions. An empty table gives no totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillwork.llm.common import scratch, table, written

CHANGES = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, op string, seq bigint"
LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, batch_id bigint"
DELTAS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, batch_id bigint"

#: Tokenizer versions with native counters.
TOKENIZERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    "marks-1": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]")).cast("long"),
}


class RollupStore:
    """Token-count rollups under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, schema: str) -> DataFrame:
        """The committed rows of a part of the store."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{what}")
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], schema)
        return rows if what == "commits" else rows.join(self.commits(), "batch_id")

    def commits(self) -> DataFrame:
        """batch_id and place: 1 for the first commit, and so on."""
        return self._read("commits", "batch_id bigint, place bigint")

    def ledger(self, touched: DataFrame | None = None) -> DataFrame:
        """The latest row of each document and tokenizer version, or of those touched; n_tokens is null after a delete."""
        rows = self._read("ledger", LEDGER)
        if touched is not None:
            same = F.col("o.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("o.tokenizer").eqNullSafe(F.col("n.tokenizer"))
            rows = rows.alias("o").join(touched.alias("n"), same, "left_semi")
        latest = F.max_by(F.struct("source", "lang", "n_tokens"), "place").alias("v")
        return rows.groupBy("doc_id", "tokenizer").agg(latest).select("doc_id", "tokenizer", "v.*")

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Applies a batch of CHANGES rows; False if it was committed before."""
        if self.commits().where(F.col("batch_id") == batch_id).take(1):
            return False
        last = F.max_by(F.struct("source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "op"), F.struct("seq", "op", "n_tokens")).alias("v")
        net = changes.groupBy("doc_id", "tokenizer").agg(last)
        new = net.select(
            "doc_id", "tokenizer", "v.source", "v.lang",
            F.when(F.col("v.op") != "delete", F.col("v.n_tokens")).alias("n_tokens"),
        )
        place = f"batch_id={batch_id}"
        new.write.mode("overwrite").parquet(f"{self.path}/ledger/{place}")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/ledger/{place}")
        before = self.ledger(new).where("n_tokens is not null")
        signed = lambda rows, sign: rows.select("source", "lang", "tokenizer", F.lit(sign).cast("long").alias("d"), (sign * F.col("n_tokens")).alias("t"))
        deltas = signed(before, -1).unionByName(signed(new.where("n_tokens is not null"), 1))
        deltas = deltas.groupBy("source", "lang", "tokenizer").agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/{place}")
        place = self.commits().agg(F.coalesce(F.max("place"), F.lit(0)) + 1).first()[0]
        self.spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(place).cast("long").alias("place")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, lang and tokenizer; rows without a document are left out."""
        summed = self._read("deltas", DELTAS).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def counts(docs: DataFrame, text: Column, name: str) -> Column:
    """Array of (tokenizer, n_tokens) of a text, null as empty."""
    held = F.coalesce(text, F.lit(""))
    return F.array(*[F.struct(F.lit(k).alias("tokenizer"), f(held).alias("n_tokens")) for k, f in TOKENIZERS.items()]).alias(name)


def op1_token_counts(spark, sf_dir) -> DataFrame:
    """Totals after three batches over all documents: every document is inserted, its count is
    revised where lines repeat (repeated lines no longer count), and documents of under 20 words are deleted.
    The second batch is delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    lines = F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1)), "\n")
    seen = docs.select("doc_id", "source", "lang", counts(docs, F.col("text"), "first"), counts(docs, lines, "second"))
    held = written(seen, "token-counts")
    store = RollupStore(spark, scratch(spark, "rollup"))

    def changes(rows, column, op):
        return rows.select("doc_id", "source", "lang", F.explode(column).alias("c")).select("doc_id", "c.tokenizer", "source", "lang", "c.n_tokens", F.lit(op).alias("op"), F.lit(0).cast("long").alias("seq"))

    store.commit(1, changes(held, "first", "insert"))
    revised = changes(held.where("first != second"), "second", "revise")
    for _ in range(2):
        store.commit(2, revised)
    store.commit(3, changes(held.where("first[0].n_tokens < 20"), "first", "delete"))
    return store.totals()


OP1_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS text, array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS kept
  FROM documents
), w AS (
  SELECT source, lang, kept, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(kept, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(kept, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) AS marks
  FROM d
), l AS (
  SELECT source, lang, 'words-1' AS tokenizer, words AS t FROM w WHERE n >= 20
  UNION ALL SELECT source, lang, 'marks-1', marks FROM w WHERE n >= 20
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(t)::BIGINT AS n_tokens FROM l GROUP BY ALL
"""
