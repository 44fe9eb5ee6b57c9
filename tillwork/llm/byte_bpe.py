"""Byte-level BPE encoding and decoding by recursive queries.

In every Spark task a DuckDB connection holds the merge table (pair of ids to
merged id, which is also its rank). Each text is cut by the vocabulary's
pattern; the words that a task has not met yet become token-position rows
(word, position, id, next id, rank of that pair), and a recursive query contracts
the leftmost pair of least rank of every word until no pair is left. Words
without a pair leave the recursion. An ordered aggregation over (text, position,
id) joined with the vocabulary decodes.

A word of over ``LONG_WORD`` bytes has as many rounds as contractions, each over
all its rows (5 KB of letters took 15 s by recursion even with all occurrences of
a pair contracted at once); such a word is contracted by the same rule in Python
with a heap instead.

Words are encoded once per task and reused. Null texts count as empty (no ids).
Special tokens don't exist: their strings are ordinary text. Very long texts are
a pass of their own. Ties between pairs go to the leftmost. Repeated rows and
other columns pass through; a column that bears an output's name is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import WordMemo, laid_out, ragged, slices, table, texts, vocab_file

LONG_WORD = 160
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_ENCODE = """
WITH RECURSIVE s(w, p, t, nt, m, done) AS (
  SELECT w, p, t, nt, m, false FROM words LEFT JOIN merges ON t::BIGINT * 65536 + nt = merges.pair
  UNION ALL
  SELECT * FROM (
    WITH open AS (SELECT w, p, t, nt, m FROM s WHERE NOT done),
    b AS (SELECT w, min(m::BIGINT * 65536 + p) AS k FROM open GROUP BY w),
    c AS (SELECT w, (k // 65536)::INT AS r, (k % 65536)::INT AS q FROM b),
    n AS (
      SELECT w, CASE WHEN p > q THEN p - 1 ELSE p END AS p, CASE WHEN p = q + 1 THEN r ELSE t END AS t,
        CASE WHEN p = q - 1 THEN r ELSE nt END AS nt, m, r IS NULL AS done, p = q + 1 OR p = q - 1 AS fresh
      FROM open JOIN c USING (w) WHERE p IS DISTINCT FROM q
    )
    SELECT w, p, t, nt, CASE WHEN fresh THEN x.m ELSE n.m END, done
    FROM n LEFT JOIN merges x ON (CASE WHEN fresh THEN t::BIGINT * 65536 + nt ELSE -1 END) = x.pair
  )
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE done GROUP BY w ORDER BY w
"""
_DECODE = "SELECT d, string_agg(h, '' ORDER BY p) AS h FROM ids JOIN vocab USING (t) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes and decodes with DuckDB; one for each Python worker."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = read_ranks(path)
        get = self.ranks.get
        splits = [(get(k[:i]), get(k[i:]), m) for k, m in self.ranks.items() for i in range(1, len(k))]
        splits = [s for s in splits if s[0] is not None and s[1] is not None]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "384MB"})
        left, right, merged = (np.array(x, np.int64) for x in zip(*splits))
        merges = pa.table({"pair": left * 65536 + right, "m": merged.astype(np.int32)})  # noqa: F841  read by name
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        names = pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "h": [k.hex() for k in self.ranks]})  # noqa: F841
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM names")
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.memo = WordMemo(lambda new: laid_out(self.words(new)), 800_000)

    def words(self, new: list[str]) -> list:
        data = [w.encode() for w in new]
        found: list = [None] * len(data)
        long = [i for i, b in enumerate(data) if len(b) > LONG_WORD]
        short = [i for i, b in enumerate(data) if len(b) <= LONG_WORD]
        for at in range(0, len(short), 100_000):
            self.contract(data, short[at : at + 100_000], found)
        for i in long:
            found[i] = self.long_word(data[i])
        return found

    def contract(self, data: list[bytes], part: list[int], found: list) -> None:
        lengths = np.fromiter((len(data[i]) for i in part), np.int64, len(part))
        ids = self.bytes[np.frombuffer(b"".join(data[i] for i in part), np.uint8)]
        after = np.append(ids[1:], 0).astype(np.int32)
        after[np.cumsum(lengths) - 1] = -1
        rows = {"w": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "p": ragged(np.zeros(len(part), np.int64), lengths).astype(np.int32), "t": ids, "nt": after}
        self.con.register("words", pa.table(rows))
        got = self.con.sql(_ENCODE).to_arrow_table()
        self.con.unregister("words")
        for i, x in zip(part, got["ids"].to_pylist()):
            found[i] = x

    def long_word(self, data: bytes) -> list[int]:
        """The same contraction with a heap of (rank, position)."""
        n = len(data)
        parts = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i):
            if i >= 0 and after[i] < n and (rank := self.ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[after[i]])))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or len(parts[i]) != a or len(parts[after[i]]) != b:
                continue  # one of the two was contracted meanwhile
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[p] for p in parts if p is not None]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        lengths = np.diff(bounds)
        rows = {"d": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), "p": np.arange(len(ids), dtype=np.int32), "t": ids.astype(np.int32)}
        self.con.register("ids", pa.table(rows))
        got = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("ids")
        out = [b""] * len(lengths)
        for d, h in zip(got["d"].to_pylist(), got["h"].to_pylist()):
            out[d] = bytes.fromhex(h)
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    path = vocab_file(path)
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """docs with ``ids`` (array of int) in place of the text; with ``decoded`` also the ids decoded again (binary)."""
    keep = _others(docs, text, "ids", "decoded")

    def work(batches):
        import public_tokenizers
        import regex

        cut = regex.compile(pattern or public_tokenizers.PATTERN).findall
        own = coder(vocabulary)
        for part in slices(batches, text):
            words: list[str] = []
            ends = [0]
            for row in texts(part, text):
                words += cut(row.as_py())
                ends.append(len(words))
            rows = own.memo.codes(words)
            lengths = own.memo.lengths[rows]
            ids = own.memo.ids[ragged(own.memo.starts[rows], lengths)]
            bounds = np.concatenate([[0], np.cumsum(lengths)])[ends]
            columns = [part.column(c) for c in keep]
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
            if decoded:
                columns.append(pa.array(own.decode(ids, bounds), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *["decoded"] * decoded])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(work, ", ".join([*fields, "ids array<int>", *["decoded binary"] * decoded]))


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with ``decoded`` (binary, as ids may end within a character) in place of the ids; null ids count as none."""
    keep = _others(encoded, ids, "decoded")

    def work(batches):
        own = coder(vocabulary)
        for batch in batches:
            lists = batch.column(ids)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            done = own.decode(np.asarray(lists.flatten(), np.int32), bounds)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(done, pa.binary())], names=[*keep, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep]
    return encoded.mapInArrow(work, ", ".join([*fields, "decoded binary"]))


def op7_byte_bpe(spark, sf_dir) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
