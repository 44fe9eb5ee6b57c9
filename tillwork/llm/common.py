"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.folders import folder as scratch  # noqa: F401  used by the operators
from tillwork.functions.folders import saved as written  # noqa: F401

#: Text bytes that one numpy pass works on; a longer document is a pass of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cuts record batches into zero-copy runs of rows with about ``most`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + most, side="right"))
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as large strings, null as the empty text; copied, as some kernels misread a slice's bounds."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return pa.concat_arrays([text, pa.array([], pa.large_string())])


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the words' codes in order, each text's bounds in them (one more
    than there are texts) and the dictionary, as strings, that codes point to.
    """
    lists = pc.ascii_split_whitespace(text)
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int32)
    words = coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # blanks at either end give an empty string
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return codes, bounds, words


def strings(words: pa.Array) -> list[str]:
    """The values of an array without nulls; quicker than to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def laid_out(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each list in the array of all, and that array."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum()))
    return np.cumsum(lengths) - lengths, lengths, flat


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length-1 of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run bounds[i]:bounds[i+1]; 0 for an empty one."""
    summed = np.concatenate([[0], np.cumsum(values)])
    return summed[bounds[1:]] - summed[bounds[:-1]]


def vocab_file(name: str) -> str:
    """The place of a public vocabulary on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """Returns a worker's freed memory to the system; an idle worker would hold it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


class WordMemo:
    """Distinct words met by a Python worker, with the ids that a tokenizer gave each.

    ``encode`` maps a list of new words to each one's start and length in an
    array of ids, and that array. The memo starts anew
    beyond ``most`` words or once another one was in use, which bounds the memory
    of a worker; results don't depend on it. ``forget`` is called then, too.
    """

    used = None

    def __init__(self, encode, most: int = 600_000, forget=None):
        self.encode, self.most, self.forget = encode, most, forget
        self.clear()

    def clear(self) -> None:
        if self.forget:
            self.forget()
        self.index: dict = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def take(self) -> None:
        """Gives the memory of another memo back to the system, as a worker may serve one stage after another."""
        if WordMemo.used not in (None, self):
            WordMemo.used.clear()
            give_back()
        WordMemo.used = self

    def codes(self, words: list) -> np.ndarray:
        """A row of the memo for each word; rows hold until the next call."""
        if len(self.index) > self.most:
            self.clear()
        self.take()
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            starts, lengths, flat = self.encode(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, flat])
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new))))
            rows[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        return rows


def ranked(df: DataFrame, order: list[str], name: str = "ranked") -> DataFrame:
    """df in the order of the columns (nulls first), dealt out by ranges and saved, with __p (number of the range) and __row (increasing within it). No group has to fit into one task."""
    dealt = df.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    return written(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), name)


def crc32_sql(text: str) -> str:
    """SQL of the CRC-32 of ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)),
      lambda c, o: list_reduce(list_prepend(xor(c, o), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""
