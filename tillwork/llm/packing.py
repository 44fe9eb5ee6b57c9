"""Packing into windows of bounded length by Karmarkar-Karp multiway differencing.

Each Spark task tokenizes its documents and cuts them: every full window's
worth of a document is a sequence of its own, the rest is cut into near-equal
pieces of at most ``piece`` ids. Pieces gather in groups of ``group``; a group
of n pieces is packed by largest differencing: every piece begins as a partial
partition into k windows, and the two partitions of largest difference between
fullest and emptiest window are merged with opposing imbalances (fullest onto
emptiest) until one is left. k begins at the least count that can hold the
group and rises while any window exceeds its capacity.

No row is shuffled: sequences are numbered by task and position within it, so
padding is the unevenness within groups and one partial group a task. Lost
tasks give the same pieces again from the same input split.

Null and empty texts have the end id alone. Very long texts are tokenized whole
and give one full window after another. Of partitions of equal difference the
earlier made one goes first, so equal inputs give equal windows. Repeated rows
are packed like any other; null document ids stay null; other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import SLICE_BYTES, WordMemo, give_back, ragged, slices, split_words, strings, table, texts, vocab_file

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
_SUM = itemgetter(0)
#: Letters beyond ASCII that normalising leaves as they are but for a one-to-one lower case: Latin-1 and Latin Extended-A, without the dotted capital I.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: What byte-level vocabularies write for the bytes of the Latin-1 characters that don't stand for themselves.
_BYTES = dict(zip([*range(0x21), *range(0x7F, 0xA1), 0xAD], range(0x100, 0x144)))


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Largest differencing into k windows: sums of those in use, fullest first, and the pieces of each."""
    heap = [(-s, i, [(-s, (i,))]) for i, s in enumerate(sizes)]  # sums are negated, so that plain order has the fullest first
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - k)  # windows in use on both sides; the others take a's or b's alone
        apart = len(a) - shared
        merged = a[:apart] + b[: len(b) - shared]
        merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[apart:], reversed(b))]
        merged.sort(key=_SUM)
        heapq.heappush(heap, (merged[0][0] - (merged[-1][0] if len(merged) == k else 0), serial, merged))
        serial += 1
    last = heap[0][2] if heap else []
    return [-w[0] for w in last], [list(w[1]) for w in last]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces of each window; no window exceeds the capacity, which no piece does."""
    k = low = max(1, -(-sum(sizes) // capacity))
    sums, windows = differencing(sizes, k)
    while sums and sums[0] > capacity:  # the count rises while a window exceeds the capacity
        low, k = k + 1, max(k + 1, k * sums[0] // capacity)
        sums, windows = differencing(sizes, k)
    while k - low > k >> 6:  # and falls back where that was too much: equal pieces exceed it by far at first
        middle = (low + k) // 2
        sums, fewer = differencing(sizes, middle)
        if sums[0] <= capacity:
            k, windows = middle, fewer
        else:
            low = middle + 1
    return windows


def _word_encoder(path: str, parts: dict[str, list[int]]):
    """Ids of words by the tokenizer. Words of printable ASCII and Latin letters are cut as its pattern cuts them and each part
    is given to its model once, which spares them the tokenizer's normalising; all others go through the whole tokenizer."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    cut, model = re.compile(f"[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+").findall, own.model
    plain = re.compile(f"[!-&(-~{LATIN}]+").fullmatch  # without the apostrophe, which begins parts of its own

    def ids_of(part: str) -> tuple[int, ...]:
        if (known := parts.get(part)) is None:
            written = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
            known = parts[part] = tuple([t.id for t in model.tokenize(written)])
        return known

    def by_tokenizer(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = own.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)), np.array(got.ids, np.int32)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(parts) > 300_000:
            parts.clear()
        flat: list[int] = []
        ends, rest = [], []
        for i, word in enumerate(words):
            if plain(word):
                low = word.lower()
                if (known := parts.get(low)) is not None:  # a part is cut into itself alone
                    flat += known
                elif low.isalpha():
                    flat += ids_of(low)
                else:
                    for part in cut(low):
                        flat += ids_of(part)
            else:
                rest.append(i)
            ends.append(len(flat))
        lengths = np.diff(np.array(ends, np.int64), prepend=0)
        starts = np.array(ends, np.int64) - lengths
        ids = [np.array(flat, np.int32)]
        at = len(flat)
        for first in range(0, len(rest), 4096):  # their ids follow those of all others
            some = rest[first : first + 4096]
            many, got = by_tokenizer([words[i] for i in some])
            lengths[some] = many
            starts[some] = at + np.cumsum(many) - many
            ids.append(got)
            at += len(got)
        return starts, lengths, np.concatenate(ids)

    probes = ["ab12cd", "A1B2", "x-y.z", "100,000", "#*(a)", "e-mail@host.org", "__init__", "<s>", "\u00c9t\u00e9s,", "\u015a\u017bx9\u00df", "\u0178\u0149\u0100!\u017f"]
    many, whole = by_tokenizer(probes)
    starts, lengths, ids = encode(probes)
    if not (np.array_equal(lengths, many) and np.array_equal(ids[ragged(starts, lengths)], whole)):
        raise ValueError(f"{path} cuts words in another way than this encoder does")
    return encode


_memos: dict[str, WordMemo] = {}


def memo(vocabulary: str) -> WordMemo:
    path = vocab_file(vocabulary)
    if path not in _memos:
        parts: dict[str, list[int]] = {}
        _memos[path] = WordMemo(_word_encoder(path, parts), forget=parts.clear)
    return _memos[path]


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, piece: int = 512, group: int = 1500, stay: bool = True) -> DataFrame:
    """One row per piece: its place in document and sequence, and its ids as little-endian unsigned 32-bit integers.

    The vocabulary must drop white space and encode words apart from each other, as word_bpe_49k does. stay: whether a
    worker keeps vocabulary and words for its next task, which is faster and takes memory meanwhile.
    """

    def work(batches):
        from pyspark import TaskContext

        words = memo(vocabulary)
        words.take()
        words.most = 600_000 if stay else 200_000
        sequence = TaskContext.get().partitionId() << 33
        waiting: list = []

        def emit(rows):
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def close():
            nonlocal sequence, waiting
            rows = []
            for chosen in pack([p[2] for p in waiting], window):
                at = 0
                for i in sorted(chosen):
                    rows.append((*waiting[i], sequence, at))
                    at += waiting[i][2]
                sequence += 1
            waiting = []
            return emit(rows)

        for part in slices(batches, "text", SLICE_BYTES if stay else SLICE_BYTES // 2):
            codes, ends, found = split_words(texts(part))
            known = words.codes(strings(found))[codes] if len(codes) else codes.astype(np.int64)
            lengths = words.lengths[known]
            ids = words.ids[ragged(words.starts[known], lengths)].astype("<u4")
            bounds = np.concatenate([[0], np.cumsum(lengths)])[ends]
            full = []
            for d, (doc, a, b) in enumerate(zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:])):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                n = len(own)
                cut = n // window * window
                for at in range(0, cut, window):
                    full.append((doc, at, window, own[at : at + window].tobytes(), n, sequence, 0))
                    sequence += 1
                if cut < n:
                    many = -(-(n - cut) // piece)
                    edges = [cut + (n - cut) * i // many for i in range(many + 1)]
                    waiting += [(doc, x, y - x, own[x:y].tobytes(), n) for x, y in zip(edges, edges[1:])]
                if len(waiting) >= group:
                    yield close()
            if full:
                yield emit(full)
        if waiting:
            yield close()
        if not stay:
            words = WordMemo.used = None
            _memos.clear()
            give_back()

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(work, PIECES)


def op3_packing(spark, sf_dir) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
