"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has 64 bits, each the majority of its word shingles'
hash bits. Documents whose fingerprints differ in at most 3 bits are linked,
and linked documents form classes.

Every distinct fingerprint gets a row of the pivot table: its Hamming distances
to many fixed reference fingerprints, in total and within each of six blocks of
bits. Two fingerprints that differ in at most three bits agree in three blocks
or more, so that there all their distances are equal: the distances within three
blocks (about 32 bits) are a bucket's key, and linked fingerprints meet in a bucket. Within a
bucket, pairs whose total distances to any reference differ by more than three
are discarded (by the triangle inequality they are further apart than that),
and the rest is verified. A bucket gives a spanning forest of its verified
links rather than all of them; classes don't change by that.

Equal fingerprints are joined before any pair is looked at, so copies cost no
pairs. Null and empty texts have fingerprint zero, linked like any other.
Repeated rows are rows of the same class. A null doc_id takes part and is
ignored for the least id of a class. A bit set in exactly half of the hashes is
0. Very long texts are hashed whole, one at a time. Other columns don't matter,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import slices, table, texts, written
from tillwork.llm.components import connected_components

SEED, SHINGLE, BITS = 42, 3, 3
REFERENCES = 16


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with ``fingerprint`` (the 64 bits as a signed long) in place of the text."""
    keep = [c for c in docs.columns if c not in (text, "fingerprint")]

    def hashes(body: bytes) -> list[int]:
        import xxhash

        words = body.lower().split()
        if not words:
            return []
        joined, of = b" ".join(words), xxhash.xxh64_intdigest
        if len(words) <= shingle:
            return [of(joined, seed)]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        return [of(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]

    def work(batches):
        for part in slices(batches, text, 1 << 20):
            found = [hashes(x.as_py().encode()) for x in texts(part, text)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            made = np.zeros(len(found), np.uint64)
            at = np.flatnonzero(counts)
            if len(at):
                flat = np.fromiter((h for hs in found for h in hs), np.uint64, int(counts.sum()))
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                begin = (np.cumsum(counts) - counts)[at]
                over = np.add.reduceat(bits, begin, axis=0, dtype=np.int64) * 2 > counts[at][:, None]
                made[at] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(made.view(np.int64))], names=[*keep, "fingerprint"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(work, ", ".join([*fields, "fingerprint bigint"]))


class PivotTable:
    """Hamming distances to fixed references, in total and within blocks of bits."""

    def __init__(self, bits: int = BITS, references: int = REFERENCES):
        self.bits, blocks = bits, 2 * bits
        self.references = np.random.default_rng(7).integers(0, 1 << 64, references, dtype=np.uint64)
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.masks = [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
        self.keys = list(combinations(range(blocks), blocks - bits))

    def distances(self, fp: np.ndarray, mask=np.uint64((1 << 64) - 1)) -> np.ndarray:
        return np.bitwise_count((fp[:, None] ^ self.references) & mask)

    def bucket_keys(self, fp: np.ndarray) -> np.ndarray:
        """For each fingerprint and choice of blocks, a value of its distances within them."""
        factor = np.uint64(0x9E3779B97F4A7C15)
        mixed = []
        for mask in self.masks:
            value = np.full(len(fp), int(mask) & 0xFFFF, np.uint64)
            for column in self.distances(fp, mask).T:
                value = (value ^ (value >> np.uint64(31))) * factor + column.astype(np.uint64)
            mixed.append(value)
        out = np.zeros((len(fp), len(self.keys)), np.uint64)
        for i, chosen in enumerate(self.keys):
            value = np.full(len(fp), i, np.uint64)
            for b in chosen:
                value = (value ^ (value >> np.uint64(31))) * factor + mixed[b]
            out[:, i] = value
        return out

    def links(self, fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows differ in at most ``bits`` bits: the table discards, survivors are verified."""
        near = np.abs(table[a].astype(np.int16) - table[b].astype(np.int16)).max(axis=1, initial=0) <= self.bits
        near[near] = np.bitwise_count(fp[a[near]] ^ fp[b[near]]) <= self.bits
        return near


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of the links that join two parts not joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return kept


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct fingerprints to links (u, v) that connect all that are within ``bits`` bits of each other."""

    def explode(batches):
        pivots = PivotTable(bits)
        for batch in batches:
            fp = np.asarray(batch.column("fingerprint")).view(np.uint64)
            for at in range(0, len(fp), 50_000):
                part = fp[at : at + 50_000]
                keys = pivots.bucket_keys(part)
                rows = pivots.distances(part)
                n = keys.shape[1]
                table = np.repeat(rows, n, axis=0)
                flat = pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer((np.arange(len(table) + 1, dtype=np.int32) * rows.shape[1]).tobytes()), pa.py_buffer(table.astype(np.uint8).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, n).view(np.int64)), flat], names=["bucket", "fingerprint", "pivots"])

    def meet(batches):
        """Rows sorted by bucket; a bucket may go on in the next batch."""
        pivots = PivotTable(bits)
        held = None

        def found(key, fp, rows):
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(bounds)
            shared = size > 1
            last = np.repeat(bounds[1:], size)
            here = np.flatnonzero(np.repeat(shared, size))
            us, vs = [], []
            for lag in range(1, int(size.max(initial=0))):
                here = here[here + lag < last[here]]
                for at in range(0, len(here), 1 << 20):
                    a = here[at : at + (1 << 20)]
                    good = pivots.links(fp, rows, a, a + lag)
                    us.append(a[good])
                    vs.append(a[good] + lag)
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            kept = _forest(u, v)
            return pa.RecordBatch.from_arrays([pa.array(fp[u[kept]].view(np.int64)), pa.array(fp[v[kept]].view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (np.asarray(batch.column(c)) for c in ("bucket", "fingerprint"))
            rows = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.uint8).reshape(len(key), -1)
            fp = fp.view(np.uint64)
            if held is not None:
                key, fp, rows = np.concatenate([held[0], key]), np.concatenate([held[1], fp]), np.concatenate([held[2], rows])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield found(key[:cut], fp[:cut], rows[:cut])
            held = key[cut:], fp[cut:], rows[cut:]
        if held is not None:
            yield found(*held)

    keyed = distinct.select("fingerprint").mapInArrow(explode, "bucket bigint, fingerprint bigint, pivots binary")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id (least doc_id of the class) and text_hash (xxhash64 of the text, to tell rows of equal doc_id) of every row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    marked = written(fingerprints(named, shingle=shingle), "fingerprints")
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct, bits), "simhash")
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["u"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted = written(rooted, "simhash-roots")
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "text_hash")


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op6_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed(F.col("fingerprint")).alias("fingerprint"), "component_id")
