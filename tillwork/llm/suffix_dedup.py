"""Removal of byte strings that repeat across documents, by bucket-pointer refinement.

Every byte of a document is removed that a string of ``LENGTH`` bytes covers
which also starts in a document of smaller doc_id. Suffixes are never sorted as
a whole; they are dealt into buckets that are refined where they can matter:

1. Initial q-gram buckets. A window of LENGTH bytes belongs to the bucket of
   the least-hashed q-gram in it, so equal windows share a bucket. Neighbouring
   windows of one bucket form a run, which stands for all of them. Buckets that
   occur in one document are final and dropped; most of them are.
2. In a shared bucket, runs of equal bytes are one run, owned by the least
   document that holds it; in any other document the whole run goes.
3. Runs that differ are refined. Their positions are sorted into buckets of 8
   bytes, then again and again by the pair (own bucket, bucket that the later
   offset points to), to 16, 32 and LENGTH bytes; each round reuses the
   buckets of the round before, and a position alone in its bucket leaves the
   sort. Windows that end in one bucket are equal, and go where the least
   owner is smaller than their own.

Spark shuffles the texts once, into chunks of bounded size (the exchange is
reused by all passes over the text), and buckets by q-gram hash. A
bucket of over ``HOT`` different runs is dealt by window instead, so no task
gathers an unbounded group; rows are reduced within a chunk before each shuffle.

Null texts count as empty; texts under LENGTH bytes lose nothing. doc_id is an
integer; rows of equal doc_id don't remove each other's bytes, and a null
doc_id counts as greater than any. Very long texts are a pass of their own, and
runs within them are cut to bounded length. Other columns pass through, but for those
that bear an output's name. An empty table gives no rows.

Runs and buckets are told apart by 64 bits of a polynomial value, as are windows of
hot buckets; bytes are compared by refinement within buckets of several runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import SLICE_BYTES, give_back, ragged, slices, table, texts

LENGTH, Q = 50, 20
CHUNK_BYTES = 8 << 20
HOT = 10_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max  # the doc_id of rows that have none


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n; kept for the next call."""
    if len(_held.get("p", ())) <= n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, _U)
        _held["p"] = np.concatenate([one, np.cumprod(np.full(n, _BASE))])
        _held["i"] = np.concatenate([one, np.cumprod(np.full(n, inverse))])
    return _held["p"], _held["i"]


_held: dict = {}


class Windows:
    """The windows of a run of whole texts, as runs of one bucket each."""

    def __init__(self, block: pa.Array, length: int = LENGTH, q: int = Q):
        bounds = np.frombuffer(block.buffers()[1], np.int64)[block.offset : block.offset + len(block) + 1]
        self.raw = np.frombuffer(block.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.length = length
        n = len(self.raw)
        power, self.inverse = _powers(n + 1)
        prefix = np.zeros(n + 1, _U)
        np.cumsum(self.raw * power[:n] + power[:n], out=prefix[1:])
        self.prefix = prefix
        windows = np.maximum(np.diff(self.bounds) - length + 1, 0)
        at = ragged(self.bounds[:-1], windows)
        if not len(at):
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.bucket = np.zeros(0, _U)
            return
        least = self.hashes(np.arange(n - q + 1), q)
        wide, reach = length - q + 1, 1
        while reach * 2 <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: reach - wide], least[wide - reach :])
        least = least[at]
        first = np.ones(len(at), bool)
        first[1:] = (least[1:] != least[:-1]) | (np.diff(at) != 1)
        opening = np.cumsum(windows) - windows  # neighbours in the buffer may be of two documents
        first[opening[windows > 0]] = True
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        if (size > wide).any():  # a bucket may go on where a text repeats itself; runs are cut to bounded length
            pieces = -(-size // wide)
            inner = ragged(np.zeros(len(size), np.int64), pieces) * wide
            begin = np.repeat(begin, pieces) + inner
            size = np.minimum(np.repeat(size, pieces) - inner, wide)
        # 48 bits name a bucket in every shuffle; buckets that share a name are refined apart
        self.start, self.count, self.bucket = at[begin], size, least[begin] >> _U(16)
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        """A 64-bit value of each string start:start+size."""
        return _mix((self.prefix[start + size] - self.prefix[start]) * self.inverse[start] + np.asarray(size).astype(_U))

    def runs(self, which=slice(None)) -> np.ndarray:
        return self.hashes(self.start[which], self.count[which] + self.length - 1)


def refine(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket of the ``length`` bytes at each position of data, equal for equal bytes.

    ends: where the string that holds a position ends; of positions with fewer bytes before it, buckets mean nothing.
    """
    n = len(data)
    q = min(8, length)
    gram = np.zeros(n, _U)
    for j in range(q):
        gram[: n - j] |= data[j:].astype(_U) << _U(8 * (7 - j))
    where = np.arange(n)
    _, bucket = np.unique(gram, return_inverse=True)
    size = q
    while size < length:
        offset = min(size, length - size)
        shared = np.bincount(bucket)[bucket] > 1
        active = np.flatnonzero(shared & (where + size + offset <= ends))
        key = (bucket[active].astype(_U) << _U(32)) | bucket[active + offset].astype(_U)
        kinds, rank = np.unique(key, return_inverse=True)
        alone = np.ones(n, bool)
        alone[active] = False
        updated = np.empty(n, np.int64)
        updated[active] = rank
        updated[alone] = len(kinds) + np.arange(n - len(active))
        bucket, size = updated, size + offset
    return bucket


def _carried(batches, key: str, work):
    """Calls work on tables of whole groups, of batches that are sorted by key."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now])
        keys = np.asarray(now.column(key).combine_chunks())
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from work(now.slice(0, cut))
        held = now.slice(cut)
    if held is not None:
        yield from work(held)


def _np(t, name):
    c = t.column(name)
    return np.asarray(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)


def _views(t: pa.Table, text: str, length: int, q: int, most: int = SLICE_BYTES):
    for batch in t.combine_chunks().to_batches():
        for part in slices([batch], text, most):
            ids = np.asarray(pc.fill_null(part.column("__doc"), _LAST))
            yield part, ids, Windows(texts(part, text), length, q)
    give_back()  # a worker holds one chunk at a time


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    body = data[ragged(start, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = Q, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT, characters: bool = False, pass_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs with, in place of the text, n_bytes, removed (array of start and length in bytes) and kept (binary: what is left of the text); with ``characters``, those that are cut in two go whole.

    A chunk is what is reduced before a shuffle; a pass of ``pass_bytes`` takes some hundred times as much memory."""
    out = ("n_bytes", "removed", "kept")
    keep = [c for c in docs.columns if c not in (text, *out)]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    place = F.pmod(F.xxhash64(doc_id, F.length(text)), F.lit(chunks)).cast("int")
    source = docs.select(*keep, F.col(text), F.col(doc_id).cast("long").alias("__doc"), place.alias("__chunk"))
    by_chunk = source.groupBy("__chunk")

    def buckets(t: pa.Table) -> pa.Table:
        """Each bucket of a chunk and the number of its different runs, negative if two rows hold it."""
        found = []
        for n, (_, _, w) in enumerate(_views(t, text, length, q)):
            found.append((w.bucket, w.runs(), w.doc + (n << 32)))
        bucket, run, row = (np.concatenate(x) if found else np.zeros(0, _U) for x in (zip(*found) if found else ((), (), ())))
        order = np.lexsort((run, bucket))
        bucket, run, row = bucket[order], run[order], row[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])]) if len(bucket) else np.zeros(0, bool)
        runs = np.add.reduceat(fresh.astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
        several = np.minimum.reduceat(row, first) < np.maximum.reduceat(row, first) if len(first) else np.zeros(0, bool)
        chunk = np.full(len(first), t.column("__chunk")[0].as_py(), np.int32)
        return pa.table({"bucket": bucket[first].view(np.int64), "chunk": chunk, "runs": np.where(several, -runs, runs).astype(np.int32)})

    def shared(batches):
        """The buckets that two rows hold, for each chunk that has them."""

        def work(t):
            bucket, runs = _np(t, "bucket"), _np(t, "runs").astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.append(first, len(bucket)))
            good = (size > 1) | (runs[first] < 0)
            many = np.add.reduceat(np.abs(runs), first) > hot
            rows = np.repeat(good, size)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(_np(t, "chunk")[rows]), pa.array(bucket[rows]), pa.array(np.repeat(many, size)[rows])], names=["chunk", "bucket", "hot"])

        yield from _carried(batches, "bucket", work)

    def runs(t: pa.Table, mine: pa.Table) -> pa.Table:
        """The different runs of a chunk's shared buckets, or their windows in hot ones, with the least document of each, and the greatest if it is another."""
        schema = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("hot", pa.bool_()), ("least", pa.int64()), ("most", pa.int64()), ("chunk", pa.int32())])
        if not t.num_rows or not mine.num_rows:
            return schema.empty_table()
        wanted = _np(mine, "bucket").view(_U)
        order = np.argsort(wanted)
        wanted, heat = wanted[order], mine.column("hot").combine_chunks().to_numpy(zero_copy_only=False)[order]
        chunk = mine.column("chunk")[0].as_py()
        made = []
        for _, ids, w in _views(t, text, length, q, pass_bytes):
            at = np.minimum(np.searchsorted(wanted, w.bucket), len(wanted) - 1)
            hit = wanted[at] == w.bucket
            for warm in (False, True):
                chosen = np.flatnonzero(hit & (heat[at] == warm))
                if not len(chosen):
                    continue
                start, count, key, doc = w.start[chosen], w.count[chosen], w.bucket[chosen], ids[w.doc[chosen]]
                value = w.runs(chosen)
                if warm:
                    doc = np.repeat(doc, count)
                    key = value = w.hashes(ragged(start, count), length)
                by = np.lexsort((doc, value, key))
                key, value, doc = key[by], value[by], doc[by]
                fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])]))
                made.append(pa.table([key[fresh].view(np.int64), value[fresh].view(np.int64), np.full(len(fresh), warm), doc[fresh], np.maximum.reduceat(doc, fresh), np.full(len(fresh), chunk, np.int32)], schema=schema))
        if not made:
            return schema.empty_table()
        found = pa.concat_tables(made)
        if len(made) > 1 and pass_bytes < SLICE_BYTES:  # small passes leave more equal runs to each other
            found = found.group_by(["key", "run", "hot", "chunk"], use_threads=False).aggregate([("least", "min"), ("most", "max")]).rename_columns(["key", "run", "hot", "chunk", "least", "most"]).select(schema.names)
        other = pc.not_equal(found.column("most"), found.column("least"))
        return found.set_column(4, schema.field("most"), pc.if_else(other, found.column("most"), pa.scalar(None, pa.int64())))

    def owners(batches):
        """For each chunk that has to know: run and its owner; and, of buckets with several runs, which chunk has to show an owner's bytes."""

        def work(t):
            key, run, least, chunk = (_np(t, c) for c in ("key", "run", "least", "chunk"))
            most = np.asarray(pc.fill_null(t.column("most").combine_chunks(), t.column("least").combine_chunks()))
            heat = t.column("hot").combine_chunks().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] != key[:-1]) | (heat[1:] != heat[:-1])]))
            size = np.diff(np.append(first, len(run)))
            owner = np.repeat(np.minimum.reduceat(least, first), size)
            group = np.cumsum(np.concatenate([[True], key[first][1:] != key[first][:-1]])) - 1
            mixed = np.repeat((np.bincount(group)[group] > 1) & ~heat[first], size)
            for show, say in ((False, most > owner), (True, mixed & (least == owner))):
                if say.any():
                    named = pa.array(key[say]) if show else pa.nulls(int(say.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(chunk[say]), named, *(pa.array(x[say]) for x in (run, heat, owner)), pa.array(np.full(int(say.sum()), show))], names=["chunk", "key", "run", "hot", "owner", "show"])

        yield from _carried(batches, "key", work)

    def bodies(t: pa.Table, asked: pa.Table) -> pa.Table:
        """The bytes of the runs that are asked for."""
        schema = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("owner", pa.int64()), ("chunk", pa.int32()), ("body", pa.binary())])
        if not t.num_rows or not asked.num_rows:
            return schema.empty_table()
        run = _np(asked, "run").view(_U)
        order = np.argsort(run)
        run, key, owner = run[order], _np(asked, "key")[order], _np(asked, "owner")[order]
        chunk, shown, made = asked.column("chunk")[0].as_py(), np.zeros(len(run), bool), []
        for _, ids, w in _views(t, text, length, q, pass_bytes):
            value = w.runs()
            at = np.minimum(np.searchsorted(run, value), len(run) - 1)
            hit = np.flatnonzero((run[at] == value) & (ids[w.doc] == owner[at]) & ~shown[at])
            one, where = np.unique(at[hit], return_index=True)
            hit = hit[where]
            shown[one] = True
            made.append(pa.table([key[one], run[one].view(np.int64), owner[one], np.full(len(one), chunk, np.int32), _binary(w.raw, w.start[hit], w.count[hit] + length - 1)], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    def refined(batches):
        """Of runs that differ within a bucket, the windows that a run of a smaller owner holds too."""

        def work(t):
            key, run, owner, chunk = (_np(t, c) for c in ("key", "run", "owner", "chunk"))
            first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] != key[:-1])]))
            gone = np.zeros(len(first), np.int64)
            shown = t.column("body").combine_chunks().take(pa.array(first))
            for some in _blocks(np.arange(len(first)), key[first], pass_bytes // 100):
                gone[some] = _overlaps(shown.take(pa.array(some)), owner[first][some], length)
            gone = np.repeat(gone, np.diff(np.append(first, len(run))))
            say = gone != 0
            if say.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[say]) for x in (chunk, run, np.zeros(len(run), bool), owner, gone)], names=["chunk", "run", "hot", "owner", "gone"])

        yield from _carried(batches, "key", work)
        give_back()

    names = [*keep, *out]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    result = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "n_bytes bigint, removed array<struct<start:bigint,length:bigint>>, kept binary"])

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        known = {}
        for warm in (False, True):
            rows = told.filter(pc.equal(told.column("hot"), warm)) if told.num_rows else told
            run = _np(rows, "run").view(_U) if rows.num_rows else np.zeros(0, _U)
            order = np.argsort(run)
            run, owner, gone = run[order], *(_np(rows, c)[order] if rows.num_rows else run.view(np.int64) for c in ("owner", "gone"))
            if len(run):  # a run may have a row for its owner and one for the windows that go
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                run, owner, gone = run[first], owner[first], np.bitwise_or.reduceat(gone, first)
            known[warm] = run, owner, gone
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        made = []
        for part, ids, w in _views(t, text, length, q, pass_bytes):
            cover = np.zeros(len(w.raw) + 1, np.int32)

            def drop(starts, counts):
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + counts + length - 1, -1)

            run, owner, gone = known[False]
            if len(run) and len(w.start):
                value = w.runs()
                at = np.minimum(np.searchsorted(run, value), len(run) - 1)
                hit = np.flatnonzero(run[at] == value)
                at, doc = at[hit], ids[w.doc[hit]]
                whole = doc > owner[at]
                drop(w.start[hit[whole]], w.count[hit[whole]])
                own = np.flatnonzero((doc == owner[at]) & (gone[at] != 0))
                for bit in range(length - q + 1):
                    lost = own[(gone[at[own]] >> bit) & 1 == 1]
                    drop(w.start[hit[lost]] + bit, np.ones(len(lost), np.int64))
            run, owner, _ = known[True]
            if len(run) and len(w.start):
                start, doc = ragged(w.start, w.count), ids[np.repeat(w.doc, w.count)]
                value = w.hashes(start, length)
                at = np.minimum(np.searchsorted(run, value), len(run) - 1)
                lost = start[(run[at] == value) & (doc > owner[at])]
                drop(lost, np.ones(len(lost), np.int64))
            stay = np.cumsum(cover[:-1]) == 0
            if characters and len(stay):
                head = np.flatnonzero((w.raw & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(stay, head)
                stay = np.repeat(whole, np.diff(np.append(head, len(stay))))
            # maximal removed runs, cut at the bounds of documents
            left = np.concatenate([[0], np.cumsum(stay)])
            lost = (~stay).astype(np.int8)
            opens = np.diff(lost, prepend=np.int8(0)) == 1
            shut = np.diff(lost, append=np.int8(0)) == -1
            edges = w.bounds[:-1][np.diff(w.bounds) > 0]
            opens[edges] = lost[edges] == 1
            shut[edges[1:] - 1] = lost[edges[1:] - 1] == 1
            opens, shut = np.flatnonzero(opens), np.flatnonzero(shut) + 1
            doc = np.searchsorted(w.bounds, opens, side="right") - 1
            per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            spans = pa.StructArray.from_arrays([pa.array(opens - w.bounds[doc]), pa.array(shut - opens)], names=["start", "length"])
            body = w.raw[stay]
            kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left[w.bounds].astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            made.append(pa.table([*[part.column(c) for c in keep], pa.array(np.diff(w.bounds)), pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans), kept], names=names))
        if made:
            return pa.concat_tables(made)
        return t.select(keep).append_column("n_bytes", pa.array([], pa.int64())).append_column("removed", pa.array([], span)).append_column("kept", pa.array([], pa.binary()))

    held = by_chunk.applyInArrow(buckets, "bucket bigint, chunk int, runs int")
    mine = held.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "chunk int, bucket bigint, hot boolean")
    told = by_chunk.cogroup(mine.groupBy("chunk")).applyInArrow(runs, "key bigint, run bigint, hot boolean, least bigint, most bigint, chunk int")
    owned = told.repartition("key").sortWithinPartitions("key", "hot", "run").mapInArrow(owners, "chunk int, key bigint, run bigint, hot boolean, owner bigint, show boolean")
    asked = owned.where("show").select("chunk", "key", "run", "owner")
    shown = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(bodies, "key bigint, run bigint, owner bigint, chunk int, body binary")
    partly = shown.repartition("key").sortWithinPartitions("key", "run").mapInArrow(refined, "chunk int, run bigint, hot boolean, owner bigint, gone bigint")
    whole = owned.where("not show").select("chunk", "run", "hot", "owner", F.lit(0).cast("long").alias("gone"))
    return by_chunk.cogroup(whole.union(partly).groupBy("chunk")).applyInArrow(cut, result)


def _blocks(which: np.ndarray, group: np.ndarray, most: int = 20_000):
    """Runs of whole groups, of about ``most`` rows."""
    if not len(which):
        return
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = 0
    for a, b in zip(edges, [*edges[1:], len(which)]):
        if b - start > most and a > start:
            yield which[start:a]
            start = a
    yield which[start:]


def _overlaps(bodies: pa.Array, owner: np.ndarray, length: int) -> np.ndarray:
    """For different runs, the windows (bits) that a run of a smaller owner holds too."""
    sizes = np.asarray(pc.binary_length(bodies), np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(bodies.to_pylist()), np.uint8)
    bucket = refine(data, np.repeat(ends, sizes), length)
    count = sizes - length + 1
    at = ragged(ends - sizes, count)
    who = np.repeat(np.arange(len(sizes)), count)
    same = bucket[at]
    order = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    least = np.repeat(np.minimum.reduceat(owner[who[order]], first), np.diff(np.append(first, len(order))))
    gone = least < owner[who[order]]
    row, bit = who[order][gone], (at - np.repeat(ends - sizes, count))[order][gone]
    out = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(out, row, np.int64(1) << bit)
    return out


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["length"]), F.lit(0)).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
