"""The trie of conversation prefixes; a count-min sketch tells most tails that nobody else shares, and they are never shuffled.

A prefix of k turns has a digest of 120 bits: the exclusive or, over its turns,
of SHA-256 of the turn's place, role and text. Such digests can be carried on from
any point, so a conversation of any length is worked on in chunks of 1,024 turns.

All prefixes are counted in a count-min sketch of three rows. An estimate of one
proves that a prefix is one conversation's own, and so are all that are longer:
their nodes (the tail) are written where the conversation is. Only prefixes whose
estimate is two or more are shuffled and grouped by their whole digests. The
sketch's cells that were hit twice are a bitmap, the one thing that is sent to all
tasks: at most WIDEST cells a row, 25 MB in all. It is as wide as the number of
prefixes asks for; beyond that bound it proves less and more is grouped, with the same result.

Sums over subtrees: each node belongs to its smallest member, so each conversation
adds, to each of its shared prefixes, the values of its own nodes from there on.
That is one row for each conversation and shared prefix, and a sum that combines within tasks.

Rows of a conversation go by turn (nulls first), then role and SHA-256 of the text,
as ties and repeated rows are turns of their own. Null roles and texts are empty.
Rows without conv_id belong to no conversation and are left out. Texts are read
once, where they are, and only their digests move. An empty table gives no rows.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import crc32_sql, ranked, table, written

CHUNK = 1024
#: Cells of a row of the sketch, at least and at most.
NARROWEST, WIDEST = 1 << 16, 1 << 26
SKETCH_ROWS = 3
_NODE = ["depth", "a", "b"]


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, role, digest, length) and conversations (conv_id, n)."""
    text = F.coalesce("text", F.lit(""))
    small = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("length"))
    dealt = ranked(small, ["conv_id", "turn", "role", "digest"], "turns")
    runs = dealt.groupBy("conv_id", "__p").agg(F.min("__row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select("conv_id", "__p", "n", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")), "runs")
    rows = dealt.join(runs.select("conv_id", "__p", "shift"), ["conv_id", "__p"]).select("conv_id", (F.col("__row") + F.col("shift")).alias("pos"), "role", "digest", "length")
    return rows, runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with their family's first turns: turns (conv_id, pos, role, digest, length) and conversations (conv_id, n).

    Of conversation c, the first h turns, h = crc32(c) % heads, are those of conversation c - c % family (fewer if it has
    fewer, none if it isn't there); its own turns after its first h follow. % keeps the sign of c.
    """
    rows, convs = placed(turns)
    rows, convs = written(rows, "placed"), written(convs, "conversations")
    base = F.col("conv_id") % family
    first = rows.where((base == 0) & (F.col("pos") < heads))
    bases = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "digest", "length"))).alias("firsts"))  # under ``heads`` turns
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    told = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - base).alias("base")).join(bases, "base", "left")
    head = F.coalesce(F.slice("firsts", F.lit(1), F.col("h")), F.expr("slice(array(named_struct('pos', 0L, 'role', '', 'digest', '', 'length', 0L)), 1, 0)"))
    told = written(told.select("conv_id", "n", "h", head.alias("head")), "heads")
    lead = told.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.role", "t.digest", "t.length")
    sizes = told.select("conv_id", "h", F.size("head").alias("lead"))
    rest = rows.join(sizes, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "role", "digest", "length")
    return lead.unionByName(rest), told.select("conv_id", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _lists(batch, name):
    """Values of a list column, one after another, and where each list begins and ends."""
    column = batch.column(name)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    return np.array(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])


def _list_of(values, bounds, kind=pa.int64()):
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, n, chunk, lo, xa, xb, a, b, length): the digests (two numbers) and last lengths of a chunk of each conversation's prefixes, and the digest before them; the first chunk begins with the empty prefix."""
    hex_ = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), F.length("role").cast("string"), "role", "digest"), 256)
    lane = lambda i: F.conv(F.substring(hex_, i, 15), 16, 10).cast("long")
    values = turns.select("conv_id", "pos", lane(1).alias("a"), lane(16).alias("b"), "length")
    roots = conversations.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("pos", "a", "b", "length")])
    chunk = F.floor(F.col("pos") / CHUNK).cast("long").alias("chunk")
    item = F.struct("pos", "a", "b", "length")
    chunks = values.unionByName(roots).groupBy("conv_id", chunk).agg(F.array_sort(F.collect_list(item)).alias("t"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.transform("t", lambda x: x[c]).alias(c)
    begun = chunks.select("conv_id", "chunk", part("a"), part("b"), part("length"), *[F.coalesce(F.bit_xor(x).over(ahead), F.lit(0)).alias(x) for x in ("xa", "xb")])
    sized = begun.join(conversations, "conv_id").select("conv_id", "n", "chunk", (F.col("chunk") * CHUNK).alias("lo"), "a", "b", "length", "xa", "xb")

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in ("conv_id", "n", "chunk", "lo", "xa", "xb")}
            for name, carried in (("a", "xa"), ("b", "xb")):
                values, bounds = _lists(batch, name)
                start = np.asarray(batch.column(carried))
                for i in range(batch.num_rows):
                    s, e = bounds[i], bounds[i + 1]
                    values[s:e] = np.bitwise_xor.accumulate(values[s:e]) ^ start[i]
                columns[name] = _list_of(values, bounds)
            columns["length"] = batch.column("length")
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return sized.mapInArrow(run, "conv_id long, n long, chunk long, lo long, xa long, xb long, a array<long>, b array<long>, length array<long>")


def _cells(a, b, width):
    """Cells of each digest in the rows of the sketch, one row after another."""
    at = [((a + r * b) & (width - 1)) + r * width for r in range(SKETCH_ROWS)]
    return np.stack(at)


def sketch(chunks: DataFrame, width: int) -> DataFrame:
    """Cells that were hit twice or more, as a bitmap: (bucket, bits) of 32,768 cells each."""

    def run(batches):
        for batch in batches:
            a, bounds = _lists(batch, "a")
            b, _ = _lists(batch, "b")
            real = np.ones(len(a), bool)
            real[bounds[:-1][np.asarray(batch.column("lo")) == 0]] = False  # not the empty prefix
            cells, seen = np.unique(_cells(a[real], b[real], width).ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(seen)], ["cell", "seen"])

    hit = chunks.select("lo", "a", "b").mapInArrow(run, "cell long, seen long").groupBy("cell").agg(F.sum("seen").alias("seen")).where("seen > 1")
    return hit.groupBy(F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits"))  # buckets and values count from 1


def screened(chunks: DataFrame) -> DataFrame:
    """chunks with ``cut``: the depth of the conversation's last prefix that others may share."""
    n = chunks.agg(F.sum(F.size("a"))).first()[0] or 0
    width = min(WIDEST, max(NARROWEST, 1 << int(4 * n).bit_length()))
    bits = np.zeros(SKETCH_ROWS * width // 8, np.uint8)  # at most 3 * WIDEST bits
    for row in sketch(chunks, width).collect():  # as many rows as the bitmap has parts of 4 KB
        at = (row["bucket"] - 1) * 4096
        part = np.frombuffer(row["bits"], np.uint8)
        bits[at : at + len(part)] |= part[: len(bits) - at]
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for batch in batches:
            a, bounds = _lists(batch, "a")
            b, _ = _lists(batch, "b")
            cells = _cells(a, b, width)
            twice = ((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=0)
            lo = np.asarray(batch.column("lo"))
            twice[bounds[:-1][lo == 0]] = True  # the empty prefix
            depth = np.arange(len(a)) - np.repeat(bounds[:-1] - lo, np.diff(bounds))
            own = np.where(twice, np.iinfo(np.int64).max, depth)
            first = np.minimum.reduceat(own, bounds[:-1]) if len(a) else own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "own"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    found = chunks.mapInArrow(run, f"{fields}, own long")
    least = F.min("own").over(Window.partitionBy("conv_id"))
    return found.withColumn("cut", F.least(least - 1, F.col("n"))).drop("own")


def _ends(members: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of members (depth, a, b, conv_id): ids are put in order by ranges, and a node's ranges are read as a stream."""
    dealt = ranked(members, [*_NODE, "conv_id"], "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = dealt.groupBy(*_NODE, "__p").agg(ids.alias("ids")).repartition(*_NODE).sortWithinPartitions(*_NODE, "__p")

    def run(batches):
        node, digest, out = None, None, []
        for batch in batches:
            for depth, a, b, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")]):
                if (depth, a, b) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, a, b), hashlib.sha256(ids.encode())
            if out:
                yield as_batch(out)
                out = []
        if node:
            yield as_batch([(*node, digest.hexdigest())])

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*_NODE, "ends_sha256"])

    return pieces.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _subtrees(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, saved, leaves): sums over the subtrees of nodes (depth, a, b, conv_id of the owner, charge, leaf)."""
    chunk = F.floor(F.col("depth") / CHUNK).cast("long").alias("chunk")
    owned = nodes.where("charge > 0 or leaf").groupBy("conv_id", chunk).agg(F.collect_list("depth").alias("at"), F.collect_list("charge").alias("charge"), F.collect_list(F.col("leaf").cast("long")).alias("leaf"), F.sum("charge").alias("charges"), F.sum(F.col("leaf").cast("long")).alias("leafs"))
    near = chunks.where("lo <= cut").select("conv_id", "n", "chunk", "lo", "cut", "a", "b").join(owned, ["conv_id", "chunk"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(later), F.lit(0))
    tail = (F.col("n") > F.col("cut")).cast("long")
    summed = near.select("lo", "cut", "a", "b", "at", "charge", "leaf", beyond("charges").alias("charges"), (beyond("leafs") + tail).alias("leafs")).where("charges > 0 or leafs > 0 or at is not null")

    def run(batches):
        for batch in batches:
            a, bounds = _lists(batch, "a")
            b, _ = _lists(batch, "b")
            at, spots = _lists(batch, "at")
            charge, _ = _lists(batch, "charge")
            leaf, _ = _lists(batch, "leaf")
            lo, cut, charges, leafs = (np.asarray(batch.column(c)) for c in ("lo", "cut", "charges", "leafs"))
            out = []
            for i in range(batch.num_rows):
                m = int(min(bounds[i + 1] - bounds[i], cut[i] - lo[i] + 1))
                s, l_ = np.zeros(m, np.int64), np.zeros(m, np.int64)
                own = at[spots[i] : spots[i + 1]] - lo[i]
                s[own], l_[own] = charge[spots[i] : spots[i + 1]], leaf[spots[i] : spots[i + 1]]
                depth = np.arange(m) + lo[i]
                s, l_ = np.cumsum(s[::-1])[::-1] + charges[i], np.cumsum(l_[::-1])[::-1] + leafs[i]
                out.append((depth, a[bounds[i] : bounds[i] + m], b[bounds[i] : bounds[i] + m], s, l_))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [*_NODE, "saved", "leaves"])

    added = summed.mapInArrow(run, "depth long, a long, b long, saved long, leaves long")
    return added.groupBy(*_NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    turns: (conv_id, pos from 1, role, digest of the text, length); conversations: (conv_id, n), those without turns too.
    """
    nothing = hashlib.sha256(b"").hexdigest()
    chunks = written(screened(written(prefixes(turns, conversations), "prefixes")), "screened")
    depth = F.col("lo") + F.col("i")
    above = lambda c, x: F.concat(F.array(F.when(F.col("lo") > 0, F.col(x))), F.slice(c, 1, F.size(c) - 1)).alias(f"p{c}")
    item = F.posexplode(F.arrays_zip("a", "b", "length", above("a", "xa"), above("b", "xb")))
    flat = chunks.select("conv_id", "n", "lo", "cut", item.alias("i", "x")).select("conv_id", "n", "cut", depth.alias("depth"), "x.a", "x.b", "x.length", "x.pa", "x.pb")

    # prefixes that may be shared are grouped by their digests
    maybe = flat.where("depth <= cut")
    here = maybe.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("length"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.sum(((F.col("depth") == F.col("cut")) & (F.col("n") > F.col("cut"))).cast("long")).alias("tails"),
    )
    nodes = written(here, "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    counted = nodes.join(kids, _NODE, "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.col("tails"))
    counted = written(counted.withColumn("charge", (F.col("n_convs") - 1) * F.col("length")).withColumn("leaf", F.col("n_children") == 0), "counted")
    sums = _subtrees(chunks, counted)
    ends = _ends(maybe.where("depth = n").select(*_NODE, "conv_id"))
    full = written(counted.join(sums, _NODE, "left").join(ends, _NODE, "left"), "full")

    # tails are written where they are, but for the parent of their first node
    top = flat.where("depth = cut and n > cut").select("conv_id", (F.col("depth") + 1).alias("depth"), "n", F.col("a").alias("pa"), F.col("b").alias("pb"))
    last = F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
    ones = [F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), last.alias("ends_sha256")]
    deeper = flat.where("depth > cut + 1").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *ones)
    below = full.select("conv_id", "depth", "pa", "pb", "n_convs", "n_children", F.coalesce("leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    tops = top.select("conv_id", "depth", "pa", "pb", *ones)
    every = written(below.unionByName(tops), "children")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    held = every.join(parents, ["depth", "pa", "pb"], "left").select(deeper.columns)  # the root has no parent
    return held.unionByName(deeper)


def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, turns, {crc32_sql('conv_id::VARCHAR')} % 6 AS h FROM l),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100
), p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, depth, list_slice(turns, 1, depth) AS key, len(turns) = depth AS ends FROM p),
n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
    CASE WHEN depth > 0 THEN length(key[depth].text) ELSE 0 END AS chars FROM k GROUP BY depth, key
), c AS (SELECT depth - 1 AS depth, list_slice(key, 1, depth - 1) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.depth = c.depth AND n.key = c.key),
a AS (SELECT list_slice(key, 1, up) AS key, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN a ON a.key = f.key LEFT JOIN n q ON q.depth = f.depth - 1 AND q.key = list_slice(f.key, 1, f.depth - 1)
"""
