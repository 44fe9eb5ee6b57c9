"""SimHash, suffix dedup, nearest neighbours, components: brute force on small inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from .conftest import edge_rows


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs):
    """Least id of each row's class, of (id, fingerprint) rows."""
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = []
    for i in range(len(pairs)):
        ids = [pairs[j][0] for j in range(len(pairs)) if root(j) == root(i) and pairs[j][0] is not None]
        out.append(min(ids) if ids else None)
    return out


def test_simhash_edge_rows(edge, empty):
    from tillwork.llm.simhash import hexed, near_duplicates

    got = near_duplicates(edge).select("doc_id", hexed(F.col("fingerprint")).alias("f"), "component_id").collect()
    pairs = [(r[0], fingerprint(r[1])) for r in edge_rows()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(pairs, classes(pairs)))
    assert Counter((r.doc_id, r.f, r.component_id) for r in got) == want
    assert near_duplicates(empty).collect() == []


@pytest.mark.parametrize("seed", [5, 6])
def test_links_lose_nothing(spark, seed):
    from tillwork.llm.components import connected_components
    from tillwork.llm.simhash import links

    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    found = set(seeds)
    for s in seeds[:20]:
        for _ in range(12):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            found.add(s)
    hub = rng.getrandbits(64)  # a dense group
    found |= {hub ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in found], "fingerprint bigint").repartition(4)
    edges = links(df)
    assert edges.count() < 20 * len(found)
    roots = {r.u: r.root for r in connected_components(edges).collect()}
    rows = [(signed(f), f) for f in sorted(found)]
    least = dict(zip((r[0] for r in rows), classes(rows)))
    group = lambda labels: {frozenset(k for k in labels if labels[k] == v) for v in labels.values()}
    assert group({k: roots.get(k, k) for k in least}) == group(least)


def test_components_of_paths_and_loops(spark):
    from tillwork.llm.components import connected_components

    rng = random.Random(2)
    order = list(range(200))
    rng.shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(500, 500), (300, 301), (301, 300), (302, 301)]
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def brute_gone(rows, length=50):
    """For each row, which bytes go."""
    last = 1 << 62
    own = {}
    data = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - length + 1):
            own[t[i : i + length]] = min(d, own.get(t[i : i + length], last + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if own[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def brute_removal(rows, length=50):
    out = []
    for gone, (doc_id, text) in zip(brute_gone(rows, length), rows):
        t = (text or "").encode()
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


def removal(df, **options):
    from tillwork.llm.suffix_dedup import remove_repeats

    rows = remove_repeats(df, **options).collect()
    return Counter((r.doc_id, r.n_bytes, sum(s.length for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


@pytest.mark.parametrize("options", [{"pass_bytes": 700}, {"pass_bytes": 700, "hot": 0}])
def test_small_passes_remove_the_same(spark, options):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(600))
    df = spark.createDataFrame([(i, text[i % 7 * 40 : i % 7 * 40 + 120 + i % 11 * 20]) for i in range(60)], "doc_id long, text string")
    assert removal(df, **options) == removal(df)


def test_a_pass_over_a_chunk_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    from tillwork.llm import suffix_dedup

    rng = np.random.default_rng(3)
    some = ["".join(map(chr, rng.integers(97, 123, 40_000))) for _ in range(50)]
    t = pa.table({"text": some, "__doc": pa.array(range(50), pa.int64())})
    suffix_dedup._held.clear()
    tracemalloc.start()
    for _, _, w in suffix_dedup._views(t, "text", 50, 20, 512 << 10):
        w.runs()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    suffix_dedup._held.clear()
    assert peak < 60e6


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"chunk_bytes": 4000}, {"hot": 2, "chunk_bytes": 3000}])
def test_suffix_dedup_edge_rows(edge, empty, options):
    assert removal(edge, **options) == brute_removal([r[:2] for r in edge_rows()])
    assert removal(empty, **options) == Counter()


def test_suffix_dedup_overlaps_and_self_repeats(spark):
    rng = random.Random(9)
    text = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(49, 130), "abcdefgh ") for _ in range(8)]
    rows = [(i, "".join(rng.choice([text(rng.randint(0, 60), "abcdefghij "), rng.choice(shared), "ab" * rng.randint(5, 60), "é" * rng.randint(0, 40)]) for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_removal(rows)
    for options in ({}, {"hot": 1, "chunk_bytes": 2000}, {"chunk_bytes": 500}):
        assert removal(df, **options) == want


def test_refine_tells_equal_strings():
    from tillwork.llm.suffix_dedup import refine

    rng = random.Random(4)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 90))).encode() for _ in range(30)] + [b"a" * 80, b"a" * 70]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    bucket = refine(data, ends)
    at = [i for i in range(len(data)) if i + 50 <= ends[i]]
    strings = {}
    for i in at:
        assert strings.setdefault(data[i : i + 50].tobytes(), bucket[i]) == bucket[i]
    assert len(set(strings.values())) == len(strings)


def test_nearest_neighbours(spark):
    from tillwork.llm.ann import nearest

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16)).astype(np.float32).tolist()
    rows = [(i, v, 1) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0], 2) for i in range(40)] + [(3, x[3], 9)]  # copies, and a repeated row
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [float("inf")] + [1.0] * 15, 0), (2004, [None] + [1.0] * 15, 0), (2005, [1.0, 2.0], 0), (None, x[5], 0), (2100, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, score int").repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, vectors = zip(*{r[0]: np.array(r[1], np.float32).astype(float) for r in rows}.items())
    ids, vectors = np.array(ids), np.array(vectors)
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(d[ids == f[1]][0] - f[2]) < 1e-12 for f in found)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
        total += 10
        if q == 0 or q >= 1000:
            assert [f[1] for f in found] == ids[order].tolist()
    assert hits / total >= 0.95
    few = nearest(df.where("vec_id in (0, 1, 1000)"), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few)] == [(1, 1000), (2, 1)]
    assert nearest(df.limit(0), F.lit(True)).collect() == []


def test_nearest_neighbours_over_several_leaves(spark):
    from tillwork.llm.ann import LEAF, nearest

    rng = np.random.default_rng(12)
    x = rng.normal(size=(4 * LEAF, 48)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<float>").repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 64 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(float)
    want = {q: set(np.argsort(((y - y[q]) ** 2).sum(axis=1), kind="stable")[1:11].tolist()) for q in range(0, len(x), 64)}
    assert sum(len(got[q] & want[q]) for q in want) / (10 * len(want)) >= 0.9


def test_the_beam_follows_measured_recall(spark):
    from tillwork.llm.ann import exact, measured_recall

    x = np.random.default_rng(3).normal(size=(60, 8)).tolist()
    nodes = spark.createDataFrame([(i, v, [j for j in range(60) if j != i]) for i, v in enumerate(x)], "node bigint, embedding array<double>, links array<bigint>")
    queries = nodes.where("node < 10").select(F.col("node").alias("query_id"), "embedding", F.col("node").alias("own"))
    true = exact(queries, nodes, 5).select("query_id", "node")
    assert measured_recall(queries, nodes, true, 5, beam=8) == (1.0, 8)
    chain = nodes.withColumn("links", F.expr("transform(sequence(0, 3), x -> pmod(node + x * x + 1, 60))"))
    shares = [measured_recall(queries, chain, true, 5, beam=b) for b in (5, 60)]
    assert shares[0][1] > 5 and shares[0][0] <= shares[1][0] == 1.0
    share, beam = measured_recall(queries, nodes.withColumn("links", F.expr("array(node)")), true, 5, beam=8)
    assert share == 0.0 and beam == 16, "without edges a wider beam gains nothing"


@pytest.mark.parametrize("size", [1e6, 1e-6])
def test_nearest_neighbours_of_any_size_are_complete(spark, size):
    from tillwork.llm.ann import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)) * size
    x[200:] = x[200] + rng.normal(size=(100, 8)) * size * 1e-5  # a dense ball of near copies
    x[299] = size * 1e8  # far away
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>").repartition(2)
    got = {}
    for r in nearest(df, F.col("vec_id") % 13 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, 300, 13):
        want = np.lexsort((np.arange(300), np.sqrt(((x - x[q]) ** 2).sum(axis=1))))
        assert [got[q][k] for k in range(1, 11)] == [i for i in want if i != q][:10]


def test_short_queries_are_held_against_all_nodes(spark):
    from tillwork.llm.ann import exact

    x = np.random.default_rng(6).normal(size=(50, 4))
    nodes = spark.createDataFrame(list(enumerate(x.tolist())), "node bigint, embedding array<double>")
    queries = nodes.where("node % 3 = 0").withColumnRenamed("node", "query_id")
    got = {}
    for r in exact(queries, nodes, 4, block=7).collect():
        got.setdefault(r.query_id, []).append((r.score, r.node))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [n for _, n in sorted(found)] == np.argsort(d, kind="stable")[:4].tolist()
    assert set(got) == set(range(0, 50, 3))


def test_fixture_has_every_case():
    rows = edge_rows()
    assert any(r[0] is None for r in rows) and any(r[1] is None for r in rows) and len(rows) > len(set(rows))


def test_nearest_without_queries_builds_nothing(spark, monkeypatch):
    from tillwork.llm import ann

    monkeypatch.setattr(ann, "build_graph", lambda *a: 1 / 0)
    rows = spark.createDataFrame([(i * 100 + 1, [float(i), 1.0]) for i in range(300)], "vec_id bigint, embedding array<double>")
    assert ann.nearest(rows, F.col("vec_id") % 100 == 0).collect() == []
    assert ann.nearest(rows.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_nearest_where_no_graph_leads_to_the_neighbours(spark, monkeypatch):
    """The degree has a ceiling; beyond it the queries are answered by brute force."""
    import numpy as np

    from tillwork.llm import ann

    degrees = []
    real = ann.build_graph
    monkeypatch.setattr(ann, "build_graph", lambda points, degree, graph: degrees.append(degree) or real(points, degree, graph))
    monkeypatch.setattr(ann, "measured_recall", lambda *a: (0.5, 16))
    monkeypatch.setattr(ann, "DEGREE", 12)
    x = np.random.default_rng(1).normal(size=(300, 16))
    rows = spark.createDataFrame([(i * 10, [float(v) for v in x[i]]) for i in range(300)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert degrees[-1] == 36 and len(degrees) <= 4
    assert got == {i * 10: [int(j) * 10 for j in np.argsort(((x - x[i]) ** 2).sum(1), kind="stable") if j != i][:10] for i in range(0, 300, 10)}


def test_the_nearest_of_a_round_are_chosen_by_three_sorts(monkeypatch):
    import numpy as np

    from tillwork.llm import ann

    rng = np.random.default_rng(3)
    n, degree, sample, seed = 4000, 7, 4, 2
    u = np.sort(rng.choice([-5, 0, 3, 1 << 40, (1 << 62) + 1], n))
    w = rng.choice(np.concatenate([np.arange(60), [-(1 << 60), 1 << 61]]), n)
    d = rng.choice(np.array([0.0, -0.0, 1e-30, 0.5, 0.5000001, 7.0, 1e30], np.float32), n)
    fresh = rng.random(n) < 0.8
    sorts = []
    real = np.argsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: 1 / 0)  # a sort a key, as it was
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or real(*a, **k))
    with np.errstate(over="ignore"):
        got = ann._chosen(u, w, d, fresh, degree, sample, seed)
    assert len(sorts) <= 3
    # brute force
    best, known = {}, set()
    for a, b, x, f in zip(u.tolist(), w.tolist(), d.tolist(), fresh.tolist()):
        best[a, b] = min(x, best.get((a, b), x))
        known |= set() if f else {(a, b)}
    want, lots = [], {}
    for a in sorted({a for a, _ in best}):
        near = sorted((x, b) for (c, b), x in best.items() if c == a)[:degree]
        lot = lambda b: (((a * 0x9E3779B1 + b * 0x85EBCA77 + seed * 0xC2B2AE3D) & (1 << 64) - 1) * 0x27D4EB2F) & 0xFFFFFFFF  # noqa: E731, B023
        of = {f: sorted((b for _, b in near if ((a, b) not in known) == f), key=lot)[:sample] for f in (True, False)}
        want += [(a, b, x, (a, b) not in known, b in of[(a, b) not in known]) for x, b in near]
    assert list(zip(*(x.tolist() for x in got))) == want
