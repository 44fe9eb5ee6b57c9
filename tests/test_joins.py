"""Similarity join, expansion indexes and the longest common subsequence against brute force, and what their plans join."""

import random

import pytest
from pyspark.sql import functions as F

from tillwork.functions import strings as S
from tillwork.operators import similarity, vocab


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence_of_any_length(spark):
    rng = random.Random(1)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(text(n, ls), text(m, ls)) for n in (0, 1, 5, 61, 62, 63, 124, 125, 200) for m in (0, 3, 62, 130) for ls in ("ab", "abcdefghij", "é😀xyz")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.lcs_length(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == lcs(r.a, r.b) for r in df.collect())


def catalogue(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(3)), f"L{i % 5}") for i in range(n)]


def grams(text):
    out = []
    for w in text.lower().split():
        p = f" {w} "
        for n in (2, 3, 4):
            if n == 2 or len(p) > n - 1:
                out += [p[i : i + n] for i in range(max(len(p) - n + 1, 1))]
    return out


def by_all_pairs(queries, stock, k):
    """The k best rows of each query by working out every pair that shares an n-gram."""
    import math
    from collections import Counter

    tfs = {o: Counter(grams(t)) for o, t, _ in stock}
    df = Counter(g for tf in tfs.values() for g in tf)
    idf = {g: math.log((1 + len(stock)) / (1 + n)) + 1 for g, n in df.items()}
    unit = lambda tf: (lambda w, norm: {g: v / norm for g, v in w.items()})(w := {g: n * idf[g] for g, n in tf.items() if g in idf}, math.sqrt(sum(v * v for v in w.values())) or 1)
    vectors = {o: unit(tf) for o, tf in tfs.items()}
    out = {}
    for q in queries:
        a, x, found = unit(Counter(grams(q))), " ".join(sorted(q.upper().split())), []
        for o, t, _ in stock:
            if any(g in vectors[o] for g in a):
                y = " ".join(sorted(t.upper().split()))
                found.append((-round(0.5 * sum(v * vectors[o].get(g, 0) for g, v in a.items()) + lcs(x, y) / (len(x) + len(y)), 9), o))
        out[q] = [o for _, o in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("hot", [20_000, 7])
def test_best_rows_equal_those_of_all_pairs(spark, hot):
    """Also with hot n-grams dealt out."""
    stock = catalogue(120)
    queries = [t for _, t, _ in catalogue(15, 3)] + [t[: len(t) - 3] for _, t, _ in stock[:25]]
    inventory = spark.createDataFrame(stock, "ord bigint, ingredient string, predicted_label string")
    asked = spark.createDataFrame([(q,) for q in queries + queries[:3]], "query string")
    top = similarity.similarity_topk(asked, similarity.build_tfidf(inventory), inventory, hot=hot)
    names = {t: o for o, t, _ in reversed(stock)}
    got = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(names[r["item"]])
    first = {o: names[t] for o, t, _ in stock}
    assert got == {q: [first[o] for o in os] for q, os in by_all_pairs(set(queries), stock, 5).items()}


def test_no_pair_comes_from_outside_the_prefixes(spark):
    stock = catalogue(200)
    inventory = spark.createDataFrame(stock, "ord bigint, ingredient string, predicted_label string")
    weights = similarity.build_tfidf(inventory)
    asked = spark.createDataFrame([(t,) for _, t, _ in stock[:40]], "query string")
    q = similarity.query_vectors(asked, weights)
    bars = q.select("query").distinct().withColumn("least", F.lit(0.7))
    found = {(r["query"], r["ord"]): r for r in similarity.cosine_pairs(q, weights, bars).collect()}
    held = q.where("rest >= 0.7 - 1e-9").join(weights.select("ord", "gram"), "gram").select("query", "ord").distinct()
    assert set(found) == {(r["query"], r["ord"]) for r in held.collect()}
    every = q.select("query", "gram", F.col("weight").alias("a")).join(weights.select("ord", "gram", "weight"), "gram").groupBy("query", "ord").agg(F.sum(F.col("a") * F.col("weight")).alias("c")).collect()
    assert all((r["query"], r["ord"]) in found for r in every if r.c >= 0.7), "the prefix holds every row of a cosine of the bound"
    assert len(found) < len(every) / 3, "and far fewer rows meet"
    assert all(abs(r.c - found[key].part) <= found[key].open + 1e-9 for r in every if (key := (r["query"], r["ord"])) in found)


def frame_of(spark, words):
    return spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, freq bigint").select("word", "freq", S.consonant_skeleton("word").alias("skeleton"), F.substring("word", 1, 1).alias("first"))


def test_skeleton_index_loses_no_pair(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefeioust") for _ in range(rng.randrange(2, 16))) for _ in range(1500)})
    tokens = sorted({"".join(rng.choice("bcdfasti") for _ in range(rng.randrange(1, 6))) for _ in range(150)})
    bare = lambda w: "".join(c for c in w if c not in "aeiou")
    inside = lambda s, w: (lambda rest: all(c in rest for c in s))(iter(w))
    keyed = spark.createDataFrame([(t, t[0], bare(t)) for t in tokens], "token string, first string, s string")
    found = {(r.token, r.word) for r in vocab.skeleton_pairs(keyed, frame_of(spark, words)).where(S.is_subsequence(F.col("s"), F.col("skeleton"))).collect()}
    want = {(t, w) for t in tokens for w in words if t[0] == w[0] and bare(t) and inside(bare(t), bare(w)) and len(bare(t)) / len(bare(w)) >= 0.4}
    assert found == want and want


@pytest.mark.parametrize("cutoff", [72.0, 60.0])
def test_fuzzy_index_loses_no_pair(spark, cutoff):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(900)})
    tokens = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    found = {(r.token, r.word) for r in vocab.fuzzy_pairs(spark.createDataFrame([(t,) for t in tokens], "token string"), frame_of(spark, words), cutoff).collect()}
    assert found == {(t, w) for t in tokens for w in words if 200 * lcs(t, w) / (len(t) + len(w)) >= cutoff - 1e-9}
