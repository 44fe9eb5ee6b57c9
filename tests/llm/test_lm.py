import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from .conftest import edge_rows

def HELD():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def test_base_scores(edge, empty):
    from tillwork.llm.lm import score

    rows = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in edge_rows()]
    count = Counter(w for d, ws in rows if not held(d) for w in ws)
    total, kinds = sum(count.values()), len(count)
    got = Counter()
    for chunk in (1 << 24, 2000):
        found = score(edge, HELD(), chunk_bytes=chunk).collect()
        got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
        want = Counter((d, held(d), len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), 5)) for d, ws in rows)
        assert got == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert score(empty, HELD()).collect() == []
    none = score(edge, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}


def test_probabilities_are_normalised():
    from tillwork.llm.lm import CLASSES, Model, improve

    rng = np.random.default_rng(0)
    noise = np.full(CLASSES, 1 / CLASSES, np.float32)
    context = np.arange(0, CLASSES * 4)
    counts = np.zeros((len(context), CLASSES), np.float32)
    counts[np.arange(len(context)), (context * 7 + 3) % 11] = rng.integers(1, 50, len(context))
    before = Model.fresh(noise)
    after = improve(before, context, counts, noise, 40, 16.0, 0.02, 1)
    logs = after.log_probabilities(context)
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    assert (counts * logs).sum() > (counts * before.log_probabilities(context)).sum()


def test_held_out_likelihood_beats_the_base(spark):
    from tillwork.llm.lm import score

    rng = np.random.default_rng(5)
    tongues = [[f"{s}{e}" for s in stems for e in ("a", "o", "en")] for stems in (["bal", "dor", "kim"], ["vut", "zep", "gir"])]
    rows = [(i, " ".join(rng.choice(tongues[i % 2], 60))) for i in range(300)]
    got = score(spark.createDataFrame(rows, "doc_id bigint, text string"), HELD()).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 20 and got[0] > got[1] * 0.95


def test_sequences_end_every_text():
    from tillwork.llm.lm import CLASSES, sequences

    code, ends = sequences(np.array([5, 6, 7]), np.array([0, 2, 2, 3]))
    assert ends.tolist() == [0, 3, 4, 6]
    two, one, now = code // CLASSES // CLASSES, code // CLASSES % CLASSES, code % CLASSES
    assert now.tolist() == [5, 6, 0, 0, 7, 0] and one.tolist() == [0, 5, 6, 0, 0, 7] and two.tolist() == [0, 0, 5, 0, 0, 0]
