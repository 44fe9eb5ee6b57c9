"""The registered queries themselves against brute force, over written tables with columns named like their outputs."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .conftest import edge_rows
from .test_pairs import brute_removal, classes, fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("n_words", "base_failed", "start", "length", "sequence_id", "offset", "n_bytes", "removed", "fingerprint", "text_hash", "ids", "decoded", "spans", "codes", "word", "score", "held_out", "tokenizer", "n_tokens")


@pytest.fixture(scope="module")
def sf(spark, edge, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = edge.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *[F.lit("clash").alias(c) for c in CLASH])
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows():
    return [(r[0], r[1] or "") for r in edge_rows()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def digest(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_quality_base(spark, sf):
    from tillwork.llm.fertility import op2_quality_rules

    want = Counter()
    for d, text in rows():
        words, lines, seen, double = WORD.findall(text), text.split("\n"), set(), 0
        for line in lines:
            double += bool(WORD.search(line)) and line in seen
            seen.add(line)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        want[(d, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), double, len(repeated), failed)] += 1
    got = op2_quality_rules(spark, sf).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_packing(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tillwork.llm.packing import op3_packing

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model.encode_special_tokens = True
    ids = [(d, [*model.encode(t, add_special_tokens=False).ids, 1]) for d, t in rows()]
    got = op3_packing(spark, sf).collect()
    possible = Counter()
    for d, x in ids:
        possible[(d, len(x))] += len(x)
    told = Counter()
    for r in got:
        told[(r.doc_id, r.doc_tokens)] += r.length
        crcs = {zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) for d, x in ids if d == r.doc_id and len(x) == r.doc_tokens}
        assert r.ids_crc32 in crcs
    assert told == possible, "every id lies in one piece"
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    total = sum(len(x) for _, x in ids)
    assert len(sequences) <= -(-total // 2048) + 4


def test_suffix_dedup(spark, sf):
    from tillwork.llm.suffix_dedup import op5_suffix_dedup

    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_suffix_dedup(spark, sf).collect())
    assert got == brute_removal([r[:2] for r in edge_rows()])


def test_simhash(spark, sf):
    from tillwork.llm.simhash import op6_simhash

    pairs = [(d, fingerprint(t)) for d, t in rows()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(pairs, classes(pairs)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in op6_simhash(spark, sf).collect()) == want


def test_byte_bpe(spark, sf):
    import public_tokenizers
    import tiktoken

    from tillwork.llm.byte_bpe import VOCABULARY, op7_byte_bpe, read_ranks

    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    want = Counter()
    for d, text in rows():
        ids = model.encode_ordinary(text)
        want[(d, len(ids), digest(",".join(map(str, ids))), digest(text))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_byte_bpe(spark, sf).collect()) == want


def test_secret_base(spark, sf):
    from tillwork.llm.secret_scan import op8_secret_scans

    assign = re.compile(r"(?a:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    rules = (("assign", assign, 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    want = Counter()
    for d, text in rows():
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= n)
        want[(d, *[sum(f[1] == k for f in found) for k in range(3)], digest(",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in found)))] += 1
    got = op8_secret_scans(spark, sf).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        assert digest(",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))) == r.base_sha256


def test_lm_base(spark, sf):
    from tillwork.llm.lm import op10_lm_scoring

    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(d, [*WORD.findall(lower(t)), None]) for d, t in rows()]
    counts = Counter(w for d, ws in tokens if not out(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -99, out(d), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens)
    rows_ = op10_lm_scoring(spark, sf).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -99, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows_)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows_)


@pytest.mark.parametrize("name", ["op1_token_counts", "op9_chat_formatting"])
def test_sql_of_queries_on_edge_tables(spark, sf, tmp_path, name):
    import duckdb

    from tillwork.llm import queries

    texts = [r[1] for r in edge_rows() if r[1] is None or "\x85" not in r[1]]
    chats = [(i // 4, i % 4, ("user", "assistant", "system", None)[i % 4], t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    own = queries.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(own.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, own.collect()), key=key) == sorted(want, key=key)
