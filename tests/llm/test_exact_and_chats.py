"""Exact duplicates, repair of conversations and the prefix trie against brute force, on edge cases and random tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillwork.llm import chat_repair, exact_dedup, prefix_trie

from .conftest import edge_rows

CHATS = "conv_id bigint, turn bigint, role string, text string, pos string, digest string, n string, symbols string, copies string, depth string, report string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def chats(seed, convs=40):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi", "", None, " \t", "Yes? ", "No!\n", "Ünï. ", "long. " * 3000, "a"]
    rows = []
    for c in range(convs):
        c = rng.choice([c, c + 100, c + 300, 0, 100, None, -7, -105])
        for t in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    return rows + rng.sample(rows, 5)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], CHATS).repartition(3)


# exact duplicates


def brute_groups(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = Counter()
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep, free = max(real, default=None), True
        for i in ids:
            out[(i, keep, len(ids), free and i == keep, sha(text))] += 1
            free = free and i != keep
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_exact_duplicates_on_edge_cases(spark, edge, block):
    rows = [(r[0], r[1] if len(r[1] or "") < 5_000 else r[1][:700]) for r in edge_rows()]
    rows += [(100, "ABcd" * 9), (101, "abCD" * 9), (102, "abcd" * 8), (103, "abcd" * 9 + "É"), (104, "abcd" * 9 + "é"), (None, ""), (None, None), (101, "abCD" * 9), (105, "abc" * 40), (106, "abc" * 40 + "x"), (107, "abc" * 40 + "X")]
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id bigint, text string, row string, name int, key string").repartition(4)
    got = exact_dedup.exact_duplicates(docs, block=block)
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_exact_duplicates_with_a_hot_group_and_an_empty_table(spark):
    rows = [(i, ("Hot " * 700 if i % 3 else f"own {i} " * (i % 50))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs, block=64).collect())) == brute_groups(rows)
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


# repair


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


GOOD = re.compile(r"(s?(ua)+)?")


def cheapest_by_search(rows):
    """Cost and audit by a search over all edits, the least audit of the cheapest first; rows are (initial, must go, truncated)."""
    start = (0, "", 0, "")
    queue, done = [start], set()
    while queue:
        cost, audit, at, said = heapq.heappop(queue)
        if at == len(rows) and GOOD.fullmatch(said):
            return cost, audit
        if (at, said, audit) in done or cost > 7 * len(rows) + 12:
            continue
        done.add((at, said, audit))
        fine = lambda s: any(GOOD.fullmatch(s + x) for x in ("", "a", "ua"))
        if at < len(rows):
            initial, gone, open_ = rows[at]
            extra = 5 if open_ else 0
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, said))
            if not gone:
                for way, role, price in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                    if len(role) == 1 and fine(said + role):
                        heapq.heappush(queue, (cost + price + extra, audit + way, at + 1, said + role))
        for role in "ua":
            if fine(said + role) and audit[-2:] != "II":
                heapq.heappush(queue, (cost + 5, audit + "I", at, said + role))


def marks(rows):
    """Symbols of a conversation's rows in order, and what is reported of them."""
    seen, out, counts = set(), [], Counter()
    for _, _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return out, (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal)


def mend(rows, audit):
    left, said, out = list(rows), "", []
    for letter in audit:
        need = "assistant" if said[-1:] == "u" else "user"
        row = None if letter == "I" else left.pop(0)
        if letter != "D":
            role = row[2] if letter == "K" else need
            said += role[:1]
            out.append((role, row[3] if row else ""))
    assert not left and GOOD.fullmatch(said)
    return out


def test_automaton_equals_a_search_over_all_edits():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("uasxUASXdua") for _ in range(rng.randrange(0, 7))) for _ in range(300)} | {"", "d", "s", "dd"}, key=lambda w: w[::-1])
    nodes = chat_repair.Automaton()
    for word in words:
        rows = [(s.lower(), s == "d", s.isupper()) for s in word]
        assert nodes.best(word[::-1]) == cheapest_by_search(rows), word


@pytest.fixture(scope="module", params=[1, 2])
def conversations(spark, request, tmp_path_factory):
    rows, path = chats(request.param), tmp_path_factory.mktemp("chats")
    frame(spark, rows).write.parquet(f"{path}/conversations.parquet")
    return rows, str(path)


def test_repaired_conversations(spark, conversations):
    rows, path = conversations
    after, want = defaultdict(list), {}
    for r in damaged(rows):
        after[r[0]].append(r)
    for c in {r[0] for r in rows}:
        mine = ordered(after[c])
        symbols, told = marks(mine)
        cost, audit = chat_repair.Automaton().best("".join("d" if gone else (i if i and i in "uas" else "x").upper() if open_ else (i if i and i in "uas" else "x") for i, gone, open_ in symbols)[::-1])
        want[c] = (*told, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in mend(mine, audit))))
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.op11_chat_repair(spark, path).collect()}
    assert got == want


def test_repaired_turns_are_the_rows_behind_the_digests(spark, conversations):
    rows, path = conversations
    turns = spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hurt = chat_repair.damage(turns)
    reports = chat_repair.repair_reports(hurt, turns).select("conv_id", "audit")
    made = defaultdict(list)
    for r in sorted(chat_repair.repaired_turns(reports, hurt).collect(), key=lambda r: r.place):
        made[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in chat_repair.repaired_digests(reports, hurt).collect()}
    assert digests == {c: sha("\n".join(made[c])) for c in {r[0] for r in rows}}


# the trie


def brute_trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[0], r[1], r[2] or "", r[3] or ""))
    own = {c: [(r[2], r[3]) for r in ordered(rs)] for c, rs in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    out = Counter()
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = sorted(c for c in members if len(full[c]) == len(key))
        out[(
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children[key], sum(not children[k] for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), sha(",".join(map(str, ends))),
        )] += 1
    return out


@pytest.mark.parametrize("chunk, narrow, wide", [(1024, 1 << 16, 1 << 26), (2, 64, 64)])
def test_prefix_trie(spark, conversations, monkeypatch, chunk, narrow, wide):
    """Also with chunks of two turns, and with a sketch so narrow that it proves nothing."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "NARROWEST", narrow)
    monkeypatch.setattr(prefix_trie, "WIDEST", wide)
    rows, path = conversations
    assert Counter(map(tuple, prefix_trie.op13_prefix_trie(spark, path).collect())) == brute_trie(rows)


def test_tails_are_not_grouped(spark):
    rows = [(c, t, "user", f"{c if t > 1 else 0} {t}") for c in range(50) for t in range(6)]
    turns, convs = prefix_trie.rebuilt(frame(spark, rows), heads=1)
    cuts = prefix_trie.screened(prefix_trie.prefixes(turns, convs)).select("conv_id", "cut").distinct().collect()
    assert sorted(r.conv_id for r in cuts) == list(range(50)) and sum(r.cut == 2 for r in cuts) >= 45


def test_empty_tables(spark, tmp_path):
    frame(spark, chats(1)).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat_repair.op11_chat_repair(spark, str(tmp_path)).collect() == []
    assert prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op11_chat_repair", "op12_exact_dedup", "op13_prefix_trie"])
def test_sql_of_new_queries(spark, conversations, tmp_path, name):
    import duckdb

    from tillwork.llm import queries

    _, path = conversations
    docs = [(r[0], r[1]) for r in edge_rows()]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit(None))).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    own = queries.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(own.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, own.collect())) == Counter(want)
