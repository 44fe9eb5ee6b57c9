"""Repair of conversation structure by the cheapest edits, from an automaton of suffixes that all conversations share.

A row of a conversation is one symbol: its role's initial (u, a, s, or x for any
other) in lower case, in upper case if its text is truncated, or d if it must go
(blank or duplicate). A conversation's symbols are its signature. Signatures are
minimised from the end: what is still to be paid at a row depends on the symbols
from there on and on the state of the grammar, so all rows of all conversations
with equal rests are one node of the automaton. Different signatures are sorted
backwards and dealt out by ranges; in that order each node is met once, and its
cost-to-go and best edit are worked out then, for each state of the grammar.

The grammar of roles is (s?(ua)+)?. Edits: Keep costs nothing, Rerole (to user or
assistant) 1, Delete 2, Insert (an empty text of user or assistant) 5; a truncated
row that isn't deleted costs 5 more. At a node and state each edit leads to one
state only, so of equally cheap edits the least letter (D, I, K, R) begins the
audit that is least in ASCII, and only one letter is kept for each node and state.

Only digests and symbols are shuffled to find signatures; no task holds more of a
conversation than its symbols, one letter a row, as the audit does. Texts are
shuffled once, to be written in order by a task that reads them as a stream.

Null roles and texts are one blank, and a null conv_id is a conversation like any
other. Rows go by turn, nulls first, then role and SHA-256 of the text; repeated
rows are duplicates. Conversations and texts of any length are read as streams.
An empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import crc32_sql, ranked, table, written

_WORD = r"[^\x20\x09-\x0D]"
#: State after a kept or made role of an initial; states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Role that an insertion or a change of role makes in a state.
_NEEDED = ("u", "u", "a", "u")
_NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of turns, some dropped, emptied, cut, doubled or given to the user by crc32 of conv_id and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, symbols) of rows (conv_id, turn, role, text, copies), one row per conversation."""
    initial = F.substring("role", 1, 1)
    small = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.when(initial.isin("u", "a", "s"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(_WORD)).alias("empty"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
    )
    one = written(small.groupBy("conv_id", "turn", "role", "digest", "initial", "empty", "open").agg(F.sum("copies").alias("copies")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    firsts = written(one.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first")), "firsts")
    a, b = one.withColumn("when", when).alias("a"), firsts.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    told = a.join(b, same).select("a.*", F.col("a.when").eqNullSafe(F.col("b.first")).alias("first"))
    lead = F.col("first") & ~F.col("empty")
    symbol = F.when(F.col("open"), F.upper("initial")).otherwise(F.col("initial"))
    rest = lambda n: F.repeat(F.lit("d"), n.cast("int"))
    marked = told.select(
        "conv_id", "turn", "role", "digest", F.repeat("initial", F.col("copies").cast("int")).alias("roles"),
        F.when(lead, F.concat(symbol, rest(F.col("copies") - 1))).otherwise(rest(F.col("copies"))).alias("symbols"),
        F.when(F.col("empty"), F.col("copies")).otherwise(0).alias("blank"), F.when(F.col("empty"), 0).otherwise(F.col("copies") - lead.cast("long")).alias("duplicate"),
        (lead & F.col("open")).cast("long").alias("truncated"),
    )
    dealt = ranked(marked, ["conv_id", "turn", "role", "digest"], "signatures")
    piece = F.array_sort(F.collect_list(F.struct("__row", "roles", "symbols")))
    chunks = dealt.groupBy("conv_id", "__p").agg(
        piece.alias("c"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.min("turn").alias("lo"), F.max("turn").alias("hi")
    )
    joined = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), "")
    chunks = chunks.select("conv_id", "__p", joined("c", "roles").alias("roles"), joined("c", "symbols").alias("symbols"), "blank", "duplicate", "truncated", "lo", "hi")
    whole = chunks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("__p", "roles", "symbols"))).alias("c"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    turns = one.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("turns"))
    roles = joined("c", "roles")
    illegal = F.greatest(F.length(roles) - 1, F.lit(0)) - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    spread = (wide("hi") - wide("lo") + 1 - wide("turns")).try_cast("long")
    w, t = whole.alias("w"), turns.alias("t")
    return w.join(t, F.col("w.conv_id").eqNullSafe(F.col("t.conv_id")), "left").select(
        "w.conv_id", F.when(F.col("turns").isNull(), 0).otherwise(spread).cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), joined("c", "symbols").alias("symbols")
    )


class Automaton:
    """Nodes of the suffixes of one signature after another, given backwards and in sorted order; nodes that the last two share are kept."""

    def __init__(self):
        self.path, self.costs, self.letters = "", [(0, 2 * INSERT, INSERT, 0)], [("", "I", "I", "")]

    def _node(self, symbol: str) -> None:
        ahead, costs, letters = self.costs[-1], [], []
        extra, initial = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for state in range(4):
            ways = [(DELETE + ahead[state], "D")]
            if symbol != "d":
                if initial in _AFTER[state]:
                    ways.append((KEEP + extra + ahead[_AFTER[state][initial]], "K"))
                ways.append((REROLE + extra + ahead[_AFTER[state][_NEEDED[state]]], "R"))
            costs.append(min(ways))
        user, assistant = costs[2], costs[3]
        costs[2], costs[3] = min(user, (INSERT + assistant[0], "I")), min(assistant, (INSERT + user[0], "I"))
        for state in (0, 1):
            costs[state] = min(costs[state], (INSERT + costs[2][0], "I"))
        self.costs.append(tuple(c for c, _ in costs))
        self.letters.append(tuple(x for _, x in costs))

    def best(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of a signature that is given from its end."""
        shared, most = 0, min(len(self.path), len(backwards))
        while shared < most and self.path[shared] == backwards[shared]:
            shared += 1
        del self.costs[shared + 1 :], self.letters[shared + 1 :]
        for symbol in backwards[shared:]:
            self._node(symbol)
        self.path = backwards
        audit, at, state = [], len(backwards), 0
        while letter := self.letters[at][state]:
            audit.append(letter)
            if letter != "D":
                state = _AFTER[state][backwards[at - 1].lower() if letter == "K" else _NEEDED[state]]
            at -= letter != "I"
        return self.costs[len(backwards)][0], "".join(audit)


def cheapest(signed: DataFrame) -> DataFrame:
    """(symbols, cost, audit) of the different signatures of a column symbols."""
    backwards = signed.select(F.reverse("symbols").alias("backwards")).distinct()
    dealt = backwards.repartitionByRange("backwards").sortWithinPartitions("backwards")

    def run(batches):
        nodes = Automaton()
        for batch in batches:
            told = [(s[::-1], *nodes.best(s)) for s in batch.column(0).to_pylist()]
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), (pa.string(), pa.int64(), pa.string()))], ["symbols", "cost", "audit"])

    return dealt.mapInArrow(run, "symbols string, cost long, audit string")


def _streams(batches):
    """(conversation, rows) of batches in which each conversation's report (place 0) comes before its rows; rows is an iterator of (role, text) of the repaired conversation."""

    def lines():
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("report", "conv_id", "audit", "role", "text", "copies")])

    source = lines()
    held = [next(source, None)]

    def rows(audit):
        letters, state = iter(audit), 0

        def edits(role, text):
            """Insertions before a row, and then what becomes of it."""
            nonlocal state
            for letter in letters:
                if letter == "D":
                    return
                made = _NEEDED[state]
                if letter == "K":
                    state = _AFTER[state][role[:1]]
                    yield role, text
                    return
                state = _AFTER[state][made]
                yield (_NAMES[made], "") if letter == "I" else (_NAMES[made], text)
                if letter == "R":
                    return

        while held[0] is not None and not held[0][0]:
            _, _, _, role, text, copies = held[0]
            for _ in range(copies):
                yield from edits(role, text)
            held[0] = next(source, None)
        for _ in letters:  # insertions after the last row
            made = _NEEDED[state]
            state = _AFTER[state][made]
            yield _NAMES[made], ""

    while held[0] is not None:
        _, conv, audit, *_ = held[0]
        held[0] = next(source, None)
        mended = rows(audit)
        yield conv, mended
        for _ in mended:  # what the reader left
            pass


def _in_order(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Reports (conv_id, audit) and rows of the same conversations together, in order. No text is in a report and no audit in a row."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = reports.select(F.lit(True).alias("report"), "conv_id", "audit", none("long", "turn"), none("string", "role"), none("string", "text"), none("long", "copies"), none("string", "digest"))
    texts = rows.select(F.lit(False).alias("report"), "conv_id", none("string", "audit"), "turn", "role", "text", "copies", F.sha2("text", 256).alias("digest"))
    return heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("report"), F.asc_nulls_first("turn"), "role", "digest").drop("digest", "turn")


def repaired_turns(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations."""

    def run(batches):
        out = []
        for conv, mended in _streams(batches):
            for place, (role, text) in enumerate(mended):
                out.append((conv, place, role, text))
                if len(out) == 1000:
                    yield as_batch(out)
                    out = []
        if out:
            yield as_batch(out)

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])

    return _in_order(reports, rows).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the same rows as role:text, joined by line feeds."""

    def run(batches):
        out = []
        for conv, mended in _streams(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(mended):
                digest.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            out.append((conv, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])

    return _in_order(reports, rows).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_reports(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of conversations: its gaps and faults, the cheapest cost and its audit. rows: (conv_id, turn, role, text, copies)."""
    signed = written(signatures(rows), "signed")
    best = written(cheapest(signed), "best")
    every = conversations.select("conv_id").distinct()
    e, s = every.alias("e"), signed.join(best, "symbols").alias("s")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return e.join(s, F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")), "left").select("e.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"))


def op11_chat_repair(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damage(turns)
    reports = written(repair_reports(rows, turns), "reports")
    a, b = reports.alias("a"), repaired_digests(reports.select("conv_id", "audit"), rows).alias("b")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))).select("a.*", "repaired_sha256")


#: In SQL a rest is four texts, one for each state of the grammar: its cost in six digits, a colon, its audit; so the least text is the cheapest, and of these the least audit.
_PLUS = "lpad(({0}[1:6]::INT + {1})::VARCHAR, 6, '0') || ':{2}' || {0}[8:]"


def _ways(state: int, role: str) -> str:
    """The least of deleting, keeping and changing a row in a state, from the rests ``acc`` after it; s is its symbol."""
    dear = "CASE WHEN s = upper(s) THEN 5 ELSE 0 END"
    ways = [_PLUS.format(f"acc[{state + 1}]", 2, "D")]
    kept = " ".join(f"WHEN '{i}' THEN {_PLUS.format(f'acc[{to + 1}]', dear, 'K')}" for i, to in _AFTER[state].items())
    ways.append(f"CASE lower(s) {kept} ELSE '999999' END")
    ways.append(f"CASE WHEN s = 'd' THEN '999999' ELSE {_PLUS.format(f'acc[{_AFTER[state][role] + 1}]', f'1 + {dear}', 'R')} END")
    return f"least({', '.join(ways)})"


_MADE = f"[{', '.join(_ways(q, r) for q, r in enumerate(_NEEDED))}]"
_INSERTED = f"[least(g[3], {_PLUS.format('g[4]', 5, 'I')}), least(g[4], {_PLUS.format('g[3]', 5, 'I')})]"
OP11_SQL = f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE fault <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
told AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, CASE WHEN role[1] IN ('u', 'a', 's') THEN role[1] ELSE 'x' END AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), signed AS (
  SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pos > 1 AND coalesce(before[1], '') || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list([CASE WHEN blank OR again THEN 'd' WHEN open THEN upper(i) ELSE i END] ORDER BY pos DESC) AS symbols, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts FROM told GROUP BY conv_id
), best AS (
  SELECT *, list_reduce(symbols, lambda acc, x: list_transform([list_transform([x[1]], lambda s: {_MADE})[1]], lambda g: list_transform([{_INSERTED}],
    lambda m: [least(g[1], {_PLUS.format('m[1]', 5, 'I')}), least(g[2], {_PLUS.format('m[1]', 5, 'I')}), m[1], m[2]])[1])[1], ['000000:', '000010:II', '000005:I', '000000:'])[1] AS b FROM signed
), audits AS (SELECT *, b[1:6]::BIGINT AS cost, b[8:] AS audit FROM best),
letters AS (SELECT conv_id, roles, texts, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS spot FROM audits WHERE audit <> ''),
run AS (SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY spot)::BIGINT AS row_, sum((letter <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY spot)::BIGINT AS made FROM letters),
first AS (SELECT conv_id, coalesce(max((letter = 'K' AND roles[row_][1] = 's')::INT) FILTER (made = 1 AND letter <> 'D'), 0) AS s FROM run GROUP BY 1),
mended AS (
  SELECT run.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN roles[row_] WHEN (made - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE texts[row_] END, chr(10) ORDER BY spot)) AS h
  FROM run JOIN first ON first.conv_id IS NOT DISTINCT FROM run.conv_id WHERE letter <> 'D' GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""
