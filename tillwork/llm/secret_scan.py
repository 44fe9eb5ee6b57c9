"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that any
match must hold. Every block of documents gets an inverted index (trigram to
the documents that hold it, letters folded), queries intersect and unite
postings, and only candidates are matched. A rule without a mandatory trigram,
as a run of hexadecimal digits, scans every document.

Two rules begin with a run of any length, whose every place a matcher would try
anew: these are found by what follows the run, which is then walked back once,
so that time stays linear in texts of any length; spans are those of the
expressions.

Index and search run inside Spark tasks over whole texts, so nothing is
shuffled. Null texts count as empty; empty texts and tables give no spans;
repeated rows give the same spans each; of spans of equal start the rule listed
first comes first; other columns pass through, but for one that bears the
output's name.
"""

from __future__ import annotations

import re
import string
from re import _parser as sre

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import slices, texts

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: kind, expression, group that is measured, its least length. The first three
#: are the base kinds; the order decides ties between spans of equal start.
RULES = (
    ("assign", _ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 0),
    ("url_password", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@", 0, 0),
)
BASE = ("assign", "access", "hex")
_TAILED = {r[0]: r[1] for r in RULES}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def trigram_query(pattern: str):
    """The Boolean query of a pattern: None (no demand), ("tri", t), ("and", parts) or ("or", parts).

    ASCII letters are folded to lower case, as the index folds them; characters
    beyond ASCII make no demand, nor do letters that a rule which ignores case
    also finds in such a character (k, s, i). Only literal runs count; a class
    counts as a literal when its members fold to one character.
    """

    def both(parts, how):
        if how == "or" and any(p is None for p in parts):
            return None
        parts = [p for p in dict.fromkeys(parts) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else (how, tuple(parts))

    def one(op, arg, loose):
        codes = [arg] if op is sre.LITERAL else [a for _, a in arg] if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) else []
        folded = {chr(a).lower() if a < 128 else "" for a in codes}
        char = folded.pop() if len(folded) == 1 else ""
        return None if not char or loose and char in "ksi" else char

    def walk(items, loose):
        found, run = [], b""

        def close():
            nonlocal run
            found.extend(("tri", run[i : i + 3]) for i in range(len(run) - 2))
            run = b""

        for op, arg in items:
            if (char := one(op, arg, loose)) is not None:
                run += char.encode()
                continue
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] == arg[1] and len(arg[2]) == 1 and one(*arg[2][0], loose):
                run += one(*arg[2][0], loose).encode() * arg[0]
                continue
            close()
            if op is sre.SUBPATTERN:
                found.append(walk(arg[-1], bool((loose or arg[1] & re.IGNORECASE) and not arg[2] & re.IGNORECASE)))
            elif op is sre.BRANCH:
                found.append(both([walk(x, loose) for x in arg[1]], "or"))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                found.append(walk(arg[2], loose))
        close()
        return both(found, "and")

    parsed = sre.parse(pattern)
    return walk(parsed, bool(parsed.state.flags & re.IGNORECASE))


def trigrams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


class BlockIndex:
    """Inverted index of a block of texts over the trigrams that the rules' queries hold."""

    def __init__(self, trigrams):
        self.rows = {t: i for i, t in enumerate(sorted(trigrams))}
        self.wanted = np.zeros(1 << 24, np.uint16)
        for t, i in self.rows.items():
            self.wanted[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def build(self, block: pa.Array) -> np.ndarray:
        """postings[trigram, text]: does the text hold the trigram?"""
        bounds = np.frombuffer(block.buffers()[1], np.int64)[block.offset : block.offset + len(block) + 1]
        postings = np.zeros((len(self.rows), len(block)), bool)
        if bounds[-1] - bounds[0] < 3:
            return postings
        data = self.fold[np.frombuffer(block.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]].astype(np.int32)
        which = self.wanted[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(which)
        doc = np.searchsorted(bounds - bounds[0], at, side="right") - 1
        inside = at + 3 <= (bounds - bounds[0])[doc + 1]
        postings[which[at[inside]] - 1, doc[inside]] = True
        return postings

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        if query[0] == "tri":
            return postings[self.rows[query[1]]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def _back(text: str, at: int, floor: int, run: str) -> int:
    """Where the run of characters of ``run`` that ends at ``at`` begins, ``floor`` at the least."""
    while at > floor:
        low = max(floor, at - 256)
        left = text[low:at].rstrip(run)
        if left:
            return low + len(left)
        at = low
    return at


def _scheme(text: str, begin: int, end: int) -> int:
    found = _LETTER.search(text, begin, end)
    return found.start() if found else -1


_LETTER = re.compile("[a-z]")
_SAFE = string.ascii_letters + string.digits + "_-"
#: Of rules that begin with a run: its characters, where a match begins in a run (-1: nowhere), and what follows the run.
TAILS = {
    "jwt": (_SAFE, lambda text, begin, end: text.find("eyJ", begin, max(begin, end - 8)), re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")),
    "url_password": (string.ascii_lowercase + string.digits + "+.-", _scheme, re.compile(r"://[^\s/:@]++:[^\s/:@]++@")),
}


def matches(rule, text: str):
    """Spans of a rule, leftmost and non-overlapping; short ones are dropped after matching."""
    kind, pattern, group, least = rule
    if kind in TAILS and pattern.pattern == _TAILED[kind]:
        run, first, tail = TAILS[kind]
        at = last = 0
        while m := tail.search(text, at):
            start = first(text, _back(text, m.start(), last, run), m.start())
            if start >= 0:
                yield start, m.end()
            at, last = (m.end(), m.end()) if start >= 0 else (m.start() + 1, last)
        return
    for m in pattern.finditer(text):
        if m.end(group) - m.start(group) >= least:
            yield m.start(), m.end()


def _compiled(rules):
    # a run of hexadecimal digits is found faster with its least length in the pattern; a class followed by + alone
    # matches maximal runs, so that dropping the short ones gives the same spans
    out = []
    for kind, pattern, group, least in rules:
        runs = re.fullmatch(r"(\[[^\]\[]+\])\+", pattern)
        fast = f"{runs[1]}{{{least},}}" if runs and group == 0 and least else pattern
        out.append((kind, re.compile(fast), group, least))
    return out


def _finder(rules):
    """A function from a record batch to the spans (start, rule, end) of each text, for use inside a task."""
    queries = [trigram_query(r[1]) for r in rules]
    index = BlockIndex(set().union(*map(trigrams_of, queries)))
    ready = _compiled(rules)

    def find(part: pa.RecordBatch, text: str) -> list[list[tuple]]:
        block = texts(part, text)
        postings = index.build(block)
        chosen = np.array([index.candidates(q, postings) for q in queries]).T
        found = []
        for row, which in zip(block, chosen):
            hits = []
            if which.any():
                body = row.as_py()
                hits = [(s, k, e) for k in np.flatnonzero(which) for s, e in matches(ready[k], body)]
            found.append(sorted(hits))
        return found

    return find


def scan(docs: DataFrame, text: str = "text", rules=RULES, out: str = "spans") -> DataFrame:
    """docs with a column ``out``: the spans of every rule in whole texts, in code points, by start and then rule."""
    schema = docs.select("*").schema
    rules = tuple(rules)

    def work(batches):
        find = _finder(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches, text):
            found = [[{"kind": rules[k][0], "start": s, "end": e} for s, k, e in hits] for hits in find(part, text)]
            columns = [c for i, c in enumerate(part.columns) if part.schema.names[i] != out]
            names = [n for n in part.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != out]
    return docs.mapInArrow(work, ", ".join([*fields, f"`{out}` {SPANS}"]))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with every span that scan() finds replaced by its kind in brackets; overlapping spans become one, named by the first. Every other column stays."""
    rules = tuple(rules)

    def clean(body: str, hits: list[tuple]) -> str:
        made, at = [], 0
        for start, k, end in hits:
            if start >= at:
                made += [body[at:start], f"[{rules[k][0]}]"]
            at = max(at, end)
        return "".join([*made, body[at:]])

    def work(batches):
        find = _finder(rules)
        for part in slices(batches, text):
            named = dict(zip(part.schema.names, part.columns))
            found = find(part, text)
            some = [i for i, hits in enumerate(found) if hits]
            if some:
                body = named[text]
                mask = np.zeros(len(body), bool)
                mask[some] = True
                named[text] = pc.replace_with_mask(body, pa.array(mask), pa.array([clean(body[i].as_py(), found[i]) for i in some], body.type))
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return docs.mapInArrow(work, docs.schema)


def op8_secret_scans(spark, sf_dir) -> DataFrame:
    from tillwork.llm.common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
