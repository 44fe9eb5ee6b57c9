"""Quality rules by tokeniser fertility.

Two public vocabularies cut every word, one of pieces with byte fallback and one
of merged bytes; a document's measures by each are characters per token, the
share of byte tokens and the entropy of its tokens (bits). Text that is unlike
its language, as symbol noise, repeated lines, capitals or table debris, is cut
into more, other or fewer kinds of tokens. Entropy grows with length, so what is
judged is its excess over what so many draws from one fixed rank distribution
give.

Rejection bands come from the corpus: for each language and size class (power
of two of the token count) a band is the median of all documents of that class
plus and minus ``width`` robust deviations (quartile distance / 1.349, at least
the measure's floor, about a histogram bin or two). A class of under ``least``
documents borrows from as many neighbouring size classes on both sides as it
takes. A language of fewer takes its script's bands, made likewise, and a script
as rare takes those of the whole corpus, so that no text goes unjudged in a corpus
of ``least`` documents; in a smaller one FIXED bands hold, which are wide and known
for Latin only.
Quartiles come from histograms of fixed bin width, so they are exact to the
bin, the same in every run, and pre-aggregated before any shuffle.

Null texts count as empty and fail the base rules; null languages are a group
of their own; repeated rows are measured each; columns that bear an output's
name are replaced. Very long texts are measured whole, one at a time. A measure
equal to a band's edge is inside; of scripts with as many letters the first by
name counts. An empty table gives no rows and no bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import SLICE_BYTES, WordMemo, give_back, group_sums, laid_out, ragged, slices, split_words, strings, table, texts, vocab_file, written

VOCABULARY, SECOND = "piece_bpe_32k.model", "byte_bpe_50k.json"
SYMBOLS = "#*$%&|<>"
SHINGLE = 8
#: Measure, bin width of its histogram, least robust deviation.
MEASURES = (
    ("chars_per_token", 0.01, 0.01), ("byte_share", 0.005, 0.005), ("entropy_excess", 0.02, 0.05),
    ("second_chars_per_token", 0.01, 0.01), ("second_byte_share", 0.005, 0.005), ("second_entropy_excess", 0.02, 0.05),
)
#: Bands of scripts that the corpus has too few documents of, lowest and highest in the order of MEASURES: natural prose takes 3 to 6 characters a token, the invented one of the test tables about 2.
FIXED = {"latin": ((1.2, 8.0), (0.0, 0.1), (-4.0, 3.0), (1.2, 8.0), (0.0, 0.35), (-4.0, 3.0))}
#: Mean entropy of 8, 16, ... 131,072 draws from 500 ranks r of weight 1 / (r + 5).
EXPECTED = (2.95, 3.87, 4.76, 5.55, 6.25, 6.79, 7.22, 7.53, 7.70, 7.81, 7.85, 7.87, 7.89, 7.89, 7.89)
WIDTH, LEAST = 5.0, 50

#: First code point of each range, and its script; letters only, "" for the rest. Fixed values.
_RANGES = (
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, ""), (0x590, "hebrew"), (0x600, "arabic"), (0x780, ""), (0x900, "indic"), (0xE00, "thai"), (0xE80, ""), (0x1100, "hangul"),
    (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""),
    (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""),
)
_STARTS = np.array([r[0] for r in _RANGES])
_SCRIPTS = sorted({r[1] for r in _RANGES})
_SCRIPT_OF = np.array([_SCRIPTS.index(r[1]) for r in _RANGES])

COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string, entropy_excess double, second_tokens bigint, second_chars_per_token double, second_byte_share double, second_token_entropy double, second_entropy_excess double"


def repeated_words(codes: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words which occurs twice or more in it."""
    n = len(codes)
    if n < width:
        return np.zeros(len(bounds) - 1, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    factor, mixed = np.uint64(0x9E3779B97F4A7C15), doc[starts].astype(np.uint64) + np.uint64(1)
    for j in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * factor + codes[starts + j].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return np.zeros(len(bounds) - 1, np.int64)
    a, b = starts[order][:-1][same], starts[order][1:][same]
    offsets = np.arange(width)
    if not ((codes[a[:, None] + offsets] == codes[b[:, None] + offsets]).all() and (doc[a] == doc[b]).all()):
        # two different windows share a 64-bit value: compare the windows themselves
        rows = np.column_stack([doc[starts], codes[starts[:, None] + offsets]])
        _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hit = starts[count[back.ravel()] > 1]
    else:
        hit = np.unique(np.concatenate([a, b]))
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return group_sums((np.cumsum(cover)[:n] > 0).astype(np.int64), bounds)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x and x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def scripts(words: pa.Array) -> np.ndarray:
    """Script of each word's first character, as an index of _SCRIPTS."""
    first = "".join(c or " " for c in pc.utf8_slice_codeunits(words, 0, 1).to_pylist())
    return _SCRIPT_OF[np.searchsorted(_STARTS, np.frombuffer(first.encode("utf-32-le"), np.uint32), side="right") - 1]


def entropy_excess(entropy: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Entropy over what is expected at that token count; beyond the ends of EXPECTED its first and last values hold."""
    return entropy - np.interp(np.log2(np.maximum(tokens, 1)), np.arange(3, 3 + len(EXPECTED)), EXPECTED)


class _Fertility:
    def __init__(self, path: str, second: str):
        import os

        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.other = Tokenizer.from_file(second)
        kinds = self.other.get_vocab()
        self.sizes = (self.own.vocab_size(), max(kinds.values()) + 1)
        single = np.zeros(self.sizes[1], bool)
        single[[i for token, i in kinds.items() if len(token) == 1]] = True  # a character of the vocabulary's alphabet is a byte
        self.bytes = (np.array([self.own.is_byte(i) for i in range(self.sizes[0])]), single)
        self.memo = WordMemo(lambda words: laid_out(self._both(words)), 400_000)

    def _both(self, words: list) -> list:
        """Ids of each word by the first vocabulary, and after them those by the second, which begin where the first's end."""
        first, shift = self.own.encode(words, num_threads=1), self.sizes[0]
        second = self.other.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)
        return [[*a, *(i + shift for i in b.ids)] for a, b in zip(first, second)]

    def measure(self, known: np.ndarray, bounds: np.ndarray):
        """For each vocabulary n_tokens, byte tokens and entropy of each text, whose words are rows of the memo."""
        lengths = self.memo.lengths[known]
        both = self.memo.ids[ragged(self.memo.starts[known], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        where = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        second = both >= self.sizes[0]
        for turn, (size, single) in enumerate(zip(self.sizes, self.bytes)):
            mine = second == bool(turn)
            ids, doc = both[mine] - turn * self.sizes[0], where[mine]
            tokens = np.bincount(doc, minlength=len(ends) - 1)
            keys, count = np.unique(doc * size + ids, return_counts=True)
            share = count / tokens[keys // size]
            entropy = np.bincount(keys // size, weights=-share * np.log2(share), minlength=len(tokens))
            yield tokens, np.bincount(doc[single[ids]], minlength=len(tokens)), np.abs(entropy)


_loaded: dict[tuple[str, str], _Fertility] = {}


def _fertility(vocabulary: str, second: str) -> _Fertility:
    key = vocab_file(vocabulary), vocab_file(second)
    if key not in _loaded:
        _loaded[key] = _Fertility(*key)
    return _loaded[key]


def measure(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, second: str = SECOND, stay: bool = True) -> DataFrame:
    """docs with the columns of COLUMNS, over whole texts. stay: whether a worker keeps vocabularies and words for its next task, which is faster and takes memory meanwhile."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    keep = [c for c in docs.columns if c not in names]

    def work(batches):
        own = _fertility(vocabulary, second)
        own.memo.take()
        own.memo.most = 400_000 if stay else 200_000
        for part in slices(batches, text, SLICE_BYTES if stay else SLICE_BYTES // 2):
            block = texts(part, text)
            codes, bounds, words = split_words(block)
            known = own.memo.codes(strings(words))[codes] if len(codes) else codes.astype(np.int64)
            (tokens, fallback, entropy), (tokens2, single, entropy2) = own.measure(known, bounds)
            chars = group_sums(np.asarray(pc.utf8_length(words), np.int64)[codes] if len(codes) else codes, bounds)
            symbols = sum(np.asarray(pc.count_substring(block, s), np.int64) for s in SYMBOLS)
            votes = np.zeros((len(block), len(_SCRIPTS)), np.int64)
            if len(codes):
                np.add.at(votes, (np.repeat(np.arange(len(block)), np.diff(bounds)), scripts(words)[codes]), 1)
            votes[:, _SCRIPTS.index("")] = 0
            script = np.array(_SCRIPTS, object)[votes.argmax(1)]
            some, some2 = np.maximum(tokens, 1), np.maximum(tokens2, 1)
            made = [
                np.diff(bounds), chars, symbols, np.array([duplicate_lines(x.as_py()) for x in block], np.int64),
                repeated_words(codes, bounds), tokens, chars / some, fallback / some, entropy, script, entropy_excess(entropy, tokens),
                tokens2, chars / some2, single / some2, entropy2, entropy_excess(entropy2, tokens2),
            ]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *map(pa.array, made)], names=[*keep, *names])
        if not stay:
            own = WordMemo.used = None
            _loaded.clear()
            give_back()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(work, ", ".join([*fields, COLUMNS]))


def _base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _size():
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def _borrowed(counts: DataFrame, least: int) -> DataFrame:
    """counts with those of the nearest size classes added to each class until it has ``least`` documents; names of fewer go."""
    sizes = counts.where(F.col("measure") == MEASURES[0][0]).groupBy("level", "name", "size").agg(F.sum("n").alias("docs"))
    others = sizes.select(*[F.col(c).alias(f"__{c}") for c in ("level", "name", "size", "docs")])
    same = (F.col("level") == F.col("__level")) & F.col("name").eqNullSafe(F.col("__name"))
    away = F.abs(F.col("size") - F.col("__size"))
    group = Window.partitionBy("level", "name", "size").orderBy("away")  # by value: classes as far on either side come together
    reach = sizes.join(others, same).withColumn("away", away).withColumn("sum", F.sum("__docs").over(group)).where(F.col("sum") >= least)
    reach = reach.groupBy("level", "name", "size").agg(F.min("away").alias("reach")).select(F.col("level").alias("__level"), F.col("name").alias("__name"), F.col("size").alias("__size"), "reach")
    near = counts.join(reach, same).where(away <= F.col("reach"))
    return near.select("level", "name", F.col("__size").alias("size"), "measure", "bin", "n")


def bands(measured: DataFrame, lang: str = "lang", width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """One row per level ("lang", "script", "all"), name and size class that has documents: lowest and highest value of each measure.

    Its rows are a few for each language, as it drops names of under ``least`` documents.
    """
    level = lambda name, column: F.struct(F.lit(name).alias("level"), column.alias("name"), _size().alias("size"))
    fit = measured.where(~_base_failed()).select(
        F.explode(F.array(level("lang", F.col(lang)), level("script", F.col("script")), level("all", F.lit("")))).alias("g"),
        *[F.round(F.col(m) / step).cast("int").alias(m) for m, step, _ in MEASURES],
    )
    long = fit.select("g.*", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m, _, _ in MEASURES])).alias("x"))
    counts = long.groupBy("level", "name", "size", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    counts = written(counts.select("level", "name", "size", "measure", F.col("bin").alias("bin"), "n"), "histograms")  # as long as there are bins
    counts = _borrowed(counts, least).groupBy("level", "name", "size", "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "name", "size", "measure")
    ranked = counts.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bin")))
    quartiles = ranked.groupBy("level", "name", "size", "measure").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    edges = []
    for m, step, floor in MEASURES:
        mid = F.max(F.when(F.col("measure") == m, F.col("q2"))) * step
        reach = width * F.greatest(F.max(F.when(F.col("measure") == m, F.col("q3") - F.col("q1"))) * (step / 1.349), F.lit(floor))
        edges += [(mid - reach).alias(f"{m}_low"), (mid + reach).alias(f"{m}_high")]
    return quartiles.groupBy("level", "name", "size").agg(*edges)


def judge(measured: DataFrame, found: DataFrame, lang: str = "lang") -> DataFrame:
    """measured with base_failed and kept. Bands are joined as tables, a row for each language or script, so that Spark knows how small they are."""
    edges = [f"{m}_{e}" for m, _, _ in MEASURES for e in ("low", "high")]
    out = measured.withColumn("base_failed", _base_failed()).withColumn("__size", _size()).withColumn("__every", F.lit(""))
    for level, column in (("lang", lang), ("script", "script"), ("all", "__every")):
        by_size = F.map_from_entries(F.collect_list(F.struct("size", F.struct(*edges))))  # as many as there are powers of two
        side = found.where(F.col("level") == level).groupBy(F.col("name").alias(f"__{level}")).agg(by_size.alias(f"__{level}_bands"))
        side = written(side, "bands")
        out = out.join(side, out[column].eqNullSafe(side[f"__{level}"]), "left")
    fixed = F.lit(None)
    for script, limits in FIXED.items():
        fixed = F.when(F.col("script") == script, F.struct(*[F.lit(x).alias(e) for e, x in zip(edges, (x for pair in limits for x in pair))])).otherwise(fixed)
    band = F.coalesce(F.col("__lang_bands")[F.col("__size")], F.col("__script_bands")[F.col("__size")], F.col("__all_bands")[F.col("__size")], fixed)
    inside = F.lit(True)
    for m, _, _ in MEASURES:
        inside &= F.col(m).between(band[f"{m}_low"], band[f"{m}_high"])
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return out.withColumn("kept", kept).select(*measured.columns, "base_failed", "kept")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", stay: bool = True) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, to tell rows of equal doc_id), measures, base_failed and kept. Measures are written once and read twice; texts aren't."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = written(measure(named, stay=stay).drop("text"), "fertility")
    return judge(measured, written(bands(measured), "bands"))


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script",
    )
