"""A vocabulary learned from text, and the expansion of abbreviated item tokens by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.folders import saved
from tillwork.functions.strings import consonant_skeleton, is_subsequence, item_tokens, lcs_ratio, looks_like_abbreviation, strip, subsequences, words


def build_vocab(df: DataFrame, text: str, min_len: int = 6, min_vowels: int = 2, min_freq: int = 3) -> DataFrame:
    """(word, freq, skeleton, first) of the alphabetic words that are long, vowelled and frequent enough."""
    token = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    good = (F.length("word") >= min_len) & (F.length(F.regexp_replace("word", "[^aeiou]", "")) >= min_vowels)
    counted = token.where(good).groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    return counted.select("word", "freq", consonant_skeleton("word").alias("skeleton"), F.substring("word", 1, 1).alias("first"))


#: Letters of a token that looks like an abbreviation, at most.
_LETTERS = 5


def skeleton_pairs(tokens: DataFrame, vocab: DataFrame, coverage: float = 0.40) -> DataFrame:
    """(token, s, word, skeleton, freq) of tokens (token, first, s) and the words whose skeleton may hold the token's.

    A skeleton that holds s holds every pair of letters of s in that order. So words are filed under first letter, length of
    the skeleton and each such pair of theirs (or letter, for s of one), and a token looks under the pair that the fewest
    words of that length have. Skeletons too long to be covered are in no file.
    """
    longest = int(_LETTERS / coverage + 1e-9)
    keys = lambda c, n: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.when(i == j, F.substring(c, i + 1, 1)).otherwise(F.concat(F.substring(c, i + 1, 1), F.substring(c, j + 1, 1)))))))
    size = F.length("skeleton")
    filed = vocab.where((size > 0) & (size <= longest)).withColumn("size", size)
    filed = saved(filed.select("first", "size", F.explode(keys(F.col("skeleton"), F.col("size"))).alias("key"), "word", "skeleton", "freq"), "filed")
    n = F.length("s")
    wanted = F.filter(keys(F.col("s"), n), lambda x: (F.length(x) == 2) | (n == 1))
    asked = tokens.where("s <> ''").select("token", "first", "s", F.explode(F.sequence(n, F.floor(n / coverage + 1e-9).cast("int"))).alias("size"), wanted.alias("keys"))
    held = filed.groupBy("first", "size", "key").agg(F.count("*").alias("n"))
    looked = asked.select("token", "first", "s", "size", F.explode("keys").alias("key")).join(held, ["first", "size", "key"], "left")
    # a pair that no word has rules the length out
    rarest = looked.groupBy("token", "first", "s", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("b")).where("b.n > 0")
    return rarest.select("token", "first", "s", "size", F.col("b.key").alias("key")).join(filed, ["first", "size", "key"]).select("token", "s", "word", "skeleton", "freq")


def fuzzy_pairs(tokens: DataFrame, vocab: DataFrame, cutoff: float = 72.0) -> DataFrame:
    """(token, word) of every token of at most five letters and every word whose lcs ratio, in percent, is the cutoff or more.

    Deletion neighbourhoods: m and n letters reach the cutoff where their longest common subsequence has at least
    least(m, n) letters, so both hold one subsequence of just that length. Tokens and words are filed under their
    lengths and each of their subsequences of it: an equal key means a pair, and no pair is lost.
    """
    share = cutoff / 100 / (2 - cutoff / 100)
    longest = int(_LETTERS / share + 1e-9)
    least = lambda m, n: F.ceil((m + n) * (cutoff / 200) - 1e-9).cast("int")
    m, n = F.length("token"), F.length("word")
    sizes = F.sequence(F.greatest(F.ceil(m * share - 1e-9).cast("int"), F.lit(1)), F.floor(m / share + 1e-9).cast("int"))
    asked = tokens.where((m > 0) & (m <= _LETTERS)).select("token", m.alias("m"), F.explode(sizes).alias("n")).where(least(F.col("m"), F.col("n")) <= F.least("m", "n"))
    asked = asked.select("token", "m", "n", F.explode(subsequences(F.col("token"), least(F.col("m"), F.col("n")), _LETTERS)).alias("key"))
    fits = F.filter(F.sequence(F.lit(1), F.lit(_LETTERS)), lambda m: least(m, n) <= F.least(m, n))
    filed = vocab.where(n.between(1, longest)).select("word", n.alias("n"), F.explode(fits).alias("m"))
    filed = filed.select("word", "m", "n", F.explode(subsequences(F.col("word"), least(F.col("m"), F.col("n")), longest)).alias("key"))
    return asked.join(filed, ["m", "n", "key"]).select("token", "word").distinct()


def expand_tokens(tokens: DataFrame, vocab: DataFrame, coverage: float = 0.40, cutoff: float = 72.0, known_words: DataFrame | None = None) -> DataFrame:
    """(token, expanded, score, method) of distinct tokens. Methods: skeleton, fuzzy, none.

    Only tokens that look like abbreviations are expanded. By skeleton: words of
    the same first letter whose skeleton holds the token's as a subsequence and
    is covered by it enough; the score is coverage times ln(1 + freq), and the
    alphabetically first of the best wins. Tokens that find none take the word of
    greatest lcs ratio (percent) in the whole vocabulary, if it reaches the cutoff.
    Words are found through skeleton_pairs and fuzzy_pairs. known_words (column word): tokens that are left alone.
    """
    one = tokens.select(F.lower("token").alias("token")).where("token is not null").distinct()
    short = one.where(looks_like_abbreviation("token"))
    if known_words is not None:
        short = short.join(known_words.select(F.lower("word").alias("token")).distinct(), "token", "left_anti")
    vocab = saved(vocab.select("word", "freq", "skeleton", "first"), "vocabulary")
    short = saved(short, "tokens")
    keyed = short.select("token", F.substring("token", 1, 1).alias("first"), consonant_skeleton("token").alias("s"))
    share = F.length("s").cast("double") / F.length("skeleton")
    fits = skeleton_pairs(keyed, vocab, coverage).where((share >= coverage) & is_subsequence(F.col("s"), F.col("skeleton")))
    best = saved(fits.groupBy("token").agg(F.min(F.struct((-share * F.log1p("freq")).alias("m"), "word")).alias("b")).select("token", F.col("b.word").alias("expanded"), (-F.col("b.m")).alias("score")), "expanded")
    rest = short.join(best, "token", "left_anti")
    near = fuzzy_pairs(rest, vocab, cutoff).withColumn("score", 100 * lcs_ratio("token", "word")).where(F.col("score") >= cutoff)
    fuzzy = near.groupBy("token").agg(F.min(F.struct((-F.col("score")).alias("m"), "word")).alias("b")).select("token", F.col("b.word").alias("expanded"), (-F.col("b.m")).alias("score"))
    found = best.withColumn("method", F.lit("skeleton")).union(fuzzy.withColumn("method", F.lit("fuzzy")))
    return one.join(found, "token", "left").select("token", F.coalesce("expanded", "token").alias("expanded"), "score", F.coalesce("method", F.lit("none")).alias("method"))


def tokens_of(items: DataFrame, text: str = "item_name") -> DataFrame:
    """Distinct tokens of item names, both as normalised and as written."""
    every = F.array_union(item_tokens(text), words(F.lower(F.coalesce(text, F.lit("")))))
    return items.select(F.explode(every).alias("token")).distinct()


def normalize_items(items: DataFrame, expansions: DataFrame, text: str = "item_name") -> DataFrame:
    """items with normalized and was_normalized. Distinct names are normalised once and joined back."""
    names = items.select(F.col(text).alias("__name")).distinct()
    placed = names.select("__name", F.posexplode_outer(item_tokens("__name")).alias("pos", "token"))
    full = placed.join(expansions.select("token", "expanded"), "token", "left").groupBy("__name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("expanded", "token").alias("t")))), lambda x: x["t"]), " ").alias("normalized")
    )
    joined = items.join(full, items[text].eqNullSafe(full["__name"]), "left").drop("__name")
    return joined.withColumn("was_normalized", F.col("normalized") != F.lower(strip(F.coalesce(text, F.lit("")))))


def abbreviation_info(items: DataFrame, expansions: DataFrame, text: str = "item_name") -> DataFrame:
    """items with has_abbreviations, has_unresolved, unresolved_tokens and resolved_tokens (map), of tokens as written."""
    names = items.select(F.col(text).alias("__name")).distinct()
    placed = names.select("__name", F.posexplode_outer(words(F.coalesce("__name", F.lit("")))).alias("pos", "raw")).withColumn("token", F.lower("raw"))
    told = placed.join(expansions.select("token", "expanded"), "token", "left")
    short = F.coalesce(looks_like_abbreviation("token"), F.lit(False))
    same = F.coalesce("expanded", "token") == F.col("token")
    entry = F.struct("pos", "raw", F.coalesce("expanded", "token").alias("to"))
    sorted_ = lambda cond: F.array_sort(F.collect_list(F.when(cond, entry)))
    info = told.groupBy("__name").agg(sorted_(short & same).alias("u"), sorted_(short & ~same).alias("r"))
    # of repeated tokens the last one counts, as in any map; equal tokens have equal expansions
    resolved = F.map_from_entries(F.array_distinct(F.transform("r", lambda x: F.struct(x["raw"], x["to"]))))
    info = info.select("__name", (F.size("u") + F.size("r") > 0).alias("has_abbreviations"), (F.size("u") > 0).alias("has_unresolved"), F.transform("u", lambda x: x["raw"]).alias("unresolved_tokens"), resolved.alias("resolved_tokens"))
    return items.join(info, items[text].eqNullSafe(info["__name"]), "left").drop("__name")
