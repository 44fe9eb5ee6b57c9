"""Column functions over strings. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that carry no meaning in item names.
NOISE_TOKENS = ("oz", "lb", "lbs", "kg", "g", "ml", "l", "ct", "pk", "pkg", "ea", "each", "pc", "pcs", "piece", "pieces", "unit", "units")
#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column) -> Column:
    """strip of a value that is at hand, such as a lambda's; a text that ASCII letters or signs begin and end is left as it is."""
    plain = lambda at: F.substring(text, at, 1).between("!", "~")
    return F.when(plain(1) & plain(-1), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def strip(text) -> Column:
    """Without white space of any script at either end."""
    return once(col(text), stripped)


def norm_str(text) -> Column:
    """Null as empty, upper case, trimmed, only A-Z, 0-9 and blanks."""
    return F.regexp_replace(strip(F.upper(F.coalesce(col(text), F.lit("")))), "[^A-Z0-9 ]", "")


def parse_float(text) -> Column:
    """Commas dropped, two decimals, null where it is no number."""
    return F.round(F.regexp_replace(col(text).cast("string"), ",", "").try_cast("double"), 2)


#: Formats of dates and times in gold labels, in the order they are tried.
_DATES = ("yyyy-M-d", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy")
_TIMES = ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm")


def century(parsed: Column, two_digits: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    late = two_digits & (F.year(parsed) % 100 >= 69) & (F.year(parsed) >= 2000)
    return F.when(late, F.add_months(parsed, -1200)).otherwise(parsed)


def as_date(text: Column, pattern: str) -> Column:
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    return century(parsed, F.lit("yyyy" not in pattern))


def parse_date(text) -> Column:
    """The date as yyyy-MM-dd by the first format that fits, else the trimmed text."""
    bare = strip(F.coalesce(col(text), F.lit("")))
    return F.coalesce(*[F.date_format(as_date(bare, p), "yyyy-MM-dd") for p in _DATES], bare)


def parse_time(text) -> Column:
    """The time as HH:mm by the first format that fits, else the upper-cased text."""
    bare = F.upper(strip(F.coalesce(col(text), F.lit(""))))
    return F.coalesce(*[F.date_format(F.try_to_timestamp(bare, F.lit(p)), "HH:mm") for p in _TIMES], bare)


def words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text) -> Column:
    """The token list that token_f1 compares."""
    return words(norm_str(text))


def f1_of_tokens(p: Column, g: Column) -> Column:
    """token_f1 of two token lists; lists are made once where one meets many."""

    def of(common):
        precision, recall = common / F.size(p), common / F.size(g)
        return F.when(common == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return once(F.size(F.array_intersect(p, g)).cast("double"), of)


def token_f1(pred, gold) -> Column:
    """Harmonic mean of shares of common different tokens in the token lists of either side."""
    return once(F.struct(tokens(pred).alias("p"), tokens(gold).alias("g")), lambda t: f1_of_tokens(t["p"], t["g"]))


#: Letters in a block of bits: one bit is left for the carry, one for the sign.
_BLOCK = 62
_FULL = (1 << _BLOCK) - 1


def letters(text: Column) -> Column:
    """Code points of a text, each as a text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def letter_masks(b: Column) -> Column:
    """The text b as lcs_of_masks wants it: its length, and for each different letter the bits of its places, in blocks of 62."""
    each = letters(b)
    blocks = F.ceil(F.length(b) / _BLOCK).cast("int")

    def places(char, chars):
        def bits(k):
            run = F.slice(chars, k * _BLOCK + 1, F.lit(_BLOCK))
            return F.aggregate(F.reverse(run), F.lit(0).cast("bigint"), lambda acc, x: acc + acc + (x == char).cast("bigint"))

        return F.transform(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), bits)

    # the letters are made once, as a bound variable
    made = F.transform(F.array(each), lambda chars: F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, places(c, chars)))))
    return F.struct(F.length(b).alias("length"), F.element_at(made, 1).alias("masks"))


def lcs_of_masks(a: Column, masked: Column) -> Column:
    """Length of the longest common subsequence of a and the text that letter_masks gave.

    Bit-parallel: a bit of the state is off where a longer match ends. Each letter of a takes one addition a block,
    with a carry from one block to the next, so the path is the same at any length.
    """
    blocks = F.greatest(F.ceil(masked["length"] / _BLOCK).cast("int"), F.lit(1))
    full, none = F.lit(_FULL).cast("bigint"), F.lit(0).cast("bigint")

    def step(state, hits):
        def block(made, k):
            v, hit = F.get(state, k), F.get(hits, k)
            total = v + v.bitwiseAND(hit) + made["carry"]
            kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(hit))).bitwiseAND(full)
            return F.struct(F.array_append(made["v"], kept).alias("v"), F.shiftright(total, _BLOCK).cast("bigint").alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("v"), none.alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(state) - 1), start, block)["v"]

    met = F.filter(F.transform(letters(a), lambda char: F.try_element_at(masked["masks"], char)), lambda hits: hits.isNotNull())  # other letters change nothing
    last = F.aggregate(met, F.array_repeat(full, blocks), step)
    off = blocks * _BLOCK - F.aggregate(last, F.lit(0), lambda acc, v: acc + F.bit_count(v))
    return F.when((F.length(a) == 0) | (masked["length"] == 0), F.lit(0)).otherwise(off)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    bound = F.transform(F.array(F.struct(a.alias("a"), letter_masks(b).alias("b"))), lambda p: lcs_of_masks(p["a"], p["b"]))
    return F.element_at(bound, 1)


def folded(text) -> Column:
    """The trimmed, upper-cased text as lcs_ratio compares it; null as empty."""
    return strip(F.upper(F.coalesce(col(text), F.lit(""))))


def lcs_ratio(a, b) -> Column:
    """2 LCS / (m + n) of the trimmed, upper-cased texts; 0 if either is empty."""
    bound = F.transform(F.array(F.struct(folded(a).alias("x"), folded(b).alias("y"))), lambda p: _ratio(p["x"], p["y"]))
    return F.element_at(bound, 1)


def _ratio(x: Column, y: Column) -> Column:
    total = F.length(x) + F.length(y)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(2.0 * lcs_of_masks(x, letter_masks(y)) / total)


def ratio_of_masks(a: Column, masked: Column) -> Column:
    """lcs_ratio of a folded text and the letter_masks of another; masks are made once where one text meets many."""
    total = F.length(a) + masked["length"]
    return F.when((F.length(a) == 0) | (masked["length"] == 0), F.lit(0.0)).otherwise(2.0 * lcs_of_masks(a, masked) / total)


def can_reach(a, b, ratio: float) -> Column:
    """Whether the lengths allow lcs_ratio >= ratio: the shorter must have at least ratio / (2 - ratio) of the longer."""
    x, y = F.length(col(a)), F.length(col(b))
    return F.least(x, y) >= F.greatest(x, y) * F.lit(ratio / (2 - ratio) - 1e-9)


def sorted_tokens(text) -> Column:
    return F.array_join(F.array_sort(words(F.lower(F.coalesce(col(text), F.lit(""))))), " ")


def sorted_length(text) -> Column:
    """Length of the sorted tokens, as token_sort_ratio compares them."""
    return F.length(F.upper(sorted_tokens(text)))


def token_sort_ratio(a, b) -> Column:
    """lcs_ratio of the sorted tokens, in percent."""
    return 100 * lcs_ratio(sorted_tokens(a), sorted_tokens(b))


def looks_like_abbreviation(token) -> Column:
    """At most five letters and at most one vowel."""
    t = F.lower(F.coalesce(col(token), F.lit("")))
    return t.rlike("^[a-z]{1,5}$") & (F.length(F.regexp_replace(t, "[^aeiou]", "")) <= 1)


def consonant_skeleton(word) -> Column:
    return F.translate(F.lower(col(word)), "aeiou", "")


def is_subsequence(a: Column, b: Column) -> Column:
    """Do the letters of a (a-z only) occur in b in order?"""
    return F.regexp_like(b, F.array_join(F.split(a, ""), ".*"))


def subsequences(text: Column, length: Column, most: int) -> Column:
    """The different subsequences of a given length of a text of at most ``most`` letters: an array of 2 ** most entries at the widest."""
    grown = F.aggregate(letters(F.substring(text, 1, most)), F.array(F.lit("")), lambda acc, c: F.array_distinct(F.concat(acc, F.transform(acc, lambda x: F.concat(x, c)))))
    return F.filter(grown, lambda x: F.length(x) == length)


def skeleton_score(a: Column, w: Column) -> Column:
    """|a| / |w| if a is a subsequence of w, else 0."""
    fits = (F.length(a) > 0) & (F.length(w) > 0) & is_subsequence(a, w)
    return F.when(fits, F.length(a).cast("double") / F.length(w)).otherwise(0.0)


def item_tokens(text) -> Column:
    """Lower-cased tokens of an item name without punctuation and noise."""
    bare = F.translate(F.lower(F.coalesce(col(text), F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(words(bare), lambda w: ~w.isin(*NOISE_TOKENS))


def char_wb_grams(text, lo: int = 2, hi: int = 4) -> Column:
    """Character n-grams inside words padded by a blank; a padded word of at most n characters gives itself once and ends."""

    def of_word(w):
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)

        def runs(n):
            every = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
            return F.when((F.lit(n) == lo) | (size > n - 1), every).otherwise(F.array().cast("array<string>"))

        return F.concat(*[runs(n) for n in range(lo, hi + 1)])

    return F.flatten(F.transform(words(F.lower(F.coalesce(col(text), F.lit("")))), of_word))


def decide(score, threshold: float = 0.5) -> Column:
    """accept if the score, rounded to four decimals, is above the threshold."""
    return F.when(F.round(col(score), 4) > threshold, "accept").otherwise("fallback")


def route(confidence, hi: float = 0.85, lo: float = 0.60) -> Column:
    c = col(confidence)
    return F.when(c >= hi, "auto").when(c >= lo, "verify").otherwise("human")


#: Parts of column names that mean money.
CURRENCY_HINTS = ("total", "sum", "amount", "spend", "cost", "price")


def format_scalar(value, name: str, kind: str) -> Column:
    """Text of a result cell of a Spark type: fractions as money where the column's name means it, else with at most
    four decimals; whole numbers grouped; other types as they are; null and NaN as "No data found."."""
    v = col(value)
    if kind in ("double", "float") or kind.startswith("decimal"):
        number = F.when(~F.isnan(v.cast("double")), v.cast("double"))
        if any(h in name.lower() for h in CURRENCY_HINTS):
            shown = F.concat(F.lit("$"), F.format_number(number, 2))
        else:
            shown = F.regexp_replace(F.regexp_replace(F.format_number(number, 4), "0+$", ""), r"\.$", "")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        shown = F.format_number(v, 0)
    else:
        shown = v.cast("string")
    return F.coalesce(shown, F.lit("No data found."))


def content_hash(content) -> Column:
    return F.md5(col(content))
