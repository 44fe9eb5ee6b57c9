"""Field extraction from receipt text, as native column expressions.

Lines are cut at line feeds, trimmed, and blank ones dropped; the store is looked
for in the first ten raw lines. Keyword and format lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.strings import as_date, col, once, stripped

MONEY = r"\d[\d,]*\.\d{2}"
_MONTH = "(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)"
#: Patterns of dates in the order they are looked for, each with the formats that can read its hits.
DATES = (
    (r"\b\d{1,2}/\d{1,2}/\d{4}\b", ("M/d/yyyy",)),
    (r"\b\d{1,2}/\d{1,2}/\d{2}\b", ("M/d/yy",)),
    (r"\b\d{4}-\d{2}-\d{2}\b", ("yyyy-M-d",)),
    (r"\b\d{1,2}-\d{1,2}-\d{4}\b", ("M-d-yyyy",)),
    (r"\b\d{1,2}-\d{1,2}-\d{2}\b", ("M-d-yy",)),
    (rf"\b{_MONTH}[A-Z]*\s+\d{{1,2}}\s+\d{{4}}\b", ("MMM d yyyy", "MMMM d yyyy")),
    (rf"\b\d{{1,2}}\s+{_MONTH}[A-Z]*\s+\d{{4}}\b", ("d MMM yyyy", "d MMMM yyyy")),
    (rf"\b{_MONTH}[A-Z]*/\d{{1,2}}/\d{{4}}\b", ("MMM/d/yyyy", "MMMM/d/yyyy")),
)
TIME_PATTERNS = (r"\b\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)\b", r"\b\d{1,2}:\d{2}\s*(?:AM|PM)\b", r"\b\d{1,2}:\d{2}:\d{2}\b")
TOTAL_WORDS = ("TOTAL", "AMOUNT", "BALANCE", "DUE")
CARD_WORDS = ("VISA", "MASTERCARD", "CARD", "DEBIT", "CREDIT", "REFERENCE#")
PAYMENT_WORDS = ("VISA", "MASTERCARD", "MASTER CARD", "AMEX", "AMERICAN EXPRESS", "DISCOVER", "DEBIT", "CREDIT", "CASH")
NUMBER_PATTERNS = (
    r"(?i)(?:RECEIPT|TRANS(?:ACTION)?|REF(?:ERENCE)?|ORDER|CHECK|TICKET)\s*[#:No.]*\s*([A-Z0-9\-]{4,})",
    r"(?i)(?:RECEIPT\s*(?:NO|NUMBER|#))\s*[:\-]?\s*([A-Z0-9\-]{4,})",
)
SKIP_WORDS = (
    "TOTAL", "SUBTOTAL", "TAX", "BALANCE", "CHANGE", "CASH", "CREDIT", "DEBIT", "VISA", "MASTERCARD", "CARD", "DUE", "AMOUNT", "PAYMENT", "THANK", "SAVE",
    "DISCOUNT", "COUPON", "MEMBER", "REWARD", "POINT", "RECEIPT", "STORE", "TEL", "ADDRESS", "PHONE", "WWW", "HTTP", "APPROVED", "AUTH",
)


def _text(text) -> Column:
    return F.coalesce(col(text), F.lit(""))


def lines(text) -> Column:
    return F.filter(F.transform(F.split(_text(text), "\n"), stripped), lambda x: x != "")


def money_lines(text) -> Column:
    """The lines that hold an amount, commas in it or not; other ones can't give a subtotal, tax, total or item."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(r"(?md)^.*\d,*\.,*\d,*\d.*$"), F.lit(0)), stripped)


def _upper_lines(text) -> Column:
    return F.transform(money_lines(text), F.upper)


#: Columns that extract_receipts makes once for all fields: lines with amounts, and these in upper case.
_MONEY_LINES, _UPPER = "__money", "__upper"


def _holds(line: Column, words) -> Column:
    """Whether a line that is at hand holds one of the words."""
    found = F.lit(False)
    for w in words:
        found |= line.contains(w)
    return found


def _amount(money: Column) -> Column:
    return F.regexp_replace(money, ",", "").try_cast("double")


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def detect_store(text) -> Column:
    usable = lambda x: F.when((F.length(x) > 3) & ~x.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}") & ~x.rlike(r"\d+\.\d{2}"), x)
    # lines after the first usable one are not looked at
    found = F.aggregate(F.slice(F.split(_text(text), "\n"), 1, 10), F.lit(None).cast("string"), lambda store, x: F.coalesce(store, once(stripped(x), usable)))
    return F.coalesce(found, F.lit("UNKNOWN"))


def extract_date(text) -> Column:
    """yyyy-MM-dd of the first hit that parses, all hits of a pattern before the next pattern's; empty if none."""

    def found(held):
        def hit(flat, p, formats):
            dates = F.transform(F.regexp_extract_all(flat, F.lit(f"(?i){p}"), F.lit(0)), lambda h: F.coalesce(*[as_date(h, f) for f in formats]))
            return _first(F.filter(dates, lambda d: d.isNotNull()))

        # a later pattern is looked at only where none before gave a date, and one with a slash or dash only where the text has that;
        # blanks, bars and commas end a hit alike, so they are made single blanks only for the patterns that hold blanks
        parts = [(sign, DATES[a:b]) for sign, a, b in (("/", 0, 2), ("-", 2, 5), ("", 5, 7), ("/", 7, 8))]
        spaced = F.regexp_replace(F.translate(held, "|,", "  "), r"\s+", " ")
        each = lambda some: lambda flat: F.coalesce(*[hit(flat, p, formats) for p, formats in some])
        return F.coalesce(*[F.when(held.contains(sign), each(some)(held)) if sign else once(spaced, each(some)) for sign, some in parts])

    return F.coalesce(F.date_format(once(_text(text), found), "yyyy-MM-dd"), F.lit(""))


def extract_time(text) -> Column:
    found = [F.nullif(F.regexp_extract(_text(text), f"(?i){p}", 0), F.lit("")) for p in TIME_PATTERNS]
    return F.coalesce(*found, F.lit(""))


def _labelled(upper, good) -> Column:
    money = F.transform(F.filter(upper, good), lambda x: F.regexp_extract(x, MONEY, 0))
    return _amount(_first(F.filter(money, lambda m: m != "")))


def extract_subtotal(text, upper: Column | None = None) -> Column:
    return _labelled(_upper_lines(text) if upper is None else upper, lambda x: _holds(x, ("SUBTOTAL", "SUB TOTAL", "SUB-TOTAL")))


def extract_tax(text, upper: Column | None = None) -> Column:
    return _labelled(_upper_lines(text) if upper is None else upper, lambda x: x.rlike(r"\bTAX\b") & ~x.contains("TOTAL"))


def extract_total(text, rule: str = "max", upper: Column | None = None) -> Column:
    """Greatest amount in (0, 20000) on keyword lines, else on any line. rule="last_total": the last line with TOTAL and no SUBTOTAL, where there is one."""

    def amounts(some):
        return F.filter(F.flatten(F.transform(some, lambda x: F.transform(F.regexp_extract_all(F.regexp_replace(x, ",", ""), F.lit(r"\d+\.\d{2}"), F.lit(0)), lambda m: m.try_cast("double")))), lambda v: (v > 0) & (v < 20000))

    every = _upper_lines(text) if upper is None else upper
    found = F.coalesce(F.array_max(amounts(F.filter(every, lambda x: _holds(x, TOTAL_WORDS)))), F.array_max(amounts(every)))
    if rule == "last_total":
        own = F.filter(every, lambda x: x.rlike(r"\bTOTAL\b") & ~x.rlike(r"SUB[ -]?TOTAL"))
        found = F.coalesce(F.try_element_at(amounts(own), F.lit(-1)), found)
    return found


def extract_card_last4(text) -> Column:
    def of(line):
        keyed = F.when(once(F.upper(line), lambda held: _holds(held, CARD_WORDS)), F.nullif(F.regexp_extract(line, r"\d{4}", 0), F.lit("")))
        return F.coalesce(keyed, F.nullif(F.regexp_extract(line, r"[Xx*]{4,}(\d{4})", 1), F.lit("")))

    return F.coalesce(_first(F.filter(F.transform(lines(text), of), lambda c: c.isNotNull())), F.lit("cash"))


def extract_payment_method(text) -> Column:
    upper = F.upper(_text(text))
    return F.coalesce(*[F.when(upper.contains(w), F.lit(w.replace(" ", "_"))) for w in PAYMENT_WORDS], F.lit(""))


def extract_receipt_number(text) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(_text(text), p, 1), F.lit("")) for p in NUMBER_PATTERNS], F.lit(""))


def extract_items(text, made: Column | None = None) -> Column:
    """Array of (name, price) of money lines that hold no skip word."""
    skipped = lambda x: once(F.upper(x), lambda held: _holds(held, SKIP_WORDS))  # noqa: E731  made once, not once a word
    money = F.filter(money_lines(text) if made is None else made, lambda x: x.rlike(MONEY) & ~skipped(x))
    items = F.transform(money, lambda x: F.struct(F.btrim(F.regexp_replace(x, MONEY, ""), F.lit(" .-@#*/\\")).alias("name"), F.regexp_extract(x, MONEY, 0).alias("price")))
    return F.filter(items, lambda i: F.length(i["name"]) >= 2)


def extract_receipts(receipts: DataFrame, text: str = "text", total_rule: str = "max") -> DataFrame:
    """receipts with every field; no Python. Lines with amounts are found and trimmed once for all fields."""
    t, made, upper = F.col(text), F.col(_MONEY_LINES), F.col(_UPPER)
    split = receipts.withColumn(_MONEY_LINES, money_lines(t)).withColumn(_UPPER, F.transform(_MONEY_LINES, F.upper))
    return split.select(
        *[c for c in receipts.columns if c != text],
        detect_store(t).alias("store"), extract_date(t).alias("date"), extract_time(t).alias("time"), extract_subtotal(t, upper).alias("subtotal"), extract_tax(t, upper).alias("tax"),
        extract_total(t, total_rule, upper).alias("total"), extract_card_last4(t).alias("card"), extract_payment_method(t).alias("payment_method"),
        extract_receipt_number(t).alias("receipt_number"), extract_items(t, made).alias("items"),
    )
