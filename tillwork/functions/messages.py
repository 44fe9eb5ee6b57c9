"""Predicates and extraction over chat messages and replies. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.functions.strings import col, strip

QUESTION_WORDS = ("how", "what", "when", "show", "list", "which", "total", "sum", "average", "who", "where", "count", "give", "find", "reset", "clear", "reload", "refresh")
RESET_COMMANDS = ("reset", "clear", "start over")
RELOAD_COMMANDS = ("reload", "refresh", "refresh data")
MEDIA_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
FORBIDDEN_SQL = ("drop ", "delete ", "insert ", "update ", "create ", "alter ", "attach ", "copy ", "truncate ", "export ", "load ", "install ", "pragma ")


def is_question(text) -> Column:
    bare = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    return bare.endswith("?") | F.coalesce(F.split(bare, r"\s+")[0].isin(*QUESTION_WORDS), F.lit(False))


def control_command(text) -> Column:
    bare = F.lower(strip(F.coalesce(col(text), F.lit(""))))
    return F.when(bare.isin(*RESET_COMMANDS), "reset").when(bare.isin(*RELOAD_COMMANDS), "reload").otherwise("none")


def supported_media(kind) -> Column:
    return F.coalesce(F.lower(col(kind)).isin(*MEDIA_TYPES), F.lit(False))


def route_messages(messages: DataFrame, text: str = "text", media: str | None = None) -> DataFrame:
    """messages with route: image, unsupported, question or help; and command."""
    kind = F.col(media) if media else F.lit(None).cast("string")
    route = F.when(kind.isNotNull() & supported_media(kind), "image").when(kind.isNotNull(), "unsupported").when(is_question(F.col(text)), "question").otherwise("help")
    return messages.withColumn("route", route).withColumn("command", control_command(F.col(text)))


def blocked_token(sql, strict: bool = False) -> Column:
    """The first forbidden token of a statement, null if it may run.

    strict: whole words outside of quoted text, whatever follows them, and a second statement (";").
    """
    if not strict:
        lowered = F.lower(F.coalesce(col(sql), F.lit("")))
        return F.try_element_at(F.filter(F.array(*map(F.lit, FORBIDDEN_SQL)), lambda t: F.contains(lowered, t)), F.lit(1))
    bare = F.regexp_replace(F.lower(F.coalesce(col(sql), F.lit(""))), r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/", " ")
    found = F.regexp_extract(bare, r"\b(" + "|".join(t.strip() for t in FORBIDDEN_SQL) + r")\b", 1)
    return F.when(found != "", found).when(bare.rlike(r";\s*\S"), ";")


def extract_sql(reply) -> Column:
    """What stands in the first <sql> element, trimmed; null if there is none."""
    found = F.regexp_extract(F.coalesce(col(reply), F.lit("")), r"(?is)<sql>(.*?)</sql>", 1)
    return F.when(col(reply).rlike(r"(?is)<sql>.*?</sql>"), strip(found))


def strip_sql(reply) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(reply), F.lit("")), r"(?is)<sql>.*?</sql>", ""))


def last_turns(messages: DataFrame, pairs: int = 20, session: str = "session_id", order: str = "turn") -> DataFrame:
    """The last 2 * pairs messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= 2 * pairs).drop("__place")


def parse_verdict(reply, fallback, labels) -> Column:
    """Struct of label, confidence and reason of a verifier's JSON reply, code fences aside; a label that isn't allowed gives the fallback and low confidence."""
    bare = strip(F.regexp_replace(F.coalesce(col(reply), F.lit("")), r"(?i)```(?:json)?", ""))
    got = F.from_json(bare, "final_label string, confidence string, reason string")
    good = F.coalesce(got["final_label"].isin(*labels), F.lit(False))
    return F.struct(
        F.when(good, got["final_label"]).otherwise(col(fallback)).alias("label"),
        F.when(good, F.coalesce(F.lower(got["confidence"]), F.lit("low"))).otherwise("low").alias("confidence"),
        F.coalesce(got["reason"], F.lit("")).alias("reason"),
    )
