"""Chat formatting: event-sourced reconstruction of conversations, native DataFrame functions only.

An event log holds rows (conv_id, seq, message, role, kind, payload). Events of
a conversation are sorted by seq and folded: "delta" appends its payload to the
message, "edit" replaces the message by its payload, "regenerate" empties the
message, so that later deltas write it anew, and "delete" removes it.

The fold happens per message first, so that a long conversation is no single
group until its finished messages meet in its one output row.

Template (a text never holds an unescaped marker):
    user       [INST] text [/INST]
    assistant   text </s>          (one blank on either side)
    other      [ROLE] role\\ntext [/ROLE]
A conversation begins with <s>. Control strings inside texts and roles get one
backslash after their first character, besides those that they have there;
taking one away again restores every text.

Null texts, roles and payloads count as empty. Events of equal seq are folded in
the order of kind and payload, messages of equal position in the order of role
and text; repeated rows are kept as messages of their own by ``events_of_turns``.
Very long texts and conversations are one row each, made in time linear in their length but
for the reading of loss spans. An empty log gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings. Fixed values.
CONTROL = r"/?(?:s>|INST\]|ROLE\])"
_ESCAPE = rf"([<\[])(\\*)({CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): a delta for each row.

    Rows of one conversation and turn stay messages of their own, in the order of role and text.
    """
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("payload"))
    counted = one.groupBy("conv_id", "turn", "role", "payload").agg(F.count("*").cast("int").alias("copies"))
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(
        "conv_id",
        F.lit(0).cast("long").alias("seq"),
        F.struct("turn", "role", F.sha2("payload", 256).alias("of"), "copy").alias("message"),
        F.col("turn").alias("position"),
        "role",
        F.lit("delta").alias("kind"),
        "payload",
    )


def streamed(events: DataFrame) -> DataFrame:
    """Each whole message of an event log (a single delta) as the events that a session leaves: a draft that is regenerated, or a first part that is edited, and deltas of the rest."""
    half = F.floor(F.length("payload") / 2).cast("int")
    head, tail = F.substring("payload", F.lit(1), half), F.substring("payload", half + 1, F.length("payload"))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("payload"))
    draft = F.concat(tail, F.lit(" draft"))
    anew = F.array(event(0, "delta", draft), event(1, "regenerate", F.lit("")), event(2, "delta", head), event(3, "delta", tail))
    mended = F.array(event(0, "delta", draft), event(1, "edit", head), event(2, "delta", tail))
    log = F.when(F.length("payload") % 2 == 0, anew).otherwise(mended)
    return events.select("conv_id", "message", "position", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "position", "role", "e.kind", "e.payload")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, position, role, text) of an event log."""
    log = events.groupBy("conv_id", "message").agg(
        F.min("position").alias("position"),
        F.min("role").alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload")))).alias("log"),
    )
    # what stands before the last edit, regeneration or deletion has no effect
    reset = F.filter("log", lambda e: e["kind"].isin("edit", "regenerate", "delete"))
    last = F.when(F.size(reset) > 0, F.element_at(reset, -1))
    after = F.filter("log", lambda e: (e["kind"] == "delta") & (last.isNull() | (F.struct(e["seq"], e["kind"], e["payload"]) > F.struct(last["seq"], last["kind"], last["payload"]))))
    begin = F.when(last["kind"] == "edit", last["payload"]).otherwise("")
    text = F.concat(F.coalesce(begin, F.lit("")), F.array_join(F.transform(after, lambda e: e["payload"]), ""))
    gone = F.coalesce(last["kind"] == "delete", F.lit(False)) & (F.size(after) == 0)
    return log.where(~gone).select("conv_id", "message", "position", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length of each assistant text in formatted, code points)."""
    body = escape(F.col("text"))
    piece = (
        F.when(F.col("role") == "user", F.struct(F.lit("[INST] ").alias("head"), body.alias("body"), F.lit(" [/INST]").alias("tail"), F.lit(False).alias("loss")))
        .when(F.col("role") == "assistant", F.struct(F.lit(" ").alias("head"), body.alias("body"), F.lit(" </s>").alias("tail"), F.lit(True).alias("loss")))
        .otherwise(F.struct(F.concat(F.lit("[ROLE] "), escape(F.regexp_replace("role", r"([\\\n])", r"\\$1")).alias("role"), F.lit("\n")).alias("head"), body.alias("body"), F.lit(" [/ROLE]").alias("tail"), F.lit(False).alias("loss")))
    )
    turns = fold(events).select("conv_id", "position", "role", "text", piece.alias("piece"))
    width = F.length("piece.head") + F.length("piece.body") + F.length("piece.tail")
    order = Window.partitionBy("conv_id").orderBy("position", "role", "text")
    ends = F.sum(width.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = turns.select("conv_id", F.row_number().over(order).alias("place"), "piece", (3 + ends - width + F.length("piece.head")).cast("int").alias("start"))
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "start"))).alias("turns"))
    whole = F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: F.concat(t["piece"]["head"], t["piece"]["body"], t["piece"]["tail"])), ""))
    loss = F.transform(F.filter("turns", lambda t: t["piece"]["loss"]), lambda t: F.struct(t["start"].alias("start"), F.length(t["piece"]["body"]).alias("length")))
    return chats.select("conv_id", whole.alias("formatted"), loss.alias("loss_spans"))


_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|\[ROLE\] (.*?) \[/ROLE\]| (.*?) </s>"


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    found = F.regexp_extract_all(F.substring(formatted, 4, 2147483647), F.lit(_TURN), F.lit(0))

    def turn(x):
        user, other = F.startswith(x, F.lit("[INST] ")), F.startswith(x, F.lit("[ROLE] "))
        cut = F.when(user, F.substring(x, 8, F.length(x) - 15)).when(other, F.substring(x, 8, F.length(x) - 15)).otherwise(F.substring(x, 2, F.length(x) - 6))
        # the role ends at the first line feed that has no backslash before it
        role = F.regexp_extract(cut, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
        return F.struct(
            F.when(user, "user").when(other, F.regexp_replace(unescape(role), r"\\([\\\n])", "$1")).otherwise("assistant").alias("role"),
            unescape(F.when(other, F.substring(cut, F.length(role) + 2, F.length(cut))).otherwise(cut)).alias("text"),
        )

    return F.transform(found, turn)


def op9_chat_formatting(spark, sf_dir) -> DataFrame:
    from tillwork.llm.common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT -1L AS conv_id, turn, role, text FROM VALUES (0L, 'user', '%s'), (1L, 'assistant', '%s') AS t(turn, role, text)" % (told, told))
    chats = format_chats(streamed(events_of_turns(turns.unionByName(more))))
    back = chats.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    lossy = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    loss = F.array_join(lossy, "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g')"
OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, length({_SQL_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
    ELSE 16 + length({_SQL_ESCAPED.format(r"regexp_replace(role, '([\\\n])', '\\\1', 'g')")}) END AS width FROM t
)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(width))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
