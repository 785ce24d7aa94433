"""Operator 10 [native]: chat formatting by event-sourced reconstruction.

An event log (conv_id, seq, turn, part, kind, role, text) is folded into final
messages, which are rendered into one training string per conversation with a loss
mask. Kinds: ``message`` (a whole message), ``edit`` (replaces the message so far),
``regenerate`` (empties it, streamed text follows), ``delta`` (appends). A message is
(conv_id, turn, part); its events are folded in seq order: text restarts at the last
event that is not a delta. Messages are grouped by (conv_id, turn, part), so a long
conversation is folded and escaped by many tasks; only rendered segments meet in the
one string that a conversation is by definition.

Template: ``<|turn|>role<|text|>text<|end|>`` per message. Control strings inside
roles and texts get one backslash after their first character (or one more, if they
have some already); unescaping takes one away, so every text is restored exactly.

Defined results: null texts and roles are empty; a null turn sorts first; null
conv_id is a conversation of its own; repeated rows are messages of their own (the
reader numbers them as parts); an empty log gives no conversations. Extra columns
are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1$2\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)\\" + _TAIL, r"$1$2")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as an event log of whole messages."""
    again = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").cast("long").alias("seq"), "turn", F.row_number().over(again).alias("part"),
        F.lit("message").alias("kind"), "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text): every message after its last event."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = (events.groupBy("conv_id", "turn", "part")
           .agg(F.array_sort(F.collect_list(event)).alias("log")))
    # position of the last restart (0: none), then that text and the deltas after it
    start = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1))), F.lit(1))
    return log.withColumn("live", F.slice("log", start, F.size("log"))).select(
        "conv_id", "turn", "part",
        F.coalesce(F.try_element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != ""), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "").alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start,length>>): spans count code points from 0."""
    part = messages.select("conv_id", F.struct(
        "turn", "part", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("role") == learn_role).alias("learn")).alias("m"))
    turns = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    size = lambda m: F.length(m["head"]) + F.length(m["body"]) + F.lit(len(END))
    ends = F.aggregate(
        "ms", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + size(m)).alias("at"),
            F.when(m["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(m["head"])).alias("start"), F.length(m["body"]).cast("long").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")))
    return turns.select(
        "conv_id", F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "").alias("formatted"),
        ends["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role,text>>, loss_text) parsed from the rendered strings alone."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    parsed = F.transform(pieces, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)<\|text\|>(.*)$", 1)).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", parsed.alias("turns"), F.array_join(under, "").alias("loss_text"))


def format_events(events: DataFrame) -> DataFrame:
    return render(final_messages(events))
