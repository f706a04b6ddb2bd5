"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context, and
only its reply is trainable. A conversation's turns are formatted once; example k is the prefix
of that text that ends with its reply, and `loss_start`, `loss_chars` say where the reply is.
Turns after the last assistant turn form a closing example without a trainable part, so each
conversation can be read back whole from its last example.

The template is ``<|turn|>role<|says|>text<|end|>`` for each turn. Control strings (the
template's own and those of common chat formats) inside roles and texts are escaped by a
backslash behind their first character; strings that look escaped get one backslash more, so
`unescape` restores every text.

Defined cases: null text, role or conversation without turns: null text and role are empty
strings, null turn numbers sort first, a null conv_id is a conversation of its own. Equal turn
numbers are ordered by role, then text; repeated rows stay repeated turns. Other columns are
ignored; an empty table has no examples.

Scale: one shuffle by conv_id. Texts of one conversation meet in one row, as the whole prefix is
each example's content; an example's text is cut out of it in the same stage, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TRAINABLE = "assistant"

#: What follows the first character (< or [) of a control string.
_REST = r"(/?s>|\|[a-z_]+\|>|/?INST\]|</?SYS>>)"
_CONTROL = r"(<|\[)(\\*)" + _REST
_ESCAPED = r"(<|\[)\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, is_last, text, loss_start, loss_chars): one row for each assistant turn,
    and one for the turns behind the last, if there are any.

    loss_start (from 0) and loss_chars count characters of text; loss_chars is null in an example
    without a trainable part.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(SAYS))
    rows = conversations.select(
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("said")).alias("key"),
        head.alias("head"),
        escape(text).alias("body"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("key", "head", "body"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    # For each turn: the characters up to its text's start and its text's end.
    bounds = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint,own:boolean>>").alias("done")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.array_append(
                acc["done"],
                F.struct(
                    (acc["at"] + F.length(t["head"])).alias("start"),
                    F.length(t["body"]).cast("long").alias("chars"),
                    (t["key"]["role"] == TRAINABLE).alias("own"),
                ),
            ).alias("done"),
        ),
        lambda acc: acc["done"],
    )
    # The closing example, for conversations whose last turn isn't an assistant's.
    tail = F.when(F.element_at("bounds", -1)["own"], F.array().cast("array<struct<start:bigint,chars:bigint,own:boolean>>")).otherwise(F.slice("bounds", -1, 1))
    cut = turns.select("conv_id", whole.alias("whole"), bounds.alias("bounds")).select("conv_id", "whole", F.concat(F.filter("bounds", lambda b: b["own"]), tail).alias("ends"))
    each = cut.select("conv_id", "whole", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "end"))
    return each.select(
        "conv_id",
        "example",
        (F.col("example") == F.col("n") - 1).alias("is_last"),
        F.substring("whole", F.lit(1), (F.col("end.start") + F.col("end.chars") + len(END)).cast("int")).alias("text"),
        F.col("end.start").alias("loss_start"),
        F.when(F.col("end.own"), F.col("end.chars")).alias("loss_chars"),
    )


def loss_text(example_text: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, unescaped; null if it has none."""
    return unescape(F.substring(example_text, (loss_start + 1).cast("int"), loss_chars.cast("int")))


def read_turns(example_text: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    pieces = F.filter(F.split(example_text, r"<\|end\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), SAYS, 1)).alias("role"),
            unescape(F.substring_index(p, SAYS, -1)).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    turns = read_turns(F.col("text"))
    each = examples.select(
        "conv_id",
        "example",
        F.when(F.col("is_last"), turns).alias("turns"),
        loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.length("text").cast("long").alias("chars"),
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"),
        F.struct("example", "loss").alias("piece"),
        "chars",
    )
    loss = F.array_join(F.transform(F.sort_array(F.col("pieces")), lambda p: F.coalesce(p["loss"], F.lit(""))), "")
    return (
        each.groupBy("conv_id")
        .agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.collect_list("piece").alias("pieces"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
    )
