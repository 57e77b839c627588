"""Chat formatting: turns of a conversation as one training text with a loss mask, in Spark expressions only.

Template: a message is <|im_start|>role<|im_sep|>text<|im_end|> and a line feed.
Adjacent turns of one role are one message, their texts kept apart by
<|im_part|>. Inside roles and texts a backslash is added to every "<", any
backslashes, "|", so no control string can occur there and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def messages(turns: Column) -> Column:
    """Array of struct(role, texts): sorted turns (struct of turn, role, text) with adjacent ones of a role merged."""
    first = F.filter(
        F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull()
    )

    def sliced(starts: Column) -> Column:
        upto = lambda j: F.coalesce(F.get(starts, j + 1), F.size(turns))
        return F.transform(
            starts,
            lambda i, j: F.struct(F.get(turns, i)["role"].alias("role"), F.transform(F.slice(turns, i + 1, upto(j) - i), lambda t: t["text"]).alias("texts")),
        )

    return C.let(first, sliced)


def chat(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, n_messages, formatted and loss, an array of struct(start, length): the code points of formatted under the loss mask.

    The mask has each text of a turn whose role is learn, escaped as it stands in formatted, and nothing between.
    A conversation's turns are collected into one row, which its text has to be in any case.
    Results: null roles and texts are empty; turns of equal number, and repeated rows, are ordered by role, then text, null numbers first; turns with a
    null conversation form one; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    given = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), C.whole(text).alias("text")).alias("t"),
    )
    convs = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), C.let(F.col("turns"), messages).alias("m"))
    lead = lambda m: F.concat(F.lit(START), escaped(m["role"]), F.lit(SEP))
    written = F.transform(
        "m", lambda m: F.struct((m["role"] == learn).alias("learn"), lead(m).alias("lead"), F.transform(m["texts"], escaped).alias("texts"))
    )
    convs = convs.select("conv_id", "n_turns", F.size("m").cast("long").alias("n_messages"), written.alias("w"))
    whole = F.transform("w", lambda w: F.concat(w["lead"], F.array_join(w["texts"], PART), F.lit(END)))
    # Pieces of text in order with the code points from the end of the piece before to its own end; starts are their running sum.
    pieces = F.flatten(
        F.transform(
            "w",
            lambda w: F.transform(
                w["texts"],
                lambda t, i: F.struct(
                    w["learn"].alias("learn"),
                    F.when(i == 0, F.length(w["lead"])).otherwise(F.lit(len(PART))).alias("gap"),
                    F.length(t).alias("length"),
                    F.when(i == F.size(w["texts"]) - 1, F.lit(len(END))).otherwise(F.lit(0)).alias("after"),
                ),
            ),
        )
    )
    size = F.transform("p", lambda p: p["gap"] + p["length"] + p["after"])
    spans = lambda ends: F.transform(
        "p", lambda p, i: F.struct(p["learn"].alias("learn"), (F.get(ends, i) - p["after"] - p["length"]).alias("start"), p["length"].alias("length"))
    )
    convs = convs.select("conv_id", "n_turns", "n_messages", "w", pieces.alias("p"))
    placed = C.let(size, lambda z: C.let(C.running(z, lambda x, y: x + y), spans))
    loss = F.transform(F.filter(placed, lambda s: s["learn"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return convs.select("conv_id", "n_turns", "n_messages", F.array_join(whole, "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda m: m != "")

    def one(m: Column) -> Column:
        at = F.call_function("instr", m, F.lit(SEP))
        role = unescaped(F.substring(m, F.lit(len(START) + 1), at - len(START) - 1))
        texts = F.split(F.substring(m, at + len(SEP), F.length(m)), r"<\|im_part\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(parts, one))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
