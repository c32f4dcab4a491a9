"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; runs of turns with one role become one block.  A block is
``<s ROLE>part<sep>part...</s>`` and is written once for each run, so the runs' starts are found first and each
run's parts are joined, which keeps the work in proportion to the conversation's length.  Every control string starts
with ``<``; inside roles and texts ``&`` is written ``&amp;`` and ``<`` is written ``&lt;``, so no text can forge one and
the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, SEP, END_OF_HEAD = "<s ", "</s>", "<sep>", ">"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to (conv_id, formatted, loss_runs).

    Turns go by turn number, ties by role, then text; repeated rows are all kept.  Null roles and texts are empty, a
    null turn comes first, null conv_ids form one conversation.  loss_runs has (outside, inside) for each block: code
    points before its text, counted from the end of the text of the block before, and code points of its text that
    are learned, 0 unless the role is assistant, so masks stay in proportion to the turns.  A conversation is one
    row, so it must fit in memory; time grows in proportion to it.  Empty tables give empty results; extra columns
    are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Each lambda sees the elements that it needs only: a lambda that refers to a whole computed array computes it for every element.
    roles = F.transform("t", lambda x: x["role"])
    changed = F.zip_with(roles, F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.size("t") - 1)), lambda own, before: ~own.eqNullSafe(before))
    starts = F.array_compact(F.transform(changed, lambda new, i: F.when(new, i)))
    spans = lambda found: F.zip_with(found, F.concat(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.size("t"))), lambda a, b: F.struct(a.alias("at"), (b - a).alias("n")))
    runs = F.transform(spans(starts), lambda s: F.slice("t", s["at"] + 1, s["n"]))
    block = lambda run: F.struct(F.concat(F.lit(OPEN), escape(F.get(run, 0)["role"]), F.lit(END_OF_HEAD)).alias("head"), F.array_join(F.transform(run, lambda x: escape(x["text"])), SEP).alias("body"), (F.get(run, 0)["role"] == "assistant").alias("learned"))
    blocks = gathered.select("conv_id", F.transform(runs, block).alias("b"))
    close = len(CLOSE)
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("b", lambda b: F.concat(b["head"], b["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform("b", lambda b, i: F.struct((F.when(i > 0, close).otherwise(0) + F.char_length(b["head"]) + F.when(b["learned"], 0).otherwise(F.char_length(b["body"]))).alias("outside"), F.when(b["learned"], F.char_length(b["body"])).otherwise(0).alias("inside"))).alias("loss_runs"),
    )


def _blocks(formatted: Column) -> Column:
    """What stands before each CLOSE; no text holds one, as its first character is escaped."""
    whole = F.split(formatted, CLOSE, -1)
    return F.slice(whole, F.lit(1), F.size(whole) - 1)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, ...) to (conv_id, turns): the (role, text) of every turn, from the formatted string alone."""
    head = lambda b: F.substring_index(b, END_OF_HEAD, 1)
    role = lambda b: unescape(F.substring(head(b), len(OPEN) + 1, 1 << 30))
    body = lambda b: b.substr(F.char_length(head(b)) + 2, F.char_length(b))
    turns = F.flatten(F.transform(_blocks(F.col("formatted")), lambda b: F.transform(F.split(body(b), SEP, -1), lambda p: F.struct(role(b).alias("role"), unescape(p).alias("text")))))
    return formatted.withColumn("turns", turns)


def loss_text(formatted: Column, loss_runs: Column) -> Column:
    """All text under the loss mask, unescaped and without the marks between parts.

    The runs are laid along the string block by block: a block's masked text is its last `inside` code points.
    """
    masked = F.zip_with(_blocks(formatted), loss_runs, lambda b, r: F.when(r["inside"] > 0, F.right(b, r["inside"])).otherwise(""))
    return F.array_join(F.transform(masked, lambda s: unescape(F.replace(s, F.lit(SEP), F.lit("")))), "")
