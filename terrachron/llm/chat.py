"""Chat formatting as relational expressions (operator 2).

Method: turn structs of a conversation are collected and sorted, neighbouring
turns of one role become one block, and the blocks are concatenated. Only Spark
expressions are used. A conversation is first put together in runs of
``run_turns`` turns, so sorting and escaping a very long one is shared by many
tasks; the runs are then concatenated.

Template: ``<|turn|>role<|text|>first<|next|>second<|end|>\\n``, where <|next|>
parts the texts of merged turns, so the rows can be read back. Control strings
within roles and texts (ours and the common ``<s> </s> [INST] [/INST]``) get a
backslash after their first character, one more if some are there already, which
is reversible. The loss mask is a list of segments, whose concatenation is the
formatted string; assistant texts are under the mask, control strings never.

Defined results: null text or role: empty; turns order by (turn, role, text)
with null turns first, so ties and repeated rows have one order and all stay; a
null conv_id is a conversation of its own; an empty table gives no rows; further
columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
_TAIL = r"(\|(?:turn|text|next|end)\|>|/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, r"$1$2$3")


def format_conversations(rows: DataFrame, *, run_turns: int = 256) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, n_blocks."""
    turn = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    run = F.coalesce(F.floor(F.col("turn") / run_turns), F.lit(-(1 << 62)))
    runs = rows.select("conv_id", run.alias("run"), turn.alias("t")).groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def prefix(role: Column, before: Column, first: Column) -> Column:
        opened = F.concat(F.lit(TURN), escape(role), F.lit(TEXT))
        return F.when(first, opened).when(role == before, F.lit(NEXT)).otherwise(F.concat(F.lit(END), opened))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def inner(x: Column, k: Column) -> Column:
        before = F.get(F.col("t"), F.greatest(k - 1, F.lit(0)))["role"]
        return F.array(segment(F.when(k > 0, prefix(x["role"], before, F.lit(False))).otherwise(""), F.lit(False)), segment(escape(x["text"]), x["role"] == "assistant"))

    formatted = runs.select(
        "conv_id", "run",
        F.element_at("t", 1)["role"].alias("first_role"), F.element_at("t", -1)["role"].alias("last_role"),
        F.flatten(F.transform("t", inner)).alias("segs"),
    )
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "first_role", "last_role", "segs"))).alias("r"))

    def outer(x: Column, k: Column) -> Column:
        before = F.get(F.col("r"), F.greatest(k - 1, F.lit(0)))["last_role"]
        return F.concat(F.array(segment(prefix(x["first_role"], before, k == 0), F.lit(False))), x["segs"])

    segments = F.filter(F.concat(F.flatten(F.transform("r", outer)), F.array(segment(F.lit(END), F.lit(False)))), lambda s: s["loss"] | (s["text"] != ""))
    out = whole.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, one for each row that went in."""
    blocks = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.greatest(F.size(F.split(formatted, r"<\|end\|>\n")) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        halves = F.split(block, r"<\|text\|>")
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(TURN) + 1, 1 << 30))
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|next\|>"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract of the query asks for, read back from the formatted string and the loss mask."""
    read = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
