"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, one array aggregation merges
adjacent turns of the same role and concatenates them, and the same fold records the loss
mask as spans of code points over assistant texts::

    ### user: first text<next/>second text</turn>
    ### assistant: answer</turn>

Marks cannot occur inside texts: a backslash is doubled, ``</turn>`` and ``<next/>`` get
one after their first character, and no three ``#`` stay together. ``read_chat`` undoes it exactly.
Roles are percent-encoded.

The one shuffle is the grouping by conversation. One conversation is one output value and
so lives in one task by definition; other conversations do not wait on its key.

Defined results: null text and null role are empty; a null conversation id is a
conversation of its own; equal turn numbers are ordered by role, then text; null turn
numbers come first; repeated rows are turns of their own; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: fixed marks of this format.
HEAD, COLON, NEXT, END = "### ", ": ", "<next/>", "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    broken = F.regexp_replace(doubled, "<(/turn>|next/>)", "<\\\\$1")
    return F.replace(broken, F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    whole = F.replace(text, F.lit("#\\#"), F.lit("##"))
    marks = F.regexp_replace(whole, "<\\\\(/turn>|next/>)", "<$1")
    return F.replace(marks, F.lit("\\\\"), F.lit("\\"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length, in code points, from 0)."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    start = F.struct(
        F.array().cast("array<string>").alias("out"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"))

    def add(s: Column, t: Column) -> Column:
        lead = F.when(s["role"] == t["role"], F.lit(NEXT)).otherwise(
            F.concat(F.when(s["role"].isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(HEAD), F.url_encode(t["role"]), F.lit(COLON)))
        text = escape(t["text"])
        at = s["pos"] + F.length(lead)
        span = F.array(F.struct(at.cast("bigint").alias("start"), F.length(text).cast("bigint").alias("length")))
        return F.struct(
            F.concat(s["out"], F.array(F.concat(lead, text))).alias("out"),
            F.when(t["role"] == loss_role, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
            (at + F.length(text)).cast("bigint").alias("pos"), t["role"].alias("role"))

    folded = grouped.select("conv_id", F.aggregate("turns", start, add).alias("f"))
    return folded.select("conv_id", F.concat(F.array_join("f.out", ""), F.lit(END)).alias("formatted"), F.col("f.spans").alias("loss_spans"))


def read_chat(chats: DataFrame) -> DataFrame:
    """Append ``turns`` (array of role and text) and ``loss_text``, both read from ``formatted``."""
    runs = F.split("formatted", END)

    def turns(run: Column) -> Column:
        body = F.substr(run, F.lit(len(HEAD) + 1))
        at = F.instr(body, COLON)
        role = F.url_decode(F.substr(body, F.lit(1), at - 1))
        texts = F.split(F.substr(body, at + len(COLON)), NEXT)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return chats.select(
        "*",
        F.flatten(F.transform(F.slice(runs, 1, F.size(runs) - 1), turns)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda p: unescape(
            F.substr("formatted", (p["start"] + 1).cast("int"), p["length"].cast("int")))), "").alias("loss_text"))
