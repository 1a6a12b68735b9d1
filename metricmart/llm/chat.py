"""Chat formatting with typed content parts (operator 1), in DataFrame functions only.

A message's content is a list of parts: text, image, audio or document. A visitor flattens them in order: texts are
escaped, any other part becomes a placeholder, with its reference kept as an attachment and its tokens counted.
A turn is ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a newline.

Escaping: a backslash is doubled, and one is put after the first character of each control string, so no text or
role can hold one; ``unescaped`` drops the first of each pair. Null roles and texts are empty; turns come by turn,
role and text (nulls first), so repeated and tied rows have one result. An empty table gives no rows. A
conversation is one row by nature, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Control strings of this template and of common others: what may not stand in a text as it is.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """Content of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def expanded_tokens(part: Column, patch: int = 28, tokens_a_second: int = 25, tokens_a_page: int = 576) -> Column:
    """Tokens that a placeholder stands for: patches of an image, seconds of audio, pages of a document."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / patch)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * tokens_a_second)
    pages = F.coalesce(part["pages"], F.lit(1)) * tokens_a_page
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(F.lit(0)).cast("long")


def flattened(parts: Column) -> Column:
    """The visitor: content string of a list of parts. Parts of an unknown or null type count as text."""

    def visit(p: Column) -> Column:
        out = escaped(p["text"])
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def format_chats(messages: DataFrame) -> DataFrame:
    """``messages``: conv_id, turn, role, parts (array of PART). One row for each conversation:

    conv_id, n_turns, formatted, loss_spans (start from 0 and length in code points of what assistants say),
    attachments (turn number from 0, type, ref, tokens; in order), expanded_tokens.
    """
    kinds = list(PLACEHOLDERS)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
    rows = rows.withColumn("content", flattened(F.col("parts")))
    rows = rows.withColumn("head", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))).withColumn("turn_text", F.concat("head", "content", F.lit(END)))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.sum(F.length("turn_text").cast("long")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("conv_id", (F.row_number().over(by_turn) - 1).alias("k"), "turn_text", "role", (F.coalesce(before, F.lit(0)) + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"), F.transform(F.filter("parts", lambda p: p["type"].isin(kinds)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))).alias("held"))
    turn = F.struct("k", "turn_text", "role", "start", "length", "held")
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(F.coalesce(t["held"], F.array().cast("array<struct<type:string,ref:string,tokens:bigint>>")), lambda a: F.struct(t["k"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns_read (role and text of each turn, unescaped) and loss_text (all text under the loss mask, unescaped)."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(F.substring(x, F.lit(len(START) + 1), F.length(x)), SEP, 1)).alias("role"), unescaped(F.substring_index(x, SEP, -1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("turns_read", turns).withColumn("loss_text", loss)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes read back from the formatted strings."""
    said = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
