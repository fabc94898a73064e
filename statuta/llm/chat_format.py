"""Operator 8: chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor over the
list turns each part into a piece of the formatted text, in order: the texts between two
attachments are joined and their control strings escaped (also one split between parts), the
others become a placeholder that names its number.  Beside the text a turn keeps its attachments (number, type, reference, expanded tokens) and the total of
expanded tokens.  Turns are marked by control strings; escaping puts a backslash behind the
first character of any control string in a text (one more where backslashes already stand
there), so that it can be undone and never reads as a mark.  The loss mask of a turn is the
span of an assistant's content.

Formatting and reading back are DataFrame expressions, row by row and without a shuffle.
Only the digests need a conversation's turns in order: they are hashed as a stream of rows
sorted by conversation and turn, so a conversation of any length keeps constant memory.

Defined cases: null text, role or parts are empty; an unknown part type reads as text;
turns with equal numbers go by role, then formatted text; repeated rows are repeated turns;
a null conversation is one conversation; other columns are not read.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import ship

ship(__name__)

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: A control string's first character, any backslashes, and what makes it one.
CONTROL = r"([<\[])(\\*)(?=\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,duration_ms:long,pages:int>>"
ATTACHED = ("image", "audio", "document")
#: Expanded tokens: an image's square tiles, an audio's frames, a document's pages, a text's characters.
TILE, UNKNOWN_IMAGE = 28, 256
FRAME_MS, UNKNOWN_AUDIO = 80, 64
PAGE_TOKENS = 512
TEXT_CHARS_PER_TOKEN = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _expanded(part: Column) -> Column:
    """Tokens that a part takes once it is expanded."""
    image = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    return (F.when(part["type"] == "image", F.coalesce(image, F.lit(UNKNOWN_IMAGE)))
            .when(part["type"] == "audio", F.coalesce(F.ceil(part["duration_ms"] / FRAME_MS), F.lit(UNKNOWN_AUDIO)))
            .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
            .otherwise(F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / TEXT_CHARS_PER_TOKEN))).cast("long")


def _is_attached(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*ATTACHED), F.lit(False))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("int").alias("pages")))


def format_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> one formatted segment per turn.

    Columns: conv_id, turn, segment, loss (start and end of the loss span in the segment, or
    null), attachments (number, type, ref, tokens) and n_tokens (expanded).
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    role = F.coalesce(F.col("role"), F.lit(""))
    base = messages.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    base = base.withColumn("attached", F.filter("parts", _is_attached))
    # places of the attachments, from 1; run r is the text between attachments r - 1 and r
    visited = base.withColumn("at", F.filter(F.transform("parts", lambda p, i: F.when(_is_attached(p), i + 1)),
                                             lambda i: i.isNotNull()))
    at, n = F.col("at"), F.size("at")

    def run(r: Column) -> Column:
        first = F.when(r > 0, F.element_at(at, F.greatest(r, F.lit(1)))).otherwise(0) + 1
        end = F.when(r < n, F.element_at(at, F.least(r + 1, n))).otherwise(F.size("parts") + 1)
        texts = F.transform(F.slice("parts", first, end - first), lambda p: F.coalesce(p["text"], F.lit("")))
        # parts are joined before they are escaped: a control string may be split between them
        return escape(F.array_join(texts, ""))

    def mark(r: Column) -> Column:
        kind = F.element_at("attached", F.least(r + 1, n))["type"]
        return F.concat(F.lit("<|"), kind, F.lit("|"), r.cast("string"), F.lit("|>"))

    pieces = F.transform(F.sequence(F.lit(0), n), lambda r: F.when(r < n, F.concat(run(r), mark(r))).otherwise(run(r)))
    visited = visited.withColumn("body", F.array_join(pieces, ""))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    loss = F.when(F.col("role") == "assistant", F.struct(
        F.length(head).alias("start"), (F.length(head) + F.length("body")).alias("end")))
    return visited.select(
        "conv_id", "turn", F.concat(head, "body", F.lit(END)).alias("segment"), loss.alias("loss"),
        F.transform("attached", lambda p, i: F.struct(
            i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
        .alias("attachments"),
        F.aggregate(F.transform("parts", _expanded), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Role, text and loss text of every turn, read from the segments alone."""
    whole = rf"(?s)^<\|turn\|>(.*?)<\|body\|>(.*)<\|end\|>$"
    marks = r"<\|(?:image|audio|document)\|\d+\|>"

    def plain(text: Column) -> Column:
        # the runs between placeholders were escaped one by one
        return F.array_join(F.transform(F.split(text, marks, -1), unescape), "")

    start, end = F.col("loss")["start"], F.col("loss")["end"]
    return formatted.select(
        "conv_id", "turn", "segment", unescape(F.regexp_extract("segment", whole, 1)).alias("role"),
        plain(F.regexp_extract("segment", whole, 2)).alias("text"),
        F.when(F.col("loss").isNotNull(), plain(F.substring("segment", start + 1, end - start))).alias("loss_text"),
        F.length("segment").cast("long").alias("chars"))


def _digest(batches):
    """Rows sorted by conversation and turn -> one row of digests per conversation."""
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, state = None, None

    def close():
        return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def frame(rows):
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    for batch in batches:
        done = []
        for conv, role, text, loss, chars in zip(*(batch[c] for c in ("conv_id", "role", "text", "loss_text", "chars"))):
            conv = None if pd.isna(conv) else int(conv)
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(close())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += int(chars)
        yield frame(done)
    if now is not None:
        yield frame([close()])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(formatted).withColumn("conv_id", F.col("conv_id").cast("long"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.drop("segment").mapInPandas(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
                 " formatted_chars long")
