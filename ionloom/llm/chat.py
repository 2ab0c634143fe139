"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is a role and a list of parts ``struct<kind, text, ref, width, height, seconds, pages>`` of kind text, image,
audio or document. The visitor turns a text part into escaped text and any other part into a placeholder ``<|kind|>``,
recording reference and expanded token count of each attachment in order. A turn is written as::

    <|role|>\\n...body...<|end|>\\n

Inside texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles ``|`` also becomes ``\\p``), so every ``<`` of
the output belongs to a mark and the texts come back unchanged.

Turns are ordered by (turn, role, text), repeated rows stay repeated, null turns come first. A null role or text counts
as empty, an unknown kind as a text part, missing attachment sizes as 0, a null conversation id is a conversation of its own,
and an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def text_part(text: Column) -> Column:
    """A message that is one text as a list of parts."""
    empty = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), empty.cast("string").alias("ref"),
        empty.cast("int").alias("width"), empty.cast("int").alias("height"), empty.cast("double").alias("seconds"),
        empty.cast("int").alias("pages"),
    ))


def attachment_tokens(part: Column, patch: int = 28, per_second: float = 25.0, per_page: int = 256) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames or document pages."""
    zero = F.lit(0)
    patches = F.ceil(F.coalesce(part["width"], zero) / patch) * F.ceil(F.coalesce(part["height"], zero) / patch)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second))
        .otherwise(F.coalesce(part["pages"], zero) * per_page).cast("long")
    )


def visit(parts: Column) -> Column:
    """Parts of one message as (body, attachments)."""
    is_attachment = lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False))
    shown = F.transform(parts, lambda p: F.when(
        is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))
    ).otherwise(escape(F.coalesce(p["text"], F.lit("")))))
    found = F.transform(F.filter(parts, is_attachment), lambda p: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), attachment_tokens(p).alias("tokens")
    ))
    nothing = F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")
    return F.struct(
        F.coalesce(F.array_join(shown, ""), F.lit("")).alias("body"), F.coalesce(found, nothing).alias("attachments")
    )


def format_chats(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    parts: str | None = None, trained_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: formatted text, loss spans (start and length in code points), attachments in order."""
    content = F.col(parts) if parts else text_part(F.col(text))
    own_role = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit("<|"), escape_role(own_role), F.lit("|>\n"))
    rows = messages.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("t"), own_role.alias("r"), head.alias("head"), visit(content).alias("v")
    )
    turns = F.sort_array(F.collect_list(F.struct(
        "t", "r", F.col("v.body").alias("body"), "head", F.col("v.attachments").alias("attachments")
    )))
    chats = rows.groupBy("conv_id").agg(turns.alias("turns"))
    pieces = F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate("turns", start, lambda acc, x: F.struct(
        (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
        F.when(x["r"].isin(*trained_roles), F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")
        )))).otherwise(acc["spans"]).alias("spans"),
    ))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("formatted"),
        walked["spans"].alias("loss_spans"), F.flatten(F.transform("turns", lambda x: x["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) back from the formatted text. Placeholders of attachments stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p.startswith("<|"))
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(F.substring(p, 3, 1 << 30), "|>\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "|>\n") + 3, F.length(p))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts say when read back."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
