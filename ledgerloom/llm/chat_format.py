"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a role and a list of parts. A visitor flattens the parts in order: text is escaped and
kept, and each image, audio or document part becomes its placeholder, repeated for its
expanded token count, and an entry in the attachment list. Counts follow the part's size: an image's
tiles of ``TILE`` pixels a side, an audio clip's seconds and a document's pages, each times a rate. A count above ``SHOWN`` is
written as a number, ``<image*100000>``, so that no part's size makes a huge string.

    <turn>user<says>text<image><image>more text</turn>

Control strings begin with ``<``. In a text ``\\`` is written ``\\b`` and ``<`` is written ``\\l``, so no text
can hold a control string, and replacing ``\\l`` and then ``\\b`` gives the text back.

The loss mask is a list of (start, length) in code points over the formatted string: the escaped text of
each assistant turn. ``read_back`` finds turns and masked text in the formatted string alone.

Defined results: null texts, roles and parts are empty; messages are ordered by turn, nulls
first, then role, then parts; a null conversation id is a conversation; repeated rows are repeated turns;
an unknown part kind is an attachment of one token; sizes that are null, not a number or under one count
as one, those above 2**30 (infinity too) as 2**30; a text of any length is one part of its conversation's string, whose 2 GB are Spark's limit; no
rows give no conversations; extra columns are ignored, whatever their names. A conversation is one record of the
output, so its turns meet in one row; conversations are never joined to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
TILE, IMAGE_RATE, AUDIO_RATE, PAGE_RATE, MOST, SHOWN = 512, 4, 2, 8, 1 << 30, 1 << 16
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _tokens(p: Column) -> Column:
    """Expanded token count of an attachment."""
    sized = lambda x: F.greatest(F.least(F.coalesce(x, F.lit(1)), F.lit(MOST)), F.lit(1))
    tiles = lambda x: F.ceil(sized(x) / F.lit(TILE))
    seconds = F.when(F.isnan(p["seconds"]), F.lit(1.0)).otherwise(sized(p["seconds"]))
    return (
        F.when(p["kind"] == "image", tiles(p["width"]) * tiles(p["height"]) * IMAGE_RATE)
        .when(p["kind"] == "audio", F.ceil(seconds) * AUDIO_RATE)
        .when(p["kind"] == "document", sized(p["pages"]) * PAGE_RATE)
        .otherwise(F.lit(1))
        .cast("long")
    )


def _mark(p: Column) -> Column:
    return F.when(p["kind"].isin("image", "audio", "document"), F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(F.lit("<attachment>"))


def _shown(p: Column) -> Column:
    """The placeholder, once for each token."""
    mark, count = _mark(p), _tokens(p)
    return F.when(count <= SHOWN, F.repeat(mark, F.least(count, F.lit(SHOWN)).cast("int"))).otherwise(F.concat(F.rtrim(mark, F.lit(">")), F.lit("*"), count.cast("string"), F.lit(">")))


def _visit(parts: Column) -> Column:
    """The flattened text of a message's parts."""
    own = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    shown = F.transform(own, lambda p: F.when(F.coalesce(p["kind"], F.lit("text")) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(_shown(p)))
    return F.array_join(shown, "")


def _attached(parts: Column) -> Column:
    other = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
    return F.transform(other, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def text_part(text: Column) -> Column:
    """A text as a list of one part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none("string").alias("ref"), none("bigint").alias("width"), none("bigint").alias("height"), none("double").alias("seconds"), none("bigint").alias("pages")))


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> conv_id, formatted, loss_spans [(start, length)], attachments [(kind, ref, tokens)].

    start counts code points from 1.
    """
    flat = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), _visit(F.col("parts")).alias("body"), _attached(F.col("parts")).alias("attached"))
    turns = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns"))
    opened = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SAYS))
    pieces = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(opened(t), t["body"], F.lit(CLOSE)).alias("shown"), F.length(opened(t)).alias("lead"), F.length(t["body"]).alias("size"))).alias("turns"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["lead"]).alias("start"), t["size"].alias("length")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(t["shown"])).alias("at"), spans.alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        "attachments",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns [(role, text)] and loss_text, from formatted and loss_spans."""
    cut = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    parts = lambda t: F.split(F.substring(t, F.lit(len(OPEN) + 1), F.length(t)), SAYS)
    turn = lambda t: F.struct(unescape(parts(t)[0]).alias("role"), unescape(parts(t)[1]).alias("text"))
    loss = F.transform("loss_spans", lambda s: F.col("formatted").substr(s["start"], s["length"]))
    return formatted.select("conv_id", F.transform(cut, turn).alias("turns"), unescape(F.array_join(loss, "")).alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
