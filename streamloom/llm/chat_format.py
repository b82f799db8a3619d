"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of typed parts (text, image, audio, document).  They are
visited in order: text is escaped, any other part becomes a placeholder mark,
and its reference and expanded token count are recorded.  Turns are joined in
blocks of consecutive turns, so a very long conversation is many rows of
bounded size; the blocks of a conversation in order are its formatted text.

Template, per turn: ``<|turn|>`` role ``<|text|>`` content ``<|end|>``; a
placeholder is ``<|image|>``, ``<|audio|>``, ``<|document|>`` or, for any other
type, ``<|part|>``, while the attachment keeps the type as given.  Inside roles
and texts a backslash becomes ``\\b``, ``<|`` becomes ``\\l`` and a ``<`` at the
end of a text that another part follows becomes ``\\s``; so no text, role or type
can make a mark, and replacing ``\\l``, ``\\s``, then ``\\b`` gives the text back.

Defined results: a null text is empty; a null role is empty; a part of null type
is text; a part of unknown type is an attachment of one token; a null turn comes
first; turns with equal number are ordered by role, then rendered text, and lie
in one block, however many they are; a very long text is one turn; repeated rows
are turns of their own; a null conv_id is a conversation like others; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Turn numbers that one block of a conversation spans.
BLOCK_TURNS = 64
#: Tokens that a part's placeholder stands for where the part names no count.
PART_TOKENS = {"image": 256, "audio": 150, "document": 1024}
#: The placeholder of parts of other types, which count as one token.
OTHER = "part"
PART_TYPE = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    marks = F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\s"), F.lit("<"))
    return F.replace(marks, F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            none.cast("string").alias("ref"),
            none.cast("int").alias("n_tokens"),
        )
    ).cast(PART_TYPE)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _visit(part: Column, last: Column) -> Column:
    kind = F.when(part["type"].isin(*PART_TOKENS), part["type"]).otherwise(OTHER)
    text = escape(F.coalesce(part["text"], F.lit("")))
    # the next text could begin with the rest of a mark
    open_end = ~last & F.endswith(text, F.lit("<"))
    closed = F.when(open_end, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("\\s"))).otherwise(text)
    return F.when(_is_text(part), closed).otherwise(
        F.concat(F.lit("<|"), kind, F.lit("|>"))
    )


def _tokens(part: Column) -> Column:
    known = F.lit(1)
    for kind, n in PART_TOKENS.items():
        known = F.when(part["type"] == kind, n).otherwise(known)
    return F.coalesce(part["n_tokens"], known).cast("int")


def render_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> one rendered turn per row, with attachments and the loss span inside it."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(BODY))
    parts = F.coalesce(F.col("parts"), F.array().cast(PART_TYPE))
    body = F.array_join(F.transform(parts, lambda p, i: _visit(p, i + 1 == F.size(parts))), "")
    attachments = F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("n_tokens")),
    )
    return (
        turns.select("conv_id", "turn", role.alias("role"), head.alias("head"), body.alias("body"), attachments.alias("a"))
        .select(
            "conv_id",
            "turn",
            "role",
            F.concat("head", "body", F.lit(END)).alias("rendered"),
            F.length("head").alias("from"),
            F.length("body").alias("chars"),
            F.col("a").alias("attachments"),
        )
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per block: (conv_id, block, n_turns, formatted, loss_spans, attachments).

    ``loss_spans`` are the (start, length) code points in ``formatted`` that an
    assistant said; attachments are in the order of their placeholders.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(None).cast("long"))
    rendered = render_turns(turns).withColumn("block", block)
    item = F.struct("turn", "role", "rendered", "from", "chars", "attachments")
    grouped = rendered.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["from"]).alias("start"), t["chars"].alias("len")))
        return F.struct(
            (acc["at"] + F.length(t["rendered"])).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return grouped.select(
        "conv_id",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.aggregate("turns", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def read_back(blocks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars), parsed from formatted blocks alone.

    ``turns`` is role, newline, text, newline for each turn; ``loss`` is the
    unescaped text under the mask.  Placeholders stay as they are;
    ``read_parts`` tells them from texts.
    """

    def one(segment: Column) -> Column:
        def cut(pair: Column) -> Column:
            role = F.substring(F.get(pair, F.lit(0)), len(TURN) + 1, 2_147_483_647)
            return F.concat(unescape(role), F.lit("\n"), unescape(F.get(pair, F.lit(1))), F.lit("\n"))

        return let(F.split(segment, r"<\|text\|>", 2), cut)

    segments = F.array_remove(F.split("formatted", r"<\|end\|>"), "")
    parsed = blocks.select(
        "conv_id",
        F.struct(
            F.col("block"),
            F.size(segments).cast("long").alias("n"),
            F.array_join(F.transform(segments, one), "").alias("turns"),
            unescape(
                F.array_join(
                    F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["len"])), ""
                )
            ).alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("b"),
    )
    return parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs")).select(
        "conv_id",
        F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_turns"),
        F.array_join(F.transform("bs", lambda b: b["turns"]), "").alias("turns"),
        F.array_join(F.transform("bs", lambda b: b["loss"]), "").alias("loss"),
        F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["chars"]).alias("formatted_chars"),
    )


def read_parts(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, at, role, parts): every turn of the formatted blocks, parsed into its typed parts.

    ``at`` counts the turns of a block from 0.  Texts that met have become one
    part, and empty ones none; attachments have their type, reference and count.
    """

    def place(kind: str | Column, text: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("mark"), text.alias("text"))

    def one(segment: Column) -> Column:
        def cut(pair: Column) -> Column:
            role = unescape(F.substring(F.get(pair, F.lit(0)), len(TURN) + 1, 2_147_483_647))
            pieces = F.transform(
                F.split(F.get(pair, F.lit(1)), r"<\|"),  # texts hold none, so each starts a placeholder
                lambda x, i: F.when(i == 0, F.array(place("text", x))).otherwise(
                    F.array(
                        place(F.substring_index(x, "|>", 1), F.lit("")),
                        place("text", F.substring(x, F.instr(x, "|>") + 2, 2_147_483_647)),
                    )
                ),
            )
            kept = F.filter(F.flatten(pieces), lambda p: (p["mark"] != "text") | (p["text"] != ""))
            return F.struct(role.alias("role"), kept.alias("parts"))

        return let(F.split(segment, r"<\|text\|>", 2), cut)

    segments = F.array_remove(F.split("formatted", r"<\|end\|>"), "")
    turns = blocks.select("conv_id", "block", "attachments", F.transform(segments, one).alias("turns"))
    # attachments of the turns before, so that each part finds its own
    held = F.transform("turns", lambda t: F.size(F.filter(t["parts"], lambda p: p["mark"] != "text")))
    each = turns.select("conv_id", "block", "attachments", held.alias("held"), F.posexplode("turns").alias("at", "t"))
    before = F.aggregate(F.slice("held", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b)
    parts = F.transform(
        F.col("t.parts"),
        lambda p, i: let(
            F.get(
                F.col("attachments"),
                F.col("before") + F.size(F.filter(F.slice(F.col("t.parts"), F.lit(1), i), lambda q: q["mark"] != "text")),
            ),
            lambda a: F.when(
                p["mark"] == "text",
                F.struct(
                    F.lit("text").alias("type"),
                    unescape(p["text"]).alias("text"),
                    F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("int").alias("n_tokens"),
                ),
            ).otherwise(
                F.struct(
                    a["type"].alias("type"),
                    F.lit(None).cast("string").alias("text"),
                    a["ref"].alias("ref"),
                    a["n_tokens"].alias("n_tokens"),
                )
            ),
        ),
    )
    return each.withColumn("before", before).select("conv_id", "block", "at", "t.role", parts.alias("parts"))
