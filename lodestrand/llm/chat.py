"""Chat formatting, with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a
block with array expressions; blocks are concatenated:

    <|im_start|>role\\ntext[<|im_sep|>text ...]<|im_end|>\\n

Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so control strings occur only where
the template puts them and every output can be read back.  In a role a line feed becomes ``\\n``.

The output is an array of segments whose concatenation is the formatted text; a segment of an assistant's text
is under the loss mask, all others aren't.  Every step is linear in the conversation's length.

Defined cases: a null text or role is empty; rows without conv_id form one conversation with a null conv_id;
turns with equal number are ordered by role, then text; repeated rows are turns of their own; a null turn comes
first; other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.arrays import cuts, sums_before

#: Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>; ``formatted()`` joins them."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", turn.alias("t")).repartition("conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spots = F.sequence(F.lit(1), F.size("t"))
    opens = F.filter(spots, lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    convs = convs.withColumn("o", opens)
    # Each block: its role and the slice of turns up to the next block.
    block = F.transform(
        F.sequence(F.lit(1), F.size("o")),
        lambda k: F.struct(
            F.element_at("t", F.element_at("o", k))["role"].alias("role"),
            F.slice("t", F.element_at("o", k), F.when(k < F.size("o"), F.element_at("o", F.least(k + 1, F.size("o")))).otherwise(F.size("t") + 1) - F.element_at("o", k)).alias("turns"),
        ),
    )
    convs = convs.select("conv_id", block.alias("blocks"))

    def segments(b: Column) -> Column:
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        body = F.transform(b["turns"], lambda t, i: F.array(plain(F.when(i > 0, F.lit(SEP)).otherwise(F.lit(""))), F.struct(escape(t["text"]).alias("text"), (b["role"] == trained_role).alias("loss"))))
        return F.concat(F.array(plain(F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")))), F.flatten(body), F.array(plain(F.lit(END))))

    return convs.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def loss_spans(segments: str = "segments") -> Column:
    """array<struct<start, end>>: the masked ranges of the formatted text in code points, end exclusive."""
    size = F.transform(segments, lambda s: F.length(s["text"]))
    placed = F.zip_with(segments, sums_before(size), lambda s, at: F.struct(s["loss"].alias("loss"), at.cast("int").alias("start"), (at + F.length(s["text"])).cast("int").alias("end")))
    return F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, read back from the formatted text at the mask's ranges."""
    return F.array_join(cuts(text, spans, lambda _, inside: unescape(inside)), "")


def parse(text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text."""
    quoted = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split(text, quoted(END)), lambda b: F.startswith(b, F.lit(START)))

    def turns(b: Column) -> Column:
        inner = F.substring(b, len(START) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        body = F.substring(inner, F.length(role) + 2, F.lit(2147483647))
        return F.transform(F.split(body, quoted(SEP), -1), lambda x: F.struct(_unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))
