"""Chat formatting: turns of typed parts become one text with a loss mask, and back.

A turn is a list of parts. A visitor flattens them in order: a text part gives its escaped
text, any other part gives a placeholder, and is recorded as an attachment with its
reference and the number of tokens that it expands to. A line break stands between parts,
so that no control string can form where two parts meet.

A conversation is written as `<|turn|>role<|body|>parts<|end|>` for each turn. Control
strings inside roles and texts (those of this template and those of `<s>`, `[INST]`
templates) get a backslash after their first character. A control string that has
backslashes there already gets one more, so that removing one gives every text back.

Everything is a DataFrame expression; a conversation is one value and therefore one row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm.common import whole

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
# What makes a control string of "<" or "[" and is never shown unescaped.
TAIL = r"(?=\||/?s>|/?INST\])"
ESCAPE = (r"([<\[])(\\*)" + TAIL, r"$1\\$2")
UNESCAPE = (r"([<\[])\\(\\*)" + TAIL, r"$1$2")
# Tokens that an attachment expands to unless its part says so itself.
EXPANSION = {"image": 576, "audio": 750, "document": 1024}
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
UTF32 = "UTF-32"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text; a null text is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            whole(text).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("tokens"),
        )
    ).cast(PART_TYPE)


def _kind(part: Column, expansion: Mapping[str, int]) -> Column:
    known = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(known.isin("text", *expansion), known).otherwise(F.lit("document"))


def _visit(part: Column, expansion: Mapping[str, int]) -> Column:
    kind = _kind(part, expansion)
    return F.when(kind == "text", escape(whole(part["text"]))).otherwise(
        F.concat(F.lit("<|"), kind, F.lit("|>"))
    )


def _attachment(part: Column, place: Column, expansion: Mapping[str, int]) -> Column:
    kind = _kind(part, expansion)
    usual = F.lit(0)
    for name, tokens in expansion.items():
        usual = F.when(kind == name, F.lit(tokens)).otherwise(usual)
    return F.struct(
        place.cast("long").alias("part"),
        kind.alias("type"),
        part["ref"].alias("ref"),
        F.coalesce(part["tokens"], usual.cast("long")).alias("tokens"),
    )


def format_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    parts: str = "parts",
    learn_from: tuple[str, ...] = ("assistant",),
    expansion: Mapping[str, int] = EXPANSION,
) -> DataFrame:
    """One row per conversation.

    Columns: conversation, n_turns, formatted, loss_mask (array of start and length in
    code points, one per turn of a role in learn_from), attachments (array of turn and
    part position from 0, type, reference, tokens), expanded_tokens (their sum).

    Turns are ordered by the order column, then role, then text; nulls come first. A null
    role is empty, null parts are none, a null part type is text, an unknown one a
    document. Rows without conversation form one of their own. Repeated rows are repeated
    turns. Other columns are ignored. An empty table gives no rows.
    """
    turns = df.select(
        F.col(conversation).alias("__conv"),
        F.col(order).alias("__order"),
        whole(F.col(role)).alias("__role"),
        F.coalesce(F.col(parts).cast(PART_TYPE), F.array().cast(PART_TYPE)).alias("__parts"),
    )
    body = F.concat_ws("\n", F.transform("__parts", lambda p: _visit(p, expansion)))
    found = F.filter(
        F.transform(
            "__parts",
            lambda p, i: F.when(_kind(p, expansion) != "text", _attachment(p, i, expansion)),
        ),
        lambda a: a.isNotNull(),
    )
    turns = turns.select("__conv", "__order", "__role", body.alias("__body"), found.alias("__att"))
    head = F.concat(F.lit(TURN), escape(F.col("__role")), F.lit(BODY))
    turns = turns.withColumn("__head", head).withColumn(
        "__piece", F.concat("__head", "__body", F.lit(END))
    )
    ordered = Window.partitionBy("__conv").orderBy(
        F.col("__order").asc_nulls_first(), "__role", "__body"
    )
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.select(
        "__conv",
        (F.row_number().over(ordered) - 1).cast("long").alias("__at"),
        "__piece",
        F.when(
            F.col("__role").isin(*learn_from),
            F.struct(
                (
                    F.coalesce(F.sum(F.char_length("__piece")).over(before), F.lit(0))
                    + F.char_length("__head")
                ).alias("start"),
                F.char_length("__body").cast("long").alias("length"),
            ),
        ).alias("__mask"),
        "__att",
    )
    gathered = placed.groupBy("__conv").agg(
        F.sort_array(F.collect_list(F.struct("__at", "__piece", "__mask", "__att"))).alias("__all")
    )
    attachments = F.flatten(
        F.transform(
            "__all",
            lambda t: F.transform(
                t["__att"],
                lambda a: F.struct(
                    t["__at"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"),
                    a["ref"].alias("ref"), a["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return gathered.select(
        F.col("__conv").alias(conversation),
        F.size("__all").cast("long").alias("n_turns"),
        F.array_join(F.transform("__all", lambda t: t["__piece"]), "").alias("formatted"),
        F.filter(F.transform("__all", lambda t: t["__mask"]), lambda m: m.isNotNull()).alias(
            "loss_mask"
        ),
        attachments.alias("attachments"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(
                F.substring_index(F.substring_index(p, BODY, -1), END, 1)
            ).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order, unescaped, with nothing between."""
    units = F.encode(formatted, UTF32)
    return F.array_join(
        F.transform(
            mask,
            lambda m: unescape(
                F.decode(
                    F.substring(
                        units, (m["start"] * 4 + 1).cast("int"), (m["length"] * 4).cast("int")
                    ),
                    UTF32,
                )
            ),
        ),
        "",
    )
