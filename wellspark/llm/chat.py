"""Chat formatting: conversations as one marked text each, with a loss mask, and back.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become a
block; blocks are concatenated. Control strings inside texts and role names are escaped, so the
format can be read back without loss. Everything is a Spark expression on arrays.

``<s>[ROLE]user[TEXT]first text[MORE]second text</s>...``

Turns are in the order of their number, null first, then of role and text. Null roles and texts
are empty ones; rows without a conversation id are one conversation; repeated rows are turns of
their own; an empty table gives an empty result. Other columns are not read. A conversation is one
row of the result, so it must fit into a row (2 GB), which no way of splitting its turns can change.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings. A control's first character stands nowhere else in a control and no control holds
    the escape character, so neither escaped texts nor their borders can make up a control."""

    begin: str = "<s>"
    role: str = "[ROLE]"
    text: str = "[TEXT]"
    more: str = "[MORE]"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")  # not used, but never left in a text
    learned: tuple[str, ...] = ("assistant",)  # roles whose texts are under the loss mask

    def __post_init__(self):
        heads = {c[:1] for c in self.controls}
        if "" in heads or len(set(self.controls)) < len(self.controls) or len(self.controls) >= len(string.ascii_letters):
            raise ValueError("control strings must be distinct, not empty and fewer than 52")
        if any(heads & set(c[1:]) or ESCAPE in c for c in self.controls):
            raise ValueError("a control holds the escape character or, after its first, the first character of one")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.role, self.text, self.more, self.end, *self.reserved)

    @property
    def codes(self) -> list[tuple[str, str]]:
        """What stands for the escape character and for each control, in the order of escaping."""
        return [(c, ESCAPE + code) for c, code in zip((ESCAPE, *self.controls), string.ascii_letters)]


def escaped(text: Column, template: Template = Template()) -> Column:
    for control, code in template.codes:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescaped(text: Column, template: Template = Template()) -> Column:
    for control, code in reversed(template.codes):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def _split(text: Column, control: str) -> Column:
    return F.split(text, rf"\Q{control}\E", -1)


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = Template(),
) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: spans of the learned texts in code points of ``formatted``, ``(start, length)``
    with starts from 0, one for each learned turn."""
    none = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("at"), F.coalesce(role_col, none).alias("role"), F.coalesce(text_col, none).alias("text")
    )
    turns = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("turn"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("ts"))
    ts = F.col("ts")
    convs = convs.withColumn(
        "heads",
        F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"])),
    )
    after = lambda k: F.coalesce(F.get("heads", k + 1), F.size(ts))
    block = lambda at, k: F.struct(
        F.get(ts, at)["role"].alias("role"), F.slice(ts, at + 1, after(k) - at).alias("turns"), (k == 0).alias("first")
    )
    convs = convs.withColumn("blocks", F.transform("heads", block))

    def pieces(b: Column) -> Column:
        lead = F.concat(
            F.when(b["first"], F.lit(template.begin)).otherwise(F.lit(template.end)),
            F.lit(template.role),
            escaped(b["role"], template),
            F.lit(template.text),
        )
        return F.transform(
            b["turns"],
            lambda t, i: F.struct(
                F.when(i == 0, lead).otherwise(F.lit(template.more)).alias("lead"),
                escaped(t["text"], template).alias("body"),
                b["role"].isin(list(template.learned)).alias("learned"),
            ),
        )

    convs = convs.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    span = "struct<start: bigint, length: bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def advance(state: Column, p: Column) -> Column:
        begin, size = state["at"] + F.length(p["lead"]), F.length(p["body"]).cast("bigint")
        own = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(p["learned"], F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct((begin + size).alias("at"), spans.alias("spans"))

    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(template.end))
    spans = F.aggregate("pieces", start, advance, lambda state: state["spans"])
    return convs.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``."""
    body = formatted.substr(F.lit(len(template.begin) + 1), F.length(formatted))
    blocks = _split(body, template.end)

    def turns(block: Column) -> Column:
        parts = _split(block, template.text)
        head = F.get(parts, 0)
        role = unescaped(head.substr(F.lit(len(template.role) + 1), F.length(head)), template)
        texts = _split(F.get(parts, 1), template.more)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescaped(x, template).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learned_texts(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(formatted.substr(s["start"].cast("int") + 1, s["length"].cast("int")), template))
