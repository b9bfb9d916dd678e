"""Chat formatting with a finite-state machine over roles, in DataFrame functions only.

A declarative ``Template`` names the states (one for each role and a start
state), the roles that may follow each state, the roles under the loss and the
marks around a turn.  ``segments`` emits one row per turn with its text segment,
its loss flag and whether the machine allows the turn; ``conversations`` joins
the segments of each conversation; ``read_back`` parses the joined text again.

Escaping: inside a text or a role, a control string ``<turn`` or ``</turn``,
with any number of backslashes after its ``<``, gets one more backslash there;
reading back takes one away.  So no text holds a bare control string, and every
text comes back unchanged.

Defined cases: a null text is an empty one, a null role is the empty role,
which the machine never allows; null turns come first; rows with equal turns
are ordered by role and text; repeated rows are kept; rows with a null conv_id
form one conversation; a conversation that breaks the turn order is formatted
all the same with ``valid`` false; an empty table gives an empty result; other
columns are ignored.  A conversation's digest needs all of its turns in one
row, so one conversation must fit in a task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "^"


@dataclass(frozen=True)
class Template:
    """Turn order, loss roles and marks; the marks hold the only bare control strings."""

    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    loss_roles: tuple[str, ...] = ("assistant",)
    name: str = "turn"

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(f"<{self.name} "), F.replace(F.replace(self.escape(role), F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit(">\n"))

    @property
    def tail(self) -> str:
        return f"</{self.name}>\n"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<(\\*)(/?{self.name})", r"<\\$1$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"<\\(\\*)(/?{self.name})", r"<$1$2")

    def allowed(self, state: Column, role: Column) -> Column:
        moves = F.create_map(*[F.lit(x) for s, roles in self.follows.items() for r in roles for x in (f"{s}>{r}", True)])
        return F.coalesce(moves[F.concat(state, F.lit(">"), role)], F.lit(False))


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, segment (marked and escaped), loss, allowed.

    The machine's state is the role of the turn before, so a lag over the
    conversation's order runs it.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return t.select(
        "*",
        F.row_number().over(order).alias("pos"),
        F.concat(template.head(F.col("role")), template.escape(F.col("text")), F.lit(template.tail)).alias("segment"),
        F.col("role").isin(*template.loss_roles).alias("loss"),
        template.allowed(F.coalesce(F.lag("role").over(order), F.lit(START)), F.col("role")).alias("allowed"),
    )


def conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, losses (start and length of each loss text, in code points), valid."""
    s = segments(turns, template).select("conv_id", "pos", "segment", "loss", "allowed", F.length(template.head(F.col("role"))).alias("head"))
    g = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment", "loss", "head"))).alias("s"), F.every("allowed").alias("valid"))
    tail = len(template.tail)
    spans = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + x["head"] + 1).alias("start"), (F.length(x["segment"]) - x["head"] - F.lit(tail)).alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return g.select("conv_id", F.concat_ws("", F.transform("s", lambda x: x["segment"])).alias("formatted"), spans.alias("losses"), "valid")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role and text, unescaped) and loss_text, from the formatted text and its loss spans alone."""
    body = F.split("formatted", F.lit(template.tail))
    parts = F.slice(body, F.lit(1), F.size(body) - 1)
    role_at = len(template.name) + 3

    def parse(x: Column) -> Column:
        end = F.position(F.lit(">\n"), x)
        role = F.replace(F.replace(x.substr(F.lit(role_at), end - F.lit(role_at)), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
        return F.struct(template.unescape(role).alias("role"), template.unescape(x.substr(end + 2, F.length(x))).alias("text"))

    loss = F.concat_ws("", F.transform("losses", lambda s: template.unescape(F.substring("formatted", s["start"], s["length"]))))
    return formatted.select("conv_id", "formatted", "valid", F.transform(parts, parse).alias("turns"), loss.alias("loss_text"))


def digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """The contract's columns, read back from the output."""
    back = read_back(conversations(turns, template), template)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
