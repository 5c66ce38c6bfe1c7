"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

All of it is SQL expressions. A conversation's turns are gathered in order of turn, then role, then text; the machine
folds over the roles. Control strings inside texts and roles are escaped so that they can be read back: ``&`` becomes
``&amp;``, the opening ``<|`` becomes ``&lt;|``, and a line break in a role becomes ``&#10;``.

Defined results: a null text or role is empty; null turns come first; turns that repeat stay, in the order above; rows
without conv_id are one conversation; an empty table gives no rows; other columns are ignored. A conversation that the
machine rejects is formatted all the same and says at which turn it was rejected. A conversation is one row of the
result, so its turns meet in one task by nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + after_role + text + close for each turn; texts of loss_roles carry loss."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; the machine begins in "start".
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(text, "&", "&amp;"), "<|", "&lt;|")


def unescape(text: Column) -> Column:
    return _replace(_replace(text, "&lt;|", "<|"), "&amp;", "&")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of struct text, loss), valid, rejected_at (turn's place from 0, or null).

    The formatted conversation is its segments' texts in a row.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        role = _replace(escape(t["role"]), "\n", "&#10;")
        head = F.concat(F.lit(template.open), role, F.lit(template.after_role))
        part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"]), t["role"].isin(*template.loss_roles)), part(F.lit(template.close + template.after_turn), F.lit(False)))

    machine = F.create_map(*(F.lit(x) for state, moves in template.machine.items() for role, to in moves.items() for x in (f"{state}\n{role}", to)))
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("rejected_at"))

    def step(s: Column, t: Column) -> Column:
        to = F.element_at(machine, F.concat(s["state"], F.lit("\n"), t["role"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["rejected_at"], F.when(to.isNull(), s["at"])).alias("rejected_at"))

    walked = grouped.withColumn("_end", F.aggregate("turns", begin, step))
    return walked.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        (F.col("_end.rejected_at").isNull() & F.col("_end.state").isin(*template.final)).alias("valid"),
        F.col("_end.rejected_at").alias("rejected_at"),
    )


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    ends = template.close + template.after_turn
    pieces = F.filter(F.split(text, F.lit(r"\Q" + ends + r"\E"), F.lit(-1)), lambda p: F.startswith(p, F.lit(template.open)))

    def turn(p: Column) -> Column:
        body = F.substring(p, len(template.open) + 1, 2**31 - 1)
        role = F.substring_index(body, template.after_role, 1)
        said = body.substr(F.char_length(role) + len(template.after_role) + 1, F.lit(2**31 - 1))
        return F.struct(unescape(_replace(role, "&#10;", "\n")).alias("role"), unescape(said).alias("text"))

    return F.transform(pieces, turn)
