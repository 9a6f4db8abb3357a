"""Chat formatting: a finite-state machine over roles and a declarative template, in built-in functions only.

A conversation's turns are first folded in runs of `RUN` turns and the runs are then joined, so a conversation
with a large share of all rows is dealt over many tasks until its one output row is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 128


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, what a model learns from, and which role may follow which state.

    open_turn holds {role}. Control strings start with one of `guarded`; `mark` follows each guarded
    character of a text or role, so no control string can be read inside one.
    """

    open_turn: str = "<|{role}|>\n"
    close_turn: str = "</s>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    states: tuple[str, ...] = ("start", "system", "user", "assistant", "error")
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
            "error": (),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    guarded: str = r"<\[|\\"
    mark: str = "\\"

    def delta(self, state: int, role: str) -> int:
        error = self.states.index("error")
        return self.states.index(role) if role in self.moves[self.states[state]] else error


def escape(text: Column, t: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"([{t.guarded}])", "$1" + t.mark.replace("\\", "\\\\"))


def unescape(text: Column, t: ChatTemplate) -> Column:
    return F.regexp_replace(text, f"([{t.guarded}])" + t.mark.replace("\\", "\\\\"), "$1")


def _machine(role: Column, t: ChatTemplate) -> Column:
    """The role's move as an array: entry s is the state after state s."""
    roles = sorted({r for to in t.moves.values() for r in to})
    error = F.array(*[F.lit(t.states.index("error")) for _ in t.states])
    return reduce(
        lambda other, r: F.when(role == r, F.array(*[F.lit(t.delta(s, r)) for s in range(len(t.states))])).otherwise(other),
        roles,
        error,
    )


def _follow(first: Column, then: Column) -> Column:
    return F.transform(first, lambda s: F.element_at(then, s + 1))


def format_conversations(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conv_id: segments array<struct<text, loss>> and `valid`.

    The formatted text is the segments' texts one after another. Turns go by turn, then role, then text;
    null texts and roles are empty strings, a null turn comes first, a null conv_id is a conversation of
    its own. Repeated rows are turns of their own. A turn order that the machine rejects gives valid = false
    and keeps every turn. Other columns are ignored; no rows give no rows.
    """
    t = template or ChatTemplate()
    same = F.array(*[F.lit(i) for i in range(len(t.states))])
    turns = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    begin, end = t.open_turn.split("{role}")
    runs = (
        turns.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            "run",
            F.flatten(
                F.transform(
                    "turns",
                    lambda x: F.array(
                        F.struct(F.concat(F.lit(begin), escape(x["role"], t), F.lit(end)).alias("text"), F.lit(False).alias("loss")),
                        F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                        F.struct(F.lit(t.close_turn).alias("text"), F.lit(False).alias("loss")),
                    ),
                )
            ).alias("segments"),
            F.aggregate("turns", same, lambda acc, x: _follow(acc, _machine(x["role"], t))).alias("moved"),
        )
    )
    finals = [F.lit(t.states.index(s)) for s in t.final]
    return (
        runs.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("run", "segments", "moved"))).alias("runs"))
        .select(
            "conv_id",
            F.flatten(F.transform("runs", lambda r: r["segments"])).alias("segments"),
            F.element_at(F.aggregate("runs", same, lambda acc, r: _follow(acc, r["moved"])), 1).isin(*finals).alias("valid"),
        )
    )


def read_back(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, the inverse of the template."""
    t = template or ChatTemplate()
    begin, end = t.open_turn.split("{role}")
    pieces = F.filter(F.split(formatted, _quoted(t.close_turn)), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substring(x, len(begin) + 1, 2**30), end, 1), t).alias("role"),
            unescape(F.substring(x, F.locate(end, x) + len(end), F.lit(2**30)), t).alias("text"),
        ),
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")


def digest_rows(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Per conversation, from the output alone: counts and digests of what reads back.

    A conversation without turns can't occur, as each has a row; a null conv_id stays null; no rows give no rows.
    """
    t = template or ChatTemplate()
    read = formatted.select("conv_id", "valid", formatted_text(F.col("segments")).alias("formatted"), loss_text(F.col("segments"), t).alias("loss"))
    read = read.withColumn("turns", read_back(F.col("formatted"), t))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
