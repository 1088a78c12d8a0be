"""Chat formatting (operator 1), DataFrame functions only.

A declarative Template says how turns are marked, which role may follow which, and which roles bear loss. Each
turn becomes segments (text, loss); a finite-state machine over the roles validates the order. Control strings
inside roles and texts are escaped reversibly: one backslash goes behind their first character, and behind any
backslashes that already stand there, so the output can be parsed back without doubt.

Defined results: null role or text counts as empty; turns of equal number are ordered by role, then text; a null
turn number comes first; rows with a null conv_id are one conversation; an unknown role is a violation but is
still formatted; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turn_open role role_close text turn_close, for each turn; begin once in front of all."""

    begin: str = "<s>"
    turn_open: str = "[INST]"
    role_close: str = "[/INST]"
    turn_close: str = "</s>"
    #: Strings that mean something to some consumer and so are escaped too.
    also: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role without an entry is a violation.
    moves: dict = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "asked"},
    })
    final: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        marks = [self.begin, self.turn_open, self.role_close, self.turn_close, *self.also]
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))

    def escape(self, text: Column) -> Column:
        """One more backslash in each control string (also in those that hold backslashes already)."""
        for m in self.controls():
            text = F.regexp_replace(text, f"{_quote(m[0])}(\\\\*){_quote(m[1:])}", f"{_insert(m[0])}\\\\$1{_insert(m[1:])}")
        return text

    def unescape(self, text: Column) -> Column:
        for m in self.controls():
            text = F.regexp_replace(text, f"{_quote(m[0])}\\\\(\\\\*){_quote(m[1:])}", f"{_insert(m[0])}$1{_insert(m[1:])}")
        return text


def _quote(s: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", s)


def _insert(s: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", s)


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments (array of text, loss), valid, bad_turn.

    bad_turn is the index of the first turn that the machine rejects (n_turns where the end is missing), else null.
    """
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), t.escape(role).alias("erole"), t.escape(text).alias("etext")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.lit(list(t.loss_roles)) if t.loss_roles else F.array().cast("array<string>")
    seg = lambda s, on: F.struct(s.alias("text"), on.alias("loss"))
    parts = F.transform(
        "turns",
        lambda x: F.array(
            seg(F.concat(F.lit(t.turn_open), x["erole"], F.lit(t.role_close)), F.lit(False)),
            seg(x["etext"], F.array_contains(loss, x["role"])),
            seg(F.lit(t.turn_close), F.lit(False)),
        ),
    )
    segments = F.concat(F.array(seg(F.lit(t.begin), F.lit(False))), F.flatten(parts))
    moves = [(f"{state}\n{role}", to) for state, row in t.moves.items() for role, to in row.items()]
    table = F.create_map(*[F.lit(x) for pair in moves for x in pair])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))

    def step(acc, x):
        to = F.try_element_at(table, F.concat_ws("\n", acc["state"], x["role"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["i"] + 1).alias("i"),
            F.when((acc["bad"] < 0) & to.isNull(), acc["i"]).otherwise(acc["bad"]).alias("bad"),
        )

    ran = whole.select("conv_id", segments.alias("segments"), F.aggregate("turns", start, step).alias("fsm"))
    bad = F.when(F.col("fsm.bad") >= 0, F.col("fsm.bad")).when(~F.col("fsm.state").isin(*t.final), F.col("fsm.i"))
    return ran.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", bad.isNull().alias("valid"), bad.cast("long").alias("bad_turn"))


def parse_chat(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, unescaped: array of (role, text)."""
    t = template or Template()
    pieces = F.split(formatted, _quote(t.turn_open))
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p):
        cut = F.instr(p, t.role_close)
        n = F.length(p)
        body = F.substring(p, cut + len(t.role_close), n - cut - len(t.role_close) + 1 - len(t.turn_close))
        return F.struct(t.unescape(F.substring(p, F.lit(1), cut - 1)).alias("role"), t.unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
