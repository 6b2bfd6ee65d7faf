"""Chat formatting by a declarative template and a finite-state machine over roles (DataFrame functions only).

A ``Template`` states the headers, the end mark, the escapes, the turn order and
the roles whose text is learned from. Every turn becomes three segments: header,
escaped text, end mark; the flag ``loss`` is set on the text of a loss role alone.
The machine runs as a function of the state before: each part of a conversation is
reduced to the table "state before -> state after", and such tables compose, so a
conversation need not be read by one task to be judged.

Rows are grouped by conversation; one that has turn numbers outside the first
``slice_turns`` is cut into parts of as many turn numbers, so that no task formats
a whole hot conversation. Every other conversation is one part, shuffled once.

Defined results
* Rows are ordered by turn; equal turns by role, then text; a null turn comes first.
  Repeated rows are formatted as often as they occur.
* A null text or role counts as empty. A role the template does not name keeps its
  name in the header and leads to the state ``bad``. Rows without conv_id form
  one conversation whose conv_id is null.
* Conversations that break the turn order are formatted like all others; ``valid``
  is false and ``n_ordered`` counts the turns before the break.
* An empty table gives no rows; extra columns are ignored. The texts of one part are
  one value in Spark, which holds 2 GB at most; so are the digests' inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import stored

SLICE_TURNS = 4096
BAD = "bad"


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like, and which turn orders are valid.

    ``controls`` maps every string that must not occur in a text to the letter that
    stands for it behind ``escape``; the escape itself is written as escape + "s".
    """

    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other_header: tuple[str, str] = ("### [", "]: ")
    turn_end: str = "</turn>\n"
    escape: str = "\\"
    controls: dict[str, str] = field(default_factory=lambda: {"### ": "h", "</turn>": "e"})
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    accept: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = [*self.controls, self.other_header[1]]
        if len(self.escape) != 1 or any(self.escape in m for m in [*marks, *self.headers.values(), self.turn_end]):
            raise ValueError("the escape is one character that no mark holds")
        if any(m[:k] == m[-k:] for m in marks for k in range(1, len(m))):
            raise ValueError("no control string may begin as it ends")
        if len({*self.controls.values(), "s", "r"}) != len(self.controls) + 2 or any(len(c) != 1 for c in self.controls.values()):
            raise ValueError("each control string needs a letter of its own besides s and r")
        if not any(c in self.turn_end for c in self.controls):
            raise ValueError("the end mark must hold a control string")
        heads = [*self.headers.values(), self.other_header[0]]
        if any(a.startswith(b) for i, a in enumerate(heads) for j, b in enumerate(heads) if i != j):
            raise ValueError("no header may begin with another one")

    @property
    def states(self) -> list[str]:
        """All states, ``bad`` last."""
        named = [self.start, *[a for a, _ in self.transitions], *self.transitions.values()]
        return [*dict.fromkeys(s for s in named if s != BAD), BAD]

    @property
    def roles(self) -> list[str]:
        return [*dict.fromkeys([*self.headers, *[r for _, r in self.transitions]])]

    def escaped(self, text: Column) -> Column:
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape + "s"))
        for mark, letter in self.controls.items():
            out = F.replace(out, F.lit(mark), F.lit(self.escape + letter))
        return out

    def unescaped(self, text: Column) -> Column:
        for mark, letter in self.controls.items():
            text = F.replace(text, F.lit(self.escape + letter), F.lit(mark))
        return F.replace(text, F.lit(self.escape + "s"), F.lit(self.escape))

    def header(self, role: Column) -> Column:
        named = F.replace(self.escaped(role), F.lit(self.other_header[1]), F.lit(self.escape + "r"))
        out = F.concat(F.lit(self.other_header[0]), named, F.lit(self.other_header[1]))
        for r, h in self.headers.items():
            out = F.when(role == r, F.lit(h)).otherwise(out)
        return out

    def split_turn(self, turn: Column) -> tuple[Column, Column]:
        """Role and text of one formatted turn without its end mark."""
        begin, end = self.other_header
        rest = F.substring(turn, len(begin) + 1, 2**31 - 1)
        named = F.substring_index(rest, end, 1)
        role = self.unescaped(F.replace(named, F.lit(self.escape + "r"), F.lit(end)))
        text = rest.substr(F.char_length(named) + F.lit(len(end) + 1), F.lit(2**31 - 1))
        for r, h in self.headers.items():
            here = F.startswith(turn, F.lit(h))
            role = F.when(here, F.lit(r)).otherwise(role)
            text = F.when(here, F.substring(turn, len(h) + 1, 2**31 - 1)).otherwise(text)
        return role, self.unescaped(text)

    def moves(self) -> Column:
        """The transition table as a literal: the next state at [state * (roles + 1) + role]."""
        states, roles = self.states, [*self.roles, None]
        at = {s: i for i, s in enumerate(states)}
        return F.array(*[F.lit(at[self.transitions.get((s, r), BAD) if s != BAD else BAD])
                         for s in states for r in roles])

    def role_code(self, role: Column) -> Column:
        out = F.lit(len(self.roles))
        for i, r in enumerate(self.roles):
            out = F.when(role == r, F.lit(i)).otherwise(out)
        return out


def _machine(template: Template, codes: Column) -> Column:
    """For every state before: the state after ``codes`` and how many turns stayed in order."""
    states, width = template.states, len(template.roles) + 1
    bad, moves = len(states) - 1, template.moves()
    same = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(0).cast("long").alias("n")) for i in range(len(states))])

    def step(table, code):
        def move(s):
            after = F.element_at(moves, s["state"] * F.lit(width) + code + F.lit(1))
            return F.struct(after.alias("state"), (s["n"] + F.when(after == bad, 0).otherwise(1)).cast("long").alias("n"))
        return F.transform(table, move)

    return F.aggregate(codes, same, step)


def format_parts(turns: DataFrame, template: Template | None = None, *, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 slice_turns: int = SLICE_TURNS) -> DataFrame:
    """conv_id, part (null turns first, then ascending), whole (the conversation has this part
    alone), segments array<struct<text, loss>>, machine (state before -> state and ordered turns)."""
    template = template or Template()
    turn = F.col(turn_col)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    part = F.floor(turn / F.lit(slice_turns)).cast("long")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), part.alias("part"),
        F.struct(turn.alias("turn"), text(role_col).alias("role"), template.escaped(text(text_col)).alias("text")).alias("t"))
    # written first, so that Spark broadcasts it by its real size or else splits hot keys
    long = stored(rows.filter(F.col("part").isNull() | (F.col("part") != 0))
                  .select(F.col("conv_id").alias("long_id")).distinct(), "chat-long")
    match = F.col("conv_id").eqNullSafe(F.col("long_id"))

    def parts(found: DataFrame, whole: bool, keys: list[str]) -> DataFrame:
        got = found.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("ts"))
        segments = F.flatten(F.transform("ts", lambda t: F.array(
            F.struct(template.header(t["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(t["text"].alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.turn_end).alias("text"), F.lit(False).alias("loss")))))
        codes = F.transform("ts", lambda t: template.role_code(t["role"]))
        return got.select("conv_id", (F.lit(0).cast("long") if whole else F.col("part")).alias("part"),
                          F.lit(whole).alias("whole"), segments.alias("segments"),
                          _machine(template, codes).alias("machine"))

    # two disjoint sets of rows: each text is shuffled once
    return (parts(rows.join(long, match, "left_anti"), True, ["conv_id"])
            .unionByName(parts(rows.join(long, match, "left_semi"), False, ["conv_id", "part"])))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_parts(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Each part read back from its formatted text (turns) and its loss flags (loss)."""
    template = template or Template()
    pieces = F.split("formatted", re.escape(template.turn_end).replace("\\\n", "\n"), -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - F.lit(1))

    def line(t):
        role, text = template.split_turn(t)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return (parts.withColumn("formatted", formatted_text(F.col("segments")))
            .select("conv_id", "part", "whole", "machine", F.char_length("formatted").cast("long").alias("formatted_chars"),
                    F.transform(turns, line).alias("lines"), F.array_join(loss, "").alias("loss"))
            .select("conv_id", "part", "whole", "machine", "formatted_chars", F.size("lines").cast("long").alias("n_turns"),
                    F.array_join("lines", "").alias("turns"), "loss"))


def conversation_digests(read: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: counts and digests of what ``read_parts`` found, and the
    machine's verdict. Only conversations of several parts are grouped once more."""
    template = template or Template()
    several = (read.filter(~F.col("whole")).groupBy("conv_id")
               .agg(F.sort_array(F.collect_list(F.struct("part", "machine", "turns", "loss"))).alias("ps"),
                    F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
               .select("conv_id", "n_turns", "formatted_chars",
                       F.array_join(F.transform("ps", lambda p: p["turns"]), "").alias("turns"),
                       F.array_join(F.transform("ps", lambda p: p["loss"]), "").alias("loss"),
                       F.transform("ps", lambda p: p["machine"]).alias("tables")))
    one = read.filter("whole").select("conv_id", "n_turns", "formatted_chars", "turns", "loss",
                                      F.array("machine").alias("tables"))
    states = template.states
    good = [states.index(s) for s in template.accept]

    def follow(s, table):
        after = F.element_at(table, s["state"] + F.lit(1))
        return F.struct(after["state"].alias("state"), (s["n"] + after["n"]).alias("n"))

    begin = F.struct(F.lit(states.index(template.start)).alias("state"), F.lit(0).cast("long").alias("n"))
    return (one.unionByName(several).withColumn("end", F.aggregate("tables", begin, follow))
            .select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    "formatted_chars", F.col("end.state").isin(*good).alias("valid"), F.col("end.n").alias("n_ordered")))
