"""Chat formatting from a declarative template, with DataFrame operations only.

A finite-state machine over roles validates the order of the turns; each turn becomes three
segments (header, text, end), of which only the texts of trained roles carry loss. Control
strings inside texts are escaped reversibly, by rules that follow from the template: a backslash
becomes \\b, the first character of the template's strings, where their second one follows, a
backslash and a letter (\\c| for <|), and in roles that of the string after the role \\n, so that
every backslash is followed by a code of its own. Turns are rows until their places are known,
so that the work grows with the length of a conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """start + role + after_role + text + end for each turn; moves: state -> {role: next state}; a conversation is valid if it ends in one of finals.

    So that an end is only found where one was put: start and end have two characters at least,
    the first one of end stands in no string but at its beginning, start and after_role aren't
    beginnings of end nor end of them, and no string has a backslash.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: {"begin": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered", "tool": "asked"}, "answered": {"user": "asked", "tool": "asked"}})
    initial: str = "begin"
    finals: tuple = ("answered",)

    def __post_init__(self):
        strings = (self.start, self.after_role, self.end)
        nested = any(x.startswith(self.end) or self.end.startswith(x) for x in strings[:2])
        if not all(strings) or min(len(self.start), len(self.end)) < 2 or nested or any("\\" in x or self.end[0] in x[1:] for x in strings):
            raise ValueError("the template's strings can't be told apart in its output")

    @property
    def codes(self) -> list[tuple[str, str]]:
        """What is replaced in texts, in this order, and by what."""
        leads = dict.fromkeys((self.start[:2], self.end[:2]))
        return [("\\", "\\b"), *((lead, f"\\{code}{lead[1]}") for lead, code in zip(leads, "cd"))]

    @property
    def role_codes(self) -> list[tuple[str, str]]:
        after = [(self.after_role[0], "\\n")] if self.after_role[:2] not in (self.start[:2], self.end[:2]) else []
        return self.codes + after


CHATML = Template()


def escaped(text: Column, codes: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, c: F.replace(out, F.lit(c[0]), F.lit(c[1])), codes, text)


def unescaped(text: Column, codes: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, c: F.replace(out, F.lit(c[1]), F.lit(c[0])), reversed(codes), text)


def next_state(state: Column, role: Column, template: Template) -> Column:
    moves = [(a, r, b) for a, to in template.moves.items() for r, b in to.items()]
    return reduce(lambda rest, m: F.when((state == m[0]) & (role == m[1]), F.lit(m[2])).otherwise(rest), moves, F.lit("invalid"))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation: conv_id, valid, formatted, segments array<struct<start, length, loss>> (code points of formatted, start from 0).

    Turns go by turn, then role and text, so that ties and repeated rows have a fixed order;
    null texts and roles are empty. Conversations that the state machine rejects are formatted
    too, with valid = false. A null conv_id is a conversation of its own. Rows that repeat are
    turns each; texts and conversations of any length are formatted whole, one conversation
    being one value. Other columns are not read. An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(template.start), escaped(role, template.role_codes), F.lit(template.after_role))
    said = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text, template.codes).alias("said"))
    said = said.withColumns({"n": F.length("head"), "m": F.length("said")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.col("n") + F.col("m") + len(template.end)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = said.select("conv_id", F.struct(F.row_number().over(order).alias("nth"), F.coalesce(before, F.lit(0)).cast("int").alias("at"), "role", "head", "said", "n", "m").alias("t"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    state = F.aggregate("t", F.lit(template.initial), lambda s, x: next_state(s, x["role"], template))
    segment = lambda start, length, loss: F.struct(start.alias("start"), length.alias("length"), loss.alias("loss"))
    segments = F.transform(
        "t",
        lambda x: F.array(
            segment(x["at"], x["n"], F.lit(False)),
            segment(x["at"] + x["n"], x["m"], x["role"].isin(*template.loss_roles)),
            segment(x["at"] + x["n"] + x["m"], F.lit(len(template.end)), F.lit(False)),
        ),
    )
    return chats.select("conv_id", state.isin(*template.finals).alias("valid"), F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["said"], F.lit(template.end))), "").alias("formatted"), F.flatten(segments).alias("segments"))


def parse_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Reads formatted chats back: conv_id, turns array<struct<role, text>>, loss_text (all text under the loss mask, unescaped)."""
    blocks = F.filter(F.split("formatted", F.lit(rf"\Q{template.end}\E")), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(template.start) + 1))
    parsed = F.transform(
        blocks,
        lambda x: F.struct(
            unescaped(F.substring_index(body(x), template.after_role, 1), template.role_codes).alias("role"),
            unescaped(F.substr(body(x), F.position(F.lit(template.after_role), body(x)) + len(template.after_role)), template.codes).alias("text"),
        ),
    )

    def marked(x: Column, i: Column) -> Column:
        """A turn's part under the mask; its three segments begin where its block does."""
        first, own = F.get("segments", 3 * i), F.get("segments", 3 * i + 1)
        return F.when(own["loss"], unescaped(F.substr(x, own["start"] - first["start"] + 1, own["length"]), template.codes)).otherwise("")

    return formatted.select("conv_id", "valid", "formatted", parsed.alias("turns"), F.array_join(F.transform(blocks, marked), "").alias("loss_text"))
