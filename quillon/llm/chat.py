"""Chat formatting with a finite-state machine over roles, in DataFrame functions only.

A declarative template gives each role what opens and closes its turn, and whether its text is learnt. A conversation's turns, in
order, become segments (text, loss); their concatenation is the training string. The machine's transitions say which role may
follow which; a conversation that breaks them is formatted all the same and marked as not valid.

Control strings inside a text are escaped: a backslash is doubled, and one is put after the first character of each control
string, so no control string is left and `unescaped` gives the text back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """`turns` by role; any other role (null too) is written between `other`'s marks, with its escaped name first."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS] ", " [/SYS]", False),
            "user": Turn("<s>[INST] ", " [/INST]", False),
            "assistant": Turn("[ANS] ", "</s>", True),
        }
    )
    other: Turn = Turn("[ROLE ", " [/ROLE]", False)
    other_name_end: str = "] "
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[/ROLE]", "[ROLE ")
    start: str = "start"
    # state -> role -> next state; roles that aren't named break the order
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "answer"},
            "asked": {"user": "answer"},
            "answer": {"assistant": "asked"},
        }
    )
    final: tuple[str, ...] = ("asked",)


def _pattern(strings: tuple[str, ...]) -> str:
    return "|".join(re.escape(s[0]) + "(?=" + re.escape(s[1:]) + ")" for s in strings)


def escaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_pattern(t.control)})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, t: Template, what: str) -> Column:
    out = F
    for name, turn in t.turns.items():
        out = out.when(role == name, F.lit(getattr(turn, what)))
    return out


def segments(turns: Column, t: Template) -> Column:
    """Turns, an array of (role, text), as an array of (text, loss)."""

    def of(x: Column) -> Column:
        role, name = x["role"], F.coalesce(x["role"], F.lit(""))
        opened = _by_role(role, t, "open").otherwise(F.concat(F.lit(t.other.open), F.replace(escaped(name, t), F.lit("]"), F.lit("\\]")), F.lit(t.other_name_end)))
        mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escaped(F.coalesce(x["text"], F.lit("")), t).alias("text"), _by_role(role, t, "loss").otherwise(F.lit(t.other.loss)).alias("loss"))
        return F.array(mark(opened), body, mark(_by_role(role, t, "close").otherwise(F.lit(t.other.close))))

    return F.flatten(F.transform(turns, of))


def valid(turns: Column, t: Template) -> Column:
    """Whether the machine accepts the sequence of roles."""
    moves = F.create_map(*(F.lit(x) for s, to in t.moves.items() for r, n in to.items() for x in (f"{s} {r}", n)))
    last = F.aggregate(turns, F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(" "), F.coalesce(x["role"], F.lit("")))), F.lit("broken")))
    return last.isin(*t.final)


def read_back(formatted: Column, t: Template) -> Column:
    """The turns (role, text) that a training string holds, from the string alone; an unnamed role reads as ''."""
    closing = [(name, turn.open, turn.close) for name, turn in t.turns.items()]
    # No control string is left inside a text, so the nearest closing mark ends a turn.
    whole = "|".join([re.escape(o) + ".*?" + re.escape(c) for _, o, c in closing] + [re.escape(t.other.open) + ".*?" + re.escape(t.other.close)])
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{whole})"), F.lit(0))

    def of(x: Column) -> Column:
        role, body = F, F
        for name, o, c in closing:
            role = role.when(x.startswith(o), F.lit(name))
            body = body.when(x.startswith(o), F.substr(x, F.lit(len(o) + 1), F.length(x) - len(o) - len(c)))
        inner = F.substr(x, F.lit(len(t.other.open) + 1), F.length(x) - len(t.other.open) - len(t.other.close))
        named = F.regexp_extract(inner, r"(?s)^([^\]\\]*+(?:\\.[^\]\\]*+)*+)" + re.escape(t.other_name_end), 1)
        return F.struct(
            role.otherwise(unescaped(named)).alias("role"),
            unescaped(body.otherwise(F.substr(inner, F.length(named) + len(t.other_name_end) + 1))).alias("text"),
        )

    return F.transform(found, of)


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: (conv_id, turns, segments, formatted, valid).

    Turns are ordered by (turn, role, text), nulls first, so repeated turn numbers have a fixed order; a null text is empty; a null
    conv_id is a conversation of its own. A conversation is one training string and so one row, however long. No turn is
    dropped. Extra columns are ignored.
    """
    t = template or Template()
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    cut = grouped.select("conv_id", "turns", segments(F.col("turns"), t).alias("segments"), valid(F.col("turns"), t).alias("valid"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Figures of the formatted conversations, read back from the training string and the segments' loss flags."""
    t = template or Template()
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    back = formatted.select("conv_id", "valid", read_back(F.col("formatted"), t).alias("back"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def digests_sql(template: Template | None = None) -> str:
    """The same figures in DuckDB SQL, straight from the rows; `valid` by a pattern over the sequence of roles."""
    t = template or Template()
    esc = "replace(text, '\\', '\\\\')"
    for c in t.control:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    size = " ".join(f"when role = '{r}' then {len(x.open) + len(x.close)}" for r, x in t.turns.items())
    name = "replace(coalesce(role, ''), '\\', '\\\\')"
    for c in t.control:
        name = f"replace({name}, '{c}', '{c[0]}\\{c[1:]}')"
    name = f"replace({name}, ']', '\\]')"
    other = len(t.other.open) + len(t.other.close) + len(t.other_name_end)
    learnt = ", ".join(f"'{r}'" for r, x in t.turns.items() if x.loss)
    return f"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (select *, length({esc}) + case {size} else {other} + length({name}) end as chars from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn nulls first, role nulls first, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role in ({learnt})), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role nulls first, text) filter (role in ({learnt})), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars,
  regexp_full_match(string_agg(coalesce(role, ''), ' ' order by turn nulls first, role nulls first, text), 'system|(system )?user assistant( user assistant)*') as valid
from sized group by conv_id"""
