"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles says whether the turns come in a valid order.  Each
turn gives three segments, its opening mark, its escaped text and its closing mark, of which
only texts of loss-bearing roles carry the loss flag; the formatted text is their
concatenation.  Escaping breaks every control string inside a text after its first character,
so the marks can be found by plain search and the text be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK, BACKSLASH = "\\z", "\\e"


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, marks for any other role (its name before `named`), and the allowed turn order."""

    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", True)})
    other: Role = Role("[ROLE]", "[/ROLE]")
    named: str = "[AS]"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: frozenset[str] = frozenset({"answered"})

    @property
    def control(self) -> list[str]:
        return [m for r in (*self.roles.values(), self.other) for m in (r.open, r.close)] + [self.named]


DEFAULT = Template()


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    for mark in template.control:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + BREAK + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(BREAK), F.lit("")), F.lit(BACKSLASH), F.lit("\\"))


def _by_role(template: Template, role: Column, of, other: Column) -> Column:
    out = other
    for name, r in template.roles.items():
        out = F.when(role == name, of(r)).otherwise(out)
    return out


def format_chats(turns: DataFrame, template: Template = DEFAULT, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, valid_order, segments (text, loss), formatted.

    Turns come by number, ties by role and text; a null number comes first.  Null roles and texts
    are empty strings; a null key is a conversation; an invalid order is flagged and formatted all
    the same; repeated rows are turns; an empty table gives no rows; other columns aren't read.
    A conversation is one row in the end, so its text must fit in one; rows meet nowhere else.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = turns.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(row)).alias("__turns"))
    moves = F.create_map(*(F.lit(x) for (state, said), to in template.moves.items() for x in (f"{state}|{said}", to)))
    state = F.aggregate("__turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("|"), t["role"])), F.lit("error")))
    plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))

    def segments(t: Column) -> Column:
        opening = _by_role(template, t["role"], lambda r: F.lit(r.open), F.concat(F.lit(template.other.open), escape(t["role"], template), F.lit(template.named)))
        closing = _by_role(template, t["role"], lambda r: F.lit(r.close), F.lit(template.other.close))
        loss = _by_role(template, t["role"], lambda r: F.lit(r.loss), F.lit(template.other.loss))
        return F.array(plain(opening), F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")), plain(closing))

    out = told.select(F.col(key), state.isin(*template.final).alias("valid_order"), F.flatten(F.transform("__turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """Roles and texts read back from a formatted conversation: array of (role, text)."""
    closers = [r.close for r in (*template.roles.values(), template.other)]
    pattern = "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in closers)
    parts = F.split(formatted, pattern, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def read(p: Column) -> Column:
        rest = p.substr(F.lit(len(template.other.open) + 1), F.length(p))
        at = F.instr(rest, template.named)
        out = F.struct(unescape(rest.substr(F.lit(1), at - 1)).alias("role"), unescape(rest.substr(at + len(template.named), F.length(rest))).alias("text"))
        for name, r in template.roles.items():
            own = F.struct(F.lit(name).alias("role"), unescape(p.substr(F.lit(len(r.open) + 1), F.length(p))).alias("text"))
            out = F.when(p.startswith(r.open), own).otherwise(out)
        return out

    return F.transform(parts, read)


def digest(chats: DataFrame, template: Template = DEFAULT, key: str = "conv_id") -> DataFrame:
    """Sizes and hashes read back from formatted conversations."""
    read = chats.select(key, "valid_order", "formatted", parse(F.col("formatted"), template).alias("__turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("__loss"))
    return read.select(
        key,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


def oracle(template: Template = DEFAULT) -> str:
    """The digest in SQL over the table conversations and the added conversation."""
    escaped = "replace(text, '\\', '\\e')"
    for mark in template.control:
        escaped = f"replace({escaped}, '{mark}', '{mark[0]}{BREAK}{mark[1:]}')"
    marks = " ".join(f"WHEN '{name}' THEN {len(r.open) + len(r.close)}" for name, r in template.roles.items())
    other = len(template.other.open) + len(template.other.close) + len(template.named)
    role = escaped.replace("text", "role", 1)
    loss = ", ".join(f"'{name}'" for name, r in template.roles.items() if r.loss)
    steps = " ".join(f"WHEN prev = {state} AND role = '{said}' THEN true" for (state, said) in [(("''" if s == "start" else {"told": "'system'", "asked": "'user'", "answered": "'assistant'"}[s]), r) for s, r in template.moves])
    return f"""
WITH all_turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next FROM all_turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(length({escaped}) + CASE role {marks} ELSE {other} + length({role}) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE {steps} ELSE false END) AND bool_or(next IS NULL AND role = 'assistant') AS valid_order
FROM t GROUP BY conv_id
"""
