"""Chat formatting: layouts found by schema fingerprints, one template, a loss mask; DataFrame functions only.

A record's nested field paths (``messages[].role``) are listed: from the schema of
a typed table, or from each row's own shape where records are JSON text. A layout
declares the paths that it needs, and its fingerprint is the digest of those. The
paths of a record that a layout names are hashed likewise, and the first layout
of LAYOUTS with an equal fingerprint converts the record, by the turns that it
declares. Other fields don't matter, whatever their names are.

The template writes a turn as ``### role: text</turn>`` and a line end. In role
and text every backslash is doubled and a backslash is put after the first
character of each control string, so no control string is left in them and the
way back is exact. The mask is kept as segments (text, loss): the formatted text
is their concatenation, and the texts of assistants are under the mask.

Defined results: null role and null text are empty. Turns go by number, null
numbers first; equal numbers by role, then text; repeated rows are turns of their
own. Rows with a null conversation are one conversation. A conversation is one row
of the result, as large as its text: that is what the format is. A JSON record
that no layout takes, or that isn't JSON, has a null layout and no turns, and its
formatted text is empty. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>"
CONTROL = (OPEN, SEPARATOR, CLOSE)
END = CLOSE + "\n"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Say:
    """One turn: the role, and the fields whose texts make it, a blank line between them; no turn if none has a text."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array of structs; a text may be a list of parts with a text each."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class Pairs:
    """Two turns for each pair of an array of pairs: the user's, the assistant's."""

    array: str


@dataclass(frozen=True)
class Layout:
    name: str
    needs: tuple[str, ...]
    turns: tuple[Say | Each | Pairs, ...]
    ddl: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return digest(self.needs)


def digest(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


#: Rows of one turn each; they have no declared turns, as a group of rows makes a record.
ROWS = Layout("turn_rows", ("turn", "role", "text"), ())
LAYOUTS = (
    ROWS,
    Layout("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),), "messages array<struct<role: string, content: variant>>"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (Each("conversations", "from", "value"),), "conversations array<struct<`from`: string, value: string>>", {"human": "user", "gpt": ASSISTANT}),
    Layout("instruction", ("instruction", "output"), (Say("system", ("system",)), Pairs("history"), Say("user", ("instruction", "input", "context")), Say(ASSISTANT, ("output",))), "system string, history array<array<string>>, instruction string, input string, context string, output string"),
    Layout("instruction_response", ("instruction", "response"), (Say("system", ("system",)), Say("user", ("instruction", "context")), Say(ASSISTANT, ("response",))), "system string, instruction string, context string, response string"),
    Layout("completion", ("prompt", "completion"), (Say("system", ("system",)), Say("user", ("prompt",)), Say(ASSISTANT, ("completion",))), "system string, prompt string, completion string"),
    Layout("response", ("prompt", "response"), (Say("system", ("system",)), Say("user", ("prompt",)), Say(ASSISTANT, ("response",))), "system string, prompt string, response string"),
    Layout("question", ("question", "answer"), (Say("user", ("context", "question")), Say(ASSISTANT, ("answer",))), "context string, question string, answer string"),
)

TURNS = "array<struct<role: string, text: string>>"


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The nested field paths of a type."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            yield path
            yield from schema_paths(f.dataType, path)
    elif isinstance(kind, T.ArrayType):
        yield f"{at}[]"
        yield from schema_paths(kind.elementType, f"{at}[]")


def row_paths(record: Column) -> Column:
    """The nested field paths of a variant, read from its shape; empty for null."""
    marks = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`[^`]*(?:``[^`]*)*`: |\w+: |OBJECT<|ARRAY<|>)"), F.lit(1))
    zero = F.struct(F.array(F.lit("")).alias("within"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, mark: Column) -> Column:
        path = F.concat(F.element_at(acc["within"], -1), F.replace(F.regexp_replace(mark, "^`|`?: $", ""), F.lit("``"), F.lit("`")))
        items = F.concat(acc["at"], F.lit("[]"))
        inner = F.concat(acc["within"], F.array(F.concat(acc["at"], F.when(acc["at"] == "", "").otherwise("."))))
        return (
            F.when(mark == ">", F.struct(F.slice(acc["within"], 1, F.size(acc["within"]) - 1).alias("within"), acc["at"].alias("at"), acc["out"].alias("out")))
            .when(mark == "OBJECT<", F.struct(inner.alias("within"), acc["at"].alias("at"), acc["out"].alias("out")))
            .when(mark == "ARRAY<", F.struct(F.concat(acc["within"], F.array(items)).alias("within"), items.alias("at"), F.array_append(acc["out"], items).alias("out")))
            .otherwise(F.struct(acc["within"].alias("within"), path.alias("at"), F.array_append(acc["out"], path).alias("out")))
        )

    return F.coalesce(F.aggregate(marks, zero, step, lambda acc: acc["out"]), F.array().cast("array<string>"))


def layout_name(paths: Column) -> Column:
    """The layout of a record with these paths: the first whose fingerprint is that of the paths it names."""
    named = lambda x: F.md5(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, x.needs)))), "\n"))
    return F.coalesce(*[F.when(named(x) == x.fingerprint, x.name) for x in LAYOUTS])


def layout_of(df: DataFrame) -> Layout:
    """The layout of a typed table."""
    have = set(schema_paths(df.schema))
    for x in LAYOUTS:
        if digest([p for p in x.needs if p in have]) == x.fingerprint:
            return x
    raise ValueError(f"no layout has the fields {sorted(have)}")


def _text(value: Column, kind: T.DataType) -> Column:
    """A text of a field: a string, a list of parts joined, or a variant that is one of both."""
    if isinstance(kind, T.VariantType):
        parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(parts, "")).otherwise(F.try_variant_get(value, "$", "string"))
    if isinstance(kind, T.ArrayType):
        part = kind.elementType
        return F.array_join(F.transform(value, lambda p: F.coalesce((p["text"] if isinstance(part, T.StructType) else p).cast("string"), F.lit(""))), "")
    return value.cast("string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _each(rule: Each, inner: dict[str, T.DataType], role):  # noqa: ANN001, ANN202
    return lambda m: _turn(role(m[rule.role]), _text(m[rule.text], inner[rule.text]))


def turns_of(layout: Layout, get, kinds: dict[str, T.DataType]) -> Column:
    """The canonical turns that a layout declares; get gives a field's column, kinds the types of the fields there are."""

    def role(value: Column) -> Column:
        named = F.coalesce(value.cast("string"), F.lit(""))
        for theirs, ours in layout.roles.items():
            named = F.when(value == theirs, ours).otherwise(named)
        return named

    lists = []
    for rule in layout.turns:
        if isinstance(rule, Each):
            if rule.array in kinds:
                inner = {f.name: f.dataType for f in kinds[rule.array].elementType.fields}
                lists.append(F.transform(get(rule.array), _each(rule, inner, role)))
        elif isinstance(rule, Pairs):
            if rule.array in kinds:
                lists.append(F.flatten(F.transform(get(rule.array), lambda p: F.array(_turn(F.lit("user"), F.get(p, F.lit(0))), _turn(F.lit(ASSISTANT), F.get(p, F.lit(1)))))))
        elif own := [f for f in rule.fields if f in kinds]:
            texts = F.filter(F.array(*[_text(get(f), kinds[f]) for f in own]), lambda t: F.coalesce(t != "", F.lit(False)))
            lists.append(F.when(F.size(texts) > 0, F.array(_turn(F.lit(rule.role), F.array_join(texts, "\n\n")))))
    empty = F.array().cast(TURNS)
    return F.concat(*[F.coalesce(x.cast(TURNS), empty) for x in lists]) if lists else empty


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, turns from a typed table of any layout: of rows by turn a row for each conversation, otherwise one for each row."""
    layout = layout_of(df)
    if layout is ROWS:
        turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        listed = F.sort_array(F.collect_list(turn))
        return df.select(F.col(key).alias("conv_id"), "turn", "role", "text").groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return df.select(F.col(key).alias("conv_id"), turns_of(layout, lambda f: F.col(f"`{f}`"), {f.name: f.dataType for f in df.schema.fields}).alias("turns"))


def canonical_json(df: DataFrame, column: str, key: str = "conv_id") -> DataFrame:
    """conv_id, layout, turns of records that are JSON text, each by the layout of its own shape."""
    rows = df.select(F.col(key).alias("conv_id"), F.col(column).alias("json"), layout_name(row_paths(F.try_parse_json(column))).alias("layout"))
    turns = F.array().cast(TURNS)
    for x in LAYOUTS:
        if x is not ROWS:
            kind = T.StructType.fromDDL(x.ddl)
            record = F.from_json("json", x.ddl)
            turns = F.when(F.col("layout") == x.name, turns_of(x, lambda f, r=record: r[f], {f.name: f.dataType for f in kind.fields})).otherwise(turns)
    return rows.select("conv_id", "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: Column) -> Column:
    """The formatted conversation as pieces (text, loss)."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return F.flatten(F.transform(turns, lambda t: F.array(piece(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEPARATOR)), no), piece(escape(t["text"]), t["role"] == ASSISTANT), piece(F.lit(END), no))))


def template(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments from (conv_id, turns)."""
    pieces = turns.select("conv_id", segments(F.col("turns")).alias("segments"))
    return pieces.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def formatted(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, formatted, segments of all conversations of a typed table."""
    return template(canonical(df, key))


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, END)

    def turn(p: Column) -> Column:
        cut = F.split(p, SEPARATOR, 2)
        return F.struct(unescape(F.substr(cut[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(cut[1]).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_back(out: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what formatted() gives."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = out.select("conv_id", parsed(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escape(x: str, controls: tuple[str, ...] = CONTROL) -> str:
    out = rf"replace({x}, '\', '\\')"
    for c in controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
 sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(OPEN + SEPARATOR + END)})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
