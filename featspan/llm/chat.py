"""Chat formatting with DataFrame functions only.

A record is JSON text in whatever layout its source uses. The sorted list of its nested field
paths is hashed, and the hash selects a declarative mapping to canonical turns (role, text). Paths
are those of a skeleton without the texts, so texts may be of any length; fields that no layout
names are left aside. A text may come in parts, whose texts are joined. Turns are rendered by a template whose control strings are escaped inside texts and roles, so that the
output can be read back exactly, with a mask of the code points a model is to learn from.

Null roles and texts are empty, turns of equal number are ordered by role and text, repeated rows
stay, unknown layouts and broken JSON give null turns (and nothing after them), a conversation
without turns gives an empty output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featspan.llm.arrays import cut, let, pieces_of, running

TURNS = "array<struct<role:string,text:string>>"
OPEN, SHUT = "<|im_start|>", "<|im_end|>"
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How one record layout becomes turns.

    ``paths`` are its field paths (list elements as ``key[].field``). Either ``turns`` names the
    list and its role and text fields, or ``fields`` gives (role, field paths to join) per turn.
    """

    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout(("messages", "messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout(("conversations", "conversations[].from", "conversations[].value"), ("conversations", "from", "value"), roles=ROLE_NAMES),
    Layout(("turns", "turns[].speaker", "turns[].text"), ("turns", "speaker", "text"), roles=ROLE_NAMES),
    Layout(("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout(("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout(("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout(
        ("input", "instruction", "output", "system"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
)


#: Fields of the parts of a text that comes in parts.
_PART = ("type", "text")
#: Spark's JSON reader ends strings at 20 million characters unless told otherwise.
_NO_LIMIT = {"maxStringLen": str(2**31 - 1)}


#: A JSON string; possessive, so that long ones need no stack.
_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_STRING = f'"{_BODY}"'


def _list_keys(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({x.turns[0] for x in layouts if x.turns})


def _known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def _under(key: str) -> Callable[[Column], Column]:
    return lambda name: F.concat(F.lit(f"{key}[]."), name)


def skeleton(raw: Column) -> Column:
    """The record with all string values empty: its layout, however long its texts are."""
    return F.regexp_replace(raw, rf'(?=")({_STRING}\s*+:\s*+)?+(?:("){_BODY}("))?+', "$1$2$3")


def _elements(bones: Column, key: str) -> Column:
    """The elements of a list of a skeleton, as JSON; none if it is no list."""
    return F.coalesce(F.from_json(F.get_json_object(bones, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))


def _paths(bones: Column, layouts: tuple[Layout, ...]) -> Column:
    """The field paths that some layout names; fields of a list are those of any of its elements."""
    none = F.array().cast("array<string>")
    nested = [
        F.transform(F.flatten(F.transform(_elements(bones, k), lambda e: F.coalesce(F.json_object_keys(e), none))), _under(k)) for k in _list_keys(layouts)
    ]
    known = F.array(*[F.lit(p) for p in _known_paths(layouts)])
    return F.array_sort(F.array_intersect(F.concat(F.json_object_keys(bones), *nested), known))


def fingerprint(raw: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the sorted field paths of a JSON object, as far as some layout names them; null if it is none."""
    return F.xxhash64(F.array_join(_paths(skeleton(raw), layouts), ",")) * F.when(F.json_object_keys(skeleton(raw)).isNotNull(), 1)


def _is_list(name: str) -> Callable[[Column], Column]:
    return lambda e: F.startswith(F.get_json_object(e, f"$.{name}"), F.lit("["))


def _renamed(role: str, text: str) -> Callable[[Column], Column]:
    return lambda t: F.struct(t["role"].alias(role), t["content"].alias(text))


def _turn_maker(role: str, text: str, roles: dict[str, str], parts: Column) -> Callable[[Column, Column], Column]:
    named = F.create_map(*[F.lit(s) for kv in roles.items() for s in kv]) if roles else None

    def turn(m: Column, i: Column) -> Column:
        said = F.coalesce(m[role], F.lit(""))
        said = F.coalesce(named[said], said) if named is not None else said
        # a list in the place of the text is a text in parts; those without text, such as pictures, say nothing
        pieces = F.from_json(m[text], f"array<struct<{','.join(f'{p}:string' for p in _PART)}>>", _NO_LIMIT)
        joined = F.array_join(F.transform(pieces, lambda p: F.coalesce(p["text"], F.lit(""))), "")
        whole = F.when(F.coalesce(F.get(parts, i), F.lit(False)), joined).otherwise(m[text])
        return F.struct(said.alias("role"), F.coalesce(whole, F.lit("")).alias("text"))

    return turn


def turns(raw: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Canonical turns of a JSON record by the mapping its fingerprint selects; null if there is none.

    A record with further fields that several layouts know has the paths of no single one; then
    the layout with the most paths of those it has whole is taken. A list without elements has no fields.
    """
    flat = sorted({p for x in layouts for _, own in x.fields for p in own})
    lists: dict[str, set[str]] = {}
    for x in layouts:
        if x.turns:
            lists.setdefault(x.turns[0], set()).update(x.turns[1:])
    schema = ", ".join(
        [f"`{p}` string" for p in flat]
        + [f"`{k}` array<struct<{','.join(f'`{f}`:string' for f in sorted(v))}>>" for k, v in sorted(lists.items())]
    )
    bones, record = skeleton(raw), F.from_json(raw, schema, _NO_LIMIT)
    paths = _paths(bones, layouts)
    seen = F.xxhash64(F.array_join(paths, ","))
    exact, whole = F.lit(None).cast(TURNS), F.lit(None).cast(TURNS)
    for x in sorted(layouts, key=lambda x: len(x.paths)):
        if x.turns:
            key, role, text = x.turns
            in_parts = F.transform(_elements(bones, key), _is_list(text))
            made = F.coalesce(F.transform(record[key], _turn_maker(role, text, x.roles, in_parts)), F.array().cast(TURNS))
            empty = F.array_contains(paths, key) & (F.size(_elements(bones, key)) == 0)
        else:
            made = F.array(
                *[
                    F.struct(
                        F.lit(role).alias("role"),
                        F.array_join(F.filter(F.array(*[record[p] for p in own]), lambda s: s != ""), "\n\n").alias("text"),
                    )
                    for role, own in x.fields
                ]
            )
            empty = F.lit(False)
        own = F.array(*[F.lit(p) for p in x.paths])
        exact = F.when(seen == F.xxhash64(F.lit(",".join(sorted(x.paths)))), made.cast(TURNS)).otherwise(exact)
        whole = F.when((F.size(F.array_except(own, paths)) == 0) | empty, made.cast(TURNS)).otherwise(whole)
    return F.coalesce(exact, whole)


def escape(text: Column) -> Column:
    """One backslash more between < and |, so that no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(role, F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(role, F.lit("%25"), F.lit("%"))


def render(said: Column) -> Column:
    """Struct of the formatted text and its loss mask, [start, end) code points of assistant texts."""
    parts = F.transform(
        said,
        lambda t: F.struct(
            (t["role"] == "assistant").alias("learn"),
            F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    end = len(SHUT) + 1
    spans = running(
        parts,
        F.lit(0),
        lambda at, p: at + F.length(p["head"]) + F.length(p["body"]) + end,
        lambda at, p: F.when(
            p["learn"], F.struct((at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end"))
        ),
        "bigint",
        "struct<start:bigint,end:bigint>",
    )
    mask = F.filter(spans, lambda m: m.isNotNull())
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(SHUT + "\n"))), "")
    return F.struct(text.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    shown = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda s: s != "")
    return F.transform(
        shown,
        lambda s: F.struct(
            _unescape_role(F.substring_index(F.substring(s, len(OPEN) + 1, 2**31 - 1), "\n", 1)).alias("role"),
            unescape(F.substring(s, F.instr(s, "\n") + 1, F.length(s))).alias("text"),
        ),
    )


def learned(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return let(pieces_of(formatted), lambda pieces: F.array_join(F.transform(mask, lambda m: unescape(cut(pieces, m["start"], m["end"]))), ""))


def format_chats(records: DataFrame, raw: str = "raw", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add layout (the fingerprint), formatted and loss_mask to records, in place of columns of these names; others stay."""
    held = "said"
    while held in records.columns:
        held += "_"
    out = records.withColumns({"layout": fingerprint(F.col(raw), layouts), held: turns(F.col(raw), layouts)})
    out = out.withColumn(held, render(F.col(held)))
    return out.withColumns({"formatted": F.col(held)["formatted"], "loss_mask": F.col(held)["loss_mask"]}).drop(held)


#: Layouts in which ``gather`` writes conversations; roles stay as they are.
GATHERED = (
    Layout(("messages", "messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout(("dialog", "dialog[].author", "dialog[].said"), ("dialog", "author", "said")),
)


def gather(rows: DataFrame, layouts: tuple[Layout, ...] = GATHERED) -> DataFrame:
    """One JSON record per conversation from rows by turn; conversations are dealt to ``layouts`` by their id."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("said"))
    raw = F.lit(None).cast("string")
    for i, x in enumerate(layouts):
        key, role, text = x.turns
        said = F.transform("said", _renamed(role, text))
        mine = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(layouts))) == i
        raw = F.when(mine, F.to_json(F.struct(said.alias(key)))).otherwise(raw)
    return one.select("conv_id", raw.alias("raw"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what a formatted text and its mask give back."""
    back = chats.withColumn("back", read_back(F.col("formatted"))).withColumn("loss", learned(F.col("formatted"), F.col("loss_mask")))
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
