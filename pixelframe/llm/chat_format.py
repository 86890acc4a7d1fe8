"""Chat formatting: records of different layouts to turns, turns to one marked text with its loss mask, and back.

Schema fingerprinting: of each row the nested field paths that hold a value (``messages[].role``, ``instruction``) are hashed;
the hash selects a ``Layout``, which states declaratively which fields make which turns. A layout's optional fields give
it several fingerprints. Only paths that some layout knows are hashed, so further fields do not matter. Rows whose
fingerprint no layout has keep it, with a null layout and no turns, so that one can be declared. All of it is column
expressions: no row leaves the JVM before the formatted text is read back.

A ``Template`` marks turns. Control strings inside texts and roles, and the escape character itself, are escaped by
codes that hold no control string, so the output can be cut at its marks and every text comes back exactly. The loss mask
is the places (code points, end exclusive) of assistants' escaped texts, without any mark.

Tables with a row a turn are gathered by ``conversations_of``: each row is formatted before the one shuffle, places follow from a
running sum, and a conversation is the only thing that has to fit into a task (as it must into one value).

Defined results: a null text or role is empty; rows are ordered by turn, then role, then text, null turns first; repeated
rows are turns of their own; rows without conv_id are conversations of one row each; empty texts make turns without loss
characters; texts of any length are kept whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches, tidy

TURNS = "array<struct<role: string, text: string>>"
ESCAPE = "\\"


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, fields whose texts a line feed joins) each, for records; ``each``: (array, its role, its text) for lists
    of messages, or ("", role, text) for a row that is one turn. ``optional`` fields may be missing. ``roles`` renames."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> set[str]:
        if self.each:
            top = f"{self.each[0]}[]." if self.each[0] else ""
            return {top + self.each[1], top + self.each[2]}
        return {p for _, ps in self.turns for p in ps}

    @property
    def fingerprints(self) -> list[str]:
        must = self.paths - set(self.optional)
        free = sorted(self.paths & set(self.optional))
        return [fingerprint_of(must | set(c)) for n in range(len(free) + 1) for c in combinations(free, n)]


LAYOUTS = (
    Layout("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question", (("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("messages", each=("messages", "role", "content"), optional=("messages[].content",)),
    Layout("parts", each=("messages", "role", "content[].text")),
    Layout("shared", each=("conversations", "from", "value"), optional=("conversations[].value",), roles={"human": "user", "gpt": "assistant"}),
    Layout("rows", each=("", "role", "text"), optional=("role", "text")),
)


def fingerprint_of(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, top: str = "") -> list[str]:
    """The nested field paths of a schema, ``[]`` after arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{top}.{f.name}" if top else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{top}[]")
    return [top]


def _steps(path: str) -> list[tuple[str, bool]]:
    """(field, whether its elements are gone through) down a path."""
    return [(s.removesuffix("[]"), s.endswith("[]")) for s in path.split(".")]


def _held(at: Column | None, steps: list[tuple[str, bool]]) -> Column:
    """Whether anything stands at a path."""
    (name, many), rest = steps[0], steps[1:]
    c = F.col(f"`{name}`") if at is None else at[name]
    if many:
        return F.coalesce(F.exists(c, lambda e: _held(e, rest) if rest else e.isNotNull()), F.lit(False))
    return _held(c, rest) if rest else c.isNotNull()


def _text(at: Column | None, steps: list[tuple[str, bool]]) -> Column:
    """The text at a path; texts of elements follow one another."""
    (name, many), rest = steps[0], steps[1:]
    c = F.col(f"`{name}`") if at is None else at[name]
    if many:
        return F.array_join(F.transform(c, lambda e: _text(e, rest) if rest else e.cast("string")), "")
    return _text(c, rest) if rest else c.cast("string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, has: set[str]) -> Column:
    """The turns of a layout as an expression over a table with the paths ``has``."""

    def named(role: Column) -> Column:
        out = role
        for old, new in layout.roles.items():
            out = F.when(role == old, new).otherwise(out)
        return out

    if layout.each:
        array, role, text = layout.each
        top = f"{array}[]." if array else ""
        get = lambda at, p: _text(at, _steps(p)) if top + p in has else F.lit(None).cast("string")
        if array:
            return F.transform(F.col(f"`{array}`"), lambda e: _turn(named(get(e, role)), get(e, text)))
        return F.array(_turn(named(get(None, role)), get(None, text)))
    out = []
    for role, paths in layout.turns:
        found = [p for p in paths if p in has]
        if found:
            text = F.concat_ws("\n", *[F.when(_text(None, _steps(p)) != "", _text(None, _steps(p))) for p in found])
            there = _held(None, _steps(found[0]))
            for p in found[1:]:
                there = there | _held(None, _steps(p))
            out.append(F.when(there, _turn(F.lit(role), text)))
    return F.array_compact(F.array(*out))


def chat_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``fingerprint`` (of the paths that hold a value), ``layout`` (null: none has it) and ``turns``."""
    clash = {c for c in records.columns if c.lower() in ("fingerprint", "layout", "turns")}
    known = sorted(set(field_paths(records.schema)) & {p for x in layouts for p in x.paths})
    shown = F.array_join(F.array_compact(F.array(*[F.when(_held(None, _steps(p)), F.lit(p)) for p in known])), "\n") if known else F.lit("")
    rows = records.drop(*(clash - set(known))).select("*", F.sha2(shown.cast("binary"), 256).alias("fingerprint"))
    name, turns, seen = F.lit(None).cast("string"), F.lit(None).cast(TURNS), set()
    for x in layouts:
        prints = [p for p in x.fingerprints if p not in seen]
        seen.update(prints)
        if x.paths - set(x.optional) <= set(known) and prints:
            fits = F.col("fingerprint").isin(prints)
            name, turns = F.when(fits, x.name).otherwise(name), F.when(fits, _turns(x, set(known))).otherwise(turns)
    return rows.select("*", name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def parsed(lines: DataFrame, name: str) -> DataFrame:
    """Columns of the JSON records in column ``name``: one merged schema, which the records themselves tell in one pass.

    What is no JSON object has null fields; a field whose kind differs between records is read as its JSON text.
    """
    told = lines.select(F.schema_of_variant_agg(F.try_parse_json(F.col(name)))).first()[0]
    if not told.startswith("OBJECT<"):
        return lines
    kind = re.sub(r"`[^`]*`|\bOBJECT<|\bVOID\b|\bVARIANT\b", lambda m: {"OBJECT<": "STRUCT<", "VOID": "STRING", "VARIANT": "STRING"}.get(m[0], m[0]), told)
    return lines.withColumn("_record", F.from_json(name, kind)).select(*[c for c in lines.columns if c != name], "_record.*")


@dataclass(frozen=True)
class Template:
    """What stands before a role, between role and text, and after a text."""

    begin: str = "<turn>"
    between: str = "\n"
    end: str = "</turn>"

    def __post_init__(self) -> None:
        marks = (self.begin, self.end)
        if self.begin == self.end or ESCAPE in "".join((*marks, self.between)) or not self.between or self.between[0] in self.between[1:]:
            raise ValueError("marks must differ and hold no escape character")
        if any(not m or any(x[:1] in m[1:] for x in marks) for m in marks):
            raise ValueError("no mark may begin with a character that one holds further on")

    @property
    def codes(self) -> dict[str, str]:
        """Control strings and the codes that stand for them; the escape character comes first."""
        return {ESCAPE: ESCAPE * 2, self.begin: f"{ESCAPE}b", self.end: f"{ESCAPE}e"}

    def escaped(self, text: Column, role: bool = False) -> Column:
        for mark, code in (self.codes | ({self.between: f"{ESCAPE}r"} if role else {})).items():
            text = F.replace(text, F.lit(mark), F.lit(code))
        return text

    def unescaped(self, text: str) -> str:
        marks = {c[1:]: m for m, c in self.codes.items()} | {"r": self.between}
        return re.sub(r"\\(.)", lambda m: marks[m[1]], text) if ESCAPE in text else text

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns (role, text) of a formatted text."""
        out = []
        for piece in formatted.split(self.end)[:-1]:
            role, _, text = piece.removeprefix(self.begin).partition(self.between)
            out.append((self.unescaped(role), self.unescaped(text)))
        return out


def _piece(turn: Column, template: Template) -> tuple[Column, Column, Column]:
    """A turn's head, escaped text and whole."""
    head = F.concat(F.lit(template.begin), template.escaped(turn["role"], True), F.lit(template.between))
    text = template.escaped(turn["text"])
    return head, text, F.concat(head, text, F.lit(template.end))


def conversations_of(rows: DataFrame, key: str = "conv_id", order: str = "turn", template: Template | None = None, layouts: tuple[Layout, ...] = LAYOUTS, loss_role: str = "assistant") -> DataFrame:
    """``key``, formatted and loss: array of (start, end) for each conversation, from a table with a row a turn or a record.

    Several rows of one ``key`` are one conversation, by ``order``; a record's turns stay together, in their order. ``order`` may be missing.
    """
    template = template or Template()
    place = F.col(f"`{order}`").cast("long") if order in rows.columns else F.lit(None).cast("long")
    kept = rows.withColumns({"_key": F.col(f"`{key}`"), "_place": place}) if {"_key", "_place"}.isdisjoint(rows.columns) else rows.select(F.col(f"`{key}`").alias("_key"), place.alias("_place"), *[c for c in rows.columns if c not in ("_key", "_place")])
    turns = chat_turns(kept, layouts).select("_key", "_place", F.when(F.col("_key").isNull(), F.monotonically_increasing_id()).alias("_own"), F.posexplode("turns").alias("_at", "_turn"))
    _, _, whole = _piece(F.col("_turn"), template)
    sized = turns.select("_key", "_own", "_place", "_at", "_turn", F.length(whole).cast("long").alias("_size"))
    before = Window.partitionBy("_key", "_own").orderBy("_place", "_at", "_turn.role", "_turn.text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_start", F.sum("_size").over(before) - F.col("_size"))
    head, text, whole = _piece(F.col("_turn"), template)
    first = F.col("_start") + F.length(head)
    placed = placed.select(
        "_key", "_own", "_start", whole.alias("_whole"),
        F.when(F.col("_turn.role") == loss_role, F.struct(first.alias("start"), (first + F.length(text)).alias("end"))).alias("_loss"),
    )
    found = placed.groupBy("_key", "_own").agg(F.sort_array(F.collect_list(F.struct("_start", "_whole"))).alias("_pieces"), F.sort_array(F.collect_list("_loss")).alias("loss"))
    return found.select(F.col("_key").alias(key), F.array_join(F.transform("_pieces", lambda p: p["_whole"]), "").alias("formatted"), "loss")


def read_back(chats: DataFrame, key: str = "conv_id", template: Template | None = None) -> DataFrame:
    """``chats`` with ``turns`` and ``loss_text`` (all text under the mask), read from formatted texts and masks alone."""
    template = template or Template()
    LIST = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            texts, masks = column(b, "formatted"), column(b, "loss")
            turns = [[{"role": r, "text": t} for r, t in template.read(x)] for x in texts]
            under = ["".join(template.unescaped(x[s["start"] : s["end"]]) for s in m) for x, m in zip(texts, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("formatted"), pa.array(turns, LIST), pa.array(under, pa.string())], ["key", "formatted", "turns", "loss_text"])

    small_batches(chats.sparkSession)
    kind = chats.schema[key].dataType.simpleString()
    out = chats.select(F.col(f"`{key}`").alias("key"), "formatted", "loss").mapInArrow(tidy(run), f"key {kind}, formatted string, turns {TURNS}, loss_text string")
    return out.withColumnRenamed("key", key)
