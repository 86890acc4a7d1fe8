"""Canonical texts and hashes of recipes that lie in a column, as expressions: no recipe leaves the JVM.

A JSON text is parsed into a variant. What fields an object has, of what kinds and with what defaults, is a table (``OPS`` and
the nested objects' fields) in one literal, so the expression is as long as there are kinds and not as there are operations: each
object's fields are taken from its table, in order, and written by their kind: floats on the 1e-6 grid, whole numbers, texts, lists and
objects. What ``parse`` refuses (unknown operations and fields, missing or ill-typed ones, other shapes) has no text: the
result is null. Ranges are not looked at, as in ``parse``; ``out_of_range`` tells them. Floats beyond 2^53 millionths belong to no operation and have no text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recipe import BAND_FIELDS, Choice, LAYER_FIELDS, MASK_FIELDS, OMITTED, OPS, Range, RECT_FIELDS, REQUIRED, SILENT, STOP_FIELDS

#: What stands for a value that is none of its kind; no JSON text holds it.
WRONG = "\0"

Writer = Callable[[Column, Column], Column]


def _table() -> Column:
    """Objects' names to their fields: name, kind, text of the default, and whether there must be a value."""

    def fields(of: dict[str, tuple], op: str | None = None, more: tuple[dict, ...] = ()) -> list[dict]:
        out = list(more)
        for name, (kind, default, *_) in of.items():
            silent = (op, name) in SILENT
            kind = f"{kind} but {SILENT[op, name]}" if silent else kind
            out.append({"name": name, "kind": kind, "default": None if silent or default in (REQUIRED, OMITTED) else json.dumps(default), "must": default is REQUIRED})
        return sorted(out, key=lambda f: f["name"])

    text = {"kind": "str", "default": None, "must": True}
    table = {op: fields(of, op, ({"name": "op", **text},)) for op, of in OPS.items()}
    table |= {"a stop": fields(STOP_FIELDS), "a rect": fields(RECT_FIELDS), "a mask": fields(MASK_FIELDS), "a band": fields(BAND_FIELDS)}
    table["a layer"] = fields(LAYER_FIELDS, None, ({"name": "source", "kind": "source", "default": None, "must": True}, {"name": "ops", "kind": "ops", "default": "[]", "must": False}))
    table["a source"] = [{"name": "revision_id", **text}]
    return F.from_json(F.lit(json.dumps(table)), "map<string, array<struct<name: string, kind: string, default: string, must: boolean>>>")


def float_text(v: Column) -> Column:
    """A double as recipes write it."""
    k = F.floor(F.abs(v) * 1e6 + 0.5).cast("long")
    whole, rest = F.floor(k / 1_000_000).cast("long").cast("string"), F.lpad((k % 1_000_000).cast("string"), 6, "0")
    plain = F.concat(whole, F.lit("."), F.substring(rest, 1, 1), F.rtrim(F.substring(rest, 2, 5), F.lit("0")))
    ten, one = F.substring(rest, 5, 1), F.substring(rest, 6, 1)
    small = F.when(k < 10, F.concat(one, F.lit("e-6"))).when(one == "0", F.concat(ten, F.lit("e-5"))).otherwise(F.concat(ten, F.lit("."), one, F.lit("e-5")))
    text = F.when(k == 0, "0.0").when(k < 100, small).otherwise(plain)
    return F.when(F.abs(v) * 1e6 < 2.0**53, F.concat(F.when((v < 0) & (k > 0), "-").otherwise(""), text))


def _is(v: Column, pattern: str) -> Column:
    return F.schema_of_variant(v).rlike(f"^({pattern})")


def _scalar(v: Column, kind: Column) -> Column:
    number = F.when(_is(v, "BIGINT|DECIMAL|DOUBLE"), float_text(F.try_variant_get(v, "$", "double")))
    whole = F.when(_is(v, r"BIGINT|DECIMAL\(\d+,0\)"), F.try_variant_get(v, "$", "string"))
    text = F.when(_is(v, "STRING"), F.regexp_replace(F.to_json(F.array(F.try_variant_get(v, "$", "string"))), r"^\[|\]$", ""))
    known = F.when(kind == "float", number).when(kind == "int", whole).when(kind.isin("str", "enum"), text)
    known = known.when(kind == "code", F.when(F.try_variant_get(v, "$", "bigint").between(0, 255), whole))
    known = known.when(kind.startswith("enum but "), F.when(text != F.concat(F.lit('"'), F.substring_index(kind, " ", -1), F.lit('"')), text).otherwise(F.when(text.isNotNull(), F.lit(""))))
    return known.when(kind == "bool", F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "string")))


def _list(v: Column, each: Callable[[Column], Column], n: int | None = None) -> Column:
    """A list; with ``n``, of so many."""
    items = F.try_variant_get(v, "$", "array<variant>")
    told = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.coalesce(each(x), F.lit(WRONG))), ","), F.lit("]"))
    return F.when(_is(v, "ARRAY") & (F.size(items) == n if n is not None else F.lit(True)), told)


def _object(v: Column, fields: Column, write: Writer) -> Column:
    """An object by its table of fields."""
    has = F.try_variant_get(v, "$", "map<string, variant>")

    def told(f: Column) -> Column:
        at = has[f["name"]]
        value = F.coalesce(write(at, f["kind"]), F.lit(WRONG))
        default = F.when(f["kind"] == "float", float_text(f["default"].cast("double"))).otherwise(f["default"])
        text = F.when(at.isNotNull() & ~F.is_variant_null(at), value).when(f["must"], WRONG).otherwise(default)
        return F.struct(f["name"].alias("name"), text.alias("text"))

    alien = F.exists(F.map_keys(has), lambda k: ~F.exists(fields, lambda f: f["name"] == k))
    parts = F.filter(F.transform(fields, told), lambda p: p["text"] != "")
    written = F.transform(parts, lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["text"]))
    return F.when(_is(v, "OBJECT") & fields.isNotNull() & ~alien, F.concat(F.lit("{"), F.array_join(written, ","), F.lit("}")))


def canonical_column(text: Column) -> Column:
    """The canonical text of recipes given as JSON; null for what is no recipe."""
    table, v = _table(), F.try_parse_json(text)
    each = lambda kind: lambda x: _scalar(x, F.lit(kind))

    def value(v: Column, kind: Column) -> Column:
        told = F.when(kind == "floats", _list(v, each("float"))).when(kind == "quad", _list(v, lambda p: _list(p, each("float"), 2), 4))
        told = told.when(kind == "points", _list(v, lambda p: _list(p, each("code"), 2))).when(kind == "stops", _list(v, lambda s: _object(s, table["a stop"], _scalar)))
        return told.when(kind.isin("rect", "mask", "band"), _object(v, table[F.concat(F.lit("a "), kind)], _scalar)).otherwise(_scalar(v, kind))

    def operation(v: Column) -> Column:
        return _object(v, table[F.try_variant_get(v, "$.op", "string")], value)

    def of_layer(v: Column, kind: Column) -> Column:
        base = F.when(_is(v, "STRING") & (F.try_variant_get(v, "$", "string") == "base"), '"base"')
        source = F.coalesce(base, _object(v, table["a source"], _scalar))
        return F.when(kind == "source", source).when(kind == "ops", _list(v, operation)).when(kind == "mask", _object(v, table["a mask"], _scalar)).otherwise(_scalar(v, kind))

    layers, ops = F.try_variant_get(v, "$.layers", "variant"), F.try_variant_get(v, "$.operations", "variant")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    above = F.when(layers.isNull() | F.is_variant_null(layers), "").otherwise(F.concat(F.lit('"layers":'), F.coalesce(_list(layers, lambda x: _object(x, table["a layer"], of_layer)), F.lit(WRONG)), F.lit(",")))
    whole = F.concat(F.lit("{"), above, F.lit('"operations":'), _list(ops, operation), F.lit("}"))
    told = F.when(_is(v, "OBJECT") & F.forall(keys, lambda k: k.isin("operations", "layers")), whole)
    # once, as the text is long: a list of it, if nothing in it is wrong
    return F.get(F.filter(F.array(told), lambda t: F.instr(t, WRONG) == 0), 0)


def hash_column(text: Column) -> Column:
    """``recipe_hash`` of recipes given as JSON; null for what is no recipe."""
    return F.sha2(canonical_column(text).cast("binary"), 256)


def _limits() -> Column:
    """Operations' names to the fields that have a range or a choice."""

    def limit(name: str, test: Range | Choice) -> dict:
        if isinstance(test, Range):
            return {"name": name, "low": float(test.low), "high": float(test.high), "values": None}
        return {"name": name, "low": None, "high": None, "values": [str(v) for v in test.values]}

    table = {op: [limit(n, t) for n, (_, _, *tests) in params.items() for t in tests if isinstance(t, Range | Choice)] for op, params in OPS.items()}
    return F.from_json(F.lit(json.dumps(table)), "map<string, array<struct<name: string, low: double, high: double, values: array<string>>>>")


_FAULTS = "array<struct<layer: int, index: int, op: string, field: string>>"


def out_of_range(text: Column) -> Column:
    """Of recipes given as JSON a list of (layer, index, op, field): every parameter outside its range or choice, where ``validate`` tells the
    first. Layers are numbered from 0, those of the recipe's own operations are null. Defaults are never outside; values of
    another kind, unknown operations and texts that are no JSON are ``canonical_column``'s affair and tell nothing here."""
    limits, v = _limits(), F.try_parse_json(text)
    nothing = F.array().cast(_FAULTS)

    def wrong(v: Column, limit: Column) -> Column:
        number, word = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string")
        return F.coalesce(F.when(limit["values"].isNull(), ~number.between(limit["low"], limit["high"])).otherwise(~F.array_contains(limit["values"], word)), F.lit(False))

    def told(ops: Column, layer: Column) -> Column:
        def of_one(o: Column, i: Column) -> Column:
            fields, op = F.try_variant_get(o, "$", "map<string, variant>"), F.try_variant_get(o, "$.op", "string")
            bad = F.filter(limits[op], lambda limit: wrong(F.try_element_at(fields, limit["name"]), limit))
            return F.coalesce(F.transform(bad, lambda limit: F.struct(layer.alias("layer"), i.alias("index"), op.alias("op"), limit["name"].alias("field"))), nothing)

        return F.coalesce(F.flatten(F.transform(F.try_variant_get(ops, "$", "array<variant>"), of_one)), nothing)

    layers = F.try_variant_get(F.try_variant_get(v, "$.layers", "variant"), "$", "array<variant>")
    above = F.flatten(F.transform(layers, lambda x, k: told(F.try_variant_get(x, "$.ops", "variant"), k)))
    return F.concat(told(F.try_variant_get(v, "$.operations", "variant"), F.lit(None).cast("int")), F.coalesce(above, nothing))
