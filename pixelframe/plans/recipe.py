"""Recipes: parsing, static checks, canonical text and hash.

An operation's parameters are described by ``OPS``: name -> (kind, default[, test]). Parsing fills defaults in and
refuses unknown keys; ``validate`` runs the tests and the rules that join several parameters.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from ..functions.numeric import aspect_ratio, half_away, hex_color
from ..operators.composite import MODES


@dataclass(frozen=True)
class Place:
    """Where in a recipe something stands: the layer and the operation, if it is about one, and words for it."""

    text: str
    layer: int | None = None
    index: int | None = None
    op: str | None = None

    def under(self, text: str) -> Place:
        return replace(self, text=self.text + text)

    def operation(self, i: int, name: Any) -> Place:
        """The operation at ``i`` of the recipe or, in a layer, of its own."""
        known = name if isinstance(name, str) and name in OPS else None
        text = f"{self.text}{'.ops' if self.text else 'operations'}[{i}]" + (f" ({known})" if known else "")
        return replace(self, text=text, index=i, op=known)


def layer_place(i: int) -> Place:
    return Place(f"layers[{i}]", i)


TOP = Place("")

#: How to go on, by what is wrong.
RECOVERY = {
    "unknown_operation": "Call list_operations for the names of operations.",
    "missing": "Add what is missing; explain_operation lists required fields.",
    "field": "Correct the named field; a recipe has operations and, optionally, layers.",
}


class RecipeError(ValueError):
    """What is wrong with a recipe, of what ``kind`` that is, and where."""

    code = "invalid_recipe"

    def __init__(self, text: str, place: Place | None = None, kind: str = "field"):
        place = place or TOP
        super().__init__(f"{place.text}: {text}" if place.text else text)
        self.kind, self.operation_index, self.op, self.layer_index = kind, place.index, place.op, place.layer

    @property
    def recovery(self) -> str:
        if self.kind == "field" and self.op:
            return f"Correct the parameter; explain_operation({self.op!r}) lists ranges and defaults."
        return RECOVERY[self.kind]

    def details(self) -> dict:
        return {"code": self.code, "message": str(self), "operation_index": self.operation_index, "op": self.op, "layer_index": self.layer_index, "recovery": self.recovery}


REQUIRED, OMITTED = object(), object()


@dataclass(frozen=True)
class Range:
    low: float
    high: float

    def __call__(self, v: float) -> str | None:
        return None if math.isfinite(v) and self.low <= v <= self.high else f"must be within {self.low}..={self.high}, got {v}"


@dataclass(frozen=True)
class Choice:
    values: tuple

    def __call__(self, v: Any) -> str | None:
        return None if v in self.values else f"must be one of {', '.join(map(str, self.values))}, got {v!r}"


def within(low: float, high: float) -> Range:
    return Range(low, high)


def one_of(*values: Any) -> Choice:
    return Choice(values)


def revision(v: str) -> str | None:
    return None if v.startswith("rev_") else f'must start with "rev_", got {v!r}'


def _points(v: list) -> str | None:
    if not 1 <= len(v) <= 32:
        return f"takes 1 to 32 points, not {len(v)}"
    return None if all(a[0] < b[0] for a, b in zip(v, v[1:], strict=False)) else "points must go from left to right"


def _stops(v: list) -> str | None:
    if not 2 <= len(v) <= 8:
        return f"takes 2 to 8 stops, not {len(v)}"
    for s in v:
        if not 0 <= s["position"] <= 1 or not math.isfinite(s["position"]):
            return f"position must be within 0..=1, got {s['position']}"
        if len(s["color"]) not in (4, 5, 7) or hex_color(s["color"]) is None:
            return f"color must be a hex colour of 3, 4 or 6 digits, got {s['color']!r}"
    gaps = [b["position"] - a["position"] for a, b in zip(v, v[1:], strict=False)]
    return None if all(g >= 1e-6 for g in gaps) else "positions must increase by at least 1e-6"


def _color(v: str) -> str | None:
    return None if hex_color(v) else f"must be a hex colour, got {v!r}"


POINTS = ("points", OMITTED, _points)
MASK = ("mask", OMITTED)
BAND = ("band", OMITTED)
RECT = ("rect", OMITTED)

# Fields of nested objects.
STOP_FIELDS = {"position": ("float", REQUIRED), "color": ("str", REQUIRED)}
RECT_FIELDS = {k: ("int", REQUIRED) for k in ("x", "y", "width", "height")}
MASK_FIELDS = {"revision_id": ("str", REQUIRED), "invert": ("bool", False), "feather_px": ("float", 0.0)}
BAND_FIELDS = {k: ("float", 0.0) for k in ("hue", "saturation", "luminance")}
LAYER_FIELDS = {"mask": MASK, "blend_mode": ("enum", "normal"), "opacity": ("float", 1.0)}

# Operations, their parameters' defaults and ranges.
OPS: dict[str, dict[str, tuple]] = {
    "auto_orient": {},
    "rotate": {"angle_degrees": ("float", REQUIRED, within(-360.0, 360.0)), "crop": ("enum", "largest_inscribed_rect", one_of("largest_inscribed_rect", "full"))},
    "crop": {
        "aspect_ratio": ("str", OMITTED, lambda v: None if aspect_ratio(v) else f'must be "W:H" with positive integers, got {v!r}'),
        "rect": RECT,
        "anchor": ("enum", "center", one_of("top_left", "top", "top_right", "left", "center", "right", "bottom_left", "bottom", "bottom_right")),
        "mode": ("enum", "crop", one_of("crop", "pad")),
        "pad_color": ("str", OMITTED, _color),
        "coordinate_space": ("enum", "current", one_of("current", "source")),
    },
    "resize": {
        "width": ("int", OMITTED, within(1, 2**32 - 1)), "height": ("int", OMITTED, within(1, 2**32 - 1)), "fit": ("enum", "cover", one_of("cover", "contain", "fill")),
        "without_enlargement": ("bool", True),
    },
    "adjust": {
        "brightness": ("float", 0.0, within(-1.0, 1.0)), "contrast": ("float", 0.0, within(-1.0, 1.0)), "saturation": ("float", 0.0, within(-1.0, 1.0)),
        "sharpness": ("float", 0.0, within(0.0, 1.0)), "mask": MASK,
    },
    "perspective": {
        "quad": ("quad", OMITTED), "vertical_degrees": ("float", OMITTED, within(-45.0, 45.0)), "horizontal_degrees": ("float", OMITTED, within(-45.0, 45.0)),
        "pad_color": ("str", OMITTED, _color),
    },
    "color_matrix": {"matrix": ("floats", REQUIRED, lambda v: None if len(v) == 20 and all(abs(x) <= 8 for x in v) else "must be 20 numbers within -8..=8"), "mask": MASK},
    "curves": {"master": POINTS, "red": POINTS, "green": POINTS, "blue": POINTS, "mask": MASK},
    "levels": {
        "in_black": ("int", 0, within(0, 255)), "in_white": ("int", 255, within(0, 255)), "gamma": ("float", 1.0, within(0.1, 10.0)),
        "out_black": ("int", 0, within(0, 255)), "out_white": ("int", 255, within(0, 255)), "mask": MASK,
    },
    "blur": {"sigma": ("float", REQUIRED, within(0.1, 100.0)), "mask": MASK},
    "median": {"radius": ("int", REQUIRED, within(1, 16)), "mask": MASK},
    "unsharp_mask": {
        "amount": ("float", REQUIRED, within(0.0, 4.0)), "radius": ("float", REQUIRED, within(0.1, 50.0)), "threshold": ("int", 0, within(0, 255)), "mask": MASK,
    },
    "lut": {"lut_revision_id": ("str", REQUIRED, revision), "strength": ("float", 1.0, within(0.0, 1.0)), "mask": MASK},
    "white_balance": {"temperature": ("float", 0.0, within(-100.0, 100.0)), "tint": ("float", 0.0, within(-100.0, 100.0)), "mask": MASK},
    "hsl": {"red": BAND, "orange": BAND, "yellow": BAND, "green": BAND, "aqua": BAND, "blue": BAND, "purple": BAND, "magenta": BAND, "mask": MASK},
    "convolve": {
        "kernel": ("floats", REQUIRED, lambda v: None if all(abs(x) <= 256 for x in v) else "values must be within -256..=256"), "size": ("int", REQUIRED, one_of(3, 5, 7, 9)),
        "divisor": ("float", 1.0, lambda v: None if math.isfinite(v) and abs(v) >= 1e-6 else f"must be at least 1e-6 in size, got {v}"), "offset": ("float", 0.0, within(-255.0, 255.0)), "mask": MASK,
    },
    "clone": {**{k: ("int", REQUIRED, within(0, 2**32 - 1)) for k in ("src_x", "src_y", "dest_x", "dest_y")}, "radius": ("int", REQUIRED, within(1, 2048)), "feather_px": ("float", 0.0, within(0.0, 200.0))},
    "heal": {**{k: ("int", REQUIRED, within(0, 2**32 - 1)) for k in ("src_x", "src_y", "dest_x", "dest_y")}, "radius": ("int", REQUIRED, within(1, 2048)), "feather_px": ("float", 0.0, within(0.0, 200.0))},
    "svg_overlay": {
        "svg_revision_id": ("str", REQUIRED, revision), "x": ("int", REQUIRED, within(-1e8, 1e8)), "y": ("int", REQUIRED, within(-1e8, 1e8)), "width": ("int", OMITTED, within(1, 32768)),
        "height": ("int", OMITTED, within(1, 32768)), "opacity": ("float", 1.0, within(0.0, 1.0)), "blend_mode": ("enum", "normal", one_of(*MODES)),
    },
    "flip": {"direction": ("enum", REQUIRED, one_of("horizontal", "vertical"))},
    "vignette": {"strength": ("float", REQUIRED, within(-1.0, 1.0)), "radius": ("float", 0.7, within(0.0, 1.5)), "feather": ("float", 0.5, within(0.0, 1.0))},
    "grain": {"amount": ("float", REQUIRED, within(0.0, 1.0)), "size": ("int", 1, within(1, 4)), "monochrome": ("bool", True), "seed": ("int", 0, within(0, 2**64 - 1)), "mask": MASK},
    "gradient_map": {"stops": ("stops", REQUIRED, _stops), "mask": MASK},
    "pixelate": {"block_size": ("int", REQUIRED, within(2, 256)), "region": RECT},
    "auto_levels": {"clip_percent": ("float", 0.5, within(0.0, 10.0)), "per_channel": ("bool", False), "mask": MASK},
    "encode": {
        "format": ("enum", REQUIRED, one_of("jpeg", "png", "webp", "avif")), "quality": ("int", OMITTED, within(1, 100)), "bit_depth": ("int", OMITTED, one_of(8, 16)),
    },
    "strip_metadata": {"scope": ("enum", "all", one_of("all", "gps", "exif"))},
}
MASKED = frozenset(name for name, params in OPS.items() if "mask" in params)
#: A default that stays out of the canonical text.
SILENT = {("crop", "coordinate_space"): "current"}


def _number(v: Any, where: Place) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise RecipeError(f"expected a number, got {v!r}", where)
    return float(v)


def _integer(v: Any, where: Place) -> int:
    if isinstance(v, bool) or not isinstance(v, int):
        raise RecipeError(f"expected an integer, got {v!r}", where)
    return v


def _keys(v: Any, where: Place, fields: dict[str, tuple]) -> dict:
    """A mapping with these fields only: name -> (kind, default)."""
    if not isinstance(v, dict):
        raise RecipeError(f"expected an object, got {v!r}", where)
    if extra := set(v) - set(fields):
        raise RecipeError(f"unknown field {sorted(extra)[0]!r}", where)
    out = {}
    for name, (kind, default, *_) in fields.items():
        if v.get(name) is None:
            if default is REQUIRED:
                raise RecipeError(f"missing field {name!r}", where, "missing")
            if default is not OMITTED:
                out[name] = default
        else:
            out[name] = _value(v[name], kind, where.under(f".{name}"))
    return out


def _list(v: Any, where: Place) -> list:
    if not isinstance(v, list):
        raise RecipeError(f"expected a list, got {v!r}", where)
    return v


def _value(v: Any, kind: str, where: Place) -> Any:
    if kind == "float":
        return _number(v, where)
    if kind == "int":
        return _integer(v, where)
    if kind in ("str", "enum"):
        if not isinstance(v, str):
            raise RecipeError(f"expected a string, got {v!r}", where)
        return v
    if kind == "bool":
        if not isinstance(v, bool):
            raise RecipeError(f"expected true or false, got {v!r}", where)
        return v
    if kind == "floats":
        return [_number(x, where) for x in _list(v, where)]
    if kind == "quad":
        quad = [[_number(x, where) for x in _list(p, where)] for p in _list(v, where)]
        if len(quad) != 4 or any(len(p) != 2 for p in quad):
            raise RecipeError("expected four points", where)
        return quad
    if kind == "points":
        points = [[_integer(x, where) for x in _list(p, where)] for p in _list(v, where)]
        if any(len(p) != 2 or not all(0 <= x <= 255 for x in p) for p in points):
            raise RecipeError("expected pairs of code values", where)
        return points
    if kind == "stops":
        return [_keys(s, where, STOP_FIELDS) for s in _list(v, where)]
    if kind == "rect":
        return _keys(v, where, RECT_FIELDS)
    if kind == "mask":
        return _keys(v, where, MASK_FIELDS)
    return _keys(v, where, BAND_FIELDS)  # a band of hsl


def _name(v: Any) -> Any:
    return v.get("op") if isinstance(v, dict) else None


def _operation(v: Any, where: Place) -> dict:
    if not isinstance(v, dict) or v.get("op") not in OPS:
        raise RecipeError(f"unknown operation {v.get('op') if isinstance(v, dict) else v!r}", where, "unknown_operation")
    body = {k: x for k, x in v.items() if k != "op"}
    return {"op": v["op"], **_keys(body, where, OPS[v["op"]])}


def parse(recipe: dict | str) -> dict:
    """A recipe with all defaults written out."""
    if isinstance(recipe, str):
        recipe = json.loads(recipe)
    if not isinstance(recipe, dict) or not isinstance(recipe.get("operations"), list):
        raise RecipeError("a recipe is an object with a list of operations", kind="missing")
    if extra := set(recipe) - {"operations", "layers"}:
        raise RecipeError(f"a recipe has no field {sorted(extra)[0]!r}")
    out: dict[str, Any] = {"operations": [_operation(o, TOP.operation(i, _name(o))) for i, o in enumerate(recipe["operations"])]}
    if recipe.get("layers") is not None:
        out["layers"] = []
        for i, layer in enumerate(_list(recipe["layers"], "layers")):
            where = layer_place(i)
            body = dict(layer) if isinstance(layer, dict) else {}
            source, ops = body.pop("source", None), body.pop("ops", [])
            if not (source == "base" or isinstance(source, dict) and set(source) == {"revision_id"} and isinstance(source["revision_id"], str)):
                raise RecipeError("expected \"base\" or a revision_id", where.under(" (source)"))
            rest = _keys(body, where, LAYER_FIELDS)
            out["layers"].append({"source": source, "ops": [_operation(o, where.operation(j, _name(o))) for j, o in enumerate(_list(ops, where))], **rest})
    return out


def _check_mask(mask: dict, where: Place) -> None:
    if problem := revision(mask["revision_id"]) or within(0.0, 200.0)(mask["feather_px"]):
        raise RecipeError(f"mask {problem}", where)


def _convex(quad: list) -> bool:
    turns = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = quad[i], quad[(i + 1) % 4], quad[(i + 2) % 4]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return all(t > 0 for t in turns)


def _joint(op: dict) -> str | None:
    """Rules that join several parameters."""
    name = op["op"]
    if name == "crop":
        if op.get("coordinate_space") == "source" and "rect" not in op:
            return 'coordinate_space "source" is only valid together with rect'
        if ("aspect_ratio" in op) == ("rect" in op):
            return "either aspect_ratio or rect says what to keep"
        if "rect" in op and not (op["rect"]["width"] > 0 and op["rect"]["height"] > 0):
            return "rect needs a width and a height above 0"
    if name == "resize" and "width" not in op and "height" not in op:
        return "width or height is needed"
    if name == "curves" and not any(k in op for k in ("master", "red", "green", "blue")):
        return "one of master, red, green and blue is needed"
    if name == "levels":
        if op["in_black"] >= op["in_white"]:
            return "in_black must lie below in_white"
        if op["out_black"] > op["out_white"]:
            return "out_black must not lie above out_white"
    if name == "hsl":
        bands = {k: v for k, v in op.items() if k not in ("op", "mask")}
        if not bands:
            return "one band is needed"
        if any(abs(x) > 100 or not math.isfinite(x) for b in bands.values() for x in b.values()):
            return "a band's values lie within -100..=100"
    if name == "convolve" and len(op["kernel"]) != op["size"] ** 2:
        return f"a kernel of {op['size']} a side has {op['size'] ** 2} values, not {len(op['kernel'])}"
    if name == "perspective":
        if ("quad" in op) == ("vertical_degrees" in op or "horizontal_degrees" in op):
            return "either quad or degrees say how to turn"
        if "quad" in op and not _convex(op["quad"]):
            return "quad must go clockwise from the top left around a convex shape"
    if name == "pixelate" and "region" in op and not (op["region"]["width"] > 0 and op["region"]["height"] > 0):
        return "region needs a width and a height above 0"
    if name == "encode" and op.get("bit_depth") == 16 and op["format"] != "png":
        return "16 bits go into png files only"
    return None


def _check_operations(ops: list[dict], top: Place = TOP) -> None:
    for i, op in enumerate(ops):
        where = top.operation(i, op["op"])
        if "mask" in op:
            _check_mask(op["mask"], where)
        for name, (_, _, *tests) in OPS[op["op"]].items():
            if name in op:
                for test in tests:
                    if problem := test(op[name]):
                        raise RecipeError(f"{name} {problem}", where)
        if problem := _joint(op):
            raise RecipeError(problem, where)
        if op["op"] == "encode" and i != len(ops) - 1:
            raise RecipeError("nothing may follow encode", where)


def validate(recipe: dict) -> dict:
    """Check a parsed recipe; gives it back."""
    if not recipe["operations"] and recipe.get("layers") is None:
        raise RecipeError("a recipe needs operations or layers", kind="missing")
    _check_operations(recipe["operations"])
    layers = recipe.get("layers")
    if layers is not None and not layers:
        raise RecipeError("the list of layers is empty", kind="missing")
    for i, layer in enumerate(layers or []):
        where = layer_place(i)
        if isinstance(layer["source"], dict) and (problem := revision(layer["source"]["revision_id"])):
            raise RecipeError(f"revision_id {problem}", where.under(" (source)"))
        if problem := within(0.0, 1.0)(layer["opacity"]):
            raise RecipeError(f"opacity {problem}", where)
        if problem := one_of(*MODES)(layer["blend_mode"]):
            raise RecipeError(f"blend_mode {problem}", where)
        if "mask" in layer:
            _check_mask(layer["mask"], where)
        if i == 0 and (layer["blend_mode"] != "normal" or layer["opacity"] != 1.0 or "mask" in layer):
            raise RecipeError("lies at the bottom: it is normal, opaque and without a mask", where)
        for j, op in enumerate(layer["ops"]):
            if op["op"] in ("encode", "strip_metadata"):
                raise RecipeError("belongs to the recipe's own operations", where.operation(j, op["op"]))
        _check_operations(layer["ops"], where)
    return recipe


def _written(v: float) -> str:
    """A float on the 1e-6 grid, with a fraction and without padding in exponents."""
    if math.isfinite(v) and abs(v * 1e6) < 2**53:
        v = half_away(v * 1e6) / 1e6
    text = repr(float(v))
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}e{int(exponent)}" if int(exponent) < 0 else f"{mantissa}e+{int(exponent)}".replace("e+", "e")
    return text


def canonical(v: Any) -> str:
    """Compact JSON with sorted keys."""
    if isinstance(v, dict):
        kept = {k: x for k, x in v.items() if SILENT.get((v.get("op"), k), OMITTED) != x}
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(kept[k])}" for k in sorted(kept)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, float):
        return _written(v)
    return json.dumps(v, ensure_ascii=False)


def recipe_hash(recipe: dict | str) -> str:
    """SHA-256 of the canonical text of a recipe, defaults written out."""
    return hashlib.sha256(canonical(parse(recipe)).encode()).hexdigest()
