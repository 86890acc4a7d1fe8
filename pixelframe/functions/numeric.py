"""Scalar rules that all operators share, as Column expressions, and the tables that are built on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")
TONE_LAST, CONV_LAST = 255, 4095
ALPHA_LEAST = 1e-6


def half_away(v: float) -> float:
    """Round to an integer, halves away from zero."""
    return math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)


def q6(v: float) -> float:
    return half_away(v * 1e6) / 1e6


def q9(v: float) -> float:
    return half_away(v * 1e9) / 1e9


def col_q6(c: Column) -> Column:
    return F.round(c * 1e6) / 1e6


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def to_u8(c: Column) -> Column:
    return F.floor(clamp(c) * 255.0 + 0.5).cast("int")


def to_u16(c: Column) -> Column:
    return F.floor(clamp(c) * 65535.0 + 0.5).cast("int")


def table(values: Sequence[float]) -> Column:
    """An array that the optimizer folds into one literal; as text, so that a plan need not hold thousands of expressions."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def lerp(values: Sequence[float], c: Column) -> Column:
    """Linear interpolation in evenly spaced nodes over 0..1, ends held."""
    last = len(values) - 1
    if last == 0:
        return F.lit(float(values[0]))
    nodes, at = table(values), clamp(c) * float(last)
    low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    a = F.element_at(nodes, low + 1)
    return a + (F.element_at(nodes, low + 2) - a) * (at - low)


def srgb_to_linear_exact(v: float) -> float:
    return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4


def linear_to_srgb_exact(v: float) -> float:
    return v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


@cache
def eotf_nodes() -> tuple[float, ...]:
    return tuple(q9(srgb_to_linear_exact(i / CONV_LAST)) for i in range(CONV_LAST + 1))


@cache
def oetf_nodes() -> tuple[float, ...]:
    return tuple(q9(linear_to_srgb_exact(i / CONV_LAST)) for i in range(CONV_LAST + 1))


@cache
def eotf_u8() -> tuple[float, ...]:
    return tuple(q9(srgb_to_linear_exact(i / 255)) for i in range(256))


def to_linear(c: Column) -> Column:
    return lerp(eotf_nodes(), c)


def codes_to_linear(c: Column) -> Column:
    """Of code values on 0..1, 8 or 16 bits deep: what a table of all of them has, without one of 65,536 entries in the plan."""
    return F.round(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) * 1e9) / 1e9


def to_srgb(c: Column) -> Column:
    return lerp(oetf_nodes(), c)


def luma_601(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma_709(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def smoothstep(t: Column) -> Column:
    return t * t * (3.0 - 2.0 * t)


def unpremultiplied(c: Column, a: Column) -> Column:
    return F.when(a < ALPHA_LEAST, 0.0).otherwise(clamp(c / a))


def hex_color(text: str) -> tuple[int, int, int, int] | None:
    """``#rgb``, ``#rgba``, ``#rrggbb`` or ``#rrggbbaa`` as code values."""
    if not text.startswith("#") or len(text) not in (4, 5, 7, 9):
        return None
    digits = text[1:] if len(text) > 5 else "".join(c * 2 for c in text[1:])
    try:
        if not digits.isalnum():
            return None
        values = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
    except ValueError:
        return None
    return tuple([*values, 255][:4])


def aspect_ratio(text: str) -> tuple[int, int] | None:
    parts = text.split(":")
    if len(parts) != 2 or not all(p.isascii() and p.isdigit() and int(p) for p in parts):
        return None
    return int(parts[0]), int(parts[1])


def monotone_nodes(points: Sequence[Sequence[int]]) -> list[float]:
    """A monotone cubic through control points of code values, at the 256 code values, on 0..1."""
    xs, ys = [float(p[0]) for p in points], [float(p[1]) for p in points]
    if len(points) == 1:
        return [min(max(q9(ys[0]), 0.0), 255.0) / 255.0] * 256
    n = len(xs)
    slope = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
    tangent = [slope[0], *((a + b) / 2 for a, b in zip(slope, slope[1:], strict=False)), slope[-1]]
    for i, d in enumerate(slope):
        if d == 0:
            tangent[i] = tangent[i + 1] = 0.0
            continue
        for j in (i, i + 1):
            if tangent[j] / d < 0:
                tangent[j] = 0.0
        a, b = tangent[i] / d, tangent[i + 1] / d
        if a * a + b * b > 9:
            t = 3 / math.sqrt(a * a + b * b)
            tangent[i], tangent[i + 1] = t * a * d, t * b * d

    def at(x: float) -> float:
        if x <= xs[0]:
            return ys[0]
        if x >= xs[-1]:
            return ys[-1]
        i = max(k for k in range(n - 1) if xs[k] <= x)
        h = xs[i + 1] - xs[i]
        t = (x - xs[i]) / h
        return (
            (2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * h * tangent[i]
            + (-2 * t**3 + 3 * t**2) * ys[i + 1] + (t**3 - t**2) * h * tangent[i + 1]
        )

    return [min(max(q9(at(float(x))), 0.0), 255.0) / 255.0 for x in range(256)]


def lerp_value(values: Sequence[float], v: float) -> float:
    at = min(max(v, 0.0), 1.0) * (len(values) - 1)
    i = min(int(at), len(values) - 2)
    return values[i] + (values[i + 1] - values[i]) * (at - i)


def composed(first: Sequence[float] | None, second: Sequence[float] | None) -> list[float] | None:
    """Nodes of ``second`` after ``first``."""
    if first is None or second is None:
        return list(first or second) if first or second else None
    return [lerp_value(second, v) for v in first]


def level_nodes(in_black: int, in_white: int, gamma: float, out_black: int, out_white: int) -> list[float]:
    out = []
    for i in range(256):
        v = min(max((i - in_black) / (in_white - in_black), 0.0), 1.0)
        v = v if gamma == 1.0 else v ** (1.0 / gamma)
        out.append(min(max(q9(out_black + v * (out_white - out_black)), 0.0), 255.0) / 255.0)
    return out


def gaussian_weights(sigma: float) -> list[float]:
    """Taps -radius..radius, on a grid of 1e-6 before they are normalised."""
    radius = min(max(math.ceil(3 * sigma), 1), 255)
    raw = [q6(math.exp(-(i * i) / (2 * sigma * sigma))) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def lanczos_taps(size: int, out: int) -> list[list[tuple[int, float]]]:
    """For each output place the source places, ends held, and their weights: Lanczos with three lobes."""
    ratio = size / out
    scale = max(1.0, ratio)
    reach = 3.0 * scale

    def kernel(t: float) -> float:
        if t == 0:
            return 1.0
        if abs(t) >= 3:
            return 0.0
        a = math.pi * t
        return 3 * math.sin(a) * math.sin(a / 3) / (a * a)

    taps = []
    for o in range(out):
        centre = (o + 0.5) * ratio
        low, high = math.floor(centre - reach), math.ceil(centre + reach)
        each = [(s, q6(kernel((s + 0.5 - centre) / scale))) for s in range(low, high + 1)]
        total = sum(w for _, w in each)
        merged: dict[int, float] = {}
        for s, w in each:
            if w:
                k = min(max(s, 0), size - 1)
                merged[k] = merged.get(k, 0.0) + w / total
        taps.append(sorted(merged.items()))
    return taps
