"""Weight planes: (image_id, y, x, w) with w on 0..1, from images and from generators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import KEY, SIZE_ID, SRGB, Extent, PixelFrame
from ..functions import numeric as N
from .filters import WINDOW_RADIUS, taps


def _resized(q: PixelFrame, sizes: Sequence[tuple[int, int]]) -> PixelFrame:
    """Weights of each extent at another size. Bilinear between pixel centres: each axis as a table of two taps for each place."""
    df = q.df
    for axis, old, new in (("x", q.each(lambda e: e.width), [w for w, _ in sizes]), ("y", q.each(lambda e: e.height), [h for _, h in sizes])):
        if old == new:
            continue
        pairs = sorted(set(zip(old, new, strict=True)))
        rows = []
        for k, (size, out) in enumerate(pairs):
            for o in range(out):
                at = min(max((o + 0.5) * size / out - 0.5, 0.0), size - 1.0)
                i = int(at)
                f = N.q6(at - i)
                rows += [(k, i, o, 1.0 - f), (k, min(i + 1, size - 1), o, f)]
        table = df.sparkSession.createDataFrame(rows, f"_pair int, {axis} int, _o int, _k double")
        other = "y" if axis == "x" else "x"
        df = df.withColumn("_pair", q.pick([pairs.index(k) for k in zip(old, new, strict=True)])).join(F.broadcast(table) if len(rows) <= 500_000 else table, ["_pair", axis])
        df = df.groupBy(*q.ids, other, F.col("_o").alias(axis)).agg(F.sum(F.col("w") * F.col("_k")).alias("w"))
    return q.sized(df.select(*q.keys, "w"), [Extent(w, h) for w, h in sizes])


def _fitted(mask: PixelFrame, target: PixelFrame) -> tuple[PixelFrame, list[tuple[int, int]]]:
    """The mask as a frame whose extents are the pairs of sizes that an image has as mask and as target, and the targets' sizes."""
    sizes = target.each(lambda e: (e.width, e.height))
    if not target.mixed:
        return mask, sizes * len(mask.shapes)
    own = F.col(SIZE_ID) if mask.mixed else F.lit(0)
    images = target.images().select("image_id", F.col(SIZE_ID).alias("_target"))
    rows = mask.df.withColumn("_own", own).drop(SIZE_ID).join(images, "image_id")
    if mask.mixed:
        met = mask.images().join(images, "image_id").select(SIZE_ID, "_target").distinct()
        pairs = sorted((r[0], r[1]) for r in met.toLocalIterator()) or [(0, 0)]
    else:
        pairs = [(0, k) for k in range(len(sizes))]
    table = mask.df.sparkSession.createDataFrame([(k, *pair) for k, pair in enumerate(pairs)], f"{SIZE_ID} int, _own int, _target int")
    rows = rows.join(F.broadcast(table) if len(pairs) <= 100_000 else table, ["_own", "_target"])
    extents = tuple(mask.shapes[i] for i, _ in pairs)
    return PixelFrame(rows.select(*KEY, SIZE_ID, *[c for c in mask.df.columns if c not in mask.keys]), None, None, mask.space, extents=extents), [sizes[k] for _, k in pairs]


def plane_for(mask: PixelFrame, target: PixelFrame, invert=False, feather_px=0.0) -> DataFrame:
    """The weights of mask images, each at the size of its target: luma, resized, inverted, feathered, clamped."""
    q, sizes = _fitted(mask, target)
    q = q.to(SRGB)
    q = _resized(q.select(*q.keys, N.luma_709(F.col("r"), F.col("g"), F.col("b")).alias("w")), sizes)
    if invert:
        q = q.with_columns({"w": 1.0 - F.col("w")})
    if feather_px > 0:
        weights = N.gaussian_weights(feather_px)
        if len(weights) // 2 <= WINDOW_RADIUS:
            for axis in ("x", "y"):
                q = taps(q, weights, axis, ["w"])
        else:
            from . import kernels as K

            four = q.select(*q.keys, *(F.col("w").alias(c) for c in "rgb"), F.lit(1.0).alias("a"))
            q = K.per_tile(four, lambda v, on: K.convolved(K.convolved(v, weights, 1, on), weights, 0, on), len(weights) // 2).select(*KEY, F.col("r").alias("w"))
    return q.df.select(*KEY, N.clamp(F.col("w")).alias("w"))


def plane(p: PixelFrame, width: int, height: int, invert=False, feather_px=0.0) -> DataFrame:
    """The same at one size."""
    return plane_for(p, PixelFrame(p.df, width, height), invert, feather_px)


def _ramp_down(t: Column, low: float, high: float) -> Column:
    """1 up to ``low``, 0 from ``high`` on, a line between; a step at ``low`` if they do not differ."""
    step = F.when(t <= float(low), 1.0)
    return step.otherwise(0.0) if high <= low else step.when(t >= float(high), 0.0).otherwise((float(high) - t) / float(high - low))


def linear_gradient(p: PixelFrame, angle_degrees=0.0, start=0.0, end=1.0) -> DataFrame:
    """1 before ``start`` and 0 after ``end`` along a direction, on coordinates of 0..1; 0 degrees runs downward."""
    a = math.radians(angle_degrees)
    dx, dy = N.q6(math.sin(a)), N.q6(math.cos(a))
    xn, yn = (F.col("x") + 0.5) / p.pick(lambda e: float(e.width)) - 0.5, (F.col("y") + 0.5) / p.pick(lambda e: float(e.height)) - 0.5
    return _codes(p, _ramp_down(0.5 + (xn * dx + yn * dy) / (abs(dx) + abs(dy)), start, end))


def radial_gradient(p: PixelFrame, center_x=0.5, center_y=0.5, radius=0.5, feather=0.25) -> DataFrame:
    """1 within ``radius``, 0 beyond ``radius + feather``, in half diagonals from a centre."""
    dx, dy = F.col("x") + 0.5 - p.pick(lambda e: center_x * e.width), F.col("y") + 0.5 - p.pick(lambda e: center_y * e.height)
    half = p.pick(lambda e: N.q6(0.5 * math.sqrt(float(e.width) ** 2 + float(e.height) ** 2)))
    return _codes(p, _ramp_down(N.col_q6(F.sqrt(dx * dx + dy * dy) / half), radius, radius + feather))


def _luma_codes() -> Column:
    r, g, b = (N.to_u8(F.col(c)) for c in N.CHANNELS)
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def luminosity_range(p: PixelFrame, low=0, high=255, feather=16.0) -> DataFrame:
    """1 where the luma, in code values, lies within the range; ``feather`` code values outside it fall to 0."""
    v = _luma_codes()
    p = p.to(SRGB)
    return _codes(p, F.when(v < float(low), _ramp_down(low - v, 0.0, feather)).when(v > float(high), _ramp_down(v - float(high), 0.0, feather)).otherwise(1.0))


#: HSV saturation below which a colour's weight falls to 0.
SATURATION_GATE = 0.10


def color_range(p: PixelFrame, hue_center: float, hue_width=30.0, feather=15.0) -> DataFrame:
    """1 up to ``hue_width`` degrees from a hue; weak saturation lowers the weight."""
    p = p.to(SRGB)
    r, g, b = (N.to_u8(F.col(c)) / F.lit(255.0) for c in N.CHANNELS)
    q = p.select(*p.keys, r.alias("r"), g.alias("g"), b.alias("b"))
    r, g, b = (F.col(c) for c in N.CHANNELS)
    high, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    flat = (d <= 0.0) | (high <= 0.0)
    hue = 60.0 * F.when(high == r, (g - b) / F.nullif(d, F.lit(0.0))).when(high == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2.0).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4.0)
    q = q.with_columns({"_h": F.when(flat, 0.0).otherwise(hue + F.when(hue < 0.0, 360.0).otherwise(0.0)), "_s": F.when(flat, 0.0).otherwise(d / high)})
    off = F.abs(F.col("_h") - float(hue_center)) % 360.0
    q = q.with_columns({"_o": F.when(off > 180.0, 360.0 - off).otherwise(off)})
    return _codes(q, _ramp_down(F.col("_o"), hue_width, hue_width + feather) * N.clamp(F.col("_s") / SATURATION_GATE))


def _codes(p: PixelFrame, w: Column) -> DataFrame:
    """Generated masks are images: weights as code values, back on 0..1."""
    return p.df.select(*p.keys, (F.floor(N.clamp(N.col_q6(w)) * 255.0 + 0.5) / 255.0).alias("w"))


class MaskError(ValueError):
    """``code`` says what is wrong with a mask's description."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


#: Generators by kind, with the fields each takes and their ranges.
KINDS = {
    "linear_gradient": (linear_gradient, {"angle_degrees": (-360, 360), "start": (0, 1), "end": (0, 1)}),
    "radial_gradient": (radial_gradient, {"center_x": (0, 1), "center_y": (0, 1), "radius": (0, 1), "feather": (0, 1)}),
    "luminosity_range": (luminosity_range, {"min": (0, 255), "max": (0, 255), "feather": (0, 255)}),
    "color_range": (color_range, {"hue_center": (0, 360), "hue_width": (1, 180), "feather": (0, 180)}),
}


def generate(p: PixelFrame, kind: str, **fields: float | None) -> DataFrame:
    """A mask by its kind and fields; what is not given has its default, and nothing that does not belong is passed over."""
    if kind not in KINDS:
        raise MaskError("invalid_mask_kind", f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    make, ranges = KINDS[kind]
    given = {k: v for k, v in fields.items() if v is not None}
    if odd := sorted(set(given) - set(ranges)):
        raise MaskError("unexpected_mask_param", f"{kind} does not take {', '.join(odd)}; it takes {', '.join(ranges)}")
    if kind == "color_range" and "hue_center" not in given:
        raise MaskError("missing_mask_param", "color_range needs hue_center, in degrees")
    for name, v in given.items():
        low, high = ranges[name]
        if not low <= v <= high:  # not a number is out of range too
            raise MaskError("invalid_mask_param", f"{name} is {v}, must be within {low}..{high}")
    for first, last, from_, to in (("start", "end", 0.0, 1.0), ("min", "max", 0, 255)):
        if first in ranges and given.get(last, to) < given.get(first, from_):
            raise MaskError("invalid_mask_param", f"{last} must not lie below {first}")
    return make(p, **{{"min": "low", "max": "high"}.get(k, k): v for k, v in given.items()})


def mean_weight(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg(N.col_q6(F.avg("w")).alias("mean_weight"))
