"""Blend modes, source-over compositing, layers, masks and overlays: positional joins and expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import KEY, SRGB, PixelFrame
from ..functions import numeric as N


def _hard_light(b: Column, s: Column) -> Column:
    screen = lambda x, y: x + y - x * y
    return F.when(s <= 0.5, b * (2.0 * s)).otherwise(screen(b, 2.0 * s - 1.0))


def _soft_light(b: Column, s: Column) -> Column:
    d = F.when(b <= 0.25, ((16.0 * b - 12.0) * b + 4.0) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1.0 - 2.0 * s) * b * (1.0 - b)).otherwise(b + (2.0 * s - 1.0) * (d - b))


SEPARABLE = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": lambda b, s: b + s - b * s,
    "overlay": lambda b, s: _hard_light(s, b),
    "darken": lambda b, s: F.least(b, s),
    "lighten": lambda b, s: F.greatest(b, s),
    "color_dodge": lambda b, s: F.when(b == 0.0, 0.0).when(s == 1.0, 1.0).otherwise(F.least(F.lit(1.0), b / F.nullif(1.0 - s, F.lit(0.0)))),
    "color_burn": lambda b, s: F.when(b == 1.0, 1.0).when(s == 0.0, 0.0).otherwise(1.0 - F.least(F.lit(1.0), (1.0 - b) / F.nullif(s, F.lit(0.0)))),
    "hard_light": _hard_light,
    "soft_light": _soft_light,
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2.0 * b * s,
}
NON_SEPARABLE = ("hue", "saturation", "color", "luminosity")
MODES = (*SEPARABLE, *NON_SEPARABLE)

Triple = tuple[Column, Column, Column]


def _lum(c: Triple) -> Column:
    return c[0] * 0.3 + c[1] * 0.59 + c[2] * 0.11


def _sat(c: Triple) -> Column:
    return F.greatest(*c) - F.least(*c)


def _set_sat(c: Triple, s: Column) -> Triple:
    """The triple stretched to saturation s: its least value goes to 0, its greatest to s."""
    low, d = F.least(*c), _sat(c)
    return tuple(F.when(d > 0.0, (v - low) * s / F.nullif(d, F.lit(0.0))).otherwise(0.0) for v in c)


def _set_lum(c: Triple, lum: Column, p: PixelFrame) -> tuple[PixelFrame, Triple]:
    """Move to a luminosity and clip towards it; intermediate values become columns, so that plans stay small."""
    shift = lum - _lum(c)
    p = p.with_columns({f"_t{i}": v + shift for i, v in enumerate(c)})
    t = tuple(F.col(f"_t{i}") for i in range(3))
    p = p.with_columns({"_tl": _lum(t), "_tn": F.least(*t), "_tx": F.greatest(*t)})
    level, low, high = F.col("_tl"), F.col("_tn"), F.col("_tx")
    p = p.with_columns({f"_t{i}": F.when(low < 0.0, level + (v - level) * level / F.greatest(level - low, F.lit(1e-12))).otherwise(v) for i, v in enumerate(t)})
    t = tuple(F.col(f"_t{i}") for i in range(3))
    return p, tuple(F.when(high > 1.0, level + (v - level) * (1.0 - level) / F.greatest(high - level, F.lit(1e-12))).otherwise(v) for v in t)


def blended(p: PixelFrame, mode: str) -> tuple[PixelFrame, Triple]:
    """B(backdrop, source) of the columns b_r.. and s_r.."""
    b, s = (tuple(F.col(f"{k}_{c}") for c in N.CHANNELS) for k in "bs")
    if mode in SEPARABLE:
        return p, tuple(SEPARABLE[mode](x, y) for x, y in zip(b, s, strict=True))
    if mode == "hue":
        return _set_lum(_set_sat(s, _sat(b)), _lum(b), p)
    if mode == "saturation":
        return _set_lum(_set_sat(b, _sat(s)), _lum(b), p)
    if mode == "color":
        return _set_lum(s, _lum(b), p)
    return _set_lum(b, _lum(s), p)


def over(back: PixelFrame, source: PixelFrame, mode="normal", opacity=1.0, mask: DataFrame | None = None, at: tuple[int, int] | None = None) -> PixelFrame:
    """``source`` over ``back`` in sRGB code values. ``mask``: (image_id, y, x, w). With ``at`` the source may be smaller."""
    back, source = back.to(SRGB), source.to(SRGB)
    x0, y0 = at or (0, 0)
    top = source.df.select("image_id", (F.col("y") + y0).cast("int").alias("y"), (F.col("x") + x0).cast("int").alias("x"), *(N.clamp(F.col(c)).alias(f"s_{c}") for c in "rgba"), source.w.alias("_sw"), source.h.alias("_sh"))
    df = back.df.select(*back.keys, *(N.clamp(F.col(c)).alias(f"b_{c}") for c in "rgba"))
    df = df.join(top, list(KEY), "inner" if at is None else "left")
    if at is None and (back.mixed or source.mixed):
        alike = (F.col("_sw") == back.w) & (F.col("_sh") == back.h)
        df = df.withColumn("s_a", F.when(alike, F.col("s_a")).otherwise(F.raise_error(F.lit("a layer's size differs from the backdrop's")).cast("double")))
    if mask is not None:
        df = df.join(mask.select(*KEY, F.col("w").alias("_w")), list(KEY), "left")
    p = replace(back, df=df.withColumn("_as", F.coalesce(F.col("s_a"), F.lit(0.0)) * float(opacity) * (F.coalesce("_w", F.lit(0.0)) if mask is not None else F.lit(1.0))))
    p, mixed = blended(p, mode)
    sa, ba = F.col("_as"), F.col("b_a")
    p = p.with_columns({"_ao": sa + ba * (1.0 - sa)})
    ao = F.col("_ao")
    rgb = [
        F.when(sa <= 0.0, F.col(f"b_{c}")).otherwise(N.clamp((sa * (1.0 - ba) * F.col(f"s_{c}") + sa * ba * m + (1.0 - sa) * ba * F.col(f"b_{c}")) / F.nullif(ao, F.lit(0.0)))).alias(c)
        for c, m in zip(N.CHANNELS, mixed, strict=True)
    ]
    return p.select(*p.keys, *rgb, F.when(sa <= 0.0, ba).otherwise(ao).alias("a"))


def fold(layers: Sequence[tuple[PixelFrame, str, float, DataFrame | None]]) -> PixelFrame:
    """Layers from bottom to top; the first is the backdrop. Each: (frame, blend mode, opacity, mask)."""
    out = layers[0][0].to(SRGB)
    for frame, mode, opacity, mask in layers[1:]:
        if not (frame.mixed or out.mixed) and (frame.width, frame.height) != (out.width, out.height):
            raise ValueError("a layer's size differs from the backdrop's")
        out = over(out, frame, mode, opacity, mask)
    return out


def masked(before: PixelFrame, after: PixelFrame, mask: DataFrame) -> PixelFrame:
    """``after`` where the mask is 1, ``before`` where it is 0, and between them otherwise."""
    if before.each(lambda e: (e.width, e.height)) != after.each(lambda e: (e.width, e.height)):
        raise ValueError("a masked operation must keep the image's size")
    old = before.to(after.space).df.select(*KEY, *(F.col(c).alias(f"_{c}") for c in "rgba"))
    df = after.df.join(old, list(KEY)).join(mask.select(*KEY, "w"), list(KEY))
    new = [F.when(F.col("w") == 1.0, F.col(c)).when(F.col("w") == 0.0, F.col(f"_{c}")).otherwise(F.col(f"_{c}") + (F.col(c) - F.col(f"_{c}")) * F.col("w")).alias(c) for c in "rgba"]
    return replace(after, df=df.select(*after.keys, *new))


def flattened(p: PixelFrame) -> DataFrame:
    """Code values on white with integer rounding."""
    from ..frame import codes

    on_white = lambda c: F.floor((F.col(c) * F.col("a8") + 255 * (255 - F.col("a8")) + 127) / 255).cast("int").alias(c)
    return codes(p).select(*p.keys, *(on_white(f"{c}8") for c in N.CHANNELS))
