"""Row-local tone and colour operators, and those that need a statistic of the image first."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..frame import LINEAR, SRGB, PixelFrame
from ..functions import numeric as N
from . import kernels as K


def _c(name: str) -> Column:
    return F.col(name)


def adjust(p: PixelFrame, brightness=0.0, contrast=0.0, saturation=0.0, sharpness=0.0) -> PixelFrame:
    p = p.to(SRGB)
    if brightness or contrast or saturation:
        mid = 128.0 / 255.0
        v = {c: (_c(c) + float(brightness) - mid) * (1.0 + contrast) + mid for c in N.CHANNELS}
        if saturation:
            p = p.with_columns(v)
            luma = N.luma_601(_c("r"), _c("g"), _c("b"))
            v = {c: luma + (_c(c) - luma) * (1.0 + saturation) for c in N.CHANNELS}
        p = p.with_columns({c: N.clamp(e) for c, e in v.items()})
    if sharpness:
        from .filters import taps

        blurred = p.select(*p.df.columns, *(_c(c).alias(f"blur_{c}") for c in N.CHANNELS))
        for axis in ("x", "y"):
            blurred = taps(blurred, [0.25, 0.5, 0.25], axis, [f"blur_{c}" for c in N.CHANNELS])
        sharp = {c: N.clamp(_c(c) + float(sharpness) * (_c(c) - _c(f"blur_{c}"))) for c in N.CHANNELS}
        p = blurred.with_columns(sharp).select(*p.df.columns)
    return p


def color_matrix(p: PixelFrame, matrix: Sequence[float]) -> PixelFrame:
    p, m = p.to(SRGB), [float(v) for v in matrix]
    row = lambda i: N.clamp(sum((_c(c) * m[5 * i + j] for j, c in enumerate("rgba")), F.lit(0.0)) + m[5 * i + 4])
    return p.with_columns({c: row(i) for i, c in enumerate("rgba")})


def curves(p: PixelFrame, master=None, red=None, green=None, blue=None) -> PixelFrame:
    p = p.to(SRGB)
    nodes = lambda points: N.monotone_nodes(points) if points else None
    first = nodes(master)
    tables = {c: N.composed(first, nodes(own)) for c, own in zip(N.CHANNELS, (red, green, blue), strict=True)}
    return p.with_columns({c: N.lerp(t, _c(c)) for c, t in tables.items() if t})


def levels(p: PixelFrame, in_black=0, in_white=255, gamma=1.0, out_black=0, out_white=255) -> PixelFrame:
    nodes = N.level_nodes(in_black, in_white, gamma, out_black, out_white)
    return p.to(SRGB).rgb(lambda c: N.lerp(nodes, c))


def white_balance_gains(temperature: float, tint: float) -> tuple[float, float, float]:
    r, g, b = 1 + 0.35 * temperature / 100, 1 - 0.25 * tint / 100, 1 - 0.35 * temperature / 100
    mean = 0.2126 * r + 0.7152 * g + 0.0722 * b
    return N.q6(r / mean), N.q6(g / mean), N.q6(b / mean)


def white_balance(p: PixelFrame, temperature=0.0, tint=0.0) -> PixelFrame:
    p = p.to(LINEAR)
    if not temperature and not tint:
        return p
    return p.with_columns({c: N.clamp(_c(c) * k) for c, k in zip(N.CHANNELS, white_balance_gains(temperature, tint), strict=True)})


# The bands' names and the hues of their centres.
BANDS = {"red": 0.0, "orange": 30.0, "yellow": 60.0, "green": 120.0, "aqua": 180.0, "blue": 240.0, "purple": 280.0, "magenta": 320.0}


def hsl(p: PixelFrame, **bands: Mapping[str, float] | None) -> PixelFrame:
    p = p.to(SRGB)
    shift = {n: {k: float((bands.get(n) or {}).get(k, 0.0)) for k in ("hue", "saturation", "luminance")} for n in BANDS}
    if not any(v for s in shift.values() for v in s.values()):
        return p
    names, centres = list(BANDS), [*BANDS.values(), 360.0]
    r, g, b = _c("r"), _c("g"), _c("b")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    gray = (r == g) & (g == b)
    sector = (
        F.when(gray, 0.0)
        .when(high == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0))
        .when(high == g, (b - r) / d + 2.0)
        .otherwise((r - g) / d + 4.0)
    )
    light = (high + low) / 2.0
    base = p.with_columns({"_gray": gray, "_h": sector * 60.0, "_l": light, "_s": F.when(gray, 0.0).when(light <= 0.5, d / (high + low)).otherwise(d / (2.0 - high - low))})

    def ladder(value) -> Column:
        """``value``(band, next band, weight of the next) for the two bands around the hue."""
        out = None
        for i, name in enumerate(names):
            t = (_c("_h") - centres[i]) / (centres[i + 1] - centres[i])
            v = value(shift[name], shift[names[(i + 1) % 8]], t)
            test = _c("_h") < centres[i + 1]
            out = F.when(test, v) if out is None else out.when(test, v)
        return out.otherwise(value(shift["red"], shift["orange"], F.lit(0.0)))

    mixed = lambda k: ladder(lambda x, y, t: (1.0 - t) * x[k] + t * y[k])
    idle = ladder(lambda x, y, t: F.lit(not any(x.values()) and not any(y.values())))
    base = base.with_columns({"_dh": mixed("hue") * 0.3, "_fs": N.clamp(mixed("saturation") / 100.0, -0.95, 1.0), "_fl": N.clamp(mixed("luminance") / 100.0 * 0.5, -0.95, 1.0), "_keep": _c("_gray") | idle})
    base = base.with_columns({"_h": F.pmod(_c("_h") + _c("_dh"), F.lit(360.0)), "_s": N.clamp(_c("_s") * (1.0 + _c("_fs"))), "_l": N.clamp(_c("_l") * (1.0 + _c("_fl")))})
    chroma = F.when(_c("_l") <= 0.5, 2.0 * _c("_l") * _c("_s")).otherwise((2.0 - 2.0 * _c("_l")) * _c("_s"))
    base = base.with_columns({"_c": chroma, "_p": _c("_h") / 60.0})
    base = base.with_columns({"_x": _c("_c") * (1.0 - F.abs(_c("_p") % 2.0 - 1.0)), "_m": _c("_l") - _c("_c") / 2.0})

    def pick(order: str) -> Column:
        parts = {"c": _c("_c"), "x": _c("_x"), "0": F.lit(0.0)}
        out = F.when(_c("_p") < 1.0, parts[order[0]])
        for i in range(1, 5):
            out = out.when(_c("_p") < i + 1.0, parts[order[i]])
        return N.clamp(out.otherwise(parts[order[5]]) + _c("_m"))

    new = {"r": pick("cx00xc"), "g": pick("xccx00"), "b": pick("00xccx")}
    flat = N.clamp(_c("_l"))
    return base.with_columns({c: F.when(_c("_keep"), _c(c)).when(_c("_s") <= 0.0, flat).otherwise(e) for c, e in new.items()}).select(*p.df.columns)


def vignette(p: PixelFrame, strength: float, radius=0.7, feather=0.5) -> PixelFrame:
    p = p.to(LINEAR)
    if not strength:
        return p
    gain = vignette_gain(p, strength, radius, feather)
    return p.rgb(lambda c: c * gain)


def vignette_gain(p: PixelFrame, strength: float, radius: float, feather: float) -> Column:
    dx, dy = _c("x") + 0.5 - p.pick(lambda e: e.width / 2.0), _c("y") + 0.5 - p.pick(lambda e: e.height / 2.0)
    d = F.sqrt(dx * dx + dy * dy) / p.pick(lambda e: math.sqrt(e.width * e.width + e.height * e.height) / 2.0)
    t = N.clamp((d - float(radius)) / float(feather)) if feather else F.when(d > float(radius), 1.0).otherwise(0.0)
    return N.col_q6(1.0 - float(strength) * N.smoothstep(t))


# What the seed is xored with, and the factors of block column, block row and channel.
GRAIN_SEED, GRAIN_FACTORS = 0xA0761D6478BD642F, (0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15)


def _splitmix(z: np.ndarray) -> np.ndarray:
    # The constants of splitmix64.
    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def grain_noise(seed: int, size: int, channel: int):
    """Noise in -1..1 of a pixel's block: four chained rounds, whose upper 32 bits count."""

    @pandas_udf("double")
    def noise(x: pd.Series, y: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = _splitmix(np.full(len(x), seed ^ GRAIN_SEED, np.uint64))
            parts = (x // size).to_numpy(), (y // size).to_numpy(), np.full(len(x), channel)
            for part, factor in zip(parts, GRAIN_FACTORS, strict=True):
                z = _splitmix(z ^ part.astype(np.uint64) * np.uint64(factor))
        return pd.Series((z >> np.uint64(32)).astype(np.float64) / 4294967295.0 * 2.0 - 1.0)

    return noise("x", "y")


def grain(p: PixelFrame, amount: float, size=1, monochrome=True, seed=0) -> PixelFrame:
    p = p.to(SRGB)
    if not amount:
        return p
    p = p.with_columns({f"_n{i}": grain_noise(seed, size, i) for i in range(1 if monochrome else 3)})
    noisy = {c: N.clamp(_c(c) + N.col_q6(_c(f"_n{0 if monochrome else i}") * float(amount) * 0.12)) for i, c in enumerate(N.CHANNELS)}
    columns = [c for c in p.df.columns if not c.startswith("_n")]
    return p.with_columns(noisy).select(*columns)


def gradient_map(p: PixelFrame, stops: Sequence[Mapping]) -> PixelFrame:
    p = p.to(SRGB)
    at = [float(s["position"]) for s in stops]
    colors = [N.hex_color(s["color"])[:3] for s in stops]
    p = p.with_columns({"_l": N.luma_709(_c("r"), _c("g"), _c("b"))})

    def channel(i: int) -> Column:
        v = [c[i] / 255.0 for c in colors]
        out = F.when(_c("_l") <= at[0], v[0])
        for k in range(len(at) - 1):
            out = out.when(_c("_l") < at[k + 1], v[k] + (v[k + 1] - v[k]) * ((_c("_l") - at[k]) / (at[k + 1] - at[k])))
        return out.otherwise(v[-1])

    return p.with_columns({c: channel(i) for i, c in enumerate(N.CHANNELS)}).select(*[c for c in p.df.columns if c != "_l"])


def lut(p: PixelFrame, cube, strength=1.0) -> PixelFrame:
    """``cube``: a sources.cube.Cube, one- or three-dimensional."""
    p = p.to(SRGB)
    if not strength:
        return p
    if cube.is_3d:
        return K.per_batch(p, _tetrahedral(p.df.sparkSession.sparkContext.broadcast(np.array(cube.rows)), cube, float(strength)))
    low, high = cube.domain_min, cube.domain_max
    where = [N.clamp((_c(c) - low[i]) / (high[i] - low[i])) for i, c in enumerate(N.CHANNELS)]
    target = [N.lerp([row[i] for row in cube.rows], v) for i, v in enumerate(where)]
    return p.with_columns({c: _c(c) + (N.clamp(target[i]) - _c(c)) * float(strength) for i, c in enumerate(N.CHANNELS)})


#: Corners on the way from a cell's low corner to its high one, by the order of the fractions: their tests, and the channels in order.
PATHS = (
    (lambda r, g, b: (r > g) & (g > b), (0, 1, 2)), (lambda r, g, b: (r > g) & (r > b), (0, 2, 1)), (lambda r, g, b: r > g, (2, 0, 1)),
    (lambda r, g, b: b > g, (2, 1, 0)), (lambda r, g, b: b > r, (1, 2, 0)), (lambda r, g, b: np.ones(len(r), bool), (1, 0, 2)),
)


def _tetrahedral(sent, cube, strength: float):
    """A function from colours (n, 3) to their values in a broadcast three-dimensional table (129 nodes a side at most)."""
    low, span, n = np.array(cube.domain_min), np.subtract(cube.domain_max, cube.domain_min), cube.size

    def run(rgb: np.ndarray) -> np.ndarray:
        at = np.clip((rgb - low) / span, 0.0, 1.0) * float(n - 1)
        cell = np.minimum(np.floor(at), n - 1).astype(np.int64)
        f, step = at - cell, np.minimum(cell + 1, n - 1) - cell
        strides = np.array([1, n, n * n])
        out, left = np.empty_like(rgb), np.ones(len(rgb), bool)
        for test, order in PATHS:
            rows = np.flatnonzero(left & test(*f.T))
            left[rows] = False
            node = cell[rows] @ strides
            before = sent.value[node]
            value = before.copy()
            for c in order:
                node = node + step[rows, c] * strides[c]
                after = sent.value[node]
                value += f[rows, c, None] * (after - before)
                before = after
            out[rows] = value
        return rgb + (np.clip(out, 0.0, 1.0) - rgb) * strength

    return run


def histogram(p: PixelFrame, value: Column) -> PixelFrame:
    """(image_id, bin, n): counts of 256 bins."""
    return p.df.groupBy("image_id", F.floor(value * 255.0 + 0.5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _bounds(bins, keys: list[str], clip_percent: float):
    """(*keys, lo, hi): the first bins from either end whose running counts exceed the clipped share."""
    up = Window.partitionBy(*keys).orderBy("bin")
    down = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    limit = F.sum("n").over(Window.partitionBy(*keys)) * float(clip_percent) / 100.0
    run = bins.select(*keys, "bin", (F.sum("n").over(up) > limit).alias("from_low"), (F.sum("n").over(down) > limit).alias("from_high"))
    return run.groupBy(*keys).agg(F.min(F.when(_c("from_low"), _c("bin"))).alias("lo"), F.max(F.when(_c("from_high"), _c("bin"))).alias("hi"))


def level_bounds(p: PixelFrame, value: Column, clip_percent: float):
    """(image_id, lo, hi) of one value."""
    return _bounds(histogram(p, value), ["image_id"], clip_percent)


def auto_levels(p: PixelFrame, clip_percent=0.5, per_channel=False) -> PixelFrame:
    p, columns = p.to(SRGB), p.df.columns
    df = p.df
    # one row for an image: the tables of bounds are small beside the pixels, and Spark broadcasts them below its threshold
    sources = {c: _c(c) for c in N.CHANNELS} if per_channel else {"all": N.luma_709(_c("r"), _c("g"), _c("b"))}
    # the bins of all sources in one pass over the pixels
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("of"), F.floor(v * 255.0 + 0.5).cast("int").alias("bin")) for n, v in sources.items())))
    bins = df.select("image_id", each.alias("_e")).groupBy("image_id", "_e.of", "_e.bin").agg(F.count(F.lit(1)).alias("n"))
    bounds = _bounds(bins, ["image_id", "of"], clip_percent).groupBy("image_id")
    ends = [F.max(F.when(_c("of") == n, _c(k) / 255.0)).alias(f"_{k}_{n}") for n in sources for k in ("lo", "hi")]
    df = df.join(bounds.agg(*ends), "image_id", "left")

    def stretched(c: str) -> Column:
        lo, hi = (_c(f"_{k}_{c if per_channel else 'all'}") for k in ("lo", "hi"))
        return F.when(hi > lo, N.clamp((_c(c) - lo) / (hi - lo))).otherwise(_c(c))

    return replace(p, df=df.withColumns({c: stretched(c) for c in N.CHANNELS}).select(*columns))
