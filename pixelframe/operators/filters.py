"""Neighbourhood operators. Small footprints are window expressions, larger ones numpy kernels on tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import LINEAR, PixelFrame
from ..functions import numeric as N
from . import kernels as K

#: The largest radius of a filter, and of a square kernel, that runs as a window expression.
WINDOW_RADIUS, CONVOLVE_RADIUS = 8, 1


def neighbour(column: str | Column, offset: int, axis: str) -> Column:
    """A column's value ``offset`` pixels on along an axis, the image's edge held."""
    c = F.col(column) if isinstance(column, str) else column
    if not offset:
        return c
    w = Window.partitionBy("image_id", "y" if axis == "x" else "x").orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.lead(c, offset).over(w) if offset > 0 else F.lag(c, -offset).over(w)
    return F.coalesce(moved, (F.last(c) if offset > 0 else F.first(c)).over(whole))


def taps(p: PixelFrame, weights: Sequence[float], axis: str, columns: Sequence[str]) -> PixelFrame:
    """Each column's weighted sum of neighbours along an axis, added from left to right."""
    r = len(weights) // 2
    new = {}
    for c in columns:
        total = None
        for k, w in enumerate(weights):
            term = neighbour(c, k - r, axis) * float(w)
            total = term if total is None else total + term
        new[c] = total
    return p.with_columns(new)


def premultiplied(p: PixelFrame) -> PixelFrame:
    return p.with_columns({c: F.col(c) * F.col("a") for c in N.CHANNELS})


def unpremultiplied(p: PixelFrame) -> PixelFrame:
    return p.with_columns({c: N.unpremultiplied(F.col(c), F.col("a")) for c in N.CHANNELS})


def blur(p: PixelFrame, sigma: float) -> PixelFrame:
    p, weights = p.to(LINEAR), N.gaussian_weights(sigma)
    if len(weights) // 2 > WINDOW_RADIUS:
        return K.per_tile(p, lambda v, on: K.blurred(v, weights, on), len(weights) // 2)
    p = premultiplied(p)
    for axis in ("x", "y"):
        p = taps(p, weights, axis, list("rgba"))
    return unpremultiplied(p)


def median(p: PixelFrame, radius: int) -> PixelFrame:
    """The middle value of each channel in a square; for radius 1 as arrays of window values."""
    p = p.to(LINEAR)
    if radius > 1:
        return K.per_tile(p, lambda v, on: K.median(v, radius, on), radius)
    rows = p.with_columns({f"_{c}": F.array(*(neighbour(c, k, "x") for k in (-1, 0, 1))) for c in "rgba"})
    new = {c: F.element_at(F.array_sort(F.concat(*(neighbour(f"_{c}", k, "y") for k in (-1, 0, 1)))), 5) for c in "rgba"}
    return rows.with_columns(new).select(*p.df.columns)


def unsharp_mask(p: PixelFrame, amount: float, radius: float, threshold=0) -> PixelFrame:
    p = p.to(LINEAR)
    if len(N.gaussian_weights(radius)) // 2 <= WINDOW_RADIUS:
        # the windows carry the sharp channels along, so that nothing is joined
        soft = blur(p.with_columns({f"_o{c}": F.col(c) for c in "rgba"}), radius)
        both = soft.with_columns({f"_{c}": F.col(c) for c in "rgba"} | {c: F.col(f"_o{c}") for c in "rgba"}).df
    else:
        weights = N.gaussian_weights(radius)
        return K.per_tile(p, lambda v, on: K.sharpened(v, weights, float(amount), threshold / 255.0, on), len(weights) // 2)
    diff = {c: F.col(c) - F.col(f"_{c}") for c in "rgba"}
    sharp = {c: F.when(F.abs(d) > threshold / 255.0, N.clamp(F.col(c) + float(amount) * d)).otherwise(F.col(c)) for c, d in diff.items()}
    return replace(p, df=both.withColumns(sharp).select(*p.df.columns))


def convolve(p: PixelFrame, kernel: Sequence[float], size: int, divisor=1.0, offset=0.0) -> PixelFrame:
    p, r = p.to(LINEAR), size // 2
    if r > CONVOLVE_RADIUS:
        return K.per_tile(p, lambda v, on: K.correlated(v, kernel, size, float(divisor), offset / 255.0, N.ALPHA_LEAST, on), r)
    base = p.with_columns({f"_{c}": F.col(c) * F.col("a") for c in N.CHANNELS})
    # each row of the kernel is one pass along x; the rows then meet along y
    for c in N.CHANNELS:
        rows = {}
        for j in range(size):
            total = None
            for i in range(size):
                term = neighbour(f"_{c}", i - r, "x") * float(kernel[j * size + i])
                total = term if total is None else total + term
            rows[f"_{c}{j}"] = total
        base = base.with_columns(rows)
    new = {}
    for c in N.CHANNELS:
        total = None
        for j in range(size):
            term = neighbour(f"_{c}{j}", j - r, "y")
            total = term if total is None else total + term
        v = F.when(F.col("a") < N.ALPHA_LEAST, 0.0).otherwise(total / float(divisor) / F.col("a"))
        new[c] = N.clamp(v + offset / 255.0)
    return base.with_columns(new).select(*p.df.columns)


def disc_weight(cx: int, cy: int, radius: Column, feather: float) -> Column:
    dx, dy, radius = F.col("x") - F.lit(cx), F.col("y") - F.lit(cy), radius.cast("double")
    d, core = F.sqrt((dx * dx + dy * dy).cast("double")), F.greatest(radius - float(feather), F.lit(0.0))
    t = N.clamp((radius - d) / F.nullif(radius - core, F.lit(0.0)))
    return N.col_q6(F.when(d <= core, 1.0).when(d > radius, 0.0).otherwise(N.smoothstep(t)))


def _onto_disc(p: PixelFrame, patch: DataFrame, cx: int, cy: int, radius: Column, feather: float) -> PixelFrame:
    """``patch`` over the disc's pixels by their weight. Only the square around the disc is joined; all other pixels pass by."""
    square = F.col("x").between(F.lit(cx) - radius, F.lit(cx) + radius) & F.col("y").between(F.lit(cy) - radius, F.lit(cy) + radius)
    both = p.df.filter(square).join(patch.select(*p.keys, *(F.col(c).alias(f"_{c}") for c in "rgba")), list(p.keys), "left").withColumn("_w", disc_weight(cx, cy, radius, feather))
    new = {c: F.when(F.col("_r").isNull() | (F.col("_w") <= 0.0), F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_w")) for c in "rgba"}
    rows = both.select(*p.keys, *(e.alias(c) for c, e in new.items()))
    return replace(p, df=rows.unionByName(p.df.filter(~square).select(*p.keys, *"rgba")))


def clone(p: PixelFrame, src_x: int, src_y: int, dest_x: int, dest_y: int, radius: int, feather_px=0.0) -> PixelFrame:
    """Pixels of a disc from elsewhere in the same image: a join of the disc with itself, moved."""
    p = p.to(LINEAR)
    near = F.col("x").between(src_x - radius, src_x + radius) & F.col("y").between(src_y - radius, src_y + radius)
    moved = lambda c, by: (F.col(c) + by).cast("int").alias(c)
    source = p.df.filter(near).select("image_id", moved("y", dest_y - src_y), moved("x", dest_x - src_x), *p.ids[1:], *"rgba")
    return _onto_disc(p, source, dest_x, dest_y, F.lit(radius), feather_px)


def heal(p: PixelFrame, src_x: int, src_y: int, dest_x: int, dest_y: int, radius: int, feather_px=0.0) -> PixelFrame:
    """A disc with the detail of another: both patches, the blurred source taken away and the blurred target added."""
    p = p.to(LINEAR)
    reach = p.each(lambda e: min(radius, math.ceil(math.hypot(e.width, e.height))))
    patch = K.healed(p, (src_x, src_y), (dest_x, dest_y), reach, [N.gaussian_weights(max(r / 3.0, 0.1)) for r in reach])
    return _onto_disc(p, patch, dest_x, dest_y, p.pick(reach), feather_px)


def pixelate(p: PixelFrame, block_size: int, region=None) -> PixelFrame:
    """Block means of premultiplied colour, over blocks that start at the region's corner."""
    p = p.to(LINEAR)
    x0, y0 = (region["x"], region["y"]) if region else (0, 0)
    ends = p.each(lambda e: (min(x0 + region["width"], e.width), min(y0 + region["height"], e.height)) if region else (e.width, e.height))
    if any(x0 >= x1 or y0 >= y1 for x1, y1 in ends):
        raise ValueError("the region lies outside the image")
    x1, y1 = (p.pick([e[i] for e in ends]) for i in (0, 1))
    inside = F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)
    block = lambda c, o: F.floor((F.col(c) - o) / block_size)
    # added up line by line, so that a mean does not depend on the order in which a shuffle brings rows
    w_ = Window.partitionBy("image_id", inside, block("y", y0), block("x", x0)).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = p.with_columns({f"_{c}": F.avg(F.col(c) * F.col("a")).over(w_) for c in N.CHANNELS} | {"_a": F.avg("a").over(w_)})
    new = {c: F.when(inside, N.unpremultiplied(F.col(f"_{c}"), F.col("_a"))).otherwise(F.col(c)) for c in N.CHANNELS}
    return mean.with_columns(new | {"a": F.when(inside, F.col("_a")).otherwise(F.col("a"))}).select(*p.df.columns)
