"""Differences of two images, layouts for comparing them, and guide lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import KEY, PixelFrame, codes, grid


def _joined(a: PixelFrame, b: PixelFrame) -> DataFrame:
    told = "images of different sizes have no pixel difference"
    if not (a.mixed or b.mixed) and (a.width, a.height) != (b.width, b.height):
        raise ValueError(told)
    x = codes(a).select(*KEY, *(F.col(f"{c}8").alias(f"p_{c}") for c in "rgb"), a.w.alias("_w"), a.h.alias("_h"))
    y = codes(b).select(*KEY, *(F.col(f"{c}8").alias(f"q_{c}") for c in "rgb"), b.w.alias("_v"), b.h.alias("_u"))
    both = x.join(y, list(KEY))
    alike = F.when((F.col("_w") == F.col("_v")) & (F.col("_h") == F.col("_u")), F.lit(0)).otherwise(F.raise_error(F.lit(told)).cast("int"))
    off = alike if a.mixed or b.mixed else F.lit(0)
    return both.select(*KEY, *((F.abs(F.col(f"p_{c}") - F.col(f"q_{c}")) + off).alias(f"d_{c}") for c in "rgb"))


def diff_stats(a: PixelFrame, b: PixelFrame, threshold: int = 2) -> DataFrame:
    """(image_id, mean_diff, max_diff, changed): over channels, and the share of pixels that differ by more."""
    d = F.greatest("d_r", "d_g", "d_b")
    return _joined(a, b).groupBy("image_id").agg(
        (F.sum(F.col("d_r") + F.col("d_g") + F.col("d_b")) / (3 * F.count(F.lit(1)))).alias("mean_diff"),
        F.max(d).alias("max_diff"),
        F.avg(F.when(d > threshold, 1.0).otherwise(0.0)).alias("changed"),
    )


# The heat map's stops.
HEAT = ((0, (0x10, 0x10, 0x30)), (64, (0x00, 0x40, 0xFF)), (160, (0xFF, 0xE8, 0x00)), (255, (0xFF, 0x00, 0x00)))


def diff_heatmap(a: PixelFrame, b: PixelFrame) -> DataFrame:
    """Code values of a ramp by the greatest channel difference."""
    d = F.greatest("d_r", "d_g", "d_b")

    def channel(i: int) -> Column:
        out = F.when(d <= HEAT[0][0], F.lit(HEAT[0][1][i]))
        for (x0, c0), (x1, c1) in zip(HEAT, HEAT[1:], strict=False):
            out = out.when(d <= x1, F.floor(c0[i] + (c1[i] - c0[i]) * (d - x0) / float(x1 - x0) + 0.5).cast("int"))
        return out

    return _joined(a, b).select(*KEY, *(channel(i).alias(f"{c}8") for i, c in enumerate("rgb")))


def beside(a: PixelFrame, b: PixelFrame, gap: int = 8, stacked: bool = False, fill: int = 0xDE) -> DataFrame:
    """Both images' code values on one canvas, centred across, with a gap between them."""
    if stacked:
        w, h = max(a.width, b.width), a.height + gap + b.height
        places = ((a, (w - a.width) // 2, 0), (b, (w - b.width) // 2, a.height + gap))
    else:
        w, h = a.width + gap + b.width, max(a.height, b.height)
        places = ((a, 0, (h - a.height) // 2), (b, a.width + gap, (h - b.height) // 2))
    moved = [codes(p).select("image_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x"), "r8", "g8", "b8") for p, x, y in places]
    canvas = grid(a.df.select("image_id").union(b.df.select("image_id")).distinct(), w, h)
    return canvas.join(moved[0].unionByName(moved[1]), list(KEY), "left").select(*KEY, *(F.coalesce(c, F.lit(fill)).alias(c) for c in ("r8", "g8", "b8")))


# Guide colour and tint colour.
GUIDE, TINT = (0xFF, 0x33, 0x55), (0xFF, 0x22, 0x22)


def guides(p: PixelFrame, kind: str) -> DataFrame:
    """Code values with lines at eighths (grid), thirds, or twelfths across (horizon), at six tenths of the line colour."""
    n = {"grid": 8, "thirds": 3, "horizon": 12}[kind]
    on = lambda c, size: reduce(Column.__or__, (F.col(c) == p.pick(lambda e, i=i: i * size(e) // n) for i in range(1, n)))
    lined = lambda c, k: F.floor(c * 0.4 + k * 0.6 + 0.5)
    row, column = on("y", lambda e: e.height), F.lit(False) if kind == "horizon" else on("x", lambda e: e.width)

    def mixed(name: str, k: int) -> Column:
        """Each line is drawn for itself, so a crossing is drawn twice."""
        c = F.col(name)
        return F.when(row & column, lined(lined(c, k), k)).when(row | column, lined(c, k)).otherwise(c).cast("int").alias(name)

    return codes(p).select(*p.keys, *(mixed(c, k) for c, k in zip(("r8", "g8", "b8"), GUIDE, strict=True)))


def mask_tint(p: PixelFrame, mask: DataFrame) -> DataFrame:
    """Code values with the masked part (weight code over 128) tinted and the rest darkened."""
    df = codes(p).join(mask.select(*KEY, F.floor(F.col("w") * 255.0 + 0.5).alias("_w")), list(KEY))
    tint = lambda c, k: F.floor(F.when(F.col("_w") > 128, F.col(c) * 0.4 + k * 0.6).otherwise(F.col(c) * 0.75) + 0.5).cast("int").alias(c)
    return df.select(*KEY, *(tint(c, k) for c, k in zip(("r8", "g8", "b8"), TINT, strict=True)))
