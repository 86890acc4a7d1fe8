"""Operators that move pixels: permutations and crops are projections on the key, resampling works on packed tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import LINEAR, Extent, PixelFrame, grid
from ..functions import numeric as N
from . import kernels as K


def then(matrix, step) -> tuple:
    """``step`` after ``matrix``, scaled to a positive last entry."""
    m = np.array(step, float) @ np.array(matrix, float)
    return tuple(map(tuple, (m / m[2, 2] if m[2, 2] else m).tolist()))


def _moved(p: PixelFrame, x, y, to: Callable[[Extent], tuple]) -> PixelFrame:
    """Pixels at new places; ``to`` maps an extent to (width, height, step)."""
    df = p.df.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *p.ids[1:], *"rgba")
    return p.sized(df, [Extent(w, h, then(e.matrix, step)) for e in p.shapes for w, h, step in [to(e)]])


def flip(p: PixelFrame, direction: str) -> PixelFrame:
    x, y = F.col("x"), F.col("y")
    if direction == "horizontal":
        return _moved(p, p.w - 1 - x, y, lambda e: (e.width, e.height, ((-1, 0, e.width), (0, 1, 0), (0, 0, 1))))
    return _moved(p, x, p.h - 1 - y, lambda e: (e.width, e.height, ((1, 0, 0), (0, -1, e.height), (0, 0, 1))))


def quarter(p: PixelFrame, turns: int) -> PixelFrame:
    """Clockwise quarter turns."""
    for _ in range(turns % 4):
        p = _moved(p, p.h - 1 - F.col("y"), F.col("x"), lambda e: (e.height, e.width, ((0, -1, e.height), (1, 0, 0), (0, 0, 1))))
    return p


def transpose(p: PixelFrame) -> PixelFrame:
    return _moved(p, F.col("y"), F.col("x"), lambda e: (e.height, e.width, ((0, 1, 0), (1, 0, 0), (0, 0, 1))))


def orient(p: PixelFrame, orientation: int) -> PixelFrame:
    """EXIF orientation 1 to 8; 5 is the transpose and 7 the anti-transpose."""
    steps = {
        1: lambda q: q, 2: lambda q: flip(q, "horizontal"), 3: lambda q: quarter(q, 2), 4: lambda q: flip(q, "vertical"), 5: transpose,
        6: lambda q: quarter(q, 1), 7: lambda q: quarter(transpose(q), 2), 8: lambda q: quarter(q, 3),
    }
    return steps[orientation](p) if orientation in steps else p


def cropped(p: PixelFrame, boxes: Sequence[tuple[int, int, int, int]]) -> PixelFrame:
    """Of each extent its box (x, y, width, height)."""
    if all((x, y, w, h) == (0, 0, e.width, e.height) for (x, y, w, h), e in zip(boxes, p.shapes, strict=True)):
        return p
    x0, y0, x1, y1 = (p.pick(v) for v in zip(*((x, y, x + w - 1, y + h - 1) for x, y, w, h in boxes), strict=True))
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    box = iter(boxes)

    def to(e: Extent):
        x, y, w, h = next(box)
        return w, h, ((1, 0, -x), (0, 1, -y), (0, 0, 1))

    return _moved(replace(p, df=p.df.filter(inside)), F.col("x") - x0, F.col("y") - y0, to)


def padded(p: PixelFrame, places: Sequence[tuple[int, int, int, int]], color=(255, 255, 255, 255)) -> PixelFrame:
    """Each extent at (x, y) on a canvas of one colour, of (x, y, width, height)."""
    x, y = (p.pick([v[i] for v in places]) for i in (0, 1))
    place = iter(places)

    def to(e: Extent):
        x, y, w, h = next(place)
        return w, h, ((1, 0, x), (0, 1, y), (0, 0, 1))

    moved = _moved(p, F.col("x") + x, F.col("y") + y, to)
    fill = [c / 255.0 for c in color]
    if p.space == LINEAR:
        fill = [*(N.q9(N.srgb_to_linear_exact(c)) for c in fill[:3]), fill[3]]
    canvas = grid(p.images(), moved.w, moved.h)
    df = canvas.join(moved.df, list(p.keys), "left").select(*p.keys, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgba", fill, strict=True)))
    return replace(moved, df=df)


def aspect_size(width: int, height: int, ratio: tuple[int, int], pad: bool) -> tuple[int, int]:
    """A size of this ratio that a second call leaves as it is: crops shrink a side, pads grow one."""
    w, h = width, height
    for _ in range(8):
        wide = w * ratio[1] > h * ratio[0]
        if wide != pad:
            new = (max(1, int(N.half_away(h * ratio[0] / ratio[1]))), h)
        else:
            new = (w, max(1, int(N.half_away(w * ratio[1] / ratio[0]))))
        if not pad:
            new = min(new[0], w), min(new[1], h)
        else:
            new = max(new[0], w), max(new[1], h)
        if new == (w, h):
            break
        w, h = new
    return w, h


ANCHORS = {
    "top_left": (0, 0), "top": (1, 0), "top_right": (2, 0), "left": (0, 1), "center": (1, 1), "right": (2, 1), "bottom_left": (0, 2), "bottom": (1, 2),
    "bottom_right": (2, 2),
}


def crop(p: PixelFrame, aspect_ratio=None, rect=None, anchor="center", mode="crop", pad_color=None, coordinate_space="current") -> PixelFrame:
    if rect is not None:
        x, y, w, h = (int(rect[k]) for k in ("x", "y", "width", "height"))
        if coordinate_space == "source":
            return cropped(p, p.each(lambda e: source_rect(e, x, y, w, h)))
        if any(x + w > e.width or y + h > e.height or x < 0 or y < 0 for e in p.shapes):
            raise ValueError("crop rect lies outside the image")
        return cropped(p, p.each(lambda e: (x, y, w, h)))
    ratio, (i, j) = N.aspect_ratio(aspect_ratio), ANCHORS[anchor]

    def place(e: Extent) -> tuple[int, int, int, int]:
        w, h = aspect_size(e.width, e.height, ratio, mode == "pad")
        return (*((0, s // 2, s)[k] for s, k in ((abs(e.width - w), i), (abs(e.height - h), j))), w, h)

    if mode == "pad":
        return padded(p, p.each(place), N.hex_color(pad_color or "#ffffff"))
    return cropped(p, p.each(place))


def source_box(p: PixelFrame | Extent, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
    """Left, top, right and bottom, in current coordinates, of the box around a rectangle of source coordinates."""
    corners = np.array(p.matrix) @ np.array([[x, x + w, x, x + w], [y, y, y + h, y + h], [1, 1, 1, 1]], float)
    if (corners[2] <= 0).any():
        raise ValueError("crop rect reaches the horizon")
    xs, ys = corners[:2] / corners[2]
    x0, x1 = (int(N.half_away(v)) for v in (xs.min(), xs.max()))
    y0, y1 = (int(N.half_away(v)) for v in (ys.min(), ys.max()))
    return x0, y0, x1, y1


def source_rect(p: PixelFrame | Extent, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
    """That box's part inside the image, as place and size."""
    x0, y0, x1, y1 = source_box(p, x, y, w, h)
    x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, p.width), min(y1, p.height)
    if x0 >= x1 or y0 >= y1:
        raise ValueError("crop rect is empty")
    return x0, y0, x1 - x0, y1 - y0


def resize_plan(width: int, height: int, to_width=None, to_height=None, fit="cover", without_enlargement=True) -> tuple[int, int, int, int]:
    """Size after scaling, and size after the centred crop that ``cover`` needs."""
    sx = to_width / width if to_width else None
    sy = to_height / height if to_height else None
    if fit == "fill":
        w, h = to_width or width, to_height or height
        if without_enlargement:
            w, h = min(w, width), min(h, height)
        return w, h, w, h
    scale = (max if fit == "cover" else min)(s for s in (sx, sy) if s is not None)
    if without_enlargement:
        scale = min(scale, 1.0)
    w, h = max(1, int(N.half_away(width * scale))), max(1, int(N.half_away(height * scale)))
    if fit == "cover" and to_width and to_height:
        return w, h, min(w, to_width), min(h, to_height)
    return w, h, w, h


def _scaled(p: PixelFrame, sizes: Sequence[tuple[int, int]]) -> PixelFrame:
    """Every extent at another size, in linear light. An axis whose size stays is not touched."""
    p = p.to(LINEAR)
    return p.sized(K.scaled(p, sizes, N.lanczos_taps, 3.0), [Extent(w, h, then(e.matrix, ((w / e.width, 0, 0), (0, h / e.height, 0), (0, 0, 1)))) for e, (w, h) in zip(p.shapes, sizes, strict=True)])


def resize(p: PixelFrame, width=None, height=None, fit="cover", without_enlargement=True) -> PixelFrame:
    """Lanczos along x and then y, by tiles of the result with the source pixels that they are made of (``kernels.Scaling``).

    Images whose size stays are not resampled; of a frame of several sizes they are set apart.
    """
    plans = p.each(lambda e: resize_plan(e.width, e.height, width, height, fit, without_enlargement))
    if any(w * h > 100_000_000 for w, h, _, _ in plans):
        raise ValueError("resize target is larger than 100 million pixels")
    sizes = [(w, h) for w, h, _, _ in plans]
    stays = [(e.width, e.height) == s for e, s in zip(p.shapes, sizes, strict=True)]
    if not all(stays):
        if any(stays):
            same = p.pick([int(s) for s in stays]) == 1
            done = _scaled(replace(p, df=p.df.filter(~same)), sizes)
            p = replace(done, df=done.df.unionByName(replace(p, df=p.df.filter(same)).to(LINEAR).df.select(*p.keys, *"rgba")))
        else:
            p = _scaled(p, sizes)
    return cropped(p, [((e.width - w) // 2, (e.height - h) // 2, w, h) for e, (_, _, w, h) in zip(p.shapes, plans, strict=True)])


def inside(width: int, height: int, angle: float) -> tuple[float, float]:
    """The largest upright rectangle inside a turned one.

    A rectangle (a, b) lies inside if a c + b s <= width and a s + b c <= height. Under one of these alone the area is
    greatest where both terms are equal; if the other one holds there, that is the answer, else both are tight.
    """
    if angle % 90 == 0:
        return (width, height) if angle % 180 == 0 else (height, width)
    s, c = abs(math.sin(math.radians(angle))), abs(math.cos(math.radians(angle)))
    for a, b in ((height / 2 / s, height / 2 / c), (width / 2 / c, width / 2 / s)):
        if a * c + b * s <= width * (1 + 1e-12) and a * s + b * c <= height * (1 + 1e-12):
            break
    else:
        a, b = (width * c - height * s) / (c * c - s * s), (height * c - width * s) / (c * c - s * s)
    return a, b


def inscribed(width: int, height: int, angle: float) -> tuple[int, int]:
    """That rectangle in whole pixels, at most as large as the image."""
    a, b = inside(width, height, angle)
    return min(max(1, int(a + 1e-9)), width), min(max(1, int(b + 1e-9)), height)


def rotation(width: int, height: int, angle: float, crop="largest_inscribed_rect") -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """The step of a turn, and the part of its canvas that is kept: all of a larger canvas, or the inscribed rectangle of one
    as large as the image. The turn is about the pixel at (width / 2, height / 2), counted from pixel centres."""
    a = math.radians(angle)
    s, c = math.sin(a), math.cos(a)
    w, h = width, height
    if crop == "full":
        w, h = (math.ceil(width * abs(c) + height * abs(s) - 1e-9), math.ceil(width * abs(s) + height * abs(c) - 1e-9))
    to = np.array([[1, 0, w / 2 + 0.5], [0, 1, h / 2 + 0.5], [0, 0, 1]])
    back = np.array([[1, 0, -width / 2 - 0.5], [0, 1, -height / 2 - 0.5], [0, 0, 1]])
    step = to @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ back
    if crop == "full":
        return step, (0, 0, w, h)
    iw, ih = inscribed(width, height, angle)
    return step, ((w - iw) // 2, (h - ih) // 2, iw, ih)


def rotation_loss(width: int, height: int, angle: float) -> float:
    """Per cent of the pixels that a turn with the inscribed crop removes."""
    if angle % 90 == 0:
        return 0.0
    w, h = inscribed(width, height, angle)
    return (1 - w * h / (width * height)) * 100


def inside_columns(width: Column, height: Column, angle: Column) -> tuple[Column, Column]:
    """``inside`` as expressions, for angles that are no quarter turns."""
    zero = F.lit(0.0)
    s, c = (F.nullif(F.abs(f(F.radians(angle))), zero) for f in (F.sin, F.cos))
    fits = lambda a, b: (a * c + b * s <= width * (1 + 1e-12)) & (a * s + b * c <= height * (1 + 1e-12))
    flat, steep, even = (height / 2 / s, height / 2 / c), (width / 2 / c, width / 2 / s), F.nullif(c * c - s * s, zero)
    both = (width * c - height * s) / even, (height * c - width * s) / even
    return tuple(F.when(fits(*flat), flat[i]).when(fits(*steep), steep[i]).otherwise(both[i]) for i in (0, 1))


def loss_percent(width: Column, height: Column, angle: Column) -> Column:
    """Per cent of the pixels that lie outside the largest upright rectangle inside an image turned by ``angle``."""
    a, b = inside_columns(width, height, angle)
    return F.when(angle % 90 == 0, 0.0).otherwise(100.0 * N.clamp(1.0 - a * b / (width * height)))


def rotation_loss_columns(width: Column, height: Column, angle: Column) -> Column:
    """``rotation_loss`` as an expression: the same in whole pixels."""
    sides = [F.least(F.greatest(F.floor(v + 1e-9), F.lit(1)), n) for v, n in zip(inside_columns(width, height, angle), (width, height), strict=True)]
    return F.when(angle % 90 == 0, 0.0).otherwise((1 - sides[0] * sides[1] / (width * height)) * 100)


def rotate(p: PixelFrame, angle_degrees: float, crop="largest_inscribed_rect") -> PixelFrame:
    """Clockwise. Quarter turns are exact; other angles resample."""
    if angle_degrees % 90 == 0:
        return quarter(p, int(angle_degrees // 90))
    plans = p.each(lambda e: rotation(e.width, e.height, angle_degrees, crop))
    p, white = p.to(LINEAR), (1.0, 1.0, 1.0, 1.0)
    if crop == "full":
        return _warped(p, [(step, w, h) for step, (_, _, w, h) in plans], white)
    turned = _warped(p, [(step, e.width, e.height) for e, (step, _) in zip(p.shapes, plans, strict=True)], white)
    return cropped(turned, [box for _, box in plans])


def warp(p: PixelFrame, step: np.ndarray, width: int, height: int, border) -> PixelFrame:
    return _warped(p, p.each(lambda e: (step, width, height)), border)


def _warped(p: PixelFrame, plans: Sequence[tuple[np.ndarray, int, int]], border) -> PixelFrame:
    """Of each extent (step, width, height)."""
    df = K.per_window(p, [K.Warp(np.linalg.inv(step), w, h, e.width, e.height) for e, (step, w, h) in zip(p.shapes, plans, strict=True)], border)
    return p.sized(df, [Extent(w, h, then(e.matrix, step)) for e, (step, w, h) in zip(p.shapes, plans, strict=True)])


def homography(quad, width: int, height: int) -> np.ndarray:
    """The matrix from the quad's corners (clockwise from the top left) to those of a rectangle."""
    scale = max(1.0, *(abs(v) for point in quad for v in point))
    rows, right = [], []
    for (x, y), (u, v) in zip(quad, ((0, 0), (width, 0), (width, height), (0, height)), strict=True):
        x, y, u, v = x / scale, y / scale, u / scale, v / scale
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)
    to = np.diag([1 / scale, 1 / scale, 1.0])
    return np.linalg.inv(to) @ m @ to


def perspective_step(width: int, height: int, quad=None, vertical_degrees=None, horizontal_degrees=None) -> tuple[np.ndarray, int, int]:
    if quad is not None:
        d = lambda i, j: math.dist(quad[i], quad[j])
        w, h = (max(1, int(N.half_away((a + b) / 2))) for a, b in ((d(0, 1), d(3, 2)), (d(0, 3), d(1, 2))))
        return homography(quad, w, h), w, h
    f = max(width, height)
    tilt = np.array([[1, 0, 0], [0, 1, 0], [N.q6(math.tan(math.radians(horizontal_degrees or 0))) / f, N.q6(math.tan(math.radians(vertical_degrees or 0))) / f, 1]])
    centre = np.array([[1, 0, width / 2], [0, 1, height / 2], [0, 0, 1]])
    return centre @ tilt @ np.linalg.inv(centre), width, height


def perspective(p: PixelFrame, quad=None, vertical_degrees=None, horizontal_degrees=None, pad_color=None) -> PixelFrame:
    plans = p.each(lambda e: perspective_step(e.width, e.height, quad, vertical_degrees, horizontal_degrees))
    color = [c / 255.0 for c in N.hex_color(pad_color or "#ffffff")]
    border = (*(N.q9(N.srgb_to_linear_exact(c)) for c in color[:3]), color[3])
    return _warped(p.to(LINEAR), plans, border)


def padding_share(width: int, height: int, step: np.ndarray, to_width: int, to_height: int) -> float:
    """The same share for one size, in lines, without any image."""
    m, out = np.linalg.inv(step), 0
    x = np.arange(to_width) + 0.5
    for y in np.arange(to_height) + 0.5:
        with np.errstate(all="ignore"):
            d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
            u, v = ((m[i, 0] * x + m[i, 1] * y + m[i, 2]) / d for i in (0, 1))
        out += np.count_nonzero(~((d > 0) & (u >= 0) & (v >= 0) & (u < width) & (v < height)))
    return out / (to_width * to_height)


def padding_ratio(p: PixelFrame, step: np.ndarray, width: int, height: int):
    """(image_id, ratio): the share of output pixels whose source lies outside the image."""
    m = [[F.lit(float(v)) for v in row] for row in np.linalg.inv(step)]
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    d = m[2][0] * x + m[2][1] * y + m[2][2]
    u, v = ((m[i][0] * x + m[i][1] * y + m[i][2]) / d for i in (0, 1))
    outside = (d <= 0.0) | (u < 0.0) | (v < 0.0) | (u >= float(p.width)) | (v >= float(p.height))
    return grid(p.df.select("image_id").distinct(), width, height).groupBy("image_id").agg(F.avg(F.when(outside, 1.0).otherwise(0.0)).alias("ratio"))


