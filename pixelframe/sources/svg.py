"""SVG drawings, rasterised with four by four samples a pixel: shapes and paths with fills, strokes, gradients and transforms.

Text, images, filters, masks, clips and patterns are not drawn; each gives a warning. Opacity of a group counts for each of its
shapes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..frame import PixelFrame, from_channels
from ..functions.numeric import hex_color

MOST_BYTES, MOST_EDGE = 16 << 20, 32768
SAMPLES = 4
#: Straight pieces of a curve.
PIECES = 24

# The basic colour keywords.
NAMES = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080",
    "fuchsia": "#ff00ff", "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080",
    "aqua": "#00ffff", "orange": "#ffa500", "currentcolor": "#000000",
}
INHERITED = ("fill", "fill-opacity", "fill-rule", "stroke", "stroke-width", "stroke-opacity", "stroke-linecap", "stroke-linejoin", "stroke-miterlimit", "color")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


class SvgError(ValueError):
    code = "invalid_svg"


def _length(text: str | None, default: float = 0.0) -> float:
    m = re.match(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(px)?\s*$", text or "")
    return float(m[1]) if m else default


def _numbers(text: str | None) -> list[float]:
    return [float(v) for v in _NUMBER.findall(text or "")]


def color_of(text: str) -> tuple[float, float, float, float] | None:
    """A colour on 0..1; None if it is none or not known."""
    t = text.strip().lower()
    if m := re.match(r"rgba?\(([^)]*)\)", t):
        parts = re.findall(r"[-+.\d]+%?", m[1])
        v = [float(p[:-1]) / 100 if p.endswith("%") else float(p) / (255 if i < 3 else 1) for i, p in enumerate(parts)]
        return tuple(min(max(x, 0.0), 1.0) for x in (*v, 1.0)[:4]) if len(v) >= 3 else None
    c = hex_color(NAMES.get(t, t))
    return None if c is None else tuple(x / 255.0 for x in c)


def transform_of(text: str | None) -> np.ndarray:
    out = np.eye(3)
    for name, inner in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = _numbers(inner)
        m = np.eye(3)
        if name == "matrix" and len(v) == 6:
            m[:2] = np.array(v).reshape(3, 2).T
        elif name == "translate" and v:
            m[:2, 2] = v[0], v[1] if len(v) > 1 else 0
        elif name == "scale" and v:
            m[0, 0], m[1, 1] = v[0], v[-1]
        elif name == "rotate" and v:
            a = math.radians(v[0])
            x, y = v[1:3] if len(v) >= 3 else (0, 0)
            c, s = math.cos(a), math.sin(a)
            m[:2] = [[c, -s, x - c * x + s * y], [s, c, y - s * x - c * y]]
        elif name == "skewX" and v:
            m[0, 1] = math.tan(math.radians(v[0]))
        elif name == "skewY" and v:
            m[1, 0] = math.tan(math.radians(v[0]))
        out = out @ m
    return out


def _bezier(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    t, p = np.linspace(0, 1, PIECES + 1)[1:, None], np.array(points)
    n = len(points) - 1
    return [tuple(q) for q in sum(math.comb(n, k) * (1 - t) ** (n - k) * t**k * p[k] for k in range(n + 1))]


def _arc(x0, y0, rx, ry, turn, large, sweep, x, y) -> list[tuple[float, float]]:
    """An elliptic arc between two points, from the ellipse's centre."""
    if not rx or not ry or (x0, y0) == (x, y):
        return [(x, y)]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    dx, dy = (x0 - x) / 2, (y0 - y) / 2
    u, v = (c * dx + s * dy) / abs(rx), (c * dy - s * dx) / abs(ry)
    far = u * u + v * v
    grow = max(1.0, math.sqrt(far))  # a radius too short for the distance grows
    rx, ry, u, v, far = abs(rx) * grow, abs(ry) * grow, u / grow, v / grow, min(far, 1.0)
    k = math.sqrt(max(0.0, 1 / far - 1)) * (1 if bool(large) != bool(sweep) else -1)
    cu, cv = k * v, -k * u  # the centre on the unit circle's plane, around the middle of the chord
    a, b = math.atan2(v - cv, u - cu), math.atan2(-v - cv, -u - cu)
    if sweep and b < a:
        b += 2 * math.pi
    if not sweep and b > a:
        b -= 2 * math.pi
    out = []
    for t in np.linspace(a, b, 2 * PIECES + 1)[1:]:
        px, py = rx * (cu + math.cos(t)), ry * (cv + math.sin(t))
        out.append((c * px - s * py + (x0 + x) / 2, s * px + c * py + (y0 + y) / 2))
    return out


def path_of(text: str) -> list[tuple[list[tuple[float, float]], bool]]:
    """Polylines of a path's data, and whether each is closed; data are read up to the first mistake."""
    words = re.findall(r"[MmLlHhVvCcSsQqTtAaZz]|" + _NUMBER.pattern, text)
    out: list[tuple[list, bool]] = []
    x = y = 0.0
    start, control, at, command, last = (0.0, 0.0), None, 0, "", ""
    line: list[tuple[float, float]] = []
    needs = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    while at < len(words):
        if words[at].isalpha():
            command = words[at]
            at += 1
        elif command in "Zz":
            break
        kind, rel = command.upper(), command.islower()
        n = needs[kind]
        if kind == "A":  # flags may stand without a space between them
            flat = " ".join(words[at:])
            m = re.match(rf"\s*({_NUMBER.pattern})\s+({_NUMBER.pattern})\s+({_NUMBER.pattern})\s+([01])\s*([01])\s*({_NUMBER.pattern})\s+({_NUMBER.pattern})", flat)
            if not m:
                break
            v = [float(g) for g in m.groups()]
            words[at:] = re.findall(r"[A-Za-z]|" + _NUMBER.pattern, flat[m.end() :])
        else:
            if at + n > len(words) or any(w.isalpha() for w in words[at : at + n]):
                break
            v = [float(w) for w in words[at : at + n]]
            at += n
        ox, oy = (x, y) if rel else (0.0, 0.0)
        if kind == "M":
            if len(line) > 1:
                out.append((line, False))
            x, y = v[0] + ox, v[1] + oy
            start, line, command = (x, y), [(x, y)], "l" if rel else "L"
        elif kind == "Z":
            if line:
                out.append((line, True))
            x, y = start
            line = [start]
        elif kind == "A":
            px, py = v[5] + ox, v[6] + oy
            line += _arc(x, y, v[0], v[1], v[2], v[3], v[4], px, py)
            x, y = px, py
        elif kind in "LHV":
            x = v[0] + ox if kind in "LH" else x
            y = v[-1] + oy if kind in "LV" else y
            line.append((x, y))
        else:
            p = [(v[i] + ox, v[i + 1] + oy) for i in range(0, n, 2)]
            if kind in "ST":
                same = last in ("CS" if kind == "S" else "QT")
                p.insert(0, (2 * x - control[0], 2 * y - control[1]) if same and control else (x, y))
            line += _bezier([(x, y), *p])
            control, (x, y) = p[-2], p[-1]
        last = kind
    if len(line) > 1:
        out.append((line, False))
    return out


def outline_of(e: ElementTree.Element, tag: str) -> list[tuple[list[tuple[float, float]], bool]] | None:
    """An element's polylines in its own coordinates; None if it is no shape."""
    get = lambda k, d=0.0: _length(e.get(k), d)
    if tag == "rect":
        x, y, w, h = get("x"), get("y"), get("width"), get("height")
        rx, ry = get("rx", get("ry")), get("ry", get("rx"))
        rx, ry = min(rx, w / 2), min(ry, h / 2)
        if w <= 0 or h <= 0:
            return []
        if rx <= 0 or ry <= 0:
            return [([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True)]
        d = f"M{x + rx} {y}L{x + w - rx} {y}A{rx} {ry} 0 0 1 {x + w} {y + ry}L{x + w} {y + h - ry}A{rx} {ry} 0 0 1 {x + w - rx} {y + h}L{x + rx} {y + h}A{rx} {ry} 0 0 1 {x} {y + h - ry}L{x} {y + ry}A{rx} {ry} 0 0 1 {x + rx} {y}Z"
        return path_of(d)
    if tag in ("circle", "ellipse"):
        rx, ry = (get("r"), get("r")) if tag == "circle" else (get("rx"), get("ry"))
        t = np.linspace(0, 2 * math.pi, 8 * PIECES, endpoint=False)
        return [(list(zip((get("cx") + rx * np.cos(t)).tolist(), (get("cy") + ry * np.sin(t)).tolist(), strict=True)), True)] if rx > 0 and ry > 0 else []
    if tag == "line":
        return [([(get("x1"), get("y1")), (get("x2"), get("y2"))], False)]
    if tag in ("polyline", "polygon"):
        v = _numbers(e.get("points"))
        return [(list(zip(v[::2], v[1::2], strict=False)), tag == "polygon")] if len(v) >= 4 else []
    return path_of(e.get("d", "")) if tag == "path" else None


def stroke_of(lines, width: float, cap: str, join: str, limit: float) -> list[list[tuple[float, float]]]:
    """Polygons that together cover a stroke, all turning the same way."""
    out: list[np.ndarray] = []
    half, round_ = width / 2, np.linspace(0, 2 * math.pi, 2 * PIECES, endpoint=False)
    disc = lambda c: c + half * np.stack([np.cos(round_), np.sin(round_)], 1)
    for points, closed in lines:
        p = np.array(points, float)
        p = p[np.concatenate([[True], np.abs(np.diff(p, axis=0)).sum(1) > 1e-9])]
        if closed and len(p) > 1 and np.allclose(p[0], p[-1]):
            p = p[:-1]
        if len(p) < 2:
            if cap == "round":
                out.append(disc(p[0]))
            continue
        ends = np.roll(p, -1, 0) if closed else p[1:]
        starts = p if closed else p[:-1]
        along = (ends - starts) / np.linalg.norm(ends - starts, axis=1)[:, None]
        side = half * np.stack([-along[:, 1], along[:, 0]], 1)
        for k, (a, b, d, n) in enumerate(zip(starts, ends, along, side, strict=True)):
            if not closed and cap == "square":
                a, b = (a - half * d if k == 0 else a), (b + half * d if k == len(starts) - 1 else b)
            out.append(np.array([a + n, b + n, b - n, a - n]))
        if not closed and cap == "round":
            out += [disc(p[0]), disc(p[-1])]
        for k in range(len(starts) if closed else len(starts) - 1):
            j = (k + 1) % len(starts)
            c, turn = ends[k], along[k][0] * along[j][1] - along[k][1] * along[j][0]
            if join == "round":
                out.append(disc(c))
                continue
            u, v = (-side[k], -side[j]) if turn > 0 else (side[k], side[j])
            corner = [c, c + u, c + v]
            cosine = float(along[k] @ along[j])
            if join != "bevel" and cosine > -1 + 1e-9 and math.sqrt(2 / (1 + cosine)) <= limit:
                corner.insert(2, c + (u + v) / (1 + cosine))
            out.append(np.array(corner))
    area = lambda q: float(np.sum(q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]))
    return [[tuple(r) for r in (q if area(q) >= 0 else q[::-1])] for q in out]


def coverage(polygons: list[np.ndarray], width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """The share of each pixel's samples inside polygons, in pixels, by the winding rule."""
    out = np.zeros((height, width))
    edges = [np.concatenate([q, np.roll(q, -1, 0)], 1) for q in polygons if len(q) > 1]
    if not edges:
        return out
    e = np.concatenate(edges)
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return out
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    way, slope = np.sign(e[:, 3] - e[:, 1]), (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    xs = (np.arange(width * SAMPLES) + 0.5) / SAMPLES
    first, last = max(0, math.floor(low.min() * SAMPLES)), min(height * SAMPLES, math.ceil(high.max() * SAMPLES) + 1)
    for row in range(first, last):
        y = (row + 0.5) / SAMPLES
        hit = (low <= y) & (y < high)
        if not hit.any():
            continue
        x = e[hit, 0] + (y - e[hit, 1]) * slope[hit]
        order = np.argsort(x)
        winding = np.concatenate([[0], np.cumsum(way[hit][order])])[np.searchsorted(x[order], xs, "right")]
        inside = winding.astype(np.int64) % 2 != 0 if even_odd else winding != 0
        out[row // SAMPLES] += inside.reshape(width, SAMPLES).sum(1)
    return out / SAMPLES**2


class _Gradient:
    """A linear or radial gradient: colours (r, g, b, a) at places in its own coordinates."""

    def __init__(self, e: ElementTree.Element, by_id: dict[str, ElementTree.Element]):
        chain = [e]
        while (ref := next((v for k, v in chain[-1].attrib.items() if k.endswith("href")), "")).startswith("#") and ref[1:] in by_id and by_id[ref[1:]] not in chain:
            chain.append(by_id[ref[1:]])
        get = lambda k, d="": next((c.get(k) for c in chain if c.get(k) is not None), d)
        self.radial = e.tag.endswith("radialGradient")
        share = lambda k, d: float(t[:-1]) / 100 if (t := get(k, d)).endswith("%") else float(_length(t))
        self.box = get("gradientUnits") != "userSpaceOnUse"
        self.turn, self.spread = transform_of(get("gradientTransform")), get("spreadMethod", "pad")
        if self.radial:
            self.c, self.r = (share("cx", "50%"), share("cy", "50%")), share("r", "50%")
            self.f = (share("fx", get("cx", "50%")), share("fy", get("cy", "50%")))
        else:
            self.a, self.b = (share("x1", "0%"), share("y1", "0%")), (share("x2", "100%"), share("y2", "0%"))
        stops = next((s for c in chain if (s := [x for x in c if x.tag.endswith("stop")])), [])
        self.at, self.colors = [], []
        for s in stops:
            style = _style(s)
            offset = style.get("offset", "0").strip()
            at = float(offset[:-1]) / 100 if offset.endswith("%") else _length(offset)
            c = color_of(style.get("stop-color", "black")) or (0, 0, 0, 1)
            self.at.append(max([min(max(at, 0.0), 1.0), *self.at[-1:]]))
            self.colors.append((*c[:3], c[3] * _length(style.get("stop-opacity"), 1.0)))

    def paint(self, matrix: np.ndarray, box: tuple[float, float, float, float], width: int, height: int) -> np.ndarray:
        if not self.at:
            return np.zeros((height, width, 4))
        own = matrix
        if self.box:
            x0, y0, x1, y1 = box
            own = own @ np.array([[x1 - x0, 0, x0], [0, y1 - y0, y0], [0, 0, 1]])
        back = np.linalg.pinv(own @ self.turn)
        ys, xs = np.indices((height, width)) + 0.5
        u, v = (back[i, 0] * xs + back[i, 1] * ys + back[i, 2] for i in (0, 1))
        if self.radial:
            fx, fy = self.f
            dx, dy, cx, cy = u - fx, v - fy, self.c[0] - fx, self.c[1] - fy
            a, b, c = self.r**2 - cx * cx - cy * cy, dx * cx + dy * cy, dx * dx + dy * dy
            t = (np.sqrt(np.maximum(b * b + a * c, 0)) - b) / a if a > 0 else np.ones_like(u)
        else:
            dx, dy = self.b[0] - self.a[0], self.b[1] - self.a[1]
            n = dx * dx + dy * dy
            t = ((u - self.a[0]) * dx + (v - self.a[1]) * dy) / n if n else np.ones_like(u)
        if self.spread == "repeat":
            t = t - np.floor(t)
        elif self.spread == "reflect":
            t = 1 - np.abs(np.mod(t, 2) - 1)
        return np.stack([np.interp(t, self.at, [c[i] for c in self.colors]) for i in range(4)], -1)


def _style(e: ElementTree.Element) -> dict[str, str]:
    """An element's attributes, those of its style attribute first."""
    return dict(e.attrib) | {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in e.get("style", "").split(";")) if v}


def _root(text: str) -> ElementTree.Element:
    if len(text) > MOST_BYTES:
        raise SvgError("drawing is larger than 16 MiB")
    if "<!ENTITY" in text:
        raise SvgError("entities are not read")
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise SvgError(str(e)) from None


def size_of(text: str) -> tuple[int, int]:
    """A drawing's own size; 0 x 0 if it has none or is damaged."""
    try:
        root = _root(text)
    except SvgError:
        return 0, 0
    box = _numbers(root.get("viewBox"))
    w, h = (_length(root.get(k), box[i] if len(box) == 4 else 0.0) for k, i in (("width", 2), ("height", 3)))
    return (round(w), round(h)) if w > 0 and h > 0 else (0, 0)


def rasterise(text: str, width: int | None = None, height: int | None = None) -> tuple[np.ndarray, list[str]]:
    """(height, width, 4) on 0..1, and warnings about what is not drawn."""
    root = _root(text)
    box = _numbers(root.get("viewBox"))
    w0, h0 = _length(root.get("width"), box[2] if len(box) == 4 else 0), _length(root.get("height"), box[3] if len(box) == 4 else 0)
    if w0 <= 0 or h0 <= 0:
        raise SvgError("drawing has no size")
    if len(box) != 4 or box[2] <= 0 or box[3] <= 0:
        box = [0.0, 0.0, w0, h0]
    w = width or (round(w0 * height / h0) if height else round(w0))
    h = height or (round(h0 * width / w0) if width else round(h0))
    if max(w, h) > MOST_EDGE or w * h > 100_000_000 or min(w, h) < 1:
        raise SvgError("raster size is out of range")
    view = np.array([[w / box[2], 0, -box[0] * w / box[2]], [0, h / box[3], -box[1] * h / box[3]], [0, 0, 1]])
    by_id = {e.get("id"): e for e in root.iter() if e.get("id")}
    out, warnings = np.zeros((h, w, 4)), []

    def painted(value: str, matrix: np.ndarray, lines) -> np.ndarray | None:
        """Colours (h, w, 4) or one colour of a paint."""
        if value.strip().lower() in ("none", "transparent"):
            return None
        if m := re.match(r"url\(\s*['\"]?#([^)'\"]+)['\"]?\s*\)", value.strip()):
            e = by_id.get(m[1])
            if e is None or not e.tag.endswith(("linearGradient", "radialGradient")):
                warnings.append(f"paint {value} is not drawn")
                return None
            flat = np.array([p for points, _ in lines for p in points])
            return _Gradient(e, by_id).paint(matrix, (*flat.min(0), *flat.max(0)), w, h)
        c = color_of(value)
        if c is None:
            warnings.append(f"fill {value} is not drawn")
        return None if c is None else np.array(c)

    def lay(cover: np.ndarray, paint: np.ndarray, opacity: float) -> None:
        cover = cover * paint[..., 3] * opacity
        a = cover + out[..., 3] * (1 - cover)
        mix = np.where(a > 0, cover / np.where(a > 0, a, 1), 0)[..., None]
        out[..., :3] = paint[..., :3] * mix + out[..., :3] * (1 - mix)
        out[..., 3] = a

    for e, tag, style, matrix, opacity in _walk(root, {}, view, 1.0, by_id, warnings):
        lines = outline_of(e, tag)
        if not lines:
            continue
        on = lambda q, m=matrix: np.array([(m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2]) for x, y in q])
        fill = painted(style.get("fill", "#000000"), matrix, lines) if tag != "line" else None
        if fill is not None:
            lay(coverage([on(p) for p, _ in lines], w, h, style.get("fill-rule") == "evenodd"), fill, opacity * _length(style.get("fill-opacity"), 1.0))
        thick = _length(style.get("stroke-width"), 1.0)
        stroke = painted(style.get("stroke", "none"), matrix, lines) if thick > 0 else None
        if stroke is not None:
            parts = stroke_of(lines, thick, style.get("stroke-linecap", "butt"), style.get("stroke-linejoin", "miter"), _length(style.get("stroke-miterlimit"), 4.0))
            if np.linalg.det(matrix[:2, :2]) < 0:
                parts = [p[::-1] for p in parts]
            lay(coverage([on(p) for p in parts], w, h), stroke, opacity * _length(style.get("stroke-opacity"), 1.0))
    return out, warnings


@dataclass(frozen=True)
class Drawing:
    """An SVG text, drawn at the size that it is asked for."""

    text: str

    def warnings(self) -> list[str]:
        return rasterise(self.text)[1]

    def frame(self, spark: SparkSession, width: int | None = None, height: int | None = None) -> PixelFrame:
        """Image 0: one task draws, and hands pixels on in parts."""
        w0, h0 = size_of(self.text)
        if not w0 and not (width and height):
            raise SvgError("drawing has no size")
        w, h = width or (round(w0 * height / h0) if height else w0), height or (round(h0 * width / w0) if width else h0)
        text = self.text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                rgba = rasterise(text, w, h)[0].reshape(-1, 4)
                ys, xs = (i.ravel() for i in np.indices((h, w)))
                for at in range(0, len(rgba), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    key = [pa.array(np.zeros(len(rgba[part]), np.int32)), pa.array(ys[part], pa.int32()), pa.array(xs[part], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*key, *(pa.array(rgba[part, i]) for i in range(4))], ["image_id", "y", "x", *"rgba"])

        pixels = spark.range(1, numPartitions=1).mapInArrow(run, "image_id int, y int, x int, r double, g double, b double, a double")
        return from_channels(pixels, w, h)


def _walk(e, inherited, matrix, opacity, by_id, warnings, depth: int = 0) -> Iterator[tuple]:
    """Shapes below an element in order: with their tags, styles, matrices and opacities."""
    if not isinstance(e.tag, str) or depth > 64:
        return
    tag, own = e.tag.rpartition("}")[2], _style(e)
    if tag in ("defs", "linearGradient", "radialGradient", "title", "desc", "metadata", "symbol", "style") or own.get("display") == "none":
        if tag == "style" and (e.text or "").strip():
            warnings.append("style is not drawn")
        return
    style = inherited | {k: own[k] for k in INHERITED if k in own and own[k] != "inherit"}
    opacity *= _length(own.get("opacity"), 1.0)
    if depth:
        matrix = matrix @ transform_of(own.get("transform"))
    for k in ("filter", "mask", "clip-path"):
        if own.get(k, "none") != "none":
            warnings.append(f"{k} is not drawn")
    if tag in ("svg", "g", "a"):
        for child in e:
            yield from _walk(child, style, matrix, opacity, by_id, warnings, depth + 1)
    elif tag == "use":
        ref = next((v for k, v in e.attrib.items() if k.endswith("href")), "")
        if (target := by_id.get(ref[1:])) is not None and ref.startswith("#"):
            moved = matrix @ transform_of(f"translate({_length(e.get('x'))} {_length(e.get('y'))})")
            yield from _walk(target, style, moved, opacity, by_id, warnings, depth + 1)
    elif tag in ("rect", "circle", "ellipse", "line", "polyline", "polygon", "path"):
        if own.get("visibility") not in ("hidden", "collapse"):
            yield e, tag, style, matrix, opacity
    else:
        warnings.append(f"{tag} is not drawn")
