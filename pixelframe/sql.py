"""DuckDB SQL of the same computations, for comparing results. Each step is a select from the step before, ``{p}``."""

from __future__ import annotations

import math

import numpy as np

from .functions import numeric as N
from .operators import color, geometry, tilt

def tiles(table: str, key: str, width: int, height: int) -> str:
    """Rows by their key's place in images of this size; places without a row are there too, with nulls."""
    size = width * height
    places = f"(select unnest(range((max({key}) // {size} + 1) * {size})) k from {table})"
    return f"(select (k // {size})::INT image_id, (k % {size} // {width})::INT y, (k % {width})::INT x, {table}.* from {places} left join {table} on k = {key})"


def _orders(width: int, height: int) -> str:
    return f"""select image_id, y, x, coalesce((floor(o_totalprice)::BIGINT % 256)::INT, 0) r8, coalesce(((o_orderkey * 37) % 256)::INT, 0) g8,
  coalesce(((o_custkey * 11) % 256)::INT, 0) b8, 255 a8 from {tiles("orders", "o_orderkey", width, height)}"""


ORDERS, WIDE = _orders(32, 32), _orders(2500, 6)
EVENTS = f"""select image_id, y, x, coalesce((floor(value * 10)::BIGINT % 256)::INT, 0) r8, coalesce(((user_id * 53) % 256)::INT, 0) g8,
  coalesce(((event_id * 29) % 256)::INT, 0) b8, coalesce(((user_id * 7) % 256)::INT, 0) a8 from {tiles("events", "event_id", 32, 32)}"""
BIG = f"""select image_id, y, (x * 128 + p)::INT x, coalesce(((floor(o_totalprice)::BIGINT + p) % 256)::INT, 0) r8, coalesce(((o_orderkey * 37 + p * 2) % 256)::INT, 0) g8,
  coalesce(((o_custkey * 11 + y) % 256)::INT, 0) b8, 255 a8 from {tiles("orders", "o_orderkey", 14, 1400)}, range(128) t(p)"""


def d(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def _q(i: int) -> str:
    e = f"embedding[(p + {i}) % 64 + 1]::DOUBLE"
    return f"floor(least(greatest(({e} + {d(0.6)}) / {d(1.2)}, {d(0)}), {d(1)}) * {d(255)} + {d(0.5)})::INT"


EMB = f"select (vec_id // 50)::INT image_id, (vec_id % 50)::INT y, p::INT x, {_q(0)} r8, {_q(21)} g8, {_q(42)} b8, 255 a8 from embeddings, range(64) t(p)"
SIZES = {"orders": (32, 32), "events": (32, 32), "emb": (64, 50), "wide": (2500, 6), "big": (1792, 1400)}
RELATIONS = {"orders": ORDERS, "events": EVENTS, "emb": EMB, "wide": WIDE, "big": BIG}
KEY = "image_id, y, x"
CLAMP = "least(greatest({0}, 0::DOUBLE), 1::DOUBLE)"


def clamp(e: str) -> str:
    return CLAMP.format(e)


def nodes(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def lerp(name: str, e: str, last: int) -> str:
    at = f"({clamp(e)} * {d(last)})"
    low = f"least(floor({at})::INT, {last - 1})"
    return f"({name}[{low} + 1] + ({name}[{low} + 2] - {name}[{low} + 1]) * ({at} - {low}))"


def u8(e: str) -> str:
    return f"floor({clamp(e)} * {d(255)} + {d(0.5)})::INT"


class Chain:
    """Common table expressions, one a step."""

    def __init__(self, relation: str, space: str = "srgb", prefix: str = "t", width: int | None = None, height: int | None = None):
        self.prefix, self.parts, self.space = prefix, [], space
        self.width, self.height = SIZES.get(relation, (width, height))
        self.add(RELATIONS[relation])
        if space == "srgb":
            self.add(f"select {KEY}, r8 / {d(255)} r, g8 / {d(255)} g, b8 / {d(255)} b, a8 / {d(255)} a from {{p}}")
        else:
            self.add(f"select {KEY}, n[r8 + 1] r, n[g8 + 1] g, n[b8 + 1] b, a8 / {d(255)} a from {{p}}, (select {nodes(N.eotf_u8())} n)")

    @property
    def last(self) -> str:
        return f"{self.prefix}{len(self.parts) - 1}"

    def add(self, select: str) -> Chain:
        self.parts.append(select.replace("{p}", self.last if self.parts else ""))
        return self

    def merge(self, other: Chain) -> Chain:
        """The other chain's steps first; both keep their names."""
        self.before = [*getattr(self, "before", []), *other.named()]
        return self

    def named(self) -> list[str]:
        return [*getattr(self, "before", []), *(f"{self.prefix}{i} as (\n{s})" for i, s in enumerate(self.parts))]

    def sql(self, final: str) -> str:
        return "with recursive " + ",\n".join(self.named()) + "\n" + final.replace("{p}", self.last)

    def rgb(self, f, more: str = "", a: str = "a") -> Chain:
        return self.add(f"select {KEY}, {', '.join(f'{f(c)} {c}' for c in 'rgb')}, {a} a from {{p}}{more}")

    def to(self, space: str) -> Chain:
        if space != self.space:
            values = N.eotf_nodes() if space == "linear" else N.oetf_nodes()
            self.rgb(lambda c: lerp("n", c, 4095), f", (select {nodes(values)} n)")
            self.space = space
        return self

    def codes(self) -> str:
        self.to("srgb")
        return self.sql(f"select {KEY}, {', '.join(f'{u8(c)} {c}8' for c in 'rgba')} from {{p}}")

    # operators

    def adjust(self, brightness=0.0, contrast=0.0, saturation=0.0, sharpness=0.0) -> Chain:
        self.to("srgb")
        if brightness or contrast or saturation:
            mid = d(128 / 255)
            self.rgb(lambda c: f"({c} + {d(brightness)} - {mid}) * {d(1 + contrast)} + {mid}")
            if saturation:
                luma = f"(r * {d(0.299)} + g * {d(0.587)} + b * {d(0.114)})"
                self.rgb(lambda c: f"{luma} + ({c} - {luma}) * {d(1 + saturation)}")
            self.rgb(clamp)
        if sharpness:
            self.add(f"select *, r br, g bg, b bb from {{p}}")
            for axis in "xy":
                self.taps([0.25, 0.5, 0.25], axis, ["br", "bg", "bb"], ["r", "g", "b", "a"])
            self.rgb(lambda c: clamp(f"{c} + {d(sharpness)} * ({c} - b{c})"))
        return self

    def color_matrix(self, matrix) -> Chain:
        row = lambda i: clamp("0::DOUBLE + " + " + ".join(f"{c} * {d(matrix[5 * i + j])}" for j, c in enumerate("rgba")) + f" + {d(matrix[5 * i + 4])}")
        return self.to("srgb").add(f"select {KEY}, {row(0)} r, {row(1)} g, {row(2)} b, {row(3)} a from {{p}}")

    def tables(self, r, g, b) -> Chain:
        self.to("srgb")
        named = {c: t for c, t in zip("rgb", (r, g, b), strict=True) if t}
        extra = ", (select " + ", ".join(f"{nodes(t)} n{c}" for c, t in named.items()) + ")"
        return self.rgb(lambda c: lerp(f"n{c}", c, 255) if c in named else c, extra)

    def curves(self, master=None, red=None, green=None, blue=None) -> Chain:
        node = lambda p: N.monotone_nodes(p) if p else None
        return self.tables(*(N.composed(node(master), node(c)) for c in (red, green, blue)))

    def levels(self, **k) -> Chain:
        t = N.level_nodes(*({"in_black": 0, "in_white": 255, "gamma": 1.0, "out_black": 0, "out_white": 255} | k).values())
        return self.tables(t, t, t)

    def white_balance(self, temperature=0.0, tint=0.0) -> Chain:
        gains = dict(zip("rgb", color.white_balance_gains(temperature, tint), strict=True))
        return self.to("linear").rgb(lambda c: clamp(f"{c} * {d(gains[c])}"))

    def gradient_map(self, stops) -> Chain:
        self.to("srgb").add(f"select *, (r * {d(0.2126)} + g * {d(0.7152)} + b * {d(0.0722)}) l from {{p}}")
        at, colors = [s["position"] for s in stops], [N.hex_color(s["color"]) for s in stops]

        def channel(c):
            v = [k["rgb".index(c)] / 255 for k in colors]
            mid = " ".join(f"when l < {d(at[k + 1])} then {d(v[k])} + {d(v[k + 1] - v[k])} * ((l - {d(at[k])}) / {d(at[k + 1] - at[k])})" for k in range(len(at) - 1))
            return f"case when l <= {d(at[0])} then {d(v[0])} {mid} else {d(v[-1])} end"

        return self.rgb(channel)

    def hsl(self, **bands) -> Chain:
        names, centres = list(color.BANDS), [*color.BANDS.values(), 360.0]
        shift = {n: {k: float((bands.get(n) or {}).get(k, 0)) for k in ("hue", "saturation", "luminance")} for n in names}
        self.to("srgb").add(
            "select *, r = g and g = b gray, greatest(r, g, b) hi, least(r, g, b) lo from {p}"
        ).add(
            f"""select *, case when gray then 0 when hi = r then (g - b) / (hi - lo) + case when g < b then {d(6)} else 0 end when hi = g then (b - r) / (hi - lo) + {d(2)}
            else (r - g) / (hi - lo) + {d(4)} end * {d(60)} h, (hi + lo) / {d(2)} l from {{p}}"""
        ).add(f"select *, case when gray then 0 when l <= {d(0.5)} then (hi - lo) / (hi + lo) else (hi - lo) / ({d(2)} - hi - lo) end s from {{p}}")

        def ladder(value):
            whens = []
            for i, n in enumerate(names):
                t = f"((h - {d(centres[i])}) / {d(centres[i + 1] - centres[i])})"
                whens.append(f"when h < {d(centres[i + 1])} then {value(shift[n], shift[names[(i + 1) % 8]], t)}")
            return "case " + " ".join(whens) + f" else {value(shift['red'], shift['orange'], d(0))} end"

        mix = lambda k: ladder(lambda a, b, t: f"(1::DOUBLE - {t}) * {d(a[k])} + {t} * {d(b[k])}")
        idle = ladder(lambda a, b, t: str(not any(a.values()) and not any(b.values())).lower())
        limit = lambda e: f"least(greatest({e}, {d(-0.95)}), {d(1)})"
        self.add(f"select *, ({mix('hue')}) * {d(0.3)} dh, {limit(f'({mix("saturation")}) / {d(100)}')} fs, {limit(f'({mix("luminance")}) / {d(100)} * {d(0.5)}')} fl, gray or ({idle}) keep from {{p}}")
        turned = f"(h + dh)"
        self.add(f"select {KEY}, r, g, b, a, keep, case when {turned} % {d(360)} < 0 then {turned} % {d(360)} + {d(360)} else {turned} % {d(360)} end h, {clamp('s * (1::DOUBLE + fs)')} s, {clamp('l * (1::DOUBLE + fl)')} l from {{p}}")
        self.add(f"select *, case when l <= {d(0.5)} then {d(2)} * l * s else ({d(2)} - {d(2)} * l) * s end c, h / {d(60)} hp from {{p}}")
        self.add(f"select *, c * (1::DOUBLE - abs(hp % {d(2)} - 1::DOUBLE)) xx, l - c / {d(2)} m from {{p}}")

        def pick(order):
            part = {"c": "c", "x": "xx", "0": "0::DOUBLE"}
            whens = " ".join(f"when hp < {d(i + 1)} then {part[order[i]]}" for i in range(5))
            return clamp(f"(case {whens} else {part[order[5]]} end) + m")

        new = {"r": pick("cx00xc"), "g": pick("xccx00"), "b": pick("00xccx")}
        return self.rgb(lambda c: f"case when keep then {c} when s <= 0 then {clamp('l')} else {new[c]} end")

    def vignette(self, strength, radius=0.7, feather=0.5) -> Chain:
        w, h = self.width, self.height
        dx, dy = f"(x + {d(0.5)} - {d(w / 2)})", f"(y + {d(0.5)} - {d(h / 2)})"
        far = f"(sqrt({dx} * {dx} + {dy} * {dy}) / {d(math.sqrt(w * w + h * h) / 2)})"
        self.to("linear").add(f"select *, {clamp(f'({far} - {d(radius)}) / {d(feather)}')} t from {{p}}")
        self.add(f"select *, round((1::DOUBLE - {d(strength)} * (t * t * ({d(3)} - {d(2)} * t))) * {d(1e6)}) / {d(1e6)} k from {{p}}")
        return self.rgb(lambda c: f"{c} * k")

    def grain(self, amount, size=1, monochrome=True, seed=0) -> Chain:
        two = "18446744073709551616::UHUGEINT"
        add = lambda e, k: f"((({e})::UHUGEINT + {k}::UHUGEINT) % {two})::UBIGINT"
        mul = lambda e, k: f"((({e})::UHUGEINT * {k}::UHUGEINT) % {two})::UBIGINT"
        start = seed ^ color.GRAIN_SEED
        self.to("srgb").add(f"select *, {start}::UBIGINT z from {{p}}" if monochrome else f"select p.*, ch, {start}::UBIGINT z from {{p}} p, range(3) c(ch)")
        factors = [mul(e, k) for e, k in zip((f"x // {size}", f"y // {size}", "0" if monochrome else "ch"), color.GRAIN_FACTORS, strict=True)]
        for part in (None, *factors):
            start = "z" if part is None else f"xor(z, {part})"
            self.add(f"select * exclude (z), {add(start, 0x9E3779B97F4A7C15)} z from {{p}}")
            self.add(f"select * exclude (z), {mul('xor(z, z >> 30)', 0xBF58476D1CE4E5B9)} z from {{p}}")
            self.add(f"select * exclude (z), {mul('xor(z, z >> 27)', 0x94D049BB133111EB)} z from {{p}}")
            self.add("select * exclude (z), xor(z, z >> 31) z from {p}")
        self.add(f"select * exclude (z), round(((z >> 32)::DOUBLE / {d(4294967295)} * {d(2)} - {d(1)}) * {d(amount)} * {d(0.12)} * {d(1e6)}) / {d(1e6)} n from {{p}}")
        if monochrome:
            return self.rgb(lambda c: clamp(f"{c} + n"))
        self.add(f"select {KEY}, any_value(r) r, any_value(g) g, any_value(b) b, any_value(a) a, max(n) filter (ch = 0) n0, max(n) filter (ch = 1) n1, max(n) filter (ch = 2) n2 from {{p}} group by {KEY}")
        return self.rgb(lambda c: clamp(f"{c} + n{'rgb'.index(c)}"))

    def lut(self, cube, strength=1.0) -> Chain:
        self.to("srgb")
        n, lo, hi = cube.size, cube.domain_min, cube.domain_max
        lists = ", (select " + ", ".join(f"{nodes([r[i] for r in cube.rows])} n{i}" for i in range(3)) + ")"
        v = {c: clamp(f"({c} - {d(lo[i])}) / {d(hi[i] - lo[i])}") for i, c in enumerate("rgb")}
        if not cube.is_3d:
            return self.rgb(lambda c: f"{c} + ({clamp(lerp(f'n{"rgb".index(c)}', v[c], n - 1))} - {c}) * {d(strength)}", lists)
        self.add(f"select *, {', '.join(f'{v[c]} * {d(n - 1)} at_{c}' for c in 'rgb')} from {{p}}")
        self.add(f"select *, {', '.join(f'least(floor(at_{c})::INT, {n - 1}) i_{c}' for c in 'rgb')} from {{p}}")
        self.add(f"select *, {', '.join(f'at_{c} - i_{c} f_{c}, least(i_{c} + 1, {n - 1}) j_{c}' for c in 'rgb')} from {{p}}")
        orders = (("f_r > f_g and f_g > f_b", "rgb"), ("f_r > f_g and f_r > f_b", "rbg"), ("f_r > f_g", "brg"), ("f_b > f_g", "bgr"), ("f_b > f_r", "gbr"), ("true", "grb"))

        def node(k, upper):
            r, g, b = (f"{'j' if c in upper else 'i'}_{c}" for c in "rgb")
            return f"n{k}[({b} * {n} + {g}) * {n} + {r} + 1]"

        def value(k):
            whens = []
            for test, o in orders:
                c0, c1, c2, c3 = (node(k, o[:i]) for i in range(4))
                whens.append(f"when {test} then {c0} + f_{o[0]} * ({c1} - {c0}) + f_{o[1]} * ({c2} - {c1}) + f_{o[2]} * ({c3} - {c2})")
            return "case " + " ".join(whens) + " end"

        return self.rgb(lambda c: f"{c} + ({clamp(value('rgb'.index(c)))} - {c}) * {d(strength)}", lists)

    def bounds(self, values: dict[str, str], clip: float) -> str:
        """A join of lo and hi by image for each named value."""
        joins = ""
        for name, v in values.items():
            joins += f""" left join (select image_id, min(bin) filter (up > lim) / {d(255)} lo_{name}, max(bin) filter (down > lim) / {d(255)} hi_{name} from (
              select image_id, bin, sum(n) over (partition by image_id order by bin) up, sum(n) over (partition by image_id order by bin desc) down,
              sum(n) over (partition by image_id) * {d(clip)} / {d(100)} lim
              from (select image_id, floor({v} * {d(255)} + {d(0.5)})::INT bin, count(*) n from {self.last} group by all)) group by image_id) using (image_id)"""
        return joins

    def auto_levels(self, clip_percent=0.5, per_channel=False) -> Chain:
        self.to("srgb")
        values = {c: c for c in "rgb"} if per_channel else {"l": f"(r * {d(0.2126)} + g * {d(0.7152)} + b * {d(0.0722)})"}
        k = lambda c: c if per_channel else "l"
        return self.rgb(lambda c: f"case when hi_{k(c)} > lo_{k(c)} then {clamp(f'({c} - lo_{k(c)}) / (hi_{k(c)} - lo_{k(c)})')} else {c} end", self.bounds(values, clip_percent))

    @staticmethod
    def near(c: str, k: int, axis: str) -> str:
        if not k:
            return c
        f, end = ("lead", "last_value") if k > 0 else ("lag", "first_value")
        return f"coalesce({f}({c}, {abs(k)}) over w{axis}, {end}({c}) over e{axis})"

    WINDOWS = " window " + ", ".join(
        f"w{a} as (partition by image_id, {o} order by {a}), e{a} as (partition by image_id, {o} order by {a} rows between unbounded preceding and unbounded following)" for a, o in ("xy", "yx")
    )

    def taps(self, weights, axis, columns, others=()) -> Chain:
        r = len(weights) // 2
        total = lambda c: " + ".join(f"{self.near(c, k - r, axis)} * {d(w)}" for k, w in enumerate(weights))
        return self.add(f"select {KEY}, {', '.join([*others, *(f'{total(c)} {c}' for c in columns)])} from {{p}}{self.WINDOWS}")

    def blur(self, sigma, others=()) -> Chain:
        keep = "".join(f", {o}" for o in others)
        self.to("linear").add(f"select {KEY}, r * a r, g * a g, b * a b, a{keep} from {{p}}")
        for axis in "xy":
            self.taps(N.gaussian_weights(sigma), axis, list("rgba"), others)
        return self.add(f"select {KEY}, {', '.join(f'{self.plain(c)} {c}' for c in 'rgb')}, a{keep} from {{p}}")

    @staticmethod
    def plain(c: str, a: str = "a") -> str:
        return f"case when {a} < {d(1e-6)} then 0 else {clamp(f'{c} / {a}')} end"

    def unsharp_mask(self, amount, radius, threshold=0) -> Chain:
        self.to("linear").add(f"select *, r o_r, g o_g, b o_b, a o_a from {{p}}").blur(radius, [f"o_{c}" for c in "rgba"])
        new = lambda c: f"case when abs(o_{c} - {c}) > {d(threshold / 255)} then {clamp(f'o_{c} + {d(amount)} * (o_{c} - {c})')} else o_{c} end"
        return self.rgb(new, "", new("a"))

    def median1(self) -> Chain:
        self.to("linear").add(f"select {KEY}, {', '.join(f'[{self.near(c, -1, "x")}, {c}, {self.near(c, 1, "x")}] {c}' for c in 'rgba')} from {{p}}{self.WINDOWS}")
        mid = lambda c: f"list_sort(list_concat(list_concat({self.near(c, -1, 'y')}, {c}), {self.near(c, 1, 'y')}))[5]"
        return self.add(f"select {KEY}, {', '.join(f'{mid(c)} {c}' for c in 'rgba')} from {{p}}{self.WINDOWS}")

    def convolve(self, kernel, size, divisor=1.0, offset=0.0) -> Chain:
        self.to("linear").add(f"select *, r * a pr, g * a pg, b * a pb from {{p}}")
        half = size // 2
        row = lambda c, j: " + ".join(f"{self.near(f'p{c}', i - half, 'x')} * {d(kernel[size * j + i])}" for i in range(size))
        self.add(f"select {KEY}, a, {', '.join(f'{row(c, j)} {c}{j}' for c in 'rgb' for j in range(size))} from {{p}}{self.WINDOWS}")
        total = lambda c: " + ".join(self.near(f"{c}{j}", j - half, "y") for j in range(size))
        return self.rgb(lambda c: clamp(f"case when a < {d(1e-6)} then 0 else ({total(c)}) / {d(divisor)} / a end + {d(offset / 255)}"), self.WINDOWS)

    def pixelate(self, block, region=None) -> Chain:
        x0, y0, w, h = region or (0, 0, self.width, self.height)
        inside = f"(x between {x0} and {min(x0 + w, self.width) - 1} and y between {y0} and {min(y0 + h, self.height) - 1})"
        part = f"over (partition by image_id, {inside}, (x - {x0}) // {block}, (y - {y0}) // {block})"
        self.to("linear").add(f"select *, avg(r * a) {part} mr, avg(g * a) {part} mg, avg(b * a) {part} mb, avg(a) {part} ma from {{p}}")
        return self.rgb(lambda c: f"case when {inside} then {self.plain(f'm{c}', 'ma')} else {c} end", "", f"case when {inside} then ma else a end")

    def clone(self, sx, sy, dx, dy, radius, feather=0.0) -> Chain:
        core = max(radius - feather, 0.0)
        far = f"sqrt(((x - {dx}) * (x - {dx}) + (y - {dy}) * (y - {dy}))::DOUBLE)"
        t = clamp(f"({d(radius)} - {far}) / {d(radius - core)}") if radius > core else "1::DOUBLE"
        w = f"round(case when {far} <= {d(core)} then 1 when {far} > {d(radius)} then 0 else {t} * {t} * ({d(3)} - {d(2)} * {t}) end * {d(1e6)}) / {d(1e6)}"
        self.to("linear").add(f"select *, {w} w from {{p}}")
        # the square around the source is told twice, the second time where it goes; nothing is joined
        near = f"abs(x - {sx}) <= {radius} and abs(y - {sy}) <= {radius}"
        self.add(f"select image_id, (y + k * {dy - sy})::INT y, (x + k * {dx - sx})::INT x, k, r, g, b, a, w from (select *, unnest(case when {near} then [0, 1] else [0] end) k from {{p}})")
        of = lambda c, k: f"max({c}) filter (k = {k})"
        self.add(f"select image_id, y, x, {', '.join(f'{of(c, 0)} {c}, {of(c, 1)} q{c}' for c in 'rgba')}, {of('w', 0)} w from {{p}} group by image_id, y, x having count(*) filter (k = 0) > 0")
        new = lambda c: f"case when qr is null or w <= 0 then {c} else {c} + (q{c} - {c}) * w end"
        return self.rgb(new, "", new("a"))

    def median(self, radius) -> Chain:
        """Each pixel's neighbours as rows, edges held; the middle one by rank."""
        side, w, h = 2 * radius + 1, self.width, self.height
        self.to("linear").add(f"select image_id, y, x, least(greatest(y + j, 0), {h - 1}) v, least(greatest(x + i, 0), {w - 1}) u from {{p}}, range({-radius}, {radius + 1}) a(i), range({-radius}, {radius + 1}) b(j)")
        pixels = self.parts[-2] and f"{self.prefix}{len(self.parts) - 2}"
        mid = ", ".join(f"list_sort(list(q.{c}))[{side * side // 2 + 1}] {c}" for c in "rgba")
        return self.add(f"select p.image_id, p.y, p.x, {mid} from {{p}} p join {pixels} q on p.image_id = q.image_id and p.v = q.y and p.u = q.x group by p.image_id, p.y, p.x")

    def bicubic(self, step, width: int, height: int, border) -> Chain:
        """A gather through the inverse of ``step``: sixteen neighbours of each place, outside the image the border."""
        m = [[d(v) for v in row] for row in np.linalg.inv(np.array(step)).tolist()]
        self.to("linear").add(f"select {KEY}, r * a r, g * a g, b * a b, a from {{p}}")
        pixels = self.last
        x, y = f"(gx + {d(0.5)})", f"(gy + {d(0.5)})"
        line = lambda k: f"({m[k][0]} * {x} + {m[k][1]} * {y} + {m[k][2]})"
        self.add(f"select image_id, gy::INT y, gx::INT x, {line(0)} / {line(2)} - {d(0.5)} u, {line(1)} / {line(2)} - {d(0.5)} v from (select distinct image_id from {{p}}), range({height}) b(gy), range({width}) a(gx)")
        t = lambda e: f"case when abs({e}) <= 1 then {d(1.5)} * abs({e}) ** 3 - {d(2.5)} * abs({e}) ** 2 + 1 when abs({e}) < 2 then {d(-0.5)} * abs({e}) ** 3 + {d(2.5)} * abs({e}) ** 2 - {d(4)} * abs({e}) + 2 else 0 end"
        self.add("select *, (floor(u) + i)::INT su, (floor(v) + j)::INT sv from {p}, range(-1, 3) a(i), range(-1, 3) b(j)")
        self.add(f"select *, ({t('(u - su)')}) * ({t('(v - sv)')}) k from {{p}}")
        edge = dict(zip("rgba", [*(c * border[3] for c in border[:3]), border[3]], strict=True))
        total = ", ".join(f"{clamp(f'sum(k * coalesce(q.{c}, {d(edge[c])}))')} {c}" for c in "rgba")
        self.add(f"select p.image_id, p.y, p.x, {total} from {{p}} p left join {pixels} q on p.image_id = q.image_id and p.sv = q.y and p.su = q.x group by p.image_id, p.y, p.x")
        self.width, self.height = width, height
        return self.rgb(self.plain)

    def rotate(self, angle) -> Chain:
        step, (x, y, w, h) = geometry.rotation(self.width, self.height, angle)
        return self.bicubic(step, self.width, self.height, (1.0, 1.0, 1.0, 1.0)).crop(x, y, w, h)

    def perspective(self, **k) -> Chain:
        return self.bicubic(*geometry.perspective_step(self.width, self.height, **k), (1.0, 1.0, 1.0, 1.0))

    def heal(self, sx, sy, dx, dy, radius, feather=0.0) -> Chain:
        """Both patches with edges held, blurred; the source's detail on the target's ground, mixed in by the disc."""
        reach = min(radius, math.ceil(math.hypot(self.width, self.height)))
        weights = N.gaussian_weights(max(reach / 3.0, 0.1))
        self.to("linear")
        pixels = self.last
        span = f"range({-reach}, {reach + 1})"
        for name, (cx, cy) in (("s", (sx, sy)), ("t", (dx, dy))):
            self.add(
                f"select image_id, j::INT y, i::INT x, r * a r, g * a g, b * a b, a from (select image_id, i, j, least(greatest(i + {cx}, 0), {self.width - 1})::INT u, least(greatest(j + {cy}, 0), {self.height - 1})::INT v"
                f" from (select distinct image_id from {pixels}), {span} a(i), {span} b(j)) join (select image_id, y v, x u, r, g, b, a from {pixels}) using (image_id, v, u)"
            )
            flat = self.last
            for axis in "xy":
                self.taps(weights, axis, list("rgba"))
            self.add(f"select p.image_id, p.y, p.x, {', '.join(f'{self.plain(f"p.{c}", "p.a")} l{c}' for c in 'rgb')}, p.a la, {', '.join(f'{self.plain(f"f.{c}", "f.a")} {c}' for c in 'rgb')}, f.a a from {{p}} p join {flat} f using (image_id, y, x)")
            if name == "s":
                source = self.last
        mixed = ", ".join(f"{clamp(f's.{c} - s.l{c} + t.l{c}')} n{c}" for c in "rgba")
        self.add(f"select image_id, t.y + {dy} y, t.x + {dx} x, {mixed} from {{p}} t join {source} s using (image_id, y, x)")
        core = max(radius - feather, 0.0)
        far = f"sqrt(((x - {dx}) * (x - {dx}) + (y - {dy}) * (y - {dy}))::DOUBLE)"
        t = clamp(f"({d(radius)} - {far}) / {d(radius - core)}") if radius > core else "1::DOUBLE"
        w = f"floor(case when {far} <= {d(core)} then 1 when {far} > {d(radius)} then 0 else {t} * {t} * ({d(3)} - {d(2)} * {t}) end * {d(1e6)} + {d(0.5)}) / {d(1e6)}"
        self.add(f"select *, {w} w from {pixels} left join {{p}} using (image_id, y, x)")
        new = lambda c: f"case when n{c} is null or w <= 0 then {c} else {c} + (n{c} - {c}) * w end"
        return self.rgb(new, "", new("a"))

    def moved(self, x: str, y: str, width: int, height: int, where: str = "true") -> Chain:
        self.width, self.height = width, height
        return self.add(f"select image_id, ({y})::INT y, ({x})::INT x, r, g, b, a from {{p}} where {where}")

    def of_size(self, kind: int, width: int, height: int) -> Chain:
        """Of the images of three sizes those of one."""
        self.width, self.height = width, height
        return self.add(f"select * from {{p}} where image_id % 3 = {kind} and x < {width} and y < {height}")

    def crop(self, x, y, w, h) -> Chain:
        return self.moved(f"x - {x}", f"y - {y}", w, h, f"x between {x} and {x + w - 1} and y between {y} and {y + h - 1}")

    def pad(self, x, y, w, h, fill) -> Chain:
        self.moved(f"x + {x}", f"y + {y}", w, h)
        part = ", ".join(f"coalesce(m.{c}, {d(v)}) {c}" for c, v in zip("rgba", fill, strict=True))
        return self.add(f"select i.image_id, gy::INT y, gx::INT x, {part} from (select distinct image_id from {{p}}) i, range({h}) b(gy), range({w}) a(gx) left join {{p}} m on m.image_id = i.image_id and m.y = gy and m.x = gx")

    def resize(self, w, h) -> Chain:
        self.to("linear").add(f"select {KEY}, r * a r, g * a g, b * a b, a from {{p}}")
        for axis, size, out in (("x", self.width, w), ("y", self.height, h)):
            if size != out:
                rows = ", ".join(f"({s}, {o}, {k!r}::DOUBLE)" for o, each in enumerate(N.lanczos_taps(size, out)) for s, k in each)
                other = "y" if axis == "x" else "x"
                self.add(f"select image_id, {other}, o {axis}, {', '.join(f'sum({c} * k) {c}' for c in 'rgba')} from {{p}} join (values {rows}) v(s, o, k) on {axis} = s group by image_id, {other}, o")
        self.width, self.height = w, h
        self.add(f"select {KEY}, r, g, b, {clamp('a')} a from {{p}}")
        return self.rgb(self.plain)

    def over(self, top: Chain, mode="normal", opacity=1.0, mask: str | None = None) -> Chain:
        """``mask``: a table of (image_id, y, x, w) among the named ones."""
        self.to("srgb")
        top.to("srgb")
        self.merge(top)
        w = "m.w" if mask else "1::DOUBLE"
        self.add(
            f"select {', '.join(f'p.{k}' for k in ('image_id', 'y', 'x'))}, {', '.join(f'{clamp(f"p.{c}")} b_{c}, {clamp(f"s.{c}")} s_{c}' for c in 'rgba')}, {clamp('s.a')} * {d(opacity)} * {w} s_as"
            f" from {{p}} p join {top.last} s using (image_id, y, x)" + (f" join {mask} m using (image_id, y, x)" if mask else "")
        )
        self.add(f"select *, s_as + b_a * (1::DOUBLE - s_as) ao from {{p}}")
        mixed = self.mode(mode)
        return self.rgb(
            lambda c: f"case when s_as <= 0 then b_{c} else {clamp(f'(s_as * (1::DOUBLE - b_a) * s_{c} + s_as * b_a * ({mixed[c]}) + (1::DOUBLE - s_as) * b_a * b_{c}) / ao')} end",
            "", "case when s_as <= 0 then b_a else ao end",
        )

    def mode(self, name: str) -> dict[str, str]:
        hard = lambda b, s: f"case when {s} <= 0.5 then {b} * (2::DOUBLE * {s}) else {b} + (2::DOUBLE * {s} - 1) - {b} * (2::DOUBLE * {s} - 1) end"
        soft = lambda b, s: f"case when {s} <= 0.5 then {b} - (1::DOUBLE - 2::DOUBLE * {s}) * {b} * (1::DOUBLE - {b}) else {b} + (2::DOUBLE * {s} - 1) * (case when {b} <= 0.25 then ((16::DOUBLE * {b} - 12) * {b} + 4) * {b} else sqrt({b}) end - {b}) end"
        each = {
            "normal": lambda b, s: s, "multiply": lambda b, s: f"{b} * {s}", "screen": lambda b, s: f"{b} + {s} - {b} * {s}", "overlay": lambda b, s: hard(s, b),
            "darken": lambda b, s: f"least({b}, {s})", "lighten": lambda b, s: f"greatest({b}, {s})",
            "color_dodge": lambda b, s: f"case when {b} = 0 then 0 when {s} = 1 then 1 else least(1, {b} / (1::DOUBLE - {s})) end",
            "color_burn": lambda b, s: f"case when {b} = 1 then 1 when {s} = 0 then 0 else 1::DOUBLE - least(1, (1::DOUBLE - {b}) / {s}) end",
            "hard_light": hard, "soft_light": soft, "difference": lambda b, s: f"abs({b} - {s})", "exclusion": lambda b, s: f"{b} + {s} - 2::DOUBLE * {b} * {s}",
        }
        if name in each:
            return {c: each[name](f"b_{c}", f"s_{c}") for c in "rgb"}
        lum = lambda p: f"({p}_r * {d(0.3)} + {p}_g * {d(0.59)} + {p}_b * {d(0.11)})"
        sat = lambda p: f"(greatest({p}_r, {p}_g, {p}_b) - least({p}_r, {p}_g, {p}_b))"
        base, goal = {"hue": ("s", "b"), "saturation": ("b", "b"), "color": ("s", "b"), "luminosity": ("b", "s")}[name]
        if name in ("hue", "saturation"):
            to = sat("b") if name == "hue" else sat("s")
            self.add(f"select *, {', '.join(f'case when {sat(base)} > 0 then ({base}_{c} - least({base}_r, {base}_g, {base}_b)) * {to} / {sat(base)} else 0 end c_{c}' for c in 'rgb')} from {{p}}")
        else:
            self.add(f"select *, {', '.join(f'{base}_{c} c_{c}' for c in 'rgb')} from {{p}}")
        self.add(f"select *, {', '.join(f'c_{c} + ({lum(goal)} - {lum("c")}) t_{c}' for c in 'rgb')} from {{p}}")
        self.add(f"select *, {lum('t')} tl, least(t_r, t_g, t_b) tn, greatest(t_r, t_g, t_b) tx from {{p}}")
        self.add(f"select *, {', '.join(f'case when tn < 0 then tl + (t_{c} - tl) * tl / greatest(tl - tn, {d(1e-12)}) else t_{c} end v_{c}' for c in 'rgb')} from {{p}}")
        return {c: f"case when tx > 1 then tl + (v_{c} - tl) * (1::DOUBLE - tl) / greatest(tx - tl, {d(1e-12)}) else v_{c} end" for c in "rgb"}

    def as_mask(self, invert=False, feather=0.0) -> Chain:
        w = f"(r * {d(0.2126)} + g * {d(0.7152)} + b * {d(0.0722)})"
        self.to("srgb").add(f"select {KEY}, {f'1::DOUBLE - {w}' if invert else w} w from {{p}}")
        if feather:
            for axis in "xy":
                self.taps(N.gaussian_weights(feather), axis, ["w"])
        return self.add(f"select {KEY}, {clamp('w')} w from {{p}}")

    def resized_mask(self, w: int, h: int) -> Chain:
        """Bilinear between pixel centres, one axis after the other."""
        for axis, size, out in (("x", self.width, w), ("y", self.height, h)):
            rows = []
            for o in range(out):
                at = min(max((o + 0.5) * size / out - 0.5, 0.0), size - 1.0)
                f = N.q6(at - int(at))
                rows += [f"({int(at)}, {o}, {d(1.0 - f)})", f"({min(int(at) + 1, size - 1)}, {o}, {d(f)})"]
            other = "y" if axis == "x" else "x"
            self.add(f"select image_id, {other}, o {axis}, sum(w * k) w from {{p}} join (values {', '.join(rows)}) v(s, o, k) on {axis} = s group by image_id, {other}, o")
        self.width, self.height = w, h
        return self

    def masked(self, op, mask: Chain) -> Chain:
        """``op`` adds steps to this chain; the result is mixed with what was there before by the mask."""
        before = self.last
        op(self)
        self.merge(mask)
        new = lambda c: f"case when w = 1 then p.{c} when w = 0 then o.{c} else o.{c} + (p.{c} - o.{c}) * w end"
        return self.add(f"select p.image_id, p.y, p.x, {', '.join(f'{new(c)} {c}' for c in 'rgba')} from {{p}} p join {before} o using (image_id, y, x) join {mask.last} m using (image_id, y, x)")


def angles(**columns) -> str:
    """All tilt angles' numbers with functions of their radians, as a table."""
    rows = ", ".join(f"({i}, {', '.join(d(f(math.radians(a))) for f in columns.values())})" for i, a in enumerate(tilt.ANGLES))
    return f"(values {rows}) angles(ai, {', '.join(columns)})"


def gray(relation: str | tuple[str, int]) -> Chain:
    """Gray values that are whole code values, as gx; (relation, long edge) of smaller images."""
    relation, edge = relation if isinstance(relation, tuple) else (relation, None)
    c = Chain(relation)
    c.add(f"select {KEY}, {u8(f'(r * {d(0.2126)} + g * {d(0.7152)} + b * {d(0.0722)})')}::DOUBLE gx from {{p}}")
    if edge:
        long = max(c.width, c.height)
        w, h = (max(1, int(N.half_away(s * edge / long))) for s in (c.width, c.height))
        c.add(f"select {KEY}, gx::BIGINT * 1000000 gx from {{p}}")
        for axis, size, out, other in (("y", c.height, h, "x"), ("x", c.width, w, "y")):
            rows = ", ".join(f"({s}, {o}, {round(k * 1e9)}::BIGINT)" for o, each in enumerate(tilt.triangle_taps(size, out)) for s, k in each)
            c.add(f"select image_id, {other}, o {axis}, ((sum(gx * k) + 500000000) // 1000000000)::BIGINT gx from {{p}} join (values {rows}) v(s, o, k) on {axis} = s group by image_id, {other}, o")
        c.width, c.height = w, h
        c.add(f"select {KEY}, ((gx + 500000) // 1000000)::DOUBLE gx from {{p}}")
    return c


def sobel(relation: str | tuple[str, int]) -> Chain:
    """Gradients of gray values under a Gaussian that are whole code values."""
    c = gray(relation)
    r = math.ceil(2 * 1.4)
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * 1.4 * 1.4))
    for axis in "xy":
        c.taps((weights / weights.sum()).tolist(), axis, ["gx"])
    c.add(f"select {KEY}, least(floor(gx + {d(0.5)}), 255)::DOUBLE gx from {{p}}").add("select *, gx gy from {p}")
    w = lambda col, taps, axis: "0::DOUBLE + " + " + ".join(f"{c.near(col, k - 1, axis)} * {d(v)}" for k, v in enumerate(taps) if v)
    c.add(f"select {KEY}, {w('gx', (-1, 0, 1), 'x')} gx, {w('gy', (1, 2, 1), 'x')} gy from {{p}}{c.WINDOWS}")
    return c.add(f"select {KEY}, {w('gx', (1, 2, 1), 'y')} gx, {w('gy', (-1, 0, 1), 'y')} gy from {{p}}{c.WINDOWS}")


def thresholds(relation: str) -> Chain:
    """From the bin in which nine tenths of an image's gradients are reached."""
    c = sobel(relation).add("select image_id, least(floor(sqrt(gx * gx + gy * gy)), 1140) bin, count(*) n from {p} group by all")
    c.add("select *, sum(n) over (partition by image_id order by bin) upto, sum(n) over (partition by image_id) whole from {p}")
    c.add(f"select image_id, greatest(40, least(500, min(bin) filter (upto >= floor(whole * {d(0.9)}))))::DOUBLE high from {{p}} group by image_id")
    return c.add(f"select image_id, high * {d(0.4)} low, high from {{p}}")


def canny(relation: str) -> Chain:
    """Gradients that are greatest across the edge, and of these the weak ones that strong ones reach."""
    gradients, c = sobel(relation).last, thresholds(relation)
    least, w, h = c.last, c.width, c.height
    c.add(f"select *, sqrt(gx * gx + gy * gy) g, degrees(atan2(gy, gx)) + case when atan2(gy, gx) < 0 then 180 else 0 end angle from {gradients}")
    every = c.last
    kind = lambda *v: "case " + " ".join(f"when angle >= {lo} and angle < {lo + 45} then {k}" for lo, k in zip((22.5, 67.5, 112.5), v, strict=False)) + f" else {v[3]} end"
    c.add(f"select *, {kind(1, -1, 1, 0)} dy, {kind(1, 0, -1, -1)} dx from {{p}}")
    c.add(
        f"select p.image_id, p.y, p.x, p.gx, p.gy, p.g, high from {{p}} p join {least} using (image_id) join {every} a on a.image_id = p.image_id and a.y = p.y + p.dy and a.x = p.x + p.dx"
        f" join {every} b on b.image_id = p.image_id and b.y = p.y - p.dy and b.x = p.x - p.dx where p.g >= a.g and p.g >= b.g and p.y between 1 and {h - 2} and p.x between 1 and {w - 2} and p.g >= low"
    )
    weak, me = c.last, f"{c.prefix}{len(c.parts)}"
    c.add(
        f"select image_id, y, x from {weak} where g >= high union select q.image_id, q.y, q.x from"
        f" (select image_id, y + i y, x + j x from {me}, range(-1, 2) a(i), range(-1, 2) b(j)) e join {weak} q on q.image_id = e.image_id and q.y = e.y and q.x = e.x"
    )
    return c.add(f"select image_id, y, x, gx, gy from {{p}} join {weak} using (image_id, y, x)")


def points(c: Chain) -> Chain:
    """Points whose gradient lies near either axis, with coordinates from the image's centre."""
    limit = d(math.tan(math.radians(tilt.SPAN + tilt.SLACK)))
    c.add(f"select {KEY}, abs(gx) + abs(gy) strength, case when abs(gy) > abs(gx) and abs(gx) <= {limit} * abs(gy) then 'h' when abs(gy) <= abs(gx) and abs(gy) <= {limit} * abs(gx) and abs(gx) > 0 then 'v' end family from {{p}}")
    return c.add(f"select *, x - {d((c.width - 1) / 2)} dx, y - {d((c.height - 1) / 2)} dy from {{p}} where family is not null")


def votes(relation: str) -> Chain:
    c = points(canny(relation))
    c.add(f"select *, case when family = 'h' then -dx * s + dy * c else dx * c + dy * s end r from {{p}}, {angles(s=math.sin, c=math.cos)}")
    return c.add(f"select image_id, family, ai, (case when r < 0 then -floor({d(0.5)} - r) else floor(r + {d(0.5)}) end)::INT ri, count(*) votes from {{p}} group by all")


def lines(relation: str, floor: float) -> Chain:
    c = votes(relation)
    all_votes, bins = c.last, 2 * (math.ceil(math.hypot(c.width, c.height) / 2) + 2) + 1
    c.add(f"select image_id, family, greatest({d(0.12 * max(c.width, c.height))}, 5::DOUBLE * sum(votes) / {bins}, {d(floor)}) least from {{p}} where ai = 0 group by all")
    c.add(f"select v.* from {all_votes} v join {{p}} using (image_id, family) where votes >= least")
    c.add(
        "select p.* from {p} p where not exists (select 1 from {p} q where q.image_id = p.image_id and q.family = p.family and abs(q.ai - p.ai) <= 5 and abs(q.ri - p.ri) <= 6"
        " and (q.votes > p.votes or q.votes = p.votes and (q.ai < p.ai or q.ai = p.ai and q.ri < p.ri)))"
    )
    beside = lambda k, n: f"left join (select image_id, family, ai + {k} ai, ri, votes {n} from {all_votes}) {n} using (image_id, family, ai, ri)"
    c.add(f"select p.*, coalesce(l, 0) l, coalesce(u, 0) u from {{p}} p {beside(1, 'l')} {beside(-1, 'u')}")
    c.add(f"select *, case when ai between 1 and {len(tilt.ANGLES) - 2} and l - 2 * votes + u < 0 then greatest({d(-0.5)}, least({d(0.5)}, {d(0.5)} * (l - u) / (l - {d(2)} * votes + u))) else 0 end off from {{p}}")
    c.add(f"select image_id, family, ri, votes, ({nodes(tilt.ANGLES)})[ai + 1] + off * {d(tilt.STEP)} phi from {{p}}")
    return c.add(f"select * from (select *, row_number() over (partition by image_id order by votes desc, phi, family, ri)::INT rank from {{p}}) where rank <= {tilt.MOST_LINES}")


def angle_histogram(relation: str, floor: float) -> Chain:
    c, spread = lines(relation, floor), tilt.SPREAD / tilt.STEP
    reach = math.ceil(3 * spread)
    c.add(f"select image_id, votes, (phi + {d(tilt.SPAN)}) / {d(tilt.STEP)} pos from {{p}}")
    c.add(f"select image_id, votes, pos, (floor(pos + {d(0.5)}) + k)::INT ai from {{p}}, range({-reach}, {reach + 1}) t(k)")
    return c.add(f"select image_id, ai, sum(votes * exp({d(-0.5)} * ((ai - pos) / {d(spread)}) * ((ai - pos) / {d(spread)}))) mass from {{p}} where ai between 0 and {len(tilt.ANGLES) - 1} group by all")


def histogram_peaks(relation: str, floor: float) -> Chain:
    """Three times the best maximum that lies a degree from those before."""
    c = angle_histogram(relation, floor)
    masses, grid = c.last, f"({nodes(tilt.ANGLES)})"
    c.add(f"select i.image_id, k.ai::INT ai, coalesce(mass, 0) mass from (select distinct image_id from {masses}) i cross join range({len(tilt.ANGLES)}) k(ai) left join {masses} m on m.image_id = i.image_id and m.ai = k.ai")
    dense = c.last
    c.add("select *, coalesce(lag(mass) over (partition by image_id order by ai), 0) l, coalesce(lead(mass) over (partition by image_id order by ai), 0) u from {p}")
    c.add(f"select image_id, mass, {grid}[ai + 1] + {d(tilt.STEP)} * case when l - 2 * mass + u < 0 then greatest({d(-0.5)}, least({d(0.5)}, {d(0.5)} * (l - u) / (l - {d(2)} * mass + u))) else 0 end phi from {{p}} where mass > 0 and mass > l and mass >= u")
    tops, taken = c.last, None
    for place in (1, 2, 3):
        far = f"where not exists (select 1 from {taken} t where t.image_id = p.image_id and abs(t.phi - p.phi) < 1)" if taken else ""
        c.add(f"select image_id, {place} place, phi from (select p.*, row_number() over (partition by image_id order by mass desc, phi) k from {tops} p {far}) where k = 1" + (f" union all select * from {taken}" if taken else ""))
        taken = c.last
    return c.add(f"select t.image_id, place, phi, least(sum(mass) filter (abs({grid}[ai + 1] - phi) <= {d(tilt.PEAK_RADIUS)}) / sum(mass), 1) share from {{p}} t join {dense} using (image_id) group by all")


def line_support(relation: str, floor: float) -> Chain:
    c = histogram_peaks(relation, floor)
    found = lines(relation, floor).last
    c.add(f"select l.*, share from {found} l join (select image_id, phi top, share from {{p}} where place = 1) using (image_id) where abs(phi - top) <= {d(tilt.PEAK_RADIUS)}")
    mean = lambda of: f"sum(phi * votes) filter ({of}) / sum(votes) filter ({of})"
    means = ", ".join(f"{mean(f"family = '{f}'")} {f}" for f in "hv")
    c.add(f"select image_id, share, {mean('true')} phi, count(*) n, {means} from {{p}} group by image_id, share")
    base = f"({d(0.4)} * share + {d(0.35)} * least(n / {d(6)}, 1) + {d(0.25)} * coalesce(greatest(0, 1 - abs(h - v)), {d(0.65)}))"
    return c.add(f"select image_id, phi, n, h, v, {base} * least(n / {d(2)}, 1) confidence from {{p}}")


def projection_scores(relation: str) -> Chain:
    """Profiles of the strongest points, smoothed twice."""
    c = points(sobel(relation))
    every = c.last
    c.add("select image_id, least(floor(strength), 2048) bin, count(*) n from {p} group by all")
    c.add("select *, sum(n) over (partition by image_id order by bin desc) above, sum(n) over (partition by image_id) whole from {p}")
    c.add(f"select image_id, greatest({d(12)}, max(bin) filter (above >= least(greatest(floor(whole * {d(0.15)}), 1), 40000)), {d(0.15)} * max(bin) filter (above >= greatest(ceil(whole * {d(0.005)}), 1))) least from {{p}} group by image_id")
    tan = math.tan(math.radians(tilt.SPAN))
    half = {"h": (c.height - 1) / 2 + tan * (c.width - 1) / 2, "v": (c.width - 1) / 2 + tan * (c.height - 1) / 2}
    by = lambda f: f"case family when 'h' then {d(f(half['h']))} else {d(f(half['v']))} end"
    n = by(lambda v: math.ceil(2 * (math.ceil(v) + 2.0)) + 1)
    c.add(f"select e.image_id, family, ai, strength, (case when family = 'h' then dy - dx * t else dx + dy * t end) + {by(lambda v: math.ceil(v) + 2.0)} t from {every} e join {{p}} using (image_id), {angles(t=math.tan)} where strength >= least")
    c.add(f"select * from {{p}} where t >= 0 and floor(t) + 1 < {n}")
    c.add("select image_id, family, ai, floor(t) bin, strength * (1::DOUBLE - (t - floor(t))) w from {p} union all select image_id, family, ai, floor(t) + 1, strength * (t - floor(t)) from {p}")
    c.add("select image_id, family, ai, bin, sum(w) b from {p} group by all")
    for _ in range(2):
        c.add(f"select image_id, family, ai, bin + k bin, sum(b * v) b from {{p}}, (values (-1, {d(0.25)}), (0, {d(0.5)}), (1, {d(0.25)})) s(k, v) where bin + k >= 0 and bin + k < {n} group by image_id, family, ai, bin + k")
    return c.add("select image_id, family, ai, sum(b * b) / (sum(b) * sum(b)) score from {p} group by image_id, family, ai")
