"""Registered queries over the pixel relations, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries, fixtures, sql
from .frame import KEY, PixelFrame, codes, from_codes
from .functions import numeric as N
from .operators import color, compare, composite, filters, geometry, masks, tilt
from .plans.compile import execute
from .plans.presets import PRESETS
from .plans.recipe_columns import hash_column, out_of_range
from .shared import written
from .sources import images, store, svg
from .sources.cube import Cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LOAD = {"orders": fixtures.orders_px, "events": fixtures.events_px, "emb": fixtures.emb_px, "wide": fixtures.wide_px, "big": fixtures.big_px}


def frame(spark: SparkSession, sf: str, relation: str, space: str = "srgb") -> PixelFrame:
    return from_codes(LOAD[relation](spark, sf), *sql.SIZES[relation], space)


def px(name: str, relation: str, run: Callable[[PixelFrame], PixelFrame], chain: Callable[[sql.Chain], sql.Chain] | None, space: str = "srgb") -> None:
    """An operator's result as code values."""
    QUERIES[name] = lambda spark, sf: codes(run(frame(spark, sf, relation, space)))
    if chain:
        ORACLES[name] = chain(sql.Chain(relation, space)).codes()


def lut_1d() -> Cube:
    return Cube(tuple((N.q6((i / 16) ** 1.3), N.q6((i / 16) ** 0.8), N.q6(1 - i / 16)) for i in range(17)), 17, False)


def lut_3d() -> Cube:
    n = 5
    rows = [(N.q6((r / 4) ** 1.2), N.q6((g + 0.5 * r) / 6), N.q6((b / 4) ** 0.7 * (1 - 0.1 * g))) for b in range(n) for g in range(n) for r in range(n)]
    return Cube(tuple(rows), n, True, (0.0, 0.0, 0.0), (1.0, 0.9, 1.0))


S_CURVE = {"master": [[0, 0], [64, 48], [192, 210], [255, 255]]}
RGB_CURVES = {"master": [[0, 8], [128, 140], [255, 250]], "red": [[0, 0], [100, 130], [255, 255]], "blue": [[20, 0], [255, 220]]}
BANDS = {"red": {"hue": 20, "saturation": 30, "luminance": -10}, "yellow": {"saturation": -40}, "blue": {"hue": -35, "saturation": 25, "luminance": 20}, "magenta": {"luminance": 60}}
STOPS = [{"position": 0.0, "color": "#0a1f3d"}, {"position": 0.4, "color": "#c33"}, {"position": 1.0, "color": "#f5ead0"}]
SHARP = [0, -1, 0, -1, 5, -1, 0, -1, 0]

px("px_sepia", "orders", lambda p: color.color_matrix(p, PRESETS["sepia"][0]["matrix"]), lambda c: c.color_matrix(PRESETS["sepia"][0]["matrix"]))
px("px_matrix_alpha", "events", lambda p: color.color_matrix(p, [0.5, 0.2, 0, 0.1, 0.05, 0, 1.1, -0.2, 0, 0, 0.1, 0.1, 0.9, 0, -0.02, 0.2, 0, 0, 0.7, 0.1]), lambda c: c.color_matrix([0.5, 0.2, 0, 0.1, 0.05, 0, 1.1, -0.2, 0, 0, 0.1, 0.1, 0.9, 0, -0.02, 0.2, 0, 0, 0.7, 0.1]))
px("px_adjust", "orders", lambda p: color.adjust(p, 0.05, 0.2, -0.3), lambda c: c.adjust(0.05, 0.2, -0.3))
px("px_adjust_sharpness", "emb", lambda p: color.adjust(p, sharpness=0.6), lambda c: c.adjust(sharpness=0.6))
px("px_curves_scurve", "emb", lambda p: color.curves(p, **S_CURVE), lambda c: c.curves(**S_CURVE))
px("px_curves_rgb", "orders", lambda p: color.curves(p, **RGB_CURVES), lambda c: c.curves(**RGB_CURVES))
px("px_levels_gamma", "orders", lambda p: color.levels(p, 12, 240, 1.4, 5, 250), lambda c: c.levels(in_black=12, in_white=240, gamma=1.4, out_black=5, out_white=250))
px("px_white_balance", "orders", lambda p: color.white_balance(p, 24, -8), lambda c: c.white_balance(24, -8), "linear")
px("px_hsl_bands", "orders", lambda p: color.hsl(p, **BANDS), lambda c: c.hsl(**BANDS))
px("px_gradient_map", "orders", lambda p: color.gradient_map(p, STOPS), lambda c: c.gradient_map(STOPS))
px("px_vignette", "emb", lambda p: color.vignette(p, 0.6, 0.5, 0.4), lambda c: c.vignette(0.6, 0.5, 0.4), "linear")
px("px_grain_mono", "orders", lambda p: color.grain(p, 0.4, 2, True, 3), lambda c: c.grain(0.4, 2, True, 3))
px("px_grain_rgb", "orders", lambda p: color.grain(p, 0.3, 1, False, 77), lambda c: c.grain(0.3, 1, False, 77))
px("px_lut1d", "orders", lambda p: color.lut(p, lut_1d(), 0.8), lambda c: c.lut(lut_1d(), 0.8))
px("px_lut3d_tetra", "orders", lambda p: color.lut(p, lut_3d(), 0.9), lambda c: c.lut(lut_3d(), 0.9))
px("px_auto_levels_luma", "emb", lambda p: color.auto_levels(p, 2.0), lambda c: c.auto_levels(2.0))
px("px_auto_levels_rgb", "emb", lambda p: color.auto_levels(p, 1.0, True), lambda c: c.auto_levels(1.0, True))
px("px_pixelate", "events", lambda p: filters.pixelate(p, 5), lambda c: c.pixelate(5), "linear")
px("px_pixelate_region", "orders", lambda p: filters.pixelate(p, 4, {"x": 3, "y": 5, "width": 50, "height": 14}), lambda c: c.pixelate(4, (3, 5, 50, 14)), "linear")
px("px_blur_sigma1", "events", lambda p: filters.blur(p, 1.0), lambda c: c.blur(1.0), "linear")
px("px_unsharp", "emb", lambda p: filters.unsharp_mask(p, 0.8, 0.9, 3), lambda c: c.unsharp_mask(0.8, 0.9, 3), "linear")
px("px_median1", "events", lambda p: filters.median(p, 1), lambda c: c.median1(), "linear")
px("px_convolve3", "events", lambda p: filters.convolve(p, SHARP, 3, 1.5, 4), lambda c: c.convolve(SHARP, 3, 1.5, 4), "linear")
for _size in (5, 7, 9):
    _kernel = [(i * 7 % 5) - 1 for i in range(_size * _size)]
    px(f"px_convolve{_size}", "emb", lambda p, k=_kernel, n=_size: filters.convolve(p, k, n, 2.0 * n * n, 3), lambda c, k=_kernel, n=_size: c.convolve(k, n, 2.0 * n * n, 3), "linear")
px("px_clone", "emb", lambda p: filters.clone(p, 12, 10, 40, 30, 9, 4.0), lambda c: c.clone(12, 10, 40, 30, 9, 4.0), "linear")
px("px_heal", "emb", lambda p: filters.heal(p, 12, 10, 40, 30, 9, 4.0), lambda c: c.heal(12, 10, 40, 30, 9, 4.0), "linear")
px("px_heal_edge", "emb", lambda p: filters.heal(p, 3, 45, 60, 2, 7), lambda c: c.heal(3, 45, 60, 2, 7), "linear")
px("px_blur_kernel", "emb", lambda p: filters.blur(p, 4.0), lambda c: c.blur(4.0), "linear")
px("px_median_kernel", "orders", lambda p: filters.median(p, 2), lambda c: c.median(2), "linear")
px("px_flip_h", "emb", lambda p: geometry.flip(p, "horizontal"), lambda c: c.moved("63 - x", "y", 64, 50))
px("px_flip_v", "emb", lambda p: geometry.flip(p, "vertical"), lambda c: c.moved("x", "49 - y", 64, 50))
TURNS = {1: ("49 - y", "x", 50, 64), 2: ("63 - x", "49 - y", 64, 50), 3: ("y", "63 - x", 50, 64)}
for _t, _m in TURNS.items():
    px(f"px_rotate{90 * _t}", "emb", lambda p, t=_t: geometry.rotate(p, 90.0 * t), lambda c, m=_m: c.moved(*m))
ORIENT = {2: ("63 - x", "y", 64, 50), 3: TURNS[2], 4: ("x", "49 - y", 64, 50), 5: ("y", "x", 50, 64), 6: TURNS[1], 7: ("49 - y", "63 - x", 50, 64), 8: TURNS[3]}
for _t, _m in ORIENT.items():
    px(f"px_orient_{_t}", "emb", lambda p, t=_t: geometry.orient(p, t), lambda c, m=_m: c.moved(*m))
px("px_crop_rect", "emb", lambda p: geometry.crop(p, rect={"x": 7, "y": 9, "width": 30, "height": 20}), lambda c: c.crop(7, 9, 30, 20))
px("px_crop_aspect", "emb", lambda p: geometry.crop(p, "16:9", anchor="top"), lambda c: c.crop(0, 0, 64, 36))
px("px_pad_aspect", "emb", lambda p: geometry.crop(p, "1:1", mode="pad", anchor="bottom", pad_color="#336699"), lambda c: c.pad(0, 14, 64, 64, [0x33 / 255, 0x66 / 255, 0x99 / 255, 1]))
px("px_crop_source_space", "emb", lambda p: geometry.crop(geometry.quarter(p, 1), rect={"x": 10, "y": 5, "width": 20, "height": 8}, coordinate_space="source"), lambda c: c.moved(*TURNS[1]).crop(37, 10, 8, 20))
px("px_resize_lanczos", "emb", lambda p: geometry.resize(p, 24, 20, "fill"), lambda c: c.resize(24, 20), "linear")
px("px_resize_cover", "emb", lambda p: geometry.resize(p, 32, 32), lambda c: c.resize(41, 32).crop(4, 0, 32, 32), "linear")
px("px_resize_alpha", "events", lambda p: geometry.resize(p, 48, fit="contain", without_enlargement=False), lambda c: c.resize(48, 48), "linear")
px("px_rotate_bicubic", "emb", lambda p: geometry.rotate(p, 10.0), lambda c: c.rotate(10.0), "linear")
px("px_perspective_keystone", "emb", lambda p: geometry.perspective(p, vertical_degrees=8.0), lambda c: c.perspective(vertical_degrees=8.0), "linear")
QUAD = [[4, 3], [60, 6], [57, 46], [2, 41]]
px("px_perspective_quad", "emb", lambda p: geometry.perspective(p, QUAD), lambda c: c.perspective(quad=QUAD), "linear")


# images of three sizes in one plan; the SQL takes them size by size
def sizes(name: str, operations: list[dict], chain: Callable[[sql.Chain], sql.Chain], space: str = "linear") -> None:
    QUERIES[name] = lambda s, d: codes(execute({"operations": operations}, fixtures.sizes_px(s, d)).frame).select(*KEY, "r8", "g8", "b8", "a8")
    ORACLES[name] = " union all ".join(f"select * from ({chain(sql.Chain('orders', space, prefix=f's{i}_').of_size(i, *size)).codes()})" for i, size in enumerate(fixtures.THREE))


def _fit(c: sql.Chain, width: int, height: int) -> sql.Chain:
    w, h, *_ = geometry.resize_plan(c.width, c.height, width, height, "contain")
    return c.resize(w, h)


def _cut(c: sql.Chain, ratio: str) -> sql.Chain:
    w, h = geometry.aspect_size(c.width, c.height, N.aspect_ratio(ratio), False)
    return c.crop((c.width - w) // 2, (c.height - h) // 2, w, h)


def _square(c: sql.Chain, fill: list[float]) -> sql.Chain:
    side = max(c.width, c.height)
    return c.pad((side - c.width) // 2, (side - c.height) // 2, side, side, fill)


sizes(
    "px_sizes_fit_cut_blur_vignette",
    [{"op": "resize", "width": 22, "height": 20, "fit": "contain"}, {"op": "crop", "aspect_ratio": "4:3"}, {"op": "blur", "sigma": 3.0}, {"op": "vignette", "strength": 0.5}],
    lambda c: _cut(_fit(c, 22, 20), "4:3").blur(3.0).vignette(0.5),
)
sizes(
    "px_sizes_turn_square_levels",
    [{"op": "rotate", "angle_degrees": 10.0}, {"op": "flip", "direction": "horizontal"}, {"op": "crop", "aspect_ratio": "1:1", "mode": "pad", "pad_color": "#000000"}, {"op": "pixelate", "block_size": 3}, {"op": "auto_levels", "clip_percent": 1.0}],
    lambda c: _square((t := c.rotate(10.0)).moved(f"{t.width} - 1 - x", "y", t.width, t.height), [0, 0, 0, 1]).pixelate(3).auto_levels(1.0),
)


_NOTHING = {"operations": [{"op": "auto_orient"}, {"op": "strip_metadata", "scope": "all"}, {"op": "encode", "format": "png"}]}
QUERIES["px_no_pixel_ops"] = lambda s, d: codes(execute(_NOTHING, LOAD["events"](s, d), 32, 32).frame)
ORACLES["px_no_pixel_ops"] = sql.EVENTS


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *(F.round(c, 6).alias(c) for c in columns))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# scalar primitives
add("px_eotf", lambda s, d: _rounded(frame(s, d, "emb").to("linear").df.drop("a"), *"rgb"), sql.Chain("emb").to("linear").sql("select image_id, y, x, round(r, 6) r, round(g, 6) g, round(b, 6) b from {p}"))
add("px_oetf", lambda s, d: _rounded(frame(s, d, "emb", "linear").to("srgb").df.drop("a"), *"rgb"), sql.Chain("emb", "linear").to("srgb").sql("select image_id, y, x, round(r, 6) r, round(g, 6) g, round(b, 6) b from {p}"))
add("px_quantize_u16", lambda s, d: frame(s, d, "events").df.select(*KEY, *(N.to_u16(F.col(c) * 0.37).alias(f"{c}16") for c in "rgba")), sql.Chain("events").sql("select image_id, y, x, " + ", ".join(f"floor({sql.clamp(f'{c} * {sql.d(0.37)}')} * {sql.d(65535)} + {sql.d(0.5)})::INT {c}16" for c in "rgba") + " from {p}"))
add("px_premultiply", lambda s, d: _rounded(filters.unpremultiplied(filters.premultiplied(frame(s, d, "events"))).df, *"rgba"), sql.Chain("events").sql("select image_id, y, x, " + ", ".join(f"round({sql.Chain.plain(f'({c} * a)')}, 6) {c}" for c in "rgb") + ", round(a, 6) a from {p}"))
add("px_histogram", lambda s, d: color.histogram(frame(s, d, "orders"), N.luma_709(F.col("r"), F.col("g"), F.col("b"))), sql.Chain("orders").sql(f"select image_id, floor((r * {sql.d(0.2126)} + g * {sql.d(0.7152)} + b * {sql.d(0.0722)}) * {sql.d(255)} + {sql.d(0.5)})::INT bin, count(*) n from {{p}} group by all"))
add("px_auto_levels_bounds", lambda s, d: color.level_bounds(frame(s, d, "emb"), F.col("r"), 1.5).select("image_id", "lo", "hi"), (_c := sql.Chain("emb")).sql(f"select image_id, (lo_r * 255)::INT lo, (hi_r * 255)::INT hi from (select distinct image_id from {{p}}){_c.bounds({'r': 'r'}, 1.5)}"))

# composites
for _mode in composite.MODES:
    add(
        f"px_blend_{_mode}",
        lambda s, d, m=_mode: codes(composite.over(frame(s, d, "orders"), frame(s, d, "events"), m, 0.6)),
        sql.Chain("orders").over(sql.Chain("events", prefix="s"), _mode, 0.6).codes(),
    )


def _three(s: SparkSession, d: str) -> DataFrame:
    base, top = frame(s, d, "orders"), frame(s, d, "events")
    middle = color.color_matrix(base, PRESETS["sepia"][0]["matrix"])
    return codes(composite.fold([(base, "normal", 1.0, None), (middle, "screen", 0.5, None), (top, "multiply", 0.8, masks.plane(top, 32, 32, True))]))


def _three_sql() -> str:
    c = sql.Chain("orders").over(sql.Chain("orders", prefix="m").color_matrix(PRESETS["sepia"][0]["matrix"]), "screen", 0.5)
    mask = sql.Chain("events", prefix="k").as_mask(True)
    return c.merge(mask).over(sql.Chain("events", prefix="s"), "multiply", 0.8, mask.last).codes()


add("px_layers_three", _three, _three_sql())
add("px_masked_curves", lambda s, d: codes(composite.masked(p := frame(s, d, "orders"), color.curves(p, **S_CURVE), masks.plane(frame(s, d, "events"), 32, 32))), sql.Chain("orders").masked(lambda c: c.curves(**S_CURVE), sql.Chain("events", prefix="k").as_mask()).codes())
add("px_mask_invert", lambda s, d: _rounded(masks.plane(frame(s, d, "events"), 32, 32, True), "w"), sql.Chain("events").as_mask(True).sql("select image_id, y, x, round(w, 6) w from {p}"))
add("px_mask_feather", lambda s, d: _rounded(masks.plane(frame(s, d, "events"), 32, 32, False, 1.5), "w"), sql.Chain("events").as_mask(False, 1.5).sql("select image_id, y, x, round(w, 6) w from {p}"))
add("px_mask_resized", lambda s, d: _rounded(masks.plane(frame(s, d, "events"), 48, 20), "w"), sql.Chain("events").as_mask().resized_mask(48, 20).sql(f"select image_id, y, x, round({sql.clamp('w')}, 6) w from {{p}}"))
add("px_flatten_white", lambda s, d: composite.flattened(frame(s, d, "events")), f"with p as ({sql.EVENTS}) select image_id, y, x, " + ", ".join(f"(({c}8 * a8 + 255 * (255 - a8) + 127) // 255)::INT {c}8" for c in "rgb") + " from p")

LOGO = '<svg xmlns="http://www.w3.org/2000/svg" width="12" height="10"><rect width="8" height="10" fill="#ff8800" fill-opacity="0.5"/><rect x="8" y="2" width="4" height="6" fill="#003366"/></svg>'


def _stamped(s: SparkSession, d: str) -> DataFrame:
    drawn = svg.rasterise(LOGO)[0]
    pixels = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), *(F.lit(float(v)).alias(c) for v, c in zip(drawn[y, x], "rgba", strict=True))) for y in range(10) for x in range(12)))
    logo = frame(s, d, "emb").df.select("image_id").distinct().select("image_id", F.explode(pixels).alias("p")).select("image_id", "p.*")
    recipe = {"operations": [{"op": "svg_overlay", "svg_revision_id": "rev_logo", "x": 5, "y": 7, "opacity": 0.8, "blend_mode": "multiply"}]}
    return codes(execute(recipe, LOAD["emb"](s, d), 64, 50, {"rev_logo": PixelFrame(logo, 12, 10)}).frame)


_at = "case when y between 7 and 16 and x between 5 and 12 then {0} when y between 9 and 14 and x between 13 and 16 then {1} else 0::DOUBLE end"
_logo = sql.Chain("emb", prefix="s").add(f"select image_id, y, x, {', '.join(f'{_at.format(sql.d(u), sql.d(v))} {c}' for c, u, v in (('r', 1, 0), ('g', 0x88 / 255, 0x33 / 255), ('b', 0, 0x66 / 255), ('a', 0.5, 1)))} from {{p}}")
add("px_svg_overlay", _stamped, sql.Chain("emb").over(_logo, "multiply", 0.8).codes())

# masks
_q6 = lambda e: f"(round(({e}) * {sql.d(1e6)}) / {sql.d(1e6)})"
_code = lambda e: f"round(floor({sql.clamp(_q6(e))} * {sql.d(255)} + {sql.d(0.5)}) / {sql.d(255)}, 6) w"


def _down(t: str, low: float, high: float) -> str:
    return f"case when {t} <= {sql.d(low)} then 1 when {t} >= {sql.d(high)} then 0 else ({sql.d(high)} - ({t})) / {sql.d(high - low)} end"


_dx, _dy = (N.q6(float(v)) for v in (np.sin(np.radians(30.0)), np.cos(np.radians(30.0))))
_along = f"({sql.d(0.5)} + (((x + {sql.d(0.5)}) / {sql.d(64)} - {sql.d(0.5)}) * {sql.d(_dx)} + ((y + {sql.d(0.5)}) / {sql.d(50)} - {sql.d(0.5)}) * {sql.d(_dy)}) / {sql.d(abs(_dx) + abs(_dy))})"
add("mask_linear", lambda s, d: _rounded(masks.linear_gradient(frame(s, d, "emb"), 30.0, 0.2, 0.8), "w"), sql.Chain("emb").sql(f"select image_id, y, x, {_code(_down(_along, 0.2, 0.8))} from {{p}}"))
_far = _q6(f"sqrt((x + {sql.d(0.5)} - {sql.d(32)}) * (x + {sql.d(0.5)} - {sql.d(32)}) + (y + {sql.d(0.5)} - {sql.d(25)}) * (y + {sql.d(0.5)} - {sql.d(25)})) / {sql.d(N.q6(0.5 * float(np.sqrt(64.0**2 + 50.0**2))))}")
add("mask_radial", lambda s, d: _rounded(masks.radial_gradient(frame(s, d, "emb"), 0.5, 0.5, 0.4, 0.4), "w"), sql.Chain("emb").sql(f"select image_id, y, x, {_code(_down(_far, 0.4, 0.8))} from {{p}}"))
_luma8 = f"({sql.u8('r')} * {sql.d(0.2126)} + {sql.u8('g')} * {sql.d(0.7152)} + {sql.u8('b')} * {sql.d(0.0722)})"
_range = f"case when l < 80 then {_down(f'80 - l', 0, 40)} when l > 150 then {_down('l - 150', 0, 40)} else 1 end"
add("mask_luminosity", lambda s, d: _rounded(masks.luminosity_range(frame(s, d, "emb"), 80, 150, 40.0), "w"), sql.Chain("emb").add(f"select {', '.join(KEY)}, {_luma8} l from {{p}}").sql(f"select image_id, y, x, {_code(_range)} from {{p}}"))
_hue = "60::DOUBLE * case when hi = r then (g - b) / (hi - lo) when hi = g then (b - r) / (hi - lo) + 2 else (r - g) / (hi - lo) + 4 end"
add("mask_color_range", lambda s, d: _rounded(masks.color_range(frame(s, d, "orders"), 200.0, 30.0, 20.0), "w"), sql.Chain("orders").add("select *, greatest(r, g, b) hi, least(r, g, b) lo from {p}").add(f"select *, case when hi - lo <= 0 or hi <= 0 then 0 when {_hue} < 0 then {_hue} + 360 else {_hue} end h, case when hi - lo <= 0 or hi <= 0 then 0 else (hi - lo) / hi end s from {{p}}").add(f"select *, case when abs(h - {sql.d(200)}) % 360 > 180 then 360 - abs(h - {sql.d(200)}) % 360 else abs(h - {sql.d(200)}) % 360 end o from {{p}}").sql(f"select image_id, y, x, {_code(f'({_down("o", 30, 50)}) * {sql.clamp(f"s / {sql.d(0.1)}")}')} from {{p}}"))
_far = _q6(f"sqrt((x + {sql.d(0.5)} - {sql.d(32)}) * (x + {sql.d(0.5)} - {sql.d(32)}) + (y + {sql.d(0.5)} - {sql.d(25)}) * (y + {sql.d(0.5)} - {sql.d(25)})) / {sql.d(N.q6(0.5 * float(np.sqrt(64.0**2 + 50.0**2))))}")
add("mask_radial_defaults", lambda s, d: _rounded(masks.generate(frame(s, d, "emb"), "radial_gradient"), "w"), sql.Chain("emb").sql(f"select image_id, y, x, {_code(_down(_far, 0.5, 0.75))} from {{p}}"))
_range16 = f"case when l < 90 then {_down('90 - l', 0, 16)} when l > 140 then {_down('l - 140', 0, 16)} else 1 end"
add("mask_luminosity_defaults", lambda s, d: _rounded(masks.generate(frame(s, d, "emb"), "luminosity_range", min=90, max=140), "w"), sql.Chain("emb").add(f"select {', '.join(KEY)}, {_luma8} l from {{p}}").sql(f"select image_id, y, x, {_code(_range16)} from {{p}}"))
add("mask_mean_weight", lambda s, d: masks.mean_weight(masks.luminosity_range(frame(s, d, "emb"), 80, 150, 40.0)), f"select image_id, round(avg(w) * 1e6) / 1e6 mean_weight from ({ORACLES['mask_luminosity'].replace('round(floor', '(floor').replace(f'/ {sql.d(255)}, 6) w', f'/ {sql.d(255)}) w')}) group by image_id")

# comparisons and guides
_pair = f"with a as ({sql.ORDERS}), b as ({sql.EVENTS}), j as (select a.image_id, a.y, a.x, abs(a.r8 - b.r8) dr, abs(a.g8 - b.g8) dg, abs(a.b8 - b.b8) db from a join b using (image_id, y, x)), k as (select *, greatest(dr, dg, db) m from j) "
add("px_diff_stats", lambda s, d: _rounded(compare.diff_stats(frame(s, d, "orders"), frame(s, d, "events")), "mean_diff", "changed"), _pair + "select image_id, round(sum(dr + dg + db) / (3 * count(*))::DOUBLE, 6) mean_diff, max(m) max_diff, round(avg(case when m > 2 then 1.0::DOUBLE else 0 end), 6) changed from k group by image_id")


def _heat(i: int) -> str:
    whens = " ".join(f"when m <= {x1} then floor({c0[i]} + {c1[i] - c0[i]} * (m - {x0}) / {sql.d(x1 - x0)} + {sql.d(0.5)})::INT" for (x0, c0), (x1, c1) in zip(compare.HEAT, compare.HEAT[1:], strict=False))
    return f"case when m <= 0 then {compare.HEAT[0][1][i]} {whens} end"


add("px_diff_heatmap", lambda s, d: compare.diff_heatmap(frame(s, d, "orders"), frame(s, d, "events")), _pair + f"select image_id, y, x, {_heat(0)} r8, {_heat(1)} g8, {_heat(2)} b8 from k")
add("px_side_by_side", lambda s, d: compare.beside(frame(s, d, "orders"), frame(s, d, "emb")), f"with a as ({sql.ORDERS}), b as ({sql.EMB}), m as (select image_id, y + 9 y, x, r8, g8, b8 from a union all select image_id, y, x + 40, r8, g8, b8 from b), i as (select image_id from a union select image_id from b) select i.image_id, gy::INT y, gx::INT x, coalesce(r8, 222) r8, coalesce(g8, 222) g8, coalesce(b8, 222) b8 from i cross join range(50) b(gy) cross join range(104) a(gx) left join m on m.image_id = i.image_id and m.y = gy and m.x = gx")
add("px_stacked", lambda s, d: compare.beside(frame(s, d, "orders"), frame(s, d, "emb"), stacked=True), f"with a as ({sql.ORDERS}), b as ({sql.EMB}), m as (select image_id, y, x + 16 x, r8, g8, b8 from a union all select image_id, y + 40, x, r8, g8, b8 from b), i as (select image_id from a union select image_id from b) select i.image_id, gy::INT y, gx::INT x, coalesce(r8, 222) r8, coalesce(g8, 222) g8, coalesce(b8, 222) b8 from i cross join range(90) b(gy) cross join range(64) a(gx) left join m on m.image_id = i.image_id and m.y = gy and m.x = gx")
for _kind, _n in (("grid", 8), ("thirds", 3), ("horizon", 12)):
    _row = f"y in ({', '.join(str(i * 50 // _n) for i in range(1, _n))})"
    _col = "false" if _kind == "horizon" else f"x in ({', '.join(str(i * 64 // _n) for i in range(1, _n))})"
    _line = lambda e, v: f"floor({e} * {sql.d(0.4)} + {sql.d(v * 0.6)} + {sql.d(0.5)})"
    add(f"px_overlay_{_kind}", lambda s, d, k=_kind: compare.guides(frame(s, d, "emb"), k), f"with p as ({sql.EMB}) select image_id, y, x, " + ", ".join(f"case when {_row} and {_col} then {_line(_line(f'{c}8', v), v)} when {_row} or {_col} then {_line(f'{c}8', v)} else {c}8 end::INT {c}8" for c, v in zip("rgb", compare.GUIDE, strict=True)) + " from p")
add("px_overlay_mask", lambda s, d: compare.mask_tint(frame(s, d, "orders"), masks.plane(frame(s, d, "events"), 32, 32)), (_m := sql.Chain("events", prefix="k").as_mask()).sql(f"select p.image_id, p.y, p.x, " + ", ".join(f"floor(case when floor(w * {sql.d(255)} + {sql.d(0.5)}) > 128 then {c}8 * {sql.d(0.4)} + {sql.d(v * 0.6)} else {c}8 * {sql.d(0.75)} end + {sql.d(0.5)})::INT {c}8" for c, v in zip("rgb", compare.TINT, strict=True)) + f" from ({sql.ORDERS}) p join {{p}} using (image_id, y, x)"))
_step, _w, _h = geometry.perspective_step(64, 50, vertical_degrees=12.0, horizontal_degrees=-5.0)
_inv = np.linalg.inv(_step).tolist()
_lin = lambda r: f"({sql.d(r[0])} * (gx + {sql.d(0.5)}) + {sql.d(r[1])} * (gy + {sql.d(0.5)}) + {sql.d(r[2])})"
add("px_perspective_padding", lambda s, d: _rounded(geometry.padding_ratio(frame(s, d, "emb"), _step, _w, _h), "ratio"), f"with p as (select distinct image_id from ({sql.EMB})), g as (select image_id, {_lin(_inv[2])} dd, {_lin(_inv[0])} / {_lin(_inv[2])} u, {_lin(_inv[1])} / {_lin(_inv[2])} v from p, range({_h}) b(gy), range({_w}) a(gx)) select image_id, round(avg(case when dd <= 0 or u < 0 or v < 0 or u >= 64 or v >= 50 then 1.0::DOUBLE else 0 end), 6) ratio from g group by image_id")

def _loss(s: SparkSession, d: str) -> DataFrame:
    """What turns of a part's size by an angle from its key lose."""
    t = s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") + 20).cast("double").alias("w"), (F.col("p_partkey") % 89 + 0.5).cast("double").alias("a"))
    return t.select("p_partkey", F.round(geometry.rotation_loss_columns(F.col("w"), F.lit(40.0), F.col("a")), 6).alias("loss"))


_turned = f"select p_partkey, (p_size + 20)::DOUBLE w, {sql.d(40)} h, sin(radians(p_partkey % 89 + {sql.d(0.5)})) s, cos(radians(p_partkey % 89 + {sql.d(0.5)})) c from part"
_fits = lambda a, b: f"{a} * c + {b} * s <= w * (1 + {sql.d(1e-12)}) and {a} * s + {b} * c <= h * (1 + {sql.d(1e-12)})"
_side = lambda one, two, both: f"case when {_fits('(h / 2 / s)', '(h / 2 / c)')} then {one} when {_fits('(w / 2 / c)', '(w / 2 / s)')} then {two} else {both} end"
add("geo_rotation_loss", _loss, f"with t as ({_turned}), r as (select p_partkey, w, h, {_side('h / 2 / s', 'w / 2 / c', '(w * c - h * s) / (c * c - s * s)')} a, {_side('h / 2 / c', 'w / 2 / s', '(h * c - w * s) / (c * c - s * s)')} b from t) select p_partkey, round((1 - least(greatest(1, floor(a + {sql.d(1e-9)})), w) * least(greatest(1, floor(b + {sql.d(1e-9)})), h) / (w * h)) * 100, 6) loss from r")

# tilt: each step of the estimate
_FLOOR = 10.0  # of votes; the images are small
_gray = lambda s, d: tilt.gray(frame(s, d, "emb"))
_gradients = lambda s, d: tilt.gradients(_gray(s, d))
_points = lambda s, d: tilt.edge_points(tilt.canny_edges(_gray(s, d)))
_lines = lambda s, d: written(tilt.lines(_points(s, d), 64, 50, _FLOOR), "lines")


def _support(s: SparkSession, d: str) -> DataFrame:
    found = _lines(s, d)
    return tilt.line_support(found, tilt.histogram_peaks(tilt.angle_histogram(found)))


add("tilt_sobel", _gradients, sql.sobel("emb").sql("select image_id, y, x, gx, gy from {p}"))
add("tilt_canny_thresholds", lambda s, d: tilt.canny_thresholds(_gradients(s, d)), sql.thresholds("emb").sql("select image_id, low, high from {p}"))
add("tilt_canny", lambda s, d: tilt.canny_edges(_gray(s, d), 24), sql.canny("emb").sql("select image_id, y, x, gx, gy from {p}"))
add("tilt_edge_family", _points, sql.points(sql.canny("emb")).sql("select image_id, y, x, family, strength from {p}"))
add("tilt_hough_votes", lambda s, d: tilt.hough_votes(_points(s, d), 64, 50), sql.votes("emb").sql("select image_id, family, ai, ri, votes from {p}"))
add("tilt_nms", lambda s, d: _rounded(_lines(s, d), "phi"), sql.lines("emb", _FLOOR).sql("select image_id, family, round(phi, 6) phi, votes, rank from {p}"))
add("tilt_angle_hist", lambda s, d: _rounded(tilt.angle_histogram(_lines(s, d)), "mass"), sql.angle_histogram("emb", _FLOOR).sql("select image_id, ai, round(mass, 6) mass from {p}"))
add("tilt_peaks", lambda s, d: _rounded(tilt.histogram_peaks(tilt.angle_histogram(_lines(s, d))), "phi", "share"), sql.histogram_peaks("emb", _FLOOR).sql("select image_id, place, round(phi, 6) phi, round(share, 6) share from {p}"))
add("tilt_support", lambda s, d: _rounded(_support(s, d), "phi", "h", "v", "confidence"), sql.line_support("emb", _FLOOR).sql("select image_id, n, round(phi, 6) phi, round(h, 6) h, round(v, 6) v, round(confidence, 6) confidence from {p}"))
add("tilt_projection_score", lambda s, d: _rounded(tilt.projection_scores(tilt.strong_points(tilt.edge_points(_gradients(s, d))), 64, 50), "score"), sql.projection_scores("emb").sql("select image_id, family, ai, round(score, 6) score from {p}"))
_BIG = 1024  # the working size and the floor of votes as they are


def _big_lines(s: SparkSession, d: str) -> DataFrame:
    small = tilt.shrunk(tilt.gray(frame(s, d, "big")), _BIG)
    return _rounded(tilt.lines(tilt.edge_points(tilt.canny_edges(small)), small.width, small.height), "phi")


add("tilt_shrunk", lambda s, d: tilt.shrunk(tilt.gray(frame(s, d, "big")), _BIG).df.select(*KEY, "v"), sql.gray(("big", _BIG)).sql("select image_id, y, x, gx v from {p}"))
add("tilt_big_lines", _big_lines, sql.lines(("big", _BIG), 24.0).sql("select image_id, family, round(phi, 6) phi, votes, rank from {p}"))
add("tilt_detect", lambda s, d: tilt.detect(frame(s, d, "emb")), None)

# presets whose operations are all expressible
PRESET_SQL = {
    "architecture_clean": ("srgb", lambda c: c.auto_levels(0.5).unsharp_mask(0.5, 1.2, 2).adjust(saturation=-0.05)),
    "cinema_teal_orange": ("srgb", lambda c: c.hsl(**{k: v for k, v in PRESETS["cinema_teal_orange"][0].items() if k != "op"}).adjust(contrast=0.08)),
    "duotone_navy_cream": ("srgb", lambda c: c.gradient_map(PRESETS["duotone_navy_cream"][0]["stops"])),
    "food_vivid": ("srgb", lambda c: c.hsl(**{k: v for k, v in PRESETS["food_vivid"][0].items() if k != "op"}).adjust(contrast=0.1)),
    "grain_fine": ("srgb", lambda c: c.grain(0.1, 1, True, 0)),
    "landscape_punch": ("srgb", lambda c: c.adjust(contrast=0.15, saturation=0.18).vignette(0.22, 0.65, 0.5)),
    "matte_fade": ("srgb", lambda c: c.curves([[0, 28], [128, 132], [255, 238]]).adjust(saturation=-0.12)),
    "portrait_soft": ("srgb", lambda c: c.curves([[0, 12], [128, 130], [255, 244]]).adjust(saturation=-0.08).vignette(0.18, 0.75, 0.55)),
    "product_clean": ("linear", lambda c: c.white_balance(3, -2).levels(in_black=6, in_white=249, gamma=1.05).unsharp_mask(0.6, 1.0, 3)),
    "product_white": ("srgb", lambda c: c.auto_levels(0.3).white_balance(2, -1).unsharp_mask(0.6, 1.0, 3)),
    "soft_vignette": ("linear", lambda c: c.vignette(0.2)),
    "film_warm": ("linear", lambda c: c.white_balance(14, -2).curves(PRESETS["film_warm"][1]["master"]).grain(0.08, 1, True, 1)),
    "film_cool": ("linear", lambda c: c.white_balance(-14, 2).curves(PRESETS["film_cool"][1]["master"]).grain(0.08, 1, True, 2)),
    "film_grain_strong": ("srgb", lambda c: c.curves(PRESETS["film_grain_strong"][0]["master"]).grain(0.4, 2, True, 3)),
    "film_soft": ("srgb", lambda c: c.curves(PRESETS["film_soft"][0]["master"]).color_matrix(PRESETS["film_soft"][1]["matrix"])),
    **{n: ("srgb", lambda c, n=n: c.color_matrix(PRESETS[n][0]["matrix"])) for n in ("bw_neutral", "bw_red_filter", "grayscale", "sepia")},
    **{n: ("srgb", lambda c, n=n: c.color_matrix(PRESETS[n][0]["matrix"]).curves(PRESETS[n][1]["master"])) for n in ("bw_high_contrast", "bw_soft")},
}


def preset(name: str, relation: str = "orders") -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: codes(execute(name, LOAD[relation](s, d), *sql.SIZES[relation]).frame)


for _name, (_space, _chain) in PRESET_SQL.items():
    add(f"preset_{_name}", preset(_name), _chain(sql.Chain("orders", _space)).codes())
add("preset_web_optimize", preset("web_optimize", "wide"), sql.Chain("wide", "linear").resize(2000, 5).codes())
add("preset_hero_2400", preset("hero_2400", "wide"), sql.Chain("wide", "linear").resize(2400, 6).codes())
#: Of the presets that cut and scale: the cut's size and the result's.
SOCIAL = {
    "eyecatch_16_9": ((1792, 1008), (1600, 900)), "instagram_portrait_4_5": ((1120, 1400), (1080, 1350)), "instagram_square_1080": ((1400, 1400), (1080, 1080)),
    "og_1200x630": ((1792, 941), (1200, 630)), "thumbnail_square": ((1400, 1400), (800, 800)), "x_wide_16_9": ((1792, 1008), (1600, 900)),
    "youtube_thumb_1280x720": ((1792, 1008), (1280, 720)),
}


def _social(cut: tuple[int, int], size: tuple[int, int]) -> str:
    return sql.Chain("big", "linear").crop((1792 - cut[0]) // 2, (1400 - cut[1]) // 2, *cut).resize(*size).codes()


for _name, _sizes in SOCIAL.items():
    add(f"preset_{_name}", preset(_name, "big"), _social(*_sizes))

# the ledger's operations on the driver's tables
DOCS = "select doc_id, coalesce(text, '') as text from documents"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


add("store_import_dedup", lambda s, d: store.first_by(_docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_size")), "sha256", "doc_id"), f"select sha256(text) sha256, min(doc_id) doc_id, any_value(strlen(text)) byte_size from ({DOCS}) group by 1")
_LINES = r"list_filter(list_transform(string_split_regex(substr(coalesce(html, ''), 1, 65536), '\r?\n'), lambda x: upper(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '' and not starts_with(x, '#'))[1:16]"
add("store_sniff", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", images.sniff(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("kind")), f"select page_id, case when ends_with(lower(coalesce(url, '')), '.cube') or len(list_filter({_LINES}, lambda x: starts_with(x, 'LUT_1D_SIZE') or starts_with(x, 'LUT_3D_SIZE'))) > 0 then 'lut' when ends_with(lower(coalesce(url, '')), '.svg') or contains(substr(coalesce(html, ''), 1, 4096), '<svg') then 'svg' else 'raster' end kind from pages")
add("store_object_path", lambda s, d: _docs(s, d).select("doc_id", store.object_path(F.sha2("text", 256), F.when(F.col("doc_id") % 2 == 0, "image/png").otherwise("text/plain")).alias("rel_path")), f"select doc_id, 'objects/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || case when doc_id % 2 = 0 then '.png' else '.bin' end rel_path from ({DOCS})")
add("store_preview_key", lambda s, d: _docs(s, d).select("doc_id", store.preview_key(F.concat(F.lit("rev_"), F.col("doc_id").cast("string")), F.sha2("text", 256), "grid").alias("preview_key")), f"select doc_id, substr(sha256('rev_' || doc_id || chr(0) || sha256(text) || chr(0) || 'grid' || chr(0)), 1, 32) preview_key from ({DOCS})")


def _turns(s: SparkSession, d: str) -> DataFrame:
    t = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn")
    name = lambda k: F.concat(F.lit("rev_"), F.col("conv_id").cast("string"), F.lit("_"), k.cast("string"))
    return t.select(name(F.col("turn")).alias("revision_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("source_revision_id"))


def _lineage(s: SparkSession, d: str) -> DataFrame:
    last = _turns(s, d).agg(F.max("revision_id")).first()[0]
    return store.lineage(_turns(s, d), last).select("revision_id", "depth")


_TURNS = "select 'rev_' || conv_id || '_' || turn revision_id, case when turn > 0 then 'rev_' || conv_id || '_' || (turn - 1) end source_revision_id from conversations"
add("store_lineage", _lineage, f"with recursive e as ({_TURNS}), up(revision_id, source_revision_id, depth) as (select *, 0 from e where revision_id = (select max(revision_id) from e) union all select e.*, depth + 1 from up join e on e.revision_id = up.source_revision_id) select revision_id, depth from up")
add("store_lineage_all", lambda s, d: store.lineages(_turns(s, d)), f"with recursive e as ({_TURNS}), up(revision_id, root, parent, depth) as (select revision_id, revision_id, source_revision_id, 0 from e union all select up.revision_id, up.parent, e.source_revision_id, depth + 1 from up left join e on e.revision_id = up.parent where up.parent is not null) select revision_id, root, depth::BIGINT depth from up where parent is null")


def _memo_hits(s: SparkSession, d: str) -> DataFrame:
    """Every turn's answer asked for again, by a recipe that follows from its source; also by another recipe and of another engine."""
    source = F.col("source_revision_id")
    turns = _turns(s, d).withColumn("recipe_hash", F.sha2(source, 256)).withColumn("ledger_seq", F.col("revision_id"))
    rows = turns.withColumn("engine_version", F.lit(store.ENGINE_VERSION))
    rows = rows.unionByName(turns.withColumns({"engine_version": F.lit("another"), "revision_id": F.lit(""), "ledger_seq": F.lit("")}))
    asked = turns.select(source, F.explode(F.array("recipe_hash", F.sha2("recipe_hash", 256))).alias("recipe_hash")).distinct()
    return store.memo(rows, asked).select("source_revision_id", "revision_id")


add("store_memo_hits", _memo_hits, f"select source_revision_id, min(revision_id) revision_id from ({_TURNS}) where source_revision_id is not null group by 1")


def _list_order(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet").select("user_id", F.col("user_id").alias("asset_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("ledger_seq"))
    return store.placed(rows).select(F.col("ledger_seq").alias("event_id"), "user_id", "place")


add("store_list_order", _list_order, "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) place from events")


def _hashes(s: SparkSession, d: str) -> DataFrame:
    """The hash of a recipe that each document's columns make, as one JSON text with fields in any order and defaults left out."""
    k, n = F.col("doc_id"), F.col("n_chars")
    number = lambda c: c.cast("string")
    text = F.concat(
        F.lit('{"operations": [{"strength": '), number(k % 1000 / 1000), F.lit(', "op": "vignette", "radius": '), number(n % 15 / 10), F.lit('}, {"op": "levels", "in_black": '), number(n % 200),
        F.lit(', "gamma": '), number(1 + k % 7 / 8), F.lit('}, {"op": "lut", "lut_revision_id": "rev_'), F.coalesce("lang", F.lit("")), F.lit('"}, {"op": "crop", "rect": {"width": '), number(n % 9 + 1),
        F.lit(', "height": 4, "y": 2, "x": '), number(k % 11), F.lit("}}]}"),
    )
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", hash_column(text).alias("recipe_hash"))


_frac = lambda e: f"(({e})::DOUBLE)::VARCHAR"
add("store_recipe_hash", _hashes, f"""select doc_id, sha256('{{"operations":[{{"feather":0.5,"op":"vignette","radius":' || {_frac('n_chars % 15 / 10')} || ',"strength":' || {_frac('doc_id % 1000 / 1000')} || '}},{{"gamma":' || {_frac('1 + doc_id % 7 / 8')}
  || ',"in_black":' || (n_chars % 200) || ',"in_white":255,"op":"levels","out_black":0,"out_white":255}},{{"lut_revision_id":"rev_' || coalesce(lang, '') || '","op":"lut","strength":1.0}},{{"anchor":"center","mode":"crop","op":"crop","rect":{{"height":4,"width":'
  || (n_chars % 9 + 1) || ',"x":' || (doc_id % 11) || ',"y":2}}}}]}}') recipe_hash from documents""")


def _faults(s: SparkSession, d: str) -> DataFrame:
    """Every parameter outside its range in recipes of two layers that each document's columns make."""
    number = lambda c: c.cast("string")
    k, n = F.col("doc_id"), F.col("n_chars")
    text = F.concat(
        F.lit('{"operations": [{"op": "vignette", "strength": '), number((k % 1000 - 480) / 400), F.lit(', "radius": '), number(n % 20 / 10), F.lit('}, {"op": "median", "radius": '), number(n % 20), F.lit('}, {"op": "flip", "direction": "'),
        F.when(k % 3 == 0, "vertical").otherwise(F.coalesce("lang", F.lit(""))), F.lit('"}], "layers": [{"source": "base"}, {"source": "base", "ops": [{"op": "convolve", "kernel": [1], "size": '), number(k % 10), F.lit('}, {"op": "blur", "sigma": '), number(n % 103), F.lit("}]}]}"),
    )
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(out_of_range(text)).alias("f"))
    return rows.select("doc_id", F.coalesce("f.layer", F.lit(-1)).alias("layer"), "f.index", "f.op", "f.field")


_WRONG = (
    ("doc_id % 1000 < 80 or doc_id % 1000 > 880", -1, 0, "vignette", "strength"), ("n_chars % 20 > 15", -1, 0, "vignette", "radius"), ("n_chars % 20 not between 1 and 16", -1, 1, "median", "radius"),
    ("doc_id % 3 <> 0", -1, 2, "flip", "direction"), ("doc_id % 10 not in (3, 5, 7, 9)", 1, 0, "convolve", "size"), ("n_chars % 103 not between 1 and 100", 1, 1, "blur", "sigma"),
)
add("store_recipe_faults", _faults, " union all ".join(f"select doc_id, {layer} layer, {i} as index, '{op}' op, '{field}' field from documents where {when}" for when, layer, i, op, field in _WRONG))


QUERIES |= file_queries.QUERIES
ORACLES |= file_queries.ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A film look, stretched, as means of each image's channels."""
    from .plans.recipe import canonical, parse

    recipe = canonical(parse({"operations": [*PRESETS["film_warm"], {"op": "auto_levels"}]}))
    p = execute(recipe, fixtures.orders_px(spark, sf_dir), 32, 32).frame
    return codes(p).groupBy("image_id").agg(*(F.round(F.avg(f"{c}8"), 6).alias(f"mean_{c}") for c in "rgb"))


def _entry_sql() -> str:
    c = sql.Chain("orders", "linear").white_balance(14, -2).curves(PRESETS["film_warm"][1]["master"]).grain(0.08, 1, True, 1).auto_levels()
    return c.sql("select image_id, " + ", ".join(f"round(avg({sql.u8(k)}), 6) mean_{k}" for k in "rgb") + " from {p} group by image_id")


add("flagship_film", entry, _entry_sql())
