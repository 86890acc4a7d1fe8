"""Properties of operators on small images, and kernels against window plans."""

import numpy as np
import pytest

from pixelframe.frame import PixelFrame, codes, from_codes
from pixelframe.functions import numeric as N
from pixelframe.operators import color, composite, filters, geometry, kernels, masks, tilt
from pixelframe.plans.compile import execute
from pixelframe.sources.cube import Cube, CubeError, parse_cube


def relation(spark, pixels):
    h, w, _ = pixels.shape
    rows = [(0, y, x, *(int(v) for v in pixels[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, y int, x int, r8 int, g8 int, b8 int, a8 int")


def array(p: PixelFrame):
    out = np.zeros((p.height, p.width, 4))
    for r in p.df.collect():
        out[r.y, r.x] = r.r, r.g, r.b, r.a
    return out


@pytest.fixture(scope="module")
def pixels():
    return np.random.default_rng(4).integers(0, 256, (9, 12, 4))


@pytest.fixture(scope="module")
def image(spark, pixels):
    return from_codes(relation(spark, pixels).cache(), 12, 9)


def test_transfer_round_trip_on_all_code_values():
    for i in range(256):
        v = N.lerp_value(N.oetf_nodes(), N.eotf_u8()[i])
        assert int(N.half_away(v * 255)) == i


def test_code_values_of_any_depth_are_read_exactly(spark):
    from pyspark.sql import functions as F

    deep = spark.range(65536).select((F.col("id") / 65535).alias("v")).select("v", N.codes_to_linear(F.col("v")).alias("l"))
    assert all(abs(r.l - N.q9(N.srgb_to_linear_exact(r.v))) < 1.5e-9 for r in deep.collect())
    few = spark.range(256).select(N.codes_to_linear(F.col("id") / 255).alias("l"))
    assert tuple(r.l for r in few.collect()) == N.eotf_u8()


def test_identities(image):
    before = array(image)
    for after in (
        color.adjust(image), color.color_matrix(image, [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]), color.curves(image, [[0, 0], [255, 255]]), color.levels(image),
        color.hsl(image, red={"hue": 0}), geometry.flip(geometry.flip(image, "horizontal"), "horizontal"), geometry.quarter(image, 4), geometry.rotate(image, 360.0),
        color.lut(image, Cube(tuple((r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3)), 3, True)),
    ):
        assert np.allclose(array(after), before, atol=2e-9)


def test_orientations_invert(image):
    for a, b in ((2, 2), (3, 3), (4, 4), (5, 5), (6, 8), (7, 7)):
        assert np.allclose(array(geometry.orient(geometry.orient(image, a), b)), array(image))
    v = array(image)
    assert np.allclose(array(geometry.orient(image, 5)), v.transpose(1, 0, 2))
    assert np.allclose(array(geometry.orient(image, 6)), np.rot90(v, -1))


def test_windows_agree_with_kernels(image):
    linear = image.to("linear")
    v = array(linear)
    weights = N.gaussian_weights(0.8)
    assert np.allclose(array(filters.blur(linear, 0.8)), kernels.blurred(v, weights), atol=1e-9)
    assert np.allclose(array(filters.median(linear, 1)), kernels.median(v, 1), atol=1e-12)
    assert np.allclose(array(filters.median(linear, 2)), kernels.median(v, 2), atol=1e-12)


def test_warp_of_quarter_turn_is_exact(image):
    linear = image.to("linear")
    step = np.array([[0, -1, 9], [1, 0, 0], [0, 0, 1]])
    warped = geometry.warp(linear, step, 9, 12, (1.0, 1.0, 1.0, 1.0))
    want = array(geometry.quarter(linear, 1))
    want[..., :3] = np.where(want[..., 3:] < 1e-6, 0, want[..., :3])
    assert np.allclose(array(warped), want, atol=1e-9)


def test_homography_maps_corners():
    quad = [[3, 2], [20, 4], [22, 19], [1, 16]]
    m = geometry.homography(quad, 18, 15)
    for (x, y), want in zip(quad, ((0, 0), (18, 0), (18, 15), (0, 15)), strict=True):
        u, v, w = m @ np.array([x, y, 1.0])
        assert np.allclose((u / w, v / w), want)


def test_aspect_crop_is_stable():
    for w in range(1, 70, 3):
        for h in (1, 7, 33, 64):
            for ratio in ((16, 9), (1, 1), (4, 5), (1200, 630)):
                for pad in (False, True):
                    once = geometry.aspect_size(w, h, ratio, pad)
                    assert geometry.aspect_size(*once, ratio, pad) == once
                    assert all(a >= b for a, b in zip(once, (w, h), strict=True)) if pad else all(a <= b for a, b in zip(once, (w, h), strict=True))


def test_contain_never_exceeds_the_box():
    for w, h in ((100, 37), (37, 100), (64, 64), (1, 900)):
        cw, ch, *_ = geometry.resize_plan(w, h, 50, 40, "contain")
        assert cw <= 50 and ch <= 40 and cw <= max(w, 1) and ch <= h


# Results of the compositing specification for backdrop .2 and source .7.
SPEC = {
    "normal": 0.7, "multiply": 0.14, "screen": 0.76, "overlay": 0.28, "darken": 0.2, "lighten": 0.7, "color_dodge": 0.2 / 0.3, "color_burn": 0.0, "hard_light": 1 - 2 * 0.3 * 0.8,
    "difference": 0.5, "exclusion": 0.62, "soft_light": 0.2 + 0.4 * (((16 * 0.2 - 12) * 0.2 + 4) * 0.2 - 0.2),
}


@pytest.mark.parametrize("mode", SPEC)
def test_separable_modes(spark, mode):
    from pyspark.sql import functions as F

    got = spark.range(1).select(composite.SEPARABLE[mode](F.lit(0.2), F.lit(0.7)).alias("v")).first().v
    assert got == pytest.approx(SPEC[mode], abs=1e-9)


def test_non_separable_modes_keep_luminosity(image, spark):
    top = geometry.flip(image, "horizontal")
    opaque = lambda p: color.color_matrix(p, [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1])
    a, b = opaque(image), opaque(top)
    lum = lambda v: v[..., :3] @ np.array([0.3, 0.59, 0.11])
    for mode, of in (("hue", a), ("saturation", a), ("color", a), ("luminosity", b)):
        assert np.allclose(lum(array(composite.over(a, b, mode))), lum(array(of)), atol=1e-6)


def test_mask_bounds(image):
    mask = masks.plane(geometry.flip(image, "vertical"), 12, 9, feather_px=1.0)
    assert all(0 <= r.w <= 1 for r in mask.collect())
    assert masks.plane(image, 5, 4).count() == 20
    inverted = color.color_matrix(image, [-1, 0, 0, 0, 1, 0, -1, 0, 0, 1, 0, 0, -1, 0, 1, 0, 0, 0, 1, 0])
    after = composite.masked(image, inverted, masks.linear_gradient(image, 90.0, 0.4, 0.6))
    v, a, b = array(after), array(image), array(inverted)
    assert np.allclose(v[:, 0], b[:, 0]) and np.allclose(v[:, -1], a[:, -1])


def test_svg_overlay_and_layers(spark, image, pixels):
    from pixelframe.sources.svg import rasterise

    raster, warnings = rasterise('<svg xmlns="http://www.w3.org/2000/svg" width="4" height="3"><rect x="0" y="0" width="2" height="3" fill="#ff0000"/><text>no</text></svg>')
    assert warnings == ["text is not drawn"] and raster.shape == (3, 4, 4)
    stamp = from_codes(relation(spark, np.round(raster * 255).astype(int)), 4, 3)
    recipe = {"operations": [{"op": "svg_overlay", "svg_revision_id": "rev_s", "x": 5, "y": 2}]}
    out = array(execute(__import__("json").dumps(recipe), relation(spark, pixels), 12, 9, {"rev_s": stamp}).frame)
    assert np.allclose(out[2:5, 5:7], [1, 0, 0, 1]) and np.allclose(out[0], array(image)[0])
    layers = {"operations": [], "layers": [{"source": "base"}, {"source": {"revision_id": "rev_b"}, "ops": [{"op": "flip", "direction": "vertical"}], "opacity": 0.0}]}
    same = execute(__import__("json").dumps(layers), relation(spark, pixels), 12, 9, {"rev_b": image})
    assert np.allclose(array(same.frame), array(image))


def test_cube_files():
    cube = parse_cube("TITLE \"t\"\n# c\nLUT_1D_SIZE 2\nDOMAIN_MAX 1 1 2\n0 0 0 # low\n1 1 1\n")
    assert cube.rows == ((0, 0, 0), (1, 1, 1)) and cube.domain_max == (1, 1, 2)
    for bad in ("", "LUT_3D_SIZE 1\n", "LUT_1D_SIZE 2\n0 0 0\n", "LUT_1D_SIZE 2\n0 0 0\n1 1 17\n", "LUT_1D_SIZE 2\n0 0\n1 1 1\n"):
        with pytest.raises(CubeError):
            parse_cube(bad)


@pytest.mark.parametrize("angle", [-6.0, 2.4, 5.0])
def test_tilt_of_a_synthetic_grid(spark, angle):
    h, w = 120, 160
    ys, xs = np.indices((h, w)) + 0.5
    a = np.radians(angle)
    u, v = (xs - w / 2) * np.cos(a) + (ys - h / 2) * np.sin(a), -(xs - w / 2) * np.sin(a) + (ys - h / 2) * np.cos(a)
    lines = np.minimum(np.abs((u + 400) % 20 - 10), np.abs((v + 400) % 20 - 10))
    gray = np.clip(255 * (1 - np.clip(1.5 - lines, 0, 1)), 0, 255).astype(int)
    p = from_codes(relation(spark, np.dstack([gray, gray, gray, np.full_like(gray, 255)])), w, h)
    out = tilt.detect(p).first()
    assert abs(out.tilt - angle) <= 0.1 and out.n_lines >= 2


def test_image_files(spark, tmp_path, image, pixels):
    from pixelframe.sources import images

    content = images.encoded(image).first().content
    (tmp_path / "a.png").write_bytes(content)
    (tmp_path / "b.txt").write_bytes(b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.inspect(spark, str(tmp_path)).collect()}
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].mime) == (12, 9, "image/png") and rows["b.txt"].error
    back = {(r.y, r.x): (r.r8, r.g8, r.b8, r.a8) for r in images.read_pixels(spark, str(tmp_path / "a.png")).collect()}
    want = {(r.y, r.x): (r.r8, r.g8, r.b8, r.a8) for r in codes(image).collect()}
    assert back == want
    with pytest.raises(images.ImageError):
        images.encoded(image, "webp")
