"""Images of different sizes in one plan: each is what it is alone."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import array, relation

from pixelframe.frame import PixelFrame, codes, from_codes, from_sizes
from pixelframe.operators import composite, masks
from pixelframe.plans.compile import execute
from pixelframe.sources import images

SIZES = {0: (23, 17), 1: (16, 16), 2: (9, 31), 3: (23, 17)}
PIXELS = {k: np.random.default_rng(k).integers(0, 256, (h, w, 4)) for k, (w, h) in SIZES.items()}


def _rows(spark, pixels=None):
    rows = [(k, y, x, *(int(c) for c in v[y, x]), v.shape[1], v.shape[0]) for k, v in (pixels or PIXELS).items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id int, y int, x int, r8 int, g8 int, b8 int, a8 int, width int, height int")


@pytest.fixture(scope="module")
def mixed(spark):
    return _rows(spark).cache()


def _arrays(df) -> dict[int, np.ndarray]:
    found: dict = {}
    for r in df.collect():
        found.setdefault(r.image_id, {})[r.y, r.x] = (r.r8, r.g8, r.b8, r.a8)
    out = {}
    for k, cells in found.items():
        h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
        assert len(cells) == w * h
        out[k] = np.array([[cells[y, x] for x in range(w)] for y in range(h)])
    return out


RECIPES = {
    "resize": [{"op": "resize", "width": 12, "height": 10, "fit": "contain"}],
    "cover": [{"op": "resize", "width": 14, "height": 14}, {"op": "vignette", "strength": 0.7}],
    "some stay": [{"op": "resize", "width": 16, "height": 16, "fit": "contain"}, {"op": "levels", "in_black": 9}],
    "aspect": [{"op": "crop", "aspect_ratio": "3:2", "anchor": "bottom_right"}, {"op": "flip", "direction": "vertical"}],
    "pad": [{"op": "crop", "aspect_ratio": "1:1", "mode": "pad", "pad_color": "#102030"}],
    "rect": [{"op": "crop", "rect": {"x": 2, "y": 3, "width": 6, "height": 9}}],
    "source rect": [{"op": "rotate", "angle_degrees": 90}, {"op": "crop", "rect": {"x": 1, "y": 2, "width": 7, "height": 9}, "coordinate_space": "source"}],
    "turn": [{"op": "rotate", "angle_degrees": 12.5}, {"op": "rotate", "angle_degrees": -90}],
    "full turn": [{"op": "rotate", "angle_degrees": 33, "crop": "full"}],
    "keystone": [{"op": "perspective", "vertical_degrees": 9, "horizontal_degrees": -4}],
    "kernels": [{"op": "blur", "sigma": 3.2}, {"op": "median", "radius": 2}, {"op": "convolve", "kernel": list(range(25)), "size": 5, "divisor": 300}, {"op": "unsharp_mask", "amount": 0.8, "radius": 3.5}],
    "windows": [{"op": "blur", "sigma": 0.8}, {"op": "median", "radius": 1}, {"op": "unsharp_mask", "amount": 0.8, "radius": 1.0}, {"op": "adjust", "sharpness": 0.4}],
    "discs": [{"op": "clone", "src_x": 4, "src_y": 5, "dest_x": 6, "dest_y": 12, "radius": 4, "feather_px": 2}, {"op": "heal", "src_x": 2, "src_y": 13, "dest_x": 7, "dest_y": 4, "radius": 40, "feather_px": 3}],
    "blocks": [{"op": "pixelate", "block_size": 5, "region": {"x": 1, "y": 2, "width": 100, "height": 9}}, {"op": "auto_levels"}, {"op": "grain", "amount": 0.4, "seed": 5}],
}


@pytest.mark.parametrize("name", RECIPES)
def test_each_image_is_what_it_is_alone(spark, mixed, name):
    got = _arrays(codes(execute({"operations": RECIPES[name]}, mixed).frame))
    assert set(got) == set(SIZES)
    for k in (0, 1, 2):
        want = execute({"operations": RECIPES[name]}, relation(spark, PIXELS[k]), *SIZES[k]).frame
        want = np.floor(array(want) * 255 + 0.5)
        assert got[k].shape == want.shape
        # an image that alone is not resampled stays in code values; in a frame it goes to linear light and back
        assert np.abs(got[k] - want).max() <= (1 if name == "some stay" else 0), k


def test_masks_and_layers_of_several_sizes(spark, mixed):
    smooth = lambda v: {k: np.repeat(np.repeat(a[: a.shape[0] // 2, : a.shape[1] // 2], 2, 0), 2, 1) for k, a in v.items()}
    small = smooth(PIXELS)
    p, m = from_sizes(mixed), from_sizes(_rows(spark, small))
    got = {k: {(r.y, r.x): r.w for r in rows} for k, rows in _by_image(masks.plane_for(m, p, True, 1.5).collect()).items()}
    for k, (w, h) in SIZES.items():
        v = small[k]
        want = masks.plane(from_codes(relation(spark, v), v.shape[1], v.shape[0]), w, h, True, 1.5).collect()
        assert len(want) == len(got[k]) == w * h and all(abs(got[k][r.y, r.x] - r.w) < 1e-12 for r in want)
    one = from_codes(relation(spark, PIXELS[1]).crossJoin(spark.createDataFrame([(k,) for k in SIZES], "k int")).select(F.col("k").alias("image_id"), "y", "x", "r8", "g8", "b8", "a8"), 16, 16)
    assert masks.plane_for(one, p).count() == sum(w * h for w, h in SIZES.values())
    assert composite.fold([(p, "normal", 1.0, None), (p, "multiply", 0.5, masks.plane_for(m, p))]).df.count() == sum(w * h for w, h in SIZES.values())
    with pytest.raises(Exception, match="a layer's size differs"):
        composite.fold([(p, "normal", 1.0, None), (m, "screen", 1.0, None)]).df.collect()


def _by_image(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.image_id, []).append(r)
    return out


def test_sizes_may_be_told_and_odd_rows_belong_to_no_image(spark, mixed):
    told = spark.createDataFrame([(23, 17), (16, 16), (9, 31)], "width int, height int")
    odd = mixed.unionByName(spark.createDataFrame([(9, 0, 0, 1, 1, 1, 1, None, 5), (9, 0, 0, 1, 1, 1, 1, 77, 5)], mixed.schema)).withColumn("size_id", F.lit("clash"))
    p = from_sizes(odd, told)
    assert [(e.width, e.height) for e in p.extents] == [(9, 31), (16, 16), (23, 17)] and p.df.count() == mixed.count()
    assert from_sizes(mixed.limit(0)).df.count() == 0
    out = execute({"operations": [{"op": "rotate", "angle_degrees": 20}]}, mixed)
    assert len(out.warnings) == 1 and out.warnings[0].startswith("3 of 3 sizes, at worst: ")


def test_a_folder_of_photos_through_one_recipe(spark, tmp_path):
    for k, v in PIXELS.items():
        (tmp_path / f"{k}.png").write_bytes(images.png(v.astype(np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    pixels, files = images.read_images(spark, str(tmp_path))
    assert [(r.width, r.height) for r in files.orderBy("image_id").collect()] == list(SIZES.values())
    out = execute({"operations": [{"op": "crop", "aspect_ratio": "1:1"}, {"op": "encode", "format": "png"}]}, pixels, sizes=files)
    made = {r.image_id: bytes(r.content) for r in images.encoded(out.frame).collect()}
    for k, (w, h) in SIZES.items():
        side = min(w, h)
        assert struct.unpack(">II", made[k][16:24]) == (side, side)
    (tmp_path / "out").mkdir()
    for k, content in made.items():
        (tmp_path / "out" / f"{k}.png").write_bytes(content)
    back = _arrays(images.read_pixels(spark, str(tmp_path / "out")).withColumn("image_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int")))
    for k, (w, h) in SIZES.items():
        side = min(w, h)
        x, y = (w - side) // 2, (h - side) // 2
        assert np.array_equal(back[k], PIXELS[k][y : y + side, x : x + side])


def test_one_plan_whatever_the_number_of_sizes(spark):
    rows = spark.range(40).select(F.col("id").cast("int").alias("image_id"), (F.col("id") + 5).cast("int").alias("width"), (70 - F.col("id")).cast("int").alias("height"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    rows = rows.select("*", *(((F.col("x") * k + F.col("y")) % 256).alias(f"{c}8") for c, k in (("r", 3), ("g", 5), ("b", 7))), F.lit(255).alias("a8"))
    p = execute({"operations": [{"op": "resize", "width": 20, "height": 20, "fit": "contain"}, {"op": "vignette", "strength": 0.4}]}, rows).frame
    plan = p.df._jdf.queryExecution().executedPlan().toString()
    assert isinstance(p, PixelFrame) and "Union" not in plan and plan.count("Scan ExistingRDD") <= 4
    assert p.df.count() == sum(e.width * e.height for e in p.extents)
