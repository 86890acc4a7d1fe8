"""Tilt where lines are short, families disagree, images are large, or nothing is to be found."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import relation

from pixelframe.frame import from_codes
from pixelframe.operators import geometry, tilt


def found(spark, gray, **more):
    gray = np.clip(np.round(gray), 0, 255).astype(int)
    p = from_codes(relation(spark, np.dstack([gray] * 3 + [np.full_like(gray, 255)])), gray.shape[1], gray.shape[0])
    return tilt.detect(p, **more).first()


def turned(w, h, level, upright):
    """Coordinates across level and across upright lines, each family turned by its own angle."""
    ys, xs = np.indices((h, w)) + 0.5
    a, b = np.radians(level), np.radians(upright)
    return (ys - h / 2) * np.cos(a) - (xs - w / 2) * np.sin(a), (xs - w / 2) * np.cos(b) + (ys - h / 2) * np.sin(b)


def grid(w, h, level, upright, gap=20):
    v, u = turned(w, h, level, upright)
    return 255 * np.clip(np.minimum(np.abs((u + 40 * gap) % gap - gap / 2), np.abs((v + 40 * gap) % gap - gap / 2)) - 0.5, 0, 1)


def test_broken_edges_without_lines_are_measured_by_profiles(spark):
    v, u = turned(160, 120, 3.0, 3.0)
    some = np.random.default_rng(1).uniform(size=(60, 60)) < 0.25
    dashes = (np.abs((v + 405) % 15 - 7.5) < 1.5) & ((u + 400) % 20 < 7) & some[((v + 405) // 15).astype(int), ((u + 400) // 20).astype(int)]
    out = found(spark, 255.0 * ~dashes)
    assert (out.n_lines, out.method) == (0, "projection_profile")
    assert abs(out.tilt - 3.0) <= 0.5 and out.confidence > 0 and out.alternatives[0].angle == pytest.approx(-out.tilt)


def test_families_that_disagree_are_told(spark):
    out = found(spark, grid(200, 160, 2.0, 1.3))
    assert abs(out.horizontal_angle + 2.0) <= 0.15 and abs(out.vertical_angle + 1.3) <= 0.15
    assert any("perspective" in w for w in out.warnings)
    assert out.horizontal_support + out.vertical_support == pytest.approx(1.0, abs=0.002)
    same = found(spark, grid(200, 160, 2.0, 2.0))
    assert not any("perspective" in w for w in same.warnings) and same.method == "hough_projection_fused"
    assert abs(same.recommended + 2.0) <= 0.1 and same.n_supporting >= 2
    assert max(p.score for p in same.score_curve) == 1.0


def test_large_images_are_shrunk_and_wider_angles_searched(spark):
    big = grid(320, 240, 4.0, 4.0, 40)
    out = found(spark, big, working_long_edge=160)
    assert abs(out.tilt - 4.0) <= 0.2 and out.recommended == -out.tilt
    assert found(spark, big, max_abs_angle=2.0).tilt != out.tilt
    assert abs(found(spark, grid(200, 160, 20.0, 20.0), max_abs_angle=25.0).tilt - 20.0) <= 0.2


def test_nothing_to_be_found(spark):
    flat = found(spark, np.full((64, 80), 128.0))
    assert (flat.tilt, flat.recommended, flat.confidence) == (None, None, 0.0) and flat.warnings
    noise = None
    for seed in (1, 2):
        v = np.round(np.random.default_rng(seed).uniform(0, 255, (240, 320))).astype(int)
        df = relation(spark, np.dstack([v] * 3 + [np.full_like(v, 255)])).withColumn("image_id", F.lit(seed))
        noise = df if noise is None else noise.unionByName(df)
    out = tilt.detect(from_codes(noise, 320, 240)).collect()
    assert len(out) == 2 and all(r.recommended is None for r in out)
    stripes, _ = turned(160, 120, 45.0, 45.0)
    assert found(spark, 255 * np.clip(np.abs((stripes + 400) % 20 - 10) - 0.5, 0, 1)).recommended is None
    assert found(spark, np.zeros((12, 80))).warnings[0].startswith("sides of at least 16")


def test_accuracy_on_a_grid(spark):
    angles = [-12.0, -6.5, -2.4, 0.0, 0.7, 3.3, 9.0]
    values = [np.round(grid(640, 480, a, a, 48)).astype(np.uint8).tobytes() for a in angles]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "image_id int, v binary").repartition(len(angles))

    def pixels(batches):
        for b in batches:
            for i, v in zip(b.column("image_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                y, x = np.indices((480, 640), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(y.size, i, np.int32)), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(np.frombuffer(v, np.uint8).astype(np.int32))], ["image_id", "y", "x", "r8"])

    df = rows.mapInArrow(pixels, "image_id int, y int, x int, r8 int").select("image_id", "y", "x", *(F.col("r8").alias(f"{c}8") for c in "rgb"), F.lit(255).alias("a8"))
    out = tilt.detect(from_codes(df, 640, 480)).orderBy("image_id").collect()
    for angle, r in zip(angles, out, strict=True):
        assert abs(r.recommended + angle) <= 0.1 and r.confidence >= 0.5 and r.method == "hough_projection_fused"


def _reached(weak: set, strong: set) -> set:
    out, front = set(), list(strong)
    while front:
        y, x = front.pop()
        if (y, x) not in out:
            out.add((y, x))
            front += [q for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (q := (y + dy, x + dx)) in weak]
    return out


def test_weak_edges_are_followed_over_tiles(spark):
    rng = np.random.default_rng(6)
    spiral, (y, x), step = set(), (0, 0), 0
    for n in [39, 39, 39, 35, 35, 31, 31, 27, 27, 23, 23]:  # one chain that crosses borders again and again
        for _ in range(n):
            spiral.add((y, x))
            y, x = y + (0, 1, 0, -1)[step], x + (1, 0, -1, 0)[step]
        step = (step + 1) % 4
    some = lambda share: {tuple(p) for p in np.argwhere(rng.random((40, 40)) < share).tolist()}
    rows, want = [], set()
    for i, (points, strong) in enumerate(((spiral, {(0, 0)}), (spiral, set()), (some(0.35), None), (some(0.12), None))):
        strong = set(sorted(points)[:: max(1, len(points) // 12)]) if strong is None else strong
        rows += [(i, y, x, 0.0, 1.0, (y, x) in strong) for y, x in points]
        want |= {(i, *p) for p in _reached(points, strong)}
    df = spark.createDataFrame(rows, "image_id int, y int, x int, gx double, gy double, strong boolean")
    for side in (12, 64):
        assert {(r.image_id, r.y, r.x) for r in tilt.tied_to_strong(df, 40, 40, side).collect()} == want
    y, x = np.array([p[0] for p in spiral]), np.array([p[1] for p in spiral])
    assert (tilt.labels(y, x) == 0).all()


def test_no_row_is_made_for_a_point_and_an_angle(spark):
    points = spark.range(4000).select(F.lit(0).alias("image_id"), (F.col("id") % 50).cast("int").alias("y"), (F.col("id") * 7 % 64).cast("int").alias("x"), F.when(F.col("id") % 2 == 0, "h").otherwise("v").alias("family"))
    votes = tilt.hough_votes(points.coalesce(1), 64, 50)
    assert votes.agg(F.sum("votes")).first()[0] == 4000 * len(tilt.ANGLES)
    assert "Generate" not in votes._jdf.queryExecution().executedPlan().toString()


def test_losses_as_columns(spark):
    cases = [(w, h, a) for w, h in ((60, 40), (40, 60), (50, 50), (200, 10)) for a in (0.0, 1.0, 17.0, 45.0, 46.0, 80.0, 90.0, 133.0)]
    rows = spark.createDataFrame([(float(w), float(h), a) for w, h, a in cases], "w double, h double, a double")
    got = rows.select("w", "h", "a", geometry.rotation_loss_columns(F.col("w"), F.col("h"), F.col("a")).alias("v"), geometry.loss_percent(F.col("w"), F.col("h"), F.col("a")).alias("exact")).collect()
    for r in got:
        want = geometry.rotation_loss(int(r.w), int(r.h), r.a)
        assert abs(r.v - want) < 1e-9 and r.exact <= r.v + 1e-9


def test_shrinking_does_not_depend_on_the_order_of_rows(spark):
    gray = np.random.default_rng(5).integers(0, 256, (90, 140))
    rows = relation(spark, np.dstack([gray] * 3 + [np.full_like(gray, 255)]))
    shuffled = rows.repartition(7, F.xxhash64("y", "x")).sortWithinPartitions(F.xxhash64("x", "y"))
    small = [{(r.y, r.x): r.v for r in tilt.shrunk(tilt.gray(from_codes(p, 140, 90)), 77).df.collect()} for p in (rows, shuffled)]
    assert small[0] == small[1] and len(small[0]) == 77 * 50
    # against the taps in exact arithmetic
    for o, axis in (((3, 11), "some"), ((49, 76), "last")):
        down, across = tilt.triangle_taps(90, 50)[o[0]], tilt.triangle_taps(140, 77)[o[1]]
        exact = sum(int(gray[i, j]) * k * w for i, k in down for j, w in across)
        assert abs(small[0][o] - exact) <= 0.5 + 1e-5, axis
