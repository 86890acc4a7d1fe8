"""Packed tiles: what they carry, how kernels share an exchange, and how much memory warps and heals take."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import array, relation

from pixelframe.frame import from_codes
from pixelframe.functions import numeric as N
from pixelframe.operators import filters, geometry
from pixelframe.operators import kernels as K


@pytest.fixture(scope="module")
def image(spark):
    v = np.random.default_rng(9).integers(0, 256, (40, 57, 4))
    return from_codes(relation(spark, v).cache(), 57, 40, "linear")


def test_values_come_back_exactly():
    rng = np.random.default_rng(1)
    special = np.array([[0.0, -0.0, np.nan, np.inf], [1e-300, 1.0, -np.inf, 5e-324]])
    for v in (special, rng.integers(0, 256, (5000, 4)) / 255, rng.integers(0, 900, (50_000, 4)) / 900, rng.random((3000, 4)), np.ones((1, 4)), np.empty((0, 4))):
        back = K.loosened(K.squeezed(v), len(v))
        assert np.array_equal(back.view(np.int64), np.ascontiguousarray(v).view(np.int64))
    for places in (np.array([3, 4, 5, 9, 10, 2]), np.array([7]), np.arange(1000), rng.permutation(50)):
        assert np.array_equal(K.places(K.runs(places)), places)


def _three(p):
    return filters.convolve(filters.median(filters.blur(p, 3.0), 2), [1.0] * 25, 5, 30.0, 2)


def test_three_kernels_share_one_exchange(image, monkeypatch):
    monkeypatch.setattr(K, "TILE", 32)
    out = _three(image)
    assert len(out.pending.steps) == 3
    assert out.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    v = K.blurred(array(image), N.gaussian_weights(3.0))
    v = K.correlated(K.median(v, 2), [1.0] * 25, 5, 30.0, 2 / 255, N.ALPHA_LEAST)
    assert np.allclose(array(out), v, atol=1e-12)
    # halos of more than half a tile, or anything else between, begin another chain
    assert len(filters.blur(out, 5.0).pending.steps) == 1
    between = geometry.flip(filters.median(image, 2), "horizontal")
    assert len(filters.median(between, 2).pending.steps) == 1


def test_three_kernels_send_less_than_a_fifth_of_the_pixels(spark):
    w, h = 700, 500
    df = spark.range(w * h).select(F.lit(0).alias("image_id"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), *((F.hash("id", F.lit(k)) % 128 + 128).alias(f"{k}8") for k in "rgba"))
    p = _three(from_codes(df, w, h, "linear"))
    halo = sum(h for _, h in p.pending.steps)
    sent = K.packed(p.pending.base.df.withColumns({"size_id": F.lit(0), "part": F.lit(0)}), [(w, h)], halo).agg(F.sum(F.octet_length("at") + F.octet_length("data"))).first()[0]
    rows = w * h * (3 * 4 + 4 * 8)  # three integers and four doubles each
    assert sent < 0.2 * rows


def test_packing_of_pixels_in_any_order(spark, image, monkeypatch):
    monkeypatch.setattr(K, "TILE", 16)
    monkeypatch.setattr(K, "GATHER", 100)
    mixed = image.df.orderBy(F.xxhash64("y", "x"))
    from dataclasses import replace

    assert np.allclose(array(filters.median(replace(image, df=mixed), 3)), K.median(array(image), 3))


def _peak(f) -> float:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


@pytest.mark.parametrize("step", [{"vertical_degrees": 45.0}, {"vertical_degrees": 30.0, "horizontal_degrees": 40.0}], ids=["keystone", "both"])
def test_cells_of_a_warp_of_100_million_pixels_are_bounded(step):
    n = 10_000
    forward, w, h = geometry.perspective_step(n, n, **step)
    warp = K.Warp(np.linalg.inv(forward), w, h, n, n)
    plan = K.cells(warp)
    boxes = np.array(plan)
    area = (boxes[:, 6] - boxes[:, 4]) * (boxes[:, 7] - boxes[:, 5])
    assert ((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).sum() == w * h
    assert area.max() <= K.MOST_SOURCE * K.TILE**2 and len(plan) < 5000 and area.sum() < 4 * n * n
    # a pixel row of the source box in Arrow takes 44 bytes
    x0, y0, x1, y1, left, top, right, bottom = plan[int(area.argmax())]
    source = np.ones((bottom - top, right - left, 4))
    peak = _peak(lambda: K.warped(source, warp.inverse, (x0, y0, x1, y1), (left, top), (n, n), (1.0, 1.0, 1.0, 1.0)))
    assert peak + (source.nbytes + area.max() * 44) / 1e6 < 1500


def test_small_cells_change_nothing(image, monkeypatch):
    run = lambda: [array(geometry.perspective(image, vertical_degrees=v, horizontal_degrees=h)) for v, h in ((44.0, 0.0), (40.0, 38.0))]
    whole = run()
    monkeypatch.setattr(K, "TILE", 16)
    monkeypatch.setattr(K, "EXACT", 4)
    monkeypatch.setattr(K, "BLOCK", 8)
    for a, b in zip(run(), whole, strict=True):
        assert np.allclose(a, b, atol=1e-12)


def test_a_tile_of_a_large_heal_is_bounded():
    weights = N.gaussian_weights(2048 / 3)
    side = K.TILE + 2 * (len(weights) // 2)
    v = np.random.default_rng(0).random((side, side, 8))

    def kernel():
        a, b = v[..., :4], v[..., 4:]
        return np.clip(a - K.blurred(a, weights) + K.blurred(b, weights), 0, 1)

    assert _peak(kernel) + v.nbytes / 1e6 < 800


def test_heals_of_many_tiles_and_beyond_the_edges(image, monkeypatch):
    places = ((12, 10, 40, 30, 9, 4.0), (1, 38, 55, 2, 14, 0.0), (30, 20, 28, 22, 2048, 5.0))
    whole = [array(filters.heal(image, *p)) for p in places]
    monkeypatch.setattr(K, "TILE", 8)
    for p, want in zip(places, whole, strict=True):
        assert np.allclose(array(filters.heal(image, *p)), want, atol=1e-12)


def test_a_median_by_counts_is_the_middle_value_at_any_radius(monkeypatch):
    import time

    rng = np.random.default_rng(5)
    table = np.sort(rng.random(256))
    v = np.stack([table[rng.integers(0, 256, (70, 90))], table[rng.integers(0, 3, (70, 90))], np.zeros((70, 90)), rng.random((70, 90))], -1)
    for radius in (1, 2, 5, 16):
        monkeypatch.setattr(K, "COUNTED_RADIUS", 99)
        want = K.median(v, radius)
        monkeypatch.setattr(K, "COUNTED_RADIUS", 1)
        assert np.array_equal(K.median(v, radius), want)
    took = []
    for radius in (6, 16):
        code, at = rng.integers(0, 256, (400 + 2 * radius, 400 + 2 * radius)), time.perf_counter()
        K.counted_median(code, radius)
        took.append(time.perf_counter() - at)
    assert took[1] < 2 * took[0]
