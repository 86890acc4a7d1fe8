"""Other sizes by packed tiles: what taps give on whole images, one exchange of packed rows, bounded sources."""

import numpy as np
import pytest
from test_operators import array, relation

from pixelframe.frame import from_codes
from pixelframe.functions import numeric as N
from pixelframe.operators import geometry, kernels


def matrix(size, out):
    m = np.zeros((out, size))
    for o, each in enumerate(N.lanczos_taps(size, out)):
        for s, w in each:
            m[o, s] += w
    return m


@pytest.mark.parametrize("side", [1024, 9])
def test_tiles_give_what_whole_images_give(spark, monkeypatch, side):
    monkeypatch.setattr(kernels, "TILE", side)
    v = np.random.default_rng(8).integers(0, 256, (23, 31, 4))
    p = from_codes(relation(spark, v).cache(), 31, 23, "linear")
    a = kernels.premultiplied(array(p))
    for w, h in ((20, 11), (31, 9), (4, 23), (45, 40), (1, 1)):
        want = np.einsum("oy,yxc,px->opc", matrix(23, h), a, matrix(31, w))
        want[..., 3] = np.clip(want[..., 3], 0, 1)
        got = geometry.resize(p, w, h, "fill", without_enlargement=False)
        assert np.allclose(array(got), kernels.unpremultiplied(want), atol=1e-9), (w, h)


def test_pixels_travel_packed(spark):
    v = np.random.default_rng(8).integers(0, 256, (23, 31, 4))
    plan = geometry.resize(from_codes(relation(spark, v), 31, 23, "linear"), 20, 11, "fill").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan and "HashAggregate" not in plan


def test_sources_of_tiles_stay_bounded():
    for n, out in ((10_000, 100), (10_000, 9_000), (1792, 1600), (300, 3000)):
        tiles = kernels.Scaling([(n, n, out, out)], N.lanczos_taps, 3.0, kernels.TILE)
        first, stop = tiles.ends(0, "x")
        assert (stop - first).max() ** 2 <= kernels.MOST_SOURCE * kernels.TILE**2 * 1.01
        low, high = tiles.near(np.zeros(n, int), {"x": np.arange(n)}, "x")
        assert all(low[s] <= t <= high[s] for t in range(len(first)) for s in (first[t], stop[t] - 1)) and (high - low).max() <= 2


def test_means_of_blocks_do_not_depend_on_the_order_of_rows(spark):
    from pyspark.sql import functions as F

    from pixelframe.operators import filters

    v = np.random.default_rng(8).integers(0, 256, (23, 31, 4))
    rows = relation(spark, v)
    got = [array(filters.pixelate(from_codes(rows.orderBy(*by).coalesce(1), 31, 23, "linear"), 7)) for by in ([F.col("y"), F.col("x")], [F.desc("x"), F.desc("y")], [F.rand(3)])]
    assert all(np.array_equal(got[0], g) for g in got)
