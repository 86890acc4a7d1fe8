"""Images that lack their last lines: neighbourhoods end where pixels do, warps see the border there, and no pixel is made up."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import array, relation

import __spark_entry__
from pixelframe.frame import from_codes
from pixelframe.operators import filters, geometry, kernels

W, H, LEFT = 31, 23, 9


@pytest.fixture(scope="module")
def pair(spark):
    """The upper lines as part of an image of 23 lines, and as an image of their own."""
    v = np.random.default_rng(5).integers(0, 256, (LEFT, W, 4))
    rows = relation(spark, v).cache()
    return from_codes(rows, W, H, "linear"), from_codes(rows, W, LEFT, "linear")


@pytest.mark.parametrize("side", [1024, 7])
def test_neighbourhoods_end_with_the_lines(pair, monkeypatch, side):
    monkeypatch.setattr(kernels, "TILE", side)
    for name, run in (
        ("blur", lambda p: filters.blur(p, 3.5)), ("convolve", lambda p: filters.convolve(p, list(range(25)), 5, 300.0, 3)), ("median", lambda p: filters.median(p, 2)),
        ("sharpen", lambda p: filters.unsharp_mask(p, 0.8, 3.5)), ("two", lambda p: filters.median(filters.blur(p, 3.5), 2)), ("heal", lambda p: filters.heal(p, 3, 2, 20, 4, 3)),
    ):
        part, whole = (run(p) for p in pair)
        assert part.df.count() == W * LEFT, name
        assert np.array_equal(array(part)[:LEFT], array(whole)), name


def test_healing_keeps_what_has_no_source(pair):
    part = filters.heal(pair[0], 3, 20, 20, 4, 2)
    assert np.array_equal(array(part), array(pair[0]))


def test_warps_see_the_border_where_lines_are_missing(spark, pair):
    v = array(pair[0])[:LEFT]
    full = np.concatenate([v, np.ones((H - LEFT, W, 4))])
    k = kernels.warped(full, np.linalg.inv(geometry.perspective_step(W, H, vertical_degrees=8.0)[0]), (0, 0, W, H), (0, 0), (W, H), (1.0,) * 4)
    assert np.allclose(array(geometry.perspective(pair[0], vertical_degrees=8.0)), k, atol=1e-12)


def test_neighbours_across_missing_lines_and_pixels(spark):
    """Lines and columns that are missing inside an image: filters see what is left as one."""
    v = np.random.default_rng(8).integers(0, 256, (H, W, 4))
    ys, xs = [y for y in range(H) if y not in (0, 4, 5, 11)], [x for x in range(W) if x not in (2, 17, 30)]
    part = from_codes(relation(spark, v).filter(F.col("y").isin(ys) & F.col("x").isin(xs)), W, H, "linear")
    whole = from_codes(relation(spark, v[np.ix_(ys, xs)]), len(xs), len(ys), "linear")
    for run in (lambda p: filters.blur(p, 3.5), lambda p: filters.convolve(p, list(range(25)), 5, 300.0, 3), lambda p: filters.unsharp_mask(p, 0.8, 3.5)):
        assert np.array_equal(array(run(part))[np.ix_(ys, xs)], array(run(whole)))


def test_sums_of_filters_do_not_depend_on_tiles(monkeypatch):
    v = np.random.default_rng(1).uniform(size=(40, 50, 4))
    weights = np.random.default_rng(2).uniform(size=21).tolist()
    wide = np.pad(v, [(0, 0), (10, 10), (0, 0)], "edge")
    want = wide[:, :50] * weights[0]
    for k in range(1, 21):
        want = want + wide[:, k : k + 50] * weights[k]
    assert np.array_equal(kernels.convolved(v, weights, 1), want)
    monkeypatch.setattr(kernels, "NEAR", 1000)
    assert np.array_equal(kernels.convolved(v, weights, 1), want)
    assert np.array_equal(kernels.convolved(v.swapaxes(0, 1), weights, 0), want.swapaxes(0, 1))


#: Of 237 embeddings, five images of which the last has 37 lines: all, without some inside, and without the lines that a patch is made of.
LINES = {"last": lambda k: True, "inside": lambda k: k % 7 not in (0, 3), "source": lambda k: not 100 <= k < 121, "target": lambda k: not 71 <= k < 90}


@pytest.mark.parametrize("name", ["px_convolve7", "px_convolve9", "px_heal"])
@pytest.mark.parametrize("kept", LINES)
def test_queries_equal_their_sql_where_lines_are_missing(spark, tmp_path, name, kept):
    v = np.random.default_rng(11).normal(0, 0.3, (237, 64))
    rows = [(k, v[k].tolist()) for k in range(237) if LINES[kept](k)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        columns = "image_id, y, x, r8, g8, b8, a8"
        want = con.execute(f"select {columns} from ({__spark_entry__.oracle_sql()[name]}) order by all").fetchall()
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).selectExpr(columns.split(", "))
    assert len(want) == 64 * len(rows) and sorted(map(tuple, got.collect())) == want
