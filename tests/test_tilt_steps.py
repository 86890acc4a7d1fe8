"""Steps of tilt estimation: edges at the end of an image's lines, maxima of votes, what votes send, shrinking by tiles."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import relation

from pixelframe.frame import from_codes
from pixelframe.operators import kernels, tilt


def gray(spark, v, width, height):
    return tilt.gray(from_codes(relation(spark, np.dstack([v] * 3 + [np.full_like(v, 255)])), width, height))


def test_no_edge_lies_across_the_last_line_that_is_there(spark, monkeypatch):
    v = np.random.default_rng(3).integers(0, 256, (12, 40))
    want = None
    for side in (1024, 16):
        monkeypatch.setattr(kernels, "TILE", side)
        edges = {(r.y, r.x, r.gx, r.gy) for r in tilt.canny_edges(gray(spark, v, 40, 30), 16).collect()}
        # there only a gradient along the line has both of its neighbours
        assert edges and all(abs(gy) < 0.4143 * abs(gx) for y, _, gx, gy in edges if y == 11)
        assert edges == (want or edges)
        want = edges


def test_maxima_are_those_of_all_pairs():
    votes = np.random.default_rng(2).integers(0, 6, (31, 40))
    want = set()
    strong = [(int(votes[a, r]), int(a), int(r)) for a, r in zip(*np.nonzero(votes >= 4), strict=True)]
    for v, a, r in strong:
        near = [(-v2, a2, r2) for v2, a2, r2 in strong if abs(a2 - a) <= 5 and abs(r2 - r) <= 6]
        if min(near) == (-v, a, r):
            want.add((a, r))
    assert set(zip(*(k.tolist() for k in tilt.maxima(votes, 4.0)), strict=True)) == want


def test_lines_are_found_without_a_row_for_a_vote(spark):
    v = np.random.default_rng(3).integers(0, 256, (50, 64))
    points = spark.createDataFrame(tilt.edge_points(tilt.canny_edges(gray(spark, v, 64, 50))).collect())
    plan = tilt.lines(points, 64, 50, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("FlatMapGroupsInArrow") == 1 and "HashAggregate" not in plan
    few = tilt.hough_votes(points, 64, 50).select("family", "ai", "ri", "votes")
    # as many copies of each point as make tables travel in place of points
    many = tilt.hough_votes(points.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))), 64, 50).select("family", "ai", "ri", (F.col("votes") / 300).cast("long"))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_shrinking_sends_packed_tiles(spark, monkeypatch):
    v = np.random.default_rng(4).integers(0, 256, (90, 140))
    p = gray(spark, v, 140, 90)
    plan = tilt.shrunk(p, 77).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan
    whole = {(r.y, r.x): r.v for r in tilt.shrunk(p, 77).df.collect()}
    monkeypatch.setattr(kernels, "TILE", 16)
    assert {(r.y, r.x): r.v for r in tilt.shrunk(p, 77).df.collect()} == whole and len(whole) == 77 * 50


def test_steps_of_the_estimate_are_planned_once(spark):
    """The last plan joins tables of the steps; it does not hold their joins again."""
    rows = spark.range(32 * 32).select(F.lit(0).alias("image_id"), F.floor(F.col("id") / 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"), *((F.hash("id") % 2 * 100 + 100).alias(f"{c}8") for c in "rgba"))
    plan = tilt.detect(from_codes(rows, 32, 32))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 5
