"""Tilt estimation as a dataflow: smoothing, gradients, Canny edges, line votes, local maxima, angle histogram, profiles, fusion.

Gradients come from 3x3 neighbourhoods of smoothed values. An edge is where a gradient is greatest across itself; weak edges
count if they are tied to strong ones, which is told by labels within tiles and by joins over the tiles' borders. An edge point
belongs to the nearly level or the nearly upright family by its gradient and votes, for each tilt angle of a grid, for
the line through it; a task counts the votes of its points in one table before anything is shuffled. Profiles are taken of the
strongest points of an image, of which there is a fixed number at most.

``detect`` goes over the points of profiles twice: for the grid of angles, by which every choice is made, and then for fine
samples around what was chosen (``centred_means``). All else is joins of tables with a few hundred rows an image.
Angles are in degrees, clockwise on the screen (``phi``); what levels an image is ``-phi``.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import KEY, SIZE_ID, SRGB, PixelFrame
from ..functions import numeric as N
from ..shared import written
from . import kernels as K
from .geometry import loss_percent

# The estimate's parameters, down to the curve's.
STEP, SPAN, SIGMA, SLACK = 0.1, 15.0, 1.4, 6.0
#: Smallest side of an image in which lines are looked for.
LEAST_SIDE = 16
#: Degrees around a peak within which lines support it; the histogram's spread.
PEAK_RADIUS, SPREAD = 0.8, 0.25
LEAST_LINES, MOST_LINES = 2, 200
#: Projection points: the strongest share, most, least gradient, least share of the strongest edges, fewest in a family.
KEEP_SHARE, MOST_POINTS, LEAST_GRADIENT, STRONG_SHARE, FAMILY_POINTS = 0.15, 40_000, 12.0, 0.15, 64
REFINE_RADIUS, REFINE_SAMPLES = 0.3, 61
#: Sharpness of a profile that is used at all, and of one that is recommended without lines.
USABLE, ALONE = 0.25, 0.45
HOUGH_RADIUS, FAMILY_WINDOW, DISAGREEMENT = 0.5, 1.0, 0.3
CURVE_FLOOR, CURVE_MOST, CURVE_POINTS = 0.25, 0.999, 300

#: Pixels along the side of the tiles in which edges are labelled.
EDGE_TILE = 256


def angle_grid(limit: float = SPAN) -> list[float]:
    return [-limit + STEP * i for i in range(int(math.floor(2 * limit / STEP + 0.5)) + 1)]


ANGLES = angle_grid()


def gray(p: PixelFrame) -> PixelFrame:
    p = p.to(SRGB)
    return p.select(*KEY, N.to_u8(N.luma_709(F.col("r"), F.col("g"), F.col("b"))).cast("double").alias("v"))


def _smoothed(v: np.ndarray, on: np.ndarray | None) -> np.ndarray:
    """Under a Gaussian, as whole code values."""
    r = math.ceil(2 * SIGMA)
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * SIGMA * SIGMA))
    weights = (weights / weights.sum()).tolist()
    return np.minimum(np.floor(K.convolved(K.convolved(v, weights, 1, on), weights, 0, on) + 0.5), 255)


def _sobel(v: np.ndarray, on: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y, edges held."""
    step, sum_ = (-1, 0, 1), (1, 2, 1)
    return K.convolved(K.convolved(v, step, 1, on), sum_, 0, on)[..., 0], K.convolved(K.convolved(v, sum_, 1, on), step, 0, on)[..., 0]


def _thin(gx: np.ndarray, gy: np.ndarray, g: np.ndarray, on: np.ndarray | None) -> np.ndarray:
    """Where neither of the two neighbours across the edge has a greater gradient; both have to be there."""
    angle = np.degrees(np.arctan2(gy, gx))
    angle = np.where(angle < 0, angle + 180.0, angle)
    wide = np.pad(g if on is None else np.where(on, g, np.inf), 1, constant_values=np.inf)
    at = lambda dy, dx: wide[1 + dy : 1 + dy + g.shape[0], 1 + dx : 1 + dx + g.shape[1]]
    two = np.maximum(at(0, -1), at(0, 1))
    # the neighbours on a line at 45, 90 and 135 degrees
    for low, dy, dx in ((22.5, 1, 1), (67.5, 1, 0), (112.5, 1, -1)):
        two = np.where((angle >= low) & (angle < low + 45.0), np.maximum(at(dy, dx), at(-dy, -dx)), two)
    return (g >= two) if on is None else (g >= two) & on


def _by_tile(p: PixelFrame, halo: int, f, schema: str) -> DataFrame:
    """``f`` on each tile of the column v: image, left, top, the tile's place in its window, values and which places have a pixel."""
    tiles = K.Tiles([(p.width, p.height)], K.TILE, halo)

    def run(tile, v, on):
        image, size, ty, tx = tile
        left, top, _, _ = tiles.window(size, ty, tx)
        y0, x0 = ty * tiles.side, tx * tiles.side
        return f(image, left, top, (slice(y0 - top, y0 - top + tiles.side), slice(x0 - left, x0 - left + tiles.side)), v, None if on is None else on[..., 0])

    rows = p.df.select(*KEY, "v", F.lit(0).alias(SIZE_ID), F.lit(0).alias("part"))
    return K.by_tile(rows, tiles, ["v"], run, schema)


def gradients(p: PixelFrame) -> DataFrame:
    """(image_id, y, x, gx, gy) of the smoothed column v."""

    def run(image, left, top, own, v, on):
        gx, gy = (k[own] for k in _sobel(_smoothed(v, on), on))
        there = np.ones(gx.shape, bool) if on is None else on[own]
        y, x = (k.astype(np.int32) for k in np.nonzero(there))
        places = [pa.array(np.full(len(y), image, np.int32)), pa.array(y + np.int32(top + own[0].start)), pa.array(x + np.int32(left + own[1].start))]
        return pa.table([*places, pa.array(gx[there]), pa.array(gy[there])], [*KEY, "gx", "gy"])

    return _by_tile(p, math.ceil(2 * SIGMA) + 1, run, "image_id int, y int, x int, gx double, gy double")


#: The last bin of gradients.
MOST_BIN = 1140


def canny_thresholds(gradients: DataFrame) -> DataFrame:
    """(image_id, low, high): from the bin in which nine tenths of an image's gradients are reached."""
    bins = gradients.select("image_id", F.least(F.floor(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))), F.lit(MOST_BIN)).alias("bin"), F.lit(1).cast("long").alias("n"))
    return _thresholds(bins)


def _thresholds(bins: DataFrame) -> DataFrame:
    """Of (image_id, bin, n)."""
    bins = bins.groupBy("image_id", "bin").agg(F.sum("n").alias("n"))
    run = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("image_id").orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy("image_id")))
    high = run.groupBy("image_id").agg(F.min(F.when(F.col("upto") >= F.floor(F.col("all") * 0.9), F.col("bin"))).cast("double").alias("b"))
    high = high.select("image_id", F.greatest(F.lit(40.0), F.least(F.lit(500.0), "b")).alias("high"))
    return high.select("image_id", (F.col("high") * 0.4).alias("low"), "high")


def canny_edges(p: PixelFrame, side: int = EDGE_TILE) -> DataFrame:
    """(image_id, y, x, gx, gy) of edge points of the column v. Tiles are gone over once, for the points that may be edges and for the counts
    of gradients (rows without y, the bin as x) that thresholds come from; both are written."""
    width, height, places = p.width, p.height, ["y", "x", "gx", "gy"]

    def run(image, left, top, own, v, on):
        gx, gy = _sobel(_smoothed(v, on), on)
        g = np.sqrt(gx * gx + gy * gy)
        thin, own_g = _thin(gx, gy, g, on)[own], g[own] if on is None else g[own][on[own]]
        y, x = np.nonzero(thin)
        y, x = y + top + own[0].start, x + left + own[1].start
        inside = (y >= 1) & (y <= height - 2) & (x >= 1) & (x <= width - 2)
        y, x = y[inside], x[inside]
        counts = np.bincount(np.minimum(np.floor(own_g), MOST_BIN).astype(np.int64).ravel())
        bins = np.flatnonzero(counts)
        none = np.zeros(len(bins), np.int32)
        columns = [np.concatenate(k).astype(np.int32) for k in ((y, none), (x, bins), (gx[y - top, x - left], none), (gy[y - top, x - left], none))]
        columns = [pa.array(columns[0], mask=np.arange(len(columns[0])) >= len(y)), *map(pa.array, columns[1:])]
        return pa.table([pa.array(np.full(len(columns[0]), image, np.int32)), *columns, pa.array(np.concatenate([np.zeros(len(y), np.int64), counts[bins]]))], ["image_id", *places, "n"])

    found = written(_by_tile(p, math.ceil(2 * SIGMA) + 2, run, "image_id int, y int, x int, gx int, gy int, n long"), "thin")
    least = _thresholds(found.filter("y is null").select("image_id", F.col("x").alias("bin"), "n"))
    points = found.filter("y is not null").join(least, "image_id").withColumn("g", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))
    weak = points.filter("g >= low").select("image_id", "y", "x", F.col("gx").cast("double"), F.col("gy").cast("double"), (F.col("g") >= F.col("high")).alias("strong"))
    return tied_to_strong(weak, width, height, side)


def labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of some points the number of the first point to which it is tied by neighbours in eight directions."""
    y0, x0 = y.min(), x.min()
    at = np.full((y.max() - y0 + 3, x.max() - x0 + 3), -1, np.int64)
    at[y - y0 + 1, x - x0 + 1] = np.arange(len(y))
    links = [np.stack([np.arange(len(y)), at[y - y0 + 1 + dy, x - x0 + 1 + dx]], 1) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    links = np.concatenate([k[k[:, 1] >= 0] for k in links])
    first = np.arange(len(y))
    while True:
        ends = first[links]
        links, ends = links[ends[:, 0] != ends[:, 1]], ends[ends[:, 0] != ends[:, 1]]
        if not len(links):
            return first
        np.minimum.at(first, ends.max(1), ends.min(1))
        while (first[first] != first).any():
            first = first[first]


def tied_to_strong(weak: DataFrame, width: int, height: int, side: int = EDGE_TILE) -> DataFrame:
    """Of points (image_id, y, x, gx, gy, strong) those that neighbours tie to a strong one.

    Points are labelled within tiles. Labels that touch over a border are pairs; from labels with a strong point, pairs lead to
    further labels, in as many joins as a chain of weak points crosses borders.
    """

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        first = labels(y, x)
        number = y.astype(np.int64) * width + x
        anchored = np.zeros(len(y), bool)
        anchored[first[table.column("strong").to_numpy(zero_copy_only=False)]] = True
        return table.select([*KEY, "gx", "gy"]).append_column("label", pa.array(number[first])).append_column("anchored", pa.array(anchored[first]))

    tile = lambda c: F.floor(F.col(c) / side).cast("int")
    known = weak.withColumns({"ty": tile("y"), "tx": tile("x")}).groupBy("image_id", "ty", "tx").applyInArrow(run, "image_id int, y int, x int, gx double, gy double, label long, anchored boolean")
    edges = [*KEY, "gx", "gy"]
    if width <= side and height <= side:
        return known.filter("anchored").select(*edges)
    known = written(known, "edge-labels")
    at_border = lambda c: (F.col(c) % side).isin(0, side - 1)
    border = known.filter(at_border("y") | at_border("x")).select(*KEY, "label")
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    near = border.select("*", F.explode(steps).alias("s")).select("image_id", "y", "x", (F.col("y") + F.col("s.dy")).alias("y2"), (F.col("x") + F.col("s.dx")).alias("x2"), F.col("label").alias("other"))
    near = near.filter((F.floor(F.col("y2") / side) != tile("y")) | (F.floor(F.col("x2") / side) != tile("x"))).select("image_id", F.col("y2").alias("y"), F.col("x2").alias("x"), "other")
    pairs = written(border.join(near, list(KEY)).select("image_id", "label", "other").distinct(), "edge-pairs")
    reached = front = known.filter("anchored").select("image_id", "label").distinct()
    while True:
        more = pairs.join(front.withColumnRenamed("label", "other"), ["image_id", "other"]).select("image_id", "label").distinct()
        front = written(more.join(reached, ["image_id", "label"], "left_anti"), "edge-front")
        if front.isEmpty():
            return known.join(reached, ["image_id", "label"], "left_semi").select(*edges)
        reached = reached.unionByName(front)


def edge_points(gradients: DataFrame, limit: float = SPAN) -> DataFrame:
    """(image_id, y, x, family, strength) of points whose gradient lies near either axis."""
    slope = math.tan(math.radians(limit + SLACK))
    ax, ay = F.abs("gx"), F.abs("gy")
    family = F.when((ay > ax) & (ax <= slope * ay), "h").when((ay <= ax) & (ay <= slope * ax) & (ax > 0), "v")
    return gradients.select(*KEY, family.alias("family"), (ax + ay).alias("strength")).filter("family is not null")


def _centred(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.withColumns({"dx": F.col("x") - (width - 1) / 2.0, "dy": F.col("y") - (height - 1) / 2.0})


#: Points whose votes are counted at a time.
VOTERS = 2048


def _by_family(points: DataFrame, width: int, height: int, limit: float, f, schema: str) -> DataFrame:
    """``f`` on each image's family: image, name, and its votes by angle and rounded distance from the centre. A task sends one row for each
    family of its points: the points, or where these are more than the table has places, their votes."""
    reach = math.ceil(math.hypot(width, height) / 2) + 2
    angles = [math.radians(a) for a in angle_grid(limit)]
    sin, cos = (np.array([g(a) for a in angles])[:, None] for g in (math.sin, math.cos))
    shape = len(angles), 2 * reach + 1

    def table(dx: np.ndarray, dy: np.ndarray, upright: bool) -> np.ndarray:
        votes, row = np.zeros(shape[0] * shape[1], np.int64), np.arange(shape[0])[:, None] * shape[1] + reach
        for k in range(0, len(dx), VOTERS):
            x, y = dx[k : k + VOTERS], dy[k : k + VOTERS]
            r = x * cos + y * sin if upright else -x * sin + y * cos
            votes += np.bincount((np.trunc(r + np.copysign(0.5, r)).astype(np.int64) + row).ravel(), minlength=len(votes))
        return votes

    def send(batches):
        for c in K.gathered(batches):
            order = np.lexsort((c["upright"], c["image_id"]))
            image, upright = c["image_id"][order], c["upright"][order]
            first = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (upright[1:] != upright[:-1])]))
            data, few = [], []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                dx, dy = c["dx"][order[a:b]], c["dy"][order[a:b]]
                few.append(b - a < shape[0] * shape[1] // 4)
                data.append(np.stack([dx, dy]).astype(np.float32).tobytes() if few[-1] else table(dx, dy, bool(upright[a])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(image[first]), pa.array(upright[first]), pa.array(few), pa.array(data, pa.binary())], ["image_id", "upright", "few", "data"])

    def run(rows: pa.Table) -> pa.Table:
        image, upright = int(rows.column("image_id")[0].as_py()), bool(rows.column("upright")[0].as_py())
        votes, held = np.zeros(shape[0] * shape[1], np.int64), []
        for few, data in zip(rows.column("few").to_pylist(), rows.column("data"), strict=True):
            if few:
                held.append(np.frombuffer(data.as_buffer(), np.float32).reshape(2, -1))
            else:
                votes += np.frombuffer(data.as_buffer(), np.int32)
        if held:
            votes += table(*np.concatenate(held, 1).astype(np.float64), upright)
        return f(image, "v" if upright else "h", votes.reshape(shape), reach)

    # places are halves, which 32 bits hold exactly
    flat = _centred(points, width, height).select(F.col("image_id").cast("int").alias("image_id"), (F.col("family") == "v").cast("int").alias("upright"), "dx", "dy")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = flat.mapInArrow(send, "image_id int, upright int, few boolean, data binary")
    return sent.repartition(n, "image_id", "upright").groupBy("image_id", "upright").applyInArrow(run, schema)


def _family_rows(image: int, family: str, **columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"image_id": pa.array(np.full(n, image, np.int32)), "family": pa.array([family] * n, pa.string()), **columns})


def hough_votes(points: DataFrame, width: int, height: int, limit: float = SPAN) -> DataFrame:
    """(image_id, family, ai, ri, votes): points on each line of an angle and a rounded distance from the centre. No row is made for a point
    and an angle."""

    def run(image, family, votes, reach):
        ai, ri = np.nonzero(votes)
        return _family_rows(image, family, ai=pa.array(ai, pa.int32()), ri=pa.array(ri - reach, pa.int32()), votes=pa.array(votes[ai, ri]))

    return _by_family(points, width, height, limit, run, "image_id int, family string, ai int, ri int, votes long")


def _between(left: Column, middle: Column, right: Column) -> Column:
    """How many places a maximum lies off its middle, by the parabola through three values."""
    bend = left - 2.0 * middle + right
    return F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / F.nullif(bend, F.lit(0.0))))).otherwise(0.0)


def _angle(place: Column, limit: float) -> Column:
    return F.element_at(N.table(angle_grid(limit)), place + 1)


def maxima(votes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(angle, distance) of votes of at least ``least`` that are greatest nearby (ties: the smaller angle, then distance)."""
    place = np.arange(votes.size).reshape(votes.shape)
    # more votes first, then the earlier place
    key = votes.astype(np.int64) * votes.size - place
    best = key
    for axis, reach in ((0, 5), (1, 6)):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        wide, n = np.pad(best, pad, constant_values=np.iinfo(np.int64).min), votes.shape[axis]
        best = np.max([np.take(wide, range(k, k + n), axis) for k in range(2 * reach + 1)], 0)
    return np.nonzero((key == best) & (votes >= max(least, 1)))


def lines(points: DataFrame, width: int, height: int, floor: float = 24.0, limit: float = SPAN, most: int = MOST_LINES) -> DataFrame:
    """(image_id, family, phi, votes, rank) of the strongest lines through ``edge_points``: those with votes enough for their image's size and their
    family's points that are greatest nearby, the angle between those tried. Votes stay in the task that adds them up."""

    def run(image, family, votes, reach):
        # every point votes once for each angle
        ai, ri = maxima(votes, max(0.12 * max(width, height), 5.0 * int(votes[0].sum()) / (2 * reach + 1), float(floor)))
        wide = np.pad(votes, [(1, 1), (0, 0)])
        return _family_rows(image, family, ai=pa.array(ai, pa.int32()), ri=pa.array(ri - reach, pa.int32()), votes=pa.array(votes[ai, ri]), l=pa.array(wide[ai, ri]), u=pa.array(wide[ai + 2, ri]))

    alone = _by_family(points, width, height, limit, run, "image_id int, family string, ai int, ri int, votes long, l long, u long")
    inside = (F.col("ai") > 0) & (F.col("ai") < len(angle_grid(limit)) - 1)
    phi = _angle(F.col("ai"), limit) + F.when(inside, _between(F.col("l"), F.col("votes"), F.col("u"))).otherwise(0.0) * STEP
    ranked = alone.withColumn("phi", phi).withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("votes"), "phi", "family", "ri")))
    return ranked.filter(F.col("rank") <= most).select("image_id", "family", "phi", "votes", "rank")


def angle_histogram(found: DataFrame, limit: float = SPAN) -> DataFrame:
    """(image_id, ai, mass): lines' votes spread over neighbouring angles by a Gaussian."""
    spread = SPREAD / STEP
    reach = math.ceil(3 * spread)
    at = (F.col("phi") + limit) / STEP
    middle = F.floor(at + 0.5)
    each = found.select("image_id", "votes", at.alias("at"), F.explode(F.sequence(middle - reach, middle + reach)).alias("ai"))
    each = each.filter(F.col("ai").between(0, len(angle_grid(limit)) - 1))
    z = (F.col("ai") - F.col("at")) / spread
    return each.groupBy("image_id", F.col("ai").cast("int").alias("ai")).agg(F.sum(F.col("votes") * F.exp(-0.5 * z * z)).alias("mass"))


def histogram_peaks(masses: DataFrame, limit: float = SPAN, apart: float = 1.0, most: int = 3) -> DataFrame:
    """(image_id, place, phi, share): the strongest maxima at least ``apart`` degrees from stronger ones, and the share of the mass around
    each. Of a level stretch the left end is its maximum."""
    w = Window.partitionBy("image_id").orderBy("ai")
    beside = lambda f, k: F.when(f("ai").over(w) == F.col("ai") + k, f("mass").over(w)).otherwise(0.0)
    every = masses.withColumns({"l": beside(F.lag, -1), "u": beside(F.lead, 1)})
    top = (F.col("mass") > 0) & (F.col("mass") > F.col("l")) & (F.col("mass") >= F.col("u"))
    phi = _angle(F.col("ai"), limit) + STEP * _between(F.col("l"), F.col("mass"), F.col("u"))
    tops = F.sort_array(F.collect_list(F.when(top, F.struct((-F.col("mass")).alias("less"), phi.alias("phi")))))
    image = every.groupBy("image_id").agg(tops.alias("tops"), F.collect_list(F.struct(_angle(F.col("ai"), limit).alias("phi"), "mass")).alias("all"), F.sum("mass").alias("whole"))
    free = lambda chosen, t: (F.size(chosen) < most) & F.forall(chosen, lambda c: F.abs(c - t["phi"]) >= apart)
    chosen = F.aggregate("tops", F.array().cast("array<double>"), lambda c, t: F.when(free(c, t), F.concat(c, F.array(t["phi"]))).otherwise(c))
    out = image.select("image_id", "all", "whole", F.posexplode(chosen).alias("k", "phi"))
    near = F.aggregate(F.filter("all", lambda a: F.abs(a["phi"] - F.col("phi")) <= PEAK_RADIUS), F.lit(0.0), lambda t, a: t + a["mass"])
    return out.select("image_id", (F.col("k") + 1).alias("place"), "phi", F.least(near / F.col("whole"), F.lit(1.0)).alias("share"))


def line_support(found: DataFrame, tops: DataFrame) -> DataFrame:
    """(image_id, phi, n, h, v, confidence): lines near the first peak, their mean angle, that of each family, and how far
    to trust them."""
    near = found.join(tops.filter("place = 1").select("image_id", F.col("phi").alias("top"), "share"), "image_id").filter(F.abs(F.col("phi") - F.col("top")) <= PEAK_RADIUS)
    mean = lambda of: F.sum(F.when(of, F.col("phi") * F.col("votes"))) / F.sum(F.when(of, F.col("votes")))
    out = near.groupBy("image_id", "share").agg(mean(F.lit(True)).alias("phi"), F.count(F.lit(1)).alias("n"), *(mean(F.col("family") == f).alias(f) for f in "hv"))
    agree = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("h") - F.col("v"))), F.lit(0.65))
    base = 0.40 * F.col("share") + 0.35 * F.least(F.col("n") / 6, F.lit(1.0)) + 0.25 * agree
    return out.select("image_id", "phi", "n", "h", "v", (base * F.least(F.col("n") / LEAST_LINES, F.lit(1.0))).alias("confidence"))


def strong_points(points: DataFrame) -> DataFrame:
    """The points that profiles are made of: the strongest of an image, by thresholds from the counts of their strengths."""
    bins = points.groupBy("image_id", F.least(F.floor("strength"), F.lit(2048)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    run = bins.withColumns({"above": F.sum("n").over(Window.partitionBy("image_id").orderBy(F.desc("bin"))), "all": F.sum("n").over(Window.partitionBy("image_id"))})
    keep = F.least(F.greatest(F.floor(F.col("all") * KEEP_SHARE), F.lit(1)), F.lit(MOST_POINTS))
    top = F.greatest(F.ceil(F.col("all") * 0.005), F.lit(1))
    least = run.groupBy("image_id").agg(F.max(F.when(F.col("above") >= keep, F.col("bin"))).alias("k"), F.max(F.when(F.col("above") >= top, F.col("bin"))).alias("t"))
    least = least.select("image_id", F.greatest(F.lit(LEAST_GRADIENT), F.col("k"), STRONG_SHARE * F.col("t")).alias("least"))
    return points.join(least, "image_id").filter("strength >= least").drop("least")


def profile(dx: np.ndarray, dy: np.ndarray, w: np.ndarray, upright: bool, phi: float, half: float) -> float:
    """How sharp the points' smoothed profile across an angle is: sum b^2 / (sum b)^2 over bins a pixel wide, each point
    in the two beside it."""
    tan, offset = math.tan(math.radians(phi)), math.ceil(half) + 2.0
    n = math.ceil(2 * offset) + 1
    t = (dx + dy * tan if upright else dy - dx * tan) + offset
    low = np.floor(t).astype(np.int64)
    ok = (low >= 0) & (low + 1 < n)
    low, part, w = low[ok], (t - np.floor(t))[ok], w[ok]
    b = np.bincount(low, w * (1 - part), n) + np.bincount(low + 1, w * part, n)
    for _ in range(2):
        b = np.convolve(b, [0.25, 0.5, 0.25], "same")
    return float((b * b).sum() / b.sum() ** 2) if b.sum() > 0 else 0.0


def projection_scores(points: DataFrame, width: int, height: int, limit: float = SPAN, samples: DataFrame | None = None) -> DataFrame:
    """(image_id, family, [part,] ai, score): the sharpness of profiles of ``strong_points`` across the grid's angles, or across those of
    ``samples`` (image_id, family, part, first, step, n). A task holds one family of one image, of which there are few points."""
    flat = _centred(points, width, height).select("image_id", "family", "dx", "dy", "strength")
    if samples is None:
        flat = flat.select("*", F.lit(0).alias("part"), F.lit(-limit).alias("first"), F.lit(STEP).alias("step"), F.lit(len(angle_grid(limit))).alias("n"))
    else:
        flat = flat.join(samples, ["image_id", "family"])
    tan = math.tan(math.radians(limit))
    half = {"h": (height - 1) / 2 + tan * (width - 1) / 2, "v": (width - 1) / 2 + tan * (height - 1) / 2}

    def run(table: pa.Table) -> pa.Table:
        image, family, part, first, step, n = (table.column(c)[0].as_py() for c in ("image_id", "family", "part", "first", "step", "n"))
        dx, dy, w = (table.column(c).to_numpy() for c in ("dx", "dy", "strength"))
        scores = [profile(dx, dy, w, family == "v", first + step * k, half[family]) for k in range(n)]
        return pa.table({"image_id": pa.array([image] * n, pa.int32()), "family": pa.array([family] * n), "part": pa.array([part] * n, pa.int32()), "ai": pa.array(range(n), pa.int32()), "score": pa.array(scores, pa.float64())})

    out = flat.groupBy("image_id", "family", "part").applyInArrow(run, "image_id int, family string, part int, ai int, score double")
    return out.drop("part") if samples is None else out


def triangle_taps(size: int, out: int) -> list[list[tuple[int, float]]]:
    """For each place of a shorter axis, the places it is made of and their weights."""
    ratio, every = size / out, []
    reach = max(ratio, 1.0)
    for o in range(out):
        centre = (o + 0.5) * ratio
        low = min(max(math.floor(centre - reach), 0), size - 1)
        places = range(low, min(max(math.ceil(centre + reach), low + 1), size))
        weights = [max(0.0, 1.0 - abs((i + 0.5 - centre) / reach)) for i in places]
        every.append([(i, N.q9(w / sum(weights))) for i, w in zip(places, weights, strict=True) if w])
    return every


def shrunk(p: PixelFrame, long_edge: int) -> PixelFrame:
    """The column v of ``gray`` with the longer side at most ``long_edge``, along y and then x, by packed tiles. Sums are of whole numbers (values in
    millionths, weights in billionths), so that they do not depend on the order in which a shuffle brings rows."""
    long = max(p.width, p.height)
    if long <= long_edge:
        return p
    w, h = (max(1, int(N.half_away(s * long_edge / long))) for s in (p.width, p.height))
    tiles = K.Scaling([(p.width, p.height, w, h)], triangle_taps, 1.0, K.TILE)

    def run(tile, v, on):
        image, size, ty, tx = tile
        v, on = np.floor(v * 1e6 + 0.5).astype(np.int64), on if on is None else on[..., 0]
        (x0, across), (y0, down) = tiles.axis(size, tx, "x"), tiles.axis(size, ty, "y")
        for axis, each in ((0, down), (1, across)):
            if each is not None:
                whole = each[0], np.floor(each[1] * 1e9 + 0.5)
                v, on = (K.gathered_sums(v, whole, axis) + 500_000_000) // 1_000_000_000, on if on is None else K.reached(on, whole, axis)
        y, x = np.nonzero(np.ones(v.shape[:2], bool) if on is None else on)
        return pa.table([pa.array(np.full(len(y), image, np.int32)), pa.array(y + y0, pa.int32()), pa.array(x + x0, pa.int32()), pa.array(((v[y, x, 0] + 500_000) // 1_000_000).astype(np.float64))], [*KEY, "v"])

    rows = p.df.select(*KEY, "v", F.lit(0).alias(SIZE_ID), F.lit(0).alias("part"))
    return replace(p, df=K.by_tile(rows, tiles, ["v"], run, "image_id int, y int, x int, v double"), width=w, height=h)


def _sharpness(scores: Column, peak: Column) -> Column:
    """How far the median lies below the peak."""
    middle = F.element_at(F.sort_array(scores), F.floor(F.size(scores) / 2).cast("int") + 1)
    return F.when((F.size(scores) > 2) & (peak > 0), N.clamp((peak - middle) / peak / 0.2)).otherwise(0.0)


def family_facts(points: DataFrame, curves: DataFrame) -> DataFrame:
    """(image_id, family, mass, low, high, sharp, best, weight, part_of): of families with points enough; ``weight`` and ``part_of`` are
    shares of the image, by mass and sharpness and by mass."""
    size = points.groupBy("image_id", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("strength").alias("mass")).filter(F.col("n") >= FAMILY_POINTS)
    curve = curves.groupBy("image_id", "family").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.collect_list("score").alias("_all"), F.max_by("ai", F.struct("score", -F.col("ai"))).alias("best"))
    out = size.join(curve.withColumn("sharp", _sharpness(F.col("_all"), F.col("high"))).drop("_all"), ["image_id", "family"])
    pull, image = F.col("mass") * F.greatest("sharp", F.lit(0.1)), Window.partitionBy("image_id")
    return out.select("image_id", "family", "mass", "low", "high", "sharp", "best", (pull / F.sum(pull).over(image)).alias("weight"), (F.col("mass") / F.sum("mass").over(image)).alias("part_of"))


def _stretched(score: str = "score") -> Column:
    return F.when(F.col("high") > F.col("low"), (F.col(score) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)


def fused_curves(curves: DataFrame, facts: DataFrame) -> DataFrame:
    """(image_id, ai, both): the families' stretched curves by their weights."""
    return curves.join(facts, ["image_id", "family"]).groupBy("image_id", "ai").agg(F.sum(F.col("weight") * _stretched()).alias("both"))


def fused_facts(fused: DataFrame, facts: DataFrame) -> DataFrame:
    """(image_id, sharp, top): of the fused curve. Stretched scores are sharp for noise too, so the curve counts at most as its families do."""
    own = facts.groupBy("image_id").agg((F.sum(F.col("mass") * F.col("sharp")) / F.sum("mass")).alias("own"))
    image = fused.groupBy("image_id").agg(F.collect_list("both").alias("_all"), F.max("both").alias("peak"), F.max_by("ai", F.struct("both", -F.col("ai"))).alias("top"))
    return image.join(own, "image_id").select("image_id", F.least(_sharpness(F.col("_all"), F.col("peak")), "own").alias("sharp"), "top")


def samples_around(centres: DataFrame, limit: float) -> DataFrame:
    """Fine samples around ``centre``: first, step and n, inside the limit."""
    low, high = F.greatest(F.col("centre") - REFINE_RADIUS, F.lit(-limit)), F.least(F.col("centre") + REFINE_RADIUS, F.lit(limit))
    return centres.select("image_id", "family", "part", low.alias("first"), ((high - low) / (REFINE_SAMPLES - 1)).alias("step"), F.lit(REFINE_SAMPLES).alias("n"))


def centred_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, phi, height): of samples (x, w) the mean weighted by what lies above the least, and the value of the sample nearest to it."""
    all_ = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("s"), F.min("w").alias("least"))
    above = F.aggregate("s", F.lit(0.0), lambda t, e: t + e["w"] - F.col("least"))
    moment = F.aggregate("s", F.lit(0.0), lambda t, e: t + (e["w"] - F.col("least")) * e["x"])
    middle = (F.element_at("s", 1)["x"] + F.element_at("s", -1)["x"]) / 2.0
    out = all_.withColumn("phi", F.when(above > 0, moment / F.nullif(above, F.lit(0.0))).otherwise(middle))
    nearest = F.array_min(F.transform("s", lambda e: F.struct(F.abs(e["x"] - F.col("phi")).alias("far"), e["w"].alias("w"))))
    return out.select(*keys, "phi", nearest["w"].alias("height"))


def _round3(c: Column) -> Column:
    """To thousandths, half away from zero, without a negative zero."""
    return F.when(c < 0, -F.floor(-c * 1000.0 + 0.5)).otherwise(F.floor(c * 1000.0 + 0.5)).cast("double") / 1000.0 + 0.0


_PAIRS = "array<struct<angle: double, score: double>>"


def detect(p: PixelFrame, min_confidence: float = 0.5, max_abs_angle: float = SPAN, working_long_edge: int = 1024, edge_tile: int = EDGE_TILE) -> DataFrame:
    """One row for each image: tilt, confidence, n_lines, recommended, method, and what speaks for it.

    ``tilt`` is the clockwise angle of the image's level lines in degrees, null if nothing was found; ``recommended`` the
    rotation that levels it, null without enough confidence and evidence. ``n_lines`` counts the lines found,
    ``n_supporting`` those near the peak. Each family has its angle (as a rotation), confidence and share of the edges.
    Tables that several steps read are written to the shared folder.
    """
    limit, small = min(max(max_abs_angle, 0.5), 45.0), shrunk(gray(p), max(working_long_edge, 64))
    size, (w, h) = (p.width, p.height), (small.width, small.height)
    if small.df is not p.df and size != (w, h):
        small = replace(small, df=written(small.df, "small"))
    images = small.df.select(F.col("image_id").cast("int").alias("image_id")).distinct()
    if min(w, h) < LEAST_SIDE:
        return _told(images.select("image_id", F.lit(f"sides of at least {LEAST_SIDE} pixels are needed").alias("_small")), min_confidence, size)
    small = replace(small, df=small.df.select(*(F.col(c).cast("int").alias(c) for c in KEY), "v"))
    slopes = written(gradients(small), "gradients")

    found = written(lines(edge_points(canny_edges(small, edge_tile), limit), w, h, limit=limit), "lines")
    masses = written(angle_histogram(found, limit), "masses")
    tops = written(histogram_peaks(masses, limit), "tops")
    support = line_support(found, tops).select("image_id", F.col("phi").alias("line_phi"), F.col("n").alias("n_supporting"), F.col("confidence").alias("line_confidence"))

    points = written(strong_points(edge_points(slopes, limit)), "strong-points")
    curves = written(projection_scores(points, w, h, limit), "curves")
    facts = written(family_facts(points, curves), "facts")
    fused = written(fused_curves(curves, facts), "fused")
    whole = fused_facts(fused, facts).withColumn("usable", F.col("sharp") >= USABLE)

    # what the fine samples lie around: near the lines' angle the fused curve's best place, else the best of all
    angled = lambda df: df.withColumn("x", _angle(F.col("ai"), limit))
    near = angled(fused).join(support, "image_id").filter(F.abs(F.col("x") - F.col("line_phi")) <= HOUGH_RADIUS)
    near = near.groupBy("image_id").agg(F.max_by("x", F.struct("both", -F.col("ai"))).alias("near"))
    image = images.join(whole, "image_id", "left").join(support, "image_id", "left").join(near, "image_id", "left")
    best = _angle(F.col("top"), limit)
    centre = F.when(F.col("usable"), F.coalesce("near", "line_phi", best)).otherwise(F.col("line_phi"))
    image = written(image.withColumns({"centre": centre, "best": best}), "centres")
    around = facts.join(image.select("image_id", F.coalesce("centre", "best").alias("centre"), F.col("centre").isNotNull().alias("known")), "image_id")
    step = Window.partitionBy("image_id", "family").orderBy("ai")
    peaks = angled(curves).withColumns({"l": F.lag("score").over(step), "u": F.lead("score").over(step)}).filter("score >= l and score >= u")
    own = peaks.join(around.select("image_id", "family", "centre", "known"), ["image_id", "family"])
    own = own.filter(~F.col("known") | (F.abs(F.col("x") - F.col("centre")) < FAMILY_WINDOW)).groupBy("image_id", "family").agg(F.max_by("x", F.struct("score", -F.col("ai"))).alias("centre"))
    wanted = around.select("image_id", "family", F.lit(0).alias("part"), "centre").unionByName(own.select("image_id", "family", F.lit(1).alias("part"), "centre"))
    asked = samples_around(wanted, limit)
    fine = projection_scores(points, w, h, limit, asked).join(asked, ["image_id", "family", "part"]).join(facts, ["image_id", "family"])
    fine = written(fine.select("image_id", "family", "part", (F.col("first") + F.col("step") * F.col("ai")).alias("x"), _stretched().alias("s"), "weight", "sharp"), "samples")
    both = fine.filter("part = 0").groupBy("image_id", "x").agg(F.sum(F.col("weight") * F.col("s")).alias("w"))
    both = centred_means(both, ["image_id"]).select("image_id", F.col("phi").alias("fine_phi"))
    each = centred_means(fine.filter("part = 1").withColumn("w", F.col("s")), ["image_id", "family"]).join(facts, ["image_id", "family"])
    each = each.join(image.select("image_id", F.col("centre").isNotNull().alias("known")), "image_id")
    each = each.withColumn("trust", F.when(F.col("known"), N.clamp(F.col("height")) * F.col("sharp")).otherwise(F.col("sharp")))
    of = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c)))
    families = facts.select("image_id", "family", "part_of").join(each.select("image_id", "family", "phi", "trust"), ["image_id", "family"], "left")
    families = families.groupBy("image_id").agg(*(of(f, c).alias(f"{f}_{c}") for f in "hv" for c in ("phi", "trust", "part_of")))

    counts = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_lines"))
    pairs = tops.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "phi", "share"))), lambda t: F.struct(_round3(-t["phi"]).alias("angle"), _round3(t["share"]).alias("score"))).alias("tops"))
    rows = written(image.join(both, "image_id", "left").join(families, "image_id", "left").join(counts, "image_id", "left").join(pairs, "image_id", "left"), "found")
    return _told(rows.join(_curve(rows, fused, masses, limit), "image_id", "left"), min_confidence, size)


def _phi() -> Column:
    """The angle that an image's rows tell."""
    return F.when(F.col("usable"), F.col("fine_phi")).otherwise(F.col("line_phi"))


def _curve(rows: DataFrame, fused: DataFrame, masses: DataFrame, limit: float) -> DataFrame:
    """(image_id, score_curve): the fused curve by the levelling angle, lifted where lines are; only the told angle itself has 1."""
    peak = _round3(-F.coalesce(_phi(), "fine_phi"))
    most = masses.groupBy("image_id").agg(F.max("mass").alias("most"))
    every = fused.join(masses, ["image_id", "ai"], "left").join(most, "image_id", "left").join(rows.select("image_id", peak.alias("peak"), _phi().isNotNull().alias("_any")), "image_id")
    image = Window.partitionBy("image_id")
    low, high = F.min("both").over(image), F.max("both").over(image)
    lifted = F.when(F.col("_any") & (F.col("most") > 0), CURVE_FLOOR + (1 - CURVE_FLOOR) * F.coalesce("mass", F.lit(0.0)) / F.col("most")).otherwise(1.0)
    every = every.withColumn("v", F.when(high > low, (F.col("both") - low) / (high - low)).otherwise(0.0) * lifted)
    n = len(angle_grid(limit))
    stride = max(-(-n // (CURVE_POINTS - 1)), 1)
    top = F.max("v").over(image)
    every = every.withColumn("score", _round3(F.when(top > 0, N.clamp(F.col("v") * CURVE_MOST / top)).otherwise(0.0)))
    kept = (F.col("ai") % stride == 0) | (F.col("ai") == n - 1)
    angle = _round3(-_angle(F.col("ai"), limit))
    pairs = F.collect_list(F.when(kept & (F.abs(angle - F.col("peak")) >= STEP * 0.5), F.struct(angle.alias("angle"), F.col("score").alias("score"))))
    out = every.groupBy("image_id", "peak").agg(pairs.alias("pairs"))
    return out.select("image_id", F.sort_array(F.concat("pairs", F.array(F.struct(F.col("peak").alias("angle"), F.lit(1.0).alias("score"))))).alias("score_curve"))


def _told(rows: DataFrame, min_confidence: float, size: tuple[int, int]) -> DataFrame:
    """The answer for each image from what the steps found; columns that no step made are null."""
    kinds = {"usable": "boolean", "n_lines": "long", "n_supporting": "long", "tops": _PAIRS, "score_curve": _PAIRS, "_small": "string"}
    names = ["sharp", "usable", "line_phi", "fine_phi", "line_confidence", "n_supporting", "n_lines", "tops", "score_curve", "_small", *(f"{f}_{c}" for f in "hv" for c in ("phi", "trust", "part_of"))]
    rows = rows.select("image_id", *((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in names))
    lined, usable, phi = F.col("line_phi").isNotNull(), F.coalesce("usable", F.lit(False)), _phi()
    apart = F.abs(F.col("h_phi") - F.col("v_phi"))
    alone = 0.60 * F.col("sharp") + 0.40 * F.coalesce(N.clamp(1.0 - apart), F.lit(0.65))
    confidence = F.when(lined, F.col("line_confidence")).when(usable, alone).otherwise(0.0)
    n = F.coalesce("n_supporting", F.lit(0))
    enough = F.when(lined, n >= LEAST_LINES).when(usable, F.col("sharp") >= ALONE).otherwise(False)
    rows = rows.withColumns({"phi": phi, "sure": confidence, "enough": enough})
    good = F.col("enough") & (F.col("sure") >= min_confidence)
    told = [
        F.col("_small"),
        F.when(lined & (n < LEAST_LINES), F.format_string("%d line(s) lie near the peak, which is too little to go by", n)),
        F.when(~lined & usable & (F.col("sharp") < ALONE), "profiles have no clear peak"),
        F.when(~lined & ~usable & F.col("_small").isNull(), "neither lines nor profiles show a tilt"),
        F.when(phi.isNotNull() & (apart > DISAGREEMENT), F.format_string("level lines ask for %+.2f and upright ones for %+.2f degrees, as perspective makes them", -F.col("h_phi"), -F.col("v_phi"))),
        F.when(phi.isNotNull() & (F.col("sure") < min_confidence), F.format_string(f"confidence is %.2f, and {min_confidence:.2f} was asked for", F.col("sure"))),
        F.when(phi.isNotNull() & good, F.format_string("levelling cuts about %.1f per cent of the pixels away", loss_percent(F.lit(float(size[0])), F.lit(float(size[1])), phi))),
    ]
    zero = lambda c: _round3(F.coalesce(c, F.lit(0.0)))
    sides = [e for f, name in (("h", "horizontal"), ("v", "vertical")) for e in (_round3(-F.col(f"{f}_phi")).alias(f"{name}_angle"), zero(f"{f}_trust").alias(f"{name}_confidence"), zero(f"{f}_part_of").alias(f"{name}_support"))]
    none = F.array().cast(_PAIRS)
    alternatives = F.when(lined, F.col("tops")).when(usable, F.array(F.struct(_round3(-phi).alias("angle"), _round3(F.col("sharp")).alias("score")))).otherwise(none)
    method = F.when(lined & usable, "hough_projection_fused").when(~lined & usable, "projection_profile").otherwise("dominant_hv_lines")
    return rows.select(
        "image_id", _round3(F.col("phi")).alias("tilt"), _round3(F.col("sure")).alias("confidence"), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.when(good & phi.isNotNull(), _round3(-F.col("phi"))).alias("recommended"), method.alias("method"), n.cast("long").alias("n_supporting"), *sides,
        alternatives.alias("alternatives"), F.coalesce("score_curve", none).alias("score_curve"), F.array_compact(F.array(*told)).alias("warnings"),
    )
