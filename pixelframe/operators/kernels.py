"""Neighbourhood operators with large footprints, as numpy kernels on tiles of an image with what lies around them.

Pixels travel packed: a task sends, for each tile that some of its pixels belong to or lie near, one row with their places and
values (``squeezed``), so that no pixel is a row of a shuffle. Kernels that follow one another share one exchange: the frame remembers what it
came from (``Chain``), the halos add up, and each tile runs all kernels in turn, giving up after each the rim that has
lost its surroundings. A group is one tile and (image_id, ty, tx) spreads large images over tasks, so a task's memory does not depend
on the size of images. Only what needs an image in one piece, as a file does, takes it so.

Warps cut the result into cells until what a cell reads of the source is bounded too. Healing runs on tiles of the
patch: source and target pixels come to the tile of their place in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import SIZE_ID, PixelFrame

#: Pixels along a tile's side, and along the side of the blocks by which cells of a warp get their sources.
TILE, BLOCK = 1024, 256
#: Pixels that a task gathers before it packs them.
GATHER = 1 << 18
#: A warp's cell reads at most so many tiles' worth of source pixels; cells of at most so many pixels a side are traced exactly.
MOST_SOURCE, EXACT = 2.5, 64

Kernel = Callable[[np.ndarray, int, np.ndarray | None], np.ndarray]


def _schema(p: PixelFrame) -> str:
    return f"image_id int, y int, x int, {SIZE_ID + ' int, ' if p.mixed else ''}r double, g double, b double, a double"


def _pixels(table: pa.Table, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """The array (height, width, 4) of the rows of a table, by their place from (x0, y0)."""
    out = np.zeros((height, width, 4))
    y, x = table.column("y").to_numpy() - y0, table.column("x").to_numpy() - x0
    for i, c in enumerate("rgba"):
        out[y, x, i] = table.column(c).to_numpy()
    return out


def _table(image: int, size: int | None, out: np.ndarray, x0: int, y0: int) -> pa.Table:
    ys, xs = np.indices(out.shape[:2], np.int32)
    columns = {"image_id": pa.array(np.full(ys.size, image, np.int32)), "y": pa.array((ys + y0).ravel(), pa.int32()), "x": pa.array((xs + x0).ravel(), pa.int32())}
    if size is not None:
        columns[SIZE_ID] = pa.array(np.full(ys.size, size, np.int32))
    return pa.table(columns | {c: pa.array(out[..., i].ravel()) for i, c in enumerate("rgba")})


def per_batch(p: PixelFrame, f: Callable[[np.ndarray], np.ndarray]) -> PixelFrame:
    """``f`` maps colours (n, 3) to others, pixel by pixel."""
    keys = list(p.keys)

    def run(batches):
        for b in batches:
            rgb = f(np.stack([b.column(c).to_numpy() for c in "rgb"], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), *(pa.array(rgb[:, i]) for i in range(3)), b.column("a")], [*keys, *"rgba"])

    return replace(p, df=p.df.select(*keys, *"rgba").mapInArrow(run, _schema(p)))


# packed tiles


def gathered(batches):
    """Record batches of about ``GATHER`` rows as dicts of numpy columns."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= GATHER:
            yield _columns(held)
            held, n = [], 0
    if n:
        yield _columns(held)


def _columns(batches: list) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {c: table.column(c).to_numpy() for c in table.column_names}


@dataclass(frozen=True)
class Tiles:
    """Tiles of one side of images of some sizes, with what lies at most ``halo`` around them."""

    sizes: Sequence[tuple[int, int]]
    side: int
    halo: int

    def window(self, size: int, ty: int, tx: int) -> tuple[int, int, int, int]:
        """Left, top, right and bottom of a tile with its halo, inside the image."""
        (w, h), side, halo = self.sizes[size], self.side, self.halo
        return max(0, tx * side - halo), max(0, ty * side - halo), min(w, (tx + 1) * side + halo), min(h, (ty + 1) * side + halo)

    def near(self, size: np.ndarray, c: dict[str, np.ndarray], axis: str) -> tuple[np.ndarray, np.ndarray]:
        """Of pixels the first and the last tile along an axis that they belong to or lie near."""
        n = np.array(self.sizes, np.int64)[size, "xy".index(axis)]
        return np.maximum(0, (c[axis] - self.halo) // self.side), np.minimum((n - 1) // self.side, (c[axis] + self.halo) // self.side)


def _pieces(c: dict[str, np.ndarray], tiles: Tiles | Scaling):
    """Rows by the tiles that they belong to or lie near: (image, size, ty, tx, part), and the row numbers of each."""
    size = c[SIZE_ID]
    low, high = {}, {}
    for axis in "yx":
        low[axis], high[axis] = tiles.near(size, c, axis)
    picked, ty, tx = [], [], []
    for j in range(int((high["y"] - low["y"]).max()) + 1):
        for i in range(int((high["x"] - low["x"]).max()) + 1):
            rows = np.flatnonzero((low["y"] + j <= high["y"]) & (low["x"] + i <= high["x"]))
            picked.append(rows)
            ty.append(low["y"][rows] + j)
            tx.append(low["x"][rows] + i)
    rows, ty, tx = np.concatenate(picked), np.concatenate(ty), np.concatenate(tx)
    keys = c["image_id"][rows], size[rows], ty, tx, c["part"][rows]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)])) if len(order) else []
    for a, b in zip(first, [*first[1:], len(order)], strict=True):
        yield tuple(int(k[a]) for k in keys), rows[order[a:b]]


def squeezed(values: np.ndarray) -> bytes:
    """Columns of doubles, exactly, in as few bytes as their distinct values allow: a table of them and places in it of one or two bytes,
    as channels that come from code values have, or else the doubles."""
    out = []
    for v in values.T:
        v = np.ascontiguousarray(v)
        table = at = None
        bits = v.view(np.int64)
        some = np.unique(bits[:2048])
        if len(some) <= 1024:
            table, at = some, np.minimum(np.searchsorted(some, bits), len(some) - 1)
            if not np.array_equal(table[at], bits):
                table, at = np.unique(bits, return_inverse=True)
        if table is None or len(table) > 65536 or len(table) * 8 + (1 if len(table) <= 256 else 2) * len(v) >= 8 * len(v):
            out += [np.array([0], np.int64).tobytes(), v.tobytes()]
        else:
            out += [np.array([len(table)], np.int64).tobytes(), table.tobytes(), at.astype(np.uint8 if len(table) <= 256 else np.uint16).tobytes()]
    return b"".join(out)


def loosened(data, n: int, columns: int = 4) -> np.ndarray:
    """The columns (n, ``columns``) again."""
    out, at = np.empty((n, columns)), 0
    for i in range(columns):
        (size,) = np.frombuffer(data, np.int64, 1, at)
        at += 8
        if not size:
            out[:, i] = np.frombuffer(data, np.float64, n, at)
            at += 8 * n
            continue
        table = np.frombuffer(data, np.float64, size, at)
        at += 8 * int(size)
        kind = np.dtype(np.uint8 if size <= 256 else np.uint16)
        out[:, i] = table[np.frombuffer(data, kind, n, at)]
        at += kind.itemsize * n
    return out


def runs(places: np.ndarray) -> bytes:
    """Places as runs (first, length) of consecutive ones."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
    return np.stack([places[first], np.diff(np.append(first, len(places)))], 1).astype(np.uint32).tobytes()


def places(data) -> np.ndarray:
    first, n = np.frombuffer(data, np.uint32).reshape(-1, 2).astype(np.int64).T
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


PIECE = "image_id int, size_id int, ty int, tx int, part int, at binary, data binary"


def packed(rows: DataFrame, sizes: Sequence[tuple[int, int]], halo: int) -> DataFrame:
    """One row for each tile and batch of ``rows`` (image_id, size_id, part, y, x, r, g, b, a): places in the tile's window and values."""
    return _sent(rows, Tiles(sizes, TILE, halo), "rgba")


def _sent(rows: DataFrame, tiles: Tiles | Scaling, columns: Sequence[str]) -> DataFrame:
    def run(batches):
        for c in gathered(batches):
            values = np.stack([c[k] for k in columns], 1)
            for (image, size, ty, tx, part), at in _pieces(c, tiles):
                x0, y0, x1, _ = tiles.window(size, ty, tx)
                place = (c["y"][at] - y0).astype(np.int64) * (x1 - x0) + (c["x"][at] - x0)
                yield pa.RecordBatch.from_pydict({
                    "image_id": pa.array([image], pa.int32()), "size_id": pa.array([size], pa.int32()), "ty": pa.array([ty], pa.int32()), "tx": pa.array([tx], pa.int32()),
                    "part": pa.array([part], pa.int32()), "at": pa.array([runs(place)], pa.binary()), "data": pa.array([squeezed(values[at])], pa.binary()),
                })

    return rows.select("image_id", SIZE_ID, "part", "y", "x", *columns).mapInArrow(run, PIECE)


def by_tile(rows: DataFrame, tiles: Tiles | Scaling, columns: Sequence[str], f: Callable, schema: str, parts: int = 1) -> DataFrame:
    """``f`` on each tile: (image, size, ty, tx), values (height, width, columns * parts) of its window, and which places of it have a pixel
    (height, width, parts), None if all have."""
    width = len(columns)

    def run(table: pa.Table) -> pa.Table:
        image, size, ty, tx = (int(table.column(c)[0].as_py()) for c in ("image_id", "size_id", "ty", "tx"))
        x0, y0, x1, y1 = tiles.window(size, ty, tx)
        v, on = np.zeros(((y1 - y0) * (x1 - x0), width * parts)), np.zeros(((y1 - y0) * (x1 - x0), parts), bool)
        for part, at, data in zip(*(table.column(c) for c in ("part", "at", "data")), strict=True):
            k, at = part.as_py(), places(at.as_buffer())
            v[at, width * k : width * (k + 1)] = loosened(data.as_buffer(), len(at), width)
            on[at, k] = True
        return f((image, size, ty, tx), v.reshape(y1 - y0, x1 - x0, -1), None if on.all() else on.reshape(y1 - y0, x1 - x0, parts))

    # packed tiles are few bytes and much work: by number, so that they are not put together by their bytes
    tile = ["image_id", "size_id", "ty", "tx"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _sent(rows, tiles, columns).repartition(n, *tile).groupBy(*tile).applyInArrow(run, schema)


def _tiled(rows: DataFrame, sizes: Sequence[tuple[int, int]], steps: Sequence[tuple[Kernel, int]], schema: str, mixed: bool, parts: int = 1) -> DataFrame:
    """Kernels over tiles of ``rows``; a kernel gets (height, width, 4 * parts), the number of the size and which places have a pixel, and
    gives (height, width, 4). Places without a pixel get none."""
    side, tiles = TILE, Tiles(sizes, TILE, sum(h for _, h in steps))

    def run(tile, v, on):
        image, size, ty, tx = tile
        x0, y0, x1, y1 = tiles.window(size, ty, tx)
        for kernel, rim in steps:
            v = kernel(v, size, on)
            # beside an edge that is not the image's the rim has not seen its surroundings
            left, top = rim * (x0 > 0), rim * (y0 > 0)
            right, bottom = rim * (x1 < sizes[size][0]), rim * (y1 < sizes[size][1])
            v, on = (k if k is None else k[top : k.shape[0] - bottom, left : k.shape[1] - right] for k in (v, on))
            x0, y0, x1, y1 = x0 + left, y0 + top, x1 - right, y1 - bottom
        v, on = (k if k is None else k[ty * side - y0 :, tx * side - x0 :][:side, :side] for k in (v, on))
        out = _table(image, size if mixed else None, v, tx * side, ty * side)
        return out if on is None else out.filter(pa.array(on.all(2).ravel()))

    return by_tile(rows, tiles, "rgba", run, schema, parts)


@dataclass(frozen=True)
class Chain:
    """A frame, and the kernels that lead from it to ``df``."""

    base: PixelFrame
    steps: tuple[tuple[Kernel, int], ...]
    df: DataFrame


def per_tile(p: PixelFrame, kernel: Callable[[np.ndarray, np.ndarray | None], np.ndarray], halo: int) -> PixelFrame:
    """``kernel`` maps an array (height, width, 4), and which of its places have a pixel, to one of the same size, in which a pixel depends on
    those at most ``halo`` away along either axis; beyond the image's edges it sees what it does beyond the array's. A kernel right after
    others is run with them, as long as the halos together are at most half a tile."""
    before: Any = p.pending if p.pending is not None and p.pending.df is p.df else None
    if before is not None and sum(h for _, h in before.steps) + halo > TILE // 2:
        before = None
    base, steps = (before.base, before.steps) if before is not None else (p, ())
    steps = (*steps, (lambda v, _, on: kernel(v, None if on is None else on[..., 0]), halo))
    rows = base.df if base.mixed else base.df.withColumn(SIZE_ID, F.lit(0))
    df = _tiled(rows.withColumn("part", F.lit(0)), base.each(lambda e: (e.width, e.height)), steps, _schema(p), p.mixed)
    return replace(p, df=df, pending=Chain(base, steps, df))


# other sizes


@lru_cache(maxsize=64)
def _taps(of: Callable, size: int, out: int) -> list[list[tuple[int, float]]]:
    return of(size, out)


@dataclass(frozen=True)
class Scaling:
    """Tiles of images at other sizes, each with the source pixels that its taps reach. ``plans``: (width, height, new width, new height);
    ``taps`` tells an axis' (source place, weight) for each new place, ``support`` how many source pixels, or new ones if these are larger, they reach."""

    plans: Sequence[tuple[int, int, int, int]]
    taps: Callable[[int, int], list[list[tuple[int, float]]]]
    support: float
    side: int

    def _axis(self, size: int, axis: str) -> tuple[int, int, int, float]:
        """Old and new length, places of a tile, reach. Tiles are smaller where many source pixels make a new one, so that a tile's source stays bounded."""
        i = "xy".index(axis)
        n, out = self.plans[size][i], self.plans[size][i + 2]
        reach, most = 0 if n == out else self.support * max(1.0, n / out), MOST_SOURCE**0.5 * self.side
        return n, out, min(self.side, max(1, int(max(most - 2 * reach, reach) * out / n))), reach

    def ends(self, size: int, axis: str) -> tuple[np.ndarray, np.ndarray]:
        """First source place of each tile along an axis, and the one behind its last."""
        n, out, side, reach = self._axis(size, axis)
        first = np.arange(0, out, side)
        if n == out:
            return first, np.minimum(first + side, n)
        low = np.floor((first + 0.5) * n / out - reach)
        high = np.ceil((np.minimum(first + side, out) - 0.5) * n / out + reach)
        return np.clip(low, 0, n - 1).astype(np.int64), np.clip(high, 0, n - 1).astype(np.int64) + 1

    def window(self, size: int, ty: int, tx: int) -> tuple[int, int, int, int]:
        (left, right), (top, bottom) = self.ends(size, "x"), self.ends(size, "y")
        return int(left[tx]), int(top[ty]), int(right[tx]), int(bottom[ty])

    def near(self, size: np.ndarray, c: dict[str, np.ndarray], axis: str) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for k in np.unique(size):
            (first, stop), rows = self.ends(k, axis), size == k
            low[rows], high[rows] = np.searchsorted(stop, c[axis][rows], "right"), np.searchsorted(first, c[axis][rows], "right") - 1
        return low, high

    def axis(self, size: int, at: int, axis: str) -> tuple[int, tuple[np.ndarray, np.ndarray] | None]:
        """Of a tile the first new place, and (new place, tap) of places in its window and of weights, from left to right; None if the axis keeps its length."""
        n, out, side, _ = self._axis(size, axis)
        first = at * side
        if n == out:
            return first, None
        every, start = _taps(self.taps, n, out)[first : first + side], self.ends(size, axis)[0][at]
        most = max(map(len, every))
        place, weight = np.zeros((len(every), most), np.int64), np.zeros((len(every), most))
        for o, each in enumerate(every):
            place[o, : len(each)], weight[o, : len(each)] = zip(*((i - start, w) for i, w in each), strict=True)
        return first, (place, weight)


def gathered_sums(v: np.ndarray, taps: tuple[np.ndarray, np.ndarray], axis: int) -> np.ndarray:
    """Along an axis the sums of an image's (height, width, channels) values by their weights, from left to right."""
    total, part = None, None
    for place, w in zip(taps[0].T, taps[1].T, strict=True):
        w = w.astype(v.dtype)[:, None, None] if axis == 0 else w.astype(v.dtype)[:, None]
        part = np.take(v, place, axis, out=part)
        part *= w
        total = part.copy() if total is None else np.add(total, part, out=total)
    return total


def reached(on: np.ndarray, taps: tuple[np.ndarray, np.ndarray], axis: int) -> np.ndarray:
    """Which new places any pixel makes."""
    w = (taps[1] != 0).T
    return np.any([np.take(on, place, axis) & (k[:, None] if axis == 0 else k) for place, k in zip(taps[0].T, w, strict=True)], 0)


def scaled(p: PixelFrame, sizes: Sequence[tuple[int, int]], taps: Callable, support: float) -> DataFrame:
    """Pixels at other sizes, along x and then y, in premultiplied colour. A pixel is there if any of those that make it is."""
    tiles, mixed = Scaling([(e.width, e.height, w, h) for e, (w, h) in zip(p.shapes, sizes, strict=True)], taps, support, TILE), p.mixed

    def run(tile, v, on):
        image, size, ty, tx = tile
        v, on = premultiplied(v), on if on is None else on[..., 0]
        (x0, across), (y0, down) = tiles.axis(size, tx, "x"), tiles.axis(size, ty, "y")
        for axis, each in ((1, across), (0, down)):
            if each is not None:
                v, on = gathered_sums(v, each, axis), on if on is None else reached(on, each, axis)
        v[..., 3] = np.clip(v[..., 3], 0, 1)
        out = _table(image, size if mixed else None, unpremultiplied(v), x0, y0)
        return out if on is None else out.filter(pa.array(on.ravel()))

    rows = p.df if mixed else p.df.withColumn(SIZE_ID, F.lit(0))
    return by_tile(rows.withColumn("part", F.lit(0)), tiles, "rgba", run, _schema(p))


# warps


@dataclass(frozen=True)
class Warp:
    """From places of a result of this size to places of a source."""

    inverse: np.ndarray
    width: int
    height: int
    source_width: int
    source_height: int


def source_box(w: Warp, x0: int, y0: int, x1: int, y1: int) -> tuple[int, int, int, int] | None:
    """Source pixels (left, top, right, bottom) that the taps of a cell reach; None if the cell meets the horizon."""
    corners = w.inverse @ np.array([[x0, x1, x0, x1], [y0, y0, y1, y1], [1, 1, 1, 1]], float)
    if not ((corners[2] > 1e-9).all() or (corners[2] < -1e-9).all()):
        return None
    u, v = corners[:2] / corners[2]
    left, right = np.clip([u.min() - 4, u.max() + 4], 0, w.source_width).astype(int)
    top, bottom = np.clip([v.min() - 4, v.max() + 4], 0, w.source_height).astype(int)
    return int(left), int(top), int(right), int(bottom)


def traced_box(w: Warp, x0: int, y0: int, x1: int, y1: int) -> tuple[int, int, int, int]:
    """The same, pixel by pixel."""
    u, v = _sources(w.inverse, x0, y0, x1, y1)
    with np.errstate(invalid="ignore"):
        reach = (u > -3) & (u < w.source_width + 2) & (v > -3) & (v < w.source_height + 2)
    if not reach.any():
        return 0, 0, 0, 0
    u, v = np.floor(u[reach]), np.floor(v[reach])
    left, right = np.clip([u.min() - 1, u.max() + 3], 0, w.source_width).astype(int)
    top, bottom = np.clip([v.min() - 1, v.max() + 3], 0, w.source_height).astype(int)
    return int(left), int(top), int(right), int(bottom)


def cells(w: Warp) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(left, top, right, bottom) of the result's cells, each with its source box: tiles, cut into four until the box is small enough."""
    side, most = TILE, MOST_SOURCE * TILE * TILE
    left = [(x, y, min(w.width, x + side), min(w.height, y + side)) for y in range(0, w.height, side) for x in range(0, w.width, side)]
    out = []
    while left:
        x0, y0, x1, y1 = cell = left.pop()
        box = source_box(w, *cell)
        if box is None and max(x1 - x0, y1 - y0) <= EXACT:
            box = traced_box(w, *cell)
        if (x1 - x0) * (y1 - y0) == 1 or box is not None and (box[2] - box[0]) * (box[3] - box[1]) <= most:
            out.append((*cell, *box))
            continue
        xs = [x0, (x0 + x1) // 2, x1] if x1 - x0 > 1 else [x0, x1]
        ys = [y0, (y0 + y1) // 2, y1] if y1 - y0 > 1 else [y0, y1]
        left += [(a, c, b, d) for a, b in zip(xs, xs[1:], strict=False) for c, d in zip(ys, ys[1:], strict=False)]
    return out


def per_window(p: PixelFrame, warps: Sequence[Warp], border: tuple[float, ...]) -> DataFrame:
    """Pixels of a warp's result, a warp for each extent: each cell with the source pixels that it reaches."""
    plans = [cells(w) for w in warps]
    rows = [
        (k, by, bx, cell, *box)
        for k, plan in enumerate(plans) for cell, (*_, x0, y0, x1, y1) in enumerate(plan) if x0 < x1 and y0 < y1
        for box in [(x0, y0, x1 - 1, y1 - 1)]
        for by in range(y0 // BLOCK, (y1 - 1) // BLOCK + 1) for bx in range(x0 // BLOCK, (x1 - 1) // BLOCK + 1)
    ]
    spark, mixed, schema = p.df.sparkSession, p.mixed, _schema(p)
    reach = spark.createDataFrame(rows, f"{SIZE_ID} int, by int, bx int, cell int, x0 int, y0 int, x1 int, y1 int")
    # an image of 100 million pixels has 1,526 blocks, and few cells reach one block; frames of many sizes may have more rows
    reach = F.broadcast(reach) if len(rows) <= 100_000 else reach
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int").alias(f"b{c}")
    size = F.col(SIZE_ID) if mixed else F.lit(0).alias(SIZE_ID)
    held = p.df.select("image_id", size, "y", "x", *"rgba", block("y"), block("x")).join(reach, [SIZE_ID, "by", "bx"])
    held = held.filter("x between x0 and x1 and y between y0 and y1").select("image_id", SIZE_ID, "y", "x", *"rgba", "cell")
    # a cell that reaches no pixel is all border; one row without a place stands for each cell
    counts = p.pick([len(plan) for plan in plans])
    marks = p.images().select("image_id", size, F.explode(F.sequence(F.lit(0), counts - 1)).alias("cell"))
    none = [F.lit(None).cast("int").alias(c) for c in ("y", "x")] + [F.lit(0.0).alias(c) for c in "rgba"]
    held = held.unionByName(marks.select("image_id", SIZE_ID, *none, "cell"))

    def run(table: pa.Table) -> pa.Table:
        image, k, cell = (int(table.column(c)[0].as_py()) for c in ("image_id", SIZE_ID, "cell"))
        x0, y0, x1, y1, left, top, right, bottom = plans[k][cell]
        table = table.filter(table.column("y").is_valid())
        source, on = _pixels(table, left, top, right - left, bottom - top), None
        if table.num_rows < (right - left) * (bottom - top):
            on = np.zeros(source.shape[:2], bool)
            on[table.column("y").to_numpy() - top, table.column("x").to_numpy() - left] = True
        out = warped(source, warps[k].inverse, (x0, y0, x1, y1), (left, top), (warps[k].source_width, warps[k].source_height), border, on)
        return _table(image, k if mixed else None, out, x0, y0)

    return held.groupBy("image_id", SIZE_ID, "cell").applyInArrow(run, schema)


def premultiplied(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    out[..., :3] *= v[..., 3:]
    return out


def unpremultiplied(v: np.ndarray) -> np.ndarray:
    a = v[..., 3:]
    rgb = np.where(a < 1e-6, 0.0, np.clip(v[..., :3] / np.where(a < 1e-6, 1.0, a), 0, 1))
    return np.concatenate([rgb, a], -1)


def held(v: np.ndarray, on: np.ndarray | None, axis: int) -> np.ndarray:
    """Places without a pixel have along an axis the value of the last one before them that has one, or else of the first."""
    if on is None:
        return v
    n, mask = v.shape[axis], np.moveaxis(on, axis, 0)
    at = np.maximum.accumulate(np.where(mask, np.arange(n)[:, None], -1), 0)
    at = np.moveaxis(np.where(at < 0, mask.argmax(0), at), 0, axis)
    return np.take_along_axis(v, at[..., None], axis)


def closed(v: np.ndarray, on: np.ndarray | None, axis: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The values along an axis without the places that have no pixel, the last one repeated behind them, and for each place where its
    value now is: neighbours along an axis are the pixels next to one another, as they are to window expressions."""
    if on is None:
        return v, None
    mask = np.moveaxis(on, axis, 0)
    order, last = np.argsort(~mask, 0, kind="stable"), np.maximum(mask.sum(0) - 1, 0)
    order = np.take_along_axis(order, np.minimum(np.arange(len(mask))[:, None], last), 0)
    rank = np.maximum(np.cumsum(mask, 0) - 1, 0)
    return np.take_along_axis(v, np.moveaxis(order, 0, axis)[..., None], axis), np.moveaxis(rank, 0, axis)


def opened(v: np.ndarray, rank: np.ndarray | None, axis: int) -> np.ndarray:
    """Values back at their places."""
    return v if rank is None else np.take_along_axis(v, rank[..., None], axis)


#: Bytes of values that a pass of a filter works on at a time, so that they stay in a core's cache.
NEAR = 1 << 17


def convolved(v: np.ndarray, weights: Sequence[float], axis: int, on: np.ndarray | None = None) -> np.ndarray:
    """One pass of a filter of odd length along an axis, edges held. Terms are added from left to right, so that sums are those of the
    window expressions to the last bit, whatever tile a pixel lies in."""
    n, r = v.shape[axis], len(weights) // 2
    v, rank = closed(v, on, axis)
    flat = np.moveaxis(v, axis, 0)
    rest = flat.shape[1:]
    flat = np.ascontiguousarray(flat).reshape(n, -1)
    wide = np.concatenate([np.repeat(flat[:1], r, 0), flat, np.repeat(flat[-1:], r, 0)])
    out, step = np.empty_like(flat), max(1, NEAR // (8 * flat.shape[1]))
    for at in range(0, n, step):
        total = out[at : at + step]
        part = np.empty_like(total)
        np.multiply(wide[at : at + len(total)], float(weights[0]), out=total)
        for k, w in enumerate(weights[1:], 1):
            np.multiply(wide[at + k : at + k + len(total)], float(w), out=part)
            total += part
    return opened(np.moveaxis(out.reshape(n, *rest), 0, axis), rank, axis)


def blurred(v: np.ndarray, weights: Sequence[float], on: np.ndarray | None = None) -> np.ndarray:
    return unpremultiplied(convolved(convolved(premultiplied(v), weights, 1, on), weights, 0, on))


def sharpened(v: np.ndarray, weights: Sequence[float], amount: float, least: float, on: np.ndarray | None = None) -> np.ndarray:
    """Away from the blurred image wherever they differ by more than ``least``."""
    d = v - blurred(v, weights, on)
    return np.where(np.abs(d) > least, np.clip(v + amount * d, 0, 1), v)


def correlated(v: np.ndarray, kernel: Sequence[float], size: int, divisor: float, offset: float, alpha_least: float, on: np.ndarray | None = None) -> np.ndarray:
    """A square kernel over premultiplied colour; rows of it first, then their sum. Alpha stays."""
    r = size // 2
    flat, across = closed(premultiplied(v)[..., :3], on, 1)
    wide = np.pad(flat, [(0, 0), (r, r), (0, 0)], "edge")
    h, w = v.shape[:2]
    total = np.zeros((h, w, 3))
    for j in range(size):
        row = np.zeros((h, w, 3))
        for i in range(size):
            if k := float(kernel[j * size + i]):
                row += wide[:, i : i + w] * k
        row, down = closed(opened(row, across, 1), on, 0)
        total += np.pad(row, [(r, r), (0, 0), (0, 0)], "edge")[j : j + h]
    total, a = opened(total, down, 0), v[..., 3:]
    rgb = np.where(a < alpha_least, 0.0, total / divisor / np.where(a < alpha_least, 1.0, a))
    return np.concatenate([np.clip(rgb + offset, 0, 1), a], -1)


#: The radius from which on a channel of few values is counted rather than sorted.
COUNTED_RADIUS = 6


def median(v: np.ndarray, radius: int, on: np.ndarray | None = None) -> np.ndarray:
    """The middle value of each channel in a square. From ``COUNTED_RADIUS`` on, channels of at most 256 values, as sources of
    8 bits have, cost the same at any radius; others are partitioned pixel by pixel."""
    wide = np.pad(held(held(v, on, 1), on, 0), [(radius, radius), (radius, radius), (0, 0)], "edge")
    out, left = np.empty_like(v), []
    for c in range(v.shape[2]):
        values = np.ascontiguousarray(wide[..., c])
        table, code = np.unique(values, return_inverse=True) if radius >= COUNTED_RADIUS and len(np.unique(values[::7])) <= 256 else (None, None)
        if table is None or len(table) > 256:
            left.append(c)
        else:
            out[..., c] = table[counted_median(code.reshape(values.shape), radius)]
    if left:
        side = 2 * radius + 1
        windows = np.lib.stride_tricks.sliding_window_view(wide[..., left], (side, side), (0, 1))
        for y in range(v.shape[0]):
            flat = windows[y].reshape(v.shape[1], len(left), side * side)
            out[y][:, left] = np.partition(flat, side * side // 2, -1)[..., side * side // 2]
    return out


def counted_median(code: np.ndarray, radius: int) -> np.ndarray:
    """Middle ranks, below 256, of all squares inside ``code``.

    Going from column to column, for every line at once: the counts of each rank in a column's stretch of lines, summed up
    over columns, so that two of these sums tell a square's counts. The middle is sought among sixteen groups of ranks and
    then within one.
    """
    side, (height, width) = 2 * radius + 1, code.shape
    lines, middle = height - 2 * radius, side * side // 2
    row, out = np.arange(lines), np.empty((lines, width - 2 * radius), np.int64)
    sums, groups = (np.zeros((side + 1, lines, n), np.uint16) for n in (256, 16))
    for x in range(width):
        column, change = code[:, x], np.zeros((lines, 256), np.uint16)
        change[0] = np.bincount(column[:side], minlength=256)
        change[row[1:], column[side:]] += np.uint16(1)
        change[row[1:], column[: lines - 1]] -= np.uint16(1)
        counts = np.cumsum(change, 0, dtype=np.uint16)
        now, before, first = x % (side + 1), (x - 1) % (side + 1), (x + 1) % (side + 1)
        np.add(sums[before], counts, out=sums[now])
        np.add(groups[before], counts.reshape(lines, 16, 16).sum(2, dtype=np.uint16), out=groups[now])
        if x >= 2 * radius:
            upto = np.cumsum(groups[now] - groups[first], 1, dtype=np.uint16)
            group = (upto <= middle).sum(1)
            below = np.where(group > 0, upto[row, group - 1], 0)
            inside = sums[now].reshape(lines, 16, 16)[row, group] - sums[first].reshape(lines, 16, 16)[row, group]
            out[:, x - 2 * radius] = group * 16 + (below[:, None] + np.cumsum(inside, 1, dtype=np.int64) <= middle).sum(1)
    return out


def _cubic(t: np.ndarray) -> np.ndarray:
    """Keys' kernel with a = -1/2."""
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def _sources(inverse: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pixels of a cell come from, counted from pixel centres."""
    ys, xs = np.indices((y1 - y0, x1 - x0)) + 0.5
    ys, xs = ys + y0, xs + x0
    with np.errstate(all="ignore"):
        d = inverse[2][0] * xs + inverse[2][1] * ys + inverse[2][2]
        u = (inverse[0][0] * xs + inverse[0][1] * ys + inverse[0][2]) / d - 0.5
        w = (inverse[1][0] * xs + inverse[1][1] * ys + inverse[1][2]) / d - 0.5
    return u, w


def warped(v: np.ndarray, inverse: np.ndarray, window: tuple[int, int, int, int], origin: tuple[int, int], size: tuple[int, int], border: tuple[float, ...], on: np.ndarray | None = None) -> np.ndarray:
    """Bicubic gather for a window of the result: output pixel centres go through ``inverse`` to source coordinates; outside
    and where the source has no pixel lies the border. ``v`` is the part of a source of ``size`` that begins at ``origin``."""
    x0, y0, x1, y1 = window
    edge = np.array([*(b * border[3] for b in border[:3]), border[3]])
    src = premultiplied(v) if on is None else np.where(on[..., None], premultiplied(v), edge)
    u, w = _sources(inverse, x0, y0, x1, y1)
    with np.errstate(invalid="ignore"):
        iu, iw = np.floor(u).astype(int), np.floor(w).astype(int)
    out = np.zeros((y1 - y0, x1 - x0, 4))
    for j in range(-1, 3):
        for i in range(-1, 3):
            x, y = iu + i, iw + j
            inside = (x >= 0) & (x < size[0]) & (y >= 0) & (y < size[1])
            tap = np.broadcast_to(edge, out.shape).copy()
            tap[inside] = src[y[inside] - origin[1], x[inside] - origin[0]]
            out += (_cubic(u - x) * _cubic(w - y))[..., None] * tap
    return unpremultiplied(np.clip(out, 0, 1))


def _places(c: str, centre: int, radius: Column, size: Column) -> Column:
    """The places of a patch, from 0 to 2 * radius, that hold a pixel's coordinate; beyond an edge a patch holds the edge."""
    at = F.col(c) - centre + radius
    low = F.when(F.col(c) == 0, F.lit(0)).otherwise(at)
    high = F.when(F.col(c) == size - 1, 2 * radius).otherwise(at)
    low, high = F.greatest(low, F.lit(0)), F.least(high, 2 * radius)
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))


def healed(p: PixelFrame, src: tuple[int, int], dest: tuple[int, int], radii: Sequence[int], weights: Sequence[Sequence[float]]) -> DataFrame:
    """(image_id, [size_id,] y, x, r, g, b, a): the target patch with the source's detail, a radius and weights for each extent.

    Both patches are images of 2 * radius + 1 a side, into whose tiles pixels come by their place in the patch, so that a tile
    holds both patches' pixels and what lies around them.
    """
    radius, size = p.pick(radii), F.col(SIZE_ID) if p.mixed else F.lit(0).alias(SIZE_ID)
    rows = None
    for part, (cx, cy) in enumerate((src, dest)):
        placed = p.df.select("image_id", size, F.lit(part).alias("part"), F.explode(_places("y", cy, radius, p.h)).alias("_y"), "x", *"rgba", radius.alias("_radius"))
        across = _places("x", cx, F.col("_radius"), p.w)
        placed = placed.select("image_id", SIZE_ID, "part", F.col("_y").alias("y"), F.explode(across).alias("_x"), *"rgba").withColumnRenamed("_x", "x")
        rows = placed if rows is None else rows.unionByName(placed)

    def kernel(v: np.ndarray, k: int, on: np.ndarray | None) -> np.ndarray:
        a, b = v[..., :4], v[..., 4:]
        a_on, b_on = (None, None) if on is None else (on[..., 0], on[..., 1])
        return np.clip(a - blurred(a, weights[k], a_on) + blurred(b, weights[k], b_on), 0, 1)

    sides = [(2 * r + 1, 2 * r + 1) for r in radii]
    out = _tiled(rows, sides, [(kernel, max(len(w) // 2 for w in weights))], _schema(p), p.mixed, 2)
    back = lambda c, at: (F.col(c) + at - radius).cast("int").alias(c)
    return out.select("image_id", back("y", dest[1]), back("x", dest[0]), *p.ids[1:], *"rgba")
