"""The pixel relation: one row for each pixel, keyed (image_id, y, x)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import numeric as N

LINEAR, SRGB = "linear", "srgb"
KEY = ("image_id", "y", "x")
IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


#: Which of a frame's sizes a pixel's image had at first; frames of one size have no such column.
SIZE_ID = "size_id"


@dataclass(frozen=True)
class Extent:
    """An image's current size, and the matrix from its source coordinates to current ones."""

    width: int
    height: int
    matrix: tuple = IDENTITY


@dataclass(frozen=True)
class PixelFrame:
    """Images with straight alpha and channels on 0..1 as DOUBLE.

    ``space`` says how r, g, b are to be read; ``matrix`` maps source coordinates to current ones. Images of different sizes in one frame have
    no ``width``, ``height`` and ``matrix`` but ``extents``, one for each distinct size at the start, and a column ``size_id`` that says
    which of them a pixel belongs to. What an operator needs to know of a size it plans once for each extent (``each``) and reads as a
    column (``pick``), so one plan serves all images, however many there are.
    """

    df: DataFrame
    width: int | None
    height: int | None
    space: str = SRGB
    matrix: tuple = IDENTITY
    extents: tuple[Extent, ...] = ()
    #: Neighbourhood kernels that ``df`` ends with, so that further ones join them (``operators.kernels``).
    pending: Any = field(default=None, compare=False, repr=False)

    @property
    def mixed(self) -> bool:
        return bool(self.extents)

    @property
    def keys(self) -> tuple[str, ...]:
        """The columns that say which pixel of which image a row is."""
        return (*KEY, SIZE_ID) if self.mixed else KEY

    @property
    def ids(self) -> tuple[str, ...]:
        """The columns that say which image a row belongs to."""
        return ("image_id", SIZE_ID) if self.mixed else ("image_id",)

    @property
    def shapes(self) -> tuple[Extent, ...]:
        return self.extents or (Extent(self.width, self.height, self.matrix),)

    def each(self, f: Callable[[Extent], Any]) -> list:
        return [f(e) for e in self.shapes]

    def pick(self, values: Sequence[float] | Callable[[Extent], float]) -> Column:
        """The value of a pixel's own extent, of a value for each."""
        values = self.each(values) if callable(values) else list(values)
        if all(v == values[0] for v in values):
            return F.lit(values[0])
        c = F.get(N.table([float(v) for v in values]), F.col(SIZE_ID))
        return c.cast("int") if all(isinstance(v, int) for v in values) else c

    @property
    def w(self) -> Column:
        return self.pick(lambda e: e.width)

    @property
    def h(self) -> Column:
        return self.pick(lambda e: e.height)

    def images(self) -> DataFrame:
        return self.df.select(*self.ids).distinct()

    def sized(self, df: DataFrame, extents: Sequence[Extent]) -> PixelFrame:
        """Other pixels of other sizes, in the same order of extents."""
        if self.mixed:
            return replace(self, df=df, extents=tuple(extents))
        (e,) = extents
        return replace(self, df=df, width=e.width, height=e.height, matrix=e.matrix)

    def with_columns(self, columns: dict[str, Column]) -> PixelFrame:
        return replace(self, df=self.df.withColumns(columns))

    def rgb(self, f) -> PixelFrame:
        """Apply one function of a Column to r, g and b."""
        return self.with_columns({c: f(F.col(c)) for c in N.CHANNELS})

    def select(self, *columns: Column) -> PixelFrame:
        return replace(self, df=self.df.select(*columns))

    def to(self, space: str) -> PixelFrame:
        if space == self.space:
            return self
        return replace(self.rgb(N.to_linear if space == LINEAR else N.to_srgb), space=space)


def from_codes(df: DataFrame, width: int | None, height: int | None, space: str = SRGB, extents: tuple[Extent, ...] = ()) -> PixelFrame:
    """From columns r8, g8, b8, a8 of code values."""
    if space == LINEAR:
        nodes = N.table(N.eotf_u8())
        channel = lambda c: F.element_at(nodes, F.col(c) + 1)
    else:
        channel = lambda c: F.col(c) / F.lit(255.0)
    rgba = [channel(f"{c}8").alias(c) for c in N.CHANNELS]
    keys = (*KEY, SIZE_ID) if extents else KEY
    return PixelFrame(df.select(*keys, *rgba, (F.col("a8") / F.lit(255.0)).alias("a")), width, height, space, extents=extents)


def from_channels(df: DataFrame, width: int | None, height: int | None, space: str = SRGB, extents: tuple[Extent, ...] = ()) -> PixelFrame:
    """From columns r, g, b, a on 0..1 of sRGB code values, as files of 8 and 16 bits have them."""
    p = PixelFrame(df.select(*((*KEY, SIZE_ID) if extents else KEY), *"rgba"), width, height, extents=extents)
    return replace(p.rgb(N.codes_to_linear), space=LINEAR) if space == LINEAR else p


def from_sizes(df: DataFrame, sizes: DataFrame | None = None, space: str = SRGB) -> PixelFrame:
    """Images of different sizes, from a relation with columns width and height beside code values or channels.

    ``sizes``: (width, height) of all images, as headers tell it; without it the relation's own columns are read once. Only the distinct
    sizes go to the driver. A row whose size is not among them, or is null, belongs to no image and is left out.
    """
    known = (df if sizes is None else sizes).select("width", "height").dropna().distinct()
    extents = tuple(Extent(w, h) for w, h in sorted((int(r.width), int(r.height)) for r in known.toLocalIterator()))
    if not extents:
        extents = (Extent(1, 1),)
    table = df.sparkSession.createDataFrame([(i, e.width, e.height) for i, e in enumerate(extents)], f"{SIZE_ID} int, width int, height int")
    rows = df.drop(SIZE_ID).join(F.broadcast(table) if len(extents) <= 100_000 else table, ["width", "height"])
    return (from_codes if "r8" in df.columns else from_channels)(rows, None, None, space, extents)


def codes(p: PixelFrame) -> DataFrame:
    """Columns r8, g8, b8, a8 of the sRGB code values."""
    p = p.to(SRGB)
    return p.df.select(*p.keys, *(N.to_u8(F.col(c)).alias(f"{c}8") for c in "rgba"))


def sizes(df: DataFrame) -> DataFrame:
    """(image_id, width, height) of a pixel relation."""
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def grid(images: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """All keys of images; ``images``: image_id and what else is to be kept."""
    last = lambda n: (n if isinstance(n, Column) else F.lit(n)) - 1
    rows = images.select("*", F.explode(F.sequence(F.lit(0), last(height))).alias("y"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last(width))).alias("x"))
    return rows.select(*KEY, *[c for c in images.columns if c != "image_id"])
