"""Adobe .cube tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import q6
from .lines import numbered_lines

MOST_BYTES = 16 << 20


class CubeError(ValueError):
    code = "invalid_lut"


@dataclass(frozen=True)
class Cube:
    """Rows of (r, g, b); in three dimensions red varies fastest."""

    rows: tuple[tuple[float, float, float], ...] | np.ndarray
    size: int
    is_3d: bool
    domain_min: tuple[float, float, float] = (0.0, 0.0, 0.0)
    domain_max: tuple[float, float, float] = (1.0, 1.0, 1.0)
    title: str = ""


class _Reader:
    """Takes a table's lines in order; ``rows`` may be taken elsewhere, as (line, values)."""

    def __init__(self):
        self.size, self.is_3d, self.low, self.high, self.title, self.rows = None, False, (0.0,) * 3, (1.0,) * 3, "", []

    def numbers(self, words: list[str], n: int, line: int) -> tuple[float, ...]:
        try:
            values = tuple(float(w) for w in words)
        except ValueError:
            raise CubeError(f"line {line}: expected numbers") from None
        if len(values) != n or any(not abs(v) < float("inf") for v in values):
            raise CubeError(f"line {line}: expected {n} finite numbers")
        return values

    def take(self, line: int, raw: str) -> None:
        if raw.strip().upper().startswith("TITLE"):
            self.title = raw.strip()[5:].strip().strip('"')
            return
        words = raw.split("#", 1)[0].split()
        if not words:
            return
        key = words[0].upper()
        if key in ("LUT_1D_SIZE", "LUT_3D_SIZE"):
            if self.size is not None:
                raise CubeError(f"line {line}: size is given twice")
            (value,), self.is_3d = self.numbers(words[1:], 1, line), key == "LUT_3D_SIZE"
            self.size = int(value)
            if self.size != value or not 2 <= self.size <= (129 if self.is_3d else 65536):
                raise CubeError(f"line {line}: size {words[1]} is out of range")
        elif key == "DOMAIN_MIN":
            self.low = self.numbers(words[1:], 3, line)
        elif key == "DOMAIN_MAX":
            self.high = self.numbers(words[1:], 3, line)
        elif key[0].isalpha():
            raise CubeError(f"line {line}: unknown keyword {words[0]}")
        else:
            self.before_values(line)
            row = self.numbers(words, 3, line)
            if any(abs(v) > 16 for v in row):
                raise CubeError(f"line {line}: values must be within -16..=16")
            self.rows.append(tuple(q6(v) for v in row))

    def before_values(self, line: int) -> None:
        if self.size is None:
            raise CubeError(f"line {line}: values before a size")

    def done(self, rows: np.ndarray | None = None) -> Cube:
        rows = tuple(self.rows) if rows is None else rows
        if self.size is None:
            raise CubeError("no LUT_1D_SIZE or LUT_3D_SIZE")
        if len(rows) != (self.size**3 if self.is_3d else self.size):
            raise CubeError(f"expected {self.size**3 if self.is_3d else self.size} rows, got {len(rows)}")
        if any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise CubeError("DOMAIN_MIN must be below DOMAIN_MAX")
        return Cube(rows, self.size, self.is_3d, self.low, self.high, self.title)


def parse_cube(text: str) -> Cube:
    """A table from a file's content."""
    if len(text) > MOST_BYTES:
        raise CubeError("table is larger than 16 MiB")
    reader = _Reader()
    for number, line in enumerate(text.removeprefix("\ufeff").splitlines(), 1):
        reader.take(number, line)
    return reader.done()


def read_cube(spark: SparkSession, path: str) -> Cube:
    """A table from a file of any number of splits: tasks turn its numbered lines of values into numbers; the driver gets the
    other lines, and the values as an array of 50 MB at most."""
    lines = numbered_lines(spark, path)
    size = lines.select(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    if size > MOST_BYTES + 1:
        raise CubeError("table is larger than 16 MiB")
    told = F.translate(F.replace("line", F.lit("\ufeff"), F.lit("")), "\t\r\f\v", "    ")
    words = F.split(F.trim(F.substring_index(told, "#", 1)), " +")
    values = F.transform(words, lambda w: F.when(w.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), w.try_cast("double")))
    good = (F.size(words) == 3) & ~F.upper(F.trim(told)).startswith("TITLE") & F.forall(values, lambda v: v.isNotNull() & (F.abs(v) <= 16))
    marked = lines.select("number", told.alias("line"), values.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    # all that is no row of three numbers is read on the driver: keywords, comments, blank lines, and what is wrong
    others = marked.filter(~F.col("good") & (F.trim("line") != "")).select("number", "line").orderBy("number")
    first = marked.filter("good").agg(F.min("number")).first()[0]
    reader = _Reader()
    for r in others.toLocalIterator():
        if first is not None and r.number > first and reader.size is None:
            reader.before_values(first)
        reader.take(r.number, r.line)
    if first is not None:
        reader.before_values(first)
    rows = marked.filter("good").orderBy("number").select(*(F.col("v")[i].alias(c) for i, c in enumerate("rgb"))).toArrow()
    table = np.stack([rows.column(c).to_numpy() for c in "rgb"], 1)
    return reader.done(np.where(table < 0, np.ceil(table * 1e6 - 0.5), np.floor(table * 1e6 + 0.5)) / 1e6)
