"""Fill-in-middle transformation: texts cut at unit boundaries and put together as prefix, suffix, middle.

Run-length class encoding: a text is stored as maximal runs of characters of one class, each with the number of
units that end before it. A cut after ``u`` units is found by binary search of the run in which unit ``u`` ends,
and its offset follows arithmetically from the run's start, so no list of units is ever made. What a run of a class
ends is stated by a ``Units``: each of its characters a unit (line feeds), the whole run one unit, or none; what
stands after the last end is a unit too.

Cuts, the chance of a transformation and its form come from the SHA-256 of a seed and doc_id, so they hold on every
machine and in every retry, and no shuffle is needed.

Defined results: a null or empty text has no units and stays as it is (form ``plain``), as does one that holds a mark;
a null doc_id counts as an empty text in the hash; repeated rows each get the same row; texts of any length are read whole,
one at a time; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, tidy

NONE, EACH, WHOLE = 0, 1, 2


@dataclass(frozen=True)
class Units:
    """Characters of ``mark`` form one class, all others the second; what a run of each ends."""

    mark: str
    marked: int
    other: int

    @property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.mark.encode("utf-32-le"), "<u4")


#: ``[^\n]*\n|[^\n]+``; ``[ \t-\r]*[^ \t-\r]+`` and white space at the end; single characters.
LINES = Units("\n", EACH, NONE)
WORDS = Units(" \t\n\v\f\r", NONE, WHOLE)
CHARS = Units("", EACH, EACH)


@dataclass(frozen=True)
class Runs:
    """A text's runs: where each begins, whether its characters end a unit each, and the units that end before it and after it."""

    start: np.ndarray
    each: np.ndarray
    before: np.ndarray
    after: np.ndarray
    size: int

    @property
    def n(self) -> int:
        return int(self.after[-1]) if len(self.after) else 0

    def cut(self, units: int) -> int:
        """The offset, in code points, at which the first ``units`` units end."""
        if not units:
            return 0
        k = int(np.searchsorted(self.after, units))
        if self.each[k]:
            return int(self.start[k]) + units - int(self.before[k])
        return int(self.start[k + 1]) if k + 1 < len(self.start) else self.size


def runs(text: str, kind: Units = LINES) -> Runs:
    """The run-length class encoding of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    marked = np.zeros(len(points), bool)
    for c in kind.codes:
        marked |= points == c
    start = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]])) if len(points) else np.empty(0, np.int64)
    ends = np.where(marked[start], kind.marked, kind.other)
    count = np.where(ends == EACH, np.diff(np.append(start, len(points))), ends == WHOLE)
    if len(count) and ends[-1] == NONE:
        count[-1] = 1  # the rest of the text
    after = np.cumsum(count)
    return Runs(start, ends == EACH, after - count, after, len(points))


@dataclass(frozen=True)
class Plan:
    """Parameters: seed, unit, marks, and in a hundred the transformed texts and of these the suffix-first ones."""

    seed: int = 7
    units: Units = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    suffix_first: int = 50

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # only such marks are found again where they were put, whatever stands beside them
        if len(set(marks)) < 3 or any(not m or any(x[:1] in m[1:] for x in marks) for m in marks):
            raise ValueError("marks must differ, and none may begin with a character that a mark holds further on")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def transform(doc_id: int | None, text: str, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the output."""
    found = runs(text, plan.units)
    key = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= plan.rate or any(m in text for m in plan.marks):
        return found.n, "plain", None, None, text
    low, high = (found.cut(u) for u in sorted((h1 % (found.n + 1), h2 % (found.n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < plan.suffix_first:
        form, out = "spm", (plan.suffix, suffix, plan.prefix, prefix, plan.middle, middle)
    else:
        form, out = "psm", (plan.prefix, prefix, plan.suffix, suffix, plan.middle, middle)
    return found.n, form, low, high - low, "".join(out)


def restored(output: str, form: str, plan: Plan | None = None) -> str:
    """The text, from nothing but an output and its form."""
    plan = plan or Plan()
    if form == "plain":
        return output
    first, second = (plan.suffix, plan.prefix) if form == "spm" else (plan.prefix, plan.suffix)
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(plan.middle)
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return prefix + middle + suffix


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of every row."""
    plan = plan or Plan()

    def run(batches):
        for b in batches:
            rows = [transform(i, t or "", plan) for i, t in zip(column(b, "doc_id"), column(b, "text"), strict=True)]
            n, form, low, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(low, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)


def rebuilt(out: DataFrame, plan: Plan | None = None) -> DataFrame:
    """``out`` of ``fill_middle`` with ``restored``: the text, read back from output and form by column expressions."""
    plan = plan or Plan()
    cut = F.length(F.lit(plan.prefix)), F.length(F.lit(plan.suffix))

    def parts(first_size, second: str):
        body = F.expr("output").substr(first_size + 1, F.length("output"))
        a = F.substring_index(body, second, 1)
        rest = body.substr(F.length(a) + F.length(F.lit(second)) + 1, F.length(body))
        b = F.substring_index(rest, plan.middle, 1)
        return a, b, rest.substr(F.length(b) + F.length(F.lit(plan.middle)) + 1, F.length(rest))

    p, s, m = parts(cut[0], plan.suffix)
    s2, p2, m2 = parts(cut[1], plan.prefix)
    text = F.when(F.col("form") == "psm", F.concat(p, m, s)).when(F.col("form") == "spm", F.concat(p2, m2, s2)).otherwise(F.col("output"))
    return out.withColumn("restored", text)
