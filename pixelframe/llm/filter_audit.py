"""Filter interaction audit: what each filter removes in every order, from joint failures only.

Inclusion-exclusion: one pass over rows with a flag for each filter aggregates, for every set S of filters, the number
J(S) of rows that fail all of S, as sums of products of flags (32 sets for five filters). All figures follow from
these by Moebius inversion: survivors of a set P are the sum of (-1)^|S| J(S) over S within P; a filter removes, after the
filters P, survivors(P) - survivors(P and it); it alone is failed by survivors(all but it) - survivors(all). The Harsanyi
dividend of S in the game "rows removed" is (-1)^(|S|+1) J(S), so a filter's removals over all orders sum to
orders * sum of dividend(S) / |S| over the sets S with it, which is whole. Everything is a DataFrame expression.

Exact repeats: a row fails if its text is that of a smaller doc_id anywhere in the table. Rows carry digests of their
texts; the smallest id of each digest is found by a rank, of which Spark keeps each task's own first rows before it shuffles,
so a text that a third of all rows share sends one row a task. That set is joined back on (doc_id, digest), which no group is hot in.

Defined results: a null text is empty; a null ``lang`` is the part ``''``; a row without doc_id counts, fails no repeat filter,
makes no other row a repeat and has no label; rows that repeat a doc_id with the same text are not smaller than one another;
of several labels of a doc_id any 1 counts; labels without document, null labels and labels without doc_id count nothing;
texts of any length are read whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST_FILTERS = 6  # orders grow with the factorial
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\v\f\r", "     "), " "), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text).cast("long") - F.length(F.translate(text, UPPER, ""))) > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags A to E and the measures ``good`` and ``toxic`` of every row of ``docs``.

    The light rows (digests and flags) are written once, so that texts are read once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    light = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[c.alias(k) for k, c in text_filters(F.col("text")).items()])
    light = written(light, "flags")
    named = light.filter("doc_id is not null")
    place = F.rank().over(Window.partitionBy("digest").orderBy("doc_id"))
    firsts = named.select("digest", "doc_id").withColumn("place", place).filter("place = 1").select("digest", "doc_id").distinct().withColumn("first", F.lit(True))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    named = named.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    said = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    no = F.lit(False)
    named = named.select("part", "A", "B", "C", "D", F.col("first").isNull().alias("E"), said("good"), said("toxic"))
    return named.unionByName(light.filter("doc_id is null").select("part", "A", "B", "C", "D", no.alias("E"), no.alias("good"), no.alias("toxic")))


def joint_failures(rows: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """part and, for all rows and for those of each measure, an array of J(S): filter k is bit k of the index S."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    whole = ["n", *measures]
    flag = {k: F.col(k).cast("long") for k in filters}
    weight = {"n": F.lit(1).cast("long"), **{m: F.col(m).cast("long") for m in measures}}

    def product(m: str, s: int) -> Column:
        out = weight[m]
        for k, name in enumerate(filters):
            if s >> k & 1:
                out = out * flag[name]
        return F.sum(out)

    sets = range(1 << len(filters))
    sums = rows.groupBy("part").agg(*[product(m, s).alias(f"{m}_{s}") for m in whole for s in sets])
    return sums.select("part", *[F.array(*[f"{m}_{s}" for s in sets]).alias(f"fail_{m}") for m in whole])


def _sum(terms: list[tuple[int, Column]]) -> Column:
    return sum((c * k for k, c in terms[1:]), terms[0][1] * terms[0][0])


def inverted(joint: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """Moebius inversion: arrays of survivors of each set, and of what each filter removes over all orders."""
    sets = range(1 << len(filters))
    within = lambda p: [s for s in sets if s & p == s]
    kept = lambda m: F.array(*[_sum([((-1) ** s.bit_count(), F.col(f"fail_{m}")[s]) for s in within(p)]) for p in sets])
    orders = math.factorial(len(filters))
    shapley = [_sum([((-1) ** (s.bit_count() + 1) * orders // s.bit_count(), F.col("fail_n")[s]) for s in sets if s >> k & 1]) for k in range(len(filters))]
    return joint.withColumns({**{f"kept_{m}": kept(m) for m in ["n", *measures]}, "shapley": F.array(*shapley)})


def interaction_audit(rows: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """A row for each part, order of filters and step.

    ``rows`` has ``part`` and boolean columns: for each of ``filters`` whether a row fails it, and ``measures`` whose losses are
    counted. Returns part, filter_order, step, kept, removed, redundant, unique_fails, ``<measure>_lost`` and shapley.
    """
    full = (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[i] for i in order), "step": step, "k": k, "own": 1 << k, "rest": full - (1 << k), "before": before, "after": before | 1 << k})
            before |= 1 << k
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, k: int, own: int, rest: int, before: int, after: int>>")
    at = lambda name, i: F.get(F.col(name), i)
    out = inverted(joint_failures(rows, filters, measures), filters, measures).withColumn("s", F.explode(table)).select("*", "s.*")
    removed = lambda m: at(f"kept_{m}", F.col("before")) - at(f"kept_{m}", F.col("after"))
    return out.select(
        "part", "filter_order", "step",
        at("kept_n", F.col("after")).alias("kept"),
        removed("n").alias("removed"),
        (at("fail_n", F.col("own")) - removed("n")).alias("redundant"),
        (at("kept_n", F.col("rest")) - at("kept_n", F.lit(full))).alias("unique_fails"),
        *[removed(m).alias(f"{m}_lost") for m in measures],
        at("shapley", F.col("k")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E by ``lang``."""
    return interaction_audit(flagged(docs, labels), list("ABCDE"), ["good", "toxic"])

