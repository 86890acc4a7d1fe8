"""Lines of text with their numbers, from files that many tasks read at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line) of text files, numbers from 1 and by file; lines end with a line feed.

    Files are read by splits. A first pass counts the lines of each split; running sums over a file's splits, of which there is one row
    each, give the number before each, and a line's place in its split follows from the order in which a task reads it.
    The table of splits is sent to the tasks while it is small and joined by a shuffle beyond that.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("lineSep", "\n").text(path).select(place.alias("split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    before, table = {}, []
    for r in sorted(splits, key=lambda r: (r.split.file, r.split.start)):
        n = before.get(r.split.file, 0)
        table.append(((r.split.file, r.split.start), r["_first"] - n))
        before[r.split.file] = n + r["_n"]
    shifts = spark.createDataFrame(table, "split struct<file: string, start: long>, _shift long")
    shifts = F.broadcast(shifts) if len(table) <= 100_000 else shifts
    return rows.join(shifts, "split").select("split.file", (F.col("_id") - F.col("_shift") + 1).alias("number"), "line")
