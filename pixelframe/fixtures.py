"""Pixel relations derived from the driver's tables: (image_id, y, x, r8, g8, b8, a8), every image a full rectangle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tiles(df: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Rows by their key's place in images of this size; places without a row are there too, with nulls. Keys are counted exactly, by bitmaps: only
    where some before the last are missing, places are joined for those; else those behind the last are put beside the rows. Rows are dealt out in
    stretches of keys and lie in order there, however files hold them: tiles are packed by stretches, and rows of many images together would be many small pieces."""
    k, size, spark = F.col("_k"), width * height, df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    df = df.withColumn("_k", F.col(key)).filter("_k >= 0")
    some = df.groupBy(F.bitmap_bucket_number(k + 1).alias("b")).agg(F.max("_k").alias("last"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(k + 1))).alias("n"))
    last, keys = some.agg(F.max("last"), F.sum("n")).first()
    n = 0 if last is None else (last // size + 1) * size
    if last is not None and keys <= last:
        places = spark.range(n).withColumnRenamed("id", "_k").join(df.select("_k"), "_k", "left_anti")
    else:
        places = spark.range(n if last is None else last + 1, n, 1, 1).withColumnRenamed("id", "_k")
    rows = df.unionByName(places, allowMissingColumns=True).repartitionByRange(parts, "_k").sortWithinPartitions("_k")
    at = [F.floor(k / size).cast("int").alias("image_id"), F.floor(k % size / width).cast("int").alias("y"), (k % width).cast("int").alias("x")]
    return rows.select(*at, "*")


def _code(c, missing: int = 0):
    return F.coalesce((c % 256).cast("int"), F.lit(missing))


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32, opaque."""
    return _orders(spark, sf_dir, 32, 32)


def wide_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2500 x 6, opaque."""
    return _orders(spark, sf_dir, 2500, 6)


def _orders(spark: SparkSession, sf_dir: str, width: int, height: int) -> DataFrame:
    t = _tiles(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", width, height)
    rgb = [_code(F.floor("o_totalprice")), _code(F.col("o_orderkey") * 37), _code(F.col("o_custkey") * 11)]
    return t.select("image_id", "y", "x", *(c.alias(f"{n}8") for n, c in zip("rgb", rgb, strict=True)), F.lit(255).alias("a8"))


def events_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32, with alpha."""
    t = _tiles(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value"), "event_id", 32, 32)
    rgba = [_code(F.floor(F.col("value") * 10)), _code(F.col("user_id") * 53), _code(F.col("event_id") * 29), _code(F.col("user_id") * 7)]
    return t.select("image_id", "y", "x", *(c.alias(f"{n}8") for n, c in zip("rgba", rgba, strict=True)))


#: Sizes of the images of ``sizes_px``, by number modulo three.
THREE = ((32, 32), (24, 30), (31, 17))


def sizes_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of three sizes, with width and height as columns; opaque."""
    at = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in THREE)), F.col("image_id") % 3 + 1)
    return orders_px(spark, sf_dir).withColumns({"width": at(0), "height": at(1)}).filter("x < width and y < height")


def big_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1792 x 1400, opaque: each order is a run of 128 pixels, 14 of them a line."""
    t = _tiles(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 14, 1400)
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("p"))
    rgb = [_code(F.floor("o_totalprice") + F.col("p")), _code(F.col("o_orderkey") * 37 + F.col("p") * 2), _code(F.col("o_custkey") * 11 + F.col("y"))]
    return t.select("image_id", "y", (F.col("x") * 128 + F.col("p")).alias("x"), *(c.alias(f"{n}8") for n, c in zip("rgb", rgb, strict=True)), F.lit(255).alias("a8"))


def emb_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 x 50, opaque, from the embeddings' values."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    e = lambda k: F.element_at("embedding", (F.col("p") + k) % 64 + 1).cast("double")
    q = lambda c: F.floor(F.least(F.greatest((c + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    at = [F.floor(F.col("vec_id") / 50).cast("int").alias("image_id"), (F.col("vec_id") % 50).cast("int").alias("y"), F.col("p").alias("x")]
    return t.select(*at, *(q(e(k)).alias(f"{n}8") for n, k in zip("rgb", (0, 21, 42), strict=True)), F.lit(255).alias("a8"))
