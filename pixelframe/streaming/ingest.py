"""A stream of image files into (sha256, path, byte_size), each content once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incoming(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    hashed = files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("byte_size"), "modificationTime")
    return hashed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
