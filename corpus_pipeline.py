"""From documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, for the documents that stay.
A row's doc_id identifies its document: repeated rows stay or go together. A row without one is identified by its text
and loses against every numbered row: it goes if a numbered document that takes part is an exact or near copy of it.
Of near copies that all lack a number one text stays, and exact copies that all lack one are repeated rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.bloom import without
from pixelframe.llm.common import unused, written
from pixelframe.llm.decontaminate import clean
from pixelframe.llm.exact_dedup import exact_dedup
from pixelframe.llm.ngram_join import ngram_join
from pixelframe.llm.piece_codec import round_trip
from pixelframe.llm.quality_gam import accepted, train

LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, gives at least ``LEAST_QUALITY``.

    Null and empty texts and rows without a doc_id are scored like others, texts of any length whole; repeated rows stay or go
    together; a score of exactly ``LEAST_QUALITY`` stays; an empty table stays empty; further columns are kept as they are.
    """
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, the one with the largest doc_id.

    A null text counts as empty; repeated rows of the document that stays all stay; texts of any length count whole; an empty
    table stays empty; further columns are kept as they are.
    """
    gone = written(exact_dedup(docs).filter("not kept").select("doc_id", "digest"), "gone")
    out = without(docs, gone.filter("doc_id is not null").select("doc_id"))
    (name,) = unused(docs, "digest")
    unnamed = gone.filter("doc_id is null").select(F.lower(F.hex("digest")).alias(name)).distinct()
    if unnamed.isEmpty():
        return out
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rest = out.filter("doc_id is null").join(unnamed, F.sha2(lowered.cast("binary"), 256) == F.col(name), "left_anti")
    return out.filter("doc_id is not null").unionByName(rest)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles, the document with the smallest doc_id.

    Texts without words are linked with nothing and stay; a similarity of exactly 0.8 links; texts of any length count whole;
    an empty table stays empty; further columns are kept as they are.
    """
    unnamed = docs.filter("doc_id is null")
    if unnamed.isEmpty():
        return without(docs, written(ngram_join(docs).filter("doc_id <> component_id").select("doc_id"), "gone"))
    # rows without a number take part under the 64-bit hash of their text
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    hashes = written(unnamed.select(F.xxhash64("text").alias("doc_id")).distinct(), "unnamed").withColumn("unnamed", F.lit(True))
    groups = ngram_join(docs.withColumn("doc_id", key)).select("doc_id", "component_id").distinct()
    groups = written(groups.join(hashes, "doc_id", "left"), "groups")
    named = F.min(F.when(F.col("unnamed").isNull(), F.col("doc_id")))
    keep = groups.groupBy("component_id").agg(F.coalesce(named, F.min("doc_id")).alias("keep")).filter("keep <> component_id")
    gone = groups.join(keep, "component_id", "left").filter("doc_id <> coalesce(keep, component_id)").select("doc_id")
    return without(docs, written(gone, "gone"), key)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages.

    Exactly a twentieth goes. Texts without words stay; repeated rows stay or go together; texts of any length are read whole;
    an empty table stays empty; further columns are kept as they are.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text that they decode to.

    A null or empty text has no ids and decodes to an empty text; every row gets a row, repeated ones and those without a doc_id
    too; texts of any length are encoded whole; an empty table gives an empty result; further columns are ignored.
    """
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_passages),
    ("piece_codec", pieces),
]

#: The classifier and the encoding have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs.select([F.col(c) for c in docs.columns])
