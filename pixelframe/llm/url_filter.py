"""URL rules by canonical prefixes: a blocked Bloom filter passes possible hits to an exact hash join.

A rule's key is its host followed by its path. A URL's host suffixes with as many labels as some rule's host has are
looked up in a filter of the rules' hosts; only those that pass make candidate keys, with the path prefixes as long as some
rule's path, so a URL of a host that is not listed costs a few lookups, however many lengths there are. The filter of all
rules' keys drops nearly every candidate that is no rule. What passes is hash-joined with the rules on the key, once for each
distinct host and path, which drops the rest; of the rules that fit, the one with the longest key wins. URLs of which
nothing passes meet no join. A URL that no rule fits is not listed and passes.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path; repeated rows
each get a row; URLs of any length are taken whole; an empty table gives an empty result; without rules every URL
passes; rules without a host or a path are left out; of rules with the same key, blocking ones win; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom, bloom_of
from .common import column, hashed, written

#: Rules up to which the list is broadcast for the exact join; a longer one is joined by a shuffle.
BROADCAST_RULES = 50_000


def lowered(c):
    """A-Z lower-cased, and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_filter(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rules``: (verdict, host, path), as rows or as a table. Gives page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    listed = rules.select(lowered(F.col("host")).alias("host"), "path", "verdict")
    listed = listed.withColumn("key", F.concat("host", "path")).filter("key is not null")
    # what candidates can look like: distinct numbers of labels and lengths of paths
    labels = sorted(r[0] for r in listed.select(F.size(F.split("host", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    names = listed.select("host").distinct()
    named = spark.sparkContext.broadcast(bloom_of(names, names.count(), _key_hashes).words)
    listed = listed.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"))
    listed = listed.select(F.col("key").alias("rule"), F.when(F.col("block"), "block").otherwise("allow").alias("listed"))
    n = listed.count()
    sent = spark.sparkContext.broadcast(bloom_of(listed.select("rule"), n, _key_hashes).words)

    def candidates(batches):
        filter_, hosts_listed = BlockedBloom(sent.value), BlockedBloom(named.value)
        passing = lambda f, words: np.flatnonzero(f.may_hold(np.array([hashed(w.encode()) for w in words], np.uint64))).tolist()
        for b in batches:
            hosts, paths = column(b, "host"), column(b, "path")
            each = [host.split(".") if host else [] for host in hosts]
            suffixes = [(i, ".".join(parts[-k:])) for i, parts in enumerate(each) for k in labels if k <= len(parts)]
            near = [suffixes[j] for j in passing(hosts_listed, [s for _, s in suffixes])]
            keys = [(i, suffix + paths[i][:m]) for i, suffix in near for m in lengths if m <= len(paths[i])]
            hits: list[list[str]] = [[] for _ in hosts]
            for j in passing(filter_, [k for _, k in keys]):
                hits[keys[j][0]].append(keys[j][1])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(hits, pa.list_(pa.string()))], ["page_id", "host", "path", "hits"])

    split = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    rest = F.coalesce(F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)")), F.lit(""))
    split = split.select("page_id", rest.alias("rest"))
    split = split.select("page_id", lowered(F.regexp_extract("rest", "^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    out = written(split.mapInArrow(candidates, "page_id long, host string, path string, hits array<string>"), "candidates")
    none = out.filter(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    some = out.filter(F.size("hits") > 0)
    keys = some.groupBy("host", "path").agg(F.first("hits").alias("hits")).select("host", "path", F.explode("hits").alias("rule"))
    keys = keys.join(F.broadcast(listed) if n <= BROADCAST_RULES else listed.hint("shuffle_hash"), "rule")
    best = keys.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "listed")).alias("best"))
    found = some.select("page_id", "host", "path").join(best, ["host", "path"], "left")
    return none.unionByName(found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit("allow")).alias("verdict")))


def _key_hashes(keys: pa.Array) -> np.ndarray:
    return np.array([hashed(k.encode()) for k in keys.to_pylist()], np.uint64)
