"""The revision ledger: append-only Parquet rows, content-addressed, with memoised derivations and lineage.

One writer appends at a time; should two have appended the same content, readers take the row of least ``ledger_seq``.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .lines import numbered_lines

SCHEMA = (
    "asset_id string, revision_id string, source_revision_id string, width int, height int, mime_type string, byte_size long, sha256 string,"
    " rel_path string, recipe string, recipe_hash string, engine_version string, origin map<string,string>, created_at timestamp, ledger_seq long"
)
ENGINE_VERSION = "pixelframe/1"
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/avif": "avif", "image/gif": "gif", "image/bmp": "bmp", "image/svg+xml": "svg", "application/x-cube-lut": "cube"}


class StoreError(ValueError):
    code = "store_error"


def object_path(sha: Column | str, mime: Column | str):
    """``objects/<first two digits>/<sha>.<extension>`` as a Column or a string."""
    if isinstance(sha, str):
        return f"objects/{sha[:2]}/{sha}.{EXTENSIONS.get(mime, 'bin')}"
    ext = F.coalesce(*(F.when(mime == m, F.lit(e)) for m, e in EXTENSIONS.items()), F.lit("bin"))
    return F.concat(F.lit("objects/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit("."), ext)


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the first: a grouped minimum, so that a key with very many rows is aggregated before it is shuffled."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("_f")).select(key, order, "_f.*")


def preview_key(source: Column | str, recipe_hash: Column | str, overlay: str = "", mask: str = ""):
    """A preview's name by what it shows, as a Column or a string."""
    if isinstance(source, Column):
        told = F.concat_ws("\0", source, recipe_hash, F.lit(overlay), F.lit(mask))
        return F.substring(F.sha2(told, 256), 1, 32)
    return hashlib.sha256("\0".join((source, recipe_hash, overlay, mask)).encode()).hexdigest()[:32]


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or ".." in name:
        raise StoreError(f"unsafe name {name!r}")
    return name


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/") + "/ledger"

    def rows(self) -> DataFrame:
        """All rows; none while nothing has been written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _append(self, df: DataFrame) -> None:
        start = self.rows().agg(F.coalesce(F.max("ledger_seq"), F.lit(-1).cast("long"))).first()[0] + 1
        # an order that does not need all rows in one task: ids are unique and rise within a partition
        df = df.withColumn("ledger_seq", F.monotonically_increasing_id() + start).withColumn("created_at", F.current_timestamp()).withColumn("engine_version", F.lit(ENGINE_VERSION))
        df.select(*[F.col(c.split()[0]) for c in SCHEMA.replace("string,string", "string;string").split(", ")]).write.mode("append").parquet(self.path)

    def import_assets(self, files: DataFrame) -> DataFrame:
        """Add files (path, content, mime_type, width, height) whose content is new; gives the ledger's row of each file."""
        hashed = files.withColumn("sha256", F.sha2("content", 256)).withColumn("byte_size", F.octet_length("content").cast("long"))
        first = first_by(hashed.drop("content"), "sha256", "path")
        known = self.rows().filter("source_revision_id is null").select("sha256").distinct()
        new = first.join(known, "sha256", "left_anti")
        # names follow from the content, so that a task that runs twice gives the same row
        new = new.select(
            F.concat(F.lit("ast_"), F.substring("sha256", 1, 26)).alias("asset_id"), F.concat(F.lit("rev_"), F.substring("sha256", 1, 26)).alias("revision_id"),
            F.lit(None).cast("string").alias("source_revision_id"), F.col("width").cast("int"), F.col("height").cast("int"), "mime_type", "byte_size", "sha256",
            object_path(F.col("sha256"), F.col("mime_type")).alias("rel_path"), F.lit(None).cast("string").alias("recipe"), F.lit(None).cast("string").alias("recipe_hash"),
            F.create_map(F.lit("path"), F.col("path")).alias("origin"),
        )
        self._append(new)
        return hashed.select("path", "sha256").join(self.originals(), "sha256")

    def originals(self) -> DataFrame:
        return first_by(self.rows().filter("source_revision_id is null"), "sha256", "ledger_seq")

    def memo(self, requests: DataFrame) -> DataFrame:
        """Of requests (source_revision_id, recipe_hash) those that have a result, with its revision."""
        return memo(self.rows(), requests)

    def record(self, source_revision_id: str, recipe: str, recipe_hash: str, content: bytes, mime: str, width: int, height: int) -> str:
        """The revision of a derivation; one that has been made before is given back."""
        wanted = self.spark.createDataFrame([(source_revision_id, recipe_hash)], "source_revision_id string, recipe_hash string")
        if made := self.memo(wanted).head():
            return made["revision_id"]
        source = self.rows().filter(F.col("revision_id") == source_revision_id).head()
        if source is None:
            raise StoreError(f"unknown revision {source_revision_id}")
        sha, revision = hashlib.sha256(content).hexdigest(), f"rev_{uuid.uuid4().hex[:26]}"
        row = (source["asset_id"], revision, source_revision_id, width, height, mime, len(content), sha, object_path(sha, mime), recipe, recipe_hash, {"kind": "derived"})
        names = "asset_id string, revision_id string, source_revision_id string, width int, height int, mime_type string, byte_size long, sha256 string, rel_path string, recipe string, recipe_hash string, origin map<string,string>"
        self._append(self.spark.createDataFrame([row], names))
        return revision

    def known(self) -> DataFrame:
        """Each revision's row; of rows that two writers made of one revision the first."""
        return first_by(self.rows(), "revision_id", "ledger_seq")

    def merge(self, made: DataFrame) -> None:
        """Append derivations (source_revision_id, recipe, recipe_hash, mime_type, width, height, byte_size, sha256, rel_path) whose source is known and
        that have no row yet, each once. Names follow from what was asked, so that a task that runs twice gives the same row."""
        asked = ["source_revision_id", "recipe_hash"]
        made = made.withColumn("_key", F.struct(*asked))
        made = first_by(made, "_key", "sha256").drop("_key")
        new = made.join(self.memo(made.select(*asked).distinct()).select(*asked), asked, "left_anti")
        sources = self.known().select(F.col("revision_id").alias("source_revision_id"), "asset_id")
        self._append(new.join(sources, "source_revision_id").select("*", derived_id(*map(F.col, asked)).alias("revision_id"), F.create_map(F.lit("kind"), F.lit("derived")).alias("origin")))

    def revisions(self, asset_id: str | None = None) -> DataFrame:
        rows = self.rows() if asset_id is None else self.rows().filter(F.col("asset_id") == asset_id)
        return placed(rows).orderBy("created_at", "ledger_seq")

    def lineage(self, revision_id: str) -> DataFrame:
        """(revision_id, source_revision_id, depth): a revision and what it was made from, step by step."""
        return lineage(self.rows().select("revision_id", "source_revision_id"), revision_id)


def derived_id(source: Column, recipe_hash: Column) -> Column:
    """The name of what a recipe makes of a revision."""
    return F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("\0", source, recipe_hash, F.lit(ENGINE_VERSION)), 256), 1, 26))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of a ledger with each one's place among its asset's revisions, by time and then by order of writing."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("asset_id").orderBy("created_at", "ledger_seq")))


def memo(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Of requests (source_revision_id, recipe_hash) those that this engine has a result of among a ledger's rows, the first one."""
    made = rows.filter(F.col("engine_version") == ENGINE_VERSION).filter("source_revision_id is not null").groupBy("source_revision_id", "recipe_hash")
    return requests.join(made.agg(F.min_by("revision_id", "ledger_seq").alias("revision_id")), ["source_revision_id", "recipe_hash"])


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ledger kept as lines of JSON, read by as many tasks as its files have splits; blank lines are passed over, and a line
    that is no row fails with its number."""
    names = [f.split()[0] for f in SCHEMA.replace("string,string", "string;string").split(", ")]
    required = ("asset_id", "revision_id", "width", "height", "mime_type", "byte_size", "sha256", "rel_path", "created_at")

    def run(batches):
        for b in batches:
            rows = []
            for file, number, line in zip(*(b.column(c).to_pylist() for c in ("file", "number", "line")), strict=True):
                try:
                    row = json.loads(line)
                    missing = [n for n in required if row.get(n) is None]
                except (ValueError, AttributeError) as e:
                    raise StoreError(f"{file}: line {number}: {e}") from None
                if missing:
                    raise StoreError(f"{file}: line {number}: without {', '.join(missing)}")
                if isinstance(row.get("recipe"), dict):
                    row["recipe"] = json.dumps(row["recipe"], sort_keys=True, separators=(",", ":"))
                row["origin"] = [(k, str(v)) for k, v in (row.get("origin") or {}).items()]
                rows.append({"ledger_seq": number - 1} | row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names)

    kinds = {n: pa.string() for n in names} | {"width": pa.int32(), "height": pa.int32(), "byte_size": pa.int64(), "ledger_seq": pa.int64(), "origin": pa.map_(pa.string(), pa.string())}
    lines = numbered_lines(spark, path).filter(F.length(F.trim(F.translate("line", "\t\r\f\v", "    "))) > 0)
    read = lines.select("file", "number", "line").mapInArrow(run, SCHEMA.replace("created_at timestamp", "created_at string"))
    return read.withColumn("created_at", F.to_timestamp("created_at")).select(*names)


def lineages(edges: DataFrame) -> DataFrame:
    """(revision_id, root, depth) of every revision in ``edges`` (revision_id, source_revision_id): what it goes back to, and over how many steps.

    Pointer doubling: each round joins every revision that is not at its root with what it points to, so that pointers grow
    twice as long; a ledger of depth d takes log2(d) joins, each written to the shared folder. Revisions at their root leave
    the rounds. A source that has no row is a root; of several rows of a revision the one of the least source counts; rows without a
    revision are left out; revisions that go back to themselves are an error.
    """
    known = edges.filter("revision_id is not null").groupBy("revision_id").agg(F.min("source_revision_id").alias("source"))
    done = known.filter("source is null").select("revision_id", F.col("revision_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    rows = known.filter("source is not null").select("revision_id", F.col("source").alias("at"), F.lit(1).cast("long").alias("depth"))
    # sources that no row has are where a path ends, like rows without a source
    ends = known.filter("source is not null").select(F.col("source").alias("at")).distinct().join(known.filter("source is not null").select(F.col("revision_id").alias("at")), "at", "left_anti")
    front = written(rows.join(ends.withColumn("end", F.lit(True)), "at", "left").select("revision_id", "at", "depth", F.coalesce("end", F.lit(False)).alias("end")), "lineage")
    finished, before = [done], -1
    while True:
        left = front.filter("not end")
        finished.append(front.filter("end").select("revision_id", F.col("at").alias("root"), "depth"))
        if not (n := left.count()):
            break
        if n == before:
            raise StoreError("revisions go back to themselves")
        # the pointers of this round: of those that are at an end and of those that are not
        here = reduce(DataFrame.unionByName, (f.select(F.col("revision_id").alias("at"), F.col("root").alias("to"), F.col("depth").alias("more"), F.lit(True).alias("end")) for f in finished[1:]))
        here = here.unionByName(left.select(F.col("revision_id").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.lit(False).alias("end")))
        front, before = written(left.drop("end").join(here, "at").select("revision_id", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), "end"), "lineage"), n
    return reduce(DataFrame.unionByName, finished)


def lineage(edges: DataFrame, revision_id: str) -> DataFrame:
    name = f"edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(name)
    return edges.sparkSession.sql(
        f"""with recursive up(revision_id, source_revision_id, depth) as (
            select revision_id, source_revision_id, 0 from {name} where revision_id = '{safe_name(revision_id)}'
            union all select e.revision_id, e.source_revision_id, depth + 1 from up join {name} e on e.revision_id = up.source_revision_id)
        select * from up"""
    )
