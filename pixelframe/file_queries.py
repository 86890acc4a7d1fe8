"""Queries of files: images, ledgers and tables that tasks write from the given tables into the shared folder and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, sql
from .frame import from_sizes
from .shared import shared_dir
from .sources import images, store
from .sources.cube import read_cube
from .sources.sinks import write_objects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = query, oracle


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder's name, as a path that tasks can open."""
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


# images of three sizes as files, the way up that their numbers modulo eight tell
def _turned(content: Column, orientation: Column) -> Column:
    """PNG files with an EXIF orientation: a chunk of 26 bytes behind the first one."""
    tiff = F.concat(F.lit("49492A0008000000" + "0100" + "1201030001000000"), F.lpad(F.hex(orientation), 2, "0"), F.lit("000000" + "00000000"))
    body = F.concat(F.lit("eXIf").cast("binary"), F.unhex(tiff))
    chunk = F.concat(F.unhex(F.lit("0000001A")), body, F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))
    return F.concat(F.substring(content, 1, 33), chunk, F.substring(content, 34, 2**31 - 1))


def _written(spark: SparkSession, sf_dir: str, **how) -> str:
    """The folder of one file an image; names follow the images' numbers."""
    made = images.encoded(from_sizes(fixtures.sizes_px(spark, sf_dir)), **how)
    content = F.col("content") if how.get("fmt") == "jpeg" else _turned(F.col("content"), F.col("image_id") % 8 + 1)
    folder = _folder(spark, "files")
    write_objects(made.select(F.format_string(f"%08d.{how.get('fmt', 'png')}", "image_id").alias("rel_path"), content.alias("content")), folder)
    return folder


def _decoded(most: int, orient: bool, **how) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels, _ = images.read_images(spark, _written(spark, sf_dir, **how), orient)
        return pixels.select("image_id", "y", "x", *(F.round(F.col(c) * most).cast("int").alias(c) for c in "rgba"))

    return query


_SIZES = "select *, [32, 24, 31][image_id % 3 + 1] w, [32, 30, 17][image_id % 3 + 1] h, image_id % 8 + 1 o"
_STORED = f"with p as (select * from ({_SIZES} from ({sql.ORDERS})) where x < w and y < h) "
_X = "case o when 1 then x when 2 then w - 1 - x when 3 then w - 1 - x when 4 then x when 5 then y when 6 then h - 1 - y when 7 then h - 1 - y else y end::INT x"
_Y = "case o when 1 then y when 2 then y when 3 then h - 1 - y when 4 then h - 1 - y when 5 then x when 6 then x when 7 then w - 1 - x else w - 1 - x end::INT y"
add("file_decode", _decoded(255, True), _STORED + f"select image_id, {_Y}, {_X}, r8 r, g8 g, b8 b, a8 a from p")
add("file_decode_plain", _decoded(255, False), _STORED + "select image_id, y, x, r8 r, g8 g, b8 b, a8 a from p")
add("file_decode_16_bits", _decoded(65535, True, bit_depth=16), _STORED + f"select image_id, {_Y}, {_X}, r8 * 257 r, g8 * 257 g, b8 * 257 b, a8 * 257 a from p")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every image as a PNG file of 8 and of 16 bits and as a JPEG file."""
    heads = images.inspect(spark, [_written(spark, sf_dir), _written(spark, sf_dir, bit_depth=16), _written(spark, sf_dir, fmt="jpeg")])
    number = F.regexp_extract("path", r"(\d{8})\.\w+$", 1).cast("int")
    return heads.select(number.alias("image_id"), "mime", "width", "height", "oriented_width", "oriented_height", "orientation", "has_alpha", "bit_depth", F.col("error").isNull().alias("good"))


_KINDS = "(values ('image/png', 8), ('image/png', 16), ('image/jpeg', 8)) k(mime, bit_depth)"
_TURN = "case when mime = 'image/png' then o else 1 end"
add(
    "file_headers", _headers,
    _STORED + f"select image_id, mime, w width, h height, case when {_TURN} >= 5 then h else w end oriented_width, case when {_TURN} >= 5 then w else h end oriented_height, "
    f"({_TURN})::INT orientation, mime = 'image/png' has_alpha, bit_depth, true good from (select distinct image_id, w, h, o from p), {_KINDS}",
)


# ledgers
def _rows_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of sixteen files of lines of JSON, a row for each turn and a blank line after each first turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat_ws("_", F.lit("rev"), F.col("conv_id").cast("string"), turn.cast("string"))
    row = F.struct(
        F.concat(F.lit("ast_"), F.col("conv_id").cast("string")).alias("asset_id"), name(F.col("turn")).alias("revision_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("source_revision_id"),
        (F.col("conv_id") % 1000 + 1).alias("width"), (F.col("turn") + 1).alias("height"), F.lit("image/png").alias("mime_type"), F.octet_length("text").alias("byte_size"), F.sha2("text", 256).alias("sha256"),
        store.object_path(F.sha2("text", 256), F.lit("image/png")).alias("rel_path"), F.struct(F.col("turn").alias("z"), F.col("role").alias("a")).alias("recipe"), F.create_map(F.lit("text"), F.col("text")).alias("origin"),
        F.lit("2020-01-01T00:00:00Z").alias("created_at"),
    )
    lines = F.when(F.col("turn") == 0, F.array(F.to_json(row), F.lit(" "))).otherwise(F.array(F.to_json(row)))
    t = t.select((F.col("conv_id") % 16).alias("k"), "conv_id", "turn", "role", "text", F.posexplode(lines).alias("i", "value"))
    folder = _folder(spark, "ledger")
    t.repartition(16, "k").sortWithinPartitions("k", "conv_id", "turn", "role", "text", "i").select("k", "value").write.partitionBy("k").text(folder)
    return store.scan_jsonl(spark, folder).select("revision_id", "source_revision_id", "width", "height", "byte_size", "sha256", "rel_path", "recipe", F.sha2(F.col("origin")["text"], 256).alias("told"), "ledger_seq")


add(
    "store_ledger_scan", _rows_of_turns,
    """with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations)
select 'rev_' || conv_id || '_' || turn revision_id, case when turn > 0 then 'rev_' || conv_id || '_' || (turn - 1) end source_revision_id, (conv_id % 1000 + 1)::INT width, (turn + 1)::INT height,
  strlen(text) byte_size, sha256(text) sha256, 'objects/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.png' rel_path, '{"a":"' || role || '","z":' || turn || '}' recipe, sha256(text) told,
  (sum(case when turn = 0 then 2 else 1 end) over (partition by conv_id % 16 order by conv_id, turn, role, text rows unbounded preceding) - case when turn = 0 then 2 else 1 end)::BIGINT ledger_seq from t""",
)


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents imported as files, twice; then what each language makes of them, of the even ones first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    ledger = store.Ledger(spark, _folder(spark, "appended"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.lit("image/png").alias("mime_type"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    for _ in range(2):
        ledger.import_assets(files)
    sha = F.sha2(F.concat("lang", "text"), 256)
    made = docs.select(
        "doc_id", F.concat(F.lit("rev_"), F.substring(F.sha2("text", 256), 1, 26)).alias("source_revision_id"), F.col("lang").alias("recipe"), F.sha2("lang", 256).alias("recipe_hash"), F.lit("image/png").alias("mime_type"),
        F.lit(1).alias("width"), F.lit(1).alias("height"), F.octet_length(F.concat("lang", "text")).cast("long").alias("byte_size"), sha.alias("sha256"), store.object_path(sha, F.lit("image/png")).alias("rel_path"),
    )
    ledger.merge(made.filter("doc_id % 2 = 0").drop("doc_id"))
    ledger.merge(made.drop("doc_id"))
    return ledger.rows().select("revision_id", "source_revision_id", "asset_id", "byte_size", "sha256", "rel_path", F.col("origin")["path"].alias("path"))


add(
    "store_ledger_append", _appended,
    f"""with docs as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') t from documents),
each as (select doc_id::VARCHAR path, lang, t, substr(sha256(t), 1, 26) k, lang || t made from docs)
select 'rev_' || k revision_id, null source_revision_id, 'ast_' || k asset_id, strlen(any_value(t)) byte_size, sha256(any_value(t)) sha256,
  'objects/' || substr(k, 1, 2) || '/' || sha256(any_value(t)) || '.png' rel_path, min(path) path from each group by k
union all
select 'rev_' || substr(sha256('rev_' || k || chr(0) || sha256(lang) || chr(0) || '{store.ENGINE_VERSION}'), 1, 26), 'rev_' || k, 'ast_' || k, strlen(any_value(made)), sha256(any_value(made)),
  'objects/' || substr(sha256(any_value(made)), 1, 2) || '/' || sha256(any_value(made)) || '.png', null from each group by k, lang""",
)


# tables of colours
def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose values are shares of orders and of customers, as a file with a comment for each fourth line."""
    counted = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_custkey") % 4096).alias("i")).agg(F.count(F.lit(1)).alias("n"), (F.max("o_orderkey") % 1000).alias("most"))
    rows = spark.range(4096).withColumnRenamed("id", "i").join(counted, "i", "left").fillna(0)
    value = lambda c: F.format_string("0.%03d", c)
    line = F.concat_ws(" ", value(F.col("n") % 1000), F.concat(F.lit("-"), value(F.col("most"))), F.lit("1.25e-1"))
    lines = rows.select("i", F.when(F.col("i") % 4 == 0, F.concat(line, F.lit("\t# each fourth"))).otherwise(line).alias("value"))
    head = spark.createDataFrame([(-2, 'TITLE "shares"'), (-1, "LUT_1D_SIZE 4096")], "i long, value string")
    folder = _folder(spark, "table")
    head.unionByName(lines).repartition(1).sortWithinPartitions("i").select("value").write.text(folder)
    cube = read_cube(spark, folder)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cube.rows)], "i int, r double, g double, b double")


add(
    "file_table_scan", _table,
    "select i::INT i, (coalesce(n, 0) % 1000) / 1000::DOUBLE r, -(coalesce(most, 0) / 1000::DOUBLE) g, 0.125::DOUBLE b from range(4096) a(i) left join "
    "(select o_custkey % 4096 k, count(*) n, max(o_orderkey) % 1000 most from orders group by 1) on i = k",
)
