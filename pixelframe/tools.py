"""A workspace of images: files in, derivations made once, previews, comparisons and masks, all in a ledger."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import KEY, PixelFrame, codes, from_channels, from_codes, from_sizes
from .operators import compare, geometry, masks, tilt
from .plans.compile import execute, plan_of, preview
from .plans.recipe import canonical, recipe_hash
from .sources import images, svg
from .sources.cube import MOST_BYTES as CUBE_BYTES
from .sources.cube import Cube, read_cube
from .sources.sinks import export_file, preview_path, put, stored, write_objects
from .sources.store import Ledger, StoreError, object_path, preview_key

LUT_MIME, SVG_MIME = "application/x-cube-lut", "image/svg+xml"
RASTERS = ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp", "image/avif")
MIMES = {"png": "image/png", "jpeg": "image/jpeg"}
#: Long edges of previews and of compared images.
PREVIEW_EDGE, COMPARED_EDGE = 768, 640
OVERLAYS = ("grid", "thirds", "horizon", "mask")


class ToolError(ValueError):
    """A request that cannot be met: ``code``, and how to go on."""

    def __init__(self, code: str, text: str, recovery: str = ""):
        super().__init__(text)
        self.code, self.recovery = code, recovery


class _Assets(Mapping):
    """What recipes refer to, read when it is asked for."""

    def __init__(self, workspace: Workspace):
        self.workspace, self.known = workspace, {}

    def __getitem__(self, revision_id: str) -> PixelFrame | Cube | svg.Drawing:
        if revision_id not in self.known:
            self.known[revision_id] = self.workspace.asset(revision_id)
        return self.known[revision_id]

    def mask(self, revision_id: str) -> PixelFrame:
        return self.workspace.frame(revision_id, orient=False)

    def __contains__(self, revision_id: object) -> bool:
        return self.workspace.row(str(revision_id)) is not None

    def __iter__(self) -> Iterator[str]:
        return (r.revision_id for r in self.workspace.ledger.rows().select("revision_id").toLocalIterator())

    def __len__(self) -> int:
        return self.workspace.ledger.rows().count()


class Workspace:
    """``folder`` is a path that the driver and all executors mount."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ledger = Ledger(spark, self.folder)

    # files and revisions

    def import_files(self, path: str) -> DataFrame:
        """The ledger's row of each file under a path; content that is known keeps its revision. Tables have no size,
        drawings their own one, images the size that their orientation gives them."""
        files = self.spark.read.format("binaryFile").load(path).select("path", "content")
        files = files.withColumn("kind", images.sniff(F.col("content"), F.col("path")))

        def run(batches):
            for b in batches:
                rows = []
                for file, data, kind in zip(*(b.column(c).to_pylist() for c in ("path", "content", "kind")), strict=True):
                    try:
                        rows.append((file, data, *_described(data, kind), None))
                    except (images.ImageError, svg.SvgError) as e:
                        rows.append((file, None, None, 0, 0, str(e)))
                kinds = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "content", "mime_type", "width", "height", "error"])

        told = files.mapInArrow(run, "path string, content binary, mime_type string, width int, height int, error string")
        if bad := told.filter("error is not null").select("path", "error").head():
            raise ToolError("decode_failed", f"{bad.path}: {bad.error}", "import images, .cube tables or SVG drawings within the limits")
        told = told.drop("error")
        write_objects(told.select(object_path(F.sha2("content", 256), F.col("mime_type")).alias("rel_path"), "content"), self.folder)
        return self.ledger.import_assets(told)

    def row(self, revision_id: str):
        return self.ledger.rows().filter(F.col("revision_id") == revision_id).head()

    def _raster(self, revision_id: str):
        row = self.row(revision_id)
        if row is None:
            raise StoreError(f"unknown revision {revision_id}")
        if row.mime_type not in RASTERS:
            raise ToolError("not_an_image", f"{revision_id} is {row.mime_type}", "refer to it from a recipe; transforms start from an image")
        return row

    def path(self, row) -> str:
        return os.path.join(self.folder, row.rel_path)

    def read(self, revision_id: str) -> bytes:
        """A revision's file."""
        row = self.row(revision_id)
        if row is None:
            raise StoreError(f"unknown revision {revision_id}")
        found = self.spark.read.format("binaryFile").load(self.path(row)).select("content").head()
        return bytes(found.content)

    def frame(self, revision_id: str, orient: bool = True) -> PixelFrame:
        """A revision's pixels as image 0; ``orient=False`` as they are stored."""
        row = self._raster(revision_id)
        pixels = images.read_channels(self.spark, self.path(row), orient).select(F.lit(0).alias("image_id"), "y", "x", *"rgba")
        width, height = row.width, row.height
        if not orient:
            head = images.inspect(self.spark, self.path(row)).select("width", "height").head()
            width, height = head.width, head.height
        return from_channels(pixels, width, height)

    def asset(self, revision_id: str) -> PixelFrame | Cube | svg.Drawing:
        row = self.row(revision_id)
        if row is None:
            raise StoreError(f"unknown revision {revision_id}")
        if row.mime_type == LUT_MIME:
            return read_cube(self.spark, self.path(row))
        if row.mime_type == SVG_MIME:
            return svg.Drawing(self.read(revision_id).decode())
        return self.frame(revision_id)

    # transforms

    def apply_transform(self, revision_id: str, recipe: dict | str) -> dict[str, Any]:
        """A new revision by a recipe or preset; one that was made before is given back without work."""
        parsed = plan_of(recipe)
        self._raster(revision_id)
        text = recipe if isinstance(recipe, str) else json.dumps(recipe)
        row = self.apply_transforms(self.spark.createDataFrame([(revision_id, text)], "source_revision_id string, recipe string")).head()
        if row.revision_id is None:
            code = next((c for c in ("encode_failed", "decode_failed") if row.error.startswith(c)), "transform_failed")
            raise ToolError(code, f"{revision_id}: {row.error}", "change the recipe, or import the image again")
        return {"revision_id": row.revision_id, "recipe_hash": recipe_hash(parsed), "reused": row.reused, "warnings": list(row.warnings)}

    def apply_transforms(self, requests: DataFrame) -> DataFrame:
        """``requests`` (source_revision_id, recipe as JSON or a preset's name) with recipe_hash, revision_id, reused, warnings and error.

        What the ledger knows is not made again, what is asked for twice is made once. Each distinct recipe is one plan over all its images, of
        whatever sizes; the tasks that encode files write them, and the ledger is appended to once, at the end. A request that cannot be met
        has an ``error`` and no revision, and does not keep others from being met; null requests are such. Only recipes and paths go to
        the driver.
        """
        rows = requests.select("source_revision_id", "recipe")
        plans, told = {}, []
        for (text,) in rows.select("recipe").distinct().toLocalIterator():
            try:
                parsed = plan_of(text or "{}")
                plans[recipe_hash(parsed)] = parsed
                told.append((text, recipe_hash(parsed), None))
            except ValueError as e:
                told.append((text, None, str(e)))
        known = self.spark.createDataFrame(told, "_text string, recipe_hash string, _bad string")
        asked = rows.join(F.broadcast(known) if len(told) <= 10_000 else known, F.col("recipe").eqNullSafe(F.col("_text"))).drop("_text")
        keys = ["source_revision_id", "recipe_hash"]
        wanted = asked.filter("recipe_hash is not null").select(*keys).distinct()
        sources = self.ledger.known().select(F.col("revision_id").alias("source_revision_id"), "mime_type", F.col("rel_path").alias("source_path"))
        staging = os.path.join(self.folder, f"staging-{uuid.uuid4().hex}")
        before = f"{staging}/before"
        self.ledger.memo(wanted).select(*keys).write.parquet(before)
        new = wanted.join(self.spark.read.parquet(before), keys, "left_anti").join(sources, "source_revision_id").filter(F.col("mime_type").isin(*RASTERS))
        new.write.parquet(f"{staging}/new")
        new, made = self.spark.read.parquet(f"{staging}/new"), None
        # a few at a time would only be more jobs; each plan is written by itself, so that none grows with the number of recipes
        for wanted_hash, mime in sorted(map(tuple, new.select("recipe_hash", "mime_type").distinct().toLocalIterator())):
            part = self._made(new.filter((F.col("recipe_hash") == wanted_hash) & (F.col("mime_type") == mime)), plans[wanted_hash], mime)
            if isinstance(part, DataFrame):
                stored(part, self.folder).write.mode("append").parquet(f"{staging}/made")
                made = f"{staging}/made"
            else:
                told.append((wanted_hash, mime, part))
        none = "source_revision_id string, recipe_hash string, warnings array<string>"
        warned = self.spark.createDataFrame([], none)
        if made:
            rows_made = self.spark.read.parquet(made)
            self.ledger.merge(rows_made.drop("warnings"))
            warned = rows_made.select(*keys, "warnings").dropDuplicates(keys)
        failed = self.spark.createDataFrame([t for t in told if t[0] in plans], "recipe_hash string, mime_type string, _failed string")
        had = self.spark.read.parquet(before).withColumn("reused", F.lit(True))
        out = asked.join(self.ledger.memo(wanted), keys, "left").join(had, keys, "left").join(warned, keys, "left").join(sources, "source_revision_id", "left").join(failed, ["recipe_hash", "mime_type"], "left")
        error = (
            F.when(F.col("_bad").isNotNull(), F.col("_bad"))
            .when(F.col("mime_type").isNull(), F.concat(F.lit("unknown revision "), F.coalesce("source_revision_id", F.lit("null"))))
            .when(~F.col("mime_type").isin(*RASTERS), F.concat(F.lit("not an image: "), "mime_type"))
            .otherwise(F.coalesce("_failed", F.lit("decode_failed: the image cannot be read")))
        )
        out = out.select(
            "source_revision_id", "recipe", "recipe_hash", "revision_id", F.coalesce("reused", F.lit(False)).alias("reused"),
            F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.when(F.col("revision_id").isNull(), error).alias("error"),
        )
        out.write.parquet(f"{staging}/answers")
        return self.spark.read.parquet(f"{staging}/answers")

    def cleanup(self) -> None:
        """Delete the tables that answers are read from; no answer that is still to be read may be kept."""
        for name in os.listdir(self.folder):
            if name.startswith("staging-"):
                shutil.rmtree(os.path.join(self.folder, name))

    def _made(self, asked: DataFrame, parsed: dict, mime: str) -> DataFrame | str:
        """The files that one recipe makes of images of one type: what the ledger needs of them, content and warnings; or why there are none."""
        paths = [os.path.join(self.folder, r.source_path) for r in asked.select("source_path").distinct().toLocalIterator()]
        pixels, files = images.read_images(self.spark, paths)
        n = files.count()
        if not n:
            return "decode_failed: the image cannot be read"
        try:
            out = execute(parsed, pixels, assets=_Assets(self), source_format=mime.split("/")[1], sizes=files, shared=n)
            content = images.encoded(out.frame, out.format, out.quality, out.bit_depth)
        except (ValueError, KeyError) as e:
            return str(e.args[0] if e.args else e)
        all_goes = any(o["op"] == "strip_metadata" and o["scope"] == "all" for o in parsed["operations"])
        if out.format == "jpeg" and not all_goes:
            content = images.with_profiles(content, images.profiles(self.spark, paths).join(files.select("path", "image_id"), "path").select("image_id", "icc"))
        lost = [F.lit(w) for w in out.warnings]
        lost.append(F.when(F.col("has_exif"), "EXIF data is dropped when a file is written again"))
        if out.format != "jpeg" and not all_goes:
            lost.append(F.when(F.col("has_icc"), f"the colour profile is dropped: {out.format} files are written without one"))
        name = lambda c: F.substring_index(c, "/", -1)
        files = files.select("image_id", name("path").alias("_name"), F.array_compact(F.array(*lost)).cast("array<string>").alias("warnings"))
        asked = asked.select("source_revision_id", "recipe_hash", name("source_path").alias("_name"))
        return asked.join(files, "_name").join(content, "image_id").select("source_revision_id", F.lit(canonical(parsed)).alias("recipe"), "recipe_hash", F.lit(MIMES[out.format]).alias("mime_type"), "width", "height", "content", "warnings")

    def render_preview(self, revision_id: str, recipe: dict | str, overlay: str | None = None, mask_revision_id: str | None = None) -> dict[str, Any]:
        """The path of a JPEG of at most 768 pixels a side, with guide lines or a mask over it; written once."""
        if overlay is not None and overlay not in OVERLAYS:
            raise ToolError("invalid_overlay", f"unknown overlay {overlay!r}", f"one of {', '.join(OVERLAYS)}")
        if (overlay == "mask") != (mask_revision_id is not None):
            raise ToolError("mask_revision_id_required" if overlay == "mask" else "mask_revision_id_without_mask_overlay", "the overlay mask and mask_revision_id go together")
        parsed = plan_of(recipe)
        wanted, source = recipe_hash(parsed), self.frame(revision_id)
        rel_path = preview_path(preview_key(revision_id, wanted, overlay or "", mask_revision_id or ""), "jpg")
        out = execute(preview(parsed), source.df, source.width, source.height, _Assets(self))
        p = out.frame
        if not os.path.exists(os.path.join(self.folder, rel_path)):
            if overlay == "mask":
                shown = compare.mask_tint(p, masks.plane(self.frame(mask_revision_id, False), p.width, p.height))
            elif overlay:
                shown = compare.guides(p, overlay)
            else:
                shown = None
            if shown is not None:
                p = from_codes(shown.withColumn("a8", F.lit(255)), p.width, p.height)
            content = images.encoded(p, "jpeg", 80).select(F.lit(rel_path).alias("rel_path"), "content")
            write_objects(content, self.folder)
        return {"path": os.path.join(self.folder, rel_path), "width": p.width, "height": p.height, "recipe_hash": wanted, "warnings": out.warnings}

    def compare_revisions(self, a: str, b: str, layout: str = "side_by_side") -> PixelFrame:
        """Both images within 640 pixels beside or above each other, or the heat map of their difference."""
        if layout not in ("side_by_side", "stacked", "diff"):
            raise ToolError("invalid_layout", f"unknown layout {layout!r}", "side_by_side, stacked or diff")
        p, q = (geometry.resize(self.frame(r), COMPARED_EDGE, COMPARED_EDGE, "contain") for r in (a, b))
        if layout == "diff":
            return from_codes(compare.diff_heatmap(p, q).withColumn("a8", F.lit(255)), p.width, p.height)
        shown = compare.beside(p, q, stacked=layout == "stacked")
        gap = 8
        width, height = (max(p.width, q.width), p.height + gap + q.height) if layout == "stacked" else (p.width + gap + q.width, max(p.height, q.height))
        return from_codes(shown.withColumn("a8", F.lit(255)), width, height)

    def generate_mask(self, kind: str, reference_revision_id: str, **fields) -> dict[str, Any]:
        """A mask image of the reference's size as a revision made from it."""
        p = self.frame(reference_revision_id)
        weights = masks.generate(p, kind, **fields)
        text = json.dumps({"generator": {"kind": kind} | {k: v for k, v in sorted(fields.items()) if v is not None}}, sort_keys=True, separators=(",", ":"))
        wanted = f"mask:{text}"
        asked = self.spark.createDataFrame([(reference_revision_id, wanted)], "source_revision_id string, recipe_hash string")
        mean = masks.mean_weight(weights).head().mean_weight
        if made := self.ledger.memo(asked).head():
            return {"revision_id": made.revision_id, "mean_weight": mean, "reused": True}
        gray = PixelFrame(weights.select(*KEY, *(F.col("w").alias(c) for c in "rgb"), F.lit(1.0).alias("a")), p.width, p.height)
        told = {"source_revision_id": reference_revision_id, "recipe": text, "recipe_hash": wanted, "mime_type": "image/png"}
        self.ledger.merge(stored(images.encoded(gray).select(*(F.lit(v).alias(k) for k, v in told.items()), "width", "height", "content"), self.folder))
        return {"revision_id": self.ledger.memo(asked).head().revision_id, "mean_weight": mean, "reused": False}

    # many revisions at once

    def _images(self, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of revisions (revision_id) those that are images that can be read: (revision_id, image_id), pixels with sizes, and files. An
        image is read once, whatever number of revisions have its content."""
        known = self.ledger.known().filter(F.col("mime_type").isin(*RASTERS)).select("revision_id", "rel_path")
        found = revisions.select("revision_id").distinct().join(known, "revision_id")
        paths = [os.path.join(self.folder, r.rel_path) for r in found.select("rel_path").distinct().toLocalIterator()]
        if not paths:
            empty = self.spark.createDataFrame([], "image_id int, path string, width int, height int")
            return found.select("revision_id", F.lit(0).alias("image_id")), self.spark.createDataFrame([], "image_id int, y int, x int, r double, g double, b double, a double, width int, height int"), empty
        pixels, files = images.read_images(self.spark, paths)
        name = lambda c: F.substring_index(c, "/", -1).alias("_name")
        return found.select("revision_id", name("rel_path")).join(files.select("image_id", name("path")), "_name").select("revision_id", "image_id"), pixels, files

    def generate_masks(self, kind: str, references: DataFrame, **fields) -> DataFrame:
        """``references`` (revision_id) with mask_revision_id, mean_weight and reused: a mask image for each, of its size, made once. References
        that are no images that can be read have no mask."""
        text = json.dumps({"generator": {"kind": kind} | {k: v for k, v in sorted(fields.items()) if v is not None}}, sort_keys=True, separators=(",", ":"))
        numbers, pixels, files = self._images(references)
        p = from_sizes(pixels, files)
        weights = masks.generate(p, kind, **fields)
        gray = replace(p, df=weights.select(*p.keys, *(F.col("w").alias(c) for c in "rgb"), F.lit(1.0).alias("a")))
        told = {"recipe": text, "recipe_hash": f"mask:{text}", "mime_type": "image/png"}
        keys = ["source_revision_id", "recipe_hash"]
        asked = numbers.select(F.col("revision_id").alias("source_revision_id"), "image_id", *(F.lit(v).alias(k) for k, v in told.items()))
        staging = os.path.join(self.folder, f"staging-{uuid.uuid4().hex}")
        self.ledger.memo(asked.select(*keys)).select(*keys).write.parquet(f"{staging}/before")
        before = self.spark.read.parquet(f"{staging}/before")
        new = asked.join(before, keys, "left_anti").join(images.encoded(gray), "image_id").drop("image_id")
        stored(new, self.folder).write.parquet(f"{staging}/made")
        self.ledger.merge(self.spark.read.parquet(f"{staging}/made"))
        out = asked.join(self.ledger.memo(asked.select(*keys)), keys).join(masks.mean_weight(weights), "image_id").join(before.withColumn("reused", F.lit(True)), keys, "left")
        out = out.select("source_revision_id", F.col("revision_id").alias("mask_revision_id"), "mean_weight", F.coalesce("reused", F.lit(False)).alias("reused"))
        references.select("revision_id").join(out.withColumnRenamed("source_revision_id", "revision_id"), "revision_id", "left").write.parquet(f"{staging}/answers")
        return self.spark.read.parquet(f"{staging}/answers")

    def render_previews(self, revisions: DataFrame, recipe: dict | str, overlay: str | None = None) -> DataFrame:
        """``revisions`` (revision_id) with the path and size of a preview of each by one recipe, with guide lines if asked for. Tasks
        write the files; those that are there stay. Revisions that are no images that can be read have no path."""
        if overlay is not None and overlay not in OVERLAYS[:3]:
            raise ToolError("invalid_overlay", f"unknown overlay {overlay!r}", f"one of {', '.join(OVERLAYS[:3])}")
        parsed = plan_of(recipe)
        numbers, pixels, files = self._images(revisions)
        out = execute(preview(parsed), pixels, assets=_Assets(self), sizes=files, shared=max(1, files.count())).frame
        if overlay:
            shown = compare.guides(out, overlay).withColumn("a8", F.lit(255))
            out = from_codes(shown, None, None, extents=out.extents)
        key = F.concat(F.lit("previews/"), preview_key(F.col("revision_id"), F.lit(recipe_hash(parsed)), overlay or ""), F.lit(".jpg"))
        made = numbers.select("revision_id", "image_id", key.alias("rel_path")).join(images.encoded(out, "jpeg", 80), "image_id")
        staging = os.path.join(self.folder, f"staging-{uuid.uuid4().hex}")
        put(made.select("revision_id", "rel_path", "content", "width", "height"), self.folder).write.parquet(f"{staging}/answers")
        return revisions.select("revision_id").join(self.spark.read.parquet(f"{staging}/answers"), "revision_id", "left")

    def compare_pairs(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) of revisions with mean_diff, max_diff and changed, within 640 pixels; null where one cannot be read, or where
        their sizes differ then."""
        every = pairs.select(F.col("a").alias("revision_id")).unionByName(pairs.select(F.col("b").alias("revision_id"))).distinct()
        numbers, pixels, files = self._images(every)
        size = files.select("image_id", F.struct("width", "height").alias("size"))
        of = lambda c: numbers.join(size, "image_id").select(F.col("revision_id").alias(c), F.col("image_id").alias(f"_{c}"), F.col("size").alias(f"size_{c}"))
        known = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
        fits = lambda c: F.struct(*(F.greatest(F.lit(1), F.floor(F.col(f"size_{c}")[k] * F.least(F.lit(1.0), COMPARED_EDGE / F.greatest(F.col(f"size_{c}.width"), F.col(f"size_{c}.height"))) + 0.5)).alias(k) for k in ("width", "height")))
        known = known.filter(fits("a") == fits("b")).select("a", "b", "_a", "_b")
        # pairs of the same images have the same difference, so the images' numbers are the pair's
        met = [tuple(r) for r in known.select("_a", "_b").distinct().toLocalIterator()]
        table = self.spark.createDataFrame([(i, *p) for i, p in enumerate(sorted(met))], "pair int, _a int, _b int")
        table = F.broadcast(table) if len(met) <= 100_000 else table

        def side(c: str) -> PixelFrame:
            rows = pixels.join(table.select(F.col("pair"), F.col(c).alias("image_id")), "image_id").drop("image_id").withColumnRenamed("pair", "image_id")
            return geometry.resize(from_sizes(rows, files), COMPARED_EDGE, COMPARED_EDGE, "contain")

        stats = compare.diff_stats(side("_a"), side("_b")).withColumnRenamed("image_id", "pair")
        found = known.join(table, ["_a", "_b"]).join(stats, "pair").select("a", "b", "mean_diff", "max_diff", "changed")
        return pairs.select("a", "b").join(found, ["a", "b"], "left")

    def detect_tilt(self, revision_id: str, **settings) -> dict[str, Any]:
        return tilt.detect(self.frame(revision_id), **settings).head().asDict(True)

    def inspect(self, revision_id: str) -> dict[str, Any]:
        return images.inspect(self.spark, self.path(self._raster(revision_id))).head().asDict(True)

    def export(self, revision_id: str, target: str, overwrite: bool = False) -> str:
        """Copy a revision's file out of the workspace; gives the path that was written."""
        row = self.row(revision_id)
        if row is None:
            raise StoreError(f"unknown revision {revision_id}")
        return export_file(self.path(row), target, self.folder, overwrite)

    def list_assets(self) -> DataFrame:
        return self.ledger.revisions()


def _described(data: bytes, kind: str) -> tuple[str, int, int]:
    """Type and size of a file's content."""
    if kind == "lut":
        if len(data) > CUBE_BYTES:
            raise images.ImageError("limit_exceeded: the table is larger than 16 MiB")
        return LUT_MIME, 0, 0
    if kind == "svg":
        if len(data) > svg.MOST_BYTES:
            raise images.ImageError("limit_exceeded: the drawing is larger than 16 MiB")
        return SVG_MIME, *svg.size_of(data.decode("utf-8", "replace"))
    head = images.header(data)
    return head["mime"], head["oriented_width"], head["oriented_height"]
