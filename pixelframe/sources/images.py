"""Image files: type by content, headers, PNG read and written with the standard library, Spark's image source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jpeg import jpeg, profiled

MOST_BYTES, MOST_PIXELS = 128 << 20, 100_000_000
PIXELS = "image_id int, y int, x int, r8 int, g8 int, b8 int, a8 int"
HEADER = (
    "path string, mime string, width int, height int, oriented_width int, oriented_height int, orientation int, has_alpha boolean, bit_depth int,"
    " has_icc_profile boolean, has_gps boolean, exif map<string,string>, byte_size long, error string"
)


class ImageError(ValueError):
    code = "decode_failed"


#: Lines of a text, without blank ones and comments, among which a table's size must stand.
SNIFFED_LINES = 16


def sniff(content: Column, path: Column) -> Column:
    """lut, svg or raster, by name or by the text's beginning; a table wins over a drawing."""
    lines = F.transform(F.split(F.substring(content, 1, 65536).cast("string"), r"\r?\n"), lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")))
    told = F.slice(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), 1, SNIFFED_LINES)
    lut = F.lower(path).endswith(".cube") | F.exists(told, lambda x: x.startswith("LUT_1D_SIZE") | x.startswith("LUT_3D_SIZE"))
    return F.when(lut, "lut").when(F.lower(path).endswith(".svg") | F.substring(content, 1, 4096).cast("string").contains("<svg"), "svg").otherwise("raster")


def header(data: bytes) -> dict:
    """What a file's header tells of PNG, JPEG, GIF, BMP, WebP and AVIF files, without decoding pixels."""
    if not data:
        raise ImageError("empty input")
    if len(data) > MOST_BYTES:
        raise ImageError("input is larger than 128 MiB")
    out = {"orientation": 1, "has_alpha": False, "bit_depth": 8, "has_icc_profile": False, "has_gps": False, "exif": {}}
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, kind = struct.unpack(">IIBB", data[16:26])
        out |= {"mime": "image/png", "width": w, "height": h, "has_alpha": kind in (4, 6), "bit_depth": max(8, depth)}
        for name, part in png_chunks(data):
            out["has_alpha"] |= name == b"tRNS"
            out["has_icc_profile"] |= name == b"iCCP"
            if name == b"eXIf":
                out |= exif(part)
    elif data[:2] == b"\xff\xd8":
        out |= {"mime": "image/jpeg", "width": 0, "height": 0}
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                out |= exif(data[at + 10 : at + 2 + n])
            out["has_icc_profile"] |= marker == 0xE2 and data[at + 4 : at + 16] == b"ICC_PROFILE\0"
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                out["height"], out["width"] = struct.unpack(">HH", data[at + 5 : at + 9])
                break
            at += 2 + n
    elif data[:4] == b"GIF8":
        w, h = struct.unpack("<HH", data[6:10])
        out |= {"mime": "image/gif", "width": w, "height": h, "has_alpha": True}
    elif data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        out |= {"mime": "image/bmp", "width": w, "height": abs(h)}
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out |= {"mime": "image/webp"} | _webp(data)
    elif data[4:12] in (b"ftypavif", b"ftypavis"):
        at = data.find(b"ispe", 0, 1 << 16)
        if at < 0:
            raise ImageError("AVIF file without a size")
        w, h = struct.unpack(">II", data[at + 8 : at + 16])
        out |= {"mime": "image/avif", "width": w, "height": h}
    else:
        raise ImageError("no known image type")
    w, h = out["width"], out["height"]
    if not w or not h:
        raise ImageError("no size found")
    if w * h > MOST_PIXELS:
        raise ImageError("image has more than 100 million pixels")
    out["oriented_width"], out["oriented_height"] = (h, w) if out["orientation"] >= 5 else (w, h)
    return out


def icc_profile(data: bytes) -> bytes:
    """The colour profile that a JPEG or PNG file holds, empty if none."""
    if data[:2] == b"\xff\xd8":
        parts, at = [], 2
        while at + 4 < len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            n = int.from_bytes(data[at + 2 : at + 4])
            if data[at + 1] == 0xE2 and data[at + 4 : at + 16] == b"ICC_PROFILE\0":
                parts.append((data[at + 16], data[at + 18 : at + 2 + n]))
            at += 2 + n
        return b"".join(p for _, p in sorted(parts))
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        for name, part in png_chunks(data):
            if name == b"iCCP":
                try:
                    return zlib.decompressobj().decompress(part.split(b"\0", 1)[1][1:], 16 << 20)
                except zlib.error:
                    return b""
    return b""


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _webp(data: bytes) -> dict:
    kind = data[12:16]
    if kind == b"VP8X":
        return {"has_alpha": bool(data[20] & 0x10), "has_icc_profile": bool(data[20] & 0x20), "width": 1 + int.from_bytes(data[24:27], "little"), "height": 1 + int.from_bytes(data[27:30], "little")}
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return {"has_alpha": bool(bits >> 28 & 1), "width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)}
    w, h = struct.unpack("<HH", data[26:30])
    return {"width": w & 0x3FFF, "height": h & 0x3FFF}


# EXIF tags and the names under which their values are told.
EXIF_TAGS = {
    0x010F: "camera_make", 0x0110: "camera_model", 0xA434: "lens_model", 0x9003: "datetime_original", 0x0132: "datetime", 0x829A: "exposure_time",
    0x829D: "f_number", 0x8827: "iso", 0x920A: "focal_length", 0x0131: "software",
}


def exif(tiff: bytes) -> dict:
    """Orientation, whether there is a place, and a summary of other fields, of an EXIF block; damaged ones tell what can be read."""
    out: dict = {"orientation": 1, "has_gps": False, "exif": {}}
    order = "<" if tiff[:2] == b"II" else ">"

    def directory(at: int) -> None:
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            if tag == 0x8769:
                directory(struct.unpack(order + "I", entry[8:12])[0])
            elif tag == 0x8825:
                out["has_gps"] = True
            elif tag == 0x0112 and 1 <= (v := struct.unpack(order + "H", entry[8:10])[0]) <= 8:
                out["orientation"] = v
                out["exif"]["orientation"] = str(v)
            elif tag in EXIF_TAGS and (text := _told(EXIF_TAGS[tag], kind, n, entry[8:12])):
                out["exif"].setdefault(EXIF_TAGS[tag], text)

    def _told(name: str, kind: int, n: int, inside: bytes) -> str:
        place = struct.unpack(order + "I", inside)[0]
        if kind == 2:
            return (inside if n <= 4 else tiff[place : place + n])[:n].split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind == 3:
            return str(struct.unpack(order + "H", inside[:2])[0])
        if kind == 5:
            a, b = struct.unpack(order + "II", tiff[place : place + 8])
            if not b:
                return ""
            if name == "exposure_time":
                return f"1/{b / a:g} s" if 0 < a < b else f"{a / b:g} s"
            return {"f_number": f"f/{a / b:g}", "focal_length": f"{a / b:g} mm"}.get(name, f"{a / b:g}")
        return ""

    try:
        directory(struct.unpack(order + "I", tiff[4:8])[0])
    except (struct.error, RecursionError):
        pass
    return out


def inspect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headers of all files under a path, unreadable ones with an error."""
    names = [f.split()[0] for f in HEADER.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in HEADER.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                row = dict.fromkeys(names) | {"path": p, "byte_size": len(data)}
                try:
                    row |= header(data)
                    row["exif"] = list(row["exif"].items())
                except (ImageError, struct.error, IndexError) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, HEADER)


def oriented(v: np.ndarray, orientation: int) -> np.ndarray:
    """An array (height, width, channels) the way up that its EXIF orientation asks for."""
    if orientation >= 5:
        v = v.transpose(1, 0, 2)
    turned = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.flip(v, turned) if turned else v


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 4) of uint16: a PNG file with 16 bits a channel."""
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 16 or interlaced or kind not in (0, 2, 4, 6):
        raise ImageError("not a plain PNG file of 16 bits")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    line = w * n * 2
    try:
        raw = zlib.decompressobj().decompress(b"".join(p for c, p in png_chunks(data) if c == b"IDAT"), h * (line + 1))
    except zlib.error as e:
        raise ImageError(str(e)) from None
    if len(raw) < h * (line + 1):
        raise ImageError("PNG file is cut short")
    rows = np.frombuffer(raw, np.uint8).reshape(h, line + 1)
    out, up, step = np.empty((h, line), np.uint8), np.zeros(line, np.uint8), 2 * n
    for y in range(h):
        how, x = rows[y, 0], rows[y, 1:]
        if how == 1:
            up = np.cumsum(x.reshape(-1, step), 0, dtype=np.uint8).ravel()
        elif how == 2:
            up = x + up
        elif how in (3, 4):
            up = np.frombuffer(_unfiltered(x.tolist(), up.tolist(), step, how == 4), np.uint8)
        else:
            up = x
        out[y] = up
    v = out.reshape(h, w, n, 2).astype(np.uint16)
    v = v[..., 0] << 8 | v[..., 1]
    rgb = v[..., :3] if n >= 3 else np.repeat(v[..., :1], 3, -1)
    alpha = v[..., -1:] if n in (2, 4) else np.full((h, w, 1), 65535, np.uint16)
    return np.concatenate([rgb, alpha], -1)


def _unfiltered(x: list[int], up: list[int], step: int, paeth: bool) -> bytes:
    """A line whose bytes were told by their difference to the mean, or to the nearest, of their neighbours."""
    out = [0] * step + x
    above = [0] * step + up
    for i in range(step, len(out)):
        a, b = out[i - step], above[i]
        if paeth:
            c = above[i - step]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        else:
            guess = (a + b) // 2
        out[i] = (out[i] + guess) & 255
    return bytes(out[step:])


def _located(c: str) -> Column:
    """Paths as one form of them, whoever tells them."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def read_channels(spark: SparkSession, path: str | list[str], orient: bool = True) -> DataFrame:
    """(path, y, x, r, g, b, a) on 0..1 of the files under a path, the way up that EXIF asks for; ``orient=False``, as masks
    are read, as they are stored. Headers are read first: files that are too large or unreadable are not decoded."""
    return _channels(spark, list(_heads(spark, path).toLocalIterator()), orient)


def _heads(spark: SparkSession, path: str | list[str], *more: Column) -> DataFrame:
    """(path, name, bit_depth, orientation, ...) of readable files, the path as it is read and as a name."""
    return inspect(spark, path).filter("error is null").select("path", _located("path").alias("name"), "bit_depth", "orientation", *more)


def _channels(spark: SparkSession, heads: list, orient: bool) -> DataFrame:
    """``read_channels`` of files whose headers have been read, so that no file is opened for its header again."""
    # the paths, which Spark holds on the driver in listing files too
    good = [(r.path, r.bit_depth) for r in heads]
    schema = "path string, y int, x int, r double, g double, b double, a double"
    turns = spark.createDataFrame([(r.name, r.orientation) for r in heads], "path string, orientation int")
    turns = F.broadcast(turns) if len(heads) <= 100_000 else turns
    out = spark.createDataFrame([], schema)

    def rows(name: str, v: np.ndarray, most: float, orientation: int) -> Iterator[pa.RecordBatch]:
        v = oriented(v, orientation if orient else 1)
        ys, xs = (i.ravel() for i in np.indices(v.shape[:2]))
        for at in range(0, ys.size, 1 << 18):
            part = slice(at, at + (1 << 18))
            rgba = v.reshape(-1, 4)[part] / most
            columns = [pa.array([name] * len(rgba)), pa.array(ys[part], pa.int32()), pa.array(xs[part], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(rgba[:, i]) for i in range(4))], ["path", "y", "x", *"rgba"])

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["nChannels"]
                flat = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], n)
                bgr = flat[..., 2::-1] if n >= 3 else np.repeat(flat[..., :1], 3, -1)
                alpha = flat[..., 3:] if n == 4 else np.full((*flat.shape[:2], 1), 255, np.uint8)
                yield from rows(r["path"], np.concatenate([bgr, alpha], -1), 255.0, r["orientation"])

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield from rows(r["path"], png_pixels(r["content"]), 65535.0, r["orientation"])

    if few := [p for p, depth in good if depth == 8]:
        images = spark.read.format("image").option("dropInvalid", True).load(few).select(_located("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
        out = out.unionByName(images.join(turns, "path").mapInArrow(shallow, schema))
    if many := [p for p, depth in good if depth == 16]:
        files = spark.read.format("binaryFile").load(many).select(_located("path").alias("path"), "content")
        out = out.unionByName(files.join(turns, "path").mapInArrow(deep, schema))
    return out


def read_pixels(spark: SparkSession, path: str, orient: bool = True) -> DataFrame:
    """The same as code values of 8 bits."""
    code = lambda c: F.floor(F.col(c) * 255.0 + 0.5).cast("int").alias(f"{c}8")
    return read_channels(spark, path, orient).select("path", "y", "x", *(code(c) for c in "rgba"))


def read_images(spark: SparkSession, path: str | list[str], orient: bool = True) -> tuple[DataFrame, DataFrame]:
    """The images under a path, of whatever sizes, as one relation: (image_id, y, x, r, g, b, a, width, height), and the files
    (image_id, path, width, height, has_exif, has_icc). Numbers follow the order of paths; unreadable files have none."""
    told = [(F.coalesce(F.size("exif") > 0, F.lit(False)) | F.col("has_gps")).alias("has_exif"), F.col("has_icc_profile").alias("has_icc")]
    turned = F.coalesce("orientation", F.lit(1)) >= 5 if orient else F.lit(False)
    size = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("width", "height"), ("height", "width"))]
    found = sorted(_heads(spark, path, *size, *told).toLocalIterator(), key=lambda r: r.name)
    files = spark.createDataFrame([(i, r.name, r.width, r.height, r.has_exif, r.has_icc) for i, r in enumerate(found)], "image_id int, path string, width int, height int, has_exif boolean, has_icc boolean")
    numbers = files.select("path", "image_id", "width", "height")
    pixels = _channels(spark, found, orient).join(F.broadcast(numbers) if len(found) <= 100_000 else numbers, "path")
    return pixels.select("image_id", "y", "x", *"rgba", "width", "height"), files


def profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, icc): the colour profiles of the files that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([icc_profile(c) for c in b.column("content").to_pylist()], pa.binary())], ["path", "icc"])

    files = spark.read.format("binaryFile").load(path).select(_located("path").alias("path"), "content")
    return files.mapInArrow(run, "path string, icc binary").filter("octet_length(icc) > 0")


def with_profiles(files: DataFrame, icc: DataFrame) -> DataFrame:
    """JPEG files (image_id, content, ...) with the profile of their image from (image_id, icc), if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [profiled(c, p) if p else c for c, p in zip(b.column("content").to_pylist(), b.column("icc").to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("content"), "content", pa.array(made, pa.binary())).drop_columns(["icc"])

    schema = files.schema
    return files.join(icc, "image_id", "left").select(*schema.names, "icc").mapInArrow(run, schema)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3 or 4) of uint8 or uint16."""
    h, w, n = pixels.shape
    depth = 16 if pixels.dtype == np.uint16 else 8
    raw = pixels.astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8).reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 2 if n == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


#: Lines of an image that go to a file's task as one row.
BAND = 64


def encoded(p, fmt: str = "png", quality: int | None = None, bit_depth: int = 8, icc: bytes = b"") -> DataFrame:
    """(image_id, content, width, height): one file an image, as PNG or, on white and with a colour profile if one is given, as JPEG. Lines are packed into bands first, so that the
    task which writes a file holds its bytes and not a row for each pixel."""
    if fmt not in ("png", "jpeg"):
        raise ImageError(f"encode_failed: no encoder for {fmt} in this environment")
    from ..frame import codes
    from ..functions.numeric import to_u16
    from ..operators.composite import flattened

    sizes, size = p.each(lambda e: (e.width, e.height)), F.col("size_id") if p.mixed else F.lit(0).alias("size_id")
    if fmt == "jpeg":
        df, kind, channels = flattened(p), np.uint8, ("r8", "g8", "b8")
    elif bit_depth == 16:
        df, kind, channels = p.to("srgb").df.select(*p.keys, *(to_u16(F.col(c)).alias(c) for c in "rgba")), np.uint16, tuple("rgba")
    else:
        df, kind, channels = codes(p), np.uint8, ("r8", "g8", "b8", "a8")

    def band(table: pa.Table) -> pa.Table:
        k, (width, height) = table.column("band")[0].as_py(), sizes[table.column("size_id")[0].as_py()]
        out = np.zeros((min(BAND, height - k * BAND), width, len(channels)), kind)
        y, x = table.column("y").to_numpy() - k * BAND, table.column("x").to_numpy()
        for i, c in enumerate(channels):
            out[y, x, i] = table.column(c).to_numpy()
        return pa.table({**{c: table.column(c)[:1] for c in ("image_id", "size_id", "band")}, "data": pa.array([out.tobytes()], pa.binary())})

    def file(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("band").to_pylist(), table.column("data").to_pylist(), strict=True))
        width, height = sizes[table.column("size_id")[0].as_py()]
        pixels = np.frombuffer(b"".join(d for _, d in parts), kind).reshape(height, width, len(channels))
        data = png(pixels) if fmt == "png" else jpeg(pixels, quality or 85, icc)
        return pa.table({"image_id": table.column("image_id")[:1], "content": pa.array([data], pa.binary()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32())})

    bands = df.select("image_id", size, F.floor(F.col("y") / BAND).cast("int").alias("band"), "y", "x", *channels)
    bands = bands.groupBy("image_id", "size_id", "band").applyInArrow(band, "image_id int, size_id int, band int, data binary")
    return bands.groupBy("image_id", "size_id").applyInArrow(file, "image_id int, content binary, width int, height int")
