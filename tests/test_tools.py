"""Files in and out, and the workspace's tools from import to comparison."""

import json
import struct
import zlib

import numpy as np
import pytest

from pixelframe.sources import images
from pixelframe.sources.jpeg import code_lengths, jpeg
from pixelframe.sources.store import StoreError, scan_jsonl
from pixelframe.tools import ToolError, Workspace

LUT = "# LUT_3D_SIZE 9\nTITLE \"x\"\nlut_3d_size 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))


def gradient(h=21, w=34):
    y, x = np.indices((h, w))
    return np.stack([x * 7 % 256, y * 11 % 256, (x + y) * 3 % 256], -1).astype(np.uint8)


def with_exif(data: bytes, *entries: bytes) -> bytes:
    tiff = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(entries) + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]


ORIENTATION_6 = struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
GPS = struct.pack("<HHII", 0x8825, 4, 1, 0)
ISO = struct.pack("<HHIHH", 0x8827, 3, 1, 400, 0)


def pixels(df, columns="rgb"):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, len(columns)))
    for r in rows:
        out[r.y, r.x] = [r[c if c in r.__fields__ else f"{c}8"] for c in columns]
    return out


def test_jpeg_is_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name, v, quality, most in (("smooth", gradient(), 95, 40), ("flat", np.full((16, 8, 3), 77, np.uint8), 80, 2), ("noise", rng.integers(0, 256, (25, 40, 3)).astype(np.uint8), 100, 8)):
        path = tmp_path / f"{name}.jpg"
        path.write_bytes(jpeg(v, quality))
        back = pixels(images.read_pixels(spark, str(path)))
        assert back.shape == v.shape and np.abs(back - v).max() <= most and np.abs(back - v).mean() < 4
    lengths = code_lengths(np.array([1 << k for k in range(40)] + [0] * 216))
    assert lengths.max() <= 16 and sum(2.0 ** -int(n) for n in lengths[lengths > 0]) <= 1


def test_headers_tell_orientation_place_and_profile(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(with_exif(jpeg(gradient()), ORIENTATION_6, ISO, GPS))
    (tmp_path / "b.png").write_bytes(images.png(gradient()))
    (tmp_path / "c.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\x0a\0\0\0" + bytes([0x30, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))
    (tmp_path / "d.bin").write_bytes(b"nothing")
    (tmp_path / "e.jpg").write_bytes(with_exif(jpeg(gradient()), ORIENTATION_6)[:60])
    rows = {r.path[-5:]: r for r in images.inspect(spark, str(tmp_path)).collect()}
    a = rows["a.jpg"]
    assert (a.width, a.height, a.oriented_width, a.oriented_height, a.orientation) == (34, 21, 21, 34, 6)
    assert a.has_gps and not a.has_icc_profile and a.exif == {"iso": "400", "orientation": "6"}
    assert rows["b.png"].error is None and not rows["b.png"].has_gps and not rows["b.png"].has_alpha
    assert (rows[".webp"].mime, rows[".webp"].width, rows[".webp"].height, rows[".webp"].has_alpha, rows[".webp"].has_icc_profile) == ("image/webp", 100, 50, True, True)
    assert "no known" in rows["d.bin"].error and rows["e.jpg"].error


def test_scan_turns_and_reads_deep_files(spark, tmp_path):
    v = gradient()
    (tmp_path / "a.jpg").write_bytes(with_exif(jpeg(v, 98), ORIENTATION_6))
    turned = pixels(images.read_pixels(spark, str(tmp_path / "a.jpg")))
    stored = pixels(images.read_pixels(spark, str(tmp_path / "a.jpg"), orient=False))
    assert np.array_equal(turned, np.rot90(stored, -1)) and stored.shape == v.shape
    for k in range(1, 9):
        back = {6: 8, 8: 6}.get(k, k)
        assert np.array_equal(images.oriented(images.oriented(v, k), back), v)
    deep = np.random.default_rng(2).integers(0, 65536, (9, 7, 4)).astype(np.uint16)
    (tmp_path / "b.png").write_bytes(images.png(deep))
    assert np.allclose(pixels(images.read_channels(spark, str(tmp_path / "b.png")), "rgba") * 65535, deep)


def test_deep_files_in_every_line_filter():
    v = np.random.default_rng(3).integers(0, 65536, (5, 6, 3)).astype(np.uint16)
    flat = v.astype(">u2").reshape(5, -1).view(np.uint8).astype(int)
    lines, up = b"", np.zeros(36, int)
    for y in range(5):
        left = np.concatenate([np.zeros(6, int), flat[y, :-6]])
        corner = np.concatenate([np.zeros(6, int), up[:-6]])
        p = left + up - corner
        near = [np.abs(p - c) for c in (left, up, corner)]
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = (np.zeros(36, int), left, up, (left + up) // 2, paeth)[y]
        lines += bytes([y]) + bytes(((flat[y] - guess) % 256).tolist())
        up = flat[y]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 16, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(images.png_pixels(data)[..., :3], v)


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("work")
    files = folder / "in"
    files.mkdir()
    (files / "a.png").write_bytes(images.png(gradient()))
    (files / "b.jpg").write_bytes(with_exif(jpeg(gradient()), ORIENTATION_6))
    (files / "look.txt").write_text(LUT)
    (files / "logo.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg" width="6" height="4"><rect width="6" height="4" fill="#ff0000"/></svg>')
    w = Workspace(spark, str(folder / "space"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in w.import_files(str(files)).collect()}
    return w, rows, files


def test_import_describes_every_kind(work):
    w, rows, files = work
    assert {n: (r.mime_type, r.width, r.height) for n, r in rows.items()} == {
        "a.png": ("image/png", 34, 21), "b.jpg": ("image/jpeg", 21, 34), "look.txt": ("application/x-cube-lut", 0, 0), "logo.svg": ("image/svg+xml", 6, 4),
    }
    assert w.read(rows["a.png"].revision_id) == (files / "a.png").read_bytes()
    again = w.import_files(str(files / "a.png")).first()
    assert again.revision_id == rows["a.png"].revision_id and w.ledger.rows().filter("source_revision_id is null").count() == 4
    with pytest.raises(StoreError):
        w.read("rev_none")


def test_a_transform_is_made_once(work):
    w, rows, _ = work
    source = rows["a.png"].revision_id
    recipe = {"operations": [{"op": "rotate", "angle_degrees": 5.0}, {"op": "lut", "lut_revision_id": rows["look.txt"].revision_id}, {"op": "svg_overlay", "svg_revision_id": rows["logo.svg"].revision_id, "x": 1, "y": 2}]}
    first = w.apply_transform(source, recipe)
    n = w.ledger.rows().count()
    again = w.apply_transform(source, json.dumps(recipe))
    assert not first["reused"] and again["reused"] and again["revision_id"] == first["revision_id"] and w.ledger.rows().count() == n
    assert any("per cent" in x for x in first["warnings"])
    made = w.row(first["revision_id"])
    out = pixels(w.frame(first["revision_id"]).df)
    assert out.shape == (made.height, made.width, 3) and np.allclose(out[3, 3], [1, 0, 0])
    gray = w.apply_transform(rows["b.jpg"].revision_id, "grayscale")
    row = w.row(gray["revision_id"])
    assert (row.mime_type, row.width, row.height) == ("image/jpeg", 21, 34)
    assert [r.depth for r in w.ledger.lineage(first["revision_id"]).orderBy("depth").collect()] == [0, 1]
    large = w.apply_transform(source, {"operations": [{"op": "svg_overlay", "svg_revision_id": rows["logo.svg"].revision_id, "x": 0, "y": 0, "width": 12, "height": 8}]})
    assert np.allclose(pixels(w.frame(large["revision_id"]).df)[:8, :12], [1, 0, 0])
    # a mask is read as it is stored: b.jpg is 34 x 21 before it is turned
    masked = w.apply_transform(source, {"operations": [{"op": "adjust", "brightness": 0.5, "mask": {"revision_id": rows["b.jpg"].revision_id}}]})
    assert w.row(masked["revision_id"]).width == 34
    with pytest.raises(ToolError) as e:
        w.apply_transform(rows["look.txt"].revision_id, "grayscale")
    assert e.value.code == "not_an_image"


def test_colour_profiles_stay_in_jpeg_files(work, tmp_path):
    w, rows, _ = work
    profile = bytes(range(256)) * 300
    (tmp_path / "p.jpg").write_bytes(with_exif(jpeg(gradient(), 90, profile), ISO))
    source = w.import_files(str(tmp_path / "p.jpg")).first().revision_id
    assert w.inspect(source)["has_icc_profile"] and images.icc_profile(w.read(source)) == profile
    kept = w.apply_transform(source, "sepia")
    assert images.icc_profile(w.read(kept["revision_id"])) == profile and any("EXIF" in x for x in kept["warnings"])
    bare = w.apply_transform(source, {"operations": [{"op": "strip_metadata", "scope": "all"}]})
    assert images.icc_profile(w.read(bare["revision_id"])) == b""
    flat = w.apply_transform(source, {"operations": [{"op": "encode", "format": "png"}]})
    assert any("profile" in x for x in flat["warnings"])


def test_previews_comparisons_and_masks(work):
    w, rows, _ = work
    a = rows["a.png"].revision_id
    mask = w.generate_mask("linear_gradient", a, angle_degrees=90)
    assert 0.4 < mask["mean_weight"] < 0.6 and w.generate_mask("linear_gradient", a, angle_degrees=90)["revision_id"] == mask["revision_id"]
    shown = w.render_preview(a, "sepia", "mask", mask["revision_id"])
    with open(shown["path"], "rb") as f:
        head = images.header(f.read())
    assert (head["mime"], head["width"], head["height"]) == ("image/jpeg", 34, 21) and w.render_preview(a, "sepia", "mask", mask["revision_id"])["path"] == shown["path"]
    for bad in (("dots", None), ("mask", None), ("grid", mask["revision_id"])):
        with pytest.raises(ToolError):
            w.render_preview(a, "sepia", *bad)
    turned = w.apply_transform(a, {"operations": [{"op": "flip", "direction": "horizontal"}]})["revision_id"]
    assert (w.compare_revisions(a, turned).width, w.compare_revisions(a, turned, "stacked").height) == (34 * 2 + 8, 21 * 2 + 8)
    assert w.compare_revisions(a, turned, "diff").df.count() == 34 * 21
    assert w.inspect(a)["mime"] == "image/png" and w.list_assets().count() >= 6
    found = w.detect_tilt(a)
    assert set(found) >= {"tilt", "confidence", "recommended", "method", "warnings"}


def test_export_leaves_the_workspace(work, tmp_path):
    w, rows, files = work
    out = w.export(rows["a.png"].revision_id, str(tmp_path / "out.png"))
    with open(out, "rb") as f:
        assert f.read() == (files / "a.png").read_bytes()
    with pytest.raises(StoreError):
        w.export(rows["a.png"].revision_id, str(tmp_path / "out.png"))
    assert w.export(rows["a.png"].revision_id, str(tmp_path / "out.png"), overwrite=True) == out


def test_ledger_lines(spark, tmp_path):
    row = {"asset_id": "ast_1", "revision_id": "rev_1", "width": 1, "height": 2, "mime_type": "image/png", "byte_size": 3, "sha256": "ab", "rel_path": "x", "created_at": "2024-01-02T03:04:05Z", "recipe": {"b": 1, "a": []}}
    (tmp_path / "ledger.jsonl").write_text(json.dumps(row) + "\n\n  \n" + json.dumps(row | {"revision_id": "rev_2"}) + "\n")
    got = scan_jsonl(spark, str(tmp_path / "ledger.jsonl")).orderBy("ledger_seq").collect()
    assert [(r.revision_id, r.ledger_seq, r.recipe) for r in got] == [("rev_1", 0, '{"a":[],"b":1}'), ("rev_2", 3, '{"a":[],"b":1}')]
    (tmp_path / "bad.jsonl").write_text(json.dumps(row) + "\n{")
    with pytest.raises(Exception, match="line 2"):
        scan_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
