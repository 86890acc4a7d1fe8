"""Reading images opens each file for its header once."""

import numpy as np

from pixelframe.sources import images


def test_headers_are_read_once(spark, tmp_path, monkeypatch):
    v = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(images.png(v if k else v.astype(np.uint16) * 257))
    calls, inspect = [], images.inspect
    monkeypatch.setattr(images, "inspect", lambda *a: calls.append(a) or inspect(*a))
    pixels, files = images.read_images(spark, str(tmp_path))
    rows = pixels.collect()
    assert len(calls) == 1 and len(rows) == 3 * 35 and files.count() == 3
    assert all(np.allclose([r.r, r.g, r.b, r.a], v[r.y, r.x] / 255.0) for r in rows)
