"""Many transforms at once."""

import os

import numpy as np
import pytest

from pixelframe.sources import images
from pixelframe.tools import ToolError, Workspace


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("batch")
    (folder / "in").mkdir()
    for k in range(50):
        v = np.random.default_rng(k).integers(0, 256, (6 + k % 3, 9 - k % 2, 3)).astype(np.uint8)
        (folder / "in" / f"{k:02}.png").write_bytes(images.png(v))
    (folder / "in" / "look.cube").write_text("LUT_1D_SIZE 2\n0 0 0\n1 1 1\n")
    w = Workspace(spark, str(folder / "space"))
    rows = {os.path.basename(r.path): r.revision_id for r in w.import_files(str(folder / "in")).collect()}
    return w, rows


ASK = "source_revision_id string, recipe string"
RECIPES = ['{"operations": [{"op": "vignette", "strength": 0.%d}]}' % k for k in (2, 4)] + ["sepia", '{"operations":[{"op":"crop","aspect_ratio":"1:1"}]}']


def _objects(w) -> int:
    return sum(len(f) for _, _, f in os.walk(os.path.join(w.folder, "objects")))


def test_two_hundred_requests_of_which_half_are_known(spark, work, monkeypatch):
    w, rows = work
    sources = [r for n, r in sorted(rows.items()) if n.endswith(".png")]
    first = w.apply_transforms(spark.createDataFrame([(s, r) for s in sources for r in RECIPES[:2]], ASK)).collect()
    assert len(first) == 100 and not any(r.reused or r.error for r in first)
    ledger, objects = w.ledger.rows().count(), _objects(w)
    # nothing reads a file on the driver
    monkeypatch.setattr(Workspace, "read", None)
    asked = spark.createDataFrame([(s, r) for s in sources for r in RECIPES] + [(s, RECIPES[3]) for s in sources[:20]], ASK)
    second = w.apply_transforms(asked).collect()
    assert len(second) == 220 and sum(r.reused for r in second) == 100 and not any(r.error for r in second)
    assert w.ledger.rows().count() == ledger + 100 and _objects(w) == objects + 100
    assert {(r.source_revision_id, r.recipe): r.revision_id for r in first}.items() <= {(r.source_revision_id, r.recipe): r.revision_id for r in second}.items()
    third = w.apply_transforms(asked).collect()
    assert all(r.reused for r in third) and w.ledger.rows().count() == ledger + 100 and _objects(w) == objects + 100
    assert {tuple(r)[:4] for r in third} == {tuple(r)[:4] for r in second}
    made = {r.revision_id: r for r in w.ledger.rows().filter("source_revision_id is not null").collect()}
    sizes = {r.revision_id: (r.width, r.height) for r in w.ledger.rows().collect()}
    for r in second:
        if r.recipe == RECIPES[3]:
            side = min(sizes[r.source_revision_id])
            assert (made[r.revision_id].width, made[r.revision_id].height) == (side, side)
    w.cleanup()
    assert not any(n.startswith("staging-") for n in os.listdir(w.folder))


def test_what_cannot_be_met_is_told_and_keeps_nothing_back(spark, work):
    w, rows = work
    a, lut = rows["00.png"], rows["look.cube"]
    ask = [(a, "grayscale"), (None, "grayscale"), (a, None), ("rev_none", "grayscale"), (lut, "grayscale"), (a, '{"operations": [{"op": "blurr"}]}'), (a, '{"operations": [{"op": "encode", "format": "webp"}]}'), (a, '{"operations": [{"op": "crop", "rect": {"x": 0, "y": 0, "width": 99, "height": 2}}]}')]
    out = {(r.source_revision_id, r.recipe): r for r in w.apply_transforms(spark.createDataFrame(ask, ASK)).collect()}
    assert len(out) == len(ask) and out[ask[0]].error is None and out[ask[0]].revision_id
    for request, words in zip(ask[1:], ("unknown revision null", "operations", "unknown revision rev_none", "not an image", "blurr", "encode_failed", "outside"), strict=True):
        assert out[request].revision_id is None and words in out[request].error, request
    assert w.apply_transforms(spark.createDataFrame([], ASK)).count() == 0
    with pytest.raises(ToolError) as e:
        w.apply_transform(a, '{"operations": [{"op": "encode", "format": "webp"}]}')
    assert e.value.code == "encode_failed"


def test_masks_and_layers_of_a_batch(spark, work):
    w, rows = work
    a, b, c = rows["00.png"], rows["01.png"], rows["06.png"]
    mask = w.generate_mask("linear_gradient", a, angle_degrees=90)["revision_id"]
    recipe = '{"operations": [{"op": "adjust", "brightness": 0.5, "mask": {"revision_id": "%s"}}]}' % mask
    out = w.apply_transforms(spark.createDataFrame([(x, recipe) for x in (a, b, c)], ASK)).collect()
    assert not any(r.error for r in out)
    alone = Workspace(spark, w.folder + "-alone")
    for r in out:
        row = w.row(r.revision_id)
        assert (row.width, row.height) == (w.row(r.source_revision_id).width, w.row(r.source_revision_id).height)
    assert alone.ledger.rows().count() == 0


def test_masks_previews_and_comparisons_of_many_revisions(spark, work):
    w, rows = work
    ids = [rows[f"{k:02}.png"] for k in range(7)]
    asked = spark.createDataFrame([(i,) for i in [*ids, ids[0], "rev_none", rows["look.cube"], None]], "revision_id string")
    first = w.generate_masks("radial_gradient", asked, radius=0.4).collect()
    assert len(first) == 11 and sum(r.mask_revision_id is None for r in first) == 3
    alone = w.generate_mask("radial_gradient", ids[2], radius=0.4)
    (one,) = [r for r in first if r.revision_id == ids[2]]
    assert alone["reused"] and one.mask_revision_id == alone["revision_id"] and abs(one.mean_weight - alone["mean_weight"]) < 1e-9
    n = w.ledger.rows().count()
    again = w.generate_masks("radial_gradient", asked, radius=0.4).collect()
    assert w.ledger.rows().count() == n and {r.mask_revision_id for r in again} == {r.mask_revision_id for r in first}
    assert all(r.reused for r in again if r.mask_revision_id)

    shown = {r.revision_id: r for r in w.render_previews(asked.distinct(), "sepia", "thirds").collect()}
    single = w.render_preview(ids[3], "sepia", "thirds")
    assert os.path.join(w.folder, shown[ids[3]].rel_path) == single["path"] and (shown[ids[3]].width, shown[ids[3]].height) == (single["width"], single["height"])
    assert shown["rev_none"].rel_path is None and len({r.rel_path for r in shown.values() if r.rel_path}) == 7
    assert all(os.path.exists(os.path.join(w.folder, r.rel_path)) for r in shown.values() if r.rel_path)
    with pytest.raises(ToolError):
        w.render_previews(asked, "sepia", "mask")

    from pixelframe.operators import compare

    pairs = [(ids[0], ids[6]), (ids[0], ids[0]), (ids[0], ids[1]), (ids[1], "rev_none"), (ids[0], ids[6])]
    got = w.compare_pairs(spark.createDataFrame(pairs, "a string, b string")).collect()
    stats = {(r.a, r.b): r for r in got}
    assert len(got) == 5 and stats[pairs[1]].max_diff == 0 and stats[pairs[2]].mean_diff is None and stats[pairs[3]].mean_diff is None
    want = compare.diff_stats(w.frame(ids[0]), w.frame(ids[6])).first()
    assert abs(stats[pairs[0]].mean_diff - want.mean_diff) < 1e-9 and stats[pairs[0]].max_diff == want.max_diff
    assert w.compare_pairs(spark.createDataFrame([("x", "y")], "a string, b string")).first().mean_diff is None
