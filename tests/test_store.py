import pytest

from pixelframe.sources.store import Ledger, StoreError, object_path, preview_key, safe_name


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "work"))


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c), "image/png", 4, 3) for p, c in rows], "path string, content binary, mime_type string, width int, height int")


def test_import_is_idempotent(spark, ledger):
    first = ledger.import_assets(files(spark, [("a", b"1"), ("b", b"2"), ("c", b"1")])).collect()
    assert len(first) == 3 and len({r.revision_id for r in first}) == 2
    again = ledger.import_assets(files(spark, [("d", b"2")])).collect()
    assert ledger.rows().count() == 2 and again[0].revision_id in {r.revision_id for r in first}


def test_derivations_are_remembered(spark, ledger):
    source = ledger.import_assets(files(spark, [("a", b"1")])).first().revision_id
    one = ledger.record(source, "{}", "h", b"x", "image/png", 2, 2)
    assert ledger.record(source, "{}", "h", b"x", "image/png", 2, 2) == one
    two = ledger.record(one, "{}", "h2", b"y", "image/png", 2, 2)
    assert [(r.revision_id, r.depth) for r in ledger.lineage(two).orderBy("depth").collect()] == [(two, 0), (one, 1), (source, 2)]
    assert len({r.asset_id for r in ledger.revisions().collect()}) == 1
    with pytest.raises(StoreError):
        ledger.record("rev_none", "{}", "h", b"x", "image/png", 2, 2)


def test_names():
    assert object_path("ab" * 32, "image/png") == f"objects/ab/{'ab' * 32}.png"
    assert len(preview_key("rev_a", "h")) == 32
    for bad in ("", "a/b", "..", "a b"):
        with pytest.raises(StoreError):
            safe_name(bad)


def test_stream_drops_repeated_content(spark, tmp_path):
    from pixelframe.streaming.ingest import incoming

    for name, data in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / name).write_bytes(data)
    query = incoming(spark, str(tmp_path)).writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("arrivals").count() == 2


def test_files_are_written_once(spark, tmp_path):
    from pixelframe.sources.sinks import export_file, preview_path, write_objects

    work = tmp_path / "work"
    rows = [("objects/ab/x.png", bytearray(b"1")), ("objects/ab/x.png", bytearray(b"1")), (preview_path("k", "png"), bytearray(b"2"))]
    write_objects(spark.createDataFrame(rows, "rel_path string, content binary"), str(work))
    write_objects(spark.createDataFrame([("objects/ab/x.png", bytearray(b"3"))], "rel_path string, content binary"), str(work))
    assert (work / "objects/ab/x.png").read_bytes() == b"1" and len(list((work / "objects/ab").iterdir())) == 1
    out = tmp_path / "out.png"
    export_file(str(work / "objects/ab/x.png"), str(out), str(work))
    for target in (str(out), str(work / "y"), str(tmp_path), str(tmp_path / "none/y")):
        with pytest.raises(StoreError):
            export_file(str(out), target, str(work))
