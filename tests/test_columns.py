"""Recipes in a column, numbered lines of files with many splits, and lineage of whole ledgers."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from test_recipe import FULL, HEAL

from pixelframe.plans.presets import PRESETS
from pixelframe.plans.recipe import OMITTED, OPS, REQUIRED, RecipeError, _written, canonical, parse, recipe_hash, validate
from pixelframe.plans.recipe_columns import canonical_column, float_text, hash_column, out_of_range
from pixelframe.sources.lines import numbered_lines
from pixelframe.sources.store import StoreError, lineages, scan_jsonl

RNG = random.Random(11)
VALUES = {
    "float": lambda: RNG.choice([0, 1, -2, 0.5, -0.25, 1e-6, 3.5e-5, 0.00002, 1e-9, 0.7000000001, 123.456789, 99999.5, 1e3]), "int": lambda: RNG.choice([0, 7, -3, 255, 2**40, 2**64 - 1]),
    "str": lambda: RNG.choice(["a", "", 'q"\\/\n\té😀', "16:9"]), "enum": lambda: RNG.choice(["current", "source", "cover", "x"]), "bool": lambda: RNG.choice([True, False]),
    "floats": lambda: [VALUES["float"]() for _ in range(RNG.randint(0, 5))], "quad": lambda: [[VALUES["float"](), VALUES["float"]()] for _ in range(4)],
    "points": lambda: [[RNG.randint(0, 255), RNG.randint(0, 255)] for _ in range(RNG.randint(0, 4))], "stops": lambda: [{"color": "#fff", "position": VALUES["float"]()} for _ in range(3)],
    "rect": lambda: {k: RNG.randint(0, 99) for k in ("width", "x", "height", "y")}, "mask": lambda: RNG.choice([{"revision_id": "rev_1"}, {"feather_px": 2, "invert": True, "revision_id": "rev_2"}]),
    "band": lambda: RNG.choice([{}, {"hue": 3}, {"luminance": -0.5, "saturation": 20, "hue": 1}]),
}


def _operation(name: str) -> dict:
    out = {k: VALUES[kind]() for k, (kind, default, *_) in OPS[name].items() if default is REQUIRED or RNG.random() < (0.5 if default is OMITTED else 0.6)}
    keys = [*out, "op"]
    RNG.shuffle(keys)
    return {k: name if k == "op" else out[k] for k in keys}


def _recipes() -> list[str]:
    good = [json.dumps({"operations": [_operation(n) for n in RNG.sample(list(OPS), 3)]}, ensure_ascii=RNG.random() < 0.5) for _ in range(120)]
    good += [json.dumps({"operations": [_operation(n)]}) for n in OPS]
    good += [json.dumps({"operations": list(ops)}) for ops in PRESETS.values()] + [FULL, HEAL, '{"operations": []}', '{"operations": [], "layers": []}', '{"operations": [], "layers": null}']
    layer = {"source": "base", "ops": [_operation("curves")], "mask": {"revision_id": "rev_x"}}
    good.append(json.dumps({"layers": [layer, {"source": {"revision_id": "rev_9"}, "opacity": 0.25, "blend_mode": "hue"}], "operations": [_operation("blur")]}))
    bad = ["", "no", "[]", "{}", "null", '{"operations": {}}', '{"operations": [], "more": 1}', '{"operations": [3]}', '{"operations": [{"op": "blurr"}]}', '{"operations": [{"op": "a mask", "revision_id": "rev_1"}]}', '{"operations": [{"op": "blur"}]}',
           '{"operations": [{"op": "blur", "sigma": "1"}]}', '{"operations": [{"op": "blur", "sigma": true}]}', '{"operations": [{"op": "blur", "sigma": 1, "x": 2}]}', '{"operations": [{"op": "blur", "sigma": null}]}', '{"operations": [{"op": "median", "radius": 2.5}]}',
           '{"operations": [{"op": "curves", "master": [[1, 256]]}]}', '{"operations": [{"op": "curves", "master": [[1]]}]}', '{"operations": [{"op": "crop", "rect": {"x": 1}}]}', '{"operations": [{"op": "perspective", "quad": [[1, 2]]}]}',
           '{"operations": [], "layers": [{"ops": []}]}', '{"operations": [], "layers": [{"source": "other"}]}', '{"operations": [], "layers": [{"source": {"revision_id": 1}}]}']
    return [*good, *bad]


def _wanted(text: str) -> str | None:
    try:
        return canonical(parse(text))
    except (RecipeError, ValueError):
        return None


def test_texts_and_hashes_are_those_of_single_recipes(spark):
    texts = sorted({*_recipes()})
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: (r.c, r.h) for r in rows.select("t", canonical_column(F.col("t")).alias("c"), hash_column(F.col("t")).alias("h")).collect()}
    for t in texts:
        want = _wanted(t)
        assert got[t] == (want, None if want is None else recipe_hash(t)), t
    assert got[None] == (None, None) and sum(v[0] is not None for v in got.values()) > 150
    plan = rows.select(hash_column(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_are_written_alike(spark):
    values = [0.0, 1e-7, -1e-7, 5e-7, 1e-6, 9.4e-6, 1e-5, 1.05e-5, 9.99e-5, 1e-4, 0.00012, 0.1, 0.30000000000000004, 1.0, 1.5, -2.000001, 10.0, 1234567.891011, 1e9, *(RNG.uniform(-300, 300) for _ in range(500)), *(10 ** RNG.uniform(-7, 5) for _ in range(500))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", float_text(F.col("v")).alias("t")).collect()
    for r in rows:
        want = _written(r.v)
        assert r.t == (want.removeprefix("-") if float(want) == 0 else want), r.v
    assert spark.range(1).select(float_text(F.lit(math.inf))).first()[0] is None


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    texts = {"a.txt": "\n".join(f"line {i} " + "x" * (i * 37 % 91) for i in range(700)), "b.txt": "\n\nonly\n\n", "c.txt": "y" * 9000 + "\nlast", "d.txt": "", "e.txt": "é\r\nf"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, newline="")
    df = numbered_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.number] = r.line
    for n, t in texts.items():
        lines = t.split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got.get(n, {}) == dict(enumerate(lines, 1)), n
    assert numbered_lines(spark, str(tmp_path / "d.txt")).count() == 0


def test_a_long_ledger_is_read_by_many_tasks_and_tells_bad_lines(spark, tmp_path, small_splits):
    row = {"asset_id": "ast_1", "width": 1, "height": 2, "mime_type": "image/png", "byte_size": 3, "sha256": "ab", "rel_path": "x", "created_at": "2024-01-02T03:04:05Z"}
    lines = [json.dumps(row | {"revision_id": f"rev_{i}"}) if i % 7 else "  " for i in range(400)]
    (tmp_path / "ledger.jsonl").write_text("\n".join(lines) + "\n")
    df = scan_jsonl(spark, str(tmp_path / "ledger.jsonl"))
    assert df.rdd.getNumPartitions() > 10
    assert {(r.revision_id, r.ledger_seq) for r in df.collect()} == {(f"rev_{i}", i) for i in range(400) if i % 7}
    lines[333] = "{"
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    with pytest.raises(Exception, match="line 334"):
        scan_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def _lineages(spark, edges):
    return {r.revision_id: (r.root, r.depth) for r in lineages(spark.createDataFrame(edges, "revision_id string, source_revision_id string")).collect()}


def test_lineage_of_all_revisions(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(100)]
    fan = [(f"f{i}", "hub") for i in range(50)] + [("hub", "top"), ("g", "f3")]
    odd = [("lost", "nowhere"), ("lost2", "lost"), (None, "c1"), ("c5", "c4"), ("alone", None)]
    want = {f"c{i}": ("c0", i) for i in range(100)} | {f"f{i}": ("top", 2) for i in range(50)} | {"hub": ("top", 1), "g": ("top", 3), "lost": ("nowhere", 1), "lost2": ("nowhere", 2), "alone": ("alone", 0)}
    edges = chain + fan + odd
    RNG.shuffle(edges)
    assert _lineages(spark, edges) == want
    assert _lineages(spark, []) == {}
    for loop in ([("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]):
        with pytest.raises(StoreError, match="back to themselves"):
            _lineages(spark, loop)


def test_tables_are_read_by_many_tasks(spark, tmp_path, small_splits):
    import numpy as np

    from pixelframe.sources.cube import CubeError, parse_cube, read_cube

    n = 9
    rows = [f"{RNG.uniform(-1, 2):.7f} {RNG.uniform(0, 1)!r}\t{RNG.choice(['0', '1.', '.5', '1e-3', '-2E0'])}" for _ in range(n**3)]
    rows.insert(50, "# a comment 1 2 3")
    rows.insert(90, "   ")
    rows.insert(300, "0.1 0.2 0.3 # after" if len(rows) > 300 else "")
    rows.pop(10)
    texts = {"good": f'\ufeffTITLE "a b c"\r\nlut_3d_size {n}\nDOMAIN_MIN 0 0 -1\n' + "\n".join(rows) + "\n", "small": "LUT_1D_SIZE 2\n0 0 0\n1 1 1"}
    for name, text in texts.items():
        (tmp_path / f"{name}.cube").write_text(text, newline="")
        got, want = read_cube(spark, str(tmp_path / f"{name}.cube")), parse_cube(text)
        assert np.array_equal(np.array(got.rows), np.array(want.rows)) and (got.size, got.is_3d, got.domain_min, got.domain_max, got.title) == (want.size, want.is_3d, want.domain_min, want.domain_max, want.title)
    for text in ("", "0 0 0\nLUT_1D_SIZE 2\n1 1 1", "LUT_1D_SIZE 2\n0 0 0\n1 1", "LUT_1D_SIZE 2\n0 0 0\n1 1 17", "LUT_1D_SIZE 2\n0 0 0\nnan 1 1", "LUT_1D_SIZE 2\nLUT_1D_SIZE 2", "LUT_1D_SIZE 1", "LUT_1D_SIZE 3\n0 0 0\n1 1 1", "LUT_1D_SIZE 2\nWHAT 1\n0 0 0", "LUT_1D_SIZE 2\nDOMAIN_MAX 0 0 0\n0 0 0\n1 1 1"):
        (tmp_path / "bad.cube").write_text(text)
        with pytest.raises(CubeError) as a:
            parse_cube(text)
        with pytest.raises(CubeError) as b:
            read_cube(spark, str(tmp_path / "bad.cube"))
        assert str(a.value) == str(b.value)


def test_ranges_are_told_where_validate_tells_them(spark):
    cases = {
        '{"operations": [{"op": "blur", "sigma": 0.09999996}]}': (None, 0, "blur", "sigma"),
        '{"operations": [{"op": "auto_orient"}, {"op": "levels", "in_white": 256}]}': (None, 1, "levels", "in_white"),
        '{"operations": [{"op": "encode", "format": "tiff"}]}': (None, 0, "encode", "format"),
        '{"operations": [{"op": "encode", "format": "png", "bit_depth": 12}]}': (None, 0, "encode", "bit_depth"),
        '{"operations": [], "layers": [{"source": "base"}, {"source": "base", "ops": [{"op": "flip", "direction": "up"}]}]}': (1, 0, "flip", "direction"),
    }
    good = ['{"operations": [{"op": "blur", "sigma": 0.1}, {"op": "vignette", "strength": -1}]}', '{"operations": [{"op": "grain", "amount": 1, "seed": 18446744073709551615}]}']
    odd = [None, "", "[]", "{", '{"operations": 3}', '{"operations": [7, {"op": 4}, {"op": "no"}, {"op": "blur"}, {"op": "blur", "sigma": null}], "layers": [2]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, *good, *odd])], "i int, t string")
    got = {r.t: [tuple(f) for f in r.f] for r in rows.select("t", out_of_range(F.col("t")).alias("f")).collect()}
    assert got == {t: [f] for t, f in cases.items()} | {t: [] for t in (*good, *odd)}
    for t, (layer, index, op, field) in cases.items():
        with pytest.raises(RecipeError, match=field) as e:
            validate(parse(t))
        assert (e.value.details()["layer_index"], e.value.details()["operation_index"], e.value.details()["op"]) == (layer, index, op)
    for t in good:
        validate(parse(t))
