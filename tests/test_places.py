"""Places of the pixel relations: every place up to the end of the last image, with keys missing or not, and without a join where none is."""

import pytest
from pyspark.sql import functions as F

from pixelframe import fixtures


def _orders(spark, keys, path):
    rows = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    rows.select("o_orderkey", F.lit(7).cast("long").alias("o_custkey"), F.lit(3.0).alias("o_totalprice")).coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


@pytest.mark.parametrize("keys", [range(3000), [0], range(1024), [k for k in range(70_000) if k not in (5, 40_000)], [5], [2, 0, 2, 4], [None, -3, 1, 0], [], [None], [-1]])
def test_every_place_is_there(spark, tmp_path, keys):
    px = fixtures.orders_px(spark, _orders(spark, keys, tmp_path))
    kept = sorted(k for k in keys if k is not None and k >= 0)
    n = (kept[-1] // 1024 + 1) * 1024 if kept else 0
    want = sorted([(k, k * 37 % 256) for k in kept] + [(k, 0) for k in set(range(n)) - set(kept)])
    assert sorted((r.image_id * 1024 + r.y * 32 + r.x, r.g8) for r in px.collect()) == want


def test_no_join_where_no_key_is_missing(spark, tmp_path):
    plan = fixtures.wide_px(spark, _orders(spark, range(20_000), tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("gap", [False, True])
def test_tiles_are_packed_as_well_from_rows_in_any_order(spark, tmp_path, gap):
    from pixelframe.frame import from_codes
    from pixelframe.operators import kernels

    rows = spark.range(60_000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit(3.0).alias("o_totalprice"))

    def pieces(name, dealt):
        dealt.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        p = from_codes(fixtures.big_px(spark, f"{tmp_path}/{name}"), 1792, 1400)
        return kernels.packed(p.df.withColumns({"size_id": F.lit(0), "part": F.lit(0)}), [(1792, 1400)], 0).count()

    mixed = rows.filter(F.lit(not gap) | (F.col("o_orderkey") != 777)).repartition(24, F.xxhash64("o_orderkey", F.lit(1)))
    assert pieces("mixed", mixed) <= 1.2 * pieces("kept", rows.repartitionByRange(24, "o_orderkey").sortWithinPartitions("o_orderkey"))
