"""A few registered queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
FILES = ["file_decode", "file_decode_plain", "file_decode_16_bits", "file_headers", "file_table_scan", "store_ledger_scan", "store_ledger_append", "store_recipe_faults"]


@pytest.mark.parametrize("name", ["flagship_film", "px_sepia", "px_unsharp", "px_layers_three", "px_resize_lanczos", "tilt_nms", "store_lineage", "preset_product_white", *FILES])
def test_query_matches_its_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in ("orders", "events", "embeddings", "documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    order = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=order)
    assert rows == [pytest.approx(r) if any(isinstance(v, float) for v in r) else r for r in sorted(want.fetchall(), key=order)]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
