"""The store's queries run the ledger's own memo and hash each row's recipe."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("store_memo_hits", "conversations"), ("store_recipe_hash", "documents")])
def test_query_does_the_operators_job(spark, monkeypatch, name, table):
    from pixelframe import queries
    from pixelframe.sources import store

    plan = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert sorted(map(tuple, plan.select(*sorted(plan.columns)).collect())) == sorted(con.execute(f"select {', '.join(sorted(plan.columns))} from ({queries.ORACLES[name]})").fetchall())
    fault = lambda *a: (_ for _ in ()).throw(ZeroDivisionError())
    monkeypatch.setattr(*((store, "memo", fault) if name == "store_memo_hits" else (queries, "hash_column", fault)))
    with pytest.raises(ZeroDivisionError):
        queries.QUERIES[name](spark, SF)
