import duckdb
import numpy as np
import pytest

from tidemark.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.sql(registry.ORACLE_SQL[name]).df()
        k = "page_id" if "page_id" in got else "doc_id"
        got, want = (x.sort_values(k).reset_index(drop=True) for x in (got, want))
        for col in want.columns:
            assert np.allclose(got[col], want[col]) if got[col].dtype.kind == "f" else got[col].astype(str).tolist() == want[col].astype(str).tolist(), col
        assert sorted(got.columns) == sorted(want.columns)
