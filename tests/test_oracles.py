"""Every query of the library against its SQL on DuckDB."""

import duckdb
import pandas as pd
import pytest

from volmesh import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 5)
        return str(v)[:10] if hasattr(v, "year") else v

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equal(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for g, w in zip(canonical(got), canonical(want)):
        assert all(a == b or (isinstance(a, float) and abs(float(a) - float(b)) <= 1e-9 * max(1, abs(a))) or (a is not None and b is not None and isinstance(b, (int, float)) and float(a) == float(b)) for a, b in zip(g, w)), (g, w)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
