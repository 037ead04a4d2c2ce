import duckdb
import pytest

from shutterlake.plans import catalog, media, report  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    assert sorted(map(repr, got[cols].astype(str).values.tolist())) == sorted(map(repr, want[cols].astype(str).values.tolist()))
