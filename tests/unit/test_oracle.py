"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from protloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(catalog.ORACLE_SQL)


def rows(df) -> list[tuple]:
    show = lambda v: "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    cols = sorted(df.columns)
    return sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))
