"""Every query of the catalog against DuckDB on the smallest tables."""

import duckdb
import pytest

from pressloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(float(r[i]), 5) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
