"""Every registered query of the package against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

from siftwork.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_twin(spark, con, name):
    df = registry.queries()[name](spark, D)
    twin = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert plain(df.collect(), df.columns) == plain(twin.fetchall(), twin.columns)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_a_twin_has_rows(spark, name):
    rows = registry.queries()[name](spark, D).collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
