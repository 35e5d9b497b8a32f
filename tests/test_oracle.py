"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from inkveil import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "customer part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    want = duck.execute(oracle.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert shown([tuple(r) for r in got.collect()], got.columns) == shown(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(oracle.ORACLE)))
def test_runs_without_sql(spark, name):
    assert queries.queries()[name](spark, DATA).columns
