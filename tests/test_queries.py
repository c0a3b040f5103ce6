"""Every reference query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from quirekit.plans import catalog


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value, ".9g")
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(_plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    assert sorted(tuple(map(_plain, r)) for r in got.select(*columns).collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_distinct_columns_and_rows(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
