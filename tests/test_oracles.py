"""Every query with an oracle, at the smallest scale, against DuckDB."""

import duckdb
import pytest
from docloom.plans import registry
from docloom.sources.derived import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def plain(rows, columns):
    """Rows as sorted text: floats to six digits, numbers without their types."""

    def cell(x):
        return f"{x:.6f}" if isinstance(x, float) and x == x else "NULL" if x is None or x != x else str(x)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain([r.asDict() for r in got.collect()], columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
