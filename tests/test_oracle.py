"""Every registered query of the workload model against its DuckDB SQL on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from chronofold import catalog_state

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(SF_DIR)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(catalog_state.QUERIES) == set(catalog_state.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog_state.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    frame = catalog_state.QUERIES[name](spark, SF_DIR)
    result = duck.execute(catalog_state.ORACLE_SQL[name])
    expected = sorted_rows([c[0] for c in result.description], result.fetchall())
    assert sorted_rows(frame.columns, [tuple(r) for r in frame.collect()]) == expected
