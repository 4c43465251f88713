"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from emberline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(columns: list[str], rows: list) -> list:
    """Rows with their cells as text, columns by name."""

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert sorted(got.columns) == sorted(want.columns)
    assert all(kinds[f.name] == KINDS[f.dataType.simpleString()] for f in got.schema if f.dataType.simpleString() in KINDS)
    assert plain(got.columns, rows) == plain(want.columns, want.fetchall())
