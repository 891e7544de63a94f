"""Every catalogue query against its SQL in DuckDB."""

import math
from datetime import datetime

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_pushdown(spark, sf_dir):
    """Filters and columns reach the scan."""
    plan = QUERIES["filter_map"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), Not(EqualTo(event_type,view))" in plan
    assert "props" not in plan
