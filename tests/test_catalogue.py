"""Every query of the catalogue gives the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from lattika.plans import catalogue, catalogue_checks, catalogue_drafts, catalogue_recognition, catalogue_rules  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_rows_are_those_of_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    want = tables.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    rows = lambda got, at: sorted(([plain(r[at(c)]) for c in order] for r in got), key=repr)
    assert rows(found.collect(), lambda c: c) == rows(want.fetchall(), names.index)
