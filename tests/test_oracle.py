"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from spindle.plans import archive, atlas, bridges, catalogue, cohorts, etl, expression, graph_files, harvests, indexed, introspection, modes, patterns, record_graphs, registry, resolution, study_graphs  # noqa: F401

QUERIES, SQL = registry.queries(), registry.oracle_sql()


#: The smallest tables, and ten times as many rows: some cases only occur there.
DIRS = os.environ.get("TEST_SF_DIRS", "/root/testdata/sf0.001,/root/testdata/sf0.01").split(",")


@pytest.fixture(scope="module", params=DIRS, ids=os.path.basename)
def sf_dir(request):
    return request.param


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    rows = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall()) == rows
