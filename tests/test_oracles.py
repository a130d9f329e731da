"""Each query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from groundwell.queries import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    cols = sorted(found.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in found.collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert mine == sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    from tests import test_rules_and_conflicts, test_stores_and_streams, test_values

    # a query without SQL has a test of its values
    named = lambda m: {n.removeprefix("test_") for n in dir(m) if n.startswith("test_")} & set(QUERIES)
    without = set(QUERIES) - set(ORACLE_SQL)
    assert without <= named(test_values) | named(test_stores_and_streams) | named(test_rules_and_conflicts)
    assert named(test_values) <= without

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "id", "score", "rank"]
