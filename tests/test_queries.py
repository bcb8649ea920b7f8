"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cadence.session import TABLES

SF = "/root/testdata/sf0.001"
OWN = {name for family in entry._FAMILIES for name in family.QUERIES}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return plain(float(v)) if hasattr(v, "as_integer_ratio") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows is not None
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_order_of_rows_does_not_matter(spark, tmp_path):
    """Shuffled input, same output."""
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SF}/events.parquet").orderBy(F.rand(5)).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("interval_merge", "keep_parts", "metrics_group_summary", "greedy_spacing"):
        a, b = (sorted(map(str, entry.queries()[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert a == b, name
