"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from silvaspan.plans import registry

SF = "/root/testdata/sf0.001"


def rows(names, got):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5f}".rstrip("0").rstrip(".")
        return str(v)

    order = sorted(names)
    return sorted(tuple(cell(r[names.index(n)]) for n in order) for r in got)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if sql := registry.oracle_sql().get(name):
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        want = rel.fetchall()
        assert rows(df.columns, got) == rows(rel.columns, want)


def test_every_tier_is_counted(spark):
    got = registry.queries()["tier_counts_by_box"](spark, SF).collect()
    levels = {}
    for r in got:
        levels.setdefault(r["request_id"], {})[r["level"]] = r["n"]
    assert all(set(n) == {-1, 0, 1, 2} and n[-1] >= n[2] for n in levels.values()) and any(n[2] for n in levels.values())
