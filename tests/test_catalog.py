import os

import duckdb
import pytest

from rillgrid.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cell(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL)
    done = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in done.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(cell(v) for v in row) for row in done.fetchall())
    assert sorted(tuple(cell(v) for v in r.values()) for r in got.select(*names).toArrow().to_pylist()) == want


def test_pairs_of_a_group_are_joined_by_hash_or_merge(spark):
    plan = catalog.queries()["pair_list"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["station_filter_sort"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(s_acctbal,4620.0)" in plan and "s_name" in plan
