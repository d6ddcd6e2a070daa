"""Queries on item ids of a million and more against their oracle."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.plans import models  # noqa: F401
from quarry.plans.registry import ORACLE, QUERIES
from test_queries import plain

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """The smallest tables with a copy of each item a million further, so that (term, item + 1000000) and (term + 1, item) both occur."""
    out = str(tmp_path_factory.mktemp("large"))
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey"), ("customer", None), ("orders", None)):
        df = spark.read.parquet(f"{DIR}/{name}.parquet")
        (df.unionByName(df.withColumn(key, F.col(key) + 1000000)) if key else df).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", ["flip_analysis", "probability_blend"])
def test_oracle_on_large_keys(spark, large, name):
    duck = duckdb.connect()
    for t in ("part", "lineitem", "customer", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, large)
    names = sorted(df.columns)
    res = duck.execute(ORACLE[name])
    own = [d[0] for d in res.description]
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == sorted(tuple(plain(r[own.index(n)]) for n in names) for r in res.fetchall())
