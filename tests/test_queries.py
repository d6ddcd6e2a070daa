"""Each query against its oracle on the smallest tables."""

import math

import pytest

from quarry.plans import extras, further, models, relational, text_features  # noqa: F401
from quarry.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    res = duck.execute(ORACLE[name])
    own = [d[0] for d in res.description]
    assert sorted(own) == names
    want = sorted(tuple(plain(r[own.index(n)]) for n in names) for r in res.fetchall())
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
