"""Every core query against its SQL on the smallest tables, compared as multisets of rows."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from corpusloom.plans import oracle, registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(oracle.SQL[name])
    names = list(r.columns)
    assert sorted(names) == cols
    want = Counter(tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall())
    assert got == want and (got or name == "prune_orphans")


def test_every_query_is_checked():
    assert set(registry.QUERIES) - set(oracle.SQL) == {"bpe_train_merges", "bpe_encode", "chat_sessions"}
