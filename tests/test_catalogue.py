"""Every registered query of the document engine against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from inkstrata.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(plain(list(r))) for r in df.select(*cols).collect())
    assert name in ORACLE_SQL, "a query of the engine needs its SQL"
    assert got, "an empty result shows nothing"
    res = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(str(plain([r[i] for i in order])) for r in res.fetchall())
