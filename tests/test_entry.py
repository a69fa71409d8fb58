import duckdb
import pytest

import __spark_entry__ as entry
from rankloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).columns == ["key", "score", "rank"]


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, con, name):
    mine = entry.queries()[name](spark, DATA)
    theirs = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in mine.select(*names).collect()))) == sorted(map(repr, theirs.fetchall()))
