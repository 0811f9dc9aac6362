"""Every query with SQL gives the rows that SQL gives on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tallyspark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def shown(v):
    if v is None:
        return ""
    return f"{v:.9f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def reference():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, reference, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = Counter(tuple(shown(r[c]) for c in names) for r in df.collect())
    relation = reference.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == names
    places = [relation.columns.index(c) for c in names]
    assert ours == Counter(tuple(shown(r[i]) for i in places) for r in relation.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
