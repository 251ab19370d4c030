"""The driver's contract, and each registered query against its SQL at the smallest scale."""

import math

import pytest

import __spark_entry__ as entry
from pawprint.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted(names), sorted(str([clean(r[i]) for i in order]) for r in found)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    sql = con.execute(ORACLES[name])
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), [d[0] for d in sql.description])
