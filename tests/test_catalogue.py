import os
from decimal import Decimal

import duckdb
import pytest

from prosegauge.plans import catalogue

SF = "/root/testdata/sf0.001"
def plain(v):
    return f"{v:.8g}" if isinstance(v, (float, Decimal)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and got == want


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
