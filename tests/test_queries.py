"""Every query with SQL gives the rows of that SQL in DuckDB."""

import os

import duckdb
import pytest

from tallyforge.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(([None if v is None else v if isinstance(v, int) else round(v, 9) if isinstance(v, float) else str(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(r.fetchall())
