"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import pytest

from sparkloom import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the supplied tables are absent")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.oracle_sql():
        cursor = duck.execute(registry.oracle_sql()[name])
        at = [d[0] for d in cursor.description]
        assert sorted(at) == columns
        assert got == sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall())
