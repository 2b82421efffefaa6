"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from arborlog.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def shown(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert shown(tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()) == shown(want)
