"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(rows):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(str(clean(v)) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, db, name):
    frame = __spark_entry__.queries()[name](spark, SMALL)
    cols = sorted(frame.columns)
    got = rows_of(frame.select(*cols).collect())
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    same = [tuple(float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in want]
    assert got == rows_of(same)


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "measure_id" and frame.count() > 0
