"""Geometry derived from the driver's tables, in whole numbers, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOXES = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 200 AS image, min(l_partkey) % 7 AS cls,
 min(l_partkey) * 37 % 900 AS x1, min(l_suppkey) * 53 % 1200 AS y1,
 min(l_partkey) * 37 % 900 + CAST(min(l_quantity) AS BIGINT) * 3 + 5 AS x2, min(l_suppkey) * 53 % 1200 + l_linenumber * 11 + 4 AS y2,
 CAST(min(l_quantity) AS BIGINT) * 3 + 5 AS w, l_linenumber * 11 + 4 AS h, (l_orderkey * 31 + min(l_partkey) * 17) % 100 AS confidence
 FROM lineitem GROUP BY l_orderkey, l_linenumber"""
SEGMENTS = """SELECT event_id AS id, user_id AS page, event_id * 101 % 1009 AS x1, event_id * 37 % 701 AS y1,
 event_id * 101 % 1009 + event_id % 9 - 4 AS x2, event_id * 37 % 701 + event_id % 83 + 1 AS y2 FROM events"""
PLACES = "SELECT event_id AS id, user_id AS page, event_id * 101 % 2003 AS x FROM events"
LINES = "SELECT DISTINCT user_id % 40 AS page, event_id * 37 % 2503 AS y FROM events"
STAFFS = """SELECT page, s * 60 + CASE WHEN s % 12 >= 8 THEN 500 WHEN s % 12 >= 4 THEN 200 ELSE 0 END + i * 8 AS y
 FROM (SELECT DISTINCT user_id % 40 AS page, event_id % 12 AS s FROM events) a CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) b"""
BARLINES = """SELECT DISTINCT user_id % 40 AS page, CAST(event_id % 12 AS INT) AS system_idx, event_id % 7 * 150 + 100 + event_id % 3 AS x FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an adapter's SQL; its tables are read by name."""
    names = [t for t in ("lineitem", "events", "orders", "part", "documents", "labels", "customer", "nation") if f" {t}" in sql]
    for t in names:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, y, x) of the positive values of the embeddings: one image a label, one row a vector."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("label AS page", "dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS y", "embedding")
    return rows.selectExpr("page", "y", "posexplode(embedding) AS (x, v)").where("v > 0").selectExpr("page", "cast(y AS bigint) AS y", "cast(x AS bigint) AS x")


#: The same in DuckDB.
PIXELS_SQL = "SELECT page, y, x - 1 AS x FROM (SELECT label AS page, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS y, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS x FROM embeddings) WHERE v > 0"
