"""Time signatures of measures: found by position, read from class names, carried on through pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import signature
from ..operators import joins, windows


def per_measure(measures: DataFrame, detections: DataFrame, default: str = "4/4") -> DataFrame:
    """measures (doc, page, group_idx, measure_number, x_start) with signature and beats; detections (doc, page, group_idx, class_name, x); of several in a measure the one farthest to the left counts."""
    keys = ["doc", "page", "group_idx"]
    found = detections.where(F.lower("class_name").contains("timesig")).withColumn("s", signature(F.col("class_name"))).where("s.signature is not null")
    starts = measures.select(*keys, F.col("x_start").alias("start"), F.col("measure_number").alias("value"))
    placed = joins.range_assign(found.select(*keys, "x", "s"), starts, keys)
    first = placed.where("value is not null").groupBy(*keys, F.col("value").alias("measure_number")).agg(F.min_by("s", F.struct("x", "s")).alias("s"))
    rows = measures.join(first, [*keys, "measure_number"], "left").withColumn("sig", F.col("s.signature"))
    out = windows.carry_forward(rows, ["doc"], ["page", "group_idx", "measure_number"], "sig", default, "signature")
    w = out.withColumn("beats", F.coalesce(F.expr("try_cast(regexp_extract(signature, '^([0-9]+)/', 1) as int)"), F.lit(4)))
    return w.drop("s", "sig")
