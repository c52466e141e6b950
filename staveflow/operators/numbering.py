"""Places and running sums over whole tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rounds import checkpoint

_BITS = 33  # monotonically_increasing_id() counts the rows of a partition in its low bits


def _fresh(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, order: list[Column], name: str = "n", size: str | None = None) -> DataFrame:
    """rows with `name`: how many rows come before in this order or, with size (a column of whole numbers), how much of it they hold.

    A range sort, a count by partition, and the counts before each partition
    added to the place within it. The only thing that all tasks share has one
    row a partition. The sorted rows are a checkpoint, so places stay the same
    when an executor is lost. Rows that tie in all of `order` come in one
    partition and in any sequence: end it with a column that tells them apart.
    """
    part, at, held = (_fresh(rows, c) for c in ("part", "at", "held"))
    rows = rows.drop(name)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _BITS) - 1)))
    ranged = checkpoint(ranged)
    amount = F.count(F.lit(1)) if size is None else F.sum(F.coalesce(F.col(size), F.lit(0)))
    totals = ranged.groupBy(part).agg(amount.alias(held))
    before = F.coalesce(F.sum(held).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select(part, before.cast("long").alias(held)))  # one row a partition
    within = F.col(at)
    if size is not None:
        earlier = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))).over(earlier), F.lit(0))
        ranged = ranged.withColumn(name, within.cast("long"))
        within = F.col(name)
    return ranged.join(offsets, part).withColumn(name, within + F.col(held)).drop(part, at, held)
