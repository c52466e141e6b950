"""Clustering that depends on what came before: running means, last kept, first member, extents, greedy suppression.

A row farther than the tolerance from the row before it breaks every one of the
sorted rules, whatever the state. So rows are cut there first, by a window, and
only the short runs between are folded, each in one aggregate() over an array;
a page's size doesn't matter then, its longest run does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..rounds import checkpoint
from . import conflicts, joins, suppression
from .islands import clusters_by_gap

#: A key of more boxes than this times conflicts.FOLDED is not walked through in one task.
WALKED = 20


def _folded(df: DataFrame, keys: list[str], x: str, tolerance: float, belongs: Callable[[Column, Column], Column], start: Callable[[Column], Column], add: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Numbers the groups: belongs(state, x) says whether x belongs to the state's group."""
    run = clusters_by_gap(df, keys, x, tolerance, "__run").withColumn("__row", F.struct(F.col(x).cast("double").alias("v"), F.struct(*[F.col(c) for c in df.columns]).alias("r")))
    groups = run.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    values = F.transform("__rows", lambda r: r["v"])
    first = F.get(values, F.lit(0))
    init = F.struct(start(first).alias("s"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        same = (acc["g"] >= 0) & belongs(acc["s"], v)
        g = F.when(same, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(F.when(same, add(acc["s"], v)).otherwise(start(v)).alias("s"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    numbered = groups.select("__run", F.explode(F.arrays_zip("__rows", F.aggregate(values, init, step, lambda acc: acc["out"]).alias("g"))).alias("z"))
    flat = numbered.select(*[F.col(f"z.__rows.r.{c}").alias(c) for c in df.columns], F.struct("__run", F.col("z.g").alias("g")).alias("__id"))
    return flat.withColumn(name, (F.dense_rank().over(Window.partitionBy(*keys).orderBy("__id")) - 1).cast("long")).drop("__id")


def running_mean_groups(df: DataFrame, keys: list[str], x: str = "x", tolerance: float = 8, name: str = "grp") -> DataFrame:
    """A row joins the group whose mean so far is within the tolerance."""
    return _folded(df, keys, x, tolerance, lambda s, v: v - s["sum"] / s["n"] <= tolerance, lambda v: F.struct(v.alias("sum"), F.lit(1.0).alias("n")), lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + 1).alias("n")), name)


def anchor_groups(df: DataFrame, keys: list[str], x: str = "x", tolerance: float = 50, name: str = "grp") -> DataFrame:
    """A row joins the group whose first member is within the tolerance."""
    return _folded(df, keys, x, tolerance, lambda s, v: v - s["a"] <= tolerance, lambda v: F.struct(v.alias("a")), lambda s, v: s, name)


def last_kept(df: DataFrame, keys: list[str], x: str = "x", distance: float = 15) -> DataFrame:
    """Distinct x that lie over `distance` beyond the last one kept."""
    grouped = anchor_groups(df.select(*keys, x).distinct(), keys, x, distance, "__g")
    return grouped.groupBy(*keys, "__g").agg(F.min(x).alias(x)).drop("__g")


def extent_clusters(df: DataFrame, keys: list[str], low: str = "y1", high: str = "y2", gap: float = 100, name: str = "grp") -> DataFrame:
    """Spans in order of their midpoints join the cluster whose extent is at most `gap` away.

    A span that begins over `gap` beyond all ends before it breaks whatever
    cluster there is, so rows are cut there and only the runs between are folded.
    """
    cols = df.columns
    row = F.struct(((F.col(low) + F.col(high)) / 2.0).alias("m"), F.least(low, high).cast("double").alias("a"), F.greatest(low, high).cast("double").alias("b"), F.struct(*cols).alias("r"))
    w = Window.partitionBy(*keys).orderBy("__row")
    far = F.col("__row.a") - F.max("__row.b").over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap
    runs = df.withColumn("__row", row).withColumn("__new", F.coalesce(far, F.lit(False)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = runs.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    spans = F.transform("__rows", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")))
    init = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        same = (acc["g"] >= 0) & (v["a"] - acc["b"] <= gap) & (acc["a"] - v["b"] <= gap)
        g = F.when(same, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(F.when(same, F.least(acc["a"], v["a"])).otherwise(v["a"]).alias("a"), F.when(same, F.greatest(acc["b"], v["b"])).otherwise(v["b"]).alias("b"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    out = groups.select("__run", F.explode(F.arrays_zip("__rows", F.aggregate(spans, init, step, lambda acc: acc["out"]).alias("g"))).alias("z"))
    flat = out.select(*[F.col(f"z.__rows.r.{c}").alias(c) for c in cols], F.struct("__run", F.col("z.g").alias("g")).alias("__id"))
    return flat.withColumn(name, (F.dense_rank().over(Window.partitionBy(*keys).orderBy("__id")) - 1).cast("long")).drop("__id")


def thickness(columns: DataFrame, keys: list[str], visits: tuple = (1, -1, 2, -2, 3, -3), coverage: float = 0.3) -> DataFrame:
    """(keys, thickness): one plus the side columns (offset, covered) visited in order until the first with too little coverage."""
    place = F.array_position(F.array(*[F.lit(v) for v in visits]), F.col("offset"))
    first_bad = F.min(F.when(F.col("covered") < coverage, place))
    return columns.where(place > 0).groupBy(*keys).agg(F.coalesce(first_bad - 1, F.count(F.lit(1))).alias("__n")).select(*keys, (F.col("__n") + 1).cast("int").alias("thickness"))


def greedy_suppression(boxes: DataFrame, keys: list[str], overlap: float = 0.5, rank: tuple = ("confidence", "id")) -> DataFrame:
    """Boxes that survive greedy suppression within keys: by confidence (ties by id, null last), each kept box drops those of that overlap or more.

    A key's boxes are walked through in that order, with the kept ones at hand
    (suppression.kept). A key of so many boxes that one task should not walk
    them goes by pairs that overlap enough, which conflicts.losers takes in
    order of rank. id names a box. Boxes without area, or with null in their
    key or corners, stay and drop none.
    """
    boxes = checkpoint(boxes)
    counts = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WALKED * conflicts.FOLDED).drop("__n")
    large = checkpoint(counts)
    if large.isEmpty():
        return _walked(boxes, keys, overlap, rank)
    own = large.select(*[F.col(k).alias(f"__large_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__large_{k}")) for k in keys])
    return _walked(boxes.join(own, on, "left_anti"), keys, overlap, rank).union(_by_pairs(boxes.join(own, on, "left_semi"), keys, overlap, rank))


def _walked(boxes: DataFrame, keys: list[str], overlap: float, rank: tuple) -> DataFrame:
    conf, ident = rank
    corners = ["x1", "y1", "x2", "y2"]
    takes_part = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))
    more = [F.xxhash64(*keys).alias("__unit"), F.coalesce(takes_part, F.lit(False)).alias("__part"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in corners]]
    ordered = boxes.select("*", *more).repartition("__unit").sortWithinPartitions("__unit", F.desc_nulls_last(conf), ident)
    return ordered.mapInArrow(lambda batches: suppression.kept(batches, overlap), boxes.schema)


def _by_pairs(boxes: DataFrame, keys: list[str], overlap: float, rank: tuple) -> DataFrame:
    conf, ident = rank
    met = joins.overlapping(boxes, keys, ident, more=[conf]).where(iou("p", "q") >= overlap)
    first = F.col(f"p.{conf}") >= F.col(f"q.{conf}")
    pairs = met.select(*keys, F.greatest(f"p.{conf}", f"q.{conf}").alias("rank"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("high"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("low"))
    return boxes.join(conflicts.losers(pairs, keys).withColumnRenamed("low", ident), ident, "left_anti").select(*boxes.columns)
