"""Joins: dictionary lookups, pairing, containment, nearest neighbour, range assignment.

Range and nearest joins get an equi key first (a grid cell), so that Spark
plans a hash or merge join and no nested loop; rows on a border go to all the
cells that they touch. Small sides are broadcast by Spark where their size is
under its threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs


def _on(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys])


def annotations_with_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of known images (image_id equal to id as text)."""
    named = images.withColumnRenamed("id", "__id")
    return annotations.join(named, F.col("image_id").cast("string") == F.col("__id").cast("string")).drop("__id")


def first_target_category(annotations: DataFrame, categories: DataFrame, ids: str = "cat_ids", key: str = "ann_id") -> DataFrame:
    """Each annotation with the first of its ids that is a target category; those without one are dropped. categories: (id, name)."""
    long = annotations.select(key, F.posexplode(ids).alias("pos", "id"))
    named = long.join(categories, "id").groupBy(key).agg(F.min(F.struct("pos", "id", "name")).alias("c"))
    return annotations.join(named.select(key, F.col("c.id").alias("category_id"), F.col("c.name").alias("category_name")), key)


def with_class_names(detections: DataFrame, classes: DataFrame, prefix: str = "class_") -> DataFrame:
    """class_name by class_id, or prefix and id for ids that the dictionary lacks."""
    return detections.join(classes.select(F.col("id").alias("class_id"), F.col("name").alias("__name")), "class_id", "left").withColumn("class_name", F.coalesce("__name", F.concat(F.lit(prefix), F.col("class_id").cast("string")))).drop("__name")


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with the numbers of keys on both sides, missing on the right, and orphans on the right."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("matched"), F.count(F.when(F.col("__r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("__l").isNull(), 1)).alias("orphans"))


def contained(outer: DataFrame, inner: DataFrame, keys: list[str], slack: float = 20, low: str = "y_start", high: str = "y_end", top: str = "top", bottom: str = "bottom", cell: int = 256) -> DataFrame:
    """Pairs (outer.*, inner.*) where the inner span lies in the outer one widened by slack."""
    a = outer.withColumn("__cell", F.explode(F.sequence(F.floor((F.col(low) - slack) / cell), F.floor((F.col(high) + slack) / cell))))
    b = inner.withColumn("__cell", F.floor(F.col(top) / cell))
    inside = (F.col(f"b.{top}") >= F.col(f"a.{low}") - slack) & (F.col(f"b.{bottom}") <= F.col(f"a.{high}") + slack)
    met = a.alias("a").join(b.alias("b"), _on("a", "b", [*keys, "__cell"]) & inside)
    return met.select(*[F.col(f"a.{c}") for c in outer.columns], *[F.col(f"b.{c}") for c in inner.columns if c not in keys])


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], reach: float = 30, point_id: str = "id", target_id: str = "target_id") -> DataFrame:
    """For each point (x, y) the nearest target within reach (equal to it counts), ties to the smallest target id.

    A target goes to its cell once; of those in the same place only the first
    can be the answer. A point goes to the cells that its reach touches, two a
    side at most.
    """
    side = 2 * int(reach) + 2
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    a = points.where("x is not null and y is not null").select(*keys, point_id, "x", "y").withColumn("__cx", cells("x")).withColumn("__cy", cells("y"))
    own = targets.where(F.col(target_id).isNotNull()).select(*keys, target_id, "x", "y", F.floor(F.col("x") / side).alias("__cx"), F.floor(F.col("y") / side).alias("__cy"))
    b = own.repartition(*keys, "__cx", "__cy").groupBy(*keys, "__cx", "__cy", "x", "y").agg(F.min(target_id).alias(target_id))
    d2 = (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y"))
    met = a.alias("a").join(b.alias("b"), _on("a", "b", [*keys, "__cx", "__cy"]) & (d2 <= reach * reach))
    best = met.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{point_id}").alias(point_id)).agg(F.min(F.struct(d2.cast("double").alias("d2"), F.col(f"b.{target_id}").alias("t"))).alias("m"))
    return best.select(*keys, point_id, F.col("m.t").alias(target_id), F.sqrt("m.d2").alias("distance"))


def range_assign(points: DataFrame, starts: DataFrame, keys: list[str], x: str = "x", start: str = "start", value: str = "value") -> DataFrame:
    """Each point with the value of the last start at or before it (start <= x < next start); points before the first have none.

    One sort by (keys, x) over both sides carries the value on, so no range join is planned.
    """
    p = points.withColumn("__kind", F.lit(1)).withColumn("__at", F.col(x))
    s = starts.select(*keys, F.lit(0).alias("__kind"), F.col(start).alias("__at"), F.struct(F.col(value).alias("v")).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return both.where(F.col("__kind") == 1).select(*points.columns, F.col("__last.v").alias(value))


def first_overlapping(groups: DataFrame, brackets: DataFrame, keys: list[str], default: int = 0) -> DataFrame:
    """groups (keys, group_idx, systems) with bracket_x: x of the first bracket (by pos) that covers one of their systems."""
    g = groups.select(*keys, "group_idx", F.explode("systems").alias("__s"))
    b = brackets.select(*keys, "pos", "x", F.explode("covered_systems").alias("__s"))
    met = g.join(b, [*keys, "__s"]).groupBy(*keys, "group_idx").agg(F.min(F.struct("pos", "x")).alias("m"))
    return groups.join(met.select(*keys, "group_idx", F.col("m.x").alias("bracket_x")), [*keys, "group_idx"], "left").withColumn("bracket_x", F.coalesce("bracket_x", F.lit(default)))


def lines_crossed(barlines: DataFrame, pixels: DataFrame, lines: DataFrame, keys: list[str], margin: int = 3, least: int = 3) -> DataFrame:
    """Barlines (id, x) with n_crossed, the staff lines (y) where a pixel is set within margin columns; those of `least` lines or more."""
    near = barlines.select(*keys, "id", F.explode(F.sequence(F.col("x") - margin, F.col("x") + margin)).alias("x"))
    hit = near.join(pixels.join(lines, [*keys, "y"], "left_semi"), [*keys, "x"])
    return hit.groupBy(*keys, "id").agg(F.countDistinct("y").alias("n_crossed")).where(F.col("n_crossed") >= least)


def remapped(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels of mapped classes with their new ids; mapping: (old_id, new_id)."""
    return labels.join(mapping.withColumnRenamed("old_id", "class_id"), "class_id").drop("class_id").withColumnRenamed("new_id", "class_id")


def without_nearest(barlines: DataFrame, clicks: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Barlines (id, x) less the nearest one (under reach, ties to the first id) to each click (x). A cell of width reach is one more key."""
    cell = F.floor(F.col("x") / reach)
    near = clicks.select(*keys, F.col("x").alias("__cx"), F.explode(F.array(*[cell + i for i in (-1, 0, 1)])).alias("__cell"))
    met = near.join(barlines.withColumn("__cell", cell), [*keys, "__cell"]).withColumn("__d", F.abs(F.col("x") - F.col("__cx"))).where(F.col("__d") < reach)
    gone = met.groupBy(*keys, "__cx").agg(F.min(F.struct("__d", "id"))["id"].alias("id")).select(*keys, "id").distinct()
    return barlines.join(gone, [*keys, "id"], "left_anti")


def without_manual(barlines: DataFrame, clicks: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Barlines (id, x, type) less all manual ones that lie under reach of a click (x)."""
    cell = F.floor(F.col("x") / reach)
    near = clicks.select(*keys, F.col("x").alias("__cx"), F.explode(F.array(*[cell + i for i in (-1, 0, 1)])).alias("__cell"))
    manual = barlines.where("type = 'manual'").withColumn("__cell", cell)
    gone = near.join(manual, [*keys, "__cell"]).where(F.abs(F.col("x") - F.col("__cx")) < reach).select(*keys, "id").distinct()
    return barlines.join(gone, [*keys, "id"], "left_anti")


def with_manual(barlines: DataFrame, clicks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """barlines and one of type manual for each click (x, y) inside a group's span (group_idx, top, bottom), over the span's height."""
    placed = group_at(clicks, spans, keys).where("group_idx is not null")
    own = placed.join(spans, [*keys, "group_idx"]).select(*keys, "group_idx", "x", F.col("top").alias("y_start"), F.col("bottom").alias("y_end"), F.lit("manual").alias("type"))
    return barlines.unionByName(own, allowMissingColumns=True)


def group_at(points: DataFrame, spans: DataFrame, keys: list[str], cell: int = 256) -> DataFrame:
    """points (y) with the smallest group_idx of the spans (group_idx, top, bottom) that contain y, ends included; null outside all."""
    cut = spans.select(*keys, "group_idx", "top", "bottom", F.explode(F.sequence(F.floor(F.col("top") / cell), F.floor(F.col("bottom") / cell))).alias("__cell"))
    at = points.withColumn("__cell", F.floor(F.col("y") / cell))
    spots = at.select(*keys, "y", "__cell").distinct().join(cut, [*keys, "__cell"]).where("y between top and bottom").groupBy(*keys, "y").agg(F.min("group_idx").alias("group_idx"))
    return points.join(spots, [*keys, "y"], "left")


def first_match(rows: DataFrame, lookup: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """rows with the columns of the first row of lookup (by pos) that has their keys; null where none has."""
    rest = [c for c in lookup.columns if c not in (*keys, pos)]
    first = lookup.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("__f"))
    return rows.join(first, keys, "left").select(*rows.columns, *[F.col("__f")[c].alias(c) for c in rest])


def overlapping(boxes: DataFrame, keys: list[str], ident: str = "id", cell: int = 512, more: list[str] | None = None) -> DataFrame:
    """(keys, a, p, b, q): pairs of boxes (ident, x1, y1, x2, y2) with some area in common, a before b by ident, and their corners, with more columns of theirs.

    Boxes move once, to the bands of y that they touch, and each band is swept
    in order of x1. A pair counts in the band where its common area begins, so
    it comes once.
    """
    box = ["x1", "y1", "x2", "y2", *(more or [])]
    dealt = _in_bands(boxes, keys, ident, cell, box)
    schema = dealt.select(*keys, F.col("__i").alias("a"), F.struct(*box).alias("p"), F.col("__i").alias("b"), F.struct(*box).alias("q")).schema
    return dealt.mapInArrow(lambda batches: pairs.swept(batches, keys, box, cell), schema)


def ious(boxes: DataFrame, keys: list[str], ident: str = "id", cell: int = 512) -> DataFrame:
    """(a, b, iou) of the pairs of overlapping(), worked out where they are found, so that a pair leaves the sweep as three numbers."""
    box = ["x1", "y1", "x2", "y2"]
    dealt = _in_bands(boxes, keys, ident, cell, box)
    schema = dealt.select(F.col("__i").alias("a"), F.col("__i").alias("b"), F.lit(0.0).alias("iou")).schema
    return dealt.mapInArrow(lambda batches: pairs.swept(batches, keys, box, cell, "iou"), schema)


def _in_bands(boxes: DataFrame, keys: list[str], ident: str, cell: int, box: list[str]) -> DataFrame:
    """Boxes with some area as (keys, __i, box, __band), once for each band of y that they touch, sorted by x1 in their band."""
    band = F.explode(F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))).alias("__band")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))
    rows = boxes.where(known).select(*keys, F.col(ident).alias("__i"), *box, band)
    return rows.repartition(*keys, "__band").sortWithinPartitions(*keys, "__band", "x1")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The keys of left, once each, that right doesn't have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
