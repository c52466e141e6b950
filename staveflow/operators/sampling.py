"""Top-k, splits and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def top_classes(counts: DataFrame, essential: DataFrame, k: int = 50, least: int = 100) -> DataFrame:
    """The k most frequent classes (cls, n), and essential ones (cls) beyond them that have more than `least`."""
    top = counts.orderBy(F.desc("n"), "cls").limit(k)
    extra = counts.join(essential, "cls", "left_semi").where(F.col("n") > least).join(top, "cls", "left_anti")
    return top.withColumn("why", F.lit("top")).unionByName(extra.withColumn("why", F.lit("essential")))


def top_images_per_class(counts: DataFrame, k: int, image: str = "image", cls: str = "cls", n: str = "n") -> DataFrame:
    """Images that are among the k richest of some class, once each, with the classes they were picked for."""
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(n), image))
    return counts.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(image).agg(F.sort_array(F.collect_set(cls)).alias("picked_for"))


def stable_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest hashes of the key; the same ones in any partitioning."""
    return rows.orderBy(_digest(key, seed), key).limit(n)


def _digest(key: str, seed: int) -> Column:
    """The same in any engine: the md5 of key and seed as text."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def stable_split(rows: DataFrame, key: str, share: float = 0.85, seed: int = 42, name: str = "split") -> DataFrame:
    return rows.withColumn(name, F.when(F.conv(F.substring(_digest(key, seed), 1, 7), 16, 10).cast("long") % 10_000 < int(share * 10_000), "train").otherwise("val"))


def shard_split(rows: DataFrame, shard: str = "shard", share: float = 0.8, name: str = "split") -> DataFrame:
    """Train for shards whose place among all is under the share."""
    place = numbered(rows.select(shard).where(F.col(shard).isNotNull()).distinct(), [F.col(shard)], "__at")
    total = place.count()
    return rows.join(place, shard).withColumn(name, F.when(F.col("__at") < share * total, "train").otherwise("val")).drop("__at")


def balanced_sample(counts: DataFrame, n: int, classes: int, image: str = "image", least: int = 50, seed: int = 42) -> DataFrame:
    """Images among the richest of each class, as many a class as n shared by the classes (least at least), once each, with the classes they were picked for; of more than n a stable sample of n."""
    return stable_sample(top_images_per_class(counts, max(least, n // max(1, classes)), image), image, n, seed)


def by_confidence(detections: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """detections with place, from 1 for the most confident of each key; ties by id."""
    return detections.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), ident)))


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by a column."""
    return rows.orderBy(order).limit(n)


def reading_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """boxes (x1, y1, x2, y2) with place, from 1, by the middle of x, then of y, then by their corners."""
    middle = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*middle, "x1", "y1", "x2", "y2")))


def visible(detections: DataFrame, shown: DataFrame, cls: str = "class_name") -> DataFrame:
    """Detections of the classes shown (a column of that name)."""
    return detections.join(shown.select(cls).distinct(), cls, "left_semi")


def shown_of(detections: DataFrame, shown: DataFrame, cls: str = "class_name") -> DataFrame:
    """One row (shown, total, label): how many of all detections are of the classes shown, as in '3 of 12 shown'."""
    mark = detections.join(shown.select(cls).distinct().withColumn("__s", F.lit(1)), cls, "left")
    return mark.agg(F.count("__s").alias("shown"), F.count(F.lit(1)).alias("total")).withColumn("label", F.format_string("%d of %d shown", "shown", "total"))
