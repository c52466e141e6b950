"""Symbols on pages: stems beside noteheads, detections of tiles, boxes as shares of the page, measure numbers through a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_vertical, segment_metrics, to_ratio
from ..functions.labels import is_notehead
from ..operators import folds, joins, windows
from ..sources import sinks
from ..sources.detectors import in_tiles

# Fixed value: the model's class of stems.
STEM_CLASS = 1


def stems(segments: DataFrame, noteheads: DataFrame, keys: list[str] | None = None, reach: float = 30, tolerance: float = 15) -> DataFrame:
    """Upright segments (id, x1, y1, x2, y2) with the nearest notehead (target_id, x, y) to their centre; others are dropped."""
    keys = keys or ["page"]
    lines = segments.select(*keys, "id", *segment_metrics()).where(is_vertical("angle", tolerance, strict=True))
    near = joins.nearest(lines.select(*keys, "id", F.col("center_x").alias("x"), F.col("center_y").alias("y")), noteheads, keys, reach)
    return lines.join(near.select(*keys, "id", F.col("target_id").alias("associated_notehead"), "distance"), [*keys, "id"])


def hybrid(detections: DataFrame, stem_lines: DataFrame) -> DataFrame:
    """Model detections without its own stems, and classical stems, with their method."""
    return sinks.merged_results(("model", detections.where(F.col("class_id") != STEM_CLASS)), ("classical", stem_lines))


def tiled(tiles: DataFrame, found: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Detections of overlapping tiles in page coordinates, duplicates suppressed by page and class (image, cls)."""
    return folds.greedy_suppression(in_tiles(tiles, found), ["image", "cls"], overlap)


def ratio_boxes(boxes: DataFrame, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Boxes (x1, y1, x2, y2) as shares of the page's size."""
    return boxes.withColumns({c: to_ratio(c, width if c[0] == "x" else height) for c in ("x1", "y1", "x2", "y2")})


def absolute_numbers(measures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """measures (doc, page, group_idx, measure_number) with absolute_number: through all groups before, one system of a group counting."""
    keys = keys or ["doc"]
    per = measures.groupBy(*keys, "page", "group_idx").agg(F.max("measure_number").alias("n"))
    before = windows.prefix_sums(per, keys, ["page", "group_idx"], "n")
    return measures.join(before.drop("n"), [*keys, "page", "group_idx"]).withColumn("absolute_number", F.col("before") + F.col("measure_number")).drop("before")


def labelled_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (image) that have a label row."""
    return images.join(labels.select("image").distinct(), "image", "left_semi")


def stems_of_detections(segments: DataFrame, detections: DataFrame, keys: list[str] | None = None, reach: float = 30) -> DataFrame:
    """stems() with the noteheads among detections (id, class_name, x1, y1, x2, y2), by their middles."""
    keys = keys or ["page"]
    heads = detections.where(is_notehead(F.col("class_name"))).select(*keys, F.col("id").alias("target_id"), F.floor((F.col("x1") + F.col("x2")) / 2).alias("x"), F.floor((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return stems(segments, heads, keys, reach)
