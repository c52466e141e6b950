"""The contract of object detectors: any function from a page's pixels to boxes becomes a source of detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETECTIONS
from .files import decoded_pages, page_files

#: width, height, pixels -> rows of (class_id, confidence, x1, y1, x2, y2)
Detector = Callable[[int, int, bytes], list[tuple[int, float, int, int, int, int]]]


def detections(pages: DataFrame, load: Callable[[], Detector], classes: dict[int, str], threshold: float = 0.25, unknown: str = "unknown_") -> DataFrame:
    """Detections of pages (name, width, height, pixels) at or over the threshold. load() makes the detector, once in each worker task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for part in parts:
            out = []
            for name, w, h, pixels in zip(part["name"], part["width"], part["height"], part["pixels"], strict=True):
                for cls, conf, *box in detect(int(w), int(h), bytes(pixels)):
                    if conf >= threshold:
                        out.append((name, cls, classes.get(cls, f"{unknown}{cls}"), conf, *box))
            yield pd.DataFrame(out, columns=["image", "class_id", "class_name", "confidence", "x1", "y1", "x2", "y2"])

    return pages.where(F.col("pixels").isNotNull()).select("name", "width", "height", "pixels").mapInPandas(run, DETECTIONS)


def confident(found: DataFrame, threshold: float) -> DataFrame:
    """Detections at or over the threshold."""
    return found.where(F.col("confidence") >= threshold)


def directory_detections(spark: SparkSession, path: str, load: Callable[[], Detector], classes: dict[int, str], threshold: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(detections by image, one summary row: images, failed, detections) of all image files of a folder."""
    pages = decoded_pages(page_files(spark, path))
    found = per_image(pages.where("error is null"), detections(pages, load, classes, threshold))
    counts = found.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum(F.size("detections")), F.lit(0)).alias("detections"))
    return found, pages.agg(F.count("error").alias("failed")).crossJoin(counts).select("images", "failed", "detections")


def write_detections(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line of JSON for each image: its name and its detections."""
    found.select(F.to_json(F.struct("image", "detections")).alias("value")).write.mode(mode).text(path)


def per_image(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(image, detections): an array by confidence for every page, empty where nothing was found."""
    boxes = found.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("confidence", "class_id", "class_name", "x1", "y1", "x2", "y2")), asc=False).alias("detections"))
    kind = boxes.schema["detections"].dataType.simpleString()
    return pages.select(F.col("name").alias("image")).join(boxes, "image", "left").withColumn("detections", F.coalesce("detections", F.array().cast(kind)))


def in_tiles(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Boxes of tiles (tile, tile_x, tile_y) back in page coordinates; found has tile and box columns."""
    out = found.join(tiles.select("tile", "tile_x", "tile_y"), "tile")
    moved = {c: F.col(c) + F.col("tile_x" if c[0] == "x" else "tile_y") for c in ("x1", "y1", "x2", "y2")}
    return out.withColumns(moved).drop("tile_x", "tile_y")
