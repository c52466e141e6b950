"""Sinks: nested JSON documents, reports, and files by image (labels, renderings, crops)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, named_files


def page_documents(measures: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, document): one JSON document a page with its measures in order."""
    keys = keys or ["doc", "page"]
    rest = [c for c in measures.columns if c not in keys]
    rows = measures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("measures"))
    return rows.select(*keys, F.to_json(F.struct(*keys, F.size("measures").alias("total_measures"), "measures")).alias("document"))


def overall_document(measures: DataFrame) -> DataFrame:
    """(doc, document): pages keyed by their number as text, and the total."""
    rest = [c for c in measures.columns if c not in ("doc", "page")]
    pages = measures.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("measures"))
    entry = F.struct(F.col("page").cast("string").alias("key"), F.struct("page", "measures").alias("value"))
    whole = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", entry.alias("e")))).alias("p"), F.sum(F.size("measures")).alias("total_measures"))
    return whole.select("doc", F.to_json(F.struct("total_measures", F.map_from_entries(F.transform("p", lambda x: x["e"])).alias("pages"))).alias("document"))


def write_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    documents.select("document").write.mode(mode).text(path)


def label_lines(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(image, line): one row an image, its label lines joined; empty for an image without labels."""
    text = F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string("%.6f", F.col(c)) for c in ("xc", "yc", "w", "h")])
    lines = labels.select("image", text.alias("line")).groupBy("image").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("line"))
    return images.select("image").join(lines, "image", "left").withColumn("line", F.coalesce("line", F.lit("")))


def write_labels(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One file <image>.txt for each row (image, line), as files.yolo_labels reads them; an empty one for an image without labels."""
    text = F.when(F.coalesce("line", F.lit("")) != "", F.concat("line", F.lit("\n"))).otherwise("")
    named_files.write(lines.select(F.concat("image", F.lit(".txt")).alias("file"), text.alias("content")), path, mode)


def write_images(images: DataFrame, path: str, mode: str = "append") -> None:
    """One file <name>.png for each image (name, width, height, pixels): page renderings, or crops by a name of their own. Rows without pixels are left out."""

    @F.pandas_udf("binary")
    def encoded(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
        return pd.Series([files.encode_png(int(w), int(h), bytes(p)) for w, h, p in zip(width, height, pixels, strict=True)])

    rows = images.where("pixels is not null and width > 0 and height > 0")
    named_files.write(rows.select(F.concat("name", F.lit(".png")).alias("file"), encoded("width", "height", "pixels").alias("content")), path, mode)


def write_crops(crops: DataFrame, path: str, mode: str = "append") -> None:
    """One file <name>/<crop_id>.png for each crop of kernels.page_crops."""
    write_images(crops.withColumn("name", F.concat_ws("/", "name", "crop_id")), path, mode)


def merged_results(*methods: tuple[str, DataFrame]) -> DataFrame:
    """Detections of several methods with their names; columns that a method lacks are null."""
    out = None
    for name, rows in methods:
        tagged = rows.withColumn("method", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def dataset_yaml(classes: DataFrame, root: str, train: str = "images/train", val: str = "images/val") -> str:
    """The text of a dataset description; classes (id, name) are a small dictionary."""
    names = sorted((r["id"], r["name"]) for r in classes.select("id", "name").collect())
    return "\n".join([f"path: {root}", f"train: {train}", f"val: {val}", f"nc: {len(names)}", "names:", *[f"  {i}: {n}" for i, n in names], ""])


def coverage_flags(classes: DataFrame, parts: dict[str, str]) -> DataFrame:
    """One row: for each flag whether a class name holds its part."""
    return classes.agg(*[F.coalesce(F.bool_or(F.lower("name").contains(v)), F.lit(False)).alias(k) for k, v in parts.items()])


def validation_report(steps: DataFrame) -> DataFrame:
    """(overall, passed, failed, seconds) of steps (step, status, seconds)."""
    return steps.agg(F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("overall"), F.count(F.when(F.col("status") == "PASS", 1)).alias("passed"), F.count(F.when(F.col("status") != "PASS", 1)).alias("failed"), F.sum("seconds").alias("seconds"))


def require_classes(classes: DataFrame, names: list[str]) -> DataFrame:
    """classes, or an error when one of the names is missing as the rows are read."""
    have = F.collect_set("name").over(Window.partitionBy())
    missing = F.array_except(F.array(*[F.lit(n) for n in names]), have)
    checked = classes.withColumn("__m", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing classes: "), F.array_join(missing, ", ")))).otherwise(F.lit("ok")))
    return checked.where(F.col("__m") == "ok").drop("__m")


def upsert(stored: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the pages of patch put in place of their own."""
    return stored.join(patch.select(*keys).distinct(), keys, "left_anti").unionByName(patch, allowMissingColumns=True)


def document_results(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): one JSON document with metadata (total_pages, total_measures, total_symbols) and pages by their number as text; pages (page, measures, symbols, signature)."""
    entry = F.struct(F.col("page").cast("string").alias("key"), F.struct(F.col("page").alias("page_number"), "measures", "symbols", "signature").alias("value"))
    whole = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", entry.alias("e")))).alias("p"), F.count(F.lit(1)).alias("total_pages"), F.sum("measures").alias("total_measures"), F.sum("symbols").alias("total_symbols"))
    body = F.struct(F.struct("total_pages", "total_measures", "total_symbols").alias("metadata"), F.map_from_entries(F.transform("p", lambda x: x["e"])).alias("pages"))
    return whole.select(*keys, F.to_json(body).alias("document"))


def excluded_classes(classes: DataFrame, excluded: list[str]) -> DataFrame:
    """(document): one JSON document of the classes (id, name) that are left out, by id, and their number."""
    gone = classes.where(F.col("name").isin(excluded)).select(F.struct("id", "name").alias("c"))
    return gone.agg(F.array_sort(F.collect_list("c")).alias("excluded")).select(F.to_json(F.struct(F.size("excluded").alias("n"), "excluded")).alias("document"))
