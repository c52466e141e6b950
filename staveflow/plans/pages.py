"""From page images to measures, whole documents at a time.

A page is decoded and thresholded once. What is left of it is a mask of one bit
a pixel, checkpointed by page name, and rows of staff lines; whatever else is
asked of its pixels travels to the mask as a few rows a page (search areas,
columns to probe) and comes back as a few rows (strokes, answers). Systems,
groups, scores, agreement and measures are joins, windows and aggregates over
all pages at once. No pixel is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions import geometry as geo
from ..functions import kernels
from ..operators import aggregates, folds, islands, validation, windows
from ..rounds import checkpoint
from ..sources import files, sinks
from . import measures as mp
from . import signatures

KEYS = ["name"]
# Height share around a system that is searched, least score of a stroke group in a system and on a whole page, width share of the bracket search and its votes.
AROUND, LEAST_SCORE, LEAST_PAGE_SCORE, LEFT, LEFT_VOTES = 0.3, 20, 30, 0.15, 80
#: The area number of a page's bracket search; those of systems count from 0.
BRACKETS = -1


def masks_of_pages(pages: DataFrame, length: int = 50) -> DataFrame:
    """kernels.page_masks of pages (name, width, height, pixels), checkpointed by name, so that later questions are the only rows that move."""
    return _by_name(kernels.page_masks(pages, length))


def masks_of_files(images: DataFrame, length: int = 50) -> DataFrame:
    """The same straight from image files (name, content), with an error for each that can't be decoded (its bits are null); a page's pixels never leave the task."""

    def one(name: str, content: bytes) -> tuple:
        try:
            width, height, pixels = files.decode_image(bytes(content))
            bits, dark, found = kernels.page_mask(np.frombuffer(pixels, np.uint8).reshape(height, width), length)
        except files.DECODE_ERRORS as e:
            return name, None, None, None, None, None, str(e) or type(e).__name__
        return name, width, height, bits, dark, [{"y": y, "x_start": a, "x_end": b} for y, a, b in found], None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (one(*r) for part in parts for r in zip(part["name"], part["content"], strict=True))
        for lot in kernels.in_lots(rows, ["name", "width", "height", "bits", "dark", "peaks", "error"], kernels.MASK_LOT):
            yield lot.astype({"width": "Int32", "height": "Int32", "dark": "Int64"})

    return _by_name(images.select("name", "content").mapInPandas(run, kernels.MASKS + ", error string"))


def _by_name(rows: DataFrame) -> DataFrame:
    """Checkpointed and dealt by name. Planned without adaptive execution, of whose plans Spark keeps no partitioning: so joins by name find the rows where they are.

    A checkpoint runs what stands behind the last exchange twice, once to count
    and once to write; so what a page costs stands before one.
    """
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(rows.repartition(int(conf.get("spark.sql.shuffle.partitions")), "name"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def staff_rows(masks: DataFrame) -> DataFrame:
    """(name, y, x_start, x_end) of staff-line rows."""
    return masks.where("bits is not null").select("name", F.explode("peaks").alias("p")).select("name", "p.*")


def systems_of_pages(masks: DataFrame, config: DetectionConfig = DEFAULT) -> DataFrame:
    """Staff systems (name, system_idx, lines, ..., group_idx) of pages."""
    lines = islands.staffs_from_peaks(staff_rows(masks), KEYS, config.staff_same_system_spacing_ratio)
    return mp.page_systems(lines.select("name", "y"), config, KEYS)


def search_areas(systems: DataFrame, config: DetectionConfig = DEFAULT) -> DataFrame:
    """Where and how barlines are sought: each system with a margin, its settings by its own height and spacing."""
    around = (F.col("height") * AROUND).cast("int")
    place = [F.col("system_idx").alias("area"), F.lit(0).alias("x_from"), F.lit(None).cast("int").alias("x_to"), F.greatest(F.lit(0), F.col("top") - around).alias("y_from"), (F.col("bottom") + around).alias("y_to")]
    return systems.select("name", *place, *geo.hough_parameters("height", "avg_spacing", config), F.lit(20).alias("tolerance"), F.lit(False).alias("hooks"))


def bracket_areas(masks: DataFrame, systems: DataFrame) -> DataFrame:
    """The left edge of each page, for strokes that are nearly upright and hooked at both ends."""
    settings = validation.bracket_parameters(systems, KEYS).join(masks.select("name", "width"), "name")
    place = [F.lit(BRACKETS).alias("area"), F.lit(0).alias("x_from"), (F.col("width") * LEFT).cast("int").alias("x_to"), "y_from", "y_to"]
    return settings.select("name", *place, F.lit(LEFT_VOTES).alias("threshold"), "min_length", "max_gap", F.lit(2).alias("tolerance"), F.lit(True).alias("hooks"))


def barlines_of_systems(masks: DataFrame, systems: DataFrame, segments: DataFrame, config: DetectionConfig = DEFAULT) -> DataFrame:
    """(name, system_idx, x): stroke groups of each system with enough score, on three of its lines, spanning it from its first line to its last."""
    keys = [*KEYS, "system_idx"]
    wide = masks.select("name", F.greatest(F.lit(5), (F.col("width") * 0.01).cast("int")).alias("near"))
    upright = segments.select(*keys, "x1", "y1", "x2", "y2", *geo.segment_metrics()).where(geo.is_vertical("angle", 20))
    # the tolerance is the page's, so distances are measured in it
    scaled = upright.join(wide, "name").withColumn("__x", F.col("center_x") / F.col("near"))
    grouped = folds.running_mean_groups(scaled, keys, "__x", 1.0)
    scores = aggregates.line_groups(grouped, [*keys, "grp"]).where(F.col("barline_score") >= LEAST_SCORE)
    extents = validation.group_extents(grouped, [*keys, "grp"])
    found = scores.join(extents, [*keys, "grp"]).join(systems.select(*keys, "lines", "top", "bottom", "height", F.col("avg_spacing").alias("spacing")), keys)
    longest = F.col("height") + (F.col("spacing") * config.hough_max_barline_length_ratio).cast("int")
    spans = found.withColumn("x", F.floor("center_x").cast("int")).where(validation.spans_staff(config=config, max_length=longest))
    answers = kernels.probed(masks, spans.select("name", F.col("system_idx").alias("area"), "x", "lines", "top", "bottom").distinct())
    return answers.where("crossed >= 3 and reached").select("name", F.col("area").alias("system_idx"), "x").distinct()


def brackets_of_pages(segments: DataFrame, systems: DataFrame) -> DataFrame:
    """Brackets (name, x, y_start, y_end, covered_systems, pos) of hooked strokes at the left edge of pages."""
    hooked = segments.where(F.col("hooked") & geo.unsigned_angle().between(88, 92))
    return mp.brackets(hooked.select("name", F.col("x1").alias("x"), "y1", "y2"), systems, KEYS)


def _masks(pages: DataFrame) -> DataFrame:
    masks = pages if "bits" in pages.columns else masks_of_files(pages) if "content" in pages.columns else masks_of_pages(pages)
    return masks.where("bits is not null")


def system_barlines(pages: DataFrame, config: DetectionConfig = DEFAULT) -> DataFrame:
    """analysed()'s system_barlines alone: pages are not searched for brackets, and nothing is agreed."""
    masks = _masks(pages)
    systems = _by_name(systems_of_pages(masks, config))
    segments = _by_name(kernels.strokes(masks, search_areas(systems, config))).withColumnRenamed("area", "system_idx")
    return barlines_of_systems(masks, systems, segments, config)


def analysed(pages: DataFrame, config: DetectionConfig = DEFAULT) -> dict[str, DataFrame]:
    """systems, barlines (agreed), brackets and measures of pages, each one table over all pages.

    pages: images (name, width, height, pixels), image files (name, content),
    or masks. Pages that could not be decoded have no rows. Each page is
    decoded once, searched once and probed once.
    """
    masks = _masks(pages)
    systems = _by_name(systems_of_pages(masks, config))
    found = _by_name(kernels.strokes(masks, search_areas(systems, config).unionByName(bracket_areas(masks, systems))))
    segments = found.where(F.col("area") != BRACKETS).withColumnRenamed("area", "system_idx")
    single = checkpoint(barlines_of_systems(masks, systems, segments, config))
    agreed = checkpoint(mp.agreed_barlines(single, systems, config, KEYS))
    brackets = checkpoint(brackets_of_pages(found.where(F.col("area") == BRACKETS), systems))
    return {"systems": systems, "system_barlines": single, "barlines": agreed, "brackets": brackets, "measures": mp.measures(agreed, systems, brackets, KEYS)}


def barlines_of_whole_pages(masks: DataFrame, config: DetectionConfig = DEFAULT, least: int = LEAST_PAGE_SCORE) -> DataFrame:
    """(name, x, score) without a search by system, for pages whose systems are unclear: one search over the page, settings by its ink and spacing, groups of `least` points (30; the strict form takes 40) that cross three of its lines and one whole staff if there are five lines.

    Candidates go to a page's mask with the page's lines, and those that stand come back.
    """
    rows = staff_rows(masks)
    lines = _by_name(islands.staffs_from_peaks(rows, KEYS, config.staff_same_system_spacing_ratio).select("name", "y"))
    spacing = checkpoint(islands.median_spacing(lines, KEYS, "y"))
    sized = masks.where("bits is not null").select("name", "width", "height", (F.col("dark") / (F.col("width") * F.col("height"))).alias("density")).join(spacing, "name")
    enough = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    tuned = checkpoint(sized.join(enough, "name", "left_semi").select("name", "height", *validation.tuned_parameters()))
    areas = tuned.select("name", F.lit(0).alias("area"), F.lit(0).alias("x_from"), F.lit(None).cast("int").alias("x_to"), F.lit(0).alias("y_from"), F.col("height").alias("y_to"), "threshold", "min_length", "max_gap", F.col("angle_tolerance").alias("tolerance"), F.lit(False).alias("hooks"))
    segments = _by_name(kernels.strokes(masks.where("bits is not null"), areas)).select("name", "x1", "y1", "x2", "y2", *geo.segment_metrics())
    scaled = segments.join(tuned.select("name", "x_tolerance"), "name").withColumn("__x", F.col("center_x") / F.col("x_tolerance"))
    grouped = folds.running_mean_groups(scaled, KEYS, "__x", 1.0)
    scored = aggregates.line_groups(grouped, [*KEYS, "grp"]).where(F.col("barline_score") >= least)
    barlines = scored.select("name", F.floor("center_x").cast("int").alias("x"), F.col("barline_score").alias("score"))
    staffs = checkpoint(islands.systems_of_five(lines.join(spacing, "name"), KEYS, F.col("spacing") * config.staff_system_grouping_ratio))
    five = staffs.select("name", F.col("system_idx").alias("staff"), F.explode("lines").alias("y"))
    alone = lines.join(five.select("name", "y"), ["name", "y"], "left_anti").select("name", F.lit(-1).alias("staff"), "y")
    each = five.unionByName(alone).groupBy("name", "staff").agg(F.collect_list("y").alias("lines"))
    places = each.groupBy("name").agg(F.collect_list("lines").alias("staffs")).withColumn("lines", F.array_distinct(F.flatten("staffs")))
    margins = validation.intersection_margin(lines.distinct(), KEYS, config)
    return kernels.standing(masks.where("bits is not null"), barlines.join(places, "name").join(margins, "name"))


def in_shares(measures: DataFrame, pages: DataFrame) -> DataFrame:
    """measures with their box as shares of the page: bbox (x, y, width, height) from 0 to 1."""
    sized = measures.join(pages.select("name", F.col("width").alias("__w"), F.col("height").alias("__h")), "name")
    share = F.struct(*[(F.col(f"bbox.{c}") / F.col("__w" if c in ("x", "width") else "__h")).alias(c) for c in ("x", "y", "width", "height")])
    return sized.withColumn("bbox", share).drop("__w", "__h")


def document_report(measures: DataFrame, symbols: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """totals and documents of whole documents: pages (doc, page), measures (doc, page, group_idx, measure_number, system_idx), symbols (doc, page, id, class_name, x1).

    A page has the measures of its groups, the number of its symbols, and the
    most likely of its time signatures.
    """
    keys = ["doc", "page"]
    count = aggregates.group_measures(measures, keys).groupBy(*keys).agg(F.sum("measure_count").alias("measures"))
    sigs = symbols.where(F.lower("class_name").contains("timesig"))
    found = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("symbols"), F.count(F.when(F.lower("class_name").contains("timesig"), 1)).alias("time_signatures"))
    likely = aggregates.likely_signature(sigs, keys, "id").select(*keys, "signature")
    each = pages.select(*keys).distinct().join(count, keys, "left").join(found, keys, "left").join(likely, keys, "left").na.fill(0, ["measures", "symbols", "time_signatures"])
    return {"pages": each, "totals": aggregates.document_totals(each, ["doc"]), "documents": sinks.document_results(each, ["doc"])}


def played(measures: DataFrame, detections: DataFrame, bpm: int = 120) -> DataFrame:
    """(doc, page, group_idx, measure_number, beat, at_ms): every beat of a document, by the signatures found on its pages."""
    signed = signatures.per_measure(measures, detections)
    return windows.beats(signed, ["doc"], ["page", "group_idx", "measure_number"], bpm=bpm).select("doc", "page", "group_idx", "measure_number", "beat", "at_ms")
