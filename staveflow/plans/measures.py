"""From staff lines and barlines to numbered measures: the relational heart of a page's analysis, without pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions.geometry import measure_id
from ..operators import aggregates, islands, joins, windows

NARROWEST = 20


def page_systems(lines: DataFrame, config: DetectionConfig = DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """Systems of five lines with their group on the page; each page stands for itself. lines: (page, y)."""
    keys = keys or ["page"]
    spacing = islands.median_spacing(lines, keys, "y")
    systems = islands.systems_of_five(lines.join(spacing, keys), keys, F.col("spacing") * config.staff_system_grouping_ratio)
    gaps = windows.gaps_and_jumps(systems, keys, "center_y").select(*keys, "gap")
    level = islands.adaptive_threshold(gaps.join(spacing, keys), keys, F.col("spacing"), config.system_group_clustering_ratio)
    limit = spacing.join(level, keys, "left").select(*keys, F.coalesce("threshold", F.lit(100.0)).alias("threshold"))
    return islands.system_groups(systems, keys, limit)


def agreed_barlines(barlines: DataFrame, systems: DataFrame, config: DetectionConfig = DEFAULT, keys: list[str] | None = None, tolerance: int | None = None) -> DataFrame:
    """Barlines (page, system_idx, x) on which enough systems of a group agree; neighbours belong together up to the tolerance, by default 5, or a share of the page's mean line spacing where systems have avg_spacing and tolerance is negative."""
    keys = keys or ["page"]
    if tolerance is not None and tolerance < 0:
        near = systems.groupBy(*keys).agg(F.floor(F.avg("avg_spacing") * config.barline_consensus_tolerance).alias("__near"))
        barlines, limit = barlines.join(near, keys), F.col("__near")
    else:
        limit = F.lit(5 if tolerance is None else tolerance)
    rows = barlines.join(systems.select(*keys, "system_idx", "group_idx"), [*keys, "system_idx"])
    clusters = islands.islands(rows.withColumn("__o", F.struct("x", "system_idx")), [*keys, "group_idx"], "x", F.col("__gap") > limit, "cluster").drop("__o")
    return aggregates.consensus(clusters, systems, keys, config.min_consensus_ratio)


def measures(barlines: DataFrame, systems: DataFrame, brackets: DataFrame | None = None, keys: list[str] | None = None, narrowest: int = NARROWEST) -> DataFrame:
    """Measures of agreed barlines (page, group_idx, x): intervals from the group's bracket on, on each of its systems, narrow ones left out before numbering."""
    keys = keys or ["page"]
    groups = systems.groupBy(*keys, "group_idx").agg(F.sort_array(F.collect_list("system_idx")).alias("systems"))
    start = groups.withColumn("bracket_x", F.lit(0)) if brackets is None else joins.first_overlapping(groups, brackets, keys)
    spans = windows.intervals(barlines, [*keys, "group_idx"], start.join(barlines.select(*keys, "group_idx").distinct(), [*keys, "group_idx"], "left_semi"))
    wide = spans.where(F.col("x_end") - F.col("x_start") >= narrowest)
    ranged = windows.y_ranges(systems, keys)
    rows = windows.numbered(wide.join(ranged, [*keys, "group_idx"]), [*keys, "system_idx"], ["x_start", "x_end"])
    inside = F.filter(F.transform("lines", lambda y, i: F.struct((y - F.col("y_top")).alias("y"), y.alias("original_y"), i.alias("staff_index"))), lambda s: (s["y"] >= 0) & (s["y"] < F.col("y_bottom") - F.col("y_top")))
    box = F.struct(F.col("x_start").alias("x"), F.col("y_top").alias("y"), (F.col("x_end") - F.col("x_start")).alias("width"), (F.col("y_bottom") - F.col("y_top")).alias("height"))
    return rows.select(measure_id(F.col("page") if "page" in keys else F.lit(1), "system_idx", "measure_number").alias("measure_id"), *keys, "system_idx", "group_idx", "measure_number", box.alias("bbox"), inside.alias("staff_lines"))


def brackets(segments: DataFrame, systems: DataFrame, keys: list[str] | None = None, x_tolerance: float = 50, y_gap: float = 100, slack: float = 20) -> DataFrame:
    """Brackets of upright left-edge segments (page, x, y1, y2) with the systems they cover; pos is their order from the left."""
    from ..operators import folds

    keys = keys or ["page"]
    upright = folds.extent_clusters(folds.anchor_groups(segments, keys, "x", x_tolerance, "gx"), [*keys, "gx"], "y1", "y2", y_gap, "gy")
    merged = aggregates.bracket_merge(upright, [*keys, "gx", "gy"])
    found = joins.contained(merged, systems.select(*keys, "system_idx", "top", "bottom"), keys, slack)
    out = found.groupBy(*keys, "gx", "gy", "x", "y_start", "y_end").agg(F.sort_array(F.collect_list("system_idx")).alias("covered_systems"))
    return windows.numbered(out, keys, ["x", "y_start"], "pos").drop("gx", "gy")
