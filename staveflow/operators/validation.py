"""Which barline candidates stand: span, bounds, coverage, crossings and thickness as joins and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, DetectionConfig
from ..functions.geometry import staff_coverage
from . import folds, islands

DEFAULT_SPACING = 12.0


def spans_staff(y_min="y_min", y_max="y_max", top="top", bottom="bottom", spacing="spacing", config: DetectionConfig = DEFAULT, max_length: Column | None = None) -> Column:
    """Whether a group's extent reaches both outer lines within the margins, goes not too far beyond, and isn't over a length."""
    y_min, y_max, top, bottom = map(F.col, (y_min, y_max, top, bottom))
    gap = F.coalesce(F.col(spacing), F.lit(DEFAULT_SPACING))
    reaches = (y_min <= top + gap * config.barline_top_margin_ratio) & (y_max >= bottom - gap * config.barline_bottom_margin_ratio)
    beyond = gap * config.barline_max_allowed_extension_ratio
    ok = reaches & (y_min >= top - beyond) & (y_max <= bottom + beyond)
    return ok if max_length is None else ok & (y_max - y_min + 1 <= max_length)


def group_extents(segments: DataFrame, keys: list[str]) -> DataFrame:
    """y_min and y_max over both ends of a group's segments."""
    return segments.groupBy(*keys).agg(F.min(F.least("y1", "y2")).alias("y_min"), F.max(F.greatest("y1", "y2")).alias("y_max"))


def within_bounds(barlines: DataFrame, extents: DataFrame, keys: list[str], margin: int = 50) -> DataFrame:
    """Barlines (x) between the first start and last end of their staff's lines, widened by margin; all of a staff without known extents."""
    e = extents.groupBy(*keys).agg(F.min("x_start").alias("__a"), F.max("x_end").alias("__b"))
    inside = F.col("x").between(F.col("__a") - margin, F.col("__b") + margin)
    return barlines.join(e, keys, "left").where(F.coalesce(inside, F.lit(True))).drop("__a", "__b")


def best_covering_run(candidates: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (x, top, bottom) with the column run (y_start, y_end) that covers most of the staff; the first of equal ones, none without coverage."""
    met = candidates.join(runs, [*keys, "x"]).withColumn("coverage", staff_coverage("y_start", "y_end", "top", "bottom")).where("coverage > 0")
    best = met.groupBy(*[c for c in candidates.columns]).agg(F.min(F.struct((-F.col("coverage")).alias("c"), "y_start", "y_end")).alias("b"))
    return best.select(*candidates.columns, F.col("b.y_start").alias("y_start"), F.col("b.y_end").alias("y_end"), (-F.col("b.c")).alias("coverage"))


def covers_staff(candidates: DataFrame, runs: DataFrame, keys: list[str], config: DetectionConfig = DEFAULT) -> DataFrame:
    """Candidates (x, top, bottom, spacing) whose best run isn't longer than the staff and its extension."""
    longest = F.col("bottom") - F.col("top") + (F.coalesce(F.col("spacing"), F.lit(DEFAULT_SPACING)) * config.barline_max_extension_ratio).cast("int")
    return best_covering_run(candidates, runs, keys).where(F.col("y_end") - F.col("y_start") + 1 <= longest)


def valid_for_staff(candidates: DataFrame, pixels: DataFrame, lines: DataFrame, keys: list[str], reach: int = 10, crossed: int = 4, thickest: int = 6) -> DataFrame:
    """Candidates (staff, x, top, bottom) with a run over the staff, crossings with enough of its lines (staff, y), and few covered columns beside.

    The run is at least half as long as the staff is high and starts and ends
    within reach of it; the first such run counts. Columns beside count while
    they cover 30 percent of the run.
    """
    ids = [*keys, "staff", "x"]
    runs = islands.vertical_runs(pixels, [*keys, "x"])
    fits = (F.col("y_end") - F.col("y_start") + 1 >= (F.col("bottom") - F.col("top")) * 0.5) & (F.col("y_start") <= F.col("top") + reach) & (F.col("y_end") >= F.col("bottom") - reach)
    first = candidates.join(runs, [*keys, "x"]).where(fits).groupBy(*ids).agg(F.min(F.struct("y_start", "y_end")).alias("r")).select(*ids, "r.*")
    near = first.join(lines, [*keys, "staff"]).where("y between y_start - 3 and y_end + 3").select(*ids, "y")
    hit = near.select(*ids, "y", F.explode(F.array(*[F.col("y") + i for i in (-1, 0, 1)])).alias("__y")).join(pixels.withColumnRenamed("y", "__y"), [*keys, "x", "__y"], "left_semi")
    crossing = hit.groupBy(*ids).agg(F.countDistinct("y").alias("n")).where(F.col("n") >= crossed).select(*ids)
    good = first.join(crossing, ids)
    offsets = F.explode(F.array(*[F.lit(i) for i in (1, -1, 2, -2, 3, -3)]))
    side = good.withColumn("offset", offsets).withColumn("__x", F.col("x") + F.col("offset"))
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}") == F.col(f"p.{k}") for k in keys], (F.col("s.__x") == F.col("p.x")) & F.col("p.y").between(F.col("s.y_start"), F.col("s.y_end")))
    filled = side.alias("s").join(pixels.alias("p"), on, "left").groupBy(*[F.col(f"s.{c}").alias(c) for c in [*ids, "offset", "y_start", "y_end"]]).agg(F.count("p.y").alias("n"))
    covered = filled.withColumn("covered", F.col("n") / (F.col("y_end") - F.col("y_start") + 1))
    thin = folds.thickness(covered, ids).where(F.col("thickness") <= thickest).select(*ids)
    return candidates.join(thin, ids, "left_semi")


def filter_barlines(candidates: DataFrame, valid: DataFrame, keys: list[str], distance: int = 15) -> DataFrame:
    """x of candidates that some staff validates, once each and at least `distance` apart."""
    return folds.last_kept(candidates.join(valid.select(*keys, "x").distinct(), [*keys, "x"], "left_semi"), keys, "x", distance)


def tuned_parameters(density="density", spacing="spacing", width="width") -> list[Column]:
    """Settings of a line search from a page's ink density, line spacing and width."""
    d, s = F.col(density), F.coalesce(F.col(spacing), F.lit(DEFAULT_SPACING))
    whole = lambda low, v: F.greatest(F.lit(low), v.cast("int"))
    return [whole(5, d * 10).alias("threshold"), whole(3, s * 0.3).alias("min_length"), whole(2, s * 0.2).alias("max_gap"), whole(5, F.col(width) * 0.005).alias("x_tolerance"), F.when(d < 0.1, 25).otherwise(15).alias("angle_tolerance")]


def bracket_parameters(systems: DataFrame, keys: list[str], pad: int = 50) -> DataFrame:
    """Rows and settings of the bracket search: the systems' extent with a margin, 1.5 times the lowest system, half the mean spacing."""
    return systems.groupBy(*keys).agg(F.greatest(F.lit(0), F.min("top") - pad).alias("y_from"), (F.max("bottom") + pad).alias("y_to"), (F.min("height") * 1.5).cast("int").alias("min_length"), (F.avg("avg_spacing") * 0.5).cast("int").alias("max_gap"))


def intersection_margin(lines: DataFrame, keys: list[str], config: DetectionConfig = DEFAULT) -> DataFrame:
    """(keys, margin): rows around a staff line that count for it, a share of the median spacing under 30 (or of the default), 2 at least."""
    spacing = islands.median_spacing(lines, keys, "y", under=30)
    pages = lines.select(*keys).distinct().join(spacing, keys, "left")
    share = F.coalesce("spacing", F.lit(DEFAULT_SPACING)) * config.barline_roi_margin_ratio
    return pages.select(*keys, F.greatest(F.lit(2), share.cast("int")).alias("margin"))


def crossings(barlines: DataFrame, pixels: DataFrame, lines: DataFrame, keys: list[str], config: DetectionConfig = DEFAULT) -> DataFrame:
    """(keys, id, x, y): the staff lines (y) of the page that have a set pixel in the barline's own column within the margin."""
    near = lines.join(intersection_margin(lines, keys, config), keys).select(*keys, "y", F.explode(F.sequence(F.col("y") - F.col("margin"), F.col("y") + F.col("margin"))).alias("__y"))
    column = barlines.select(*keys, "id", "x").join(pixels.withColumnRenamed("y", "__y"), [*keys, "x"])
    return column.join(near, [*keys, "__y"]).select(*keys, "id", "x", "y").distinct()


def valid_on_page(barlines: DataFrame, pixels: DataFrame, staffs: DataFrame, keys: list[str], config: DetectionConfig = DEFAULT, least: int = 3) -> DataFrame:
    """Barlines (id, x) that cross `least` lines of the page, and one whole staff of five (staff, y) if the page has five lines."""
    lines = staffs.select(*keys, "y").distinct()
    enough = crossings(barlines, pixels, lines, keys, config).groupBy(*keys, "id", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    five = staffs.groupBy(*keys, "staff").agg(F.count(F.lit(1)).alias("k"), F.min("y").alias("top"), F.max("y").alias("bottom")).where("k >= 5")
    candidates = enough.select(*keys, "x").distinct().join(five.select(*keys, "staff", "top", "bottom"), keys)
    whole = valid_for_staff(candidates, pixels, staffs, keys).select(*keys, "x").distinct()
    many = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("__lines"))
    found = enough.join(many, keys).join(whole.withColumn("__whole", F.lit(True)), [*keys, "x"], "left").where("__whole or __lines < 5")
    return barlines.join(found.select(*keys, "id"), [*keys, "id"], "left_semi")


def reaches_both_lines(groups: DataFrame, pixels: DataFrame, keys: list[str], margin: int = 2) -> DataFrame:
    """Groups (x, top, bottom) with a set pixel in their column within margin of the first and of the last staff line."""
    spots = groups.select(*keys, "x", "top", "bottom").distinct()
    rows = lambda line: spots.select("*", F.explode(F.sequence(F.col(line) - margin, F.col(line) + margin)).alias("y")).join(pixels, [*keys, "x", "y"], "left_semi").select(*spots.columns).distinct()
    both = rows("top").join(rows("bottom"), spots.columns, "left_semi")
    return groups.join(both, spots.columns, "left_semi")


def well_formed(candidates: DataFrame, box: str = "box", n: int = 4) -> DataFrame:
    """Candidates whose box is a list of n numbers."""
    return candidates.where((F.size(box) == n) & ~F.exists(box, lambda v: v.isNull()))
