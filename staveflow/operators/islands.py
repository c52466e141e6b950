"""Gap-based clustering: gaps and islands over windows, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], x: str, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 0 within keys in order of x; a row starts a run where `breaks` holds (it may use __gap, the distance to the row before)."""
    w = Window.partitionBy(*keys).orderBy(x)
    gap = df.withColumn("__gap", F.col(x) - F.lag(x).over(w))
    start = gap.withColumn("__new", F.when(F.col("__gap").isNull(), 0).otherwise(breaks.cast("int")))
    return start.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__gap", "__new")


def clusters_by_gap(df: DataFrame, keys: list[str], x: str, max_gap: float | Column, name: str = "island", strict: bool = False) -> DataFrame:
    """A gap of more than max_gap (strict: of max_gap or more) starts a cluster."""
    limit = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    return islands(df, keys, x, F.col("__gap") >= limit if strict else F.col("__gap") > limit, name)


def keep_sizes(df: DataFrame, keys: list[str], least: int, most: int | None = None) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    sized = df.withColumn("__n", n).where(F.col("__n") >= least)
    return (sized if most is None else sized.where(F.col("__n") <= most)).drop("__n")


def staffs_from_peaks(peaks: DataFrame, keys: list[str], ratio: float = 2.5, least: int = 4) -> DataFrame:
    """Peaks (y) whose distance to the one before is under ratio times the median short spacing share a staff; staffs of 4 lines at least stay."""
    spacing = median_spacing(peaks, keys, "y", under=30)
    joined = peaks.join(spacing, keys, "left")
    return keep_sizes(clusters_by_gap(joined, keys, "y", F.coalesce("spacing", F.lit(10.0)) * ratio, "staff", strict=True), [*keys, "staff"], least)


def median_spacing(df: DataFrame, keys: list[str], x: str, under: float | None = None) -> DataFrame:
    """(keys, spacing): the median distance of neighbours, if asked only of those under a bound."""
    w = Window.partitionBy(*keys).orderBy(x)
    gaps = df.select(*keys, (F.col(x) - F.lag(x).over(w)).alias("gap")).where("gap is not null")
    gaps = gaps if under is None else gaps.where(F.col("gap") < under)
    return gaps.groupBy(*keys).agg(F.median("gap").cast("double").alias("spacing"))


def systems_of_five(lines: DataFrame, keys: list[str], max_gap: float | Column, y: str = "y", size: int = 5) -> DataFrame:
    """(keys, system_idx, lines, top, bottom, center_y, height, avg_spacing): runs cut into chunks of five lines; other chunks are dropped."""
    run = clusters_by_gap(lines, keys, y, max_gap, "run")
    at = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(y)) - 1
    chunks = run.withColumn("chunk", F.floor(at / size)).groupBy(*keys, "run", "chunk").agg(F.array_sort(F.collect_list(y)).alias("lines"))
    whole = chunks.where(F.size("lines") == size)
    top, bottom = F.array_min("lines"), F.array_max("lines")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("run", "chunk")) - 1
    return whole.select(*keys, order.cast("int").alias("system_idx"), "lines", top.alias("top"), bottom.alias("bottom"), F.floor((top + bottom) / 2).alias("center_y"), (bottom - top).alias("height"), ((bottom - top) / F.lit(float(size - 1))).alias("avg_spacing"))


def strided_groups(df: DataFrame, keys: list[str], order: str, size: int = 5, name: str = "stride") -> DataFrame:
    """Chunks of `size` rows by position."""
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size))


def vertical_runs(pixels: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """(keys, y_start, y_end): maximal runs of consecutive y."""
    return clusters_by_gap(pixels, keys, y, 1, "run").groupBy(*keys, "run").agg(F.min(y).alias("y_start"), F.max(y).alias("y_end")).drop("run")


def horizontal_opening(pixels: DataFrame, length: int, keys: list[str] | None = None) -> DataFrame:
    """Pixels (page, y, x) in horizontal runs of at least `length`."""
    keys = keys or ["page", "y"]
    return keep_sizes(clusters_by_gap(pixels, keys, "x", 1, "run"), [*keys, "run"], length).drop("run")


def adaptive_threshold(gaps: DataFrame, keys: list[str], spacing: float | Column, ratio: float = 8.0, default_ratio: float = 8.0, jump: float = 50.0) -> DataFrame:
    """(keys, threshold) of the gaps between staff systems.

    From six gaps on: the middle of the widest jump between sorted gaps if it
    is over `jump` (a ratio set by hand wins), else their 60th percentile; from
    three on 1.3 times the median; else ratio times the spacing. The first of
    equally wide jumps counts.
    """
    spacing = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    w = Window.partitionBy(*keys).orderBy("gap", "__id")
    rows = gaps.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("low", F.lag("gap").over(w)).withColumn("at", F.row_number().over(w))
    widest = F.max(F.when(F.col("low").isNotNull(), F.struct((F.col("gap") - F.col("low")).alias("width"), (-F.col("at")).alias("at"), ((F.col("gap") + F.col("low")) / 2.0).alias("middle"))))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), widest.alias("widest"), F.expr("percentile(gap, 0.6)").alias("q60"), F.median("gap").alias("mid"), F.max(spacing).alias("spacing"))
    by_ratio = F.col("spacing") * ratio
    by_jump = by_ratio if abs(ratio - default_ratio) > 0.5 else F.col("widest.middle")
    many = F.when(F.col("widest.width") > jump, by_jump).otherwise(F.col("q60"))
    return stats.select(*keys, F.when(F.col("n") >= 6, many).when(F.col("n") >= 3, F.col("mid") * 1.3).otherwise(by_ratio).alias("threshold"))


def system_groups(systems: DataFrame, keys: list[str], threshold: DataFrame) -> DataFrame:
    """Adds group_idx: systems whose centres lie no farther apart than the page's threshold."""
    return clusters_by_gap(systems.join(threshold, keys), keys, "center_y", F.col("threshold"), "group_idx").drop("threshold")
