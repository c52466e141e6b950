"""Ordered steps: intervals, numbering, carrying on, prefix sums, gaps to neighbours, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import numbering


def intervals(barlines: DataFrame, keys: list[str], first: DataFrame | None = None, x: str = "x") -> DataFrame:
    """(keys, x_start, x_end) of neighbouring barlines; `first` (keys, bracket_x) puts one more start before them."""
    rows = barlines.select(*keys, F.col(x).alias("x"))
    if first is not None:
        rows = rows.union(first.select(*keys, F.col("bracket_x").alias("x")))
    nxt = F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))
    return rows.select(*keys, F.col("x").alias("x_start"), nxt.alias("x_end")).where("x_end is not null")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "measure_number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, default: str, name: str | None = None) -> DataFrame:
    """The last value so far, or the default before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name or value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Sum of the values of all rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def y_ranges(systems: DataFrame, keys: list[str], order: str = "system_idx") -> DataFrame:
    """y_top and y_bottom of each system (top, bottom): half the gap to each neighbour, a whole height at the page's ends, not above 0 (nor below page_height where there is such a column)."""
    w = Window.partitionBy(*keys).orderBy(order)
    above, below = F.lag("bottom").over(w), F.lead("top").over(w)
    height = F.col("bottom") - F.col("top")
    up = F.when(above.isNull(), height).otherwise(F.floor((F.col("top") - above) / 2))
    down = F.when(below.isNull(), height).otherwise(F.floor((below - F.col("bottom")) / 2))
    end = F.col("bottom") + down
    return systems.withColumn("y_top", F.greatest(F.lit(0), F.col("top") - up)).withColumn("y_bottom", F.least("page_height", end) if "page_height" in systems.columns else end)


def gaps_and_jumps(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """First differences in order of x, and second differences of the sorted first ones."""
    w = Window.partitionBy(*keys).orderBy(x)
    gaps = rows.select(*keys, F.col(x), (F.col(x) - F.lag(x).over(w)).alias("gap")).where("gap is not null")
    by_gap = Window.partitionBy(*keys).orderBy("gap", x)
    return gaps.withColumn("jump", F.col("gap") - F.lag("gap").over(by_gap)).withColumn("gap_rank", F.row_number().over(by_gap))


def dense_ids(rows: DataFrame, ident: str, name: str = "dense_id") -> DataFrame:
    """Numbers from 0 by the ids' numeric order; equal ids have one number, null comes first."""
    key = F.col(ident).cast("int").alias("__key")
    places = numbering.numbered(rows.select(key).distinct(), [F.col("__key")], "__place").select(F.col("__key").alias("__of"), "__place")
    out = rows.join(places, F.col(ident).cast("int").eqNullSafe(F.col("__of")), "left")
    return out.withColumn(name, F.col("__place").cast("int")).drop("__of", "__place")


def first_occurrence_numbers(barlines: DataFrame, keys: list[str], x: str = "x", name: str = "number") -> DataFrame:
    """Barlines numbered from 1 by distinct x, on the first system that has each."""
    first = barlines.groupBy(*keys, x).agg(F.min("system_idx").alias("system_idx"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(x)))


def tiles(pages: DataFrame, tile: int = 1024, overlap: int = 128, width: str = "width", height: str = "height") -> DataFrame:
    """pages times the tiles (tile_x, tile_y) that cover them; the last offset of a side is clamped so that the tile ends with the page."""
    step = tile - overlap
    starts = lambda side: F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(side) - tile) / step).cast("int")), F.lit(1)), lambda i: F.least(i * step, F.greatest(F.lit(0), F.col(side).cast("int") - tile)))))
    return pages.withColumn("tile_x", F.explode(starts(width))).withColumn("tile_y", F.explode(starts(height)))


def beats(measures: DataFrame, keys: list[str], order: list[str], count: str = "beats", bpm: int = 120) -> DataFrame:
    """One row for each beat of each measure, with its number and start in milliseconds since the first."""
    total = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = measures.withColumn("__before", F.coalesce(F.sum(count).over(total), F.lit(0)))
    out = before.withColumn("beat", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    return out.withColumn("at_ms", (F.col("__before") + F.col("beat") - 1) * int(60000 / bpm)).drop("__before")


def contiguous_pages(pages: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Pages from the first on, up to the first missing one."""
    w = Window.partitionBy(*keys).orderBy(page)
    run = pages.withColumn("__r", F.col(page) - F.row_number().over(w)).withColumn("__f", F.min("__r").over(Window.partitionBy(*keys)))
    return run.where("__r = __f").drop("__r", "__f")


def with_y_ranges(rows: DataFrame, systems: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """rows (system_idx, top, bottom) with y_top and y_bottom of their system; of their own height a share more on both sides where the page has no such system."""
    found = y_ranges(systems, keys).select(*keys, "system_idx", F.col("y_top").alias("__t"), F.col("y_bottom").alias("__b"))
    more = ((F.col("bottom") - F.col("top")) * share).cast("int")
    out = rows.join(found, [*keys, "system_idx"], "left")
    return out.withColumn("y_top", F.coalesce("__t", F.greatest(F.lit(0), F.col("top") - more))).withColumn("y_bottom", F.coalesce("__b", F.col("bottom") + more)).drop("__t", "__b")


def playing_order(measures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, group_idx, measure_number, position, next_page, next_group, next_measure): the measures of groups in the order in which they are played, through all measures of a group, then the next group, then the next page; nothing follows the last."""
    per = measures.select(*keys, "page", "group_idx", "measure_number").distinct()
    w = Window.partitionBy(*keys).orderBy("page", "group_idx", "measure_number")
    ahead = lambda c, n: F.lead(c).over(w).alias(n)
    return per.select("*", F.row_number().over(w).alias("position"), ahead("page", "next_page"), ahead("group_idx", "next_group"), ahead("measure_number", "next_measure"))
