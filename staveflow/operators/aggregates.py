"""Group statistics, consensus votes and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import barline_score


def line_groups(lines: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Means and population deviations of grouped segments (center_x, center_y, length, angle), with barline_score.

    A deviation that lies on a step of the score falls to one side or the other
    by how its sums were rounded. With `order`, a column, deviations are taken
    up in its order, so that partitions don't decide; a group's numbers, those
    of the strokes of one candidate, are then an array.
    """
    deviation = lambda c: F.stddev_pop(c) if order is None else _deviation(c, order)
    stats = lines.groupBy(*keys).agg(
        F.avg("center_x").alias("center_x"), deviation("center_x").alias("x_std"), F.sum("length").alias("total_length"), F.count(F.lit(1)).alias("line_count"),
        (F.max("center_y") - F.min("center_y")).alias("y_coverage"), F.avg("angle").alias("avg_angle"), deviation("angle").alias("angle_std"),
    )
    return stats.withColumn("barline_score", barline_score())


def _deviation(column: str, order: str) -> Column:
    """The population deviation by a mean that is moved value by value, in order."""
    values = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).cast("double").alias("v")))))
    init = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, r: Column) -> Column:
        mean = acc["mean"] + (r["v"] - acc["mean"]) / (acc["n"] + 1)
        return F.struct((acc["n"] + 1).alias("n"), mean.alias("mean"), (acc["squares"] + (r["v"] - mean) * (r["v"] - acc["mean"])).alias("squares"))

    return F.aggregate(values, init, step, lambda acc: F.when(acc["n"] > 0, F.sqrt(acc["squares"] / acc["n"])))


def consensus(barlines: DataFrame, systems: DataFrame, keys: list[str], ratio: float = 0.8, pad: int = 10) -> DataFrame:
    """Clusters of barlines (keys, group_idx, cluster, system_idx, x) in which enough of the group's systems agree.

    systems: (keys, group_idx, system_idx, top, bottom). Enough is the whole part of ratio times the systems, one at least.
    """
    group = systems.groupBy(*keys, "group_idx").agg(F.count(F.lit(1)).alias("group_size"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    votes = barlines.groupBy(*keys, "group_idx", "cluster").agg(F.sort_array(F.collect_set("system_idx")).alias("systems"), F.floor(F.avg("x")).alias("x"))
    need = F.greatest(F.lit(1), F.floor(F.col("group_size") * ratio))
    agreed = votes.join(group, [*keys, "group_idx"]).where(F.size("systems") >= need)
    return agreed.select(*keys, "group_idx", "x", (F.col("top") - pad).alias("y_start"), (F.col("bottom") + pad).alias("y_end"), F.size("systems").alias("consensus_count"), "group_size", "systems")


def measure_counts(barlines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measures): one less than the most barlines of a system, none under two."""
    per = barlines.groupBy(*keys, "system_idx").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy(*keys).agg(F.max("n").alias("n"))
    return most.select(*keys, F.when(F.col("n") >= 2, F.col("n") - 1).otherwise(0).alias("measures"))


def bracket_merge(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Median x, smallest and largest y of each bracket cluster."""
    return segments.groupBy(*keys).agg(F.median("x").cast("int").alias("x"), F.min("y1").alias("y_start"), F.max("y2").alias("y_end"))


def class_frequency(annotations: DataFrame, cls: str = "cls") -> DataFrame:
    """(class, n, rank): by count, ties by class."""
    counts = annotations.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), cls)).cast("long"))


def class_balance(annotations: DataFrame, cls: str = "cls", high: float = 0.5, low: float = 0.01) -> DataFrame:
    """(class, n, share, weight, imbalance, advice): weight is the inverse root of the share, imbalance the largest over the smallest count."""
    everything = Window.partitionBy()
    counts = annotations.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(everything)
    out = counts.select(cls, "n", share.alias("share"), (F.max("n").over(everything) / F.min("n").over(everything)).alias("imbalance"))
    advice = F.when(F.col("share") > high, "dominant").when(F.col("share") < low, "rare").otherwise("fine")
    return out.withColumn("weight", 1 / F.sqrt("share")).withColumn("advice", advice)


def per_image_counts(annotations: DataFrame, image: str = "image", cls: str = "cls") -> DataFrame:
    return annotations.groupBy(image, cls).agg(F.count(F.lit(1)).alias("n"))


def processing_summary(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: processed, kept, rejected and the share kept, in one pass."""
    kept = F.count(F.when(F.col(reason).isNull(), 1))
    return rows.agg(F.count(F.lit(1)).alias("processed"), kept.alias("kept"), F.count(reason).alias("rejected"), (kept * 100.0 / F.count(F.lit(1))).alias("kept_percent"))


def orientation_summary(rows: DataFrame, label: str = "orientation", ratio: str = "ratio") -> DataFrame:
    everything = Window.partitionBy()
    out = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("avg_ratio"))
    return out.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(everything))


def scale_summary(detections: DataFrame, key: str = "scale") -> DataFrame:
    return detections.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"), F.countDistinct("cls").alias("classes"))


def best_by_composite(summary: DataFrame, key: str = "scale") -> DataFrame:
    """One row: the key of the best composite (0.4 total, 0.4 mean confidence, 0.2 classes, each over its largest) and of each metric; the smallest key wins ties."""
    w = Window.partitionBy()
    part = lambda c: F.col(c) / F.max(c).over(w)
    scored = summary.withColumn("composite", part("total") * 0.4 + part("avg_confidence") * 0.4 + part("classes") * 0.2)
    first = lambda c: F.min_by(key, F.struct(-F.col(c), key))
    return scored.agg(first("composite").alias("best"), first("total").alias("most_detections"), first("avg_confidence").alias("highest_confidence"), first("classes").alias("most_classes"), F.max("composite").alias("composite"))


def majority(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one seen first."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first"))).alias("m")).select(*keys, F.col(f"m.{value}").alias(value), F.col("m.n").alias("votes"))


def combined_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes (x, y, w, h) of a key."""
    out = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b"))
    return out.select(*keys, "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"))


def line_extents(pixels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """First and last x of the lines (keys), the whole width for a line without pixels (x null)."""
    return pixels.groupBy(*keys).agg(F.coalesce(F.min("x"), F.lit(0)).alias("x_start"), F.coalesce(F.max("x"), F.lit(width - 1)).alias("x_end"))


def row_projection(pixels: DataFrame, page: str = "page", y: str = "y", floor: float = 0.1, share: float = 0.5) -> DataFrame:
    """(page, y, n, norm, is_line): set pixels a row over the page's largest, and whether that reaches the page's threshold."""
    rows = pixels.groupBy(page, y).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(page)
    norm = rows.withColumn("norm", F.col("n") / F.max("n").over(w))
    return norm.withColumn("is_line", F.col("norm") >= F.greatest(F.lit(floor), F.avg("norm").over(w) * share))


def document_totals(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, measures, symbols, time_signatures, common_signature) of pages (page, measures, symbols, time_signatures, signature): sums, and the most frequent signature (the one of the earliest page wins ties), 'Not detected' where no page has one."""
    totals = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).alias(c) for c in ("measures", "symbols", "time_signatures")])
    common = majority(pages.where("signature is not null"), keys, "signature", "page").select(*keys, F.col("signature").alias("common_signature"))
    return totals.join(common, keys, "left").withColumn("common_signature", F.coalesce("common_signature", F.lit("Not detected")))


def likely_signature(found: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, class_name, votes, signature, beats): the most frequent class of a page (the first seen of equals), read as a signature; one that isn't known is its own name without timeSig, with four beats."""
    best = majority(found, keys, "class_name", pos)
    known = F.col("class_name").isin("timeSig4", "timeSigCommon")
    return best.withColumn("signature", F.when(known, "4/4").otherwise(F.replace("class_name", F.lit("timeSig"), F.lit("")))).withColumn("beats", F.lit(4))


def group_measures(measures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_idx, measure_count, system_count): the last measure number of a group and its number of systems."""
    return measures.groupBy(*keys, "group_idx").agg(F.max("measure_number").alias("measure_count"), F.countDistinct("system_idx").alias("system_count"))


def barlines_by_group(barlines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, group_idx, xs): the x of a group's barlines in order."""
    return barlines.groupBy(*keys, "group_idx").agg(F.sort_array(F.collect_list("x")).alias("xs"))


def leftmost(symbols: DataFrame, keys: list[str], x: str = "x1") -> DataFrame:
    """The symbol farthest to the left of each key, ties by the other columns."""
    rest = [c for c in symbols.columns if c not in (*keys, x)]
    return symbols.groupBy(*keys).agg(F.min(F.struct(x, *rest)).alias("__m")).select(*keys, *[F.col("__m")[c].alias(c) for c in (x, *rest)])


def page_summary(systems: DataFrame, barlines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, staff_lines, systems, groups, barlines, measures) of a page: what was found on it, and the measures of the system with the most barlines."""
    found = systems.groupBy(*keys).agg(F.sum(F.size("lines")).alias("staff_lines"), F.count(F.lit(1)).alias("systems"), F.countDistinct("group_idx").alias("groups"))
    bars = barlines.groupBy(*keys).agg(F.count(F.lit(1)).alias("barlines")).join(measure_counts(barlines, keys), keys)
    return found.join(bars, keys, "left").na.fill(0, ["barlines", "measures"])


def ink_density(pixels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, density): set pixels (x, y from 1) over the area down to the last row that has one."""
    return pixels.groupBy(*keys).agg((F.count(F.lit(1)) / (F.lit(float(width)) * F.max("y"))).alias("density"))
