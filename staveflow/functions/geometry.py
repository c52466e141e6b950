"""Geometry of segments and boxes as column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | float | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def segment_metrics(x1="x1", y1="y1", x2="x2", y2="y2") -> list[Column]:
    """center_x, center_y (floors), length, and the signed angle in degrees (90 for an upright one)."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    return [
        F.floor((x1 + x2) / 2).alias("center_x"),
        F.floor((y1 + y2) / 2).alias("center_y"),
        F.sqrt(dx * dx + dy * dy).alias("length"),
        F.when(dx == 0, 90.0).otherwise(F.degrees(F.atan(dy / dx))).alias("angle"),
    ]


def unsigned_angle(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.abs(F.degrees(F.atan2(y2 - y1, x2 - x1)))


def is_vertical(angle="angle", tolerance: float = 15.0, strict: bool = False) -> Column:
    bound = F.lit(90.0 - tolerance)
    return F.abs(_c(angle)) > bound if strict else F.abs(_c(angle)) >= bound


def corner_to_center(x, y, w, h, width, height) -> Column:
    """(x, y, w, h) in pixels to a normalised centre box."""
    x, y, w, h, width, height = map(_c, (x, y, w, h, width, height))
    return F.struct(((x + w / 2) / width).alias("xc"), ((y + h / 2) / height).alias("yc"), (w / width).alias("w"), (h / height).alias("h"))


def corners_to_center(x1, y1, x2, y2, width, height, clipped: bool = True) -> Column:
    """Two corners in pixels to a normalised centre box; absolute sizes, each value clipped to 0..1."""
    x1, y1, x2, y2, width, height = map(_c, (x1, y1, x2, y2, width, height))
    parts = {"xc": (x1 + x2) / 2 / width, "yc": (y1 + y2) / 2 / height, "w": F.abs(x2 - x1) / width, "h": F.abs(y2 - y1) / height}
    return F.struct(*[(clip(v) if clipped else v).alias(k) for k, v in parts.items()])


def letterbox(x1, y1, x2, y2, width, height, size: int) -> Column:
    """Corners after scaling the longer side to size and padding the other evenly by whole pixels."""
    x1, y1, x2, y2, width, height = map(_c, (x1, y1, x2, y2, width, height))
    scale = size / F.greatest(width, height)
    dx = F.floor((size - (width * scale).cast("int")) / 2)
    dy = F.floor((size - (height * scale).cast("int")) / 2)
    return F.struct((x1 * scale + dx).alias("x1"), (y1 * scale + dy).alias("y1"), (x2 * scale + dx).alias("x2"), (y2 * scale + dy).alias("y2"))


def iou(a: str, b: str) -> Column:
    """Intersection over union of two struct columns x1, y1, x2, y2; 0 for boxes that don't overlap."""
    w = F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1"))
    h = F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1"))
    both = w * h
    area = lambda c: (F.col(f"{c}.x2") - F.col(f"{c}.x1")) * (F.col(f"{c}.y2") - F.col(f"{c}.y1"))
    union = area(a) + area(b) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(both / union)


def aspect(w, h) -> Column:
    """Width over height; infinite for no height."""
    return F.when(_c(h) > 0, _c(w) / _c(h)).otherwise(F.lit(float("inf")))


def orientation(w, h, vertical: float = 0.5, horizontal: float = 2.0) -> Column:
    r = aspect(w, h)
    return F.when(r < vertical, "VERTICAL").when(r > horizontal, "HORIZONTAL").otherwise("SQUARE")


def staff_coverage(y_start, y_end, top, bottom, margin: int = 10) -> Column:
    """Share of a staff's height with margins that a vertical span covers."""
    low, high = F.greatest(_c(y_start), _c(top) - margin), F.least(_c(y_end), _c(bottom) + margin)
    return F.greatest(F.lit(0), high - low) / (_c(bottom) - _c(top) + 2 * margin)


def to_ratio(v, whole) -> Column:
    return _c(v) / _c(whole)


def to_pixels(r, whole) -> Column:
    return (_c(r) * _c(whole)).cast("int")


def measure_id(page, system, number) -> Column:
    return F.format_string("P%d_%02d_%03d", _c(page), _c(system), _c(number))


def beat_interval_ms(bpm) -> Column:
    return (F.lit(60000) / _c(bpm)).cast("int")


def barline_score(x_std="x_std", count="line_count", coverage="y_coverage", angle_std="angle_std") -> Column:
    """0 to 100: points for upright alignment, number of lines, coverage and one angle."""
    steps = lambda v, *rules: F.coalesce(*[F.when(test(_c(v)), F.lit(points)) for test, points in rules], F.lit(0))
    return F.least(
        F.lit(100),
        steps(x_std, (lambda v: v < 2, 30), (lambda v: v < 5, 20), (lambda v: v < 10, 10))
        + steps(count, (lambda v: v.between(3, 8), 25), (lambda v: v >= 2, 15))
        + steps(coverage, (lambda v: v > 40, 25), (lambda v: v > 20, 15))
        + steps(angle_std, (lambda v: v < 5, 20), (lambda v: v < 10, 10)),
    )


def hough_parameters(height, spacing, config) -> list[Column]:
    """Whole-number settings of the line search: votes from a staff system's height, lengths from its line spacing."""
    height, spacing = _c(height), _c(spacing)
    return [
        F.greatest(F.lit(5), (height * 0.2).cast("int")).alias("threshold"),
        F.greatest(F.lit(3), (spacing * config.hough_min_line_length_ratio).cast("int")).alias("min_length"),
        F.greatest(F.lit(2), (spacing * config.hough_max_line_gap_ratio).cast("int")).alias("max_gap"),
    ]


def center_box_valid(xc="xc", yc="yc", w="w", h="h") -> Column:
    xc, yc, w, h = map(_c, (xc, yc, w, h))
    return xc.between(0, 1) & yc.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1) & (xc - w / 2 >= 0) & (xc + w / 2 <= 1) & (yc - h / 2 >= 0) & (yc + h / 2 <= 1)


def rejection(x1, y1, x2, y2, width, height, min_size: float = 1.0) -> Column:
    """Why a pixel box is rejected, or null: outside the page, no area, too small."""
    x1, y1, x2, y2, width, height = map(_c, (x1, y1, x2, y2, width, height))
    outside = (x1 < 0) | (y1 < 0) | (x2 > width) | (y2 > height)
    return F.when(outside, "original_bounds").when((x1 >= x2) | (y1 >= y2), "final_bounds").when((x2 - x1 < min_size) | (y2 - y1 < min_size), "too small")


def box_to_pixels(box: str, width, height) -> Column:
    """An array [x1, y1, x2, y2] of shares of the page, in whole pixels."""
    return F.transform(_c(box), lambda v, i: to_pixels(v, F.when(i % 2 == 0, _c(width)).otherwise(_c(height))))


def boxes_to_pixels(boxes: str, names: list[str], width, height) -> Column:
    """An array of structs with the fields names, those that begin with x or y in whole pixels instead of shares of the page; other fields stay."""
    return F.transform(_c(boxes), lambda b: F.struct(*[to_pixels(b[n], width if n[0] == "x" else height).alias(n) if n[0] in "xy" else b[n].alias(n) for n in names]))


def page_fit(width, height, size: int, smaller: bool = True) -> Column:
    """struct(scale, x, y): a page scaled by the smaller (or larger) ratio of size to its sides and centred on a square; x and y are negative where it hangs over."""
    width, height = _c(width), _c(height)
    scale = (F.least if smaller else F.greatest)(size / width, size / height)
    return F.struct(scale.alias("scale"), F.floor((size - (width * scale).cast("int")) / 2).alias("x"), F.floor((size - (height * scale).cast("int")) / 2).alias("y"))
