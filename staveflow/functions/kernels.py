"""Pixel kernels in numpy, and the column functions that run them page by page."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pixels of lines that the line search walks at a time.
LINE_PIXELS = 1 << 20
#: Rows of a frame that leaves a task, and masks of one.
LOT, MASK_LOT = 8192, 64


def in_lots(rows: Iterable[tuple], names: list[str], lot: int = LOT) -> Iterator[pd.DataFrame]:
    """Rows as frames of a bounded number of rows; a frame a page would cost more than what is done for the page."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, lot)):
        yield pd.DataFrame(part, columns=names)


def threshold_inverse(gray: np.ndarray, level: int = 200) -> np.ndarray:
    """Dark pixels: at or under the level."""
    return gray <= level


def smooth(gray: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian (1 2 1), borders mirrored without the edge, rounded."""
    pad = np.pad(gray.astype(np.uint16), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    rows = pad[1:-1] * 2
    rows += pad[:-2]
    rows += pad[2:]
    out = rows[:, 1:-1] * 2
    out += rows[:, :-2]
    out += rows[:, 2:]
    out += 8
    out >>= 4
    return out.astype(np.uint8)


def otsu_level(gray: np.ndarray) -> int:
    """The level with the largest variance between the two classes; the first of equal ones."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def otsu_inverse(gray: np.ndarray) -> np.ndarray:
    soft = smooth(gray)
    return soft <= otsu_level(soft)


def runs(line: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of all runs of true values, row by row."""
    height, wide = mask.shape[0], mask.shape[1] + 1
    line = np.zeros(height * wide + 1, bool)
    line[1:].reshape(height, wide)[:, :-1] = mask
    at = np.flatnonzero(line[1:] != line[:-1])
    row = at[::2] // wide
    return row, at[::2] - row * wide, at[1::2] - 1 - row * wide


def _filled(shape: tuple[int, int], row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs that don't overlap, as a mask."""
    edge = np.zeros((shape[0], shape[1] + 1), np.int8)
    np.add.at(edge, (row, first), 1)
    np.add.at(edge, (row, last + 1), -1)
    return np.cumsum(edge, axis=1, dtype=np.int8)[:, :-1] > 0


def opened_rows(mask: np.ndarray, length: int = 50) -> np.ndarray:
    """The horizontal runs of at least `length` pixels: an opening by a line."""
    out = np.zeros_like(mask)
    some = np.flatnonzero(mask.sum(1) >= length)
    row, first, last = row_runs(mask[some])
    long = last - first + 1 >= length
    out[some] = _filled((len(some), mask.shape[1]), row[long], first[long], last[long])
    return out


def peaks(values: np.ndarray, height: float, distance: int = 2) -> list[int]:
    """Local maxima of at least `height`: the middle of flat tops, and of those nearer than `distance` the higher (the later of equals) stays."""
    found, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j < n - 1 and values[j + 1] == values[i]:
                j += 1
            if j < n - 1 and values[j + 1] < values[i]:
                found.append((i + j) // 2)
                i = j
        i += 1
    found = [p for p in found if values[p] >= height]
    keep = [True] * len(found)
    for k in sorted(range(len(found)), key=lambda k: values[found[k]])[::-1]:
        if keep[k]:
            for other in range(len(found)):
                if other != k and abs(found[other] - found[k]) < distance:
                    keep[other] = False
    return [p for p, ok in zip(found, keep, strict=True) if ok]


def staff_peaks(mask: np.ndarray, length: int = 50) -> list[int]:
    """Rows where the projection of long horizontal runs peaks."""
    return _peak_rows(opened_rows(mask, length))


def _peak_rows(long: np.ndarray) -> list[int]:
    rows = long.sum(1).astype(float)
    if not rows.any():
        return []
    rows /= rows.max()
    return peaks(rows, max(0.1, 0.5 * rows[rows > 0].mean()))


def vertical_segments(mask: np.ndarray, min_length: int, max_gap: int, slope: int = 1) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of upright strokes: column runs with gaps closed, each joined with an overlapping one at most `slope` columns on.

    It stands in for a probabilistic line search, which has no exact result to match: it is repeatable and finds strokes of the same least length and largest gap.
    """
    out: list[tuple[int, int, int, int]] = []
    open_: list[list[int]] = []
    for x in range(mask.shape[1]):
        now: list[list[int]] = []
        for a, b in runs(mask[:, x]):
            if now and a - now[-1][1] - 1 <= max_gap:
                now[-1][1] = b
            else:
                now.append([a, b])
        # what is short in every column is no upright stroke
        now = [r for r in now if r[1] - r[0] + 1 >= max(2, min_length // 3)]
        used = set()
        for s in open_:
            for k, (a, b) in enumerate(now):
                if k not in used and a <= s[3] and b >= s[1] and x - s[2] <= slope:
                    s[1], s[2], s[3] = min(s[1], a), x, max(s[3], b)
                    used.add(k)
                    break
        done = [s for s in open_ if x - s[2] > slope]
        out += [tuple(s) for s in done if s[3] - s[1] + 1 >= min_length]
        open_ = [s for s in open_ if x - s[2] <= slope] + [[x, a, x, b] for k, (a, b) in enumerate(now) if k not in used]
    return sorted(out + [tuple(s) for s in open_ if s[3] - s[1] + 1 >= min_length])


def _shifts(height: int, tolerance: int) -> tuple[list[int], np.ndarray]:
    """Whole degrees from the most upright on, and by degree the columns that a line is off its middle row at each row."""
    angles = sorted(range(-tolerance, tolerance + 1), key=lambda a: (abs(a), a))
    return angles, np.rint(np.tan(np.radians(angles))[:, None] * (np.arange(height) - height // 2)[None, :]).astype(np.int32)


def line_votes(mask: np.ndarray, tolerance: int = 20) -> tuple[list[int], np.ndarray]:
    """Degrees, and by degree and column at the middle row the number of pixels on that line."""
    angles, shifts = _shifts(mask.shape[0], tolerance)
    return angles, _run_votes(shifts, *row_runs(mask), mask.shape[1])


def _run_votes(shifts: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """The votes of row runs: one more from each run's first column on, one less behind its last."""
    table = np.zeros((len(shifts), width), np.int32)
    step = max(1, LINE_PIXELS // max(1, len(row)))
    for k in range(0, len(shifts), step):
        off = shifts[k : k + step][:, row]
        base = (np.arange(len(off)) * (width + 1))[:, None]
        on, behind = (np.bincount(((edge[None, :] - off).clip(0, width) + base).ravel(), minlength=len(off) * (width + 1)) for edge in (first, last + 1))
        table[k : k + step] = np.cumsum((on - behind).reshape(len(off), width + 1), axis=1)[:, :width]
    return table


def line_segments(mask: np.ndarray, votes: int, min_length: int, max_gap: int, tolerance: int = 20) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of straight strokes within tolerance degrees of upright, y1 at most y2.

    A line search that always gives the same answer: each pixel votes for the
    lines through it, one for each whole degree and column at the middle row;
    the line with the most votes (then the most upright one, then the one
    farthest to the left) is walked from top to bottom, gaps up to max_gap are
    closed, parts of min_length are strokes, and its pixels vote no more: only
    their own votes, one a degree, are taken back, so a line costs as much as
    it has pixels; where many go at once, the runs that are left are counted
    anew, which is less. Lines of one degree share no pixel, so those of it
    that have the most votes come one after the other, and are walked together.
    """
    height, width = mask.shape
    if not height or not width:
        return []
    left, rows, out = mask.copy(), np.arange(height), []
    angles, shifts = _shifts(height, tolerance)
    found = row_runs(left)
    table = _run_votes(shifts, *found, width)
    reach = int(np.abs(shifts).max())
    degree = np.arange(len(angles))[:, None]
    together = max(1, LINE_PIXELS // height)
    while True:
        k, x = divmod(int(table.argmax()), width)
        if table[k, x] < max(1, votes):
            return sorted(out)
        columns = x + np.flatnonzero(table[k, x:] == table[k, x])[:together]
        if angles[k]:
            at = columns[:, None] + shifts[k]
            on = np.flatnonzero((at >= 0) & (at < width) & left[rows, at.clip(0, width - 1)])
        else:
            on = np.flatnonzero(left[:, columns].T)
        line = on // height
        ys = on - line * height
        xs = columns[line] + shifts[k, ys]
        breaks = np.flatnonzero((np.diff(ys) > max_gap + 1) | (np.diff(line) > 0))
        first, last = np.append(0, breaks + 1), np.append(breaks, len(ys) - 1)
        long = ys[last] - ys[first] + 1 >= min_length
        first, last = first[long], last[long]
        out += zip(xs[first].tolist(), ys[first].tolist(), xs[last].tolist(), ys[last].tolist(), strict=True)
        left[ys, xs] = False
        if len(ys) > 2 * len(found[0]) + left.size // 128:
            found = row_runs(left)
            table = _run_votes(shifts, *found, width)
            continue
        # their votes fall within reach of them
        lo, wide = int(xs.min()) - reach, int(np.ptp(xs)) + 2 * reach + 1
        gone = np.bincount((degree * wide + (xs - lo)[None, :] - shifts[:, ys]).ravel(), minlength=len(angles) * wide).reshape(-1, wide)
        a, b = max(0, lo), min(width, lo + wide)
        table[:, a:b] -= gone[:, a - lo : b - lo]


def has_horizontal_element(mask: np.ndarray, x: int, y: int, window: int = 15, length: int = 8, least: int = 5) -> bool:
    """Whether at least `least` pixels near (x, y) lie in horizontal runs of `length`, as at a bracket's ends."""
    part = mask[max(0, y - window) : y + window + 1, max(0, x - window) : x + window + 1]
    return int(opened_rows(part, length).sum()) >= least if part.size else False


def resampling(old: int, new: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), a row for each new pixel of a side: the old pixels that it takes from and how much of each; a sparse matrix with as many entries a row.

    Kinds: area (means over what a new pixel covers, for making smaller), linear
    and cubic (between centres; cubic with a slope of -0.75), nearest. Beyond
    the edge counts the pixel at the edge.
    """
    if kind == "area":
        edge = np.arange(new + 1) * (old / new)
        first = np.floor(edge[:-1]).astype(int)
        place = first[:, None] + np.arange(int(np.ceil(old / new)) + 1)[None, :]
        weight = np.clip(np.minimum(place + 1, edge[1:, None]) - np.maximum(place, edge[:-1, None]), 0, None) / (old / new)
        return np.minimum(place, old - 1), weight
    at = (np.arange(new) + 0.5) * old / new
    if kind == "nearest":
        return at.astype(int).clip(0, old - 1)[:, None], np.ones((new, 1))
    low = np.floor(at - 0.5).astype(int)
    reach = np.arange(2) if kind == "linear" else np.arange(-1, 3)
    place = low[:, None] + reach[None, :]
    far = np.abs((at - 0.5)[:, None] - place)
    if kind == "linear":
        weight = 1 - far
    else:
        slope = -0.75
        near = ((slope + 2) * far - (slope + 3)) * far * far + 1
        weight = np.where(far <= 1, near, ((slope * far - 5 * slope) * far + 8 * slope) * far - 4 * slope)
    return place.clip(0, old - 1), weight


def resampled(gray: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """An image in another size, one side after the other."""

    def along(a: np.ndarray, new: int) -> np.ndarray:
        place, weight = resampling(a.shape[0], new, kind)
        out = np.zeros((new, a.shape[1]))
        for k in range(place.shape[1]):
            out += a[place[:, k]] * weight[:, k, None]
        return out

    return np.clip(np.rint(along(along(gray, height).T, width).T), 0, 255).astype(np.uint8)


def scaled(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over areas for making an image smaller, cubic for making it larger on some side."""
    return resampled(gray, width, height, "area" if width <= gray.shape[1] and height <= gray.shape[0] else "cubic")


def on_canvas(gray: np.ndarray, scale: float, width: int, height: int, pad: int = 255) -> np.ndarray:
    """The image scaled (means below 1, cubic above), centred on a canvas; what hangs over is cut off on both sides."""
    h, w = max(1, int(gray.shape[0] * scale)), max(1, int(gray.shape[1] * scale))
    image = scaled(gray, w, h)
    out = np.full((height, width), pad, np.uint8)
    y, x = (height - h) // 2, (width - w) // 2
    part = image[max(0, -y) : max(0, -y) + height, max(0, -x) : max(0, -x) + width]
    out[max(0, y) : max(0, y) + part.shape[0], max(0, x) : max(0, x) + part.shape[1]] = part
    return out


def letterboxed(gray: np.ndarray, size: int, pad: int = 255, kind: str = "nearest") -> np.ndarray:
    """The longer side scaled to size, the other padded evenly; the same transform as geometry.letterbox. kind: a kind of resampling()."""
    scale = size / max(gray.shape)
    h, w = max(1, int(gray.shape[0] * scale)), max(1, int(gray.shape[1] * scale))
    out = np.full((size, size), pad, np.uint8)
    y, x = (size - h) // 2, (size - w) // 2
    out[y : y + h, x : x + w] = resampled(gray, w, h, kind)
    return out


def adaptive_inverse(gray: np.ndarray, block: int = 11, offset: int = 2) -> np.ndarray:
    """Darker than the mean of the block around, less an offset; borders repeat the edge."""
    r = block // 2
    pad = np.pad(gray.astype(np.int64), r, mode="edge")
    total = np.pad(pad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    mean = (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)
    return gray <= mean - offset


def closed_columns(mask: np.ndarray, length: int = 3) -> np.ndarray:
    """Vertical gaps shorter than `length` filled."""
    column, first, last = row_runs(mask.T)
    short = (column[1:] == column[:-1]) & (first[1:] - last[:-1] - 1 < length)
    return mask | _filled(mask.T.shape, column[:-1][short], last[:-1][short] + 1, first[1:][short] - 1).T


def _gray(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(int(row.height), int(row.width))


def page_staff_peaks(pages: DataFrame, length: int = 50, otsu: bool = True) -> DataFrame:
    """(name, y, x_start, x_end) of staff-line rows of pages (name, width, height, pixels)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                mask = otsu_inverse(_gray(row)) if otsu else threshold_inverse(_gray(row))
                long = opened_rows(mask, length)
                for y in staff_peaks(mask, length):
                    x = np.flatnonzero(long[y])
                    out.append((row.name, y, int(x[0]) if len(x) else 0, int(x[-1]) if len(x) else int(row.width) - 1))
            yield pd.DataFrame(out, columns=["name", "y", "x_start", "x_end"])

    return pages.where("pixels is not null").select("name", "width", "height", "pixels").mapInPandas(run, "name string, y int, x_start int, x_end int")


def page_segments(pages: DataFrame, min_length: int, max_gap: int = 3, otsu: bool = True) -> DataFrame:
    """(name, x1, y1, x2, y2) of upright strokes of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                mask = otsu_inverse(_gray(row)) if otsu else threshold_inverse(_gray(row))
                out += [(row.name, *s) for s in vertical_segments(mask, min_length, max_gap)]
            yield pd.DataFrame(out, columns=["name", "x1", "y1", "x2", "y2"])

    return pages.where("pixels is not null").select("name", "width", "height", "pixels").mapInPandas(run, "name string, x1 int, y1 int, x2 int, y2 int")


def page_crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(name, crop_id, width, height, pixels) of boxes (name, crop_id, x, y, w, h), clipped to the page. The boxes of a page, a few numbers each, go to it together; its pixels are in one row once, and crops leave one by one."""
    wanted = boxes.groupBy("name").agg(F.collect_list(F.struct(F.col("crop_id").cast("string").alias("crop_id"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")])).alias("boxes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                gray = _gray(row)
                for b in row.boxes:
                    cut = gray[max(0, b["y"]) : max(0, b["y"] + b["h"]), max(0, b["x"]) : max(0, b["x"] + b["w"])]
                    yield pd.DataFrame({"name": [row.name], "crop_id": [b["crop_id"]], "width": [cut.shape[1]], "height": [cut.shape[0]], "pixels": [cut.tobytes()]})

    rows = pages.where("pixels is not null").select("name", "width", "height", "pixels").join(wanted, "name")
    return rows.mapInPandas(run, "name string, crop_id string, width int, height int, pixels binary")


def packed_mask(mask: np.ndarray) -> bytes:
    """A mask at a bit a pixel, compressed."""
    return zlib.compress(np.packbits(mask, axis=1).tobytes(), 1)


def unpacked_mask(bits: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8).reshape(height, -(-width // 8)), axis=1, count=width).view(bool)


MASKS = "name string, width int, height int, bits binary, dark long, peaks array<struct<y: int, x_start: int, x_end: int>>"


def page_mask(gray: np.ndarray, length: int = 50, otsu: bool = True) -> tuple[bytes, int, list[tuple[int, int, int]]]:
    """(bits, dark pixels, (y, x_start, x_end) of staff-line rows) of a page."""
    mask = otsu_inverse(gray) if otsu else threshold_inverse(gray)
    long = opened_rows(mask, length)
    found = []
    for y in _peak_rows(long):
        x = np.flatnonzero(long[y])
        found.append((y, int(x[0]) if len(x) else 0, int(x[-1]) if len(x) else gray.shape[1] - 1))
    return packed_mask(mask), int(mask.sum()), found


def page_masks(pages: DataFrame, length: int = 50, otsu: bool = True) -> DataFrame:
    """(name, width, height, bits, dark, peaks) of pages (name, width, height, pixels): each is thresholded once; what is asked of its pixels later is asked of the bits. Pages without pixels are left out."""

    def one(row) -> tuple:
        bits, dark, found = page_mask(_gray(row), length, otsu)
        return row.name, int(row.width), int(row.height), bits, dark, [{"y": y, "x_start": a, "x_end": b} for y, a, b in found]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_lots((one(row) for part in parts for row in part.itertuples()), ["name", "width", "height", "bits", "dark", "peaks"], MASK_LOT)

    return pages.where("pixels is not null").select("name", "width", "height", "pixels").mapInPandas(run, MASKS)


def _asked(masks: DataFrame, questions: DataFrame, answer: Callable[[np.ndarray, list], list[tuple]], schema: str) -> DataFrame:
    """answer(mask, questions of the page) to rows (name, ...): questions, a few a page, travel to the page's bits."""
    cols = [c for c in questions.columns if c != "name"]
    wanted = questions.groupBy("name").agg(F.collect_list(F.struct(*cols)).alias("asked"))
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = (row for part in parts for row in part.itertuples())
        found = ((row.name, *x) for row in pages for x in answer(unpacked_mask(row.bits, int(row.width), int(row.height)), list(row.asked)))
        yield from in_lots(found, names)

    # the pages' partitions do the work: were they the side that is sent to the few partitions of the questions, a few tasks would do it all
    return masks.select("name", "width", "height", "bits").join(wanted.hint("shuffle_hash"), "name").mapInPandas(run, schema)


def strokes(masks: DataFrame, areas: DataFrame) -> DataFrame:
    """(name, area, x1, y1, x2, y2, hooked) of upright strokes in parts of pages, in the page's coordinates; hooked: a horizontal element at both ends.

    areas: (name, area, x_from, x_to, y_from, y_to, threshold, min_length, max_gap, tolerance) in whole numbers; x_to null is the page's edge.
    """

    def answer(mask: np.ndarray, asked: list) -> list[tuple]:
        out = []
        for r in asked:
            x, y = max(0, r["x_from"]), max(0, r["y_from"])
            cut = mask[y : r["y_to"], x : (r["x_to"] if r["x_to"] >= 0 else mask.shape[1])]
            for a, b, c, d in line_segments(cut, r["threshold"], r["min_length"], r["max_gap"], r["tolerance"]):
                hooked = r["hooks"] and has_horizontal_element(mask, a + x, b + y) and has_horizontal_element(mask, c + x, d + y)
                out.append((r["area"], a + x, b + y, c + x, d + y, bool(hooked)))
        return out

    whole = [F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in ("area", "x_from", "x_to", "y_from", "y_to", "threshold", "min_length", "max_gap", "tolerance")]
    hooks = F.col("hooks") if "hooks" in areas.columns else F.lit(True)
    return _asked(masks, areas.select("name", *whole, hooks.alias("hooks")), answer, "name string, area int, x1 int, y1 int, x2 int, y2 int, hooked boolean")


def probed(masks: DataFrame, spots: DataFrame, margin: int = 2) -> DataFrame:
    """(name, area, x, crossed, reached) of spots (name, area, x, lines, top, bottom): how many staff lines have a set pixel in the column within margin rows, and whether the first and the last row do."""

    def answer(mask: np.ndarray, asked: list) -> list[tuple]:
        out = []
        for r in asked:
            set_at = lambda y, column: bool(column[max(0, y - margin) : max(0, y + margin + 1)].any())
            column = mask[:, r["x"]] if 0 <= r["x"] < mask.shape[1] else np.zeros(0, bool)
            out.append((r["area"], r["x"], sum(set_at(y, column) for y in set(r["lines"])), set_at(r["top"], column) and set_at(r["bottom"], column)))
        return out

    whole = [F.col(c).cast("int").alias(c) for c in ("area", "x", "top", "bottom")]
    return _asked(masks, spots.select("name", *whole, F.col("lines").cast("array<int>").alias("lines")), answer, "name string, area int, x int, crossed int, reached boolean")


def page_pixels(pages: DataFrame, otsu: bool = True) -> DataFrame:
    """(name, y, x) of the dark pixels of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                y, x = np.nonzero(otsu_inverse(_gray(row)) if otsu else threshold_inverse(_gray(row)))
                yield pd.DataFrame({"name": row.name, "y": y.astype("int32"), "x": x.astype("int32")})

    return pages.where("pixels is not null").select("name", "width", "height", "pixels").mapInPandas(run, "name string, y int, x int")


def over_staff(mask: np.ndarray, x: int, lines: list[int], reach: int = 10, crossed: int = 4, thickest: int = 6) -> bool:
    """validation.valid_for_staff of one column and staff."""
    column, top, bottom = mask[:, x], min(lines), max(lines)
    fits = ((a, b) for a, b in runs(column) if b - a + 1 >= (bottom - top) * 0.5 and a <= top + reach and b >= bottom - reach)
    if not (first := next(fits, None)):
        return False
    a, b = first
    if sum(bool(column[max(0, y - 1) : y + 2].any()) for y in set(lines) if a - 3 <= y <= b + 3) < crossed:
        return False
    thick = 1
    for side in (x + i for i in (1, -1, 2, -2, 3, -3)):
        if not 0 <= side < mask.shape[1] or mask[a : b + 1, side].mean() < 0.3:
            break
        thick += 1
    return thick <= thickest


def standing(masks: DataFrame, spots: DataFrame, least: int = 3) -> DataFrame:
    """(name, x, score) of the spots (name, x, score, lines, staffs, margin) that validation.valid_on_page lets stand: lines and staffs (each with its lines) are the page's, margin the rows around a line that count for it. A page's pixels stay where they are."""

    def stands(mask: np.ndarray, r: dict) -> bool:
        if not 0 <= r["x"] < mask.shape[1] or sum(bool(mask[max(0, y - r["margin"]) : y + r["margin"] + 1, r["x"]].any()) for y in r["lines"]) < least:
            return False
        return len(r["lines"]) < 5 or any(len(s) >= 5 and over_staff(mask, r["x"], [int(y) for y in s]) for s in r["staffs"])

    def answer(mask: np.ndarray, asked: list) -> list[tuple]:
        return [(r["x"], r["score"]) for r in asked if stands(mask, r)]

    whole = [F.col(c).cast("int").alias(c) for c in ("x", "score", "margin")]
    return _asked(masks, spots.select("name", *whole, F.col("lines").cast("array<int>").alias("lines"), F.col("staffs").cast("array<array<int>>").alias("staffs")), answer, "name string, x int, score int")
