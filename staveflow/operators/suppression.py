"""Greedy suppression as a walk over boxes in order of rank, with the boxes kept so far of one key at hand.

Whether a box stays depends only on those that were kept before it, and kept
boxes overlap each other little, so they are few where boxes are crowded. Pairs
of boxes are never rows. Rows come a batch at a time, sorted by key and rank.
A slice of them is checked against the kept boxes of its key, which lie in
grids by size, and then within itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a step of the walk, candidates looked at together.
SLICE, TOGETHER = 256, 1 << 20
_WIDE = np.int64(1) << np.int64(31)


def _cells(v: np.ndarray, side: float) -> np.ndarray:
    return np.clip(np.floor(v / side), -(1 << 30), 1 << 30).astype(np.int64)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boxes (x1, y1, x2, y2) along the first axis; 0 for boxes that don't overlap."""
    w = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    h = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((w > 0) & (h > 0) & (union > 0), both / union, -1.0)


class _Grid:
    """Kept boxes of one size class, sorted by the cell of their upper left corner."""

    def __init__(self, boxes: np.ndarray, side: float) -> None:
        cell = _cells(boxes[1], side) * _WIDE + _cells(boxes[0], side)
        order = np.argsort(cell, kind="stable")
        self.side, self.cell, self.boxes = side, cell[order], boxes[:, order]
        self.reach = (boxes[2] - boxes[0]).max(), (boxes[3] - boxes[1]).max()

    def hits(self, asked: np.ndarray, overlap: float) -> np.ndarray:
        """Whether a box meets one of the grid's by overlap or more."""
        x1, y1, x2, y2 = asked
        left, right = _cells(x1 - self.reach[0], self.side), _cells(x2, self.side)
        top, bottom = _cells(y1 - self.reach[1], self.side), _cells(y2, self.side)
        rows = bottom - top + 1
        of = np.repeat(np.arange(len(x1)), rows)
        y = top[of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
        first = np.searchsorted(self.cell, y * _WIDE + left[of], "left")
        many = np.searchsorted(self.cell, y * _WIDE + right[of], "right") - first
        out, ends = np.zeros(len(x1), bool), np.cumsum(many)
        a = 0
        while a < len(of):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, "right")))
            n = many[a:b]
            place = np.repeat(first[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            box = np.repeat(of[a:b], n)
            out[box[_iou(asked[:, box], self.boxes[:, place]) >= overlap]] = True
            a = b
        return out


class _Kept:
    """The kept boxes of a key, by size class: many in a grid that is seldom built anew, the latest in one of their own."""

    def __init__(self, overlap: float) -> None:
        self.overlap, self.of = overlap, {}

    def add(self, boxes: np.ndarray) -> None:
        kind = self.kinds(boxes)
        for c in np.unique(kind).tolist():
            old, late = self.of.get(c, (None, None))
            new, side = boxes[:, kind == c], 4.0**c
            late = new if late is None else np.hstack([late.boxes, new])
            if late.shape[1] > 1000 + (old.boxes.shape[1] // 8 if old else 0):
                self.of[c] = (_Grid(np.hstack([old.boxes, late]) if old else late, side), None)
            else:
                self.of[c] = (old, _Grid(late, side))

    @staticmethod
    def kinds(boxes: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(boxes[2] - boxes[0], boxes[3] - boxes[1])) / 2).astype(int)

    def hits(self, boxes: np.ndarray) -> np.ndarray:
        size = np.maximum(boxes[2] - boxes[0], boxes[3] - boxes[1])
        out = np.zeros(len(size), bool)
        for c, grids in self.of.items():
            # boxes that share that much are no more than that much apart in size; an eighth more is looked at
            side, least = 4.0**c, max(self.overlap, 1e-3) / 1.125
            for grid in grids:
                if grid is not None:
                    ask = np.flatnonzero(~out & (size >= side * least) & (size * least <= 4 * side))
                    if len(ask):
                        out[ask] = grid.hits(boxes[:, ask], self.overlap)
        return out


def _within(unit: np.ndarray, boxes: np.ndarray, overlap: float) -> np.ndarray:
    """Which rows of a slice stay, if nothing came before it."""
    stays = np.ones(len(unit), bool)
    met = np.triu((_iou(boxes[:, :, None], boxes[:, None, :]) >= overlap) & (unit[:, None] == unit[None, :]), 1)
    for i in np.flatnonzero(met.any(axis=1)).tolist():
        if stays[i]:
            stays &= ~met[i]
    return stays


def kept(batches: Iterator[pa.RecordBatch], overlap: float) -> Iterator[pa.RecordBatch]:
    """Rows that stay, of batches sorted by key and rank whose last six columns are the key's hash, whether the row takes part, and the box in double."""
    now, held = None, _Kept(overlap)
    for batch in batches:
        n = batch.num_columns - 6
        unit, part, *corners = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(6))
        boxes, stays = np.array(corners), ~part.astype(bool)
        rows = np.flatnonzero(~stays)
        for a in range(0, len(rows), SLICE):
            at = rows[a : a + SLICE]
            u = unit[at]
            left = np.ones(len(at), bool)
            same = np.flatnonzero(u == now) if now is not None else at[:0]
            if len(same):
                left[same[held.hits(boxes[:, at[same]])]] = False
            at = at[left]
            good = at[_within(unit[at], boxes[:, at], overlap)]
            stays[good] = True
            if u[-1] != now:
                now, held = u[-1], _Kept(overlap)
            good = good[unit[good] == now]
            if len(good):
                held.add(boxes[:, good])
        out = pa.RecordBatch.from_arrays(batch.columns[:n], schema=pa.schema([batch.schema.field(i) for i in range(n)]))
        yield out.filter(pa.array(stays))
