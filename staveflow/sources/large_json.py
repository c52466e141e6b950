"""Large JSON documents as rows: one a member of a document's top-level maps and lists, wherever in the file it lies.

A document is not a row here but byte ranges of RANGE_BYTES, and each is read by
its own task, in blocks. Where a range begins in the structure follows from
sums over the ranges before it:

1. A range counts its quotes and, for both cases (it begins inside a string or
   outside), how many brackets it leaves open. Running sums over the ranges of
   a file, one row each, tell the case and the depth at which each begins.
2. With that known, a range finds the last top-level name in it; the last one
   before a range is the section that it begins in.
3. A range gives out the members that begin in it, and reads on past its end to
   where its last one ends.

No task holds more than a block and a member. Files are opened by range through
pyarrow's file systems. Texts of members are parsed by Spark with a given
schema. Scalars at the top level are no members.
"""

from __future__ import annotations

import json.decoder
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .committed import filesystem

RANGE_BYTES, BLOCK_BYTES, BEYOND_BYTES = 64 << 20, 1 << 20, 1 << 14
_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


class _Blocks:
    """Blocks of a file from a position on, with the quotes that aren't escaped."""

    def __init__(self, file, at: int, size: int, hi: int) -> None:
        self.file, self.at, self.size, self.hi = file, at, size, hi
        back = 64
        while True:  # an odd run of backslashes before the range escapes its first byte
            file.seek(max(0, at - back))
            before = file.read(min(back, at))
            run = len(before) - len(before.rstrip(b"\\"))
            if run < len(before) or len(before) == at:
                break
            back *= 8
        self.escaped = run % 2 == 1

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        while self.at < self.size:
            self.file.seek(self.at)
            # no more than the range; behind it, where its last member ends, a little at a time
            block = min(BLOCK_BYTES, self.hi - self.at) if self.at < self.hi else min(BLOCK_BYTES, BEYOND_BYTES)
            block = np.frombuffer(self.file.read(min(block, self.size - self.at)), np.uint8)
            quotes = block == _QUOTE
            slash = block == _BACKSLASH
            if slash.any():
                edge = np.diff(np.concatenate([[0], slash.astype(np.int8), [0]]))
                first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                odd = (after - first - (self.escaped & (first == 0))) % 2 == 1
                quotes[after[odd & (after < len(block))]] = False
                carried = bool(len(after) and after[-1] == len(block) and odd[-1])
            else:
                carried = False
            if self.escaped and not slash[0]:
                quotes[0] = False
            self.escaped = carried
            yield self.at, block, quotes
            self.at += len(block)


def _counted(file, lo: int, hi: int, size: int) -> tuple[int, int, int]:
    """(quotes, brackets left open if the range begins outside a string, and if inside)."""
    n, outside, inside = 0, 0, 0
    for at, block, quotes in _Blocks(file, lo, size, hi):
        block, quotes = block[: max(0, hi - at)], quotes[: max(0, hi - at)]
        if not len(block):
            break
        within = (n + np.cumsum(quotes)) % 2 == 1
        step = _STEP[block]
        inside += int(step[within].sum())
        outside += int(step[~within].sum())
        n += int(quotes.sum())
    return n, outside, inside


def _borders(file, lo: int, size: int, quoted: bool, depth: int, sections_only: bool = False, hi: int | None = None) -> Iterator[tuple[int, np.ndarray, list[tuple[int, str | None]]]]:
    """(position, block, borders) of blocks from lo on: a border is (place in the block, name of the section that opens after it; None for the border of a member)."""
    section = None
    for at, block, quotes in _Blocks(file, lo, size, size if hi is None else hi):
        before = quoted + np.cumsum(quotes) - quotes
        outside = before % 2 == 0  # an opening quote counts as outside
        step = np.where(outside & ~quotes, _STEP[block], 0)
        deep = depth + np.cumsum(step, dtype=np.int64)
        member = outside & ~quotes & (((block == _COMMA) & (deep == 2)) | ((step == 1) & (deep == 2)) | ((step == -1) & (deep == 1)))
        names = quotes & outside & (deep == 1)
        found = []
        for p in np.flatnonzero(names if sections_only else member | names).tolist():
            if names[p]:
                section = _name_at(file, at + p, size)
                if section is not None:
                    found.append((p, section))
            else:
                found.append((p, None))
        yield at, block, found
        quoted, depth = (quoted + int(quotes.sum())) % 2, int(deep[-1])


def _name_at(file, at: int, size: int) -> str | None:
    """The string that begins at a position if a colon follows, as after a name."""
    n = 256
    while True:
        file.seek(at)
        data = file.read(min(n, size - at))
        end = 1
        while end < len(data) and data[end] != _QUOTE:
            end += 2 if data[end] == _BACKSLASH else 1
        rest = data[end + 1 :].lstrip()
        if rest or at + n >= size:
            return json.decoder.scanstring(data[: end + 1].decode(), 1)[0] if rest[:1] == b":" else None
        n *= 8


def _members(file, lo: int, hi: int, size: int, quoted: bool, depth: int, section: str | None) -> Iterator[tuple[str, str | None, str]]:
    """(section, key, text) of the members that begin in a range; key is null in lists."""
    held, mapped = None, None
    for at, block, borders in _borders(file, lo, size, quoted, depth, hi=hi):
        start = 0
        for p, name in borders:
            if name is not None:
                section = name
                continue
            if held is not None:
                held += block[start:p].tobytes()
                text = held.decode().strip()
                if text:
                    yield section, *_split(text, mapped)
            held = None
            if at + p < hi and int(block[p]) not in b"]}":
                held, start = bytearray(), p + 1
                mapped = {0x7B: True, 0x5B: False}.get(int(block[p]), mapped)
        if held is not None:
            held += block[start:].tobytes()
        elif at + len(block) >= hi:
            return


def _split(text: str, mapped: bool | None) -> tuple[str | None, str]:
    """Key and value of a member. A range may begin within a map or list that it hasn't seen open: there a string with a colon behind it is a key."""
    if mapped is False or text[0] != '"':
        return None, text
    key, end = json.decoder.scanstring(text, 1)
    rest = text[end:].lstrip()
    return (key, rest[1:].strip()) if rest[:1] == ":" else (None, text)


def _over(ranges: DataFrame, answer, schema: str) -> DataFrame:
    """answer(file, row) to rows (path, lo, ...)."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                fs, at = filesystem(row.path)
                with fs.open_input_file(at) as file:
                    held, size = [], 0
                    for found in answer(file, row):
                        held.append((row.path, row.lo, *found))
                        size += sum(len(x) for x in found if isinstance(x, str))
                        if size > 4 * BLOCK_BYTES:
                            yield pd.DataFrame(held, columns=names)
                            held, size = [], 0
                    yield pd.DataFrame(held, columns=names)

    # ranges are small rows of much work: a number that is given keeps them from being put together in one task
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "lo").mapInPandas(run, schema)


def members(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, section, key, value) of the members of all documents; value is a member's text, key its name in a map."""
    listed = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size")).where("size > 0")  # contents aren't read
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo")
    ranges = listed.select("path", "size", starts).withColumn("hi", F.least("size", F.col("lo") + range_bytes))
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    sums = _over(ranges, lambda f, r: [_counted(f, int(r.lo), int(r.hi), int(r.size))], "path string, lo long, quotes long, outside long, inside long")
    sums = sums.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    sums = sums.withColumn("left", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    placed = ranges.join(sums.select("path", "lo", "quoted", F.coalesce(F.sum("left").over(before), F.lit(0)).alias("depth")), ["path", "lo"])

    def last_name(file, r) -> list[tuple[str | None]]:
        last = None
        for at, block, borders in _borders(file, int(r.lo), int(r.size), int(r.quoted), int(r.depth), True, int(r.hi)):
            for p, name in borders:
                last = name if name is not None and at + p < r.hi else last
            if at + len(block) >= r.hi:
                break
        return [(last,)]

    names = _over(placed, last_name, "path string, lo long, name string")
    begun = placed.join(names.select("path", "lo", F.last("name", True).over(before).alias("section")), ["path", "lo"])
    found = _over(begun, lambda f, r: _members(f, int(r.lo), int(r.hi), int(r.size), int(r.quoted), int(r.depth), r.section), "path string, lo long, section string, key string, value string")
    return found.select(F.col("path").alias("file"), "section", "key", "value")
