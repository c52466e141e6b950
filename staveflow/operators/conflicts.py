"""Greedy choice among rows of which some exclude each other: in order of rank, a row that is left drops those that it excludes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rounds import checkpoint

#: Pairs of a key, or of a component, that are folded in one task; more of them are split into components, or taken in rounds.
FOLDED = 100_000


def losers(pairs: DataFrame, keys: list[str], folded: int | None = None) -> DataFrame:
    """(low) of the rows that are dropped; pairs (keys, rank, high, low): `high` goes before `low`, and has the larger rank, or an equal one and the smaller name.

    Only rows of one key exclude each other, so a key's pairs, sorted by the
    rank of the row that goes first, are walked through once; a task keeps the
    names dropped so far of the key in hand. A key with over `folded` pairs is
    split into the components of its pairs, found in about as many rounds as
    the logarithm of their size. What is a larger component still is taken in
    rounds of its own: rows that none left goes before stay and drop theirs.
    """
    limit = FOLDED if folded is None else folded
    pairs = checkpoint(pairs.select(F.xxhash64(*keys).alias("unit"), "rank", "high", "low"))
    large = _over(pairs, limit)
    if large is None:
        return _walked(pairs)
    rest = checkpoint(pairs.join(large, "unit", "left_semi"))
    out = _walked(pairs.join(large, "unit", "left_anti"))
    roots = components(rest.select(F.col("high").alias("a"), F.col("low").alias("b")))
    rest = checkpoint(rest.join(roots.withColumnRenamed("node", "high"), "high").select(F.xxhash64("root").alias("unit"), "rank", "high", "low"))
    large = _over(rest, limit)
    if large is None:
        return out.union(_walked(rest))
    return out.union(_walked(rest.join(large, "unit", "left_anti"))).union(_in_rounds(rest.join(large, "unit", "left_semi").select("high", "low")))


def _over(pairs: DataFrame, limit: int) -> DataFrame | None:
    """The units with over limit pairs, or None."""
    found = checkpoint(pairs.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("unit"))
    return None if found.isEmpty() else found


def _walked(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["low"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, dropped = None, set()
        for part in parts:
            out = []
            for unit, high, low in zip(part["unit"], part["high"], part["low"], strict=True):
                if unit != now:
                    now, dropped = unit, set()
                if high not in dropped and low not in dropped:
                    dropped.add(low)
                    out.append(low)
            yield pd.DataFrame({"low": out}, dtype=part["low"].dtype)

    ordered = pairs.repartition("unit").sortWithinPartitions("unit", F.desc("rank"), "high")
    return ordered.select("unit", "high", "low").mapInPandas(run, f"low {kind}")


def _in_rounds(left: DataFrame) -> DataFrame:
    left, out = checkpoint(left), left.select("low").limit(0)
    while not left.isEmpty():
        kept = left.select("high").distinct().join(left.select(F.col("low").alias("high")).distinct(), "high", "left_anti")
        gone = checkpoint(left.join(kept, "high", "left_semi").select("low").distinct())
        out = out.union(gone)
        left = checkpoint(left.join(gone, "low", "left_anti").join(gone.withColumnRenamed("low", "high"), "high", "left_anti"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    In each round a label takes the smallest label next to it; where that takes
    another itself, and so on, the last of them is found by doubling. Edges are
    drawn between labels anew, and those within a label go. What is left are
    labels with only larger ones next to them, so a chain shrinks to half at
    most in a round, whatever its order.
    """
    edges = edges.select("a", "b")
    edges = checkpoint(edges.union(edges.select("b", "a")).where("a != b").distinct())
    labels = checkpoint(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not edges.isEmpty():
        up = checkpoint(edges.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("next")))
        while True:
            further = up.select(F.col("a").alias("next"), F.col("next").alias("to"))
            jumped = checkpoint(up.join(further, "next").select("a", "next", "to"))
            up = jumped.select("a", F.col("to").alias("next"))
            if jumped.where("to != next").isEmpty():
                break
        up = up.withColumnRenamed("next", "to")
        moved = edges.join(up, "a").select(F.col("to").alias("x"), "b").join(up.withColumnRenamed("a", "b"), "b")
        edges = checkpoint(moved.select(F.col("x").alias("a"), F.col("to").alias("b")).where("a != b").distinct())
        labels = labels.join(up.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = checkpoint(labels)
    return labels
