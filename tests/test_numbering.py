"""Places over whole tables, without a window in one task."""

import random

from pyspark.sql import functions as F

from staveflow.operators import sampling, windows
from staveflow.operators.numbering import numbered


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_places_and_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 7, 900])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, x int, w long").repartition(7)
    order = [F.col("x").desc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = {r.id: r.n for r in numbered(frame, order).collect()}
    assert got == {r[0]: i for i, r in enumerate(want)}
    sums, held = {}, 0
    for r in want:
        sums[r[0]] = held
        held += r[2] or 0
    assert {r.id: r.n for r in numbered(frame, order, size="w").collect()} == sums
    assert numbered(frame.limit(0), order).collect() == [] and numbered(frame.limit(0), order, size="w").collect() == []


def test_clashing_names(spark):
    frame = spark.createDataFrame([(3, "a", 9), (1, "b", 9)], "part int, at string, held int")
    got = numbered(frame, [F.col("part")], "n")
    assert got.columns == ["part", "at", "held", "n"] and {r.part: r.n for r in got.collect()} == {1: 0, 3: 1}


def test_dense_ids_and_shards_need_no_global_window(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("9",), (None,), ("200",)], "id string")
    got = windows.dense_ids(ids, "id")
    assert sorted((r.id or "", r.dense_id) for r in got.collect()) == [("", 0), ("10", 2), ("200", 3), ("9", 1), ("9", 1)]
    shards = spark.createDataFrame([(s,) for s in "edcba"] * 3 + [(None,)], "shard string")
    split = sampling.shard_split(shards)
    assert {r.shard: r.split for r in split.collect()} == {"a": "train", "b": "train", "c": "train", "d": "train", "e": "val"}
    for frame, keys in ((got, "id"), (split, "shard")):
        over = [x for x in plan_of(frame).splitlines() if "Window" in x]
        assert all("sum(held" in x for x in over), keys  # only the sum over one row a partition
