"""Suppression in rounds, box pairs by cells, staff checks and settings against plain statements of them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from staveflow.config import DEFAULT, DetectionConfig
from staveflow.operators import conflicts, folds, joins, pairs, sampling, validation
from staveflow.plans import pages


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x, y = rng.randrange(-200, 300), rng.randrange(-100, 200)
        rows.append((i, rng.randrange(20), x, y, x + rng.randrange(0, 160), y + rng.randrange(1, 150), i % 3))
    return rows, spark.createDataFrame(rows, "id long, confidence int, x1 int, y1 int, x2 int, y2 int, image int")


def test_pairs_come_once(boxes):
    rows, frame = boxes
    got = sorted((r.a, r.b) for r in joins.overlapping(frame, ["image"], cell=64).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[6] == b[6] and iou(a, b) > 0)


def test_boxes_move_once_for_pairs(spark):
    """Boxes lie in one shuffle, once a band; no join buffers or repeats them (two shuffles, a row a cell, before)."""
    rng = random.Random(8)
    rows = [(i, x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 60), i % 2) for i in range(6000) for x, y in [(rng.randrange(0, 4000), rng.randrange(-600, 1500))]]
    frame = spark.createDataFrame(rows, "id long, x1 long, y1 long, x2 long, y2 long, image int").repartition(3)
    met = joins.overlapping(frame, ["image"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((r.a, r.b, tuple(r.p), tuple(r.q)) for r in met.collect())
    by_x = sorted(rows, key=lambda r: (r[5], r[1]))
    want = []
    for k, a in enumerate(by_x):
        for b in by_x[k + 1 :]:
            if b[5] != a[5] or b[1] >= a[3]:
                break
            if min(a[4], b[4]) > max(a[2], b[2]):
                p, q = sorted((a, b))
                want.append((p[0], q[0], p[1:5], q[1:5]))
    assert got == sorted(want)


def test_ratios_leave_the_sweep_as_three_numbers(boxes):
    rows, frame = boxes
    met = joins.ious(frame, ["image"], cell=64)
    assert met.columns == ["a", "b", "iou"]
    assert {(r.a, r.b): r.iou for r in met.collect()} == {(a[0], b[0]): iou(a, b) for a in rows for b in rows if a[0] < b[0] and a[6] == b[6] and iou(a, b) > 0}


def test_a_sweep_compares_boxes_with_those_that_reach_them_only(monkeypatch):
    """A row of 6,000 boxes of which each meets the next four: few comparisons, not thousands a box; one very wide box and boxes beyond a batch lose no pair."""
    n, most = 6000, []
    x1 = [-1, *range(n)]
    table = pa.table({"image": [1] * (n + 1), "__i": list(range(n + 1)), "x1": x1, "y1": [0] * (n + 1), "x2": [2, *(x + 5 for x in range(n))], "y2": [9] * (n + 1), "__band": [0] * (n + 1)})
    plain = np.minimum
    monkeypatch.setattr(pairs.np, "minimum", lambda a, b: (most.append(np.broadcast(a, b).size), plain(a, b))[1])
    got = [(a, b) for batch in pairs.swept(iter(table.to_batches(max_chunksize=1000)), ["image"], ["x1", "y1", "x2", "y2"], 512) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    assert sorted(got) == sorted((i, j) for i in range(n + 1) for j in range(i + 1, min(n, (i + 4) if i else 2) + 1))
    assert sum(most) < 200 * n


def test_ratios_are_rounded_as_the_sql_does(spark, tmp_path):
    """Areas 343 of 5,120: 0.0669921875, half of the last digit, which doubles round down and decimals up."""
    import duckdb

    import __spark_entry__

    spark.createDataFrame([(0, 0, 0, 1, 28.0), (200, 1120, 136, 4, 27.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["pairwise_iou"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["pairwise_iou"](spark, str(tmp_path)).collect()] == want and len(want) == 1


@pytest.mark.parametrize("overlap", [0.1, 0.3, 0.9])
def test_suppression_is_greedy(boxes, overlap):
    rows, frame = boxes
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(k[6] != r[6] or iou(k, r) < overlap for k in kept):
            kept.append(r)
    got = folds.greedy_suppression(frame, ["image"], overlap)
    assert got.columns == frame.columns and sorted(r.id for r in got.collect()) == sorted(r[0] for r in kept)
    assert folds.greedy_suppression(frame.limit(0), ["image"]).collect() == []


def test_crowded_boxes_are_never_pairs(spark, monkeypatch):
    """Most of these boxes overlap each other; pairs of them aren't made, and the walk over slices and batches is the plain one."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        x, y, big = rng.randrange(40), rng.randrange(40), 20 if i % 50 == 0 else 1
        rows.append((i, rng.randrange(9), x, y, x + big * rng.randrange(1, 30), y + big * rng.randrange(0, 30), i % 2 if i % 7 else None))
    frame = spark.createDataFrame(rows, "id long, confidence int, x1 int, y1 int, x2 int, y2 int, image int")
    monkeypatch.setattr(joins, "overlapping", lambda *a, **k: pytest.fail("pairs of boxes"))
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if r[6] is None or all(k[6] != r[6] or iou(k, r) < 0.5 for k in kept):
            kept.append(r)
    assert sorted(r.id for r in folds.greedy_suppression(frame, ["image"], 0.5).collect()) == sorted(r[0] for r in kept)


def test_barline_over_a_whole_staff(spark):
    """A stroke through all five lines stands, one through three of them doesn't; on a page of four lines three are enough."""
    lines = [("p", 0, 20 + 8 * i) for i in range(5)] + [("q", 0, 20 + 8 * i) for i in range(4)]
    staffs = spark.createDataFrame(lines, "page string, staff int, y int")
    dark = [("p", x, y) for _, _, y in lines[:5] for x in range(60)] + [("p", 10, y) for y in range(20, 53)] + [("p", 30, y) for y in range(20, 38)]
    dark += [("q", 10, y) for y in range(20, 40)]
    pixels = spark.createDataFrame(sorted(set(dark)), "page string, x int, y int")
    bars = spark.createDataFrame([("p", 1, 10), ("p", 2, 30), ("p", 3, 200), ("q", 4, 10), ("q", 5, 40)], "page string, id int, x int")
    got = validation.valid_on_page(bars, pixels, staffs, ["page"])
    assert sorted(r.id for r in got.collect()) == [1, 4]
    margins = validation.intersection_margin(staffs, ["page"])
    assert {r.margin for r in margins.collect()} == {2}


def test_settings():
    wide = DEFAULT.with_margins(2)
    assert (wide.barline_top_margin_ratio, wide.barline_bottom_margin_ratio, wide.barline_max_allowed_extension_ratio, wide.barline_roi_margin_ratio) == (1.4, 1.4, 2.4, 0.5)
    text = DEFAULT.description()
    assert text.count("\n") == 13 + 5 - 1 and "  hough_max_line_gap_ratio: 0.3" in text
    with pytest.raises(ValueError):
        DEFAULT.with_margins(0.1)
    assert DetectionConfig(min_consensus_ratio=0.5).min_consensus_ratio == 0.5


def test_report_and_beats_of_a_document(spark):
    measures = spark.createDataFrame([("d", p, g, m, 0, 100 * m) for p in (1, 2) for g in (0, 1) for m in (1, 2)], "doc string, page int, group_idx int, measure_number int, system_idx int, x_start int")
    symbols = spark.createDataFrame([("d", 1, 1, "timeSig3", 110), ("d", 1, 2, "timeSig3", 5), ("d", 1, 3, "clefG", 1)], "doc string, page int, id int, class_name string, x1 int")
    out = pages.document_report(measures, symbols, measures)
    assert tuple(out["totals"].first()) == ("d", 2, 8, 3, 2, "3")
    found = symbols.select("doc", "page", F.lit(0).alias("group_idx"), "class_name", F.col("x1").alias("x"))
    beats = pages.played(measures, found).orderBy("page", "group_idx", "measure_number", "beat").collect()
    # the signature stands in the first measure of page 1 at x = 110 and holds from there on
    assert len(beats) == 8 * 3 and [b.at_ms for b in beats] == [500 * i for i in range(24)]


def test_balanced_sample_is_stable(spark):
    counts = spark.createDataFrame([(i, i % 4, i) for i in range(300)], "image int, cls int, n int")
    one, two = (sorted(r.image for r in sampling.balanced_sample(c, 60, 4).collect()) for c in (counts, counts.repartition(9)))
    assert one == two and len(one) == 60


@pytest.mark.parametrize("sign", [1, -1])
def test_long_chains_take_few_rounds(spark, monkeypatch, sign):
    """Two chains of a thousand boxes in a key, each box in the way of the next two: one walk, or components in about log-many rounds and a walk."""
    rows = [(1000 * k + i, "a", float(sign * i), 5.0 * i, 900.0 * k, 5.0 * i + 20, 900.0 * k + 10) for k in (0, 1) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, image string, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = sorted(1000 * k + (i if sign < 0 else 999 - i) for k in (0, 1) for i in range(0, 1000, 3))
    made, keep = [], conflicts.checkpoint
    monkeypatch.setattr(conflicts, "checkpoint", lambda df: made.append(1) or keep(df))
    for folded, most in ((10**6, 2), (2500, 7 + 3 * 10)):
        monkeypatch.setattr(conflicts, "FOLDED", folded)
        made.clear()
        got = sorted(r.id for r in folds.greedy_suppression(frame, ["image"], 0.3).collect())
        assert got == want and len(made) <= most, (folded, len(made))


def test_large_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "FOLDED", 5)
    rng = random.Random(9)
    boxes = [(i, f"p{i % 2}", float(rng.randint(0, 5)), x := rng.randint(0, 60), y := rng.randint(0, 20), x + rng.randint(5, 25), y + rng.randint(5, 25)) for i in range(120)]
    frame = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, int) else v, b[3:])) + b[:3] for b in boxes], "x1 double, y1 double, x2 double, y2 double, id long, image string, confidence double")
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[2], b[0])):
        def share(c):
            w, h = min(b[5], c[5]) - max(b[3], c[3]), min(b[6], c[6]) - max(b[4], c[4])
            both = w * h if w > 0 and h > 0 else 0
            return both / ((b[5] - b[3]) * (b[6] - b[4]) + (c[5] - c[3]) * (c[6] - c[4]) - both)

        if not any(c[1] == b[1] and share(c) >= 0.3 for c in kept):
            kept.append(b)
    assert sorted(r.id for r in folds.greedy_suppression(frame, ["image"], 0.3).collect()) == sorted(b[0] for b in kept)


def test_components(spark):
    rng = random.Random(1)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order[:100], order[1:101], strict=True)) + [(order[150], order[k]) for k in range(151, 200)] + [(order[250], order[251])]
    root = {n: n for n in range(300)}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in conflicts.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges for n in e}
