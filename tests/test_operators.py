"""Each operator against a plain statement of its rule, and the worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from staveflow.operators import aggregates, folds, islands, joins, sampling, windows

random.seed(9)


def frame(spark, values, name="x"):
    return spark.createDataFrame([(1, v) for v in values], f"page int, {name} int")


def groups_of(df, x="x", g="grp"):
    out = {}
    for r in df.collect():
        out.setdefault(r[g], []).append(r[x])
    return [sorted(out[k]) for k in sorted(out)]


def test_five_line_systems(spark):
    got = islands.systems_of_five(frame(spark, range(10, 80, 10), "y"), ["page"], 20).collect()
    assert [(r.system_idx, list(r.lines), r.top, r.bottom) for r in got] == [(0, [10, 20, 30, 40, 50], 10, 50)]


def test_twelve_systems_make_three_groups(spark):
    centres, y = [], 0
    for i in range(12):
        centres.append(y)
        y += 366 if i in (3, 7) else 193 + (i % 2)
    rows = frame(spark, centres, "center_y")
    gaps = windows.gaps_and_jumps(rows, ["page"], "center_y")
    level = islands.adaptive_threshold(gaps.select("page", "gap"), ["page"], 10.0)
    assert level.first().threshold == pytest.approx((194 + 366) / 2)
    assert groups_of(islands.system_groups(rows, ["page"], level), "center_y", "group_idx") == [centres[:4], centres[4:8], centres[8:]]


def test_threshold_of_few_gaps(spark):
    gaps = spark.createDataFrame([(1, g) for g in (10, 20, 40)] + [(2, 30)], "page int, gap int")
    got = {r.page: r.threshold for r in islands.adaptive_threshold(gaps, ["page"], 12.0).collect()}
    assert got == {1: pytest.approx(26.0), 2: pytest.approx(96.0)}
    many = spark.createDataFrame([(1, g) for g in (10, 11, 12, 13, 14, 15)], "page int, gap int")
    assert islands.adaptive_threshold(many, ["page"], 12.0).first().threshold == pytest.approx(13.0)
    wide = spark.createDataFrame([(1, g) for g in (10, 11, 12, 13, 14, 115)], "page int, gap int")
    assert islands.adaptive_threshold(wide, ["page"], 12.0, ratio=6.0).first().threshold == pytest.approx(72.0)


def plain_groups(values, joins_group):
    out = []
    for v in sorted(values):
        if out and joins_group(out[-1], v):
            out[-1].append(v)
        else:
            out.append([v])
    return out


RULES = {
    "mean": (folds.running_mean_groups, 8, lambda g, v: v - sum(g) / len(g) <= 8),
    "anchor": (folds.anchor_groups, 50, lambda g, v: v - g[0] <= 50),
}


@pytest.mark.parametrize("rule", RULES)
def test_folds(spark, rule):
    f, tol, joins_group = RULES[rule]
    data = [(p, random.randrange(600)) for p in range(40) for _ in range(random.randrange(1, 60))]
    rows = spark.createDataFrame(data, "page int, x int")
    got = {}
    for r in f(rows, ["page"], "x", tol).collect():
        got.setdefault(r.page, {}).setdefault(r.grp, []).append(r.x)
    for p in {p for p, _ in data}:
        want = plain_groups([x for q, x in data if q == p], joins_group)
        assert [sorted(got[p][g]) for g in sorted(got[p])] == want


def test_fold_examples(spark):
    assert groups_of(folds.running_mean_groups(frame(spark, [0, 6, 12, 18]), ["page"])) == [[0, 6], [12, 18]]
    assert groups_of(folds.anchor_groups(frame(spark, [0, 40, 80]), ["page"])) == [[0, 40], [80]]
    assert sorted(r.x for r in folds.last_kept(frame(spark, [0, 10, 20, 30, 40, 40]), ["page"]).collect()) == [0, 20, 40]


def test_extent_clusters(spark):
    spans = [(random.randrange(1000), random.randrange(60)) for _ in range(60)]
    rows = spark.createDataFrame([(1, a, a + n, i) for i, (a, n) in enumerate(spans)], "page int, y1 int, y2 int, i int")
    order = sorted((((a + a + n) / 2, a, a + n, i) for i, (a, n) in enumerate(spans)))
    want, low, high = [], None, None
    for _, a, b, i in order:
        if want and a - high <= 15 and low - b <= 15:
            want[-1].append(i)
            low, high = min(low, a), max(high, b)
        else:
            want.append([i])
            low, high = a, b
    assert groups_of(folds.extent_clusters(rows, ["page"], gap=15), "i") == [sorted(w) for w in want]


def test_suppression(spark):
    rows = [(1, 1, 9, 1, 0, 0, 10, 10), (1, 2, 8, 2, 0, 0, 10, 10), (1, 1, 7, 3, 0, 0, 10, 5), (1, 1, 6, 4, 0, 0, 10, 4), (1, 1, 9, 5, 50, 50, 60, 60)]
    boxes = spark.createDataFrame(rows, "image int, cls int, confidence int, id int, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r.id for r in folds.greedy_suppression(boxes, ["image", "cls"]).collect()) == [1, 2, 4, 5]


def test_thickness_stops_at_the_first_gap(spark):
    rows = [(1, 1, 0.9), (1, -1, 0.8), (1, 2, 0.1), (1, -2, 0.9), (2, 1, 0.0), (3, 1, 1.0), (3, -1, 1.0), (3, 2, 1.0), (3, -2, 1.0), (3, 3, 1.0), (3, -3, 1.0)]
    got = {r.page: r.thickness for r in folds.thickness(spark.createDataFrame(rows, "page int, offset int, covered double"), ["page"]).collect()}
    assert got == {1: 3, 2: 1, 3: 7}


def test_staffs_and_spacing(spark):
    ys = [10, 20, 30, 40, 50, 200, 210, 400, 410, 420, 430]
    got = islands.staffs_from_peaks(frame(spark, ys, "y"), ["page"])
    assert groups_of(got, "y", "staff") == [[10, 20, 30, 40, 50], [400, 410, 420, 430]]
    assert islands.median_spacing(frame(spark, ys, "y"), ["page"], "y", 30).first().spacing == 10.0


def test_runs_and_openings(spark):
    rows = spark.createDataFrame([(1, 5, y) for y in (1, 2, 3, 7, 8)], "page int, x int, y int")
    assert sorted((r.y_start, r.y_end) for r in islands.vertical_runs(rows, ["page", "x"]).collect()) == [(1, 3), (7, 8)]
    line = spark.createDataFrame([(1, 0, x) for x in (0, 1, 2, 5, 6)], "page int, y int, x int")
    assert sorted(r.x for r in islands.horizontal_opening(line, 3).collect()) == [0, 1, 2]


def test_consensus_needs_enough_systems(spark):
    systems = spark.createDataFrame([(1, 0, i, 100 * i, 100 * i + 40) for i in range(4)], "page int, group_idx int, system_idx int, top int, bottom int")
    bars = spark.createDataFrame([(1, 0, 0, s, 100 + s) for s in range(3)] + [(1, 0, 1, s, 300) for s in (0, 0, 1)], "page int, group_idx int, cluster int, system_idx int, x int")
    got = aggregates.consensus(bars, systems, ["page"]).collect()
    assert [(r.x, r.y_start, r.y_end, r.consensus_count, r.group_size, list(r.systems)) for r in got] == [(101, -10, 350, 3, 4, [0, 1, 2])]


def test_y_ranges(spark):
    rows = spark.createDataFrame([(1, 0, 400, 460), (1, 1, 580, 660), (1, 2, 760, 820)], "page int, system_idx int, top int, bottom int")
    got = {r.system_idx: (r.y_top, r.y_bottom) for r in windows.y_ranges(rows, ["page"]).collect()}
    assert got[1] == (520, 710) and got[0] == (340, 520) and got[2] == (710, 880)


def test_nearest_and_ties(spark):
    pts = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 100, 0), (1, 3, 500, 0)], "page int, id int, x int, y int")
    tgt = spark.createDataFrame([(1, 9, 30, 0), (1, 7, -30, 0), (1, 5, 110, 0), (2, 1, 0, 0)], "page int, target_id int, x int, y int")
    got = {r.id: (r.target_id, r.distance) for r in joins.nearest(pts, tgt, ["page"]).collect()}
    assert got == {1: (7, 30.0), 2: (5, 10.0)}


def test_nearest_matches_brute_force(spark):
    pts = [(1, i, random.randrange(300), random.randrange(300)) for i in range(80)]
    tgt = [(1, i, random.randrange(300), random.randrange(300)) for i in range(80)]
    want = {}
    for _, i, x, y in pts:
        near = [((x - a) ** 2 + (y - b) ** 2, j) for _, j, a, b in tgt if (x - a) ** 2 + (y - b) ** 2 <= 900]
        if near:
            want[i] = min(near)[1]
    got = joins.nearest(spark.createDataFrame(pts, "page int, id int, x int, y int"), spark.createDataFrame(tgt, "page int, target_id int, x int, y int"), ["page"])
    assert {r.id: r.target_id for r in got.collect()} == want


def test_range_assign_and_containment(spark):
    p = spark.createDataFrame([(1, x) for x in (5, 10, 19, 20, 99)], "page int, x int")
    s = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "page int, start int, value string")
    assert sorted((r.x, r.value) for r in joins.range_assign(p, s, ["page"]).collect()) == [(5, None), (10, "a"), (19, "a"), (20, "b"), (99, "b")]
    outer = spark.createDataFrame([(1, "o", 100, 700)], "page int, o string, y_start int, y_end int")
    inner = spark.createDataFrame([(1, 80, 720), (1, 79, 300), (1, 300, 400)], "page int, top int, bottom int")
    assert sorted(r.top for r in joins.contained(outer, inner, ["page"]).collect()) == [80, 300]


def test_lookup_joins(spark):
    ann = spark.createDataFrame([("a", "1", ["9", "6"]), ("b", "1", ["6"]), ("c", "2", []), ("d", "7", ["8"])], "ann_id string, image_id string, cat_ids array<string>")
    cats = spark.createDataFrame([("6", "stem"), ("8", "beam")], "id string, name string")
    got = joins.first_target_category(ann, cats)
    assert sorted((r.ann_id, r.category_name) for r in got.collect()) == [("a", "stem"), ("b", "stem"), ("d", "beam")]
    imgs = spark.createDataFrame([(1, 10), (2, 20)], "id int, width int")
    assert sorted(r.ann_id for r in joins.annotations_with_images(got, imgs).collect()) == ["a", "b"]
    det = spark.createDataFrame([(6,), (99,)], "class_id int")
    named = joins.with_class_names(det, spark.createDataFrame([(6, "stem")], "id int, name string"))
    assert sorted(r.class_name for r in named.collect()) == ["class_99", "stem"]
    pair = joins.pairing(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int"), "k").first()
    assert tuple(pair) == (1, 1, 2)


def test_manual_barlines(spark):
    bars = spark.createDataFrame([(1, 1, 0.10), (1, 2, 0.11), (1, 3, 0.5)], "page int, id int, x double")
    clicks = spark.createDataFrame([(1, 0.105), (1, 0.9)], "page int, x double")
    assert sorted(r.id for r in joins.without_nearest(bars, clicks, ["page"], 0.02).collect()) == [2, 3]


def test_first_overlap(spark):
    g = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [2, 3]), (1, 2, [4])], "page int, group_idx int, systems array<int>")
    b = spark.createDataFrame([(1, 1, 40, [1]), (1, 0, 55, [0, 2])], "page int, pos int, x int, covered_systems array<int>")
    assert {r.group_idx: r.bracket_x for r in joins.first_overlapping(g, b, ["page"]).collect()} == {0: 55, 1: 55, 2: 0}


def test_carry_beats_tiles_pages(spark):
    rows = spark.createDataFrame([("d", 1, None), ("d", 2, "3/4"), ("d", 3, None)], "doc string, n int, s string")
    got = windows.carry_forward(rows, ["doc"], ["n"], "s", "4/4").orderBy("n").collect()
    assert [r.s for r in got] == ["4/4", "3/4", "3/4"]
    beats = windows.beats(spark.createDataFrame([("d", 1, 2), ("d", 2, 3)], "doc string, n int, beats int"), ["doc"], ["n"], bpm=60).orderBy("at_ms").collect()
    assert [(r.n, r.beat, r.at_ms) for r in beats] == [(1, 1, 0), (1, 2, 1000), (2, 1, 2000), (2, 2, 3000), (2, 3, 4000)]
    tiles = windows.tiles(spark.createDataFrame([(1, 2000, 500), (2, 1024, 1025)], "id int, width int, height int"))
    assert sorted((r.id, r.tile_x, r.tile_y) for r in tiles.collect()) == [(1, 0, 0), (1, 896, 0), (1, 976, 0), (2, 0, 0), (2, 0, 1)]
    pages = windows.contiguous_pages(spark.createDataFrame([("d", p) for p in (2, 3, 5)], "doc string, page int"), ["doc"])
    assert sorted(r.page for r in pages.collect()) == [2, 3]


def test_counts_and_majority(spark):
    bars = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (1, 1), (2, 0)], "page int, system_idx int")
    assert {r.page: r.measures for r in aggregates.measure_counts(bars, ["page"]).collect()} == {1: 2, 2: 0}
    votes = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "page int, v string, pos int")
    assert aggregates.majority(votes, ["page"], "v", "pos").first().v == "b"


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in sampling.stable_sample(rows.repartition(7), "k", 50).collect()}
    assert a == {r.k for r in sampling.stable_sample(rows.repartition(2), "k", 50).collect()} and len(a) == 50
    split = {r.split: r["count"] for r in sampling.stable_split(rows, "k").groupBy("split").count().collect()}
    assert 380 < split["train"] < 470


@pytest.mark.parametrize("n", [1, 4, 16])
def test_results_do_not_depend_on_partitions(spark, n):
    data = [(p, (p * 7919 + i * 104729) % 997) for p in range(6) for i in range(80)]
    rows = spark.createDataFrame(data, "page int, x int").repartition(n)
    got = folds.running_mean_groups(rows, ["page"]).groupBy("page", "grp").agg(F.count("*").alias("n")).orderBy("page", "grp").collect()
    one = folds.running_mean_groups(spark.createDataFrame(data, "page int, x int"), ["page"]).groupBy("page", "grp").agg(F.count("*").alias("n")).orderBy("page", "grp").collect()
    assert got == one


def test_top_classes_and_images(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200), ("d", 50)], "cls string, n int")
    got = {(r.cls, r.why) for r in sampling.top_classes(counts, spark.createDataFrame([("c",), ("d",), ("a",)], "cls string"), 2).collect()}
    assert got == {("a", "top"), ("b", "top"), ("c", "essential")}
    per = spark.createDataFrame([("i1", 1, 5), ("i2", 1, 5), ("i3", 2, 1), ("i1", 2, 9)], "image string, cls int, n int")
    assert {(r.image, tuple(r.picked_for)) for r in sampling.top_images_per_class(per, 1).collect()} == {("i1", (1, 2))}


def test_deviations_in_order_don_t_depend_on_partitions(spark):
    """The deviation of these four is 10; rounded sums give 9.99... in some orders, and one step of the score more."""
    rows = [(0, 526.0), (1, 530.0), (2, 514.0), (3, 542.0)]
    mean = squares = 0.0
    for n, (_, x) in enumerate(rows, 1):
        before, mean = mean, mean + (x - mean) / n
        squares += (x - mean) * (x - before)
    frame = spark.createDataFrame([(i, 1, x, 0.0, 1.0, 90.0) for i, x in rows], "id int, page int, center_x double, center_y double, length double, angle double")
    got = {aggregates.line_groups(f, ["page"], order="id").first().x_std for f in (frame.repartition(k, "id") for k in (1, 2, 3, 4))}
    assert got == {(squares / 4) ** 0.5}


def test_targets_of_a_nearest_join_go_to_one_cell(spark):
    """Two thousand targets in one place are one row of the join, and its first id is the answer; points on borders of cells find theirs."""
    targets = spark.range(2000).selectExpr("1 AS page", "id + 7 AS target_id", "10 AS x", "10 AS y").union(spark.createDataFrame([(1, 5000, -31, 61), (2, 1, 10, 10)], "page int, target_id long, x int, y int"))
    points = spark.createDataFrame([(1, 1, 10, 40), (1, 2, 40, 10), (1, 3, 41, 10), (1, 4, -61, 61), (1, 5, -31, 31), (3, 6, 10, 10)], "page int, id int, x int, y int")
    near = joins.nearest(points, targets, ["page"])
    assert {r.id: (r.target_id, r.distance) for r in near.collect()} == {1: (7, 30.0), 2: (7, 30.0), 4: (5000, 30.0), 5: (5000, 30.0)}
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # the points' cells, by column and row; before, the targets' nine
