from pyspark.sql import functions as F

from staveflow.operators import validation


def test_span(spark):
    rows = [(0, 48, 104, True), (1, 60, 104, False), (2, 30, 104, False), (3, 50, 90, False), (4, 50, 120, False)]
    frame = spark.createDataFrame([(i, a, b, 50, 100, 8.0) for i, a, b, _ in rows], "id int, y_min int, y_max int, top int, bottom int, spacing double")
    got = {r.id: r.ok for r in frame.select("id", validation.spans_staff().alias("ok")).collect()}
    assert got == {i: ok for i, _, _, ok in rows}
    assert not frame.where("id = 0").select(validation.spans_staff(max_length=F.lit(50))).first()[0]


def test_valid_for_staff(spark):
    lines = [(1, 0, y) for y in (10, 20, 30, 40, 50)]
    thin = [(1, y, 5) for y in range(8, 53)]
    blob = [(1, y, x) for y in range(8, 53) for x in range(20, 34)]
    short = [(1, y, 50) for y in range(10, 25)]
    pixels = spark.createDataFrame(thin + blob + short, "page int, y int, x int")
    candidates = spark.createDataFrame([(1, 0, x, 10, 50) for x in (5, 26, 50, 60)], "page int, staff int, x int, top int, bottom int")
    got = validation.valid_for_staff(candidates, pixels, spark.createDataFrame(lines, "page int, staff int, y int"), ["page"])
    assert [r.x for r in got.collect()] == [5]
    kept = validation.filter_barlines(candidates, got, ["page"])
    assert [r.x for r in kept.collect()] == [5]


def test_bounds_are_open_without_extents(spark):
    bars = spark.createDataFrame([(1, 10), (1, 200), (2, 999)], "page int, x int")
    ext = spark.createDataFrame([(1, 100, 300)], "page int, x_start int, x_end int")
    assert sorted((r.page, r.x) for r in validation.within_bounds(bars, ext, ["page"]).collect()) == [(1, 200), (2, 999)]


def test_parameters(spark):
    frame = spark.createDataFrame([(0.05, 10.0, 3000), (0.9, None, 100)], "density double, spacing double, width int")
    got = [tuple(r) for r in frame.select(*validation.tuned_parameters()).collect()]
    assert got == [(5, 3, 2, 15, 25), (9, 3, 2, 5, 15)]
