import math
import random

import pytest
from pyspark.sql import functions as F

from staveflow import config
from staveflow.functions import geometry as geo
from staveflow.functions import labels


def one(spark, *cols, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    return tuple(spark.createDataFrame([row], names).select(*cols).first())


def test_stem_boxes(spark):
    boxes = [(1673, 159, 1675, 217), (1723, 175, 1724, 218), (1636, 167, 1638, 218), (1655, 516, 1656, 590), (1610, 513, 1611, 606)]
    rows = spark.createDataFrame(boxes, "x1 int, y1 int, x2 int, y2 int")
    got = rows.select((F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")).withColumn("o", geo.orientation("w", "h")).collect()
    assert [(r.w, r.h) for r in got] == [(2, 58), (1, 43), (2, 51), (1, 74), (1, 93)] and {r.o for r in got} == {"VERTICAL"}


def test_segment_metrics(spark):
    got = one(spark, *geo.segment_metrics(), x1=3, y1=0, x2=0, y2=4)
    assert got == (1, 2, 5.0, pytest.approx(math.degrees(math.atan(4 / -3))))
    assert one(spark, geo.segment_metrics()[3], x1=2, y1=9, x2=2, y2=1) == (90.0,)


def test_touching_boxes_do_not_overlap(spark):
    frame = spark.sql("select named_struct('x1',0,'y1',0,'x2',10,'y2',10) a, named_struct('x1',10,'y1',0,'x2',20,'y2',10) b, named_struct('x1',5,'y1',0,'x2',15,'y2',10) c")
    assert tuple(frame.select(geo.iou("a", "b"), geo.iou("a", "c"), geo.iou("a", "a")).first()) == (0.0, pytest.approx(1 / 3), 1.0)


def test_rejections(spark):
    cases = [((0, 0, 10, 10), None), ((-1, 0, 10, 10), "original_bounds"), ((5, 0, 5, 10), "final_bounds"), ((0, 0, 101, 10), "original_bounds")]
    rows = spark.createDataFrame([(*b,) for b, _ in cases], "x1 int, y1 int, x2 int, y2 int")
    assert [r[0] for r in rows.select(geo.rejection("x1", "y1", "x2", "y2", F.lit(100), F.lit(100))).collect()] == [w for _, w in cases]
    assert one(spark, geo.rejection("x1", "y1", "x2", "y2", F.lit(100), F.lit(100), 3), x1=0, y1=0, x2=2, y2=9) == ("too small",)


def test_letterbox_and_center(spark):
    f = one(spark, geo.letterbox("x1", "y1", "x2", "y2", F.lit(200), F.lit(100), 100), x1=0, y1=0, x2=200, y2=100)[0]
    assert tuple(f) == (0.0, 25.0, 100.0, 75.0)
    c = one(spark, geo.corners_to_center("x1", "y1", "x2", "y2", F.lit(10), F.lit(10)), x1=8, y1=2, x2=30, y2=4)[0]
    assert tuple(c) == (1.0, pytest.approx(0.3), 1.0, pytest.approx(0.2))


def test_barline_score(spark):
    random.seed(1)
    rows = [(random.uniform(0, 12), random.randrange(1, 12), random.uniform(0, 60), random.uniform(0, 15)) for _ in range(200)]

    def plain(std, n, cov, ang):
        s = 30 if std < 2 else 20 if std < 5 else 10 if std < 10 else 0
        s += 25 if 3 <= n <= 8 else 15 if n >= 2 else 0
        s += 25 if cov > 40 else 15 if cov > 20 else 0
        return min(100, s + (20 if ang < 5 else 10 if ang < 10 else 0))

    got = spark.createDataFrame(rows, "x_std double, line_count int, y_coverage double, angle_std double").select(geo.barline_score()).collect()
    assert [r[0] for r in got] == [plain(*r) for r in rows]


def test_signatures(spark):
    names = ["timeSig4", "timeSigCommon", "timeSig7_8", "x3", "x5", "brace", "timeSig12"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(labels.signature(F.col("n")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("4/4", 4), ("4/4 (Common Time)", 4), ("7/8", 7), ("3/4", 3), (None, 4), (None, 4), ("12/8", 12)]
    cats = spark.createDataFrame([("restHalf",), ("clefG",), ("keyFlat",), ("tuplet3",)], "n string").select(labels.category(F.col("n"))).collect()
    assert [r[0] for r in cats] == ["rests", "clefs", "keys/accidentals", "other"]
    assert one(spark, labels.stem(F.col("p")), p="/a/b.c/page.01.png") == ("page.01",)


def test_config():
    with pytest.raises(ValueError):
        config.DetectionConfig(staff_same_system_spacing_ratio=0.5)
    assert config.STRICT.hough_min_line_length_ratio == 0.6 and config.RELAXED.barline_top_margin_ratio == 1.0
    assert config.DEFAULT.with_margins(2).barline_bottom_margin_ratio == pytest.approx(1.4)
    assert "min_consensus_ratio: 0.8" in config.DEFAULT.description()


def test_other_columns(spark):
    assert one(spark, geo.measure_id("p", "s", "m"), p=1, s=2, m=3) == ("P1_02_003",)
    assert one(spark, geo.beat_interval_ms("b"), b=128) == (468,)
    assert one(spark, geo.staff_coverage("a", "b", F.lit(100), F.lit(140)), a=90, b=120) == (0.5,)
    assert one(spark, geo.center_box_valid(), xc=0.5, yc=0.5, w=1.0, h=0.5) == (True,)
    assert one(spark, geo.center_box_valid(), xc=0.6, yc=0.5, w=1.0, h=0.5) == (False,)
    assert one(spark, *geo.hough_parameters("h", "s", config.DEFAULT), h=40.0, s=10.0) == (8, 5, 3)
