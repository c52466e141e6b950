import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveflow.functions import kernels
from staveflow.plans import dataset, measures, signatures
from staveflow.sources import detectors, files, sinks
from staveflow.streaming import pages as streams


def pgm(gray):
    return b"P5\n# page\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def staff_page():
    gray = np.full((160, 300), 255, np.uint8)
    for s in (40, 110):
        for i in range(5):
            gray[s + 8 * i, 10:290] = 0
    for x in (60, 150, 240):
        gray[40:143, x] = 0
    return gray


def test_annotation_json(spark, tmp_path):
    doc = {
        "images": [{"id": "1", "filename": "a.png", "width": 100, "height": 50}, {"id": "2", "filename": "b.png", "width": 10, "height": 10}],
        "annotations": {"10": {"cat_id": [None, "", "6"], "img_id": "1", "a_bbox": [10, 10, 30, 40], "area": 5}, "11": {"cat_id": ["7"], "img_id": "1", "a_bbox": [0, 0, 200, 10]}, "12": {"cat_id": [], "img_id": "1", "a_bbox": [0, 0, 1, 1]}, "13": {"cat_id": ["6"], "img_id": "2", "a_bbox": [1, 1, 1, 3]}, "14": {"cat_id": ["9"], "img_id": "2", "a_bbox": [1, 2]}},
        "categories": {"6": {"name": "stem"}, "7": {"name": "beam"}, "9": {"name": "tie"}},
    }
    (tmp_path / "set-complete-3.json").write_text(json.dumps(doc))
    rows = files.annotation_json(spark, str(tmp_path / "*.json"))
    assert rows.first().shard == 3
    ann = files.annotations(rows)
    assert sorted((r.ann_id, r.category_id) for r in ann.collect()) == [("10", "6"), ("11", "7"), ("13", "6")]
    assert files.annotations(rows, excluded=["7"]).count() == 2 and files.annotations(rows, wanted=["7"]).count() == 1
    classes = dataset.target_classes(files.categories(rows), ["tie"])
    assert sorted((r.name, r.class_id) for r in classes.collect()) == [("beam", 1), ("stem", 0)]
    labels = {r.ann_id: r for r in dataset.label_rows(ann, files.images(rows), classes, 100).collect()}
    assert labels["10"].reason is None and labels["10"].label.xc == pytest.approx(0.2) and labels["10"].label.yc == pytest.approx(0.5)
    assert labels["11"].reason == "original_bounds" and labels["13"].reason == "final_bounds" and labels["13"].label is None


def test_label_files_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("a",), ("b",)], "image string")
    rows = spark.createDataFrame([("a", 2, 0.5, 0.5, 0.25, 0.125), ("a", 1, 0.1, 0.2, 0.3, 0.4)], "image string, class_id int, xc double, yc double, w double, h double")
    lines = sinks.label_lines(images, rows)
    assert {r.image: r.line for r in lines.collect()} == {"a": "1 0.100000 0.200000 0.300000 0.400000\n2 0.500000 0.500000 0.250000 0.125000", "b": ""}
    sinks.write_labels(lines, str(tmp_path / "labels"))
    back = files.yolo_labels(spark, str(tmp_path / "labels"))
    assert sorted(tuple(r)[:6] for r in back.collect()) == sorted(tuple(r) for r in rows.collect())
    (tmp_path / "x.txt").write_text("1 0.1 0.2 0.3 0.4\n2 0.1 0.2 0.3 0.4 0.9\nbad line\n1 a b c d\n")
    got = files.yolo_labels(spark, str(tmp_path / "x.txt")).orderBy("class_id").collect()
    assert [(r.image, r.class_id, r.conf) for r in got] == [("x", 1, 1.0), ("x", 2, 0.9)]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "c.txt").write_text("0: brace\n1: clefG\nbad\nx: y\n")
    assert sorted(tuple(r) for r in files.class_dictionary(spark, str(tmp_path / "c.txt")).collect()) == [(0, "brace"), (1, "clefG")]
    (tmp_path / "m.json").write_text(json.dumps({"class_mapping": {"0": "a", "1": "b"}, "model_info": {}}))
    assert sorted(tuple(r) for r in files.class_mapping(spark, str(tmp_path / "m.json")).collect()) == [(0, "a"), (1, "b")]
    classes = spark.createDataFrame([(1, "clefG"), (0, "brace")], "id int, name string")
    assert sinks.dataset_yaml(classes, "/d").splitlines()[3:] == ["nc: 2", "names:", "  0: brace", "  1: clefG"]
    assert tuple(sinks.coverage_flags(classes, {"clefs": "clef", "rests": "rest"}).first()) == (True, False)
    assert sinks.require_classes(classes, ["brace"]).count() == 2
    with pytest.raises(Exception, match="missing classes"):
        sinks.require_classes(classes, ["stem"]).collect()


def test_page_range(spark):
    pages = spark.range(1, 8).withColumnRenamed("id", "page")
    assert sorted(r.page for r in files.page_range(spark, "2-4, 7,99", pages).collect()) == [2, 3, 4, 7]
    assert files.page_range(spark, None, pages).count() == 7


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", 2, "P2_00_001", 5), ("d", 1, "P1_00_001", 3), ("d", 2, "P2_00_002", 6)], "doc string, page int, measure_id string, x int")
    whole = json.loads(sinks.overall_document(rows).first().document)
    assert whole["total_measures"] == 3 and list(whole["pages"]) == ["1", "2"] and [m["x"] for m in whole["pages"]["2"]["measures"]] == [5, 6]
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {"a": "b"}, "pages": {"2": {"page_number": 2, "measures": {"m": "1"}, "symbols": {}}, "5": {}}}))
    assert sorted(r.page for r in files.stored_results(spark, str(tmp_path / "r.json")).collect()) == [2, 5]
    sinks.write_json(sinks.page_documents(rows), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("total_measures")).first()[0] == 3
    patched = sinks.upsert(rows, rows.where("page = 1").withColumn("x", F.lit(9)), ["doc", "page"])
    assert sorted(r.x for r in patched.collect()) == [5, 6, 9]


def test_kernels():
    gray = staff_page()
    mask = kernels.threshold_inverse(gray)
    assert kernels.staff_peaks(mask) == [40, 48, 56, 64, 72, 110, 118, 126, 134, 142]
    assert kernels.runs(np.array([1, 1, 0, 1], bool)) == [(0, 1), (3, 3)]
    segs = kernels.vertical_segments(mask, 60, 3)
    assert [s[0] for s in segs] == [60, 150, 240] and all(s[3] - s[1] >= 100 for s in segs)
    assert 0 <= kernels.otsu_level(gray) < 255 and kernels.otsu_inverse(gray)[40, 100]
    assert kernels.peaks(np.array([0, 1, 1, 1, 0, 5, 4, 5, 0.0]), 0.5, 3) == [2, 7]
    assert kernels.peaks(np.array([0, 2, 0, 1, 0.0]), 1.5) == [1]


def test_more_kernels():
    mask = np.zeros((30, 30), bool)
    mask[10, 5:16] = True
    assert kernels.has_horizontal_element(mask, 8, 12) and not kernels.has_horizontal_element(mask, 29, 29)
    gray = np.zeros((10, 20), np.uint8)
    out = kernels.letterboxed(gray, 40)
    assert out.shape == (40, 40) and (out[10:30] == 0).all() and (out[:10] == 255).all()
    assert (kernels.resampled(np.arange(4, dtype=np.uint8).reshape(2, 2), 4, 4, "nearest")[0] == [0, 0, 1, 1]).all()
    page = np.full((20, 20), 200, np.uint8)
    page[8:12, 9] = 0
    assert kernels.adaptive_inverse(page)[9, 9] and not kernels.adaptive_inverse(page)[0, 0]
    column = np.array([[1], [0], [0], [1], [0], [0], [0], [1]], bool)
    assert kernels.closed_columns(column)[:, 0].tolist() == [True, True, True, True, False, False, False, True]


def test_pages_to_measures(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(pgm(staff_page()))
    (tmp_path / "b.PGM").write_bytes(b"P6 nonsense")
    pages = files.decoded_pages(files.page_files(spark, str(tmp_path)))
    got = {r.name: r for r in pages.collect()}
    assert got["a.pgm"].width == 300 and got["a.pgm"].error is None and got["b.PGM"].error and got["b.PGM"].pixels is None
    lines = kernels.page_staff_peaks(pages, otsu=False).withColumnRenamed("name", "page")
    systems = measures.page_systems(lines)
    assert sorted((r.top, r.bottom) for r in systems.collect()) == [(40, 72), (110, 142)]
    bars = kernels.page_segments(pages, 60, otsu=False).select(F.col("name").alias("page"), F.col("x1").alias("x")).crossJoin(systems.select("system_idx"))
    agreed = measures.agreed_barlines(bars, systems)
    assert sorted({r.x for r in agreed.collect()}) == [60, 150, 240]
    assert agreed.count() >= 3
    crops = kernels.page_crops(pages, spark.createDataFrame([("a.pgm", "m", 55, 35, 10, 20), ("a.pgm", "edge", 295, 0, 20, 4)], "name string, crop_id string, x int, y int, w int, h int"))
    assert {r.crop_id: (r.width, r.height, len(r.pixels)) for r in crops.collect()} == {"m": (10, 20, 200), "edge": (5, 4, 20)}


def dark_box():
    def detect(width, height, pixels):
        g = np.frombuffer(pixels, np.uint8).reshape(height, width)
        ys, xs = np.nonzero(g < 128)
        return [(0, 0.9, int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())), (5, 0.1, 0, 0, 1, 1)] if len(ys) else []

    return detect


def test_detector_contract(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(pgm(staff_page()))
    (tmp_path / "empty.pgm").write_bytes(pgm(np.full((5, 5), 255, np.uint8)))
    pages = files.decoded_pages(files.page_files(spark, str(tmp_path)))
    from pyspark import cloudpickle as cp

    cp.register_pickle_by_value(__import__(__name__, fromlist=["x"]))
    found = detectors.detections(pages, dark_box, {0: "ink"})
    assert [(r.image, r.class_name, r.x1, r.y2) for r in found.collect()] == [("a.pgm", "ink", 10, 142)]
    assert {r.image: len(r.detections) for r in detectors.per_image(pages, found).collect()} == {"a.pgm": 1, "empty.pgm": 0}


def test_brackets(spark):
    systems = spark.createDataFrame([(1, i, 100 * i, 100 * i + 40) for i in range(4)], "page int, system_idx int, top int, bottom int")
    segs = spark.createDataFrame([(1, 20, 0, 80), (1, 24, 90, 140), (1, 22, 290, 345)], "page int, x int, y1 int, y2 int")
    got = measures.brackets(segs, systems).collect()
    assert [(r.x, r.y_start, r.y_end, list(r.covered_systems), r.pos) for r in got] == [(22, 0, 140, [0, 1], 1), (22, 290, 345, [3], 2)]


def test_signatures_follow_position_and_pages(spark):
    m = spark.createDataFrame([("d", p, 0, n, 100 * n) for p in (1, 2) for n in (1, 2, 3)], "doc string, page int, group_idx int, measure_number int, x_start int")
    det = spark.createDataFrame([("d", 1, 0, "timeSig3", 250), ("d", 1, 0, "clefG", 110), ("d", 2, 0, "timeSig6", 310)], "doc string, page int, group_idx int, class_name string, x int")
    got = signatures.per_measure(m, det).orderBy("page", "measure_number").collect()
    assert [(r.signature, r.beats) for r in got] == [("4/4", 4), ("3/4", 3), ("3/4", 3), ("3/4", 3), ("3/4", 3), ("6/8", 6)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pgm").write_bytes(pgm(staff_page()))
    q = streams.each_batch(streams.page_stream(spark, str(src)), files.decoded_pages, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().width == 300
    rows = tmp_path / "rows"
    rows.mkdir()
    (rows / "1.json").write_text('{"doc":"d","page":1,"measure_number":1}\n{"doc":"d","page":1,"measure_number":2,"sig":"3/4"}\n')
    stream = streams.carried_signatures(streams.json_stream(spark, str(rows), "doc string, page int, measure_number int, sig string"))
    for k in (1, 2):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "sig")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        (rows / "2.json").write_text('{"doc":"d","page":2,"measure_number":1}\n{"doc":"e","page":1,"measure_number":1}\n')
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "sig")).select("doc", "page", "measure_number", "signature").collect())
    assert got == [("d", 1, 1, "4/4"), ("d", 1, 2, "3/4"), ("d", 2, 1, "3/4"), ("e", 1, 1, "4/4")]


def test_page_range_query_on_a_catalogue_of_more_pages(spark, tmp_path):
    import __spark_entry__

    spark.range(0, 6000, 3).selectExpr("id AS user_id").union(spark.createDataFrame([(5000,)], "id long")).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.page for r in __spark_entry__.queries()["page_range"](spark, str(tmp_path)).collect()) == [3, 6, 9, 42, 120]
