"""More of the driver's queries: parsed files, page images, manual edits, reports, datasets; each with the SQL of its result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kernels
from ..functions import labels as names
from ..operators import aggregates, joins, sampling, validation, windows
from ..rounds import new_folder
from ..sources import detectors, files, named_files, pdf, sinks
from . import dataset, pages, signatures, symbols
from . import measures as mp
from .adapters import BARLINES, BOXES, PIXELS_SQL, PLACES, SEGMENTS, STAFFS, derived, pixels, table
from .queries import CONSENSUS_SQL, SYMBOLS, SYSTEMS_SQL, query

# files


DOCUMENT_SQL = """WITH l AS (SELECT o_orderkey % 5 AS k, l_orderkey AS img, l_orderkey * 10 + l_linenumber AS ann, CASE WHEN min(l_partkey) % 7 < 5 THEN min(l_partkey) % 7 END AS cat, min(l_suppkey) % 50 AS x, l_linenumber AS n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_orderkey, l_linenumber)"""


#: Orders whose annotations make one part of a document (as many keys, a fifth of them in a shard, up to seven lines each).
PART_ORDERS = 20_000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, part, annotations): the members of the shards' annotation maps as text, without the braces, in parts of bounded size."""
    rows = derived(spark, sf_dir, DOCUMENT_SQL.removeprefix("WITH l AS (").removesuffix(")"))
    box = F.when(F.col("n") < 7, F.array(*[(F.col("x") + i).cast("double") for i in (0, 1, 2, 3)])).otherwise(F.array(F.lit(1.0)))
    one = F.struct(F.array(F.lit(None).cast("string"), F.lit(""), F.col("cat").cast("string")).alias("cat_id"), F.col("img").cast("string").alias("img_id"), box.alias("a_bbox"))
    member = F.concat(F.lit('"'), F.col("ann").cast("string"), F.lit('":'), F.to_json(one)).alias("member")
    members = rows.select("k", F.floor(F.col("img") / PART_ORDERS).alias("part"), member)
    return members.groupBy(F.col("k").alias("shard"), "part").agg(F.array_join(F.collect_list("member"), ",").alias("annotations"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): annotation documents as text, those of a shard in folders by part, so that no row holds a shard."""
    body = F.concat(F.lit('{"annotations":{'), "annotations", F.lit("}}"))
    return _parts(spark, sf_dir).select(F.format_string("part-%d/set-%d.json", "part", "shard").alias("file"), body.alias("value"))


def _whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, part, content): a document for each shard, in the pieces of which it is written."""
    parts = _parts(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("shard").orderBy("part")) == 1
    ends = parts.select("shard").distinct().select("shard", F.lit(None).cast("long").alias("part"), F.lit("}}").alias("content"))
    # the first piece opens the document; null, taken as the largest number, closes it
    order = parts.select("shard", "part").withColumn("first", first)
    pieces = parts.join(order, ["shard", "part"]).select("shard", "part", F.concat(F.when(F.col("first"), '{"annotations":{').otherwise(","), "annotations").alias("content"))
    return pieces.union(ends).select(F.format_string("set-%d.json", "shard").alias("file"), F.coalesce("part", F.lit((1 << 63) - 1)).alias("part"), "content")


@query(f"{DOCUMENT_SQL} SELECT CAST(k AS INT) AS shard, CAST(ann AS VARCHAR) AS ann_id, CAST(img AS VARCHAR) AS image_id, CAST(cat AS VARCHAR) AS category_id, CAST(x + 2 AS DOUBLE) AS x2 FROM l WHERE cat IS NOT NULL AND cat <> 4 AND n < 7")
def annotation_scan(spark, sf_dir):
    rows = files.annotations(files.annotation_documents(_documents(spark, sf_dir)), excluded=["4"])
    return rows.select("shard", "ann_id", "image_id", "category_id", F.col("box")[2].alias("x2"))


@query(f"{DOCUMENT_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE cat IS NOT NULL AND cat <> 4 AND n < 7) AS kept, count(*) FILTER (WHERE cat = 4 AND n < 7) AS excluded, count(*) FILTER (WHERE cat IS NULL) AS without_category, count(*) FILTER (WHERE cat IS NOT NULL AND n >= 7) AS without_box FROM l")
def annotation_counters(spark, sf_dir):
    return files.annotation_counters(files.annotation_documents(_documents(spark, sf_dir)), ["4"])


@query("SELECT event_type AS image, CAST(user_id AS INT) AS class_id, round(value, 6) AS xc, CAST(0.25 AS DOUBLE) AS yc, CAST(0.5 AS DOUBLE) AS w, CAST(0.125 AS DOUBLE) AS h, CAST(CASE WHEN event_id % 5 = 0 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS conf FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5")
def label_scan(spark, sf_dir):
    """Lines of five or six numbers; others, and lines of words, are skipped."""
    text = F.when(F.col("event_id") % 7 == 3, "only four numbers 1").when(F.col("event_id") % 11 == 5, "a b c d e").otherwise(F.format_string("  %d %.6f 0.25\t0.5  0.125%s", "user_id", F.round("value", 6), F.when(F.col("event_id") % 5 == 0, " 0.75").otherwise("")))
    return files.label_numbers(table(spark, sf_dir, "events").select(F.col("event_type").alias("image"), text.alias("value")))


@query("SELECT CAST(p_partkey AS INT) AS id, p_name || ': x' AS name FROM part WHERE p_partkey % 3 = 0")
def class_lines(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.format_string("%d: %s: x", key, "p_name")).when(key % 3 == 1, F.col("p_name")).otherwise(F.format_string("n%d: %s", key, "p_name"))
    return files.class_lines(table(spark, sf_dir, "part").select(text.alias("value")))


@query("SELECT event_type AS file, CAST(u AS INT) AS page, CAST(n AS VARCHAR) AS events FROM (SELECT event_type, user_id AS u, count(*) AS n FROM events GROUP BY 1, 2)")
def result_pages(spark, sf_dir):
    """Pages of stored results, their number read from the key where the page lacks it."""
    per = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    number = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("int"))
    value = F.struct(number.alias("page_number"), F.create_map(F.lit("events"), F.col("n").cast("string")).alias("measures"), F.create_map(F.lit("x"), F.lit("y")).alias("symbols"))
    documents = per.groupBy(F.col("event_type").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("user_id").cast("string"), value))).alias("pages"))
    return files.result_pages(documents).select("file", "page", F.col("measures")["events"].alias("events"))


@query("WITH p AS (SELECT DISTINCT event_type AS file, user_id * 7 % 400 AS page FROM events) SELECT file, coalesce(min(page) FILTER (WHERE page = 14), min(page)) AS page FROM p GROUP BY 1")
def stored_page(spark, sf_dir):
    return files.stored_page(table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), (F.col("user_id") * 7 % 400).alias("page")).distinct(), 14)


@query("SELECT DISTINCT user_id AS page FROM events WHERE user_id BETWEEN 3 AND 9 OR user_id IN (1, 42, 120)")
def page_range(spark, sf_dir):
    """The last page asked for lies beyond the end: 5000, or the one after the last where the catalogue goes so far."""
    catalogue = table(spark, sf_dir, "events").select(F.col("user_id").alias("page")).distinct()
    last = catalogue.agg(F.max("page")).first()[0] or 0
    return files.page_range(spark, f"1, 3-9,42,120,{max(5000, last + 1)}", catalogue)


@query("SELECT p_partkey, regexp_replace(p_name, '[.][^.]*$', '') AS stem FROM (SELECT p_partkey, replace(p_name, ' ', '.') AS p_name FROM part)")
def file_stems(spark, sf_dir):
    path = F.concat(F.lit("/data/a.b/"), F.replace("p_name", F.lit(" "), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", names.stem(path).alias("stem"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS folder, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", names.stamp(F.col("o_orderdate")).alias("folder"), names.stamp(F.col("o_orderdate"), iso=True).alias("iso"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type WHEN user_id <> 0 THEN CAST(user_id AS VARCHAR) ELSE '[' || event_id || ']' END AS value FROM events")
def first_true_value(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    found = names.first_true((text, "text"), (F.col("user_id"), "number"), (F.array("event_id"), "list"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("value"))


@query("SELECT bool_or(contains(lower(p_name), 'widget')) AS widgets, bool_or(contains(lower(p_name), 'zeppelin')) AS zeppelins, bool_or(contains(lower(p_name), 'ring')) AS rings FROM part")
def coverage_flags(spark, sf_dir):
    return sinks.coverage_flags(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), {"widgets": "widget", "zeppelins": "zeppelin", "rings": "ring"})


@query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM part WHERE p_size = 7")
def excluded_classes(spark, sf_dir):
    """The document of left-out classes, read back."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("name"))
    back = F.from_json("document", "n long, excluded array<struct<id: long, name: string>>").alias("d")
    return sinks.excluded_classes(rows, ["7"]).select(back).select("d.n", F.aggregate("d.excluded", F.lit(0).cast("long"), lambda a, c: a + c["id"]).alias("ids"))


@query("SELECT DISTINCT event_type AS name FROM events")
def required_classes(spark, sf_dir):
    return sinks.require_classes(table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct(), ["click", "error"])


@query("SELECT user_id AS doc, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT event_type) AS BIGINT) AS pages FROM events GROUP BY 1")
def overall_documents(spark, sf_dir):
    """One document of all pages, read back as a map by page."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("page"), "event_id")
    back = F.from_json("document", "total_measures long, pages map<string, struct<page: string, measures: array<struct<event_id: long>>>>").alias("d")
    return sinks.overall_document(rows).select("doc", back).select("doc", F.col("d.total_measures").alias("total"), F.size("d.pages").cast("long").alias("pages"))


# boxes and detections


@query(f"SELECT id, round((x1 + w / 2.0) / 1000, 9) AS xc, round((y1 + h / 2.0) / 1300, 9) AS yc, round(w / 1000.0, 9) AS w, round(h / 1300.0, 9) AS h FROM ({BOXES}) WHERE (x1 + w / 2.0) / 1000 <= 1 AND (y1 + h / 2.0) / 1300 <= 1 AND x1 + w <= 1000 AND y1 + h <= 1300")
def valid_center_boxes(spark, sf_dir):
    c = geo.corner_to_center("x1", "y1", "w", "h", F.lit(1000), F.lit(1300))
    rows = derived(spark, sf_dir, BOXES).select("id", c.alias("c")).select("id", "c.*").where(geo.center_box_valid())
    return rows.select("id", *[F.round(k, 9).alias(k) for k in ("xc", "yc", "w", "h")])


@query(f"SELECT system, CAST(greatest(5, trunc(h * 0.2)) AS INT) AS threshold, CAST(greatest(3, trunc(s * 0.5)) AS INT) AS min_length, CAST(greatest(2, trunc(s * 0.3)) AS INT) AS max_gap FROM (SELECT DISTINCT image AS system, image + 20 AS h, (image + 20) / 4.0 AS s FROM ({BOXES}))")
def search_parameters(spark, sf_dir):
    from ..config import DEFAULT

    rows = derived(spark, sf_dir, BOXES).select(F.col("image").alias("system"), (F.col("image") + 20).alias("h")).distinct()
    return rows.withColumn("s", F.col("h") / 4.0).select("system", *geo.hough_parameters("h", "s", DEFAULT))


@query(f"SELECT image, count(*) AS n, CAST(sum(CAST(trunc(x1 / 1000.0 * 500 + 0.0000001) AS INT)) AS BIGINT) AS x, CAST(sum(CAST(trunc(y2 / 1300.0 * 700 + 0.0000001) AS INT)) AS BIGINT) AS y FROM ({BOXES}) GROUP BY 1")
def stored_boxes_to_pixels(spark, sf_dir):
    """Nested boxes in shares of the page, put on a page of another size."""
    box = F.struct("id", (F.col("x1") / 1000.0 + 1e-7 / 500).alias("x1"), (F.col("y2") / 1300.0 + 1e-7 / 700).alias("y2"))
    rows = derived(spark, sf_dir, BOXES).groupBy("image").agg(F.collect_list(box).alias("boxes"))
    moved = rows.select("image", geo.boxes_to_pixels("boxes", ["id", "x1", "y2"], F.lit(500), F.lit(700)).alias("b"))
    total = lambda c: F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + b[c])
    return moved.select("image", F.size("b").cast("long").alias("n"), total("x1").alias("x"), total("y2").alias("y"))


@query(f"SELECT id, CAST(trunc(x1 / 1000.0 * 640 + 0.0000001) AS INT) AS a, CAST(trunc(y1 / 1300.0 * 480 + 0.0000001) AS INT) AS b, CAST(trunc(x2 / 1000.0 * 640 + 0.0000001) AS INT) AS c, CAST(trunc(y2 / 1300.0 * 480 + 0.0000001) AS INT) AS d FROM ({BOXES})")
def box_to_pixels(spark, sf_dir):
    shares = F.array(*[F.col(c) / w + 1e-7 / p for c, w, p in (("x1", 1000.0, 640), ("y1", 1300.0, 480), ("x2", 1000.0, 640), ("y2", 1300.0, 480))])
    rows = derived(spark, sf_dir, BOXES).select("id", shares.alias("box")).select("id", geo.box_to_pixels("box", F.lit(640), F.lit(480)).alias("p"))
    return rows.select("id", *[F.col("p")[i].alias(n) for i, n in enumerate("abcd")])


@query(f"SELECT DISTINCT w, h, round(least(640.0 / w, 640.0 / h), 9) AS scale, CAST(floor((640 - trunc(w * least(640.0 / w, 640.0 / h))) / 2) AS BIGINT) AS x, CAST(floor((640 - trunc(h * least(640.0 / w, 640.0 / h))) / 2) AS BIGINT) AS y FROM ({BOXES})")
def page_fits(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select("w", "h").distinct()
    return rows.select("w", "h", geo.page_fit("w", "h", 640).alias("f")).select("w", "h", F.round("f.scale", 9).alias("scale"), F.col("f.x").cast("long").alias("x"), F.col("f.y").cast("long").alias("y"))


@query(f"SELECT id, image, CAST(row_number() OVER (PARTITION BY image ORDER BY confidence DESC, id) AS INT) AS place FROM ({BOXES}) WHERE confidence >= 25")
def confident_detections(spark, sf_dir):
    found = detectors.confident(derived(spark, sf_dir, BOXES).select("id", "image", "confidence"), 25)
    return sampling.by_confidence(found, ["image"]).select("id", "image", "place")


@query(f"SELECT image, x1, y1, x2, y2, CAST(row_number() OVER (PARTITION BY image ORDER BY (x1 + x2) / 2.0, (y1 + y2) / 2.0, x1, y1, x2, y2) AS INT) AS place FROM ({BOXES})")
def reading_order(spark, sf_dir):
    return sampling.reading_order(derived(spark, sf_dir, BOXES).select("image", "x1", "y1", "x2", "y2"), ["image"])


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def head_of_documents(spark, sf_dir):
    return sampling.head(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query(f"SELECT count(*) FILTER (WHERE cls IN (1, 4)) AS shown, count(*) AS total, count(*) FILTER (WHERE cls IN (1, 4)) || ' of ' || count(*) || ' shown' AS label FROM ({BOXES})")
def shown_detections(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select(F.col("cls").alias("class_name"))
    shown = spark.createDataFrame([(1,), (4,)], "class_name long")
    counted = sampling.shown_of(rows, shown)
    return counted.join(sampling.visible(rows, shown).agg(F.count(F.lit(1)).alias("n")), F.col("n") == F.col("shown")).drop("n")


@query(f"SELECT page, id FROM ({SEGMENTS}) WHERE id % 3 <> 1")
def well_formed_boxes(spark, sf_dir):
    box = F.when(F.col("id") % 3 == 1, F.array("x1", F.lit(None).cast("long"), "x2", "y2")).otherwise(F.array("x1", "y1", "x2", "y2"))
    more = derived(spark, sf_dir, SEGMENTS).withColumn("box", box)
    short = more.withColumn("box", F.slice("box", 1, 3))
    return validation.well_formed(more.union(short)).select("page", "id")


@query(f"WITH b AS ({BOXES}), s AS (SELECT image, cls, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, image) AS r FROM s), u AS (SELECT DISTINCT image FROM r WHERE r <= 50) SELECT image FROM u ORDER BY md5(CAST(image AS VARCHAR) || '-42'), image LIMIT 60")
def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(aggregates.per_image_counts(derived(spark, sf_dir, BOXES)), 60, 7).select("image")


@query(f"WITH b AS ({BOXES}), g AS (SELECT CASE WHEN CAST('0x' || substr(md5(CAST(image AS VARCHAR) || '-42'), 1, 7) AS BIGINT) % 10000 < 8500 THEN 'train' ELSE 'val' END AS split, image, count(*) FILTER (WHERE cls <> 6 AND x2 <= 900 AND y2 <= 1190) AS n FROM b GROUP BY image) SELECT split, count(*) AS images, CAST(sum(n) AS BIGINT) AS labels FROM g GROUP BY 1")
def dataset_parts(spark, sf_dir):
    """Annotations of six of seven classes, on pages that some boxes leave."""
    rows = derived(spark, sf_dir, BOXES).select(F.col("id").alias("ann_id"), F.col("image").alias("image_id"), F.array(F.col("cls").cast("string")).alias("cat_ids"), F.array("x1", "y1", "x2", "y2").alias("box"))
    images = rows.select(F.col("image_id").alias("id")).distinct().withColumns({"width": F.lit(900), "height": F.lit(1190)})
    cats = spark.createDataFrame([(str(i), f"c{i}") for i in range(7)], "id string, name string")
    return dataset.prepared(rows, images, cats, ["c6"])["counts"]


@query(f"SELECT image, count(*) AS n, max(confidence) AS first FROM ({BOXES}) WHERE confidence >= 50 GROUP BY 1 UNION ALL SELECT 1000, 0, NULL")
def detections_by_image(spark, sf_dir):
    """Every page has a row, that without detections an empty one."""
    rows = detectors.confident(derived(spark, sf_dir, BOXES), 50).select(F.col("image").cast("string").alias("image"), "confidence", F.col("cls").alias("class_id"), F.col("cls").cast("string").alias("class_name"), "x1", "y1", "x2", "y2")
    named = rows.select(F.col("image").alias("name")).distinct().union(spark.createDataFrame([("1000",)], "name string"))
    found = detectors.per_image(named, rows)
    return found.select(F.col("image").cast("long").alias("image"), F.size("detections").cast("long").alias("n"), F.get("detections", F.lit(0))["confidence"].alias("first"))


@query(f"""WITH s AS (SELECT page, id, floor((x1 + x2) / 2.0) AS x, floor((y1 + y2) / 2.0) AS y FROM ({SEGMENTS}) WHERE abs(CASE WHEN x2 = x1 THEN 90.0 ELSE degrees(atan((y2 - y1) / CAST(x2 - x1 AS DOUBLE))) END) > 75),
 n AS (SELECT image AS page, id AS target_id, floor((x1 + x2) / 2.0) AS x, floor((y1 + y2) / 2.0) AS y FROM ({BOXES}) WHERE cls IN (0, 1, 2)), m AS (SELECT s.page, s.id, target_id, (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) AS d FROM s JOIN n ON s.page = n.page)
 SELECT page, id, target_id AS associated_notehead FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY d, target_id) AS k FROM m WHERE d <= 900) WHERE k = 1""")
def stems_of_detections(spark, sf_dir):
    kind = F.when(F.col("cls") < 3, F.get(F.array(*[F.lit(n) for n in names.NOTEHEADS]), F.col("cls").cast("int"))).otherwise("flag8thUp")
    boxes = derived(spark, sf_dir, BOXES).select(F.col("image").alias("page"), "id", kind.alias("class_name"), "x1", "y1", "x2", "y2")
    return symbols.stems_of_detections(derived(spark, sf_dir, SEGMENTS), boxes).select("page", "id", "associated_notehead")


# manual edits, lookups


@query(f"WITH c AS (SELECT image AS page, x1 * 2 AS cx FROM ({BOXES})), m AS (SELECT c.page, cx, id, abs(x - cx) AS d FROM c JOIN ({PLACES}) p ON p.page = c.page WHERE abs(x - cx) < 4), g AS (SELECT DISTINCT page, id FROM (SELECT *, row_number() OVER (PARTITION BY page, cx ORDER BY d, id) AS r FROM m) WHERE r = 1) SELECT p.page, p.id FROM ({PLACES}) p LEFT JOIN g ON p.page = g.page AND p.id = g.id WHERE g.id IS NULL")
def nearest_removed(spark, sf_dir):
    clicks = derived(spark, sf_dir, BOXES).select(F.col("image").alias("page"), (F.col("x1") * 2).alias("x"))
    return joins.without_nearest(derived(spark, sf_dir, PLACES), clicks, ["page"], 4).select("page", "id")


@query(f"WITH c AS (SELECT image AS page, x1 * 2 AS cx FROM ({BOXES})), p AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'regular' END AS type FROM ({PLACES})) SELECT p.page, p.id, p.type FROM p WHERE type = 'regular' OR NOT EXISTS (SELECT 1 FROM c WHERE c.page = p.page AND abs(p.x - cx) < 4)")
def manual_removed(spark, sf_dir):
    clicks = derived(spark, sf_dir, BOXES).select(F.col("image").alias("page"), (F.col("x1") * 2).alias("x"))
    rows = derived(spark, sf_dir, PLACES).withColumn("type", F.when(F.col("id") % 3 == 0, "manual").otherwise("regular"))
    return joins.without_manual(rows, clicks, ["page"], 4).select("page", "id", "type")


SPANS_SQL = f"SELECT page, id % 5 AS group_idx, min(y1) AS top, min(y1) + 120 AS bottom FROM ({SEGMENTS}) GROUP BY 1, 2"


@query(f"WITH s AS ({SPANS_SQL}), p AS (SELECT id, page, x % 700 AS y FROM ({PLACES})) SELECT p.id, min(group_idx) AS group_idx FROM p LEFT JOIN s ON p.page = s.page AND p.y BETWEEN top AND bottom GROUP BY p.id")
def group_at_point(spark, sf_dir):
    points = derived(spark, sf_dir, PLACES).select("id", "page", (F.col("x") % 700).alias("y"))
    return joins.group_at(points, derived(spark, sf_dir, SPANS_SQL), ["page"]).select("id", "group_idx")


@query(f"WITH s AS ({SPANS_SQL}), p AS (SELECT id, page, x, x % 700 AS y FROM ({PLACES})), g AS (SELECT p.id, any_value(p.page) AS page, any_value(p.x) AS x, min(group_idx) AS group_idx FROM p JOIN s ON p.page = s.page AND p.y BETWEEN top AND bottom GROUP BY p.id) SELECT 'manual' AS type, g.page, g.x, g.group_idx, top AS y_start, bottom AS y_end FROM g JOIN s ON s.page = g.page AND s.group_idx = g.group_idx UNION ALL SELECT NULL, page, x, system_idx, NULL, NULL FROM ({BARLINES})")
def manual_added(spark, sf_dir):
    clicks = derived(spark, sf_dir, PLACES).select("page", "x", (F.col("x") % 700).alias("y"))
    bars = derived(spark, sf_dir, BARLINES).select("page", "x", F.col("system_idx").cast("long").alias("group_idx"))
    return joins.with_manual(bars, clicks, derived(spark, sf_dir, SPANS_SQL), ["page"]).select("type", "page", "x", "group_idx", "y_start", "y_end")


@query(f"SELECT p.id, m.box FROM ({PLACES}) p LEFT JOIN (SELECT image AS page, cls, arg_min(x1, id) AS box FROM ({BOXES}) GROUP BY 1, 2) m ON m.page = p.page AND m.cls = p.x % 9")
def first_match(spark, sf_dir):
    boxes = derived(spark, sf_dir, BOXES).select(F.col("image").alias("page"), "cls", "id", F.col("x1").alias("box"))
    rows = derived(spark, sf_dir, PLACES).withColumn("cls", F.col("x") % 9)
    return joins.first_match(rows, boxes, ["page", "cls"], "id").select("id", "box")


# reports


@query(f"SELECT page, group_idx, max(k) AS measure_count, count(DISTINCT s) AS system_count FROM (SELECT page, x % 3 AS group_idx, x % 11 AS k, x % 4 AS s FROM ({PLACES})) GROUP BY 1, 2")
def group_measures(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).select("page", (F.col("x") % 3).alias("group_idx"), (F.col("x") % 11).alias("measure_number"), (F.col("x") % 4).alias("system_idx"))
    return aggregates.group_measures(rows, ["page"])


@query(f"SELECT page, system_idx AS group_idx, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS xs FROM ({BARLINES}) GROUP BY 1, 2")
def barlines_by_group(spark, sf_dir):
    out = aggregates.barlines_by_group(derived(spark, sf_dir, BARLINES).withColumnRenamed("system_idx", "group_idx"), ["page"])
    return out.select("page", "group_idx", F.array_join(F.col("xs").cast("array<string>"), ",").alias("xs"))


@query(f"SELECT image, arg_min(id, x1 * 100000000 + id) AS id, min(x1) AS x1 FROM ({BOXES}) GROUP BY 1")
def leftmost_symbol(spark, sf_dir):
    return aggregates.leftmost(derived(spark, sf_dir, BOXES).select("image", "x1", "id"), ["image"])


TIMESIGS = f"SELECT event_id AS id, user_id AS doc, event_id % 4 AS page, event_id * 101 % 1009 AS x1, CASE WHEN event_id % 9 < 3 THEN 'timeSig4' WHEN event_id % 9 < 5 THEN 'timeSig3' WHEN event_id % 9 = 5 THEN 'timeSigCommon' ELSE 'clefG' END AS class_name FROM events"


@query(f"SELECT doc, page, CASE WHEN c IN ('timeSig4', 'timeSigCommon') THEN '4/4' ELSE replace(c, 'timeSig', '') END AS signature, votes FROM (SELECT doc, page, arg_min(class_name, -n * 1000000000 + f) AS c, max(n) AS votes FROM (SELECT doc, page, class_name, count(*) AS n, min(id) AS f FROM ({TIMESIGS}) WHERE class_name <> 'clefG' GROUP BY 1, 2, 3) GROUP BY 1, 2)")
def likely_signature(spark, sf_dir):
    rows = derived(spark, sf_dir, TIMESIGS).where("class_name <> 'clefG'")
    return aggregates.likely_signature(rows, ["doc", "page"], "id").select("doc", "page", "signature", "votes")


TOTALS_SQL = f"""WITH p AS (SELECT DISTINCT doc, page FROM ({TIMESIGS})), m AS (SELECT doc, page, sum(k) AS measures FROM (SELECT page AS doc, id % 4 AS page, x % 3 AS g, max(x % 11) AS k FROM ({PLACES}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 s AS (SELECT doc, page, count(*) AS symbols, count(*) FILTER (WHERE class_name <> 'clefG') AS sigs FROM ({TIMESIGS}) GROUP BY 1, 2),
 l AS (SELECT doc, page, CASE WHEN c IN ('timeSig4', 'timeSigCommon') THEN '4/4' ELSE replace(c, 'timeSig', '') END AS signature FROM (SELECT doc, page, arg_min(class_name, -n * 1000000000 + f) AS c FROM (SELECT doc, page, class_name, count(*) AS n, min(id) AS f FROM ({TIMESIGS}) WHERE class_name <> 'clefG' GROUP BY 1, 2, 3) GROUP BY 1, 2)),
 v AS (SELECT doc, arg_min(signature, -n * 1000 + f) AS common FROM (SELECT doc, signature, count(*) AS n, min(page) AS f FROM l GROUP BY 1, 2) GROUP BY 1)
 SELECT p.doc, count(*) AS pages, CAST(sum(coalesce(measures, 0)) AS BIGINT) AS measures, CAST(sum(coalesce(symbols, 0)) AS BIGINT) AS symbols, CAST(sum(coalesce(sigs, 0)) AS BIGINT) AS time_signatures, coalesce(any_value(common), 'Not detected') AS common_signature
 FROM p LEFT JOIN m ON m.doc = p.doc AND m.page = p.page LEFT JOIN s ON s.doc = p.doc AND s.page = p.page LEFT JOIN v ON v.doc = p.doc GROUP BY 1"""


def _report(spark, sf_dir):
    found = derived(spark, sf_dir, TIMESIGS)
    rows = derived(spark, sf_dir, PLACES).select(F.col("page").alias("doc"), (F.col("id") % 4).alias("page"), (F.col("x") % 3).alias("group_idx"), (F.col("x") % 11).alias("measure_number"), F.lit(0).alias("system_idx"))
    return pages.document_report(rows, found, found.select("doc", "page"))


@query(TOTALS_SQL)
def document_totals(spark, sf_dir):
    return _report(spark, sf_dir)["totals"]


@query(f"SELECT doc, pages, measures, symbols FROM ({TOTALS_SQL})")
def document_results(spark, sf_dir):
    """The documents of whole results, read back."""
    back = F.from_json("document", "metadata struct<total_pages: long, total_measures: long, total_symbols: long>, pages map<string, struct<page_number: long>>").alias("d")
    return _report(spark, sf_dir)["documents"].select("doc", back).select("doc", F.size("d.pages").cast("long").alias("pages"), F.col("d.metadata.total_measures").alias("measures"), F.col("d.metadata.total_symbols").alias("symbols"))


@query(f"WITH m AS (SELECT DISTINCT page AS doc, x % 3 AS page, x % 4 AS group_idx, x % 6 AS measure_number FROM ({PLACES})) SELECT *, CAST(row_number() OVER w AS INT) AS position, lead(page) OVER w AS next_page, lead(group_idx) OVER w AS next_group, lead(measure_number) OVER w AS next_measure FROM m WINDOW w AS (PARTITION BY doc ORDER BY page, group_idx, measure_number)")
def playing_order(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).select(F.col("page").alias("doc"), (F.col("x") % 3).alias("page"), (F.col("x") % 4).alias("group_idx"), (F.col("x") % 6).alias("measure_number"))
    return windows.playing_order(rows, ["doc"])


MEASURED = f"SELECT page AS doc, id % 3 AS page, x % 2 AS group_idx, x AS x_start, row_number() OVER (PARTITION BY page, id % 3, x % 2 ORDER BY x, id) AS measure_number FROM (SELECT page, min(id) AS id, x FROM ({PLACES}) GROUP BY page, x)"
FOUND = f"SELECT page AS doc, id % 3 AS page, id % 2 AS group_idx, x, id, CASE id % 5 WHEN 0 THEN 'timeSig3' WHEN 1 THEN 'timeSig6' WHEN 2 THEN 'timeSigX' ELSE 'clefG' END AS class_name FROM (SELECT user_id AS page, event_id AS id, event_id * 101 % 1009 * 3 + 1 AS x FROM events)"


@query(f"""WITH m AS ({MEASURED}), d AS (SELECT *, CASE id % 5 WHEN 0 THEN '3/4' WHEN 1 THEN '6/8' END AS s FROM ({FOUND}) WHERE id % 5 < 2),
 a AS (SELECT d.doc, d.page, d.group_idx, m.measure_number, d.s, d.x, d.id FROM d ASOF JOIN m ON d.doc = m.doc AND d.page = m.page AND d.group_idx = m.group_idx AND d.x >= m.x_start),
 f AS (SELECT doc, page, group_idx, measure_number, min(struct_pack(x := x, s := s)).s AS s FROM a GROUP BY 1, 2, 3, 4)
 SELECT m.doc, m.page, m.group_idx, m.measure_number, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY m.doc ORDER BY m.page, m.group_idx, m.measure_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '4/4') AS signature
 FROM m LEFT JOIN f ON m.doc = f.doc AND m.page = f.page AND m.group_idx = f.group_idx AND m.measure_number = f.measure_number""")
def measure_signatures(spark, sf_dir):
    out = signatures.per_measure(derived(spark, sf_dir, MEASURED), derived(spark, sf_dir, FOUND).drop("id"))
    return out.select("doc", "page", "group_idx", F.col("measure_number").cast("long").alias("measure_number"), "signature")


@query(f"""WITH {SYSTEMS_SQL}, t AS (SELECT page, count(*) * 5 AS staff_lines, count(*) AS systems, count(DISTINCT group_idx) AS groups FROM sg GROUP BY 1), n AS (SELECT page, count(*) AS n FROM ({BARLINES}) GROUP BY page, system_idx), b AS (SELECT page, CAST(sum(n) AS BIGINT) AS barlines, CASE WHEN max(n) >= 2 THEN max(n) - 1 ELSE 0 END AS measures FROM n GROUP BY 1)
 SELECT t.page, CAST(staff_lines AS BIGINT) AS staff_lines, systems, groups, coalesce(barlines, 0) AS barlines, coalesce(measures, 0) AS measures FROM t LEFT JOIN b ON t.page = b.page""")
def page_summary(spark, sf_dir):
    return aggregates.page_summary(mp.page_systems(derived(spark, sf_dir, STAFFS)), derived(spark, sf_dir, BARLINES), ["page"])


@query(f"""WITH s AS (SELECT page, x % 9 AS system_idx, min(x) AS top, max(x) AS bottom FROM ({PLACES}) GROUP BY 1, 2), r AS (SELECT page, system_idx, greatest(0, top - CASE WHEN a IS NULL THEN bottom - top ELSE CAST(floor((top - a) / 2.0) AS BIGINT) END) AS t, bottom + CASE WHEN b IS NULL THEN bottom - top ELSE CAST(floor((b - bottom) / 2.0) AS BIGINT) END AS b FROM (SELECT *, lag(bottom) OVER w AS a, lead(top) OVER w AS b FROM s WINDOW w AS (PARTITION BY page ORDER BY system_idx)))
 SELECT g.id, coalesce(r.t, greatest(0, y1 - CAST(trunc((y2 - y1) * 0.3) AS INT))) AS y_top, coalesce(r.b, y2 + CAST(trunc((y2 - y1) * 0.3) AS INT)) AS y_bottom FROM ({SEGMENTS}) g LEFT JOIN r ON r.page = g.page AND r.system_idx = g.x1 % 12""")
def y_ranges_of_measures(spark, sf_dir):
    systems = derived(spark, sf_dir, PLACES).groupBy("page", (F.col("x") % 9).alias("system_idx")).agg(F.min("x").alias("top"), F.max("x").alias("bottom"))
    rows = derived(spark, sf_dir, SEGMENTS).select("id", "page", (F.col("x1") % 12).alias("system_idx"), F.col("y1").alias("top"), F.col("y2").alias("bottom"))
    return windows.with_y_ranges(rows, systems, ["page"]).select("id", "y_top", "y_bottom")


@query(f"SELECT count(*) AS measures, CAST(sum(CAST(round(x / 1200.0 * 1e6) AS BIGINT)) AS BIGINT) AS x, CAST(sum(CAST(round(width / 1200.0 * 1e6) AS BIGINT)) AS BIGINT) AS width FROM (WITH {CONSENSUS_SQL}, st AS (SELECT page, group_idx, x FROM co UNION ALL SELECT DISTINCT page, group_idx, 0 FROM co), iv AS (SELECT page, group_idx, x, lead(x) OVER (PARTITION BY page, group_idx ORDER BY x) - x AS width FROM st) SELECT iv.x, iv.width FROM iv JOIN sg ON iv.page = sg.page AND iv.group_idx = sg.group_idx WHERE width >= 20)")
def measures_in_shares(spark, sf_dir):
    systems = mp.page_systems(derived(spark, sf_dir, STAFFS))
    found = mp.measures(mp.agreed_barlines(derived(spark, sf_dir, BARLINES), systems), systems).withColumn("name", F.col("page"))
    sizes = systems.select(F.col("page").alias("name")).distinct().withColumns({"width": F.lit(1200.0), "height": F.lit(2000.0)})
    micro = lambda c: F.sum(F.round(F.col(f"bbox.{c}") * 1e6).cast("long"))
    return pages.in_shares(found, sizes).agg(F.count(F.lit(1)).alias("measures"), micro("x").alias("x"), micro("width").alias("width"))


# pixels


@query(f"""WITH p AS ({PIXELS_SQL}), l AS (SELECT page, 4 * k AS y FROM (SELECT DISTINCT page FROM p), (SELECT unnest(range(1, 11)) AS k))
 SELECT b.page, b.x, count(DISTINCT l.y) AS n FROM (SELECT DISTINCT page, x FROM p) b JOIN l ON l.page = b.page JOIN p ON p.page = b.page AND p.x = b.x AND p.y BETWEEN l.y - 2 AND l.y + 2 GROUP BY 1, 2""")
def staff_crossings(spark, sf_dir):
    """Lines four rows apart: a quarter of that is under 2, which is the least margin."""
    p = pixels(spark, sf_dir)
    lines = p.select("page").distinct().select("page", F.explode(F.sequence(F.lit(4), F.lit(40), F.lit(4))).alias("y"))
    bars = p.select("page", F.col("x").alias("id"), "x").distinct()
    return validation.crossings(bars, p, lines, ["page"]).groupBy("page", "x").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({PIXELS_SQL}), g AS (SELECT DISTINCT page, x, 5 + x % 3 AS top, 20 + x % 4 AS bottom FROM p) SELECT page, x FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.page = g.page AND p.x = g.x AND p.y BETWEEN top - 1 AND top + 1) AND EXISTS (SELECT 1 FROM p WHERE p.page = g.page AND p.x = g.x AND p.y BETWEEN bottom - 1 AND bottom + 1)")
def both_lines_reached(spark, sf_dir):
    p = pixels(spark, sf_dir)
    groups = p.select("page", "x", (F.col("x") % 3 + 5).alias("top"), (F.col("x") % 4 + 20).alias("bottom")).distinct()
    return validation.reaches_both_lines(groups, p, ["page"], 1).select("page", "x")


@query(f"WITH p AS ({PIXELS_SQL}), c AS (SELECT DISTINCT page, x * 9 AS x FROM p), v AS (SELECT DISTINCT page, x * 9 AS x FROM p WHERE x % 2 = 0), d AS (SELECT c.page, list(c.x ORDER BY c.x) AS l FROM c JOIN v ON c.page = v.page AND c.x = v.x GROUP BY 1) SELECT page, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] > 15 THEN list_concat(acc, v) ELSE acc END)) AS x FROM d")
def filtered_barlines(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("page", (F.col("x") * 9).alias("x"))
    return validation.filter_barlines(rows, rows.where("x % 18 = 0"), ["page"])


IMAGES_SQL = "SELECT label AS page, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, unnest(range(0, len(embedding))) AS x, CAST(greatest(0, least(255, floor(unnest(embedding) * 64 + 128))) AS INT) AS v FROM embeddings"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page images (name, width, height, pixels) of the embeddings: one image a label, one row a vector, values as grays, in single precision as the values are (in double some are a gray lower)."""
    whole = lambda n: F.lit(n).cast("float")
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(v * whole(64) + whole(128)))).cast("int"))
    line = F.unhex(F.array_join(F.transform(gray, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.size("embedding").alias("width"), F.hex(line).alias("line"))
    whole = rows.groupBy("label", "width").agg(F.array_sort(F.collect_list(F.struct("vec_id", "line"))).alias("lines"))
    return whole.select(F.col("label").cast("string").alias("name"), "width", F.size("lines").alias("height"), F.unhex(F.array_join(F.transform("lines", lambda r: r["line"]), "")).alias("pixels"))


@query(f"SELECT page AS label, y, x FROM ({IMAGES_SQL}) WHERE v <= 200")
def dark_pixels(spark, sf_dir):
    found = kernels.page_pixels(_images(spark, sf_dir), otsu=False)
    return found.select(F.col("name").cast("int").alias("label"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query(f"SELECT page AS label, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM ({IMAGES_SQL}) WHERE x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 24 GROUP BY 1")
def page_crops(spark, sf_dir):
    images = _images(spark, sf_dir)
    boxes = images.select("name", F.lit("a").alias("crop_id"), F.lit(10).alias("x"), F.lit(5).alias("y"), F.lit(20).alias("w"), F.lit(20).alias("h"))
    return _sums(kernels.page_crops(images, boxes))


def _sums(images: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            yield pd.DataFrame({"label": part["name"].astype(int), "n": [len(p) for p in part["pixels"]], "total": [sum(p) for p in part["pixels"]]})

    return images.mapInPandas(run, "label int, n long, total long")


@query(f"WITH i AS ({IMAGES_SQL}), s AS (SELECT page, max(y) + 1 AS h, max(x) + 1 AS w FROM i GROUP BY 1), f AS (SELECT *, 32.0 / greatest(h, w) AS scale FROM s), g AS (SELECT *, CAST(trunc(h * scale) AS BIGINT) AS nh, CAST(trunc(w * scale) AS BIGINT) AS nw FROM f), o AS (SELECT page, a, b, least(h - 1, CAST(trunc((a + 0.5) * h / nh) AS BIGINT)) AS y, least(w - 1, CAST(trunc((b + 0.5) * w / nw) AS BIGINT)) AS x FROM (SELECT *, unnest(range(0, nw)) AS b FROM (SELECT *, unnest(range(0, nh)) AS a FROM g))) SELECT o.page AS label, CAST(1024 AS BIGINT) AS n, CAST(sum(v) + 255 * (1024 - count(*)) AS BIGINT) AS total FROM o JOIN i ON i.page = o.page AND i.y = o.y AND i.x = o.x GROUP BY 1")
def letterboxed_pages(spark, sf_dir):
    return _sums(dataset.letterboxed_pages(_images(spark, sf_dir), 32))


@query(f"""WITH p AS (SELECT page, y, x FROM ({IMAGES_SQL}) WHERE v <= 128), r AS (SELECT page, y, min(x) AS a, max(x) AS b FROM (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS k FROM p) GROUP BY page, y, k), h AS (SELECT page, y, a, b FROM r)
 SELECT p.page AS label, p.y, p.x FROM p WHERE (SELECT coalesce(sum(least(b, p.x + 6) - greatest(a, p.x - 6) + 1), 0) FROM h WHERE h.page = p.page AND h.y BETWEEN p.y - 6 AND p.y + 6 AND least(b, p.x + 6) - greatest(a, p.x - 6) + 1 >= 6) >= 6""")
def horizontal_elements(spark, sf_dir):
    """Dark pixels with six pixels or more of horizontal runs of six near."""

    def run(parts):
        import numpy as np

        for part in parts:
            for r in part.itertuples():
                mask = kernels.threshold_inverse(np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width)), 128)
                found = [(int(r.name), y, x) for y, x in zip(*np.nonzero(mask), strict=True) if kernels.has_horizontal_element(mask, x, y, 6, 6, 6)]
                yield pd.DataFrame(found, columns=["label", "y", "x"])

    return _images(spark, sf_dir).mapInPandas(run, "label int, y long, x long")


@query(f"WITH c AS (SELECT page, y, count(*) AS n FROM ({PIXELS_SQL}) GROUP BY 1, 2), g AS (SELECT page, unnest(range(1, max(y) + 1)) AS y FROM c GROUP BY page), f AS (SELECT g.page, g.y, coalesce(n, 0) * 1000 + g.y * 7 % 997 AS v FROM g LEFT JOIN c ON c.page = g.page AND c.y = g.y), w AS (SELECT *, lag(v) OVER q AS a, lead(v) OVER q AS b FROM f WINDOW q AS (PARTITION BY page ORDER BY y)) SELECT page, y FROM w WHERE v > a AND v > b AND v >= 30000")
def profile_peaks(spark, sf_dir):
    """Rows that hold more than both neighbours; a small number of the row's own keeps equals apart."""
    rows = pixels(spark, sf_dir).groupBy("page", "y").agg(F.count(F.lit(1)).alias("n"))

    def run(key, part):
        import numpy as np

        size = int(part["y"].max())
        values = np.zeros(size)
        values[part["y"].to_numpy() - 1] = part["n"].to_numpy() * 1000
        found = kernels.peaks(values + np.arange(1, size + 1) * 7 % 997, 30000)
        return pd.DataFrame({"page": key[0], "y": np.array(found, "int64") + 1})

    return rows.groupBy("page").applyInPandas(run, "page int, y long")


@query(f"""WITH p AS ({PIXELS_SQL}), r AS (SELECT page, x, min(y) AS a, max(y) AS b FROM (SELECT *, y - row_number() OVER (PARTITION BY page, x ORDER BY y) AS k FROM p) GROUP BY page, x, k), g AS (SELECT *, lead(a) OVER (PARTITION BY page, x ORDER BY a) - b - 1 AS gap FROM r) SELECT page, (SELECT count(*) FROM p WHERE p.page = g.page) + CAST(coalesce(sum(gap) FILTER (WHERE gap < 3), 0) AS BIGINT) AS n FROM g GROUP BY page""")
def closed_columns(spark, sf_dir):
    def run(key, part):
        import numpy as np

        mask = np.zeros((int(part["y"].max()) + 1, int(part["x"].max()) + 1), bool)
        mask[part["y"], part["x"]] = True
        return pd.DataFrame({"page": [key[0]], "n": [int(kernels.closed_columns(mask, 3).sum())]})

    return pixels(spark, sf_dir).groupBy("page").applyInPandas(run, "page int, n long")


@query(f"SELECT class_name AS name, count(*) AS n FROM ({SYMBOLS}) WHERE class_name IN ('noteheadBlackOnLine') GROUP BY 1")
def noteheads(spark, sf_dir):
    return derived(spark, sf_dir, SYMBOLS).where(names.is_notehead(F.col("class_name"))).groupBy(F.col("class_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


#: One page a supplier: k its key, s the line spacing, n its systems, two groups of them 300 rows apart for odd k, m barlines w columns apart, a bracket before the first group for every third.
SCORES_SQL = """SELECT s_suppkey AS k, 14 + s_suppkey % 4 AS s, 2 + s_suppkey % 3 AS n, 3 + s_suppkey % 4 AS m, 90 + 10 * (s_suppkey % 5) AS w, s_suppkey % 2 AS two, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS hooked FROM supplier"""
DRAWN_SQL = f"""SELECT k, s, n, m, w, two, hooked, i, CASE WHEN i >= n THEN 1 ELSE 0 END AS g, 60 + i * (4 * s + 30) + CASE WHEN i >= n THEN 300 ELSE 0 END AS top FROM (SELECT *, unnest(range(0, n * (1 + two))) AS i FROM ({SCORES_SQL}))"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files (name, content) of SCORES_SQL: staff lines of one row, barlines of three columns through each system, brackets with hooks."""

    def one(r) -> tuple:
        height, groups = 4 * r.s, 1 + r.two
        tops = [60 + i * (height + 30) + (300 if i >= r.n else 0) for i in range(r.n * groups)]
        width = 60 + r.m * r.w
        gray = np.full((tops[-1] + height + 80, width), 255, np.uint8)
        for top in tops:
            for i in range(5):
                gray[top + i * r.s, 40 : width - 20] = 0
            for j in range(r.m):
                gray[top : top + height + 1, 60 + j * r.w : 63 + j * r.w] = 0
        if r.hooked:
            low = tops[r.n - 1] + height
            gray[tops[0] - 2 : low + 3, 20:24] = 0
            gray[tops[0] - 2 : tops[0] + 1, 20:34] = gray[low : low + 3, 20:34] = 0
        return str(r.k), b"P5\n%d %d\n255\n" % gray.shape[::-1] + gray.tobytes()

    def draw(parts):
        yield from kernels.in_lots((one(r) for part in parts for r in part.itertuples()), ["name", "content"], 16)

    rows = spark.sql(SCORES_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return rows.repartition(64).mapInPandas(draw, "name string, content binary")


DRAWN_BARLINES_SQL = f"SELECT DISTINCT k, s, n, two, hooked, g, 61 + j * w AS x FROM (SELECT *, unnest(range(0, m)) AS j FROM ({DRAWN_SQL})) UNION SELECT DISTINCT k, s, n, two, hooked, g, 21 FROM ({DRAWN_SQL}) WHERE hooked = 1 AND g = 0"


@query(f"SELECT k, i AS system_idx, g AS group_idx, top, top + 4 * s AS bottom, top + s AS second, CAST(s AS DOUBLE) AS spacing FROM ({DRAWN_SQL})")
def page_systems(spark, sf_dir):
    masks = pages.masks_of_files(_scores(spark, sf_dir))
    return pages.systems_of_pages(masks).select(F.col("name").cast("long").alias("k"), "system_idx", "group_idx", "top", "bottom", F.col("lines")[1].alias("second"), F.col("avg_spacing").alias("spacing"))


@query(f"SELECT b.k, b.x, d.i AS system_idx FROM ({DRAWN_BARLINES_SQL}) b JOIN ({DRAWN_SQL}) d ON b.k = d.k AND b.g = d.g")
def page_system_barlines(spark, sf_dir):
    return pages.system_barlines(_scores(spark, sf_dir)).select(F.col("name").cast("long").alias("k"), "x", "system_idx")


@query(f"SELECT b.k, g AS group_idx, x, CAST(n AS INT) AS group_size, 60 + g * n * (4 * s + 30) + 300 * g - 10 AS y_start, 60 + ((1 + g) * n - 1) * (4 * s + 30) + 300 * g + 4 * s + 10 AS y_end FROM ({DRAWN_BARLINES_SQL}) b")
def page_barlines(spark, sf_dir):
    return pages.analysed(_scores(spark, sf_dir))["barlines"].select(F.col("name").cast("long").alias("k"), "group_idx", "x", "group_size", "y_start", "y_end")


@query(f"SELECT k, 58 AS y_from, 60 + (n - 1) * (4 * s + 30) + 4 * s + 2 AS y_to, CAST(n AS INT) AS systems FROM ({SCORES_SQL}) WHERE hooked = 1")
def page_brackets(spark, sf_dir):
    """A stroke of several columns that smoothing has slanted may begin or end some rows off; that much counts as met."""
    found = pages.analysed(_scores(spark, sf_dir))["brackets"].where("x between 18 and 24")
    near = lambda c, want: F.when(F.abs(F.col(c) - want) <= 6, want).otherwise(F.col(c))
    drawn = spark.sql(SCORES_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    rows = found.select(F.col("name").cast("long").alias("k"), "y_start", "y_end", F.size("covered_systems").alias("systems")).join(drawn.select("k", "n", "s"), "k")
    return rows.select("k", near("y_start", F.lit(58)).alias("y_from"), near("y_end", 60 + (F.col("n") - 1) * (4 * F.col("s") + 30) + 4 * F.col("s") + 2).alias("y_to"), "systems")


@query(f"""WITH b AS (SELECT k, g, x, row_number() OVER (PARTITION BY k, g ORDER BY x) - hooked * (1 - g) AS number FROM ({DRAWN_BARLINES_SQL})),
 r AS (SELECT *, lag(top + 4 * s) OVER w AS before, lead(top) OVER w AS after FROM ({DRAWN_SQL}) WINDOW w AS (PARTITION BY k ORDER BY i))
 SELECT r.k, r.i AS system_idx, CAST(b.number AS INT) AS measure_number, b.x AS x_end, 5 AS staff_lines,
 greatest(0, top - CASE WHEN before IS NULL THEN 4 * s ELSE (top - before) // 2 END) AS y, top + 4 * s + CASE WHEN after IS NULL THEN 4 * s ELSE (after - top - 4 * s) // 2 END AS y_end
 FROM r JOIN b ON b.k = r.k AND b.g = r.g WHERE b.number > 0""")
def page_measures(spark, sf_dir):
    found = pages.analysed(_scores(spark, sf_dir))["measures"]
    return found.select(F.col("name").cast("long").alias("k"), "system_idx", "measure_number", (F.col("bbox.x") + F.col("bbox.width")).alias("x_end"), F.size("staff_lines").alias("staff_lines"), F.col("bbox.y").alias("y"), (F.col("bbox.y") + F.col("bbox.height")).alias("y_end"))


@query(f"SELECT DISTINCT k, 61 + j * w AS x FROM (SELECT *, unnest(range(0, m)) AS j FROM ({DRAWN_SQL}))")
def whole_page_barlines(spark, sf_dir):
    """The search without systems; brackets are left out, as smoothing moves them by a column."""
    found = pages.barlines_of_whole_pages(pages.masks_of_files(_scores(spark, sf_dir)))
    return found.where("x > 30").select(F.col("name").cast("long").alias("k"), "x")


@query(f"""WITH p AS (SELECT page, y, x FROM ({IMAGES_SQL}) WHERE v <= 100), h AS (SELECT page, max(y) + 1 AS h FROM ({IMAGES_SQL}) GROUP BY 1)
 SELECT p.page AS label, a AS degrees, p.x - CAST(round_even(tan(radians(a)) * (p.y - h.h // 2), 0) AS BIGINT) AS x, count(*) AS votes FROM p JOIN h ON h.page = p.page, (SELECT unnest(range(-8, 9)) AS a) GROUP BY 1, 2, 3 HAVING x BETWEEN 0 AND 63""")
def stroke_votes(spark, sf_dir):
    """The votes that the line search begins with."""

    def run(parts):
        for part in parts:
            for r in part.itertuples():
                gray = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width))
                angles, votes = kernels.line_votes(kernels.threshold_inverse(gray, 100), 8)
                k, x = np.nonzero(votes)
                yield pd.DataFrame({"label": int(r.name), "degrees": np.array(angles)[k], "x": x, "votes": votes[k, x]})

    return _images(spark, sf_dir).mapInPandas(run, "label int, degrees long, x long, votes long")


# files by image, documents of any size, pages of PDF documents: written and read back


@query(f"{DOCUMENT_SQL} SELECT CAST(k AS INT) AS shard, CAST(ann AS VARCHAR) AS ann_id, CAST(img AS VARCHAR) AS image_id, CAST(cat AS VARCHAR) AS category_id, CAST(x + 2 AS DOUBLE) AS x2 FROM l WHERE cat IS NOT NULL AND cat <> 4 AND n < 7")
def large_annotation_scan(spark, sf_dir):
    """The rows of annotation_scan from documents on disk, each read in ranges of 100,000 bytes."""
    path = new_folder(spark, "documents")
    named_files.write_pieces(_whole_documents(spark, sf_dir), path)
    rows = files.member_annotations(files.annotation_members(spark, path + "/*.json", 100_000), excluded=["4"])
    return rows.select("shard", "ann_id", "image_id", "category_id", F.col("box")[2].alias("x2"))


@query(f"SELECT CAST(image AS VARCHAR) AS image, cls AS class_id, round(x1 / 1000.0, 6) AS xc, round(y1 / 2000.0, 6) AS yc, round(w / 1000.0, 6) AS w, round(h / 1000.0, 6) AS h FROM ({BOXES})")
def label_files(spark, sf_dir):
    """A label file an image, written and read back."""
    boxes = derived(spark, sf_dir, BOXES)
    rows = boxes.selectExpr("image", "cls AS class_id", "x1 / 1000.0D AS xc", "y1 / 2000.0D AS yc", "w / 1000.0D AS w", "h / 1000.0D AS h")
    path = new_folder(spark, "labels")
    sinks.write_labels(sinks.label_lines(boxes.select("image").distinct(), rows), path)
    return files.yolo_labels(spark, path).select("image", F.col("class_id").cast("long").alias("class_id"), "xc", "yc", "w", "h")


@query(f"SELECT page AS label, part, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT page, y // 20 AS part, v FROM ({IMAGES_SQL}) WHERE x BETWEEN 10 AND 29) GROUP BY 1, 2")
def crop_files(spark, sf_dir):
    """Crops of 20 rows each, a PNG file each, written and read back."""
    images = _images(spark, sf_dir)
    boxes = images.select("name", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / 20).cast("int"))).alias("k")).selectExpr("name", "cast(k AS string) AS crop_id", "10 AS x", "k * 20 AS y", "20 AS w", "20 AS h")
    path = new_folder(spark, "crops")
    sinks.write_crops(kernels.page_crops(images, boxes), path)
    read = files.decoded_pages(files.page_files(spark, path + "/*").withColumn("name", F.regexp_extract("path", r"([0-9]+/[0-9]+)[.]png$", 1)))
    return _named_sums(read).selectExpr("cast(doc AS int) AS label", "cast(page AS long) AS part", "n", "total")


def pdf_bytes(images: list[tuple[int, int, bytes]]) -> bytes:
    """A document with an image a page, as scanners make them."""
    import zlib

    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(len(images)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(images)} >>".encode()]
    for k, (width, height, pixels) in enumerate(images):
        data = zlib.compress(pixels)
        parts.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /XObject << /Im0 {4 + 2 * k} 0 R >> >> >>".encode())
        parts.append(f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, part in enumerate(parts):
        at.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + part + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % x for x in at)
    return bytes(out + f"trailer\n<< /Root 1 0 R /Size {len(parts) + 1} >>\nstartxref\n{start}\n%%EOF\n".encode())


def _scans(spark: SparkSession, sf_dir: str) -> str:
    """A folder of two documents: the images of even and of odd labels, a page each, in order of labels."""

    def bound(key, part):
        part = part.assign(label=part["name"].astype(int)).sort_values("label")
        return pd.DataFrame({"file": [f"set-{key[0]}.pdf"], "content": [pdf_bytes([(int(w), int(h), bytes(p)) for w, h, p in zip(part["width"], part["height"], part["pixels"], strict=True)])]})

    path = new_folder(spark, "scans")
    rows = _images(spark, sf_dir).withColumn("doc", F.col("name").cast("int") % 2)
    named_files.write(rows.groupBy("doc").applyInPandas(bound, "file string, content binary"), path)
    return path


PAGES_SQL = f"SELECT 'set-' || (page % 2) || '.pdf' AS doc, row_number() OVER (PARTITION BY page % 2 ORDER BY page) AS page, n, total FROM (SELECT page, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM ({IMAGES_SQL}) GROUP BY 1)"


@query(f"SELECT doc, CAST(page AS INT) AS page, n, total FROM ({PAGES_SQL})")
def pdf_pages(spark, sf_dir):
    """Every page of the documents; the sums are of whole images."""
    found = pdf.pdf_pages(spark, _scans(spark, sf_dir), pages_per_task=2).withColumn("name", F.concat_ws("/", "doc", F.col("page").cast("string")))
    return _named_sums(found)


@query(f"SELECT doc, CAST(page AS INT) AS page, n, total FROM ({PAGES_SQL})")
def pdf_renderings(spark, sf_dir):
    """Pages of documents as PNG files, read back as images."""
    path = new_folder(spark, "renderings")
    sinks.write_images(pdf.pdf_pages(spark, _scans(spark, sf_dir)), path)
    found = files.decoded_pages(files.page_files(spark, path)).withColumn("name", F.regexp_replace("name", r"^(.*)-0*([0-9]+)[.]png$", "$1.pdf/$2"))
    return _named_sums(found)


def _named_sums(images: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            yield pd.DataFrame({"name": part["name"], "n": [len(p) for p in part["pixels"]], "total": [sum(p) for p in part["pixels"]]})

    sums = images.select("name", "pixels").mapInPandas(run, "name string, n long, total long")
    return sums.selectExpr("split_part(name, '/', 1) AS doc", "cast(split_part(name, '/', 2) AS int) AS page", "n", "total")
