"""The driver's queries over the reference's operators, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import labels as names
from ..operators import aggregates, folds, islands, joins, sampling, validation, windows
from ..sources import sinks
from . import measures as mp
from . import symbols
from .adapters import BARLINES, BOXES, LINES, PIXELS_SQL, PLACES, SEGMENTS, STAFFS, derived, pixels, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# projections and filters


@query(f"""SELECT id, page, CAST(floor((x1 + x2) / 2.0) AS BIGINT) AS center_x, CAST(floor((y1 + y2) / 2.0) AS BIGINT) AS center_y,
 round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length,
 round(CASE WHEN x2 = x1 THEN 90.0 ELSE degrees(atan((y2 - y1) / CAST(x2 - x1 AS DOUBLE))) END, 6) AS angle
 FROM ({SEGMENTS}) WHERE abs(CASE WHEN x2 = x1 THEN 90.0 ELSE degrees(atan((y2 - y1) / CAST(x2 - x1 AS DOUBLE))) END) >= 75""")
def segment_metrics(spark, sf_dir):
    rows = derived(spark, sf_dir, SEGMENTS).select("id", "page", *geo.segment_metrics()).where(geo.is_vertical())
    return rows.select("id", "page", "center_x", "center_y", F.round("length", 6).alias("length"), F.round("angle", 6).alias("angle"))


@query(f"SELECT id, round(degrees(atan2(y2 - y1, x2 - x1)), 6) AS angle FROM ({SEGMENTS}) WHERE abs(degrees(atan2(y2 - y1, x2 - x1))) BETWEEN 88 AND 92")
def bracket_angles(spark, sf_dir):
    a = geo.unsigned_angle()
    return derived(spark, sf_dir, SEGMENTS).select("id", a.alias("a")).where("a between 88 and 92").select("id", F.round("a", 6).alias("angle"))


@query(f"""SELECT id, round(least(1, greatest(0, (x1 + x2) / 2.0 / 1000)), 9) AS xc, round(least(1, greatest(0, (y1 + y2) / 2.0 / 1200)), 9) AS yc,
 round(least(1, abs(x2 - x1) / 1000.0), 9) AS w, round(least(1, abs(y2 - y1) / 1200.0), 9) AS h FROM ({BOXES})""")
def center_boxes(spark, sf_dir):
    c = geo.corners_to_center("x1", "y1", "x2", "y2", F.lit(1000), F.lit(1200))
    return derived(spark, sf_dir, BOXES).select("id", c.alias("c")).select("id", *[F.round(f"c.{k}", 9).alias(k) for k in ("xc", "yc", "w", "h")])


@query(f"""SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 900 OR y2 > 1190 THEN 'original_bounds'
 WHEN x1 >= x2 OR y1 >= y2 THEN 'final_bounds' WHEN x2 - x1 < 20 OR y2 - y1 < 20 THEN 'too small' END AS reason FROM ({BOXES})) GROUP BY 1""")
def rejection_reasons(spark, sf_dir):
    r = geo.rejection("x1", "y1", "x2", "y2", F.lit(900), F.lit(1190), 20)
    return derived(spark, sf_dir, BOXES).groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT count(*) AS processed, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS rejected, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 6) AS kept_percent FROM
 (SELECT x2 <= 900 AND y2 <= 1190 AND x2 - x1 >= 20 AND y2 - y1 >= 20 AS ok FROM ({BOXES}))""")
def processing_summary(spark, sf_dir):
    r = geo.rejection("x1", "y1", "x2", "y2", F.lit(900), F.lit(1190), 20)
    return aggregates.processing_summary(derived(spark, sf_dir, BOXES).select(r.alias("reason"))).withColumn("kept_percent", F.round("kept_percent", 6))


@query(f"""SELECT id, round(x1 * s + dx, 6) AS x1, round(y1 * s + dy, 6) AS y1, round(x2 * s + dx, 6) AS x2, round(y2 * s + dy, 6) AS y2 FROM
 (SELECT *, 640 / 1300.0 AS s, floor((640 - trunc(1000 * (640 / 1300.0))) / 2) AS dx, floor((640 - trunc(1300 * (640 / 1300.0))) / 2) AS dy FROM ({BOXES}))""")
def letterbox_boxes(spark, sf_dir):
    f = geo.letterbox("x1", "y1", "x2", "y2", F.lit(1000), F.lit(1300), 640)
    return derived(spark, sf_dir, BOXES).select("id", f.alias("f")).select("id", *[F.round(f"f.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query(f"""SELECT o AS orientation, count(*) AS n, round(avg(r), 6) AS avg_ratio, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM
 (SELECT w / CAST(h AS DOUBLE) AS r, CASE WHEN w / CAST(h AS DOUBLE) < 0.5 THEN 'VERTICAL' WHEN w / CAST(h AS DOUBLE) > 2 THEN 'HORIZONTAL' ELSE 'SQUARE' END AS o FROM ({BOXES})) GROUP BY 1""")
def orientation_summary(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select(geo.orientation("w", "h").alias("orientation"), geo.aspect("w", "h").alias("ratio"))
    return aggregates.orientation_summary(rows).select("orientation", "n", F.round("avg_ratio", 6).alias("avg_ratio"), F.round("percent", 6).alias("percent"))


@query(f"SELECT id, CAST(trunc(trunc(x1) / 900.0 * 900.0 + 0.0000001) AS INT) AS x, round(y1 / 1200.0, 9) AS ratio FROM ({BOXES})")
def ratio_round_trip(spark, sf_dir):
    back = geo.to_pixels(geo.to_ratio("x1", F.lit(900.0)) + F.lit(1e-7) / 900, F.lit(900.0))
    return derived(spark, sf_dir, BOXES).select("id", back.alias("x"), F.round(geo.to_ratio("y1", F.lit(1200.0)), 9).alias("ratio"))


# joins


@query(f"""SELECT a.id AS a, b.id AS b, round(i / CAST(a.w * a.h + b.w * b.h - i AS DOUBLE), 9) AS iou FROM
 (SELECT a.id AS aid, b.id AS bid, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM ({BOXES}) a JOIN ({BOXES}) b ON a.image = b.image AND a.cls = b.cls AND a.id < b.id
 WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)) m JOIN ({BOXES}) a ON a.id = aid JOIN ({BOXES}) b ON b.id = bid""")
def pairwise_iou(spark, sf_dir):
    """Rounded in doubles, as the SQL does; F.round goes by decimals, which takes more than all else that a pair needs."""
    met = joins.ious(derived(spark, sf_dir, BOXES), ["image", "cls"])
    return met.select("a", "b", (F.floor(F.col("iou") * 1e9 + 0.5) / 1e9).alias("iou"))


NMS_SQL = f"""WITH b AS ({BOXES}), g AS (SELECT image, cls, list(struct_pack(id := id, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY confidence DESC, id) AS l FROM b GROUP BY image, cls),
k AS (SELECT list_reduce(list_transform(l, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda c: CASE WHEN least(c.x2, e[1].x2) > greatest(c.x1, e[1].x1) AND least(c.y2, e[1].y2) > greatest(c.y1, e[1].y1)
 THEN (least(c.x2, e[1].x2) - greatest(c.x1, e[1].x1)) * (least(c.y2, e[1].y2) - greatest(c.y1, e[1].y1)) / CAST((c.x2 - c.x1) * (c.y2 - c.y1) + (e[1].x2 - e[1].x1) * (e[1].y2 - e[1].y1) - (least(c.x2, e[1].x2) - greatest(c.x1, e[1].x1)) * (least(c.y2, e[1].y2) - greatest(c.y1, e[1].y1)) AS DOUBLE) ELSE 0 END >= 0.3)) > 0 THEN acc ELSE list_concat(acc, e) END) AS kept FROM g)
SELECT u.id AS id FROM (SELECT unnest(kept) AS u FROM k)"""


@query(NMS_SQL)
def greedy_suppression(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select("id", "image", "cls", "confidence", "x1", "y1", "x2", "y2")
    return folds.greedy_suppression(rows, ["image", "cls"], 0.3).select("id")


@query(f"""WITH p AS (SELECT id, page, x, id % 97 AS y FROM ({PLACES})), t AS (SELECT id AS target_id, page, x1 AS x, y1 AS y FROM ({SEGMENTS})),
 m AS (SELECT p.page, p.id, t.target_id, (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) AS d FROM p JOIN t ON p.page = t.page WHERE (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) <= 900)
 SELECT page, id, target_id, round(sqrt(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY d, target_id) AS r FROM m) WHERE r = 1""")
def nearest_join(spark, sf_dir):
    points = derived(spark, sf_dir, PLACES).withColumn("y", F.col("id") % 97)
    targets = derived(spark, sf_dir, SEGMENTS).select("page", F.col("id").alias("target_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    found = joins.nearest(points, targets, ["page"])
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH o AS (SELECT id, page, y1 AS y_start, y1 + 200 AS y_end FROM ({SEGMENTS})), i AS (SELECT page, y1 AS top, y2 AS bottom FROM ({SEGMENTS}))
 SELECT o.id, count(*) AS n FROM o JOIN i ON o.page = i.page AND i.top >= o.y_start - 20 AND i.bottom <= o.y_end + 20 GROUP BY 1""")
def interval_containment(spark, sf_dir):
    rows = derived(spark, sf_dir, SEGMENTS)
    outer = rows.select("id", "page", F.col("y1").alias("y_start"), (F.col("y1") + 200).alias("y_end"))
    return joins.contained(outer, rows.select("page", F.col("y1").alias("top"), F.col("y2").alias("bottom")), ["page"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT page, x1 AS start, max(id) AS value FROM ({SEGMENTS}) GROUP BY page, x1)
 SELECT p.id, p.page, p.x, s.value FROM ({PLACES}) p ASOF LEFT JOIN s ON p.page = s.page AND p.x >= s.start""")
def range_assign(spark, sf_dir):
    starts = derived(spark, sf_dir, SEGMENTS).groupBy("page", F.col("x1").alias("start")).agg(F.max("id").alias("value"))
    return joins.range_assign(derived(spark, sf_dir, PLACES), starts, ["page"])


@query("SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def pair_matching(spark, sf_dir):
    return joins.pairing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS ann_id, o_orderstatus AS image_status, CASE WHEN min(l_partkey) % 5 < 3 THEN min(l_partkey) % 5 ELSE min(l_suppkey) % 3 END AS category_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_orderstatus) SELECT a.*, p_name AS category_name FROM a JOIN part ON p_partkey = a.category_id""")
def annotation_category(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ann_id"), F.col("l_orderkey").alias("image_id")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    cats = F.array((F.col("p") % 5 + F.when(F.col("p") % 5 < 3, 0).otherwise(1_000_000)), F.col("s") % 3)
    found = joins.first_target_category(rows.withColumn("cat_ids", cats), table(spark, sf_dir, "part").where("p_partkey < 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    imaged = joins.annotations_with_images(found, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("image_status")))
    return imaged.select("ann_id", "image_status", "category_id", "category_name")


@query(f"SELECT b.id, coalesce(p_name, 'class_' || CAST(cls AS VARCHAR)) AS class_name FROM ({BOXES}) b LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0) ON p_partkey = cls")
def class_names(spark, sf_dir):
    classes = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return joins.with_class_names(derived(spark, sf_dir, BOXES).select("id", F.col("cls").alias("class_id")), classes).select("id", "class_name")


@query(f"SELECT image, CASE cls WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS class_id, count(*) AS n FROM ({BOXES}) WHERE cls IN (1, 3, 5) GROUP BY 1, 2")
def class_remap(spark, sf_dir):
    mapping = spark.createDataFrame([(1, 0), (3, 1), (5, 2)], "old_id int, new_id int")
    return joins.remapped(derived(spark, sf_dir, BOXES).select("image", F.col("cls").alias("class_id")), mapping).groupBy("image", "class_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS (SELECT DISTINCT page, x % 20 AS group_idx, x % 7 AS s FROM ({PLACES})), b AS (SELECT page, id AS pos, x1 AS x, y1 % 7 AS s FROM ({SEGMENTS}))
 SELECT g.page, g.group_idx, coalesce(arg_min(b.x, b.pos), 0) AS bracket_x FROM g LEFT JOIN b ON g.page = b.page AND g.s = b.s GROUP BY 1, 2""")
def first_overlap(spark, sf_dir):
    groups = derived(spark, sf_dir, PLACES).groupBy("page", (F.col("x") % 20).alias("group_idx")).agg(F.collect_set(F.col("x") % 7).alias("systems"))
    brackets = derived(spark, sf_dir, SEGMENTS).select("page", F.col("id").alias("pos"), F.col("x1").alias("x"), F.array(F.col("y1") % 7).alias("covered_systems"))
    return joins.first_overlapping(groups, brackets, ["page"]).select("page", "group_idx", "bracket_x")


@query(f"""WITH p AS ({PIXELS_SQL}), l AS (SELECT DISTINCT page, y FROM p WHERE y % 4 = 0), b AS (SELECT DISTINCT page, x AS id, x FROM p)
 SELECT b.page, b.id, count(DISTINCT p.y) AS n_crossed FROM b JOIN p ON b.page = p.page AND p.x BETWEEN b.x - 3 AND b.x + 3 JOIN l ON l.page = p.page AND l.y = p.y GROUP BY 1, 2 HAVING count(DISTINCT p.y) >= 3""")
def lines_crossed(spark, sf_dir):
    p = pixels(spark, sf_dir)
    bars = p.select("page", F.col("x").alias("id"), "x").distinct()
    return joins.lines_crossed(bars, p, p.where("y % 4 = 0").select("page", "y").distinct(), ["page"])


# gaps and islands


@query(f"""WITH d AS (SELECT page, x, count(*) AS n FROM ({PLACES}) GROUP BY 1, 2), g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 15 THEN 1 ELSE 0 END AS b FROM d),
 i AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY x) AS island FROM g) SELECT page, CAST(island AS BIGINT) AS island, CAST(sum(n) AS BIGINT) AS n, min(x) AS low, max(x) AS high FROM i GROUP BY 1, 2""")
def gap_clusters(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).groupBy("page", "x").agg(F.count(F.lit(1)).alias("n"))
    return islands.clusters_by_gap(rows, ["page"], "x", 15).groupBy("page", "island").agg(F.sum("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query(f"""WITH g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) > 20 THEN 1 ELSE 0 END AS b FROM ({LINES})), r AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY y) AS run FROM g),
 c AS (SELECT *, (row_number() OVER (PARTITION BY page, run ORDER BY y) - 1) // 5 AS chunk FROM r), s AS (SELECT page, run, chunk, min(y) AS top, max(y) AS bottom FROM c GROUP BY 1, 2, 3 HAVING count(*) = 5)
 SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY run, chunk) - 1 AS INT) AS system_idx, top, bottom, CAST(floor((top + bottom) / 2.0) AS BIGINT) AS center_y, bottom - top AS height, (bottom - top) / 4.0 AS avg_spacing FROM s""")
def systems_of_five(spark, sf_dir):
    return islands.systems_of_five(derived(spark, sf_dir, LINES), ["page"], 20).drop("lines")


@query(f"""WITH s AS (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM ({LINES})), m AS (SELECT page, median(gap) AS spacing FROM s WHERE gap < 30 GROUP BY 1),
 g AS (SELECT s.page, s.y, CASE WHEN gap >= coalesce(spacing, 10) * 2.5 THEN 1 ELSE 0 END AS b FROM s LEFT JOIN m ON s.page = m.page), r AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY y) AS staff FROM g),
 k AS (SELECT *, count(*) OVER (PARTITION BY page, staff) AS n FROM r) SELECT page, y, CAST(staff AS BIGINT) AS staff FROM k WHERE n >= 4""")
def staffs_from_peaks(spark, sf_dir):
    return islands.staffs_from_peaks(derived(spark, sf_dir, LINES), ["page"]).select("page", "y", "staff")


@query(f"SELECT page, count(*) AS runs, CAST(sum(e - s + 1) AS BIGINT) AS total, max(e - s + 1) AS longest FROM (SELECT page, x, min(y) AS s, max(y) AS e FROM (SELECT *, y - row_number() OVER (PARTITION BY page, x ORDER BY y) AS k FROM ({PIXELS_SQL})) GROUP BY page, x, k) GROUP BY page")
def vertical_runs(spark, sf_dir):
    runs = islands.vertical_runs(pixels(spark, sf_dir), ["page", "x"]).withColumn("n", F.col("y_end") - F.col("y_start") + 1)
    return runs.groupBy("page").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("total"), F.max("n").cast("long").alias("longest"))


@query(f"SELECT page, y, x FROM (SELECT *, count(*) OVER (PARTITION BY page, y, k) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS k FROM ({PIXELS_SQL}))) WHERE n >= 5")
def horizontal_opening(spark, sf_dir):
    return islands.horizontal_opening(pixels(spark, sf_dir), 5).select("page", "y", "x")


@query(f"SELECT page, (r - 1) // 5 AS stride, count(*) AS n, min(y) AS top FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y) AS r FROM ({LINES})) GROUP BY 1, 2")
def strided_groups(spark, sf_dir):
    return islands.strided_groups(derived(spark, sf_dir, LINES), ["page"], "y").groupBy("page", "stride").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("top"))


THRESHOLD_SQL = """j AS (SELECT *, gap - lag(gap) OVER w AS jump, lag(gap) OVER w AS low, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY page ORDER BY gap, y)),
 a AS (SELECT page, count(*) AS n, max(jump) AS widest, quantile_cont(gap, 0.6) AS q60, median(gap) AS mid FROM j GROUP BY 1),
 f AS (SELECT j.page, arg_min((j.gap + j.low) / 2.0, j.r) AS middle FROM j JOIN a ON j.page = a.page AND j.jump = a.widest GROUP BY 1)"""


@query(f"""WITH g AS (SELECT * FROM (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM ({LINES})) WHERE gap IS NOT NULL), {THRESHOLD_SQL}
 SELECT a.page, round(CASE WHEN n >= 6 THEN CASE WHEN widest > 50 THEN middle ELSE q60 END WHEN n >= 3 THEN mid * 1.3 ELSE 80.0 END, 6) AS threshold FROM a LEFT JOIN f ON a.page = f.page""")
def adaptive_threshold(spark, sf_dir):
    gaps = windows.gaps_and_jumps(derived(spark, sf_dir, LINES), ["page"], "y").select("page", "gap")
    return islands.adaptive_threshold(gaps, ["page"], 10.0).withColumn("threshold", F.round("threshold", 6))


@query(f"""WITH g AS (SELECT * FROM (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM ({LINES})) WHERE gap IS NOT NULL)
 SELECT page, y, gap, gap - lag(gap) OVER (PARTITION BY page ORDER BY gap, y) AS jump, CAST(row_number() OVER (PARTITION BY page ORDER BY gap, y) AS INT) AS gap_rank FROM g""")
def gaps_and_jumps(spark, sf_dir):
    return windows.gaps_and_jumps(derived(spark, sf_dir, LINES), ["page"], "y")


# folds

FOLD_SQL = """WITH d AS (SELECT page, list(x ORDER BY x) AS l FROM (SELECT DISTINCT page, x FROM ({rows})) GROUP BY page),
f AS (SELECT page, list_reduce(list_transform(l, lambda v: [[v]]), lambda acc, v: CASE WHEN {same} THEN list_concat(acc[:-2], [list_append(acc[-1], v[1][1])]) ELSE list_concat(acc, v) END) AS g FROM d),
u AS (SELECT page, unnest(g) AS grp, unnest(range(0, len(g))) AS k FROM f)
SELECT page, k AS grp, CAST(len(grp) AS BIGINT) AS n, list_min(grp) AS low, list_max(grp) AS high FROM u"""


def _fold(spark, sf_dir, operator, tolerance):
    rows = derived(spark, sf_dir, PLACES).select("page", "x").distinct()
    return operator(rows, ["page"], "x", tolerance).groupBy("page", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query(FOLD_SQL.format(rows=PLACES, same="v[1][1] - list_avg(acc[-1]) <= 25"))
def running_mean_groups(spark, sf_dir):
    return _fold(spark, sf_dir, folds.running_mean_groups, 25)


@query(FOLD_SQL.format(rows=PLACES, same="v[1][1] - acc[-1][1] <= 50"))
def anchor_groups(spark, sf_dir):
    return _fold(spark, sf_dir, folds.anchor_groups, 50)


@query(f"""WITH d AS (SELECT page, list(x ORDER BY x) AS l FROM (SELECT DISTINCT page, x FROM ({PLACES})) GROUP BY page)
 SELECT page, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] > 30 THEN list_concat(acc, v) ELSE acc END)) AS x FROM d""")
def last_kept_merge(spark, sf_dir):
    return folds.last_kept(derived(spark, sf_dir, PLACES), ["page"], "x", 30)


@query(f"""WITH d AS (SELECT page, list(struct_pack(a := y1, b := y2) ORDER BY (y1 + y2) / 2.0, y1, y2, id) AS l FROM ({SEGMENTS}) GROUP BY page),
 f AS (SELECT page, list_reduce(list_transform(l, lambda v: [struct_pack(a := v.a, b := v.b, n := 1)]), lambda acc, v: CASE WHEN v[1].a - acc[-1].b <= 3 AND acc[-1].a - v[1].b <= 3
 THEN list_concat(acc[:-2], [struct_pack(a := least(acc[-1].a, v[1].a), b := greatest(acc[-1].b, v[1].b), n := acc[-1].n + 1)]) ELSE list_concat(acc, v) END) AS g FROM d),
 u AS (SELECT page, unnest(g) AS c, unnest(range(0, len(g))) AS k FROM f) SELECT page, k AS grp, CAST(c.n AS BIGINT) AS n, c.a AS low, c.b AS high FROM u""")
def extent_clusters(spark, sf_dir):
    rows = derived(spark, sf_dir, SEGMENTS).select("page", "y1", "y2", "id")
    return folds.extent_clusters(rows, ["page"], "y1", "y2", 3).groupBy("page", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("y1").alias("low"), F.max("y2").alias("high"))


@query(f"""WITH c AS (SELECT image AS page, o, count(*) FILTER (WHERE y1 % 7 <> o + 3) / CAST(count(*) AS DOUBLE) AS c FROM ({BOXES}), (SELECT unnest([1, -1, 2, -2, 3, -3]) AS o) GROUP BY 1, 2),
 p AS (SELECT *, list_position([1, -1, 2, -2, 3, -3], o) AS k FROM c) SELECT page, CAST(coalesce(min(k) FILTER (WHERE c < 0.85) - 1, count(*)) + 1 AS INT) AS thickness FROM p GROUP BY 1""")
def thickness(spark, sf_dir):
    side = derived(spark, sf_dir, BOXES).withColumn("offset", F.explode(F.array(*[F.lit(v) for v in (1, -1, 2, -2, 3, -3)])))
    rows = side.groupBy(F.col("image").alias("page"), "offset").agg(F.avg((F.col("y1") % 7 != F.col("offset") + 3).cast("double")).alias("covered"))
    return folds.thickness(rows, ["page"], coverage=0.85)


# aggregates


@query(f"""WITH s AS (SELECT page, x1 // 50 AS g, floor((x1 + x2) / 2.0) AS cx, floor((y1 + y2) / 2.0) AS cy, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, CASE WHEN x2 = x1 THEN 90.0 ELSE degrees(atan((y2 - y1) / CAST(x2 - x1 AS DOUBLE))) END AS a FROM ({SEGMENTS})),
 t AS (SELECT page, g, avg(cx) AS center_x, stddev_pop(cx) AS x_std, sum(len) AS total_length, count(*) AS line_count, max(cy) - min(cy) AS cov, stddev_pop(a) AS a_std FROM s GROUP BY 1, 2)
 SELECT page, g AS grp, round(center_x, 6) AS center_x, round(total_length, 6) AS total_length, line_count, CAST(least(100, CASE WHEN x_std < 2 THEN 30 WHEN x_std < 5 THEN 20 WHEN x_std < 10 THEN 10 ELSE 0 END + CASE WHEN line_count BETWEEN 3 AND 8 THEN 25 WHEN line_count >= 2 THEN 15 ELSE 0 END
 + CASE WHEN cov > 40 THEN 25 WHEN cov > 20 THEN 15 ELSE 0 END + CASE WHEN a_std < 5 THEN 20 WHEN a_std < 10 THEN 10 ELSE 0 END) AS INT) AS barline_score FROM t""")
def line_group_scores(spark, sf_dir):
    rows = derived(spark, sf_dir, SEGMENTS).withColumn("grp", F.floor(F.col("x1") / 50)).select("id", "page", "grp", *geo.segment_metrics())
    out = aggregates.line_groups(rows, ["page", "grp"], order="id")
    return out.select("page", "grp", F.round("center_x", 6).alias("center_x"), F.round("total_length", 6).alias("total_length"), "line_count", "barline_score")


@query(f"SELECT cls, n, CAST(row_number() OVER (ORDER BY n DESC, cls) AS BIGINT) AS rank FROM (SELECT cls, count(*) AS n FROM ({BOXES}) GROUP BY 1)")
def class_frequency(spark, sf_dir):
    return aggregates.class_frequency(derived(spark, sf_dir, BOXES))


@query(f"""WITH c AS (SELECT CASE WHEN cls < 4 THEN cls ELSE 4 END AS cls, count(*) AS n FROM ({BOXES}) GROUP BY 1)
 SELECT cls, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share, round(max(n) OVER () / CAST(min(n) OVER () AS DOUBLE), 9) AS imbalance, round(1 / sqrt(n / CAST(sum(n) OVER () AS DOUBLE)), 9) AS weight,
 CASE WHEN n / CAST(sum(n) OVER () AS DOUBLE) > 0.5 THEN 'dominant' WHEN n / CAST(sum(n) OVER () AS DOUBLE) < 0.01 THEN 'rare' ELSE 'fine' END AS advice FROM c""")
def class_balance(spark, sf_dir):
    out = aggregates.class_balance(derived(spark, sf_dir, BOXES).withColumn("cls", F.least("cls", F.lit(4))))
    return out.select("cls", "n", F.round("share", 9).alias("share"), F.round("imbalance", 9).alias("imbalance"), F.round("weight", 9).alias("weight"), "advice")


@query(f"""WITH c AS (SELECT x1 AS cls, count(*) AS n FROM ({BOXES}) GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, cls LIMIT 50)
 SELECT cls, n, 'top' AS why FROM t UNION ALL SELECT cls, n, 'essential' FROM c WHERE cls % 10 = 3 AND n > 20 AND cls NOT IN (SELECT cls FROM t)""")
def top_classes(spark, sf_dir):
    counts = derived(spark, sf_dir, BOXES).groupBy(F.col("x1").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.top_classes(counts, counts.where("cls % 10 = 3").select("cls"), 50, 20)


@query(f"""WITH c AS (SELECT image, cls, count(*) AS n FROM ({BOXES}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, image) AS r FROM c)
 SELECT image, string_agg(CAST(cls AS VARCHAR), ',' ORDER BY cls) AS picked_for FROM r WHERE r <= 10 GROUP BY 1""")
def per_class_top_images(spark, sf_dir):
    out = sampling.top_images_per_class(aggregates.per_image_counts(derived(spark, sf_dir, BOXES)), 10)
    return out.select("image", F.array_join(F.col("picked_for").cast("array<string>"), ",").alias("picked_for"))


@query("""SELECT CASE WHEN contains(lower(p_name), 'widget') THEN 'widgets' WHEN contains(lower(p_name), 'ring') THEN 'rings' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1""")
def category_counts(spark, sf_dir):
    cat = names.category(F.col("p_name"), (("widget", "widgets"), ("ring", "rings")))
    return table(spark, sf_dir, "part").groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))


SYMBOLS = "SELECT event_id AS id, CASE event_id % 11 WHEN 0 THEN 'noteheadBlackOnLine' WHEN 1 THEN 'flag8thUp' WHEN 2 THEN 'restQuarter' WHEN 3 THEN 'clefG' WHEN 4 THEN 'keySharp' WHEN 5 THEN 'accidentalFlat' WHEN 6 THEN 'timeSigCommon' WHEN 7 THEN 'timeSig12' WHEN 8 THEN 'meter7_8' WHEN 9 THEN 'TimeSig9' ELSE 'brace' END AS class_name FROM events"


@query(f"""SELECT CASE WHEN contains(c, 'notehead') THEN 'noteheads' WHEN contains(c, 'flag') THEN 'flags' WHEN contains(c, 'rest') THEN 'rests' WHEN contains(c, 'clef') THEN 'clefs' WHEN contains(c, 'key') OR contains(c, 'accidental') THEN 'keys/accidentals' WHEN contains(c, 'timesig') THEN 'time signatures' ELSE 'other' END AS category, count(*) AS n FROM (SELECT lower(class_name) AS c FROM ({SYMBOLS})) GROUP BY 1""")
def symbol_categories(spark, sf_dir):
    return derived(spark, sf_dir, SYMBOLS).groupBy(names.category(F.col("class_name")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT id, CASE WHEN contains(c, 'timesigcommon') THEN '4/4 (Common Time)' WHEN contains(c, 'timesig12') THEN '12/8' WHEN contains(c, 'timesig9') THEN '9/8' WHEN c = 'meter7_8' THEN '7/8' WHEN c = 'flag8thup' THEN NULL END AS signature,
 CAST(CASE WHEN contains(c, 'timesig12') THEN 12 WHEN contains(c, 'timesig9') THEN 9 WHEN c = 'meter7_8' THEN 7 ELSE 4 END AS INT) AS beats FROM (SELECT id, lower(class_name) AS c FROM ({SYMBOLS}))""")
def signature_parse(spark, sf_dir):
    return derived(spark, sf_dir, SYMBOLS).select("id", names.signature(F.col("class_name")).alias("s")).select("id", "s.signature", "s.beats")


@query(f"""WITH s AS (SELECT image % 8 AS scale, count(*) AS total, avg(confidence) AS a, count(DISTINCT cls) AS k FROM ({BOXES}) GROUP BY 1), c AS (SELECT *, total / CAST(max(total) OVER () AS DOUBLE) * 0.4 + a / max(a) OVER () * 0.4 + k / CAST(max(k) OVER () AS DOUBLE) * 0.2 AS composite FROM s)
 SELECT (SELECT scale FROM c ORDER BY composite DESC, scale LIMIT 1) AS best, (SELECT scale FROM c ORDER BY total DESC, scale LIMIT 1) AS most_detections, (SELECT scale FROM c ORDER BY a DESC, scale LIMIT 1) AS highest_confidence, (SELECT scale FROM c ORDER BY k DESC, scale LIMIT 1) AS most_classes, round((SELECT max(composite) FROM c), 9) AS composite""")
def composite_best(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).withColumn("scale", F.col("image") % 8)
    return aggregates.best_by_composite(aggregates.scale_summary(rows)).withColumn("composite", F.round("composite", 9))


@query(f"SELECT page, arg_min(v, -n * 1000000000 + f) AS value, max(n) AS votes FROM (SELECT page, x % 5 AS v, count(*) AS n, min(id) AS f FROM ({PLACES}) GROUP BY 1, 2) GROUP BY 1")
def majority_vote(spark, sf_dir):
    return aggregates.majority(derived(spark, sf_dir, PLACES).withColumn("value", F.col("x") % 5), ["page"], "value", "id")


@query(f"SELECT image, cls, min(x1) AS x, min(y1) AS y, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM ({BOXES}) GROUP BY 1, 2")
def combined_boxes(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select("image", "cls", F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h")
    return aggregates.combined_boxes(rows, ["image", "cls"])


@query(f"SELECT page, CASE WHEN max(n) >= 2 THEN max(n) - 1 ELSE 0 END AS measures FROM (SELECT page, system_idx, count(*) AS n FROM ({BARLINES}) GROUP BY 1, 2) GROUP BY 1")
def measure_counts(spark, sf_dir):
    return aggregates.measure_counts(derived(spark, sf_dir, BARLINES), ["page"])


@query(f"""WITH p AS ({PIXELS_SQL}), r AS (SELECT page, y, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT *, n / CAST(max(n) OVER (PARTITION BY page) AS DOUBLE) AS norm FROM r)
 SELECT page, y, n, round(norm, 9) AS norm, norm >= greatest(0.1, avg(norm) OVER (PARTITION BY page) * 0.5) AS is_line FROM q""")
def row_projection(spark, sf_dir):
    return aggregates.row_projection(pixels(spark, sf_dir)).withColumn("norm", F.round("norm", 9))


@query(f"SELECT page, y, min(x) AS x_start, max(x) AS x_end FROM ({PIXELS_SQL}) GROUP BY 1, 2")
def line_extents(spark, sf_dir):
    return aggregates.line_extents(pixels(spark, sf_dir), ["page", "y"], 64)


@query(f"SELECT page, round(count(*) / (64.0 * max(y)), 9) AS density FROM ({PIXELS_SQL}) GROUP BY 1")
def pixel_density(spark, sf_dir):
    return aggregates.ink_density(pixels(spark, sf_dir), ["page"], 64).withColumn("density", F.round("density", 9))


@query(f"SELECT image, x1 // 100 AS g, CAST(trunc(median(x1)) AS INT) AS x, min(y1) AS y_start, max(y2) AS y_end FROM ({BOXES}) GROUP BY 1, 2")
def bracket_merge(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).select("image", F.floor(F.col("x1") / 100).alias("g"), F.col("x1").alias("x"), "y1", "y2")
    return aggregates.bracket_merge(rows, ["image", "g"])


# windows


@query(f"""SELECT id, page, x, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '4/4') AS signature FROM (SELECT *, CASE id % 13 WHEN 0 THEN '3/4' WHEN 5 THEN '6/8' END AS s FROM ({PLACES}))""")
def carry_forward(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).withColumn("s", F.when(F.col("id") % 13 == 0, "3/4").when(F.col("id") % 13 == 5, "6/8"))
    return windows.carry_forward(rows, ["page"], ["id"], "s", "4/4", "signature").select("id", "page", "x", "signature")


@query(f"SELECT id, page, CAST(coalesce(sum(x) OVER (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ({PLACES})")
def prefix_measures(spark, sf_dir):
    return windows.prefix_sums(derived(spark, sf_dir, PLACES), ["page"], ["id"], "x").select("id", "page", "before")


@query(f"""SELECT id, page, b AS beat, (p + b - 1) * 500 AS at_ms FROM (SELECT id, page, CAST(coalesce(sum(n) OVER (PARTITION BY page ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p, unnest(range(1, n + 1)) AS b FROM (SELECT id, page, id % 4 + 2 AS n FROM ({PLACES})))""")
def beat_expansion(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).withColumn("beats", F.col("id") % 4 + 2)
    return windows.beats(rows, ["page"], ["id"]).select("id", "page", F.col("beat").cast("long").alias("beat"), "at_ms")


@query(f"SELECT page, y FROM (SELECT *, y - row_number() OVER (PARTITION BY page ORDER BY y) AS r, min(y) OVER (PARTITION BY page) AS m FROM (SELECT DISTINCT user_id % 40 AS page, event_id * 7 % 300 AS y FROM events)) WHERE r = m - 1")
def contiguous_pages(spark, sf_dir):
    rows = derived(spark, sf_dir, "SELECT DISTINCT user_id % 40 AS page, event_id * 7 % 300 AS y FROM events")
    return windows.contiguous_pages(rows, ["page"], "y")


@query("SELECT DISTINCT p_size, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INT) AS dense_id FROM part")
def dense_ids(spark, sf_dir):
    return windows.dense_ids(table(spark, sf_dir, "part").select(F.col("p_size")).distinct(), "p_size")


@query(f"SELECT page, x, system_idx, CAST(row_number() OVER (PARTITION BY page ORDER BY x) AS INT) AS number FROM (SELECT page, x, min(system_idx) AS system_idx FROM ({BARLINES}) GROUP BY 1, 2)")
def barline_numbers(spark, sf_dir):
    return windows.first_occurrence_numbers(derived(spark, sf_dir, BARLINES), ["page"])


@query("""WITH p AS (SELECT p_partkey AS id, p_size * 100 AS w, p_size * 60 + 500 AS h FROM part), x AS (SELECT DISTINCT id, least(i * 896, greatest(0, w - 1024)) AS tile_x FROM (SELECT id, w, unnest(range(0, CAST(greatest(0, ceil((w - 1024) / 896.0)) AS BIGINT) + 1)) AS i FROM p)),
 y AS (SELECT DISTINCT id, least(i * 896, greatest(0, h - 1024)) AS tile_y FROM (SELECT id, h, unnest(range(0, CAST(greatest(0, ceil((h - 1024) / 896.0)) AS BIGINT) + 1)) AS i FROM p)) SELECT x.id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y FROM x JOIN y ON x.id = y.id""")
def tile_plan(spark, sf_dir):
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size * 100 AS width", "p_size * 60 + 500 AS height")
    return windows.tiles(pages).select("id", F.col("tile_x").cast("int").alias("tile_x"), F.col("tile_y").cast("int").alias("tile_y"))


@query(f"""WITH s AS (SELECT page, x % 9 AS system_idx, min(x) AS top, max(x) AS bottom FROM (SELECT page, x, x // 223 AS k FROM ({PLACES})) GROUP BY 1, 2) SELECT page, system_idx,
 greatest(0, top - CASE WHEN a IS NULL THEN bottom - top ELSE CAST(floor((top - a) / 2.0) AS BIGINT) END) AS y_top, bottom + CASE WHEN b IS NULL THEN bottom - top ELSE CAST(floor((b - bottom) / 2.0) AS BIGINT) END AS y_bottom
 FROM (SELECT *, lag(bottom) OVER w AS a, lead(top) OVER w AS b FROM s WINDOW w AS (PARTITION BY page ORDER BY system_idx))""")
def y_ranges(spark, sf_dir):
    systems = derived(spark, sf_dir, PLACES).groupBy("page", (F.col("x") % 9).alias("system_idx")).agg(F.min("x").alias("top"), F.max("x").alias("bottom"))
    return windows.y_ranges(systems, ["page"]).select("page", "system_idx", "y_top", "y_bottom")


# plans

SYSTEMS_SQL = f"""l AS ({STAFFS}), d AS (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM l), sp AS (SELECT page, median(gap) AS spacing FROM d WHERE gap IS NOT NULL GROUP BY 1),
 r AS (SELECT d.page, d.y, sum(CASE WHEN gap > spacing * 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY d.page ORDER BY d.y) AS run FROM d JOIN sp ON d.page = sp.page),
 c AS (SELECT *, (row_number() OVER (PARTITION BY page, run ORDER BY y) - 1) // 5 AS chunk FROM r),
 s AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY run, chunk) - 1 AS INT) AS system_idx, min(y) AS top, max(y) AS bottom, CAST(floor((min(y) + max(y)) / 2.0) AS BIGINT) AS y, list(y ORDER BY y) AS ys FROM c GROUP BY page, run, chunk HAVING count(*) = 5),
 g AS (SELECT * FROM (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM s) WHERE gap IS NOT NULL), {THRESHOLD_SQL},
 th AS (SELECT sp.page, coalesce(CASE WHEN n >= 6 THEN CASE WHEN widest > 50 THEN middle ELSE q60 END WHEN n >= 3 THEN mid * 1.3 WHEN n > 0 THEN spacing * 8 END, 100.0) AS threshold FROM sp LEFT JOIN a ON sp.page = a.page LEFT JOIN f ON sp.page = f.page),
 sg AS (SELECT s.page, system_idx, top, bottom, ys, CAST(sum(CASE WHEN k > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY s.page ORDER BY s.y) AS BIGINT) AS group_idx FROM (SELECT *, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS k FROM s) s JOIN th ON s.page = th.page)"""
CONSENSUS_SQL = f"""{SYSTEMS_SQL}, b AS (SELECT b.page, b.system_idx, b.x, group_idx FROM ({BARLINES}) b JOIN sg ON b.page = sg.page AND b.system_idx = sg.system_idx),
 bx AS (SELECT *, x - lag(x) OVER (PARTITION BY page, group_idx ORDER BY x) AS dx FROM (SELECT DISTINCT page, group_idx, x FROM b)),
 bc AS (SELECT page, group_idx, x, sum(CASE WHEN dx > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY page, group_idx ORDER BY x) AS cluster FROM bx),
 v AS (SELECT b.page, b.group_idx, cluster, count(DISTINCT system_idx) AS k, CAST(floor(avg(b.x)) AS BIGINT) AS x FROM b JOIN bc ON b.page = bc.page AND b.group_idx = bc.group_idx AND b.x = bc.x GROUP BY 1, 2, 3),
 gs AS (SELECT page, group_idx, count(*) AS group_size, min(top) AS top, max(bottom) AS bottom FROM sg GROUP BY 1, 2),
 co AS (SELECT v.page, v.group_idx, x, top - 10 AS y_start, bottom + 10 AS y_end, CAST(k AS INT) AS consensus_count, group_size FROM v JOIN gs ON v.page = gs.page AND v.group_idx = gs.group_idx WHERE k >= greatest(1, floor(group_size * 0.8)))"""


@query(f"WITH {SYSTEMS_SQL} SELECT page, system_idx, top, bottom, group_idx FROM sg")
def system_groups(spark, sf_dir):
    return mp.page_systems(derived(spark, sf_dir, STAFFS)).select("page", "system_idx", "top", "bottom", "group_idx")


@query(f"WITH {CONSENSUS_SQL} SELECT * FROM co")
def consensus_barlines(spark, sf_dir):
    systems = mp.page_systems(derived(spark, sf_dir, STAFFS))
    return mp.agreed_barlines(derived(spark, sf_dir, BARLINES), systems).drop("systems")


@query(f"""WITH {CONSENSUS_SQL}, st AS (SELECT page, group_idx, x FROM co UNION ALL SELECT DISTINCT page, group_idx, 0 FROM co), iv AS (SELECT page, group_idx, x AS x_start, lead(x) OVER (PARTITION BY page, group_idx ORDER BY x) AS x_end FROM st),
 yr AS (SELECT page, system_idx, group_idx, greatest(0, top - CASE WHEN u IS NULL THEN bottom - top ELSE CAST(floor((top - u) / 2.0) AS BIGINT) END) AS yt, bottom + CASE WHEN w IS NULL THEN bottom - top ELSE CAST(floor((w - bottom) / 2.0) AS BIGINT) END AS yb, ys FROM (SELECT *, lag(bottom) OVER q AS u, lead(top) OVER q AS w FROM sg WINDOW q AS (PARTITION BY page ORDER BY system_idx))),
 m AS (SELECT iv.page, system_idx, iv.group_idx, CAST(row_number() OVER (PARTITION BY iv.page, system_idx ORDER BY x_start, x_end) AS INT) AS measure_number, x_start, x_end, yt, yb, ys FROM iv JOIN yr ON iv.page = yr.page AND iv.group_idx = yr.group_idx WHERE x_end - x_start >= 20)
 SELECT printf('P%d_%02d_%03d', page, system_idx, measure_number) AS measure_id, page, system_idx, group_idx, measure_number, x_start AS x, yt AS y, x_end - x_start AS width, yb - yt AS height, CAST(len(list_filter(ys, lambda e: e - yt >= 0 AND e < yb)) AS INT) AS n_lines FROM m""")
def measures_from_barlines(spark, sf_dir):
    systems = mp.page_systems(derived(spark, sf_dir, STAFFS))
    bars = mp.agreed_barlines(derived(spark, sf_dir, BARLINES), systems)
    out = mp.measures(bars, systems)
    return out.select("measure_id", "page", "system_idx", "group_idx", "measure_number", F.col("bbox.x").cast("long").alias("x"), F.col("bbox.y").cast("long").alias("y"), F.col("bbox.width").cast("long").alias("width"), F.col("bbox.height").cast("long").alias("height"), F.size("staff_lines").alias("n_lines"))


# validation


@query(f"""WITH e AS (SELECT page, x1 // 20 AS g, min(least(y1, y2)) AS a, max(greatest(y1, y2)) AS b FROM ({SEGMENTS}) GROUP BY 1, 2)
 SELECT page, g AS grp, a >= 50 - 10 * 1.2 AND a <= 50 + 10 * 0.7 AND b >= 600 - 10 * 0.7 AND b <= 600 + 10 * 1.2 AND b - a + 1 <= 565 AS spans FROM e""")
def full_span(spark, sf_dir):
    rows = validation.group_extents(derived(spark, sf_dir, SEGMENTS).withColumn("grp", F.floor(F.col("x1") / 20)), ["page", "grp"])
    staff = rows.withColumns({"top": F.lit(50), "bottom": F.lit(600), "spacing": F.lit(10.0)})
    return staff.select("page", "grp", validation.spans_staff(max_length=F.lit(565)).alias("spans"))


@query(f"""WITH e AS (SELECT image AS page, min(x1) + 400 AS a, max(x1) + 500 AS b FROM ({BOXES}) WHERE image % 4 <> 0 GROUP BY 1) SELECT p.page, p.id, p.x FROM ({PLACES}) p LEFT JOIN e ON p.page = e.page WHERE a IS NULL OR p.x BETWEEN a - 50 AND b + 50""".replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 4 <> 0").replace(" WHERE image % 4 <> 0", ""))
def within_bounds(spark, sf_dir):
    """Pages with a number divisible by four have no lines, and keep all."""
    lines = derived(spark, sf_dir, BOXES.replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 4 <> 0"))
    extents = lines.select(F.col("image").alias("page"), (F.col("x1") + 400).alias("x_start"), (F.col("x1") + 500).alias("x_end"))
    return validation.within_bounds(derived(spark, sf_dir, PLACES), extents, ["page"]).select("page", "id", "x")


RUNS_SQL = f"r AS (SELECT page, x, min(y) AS y_start, max(y) AS y_end FROM (SELECT *, y - row_number() OVER (PARTITION BY page, x ORDER BY y) AS k FROM ({PIXELS_SQL})) GROUP BY page, x, k)"


@query(f"""WITH {RUNS_SQL}, c AS (SELECT *, greatest(0, least(y_end, 34 + 10) - greatest(y_start, 10 - 10)) / 44.0 AS v FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY page, x ORDER BY v DESC, y_start) AS k FROM c WHERE v > 0)
 SELECT page, x, y_start, y_end, round(v, 9) AS coverage FROM b WHERE k = 1 AND y_end - y_start + 1 <= 24 + trunc(6.0 * 2.5)""")
def covering_runs(spark, sf_dir):
    runs = islands.vertical_runs(pixels(spark, sf_dir), ["page", "x"])
    candidates = runs.select("page", "x").distinct().withColumns({"top": F.lit(10), "bottom": F.lit(34), "spacing": F.lit(6.0)})
    out = validation.covers_staff(candidates, runs, ["page"]).where("coverage > 0").withColumn("coverage", F.round(F.col("coverage"), 9))
    return out.select("page", "x", "y_start", "y_end", "coverage")


@query(f"""WITH p AS ({PIXELS_SQL}), {RUNS_SQL}, f AS (SELECT page, x, min(y_start) AS s FROM r WHERE y_end - y_start + 1 >= 4 AND y_start <= 20 AND y_end >= 8 GROUP BY 1, 2), g AS (SELECT f.page, f.x, s, y_end AS e FROM f JOIN r ON r.page = f.page AND r.x = f.x AND r.y_start = f.s),
 l AS (SELECT unnest([10, 12, 14, 16, 18]) AS y), h AS (SELECT g.page, g.x, s, e, count(DISTINCT l.y) AS n FROM g JOIN l ON l.y BETWEEN s - 3 AND e + 3 JOIN p ON p.page = g.page AND p.x = g.x AND p.y BETWEEN l.y - 1 AND l.y + 1 GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT l.y) >= 3),
 o AS (SELECT h.page, h.x, k, (SELECT count(*) FROM p WHERE p.page = h.page AND p.x = h.x + [1, -1, 2, -2, 3, -3][k] AND p.y BETWEEN s AND e) / CAST(e - s + 1 AS DOUBLE) AS c FROM h, (SELECT unnest(range(1, 7)) AS k) q)
 SELECT page, x FROM o GROUP BY page, x HAVING coalesce(min(k) FILTER (WHERE c < 0.3) - 1, 6) + 1 <= 4""")
def valid_barlines(spark, sf_dir):
    p = pixels(spark, sf_dir)
    candidates = p.select("page", "x").distinct().withColumns({"staff": F.lit(0), "top": F.lit(10), "bottom": F.lit(18)})
    lines = p.select("page").distinct().select("page", F.lit(0).alias("staff"), F.explode(F.array(*[F.lit(y) for y in (10, 12, 14, 16, 18)])).alias("y"))
    return validation.valid_for_staff(candidates, p, lines, ["page"], crossed=3, thickest=4).select("page", "x")


@query(f"""WITH d AS (SELECT page, count(*) / (64.0 * max(y)) AS density FROM ({PIXELS_SQL}) GROUP BY 1) SELECT page, CAST(greatest(5, trunc(10 * density)) AS INT) AS threshold, CAST(greatest(3, trunc((page + 10.0) * 0.3)) AS INT) AS min_length, CAST(greatest(2, trunc((page + 10.0) * 0.2)) AS INT) AS max_gap,
 CAST(greatest(5, trunc(2048 * 0.005)) AS INT) AS x_tolerance, CASE WHEN density < 0.1 THEN 25 ELSE 15 END AS angle_tolerance FROM d""")
def tuned_parameters(spark, sf_dir):
    rows = pixels(spark, sf_dir).groupBy("page").agg((F.count(F.lit(1)) / (F.lit(64.0) * F.max("y"))).alias("density"))
    return rows.withColumn("spacing", F.col("page") + F.lit(10.0)).withColumn("width", F.lit(2048)).select("page", *validation.tuned_parameters())


@query(f"WITH {SYSTEMS_SQL} SELECT page, greatest(0, min(top) - 50) AS y_from, max(bottom) + 50 AS y_to, CAST(trunc(min(bottom - top) * 1.5) AS INT) AS min_length, CAST(trunc(avg((bottom - top) / 4.0) * 0.5) AS INT) AS max_gap FROM sg GROUP BY 1")
def bracket_parameters(spark, sf_dir):
    return validation.bracket_parameters(mp.page_systems(derived(spark, sf_dir, STAFFS)), ["page"])


# symbols


@query(f"""WITH s AS (SELECT page, id, floor((x1 + x2) / 2.0) AS x, floor((y1 + y2) / 2.0) AS y FROM ({SEGMENTS}) WHERE abs(CASE WHEN x2 = x1 THEN 90.0 ELSE degrees(atan((y2 - y1) / CAST(x2 - x1 AS DOUBLE))) END) > 75),
 n AS (SELECT image AS page, id AS target_id, x1 AS x, y1 AS y FROM ({BOXES})), m AS (SELECT s.page, s.id, target_id, (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) AS d FROM s JOIN n ON s.page = n.page)
 SELECT page, id, target_id AS associated_notehead, round(sqrt(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY d, target_id) AS k FROM m WHERE d <= 900) WHERE k = 1""")
def stems_near_noteheads(spark, sf_dir):
    heads = derived(spark, sf_dir, BOXES).select(F.col("image").alias("page"), F.col("id").alias("target_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return symbols.stems(derived(spark, sf_dir, SEGMENTS), heads).select("page", "id", "associated_notehead", F.round("distance", 6).alias("distance"))


TILED_SQL = f"SELECT id, image, cls, confidence, x1 % 300 + (id % 4) % 2 * 200 AS x1, x1 % 300 + w + (id % 4) % 2 * 200 AS x2, y1 % 300 + (id % 4) // 2 * 200 AS y1, y1 % 300 + h + (id % 4) // 2 * 200 AS y2 FROM ({BOXES})"


@query(NMS_SQL.replace(f"WITH b AS ({BOXES})", f"WITH b AS ({TILED_SQL})").replace(">= 0.3", ">= 0.5"))
def tiled_detections(spark, sf_dir):
    """Boxes found in four tiles that overlap by a third."""
    rows = derived(spark, sf_dir, BOXES).selectExpr("id", "image", "cls", "confidence", "x1 % 300 AS x1", "x1 % 300 + w AS x2", "y1 % 300 AS y1", "y1 % 300 + h AS y2", "id % 4 AS tile")
    return symbols.tiled(spark.createDataFrame([(i, i % 2 * 200, i // 2 * 200) for i in range(4)], "tile int, tile_x int, tile_y int"), rows).select("id")


@query(f"SELECT id, round(x1 / 1000.0, 9) AS x1, round(y1 / 1300.0, 9) AS y1, round(x2 / 1000.0, 9) AS x2, round(y2 / 1300.0, 9) AS y2 FROM ({BOXES})")
def ratio_boxes(spark, sf_dir):
    rows = derived(spark, sf_dir, BOXES).withColumns({"page_width": F.lit(1000.0), "page_height": F.lit(1300.0)})
    return symbols.ratio_boxes(rows).select("id", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH m AS (SELECT page AS doc, x % 3 AS page, x % 4 AS group_idx, id, row_number() OVER (PARTITION BY page, x % 3, x % 4 ORDER BY id) AS n FROM ({PLACES})), p AS (SELECT doc, page, group_idx, max(n) AS k FROM m GROUP BY 1, 2, 3),
 b AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY doc ORDER BY page, group_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT m.id, CAST(before + n AS BIGINT) AS absolute_number FROM m JOIN b ON m.doc = b.doc AND m.page = b.page AND m.group_idx = b.group_idx""")
def absolute_numbers(spark, sf_dir):
    rows = derived(spark, sf_dir, PLACES).select(F.col("page").alias("doc"), (F.col("x") % 3).alias("page"), (F.col("x") % 4).alias("group_idx"), "id")
    return symbols.absolute_numbers(windows.numbered(rows, ["doc", "page", "group_idx"], ["id"])).select("id", F.col("absolute_number").cast("long").alias("absolute_number"))


@query(f"SELECT DISTINCT o_orderkey AS image FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def labelled_images(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image")).distinct()
    return symbols.labelled_images(images, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("image")))


# documents, splits, sets


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1, 2""")
def nested_json_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("page"), "event_id", F.from_json("props", "k long")["k"].alias("k"))
    docs = sinks.page_documents(rows)
    back = F.from_json("document", "total_measures long, measures array<struct<event_id: long, k: long>>")
    return docs.select(F.col("doc").alias("user_id"), F.col("page").alias("event_type"), back.alias("b")).select("user_id", "event_type", F.col("b.total_measures").alias("n"), F.aggregate("b.measures", F.lit(0).cast("long"), lambda a, m: a + m["k"]).alias("k"))


@query(f"SELECT image, coalesce(string_agg(format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', cls, x1 / 1000.0, y1 / 2000.0, w / 1000.0, h / 1000.0), chr(10) ORDER BY format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', cls, x1 / 1000.0, y1 / 2000.0, w / 1000.0, h / 1000.0)), '') AS line FROM ({BOXES}) GROUP BY 1")
def label_lines(spark, sf_dir):
    boxes = derived(spark, sf_dir, BOXES)
    rows = boxes.selectExpr("image", "cls AS class_id", "x1 / 1000.0D AS xc", "y1 / 2000.0D AS yc", "w / 1000.0D AS w", "h / 1000.0D AS h")
    return sinks.label_lines(boxes.select("image").distinct(), rows)


@query(f"SELECT method, count(*) AS n, count(angle) AS with_angle FROM (SELECT 'classical' AS method, id, 1 AS angle FROM ({SEGMENTS}) UNION ALL SELECT 'model', id, NULL FROM ({BOXES})) GROUP BY 1")
def merged_results(spark, sf_dir):
    a = derived(spark, sf_dir, SEGMENTS).select("id", *geo.segment_metrics())
    out = sinks.merged_results(("classical", a), ("model", derived(spark, sf_dir, BOXES).select("id", "confidence")))
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("angle").alias("with_angle"))


@query(f"SELECT page, id, x FROM ({PLACES}) p WHERE page NOT IN (SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT page, id, x + 1 FROM ({PLACES}) WHERE id IN (SELECT event_id FROM events WHERE event_type = 'error')")
def page_upsert(spark, sf_dir):
    """Pages with errors are analysed anew; all that was stored of them goes."""
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"))
    patch = derived(spark, sf_dir, PLACES).join(errors, "id", "left_semi").withColumn("x", F.col("x") + 1)
    return sinks.upsert(derived(spark, sf_dir, PLACES), patch, ["page"]).select("page", "id", "x")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled(spark, sf_dir):
    return joins.unpaired(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT CASE WHEN bool_and(n > 0) THEN 'PASS' ELSE 'FAIL' END AS overall, count(*) FILTER (WHERE n > 0) AS passed, count(*) FILTER (WHERE NOT n > 0) AS failed, CAST(sum(n) AS BIGINT) AS seconds FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def validation_report(spark, sf_dir):
    steps = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("seconds")).withColumn("status", F.when(F.col("seconds") > 0, "PASS").otherwise("FAIL"))
    return sinks.validation_report(steps)


@query("SELECT DISTINCT event_type AS shard, CASE WHEN dense_rank() OVER (ORDER BY event_type) - 1 < 0.8 * (SELECT count(DISTINCT event_type) FROM events) THEN 'train' ELSE 'val' END AS split FROM events")
def shard_split(spark, sf_dir):
    return sampling.shard_split(table(spark, sf_dir, "events").select(F.col("event_type").alias("shard"))).distinct()


@query("SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 100")
def stable_sample(spark, sf_dir):
    return sampling.stable_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '-42'), 1, 7) AS BIGINT) % 10000 < 8500 THEN 'train' ELSE 'val' END AS split FROM documents")
def stable_split(spark, sf_dir):
    return sampling.stable_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


FLAGSHIP = "measures_from_barlines"

from . import page_queries  # noqa: E402, F401
