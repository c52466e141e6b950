"""Line dedup by a suffix array over line ids, built by prefix doubling; DataFrame functions only.

Every line is a 64-bit id. At depth k each line has the name of the run of k
lines that starts there; names are order-preserving ranks of the distinct
runs, from a range sort, so a name is a suffix-array bucket: an interval of
suffixes with a longest common prefix of k lines at least. Doubling pairs the
name at a line with the name k lines on and ranks the distinct pairs; depths in
between pair names that overlap. Suffixes whose bucket holds one of them are
final and are left out of all later levels, so only repeated lines move on.

All but the first of a bucket (by doc_id, nulls last, then row, then line) are
later copies, and their lines are deleted, if the run has MIN_RUN lines or
MIN_BYTES bytes (UTF-8, without line ends). That is the same as judging maximal
repeated runs: one of more than min_run lines is a union of runs of min_run
lines, which qualify, so doubling ends there and depths up to it are enough.

Distinct runs are counted with partial aggregates and joined back on their
names, so a very common line is a skewed join that Spark splits, never a group
in one task. Null texts have no lines; an empty text is one empty line. Rows
that repeat are documents of their own, the later ones copies; a long text is
as many rows as it has lines; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpoint, fresh, read, stable

MIN_RUN, MIN_BYTES = 3, 150


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys occur more than once, with `name`, the rank of their keys."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    ranks = checkpoint(again.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))
    return rows.join(ranks, keys).drop(*keys)


def repeated(docs: DataFrame, min_run: int = MIN_RUN, min_bytes: int | None = MIN_BYTES) -> DataFrame:
    """(rid, removed): by row id the sorted numbers of lines, from 0, that are later copies of an earlier run of min_run lines, or of fewer with min_bytes (None: of min_run only). docs has rid, doc_id and text."""
    lines = docs.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = checkpoint(lines.select("rid", "doc_id", "pos", F.xxhash64("line").alias("a"), F.octet_length("line").cast("long").alias("size")))
    at, have, copies = Window.partitionBy("rid").orderBy("pos"), 1, []
    rows = _named(lines, ["a"]).withColumn("before", F.coalesce(F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    while True:
        rows = checkpoint(rows)
        for run in range(have, min(2 * have, min_run + 1)):
            if run == min_run or min_bytes is not None:
                found = _paired(rows, run - have)
                copies.append(_later(found if run == min_run else found.where(F.col("size") >= min_bytes), run))
        if 2 * have > min_run:
            break
        rows, have = _named(_paired(rows, have), ["a", "b"]), 2 * have
    gone = F.explode(F.sequence("pos", F.col("pos") + F.col("run") - 1)).alias("pos")
    return reduce(DataFrame.union, copies).select("rid", gone).groupBy("rid").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def _paired(rows: DataFrame, step: int) -> DataFrame:
    """rows with the name `step` lines on as `b` beside their own as `a`, where there is one, and the size of both together."""
    if not step:
        return rows.withColumn("b", F.lit(0).cast("long")).withColumnRenamed("name", "a")
    at, ahead = Window.partitionBy("rid").orderBy("pos"), F.struct("pos", "name", "before", "size")
    # the row `step` lines on is among the next `step` rows
    near = F.get(F.filter(F.array(*[F.lead(ahead, i).over(at) for i in range(1, step + 1)]), lambda x: x["pos"] == F.col("pos") + step), F.lit(0))
    rows = rows.withColumn("next", near).where("next is not null")
    return rows.select("rid", "doc_id", "pos", F.col("name").alias("a"), F.col("next.name").alias("b"), "before", (F.col("next.before") - F.col("before") + F.col("next.size")).alias("size"))


def _later(rows: DataFrame, run: int) -> DataFrame:
    """(rid, pos, run) of the rows that are not the first of their (a, b)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "pos")
    first = checkpoint(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"))
    later = rows.join(first, ["a", "b"]).where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    return later.select("rid", "pos", F.lit(run).alias("run"))


def deduplicated(docs: DataFrame, min_run: int = MIN_RUN, min_bytes: int | None = MIN_BYTES) -> DataFrame:
    """All columns of docs with later copies of line runs cut from text, and n_lines, n_removed, n_runs and removed. Columns of docs with these names are replaced."""
    docs = stable(docs.drop("n_lines", "n_removed", "n_runs", "removed"))
    rid = fresh(docs, "rid")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    found = repeated(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), min_run, min_bytes).withColumnRenamed("rid", rid)
    out = rows.join(found, rid, "left").drop(rid)
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("removed", F.array().cast("array<int>")))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i))))
    return digest(out).withColumn("text", text)


def digest(rows: DataFrame) -> DataFrame:
    """Counts from text and removed."""
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))) if "n_lines" not in rows.columns else F.col("n_lines")
    rows = rows.withColumn("removed", removed).withColumn("n_lines", n.cast("long")).withColumn("n_removed", F.size("removed").cast("long"))
    starts = F.filter("removed", lambda x, i: (i == 0) | (F.get("removed", i - 1) != x - 1))
    return rows.withColumn("n_runs", F.size(starts).cast("long"))


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    counts = rows.select("rid", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    out = digest(counts.join(repeated(rows), "rid", "left"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, k, unnest(range(0, len(l) - k + 1)) AS p, l FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE len(l) >= k),
g AS (SELECT doc_id, k, p, l[p + 1:p + k] AS run FROM w WHERE k = 3 OR list_sum(list_transform(l[p + 1:p + k], lambda x: strlen(x))) >= 150),
r AS (SELECT doc_id, p, p + k AS e, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, p) AS n FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(p, e)) AS q FROM r WHERE n > 1),
y AS (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS before FROM x),
z AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> q - 1) AS n_runs, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS removed_lines FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id
"""
