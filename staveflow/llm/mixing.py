"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Each source has a target in words, so each of its documents has a rate
(target / source size) of copies: a whole part, and a fraction p to round. Two
documents meet and one moves mass to the other, up or down at random with the
odds that keep both expectations, until one of them is integral; moved mass is
counted in words, so the source's words never change. The other one goes on to
the next. Blocks of about BLOCK documents (by a hash of the row) fold like this
side by side, then the blocks' residuals do, up to one residual a source: a
reduction tree of log(rows) / log(BLOCK) levels. The last residual is rounded
at random, so a source misses its target by less than one document.

All randomness is a hash of the rows' content: reruns agree on any cluster.
Sizes are numbers of white-space words; null texts have none, and documents
without words are taken 0 times 0 words. A null source is a source. Repeated
rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import checkpoint, fresh, read

# Weights of the sources in order, share of all words to take, and most copies.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK = 32
#: Sources up to this number are broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size): words in proportion to the weights, stopped at most times the source's own, the excess reshared.

    Sources are a dimension table: what follows the sum has one row for each.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = total.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("rank", F.row_number().over(first))
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))).over(everything)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * found["level"], F.col("cap"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    """From 0 up to 1, by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _meet(state: Column, e: Column, seed: int) -> Column:
    """One step of the fold: the document in hand and the next one."""
    c = state["hand"]
    s1, s2 = c["size"].cast("double"), e["size"].cast("double")
    up, down = F.least(s1 * (1 - c["p"]), s2 * e["p"]), F.least(s1 * c["p"], s2 * (1 - e["p"]))
    rise = _uniform(c["u"], e["u"], F.lit(seed)) * (up + down) < down
    c_ends = F.when(rise, up == s1 * (1 - c["p"])).otherwise(down == s1 * c["p"])
    c_p = F.when(rise, F.when(c_ends, 1.0).otherwise(c["p"] + up / s1)).otherwise(F.when(c_ends, 0.0).otherwise(c["p"] - down / s1))
    e_p = F.when(rise, F.when(c_ends, e["p"] - up / s2).otherwise(0.0)).otherwise(F.when(c_ends, e["p"] + down / s2).otherwise(1.0))
    one, two = c.withField("p", c_p), e.withField("p", F.least(F.greatest(e_p, F.lit(0.0)), F.lit(1.0)))
    met = F.struct(F.concat(state["done"], F.array(F.when(c_ends, one).otherwise(two))).alias("done"), F.when(c_ends, two).otherwise(one).alias("hand"))
    return F.when(state["hand"].isNull(), F.struct(state["done"].alias("done"), e.alias("hand"))).otherwise(met)


def _fold(rows: DataFrame, item: str, seed: int) -> DataFrame:
    """One level: rows (source, block, unit) to one row a block with `done` and `hand`."""
    groups = rows.groupBy("source", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    start = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("done"), F.expr(f"cast(null as {item})").alias("hand"))
    # large documents first, so that what is left over tends to be small
    folded = F.aggregate("units", start, lambda s, e: _meet(s, e, seed))
    return groups.select("source", folded.alias("f")).select("source", "f.done", "f.hand")


def rounded(units: DataFrame, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Rows (source, size, p, u, id) with p replaced by 0.0 or 1.0; u is a hash unlike any other row's, id any value to carry."""
    unit = F.struct((-F.col("size")).alias("order"), "u", "size", "p", "id")
    whole = units.where("size <= 0 or p <= 0 or p >= 1")
    open_ = units.where("size > 0 and p > 0 and p < 1").select("source", "u", unit.alias("unit"))
    item = open_.schema["unit"].dataType.simpleString()
    count = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    few = count.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    count = F.broadcast(count) if few else count
    most = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    parts, level, now = [whole.select("source", F.struct("u", "size", "p", "id").alias("unit"))], 0, open_
    joined = open_.join(count.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    now = joined.select("source", "unit", F.pmod(F.xxhash64("u", F.lit(seed)), F.ceil(F.col("n") / block)).alias("block"))
    blocks = -(-most // block)
    while True:
        out = checkpoint(_fold(now, item, seed + level))
        done = out.select("source", F.explode("done").alias("unit"))
        parts.append(done.select("source", F.struct("unit.u", "unit.size", "unit.p", "unit.id").alias("unit")))
        hands = out.select("source", F.col("hand").alias("unit")).where("unit is not null")
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // block)
        now = hands.withColumn("block", F.pmod(F.xxhash64("unit.u", F.lit(seed + level)), F.lit(blocks)))
    last = hands.select("source", F.struct("unit.u", "unit.size", F.when(_uniform(F.col("unit.u"), F.lit(seed + 99)) < F.col("unit.p"), 1.0).otherwise(0.0).alias("p"), "unit.id").alias("unit"))
    return reduce(DataFrame.union, [*parts, last]).select("source", "unit.size", "unit.p", "unit.id")


def _row_hashes(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Two hashes of a whole row. Spark's hash passes over nulls, so which columns are null is hashed too, and nested columns are hashed as JSON."""
    cols = [F.to_json(c, {"ignoreNullFields": "false"}) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in docs.dtypes]
    cols += [F.col(c).isNull() for c in docs.columns]
    return F.xxhash64(*cols), F.xxhash64(F.lit(seed), *reversed(cols))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """For each row of docs: k1, k2 (a hash of the whole row), doc_id, size, source_size, target and copies."""
    k1, k2 = _row_hashes(docs, seed)
    keyed = docs.select("doc_id", "source", word_count("text").alias("size"), k1.alias("k1"), k2.alias("k2"))
    units = checkpoint(keyed.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = checkpoint(targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most))
    side = goal.select(F.col("source").alias("s"), "source_size", "target")
    few = goal.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    rows = units.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = rows.select("source", "size", (rate - F.floor(rate)).alias("p"), F.xxhash64("k1", "k2", "again").alias("u"), F.struct("k1", "k2", "doc_id", "source_size", "target", F.floor(rate).cast("long").alias("whole")).alias("id"))
    return rounded(checkpoint(ready), seed).select("id.k1", "id.k2", "id.doc_id", "source", "size", "id.source_size", "id.target", (F.col("id.whole") + F.col("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    Rows that agree in all columns are one row with the sum of their copies,
    so the texts move once, by a hash of the row.
    """
    h1, h2 = _row_hashes(docs, how.get("seed", 11))
    k1, k2, row, times = (fresh(docs, n) for n in ("k1", "k2", "row", "times"))
    taken = copies(docs, **how).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sum("copies").cast("int").alias(times)).where(F.col(times) > 0)
    kept = docs.select(h1.alias(k1), h2.alias(k2), F.struct(*docs.columns).alias(row)).groupBy(k1, k2).agg(F.first(row).alias(row))
    out = kept.join(taken, [k1, k2]).select(row, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(row)[c].alias(c) for c in docs.columns])


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
