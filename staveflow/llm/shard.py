"""Uniform sharding by a hypergeometric communication matrix.

Cell (i, j) of the matrix is how many rows input partition i sends to bin j.
Row i is the multivariate hypergeometric share of the partition's rows in bins
of fixed size. Each task draws only its own row, by walking down a binary tree
over the partitions: at each node the left half's counts are drawn with a seed
of the node's own, so all tasks agree without a matrix anywhere. A task deals
its rows to bins by a random permutation of the bin numbers with those counts
(permute locally), the rows move once (exchange), and each bin is sorted by a
random key (permute again). A shard is a run of bins, so one shard isn't one
task, and slots count through its bins.

Sizes are exact: shards differ by at most one row, bins of a shard too. Draws
are exact at every size: where numpy's sampler ends (1e9 rows at a tree node),
bins are halved until their sums fit it, each half's share by rejection with
ratios of uniforms. Nulls, empty and very long texts and repeated rows are rows
like any other (a bin's sort spills); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import ROW_BYTES, fresh, read, stable

#: About so many bytes of text in a bin, which one task sorts.
BIN_BYTES = 128 << 20
#: Numpy draws from fewer rows than this.
NUMPY_ROWS = 1_000_000_000
_ROW_BITS = 33


def even(total: int, parts: int) -> np.ndarray:
    out = np.full(parts, total // parts, dtype=np.int64)
    out[: total % parts] += 1
    return out


def _steps(a: int, d: int) -> float:
    """log((a + d)! / a!)."""
    if min(a, a + d) < 1000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    x, y = float(a), float(a + d)
    return (y + 0.5) * math.log1p(d / x) + d * math.log(x) - d + 1 / (12 * y) - 1 / (12 * x) - 1 / (360 * y**3) + 1 / (360 * x**3)


def _log_odds(good: int, bad: int, n: int, mode: int, d: int) -> float:
    """log of the probability of mode + d over that of mode. Where all counts are large, the leading terms are taken from whole numbers, so that they don't cancel in rounding."""
    a, b, c, e = mode, good - mode, n - mode, bad - n + mode
    if min(a, b, c, e, a + d, b - d, c - d, e + d) < 1000:
        return -(_steps(a, d) + _steps(b, -d) + _steps(c, -d) + _steps(e, d))
    out = d * math.log1p((a * e - b * c) / (b * c))
    for x, s in ((a, d), (b, -d), (c, -d), (e, d)):
        y = x + s
        out += (y + 0.5) * math.log1p(s / x) + 1 / (12 * y) - 1 / (12 * x)
    return -out


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n rows drawn without replacement are good; rejection by ratios of uniforms, which has no limit of size."""
    least, most = max(0, n - bad), min(good, n)
    if least == most:
        return least
    total = good + bad
    mode = min(max((good + 1) * (n + 1) // (total + 2), least), most)
    mean, spread = n * good / total, n * (good / total) * (bad / total) * ((total - n) / (total - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= _log_odds(good, bad, n, mode, k - mode):
            return k


def draw(colors: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n rows, drawn without replacement, have each colour."""
    total = int(colors.sum())
    if total < NUMPY_ROWS:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    if len(colors) == 1:
        return np.array([n], np.int64)
    mid = len(colors) // 2
    first = int(colors[:mid].sum())
    k = hypergeometric(first, total - first, n, rng)
    return np.concatenate([draw(colors[:mid], k, rng), draw(colors[mid:], n - k, rng)])


def matrix_row(p: int, before: np.ndarray, bins: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the communication matrix; before: the rows in earlier partitions, and at the end all rows."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(bins, int(before[mid] - before[lo]), np.random.default_rng([seed, lo, hi]))
        lo, hi, bins = (lo, mid, left) if p < mid else (mid, hi, bins - left)
    return bins


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 7, bins_per_shard: int | None = None) -> DataFrame:
    """All columns of docs with shard (int) and slot (long, gapless from 0 in each shard), in uniform random order.

    Columns of docs with these names are replaced.
    """
    docs = stable(docs.drop("shard", "slot"))
    own = docs.columns
    rid, to, key = fresh(docs, "rid"), fresh(docs, "to"), fresh(docs, "key")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c, t in docs.dtypes if t in ("string", "binary")), F.lit(ROW_BYTES).cast("long"))
    found = rows.groupBy(F.shiftright(rid, _ROW_BITS)).agg(F.count(F.lit(1)), F.sum(size)).collect()
    counts = {r[0]: r[1] for r in found}
    before = np.append(0, np.cumsum([counts.get(i, 0) for i in range(max(counts, default=0) + 1)]))
    total = int(before[-1])
    per = bins_per_shard or max(8, -(-sum(r[2] for r in found) // (shards * BIN_BYTES)))
    sizes = np.concatenate([even(int(n), per) for n in even(total, shards)])
    sent = docs.sparkSession.sparkContext.broadcast(before)

    @F.pandas_udf("to int, key long")
    def deal(ids: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        now, bins, keys = -1, None, None
        for x in ids:
            at = x.to_numpy()
            part, row = at >> _ROW_BITS, at & ((1 << _ROW_BITS) - 1)
            to_bin, by = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
            for p in np.unique(part):
                if p != now:
                    rng = np.random.default_rng([seed, int(p)])
                    counts = matrix_row(int(p), sent.value, sizes, seed)
                    bins, now = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts)), p
                    keys = rng.integers(0, 1 << 62, len(bins))
                m = part == p
                to_bin[m], by[m] = bins[row[m]], keys[row[m]]
            yield pd.DataFrame({"to": to_bin, "key": by})

    dealt = rows.withColumn(to, deal(rid)).select(*own, F.col(to)["to"].alias(to), F.col(to)["key"].alias(key))
    moved = dealt.repartition(len(sizes), to)
    order = F.row_number().over(Window.partitionBy(to).orderBy(key)).cast("long") - 1
    shard, j = F.floor(F.col(to) / per).cast("int"), (F.col(to) % per).cast("long")
    size = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    first = j * F.floor(size / per) + F.least(j, size % per)
    return moved.withColumn("slot", (first + order).cast("long")).withColumn("shard", shard).select(*own, "shard", "slot")


def op3_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shuffled(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
