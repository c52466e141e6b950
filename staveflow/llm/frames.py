"""What the operators share on Spark's side: checkpoints, row groups, block exchange, joins by skewed keys, connected groups.

Block exchange: a task turns a row group into sorted arrays of 64-bit keys and
sends one block of bytes to each key range, instead of one row per key. It is
an ordinary shuffle of rows (range, group, block); a block never holds more
than one group's keys, and neither side has more in memory than one group or
one range.

Groups are cut by bytes of text where the rows lie. There are as many groups as
ranges, so blocks are groups times ranges; groups have GROUP_BYTES, but so many
more that a block keeps BLOCK_BYTES of text on average. Blocks thus number at
most the input's bytes over BLOCK_BYTES, in proportion to the input, while a
group grows with the square root of the input (from 17 GB of text on: 32 MB at
1 TB, 320 MB at 100 TB).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rounds import checkpoint
from ..ship import ship

#: Least bytes of text in a row group, mean bytes of text behind a block, bytes that a row counts besides its text.
GROUP_BYTES, BLOCK_BYTES, ROW_BYTES = 4 << 20, 1 << 10, 16
#: A side of a join by key goes to all tasks up to so many rows (of a few numbers each).
FEW_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more."""
    plan, sc = df._jdf.queryExecution().optimizedPlan(), df.sparkSession.sparkContext
    while plan.getClass().getSimpleName() != "LogicalRDD":
        plan = plan.children().apply(0)
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df if it is a plain scan of files or of a checkpoint, whose rows come in the same partitions and order each time; else a checkpoint of it.

    Plain: nothing above the relation but projections and filters that are
    functions of their row. Row groups and row ids of two reads of the result
    agree, also after an executor is lost.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.deterministic():
        while (name := plan.getClass().getSimpleName()) in ("Project", "Filter"):
            plan = plan.children().apply(0)
        if name == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation":
            return df
        if name in ("LocalRelation", "Range") or (name == "LogicalRDD" and plan.rdd().isCheckpointed()):
            return df
    return checkpoint(df)


def layout(total: int, least_ranges: int) -> tuple[int, int]:
    """(bytes in a row group, key ranges) for so many bytes of text."""
    group = max(GROUP_BYTES, math.isqrt(total * BLOCK_BYTES))
    return group, max(-(-total // group), least_ranges)


def laid_out(docs: DataFrame) -> tuple[int, int, int]:
    """(bytes in a row group, key ranges, bytes of text): layout() of docs; at least as many ranges as the session has shuffle partitions, so that all cores have work."""
    total = int(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0)
    return *layout(total, partitions(docs)), total


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key; sorted keys have sorted ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split_by_range(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the ranges that occur, and where each begins, with the end."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    r = range_of(keys, n)
    at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    return r[at], np.append(at, len(keys))


def pack48(keys: np.ndarray, width: int = 6) -> bytes:
    """The upper six (or so many) bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def unpack48(block: bytes, width: int = 6) -> np.ndarray:
    some = np.frombuffer(block, np.uint8).reshape(-1, width)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, 8 - width :] = some
    return out.view("<u8").ravel()


def key_width(keys: float) -> int:
    """Bytes that tell so many keys apart but for about one in a thousand."""
    return min(8, max(5, math.ceil((math.log2(max(2.0, keys)) + 10) / 8)))


def grouped(batches: Iterator[pa.RecordBatch], group_bytes: int, column: str = "text") -> Iterator[tuple[int, pa.Table]]:
    """A partition's rows cut into row groups: each ends with the row whose value in column fills group_bytes. The number is the group's own among all partitions."""
    task = TaskContext.get()
    number, held, have = (task.partitionId() if task else 0) << 33, [], 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
        filled, start = have + np.cumsum(size), 0
        while start < len(filled):
            end = int(np.searchsorted(filled, group_bytes)) + 1
            if end > len(filled):
                break
            yield number, pa.Table.from_batches([*held, batch.slice(start, end - start)])
            number, held, filled, start = number + 1, [], filled - filled[end - 1], end
        if start < len(filled):
            held.append(batch.slice(start))
        have = int(filled[-1]) if len(filled) else have
    if held:
        yield number, pa.Table.from_batches(held)


def by_group(rows: DataFrame, group_bytes: int, f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """f over each row group of a scan (stable()), by the bytes of column, where it lies; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, table in grouped(batches, group_bytes, column):
            yield from f(g, table)

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame, group_bytes: int, column: str = "text") -> DataFrame:
    """(g, block): each row group of a scan as one compressed block, which shuffles in half the bytes of its rows."""

    def pack(g: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(table)
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["g", "block"])

    return by_group(rows, group_bytes, pack, "g long, block binary", column)


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of packed blocks."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("block").combine_chunks()]).combine_chunks()


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that over 1 / (4 * partitions) of the rows have: at most 4 * partitions of them."""
    many = 4 * partitions(rows)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") > max(1, rows.count() // many)).select(key).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema)


def lookup(rows: DataFrame, side: DataFrame, key: str, side_rows: int | None = None) -> DataFrame:
    """rows joined with side, which has one row for each key; both checkpointed or cheap, side narrow.

    A side of at most FEW_ROWS rows goes to all tasks. Of a larger one only the
    rows of the hot keys do, so that no key's rows are one task's alone.
    """
    if (side.count() if side_rows is None else side_rows) <= FEW_ROWS:
        return rows.join(F.broadcast(side), key)
    hot = hot_keys(rows, key)
    few = F.broadcast(side.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(side, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Rounds of: every node takes the smallest label of its neighbours, then the
    label of its label. Labels are one row for each node and are looked up by
    neighbour and by label, where a hot node or label is no task's alone;
    minima are partial aggregates. Stops when no label changes.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    n = labels.count()
    while n:
        near = lookup(both, labels.select(F.col("node").alias("b"), "root"), "b", n).groupBy("a").agg(F.min("root").alias("m"))
        took = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        if n > FEW_ROWS:
            took = checkpoint(took)
        new = lookup(took, took.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", n)
        new = checkpoint(new.select("node", "was", F.col("next").alias("root")))
        forget(labels)
        if n > FEW_ROWS:
            forget(took)
        labels = new.select("node", "root")
        if new.where("root != was").isEmpty():
            break
    forget(both)
    return labels
