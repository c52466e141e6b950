"""Pages and detections as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .. import rounds


def page_stream(spark: SparkSession, path: str, glob: str = "*.{pgm,PGM,png,PNG}", per_trigger: int = 100) -> DataFrame:
    """(path, name, content) of image files as they arrive."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def json_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def each_batch(rows: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Analyses each micro-batch and writes it under its own batch folder, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_pages(rows: DataFrame, store: str, checkpoint: str, by: str = "doc", keys: tuple[str, ...] = ("doc", "page")) -> StreamingQuery:
    """Keeps a store of the latest version of each page: the rows of a page in a batch take the place of all that it had before.

    The store is one folder for each value of `by`, and a batch rewrites those
    folders that it touches and no others (dynamic partition overwrite). A batch
    that is run again finds its own pages there, puts the same ones in their
    place, and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.persist()
        try:
            held = spark.read.schema(batch.schema).parquet(store) if _exists(spark, store) else new.limit(0)
            touched = held.join(new.select(by).distinct(), by, "left_semi").join(new.select(*keys).distinct(), list(keys), "left_anti")
            # what is read is written to: so the kept rows are cut from the store first
            whole = rounds.checkpoint(touched.select(*new.columns).unionByName(new))
            whole.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(store)
        finally:
            new.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


CARRIED = "doc string, page int, measure_number int, signature string"


class _Carrier(StatefulProcessor):
    """One document: the page whose turn it is, the signature in force, and the pages that came before their turn."""

    def __init__(self, default: str, first: int, patience_ms: int | None) -> None:
        self.default, self.first, self.patience = default, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "page int, signature string")
        self.waiting = handle.getMapState("waiting", "page int", "measures array<struct<number: int, sig: string>>")

    def _played(self, doc: str, page: int, measures: list, now: str, out: list) -> str:
        for number, sig in measures:
            now = sig or now
            out.append((doc, page, number, now))
        return now

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[int, list] = {}
        for part in rows:
            for page, number, sig in zip(part["page"], part["measure_number"], part["sig"], strict=True):
                came.setdefault(int(page), []).append((int(number), sig if isinstance(sig, str) and sig else None))
        turn, now = self.turn.get() if self.turn.exists() else (self.first, self.default)
        out: list[tuple] = []
        for page in sorted(came):
            measures = sorted(came[page], key=lambda m: (m[0], m[1] or ""))
            if page < turn:  # its turn was given up: it takes the signature that is in force now, and changes nothing
                self._played(key[0], page, measures, now, out)
            elif page == turn:
                now = self._played(key[0], page, measures, now, out)
                turn += 1
                while self.waiting.containsKey((turn,)):
                    now = self._played(key[0], turn, [tuple(m) for m in self.waiting.getValue((turn,))[0]], now, out)
                    self.waiting.removeKey((turn,))
                    turn += 1
            else:
                self.waiting.updateValue((page,), ([tuple(m) for m in measures],))
        self.turn.update((turn, now))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if any(True for _ in self.waiting.keys()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield pd.DataFrame(out, columns=["doc", "page", "measure_number", "signature"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A missing page has been waited for long enough: what waits is played in order."""
        _, now = self.turn.get()
        out: list[tuple] = []
        held = sorted((k[0], [tuple(m) for m in v[0]]) for k, v in self.waiting.iterator())
        for page, measures in held:
            now = self._played(key[0], page, measures, now, out)
            self.waiting.removeKey((page,))
            self.turn.update((page + 1, now))
        yield pd.DataFrame(out, columns=["doc", "page", "measure_number", "signature"])

    def close(self) -> None:
        pass


def carried_signatures(rows: DataFrame, default: str = "4/4", first: int = 1, patience_ms: int | None = None) -> DataFrame:
    """(doc, page, measure_number, signature) of a stream (doc, page, measure_number, sig): the last signature seen in a document, in order of pages and measures, whatever order its pages come in.

    A page comes whole, in one batch. One that comes before its turn waits in
    the document's state; pages follow each other from `first` on. With
    patience_ms, pages that have waited so long for a missing one are played
    without it; that takes a processing-time trigger, as timers have batches of
    their own. Needs the state store that keeps maps and timers (RocksDB),
    which is set here for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    wanted = rows.select("doc", "page", "measure_number", "sig")
    return wanted.groupBy("doc").transformWithStateInPandas(_Carrier(default, first, patience_ms), CARRIED, "Append", "None" if patience_ms is None else "ProcessingTime")
