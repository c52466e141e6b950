"""A sink that writes one file a row under the row's own name: label files, page images, crops, documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .committed import CommittedWriter


class _Writer(CommittedWriter):
    pieces = False

    def files(self, batches: Iterator[pa.RecordBatch], new) -> Iterator[tuple[str, dict]]:
        out = None
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                at = name.as_py()
                if not at or at.startswith(("/", "_", ".")) or ".." in at.split("/"):
                    raise ValueError(f"not the name of a file to write: {at!r}")
                if out is not None and not (self.pieces and out.name == at):
                    yield out.done()
                    out = None
                out = out or new(at)
                out.write(content.as_py() or b"")
        if out is not None:
            yield out.done()


class NamedFiles(DataSource):
    """Format "named_files": rows (file, content) become files below path, all or none of them; a name comes once, or, with the option pieces, in rows one after the other. Modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        writer = _Writer(self.options["path"], overwrite)
        writer.pieces = self.options.get("pieces") == "true"
        return writer


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows (file, content), content as text or bytes; null is an empty file."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("file", F.col("content").cast("binary").alias("content")).write.format("named_files").mode(mode).save(path)


def write_pieces(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows (file, part, content): a file is its pieces in order of part, and is never a row itself; one task writes it piece by piece."""
    rows.sparkSession.dataSource.register(NamedFiles)
    ordered = rows.repartition("file").sortWithinPartitions("file", "part")
    ordered.select("file", F.col("content").cast("binary").alias("content")).write.format("named_files").option("pieces", "true").mode(mode).save(path)
