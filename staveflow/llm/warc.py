"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Writing takes pages (a key, a url, a payload) and goes by these steps:

- Digests and sizes of payloads, a narrow table. Of equal payloads of min_bytes
  or more the record with the largest key is the response; the others are
  revisits that refer to it (of equal keys one is the response).
- A range sort of the narrow table by key, with running sums of bytes over the
  partitions, cuts shards of even size: where a shard begins is a function of
  the rows, not of Spark's partitions. The shards' first rows (one for each
  shard_bytes of payload) are all that the driver holds.
- Pages and decisions meet in their shard, one partition a shard, in order.
- A task writes records as gzip members of their own and begins a new file
  where the compressed size reaches roll_bytes. Lengths, digests, record ids
  and file names are made anew from the rows, never copied, and hold nothing of
  the clock, so a rerun makes the same bytes.
- Files get their names and the manifest its lines when all tasks are done
  (sources.committed).

The reader takes the files of the manifest, checks sizes, lengths and digests,
and raises where one doesn't fit.

Null payloads are empty; null keys come last and are no largest key unless
all are null; rows that repeat are records of their own, in one run of shards
that a row number cuts; payloads of any size are one record. A null url has a
fixed stand-in; bytes that a header can't hold are percent-encoded. An empty
table makes no files and an empty manifest. Other columns are not written.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.numbering import numbered
from ..rounds import new_folder
from ..sources.committed import CommittedWriter, filesystem, manifest
from .frames import checkpoint, lookup, read, stable

# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL, DATE = "urn:x-no-url", "1970-01-01T00:00:00Z"
MIN_BYTES = 1000
#: Bytes that a record counts besides its payload; least and most bytes of a shard, which grows with the root of the input between them.
RECORD_BYTES, LEAST_SHARD, MOST_SHARD, ROOT = 512, 4 << 20, 1 << 30, 1 << 20
READ_SCHEMA = "file string, offset long, type string, record_id string, url string, date string, key long, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
BATCH_BYTES = 8 << 20


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member; the length and digest of the block are added here."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time in the header
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


class WarcWriter(CommittedWriter):
    """Rows sorted by shard and key: a decision (kind 0) right before its record (kind 1)."""

    def __init__(self, uri: str, overwrite: bool, roll_bytes: int, min_bytes: int) -> None:
        super().__init__(uri, overwrite)
        self.roll_bytes, self.min_bytes = roll_bytes, min_bytes

    def files(self, batches, new):
        out, shard, number, revisit = None, None, 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "rid", "key", "url", "payload", "refers_to", "refers_null")), strict=True):
                if row[1] == 0:
                    revisit = row
                    continue
                if row[0] != shard:
                    shard, number, place = row[0], 0, 0
                    if out:
                        yield out.done(records=records)
                    out = None
                if out and out.bytes >= self.roll_bytes:
                    yield out.done(records=records)
                    out, number = None, number + 1
                if out is None:
                    out, records = new(f"shard-{shard:06d}-{number:04d}.warc.gz"), 0
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("warcinfo", out.name)), ("WARC-Date", DATE), ("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(self._record(row, place, revisit if revisit and revisit[2] == row[2] else None))
                place, records, revisit = place + 1, records + 1, None
        if out:
            yield out.done(records=records)

    def _record(self, row: tuple, place: int, revisit: tuple | None) -> bytes:
        shard, _, _, key, url, payload, _, _ = row
        payload = payload or b""
        digest = hashlib.sha1(payload).digest()
        # large payloads have one response, which revisits can name by its digest
        ident = ("response", digest.hex(), len(payload)) if revisit is None and len(payload) >= self.min_bytes else (shard, place, digest.hex())
        target = NO_URL if url is None else quote(url, safe="".join(chr(c) for c in range(33, 127)))
        headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(*ident)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _base32(digest))]
        if key is not None:
            headers.append(("X-Record-Key", key))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        if revisit is None:
            return _member(headers, http + payload)
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn("response", digest.hex(), len(payload)))]
        if not revisit[7]:
            headers.append(("X-Refers-To-Key", revisit[6]))
        return _member(headers, http)


@dataclass
class _File(InputPartition):
    name: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, uri: str, payload: bool) -> None:
        self.uri, self.payload = uri, payload

    def partitions(self) -> list[_File]:
        return [_File(x["file"], x["bytes"]) for x in manifest(self.uri)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # so Spark asks where there are no files
            return
        fs, path = filesystem(self.uri)
        names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        with fs.open_input_stream(f"{path}/{partition.name}", compression=None) as stream:
            rows, held, end = [], 0, 0
            for offset, end, record in members(stream):
                row = parsed(record, self.payload)
                rows.append((partition.name, offset, *row))
                held += len(row[-1] or b"") + RECORD_BYTES
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if end != partition.size:
                raise ValueError(f"{partition.name} has {end} bytes, not {partition.size}")
            if rows:
                yield batch(rows)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, content) of each gzip member of a file."""
    held, at = b"", 0
    while True:
        gz, out, began = zlib.decompressobj(31), [], at
        while not gz.eof:
            data = held or stream.read(1 << 20)
            held = b""
            if not data:
                if at == began:
                    return
                raise ValueError("the file ends within a record")
            out.append(gz.decompress(data))
            held = gz.unused_data
            at += len(data) - len(held)
        yield began, at, b"".join(out)


def parsed(record: bytes, payload: bool = True) -> tuple:
    """A record's fields in the order of READ_SCHEMA, from `type` on; what its headers say is checked against its bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    said = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(said["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(said["Content-Length"]):
        raise ValueError(f"a record's length is not the one it states: {said.get('WARC-Record-ID')}")
    if _base32(hashlib.sha1(block).digest()) != said["WARC-Block-Digest"]:
        raise ValueError(f"a block's digest is not the one it states: {said['WARC-Record-ID']}")
    size, digest, body = None, None, None
    if said["WARC-Type"] in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = base64.b32decode(said["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if said["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
            raise ValueError(f"a payload is not the one its record states: {said['WARC-Record-ID']}")
        body = body if payload and said["WARC-Type"] == "response" else None
    number = lambda c: int(said[c]) if c in said else None
    url = said.get("WARC-Target-URI")
    return said["WARC-Type"], said["WARC-Record-ID"], None if url == NO_URL else url, said["WARC-Date"], number("X-Record-Key"), number("X-Refers-To-Key"), said.get("WARC-Refers-To"), size, digest, body


class WarcSource(DataSource):
    """Format "warc". Options: path; writing: roll_bytes, min_bytes; reading: payload (false leaves the payloads where they are)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options["roll_bytes"]), int(self.options["min_bytes"]))

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")


def shard_size(total: int) -> int:
    """Bytes of payload in a shard for so many in all."""
    return min(MOST_SHARD, max(LEAST_SHARD, math.isqrt(total * ROOT)))


def _shard_of(bounds: list[tuple]) -> Column:
    """The shard of a row (key, digest, rid), from the first rows of all shards in order."""
    keys = np.array([b[1] if not b[0] else 0 for b in bounds], np.int64)
    full = sum(not b[0] for b in bounds)  # shards that begin with a key

    @F.pandas_udf("int")
    def find(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for null, key, digest, rid in parts:
            key = key.to_numpy(np.int64)
            at = np.searchsorted(keys[:full], key, side="right") - 1
            # rows whose key is that of a border, or null, are told apart by digest and row
            near = null.to_numpy() | (np.searchsorted(keys[:full], key, side="left") <= at) | (at < 0)
            for i in np.flatnonzero(near):
                at[i] = bisect.bisect_right(bounds, (bool(null[i]), int(key[i]), digest[i], int(rid[i]))) - 1
            yield pd.Series(at.astype(np.int32))

    return find(F.col("key").isNull(), F.coalesce("key", F.lit(0)), F.col("digest"), F.col("rid"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", mode: str = "append", min_bytes: int = MIN_BYTES, shard_bytes: int | None = None, roll_bytes: int | None = None) -> None:
    """Writes pages as WARC files and a manifest below path."""
    spark = pages.sparkSession
    rows = stable(pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("digest", F.sha1("payload"))
    narrow = checkpoint(rows.select("key", "rid", "digest", F.octet_length("payload").cast("long").alias("size")))

    large = narrow.where(F.col("size") >= min_bytes).select("key", "rid", "digest")
    latest = F.max(F.struct("key", -F.col("rid")))
    top = large.groupBy("digest").agg(latest.alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    top = checkpoint(top.select("digest", F.col("top.key").alias("refers_to"), (-F.col("top.col2")).alias("first")))
    revisits = lookup(large, top, "digest").where("rid != first").select("key", "rid", "digest", "refers_to")

    total = int(narrow.agg(F.sum(F.col("size") + RECORD_BYTES)).first()[0] or 0)
    size = shard_bytes or shard_size(total)
    order = [F.col("key").asc_nulls_last(), F.col("digest"), F.col("rid")]
    summed = numbered(narrow.withColumn("size", F.col("size") + RECORD_BYTES), order, "before", size="size")
    first = F.min(F.struct(F.col("key").isNull(), F.coalesce("key", F.lit(0)), "digest", "rid"))
    bounds = sorted(tuple(r[0]) for r in summed.groupBy(F.expr(f"before div {size}")).agg(first.alias("first")).select("first").collect())

    shard = _shard_of(bounds)
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    records = rows.select(shard.alias("shard"), F.lit(1).alias("kind"), "rid", "key", "digest", "url", "payload", no("long", "refers_to"), F.lit(True).alias("refers_null"))
    decisions = revisits.select(shard.alias("shard"), F.lit(0).alias("kind"), "rid", "key", "digest", no("string", "url"), no("binary", "payload"), "refers_to", F.col("refers_to").isNull().alias("refers_null"))
    dealt = records.unionByName(decisions).repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", *order, "kind")
    spark.dataSource.register(WarcSource)
    dealt.write.format("warc").mode(mode).option("roll_bytes", roll_bytes or max(1, size // 4)).option("min_bytes", min_bytes).save(path)


def archived(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists, checked as they are read."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    out = archived(spark, path, payload=False).where(F.col("type").isin("response", "revisit"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM s
"""
