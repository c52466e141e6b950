"""WARC archives: what is written, what is read back, and what a failed job leaves."""

import gzip
import hashlib
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from staveflow.llm import warc
from staveflow.sources.committed import MANIFEST, filesystem, manifest

SCHEMA = "page_id long, url string, html string"


def some_pages():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    same, other = text(1500), text(999)
    rows = [(i, f"http://a.example/{i}", text(rng.choice([0, 5, 900, 1000, 4000]))) for i in range(60)]
    rows += [(100 + i, "http://b.example/ü x\r\ny", same) for i in range(50)] + [(200 + i, None, other) for i in range(9)]
    rows += [(300, "u", None), (301, "u", ""), (None, "n", same), (None, "n", text(1200)), (400, "big", text(300_000)), (400, "big", text(1100))]
    return rows + [(500, "again", "again" * 300)] * 5 + [(None, None, "none" * 300)] * 3


def expected(rows):
    """(page_id, bytes, sha1, type, refers_to), sorted."""
    groups, out = {}, []
    for i, (_, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append(i)
    for html, members in groups.items():
        data = html.encode()
        best = max(members, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
        for i in members:
            again = len(data) >= 1000 and i != best
            out.append((rows[i][0], len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", rows[best][0] if again else None))
    return sorted(out, key=str)


def read_back(spark, path):
    got = warc.archived(spark, path).where("type != 'warcinfo'").collect()
    return got, sorted(((r.key, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got), key=str)


def test_round_trip(spark, tmp_path):
    rows = some_pages()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    warc.write(frame, str(tmp_path / "a"), shard_bytes=40_000, roll_bytes=6_000)
    got, digest = read_back(spark, str(tmp_path / "a"))
    assert digest == expected(rows)
    payloads = sorted((r.key or -1, bytes(r.payload)) for r in got if r.type == "response")
    assert set(payloads) <= {(k or -1, (h or "").encode()) for k, _, h in rows} and len(payloads) == sum(x[3] == "response" for x in expected(rows))
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got)
    for r in got:
        assert r.refers_to_id is None or (ids[r.refers_to_id].payload_digest == r.payload_digest and ids[r.refers_to_id].key == r.refers_to)
    assert {r.url for r in got if r.key and 100 <= r.key < 150} == {"http://b.example/%C3%BC%20x%0D%0Ay"} and {r.url for r in got if r.key and 200 <= r.key < 209} == {None}
    files = manifest(str(tmp_path / "a"))
    assert len({f["file"].split("-")[1] for f in files}) > 3 and any(f["file"].endswith("-0001.warc.gz") for f in files)
    for f in files:
        data = (tmp_path / "a" / f["file"]).read_bytes()
        assert len(data) == f["bytes"] and hashlib.sha256(data).hexdigest() == f["sha256"]
        plain = gzip.decompress(data)
        assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"\r\nWARC-Record-ID: ") == f["records"] + 1
    # files follow each other in order of keys
    keys = [r.key for r in sorted(got, key=lambda r: (r.file, r.offset))]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    frame = spark.createDataFrame(some_pages(), SCHEMA)
    for name, many in (("a", 1), ("b", 7)):
        warc.write(frame.repartition(many), str(tmp_path / name), shard_bytes=50_000, roll_bytes=9_000)
    assert (tmp_path / "a" / MANIFEST).read_bytes() == (tmp_path / "b" / MANIFEST).read_bytes()


def test_one_payload_and_one_key_everywhere(spark, tmp_path, monkeypatch):
    """A third of the rows and more with one payload, and all with one key: shards stay even, hot digests are looked up."""
    from staveflow.llm import frames

    monkeypatch.setattr(frames, "FEW_ROWS", 1)
    rows = [(1, f"u{i}", "x" * 2000 if i % 2 else f"{i}" * 600) for i in range(300)]
    warc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), shard_bytes=50_000, roll_bytes=1 << 20)
    assert read_back(spark, str(tmp_path / "a"))[1] == expected(rows)
    per = [f["records"] for f in manifest(str(tmp_path / "a"))]
    assert len(per) > 8 and max(per) < 50


def test_empty_table_other_columns_and_names(spark, tmp_path):
    frame = spark.createDataFrame([(7, "u", "h", 1, 2)], "ident long, link string, body string, digest int, shard int")
    warc.write(frame.limit(0), str(tmp_path / "none"), key="ident", url="link", payload="body")
    assert manifest(str(tmp_path / "none")) == [] and warc.archived(spark, str(tmp_path / "none")).collect() == []
    warc.write(frame, str(tmp_path / "one"), key="ident", url="link", payload="body")
    assert read_back(spark, str(tmp_path / "one"))[1] == [(7, 1, hashlib.sha1(b"h").hexdigest(), "response", None)]


def test_failed_job_leaves_nothing_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "a")
    good = spark.createDataFrame([(i, "u", "h" * i) for i in range(50)], SCHEMA)
    warc.write(good, path, shard_bytes=8000)
    before = (tmp_path / "a" / MANIFEST).read_bytes()
    spark.dataSource.register(warc.WarcSource)
    bad = good.select(F.lit(9).alias("shard"), F.lit(1).alias("kind"), F.col("page_id").alias("rid"), F.col("page_id").alias("key"), "url", F.expr("if(page_id = 49, cast(raise_error('lost') as binary), cast(html as binary))").alias("payload"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("refers_null"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("warc").mode("append").option("roll_bytes", 100).option("min_bytes", 10).save(path)
    assert (tmp_path / "a" / MANIFEST).read_bytes() == before and len(read_back(spark, path)[0]) == 50
    with pytest.raises(Exception, match="already"):
        warc.write(good, path, shard_bytes=8000)
    warc.write(good.where("page_id < 3"), path, mode="overwrite")
    assert len(read_back(spark, path)[0]) == 3 and len(list((tmp_path / "a").glob("*.gz"))) == len(manifest(path)) == 1
    with pytest.raises(FileNotFoundError):
        manifest(str(tmp_path / "nothing"))


@pytest.mark.parametrize("change", ["payload", "length", "cut"])
def test_reader_checks(spark, tmp_path, change):
    warc.write(spark.createDataFrame([(1, "u", "payload here")], SCHEMA), str(tmp_path / "a"))
    file = tmp_path / "a" / manifest(str(tmp_path / "a"))[0]["file"]
    data = file.read_bytes()
    parts = [r for _, _, r in warc.members(pafs.LocalFileSystem().open_input_stream(str(file), compression=None))]
    if change == "cut":
        file.write_bytes(data[:-5])
    else:
        old, new = (b"payload here", b"payload hare") if change == "payload" else (b"\r\nContent-Length: 9", b"\r\nContent-Length: 8")
        assert old in parts[1]
        file.write_bytes(gzip.compress(parts[0], mtime=0) + gzip.compress(parts[1].replace(old, new), mtime=0))
    with pytest.raises(Exception):
        warc.archived(spark, str(tmp_path / "a")).collect()


def test_paths():
    for uri in ("/a/b c%20?#", "file:/a/b c%20?#", "file:///a/b c%20?#/"):
        assert filesystem(uri)[1] == "/a/b c%20?#"
