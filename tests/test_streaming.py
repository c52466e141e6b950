"""Streams: pages in any order, batches that are run again, pages that never come."""

import json
import random
import time

from staveflow.streaming import pages as streams

SCHEMA = "doc string, page int, measure_number int, sig string"


def fed(spark, folder, make, out, checkpoint, batches):
    """Files one at a time, each as batches of their own; the query is started anew for each."""
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(batches):
        (folder / f"{time.time_ns()}-{k}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "page", "measure_number", "sig"), r, strict=True))) for r in rows))
        stream = make(streams.json_stream(spark, str(folder), SCHEMA))
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).select("doc", "page", "measure_number", "signature").collect())


def carried(rows):
    out, now = [], {}
    for doc, page, number, sig in sorted(rows, key=lambda r: r[:3]):
        now[doc] = sig or now.get(doc, "4/4")
        out.append((doc, page, number, now[doc]))
    return out


def test_pages_in_any_order_give_one_result(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, p, m, rng.choice([None, None, "", "3/4", "6/8"])) for d in "ab" for p in range(1, 7) for m in range(1, 4)]
    each = [[r for r in rows if r[:2] == k] for k in sorted({r[:2] for r in rows})]
    for seed in (1, 2):
        random.Random(seed).shuffle(each)
        batches = [sum(each[i : i + 3], []) for i in range(0, len(each), 3)]
        for b in batches:
            rng.shuffle(b)
        at = tmp_path / str(seed)
        at.mkdir()
        assert fed(spark, at / "in", streams.carried_signatures, at / "out", at / "ck", batches) == carried(rows)


def test_a_page_before_its_turn_waits(spark, tmp_path):
    batches = [[("a", 3, 1, None)], [("a", 1, 1, "3/4")]]
    assert fed(spark, tmp_path / "in", streams.carried_signatures, tmp_path / "out", tmp_path / "ck", batches) == [("a", 1, 1, "3/4")]
    assert fed(spark, tmp_path / "in", streams.carried_signatures, tmp_path / "out", tmp_path / "ck", [[("a", 2, 1, "2/4")]]) == [("a", 1, 1, "3/4"), ("a", 2, 1, "2/4"), ("a", 3, 1, "2/4")]


def test_a_page_that_never_comes(spark, tmp_path):
    """Pages 2 and 3 are missing: after a while page 4 is played without them; page 2, when it comes late, takes what is in force."""
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, row: (folder / name).write_text(json.dumps(dict(zip(("doc", "page", "measure_number", "sig"), row, strict=True))))
    put("1.json", ("a", 1, 1, "3/4"))
    put("2.json", ("a", 4, 1, None))
    stream = streams.carried_signatures(streams.json_stream(spark, str(folder), SCHEMA), patience_ms=500)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:

        def wait_for(n):
            for _ in range(120):
                time.sleep(0.5)
                if (tmp_path / "out" / "_spark_metadata").exists():
                    got = sorted(tuple(r) for r in spark.read.schema(streams.CARRIED).parquet(str(tmp_path / "out")).collect())
                    if len(got) >= n:
                        return got
            raise AssertionError(query.exception() or "nothing came")

        assert wait_for(2) == [("a", 1, 1, "3/4"), ("a", 4, 1, "3/4")]
        put("3.json", ("a", 2, 1, None))
        assert wait_for(3) == [("a", 1, 1, "3/4"), ("a", 2, 1, "3/4"), ("a", 4, 1, "3/4")]
    finally:
        query.stop()


def test_store_of_pages(spark, tmp_path):
    """Later versions take the place of earlier ones; a batch that runs again changes nothing, folders that no batch touches stay as they are."""
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()

    def run(number, rows, checkpoint):
        (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "page", "measure_number", "sig"), r, strict=True))) for r in rows))
        streams.store_pages(streams.json_stream(spark, str(folder), SCHEMA), store, str(tmp_path / checkpoint)).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(store).select("doc", "page", "measure_number", "sig").collect())

    first = [("a", 1, 1, "x"), ("a", 1, 2, "x"), ("a", 2, 1, "x"), ("b", 1, 1, "x")]
    assert run(1, first, "ck") == first
    files = sorted(p.name for p in (tmp_path / "store" / "doc=b").iterdir())
    second = [("a", 1, 1, "y"), ("c", 1, 1, "y")]
    want = sorted([("a", 1, 1, "y"), ("a", 2, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "y")])
    assert run(2, second, "ck") == want and sorted(p.name for p in (tmp_path / "store" / "doc=b").iterdir()) == files
    (folder / "1.json").unlink()
    assert run(2, second, "another") == want  # the batch once more, as after a lost commit
