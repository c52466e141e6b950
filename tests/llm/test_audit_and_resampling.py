"""Source divergence and importance resampling against plain statements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveflow.llm import divergence, importance

SCHEMA = "doc_id long, text string, lang string, source string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_audit(rows, min_docs, added=5, scale=10**9, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        within = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in within.items() if n >= min_docs}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
        everything = sum(count.values(), Counter())
        p = lambda c, w: 1 + scale * (c[w] + added) // (sum(c.values()) + added * len(kept))
        for s, c in count.items():
            pairs = [(sum(abs(p(c, w) - p(o, w)) for w in kept), t) for t, o in count.items() if t != s]
            terms = [(p(c, w) - p(everything, w), w) for w in kept if c[w] and p(c, w) > p(everything, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def audit(frame, **how):
    return sorted(tuple(r) for r in divergence.audit(frame, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def made_docs(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "ÉCOLE", "école", "x1y", "don't", "snake_case", "日本", "z", "Ω"] + [f"w{chr(97 + i)}" for i in range(25)]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "a", "b", "c", None, ""])
        lang = rng.choice(["en", "en", "en", "de", None])
        text = rng.choice([None, "", "123 !?"]) if rng.random() < 0.1 else " ".join(rng.choices(words, [1 + (hash_of(source, w) % 7) for w in words], k=rng.randint(1, 40)))
        rows.append((i, text, lang, source))
    return rows


def hash_of(source, word):
    return zlib.crc32(f"{source}/{word}".encode())


@pytest.mark.parametrize(("min_docs", "top"), [(1, 50), (12, 3), (10**6, 50)])
def test_divergence(spark, min_docs, top):
    rows = made_docs(260) + [(900, "only here", "xx", "lone"), (901, None, "yy", "p"), (902, "", "yy", "q")] + [(903, "twice twice", "en", "a")] * 3
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    assert audit(frame, min_docs=min_docs, top=top) == plain_audit(rows, min_docs, top=top)


def test_divergence_of_nothing_and_of_one_word(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert audit(frame) == []
    rows = [(i, "w " * (1 + i % 4), "en", f"s{i % 3}") for i in range(60)] + [(99, "long " * 40_000, "en", "s0")]
    assert audit(spark.createDataFrame(rows, SCHEMA), min_docs=1) == plain_audit(rows, 1)


def test_divergence_in_small_blocks(spark, monkeypatch):
    """Row groups, pairs and batches cut anywhere, groups looked up by hot keys."""
    from staveflow.llm import frames

    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(frames, "FEW_ROWS", 2)
    rows = made_docs(150, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert audit(spark.createDataFrame(rows, SCHEMA), min_docs=2) == plain_audit(rows, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_row_a_pair_of_postings(spark):
    """A task keeps a sum a pair of groups: more terms don't make more rows."""
    import pyarrow as pa

    def rows_out(terms):
        one = [("en", f"t{t:05d}", g, 10 * g + t, 3) for t in range(terms) for g in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*one, strict=True)], ["lang", "term", "gid", "p", "z"])
        return sum(b.num_rows for b in divergence._overlaps(iter([batch])))

    assert rows_out(5) == rows_out(500) == 15


def plain_resampling(docs, target, max_run=1, buckets=10_000, min_words=20, drawn=10, seed=2024):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]

    mine = [found(text) for _, text in docs]
    have, want = Counter(b for _, f in mine for b in f), Counter(b for t in target for b in found(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1.0) * (s + float(buckets)) / ((have[b] + 1.0) * (t + float(buckets)))))
    out = []
    for (i, _), (n, f) in zip(docs, mine, strict=True):
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * drawn // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(spark, docs, target, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.monotonically_increasing_id().alias("rid"))
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in importance.ranked(frame, goal, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def made_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "naïve", "ÉTÉ", "été", "42", "x", "日本語", "a" * 70, "b" * 300] + [f"word{i}" for i in range(60)]
    return [(i, None if i % 19 == 0 else "" if i % 23 == 0 else rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([1, 5, 19, 20, 21, 80])))) for i in range(n)]


@pytest.mark.parametrize(("max_run", "chunk_bytes"), [(1, 1 << 15), (1, 40), (3, 60), (2, 7), (4, 1000)])
def test_resampling(spark, max_run, chunk_bytes):
    docs = made_texts(220) + [(500, "z9 " * 3000)] + [(600, "tie " * 30)] * 4 + [(None, "null id " * 15), (None, "null id " * 15)]
    target = [t for _, t in made_texts(30, 8)] + [None, ""]
    got = resampled(spark, docs, target, max_run=max_run, chunk_bytes=chunk_bytes, buckets=500, drawn=35)
    assert got == plain_resampling(docs, target, max_run, 500, drawn=35)


def test_resampling_of_nothing(spark):
    assert resampled(spark, [], ["a b"]) == []
    docs = made_texts(40)
    assert resampled(spark, docs, []) == plain_resampling(docs, [])


def test_crc_of_words():
    rng = random.Random(2)
    words = ["", "a", "é" * 40, "long" * 50, *["".join(rng.choices("abcXYZ09ü", k=rng.randint(1, 90))) for _ in range(300)]]
    low = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    start = end - [len(w.encode()) for w in words]
    got = importance._onward(np.full(len(words), 0xFFFFFFFF, np.uint32), low, start, end) ^ 0xFFFFFFFF
    assert got.tolist() == [zlib.crc32(w.encode()) for w in words]


def test_long_texts_are_dealt_in_chunks(spark):
    """A chunk holds about chunk_bytes and what it carries; every word has one owner."""
    text = " ".join(f"w{i}" for i in range(20_000))
    frame = spark.createDataFrame([(0, text), (1, "short one")], "rid long, text string")
    got = importance.chunked(frame, 3, 1000).collect()
    long = [r for r in got if r.rid == 0]
    assert len(long) > 100 and max(len(r.text) for r in long) < 1100 and sum(r.own for r in long) == 20_000
    assert [(r.text, r.own) for r in got if r.rid == 1] == [("short one", -1)]


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, f"x{i % 3} " * 30, i * 1.5, "w") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, rid double, weight string")
    got = importance.resampled(frame, frame.where("doc_id % 3 = 0").select("text"), drawn=20)
    assert got.columns == ["doc_id", "text", "rid", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert sorted(r.rank for r in rows) == list(range(1, 11)) and all(r.rid == r.doc_id * 1.5 for r in rows)
