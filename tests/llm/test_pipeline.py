"""The stages of corpus_pipeline one by one and in a row, on a small corpus with all kinds of odd rows, against plain statements of what they do."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from staveflow.llm import mixing, shard, toxicity

from .test_documents import BASE, PASSAGE, low, spaced, targets
from .test_documents import components as groups_of
from .test_documents import rows as _rows  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "rid", "Shard", "k1", "toxicity"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, _rows):  # noqa: F811
    """(folder, documents): with repeated rows, null ids, null and empty texts, and columns named like the operators' own."""
    folder = str(tmp_path_factory.mktemp("sf"))
    again = [*_rows, *_rows[:3], (None, BASE + " more", "en", "s1"), (None, None, None, None), (999, "one two fool", "en", "s2")]
    docs = spark.createDataFrame(again, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({"rid": F.lit(1), "Shard": F.lit("x"), "k1": F.lit(2.5), "toxicity": F.lit(None).cast("int")})
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "one TWO"), (None, BASE), (4, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i * 3, 1, int(i % 2)) for i in range(22)] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def same(a, b):
    assert collections.Counter(map(str, a)) == collections.Counter(map(str, b))


def test_toxic_documents_go(spark, corpus):
    folder, docs = corpus
    out = STAGES["toxicity"](spark, docs, folder)
    assert out.columns == COLUMNS
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        words = [int(h) for h in _word_rows(text)]
        found = [max([0.0, *(sum(float(model.table[words[p + i]] @ model.filters[w][i][:, f]) for i in range(w)) for p in range(len(words) - w + 1))]) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        return 1 / (1 + np.exp(-(np.array(found) @ model.dense + float(model.bias))))

    kept = [r for r in docs.collect() if not score(r.text) >= model.thresholds.get(r.lang, model.thresholds[""])]
    same(out.collect(), kept)


def _word_rows(text):
    """Embedding rows of words, hash by hash."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)):
        yield mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(word.encode())) & mask) >> (64 - toxicity.DIM_BITS)


def test_one_of_each_group_stays(spark, corpus):
    folder, docs = corpus
    rows = docs.collect()
    sets = {}
    for k, r in enumerate(rows):
        w = spaced(r.text)
        n = min(5, len(w))
        sets[k] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()
    group = groups_of(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    least = {}
    for k, r in enumerate(rows):
        if sets[k]:
            least[group[k]] = min(least.get(group[k], (2, 0)), (r.doc_id is None, r.doc_id or 0))
    out = STAGES["ngram_jaccard"](spark, docs, folder)
    assert out.columns == COLUMNS
    want = [(r.doc_id, r.text) for k, r in enumerate(rows) if not sets[k]] + [(None if v[0] else v[1], "") for v in least.values()]
    got = [(r.doc_id, "" if spaced(r.text) else r.text) for r in out.collect()]
    same(got, want)


def test_contaminated_documents_go(spark, corpus):
    folder, docs = corpus
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for item in (PASSAGE, "one TWO"):
        w = word.findall(low(item))
        n = min(10, len(w))
        windows |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
    clean = lambda t: not any(tuple(w[p : p + n]) in windows for w in [word.findall(low(t))] for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
    out = STAGES["decontamination"](spark, docs, folder)
    assert out.columns == COLUMNS
    same(out.collect(), [r for r in docs.collect() if clean(r.text)])


def test_mix_takes_what_its_targets_say(spark, corpus):
    folder, docs = corpus
    rows, size = docs.collect(), collections.Counter()
    for r in rows:
        size[r.source] += len(spaced(r.text))
    out = STAGES["mixing"](spark, docs, folder)
    assert out.columns == COLUMNS
    got = out.collect()
    have, taken = collections.Counter(map(str, rows)), collections.Counter(map(str, got))
    assert all(taken[r] <= 2 * have[r] for r in taken) and set(taken) <= set(have)
    words = collections.Counter()
    for r in got:
        words[r.source] += len(spaced(r.text))
    longest = {s: max(len(spaced(r.text)) for r in rows if r.source == s) for s in size}
    assert all(abs(words[s] - t) <= longest[s] for s, t in targets(dict(size)).items())
    same(got, STAGES["mixing"](spark, docs.repartition(7), folder).collect())
    counts = mixing.copies(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert {r.doc_id: r.n for r in counts if r.n} == collections.Counter(r.doc_id for r in got)


def test_shards_hold_all_rows(spark, corpus):
    folder, docs = corpus
    out = STAGES["sharding"](spark, docs, folder)
    assert out.columns == [*(c for c in COLUMNS if c != "Shard"), "shard", "slot"]
    got = out.collect()
    same([tuple(r)[:-2] for r in got], [tuple(r) for r in docs.drop("Shard").collect()])
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes[s] for s in range(8)) - min(sizes[s] for s in range(8)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in range(8))


def test_empty_documents_go_through_all_stages(spark, corpus, tmp_path):
    folder, docs = corpus
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, folder)
        assert none.collect() == []


def test_run_is_its_stages_in_a_row(spark, corpus, tmp_path):
    folder, docs = corpus
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    got = corpus_pipeline.run(spark, folder)
    plain = [c for c in docs.columns if c not in ("shard", "slot")]
    same(got.select(plain).collect(), docs.select(plain).collect())


def test_digest_of_sharding(spark):
    """Sizes, checksums and law of the query, row by row."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = shard.op3_hypergeometric(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
