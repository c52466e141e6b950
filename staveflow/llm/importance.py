"""Importance resampling: draws the documents whose word runs look most like those of a target corpus.

Features are all runs of 1 to n consecutive words, hashed by CRC-32 into a
fixed number of buckets. A bucket's gain is the log ratio of its smoothed shares
in target and corpus, in whole thousandths. A document's weight is the sum of
its features' gains; a Gumbel number from a hash of its id is added, and of the
documents that are long enough a share with the highest scores is drawn, which
is sampling without replacement in proportion to exp(weight).

Overlap chunking: a text of over CHUNK_BYTES is cut at word borders. A chunk
owns the words that start in its stretch of bytes and carries the n - 1 words
that follow, so each run is counted once, by the chunk that owns its first
word. Chunks of long texts are dealt out anew, so that a few huge documents
don't hold up a task, and their counts and weights are summed by document.

The bucket counts (a fixed number of them) are the only thing that goes through
the driver. Ranks come from a range sort and counts by partition.

Null and empty texts have no features, weight 0 and count as no document that
can be drawn; rows that repeat are documents of their own; of equal scores the
smaller id goes first, null ids last (a null id is hashed as an empty one). An
empty table gives no rows; an empty target has no features, which only shifts
all gains. Columns of docs with the names of the results are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from . import text as tx
from .frames import checkpoint, fresh, partitions, read, stable

# Longest run, buckets, least words of a document that can be drawn, share drawn (of hundredths), seed.
MAX_RUN, BUCKETS, MIN_WORDS, DRAWN, SEED = 1, 10_000, 20, 10, 2024
#: A text of more bytes is cut into chunks of so many.
CHUNK_BYTES = 32 << 10
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def _onward(state: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states (before the last inversion) carried on over the bytes of a word each."""
    state, size = state.copy(), end - start
    at = np.flatnonzero(size <= LONG_WORD)
    for i in range(int(size[at].max(initial=0))):
        at = at[size[at] > i]
        old = state[at]
        state[at] = _CRC[(old ^ low[start[at] + i]) & 0xFF] ^ (old >> 8)
    for i in np.flatnonzero(size > LONG_WORD):
        state[i] = zlib.crc32(low[start[i] : end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(raw: np.ndarray, off: np.ndarray, own: np.ndarray | None, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words that each text owns, text of each feature, bucket of each feature); own: how many of its first words a text owns, -1 for all."""
    doc, start, end, low = tx.spans(raw, off, tx.WORD_BYTE)
    n = len(off) - 1
    have = np.bincount(doc, minlength=n)
    mine = have if own is None else np.where(own < 0, have, own)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have)
    first = np.flatnonzero(place < mine[doc])
    state, who, found = np.full(len(first), 0xFFFFFFFF, np.uint32), [], []
    for run in range(max_run):
        word = first + run
        fits = word < len(doc)
        fits[fits] = doc[word[fits]] == doc[first[fits]]
        first, state, word = first[fits], state[fits], word[fits]
        if run:
            state = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        state = _onward(state, low, start[word], end[word])
        who.append(doc[first])
        found.append((state ^ 0xFFFFFFFF).astype(np.int64) % buckets)
    return mine, np.concatenate(who), np.concatenate(found)


def _cut(max_run: int, size: int):
    """Rows (rid, text) to chunks (rid, part, text, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.frombuffer(text.as_buffer(), np.uint8)
                _, start, end, _ = tx.spans(whole, np.array([0, len(whole)]), tx.WORD_BYTE)
                edge = np.searchsorted(start, np.arange(0, len(whole) + size, size))  # words before each border
                for k in np.flatnonzero(edge[1:] > edge[:-1]):
                    a, b = edge[k], edge[k + 1]
                    last = min(b + max_run - 1, len(start)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([k]), pa.array([whole[start[a] : end[last]].tobytes().decode()]), pa.array([b - a])], ["rid", "part", "text", "own"])

    return run


def chunked(docs: DataFrame, max_run: int = MAX_RUN, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(rid, text, own) of docs (rid, text): texts of up to chunk_bytes where they lie, with own -1; of longer ones their chunks, dealt out evenly, with the words that each owns."""
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    parts = docs.where(long).select("rid", "text").mapInArrow(_cut(max_run, chunk_bytes), "rid long, part long, text string, own long")
    parts = parts.repartition(partitions(docs), "rid", "part").select("rid", "text", "own")
    return docs.where(~long).select("rid", "text", F.lit(-1).cast("long").alias("own")).unionByName(parts)


def _each(batches: Iterator[pa.RecordBatch], max_run: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, off = tx.text_bytes(batch.column(1))
        own = batch.column(2).to_numpy()
        for a, b, part, cuts in tx.chunks(raw, off):
            yield batch, a, b, *features(part, cuts, own[a:b], max_run, buckets)


def bucket_counts(pieces: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all pieces fall into each bucket: one partial row a bucket and task, and `buckets` numbers in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for *_, found in _each(batches, max_run, buckets):
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in pieces.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in target and corpus, in doubles."""
    s, t, m = float(have.sum()), float(want.sum()), float(len(have))
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + m) / ((float(x) + 1) * (t + m)))) for x, y in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weighed(pieces: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN) -> DataFrame:
    """(rid, n_words, n_features, weight), summed over the chunks of a document."""
    buckets, sent = len(gain), pieces.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, words, who, found in _each(batches, max_run, buckets):
            n = np.bincount(who, minlength=b - a)
            weight = np.bincount(who, sent.value[found], minlength=b - a).astype(np.int64)  # whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["rid", "n_words", "n_features", "weight"])

    rows = pieces.mapInArrow(run, "rid long, n_words long, n_features long, weight long")
    return rows.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def ranked(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, drawn: int = DRAWN, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(rid, doc_id, n_features, weight, score, rank) of docs (rid, doc_id, text), a stable scan. rank is 1, 2, 3 and on for the rows drawn: of those with min_words words `drawn` hundredths, rounded down."""
    pieces = chunked(docs, max_run, chunk_bytes)
    goal = chunked(target.select(F.lit(0).cast("long").alias("rid"), "text"), max_run, chunk_bytes)
    gain = gains(bucket_counts(pieces, max_run, buckets), bucket_counts(goal, max_run, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # documents without a chunk have no word
    out = docs.select("rid", "doc_id").join(weighed(pieces, gain, max_run), "rid", "left").fillna(0, ["n_words", "n_features", "weight"])
    out = checkpoint(out.withColumn("score", F.col("weight") + luck))
    fit = out.where(F.col("n_words") >= min_words)
    many = fit.count() * drawn // 100
    placed = numbered(fit, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("rid")], "rank")
    rank = F.when(F.col("rank") < many, F.col("rank") + 1)
    cols = ["rid", "doc_id", "n_features", "weight", "score"]
    return placed.select(*cols, rank.alias("rank")).unionByName(out.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns and n_features, weight, score and rank."""
    docs = stable(docs.drop("n_features", "weight", "score", "rank"))
    rid = fresh(docs, "rid")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    found = ranked(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), target, **how).where("rank is not null")
    return rows.join(found.select(F.col("rid").alias(rid), "n_features", "weight", "score", "rank"), rid).drop(rid)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    return ranked(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH ct AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT r, unnest(w) AS word FROM d),
words AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM u UNION ALL SELECT word FROM b)),
bytes AS (SELECT word, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1:2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2:2 * i + 2]) - 1) AS y FROM words),
crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, y), lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM bytes, ct),
s AS (SELECT bucket, count(*) AS n FROM u JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN crc USING (word) GROUP BY 1),
tot AS (SELECT CAST((SELECT count(*) FROM u) AS DOUBLE) AS s, CAST((SELECT count(*) FROM b) AS DOUBLE) AS t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (tot.s + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (tot.t + 10000)))) AS BIGINT) AS gain FROM tot, s LEFT JOIN t ON t.bucket = s.bucket),
wt AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM u JOIN crc USING (word) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN wt ON wt.r = d.r),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) FROM rk) * 10 // 100 THEN k END AS rank FROM sc LEFT JOIN rk ON rk.r = sc.r
"""
