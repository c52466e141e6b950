"""Benchmark decontamination by winnowing.

The smallest hash of the k-grams in each sliding window of a text is its
fingerprint. A window of T words has T-k+1 k-grams, so two equal windows of T
words always share a fingerprint: the fingerprints of a document are joined
with those of the benchmark, and each hit is extended to the whole windows
around it, whose words are then compared byte by byte. Items of fewer than T
words are one window of their own length, looked up by its hash.

A benchmark of up to BLOCK_BYTES of text is one index that all tasks get. Of a
larger one they get a table of bits by fingerprint, of a fixed size: it tells
which windows of the documents may be in the benchmark. Those windows alone go
to a join with the windows of the benchmark, by their words, so the documents
are read once and never shuffled, and no more than the bits passes the driver.
A full table of bits lets more windows through, and changes no result.

Nulls have no words. Benchmark rows with a null id or without words are left
out; rows that repeat an id count as one item. Documents that repeat are judged
each; a very long text is a chunk of its own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import checkpoint, fresh, read, stable

T_WORDS, K_WORDS = 10, 6
#: Bound of the benchmark text in a broadcast index; bits of the table that tells which windows of documents a larger one may hold (8 MB), and parts it is gathered in.
BLOCK_BYTES = 8 << 20
TABLE_BITS, TABLE_PARTS = 26, 64
_BITS = 18


class Index:
    """Windows and fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, str]], t: int = T_WORDS, k: int = K_WORDS):
        self.t, self.k, self.names = t, k, [i for i, _ in items]
        self.raw, off = tx.text_bytes(pa.array([x for _, x in items], pa.large_string()))
        doc, h, self.start = tx.words(self.raw, off, tx.WORD_BYTE)
        self.end, self.low = tx.word_ends(self.raw, off, tx.WORD_BYTE), tx.LOWER[self.raw]
        at = tx.bounds(doc, len(items))
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if length := min(b - a, t):
                g = tx.grams(h[a:b], int(length))
                found.setdefault(int(length), []).append((g, np.full(len(g), i), np.arange(a, a + len(g))))
        #: by length: window hashes, items by window (offsets and values), a place of each window
        self.windows, self.fingerprints, self.bits = {}, np.zeros(0, tx.U64), {}
        for length, parts in found.items():
            g, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, g))
            g, item, place = g[order], item[order], place[order]
            new = np.append(True, g[1:] != g[:-1])
            keep = new | np.append(True, item[1:] != item[:-1])
            self.windows[length] = (g[new], np.append(np.cumsum(keep)[new] - 1, keep.sum()), item[keep], place[new])
            probe = g[new]
            if length == t:
                low = tx.grams(h, k)
                probe = self.fingerprints = np.unique(np.lib.stride_tricks.sliding_window_view(low, t - k + 1).min(axis=1)[place])
            table = np.zeros(1 << _BITS, bool)
            table[(probe >> tx.U64(64 - _BITS)).astype(np.int64)] = True
            self.bits[length] = table

    def candidates(self, h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the benchmark window) where hashes of windows agree."""
        n = len(h) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if length == self.t:
            low = tx.sliding_min(tx.grams(h, self.k), length - self.k + 1)
            head = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            fp = low[head]
            hit = np.flatnonzero(self.bits[length][(fp >> tx.U64(64 - _BITS)).astype(np.int64)])
            hit = hit[_in(self.fingerprints, fp[hit])[0]]
            if not len(hit):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            size = np.append(head[1:], n)[hit] - head[hit]
            s = np.repeat(head[hit] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            g = h[s]
            for i in range(1, length):
                g = g * tx.U64(tx._ROOT) + h[s + i]
            g = tx.mix(g)
        else:
            g = tx.grams(h, length)
            s = np.flatnonzero(self.bits[length][(g >> tx.U64(64 - _BITS)).astype(np.int64)])
            g = g[s]
        inside = doc[s] == doc[s + length - 1]
        s, g = s[inside], g[inside]
        ok, at = _in(self.windows[length][0], g)
        return s[ok], at[ok]

    def hits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[str], list[tuple[int, int]]]]]:
        """Words of each document, and by document the items and the spans of words hit."""
        doc, h, start = tx.words(raw, off, tx.WORD_BYTE)
        n_docs = len(off) - 1
        at, out, end = tx.bounds(doc, n_docs), {}, None
        seen: dict[int, tuple[list[np.ndarray], list[tuple[int, int]]]] = {}
        for length, (_, split, item, place) in self.windows.items():
            s, w = self.candidates(h, doc, length)
            if not len(s):
                continue
            if end is None:
                end, low = tx.word_ends(raw, off, tx.WORD_BYTE), tx.LOWER[raw]
            same = self._same(low, start, end, s, place[w], length)
            for a, b in zip(s[same], w[same], strict=True):
                items, spans = seen.setdefault(int(doc[a]), ([], []))
                items.append(item[split[b] : split[b + 1]])
                spans.append((int(a - at[doc[a]]), int(a - at[doc[a]]) + length))
        for d, (items, spans) in seen.items():
            out[d] = sorted({self.names[i] for i in np.unique(np.concatenate(items))}), merged(spans)
        return np.diff(at), out

    def _same(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
        """Whether the bytes of the words from a on are those of the benchmark's words from p on, for each pair."""
        i, j = ((x[:, None] + np.arange(length)).ravel() for x in (a, p))
        n = end[i] - start[i]
        ok = n == self.end[j] - self.start[j]
        x, y, n = start[i[ok]], self.start[j[ok]], n[ok]
        if len(n):
            ok[ok] = np.logical_and.reduceat(low[tx.spread(x, n)] == self.low[tx.spread(y, n)], np.cumsum(n) - n)
        return ok.reshape(-1, length).all(1)


def _in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which x are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def _small(items: DataFrame) -> Index | None:
    """The index of a benchmark that one broadcast may hold."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return Index([(r[0], r[1]) for r in items.collect()]) if total <= BLOCK_BYTES else None


def _probes(h: np.ndarray, length: int, t: int, k: int, bits: int) -> np.ndarray:
    """What each run of `length` words is looked up by in the table of bits: the fingerprint of a whole window, the hash of a shorter one."""
    if len(h) < length:
        return np.zeros(0, tx.U64)
    found = tx.sliding_min(tx.grams(h, k), length - k + 1) if length == t else tx.grams(h, length)
    return tx.mix(found + tx.U64(length)) >> tx.U64(64 - bits)


def _window_words(low: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, length: int) -> str:
    return " ".join(low[a:b].tobytes().decode() for a, b in zip(start[at : at + length], end[at : at + length], strict=True))


def _benchmark_windows(items: DataFrame, t: int) -> DataFrame:
    """(item, length, w): the windows of items, as lower-cased words with blanks between, once each."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (raw, off) = batch.column(0).to_pylist(), tx.text_bytes(batch.column(1))
            for x, y, part, cuts in tx.chunks(raw, off):
                doc, _, start = tx.words(part, cuts, tx.WORD_BYTE)
                end, low, at = tx.word_ends(part, cuts, tx.WORD_BYTE), tx.LOWER[part], tx.bounds(doc, y - x)
                out = [(ids[x + d], min(b - a, t), _window_words(low, start, end, i, min(b - a, t))) for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a for i in range(a, b - min(b - a, t) + 1)]
                yield pa.RecordBatch.from_pylist([{"item": i, "length": n, "w": w} for i, n, w in out], pa.schema([("item", pa.string()), ("length", pa.int32()), ("w", pa.string())]))

    return items.mapInArrow(windows, "item string, length int, w string").distinct()


def _table(items: DataFrame, t: int, k: int) -> tuple[np.ndarray, list[int]]:
    """The table of bits of the benchmark's windows, and the lengths of windows that occur (t at most)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = np.zeros(1 << TABLE_BITS, bool), set()
        for batch in batches:
            raw, off = tx.text_bytes(batch.column(0))
            for x, y, part, cuts in tx.chunks(raw, off):
                doc, h, _ = tx.words(part, cuts, tx.WORD_BYTE)
                at = tx.bounds(doc, y - x)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    if length := min(int(b - a), t):
                        lengths.add(length)
                        table[_probes(h[a:b], length, t, k, TABLE_BITS).astype(np.int64)] = True
        parts = np.packbits(table).reshape(TABLE_PARTS, -1)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary()), pa.array([sorted(lengths)] * len(some), pa.list_(pa.int32()))], ["part", "bits", "lengths"])

    def join(table: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        lengths = sorted({n for x in table.column("lengths").to_pylist() for n in x})
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([held.tobytes()], pa.binary()), "lengths": pa.array([lengths], pa.list_(pa.int32()))})

    schema = "part int, bits binary, lengths array<int>"
    packed, lengths = np.zeros((TABLE_PARTS, (1 << TABLE_BITS) // 8 // TABLE_PARTS), np.uint8), set()
    for r in items.select("text").mapInArrow(bits, schema).groupBy("part").applyInArrow(join, schema).collect():
        packed[r[0]] = np.frombuffer(r[1], np.uint8)
        lengths |= set(r[2])
    return packed.ravel(), sorted(lengths)


def _candidates(rows: DataFrame, key: str, items: DataFrame, t: int, k: int) -> DataFrame:
    """(key, n_words, start, length, w): one row for each document with its words, and one for each of its windows that the table of bits lets through."""
    sent = rows.sparkSession.sparkContext.broadcast(_table(items, t, k))
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("w", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = sent.value
        for batch in batches:
            ids, (raw, off) = batch.column(0).to_pylist(), tx.text_bytes(batch.column(1))
            for x, y, part, cuts in tx.chunks(raw, off):
                doc, h, start = tx.words(part, cuts, tx.WORD_BYTE)
                at = tx.bounds(doc, y - x)
                end, low = tx.word_ends(part, cuts, tx.WORD_BYTE), tx.LOWER[part]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x:y], pa.int64()), pa.array(np.diff(at), pa.int64()), *(pa.nulls(y - x, f.type) for f in list(schema)[2:])], schema=schema)
                for length in lengths:
                    probe = _probes(h, length, t, k, TABLE_BITS).astype(np.int64)
                    s = np.flatnonzero(table[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8) & 1)
                    s = s[doc[s] == doc[s + length - 1]]
                    for i in range(0, len(s), 4096):
                        some = s[i : i + 4096]
                        d = doc[some]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[x + j] for j in d], pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some - at[d], pa.int64()), pa.array(np.full(len(some), length), pa.int32()), pa.array([_window_words(low, start, end, j, length) for j in some.tolist()], pa.string())], schema=schema)

    return rows.select(key, "text").mapInArrow(find, "key long, n_words long, start long, length int, w string")


def _joined(rows: DataFrame, key: str, items: DataFrame, t: int, k: int) -> DataFrame:
    """(key, n_words, items, spans) for each row, by a join of windows."""
    windows = checkpoint(_benchmark_windows(items, t))
    found = checkpoint(_candidates(rows, key, items, t, k))
    maybe = found.where("start is not null").select("key", "start", "length", "w")
    hit = maybe.join(windows.select("length", "w").distinct(), ["length", "w"], "left_semi")
    spans = hit.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    names = maybe.select("key", "length", "w").distinct().join(windows, ["length", "w"]).select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start: long, end: long>>")
    words = found.where("n_words is not null").select("key", "n_words")
    return words.join(names, "key", "left").join(spans, "key", "left").select("key", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce(_merged("spans"), none[1]).alias("spans"))


def _merged(spans: str):
    """Sorted spans joined where they touch."""
    start = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    return F.aggregate(spans, start, lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), grown(acc, s)).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def contamination(docs: DataFrame, benchmark: DataFrame, t: int = T_WORDS, k: int = K_WORDS) -> DataFrame:
    """All columns of docs with n_words, items (sorted ids), spans (of words, start and end) and n_hit.

    The columns of docs come first; names of theirs that clash with these are kept and ours replace them.
    """
    docs, ours = stable(docs), ("n_words", "items", "spans", "n_hit")
    rid, keep = fresh(docs, "rid"), [c for c in docs.columns if c.lower() not in ours]
    rows = docs.select(*keep).withColumn(rid, F.monotonically_increasing_id())
    items = _items(benchmark)
    found = _scanned(rows, rid, _small(items), items, t, k)
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return rows.join(found.withColumnRenamed("key", rid), rid).select(*keep, *ours)


def _scanned(rows: DataFrame, key: str, index: Index | None, items: DataFrame, t: int, k: int) -> DataFrame:
    """(key, n_words, items, spans) for each row."""
    if index is None:
        return _joined(rows, key, items, t, k)
    if (t, k) != (index.t, index.k):
        index = Index([(r[0], r[1]) for r in items.collect()], t, k)
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.text_bytes(batch.column(1))
            words, items, spans = [], [], []
            for a, b, part, cuts in tx.chunks(raw, off):
                n, hit = sent.value.hits(part, cuts)
                words.append(n)
                for d in range(b - a):
                    i, s = hit.get(d, ((), ()))
                    items.append(i)
                    spans.append([{"start": x, "end": y} for x, y in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["key", "n_words", "items", "spans"])

    return rows.select(key, "text").mapInArrow(find, "key long, n_words long, items array<string>, spans array<struct<start: long, end: long>>")


def scored(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() for doc_id alone, without the join: the digest needs no other column of docs."""
    docs, items = docs.select("doc_id", "text"), _items(benchmark)
    index = _small(items)
    if index is None:
        return contamination(docs, benchmark).drop("text")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tx.text_bytes(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            n_hit, items = np.zeros(batch.num_rows, np.int64), [()] * batch.num_rows
            for a, b, part, cuts in tx.chunks(raw, off):
                n[a:b], hit = sent.value.hits(part, cuts)
                for d, (ids, spans) in hit.items():
                    n_hit[a + d], items[a + d] = sum(y - x for x, y in spans), ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return docs.mapInArrow(find, "doc_id long, n_words long, n_hit long, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    items, name = _items(benchmark), fresh(docs, "hit")
    index = _small(items)
    if index is None:
        docs = stable(docs)
        rows = docs.withColumn(name, F.monotonically_increasing_id())
        hit = _joined(rows, name, items, T_WORDS, K_WORDS).where(F.size("spans") > 0).select(F.col("key").alias(name))
        return rows.join(hit, name, "left_anti").drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def contaminated(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            raw, off = tx.text_bytes(pa.array(t, pa.large_string(), from_pandas=True))
            out = np.zeros(len(t), bool)
            for a, _, part, cuts in tx.chunks(raw, off):
                for d in sent.value.hits(part, cuts)[1]:
                    out[a + d] = True
            yield pd.Series(out)

    return docs.withColumn(name, contaminated("text")).where(~F.col(name)).drop(name)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest([list_aggregate(w[p:p + least(len(w), 10) - 1], 'string_agg', ' ') for p in range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, ns WHERE len(w) >= n),
dg AS (SELECT doc_id, n, p, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS g FROM dw),
h AS (SELECT dg.doc_id, dg.p, dg.n, iw.item FROM dg JOIN iw ON dg.n = iw.n AND dg.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
