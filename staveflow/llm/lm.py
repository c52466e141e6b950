"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training documents are gathered over the
whole corpus by block exchange. A pair seen c times, MIN_COUNT at least, enters
the filter with each level 1 .. 1 + floor(log2 c), and a pair's count is read
back by probing level after level until one is absent, as two to the number of
levels less one: never over the true count but for the filter's rare false hits.

The probability of a word after another mixes both counts:
P(w | h) = k * min(1, s / c(h)) + (1 - k) * (c(w) + 0.5) / (N + 0.5 (V + 1)),
k = MIX * c(h) / (c(h) + HALF), where s is 2^(levels - 1), but for pairs seen
once, at one level, what Good and Turing say that such a pair is worth: twice
the number of pairs seen twice over that of pairs seen once (LEAST_ONCE at
least, 1 at most). It sums to 1 at most over the words, but for the filter's
rare false hits. Nothing is broadcast: each row group, of training or not, gets back the counts of its own words and
the levels of its own pairs.

The filter has one segment for each hash range of pairs, of BITS bits an entry
at every size of the corpus. A segment is built and probed where its range is,
so it grows no more than a range does. Classes of words and pairs are by 64-bit
and 48-bit hashes.

Null texts are empty and score their end token; long ones are scored whole. A
null doc_id counts as the empty text in the choice of training rows, and a null
in the column that chooses them leaves a row out of training. Rows that repeat
are learned from and scored each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import by_group, checkpoint, laid_out, pack48, packed, range_of, read, split_by_range, stable, unpack48, unpacked

MIN_COUNT, BITS, PROBES = 1, 12, 3
MIX, HALF, LEAST_ONCE = 0.5, 8.0, 0.25
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, token before) of texts, an end token after each text."""
    docs, toks = [], []
    for a, b, part, cuts in tx.chunks(raw, off):
        doc, h, _ = tx.words(part, cuts, tx.NOT_SPACE)
        at = tx.bounds(doc, b - a)
        docs.append(a + np.insert(doc.astype(np.int64), at[1:], np.arange(b - a)))
        toks.append(np.insert(h, at[1:], END))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, tx.U64), np.zeros(0, tx.U64)
    doc, tok = np.concatenate(docs), np.concatenate(toks)
    before = np.roll(tok, 1)
    before[np.append(True, doc[1:] != doc[:-1])] = BEGIN
    return doc, tok, before


def pair_keys(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """48-bit keys, in the upper bits."""
    return tx.mix(before * tx.U64(tx._ROOT) + tok) & ~tx.U64(0xFFFF)


class Filter:
    """Segments of bits by hash range."""

    def __init__(self, segments: list[bytes]):
        self.start = np.append(0, np.cumsum([8 * len(s) for s in segments])).astype(np.int64)
        self.bits = np.frombuffer(b"".join(segments), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
        salt = ((2 * level + 1) * 0x632BE59BD9B4E019 + probe * 0xD1B54A32D192ED03) % (1 << 64)
        return (tx.mix(keys + tx.U64(salt)) % size.astype(tx.U64)).astype(np.int64)

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray, limit: int | None = None) -> bytes:
        n = max(64, -(-BITS * int(levels.sum()) // 64) * 64)
        n = n if limit is None else min(limit, n)
        bits = np.zeros(n, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            k = keys[levels >= level]
            for probe in range(PROBES):
                bits[cls.places(k, level, probe, np.array([n]))] = True
        return np.packbits(bits).tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each key are present, from the first without a gap."""
        out, now = np.zeros(len(keys), np.int64), np.arange(len(keys))
        r = range_of(keys, len(self.start) - 1)
        start, size = self.start[r], self.start[r + 1] - self.start[r]
        level = 1
        while len(now) and level < 64:
            for probe in range(PROBES):
                at = start[now] + self.places(keys[now], level, probe, size[now])
                now = now[(self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
            out[now] = level
            level += 1
        return out


def levels_of(seen: np.ndarray) -> np.ndarray:
    """The levels of pairs by how often they were seen."""
    return 1 + np.floor(np.log2(seen)).astype(np.int64)


def _gathered(rows: DataFrame, group_bytes: int, ranges: int) -> DataFrame:
    """(g, b, counts, levels): word counts and levels of pairs for group g in range b; and with g = -1 one row a range with its V, N, and pairs seen once and twice."""

    def keys_of(g: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, tok, before = tokens(*tx.text_bytes(table.column("text")))
        use = table.column("train").to_numpy()[doc]
        words, inverse = np.unique(tok, return_inverse=True)
        times = np.bincount(inverse, use, minlength=len(words)).astype("<u4")
        pairs, inverse = np.unique(pair_keys(before, tok), return_inverse=True)
        pair_times = np.bincount(inverse, use, minlength=len(pairs)).astype("<u4")
        few, more = np.minimum(pair_times, 255).astype(np.uint8), np.flatnonzero(pair_times > 255)
        b1, cut1 = split_by_range(words, ranges)
        b2, cut2 = split_by_range(pairs, ranges)
        where = np.searchsorted(more, cut2)
        out: dict[int, list[bytes | None]] = {int(x): [None] * 6 for x in [*b1, *b2]}
        for x, i, j in zip(b1, cut1[:-1], cut1[1:], strict=True):
            out[int(x)][:2] = [words[i:j].astype("<u8").tobytes(), times[i:j].tobytes()]
        for x, i, j, m, n in zip(b2, cut2[:-1], cut2[1:], where[:-1], where[1:], strict=True):
            out[int(x)][2:] = [pack48(pairs[i:j]), few[i:j].tobytes(), (more[m:n] - i).astype("<u4").tobytes(), pair_times[more[m:n]].tobytes()]
        cols = list(zip(*out.values(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([g] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["b", "g", "words", "times", "pairs", "few", "at", "n"])

    def count(table: pa.Table) -> pa.Table:
        has = table.filter(table.column("words").is_valid())
        blocks = [np.frombuffer(x, "<u8") for x in has.column("words").to_pylist()]
        words, inverse = np.unique(np.concatenate(blocks), return_inverse=True) if blocks else (np.zeros(0, tx.U64), np.zeros(0, np.int64))
        times = np.frombuffer(b"".join(has.column("times").to_pylist()), "<u4")
        total = np.bincount(inverse, times, minlength=len(words)).astype("<u8")
        cut, back = np.append(0, np.cumsum([len(x) for x in blocks])).astype(int), total[inverse]
        counts = dict(zip(has.column("g").to_pylist(), [back[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        two = table.filter(table.column("pairs").is_valid())
        keys = [unpack48(x) for x in two.column("pairs").to_pylist()]
        weight, start = np.frombuffer(b"".join(two.column("few").to_pylist()), np.uint8).astype(np.uint32), 0
        for k, at, n in zip(keys, two.column("at").to_pylist(), two.column("n").to_pylist(), strict=True):
            weight[start + np.frombuffer(at, "<u4").astype(np.int64)] = np.frombuffer(n, "<u4")
            start += len(k)
        pairs, inverse = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, tx.U64), np.zeros(0, np.int64))
        seen = np.bincount(inverse, weight, minlength=len(pairs))
        keep = seen >= MIN_COUNT
        back = Filter([Filter.segment(pairs[keep], levels_of(seen[keep]))]).levels(pairs).astype(np.uint8)[inverse]
        cut = np.append(0, np.cumsum([len(k) for k in keys])).astype(int)
        levels = dict(zip(two.column("g").to_pylist(), [back[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        to = sorted({*counts, *levels})
        none = [0] * len(to)
        columns = [pa.array([*to, -1], pa.int64()), pa.array([table.column("b")[0].as_py()] * (len(to) + 1), pa.int32()), *(pa.array([*map(x.get, to), None], pa.binary()) for x in (counts, levels)), pa.array([*none, int((total > 0).sum())], pa.int64()), pa.array([*none, int(total.sum())], pa.int64()), *(pa.array([*none, int((seen == k).sum())], pa.int64()) for k in (1, 2))]
        return pa.table(columns, ["g", "b", "counts", "levels", "v", "n", "once", "twice"])

    blocks = by_group(rows.select("text", "train"), group_bytes, keys_of, "b int, g long, words binary, times binary, pairs binary, few binary, at binary, n binary")
    return blocks.groupBy("b").applyInArrow(count, "g long, b int, counts binary, levels binary, v long, n long, once long, twice long")


def scored(docs: DataFrame, train: str = "train") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text and the boolean column `train`)."""
    rows = stable(docs).select("doc_id", "text", F.coalesce(F.col(train), F.lit(False)).alias("train"))
    group_bytes, ranges, _ = laid_out(rows)
    got = checkpoint(_gathered(rows, group_bytes, ranges))
    v, n, once, twice = (x or 0 for x in got.where("g = -1").agg(F.sum("v"), F.sum("n"), F.sum("once"), F.sum("twice")).first())
    worth = min(1.0, max(LEAST_ONCE, 2 * twice / max(1, once)))

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpacked(docs)
        doc, tok, before = tokens(*tx.text_bytes(docs.column("text")))
        words, inverse = np.unique(tok, return_inverse=True)
        answers = answers.sort_by("b")
        count = np.frombuffer(b"".join(answers.column("counts").drop_null().to_pylist()), "<u8").astype(np.float64)
        c = count[inverse]
        uni = (c + 0.5) / (n + 0.5 * (v + 1))
        start = before == BEGIN
        c_before = np.roll(c, 1)
        c_before[start] = count[np.searchsorted(words, END)]
        of = np.unique(pair_keys(before, tok), return_inverse=True)[1]
        levels = np.frombuffer(b"".join(answers.column("levels").drop_null().to_pylist()), np.uint8)[of]
        seen = np.where(levels > 1, np.exp2(levels - 1.0), np.where(levels > 0, worth, 0.0))
        k = MIX * c_before / (c_before + HALF)
        p = k * np.minimum(1.0, seen / np.maximum(c_before, 1.0)) + (1 - k) * uni
        m = docs.num_rows
        sums = {"n_tokens": np.bincount(doc, minlength=m), "n_known": np.bincount(doc, c > 0, minlength=m).astype(np.int64), "base_score": np.bincount(doc, np.log10(uni), minlength=m), "score": np.bincount(doc, np.log10(p), minlength=m)}
        return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "train": docs.column("train"), "n_tokens": pa.array(sums["n_tokens"], pa.int64()), "n_known": pa.array(sums["n_known"], pa.int64()), "train_tokens": pa.array(np.full(m, n), pa.int64()), "base_score": pa.array(sums["base_score"]), "score": pa.array(sums["score"])})

    dealt = packed(rows, group_bytes).repartition(ranges, "g")
    answers = got.where("g >= 0").select("g", "b", "counts", "levels")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(crc, F.lit(5)) != 1).alias("train"))
    return scored(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
