"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into DIM embedding rows; filters of several widths run over
the whole text, and the largest value of each filter (max pooling) goes through
a logistic layer. One embedding column starts as the words' log odds in all
labels, and one filter as that column; both are trained on with the rest. Rows
of words that no labelled text has stay zero.

All labelled texts are learned from, whole. They become arrays of embedding
rows, dealt by a hash of the id to shards of about SHARD_DOCS documents and at
most some SHARD_BYTES of text. Which documents have labels is found by their
ids; a table of 2^ID_BITS bits of these ids then lets the texts through that
move to their shards, once (a full table lets more move, and changes nothing).
Each of ROUNDS rounds sends the model out, every shard trains its own copy, and
what the shards changed is averaged: a word's row over the shards that moved
it, in whole numbers, so that the order of the sums doesn't matter. Only one
model at a time, of at most 2^DIM_BITS rows, goes through the driver. A caller
may ask for a sample of labels instead (max_per_class: those with the smallest
hash of their id, texts of at most MAX_BYTES), which the driver trains on; no
query does.

Thresholds are calibrated by language on cross-fitted scores: each labelled
document is scored by a model that hasn't seen it. The cut of each language has
the best F1 of the cuts between bins of log odds (BINS to a unit), and is drawn
towards that of all languages by as much as SHRINK documents weigh, so that a
language with few labels leans on the others. Labels, language, source and id
are no inputs of a score. Who needs scores alone leaves the thresholds out
(cuts=False): the model is the same, and those of the folds are not trained.

Null and empty texts get the score of no word at all; long ones are scored
whole. Labels with null, of documents that don't exist, or of one class only:
the model scores the share of label 1, and the cut is 0.5. Ids with several
labels are toxic if one of them says so; of rows that repeat an id one is
learned from, and all are judged. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import checkpoint, forget, fresh, read

MAX_BYTES = 1 << 20
SHARD_DOCS, SHARD_BYTES, BATCH_WORDS = 1024, 64 << 20, 1 << 20
ROUNDS, EPOCHS, BINS = 2, 4, 64
FOLDS, SHRINK = 3, 20
DIM_BITS, EMBED, FILTERS, WIDTHS = 20, 8, 4, (1, 2, 3)
ID_BITS = 25


def word_rows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, embedding row of each word) of texts."""
    doc, h, _ = tx.words(raw, off, tx.WORD_BYTE)
    return tx.bounds(doc, len(off) - 1), (h >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def held_out(doc_id: str = "doc_id", of: int = 5):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))


class Rows:
    """The rows of an embedding table that aren't zero, to be read like the whole table."""

    def __init__(self, known: np.ndarray, values: np.ndarray):
        self.place = np.zeros(1 << DIM_BITS, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.values = np.vstack([np.zeros((1, values.shape[1]), values.dtype), values])

    @classmethod
    def of(cls, table: np.ndarray) -> Rows:
        known = np.flatnonzero(table.any(axis=1))
        return cls(known, table[known])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.values[self.place[rows]]


class Model:
    """Embedding table, filters by width, logistic layer."""

    def __init__(self, seed: int = 5, table: np.ndarray | Rows | None = None):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 << DIM_BITS, EMBED), np.float32) if table is None else table
        self.filters = {w: rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias, self.seed, self.thresholds = np.float32(np.log(0.001 / 0.999)), seed, {}

    def pooled(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(documents x filters) largest filter values, 0 at least, and the first word of each (-1: none)."""
        n, out, place = len(at) - 1, [], []
        e = self.table[rows]
        for w in WIDTHS:
            f = self.filters[w]
            m = len(rows) - w + 1
            best, where = np.zeros((n, FILTERS), np.float32), np.full((n, FILTERS), -1)
            if m > 0:
                z = e[:m] @ f[0]
                for i in range(1, w):
                    z += e[i : m + i] @ f[i]
                ok = np.flatnonzero(at[1:] - at[:-1] >= w)
                if len(ok):
                    cut = np.empty(2 * len(ok), np.int64)
                    cut[0::2], cut[1::2] = at[ok], at[ok + 1] - w + 1
                    z = np.vstack([z, np.full((1, FILTERS), -np.inf, np.float32)])
                    top = np.maximum.reduceat(z, cut)[0::2]
                    best[ok] = np.maximum(top, 0)
                    if self.training:
                        for d, a, b, t in zip(ok, cut[0::2], cut[1::2], top, strict=True):
                            where[d] = np.where(t > 0, a + z[a:b].argmax(0), -1)
            out.append(best)
            place.append(where)
        return np.hstack(out), place

    training = False

    def log_odds(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.pooled(at, rows)[0].astype(np.float64) @ self.dense.astype(np.float64) + float(self.bias), -40, 40)

    def score(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(at, rows)))

    @property
    def layers(self) -> np.ndarray:
        """Logistic layer, bias and filters as one array."""
        return np.concatenate([self.dense, [self.bias], *[self.filters[w].ravel() for w in WIDTHS]]).astype(np.float32)

    @layers.setter
    def layers(self, flat: np.ndarray) -> None:
        n = len(self.dense)
        self.dense, self.bias, n = flat[:n].astype(np.float32), np.float32(flat[n]), n + 1
        for w in WIDTHS:
            size = w * EMBED * FILTERS
            self.filters[w], n = flat[n : n + size].astype(np.float32).reshape(w, EMBED, FILTERS), n + size

    def begin(self, share: float) -> None:
        """The bias of a share of label 1, and one filter that reads the log odds."""
        self.filters[1][0, :, 0] = 0
        self.filters[1][0, 0, 0] = 1
        self.dense[0], self.bias = 2.0, np.float32(prior_odds(share) - 2.0)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02) -> None:
        share = float(y.mean()) if len(y) else 0.0
        self.bias = np.float32(prior_odds(share))
        if len(y) < 2 or y.min() == y.max():
            self.dense[:] = 0
            return
        rng = np.random.default_rng(self.seed)
        seen = [np.unique(d) for d in docs]
        pos = np.bincount(np.concatenate([s for s, t in zip(seen, y, strict=True) if t] or [[]]).astype(np.int64), minlength=1 << DIM_BITS)
        neg = np.bincount(np.concatenate([s for s, t in zip(seen, y, strict=True) if not t] or [[]]).astype(np.int64), minlength=1 << DIM_BITS)
        known = np.flatnonzero(pos + neg)
        self.table[known] = rng.normal(0, 0.02, (len(known), EMBED))
        odds = np.log((pos[known] + 0.5) / (y.sum() + 1)) - np.log((neg[known] + 0.5) / (len(y) - y.sum() + 1))
        # words of a few documents say little: their odds are shrunk
        self.table[known, 0] = odds * (pos + neg)[known] / ((pos + neg)[known] + 12)
        self.begin(share)
        self.descend(docs, y, epochs, batch, rate, rng)

    def descend(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, batch: int, rate: float, rng: np.random.Generator, toxic_weight: float = 1.0) -> None:
        """Batches of so many documents, or fewer where they have BATCH_WORDS; toxic documents count toxic_weight times."""
        params = [self.dense, *self.filters.values()]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        adagrad, step, self.training = np.full(len(self.table), 1e-4, np.float32), 0, True
        length = np.array([len(d) for d in docs], np.int64)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            end = 0
            while end < len(order):
                pick = order[end : end + batch]
                pick = pick[: max(1, int(np.searchsorted(np.cumsum(length[pick]), BATCH_WORDS, side="right")))]
                end += len(pick)
                rows = np.concatenate([docs[d] for d in pick])
                at = np.append(0, np.cumsum([len(docs[d]) for d in pick]))
                pool, place = self.pooled(at, rows)
                p = 1 / (1 + np.exp(-np.clip(pool @ self.dense + self.bias, -30, 30)))
                g = ((p - y[pick]) * np.where(y[pick] > 0, toxic_weight, 1) / len(pick)).astype(np.float32)
                grads = [pool.T @ g + 1e-4 * self.dense]
                up = g[:, None] * self.dense[None, :]
                touched, pull = [], []
                for j, w in enumerate(WIDTHS):
                    u, where, f = up[:, j * FILTERS : (j + 1) * FILTERS], place[j], self.filters[w]
                    gf = np.zeros_like(f)
                    d, k = np.nonzero(where >= 0)
                    for o in range(w):
                        r = rows[where[d, k] + o]
                        np.add.at(gf[o].T, k, u[d, k, None] * self.table[r])
                        touched.append(r)
                        pull.append(u[d, k, None] * f[o][:, k].T)
                    grads.append(gf)
                step += 1
                for p_, g_, a, b in zip(params, grads, m1, m2, strict=True):
                    a += 0.1 * (g_ - a)
                    b += 0.001 * (g_ * g_ - b)
                    p_ -= rate * 0.25 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                self.bias -= np.float32(rate * g.sum() * 5)
                if touched:
                    r, gr = np.concatenate(touched), np.concatenate(pull)
                    ids, inverse = np.unique(r, return_inverse=True)
                    total = np.zeros((len(ids), EMBED), np.float32)
                    np.add.at(total, inverse, gr)
                    adagrad[ids] += (total**2).sum(1)
                    self.table[ids] -= rate * total / np.sqrt(adagrad[ids])[:, None]
        self.training = False

    def learn(self, docs: list[np.ndarray], y: np.ndarray, use: np.ndarray, share: float) -> Model:
        """fit() on some of the sample, which has as many of both classes as it can; then the bias moves to the share of label 1 in all labels."""
        self.fit([docs[i] for i in use], y[use])
        was = y[use].mean() if len(use) else 0.5
        if 0 < share < 1 and 0 < was < 1:
            self.bias += np.float32(0.5 * (np.log(share / (1 - share)) - np.log(was / (1 - was))))
        return self


def prior_odds(share: float) -> float:
    prior = min(max(share, 0.001), 0.999)
    return math.log(prior / (1 - prior))


def threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float, n: np.ndarray | float = 1.0) -> float:
    """The middle of the range of cuts whose weighted F1 is within one document of the best, drawn towards base. A score stands for n documents, y of them toxic.

    Cuts lie in the middle between neighbouring scores. Between the toxic and
    the other documents lies a wide gap with few of either, where the very best
    cut is chance.
    """
    n = np.broadcast_to(n, y.shape)
    few = min(y.sum(), (n - y).sum())
    if not few:
        return base
    order = np.argsort(-score, kind="stable")
    s, t, w = score[order], y[order], weight[order]
    f1 = 2 * np.cumsum(t * w) / (np.cumsum(n[order] * w) + (y * weight).sum())
    cuts = np.append((s[:-1] + s[1:]) / 2, s[-1])[f1 >= f1.max() - 1 / few]
    return float((few * (cuts.min() + cuts.max()) / 2 + SHRINK * base) / (few + SHRINK))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the labels that are not held out, one row for each id."""
    return labels.where("doc_id is not null and toxic is not null").where(held_out() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def language(docs: DataFrame):
    return F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as an array of embedding rows."""
    for b in batches:
        parts = [word_rows(part, cuts) for _, _, part, cuts in tx.chunks(*tx.text_bytes(b.column(b.num_columns - 1)))]
        rows = [r[x:y].astype("<i4").tobytes() for at, r in parts for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.binary())], [*b.schema.names[:-1], "rows"])


def sampled(docs: DataFrame, labels: DataFrame, max_per_class: int, seed: int = 5) -> Model:
    """train() on at most so many labelled documents of each class."""
    rows = learnable(labels)
    pick = [rows.where(c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_per_class) for c in ("toxic = 1", "toxic <> 1")]
    chosen = {r[0]: int(r[1] == 1) for p in pick for r in p.collect()}
    total = {r[0]: r[1] for r in rows.groupBy((F.col("toxic") == 1).cast("int")).count().collect()}
    model = Model(seed)
    if chosen:
        # at most 2 * max_per_class ids
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")

        found = docs.select("doc_id", "text", language(docs).alias("lang")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES).join(F.broadcast(ids), "doc_id")
        one = found.groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("d")).select("doc_id", "d.lang", "d.text")
        got = sorted(one.mapInArrow(_arrays, "doc_id long, lang string, rows binary").collect(), key=lambda r: r[0])
        x, y = [np.frombuffer(r[2], "<i4").astype(np.int64) for r in got], np.array([chosen[r[0]] for r in got], np.float64)
        fold, score = np.array([hash_mod(r[0], FOLDS) for r in got], np.int64), np.zeros(len(got))
        share = total.get(1, 0) / max(1, sum(total.values()))
        for f in range(FOLDS):
            part = Model(seed).learn(x, y, np.flatnonzero(fold != f), share)
            for i in np.flatnonzero(fold == f):
                score[i] = part.score(np.array([0, len(x[i])]), x[i])[0]
        model.learn(x, y, np.arange(len(x)), share)
        weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
        base = threshold(score, y, weight, 0.5)
        langs = np.array([r[1] or "" for r in got])
        model.thresholds = {"": base} | {name: threshold(score[langs == name], y[langs == name], weight[langs == name], base) for name in sorted(set(langs.tolist()) - {""})}
    model.thresholds.setdefault("", 0.5)
    return model


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(shard, toxic, fold, arrays) for each shard of a partition that is sorted by shard."""
    held, now = [], -1

    def taken():
        t = pa.Table.from_batches(held)
        ids, y = t.column("doc_id").to_numpy(), t.column("toxic").to_numpy().astype(np.float64)
        return now, y, fold_of(ids), [np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in t.column("rows").combine_chunks()]

    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for x, y in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            if shard[x] != now and held:
                yield taken()
                held = []
            now = int(shard[x])
            held.append(b.slice(x, y - x))
    if held:
        yield taken()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n): the documents of each fold and class (part: 2 * fold + class)."""
    for b in batches:
        part, n = np.unique(2 * fold_of(b.column("doc_id").to_numpy()) + b.column("toxic").to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int64())], ["part", "n"])


def _counts(parts: int):
    """(row, n0, n1, ...): the documents of each part that hold a word. Parts are the classes, or 2 * fold + class if there are more than two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, fold, docs in _shards(batches):
            n = np.zeros((parts, 1 << DIM_BITS), np.int32)
            for d, p in zip(docs, y.astype(np.int64) + (2 * fold if parts > 2 else 0), strict=True):
                n[p, np.unique(d)] += 1
            row = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), *[pa.array(x) for x in n[:, row]]], ["row", *[f"n{p}" for p in range(parts)]])

    return run


#: Changes travel as whole numbers of this size; the layers' lie in rows after the words'.
_UNIT, _MOVES = 2.0**-22, [f"d{i}" for i in range(EMBED)]


def trained(docs: DataFrame, labels: DataFrame, seed: int = 5, shard_docs: int | None = None, cuts: bool = True) -> Model:
    """train() on all labels, in shards: a model of all folds and, for the thresholds, models of all folds but one."""
    shard_docs = shard_docs or SHARD_DOCS
    model = Model(seed, Rows(np.zeros(0, np.int64), np.zeros((0, EMBED), np.float32)))
    marks = learnable(labels).withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    open_docs = docs.select("doc_id", language(docs).alias("lang"), "text").where(held_out() != 0)
    sizes = open_docs.select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id")
    known = checkpoint(sizes.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    n, size = known.agg(F.sum("n"), F.sum("size")).first()
    if n:
        rows = checkpoint(dealt(open_docs, known, max(-(-n // shard_docs), -(-(size or 0) // SHARD_BYTES)), seed).mapInArrow(_arrays, "shard int, doc_id long, toxic int, lang string, rows binary"))
        _learn(model, rows, seed, cuts)
        forget(rows)
    forget(known)
    model.thresholds.setdefault("", 0.5)
    return model


def dealt(docs: DataFrame, known: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, doc_id, toxic, lang, text): a row of docs for each id of known, sorted within the partitions that the shards lie in. Texts move once, and only those that the bits of the known ids let through."""
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    place, bit = F.shiftright(at, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << ID_BITS}) & 63 as int))")
    bits = known.select(place.alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    some = docs.withColumn("place", place).join(F.broadcast(bits), "place").where(F.col("bits").bitwiseAND(bit) != 0)
    # the labels of a shard in one row: so they meet the texts by shard, where these have to go anyway
    marks = known.select(shard.alias("shard"), "doc_id", "toxic").repartition(4 * shards, "shard").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "toxic"))).alias("marks"))
    met = some.select(shard.alias("shard"), "doc_id", "lang", "text").repartition(4 * shards, "shard").join(marks, "shard")
    found = met.select("shard", "doc_id", F.expr("marks[doc_id]").alias("toxic"), "lang", "text").where("toxic is not null")
    one = found.groupBy("shard", "doc_id", "toxic").agg(F.max(F.struct("text", "lang")).alias("d")).select("shard", "doc_id", "toxic", "d.lang", "d.text")
    return one.sortWithinPartitions("shard", "doc_id")


def _learn(model: Model, rows: DataFrame, seed: int, cuts: bool) -> None:
    context = rows.sparkSession.sparkContext
    total = np.zeros((FOLDS, 2))
    for part, n in rows.mapInArrow(_classes, "part int, n long").groupBy("part").sum("n").collect():
        total[divmod(part, 2)] = n
    # model m has not seen fold m; the last one has seen all
    total = np.array([total[np.arange(FOLDS) != m].sum(0) for m in range(FOLDS + 1)])
    share = total[:, 1] / np.maximum(total.sum(1), 1)
    open_ = np.flatnonzero((total > 0).all(1)).tolist()
    # the rarer class counts more, by the root of what it lacks; half of that leaves the bias in the end
    weight = np.sqrt(np.maximum(total[:, 0], 1) / np.maximum(total[:, 1], 1))
    models, parts = (range(FOLDS + 1), 2 * FOLDS) if cuts and open_ else ([FOLDS], 2)
    by_row = rows.mapInArrow(_counts(parts), f"row int, {', '.join(f'n{p} int' for p in range(parts))}").groupBy("row").agg(*[F.sum(f"n{p}").alias(f"n{p}") for p in range(parts)])

    def odds(m: int):
        neg, pos = (sum((F.col(f"n{2 * f + t}") for f in range(parts // 2) if f != m), F.lit(0)) for t in (0, 1))
        # words of a few documents say little: their odds are shrunk
        both = F.log((pos + 0.5) / (total[m, 1] + 1)) - F.log((neg + 0.5) / (total[m, 0] + 1))
        return F.when(pos + neg > 0, both * (pos + neg) / (pos + neg + 12)).cast("float").alias(f"o{m}")

    words = by_row.select("row", *[odds(m) for m in models]).toArrow().sort_by("row")
    ids, bins = words.column("row").to_numpy(), []
    for m in models:
        start = Model(seed, model.table)
        start.bias = np.float32(prior_odds(share[m]))
        if m in open_:
            start.begin(share[m] * weight[m] / (share[m] * weight[m] + 1 - share[m]))
        else:
            start.dense[:] = 0
        layers, o = start.layers, words.column(f"o{m}").to_numpy()
        values = np.random.default_rng(seed).normal(0, 0.02, (len(ids), EMBED)).astype(np.float32)
        values[:, 0] = o
        values[np.isnan(o)] = 0
        for turn in range(ROUNDS if m in open_ else 0):
            sent = context.broadcast((ids, values, layers))
            moved = rows.mapInArrow(_turn(sent, m, float(weight[m]), seed, turn), f"row int, {', '.join(f'{c} int' for c in _MOVES)}")
            mean = [(F.sum(c) / F.count(c) * F.lit(_UNIT)).cast("float").alias(c) for c in _MOVES]
            flat = np.zeros((-(-len(layers) // EMBED), EMBED), np.float32)
            for b in moved.groupBy("row").agg(*mean).toArrow().to_batches():
                row, change = b.column(0).to_numpy(), np.stack([x.to_numpy() for x in b.columns[1:]], axis=1)
                word = row < 1 << DIM_BITS
                values[np.searchsorted(ids, row[word])] += change[word]
                flat[row[~word] - (1 << DIM_BITS)] = change[~word]
            layers += flat.ravel()[: len(layers)]
            sent.destroy()
        if m in open_:
            layers[len(model.dense)] -= np.log(weight[m]) / 2
        if m < FOLDS:
            sent = context.broadcast((ids, values, layers))
            bins.append(rows.mapInArrow(_places(sent, m), "lang string, bin int, toxic long, n long").groupBy("lang", "bin").agg(F.sum("toxic"), F.sum("n")).toArrow())
            sent.destroy()
    model.layers, model.table = layers, Rows(ids, values)
    if bins:
        got = pa.concat_tables(bins)
        lang = np.array([x or "" for x in got.column(0).to_pylist()])
        at = 1 / (1 + np.exp(-(got.column(1).to_numpy() + 0.5) / BINS))
        y, n = (got.column(i).to_numpy().astype(np.float64) for i in (2, 3))
        base = _cut(at, y, n, 0.5)
        model.thresholds = {"": base} | {name: _cut(*(v[lang == name] for v in (at, y, n)), base) for name in sorted(set(lang.tolist()) - {""})}


def _cut(score: np.ndarray, y: np.ndarray, n: np.ndarray, base: float) -> float:
    """threshold() of bins, those of one score taken together."""
    s, at = np.unique(score, return_inverse=True)
    return threshold(s, np.bincount(at, y), np.ones(len(s)), base, np.bincount(at, n))


def _turn(sent, m: int, weight: float, seed: int, turn: int):
    """One round of model m in each shard: what its copy of the model changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, layers = sent.value
        for shard, y, fold, docs in _shards(batches):
            held, place = np.zeros(1 << DIM_BITS, bool), np.empty(1 << DIM_BITS, np.int32)
            for d in docs:
                held[d] = True
            known = np.flatnonzero(held)
            place[known] = np.arange(len(known))
            before, use = values[np.searchsorted(ids, known.astype(ids.dtype))], np.flatnonzero(fold != m)
            copied = Model(seed, before.copy())
            copied.layers = layers
            copied.descend([place[docs[i]] for i in use], y[use], EPOCHS, 64, 0.02, np.random.default_rng([seed, turn, shard]), weight)
            moved = copied.table - before
            touched = np.flatnonzero(moved.any(axis=1))
            flat = copied.layers - layers
            flat = np.append(flat, np.zeros(-len(flat) % EMBED, np.float32)).reshape(-1, EMBED)
            row = np.append(known[touched], (1 << DIM_BITS) + np.arange(len(flat)))
            change = np.rint(np.clip(np.vstack([moved[touched], flat]) / _UNIT, -(2.0**31) + 1, 2.0**31 - 129)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), *[pa.array(c) for c in change.T]], ["row", *_MOVES])

    return run


def _places(sent, m: int):
    """Documents and toxic ones of fold m by language and bin of the log odds that model m, which hasn't seen them, gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, layers = sent.value
        model = Model(table=Rows(ids, values))
        model.layers = layers
        for b in batches:
            b = b.filter(pa.array(fold_of(b.column("doc_id").to_numpy()) == m))
            place = np.zeros(b.num_rows, np.int64)
            for i, r in enumerate(b.column("rows")):
                d = np.frombuffer(r.as_buffer(), "<i4")
                place[i] = math.floor(model.log_odds(np.array([0, len(d)]), d)[0] * BINS)
            one = pa.table({"lang": b.column("lang"), "bin": pa.array(place, pa.int32()), "toxic": b.column("toxic").cast(pa.int64())})
            yield from one.group_by(["lang", "bin"]).aggregate([("toxic", "sum"), ("toxic", "count")]).rename_columns(["lang", "bin", "toxic", "n"]).to_batches()

    return run


def train(docs: DataFrame, labels: DataFrame, max_per_class: int | None = None, seed: int = 5, cuts: bool = True) -> Model:
    """A model of the labelled rows of docs that are not held out, with thresholds by language unless cuts is false; of all of them, unless max_per_class is given."""
    return trained(docs, labels, seed, cuts=cuts) if max_per_class is None else sampled(docs, labels, max_per_class, seed)


def fold_of(ids: np.ndarray) -> np.ndarray:
    return (tx.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def hash_mod(i: int, of: int = 4) -> int:
    return int(tx.mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(of))


def scores(model: Model, spark: SparkSession):
    """A column function: the score of a text column."""
    small = copy(model)
    small.table = model.table if isinstance(model.table, Rows) else Rows.of(model.table)
    sent = spark.sparkContext.broadcast(small)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            out = np.zeros(len(t))
            for a, b, part, cuts in tx.chunks(*tx.text_bytes(pa.array(t, pa.large_string(), from_pandas=True))):
                out[a:b] = sent.value.score(*word_rows(part, cuts))
            yield pd.Series(out)

    return score


def cut_of(docs: DataFrame, model: Model):
    """The threshold of a row's language; that of all for languages without labels."""
    cut = F.lit(model.thresholds[""])
    if "lang" in docs.columns:
        for name, t in model.thresholds.items():
            cut = F.when(F.col("lang") == name, t).otherwise(cut) if name else cut
    return cut


def judged(docs: DataFrame, labels: DataFrame, max_per_class: int | None = None) -> DataFrame:
    """All columns of docs with toxicity (double) and rejected (boolean: at or over the language's threshold). Columns of docs with these names are replaced."""
    model = train(docs, labels, max_per_class)
    own = [c for c in docs.columns if c.lower() not in ("toxicity", "rejected")]
    s = scores(model, docs.sparkSession)
    return docs.select(*own, s("text").alias("toxicity")).withColumn("rejected", F.col("toxicity") >= cut_of(docs, model))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    name = fresh(docs, "cut")
    model = train(docs, labels)
    return docs.withColumn(name, scores(model, docs.sparkSession)("text") >= cut_of(docs, model)).where(~F.col(name)).drop(name)


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = scores(train(docs, read(spark, sf_dir, "labels"), cuts=False), spark)
    return docs.select("doc_id", (held_out() == 0).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
