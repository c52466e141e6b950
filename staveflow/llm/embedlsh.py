"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

A normalised vector's key in a table is its K random Gaussian projections,
each shifted and cut into cells of width WIDTH. Cosine 0.9 is a distance of
0.447, at which one projection agrees with probability 0.82 (0.49 for
unrelated vectors). K grows with the logarithm of the rows, so that about
BUCKET unrelated vectors meet, and the number of tables follows from K and the
recall wanted for pairs at the very threshold; nearer pairs, as near copies
are, meet far more often. Vectors travel once for each table at most, so
buckets are as large as products of matrices take in their stride.

Equal vectors are one class. A census of the keys (block exchange) tells each
row group which of its buckets hold more than SPLIT classes. Classes then go to
the hash ranges of their keys, with their vectors; those of a larger bucket to
all pairs of parts that theirs is in, so a bucket is never one task's alone.
Each bucket's pairs are compared there: candidates in single precision, with a
margin over its rounding, then in double precision. A pair that meets in
several tables counts in the first of them. Pairs are not sent on: what leaves
a range is, for each class, its number of linked vectors there, and a spanning
forest of the links.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths don't link. Rows that repeat a vec_id are
vectors of their own, each with its own row, and link with each other like any
two. A null vec_id is counted, and named by null where no other id is in reach.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import by_group, checkpoint, components, lookup, packed, partitions, read, split_by_range, unpacked

THRESHOLD, WIDTH, RECALL, SEED = 0.9, 2.0, 0.97, 6
#: About so many unrelated vectors share a bucket.
BUCKET = 768
#: Buckets up to this size are compared many at a time, larger ones as blocks of a matrix.
SMALL, BLOCK_CELLS = 32, 1 << 20
#: A bucket of more classes is split into parts of about so many, and pairs of parts go to different ranges.
SPLIT = 4096
#: About so many bytes of vectors in a range, and sent by a row group.
RANGE_BYTES = 32 << 20


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that one projection of two vectors at this distance falls into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for so many rows."""
    k = max(4, math.ceil(math.log(max(1, rows / BUCKET)) / -math.log(agreement(math.sqrt(2)))))
    p = agreement(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p))


class Tables:
    """Keys of vectors; the projections follow from the seed and the vectors' length, so no table is sent."""

    def __init__(self, k: int, tables: int, seed: int = SEED):
        self.k, self.tables, self.seed, self.made = k, tables, seed, {}

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows x tables) keys of normalised vectors."""
        dim = x.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = rng.normal(size=(dim, self.k * self.tables)), rng.uniform(0, WIDTH, self.k * self.tables)
        a, b = self.made[dim]
        out = np.empty((len(x), self.tables), np.uint64)
        salt = np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
        for i in range(0, len(x), 1024):
            cell = np.floor((x[i : i + 1024] @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, self.tables, self.k)
            h = np.broadcast_to(salt, cell.shape[:2]).copy()
            for j in range(self.k):
                h = tx.mix(h + cell[:, :, j])
            out[i : i + 1024] = h
        return out


def _vectors(lists: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None for one that links with nothing."""
    out = []
    flat, off = lists.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
    values, bad = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), lists.is_null().to_numpy(zero_copy_only=False)
    for a, b, null in zip(off[:-1], off[1:], bad, strict=True):
        v = values[a:b]
        out.append(None if null or b == a or not np.isfinite(v).all() or not v.any() else v)
    return out


def _identified(vectors: DataFrame, name: str) -> DataFrame:
    """(id, cls, vec): each vector's bytes and a hash of them, null for one that links with nothing."""

    def name_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _vectors(batch.column(1))
            cls, raw = np.zeros(len(found), np.uint64), [None] * len(found)
            dims = np.array([0 if v is None else len(v) for v in found])
            for dim in np.unique(dims[dims > 0]):
                rows = np.flatnonzero(dims == dim)
                x = np.stack([found[i] for i in rows]).astype("<f8") + 0.0
                place = np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                cls[rows] = tx.mix(tx.mix(x.view(np.uint64) ^ place).sum(axis=1) + np.uint64(dim))
                for i, v in zip(rows, x, strict=True):
                    single = v.astype("<f4")
                    raw[i] = single.tobytes() if np.array_equal(single, v) and dim % 2 == 0 else v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls.view(np.int64), mask=dims == 0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "cls", "dim", "vec"])

    return vectors.select(F.col(name).cast("long"), F.col("embedding")).mapInArrow(name_classes, "id long, cls long, dim int, vec binary")


def _doubles(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8").astype(np.float64)


def _keyed(classes: pa.Table, tables: Tables) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, vectors, keys) of classes by length."""
    vecs, dims = classes.column("vec").to_pylist(), classes.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = np.stack([_doubles(vecs[i], int(dim)) for i in rows])
        yield int(dim), rows, x, tables.keys(x / np.linalg.norm(x, axis=1, keepdims=True))


def _census(classes: DataFrame, tables: Tables, group_bytes: int, ranges: int) -> DataFrame:
    """(g, b, parts): for the keys of row group g in range b, in order, into how many parts their buckets are split."""

    def keys_of(g: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate([k.ravel() for *_, k in _keyed(table, tables)]), return_counts=True)
        b, cut = split_by_range(keys, ranges)
        cols = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (keys.astype("<u8"), n.astype("<u4"))]
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(np.full(len(b), g), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["b", "g", "keys", "n"])

    def count(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        _, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
        size = np.bincount(inverse, np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4"))
        parts, cut = (-(-size // SPLIT)).astype("<u4")[inverse], np.append(0, np.cumsum([len(x) for x in blocks]))
        return pa.table({"g": table.column("g"), "b": table.column("b"), "parts": pa.array([parts[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    blocks = by_group(classes.select("vec", "dim"), group_bytes, keys_of, "b int, g long, keys binary, n binary", "vec")
    return blocks.groupBy("b").applyInArrow(count, "g long, b int, parts binary")


def _salted(flat: np.ndarray, cls: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, side): entries of split buckets once for each pair of parts that theirs is in; side tells the parts of a pair apart, 2 for a part with itself."""
    entry = np.repeat(np.arange(len(flat)), parts)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (tx.mix(cls.astype(np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)[entry]
    low, high = np.minimum(own, other), np.maximum(own, other)
    key = np.where(parts[entry] > 1, tx.mix(flat[entry] + tx.mix(((low << 32) + high + 1).astype(np.uint64))), flat[entry])
    return entry, key, np.where(low == high, 2, np.where(low == own, 0, 1)).astype(np.uint8)


def _blocks(classes: DataFrame, tables: Tables, group_bytes: int, ranges: int) -> DataFrame:
    """(b, dim, cls, n, vecs, keys, tabs, own, sides): by range the classes that have keys there, and the keys."""
    names = ["b", "dim", "cls", "n", "vecs", "keys", "tabs", "own", "sides"]

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpacked(table)
        cls, n = table.column("cls").to_numpy().astype("<i8"), table.column("n").to_numpy().astype("<i8")
        found = list(_keyed(table, tables))
        parts = np.frombuffer(b"".join(answers.sort_by("b").column("parts").to_pylist()), "<u4").astype(np.int64)
        known, cols = np.unique(np.concatenate([k.ravel() for *_, k in found])), [[] for _ in names]
        for dim, rows, x, keys in found:
            flat, tab, own = keys.ravel(), np.tile(np.arange(tables.tables), len(rows)), np.repeat(np.arange(len(rows)), tables.tables)
            entry, flat, side = _salted(flat, cls[rows[own]], parts[np.searchsorted(known, flat)])
            order = np.argsort(flat, kind="stable")
            b, cut = split_by_range(flat[order], ranges)
            single = x.astype("<f4")
            sent = single if np.array_equal(single, x) else x.astype("<f8")
            for r, s, e in zip(b, cut[:-1], cut[1:], strict=True):
                part = order[s:e]
                here, index = np.unique(own[entry[part]], return_inverse=True)
                values = cls[rows[here]], n[rows[here]], sent[here], flat[part].astype("<u8"), tab[entry[part]].astype("<u2"), index.astype("<u4"), side[part]
                for o, v in zip(cols, (int(r), dim, *(v.tobytes() for v in values)), strict=True):
                    o.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32()] + [pa.binary()] * 7, strict=True)], names)

    dealt = packed(classes.select("cls", "n", "vec", "dim"), group_bytes, "vec")
    answers = _census(classes, tables, group_bytes, ranges)
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(deal, "b int, dim int, cls binary, n binary, vecs binary, keys binary, tabs binary, own binary, sides binary")


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i] in root, which names each node's group by one of its nodes."""
    a, b = root[a], root[b]
    both = np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b))
    a, b = both // len(root), both % len(root)
    a, b = a[a != b], b[a != b]
    if not len(a):
        return
    to = np.arange(len(root))
    while True:
        least = np.minimum(to[a], to[b])
        new = to.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == to).all():
            break
        to = new
    root[:] = to[root]


def _linked(tables: Tables, threshold: float):
    """A function of one range's blocks: (cls, links, root) of the classes linked there."""

    def find(table: pa.Table) -> pa.Table:
        outs = []
        dims = np.array(table.column("dim").to_pylist())
        for dim in np.unique(dims):
            rows = [{c: table.column(c)[int(i)].as_py() for c in ("cls", "n", "vecs", "keys", "tabs", "own", "sides")} for i in np.flatnonzero(dims == dim)]
            cls, n = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("cls", "n"))
            sizes = [len(r["cls"]) // 8 for r in rows]
            x = np.concatenate([np.frombuffer(r["vecs"], "<f4" if len(r["vecs"]) == 4 * dim * s else "<f8").astype(np.float64).reshape(s, dim) for r, s in zip(rows, sizes, strict=True)])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            key, tab = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in rows]), np.concatenate([np.frombuffer(r["tabs"], "<u2") for r in rows]).astype(np.int64)
            own = np.concatenate([np.frombuffer(r["own"], "<u4").astype(np.int64) + s for r, s in zip(rows, np.append(0, np.cumsum(sizes)[:-1]), strict=True)])
            side = np.concatenate([np.frombuffer(r["sides"], np.uint8) for r in rows])
            order = np.lexsort((cls[own], key))
            key, tab, own, side = key[order], tab[order], own[order], side[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(head, len(key)))
            all_keys = tables.keys(x)
            links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))
            met = np.zeros(len(cls), bool)
            for m in np.unique(size[(size > 1) & (size <= SMALL)]):
                heads = head[size == m]
                i, j = np.triu_indices(int(m), 1)
                for s in range(0, len(heads), max(1, 60_000 // len(i))):
                    at = heads[s : s + max(1, 60_000 // len(i))]
                    a, b, t = (at[:, None] + i).ravel(), (at[:, None] + j).ravel(), np.repeat(tab[at], len(i))
                    ok = (side[a] == 2) | (side[a] != side[b])
                    p, q, t = own[a[ok]], own[b[ok]], t[ok]
                    hit = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q, t = p[hit], q[hit], t[hit]
                    met[p] = met[q] = True
                    _merge(root, p, q)
                    first = ((all_keys[p] == all_keys[q]) & (np.arange(tables.tables) < t[:, None])).any(1)
                    np.add.at(links, p[~first], n[q[~first]])
                    np.add.at(links, q[~first], n[p[~first]])
            single, margin = x.astype(np.float32), max(1e-5, dim * 2.4e-7)
            for a, m in zip(head[size > SMALL], size[size > SMALL], strict=True):
                who, t, part = own[a : a + m], int(tab[a]), side[a : a + m]
                y, k = single[who], all_keys[who, :t]
                step = max(1, BLOCK_CELLS // int(m))
                for s in range(0, m, step):
                    # each pair of a part with itself once, above the diagonal; both orders else
                    first = s if part[0] == 2 else 0
                    near = y[s : s + step] @ y[first:].T >= threshold - margin
                    if part[0] != 2:
                        near &= part[s : s + step, None] < part[None, :]
                    r, c = np.nonzero(near)
                    r, c = r + s, c + first
                    if part[0] == 2:
                        r, c = r[r < c], c[r < c]
                    for i in range(0, len(r), 1 << 16):
                        p, q = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
                        ok = np.einsum("ij,ij->i", x[who[p]], x[who[q]]) >= threshold
                        p, q = p[ok], q[ok]
                        met[who[p]] = met[who[q]] = True
                        _merge(root, who[p], who[q])
                        if t:
                            new = ~(k[p] == k[q]).any(1)
                            p, q = p[new], q[new]
                        np.add.at(links, who[p], n[who[q]])
                        np.add.at(links, who[q], n[who[p]])
            outs.append((cls[met], links[met], cls[root[met]]))
        cols = [np.concatenate(c) for c in zip(*outs, strict=True)]
        return pa.table({"cls": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "root": pa.array(cols[2], pa.int64())})

    return find


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    rows = checkpoint(_identified(vectors, vec_id))
    classes = checkpoint(rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("vec").alias("vec"), F.first("dim").alias("dim")))
    n_classes, total = classes.agg(F.count(F.lit(1)), F.sum(F.octet_length("vec") + 40)).first()
    tables = Tables(*shape(n_classes, threshold, recall))
    ranges = max(2 * partitions(classes), -(-(total or 0) * tables.tables // RANGE_BYTES))
    found = checkpoint(_blocks(classes, tables, RANGE_BYTES // tables.tables, ranges).groupBy("b").applyInArrow(_linked(tables, threshold), "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "cls", "left").join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    known = checkpoint(known)
    names = checkpoint(known.groupBy("root").agg(F.min("least").alias("component_id")))
    info = checkpoint(lookup(known, names, "root").select("cls", "component_id", (F.col("n") - 1 + F.col("links")).alias("n_links")))
    rows = rows.select("id", "cls")
    out = lookup(rows.where("cls is not null"), info, "cls").select("id", "component_id", "n_links")
    out = out.union(rows.where("cls is null").select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    component = F.col("component_id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op6_pstable_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
