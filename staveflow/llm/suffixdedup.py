"""Substring dedup: suffixes sorted to a depth of LENGTH bytes by bucket-pointer refinement.

Every byte that lies in a LENGTH-byte string which also starts in a document of
smaller doc_id is removed. Which strings repeat is decided by refinement:
suffixes start in buckets of their first SEED bytes, and a bucket is refined by
sorting on the bucket numbers (pointers) of the same suffixes at a later offset.
Pointers that a round has refined are what the next one sorts on, so the depth
doubles, and suffixes alone in their bucket leave. Rounds end at LENGTH bytes:
the question is which LENGTH-byte strings are equal, not their order.

All suffixes of a corpus need not move for that. Of the GRAM-byte grams in a
window of LENGTH bytes the one with the smallest hash is the window's anchor;
equal windows have equal anchors, so

1. a census of the anchors' hashes (block exchange) finds those in two
   documents or more,
2. only their contexts, the bytes of the windows they anchor, go to the hash
   range of the anchor, where their suffixes are refined, and
3. each context gets back one bit for each of its windows.

The census also counts the contexts that would arrive for an anchor. One with so
many that they would fill a large share of a row group (HOT; boilerplate before
varying text makes such anchors) has its contexts cut into single windows, each
of which goes to the range of a hash of its own bytes. Equal windows still meet,
as all groups learn of the same hot anchors, and arrive once from each row group,
so no range has the contexts of an anchor in numbers that grow with the corpus.

Contexts that agree in a row group travel once, with the smallest doc_id, and
those that agree in a range are refined once, so a large group of copies costs
each row group once. Blocks grow with row groups and hash ranges, never with
the size of a group of copies.

Null texts are empty; a null doc_id counts as larger than all others; documents
with the same doc_id don't remove from each other. What is kept is bytes, since
a cut may fall within a character. A very long text is read in pieces that
overlap, and is a row group of its own. An empty table gives no rows, and other
columns are not read. Equal anchors and equal contexts are told by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as tx
from .frames import by_group, checkpoint, laid_out, pack48, packed, read, split_by_range, stable, unpack48, unpacked

LENGTH, GRAM = 50, 26
#: Bytes of the first buckets, which are compared as they are, not by a hash.
SEED = 8
#: A range is refined in so many parts, and a row group's windows are marked for so many runs at a time.
PARTS, RUNS = 16, 1 << 15
#: An anchor is hot if its contexts have over one part in so many of a row group's bytes.
HOT = 4
_PLACE = np.uint64((1 << 28) - 1)
_PIECE = 1 << 26
_LAST = np.iinfo(np.int64).max


def anchors(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: (document, hash of the anchor, first window, windows, hash of their bytes).

    Anchors are minima, so their hashes are mixed once more: else the lower key ranges would get most of them.
    """
    parts = []
    for a, b, part, cuts in tx.chunks(raw, off):
        for x in range(0, max(0, len(part) - length + 1), _PIECE):
            piece = part[x : x + _PIECE + length - 1]
            h = tx.byte_grams(piece, gram)
            place = tx.sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE
            ok = np.zeros(len(place) + 1, np.int8)
            lo, hi = np.clip(cuts[:-1] - x, 0, len(place)), np.clip(cuts[1:] - length + 1 - x, 0, len(place))
            full = lo < hi
            np.add.at(ok, lo[full], 1)
            np.add.at(ok, hi[full], -1)
            s = np.flatnonzero(np.cumsum(ok[:-1]))
            if not len(s):
                continue
            at = place[s].astype(np.int64)
            head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)))
            first, n = s[head], np.diff(np.append(head, len(s)))
            parts.append((a + np.searchsorted(cuts, first + x, side="right") - 1, tx.mix(h[at[head]]), off[a] + x + first, n, range_hash(piece, first, first + n + length - 1)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, tx.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tx.U64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def range_hash(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the strings raw[start:stop]."""
    acc = np.empty(len(raw) + 1, tx.U64)
    acc[0] = 0
    np.cumsum((raw.astype(tx.U64) + tx.U64(1)) * tx._power_table(tx._ROOT, len(raw)), out=acc[1:])
    return tx.mix((acc[stop] - acc[start]) * tx._power_table(tx._ROOT_INVERSE, len(raw) + 1)[start])


def refined(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(positions, buckets) of suffixes of the contexts raw[start:stop] that share depth bytes with another one; equal buckets, equal bytes.

    Bucket-pointer refinement: positions of a round carry the bucket of their
    first `have` bytes, and are sorted by the pair of it and the pointer `step`
    bytes on. A suffix that is alone leaves, and its pointer, unlike all
    others, goes on serving suffixes before it. No suffix reads behind its
    context, and seed is at most 8.
    """
    have, used = min(seed, depth), 0
    n = np.maximum(stop - start - have + 1, 0)
    at = tx.spread(start, n)
    left, key, pointer = np.repeat(stop, n) - at, np.zeros(len(at), np.uint64), np.zeros(len(raw), np.uint64)
    for i in range(have):
        key = (key << np.uint64(8)) | raw[at + i]
    while True:
        _, bucket, count = np.unique(key, return_inverse=True, return_counts=True)
        pointer[at] = bucket.astype(np.uint64) + np.uint64(used)
        used += len(count)
        again = count[bucket] > 1
        if have == depth:
            return at[again], bucket[again]
        step = min(have, depth - have)
        again &= left >= have + step
        at, left = at[again], left[again]
        key = (pointer[at] << np.uint64(32)) | pointer[at + step]
        have += step


class Group:
    """A row group's runs, which of them may repeat elsewhere, and its distinct contexts in the order in which they travel."""

    def __init__(self, docs: pa.Table, length: int, gram: int):
        self.raw, self.off = tx.text_bytes(docs.column("text"))
        self.ids = docs.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()
        self.length = length
        self.doc, self.hash, self.first, self.n, self.bytes = anchors(self.raw, self.off, length, gram)
        self.keys, self.key = np.unique(self.hash, return_inverse=True)

    def shared(self) -> np.ndarray:
        """Which keys are in several documents of the group."""
        low, high = np.full(len(self.keys), len(self.ids)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.key, self.doc)
        np.maximum.at(high, self.key, self.doc)
        return low < high

    def extra(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, numbers): the keys with several distinct contexts in the group, and how many more than one."""
        runs = np.flatnonzero(np.bincount(self.key, minlength=len(self.keys))[self.key] > 1)
        order = runs[np.lexsort((self.bytes[runs], self.key[runs]))]
        key, same = self.key[order], self.bytes[order]
        more = key[1:][(key[1:] == key[:-1]) & (same[1:] != same[:-1])]
        return np.unique(more, return_counts=True)

    def cut_hot(self, hot: np.ndarray) -> None:
        """Cuts the runs of hot keys into single windows, whose hash is that of their bytes."""
        runs = np.flatnonzero(hot[self.key])
        if not len(runs):
            return
        hashes = []
        for x in range(0, len(runs), RUNS):
            n = self.n[runs[x : x + RUNS]]
            size = n + self.length - 1
            start = tx.spread(np.cumsum(size) - size, n)
            hashes.append(range_hash(self.raw[tx.spread(self.first[runs[x : x + RUNS]], size)], start, start + self.length))
        n, rest = self.n[runs], np.flatnonzero(~hot[self.key])
        same = np.concatenate(hashes)
        self.doc = np.append(self.doc[rest], np.repeat(self.doc[runs], n))
        self.hash = np.append(self.hash[rest], tx.mix(same))
        self.first = np.append(self.first[rest], tx.spread(self.first[runs], n))
        self.n = np.append(self.n[rest], np.ones(len(same), np.int64))
        self.bytes, self.key = np.append(self.bytes[rest], same), np.append(self.key[rest], np.repeat(self.key[runs], n))

    def contexts(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(runs, context of each, a run of each context, smallest doc_id of each)."""
        runs = np.flatnonzero(repeated[self.key])
        order = np.lexsort((self.bytes[runs], self.hash[runs]))
        h, c = self.hash[runs][order], self.bytes[runs][order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))[: len(runs)]
        of = np.empty(len(runs), np.int64)
        of[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), _LAST)
        np.minimum.at(least, of, self.ids[self.doc[runs]])
        return runs, of, runs[order[new]], least


def _bits(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(blocks, sizes, strict=True)]).astype(bool) if blocks else np.zeros(0, bool)


def _repeated(group: Group, answers: pa.Table, ranges: int) -> np.ndarray:
    """Which keys of the group may repeat elsewhere; runs of hot ones are cut."""
    _, cut = split_by_range(group.keys, ranges)
    answers, hot = answers.sort_by("b"), np.zeros(len(group.keys), bool)
    for x, y, bits in zip(cut[:-1], cut[1:], answers.column("hot").to_pylist(), strict=True):
        if bits is not None:
            hot[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x)
    repeated = _bits(answers.column("bits").to_pylist(), np.diff(cut))
    group.cut_hot(hot & repeated)
    return repeated


def _census(rows: DataFrame, group_bytes: int, ranges: int, length: int, gram: int, most: int) -> DataFrame:
    """(g, b, bits, hot): which anchors of group g in range b are in two documents, and which have more than `most` contexts (null: none)."""

    def keys_of(g: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = Group(table, length, gram)
        b, cut = split_by_range(group.keys, ranges)
        shared = group.shared()
        at, more = group.extra()
        where = np.searchsorted(at, cut)
        cols: list[list[bytes]] = [[], [], [], []]
        for x, y, i, j in zip(cut[:-1], cut[1:], where[:-1], where[1:], strict=True):
            for col, values in zip(cols, (pack48(group.keys[x:y]), np.packbits(shared[x:y]), (at[i:j] - x).astype("<u4"), more[i:j].astype("<u4")), strict=True):
                col.append(bytes(values))
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(np.full(len(b), g), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["b", "g", "keys", "bits", "at", "more"])

    def count(table: pa.Table) -> pa.Table:
        blocks = [unpack48(x) for x in table.column("keys").to_pylist()]
        sizes = np.array([len(x) for x in blocks])
        _, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
        # within a block two keys may agree in 48 bits; that only lets more contexts travel
        twice = np.bincount(inverse, 1.0 + _bits(table.column("bits").to_pylist(), sizes))[inverse] > 1
        cut, arrive = np.append(0, np.cumsum(sizes)), np.ones(len(inverse))
        for x, at, more in zip(cut, table.column("at").to_pylist(), table.column("more").to_pylist(), strict=False):
            arrive[x + np.frombuffer(at, "<u4").astype(np.int64)] += np.frombuffer(more, "<u4")
        hot = np.bincount(inverse, arrive)[inverse] > most
        pieces = list(zip(cut[:-1], cut[1:], strict=True))
        bits = [np.packbits(twice[x:y]).tobytes() for x, y in pieces]
        hots = [np.packbits(hot[x:y]).tobytes() if hot[x:y].any() else None for x, y in pieces]
        return pa.table({"g": table.column("g"), "b": table.column("b"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())})

    blocks = by_group(rows, group_bytes, keys_of, "b int, g long, keys binary, bits binary, at binary, more binary")
    return blocks.groupBy("b").applyInArrow(count, "g long, b int, bits binary, hot binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with keep_bytes also kept (binary), for each row of docs (doc_id, text).

    An anchor is shared by at most length - gram + 1 windows, whose bits travel in one word of 32.
    """
    gram = gram or max(1, length - LENGTH + GRAM)
    if not 0 <= length - gram < 32:
        raise ValueError("gram is to be from length - 31 to length")
    rows = stable(docs).select("doc_id", "text")
    group_bytes, ranges, _ = laid_out(rows)
    most = max(1, group_bytes // HOT // (2 * length - gram))
    census = checkpoint(_census(rows, group_bytes, ranges, length, gram, most))
    dealt = packed(rows, group_bytes).repartition(ranges, "g")

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g, docs = docs.column("g")[0].as_py(), unpacked(docs)
        group = Group(docs, length, gram)
        _, _, run, least = group.contexts(_repeated(group, answers, ranges))
        b, cut = split_by_range(group.hash[run], ranges)
        first, size = group.first[run], group.n[run] + length - 1
        cols: list[list[bytes]] = [[], [], [], []]
        part = (group.hash[run] & np.uint64(PARTS - 1)).astype(np.uint8)
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            cols[0].append(size[x:y].astype("<u4").tobytes())
            cols[1].append(least[x:y].astype("<i8").tobytes())
            cols[3].append(part[x:y].tobytes())
            cols[2].append(b"".join(group.raw[i : i + k].tobytes() for i, k in zip(first[x:y], size[x:y], strict=True)))
        return pa.table({"b": pa.array(b, pa.int32()), "g": pa.array(np.full(len(b), g), pa.int64()), "sizes": pa.array(cols[0], pa.binary()), "ids": pa.array(cols[1], pa.binary()), "raw": pa.array(cols[2], pa.binary()), "part": pa.array(cols[3], pa.binary())})

    def refine(table: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("sizes").to_pylist()]
        size, ids = np.concatenate(sizes), np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), np.uint8)
        whole = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.uint8)
        begin, mask = np.cumsum(size) - size, np.zeros(len(size), np.uint32)
        for x in range(PARTS):
            # contexts of one anchor are in one part, so parts don't meet; one at a time is in memory
            pick = np.flatnonzero(part == x)
            if not len(pick):
                continue
            k, n, owner = size[pick], size[pick] - length + 1, ids[pick]
            raw, start = whole[tx.spread(begin[pick], k)], np.cumsum(k) - k
            # contexts that agree are refined once, with the smallest doc_id of all
            _, one, of = np.unique(range_hash(raw, start, start + k), return_index=True, return_inverse=True)
            least = np.full(len(one), _LAST)
            np.minimum.at(least, of, owner)
            raw, k, windows = raw[tx.spread(start[one], k[one])], k[one], n[one]
            start, base = np.cumsum(k) - k, np.cumsum(windows) - windows
            at, bucket = refined(raw, start, start + k, length)
            who = np.searchsorted(start, at, side="right") - 1
            lowest = np.full(int(bucket.max(initial=-1)) + 1, _LAST)
            np.minimum.at(lowest, bucket, least[who])
            first = np.repeat(least, windows)
            first[base[who] + at - start[who]] = lowest[bucket]
            bit = np.left_shift(np.uint32(1), tx.spread(np.zeros(len(n), np.int64), n).astype(np.uint32))
            bit[first[tx.spread(base[of], n)] >= np.repeat(owner, n)] = 0
            mask[pick] = np.bitwise_or.reduceat(bit, np.cumsum(n) - n)
        cut = np.append(0, np.cumsum([len(x) for x in sizes]))
        return pa.table({"g": table.column("g"), "b": table.column("b"), "masks": pa.array([mask[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpacked(docs)
        group = Group(docs, length, gram)
        is_mask = np.array(answers.column("masks").is_valid().to_pylist(), bool)
        runs, of, _, least = group.contexts(_repeated(group, answers.filter(pa.array(~is_mask)), ranges))
        mask = np.frombuffer(b"".join(answers.filter(pa.array(is_mask)).sort_by("b").column("masks").to_pylist()), "<u4")
        later = group.ids[group.doc[runs]] > least[of]
        edge = np.zeros(len(group.raw) + 1, np.int32)
        for x in range(0, len(runs), RUNS):
            n = group.n[runs[x : x + RUNS]]
            within = tx.spread(np.zeros(len(n), np.int64), n)
            hit = (np.repeat(mask[of[x : x + RUNS]], n) >> within.astype(np.uint32) & 1).astype(bool) | np.repeat(later[x : x + RUNS], n)
            start = (np.repeat(group.first[runs[x : x + RUNS]], n) + within)[hit]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for a, b in zip(group.off[:-1], group.off[1:], strict=True):
            g = gone[a:b]
            kept = (group.raw[a:b][~g] if g.any() else group.raw[a:b]).tobytes()
            out["n_bytes"].append(int(b - a))
            out["n_removed"].append(int(g.sum()))
            out["n_spans"].append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if b > a else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        cols = {"doc_id": docs.column("doc_id").cast(pa.int64())} | {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string() if k == "kept_sha256" else pa.binary()) for k, v in out.items() if keep_bytes or k != "kept"}
        return pa.table(cols)

    sent = dealt.groupBy("g").cogroup(census.groupBy("g")).applyInArrow(send, "b int, g long, sizes binary, ids binary, raw binary, part binary")
    masks = sent.groupBy("b").applyInArrow(refine, "g long, b int, masks binary")
    answers = census.unionByName(masks, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(remove, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, u.p AS p, u.s AS s FROM (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2 - 49), lambda p: struct_pack(p := p, s := substr(h, 2 * p + 1, 100)))) AS u FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
r AS (SELECT g.doc_id, g.p FROM g JOIN m ON g.s = m.s WHERE m.least < g.doc_id),
k AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
x AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY doc_id, k),
y AS (SELECT x.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY x.doc_id ORDER BY a), 0) AS c, h FROM x JOIN d ON x.doc_id = d.doc_id),
z AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(z.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""
