"""Exact Jaccard self-join of n-gram sets with set-relation skipping, and its connected groups.

A document's set holds the distinct hashes of its runs of N words. Two sets of
at least THRESHOLD (of 100) similarity are linked.

1. Census: how often each hash occurs in the whole corpus (block exchange). A
   hash that occurs once is in no other set, so a set with too few repeated
   hashes has no partner and leaves here, exactly. Equal sets are one class,
   and a second census, over the classes that are left, removes those whose
   hashes repeat only in copies of their own.
2. Lists: hashes are ordered by rarity, so the prefix filter holds, and each
   class goes to the lists of the repeated hashes in its prefix, with its
   position there. Lists are dealt by hash range; the census tells which are
   longer than SPLIT, and those are dealt as parts, whose pairs go to different
   ranges. A list is sorted by size and skipped block by block: what two blocks
   have left at most from the list on bounds what their sets can share, if it
   is the first list they share, and their sizes bound what they must.
3. Skipping by relation: in each list the most typical class meets the others;
   the answers of all members are then derived from those of their group's
   centre. Two groups that share a list have their centres compared, and by the
   triangle inequality of the Jaccard distance all their pairs are skipped if
   the centres are farther apart than both radii and a link's length together.
   Pairs of the few groups that are left are enumerated from their common lists.

Every comparison is an exact intersection of whole sets (of 48-bit hashes of the runs). No
list is cut and no pair is dropped, and no list's pairs are all emitted.

Texts of fewer than N words, but not none, are one run; null or wordless texts
have an empty set, link with nothing and are groups of their own. Rows with the
same or no doc_id are documents of their own; a group's id is its smallest
doc_id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .frames import by_group, checkpoint, components, fresh, key_width, laid_out, lookup, pack48, packed, read, split_by_range, stable, unpack48, unpacked

N, THRESHOLD = 5, 75
#: So many pairs of near groups are broadcast at most (16 bytes each); more are joined by a shuffle.
FEW_PAIRS = 200_000
#: A list of more classes is split into parts of about so many; lists up to SMALL classes are compared many at a time, longer ones in blocks of BLOCK.
SPLIT, SMALL, BLOCK = 4096, 24, 64


def shingles(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of n words, or of all words of a shorter text; in order of documents. Hashes have 48 bits, the upper ones."""
    docs, found = [], []
    for a, b, part, cuts in tx.chunks(raw, off):
        doc, h, _ = tx.words(part, cuts, tx.NOT_SPACE)
        at = tx.bounds(doc, b - a)
        g = tx.grams(h, n)
        first = np.ones(len(g), bool)
        first &= doc[: len(g)] == doc[len(h) - len(g) :] if len(g) else first
        docs.append(a + doc[: len(g)][first])
        found.append(g[first])
        for d in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < n)):
            k = at[d + 1] - at[d]
            docs.append(np.array([a + d]))
            found.append(tx.mix(tx.grams(h[at[d] : at[d + 1]], int(k)) + np.uint64(k)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, tx.U64)
    doc, h = np.concatenate(docs), np.concatenate(found) & ~tx.U64(0xFFFF)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def _census(rows: DataFrame, n: int, group_bytes: int, ranges: int, width: int) -> DataFrame:
    """(g, b, counts): how often the hashes of group g in range b occur in all groups. Of each hash `width` bytes travel; two that agree in them only count too high."""

    def keys_of(g: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(shingles(*tx.text_bytes(table.column("text")), n)[1], return_counts=True)
        b, cut = split_by_range(keys, ranges)
        more = np.flatnonzero(times > 1)
        where = np.searchsorted(more, cut)
        cols = [[pack48(keys[x:y], width) for x, y in zip(cut[:-1], cut[1:], strict=True)], [(more[x:y] - c).astype("<u4").tobytes() for x, y, c in zip(where[:-1], where[1:], cut, strict=False)], [times[more[x:y]].astype("<u4").tobytes() for x, y in zip(where[:-1], where[1:], strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(np.full(len(b), g), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["b", "g", "keys", "at", "n"])

    def count(table: pa.Table) -> pa.Table:
        blocks = [unpack48(x, width) for x in table.column("keys").to_pylist()]
        times = np.ones(sum(map(len, blocks)), np.int64)
        start = np.append(0, np.cumsum([len(x) for x in blocks]))
        for s, at, k in zip(start, table.column("at").to_pylist(), table.column("n").to_pylist(), strict=False):
            times[s + np.frombuffer(at, "<u4")] = np.frombuffer(k, "<u4")
        _, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
        # the order of hashes needs no more than 16 bits: beyond, ties go by hash
        total = np.minimum(np.bincount(inverse, times), 65535).astype("<u2")[inverse]
        return pa.table({"g": table.column("g"), "b": table.column("b"), "counts": pa.array([total[x:y].tobytes() for x, y in zip(start[:-1], start[1:], strict=True)], pa.binary())})

    blocks = by_group(rows.select("text"), group_bytes, keys_of, "b int, g long, keys binary, at binary, n binary")
    return blocks.groupBy("b").applyInArrow(count, "g long, b int, counts binary")


def _sets(rows: DataFrame, counts: DataFrame, n: int, threshold: int, group_bytes: int, ranges: int) -> DataFrame:
    """(rid, doc_id, n, sid, toks): the set's size and hash; toks are its repeated hashes, null if it can't have a partner or an equal set of the row group has them."""

    def judge(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpacked(docs)
        doc, h = shingles(*tx.text_bytes(docs.column("text")), n)
        keys, inverse = np.unique(h, return_inverse=True)
        total = np.frombuffer(b"".join(answers.sort_by("b").column("counts").to_pylist()), "<u2")
        m, hashed = docs.num_rows, tx.mix(keys ^ np.uint64(0x5BD1E995))
        both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | inverse.astype(np.uint64))
        doc, word = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = tx.bounds(doc, m)
        size, running = np.diff(at), np.append(np.uint64(0), np.cumsum(hashed[word]))
        sid = tx.mix(running[at[1:]] - running[at[:-1]] + size.astype(np.uint64))
        again = total[word] > 1
        cut = np.append(0, np.cumsum(again))[at]
        new = np.zeros(m, bool)
        new[np.unique(sid, return_index=True)[1]] = True
        held, rest = pack48(keys[word[again]]), np.diff(cut)
        toks = [held[6 * x : 6 * y] if ok else None for x, y, ok in zip(cut[:-1], cut[1:], new & (size > 0) & (100 * rest >= threshold * size), strict=True)]
        return pa.table({"rid": docs.column("rid"), "doc_id": docs.column("doc_id").cast(pa.int64()), "n": pa.array(size, pa.int64()), "sid": pa.array(sid.view(np.int64), mask=size == 0), "toks": pa.array(toks, pa.binary())})

    dealt = packed(rows.select("rid", "doc_id", "text"), group_bytes).repartition(ranges, "g")
    return dealt.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(judge, "rid long, doc_id long, n long, sid long, toks binary")


def _classes(sets: DataFrame, threshold: int, ranges: int) -> DataFrame:
    """(sid, n, toks, typical, parts): each set once, if enough of its hashes are in two different sets that are left; toks by rarity among these, parts by token for the last ones, whose lists are split."""
    dealt = sets.where("toks is not null").select("sid", "n", "toks", F.pmod(F.xxhash64("sid"), F.lit(ranges)).alias("g")).repartition(ranges, "g")

    def once(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        sid, first = np.unique(table.column("sid").to_numpy(), return_index=True)
        toks = table.column("toks").take(pa.array(first)).to_pylist()
        return sid, table.column("n").to_numpy()[first], [unpack48(t) for t in toks]

    def keys_of(table: pa.Table) -> pa.Table:
        keys, times = np.unique(np.concatenate(once(table)[2]), return_counts=True)
        b, cut = split_by_range(keys, ranges)
        cols = [[pack48(keys[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)], [times[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]]
        return pa.table({"b": pa.array(b, pa.int32()), "g": pa.array([table.column("g")[0].as_py()] * len(b), pa.int64()), "keys": pa.array(cols[0], pa.binary()), "n": pa.array(cols[1], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        blocks = [unpack48(x) for x in table.column("keys").to_pylist()]
        times = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4")
        _, inverse = np.unique(np.concatenate(blocks), return_inverse=True)
        total, cut = np.bincount(inverse, times).astype("<u4")[inverse], np.append(0, np.cumsum([len(x) for x in blocks]))
        return pa.table({"g": table.column("g"), "b": table.column("b"), "counts": pa.array([total[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        sid, size, toks = once(table)
        keys = np.unique(np.concatenate(toks)) if toks else np.zeros(0, np.uint64)
        total = np.frombuffer(b"".join(answers.sort_by("b").column("counts").to_pylist()), "<u4").astype(np.int64)
        own, t = np.repeat(np.arange(len(toks)), [len(x) for x in toks]), np.concatenate(toks) if toks else keys
        c = total[np.searchsorted(keys, t)]
        own, t, c = own[c > 1], t[c > 1], c[c > 1]
        order = np.lexsort((t, c, own))
        own, t, c = own[order], t[order], c[order]
        at = tx.bounds(own, len(toks))
        keep = 100 * np.diff(at) >= threshold * size
        typical = (1000 * np.bincount(own, np.log2(c), minlength=len(toks)) / np.maximum(size, 1)).astype(np.int64)
        packed_toks, parts, short = pack48(t), -(-c // SPLIT), np.append(0, np.cumsum(c <= SPLIT))
        cols = [packed_toks[6 * x : 6 * y] for x, y in zip(at[:-1][keep], at[1:][keep], strict=True)], [parts[x + short[y] - short[x] : y].astype("<u4").tobytes() for x, y in zip(at[:-1][keep], at[1:][keep], strict=True)]
        return pa.table({"sid": pa.array(sid[keep], pa.int64()), "n": pa.array(size[keep], pa.int64()), "toks": pa.array(cols[0], pa.binary()), "typical": pa.array(typical[keep]), "parts": pa.array(cols[1], pa.binary())})

    counts = dealt.groupBy("g").applyInArrow(keys_of, "b int, g long, keys binary, n binary").groupBy("b").applyInArrow(count, "g long, b int, counts binary")
    return dealt.groupBy("g").cogroup(counts.groupBy("g")).applyInArrow(keep, "sid long, n long, toks binary, typical long, parts binary")


def _prefixes(batch: pa.RecordBatch, threshold: int) -> tuple[np.ndarray, ...]:
    """(hash, row, what the set has left from there on, parts of the list) of the prefixes' repeated hashes; columns n, toks and parts are the second, third and fourth."""
    size = batch.column(1).to_numpy(zero_copy_only=False)
    toks, hot = [unpack48(x) for x in batch.column(2).to_pylist()], [np.frombuffer(x, "<u4") for x in batch.column(3).to_pylist()]
    again = np.array([len(t) for t in toks], np.int64)
    reach = np.clip(size - -(-threshold * size // 100) + 1 - (size - again), 0, again)
    own = np.repeat(np.arange(len(toks)), reach)
    within = np.arange(len(own)) - np.repeat(np.cumsum(reach) - reach, reach)
    tok = np.concatenate([t[:k] for t, k in zip(toks, reach, strict=True)]) if toks else np.zeros(0, np.uint64)
    parts, start = np.ones(len(tok), np.int64), np.cumsum(reach) - reach
    for i in np.flatnonzero([len(h) for h in hot]):
        cold = len(toks[i]) - len(hot[i])
        if cold < reach[i]:
            parts[start[i] + cold : start[i] + reach[i]] = hot[i][: reach[i] - cold]
    return tok, own, again[own] - within, parts


def _dealt(tok: np.ndarray, root: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, key, side) of list entries: those of a split list once for each pair of parts that theirs, by their root, is in; side tells the parts of a pair apart, 2 for a part with itself."""
    entry = np.repeat(np.arange(len(tok)), parts)
    n, other = parts[entry], np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = (tx.mix(root.astype(np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)[entry]
    low, high = np.minimum(own, other), np.maximum(own, other)
    key = np.where(n > 1, tx.mix(tok[entry] + tx.mix(((low << 32) + high + 1).astype(np.uint64))), tok[entry])
    return entry, key, np.where(low == high, 2, np.where(low == own, 0, 1)).astype(np.uint8)


def _listed(sets: DataFrame, ranges: int, threshold: int) -> DataFrame:
    """Blocks (b, toks, sids, sizes, left, typical, roots, sides) of the prefixes of the classes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, own, left, parts = _prefixes(batch, threshold)
            ids, size, typical, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4, 5))
            entry, tok, side = _dealt(tok, root[own], parts)
            order = np.argsort(tok, kind="stable")
            entry, tok, side = entry[order], tok[order], side[order]
            own, left = own[entry], left[entry]
            b, cut = split_by_range(tok, ranges)
            cols = [tok.astype("<u8"), ids[own].astype("<i8"), size[own].astype("<u4"), left.astype("<u4"), typical[own].astype("<u4"), root[own].astype("<i8"), side]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array([c[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for c in cols)], ["b", "toks", "sids", "sizes", "left", "typical", "roots", "sides"])

    return sets.select("sid", "n", "toks", "parts", "typical", "root").mapInArrow(deal, "b int, toks binary, sids binary, sizes binary, left binary, typical binary, roots binary, sides binary")


def _unblock(table: pa.Table) -> list[np.ndarray]:
    cols = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("toks", "<u8"), ("sids", "<i8"), ("sizes", "<u4"), ("left", "<u4"), ("typical", "<u4"), ("roots", "<i8"), ("sides", "u1"))]
    return cols[:2] + [c.astype(np.int64) for c in cols[2:]]


def _pairs_out(a: list, b: list) -> pa.Table:
    if not a:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = np.concatenate(a), np.concatenate(b)
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)] & (low != high)
    return pa.table({"a": pa.array(low[new]), "b": pa.array(high[new])})


def _lists(tok: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    stop = np.append(cut[1:], len(tok))
    more = stop - cut > 1
    return zip(cut[more], stop[more], strict=True)


def _fitting(tok: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, side: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of a list, sorted by tok and low, that sets of low to high hashes, left of them at most from there on, can link by."""

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        enough = (100 + threshold) * np.minimum(left[i], left[j]) >= threshold * (low[i] + low[j])
        return enough & (100 * high[i] >= threshold * low[j]) & (100 * high[j] >= threshold * low[i]) & ((side[i] == 2) | (side[i] != side[j]))

    cut = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))[: len(tok)]
    size = np.diff(np.append(cut, len(tok)))
    for m in np.unique(size[(size > 1) & (size <= SMALL)]):
        x, y = np.triu_indices(int(m), 1)
        heads = cut[size == m]
        for s in range(0, len(heads), max(1, 100_000 // len(x))):
            at = heads[s : s + max(1, 100_000 // len(x)), None]
            i, j = (at + x).ravel(), (at + y).ravel()
            ok = fits(i, j)
            yield i[ok], j[ok]
    for x, n in zip(cut[size > SMALL], size[size > SMALL], strict=True):
        starts = np.arange(x, x + n, BLOCK)
        most, least, widest = np.maximum.reduceat(left[x : x + n], starts - x), low[starts], np.maximum.reduceat(high[x : x + n], starts - x)
        for k, s in enumerate(starts):
            i = np.arange(s, min(s + BLOCK, x + n))
            ahead = (100 + threshold) * np.minimum(most[k], most[k:]) >= threshold * (least[k] + least[k:])
            blocks = k + np.flatnonzero(ahead & (100 * widest[k] >= threshold * least[k:]))
            j = (starts[blocks][:, None] + np.arange(BLOCK)).ravel()
            j = j[j < x + n]
            p, q = np.nonzero(fits(i[:, None], j[None, :]) & (i[:, None] < j[None, :]))
            yield i[p], j[q]


def _first_meets_all(lists: DataFrame, threshold: int) -> DataFrame:
    """(a, b): each class with the one class that it meets in most lists, of those that stand first there.

    In each list the most typical class meets all that can be linked with it
    by their positions; the rest likewise among themselves.
    """

    def stars(table: pa.Table) -> pa.Table:
        tok, sid, size, left, typical, _, side = _unblock(table)
        # pairs of parts add nothing here: each part has its own most typical class
        whole = side == 2
        tok, sid, size, left, typical = (x[whole] for x in (tok, sid, size, left, typical))
        order = np.lexsort((sid, -typical, tok))
        tok, sid, size, left = tok[order], sid[order], size[order], left[order]
        first, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _lists(tok):
            rest = np.arange(x, y)
            while len(rest) > 1:
                one, others = rest[0], rest[1:]
                fits = (100 + threshold) * np.minimum(left[one], left[others]) >= threshold * (size[one] + size[others])
                first.append(np.full(fits.sum(), sid[one]))
                other.append(sid[others[fits]])
                rest = others[~fits]
        a, b = np.concatenate(first), np.concatenate(other)
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        return pa.table({"one": pa.array(a[head]), "sid": pa.array(b[head]), "k": pa.array(np.diff(np.append(head, len(a))))})

    met = lists.groupBy("b").applyInArrow(stars, "one long, sid long, k long").groupBy("one", "sid").agg(F.sum("k").alias("k"))
    best = met.groupBy("sid").agg(F.max(F.struct("k", "one"))["one"].alias("one"))
    return best.select(F.least("one", "sid").alias("a"), F.greatest("one", "sid").alias("b")).distinct()


def _roots_that_meet(lists: DataFrame, threshold: int) -> DataFrame:
    """Pairs of roots with members in one list that can be linked by their positions."""

    def meet(table: pa.Table) -> pa.Table:
        tok, _, size, left, _, root, side = _unblock(table)
        order = np.lexsort((root, tok))
        tok, root, size, left, side = tok[order], root[order], size[order], left[order], side[order]
        head = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (root[1:] != root[:-1])))[: len(tok)]
        low, high, left = (f.reduceat(x, head) if len(head) else x for f, x in ((np.minimum, size), (np.maximum, size), (np.maximum, left)))
        tok, root, side = tok[head], root[head], side[head]
        order = np.lexsort((low, tok))
        tok, root, side, low, high, left = (x[order] for x in (tok, root, side, low, high, left))
        a, b = [], []
        for i, j in _fitting(tok, low, high, left, side, threshold):
            a.append(root[i])
            b.append(root[j])
        return _pairs_out(a, b)

    return lists.groupBy("b").applyInArrow(meet, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): exact sizes of intersection and union."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n1"), F.col("toks").alias("t1"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("toks").alias("t2"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, both = batch.column(2).to_pylist(), batch.column(3).to_pylist(), np.zeros(batch.num_rows, np.int64)
            filled = np.cumsum([len(x) + len(y) for x, y in zip(t1, t2, strict=True)])
            s = 0
            while s < len(both):
                # so many pairs at a time as hold about a million hashes; the pair's number goes above the 48 bits
                e = max(s + 1, min(s + 65_000, int(np.searchsorted(filled, (filled[s - 1] if s else 0) + 6_000_000))))
                sizes = [len(x) // 6 for pair in zip(t1[s:e], t2[s:e], strict=True) for x in pair]
                keys = unpack48(b"".join(x for pair in zip(t1[s:e], t2[s:e], strict=True) for x in pair)) >> np.uint64(16)
                keys = np.sort(keys | (np.repeat(np.arange(2 * (e - s)) // 2, sizes).astype(np.uint64) << np.uint64(48)))
                both[s:e] = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48)).astype(np.int64), minlength=e - s)
                s = e
            either = batch.column(4).to_numpy() + batch.column(5).to_numpy() - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(either)], ["a", "b", "both", "either"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "t1", "t2", "n1", "n2").mapInArrow(meet, "a long, b long, both long, either long")


def _centred(label: DataFrame, found: DataFrame) -> DataFrame:
    """label with the node of most links as each group's root."""
    degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    best = checkpoint(label.join(degree, "node").groupBy("root").agg(F.max(F.struct("k", "node"))["node"].alias("centre")))
    return checkpoint(lookup(label, best, "root").select("node", F.col("centre").alias("root")))


def links(sets: DataFrame, ranges: int, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): enough links between classes (sid, n, toks) for their connected groups; both ends of each are linked."""
    linked = 100 * F.col("both") >= threshold * F.col("either")
    apart = 1 - F.col("both") / F.col("either")
    alone = sets.withColumn("root", F.col("sid"))
    first = checkpoint(_verified(_first_meets_all(_listed(alone, ranges, threshold), threshold), sets))
    found = first.where(linked).select("a", "b")
    label = _centred(components(found), found)
    rooted = sets.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    cross = _roots_that_meet(_listed(rooted, ranges, threshold), threshold).withColumn("roots", F.lit(True))
    inner = label.where("node != root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"), F.lit(False).alias("roots"))
    wanted = checkpoint(cross.unionByName(inner).groupBy("a", "b").agg(F.max("roots").alias("roots")))
    known = wanted.join(first, ["a", "b"])
    measured = checkpoint(_verified(wanted.join(first, ["a", "b"], "left_anti").select("a", "b"), sets).join(wanted, ["a", "b"]).unionByName(known))
    found = found.union(measured.where(linked).select("a", "b"))
    member = measured.where(~F.col("roots")).select("a", "b", apart.alias("d"))
    radius = member.join(label, F.col("a") == F.col("node")).groupBy("root").agg(F.max("d").alias("r"))
    near = measured.where("roots").where(~linked).select("a", "b", apart.alias("d"))
    r1, r2 = radius.select(F.col("root").alias("a"), F.col("r").alias("ra")), radius.select(F.col("root").alias("b"), F.col("r").alias("rb"))
    slack = 1 - threshold / 100 + 1e-9
    near = checkpoint(near.join(r1, "a", "left").join(r2, "b", "left").where(F.col("d") <= slack + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))).where("ra is not null or rb is not null").select("a", "b"))
    if near.isEmpty():
        return found
    few = near.limit(FEW_PAIRS + 1).collect()
    met = _members_that_meet(_listed(rooted, ranges, threshold), [tuple(r) for r in few], threshold) if len(few) <= FEW_PAIRS else _common_lists(near, rooted, threshold)
    rest = met.join(first, ["a", "b"], "left_anti").join(measured, ["a", "b"], "left_anti")
    return found.union(_verified(checkpoint(rest), sets).where(linked).select("a", "b"))


def _members_that_meet(lists: DataFrame, near: list[tuple[int, int]], threshold: int) -> DataFrame:
    """Pairs of members, with a list in common and positions that allow a link, of groups whose roots are near; for at most FEW_PAIRS pairs of roots, which go to all tasks."""
    sent = lists.sparkSession.sparkContext.broadcast(np.array(near, np.int64).reshape(-1, 2))

    def meet(table: pa.Table) -> pa.Table:
        tok, sid, size, left, _, root, side = _unblock(table)
        ends, with_ = {}, sent.value
        for p, q in with_[np.isin(with_[:, 0], root) & np.isin(with_[:, 1], root)].tolist():
            ends.setdefault(p, []).append(q)
        order = np.lexsort((root, tok))
        tok, sid, size, left, root, side = tok[order], sid[order], size[order], left[order], root[order], side[order]
        a, b = [], []
        for x, y in _lists(tok):
            cut = np.append(np.flatnonzero(np.append(True, root[x + 1 : y] != root[x : y - 1])), y - x) + x
            at = {int(root[i]): (i, j) for i, j in zip(cut[:-1], cut[1:], strict=True)}
            for p in at.keys() & ends.keys():
                for q in ends[p]:
                    if q in at:
                        (i, j), (k, m) = at[p], at[q]
                        if side[i] == side[k] != 2:
                            continue
                        fits = (100 + threshold) * np.minimum(left[i:j, None], left[None, k:m]) >= threshold * (size[i:j, None] + size[None, k:m])
                        r, c = np.nonzero(fits)
                        a.append(sid[i + r])
                        b.append(sid[k + c])
        return _pairs_out(a, b)

    return lists.groupBy("b").applyInArrow(meet, "a long, b long").distinct()


def _common_lists(near: DataFrame, rooted: DataFrame, threshold: int) -> DataFrame:
    """Pairs of members, of fitting sizes and with a list in common, of groups whose roots are near."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, own, left, _ = _prefixes(batch, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(left), *(batch.column(i).take(pa.array(own)) for i in (0, 1, 4))], ["tok", "left", "sid", "n", "root"])

    ends = near.select(F.col("a").alias("root")).union(near.select("b")).distinct()
    rows = checkpoint(rooted.select("sid", "n", "toks", "parts", "root").join(ends, "root").select("sid", "n", "toks", "parts", "root").mapInArrow(prefixes, "tok long, left long, sid long, n long, root long"))
    one = near.join(rows.select(F.col("root").alias("a"), "tok", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx")), "a")
    two = rows.select(F.col("root").alias("b"), "tok", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    fits = F.least("lx", "ly") * (100 + threshold) >= (F.col("nx") + F.col("ny")) * threshold
    met = one.join(two, (one.b == two.b) & (one.tok == two.tok) & fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped_documents(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """(rid, doc_id, n_shingles, root, component_id) for each row of docs (doc_id, text), in the row ids of monotonically_increasing_id()."""
    docs = stable(docs)
    group_bytes, ranges, total = laid_out(docs)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    # about one run of words in six bytes of text
    census = _census(rows, n, group_bytes, ranges, key_width(total / 6))
    sets = checkpoint(_sets(rows, census, n, threshold, group_bytes, ranges))
    classes = checkpoint(_classes(sets, threshold, ranges))
    label = components(links(classes, ranges, threshold))
    named = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = checkpoint(named)
    names = checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = checkpoint(lookup(named.select("sid", "root"), names, "root"))
    rows = sets.select("rid", "doc_id", F.col("n").alias("n_shingles"), "sid")
    out = lookup(rows.where("sid is not null"), of, "sid").select("rid", "doc_id", "n_shingles", "root", "component_id")
    none = rows.where("sid is null").select("rid", "doc_id", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return out.union(none)


def deduplicated(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (then the first row), with the columns of docs; documents without words stay."""
    docs = stable(docs)
    rid = fresh(docs, "rid")
    found = checkpoint(grouped_documents(docs.select("doc_id", "text"), n, threshold))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    first = found.where("root is not null").groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.rid").alias(rid))
    kept = first.union(found.where("root is null").select("rid"))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(kept, rid, "left_semi").drop(rid)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([list_aggregate(w[p:p + least(len(w), 5) - 1], 'string_agg', ' ') for p in range(1, len(w) - least(len(w), 5) + 2)]) AS g FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM c UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id) m USING (doc_id)
"""
