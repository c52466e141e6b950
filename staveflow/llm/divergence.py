"""How far the sources of a language are apart in their words: exact sums over a whole vocabulary from sparse counts.

Each language keeps the terms that enough of its documents hold. A group is a
source within a language; a term that it never uses still has a probability,
the same for all such terms, so no group is ever laid out over the vocabulary.
The distance of two groups, a sum over all kept terms, is put together by
inclusion and exclusion over their supports A and B (terms with a count):

    terms in A, against what B gives a term it lacks
  + terms in B, against what A gives a term it lacks
  + (V - |A| - |B|) times the difference of the two constants
  + for terms in both: their difference, less the two prices above, plus the difference of the constants

The one-sided prices need no terms: a group's terms with one count cost the
same, so its count histogram, sorted and summed up once, prices it against the
constants of all other groups in one sweep. Only terms in both are met one by
one, in a join of the postings of a term; a task keeps a sum a pair of groups,
not a row a pair of postings.

Counts are exact integers throughout. Null text, lang and source count as ''.
Rows are documents of their own, also repeated ones; empty texts make a group
without terms. A language without kept terms has pairs of value 0 and no term
rows; an empty table gives no rows. Columns other than these three are not
read. A text is as many postings as it has different terms, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .frames import FEW_ROWS, by_group, checkpoint, lookup, read

# Documents that a kept term is in, added to each count, scale of probabilities, ranks of terms.
MIN_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text whose counts are merged before they leave a task; pairs of postings at a time.
GROUP_BYTES, PAIRS = 16 << 20, 1 << 20


def _counted(_: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a row group, and for each group that occurs a row without a term."""
    raw, off = tx.text_bytes(table.column("text"))
    lang, source = (tx.one_array(table.column(c)).dictionary_encode() for c in ("lang", "source"))
    many = len(source.dictionary)
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + source.indices.to_numpy(zero_copy_only=False)
    doc, start, end, low = tx.spans(raw, off, tx.LETTER_BYTE)
    length = end - start
    data, at = low[tx.LETTER_BYTE[low]], np.concatenate([[0], np.cumsum(length)])
    words = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    size = max(1, len(words.dictionary))
    key = np.sort(doc * size + words.indices.to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n, key = np.diff(np.append(first, len(key))), key[first]
    key = group[key // size] * size + key % size
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    docs, n = np.diff(np.append(first, len(key))), np.add.reduceat(n, first) if len(first) else n
    key = key[first]
    owner = np.concatenate([key // size, groups := np.unique(group)])
    zero = np.zeros(len(groups), np.int64)
    term = pa.concat_arrays([words.dictionary.take(pa.array(key % size)), pa.nulls(len(groups), pa.large_utf8())])
    out = [lang.dictionary.take(pa.array(owner // many)).cast(pa.string()), source.dictionary.take(pa.array(owner % many)).cast(pa.string()), term.cast(pa.string()), pa.array(np.append(n, zero)), pa.array(np.append(docs, zero))]
    yield from pa.table(out, names=["lang", "source", "term", "n", "docs"]).to_batches(1 << 16)


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total): counts of the kept terms by group and by language, and one row without a term for each group; checkpointed."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = by_group(rows, GROUP_BYTES, _counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")  # at most a row a source
    found = found.withColumn("total", F.sum("n").over(same)).withColumn("in_docs", F.sum("docs").over(same))
    return checkpoint(found.where((F.col("in_docs") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "n", "total"))


def _share(count: Column, size: Column, terms: Column, added: int, scale: int) -> Column:
    """1 + floor(scale * (count + added) / (size + added * terms)) in whole numbers that don't overflow; 0 where there are no terms."""
    whole = F.lit(scale).cast("decimal(10,0)") * (count + added).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", whole, (size + added * terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(0)).cast("long")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (lang, term, gid, p, z) to (a, b, value): corrections by pair of groups a < b, summed over the task's terms."""
    held, sums = None, (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))

    def merged(pairs: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs, value = pairs[order], value[order]
        new = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(1))) if len(pairs) else np.zeros(0, np.int64)
        return pairs[new], np.add.reduceat(value, new) if len(new) else value

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums[0][:, 0]), pa.array(sums[0][:, 1]), pa.array(sums[1])], ["a", "b", "value"])

    def met(rows: pa.Table, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gid, p, z = (rows.column(c).to_numpy() for c in ("gid", "p", "z"))
        after = np.repeat(start[1:], np.diff(start)) - np.arange(len(gid)) - 1  # later postings of the same term
        ends = np.cumsum(after)
        i = 0
        while i < len(gid):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")))
            x = np.repeat(np.arange(i, j), after[i:j])
            y = tx.spread(np.arange(i, j) + 1, after[i:j])
            value = np.abs(p[x] - p[y]) - np.abs(p[x] - z[y]) - np.abs(z[x] - p[y]) + np.abs(z[x] - z[y])
            yield merged(np.column_stack([gid[x], gid[y]]), value)
            i = j

    def ready(rows: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal sums
        for pairs, value in met(rows, start):
            sums = merged(np.concatenate([sums[0], pairs]), np.concatenate([sums[1], value]))
            if len(sums[1]) > PAIRS:
                yield out()
                sums = sums[0][:0], sums[1][:0]

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.ones(rows.num_rows, bool)
        term, lang = (tx.one_array(rows.column(c)) for c in ("term", "lang"))
        new[1:] = pc.or_(pc.not_equal(term[1:], term[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        held = rows.slice(start[-1])
        yield from ready(rows.slice(0, start[-1]), start)
    if held is not None:
        yield from ready(held, np.array([0, held.num_rows]))
    yield out()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, added: int = ADDED, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language with the distance from it; part `term`: the `top` terms that the source has most more of than its language."""
    held = postings(docs, min_docs)
    terms = held.where("term is not null")
    size = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("support"))
    whole = terms.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("terms"))
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "support", "all", "terms")]
    groups = held.where("term is null").select("lang", "source").join(size, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *none)
    groups = groups.withColumn("z", _share(F.lit(0), F.col("size"), F.col("terms"), added, scale)).withColumn("gid", F.monotonically_increasing_id())
    groups = checkpoint(groups)
    known = groups.select(F.struct("lang", "source").alias("grp"), "gid", "size", "all", "terms", "z")
    share = lambda n, size: _share(F.col(n), F.col(size), F.col("terms"), added, scale)
    priced = lookup(terms.withColumn("grp", F.struct("lang", "source")), known, "grp").select("lang", "source", "gid", "term", "z", share("n", "size").alias("p"), share("total", "all").alias("q"))

    # one-sided prices: each group's histogram, swept together with the constants of the others
    names = groups.select("lang", "source", "support", "terms", "z")
    others = names.select("lang", F.col("source").alias("item"), F.col("support").alias("support2"), F.col("z").alias("z2"))
    others = F.broadcast(others) if groups.count() <= FEW_ROWS else others
    constant = (F.col("terms") - F.col("support") - F.col("support2")) * F.abs(F.col("z") - F.col("z2"))
    asked = names.join(others, "lang").where("source != item")
    asked = asked.select("lang", "source", F.col("z2").alias("v"), F.lit(0).cast("long").alias("h"), "item", constant.alias("constant"))
    nothing = F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("constant")
    histogram = priced.groupBy("lang", "source", F.col("p").alias("v")).agg(F.count(F.lit(1)).alias("h")).select("lang", "source", "v", "h", *nothing)
    mine = Window.partitionBy("lang", "source")
    sofar = mine.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = histogram.unionByName(asked).withColumn("hv", F.col("h") * F.col("v"))
    swept = swept.select("*", F.sum("h").over(sofar).alias("below"), F.sum("hv").over(sofar).alias("below_v"), F.sum("h").over(mine).alias("every"), F.sum("hv").over(mine).alias("every_v"))
    price = F.col("v") * F.col("below") - F.col("below_v") + (F.col("every_v") - F.col("below_v")) - F.col("v") * (F.col("every") - F.col("below"))
    swept = swept.where("item is not null").select("lang", "source", "item", price.alias("price"), "constant")
    both = swept.select("lang", "source", "item", (F.col("price") + F.col("constant")).alias("value")).unionByName(swept.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("price").alias("value")))

    # corrections where both have the term
    ordered = priced.select("lang", "term", "gid", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    fixes = ordered.mapInArrow(_overlaps, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))
    by_id = lambda c: F.struct(F.col("lang"), F.col("source")).alias(c)
    one = groups.select(F.col("gid").alias("a"), "lang", "source")
    two = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    if groups.count() <= FEW_ROWS:
        one, two = F.broadcast(one), F.broadcast(two)
    fixes = fixes.join(one, "a").join(two, "b").select("lang", "source", "item", "value")
    back = fixes.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(fixes).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    place = F.row_number().over(mine.orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)
    more = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(more.select("*", place).where(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS ng FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.ng + 5 * l.v) AS p, 1 + (1000000000 * (k.total + 5)) // (l.nl + 5 * l.v) AS q
 FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 50
"""
