"""Operators on documents against plain statements of what they compute, on small tables with all kinds of odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from staveflow.llm import decontaminate, frames, linededup, lm, mixing, setjoin, shard, suffixdedup, toxicity

random.seed(4)
VOCABULARY = ["the", "of", "Ale", "béta", "run", "x1", "sum", "Oak", "von", "zu", "que", "la", "tree", "mill", "row", "day"]


def prose(n):
    return " ".join(random.choice(VOCABULARY) + random.choice(["", "", "", ".", ",\n"]) for _ in range(n))


BASE, PASSAGE = prose(90), prose(40)
TEXTS = [
    BASE, BASE, BASE.replace("the", "THE", 1), BASE + " tail end", PASSAGE, prose(30) + "\n" + PASSAGE + "\n" + prose(25), None, "", "   ", "one two", "one two", "ONE two", "aaaa " * 60, "aaaa " * 70,
    prose(300), "日本語 テキスト " * 12, prose(60), prose(60) + "\n" + PASSAGE, "a\nb\nc\nd\na\nb\nc\nx", "q\na\nb\nc\nd", "\n\n\n\n\n", prose(2500),
]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, ["en", "fr", None][i % 3], ["s1", "s2", "s1", None, "s3"][i % 5]) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3, "doc_id").sortWithinPartitions("doc_id")


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, null ids, and columns whose names the operators use themselves."""
    again = [*rows, *rows[:4], (None, BASE, "en", None), (None, None, None, None)]
    frame = spark.createDataFrame(again, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit(7) for c in ("rid", "g", "n", "key", "block", "shard", "size", "root", "k1", "hit", "at", "pos", "removed", "items", "unit", "toxicity")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def components(sets, linked):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard_groups(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = spaced(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if w else set()
    want = components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.grouped_documents(docs.select("doc_id", "text")).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_groups_of_edited_copies(spark):
    """A family around the threshold, with many sets that link only with some others."""
    words = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        w = list(words)
        for _ in range(i % 5):
            w[random.randrange(80)] = f"e{random.randrange(200)}"
        texts.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in texts}
    want = components(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.grouped_documents(frame).collect()}
    assert got == want and len(set(want.values())) > 1


def test_near_groups_are_joined_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FEW_PAIRS", 0)
    test_jaccard_groups_of_edited_copies(spark)


def test_split_lists_give_the_same_groups(spark, monkeypatch):
    for name in ("SPLIT", "SMALL", "BLOCK"):
        monkeypatch.setattr(setjoin, name, 3)
    test_jaccard_groups_of_edited_copies(spark)
    monkeypatch.setattr(setjoin, "FEW_PAIRS", 0)
    test_jaccard_groups_of_edited_copies(spark)


def test_jaccard_odd_rows(odd, none):
    kept = setjoin.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(None) == 2 and texts.count(BASE) == 1 and "one two" in texts and "ONE two" not in texts
    assert setjoin.deduplicated(none).collect() == []


def removed(rows, length=50):
    seen, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            else:
                own.append(s)
        seen.update(dict.fromkeys(own, i))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_suffix_dedup(docs, rows, odd, none):
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.cut_repeats(docs.select("doc_id", "text")).collect()}
    assert {i: (*v[:4], bytes(v[4])) for i, v in got.items()} == removed(rows)
    both = suffixdedup.cut_repeats(odd.select("doc_id", "text")).collect()
    last = [r for r in both if r.doc_id is None and r.n_bytes]
    assert len(both) == odd.count() and len(last) == 1 and last[0].n_removed == last[0].n_bytes
    assert all(r.n_removed == 0 for r in both if r.doc_id == 0)
    assert suffixdedup.cut_repeats(none.select("doc_id", "text")).collect() == []


def test_hot_anchors_are_cut(spark, docs, rows, monkeypatch):
    """Boilerplate before varying text, and all the odd rows, with every anchor of several contexts hot."""
    line = "Licensed under the terms that the notice in full states. "
    many = [(i, line + f"{i:04d} " + PASSAGE[i % 7 :] if i % 3 else line + prose(20), None, None) for i in range(120)]
    monkeypatch.setattr(suffixdedup, "HOT", 1 << 30)
    for some in (rows, many):
        frame = spark.createDataFrame(some, "doc_id long, text string, lang string, source string").repartition(4).select("doc_id", "text")
        got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.cut_repeats(frame).collect()}
        assert {i: (*v[:4], bytes(v[4])) for i, v in got.items()} == removed(some)


def test_windows_of_a_hot_anchor_go_apart():
    import numpy as np
    import pyarrow as pa

    line = "Licensed under the terms that the notice in full states. "
    texts = [line + f"{i * 7919 % 100003:06d} and so on for document {i}" for i in range(3000)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})

    def most(group):
        return np.unique(group.hash[group.contexts(np.ones(len(group.keys), bool))[2]], return_counts=True)[1].max()

    group = suffixdedup.Group(table, 50, 26)
    keys, more = group.extra()
    assert most(group) == more.max() + 1 > 900
    windows = sorted(np.repeat(group.first, group.n) + np.concatenate([np.arange(n) for n in group.n]))
    group.cut_hot(np.isin(np.arange(len(group.keys)), keys))
    assert most(group) == 1
    assert windows == sorted(np.repeat(group.first, group.n) + np.concatenate([np.arange(n) for n in group.n]))


@pytest.mark.parametrize(("depth", "seed"), [(7, 2), (7, 8), (13, 4), (20, 8), (9, 3)])
def test_refined_buckets_are_equal_strings(depth, seed):
    import numpy as np

    raw = np.frombuffer(b"abcabcabdabcabcab" * 3 + b"xyabcabcabdabcabcabqq", np.uint8)
    start, stop = np.array([0, 5, 21, 51]), np.array([5, 21, 51, len(raw)])
    at, bucket = suffixdedup.refined(raw, start, stop, depth, seed)
    whole = [p for a, b in zip(start, stop, strict=True) for p in range(a, b - depth + 1)]
    strings = {p: raw[p : p + depth].tobytes() for p in whole}
    many = collections.Counter(strings.values())
    assert sorted(at) == [p for p in whole if many[strings[p]] > 1]
    found = dict(zip(at.tolist(), bucket.tolist(), strict=True))
    assert all((found[i] == found[j]) == (strings[i] == strings[j]) for i in found for j in found)


@pytest.mark.parametrize("length", [100, 20])
def test_suffix_dedup_of_other_lengths(docs, rows, length):
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.cut_repeats(docs.select("doc_id", "text"), length).collect()}
    assert {i: (*v[:4], bytes(v[4])) for i, v in got.items()} == removed(rows, length)
    with pytest.raises(ValueError):
        suffixdedup.cut_repeats(docs, length, gram=length + 1)


def test_rows_in_another_order_each_time(spark, rows):
    """A shuffled input has no fixed order of rows; the operators that read it twice checkpoint it."""
    frame = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, source string").repartition(7).select("doc_id", "text")
    assert frames.stable(frame) is not frame and frames.stable(frame.orderBy("text")) is not frame and frames.stable(frame.where("rand() < 2")) is not frame
    base = frames.checkpoint(frame)
    assert frames.stable(base) is base and frames.stable(base.where("doc_id > 3").select("text")).columns == ["text"]
    assert sorted(suffixdedup.cut_repeats(frame).collect(), key=str) == sorted(suffixdedup.cut_repeats(base).collect(), key=str)
    assert sorted(setjoin.grouped_documents(frame).drop("rid").collect(), key=str) == sorted(setjoin.grouped_documents(base).drop("rid").collect(), key=str)
    train = F.col("doc_id") % 2 == 0
    assert sorted(lm.scored(frame.withColumn("train", train)).collect(), key=str) == sorted(lm.scored(base.withColumn("train", train)).collect(), key=str)


def test_small_row_groups_give_the_same(docs, rows, monkeypatch):
    """Row groups of a few rows, split lists and joins past the broadcast bound change no result."""
    want = [sorted(f().collect(), key=str) for f in (lambda: setjoin.grouped_documents(docs.select("doc_id", "text")), lambda: suffixdedup.cut_repeats(docs.select("doc_id", "text")))]
    monkeypatch.setattr(frames, "GROUP_BYTES", 700)
    monkeypatch.setattr(frames, "BLOCK_BYTES", 1)
    monkeypatch.setattr(frames, "FEW_ROWS", 0)
    for name in ("SPLIT", "SMALL", "BLOCK"):
        monkeypatch.setattr(setjoin, name, 2)
    got = [sorted(f().collect(), key=str) for f in (lambda: setjoin.grouped_documents(docs.select("doc_id", "text")), lambda: suffixdedup.cut_repeats(docs.select("doc_id", "text")))]
    assert [[r.asDict() | {"root": 0} for r in x] for x in got] == [[r.asDict() | {"root": 0} for r in x] for x in want]


def test_language_model(docs, rows, none):
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1
    got = {r.doc_id: r for r in lm.scored(docs.withColumn("train", train)).collect()}
    tokens = {i: [*spaced(t), "</s>"] for i, t, *_ in rows}
    use = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i in tokens}
    c = collections.Counter(w for i in tokens if use[i] for w in tokens[i])
    pairs = collections.Counter(p for i in tokens if use[i] for p in zip(["<s>", *tokens[i]], tokens[i], strict=False))
    n, v = sum(c.values()), len(c)
    often = collections.Counter(pairs.values())
    worth = min(1, max(lm.LEAST_ONCE, 2 * often[2] / max(1, often[1])))
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for h, w in zip(["<s>", *ws], ws, strict=False):
            ch = c["</s>"] if h == "<s>" else c[h]
            k = lm.MIX * ch / (ch + lm.HALF)
            seen = 2 ** int(math.log2(pairs[h, w])) if pairs[h, w] > 1 else worth * pairs[h, w]
            score += math.log10(k * min(1, seen / max(ch, 1)) + (1 - k) * (c[w] + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (use[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6
        assert abs(r.score - score) < 0.02 * len(ws) + 0.5  # the filter has rare false hits
    assert lm.scored(none.withColumn("train", F.lit(True))).collect() == []


def test_no_cap_on_the_filter(docs, monkeypatch):
    """No bound on the bits changes a score, and no filter goes through the driver."""
    rows = docs.withColumn("train", F.col("doc_id") % 2 == 0)
    want = {r.doc_id: r.score for r in lm.scored(rows).collect()}
    monkeypatch.setattr(lm, "MAX_BITS", 64, raising=False)
    assert {r.doc_id: r.score for r in lm.scored(rows).collect()} == want
    monkeypatch.setattr(type(docs.sparkSession.sparkContext), "broadcast", lambda *_: pytest.fail("broadcast"))
    assert {r.doc_id: r.score for r in lm.scored(rows).collect()} == want


def test_pairs_seen_once_count(spark):
    """Two held-out texts of the same words, one with pairs that training holds once."""
    words = [f"w{i}" for i in range(40)]
    mixed = words[::2] + words[1::2]
    rows = [(1, " ".join(words), True), (2, " ".join(words), False), (3, " ".join(mixed), False)]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    assert got[2].score == got[1].score and abs(got[2].base_score - got[3].base_score) < 1e-9
    k = lm.MIX / (1 + lm.HALF)
    uni = 1.5 / (41 + 0.5 * 42)
    # no pair is seen twice, so that one seen once is worth the least
    assert abs(got[2].score - 41 * math.log10(k * lm.LEAST_ONCE + (1 - k) * uni)) < 1e-6
    assert got[2].score > got[3].score + 5


def test_language_model_odd_rows(odd):
    """Repeated rows, null ids and clashing names; a null in the choice of training rows is no training."""
    train = F.when(F.col("doc_id").isNull(), None).otherwise(F.col("doc_id") % 2 == 0)
    got = lm.scored(odd.withColumn("train", train)).collect()
    assert len(got) == odd.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert all(not r.train for r in got if r.doc_id is None)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.doc_id].add((r.n_tokens, round(r.score, 6)))
    assert all(len(v) == 1 for i, v in by_text.items() if i is not None)


def test_probabilities_after_a_word_sum_to_one_at_most(spark):
    """The score of a text of two words, less that of the first, over all second words."""
    random.seed(9)
    vocabulary = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(random.choice(vocabulary[: 3 + i % 28]) for _ in range(40)), True) for i in range(60)]
    probes = [(1000 + 31 * a + b, f"v{a} v{b}" if b < 30 else f"v{a}", False) for a in range(0, 30, 7) for b in range(31)]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows + probes, "doc_id long, text string, train boolean")).collect()}
    words = collections.Counter(w for _, t, _ in rows for w in [*t.split(), "</s>"])
    pairs = collections.Counter(p for _, t, _ in rows for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True))
    n, v = sum(words.values()), len(words)
    often = collections.Counter(pairs.values())
    worth = min(1, max(lm.LEAST_ONCE, 2 * often[2] / max(1, often[1])))
    seen = lambda h, w: 2 ** int(math.log2(pairs[h, w])) if pairs[h, w] > 1 else worth * pairs[h, w]

    def p(h, w):
        c = words["</s>" if h == "<s>" else h]
        k = lm.MIX * c / (c + lm.HALF)
        return k * min(1, seen(h, w) / max(c, 1)) + (1 - k) * (words[w] + 0.5) / (n + 0.5 * (v + 1))

    for a in range(0, 30, 7):
        total = 0.0
        for b in range(31):
            chain = ["<s>", f"v{a}", *([f"v{b}"] if b < 30 else []), "</s>"]
            logs = [math.log10(p(h, w)) for h, w in zip(chain, chain[1:], strict=False)]
            r = got[1000 + 31 * a + b]
            assert abs(r.score - sum(logs)) < 0.4
            total += 10 ** (r.score - logs[0] - (logs[2] if b < 30 else 0))
        exact = sum(p(f"v{a}", w) for w in [*vocabulary, "</s>"])
        # false hits of the filter may add a little to single words
        assert 0.5 < exact <= 1 and abs(total - exact) < 0.05


def test_filter_levels():
    import numpy as np

    from staveflow.llm import text as tx

    keys = np.sort(tx.mix(np.arange(1, 4001, dtype=np.uint64)) & ~np.uint64(0xFFFF))
    levels = np.arange(4000) % 5 + 1
    parts = lm.split_by_range(keys, 3)
    f = lm.Filter([lm.Filter.segment(keys[a:b], levels[a:b], 1 << 20) for a, b in zip(parts[1][:-1], parts[1][1:], strict=True)])
    got = f.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.03
    other = tx.mix(np.arange(10_000, 14_000, dtype=np.uint64)) & ~np.uint64(0xFFFF)
    assert (f.levels(other) > 0).mean() < 0.03


def test_a_large_benchmark_is_joined(spark, docs, odd, monkeypatch):
    """Past the bound of the index no index is sent, and the results are those of an index; with a table of bits that is nearly full too."""
    from pyspark import SparkContext

    bench = spark.createDataFrame([(i, PASSAGE[i * 7 :] + f" item {i}") for i in range(12)] + [(20, "one two"), (21, BASE), (22, None), (None, BASE), (23, "  "), (20, "ONE two")], "item_id long, text string")

    def results():
        found = decontaminate.scored(docs, bench).select("doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"))
        wide = decontaminate.contamination(odd, bench).select("doc_id", "n_words", "items", "spans", "n_hit")
        return [sorted(x.collect(), key=str) for x in (found, wide, decontaminate.clean(odd, bench))]

    want = results()
    assert any(r.n_hit for r in want[0]) and 0 < len(want[2]) < odd.count()
    send = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: pytest.fail("an index") if isinstance(x, decontaminate.Index) else send(self, x))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    for bits in (16, 9):
        monkeypatch.setattr(decontaminate, "TABLE_BITS", bits)
        assert results() == want


def test_decontamination(spark, docs, rows, odd, none):
    items = [(1, PASSAGE), (2, "one TWO"), (10, PASSAGE[-120:]), (3, "not in there at all my friend of old"), (4, None), (5, ""), (None, BASE), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        if i is not None and w:
            k = min(10, len(w))
            for p in range(len(w) - k + 1):
                windows[tuple(w[p : p + k])].add(str(i))
    want = {}
    for i, t, *_ in rows:
        w = word.findall(low(t))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        want[i] = (len(w), len(hit), sorted(found))
    get = lambda frame: {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in frame.collect()}
    assert get(decontaminate.scored(docs, bench)) == want
    full = decontaminate.contamination(docs, bench)
    assert get(full) == want and full.columns[:4] == docs.columns
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {i for i, v in want.items() if not v[1]}
    assert decontaminate.clean(odd, bench).columns == odd.columns
    own = [c for c in odd.columns if c != "items"]
    wide = decontaminate.contamination(odd, bench)
    assert wide.columns == [*own, "n_words", "items", "spans", "n_hit"] and wide.count() == odd.count()
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.scored(none, bench).collect() == []


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(docs, rows, odd, none):
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(spaced(t))
    want = targets(dict(sizes))
    got = mixing.copies(docs).collect()
    assert sorted(tuple(r)[2:] for r in got if r) == sorted(tuple(r)[2:] for r in mixing.copies(docs.repartition(5)).collect())
    taken, most = collections.Counter(), collections.defaultdict(int)
    for r in got:
        assert r["size"] == len(spaced(dict((i, t) for i, t, *_ in rows)[r.doc_id])) and 0 <= r.copies <= 2
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r["size"] * r.copies
        most[r.source] = max(most[r.source], r["size"])
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= most[s] for s in want)
    copies = collections.Counter({r.doc_id: r.copies for r in got})
    out = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert out == +copies
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and 0 < mix.count() <= 2 * odd.count()
    assert mixing.mixed(none).collect() == [] and mixing.copies(none).collect() == []


def test_mixing_tells_rows_apart_by_maps_and_nulls(spark):
    rows = [(1, "a b", "s", None, {"k": 1}), (1, "a b", "s", None, {"k": 2}), (1, "a b", None, "s", {"k": 1}), (1, "a b", "s", None, {"k": 1})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, m map<string,int>")
    got = collections.Counter((r.source, r.lang, r.m["k"]) for r in mixing.mixed(frame, share=9.0).collect())
    assert got == {("s", None, 1): 4, ("s", None, 2): 2, (None, "s", 1): 2}


def test_mixing_keeps_targets_over_levels(spark):
    frame = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', int(id % 17)) as text", "concat('s', id % 3) as source")
    for r in mixing.copies(frame).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 17


def test_rounding_moves_mass_and_loses_none(spark):
    """Sums stay within one document, whatever the seed, and each document is taken as often as its fraction says, large or small."""
    units = spark.range(2000).selectExpr("concat('s', id % 2) as source", "1 + id % 9 as size", "0.1 + 0.2 * (id % 5) as p", "xxhash64(id) as u", "struct(id) as id").withColumn("p", F.col("p").cast("double"))
    want = {r.source: r.t for r in units.groupBy("source").agg(F.sum(F.col("size") * F.col("p")).alias("t")).collect()}
    taken = collections.Counter()
    for seed in range(6):
        got = mixing.rounded(units, seed, 8).selectExpr("source", "size", "p", "id.id % 5 as k").collect()
        assert len(got) == 2000 and {r.p for r in got} == {0.0, 1.0}
        for s, t in want.items():
            assert abs(sum(r["size"] * r.p for r in got if r.source == s) - t) <= 9
        for r in got:
            taken["p", r.k] += r.p / 2400
            taken["size", r["size"]] += r.p / (6 * 2000 / 9)
    assert all(abs(taken["p", k] - 0.1 - 0.2 * k) < 0.04 for k in range(5)) and all(abs(taken["size", k] - 0.5) < 0.05 for k in range(1, 10))


def test_sharding(docs, odd, none):
    for frame in (docs, odd):
        out = shard.shuffled(frame, 8, bins_per_shard=3)
        got = out.collect()
        assert out.columns == [c for c in frame.columns if c not in ("shard", "slot")] + ["shard", "slot"]
        sizes = collections.Counter(r.shard for r in got)
        counts = [sizes[s] for s in range(8)]
        assert sum(counts) == frame.count() and max(counts) - min(counts) <= 1
        for s in range(8):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
        key = lambda r: (str(r.doc_id), str(r.text))
        assert sorted(map(key, got)) == sorted(map(key, frame.collect()))
    assert shard.shuffled(none).collect() == []


def test_sharding_is_uniform(spark):
    frame = spark.range(0, 400, 1, 5)
    seen = collections.Counter(r.shard for seed in range(12) for r in shard.shuffled(frame, 4, seed=seed).where("id < 40").collect())
    assert sum(seen.values()) == 480 and all(80 < seen[s] < 160 for s in range(4))


def later_copies(rows, run, size):
    """Lines of maximal runs that stood earlier, by comparing all pairs of lines."""
    lines = [(i, k, t.split("\n")) for k, (i, t, *_) in enumerate(rows) if t is not None]
    lines.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    gone = collections.defaultdict(set)
    for y, (_, k, own) in enumerate(lines):
        for p in range(len(own)):
            for x in range(y + 1):
                other = lines[x][2]
                for q in range(p if x == y else len(other)):
                    n = 0
                    while p + n < len(own) and q + n < len(other) and own[p + n] == other[q + n]:
                        n += 1
                    if n and (n >= run or (size is not None and sum(len(z.encode()) for z in own[p : p + n]) >= size)):
                        gone[k] |= set(range(p, p + n))
    return gone


def test_line_runs(docs, rows, odd, none):
    gone = later_copies(rows, 3, 150)
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    for k, (i, text, *_) in enumerate(rows):
        r, runs = got[i], sum(1 for p in gone[k] if p - 1 not in gone[k])
        assert (r.n_lines, r.n_removed, r.n_runs, set(r.removed)) == (0 if text is None else len(text.split("\n")), len(gone[k]), runs, gone[k])
        assert r.text == (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[k]))
    assert sum(map(len, gone.values())) > 5
    wide = linededup.deduplicated(odd)
    assert wide.count() == odd.count() and wide.columns[:4] == odd.columns[:4] and wide.where("at <> 7 or key <> 7").isEmpty()
    assert linededup.deduplicated(none).collect() == []


def test_line_runs_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "x" * 200), (1, "x" * 200), (None, "x" * 200 + "\nshort"), (None, "short\nshort\nshort\nshort"), (2, "short")]
    frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in linededup.deduplicated(frame).collect())
    assert got == [("1", 1, 0), ("1", 1, 1), ("2", 1, 0), ("None", 2, 1), ("None", 4, 4 if later_copies(rows, 3, 150)[3] == {0, 1, 2, 3} else len(later_copies(rows, 3, 150)[3]))]


@pytest.mark.parametrize(("run", "size"), [(1, None), (2, 40), (5, None), (5, 60), (7, 25)])
def test_line_runs_of_other_lengths(docs, rows, run, size):
    gone = later_copies(rows, run, size)
    got = {r.doc_id: set(r.removed) for r in linededup.deduplicated(docs, run, size).collect() if r.removed}
    assert got == {rows[k][0]: g for k, g in gone.items() if g}


def test_toxicity(spark, none):
    bad = ["dolt", "fool", "pest"]
    rows, labels = [], []
    for i in range(900):
        w = prose(40).split(" ")
        if i % 3 == 0:
            w[random.randrange(40)] = random.choice(bad)
        rows.append((i, " ".join(w), ["en", "fr"][i % 2], "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(900, None, None, None), (901, "", None, None), (902, prose(20_000), "de", None)]
    labels += [(None, 1, 1), (5000, 1, 1), (3, None, None), (6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    out = docs.select("doc_id", toxicity.scores(model, spark)("text").alias("s"), (toxicity.held_out() == 0).alias("h")).collect()
    held = [(r.s, r.doc_id % 3 == 0) for r in out if r.h and r.doc_id < 900]
    assert sum((s >= 0.5) == t for s, t in held) / len(held) > 0.95
    assert all(0 <= r.s <= 1 for r in out) and {r.s for r in out if r.doc_id in (900, 901)} == {min(r.s for r in out if r.doc_id in (900, 901))}
    assert set(model.thresholds) == {"", "en", "fr"} and len(set(model.thresholds.values())) == 3 and all(0.05 < t < 0.95 for t in model.thresholds.values())
    kept = toxicity.clean(docs.withColumn("cut", F.lit(1)), marks)
    assert kept.columns == [*docs.columns, "cut"] and 580 < kept.count() < 640
    assert toxicity.judged(docs, marks.limit(0)).where("rejected").count() == 0
    assert toxicity.judged(none, marks).collect() == []


def test_thresholds_follow_their_language(spark):
    """Where the same score means less in one language, that language's cut is higher."""
    import numpy as np

    rng, y = np.random.default_rng(1), np.tile([0.0, 1.0], 150)
    score = np.where(y > 0, 0.8, 0.4) + rng.normal(0, 0.02, 300)
    shifted, ones = score - 0.25, np.ones(300)
    base = toxicity.threshold(np.r_[score, shifted], np.r_[y, y], np.ones(600), 0.5)
    high, low = toxicity.threshold(score, y, ones, base), toxicity.threshold(shifted, y, ones, base)
    assert 0.5 < high < 0.7 and 0.25 < low < 0.45
    assert toxicity.threshold(score, ones, ones, base) == base


def test_forward_pass_against_a_plain_loop():
    import numpy as np

    rng, model = np.random.default_rng(2), toxicity.Model(3)
    rows = rng.integers(0, 50, 60)
    model.table[:50] = rng.normal(size=(50, toxicity.EMBED))
    at = np.array([0, 1, 1, 3, 20, 60])
    got = model.pooled(at, rows)[0]
    for d in range(len(at) - 1):
        words = [model.table[r] for r in rows[at[d] : at[d + 1]]]
        want = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                values = [sum(words[p + i] @ model.filters[w][i][:, f] for i in range(w)) for p in range(len(words) - w + 1)]
                want.append(max([0.0, *values]))
        assert np.allclose(got[d], want, atol=1e-4)


def test_wider_filters_learn_word_pairs():
    """A pair of words that are both common alone: only filters of two words and more can tell."""
    import numpy as np

    rng = np.random.default_rng(4)
    docs, y = [], np.arange(1200) % 2.0
    for t in y:
        d = rng.integers(10, 60, 30)
        d[[3, 9, 15]], d[[6, 12, 21]] = 1, 2
        if t:
            d[[17, 18]] = 1, 2
        docs.append(d)
    model = toxicity.Model(5)
    model.fit(docs[:900], y[:900], epochs=30)
    right = [(model.score(np.array([0, 30]), d)[0] >= 0.5) == (t > 0) for d, t in zip(docs[900:], y[900:], strict=True)]
    assert np.mean(right) > 0.9


def test_toxicity_odd_rows(spark, odd):
    marks = spark.createDataFrame([(i * 3, i % 2) for i in range(20)] * 2, "doc_id long, toxic int")
    wide = toxicity.judged(odd.withColumn("Rejected", F.lit(1)), marks)
    assert wide.columns == [*(c for c in odd.columns if c != "toxicity"), "toxicity", "rejected"] and wide.count() == odd.count()
    kept = toxicity.clean(odd, marks)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_one_row_of_a_repeated_id_is_learned_from(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "bad word")] * 2000 + [(2, "good word"), (3, "x" * 3000)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "MAX_BYTES", 1000)
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, x, y: sizes.append(len(x)))
    toxicity.train(docs, marks, max_per_class=5)
    assert max(sizes) == 2


def test_all_labels_are_learned(spark):
    """Over 1,500 labelled documents of each class, in shards, and a text of over 1 MB: every word gets its row, whatever the partitions."""
    import numpy as np

    rows = [(i, f"own{i} some words {['fine', 'dolt'][i % 2]}", "en") for i in range(4200)] + [(4201, "giant " + "padding " * 150_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int")
    model, again = toxicity.train(docs, marks), toxicity.train(docs.repartition(7), marks.repartition(3))
    assert np.array_equal(model.layers, again.layers) and np.array_equal(model.table.values, again.table.values) and model.thresholds == again.thresholds
    zeros = [i for i, text, _ in rows if zlib.crc32(str(i).encode()) % 5 and not model.table[_row_of(text.split(" ")[0])].any()]
    assert zeros == []
    out = docs.where(toxicity.held_out() == 0).select("doc_id", toxicity.scores(model, spark)("text").alias("s")).collect()
    assert all((r.s >= model.thresholds["en"]) == (r.doc_id % 2 == 1) for r in out if r.doc_id < 4200)


def test_one_model_at_a_time_passes_the_driver(spark, monkeypatch):
    """What is sent holds one embedding table; without thresholds only the last model is trained, to the same numbers."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"some words own{i % 50} {['fine', 'dolt'][i % 2]}", "en") for i in range(300)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    sent, kind = [], type(spark.sparkContext)
    send = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, x: sent.append(x[1].shape) or send(self, x))
    full = toxicity.train(docs, marks)
    assert set(sent) == {(len(full.table.values) - 1, toxicity.EMBED)} and len(sent) == (toxicity.FOLDS + 1) * toxicity.ROUNDS + toxicity.FOLDS
    sent.clear()
    only = toxicity.train(docs, marks, cuts=False)
    assert len(sent) == toxicity.ROUNDS and only.thresholds == {"": 0.5} and set(full.thresholds) == {"", "en"}
    assert np.array_equal(full.layers, only.layers) and np.array_equal(full.table.values, only.table.values)


def test_labelled_texts_move_once(spark, tmp_path):
    """Texts without labels stay where they are, those with labels go through one exchange; repeated ids, null ids and texts as before."""
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(7, "text 8", "de"), (7, "text 8", "fr"), (None, "text", "en"), (3001, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    known = spark.createDataFrame([(i, i % 2) for i in [*range(0, 3000, 100), 7, 3001]], "doc_id long, toxic int")
    out = toxicity.dealt(docs, known, 3, 5)
    got = out.withColumn("p", F.spark_partition_id()).collect()
    want = {(i, i % 2, "en", f"text {i}") for i in range(0, 3000, 100)} | {(7, 1, "fr", "text 8"), (3001, 1, None, None)}
    assert len(got) == len(want) and {(r.doc_id, r.toxic, r.lang, r.text) for r in got} == want
    assert {r.shard for r in got} == {0, 1, 2} and len({(r.shard, r.p) for r in got}) == 3
    moved, rest = [], [out._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            rest.append(node.executedPlan())
        elif name == "ShuffleQueryStageExec":
            rest.append(node.plan())
        else:
            if name == "ShuffleExchangeExec" and "text" in {x.name() for x in (node.output().apply(i) for i in range(node.output().length()))}:
                moved.append(node)
            rest += [node.children().apply(i) for i in range(node.children().length())]
    assert len(moved) == 1


def _row_of(word):
    import numpy as np

    raw = np.frombuffer(word.encode(), np.uint8)
    return int(toxicity.word_rows(raw, np.array([0, len(raw)]))[1][0])


def test_labels_held_out_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "word " * 5) for i in range(50)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    held = {r.doc_id for r in docs.where(toxicity.held_out() == 0).collect()}
    assert held == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}
    only = marks.where(F.col("doc_id").isin(sorted(held)))
    assert float(toxicity.train(docs, only).bias) == float(toxicity.train(docs, marks.limit(0)).bias)
