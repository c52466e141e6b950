import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from staveflow.llm import frames
from staveflow.llm import text as tx
from staveflow.llm import shard
from staveflow.llm.shard import draw, even, hypergeometric, matrix_row

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \t\n.é\x00日-", max_size=40)), max_size=6)


def lowered(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_match_their_patterns(texts):
    for mask, pattern in ((tx.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tx.WORD_BYTE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        raw, off = tx.text_bytes(pa.array(texts, pa.string()))
        doc, h, start = tx.words(raw, off, mask)
        end = tx.word_ends(raw, off, mask)
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, lowered(t))]
        got = [(int(d), tx.LOWER[raw[a:b]].tobytes().decode()) for d, a, b in zip(doc, start, end, strict=True)]
        assert got == want
        by_word = {}
        for (_, w), x in zip(want, h, strict=True):
            assert by_word.setdefault(w, x) == x
        assert len(set(by_word.values())) == len(by_word)


def test_chunks_hold_whole_documents():
    raw, off = tx.text_bytes(pa.array(["a" * 30, None, "b" * 5, "", "c" * 12]))
    parts = list(tx.chunks(raw, off, 16))
    assert [(a, b) for a, b, _, _ in parts] == [(0, 2), (2, 4), (4, 5)] or sum(b - a for a, b, _, _ in parts) == 5
    assert b"".join(p.tobytes() for _, _, p, _ in parts) == raw.tobytes()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(values, w):
    a = np.array(values, np.uint64)
    assert tx.sliding_min(a, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_packing_and_ranges():
    keys = np.sort(tx.mix(np.arange(1000, dtype=np.uint64)))
    assert (frames.unpack48(frames.pack48(keys)) == keys & ~np.uint64(0xFFFF)).all()
    b, cut = frames.split_by_range(keys, 7)
    assert b.tolist() == sorted(set(frames.range_of(keys, 7).tolist())) and cut[-1] == 1000
    assert frames.split_by_range(keys[:0], 7)[1].tolist() == [0]


def test_matrix_rows_add_up():
    counts, bins = [5, 0, 13, 7, 1], even(26, 4)
    before = np.append(0, np.cumsum(counts))
    rows = np.array([matrix_row(p, before, bins, 3) for p in range(5)])
    assert rows.sum(1).tolist() == counts and rows.sum(0).tolist() == bins.tolist() and (rows >= 0).all()
    big = draw(np.array([2_000_000_000, 1_000_000_000, 0]), 1_500_000_000, np.random.default_rng(1))
    assert big.sum() == 1_500_000_000 and (big >= 0).all() and abs(big[0] - 1_000_000_000) < 200_000


def test_draws_past_numpys_limit_follow_the_law(monkeypatch):
    """Against numpy where it can draw, and by mean and spread where it cannot."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((30, 50, 20), (500_000, 400_000, 3_000), (3, 10_000, 500)):
        own, its = np.array([hypergeometric(good, bad, n, rng) for _ in range(8000)]), rng.hypergeometric(good, bad, n, 8000)
        edges = np.unique(np.quantile(np.r_[own, its], np.linspace(0, 1, 11)).round()) - 0.5
        a, b = np.histogram(own, np.append(edges, np.inf))[0], np.histogram(its, np.append(edges, np.inf))[0]
        assert ((a - b) ** 2 / np.maximum(a + b, 1)).sum() < 35
    x = np.array([hypergeometric(10**12, 2 * 10**12, 10**11, rng) for _ in range(4000)], float)
    spread = (1e11 * 2 / 9 * 29 / 30) ** 0.5
    assert abs(x.mean() - 1e11 / 3) < 5 * spread / 4000**0.5 and abs(x.std() / spread - 1) < 0.06
    assert hypergeometric(5, 0, 3, rng) == 3 and hypergeometric(0, 5, 3, rng) == 0
    monkeypatch.setattr(shard, "NUMPY_ROWS", 50)
    seen = np.array([draw(np.array([40, 0, 25, 35]), 30, rng) for _ in range(4000)])
    assert (seen.sum(1) == 30).all() and np.abs(seen.mean(0) - [12, 0, 7.5, 10.5]).max() < 0.2


def test_blocks_grow_with_the_input():
    """Groups times ranges stay under the bytes of the input over the mean block, at any size."""
    for total in (10**9, 10**10, 10**11, 10**12, 10**14):
        group, ranges = frames.layout(total, 8)
        assert group >= frames.GROUP_BYTES and ranges * -(-total // group) <= 1.1 * total / frames.BLOCK_BYTES
    assert frames.layout(10**14, 8)[0] < 400 << 20


def test_row_groups_are_cut_by_bytes():
    texts = ["x" * 10, None, "y" * 500, "z", "", "w" * 90, "v" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    cuts = [[batch], [batch.slice(i, 1) for i in range(len(texts))], [batch.slice(0, 3), batch.slice(3)]]
    got = [[t.column("text").to_pylist() for _, t in frames.grouped(iter(c), 120)] for c in cuts]
    assert got[0] == got[1] == got[2] == [texts[:3], texts[3:6], texts[6:]]
    assert [g for g, _ in frames.grouped(iter([batch]), 120)] == [0, 1, 2] and list(frames.grouped(iter([]), 5)) == []


def test_blocks_of_lists_skip_no_pair(monkeypatch):
    """Against all pairs of each list, for short lists, long ones, and blocks of any size."""
    from staveflow.llm import setjoin

    rng = np.random.default_rng(8)
    tok = np.sort(rng.integers(0, 9, 400)).astype(np.uint64)
    low = rng.integers(5, 60, 400)
    order = np.lexsort((low, tok))
    low, high, left, side = low[order], low[order] + rng.integers(0, 9, 400), rng.integers(1, 60, 400), rng.integers(0, 3, 400)
    fits = lambda i, j: 175 * min(left[i], left[j]) >= 75 * (low[i] + low[j]) and 100 * high[i] >= 75 * low[j] and 100 * high[j] >= 75 * low[i] and (side[i] == 2 or side[i] != side[j])
    want = sorted((i, j) for i in range(400) for j in range(i + 1, 400) if tok[i] == tok[j] and fits(i, j))
    for small, block in ((24, 64), (2, 3), (1000, 8)):
        monkeypatch.setattr(setjoin, "SMALL", small)
        monkeypatch.setattr(setjoin, "BLOCK", block)
        got = [(int(i), int(j)) for a, b in setjoin._fitting(tok, low, high, left, side, 75) for i, j in zip(a, b, strict=True)]
        assert sorted(got) == want and want
