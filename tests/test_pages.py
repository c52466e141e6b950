import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveflow.functions import kernels
from staveflow.operators import validation
from staveflow.plans import dataset, pages
from staveflow.sources import detectors, files


def png(rows, depth=8, colour=0, filters=None, palette=None):
    """A PNG of rows of samples, each line with a filter of its own."""
    height, width = rows.shape[:2]
    channels = 1 if rows.ndim == 2 else rows.shape[2]
    if depth == 16:
        lines = np.stack([rows.astype(np.uint8), np.full_like(rows, 7, np.uint8)], -1).reshape(height, -1)
    elif depth == 8:
        lines = rows.astype(np.uint8).reshape(height, -1)
    else:
        bits = (rows.reshape(height, width, 1) >> np.arange(depth - 1, -1, -1)) & 1
        lines = np.packbits(bits.reshape(height, -1).astype(np.uint8), axis=1)
    step, raw, above = max(1, channels * depth // 8), b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines.astype(int)):
        kind = (filters or [0])[y % len(filters or [0])]
        left, corner = np.r_[np.zeros(step, int), line[:-step]], np.r_[np.zeros(step, int), above[:-step]]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        raw += bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    if palette is not None:
        out += chunk(b"PLTE", palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decoded(content):
    w, h, raw = files.decode_image(content)
    return np.frombuffer(raw, np.uint8).reshape(h, w)


def test_png_kinds():
    rng = np.random.default_rng(1)
    gray = rng.integers(0, 256, (11, 17))
    every = [0, 1, 2, 3, 4]
    assert (decoded(png(gray, filters=every)) == gray).all() and (decoded(png(gray, 16, filters=every)) == gray).all()
    for depth in (1, 2, 4):
        few = rng.integers(0, 1 << depth, (5, 13))
        assert (decoded(png(few, depth)) == few * 255 // ((1 << depth) - 1)).all()
    colour = rng.integers(0, 256, (6, 5, 3))
    want = (colour @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)
    assert (decoded(png(colour, colour=2, filters=every)) == want).all()
    assert (decoded(png(np.dstack([colour, rng.integers(0, 256, (6, 5, 1))]), colour=6, filters=every)) == want).all()
    assert (decoded(png(np.dstack([gray, gray]), colour=4, filters=[4, 3])) == gray).all()
    palette, index = rng.integers(0, 256, (4, 3)), rng.integers(0, 4, (5, 9))
    assert (decoded(png(index, 2, 3, palette=palette)) == (palette @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)[index]).all()
    whole = png(gray, filters=every)
    for bad in (whole[:40], whole[:-30], b"\x89PNG", png(gray, 8, 5), whole.replace(b"IDAT", b"XDAT")):
        with pytest.raises((ValueError, struct.error)):
            files.decode_image(bad)


def plain_filters(rows, step):
    """The bytes of filtered lines, one by one."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), int)
    for y, row in enumerate(rows.astype(int)):
        for x, v in enumerate(row[1:]):
            a, b, c = (out[y + 1, x - step] if x >= step else 0), out[y, x], (out[y, x - step] if x >= step else 0)
            near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
            out[y + 1, x] = (v + [0, a, b, (a + b) // 2, near][row[0]]) % 256
    return out[1:]


def test_filters_along_diagonals():
    rng = np.random.default_rng(6)
    for kinds in ([4], [3], [0, 1, 2], [0, 1, 2, 3, 4], [2, 2, 2, 4, 1], [3, 0, 4]):
        for step, pixels, lines in ((1, 1, 1), (1, 23, 40), (3, 9, 14), (4, 5, 30), (2, 1, 9), (6, 4, 3)):
            rows = rng.integers(0, 256, (lines, 1 + step * pixels)).astype(np.uint8)
            rows[:, 0] = rng.choice(kinds, lines)
            assert (files._unfiltered(rows, step) == plain_filters(rows, step)).all()


    with pytest.raises(ValueError, match="filter"):
        files._unfiltered(np.full((1, 4), 5, np.uint8), 1)


def interlaced(gray, depth=8):
    """A gray PNG in the seven passes of Adam7."""
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
    raw = b""
    for x, y, dx, dy in passes:
        part = gray[y::dy, x::dx]
        if part.size:
            bits = (part[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
            for line in np.packbits(bits.reshape(part.shape[0], -1).astype(np.uint8), axis=1):
                raw += b"\x00" + line.tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], depth, 0, 0, 0, 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_interlaced():
    rng = np.random.default_rng(7)
    for shape in ((1, 1), (3, 2), (8, 8), (9, 17), (33, 5)):
        gray = rng.integers(0, 256, shape)
        assert (decoded(interlaced(gray)) == gray).all()
        few = rng.integers(0, 4, shape)
        assert (decoded(interlaced(few, 2)) == few * 85).all()


def plain_strokes(mask, votes, min_length, max_gap, tolerance):
    """The line search stated plainly: all votes counted anew for each line."""
    left, (height, width), out = set(zip(*np.nonzero(mask), strict=True)), mask.shape, []
    angles = sorted(range(-tolerance, tolerance + 1), key=lambda a: (abs(a), a))
    shift = {a: [int(np.rint(np.tan(np.radians(a)) * (y - height // 2))) for y in range(height)] for a in angles}
    while True:
        n, i, x = max((sum((y, x + shift[a][y]) in left for y in range(height)), -i, -x) for i, a in enumerate(angles) for x in range(width))
        if n < max(1, votes):
            return sorted(out)
        a, x = angles[-i], -x
        on = [y for y in range(height) if (y, x + shift[a][y]) in left]
        parts = [[on[0], on[0]]]
        for y in on[1:]:
            if y - parts[-1][1] - 1 <= max_gap:
                parts[-1][1] = y
            else:
                parts.append([y, y])
        out += [(x + shift[a][p], p, x + shift[a][q], q) for p, q in parts if q - p + 1 >= min_length]
        left -= {(y, x + shift[a][y]) for y in on}


def test_votes_taken_back_are_votes_counted_anew():
    rng = np.random.default_rng(3)
    for _ in range(25):
        mask = rng.random((int(rng.integers(1, 26)), int(rng.integers(1, 30)))) < rng.choice([0.1, 0.3, 0.6])
        votes, length, gap, tolerance = (int(rng.integers(*r)) for r in ((1, 6), (1, 7), (0, 4), (0, 25)))
        assert kernels.line_segments(mask, votes, length, gap, tolerance) == plain_strokes(mask, votes, length, gap, tolerance)
        angles, table = kernels.line_votes(mask, tolerance)
        for k in rng.integers(0, len(angles), 5):
            x = int(rng.integers(0, mask.shape[1]))
            at = [x + int(np.rint(np.tan(np.radians(angles[k])) * (y - mask.shape[0] // 2))) for y in range(mask.shape[0])]
            assert table[k, x] == sum(mask[y, c] for y, c in enumerate(at) if 0 <= c < mask.shape[1])


def test_openings_closings_and_bits():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = rng.random((int(rng.integers(1, 20)), int(rng.integers(1, 40)))) < 0.7
        length = int(rng.integers(1, 8))
        opened, closed = np.zeros_like(mask), mask.copy()
        for y in range(mask.shape[0]):
            for a, b in kernels.runs(mask[y]):
                opened[y, a : b + 1] = b - a + 1 >= length
        for x in range(mask.shape[1]):
            found = kernels.runs(mask[:, x])
            for (_, a), (b, _) in zip(found[:-1], found[1:], strict=True):
                closed[a + 1 : b, x] |= b - a - 1 < length
        assert (kernels.opened_rows(mask, length) == opened).all() and (kernels.closed_columns(mask, length) == closed).all()
        assert (kernels.unpacked_mask(kernels.packed_mask(mask), *mask.shape[::-1]) == mask).all()


def test_straight_strokes():
    mask = np.zeros((120, 200), bool)
    mask[10:110, 50] = True
    mask[40:44, 50] = False
    for y in range(10, 110):
        mask[y, 120 + round((y - 60) * np.tan(np.radians(10)))] = True
    mask[60, :] = True
    got = kernels.line_segments(mask, 40, 60, 6)
    upright = [s for s in got if s[0] == s[2]]
    slanted = [s for s in got if s[2] - s[0] > 10]
    assert (50, 10, 50, 109) in upright and any(abs(s[0] - 111) <= 1 and abs(s[2] - 129) <= 1 and s[3] - s[1] > 90 for s in slanted)
    assert kernels.line_segments(mask, 40, 60, 1) != got and kernels.line_segments(mask[:, :0], 1, 1, 1) == []
    assert got == kernels.line_segments(mask.copy(), 40, 60, 6)


def score():
    """Two systems of one group, three barlines through both, one stroke that is no barline, and a bracket."""
    gray = np.full((300, 900), 255, np.uint8)
    for top in (80, 155):
        for i in range(5):
            gray[top + 10 * i, 40:880] = 0
        for x in (100, 400, 700):
            gray[top : top + 41, x : x + 3] = 0
    gray[85:105, 550:552] = 0
    gray[78:199, 20:24] = 0
    for y in (78, 196):
        gray[y : y + 3, 20:34] = 0
    return gray


def test_measures_of_pages(spark):
    gray = score()
    rows = [("a", 900, 300, bytearray(gray.tobytes())), ("b", 900, 300, bytearray(np.full_like(gray, 255).tobytes())), ("c", None, None, None)]
    frame = spark.createDataFrame(rows, "name string, width int, height int, pixels binary")
    got = pages.analysed(frame)
    systems = got["systems"].orderBy("system_idx").collect()
    assert [(s.name, s.top, s.bottom, s.group_idx) for s in systems] == [("a", 80, 120, 0), ("a", 155, 195, 0)]
    single = {(r.system_idx, r.x) for r in got["system_barlines"].collect()}
    for i in (0, 1):
        assert [min(abs(x - w) for j, x in single if j == i) <= 2 for w in (100, 400, 700)] == [True] * 3
    assert not any(545 <= x <= 556 for _, x in single)
    bars = sorted(r.x for r in got["barlines"].collect())
    # the bracket's own line spans both systems too
    assert len(bars) == 4 and all(abs(b - w) <= 3 for b, w in zip(bars, (21, 101, 401, 701), strict=True))
    bracket = got["brackets"].collect()
    assert len(bracket) == 1 and 18 <= bracket[0].x <= 25 and bracket[0].covered_systems == [0, 1]
    measures = got["measures"].orderBy("system_idx", "measure_number").collect()
    assert [(m.system_idx, m.measure_number) for m in measures] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)]
    shares = pages.in_shares(got["measures"], frame).where("system_idx = 0 and measure_number = 2").first().bbox
    assert abs(shares.x - 100 / 900) < 0.01 and abs(shares.width - 300 / 900) < 0.01


def test_no_pixel_is_a_row_and_masks_stay(spark, monkeypatch):
    """Areas and spots move to the masks, which are dealt by name once."""
    monkeypatch.setattr(kernels, "page_pixels", None)
    frame = spark.createDataFrame([("a", 900, 300, bytearray(score().tobytes()))], "name string, width int, height int, pixels binary")
    masks = pages.masks_of_pages(frame)
    systems = pages.systems_of_pages(masks)
    # few pages or questions change nothing: neither side is broadcast, and the masks' partitions stay as they are
    answered = kernels.strokes(masks, pages.search_areas(systems))
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and answered.rdd.getNumPartitions() == masks.rdd.getNumPartitions()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kernels.strokes(masks, pages.search_areas(systems))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("ShuffledHashJoin") :]
    assert "bits" in side and "Exchange" not in side[: side.index("ExistingRDD[name")]  # the masks' side of the join
    assert {r.x for r in pages.analysed(masks)["system_barlines"].collect()} >= {101, 401, 701}


def test_pages_straight_from_files(spark):
    gray = score()
    pgm = b"P5 %d %d 255\n" % gray.shape[::-1] + gray.tobytes()
    frame = spark.createDataFrame([("a", bytearray(png(gray))), ("b", bytearray(pgm)), ("c", bytearray(b"nothing")), ("d", bytearray())], "name string, content binary")
    masks = {r.name: r for r in pages.masks_of_files(frame).collect()}
    assert masks["a"][1:] == masks["b"][1:] and masks["a"].dark > 0 and masks["c"].bits is None and masks["c"].error and masks["d"].error
    got = pages.analysed(frame)
    assert {r.name for r in got["measures"].collect()} == {"a", "b"} and got["brackets"].count() == 2


def test_whole_page_search(spark):
    """Without systems: wide spacing, thin lines; the strict score too."""
    gray = np.full((700, 900), 255, np.uint8)
    for top in (80, 220, 360):
        for i in range(5):
            gray[top + 20 * i : top + 20 * i + 2, 40:880] = 0
        for x in (100, 400, 700):
            gray[top : top + 82, x : x + 3] = 0
    gray[85:125, 550:552] = 0
    frame = spark.createDataFrame([("a", 900, 700, bytearray(gray.tobytes())), ("b", 50, 50, bytearray(b"\xff" * 2500))], "name string, width int, height int, pixels binary")
    masks = pages.masks_of_pages(frame)
    for least in (30, 40):
        assert sorted((r.name, r.x) for r in pages.barlines_of_whole_pages(masks, least=least).collect()) == [("a", 101), ("a", 401), ("a", 701)]
    assert pages.barlines_of_whole_pages(masks, least=101).collect() == []


def test_directory_of_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(score()))
    (tmp_path / "b.png").write_bytes(b"\x89PNG broken")
    (tmp_path / "c.txt").write_text("no image")
    dark = lambda: lambda w, h, px: [(1, px.count(0) / len(px), 0, 0, w, h), (2, 0.1, 0, 0, 1, 1)]
    found, summary = detectors.directory_detections(spark, str(tmp_path), dark, {1: "ink"}, 0.01)
    assert [(r.image, [d.class_name for d in r.detections]) for r in found.collect()] == [("a.png", ["unknown_2", "ink"])]
    assert tuple(summary.first()) == (1, 1, 2)
    detectors.write_detections(found, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().image == "a.png"


def test_scaling():
    gray = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert (kernels.resampled(gray, 4, 3, "area") == np.rint(gray.reshape(3, 2, 4, 2).mean((1, 3)))).all()
    assert (kernels.resampled(gray, 8, 6, "area") == gray).all() and (kernels.resampled(gray, 8, 6, "cubic") == gray).all()
    up = kernels.resampled(np.array([[0, 100]], np.uint8), 4, 1, "linear")[0].tolist()
    assert up == [0, 25, 75, 100]
    small, big = kernels.on_canvas(gray, 0.5, 10, 10), kernels.on_canvas(gray, 3, 10, 10, 0)
    assert small.shape == big.shape == (10, 10) and (small == 255).sum() == 100 - 12 and big.min() > 0


def test_dataset_driver(spark):
    images = spark.createDataFrame([(str(i), f"{i}.png", 200, 100) for i in range(40)], "id string, filename string, width int, height int")
    rows = [(f"a{i}", str(i % 40), ["6"] if i % 3 else ["9"], [5.0, 5.0, 50.0 + i % 7, 60.0] if i % 5 else [5.0, 5.0, 500.0, 60.0]) for i in range(200)]
    ann = spark.createDataFrame(rows, "ann_id string, image_id string, cat_ids array<string>, box array<double>").withColumn("category_id", F.col("cat_ids")[0])
    cats = spark.createDataFrame([("6", "stem"), ("9", "tie")], "id string, name string")
    out = dataset.prepared(ann.drop("category_id"), images, cats, ["tie"], 100)
    kept = [r for i, r in enumerate(rows) if i % 3 and i % 5]
    labels, counts = out["labels"].collect(), {r.split: r for r in out["counts"].collect()}
    assert len(labels) == len(kept) == sum(r.labels for r in counts.values()) and sum(r.images for r in counts.values()) == 40
    assert set(counts) == {"train", "val"} and out["lines"].count() == 40
    assert out["summary"].first().rejected == len([1 for i in range(200) if i % 3 and not i % 5])
    assert dataset.sampled(ann, images, 7, 2).count() == 7
    page = spark.createDataFrame([("a", 40, 20, bytearray(b"\x00" * 800))], "name string, width int, height int, pixels binary")
    fit = dataset.letterboxed_pages(page, 10).first()
    assert (fit.width, fit.height, bytes(fit.pixels).count(b"\xff")) == (10, 10, 50)


def test_letterboxing_leaves_out_pages_of_which_no_pixel_is_left(spark):
    rows = [("thin", 2, 30, bytearray(60)), ("fits", 3, 30, bytearray(90)), ("flat", 30, 2, bytearray(60)), ("square", 5, 5, bytearray(25))]
    page = spark.createDataFrame(rows, "name string, width int, height int, pixels binary")
    assert sorted(r.name for r in dataset.letterboxed_pages(page, 10).collect()) == ["fits", "square"]


def test_grays_of_the_embeddings_are_in_single_precision(spark, tmp_path):
    """-2e-8 * 64 + 128 is 128 in single precision and under it in double."""
    from staveflow.plans import page_queries

    spark.createDataFrame([(1, [-2e-8, 0.5, -3.0], 7)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert list(page_queries._images(spark, str(tmp_path)).first().pixels) == [128, 160, 0]


def test_lines_of_one_degree_are_walked_together(monkeypatch):
    """Every column of five staff lines of three rows has votes enough: that is one step of the search, not one a column."""
    mask = np.zeros((60, 400), bool)
    for y in range(5, 50, 10):
        mask[y : y + 3] = True
    mask[2:50, 100:103] = True
    steps = []
    monkeypatch.setattr(kernels, "divmod", lambda a, b: steps.append(1) or (a // b, a % b), raising=False)
    got = kernels.line_segments(mask, 12, 20, 3)
    assert len(steps) < 40 and (100, 2, 100, 49) in got
    monkeypatch.setattr(kernels, "LINE_PIXELS", 1000)
    assert kernels.line_segments(mask, 12, 20, 3) == got


def test_votes_are_counted_by_runs(monkeypatch):
    """Five staff lines of three rows: runs vote, and those left after the first walk vote anew (a vote a pixel and degree, twice over, before)."""
    mask = np.zeros((108, 700), bool)
    for y in range(22, 86, 15):
        mask[y : y + 3, 40:660] = True
    mask[22:86, 100:103] = True
    votes, plain = [], np.bincount
    monkeypatch.setattr(kernels.np, "bincount", lambda at, *a, **k: (votes.append(len(at)), plain(at, *a, **k))[1])
    got = kernels.line_segments(mask, 12, 20, 3)
    assert (100, 22, 100, 85) in got and sum(votes) < mask.sum() * 41 // 4


def test_rows_leave_tasks_in_lots():
    lots = list(kernels.in_lots(((i, None) for i in range(150)), ["a", "b"], 64))
    assert [len(x) for x in lots] == [64, 64, 22] and list(lots[2].columns) == ["a", "b"] and list(kernels.in_lots([], ["a"])) == []


def test_candidates_stand_in_the_mask_as_over_rows(spark):
    """kernels.standing against validation.valid_on_page over rows of pixels: staffs of four to six lines, strokes of any length and width, gaps, noise, columns off the page."""
    rng = np.random.default_rng(6)
    masks, spots, pixels, staffs = [], [], [], []
    for name in "abcdefgh":
        mask = rng.random((150, 120)) < 0.03
        tops = (20, 90) if name < "e" else (40,)
        lines = [[top + 10 * i for i in range(4 if name == "h" else int(rng.integers(4, 7)))] for top in tops]
        for ys in lines:
            for y in ys:
                mask[y] |= rng.random(120) < 0.9
            for _ in range(12):
                x, w = int(rng.integers(0, 118)), int(rng.integers(1, 12))
                a, b = ys[0] + int(rng.integers(-12, 13)), ys[-1] + int(rng.integers(-12, 13))
                mask[a : b + 1, x : x + w] = True
                mask[a + 15 : a + 15 + int(rng.integers(0, 2)), x : x + w] = False
        masks.append((name, 120, 150, bytearray(kernels.packed_mask(mask))))
        staffs += [(name, i, y) for i, ys in enumerate(lines) for y in ys]
        spots += [(name, x, x, 50, sum(lines, []), lines, 2) for x in range(-2, 123)]
        pixels += [(name, int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)]
    asked = spark.createDataFrame(spots, "name string, id int, x int, score int, lines array<int>, staffs array<array<int>>, margin int")
    got = kernels.standing(spark.createDataFrame(masks, "name string, width int, height int, bits binary"), asked)
    want = validation.valid_on_page(asked.select("name", "id", "x"), spark.createDataFrame(pixels, "name string, x int, y int"), spark.createDataFrame(staffs, "name string, staff int, y int"), ["name"])
    found = {(r.name, r.x) for r in got.collect()}
    assert found == {(r.name, r.x) for r in want.collect()} and 50 < len(found) < 900


def test_system_barlines_alone(spark, monkeypatch):
    """The barlines of systems without brackets, agreement and measures, which analysed() works out too."""
    frame = spark.createDataFrame([("a", 900, 300, bytearray(score().tobytes()))], "name string, width int, height int, pixels binary")
    masks = pages.masks_of_pages(frame)
    want = sorted(map(tuple, pages.analysed(masks)["system_barlines"].collect()))
    for name in ("bracket_areas", "brackets_of_pages"):
        monkeypatch.setattr(pages, name, lambda *a, **k: pytest.fail("brackets"))
    monkeypatch.setattr(pages.mp, "agreed_barlines", lambda *a, **k: pytest.fail("agreement"))
    assert sorted(map(tuple, pages.system_barlines(masks).collect())) == want and len(want) >= 6
