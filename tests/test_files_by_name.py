"""Files by name, documents of any size, pages of PDF documents."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveflow.functions import kernels
from staveflow.plans.page_queries import pdf_bytes
from staveflow.sources import files, large_json, named_files, pdf, sinks
from staveflow.sources.committed import MANIFEST, manifest


def test_labels_are_read_back(spark, tmp_path):
    images = spark.createDataFrame([("a",), ("b c",), ("é%20+x",)], "image string")
    rows = [("a", 2, 0.5, 0.5, 0.25, 0.125), ("a", 1, 0.1, 0.2, 0.3, 0.4), ("é%20+x", 7, 0.0, 1.0, 0.000001, 0.5)]
    lines = sinks.label_lines(images, spark.createDataFrame(rows, "image string, class_id int, xc double, yc double, w double, h double"))
    path = str(tmp_path / "labels")
    sinks.write_labels(lines.repartition(3), path)
    assert {p.name for p in (tmp_path / "labels").iterdir()} == {"a.txt", "b c.txt", "é%20+x.txt", MANIFEST} and (tmp_path / "labels" / "b c.txt").read_bytes() == b""
    got = sorted((r.image, r.class_id, r.xc, r.yc, r.w, r.h) for r in files.yolo_labels(spark, path).collect())
    assert got == sorted(rows)
    with pytest.raises(Exception, match="already"):
        sinks.write_labels(lines.limit(1), path)
    sinks.write_labels(lines.where("image = 'a'"), path, "overwrite")
    assert [x["file"] for x in manifest(path)] == ["a.txt"] and {p.name for p in (tmp_path / "labels").iterdir()} == {"a.txt", MANIFEST}


@pytest.mark.parametrize("names", [["a", "a"], ["../x"], ["/etc/x"], [None], ["_manifest.jsonl"]])
def test_all_files_or_none(spark, tmp_path, names):
    frame = spark.createDataFrame([("good", "x"), *((n, "y") for n in names)], "file string, content string").repartition(2)
    with pytest.raises(Exception):
        named_files.write(frame, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or all(x.name.startswith("_temporary-") for x in (tmp_path / "out").iterdir())


def test_crops_and_renderings(spark, tmp_path):
    rng = np.random.default_rng(1)
    gray = {n: rng.integers(0, 256, (30, 41)).astype(np.uint8) for n in "ab"}
    pages = spark.createDataFrame([(n, 41, 30, bytearray(g.tobytes())) for n, g in gray.items()] + [("none", None, None, None)], "name string, width int, height int, pixels binary")
    boxes = [("a", f"c{k}", k, 2 * k, 7, 9) for k in range(14)] + [("b", "over", 35, -4, 20, 10), ("b", "out", 100, 100, 5, 5), ("gone", "x", 0, 0, 1, 1)]
    crops = kernels.page_crops(pages, spark.createDataFrame(boxes, "name string, crop_id string, x int, y int, w int, h int"))
    sinks.write_crops(crops, str(tmp_path / "crops"))
    sinks.write_images(pages, str(tmp_path / "pages"))
    for n, g in gray.items():
        assert files.decode_png((tmp_path / "pages" / f"{n}.png").read_bytes()) == (41, 30, g.tobytes())
    for n, c, x, y, w, h in boxes[:15]:
        width, height, raw = files.decode_png((tmp_path / "crops" / n / f"{c}.png").read_bytes())
        assert (np.frombuffer(raw, np.uint8).reshape(height, width) == gray[n][max(0, y) : y + h, x : x + w]).all()
    assert len(list((tmp_path / "crops").rglob("*.png"))) == 15
    plan = crops._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") > plan.index("MapInPandas") and "collect_list" in plan  # boxes go to pages


@pytest.mark.parametrize("kind", ["area", "linear", "cubic", "nearest"])
def test_resampling_against_loops(kind):
    rng = np.random.default_rng(2)
    for old, new in (((5, 7), (3, 4)), ((6, 4), (6, 4)), ((3, 5), (8, 11)), ((9, 2), (1, 1)), ((1, 1), (4, 3)), ((8, 8), (3, 8))):
        gray = rng.integers(0, 256, old).astype(np.uint8)

        def weight(far):
            if kind == "linear":
                return max(0.0, 1 - far)
            a = -0.75
            return (a + 2) * far**3 - (a + 3) * far**2 + 1 if far <= 1 else a * far**3 - 5 * a * far**2 + 8 * a * far - 4 * a if far < 2 else 0.0

        def parts(n, m, i):
            if kind == "area":
                low, high = i * n / m, (i + 1) * n / m
                return [(j, max(0.0, min(j + 1, high) - max(j, low)) / (n / m)) for j in range(n)]
            at = (i + 0.5) * n / m - 0.5
            if kind == "nearest":
                return [(min(n - 1, int((i + 0.5) * n / m)), 1.0)]
            return [(min(max(j, 0), n - 1), weight(abs(at - j))) for j in range(int(np.floor(at)) - 3, int(np.floor(at)) + 5)]

        want = [[sum(gray[j, k] * u * v for j, u in parts(old[0], new[0], y) for k, v in parts(old[1], new[1], x)) for x in range(new[1])] for y in range(new[0])]
        got = kernels.resampled(gray, new[1], new[0], kind)
        assert np.abs(got - np.clip(want, 0, 255)).max() <= 0.5 + 1e-6


def made_document(rng, entries):
    box = lambda: [float(rng.randint(0, 99)) for _ in range(rng.choice([4, 4, 4, 3]))]
    return {
        "info": {"note": 'a "quoted\\" \\\\ {brace', "list": [1, [2, {"x": "]"}]]},
        "version": "annotations: not this",
        "images": [{"id": str(i), "filename": f"p,{i}.png", "width": 10 * i, "height": 7} for i in range(entries // 5)],
        "annotations": {f"a\"{i}": {"cat_id": rng.choice([["6"], [None, "7"], [], ["", "9"]]), "img_id": str(i % 9), "a_bbox": box(), "area": i / 2, "comments": "é\\\"},{" * (i % 3)} for i in range(entries)},
        "categories": {str(i): {"name": f"n{i}", "color": i} for i in range(10)},
    }


def test_documents_of_any_size(spark, tmp_path):
    rng = random.Random(5)
    for k, (how, entries) in enumerate((({}, 200), ({"indent": 2}, 60), ({"separators": (",", ":"), "ensure_ascii": False}, 333))):
        (tmp_path / f"set_{k}.json").write_text(json.dumps(made_document(rng, entries), **how))
    (tmp_path / "set_9.json").write_text("{}")
    whole = files.annotation_json(spark, str(tmp_path / "*.json"))
    rows = lambda f: sorted(map(str, f.collect()))
    want = [rows(files.annotations(whole)), rows(files.annotations(whole, excluded=["7"])), rows(files.images(whole)), rows(files.categories(whole))]
    assert len(want[0]) > 100
    for size in (100, 977, 1 << 20):
        parts = files.annotation_members(spark, str(tmp_path / "*.json"), size)
        got = [rows(files.member_annotations(parts)), rows(files.member_annotations(parts, excluded=["7"])), rows(files.member_images(parts)), rows(files.member_categories(parts))]
        assert got == want


def test_members_wherever_ranges_and_blocks_end(monkeypatch):
    import io

    rng = random.Random(8)

    def value(depth=0):
        kind = rng.random()
        if kind < 0.3 or depth > 2:
            return rng.choice([1, -2.5, None, True, 'a"b\\', "{[,]}", 'é\\"', "", "\\\\", "x:y", ',"k":'])
        if kind < 0.65:
            return {rng.choice(["k", 'a"', "\\", ":", ",{", "é"]) + str(i): value(depth + 1) for i in range(rng.randint(0, 4))}
        return [value(depth + 1) for _ in range(rng.randint(0, 4))]

    for _ in range(150):
        doc = {rng.choice(["annotations", 'cat"s', "x\\", "é"]) + str(i): rng.choice([value(), {str(j): value() for j in range(4)}, [value() for _ in range(4)], "s:"]) for i in range(rng.randint(0, 5))}
        data = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        monkeypatch.setattr(large_json, "BLOCK_BYTES", rng.choice([1, 3, 7, 50, 1000]))
        step, quoted, depth, section, got = rng.choice([1, 2, 13, 40, 10**6]), 0, 0, None, []
        for lo in range(0, len(data), step):
            hi, file = min(len(data), lo + step), io.BytesIO(data)
            got += [(s, k, json.loads(v)) for s, k, v in large_json._members(file, lo, hi, len(data), quoted, depth, section)]
            n, outside, inside = large_json._counted(file, lo, hi, len(data))
            for at, _, borders in large_json._borders(file, lo, len(data), quoted, depth, True):
                section = next((x for p, x in reversed(borders) if at + p < hi), section)
                if at >= hi:
                    break
            depth, quoted = depth + (inside if quoted else outside), (quoted + n) % 2
        want = [(s, k, x) for s, v in doc.items() if isinstance(v, dict) for k, x in v.items()] + [(s, None, x) for s, v in doc.items() if isinstance(v, list) for x in v]
        assert sorted(got, key=str) == sorted(want, key=str)


def pdf_of_objects(parts, packed=()):
    """A document with a cross-reference stream; objects of `packed` (numbers) lie in an object stream."""
    out, at = bytearray(b"%PDF-1.5\n%\xe2\xe3\n"), {}
    numbers = sorted(parts)
    holder, xref = max(numbers) + 1, max(numbers) + 2
    body = [(n, parts[n]) for n in packed]
    starts = np.cumsum([0, *(len(b) + 1 for _, b in body)])
    index = " ".join(f"{n} {s}" for (n, _), s in zip(body, starts, strict=False)).encode() + b" "
    data = zlib.compress(index + b" ".join(b for _, b in body))
    stream = f"<< /Type /ObjStm /N {len(body)} /First {len(index)} /Filter /FlateDecode /Length {len(data)} >>\nstream\r\n".encode() + data + b"\r\nendstream"
    for n, part in [*((n, parts[n]) for n in numbers if n not in packed), (holder, stream)]:
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + part + b"\nendobj\n"
    at[xref] = len(out)
    rows = []
    for n in range(xref + 1):
        one = (2, holder, list(packed).index(n)) if n in packed else (1, at[n], 0) if n in at else (0, 0, 255)
        rows.append(one[0].to_bytes(1, "big") + one[1].to_bytes(4, "big") + one[2].to_bytes(1, "big"))
    raw, above = b"", bytes(6)
    for r in rows:  # the "up" predictor
        raw, above = raw + b"\x02" + bytes((x - y) % 256 for x, y in zip(r, above, strict=True)), r
    data = zlib.compress(raw)
    out += f"{xref} 0 obj\n<< /Type /XRef /W [1 4 1] /Size {xref + 1} /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length {len(data)} >>\nstream\n".encode() + data + f"\nendstream\nendobj\nstartxref\n{at[xref]}\n%%EOF".encode()
    return bytes(out)


def stream(head, data):
    data = zlib.compress(data)
    return f"<< /Subtype /Image /Filter /FlateDecode /Length {len(data)} {head} >>\nstream\n".encode() + data + b"\nendstream"


def test_pdf_pages(spark, tmp_path):
    rng = np.random.default_rng(3)
    gray = [rng.integers(0, 256, (12 + k, 9)).astype(np.uint8) for k in range(20)]
    (tmp_path / "long.pdf").write_bytes(pdf_bytes([(9, 12 + k, g.tobytes()) for k, g in enumerate(gray)]))
    (tmp_path / "bad.PDF").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "cut.pdf").write_bytes(pdf_bytes([(9, 12, gray[0].tobytes())])[:-120])
    (tmp_path / "note.txt").write_text("no")
    got = {(r.doc, r.page): r for r in pdf.pdf_pages(spark, str(tmp_path), pages_per_task=3).collect()}
    for k, g in enumerate(gray):
        r = got["long.pdf", k + 1]
        assert (r.width, r.height, bytes(r.pixels), r.name, r.error) == (9, 12 + k, g.tobytes(), f"long-{k + 1:04d}", None)
    assert got["bad.PDF", None].error and got["cut.pdf", None].error and len(got) == 22
    some = pdf.pdf_pages(spark, str(tmp_path / "long.pdf"), "2-4, 19,40", pages_per_task=2)
    assert sorted(r.page for r in some.select("page").collect()) == [2, 3, 4, 19]
    big = pdf.pdf_pages(spark, str(tmp_path / "long.pdf"), "1", dpi=144).first()
    assert (big.width, big.height) == (18, 24) and bytes(big.pixels) == kernels.scaled(gray[0], 18, 24).tobytes()


def test_only_what_a_page_needs_is_read(tmp_path):
    import io

    gray = [np.random.default_rng(k).integers(0, 256, (200, 300)).astype(np.uint8) for k in range(30)]
    data = pdf_bytes([(300, 200, g.tobytes()) for g in gray])
    doc = pdf.Document(io.BytesIO(data), len(data))
    assert doc.page_count() == 30 and (doc.gray(17) == gray[16]).all() and doc.read < len(data) / 5


def test_kinds_of_pdf_images():
    import io

    rng = np.random.default_rng(4)
    mask, colour, index = rng.integers(0, 2, (7, 13)), rng.integers(0, 256, (6, 5, 3)).astype(np.uint8), rng.integers(0, 4, (4, 6))
    up = np.concatenate([np.full((6, 1), 2, np.uint8), np.diff(colour.reshape(6, 15), axis=0, prepend=np.zeros((1, 15), np.uint8))], 1).astype(np.uint8)
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    two = np.packbits(((index[:, :, None] >> np.array([1, 0])) & 1).reshape(4, -1).astype(np.uint8), axis=1)
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R 4 0 R] /Count 5 /MediaBox [0 0 72 72] >>", 3: b"<< /Kids [5 0 R 6 0 R] /Count 2 /Rotate 90 >>", 4: b"<< /Kids [7 0 R 8 0 R 13 0 R] /Count 3 >>",
        5: b"<< /Resources << /XObject << /A 9 0 R /B 12 0 R >> >> >>", 6: b"<< /Rotate 0 /Resources << /XObject << /A#20x 10 0 R >> >> >>", 7: b"<< /Resources 14 0 R >>", 8: b"<< /Resources << >> >>", 13: b"<< /Resources << /XObject << /J 15 0 R >> >> >>", 14: b"<< /XObject << /A 11 0 R >> >>",
        9: stream("/Width 13 /Height 7 /BitsPerComponent 1 /ColorSpace /DeviceGray /Decode [1 0]", np.packbits(mask.astype(np.uint8), axis=1).tobytes()),
        10: stream("/Width 5 /Height 6 /BitsPerComponent 8 /ColorSpace /DeviceRGB /DecodeParms << /Predictor 15 /Colors 3 /Columns 5 >>", up.tobytes()),
        11: stream(f"/Width 6 /Height 4 /BitsPerComponent 2 /ColorSpace [/Indexed /DeviceRGB 3 <{palette.tobytes().hex()}>]", two.tobytes()),
        12: stream("/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray", b"\x00"), 15: b"<< /Subtype /Image /Width 9 /Height 9 /Filter /DCTDecode /Length 3 >>\nstream\nabc\nendstream",
    }
    data = pdf_of_objects(parts, packed=(2, 3, 5, 7, 14))
    doc = pdf.Document(io.BytesIO(data), len(data))
    light = lambda rgb: (rgb.astype(float) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)
    assert (doc.gray(1) == np.rot90(255 - mask * 255, -1)).all()
    assert (doc.gray(2) == light(colour)).all() and (doc.gray(3) == light(palette)[index]).all()
    for page, says in ((4, "no image"), (5, "DCTDecode"), (6, "no page")):
        with pytest.raises(ValueError, match=says):
            doc.gray(page)
    assert pdf.value(rb"(a\(b\)(c)\101\n\q) ", 0)[0] == b"a(b)(c)A\nq" and pdf.value(b"<48 656C6> ", 0)[0] == b"Hel`"


def test_a_file_of_pieces(spark, tmp_path):
    rows = [("a/x.txt", 2, "c"), ("y.txt", 1, ""), ("a/x.txt", 0, "a"), ("a/x.txt", 1, "b" * 9)]
    named_files.write_pieces(spark.createDataFrame(rows, "file string, part int, content string").repartition(3), str(tmp_path / "out"))
    assert (tmp_path / "out/a/x.txt").read_text() == "a" + "b" * 9 + "c" and (tmp_path / "out/y.txt").read_text() == ""


def test_annotation_documents_are_made_in_parts_of_bounded_size(spark, monkeypatch):
    """With parts of 50 orders no row holds more than 50 orders' lines; the documents together hold every line once."""
    from staveflow.plans import page_queries

    small = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, page_queries.annotation_scan(spark, small).collect()), key=str)
    monkeypatch.setattr(page_queries, "PART_ORDERS", 50)
    held = page_queries._documents(spark, small).selectExpr("length(value) - length(replace(value, 'img_id', 'img_i')) AS n").collect()
    assert len(held) > 100 and max(r.n for r in held) <= 10 * 7
    assert sorted(map(tuple, page_queries.annotation_scan(spark, small).collect()), key=str) == whole
    assert sorted(map(tuple, page_queries.large_annotation_scan(spark, small).collect()), key=str) == whole


def test_a_range_reads_little_beyond_itself(tmp_path):
    data = json.dumps({"annotations": {str(i): {"v": i} for i in range(200_000)}}).encode()
    (tmp_path / "d.json").write_bytes(data)
    with open(tmp_path / "d.json", "rb") as file:
        blocks = iter(large_json._Blocks(file, 1000, len(data), 51_000))
        sizes = [len(next(blocks)[1]) for _ in range(3)]
    assert sizes == [50_000, large_json.BEYOND_BYTES, large_json.BEYOND_BYTES]
