"""File sources; every schema is given, none is inferred."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from ..schemas import ANNOTATIONS_JSON
from . import large_json

#: What decode_image() raises for a file that isn't an image it reads.
DECODE_ERRORS = (ValueError, IndexError, struct.error)


def annotation_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file with maps of images, annotations and categories; shard is the number in its name."""
    rows = spark.read.schema(ANNOTATIONS_JSON).option("multiLine", True).json(paths)
    return with_shard(rows.withColumn("file", F.input_file_name()))


def annotation_documents(documents: DataFrame) -> DataFrame:
    """The same from rows (file, value) that hold whole documents as text."""
    return with_shard(documents.select(F.from_json("value", ANNOTATIONS_JSON).alias("d"), "file").select("d.*", "file"))


def with_shard(files: DataFrame) -> DataFrame:
    return files.withColumn("shard", F.expr(r"try_cast(regexp_extract(file, '([0-9]+)[.]json', 1) as int)"))


def images(files: DataFrame) -> DataFrame:
    return files.select("shard", F.explode("images").alias("i")).select("shard", "i.*")


def categories(files: DataFrame) -> DataFrame:
    return files.select(F.explode("categories").alias("id", "c")).select("id", F.col("c.name").alias("name")).distinct()


def annotations(files: DataFrame, wanted: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(shard, ann_id, image_id, cat_ids, category_id, box, area): null and empty ids are dropped, the first that is left counts."""
    return _annotation_rows(files.select("shard", F.explode("annotations").alias("ann_id", "a")), wanted, excluded)


def _annotation_rows(rows: DataFrame, wanted: list[str] | None, excluded: list[str] | None) -> DataFrame:
    ids = F.filter("a.cat_id", lambda c: c.isNotNull() & (c != ""))
    out = rows.select("shard", "ann_id", F.col("a.img_id").alias("image_id"), ids.alias("cat_ids"), F.try_element_at(ids, F.lit(1)).alias("category_id"), F.col("a.a_bbox").alias("box"), F.col("a.area").alias("area"))
    out = out.where("category_id is not null and size(box) = 4")
    if wanted is not None:
        out = out.where(F.col("category_id").isin(wanted))
    return out if excluded is None else out.where(~F.col("category_id").isin(excluded))


def annotation_members(spark: SparkSession, paths: str | list[str], range_bytes: int = large_json.RANGE_BYTES) -> DataFrame:
    """(file, shard, section, key, value): the members of annotation documents of any size, a row each; no document is ever one row."""
    return with_shard(large_json.members(spark, paths, range_bytes))


def _member_schema(section: str) -> str:
    kind = DataType.fromDDL(ANNOTATIONS_JSON)[section].dataType
    return (kind.elementType if isinstance(kind, ArrayType) else kind.valueType).simpleString()


def member_images(members: DataFrame) -> DataFrame:
    """images() of annotation_members()."""
    return members.where("section = 'images'").select("shard", F.from_json("value", _member_schema("images")).alias("i")).select("shard", "i.*")


def member_categories(members: DataFrame) -> DataFrame:
    """categories() of annotation_members()."""
    return members.where("section = 'categories'").select(F.col("key").alias("id"), F.from_json("value", _member_schema("categories"))["name"].alias("name")).distinct()


def member_annotations(members: DataFrame, wanted: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """annotations() of annotation_members()."""
    rows = members.where("section = 'annotations'").select("shard", F.col("key").alias("ann_id"), F.from_json("value", _member_schema("annotations")).alias("a"))
    return _annotation_rows(rows, wanted, excluded)


def annotation_counters(files: DataFrame, excluded: list[str]) -> DataFrame:
    """One row (total, kept, excluded, without_category, without_box) of all annotations, in one pass."""
    ids = F.filter("a.cat_id", lambda c: c.isNotNull() & (c != ""))
    rows = files.select(F.explode("annotations").alias("ann_id", "a")).select(F.try_element_at(ids, F.lit(1)).alias("c"), (F.coalesce(F.size("a.a_bbox"), F.lit(0)) == 4).alias("boxed"))
    out = F.col("c").isin(excluded)
    count = lambda when: F.count(F.when(when, 1))
    return rows.agg(F.count(F.lit(1)).alias("total"), count(F.col("c").isNotNull() & F.col("boxed") & ~out).alias("kept"), count(out & F.col("boxed")).alias("excluded"), count(F.col("c").isNull()).alias("without_category"), count(F.col("c").isNotNull() & ~F.col("boxed")).alias("without_box"))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """label_numbers() of label files, with the file's name as image; sinks.write_labels writes such files."""
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # it comes percent-encoded
    return label_numbers(spark.read.text(path).select(F.regexp_extract(name, r"(?s)^(.*)\.txt$", 1).alias("image"), "value"))


def label_numbers(lines: DataFrame) -> DataFrame:
    """(image, class_id, xc, yc, w, h, conf) of lines (image, value) of five or six numbers; others are skipped, conf 1.0 where it lacks."""
    rows = lines.select("image", F.split(F.trim("value"), r"\s+").alias("p"))
    num = lambda i, t="double": F.expr(f"try_cast(get(p, {i}) as {t})")
    out = rows.where(F.size("p").isin(5, 6)).select("image", num(0, "int").alias("class_id"), num(1).alias("xc"), num(2).alias("yc"), num(3).alias("w"), num(4).alias("h"), F.coalesce(num(5), F.lit(1.0)).alias("conf"))
    return out.where("class_id is not null and xc is not null and yc is not null and w is not null and h is not null")


def class_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """class_lines() of a file."""
    return class_lines(spark.read.text(path))


def class_lines(lines: DataFrame) -> DataFrame:
    """(id, name) of lines (value) `id: name`; malformed ones are skipped."""
    rows = lines.select(F.split(F.trim("value"), r":\s*", 2).alias("p"))
    return rows.where("size(p) = 2").select(F.expr("try_cast(p[0] as int)").alias("id"), F.trim(F.col("p")[1]).alias("name")).where("id is not null and name <> ''")


def class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of a JSON file's map class_mapping."""
    rows = spark.read.schema("class_mapping map<string, string>").option("multiLine", True).json(path)
    return rows.select(F.explode("class_mapping").alias("id", "name")).withColumn("id", F.expr("try_cast(id as int)"))


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, measures, symbols) of stored document results, one row a page, in no order."""
    schema = "metadata map<string, string>, pages map<string, struct<page_number: int, measures: map<string, string>, symbols: map<string, string>>>"
    return result_pages(spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name()))


def result_pages(documents: DataFrame) -> DataFrame:
    """(file, page, measures, symbols) of documents (file, pages)."""
    return documents.select("file", F.explode("pages").alias("key", "p")).select("file", F.expr("coalesce(p.page_number, try_cast(key as int))").alias("page"), "p.measures", "p.symbols")


def stored_page(results: DataFrame, wanted: int) -> DataFrame:
    """The rows of one stored page of each file: the wanted one, or the first there is where it lacks."""
    w = Window.partitionBy("file").orderBy((F.col("page") != wanted).cast("int"), "page")
    return results.withColumn("__r", F.dense_rank().over(w)).where("__r = 1").drop("__r")


def page_range(spark: SparkSession, text: str | None, pages: DataFrame) -> DataFrame:
    """The catalogue pages (page) that "a-b", "a,b,c" or a mix names, all for null; pages beyond the end are left out."""
    if text is None or not text.strip():
        return pages
    part = F.explode(F.split(F.lit(text.replace(" ", "")), ","))
    ends = spark.range(1).select(part.alias("t")).select(F.split("t", "-").alias("e"))
    wanted = ends.select(F.explode(F.sequence(F.col("e")[0].cast("int"), F.element_at("e", -1).cast("int"))).alias("page")).distinct()
    return pages.join(wanted, "page", "left_semi")


def page_files(spark: SparkSession, path: str, glob: str = "*.{pgm,PGM,png,PNG}") -> DataFrame:
    """(path, name, content) of image files by glob."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def decode_pgm(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, gray bytes) of a binary PGM image (P5, 8 bits)."""
    fields, at = [], 0
    while len(fields) < 4:
        if at >= len(content):
            raise ValueError("the header is cut short")
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        fields.append(content[at:end])
        at = end
    kind, width, height, top = fields[0], int(fields[1]), int(fields[2]), int(fields[3])
    if kind != b"P5" or not 0 < top < 256:
        raise ValueError("not an 8-bit binary PGM")
    pixels = content[at + 1 : at + 1 + width * height]
    if len(pixels) != width * height:
        raise ValueError("the image is cut short")
    return width, height, pixels


# First column and row, and steps, of the seven passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, gray bytes) of a PNG image: gray, colour, palette, with or without alpha, 1 to 16 bits, interlaced or not. Colours weigh 0.299, 0.587 and 0.114; alpha is left out."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or not data:
        raise ValueError("the image is cut short")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced > 1 or depth not in (1, 2, 4, 8, 16):
        raise ValueError("a kind of PNG that isn't read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not interlaced:
        pixels, _ = _samples(raw, width, height, depth, channels, colour == 3)
    else:
        pixels = np.zeros((height, width, channels), np.uint8)
        for x, y, dx, dy in PASSES:
            wide, high = -(-(width - x) // dx), -(-(height - y) // dy)
            if wide > 0 and high > 0:
                pixels[y::dy, x::dx], raw = _samples(raw, wide, high, depth, channels, colour == 3)
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ValueError("a colour that the palette lacks")
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] >= 3:
        pixels = (pixels[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)[:, :, None]
    return width, height, pixels[:, :, 0].tobytes()


def _samples(raw: np.ndarray, width: int, height: int, depth: int, channels: int, indexed: bool) -> tuple[np.ndarray, np.ndarray]:
    """The 8-bit samples (height, width, channels) of an image or a pass at the head of raw, and the bytes behind it."""
    row, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    size = height * (row + 1)
    if len(raw) < size:
        raise ValueError("the image is cut short")
    rows = _unfiltered(raw[:size].reshape(height, row + 1), step)
    if depth == 16:
        rows = rows.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
        rows = rows if indexed else (rows.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return rows.reshape(height, width, channels), raw[size:]


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of rows that begin with their filter's number; step is the distance of a byte to the one on its left."""
    kinds, lines = rows[:, 0], rows[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    out = np.zeros((len(rows) + 1, lines.shape[1]), np.uint8)
    # rows whose bytes depend on their left neighbours as well as on the row above go together, along diagonals
    slow = np.flatnonzero(kinds >= 3)
    first, end = (int(slow[0]), int(slow[-1]) + 1) if len(slow) else (0, 0)
    for y in range(len(rows)):
        if first <= y < end:
            if y == first:
                out[first + 1 : end + 1] = _along_diagonals(kinds[first:end], lines[first:end], out[first], step)
            continue
        line, above, now = lines[y], out[y], out[y + 1]
        if kinds[y] == 1:
            # sums of each byte column of the pixels wrap around as they should
            for k in range(step):
                now[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        else:
            now[:] = line + above if kinds[y] == 2 else line
    return out[1:]


def _along_diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Unfilters lines together: a byte's left, upper and corner neighbours lie on the two diagonals before its own, so each diagonal is one vector over the lines.

    Arrays are skewed: line j (from 1; 0 is the line above) has its pixel x at diagonal x + j.
    """
    many, wide = len(lines), lines.shape[1] // step
    diagonals = wide + many
    given = np.zeros((many, diagonals, step), np.uint8)
    for j in range(many):
        given[j, j + 1 : j + 1 + wide] = lines[j].reshape(wide, step)
    given = np.ascontiguousarray(given.transpose(1, 0, 2)).astype(np.int16)
    out = np.zeros((diagonals, many + 1, step), np.int16)
    out[:wide, 0] = above.reshape(wide, step)
    of = {k: (kinds == k).astype(np.int16)[:, None] for k in (1, 2, 3, 4) if (kinds == k).any()}
    alone = len(of) == 1 and not (kinds == 0).any()
    none = np.zeros((many + 1, step), np.int16)
    for t in range(1, diagonals):
        lo, hi = max(1, t - wide + 1), min(many, t) + 1
        left, up, corner = out[t - 1, lo:hi], out[t - 1, lo - 1 : hi - 1], (out[t - 2] if t > 1 else none)[lo - 1 : hi - 1]
        value = given[t, lo - 1 : hi - 1]
        for k, mine in of.items():
            if k == 4:
                a, b = up - corner, left - corner
                c = np.abs(a + b)
                a, b = np.abs(a), np.abs(b)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            else:
                guess = left if k == 1 else up if k == 2 else (left + up) >> 1
            value = value + (guess if alone else guess * mine[lo - 1 : hi - 1])
        np.bitwise_and(value, 255, out=out[t, lo:hi])
    back = np.ascontiguousarray(out.transpose(1, 0, 2).astype(np.uint8))
    return np.stack([back[j, j : j + wide].reshape(-1) for j in range(1, many + 1)])


def encode_png(width: int, height: int, pixels: bytes) -> bytes:
    """A gray image as a PNG; lines are stored as differences from the line above, which suits pages."""
    gray = np.frombuffer(pixels, np.uint8).reshape(height, width)
    lines = np.full((height, width + 1), 2, np.uint8)
    lines[:1, 1:], lines[1:, 1:] = gray[:1], gray[1:] - gray[:-1]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_image(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, gray bytes) of a PNG or PGM image, told apart by how it begins."""
    return decode_png(content) if content[:4] == b"\x89PNG" else decode_pgm(content)


def decoded_pages(files: DataFrame) -> DataFrame:
    """(name, width, height, pixels, error): a file that can't be decoded has an error and stops no other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, content in zip(part["name"], part["content"], strict=True):
                try:
                    out.append((name, *decode_image(bytes(content)), None))
                except DECODE_ERRORS as e:
                    out.append((name, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["name", "width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("name", "content").mapInPandas(run, "name string, width int, height int, pixels binary, error string")
