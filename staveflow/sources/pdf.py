"""Pages of PDF documents as a data source: the images of scanned pages, read page by page.

A document is opened where it lies and only what a page needs is read: the
cross-reference table or stream, the nodes of the page tree on the way to the
page (subtrees are passed over by their counts), its resources and its largest
image. Documents are split into tasks by page ranges, so a long one is many
tasks and the pages that aren't asked for cost nothing.

Read are images of 1 to 8 bits in gray, RGB or a palette, stored plain or with
FlateDecode and its predictors, with the page's rotation; cross-reference
streams and object streams too. A page with no such image (vector graphics,
JPEG) has an error instead of pixels and stops no other; so has a document that
can't be opened, which is one row.
"""

from __future__ import annotations

import fnmatch
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import kernels
from .committed import filesystem
from .files import _unfiltered

SCHEMA = "doc string, page int, name string, width int, height int, pixels binary, error string"
_SPACE, _WORD = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*"), re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name."""


@dataclass(frozen=True)
class Ref:
    number: int


class Cut(ValueError):
    """The bytes at hand end within a value."""


def value(data: bytes, at: int) -> tuple[object, int]:
    """The PDF value at a position, and where it ends; words other than numbers come as bytes."""
    at = _SPACE.match(data, at).end()
    head = data[at : at + 1]
    if head == b"":
        raise Cut
    if data[at : at + 2] == b"<<" or head == b"[":
        end, items = (b">>", []) if head == b"<" else (b"]", [])
        at += len(end)
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + len(end)] == end:
                at += len(end)
                return (dict(zip(items[::2], items[1::2], strict=True)) if end == b">>" else items), at
            if at >= len(data) - 1:
                raise Cut
            item, at = value(data, at)
            if item == b"R" and len(items) > 1:
                items[-2:] = [Ref(items[-2])]
            else:
                items.append(item)
    if head == b"/":
        found = _WORD.match(data, at + 1)
        text = found.group() if found else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), text).decode("latin-1")), at + 1 + len(text)
    if head == b"<":
        end = data.find(b">", at)
        if end < 0:
            raise Cut
        digits = re.sub(rb"\s", b"", data[at + 1 : end]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2)), end + 1
    if head == b"(":
        out, depth, at = bytearray(), 1, at + 1
        while depth:
            c = data[at : at + 1]
            if c == b"":
                raise Cut
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                c = data[at + 1 : at + 2]
                out += bytes([int(octal.group(), 8) & 255]) if octal else _ESCAPES.get(c, b"" if c in b"\r\n" else c)
                at += len(octal.group()) + 1 if octal else 2
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
            at += 1
        return bytes(out), at
    found = _WORD.match(data, at)
    if not found:
        raise ValueError(f"no PDF value at {at}")
    if found.end() == len(data):
        raise Cut
    word = found.group()
    try:
        return (float(word) if b"." in word else int(word)), found.end()
    except ValueError:
        return {b"true": True, b"false": False, b"null": None}.get(word, word), found.end()


class Document:
    """The objects of a document, read where they lie and as they are asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.read = file, size, 0
        self.at: dict[int, object] = {}
        self._packed: dict[int, list] = {}
        self._held = (0, b"")
        tail = self._bytes(max(0, size - 2048), 2048)
        start = tail.rfind(b"startxref")
        if start < 0:
            raise ValueError("not a PDF, or cut short")
        trailer, seen, at = None, set(), int(value(tail + b" ", start + 9)[0])
        while at is not None and at not in seen:
            seen.add(at)
            new = self._section(at)
            trailer = trailer or new
            if "XRefStm" in new:
                self._section(int(new["XRefStm"]))
            at = new.get("Prev")
        if "Encrypt" in trailer:
            raise ValueError("the document is encrypted")
        self.root = self.get(self.get(trailer["Root"])["Pages"])

    def _bytes(self, at: int, n: int) -> bytes:
        """Bytes of the file; what was read last is kept, as values follow each other."""
        n, (start, held) = min(n, self.size - at), self._held
        if not start <= at <= at + n <= start + len(held):
            self.file.seek(at)
            held = self.file.read(n)
            self.read += len(held)
            start, self._held = at, (at, held)
        return held[at - start : at - start + n]

    def _value_at(self, at: int) -> tuple[object, int]:
        """A value and where it ends in the file, from as many bytes as it takes."""
        start, held = self._held
        n = start + len(held) - at if start <= at < start + len(held) else 2048
        while True:
            try:
                found, end = value(self._bytes(at, n), 0)
                return found, at + end
            except Cut:
                if at + n >= self.size:
                    raise ValueError("the document is cut short") from None
                n = max(2048, 4 * n)

    def _section(self, at: int) -> dict:
        """Notes where a cross-reference section says that objects are; earlier sections know better. Its trailer."""
        if self._bytes(at, 4) != b"xref":
            head, data = self._object_at(at)
            widths = head["W"]
            index = head.get("Index", [0, head["Size"]])
            table = np.frombuffer(data, np.uint8).reshape(-1, sum(widths)).astype(np.int64)
            cut = np.cumsum([0, *widths])
            fields = [(table[:, a:b] @ (256 ** np.arange(b - a - 1, -1, -1))).tolist() if b > a else [1] * len(table) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            numbers = [n for a, k in zip(index[::2], index[1::2], strict=True) for n in range(a, a + k)]
            for number, kind, one, two in zip(numbers, *fields, strict=True):
                if kind in (1, 2):
                    self.at.setdefault(number, one if kind == 1 else (one, two))
            return head
        at += 4
        while True:
            first, after = self._value_at(at)
            if first == b"trailer":
                return self._value_at(after)[0]
            count, after = self._value_at(after)
            lines = re.findall(rb"(\d{10}) (\d{5}) ([nf])", self._bytes(after, 20 * count + 2))
            for k, (offset, _, used) in enumerate(lines[:count]):
                if used == b"n":
                    self.at.setdefault(first + k, int(offset))
            at = after + 20 * count

    def _object_at(self, at: int) -> tuple[object, bytes | None]:
        for _ in range(3):  # number, generation, obj
            _, at = self._value_at(at)
        found, at = self._value_at(at)
        if not isinstance(found, dict):
            return found, None
        after = self._bytes(at, 64)
        stream = re.compile(rb"\s*stream\r?\n").match(after)
        if not stream:
            return found, None
        return found, self._decoded(found, self._bytes(at + stream.end(), int(self.get(found["Length"]))))

    def get(self, what: object) -> object:
        """What a reference refers to (of a stream, its dictionary); any other value as it is."""
        return self._found(what)[0]

    def _found(self, what: object) -> tuple[object, bytes | None]:
        if not isinstance(what, Ref):
            return what, None
        at = self.at.get(what.number)
        if at is None:
            return None, None
        if isinstance(at, int):
            return self._object_at(at)
        holder, place = at
        if holder not in self._packed:
            head, data = self._object_at(self.at[holder])
            spot, starts = 0, []
            for _ in range(head["N"]):
                _, spot = value(data, spot)
                start, spot = value(data, spot)
                starts.append(start)
            self._packed[holder] = [value(data + b" ", head["First"] + s)[0] for s in starts]
        return self._packed[holder][place], None

    def _decoded(self, head: dict, data: bytes) -> bytes | None:
        """A stream's bytes; None for filters that aren't read."""
        many = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        filters, settings = many(self.get(head.get("Filter"))), many(self.get(head.get("DecodeParms")))
        for k, name in enumerate(filters):
            if name not in ("FlateDecode", "Fl"):
                return None
            data = zlib.decompressobj().decompress(data)
            how = self.get(settings[k]) if k < len(settings) else None
            if how and (kind := how.get("Predictor", 1)) > 1:
                bits = how.get("Colors", 1) * how.get("BitsPerComponent", 8)
                row, step = -(-how.get("Columns", 1) * bits // 8), max(1, bits // 8)
                if kind >= 10:
                    rows = np.frombuffer(data, np.uint8)
                    data = _unfiltered(rows[: len(rows) // (row + 1) * (row + 1)].reshape(-1, row + 1), step).tobytes()
                elif how.get("BitsPerComponent", 8) == 8:
                    data = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, row // step, step), axis=1, dtype=np.uint8).tobytes()
                else:
                    return None
        return data

    def page_count(self) -> int:
        return int(self.get(self.root["Count"]))

    def page(self, n: int) -> dict:
        """The page with a number from 1, with what it inherits."""
        node, left, held = self.root, n - 1, {}
        while True:
            held |= {k: node[k] for k in ("Resources", "Rotate", "MediaBox") if k in node}
            if "Kids" not in node:
                return held | node
            for kid in self.get(node["Kids"]):
                child = self.get(kid)
                size = int(self.get(child["Count"])) if "Kids" in child else 1
                if left < size:
                    node = child
                    break
                left -= size
            else:
                raise ValueError(f"no page {n}")

    def gray(self, n: int) -> np.ndarray:
        """A page's largest image, upright, in gray."""
        page = self.page(n)
        objects = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
        found = []
        for name, ref in objects.items():
            at = self.at.get(ref.number)
            head = self._value_at(self._value_at(self._value_at(self._value_at(at)[1])[1])[1])[0] if isinstance(at, int) else None
            if isinstance(head, dict) and head.get("Subtype") == "Image":
                found.append((-int(self.get(head["Width"])) * int(self.get(head["Height"])), name, ref))
        if not found:
            raise ValueError("the page has no image")
        head, data = self._found(min(found, key=lambda x: x[:2])[2])
        if data is None:
            raise ValueError(f"an image with a filter that isn't read: {self.get(head.get('Filter'))}")
        return np.rot90(self._gray(head, data), -int(self.get(page.get("Rotate")) or 0) // 90 % 4)

    def _gray(self, head: dict, data: bytes) -> np.ndarray:
        width, height = int(self.get(head["Width"])), int(self.get(head["Height"]))
        bits = 1 if head.get("ImageMask") else int(self.get(head.get("BitsPerComponent", 8)))
        space = self.get(head.get("ColorSpace", Name("DeviceGray")))
        palette = None
        if isinstance(space, list) and space[0] in ("Indexed", "I"):
            base, table = self.get(space[1]), self._found(space[3])
            palette = np.frombuffer(table[1] if table[1] is not None else table[0], np.uint8).reshape(-1, self._channels(base))
        channels = 1 if palette is not None else self._channels(space)
        if bits not in (1, 2, 4, 8) or channels not in (1, 3):
            raise ValueError("a kind of image that isn't read")
        row = -(-width * channels * bits // 8)
        rows = np.frombuffer(data, np.uint8)[: row * height].reshape(height, row)
        if bits < 8:
            unpacked = np.unpackbits(rows, axis=1)[:, : width * channels * bits].reshape(height, width * channels, bits)
            rows = unpacked @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
            rows = rows if palette is not None else (rows.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
        pixels = rows.reshape(height, width, channels)
        if palette is not None:
            pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
        elif (limits := self.get(head.get("Decode"))) and limits[0] > limits[1]:
            pixels = 255 - pixels
        if pixels.shape[2] == 3:
            return (pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)
        return pixels[:, :, 0]

    def _channels(self, space: object) -> int:
        if isinstance(space, list):
            return int(self.get(space[1]).get("N", 1)) if space[0] == "ICCBased" else {"CalGray": 1, "CalRGB": 3}.get(space[0], 0)
        return {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3}.get(space, 0)


@dataclass
class _Pages(InputPartition):
    path: str
    first: int
    pages: list[int]
    error: str | None = None


def wanted_pages(text: str | None, count: int) -> list[int]:
    """The pages from 1 to count that "a-b", "a,b,c" or a mix names; all for none."""
    if not text or not text.strip():
        return list(range(1, count + 1))
    ends = [[int(x) for x in part.split("-")] for part in text.replace(" ", "").split(",")]
    return sorted({p for e in ends for p in range(e[0], e[-1] + 1) if 1 <= p <= count})


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.pages, self.per_task = options["path"], options.get("pages"), int(options.get("pages_per_task", 8))
        self.dpi = int(options["dpi"]) if "dpi" in options else None

    def partitions(self) -> list[_Pages]:
        """Page ranges of all documents; a document's page count is all that is read here."""
        fs, path = filesystem(self.uri)
        info, out = fs.get_file_info(path), []
        if info.type == pafs.FileType.Directory:
            found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and fnmatch.fnmatch(x.base_name.lower(), "*.pdf"))
        else:
            found = [path]
        for name in found:
            try:
                with fs.open_input_file(name) as f:
                    pages = wanted_pages(self.pages, Document(f, f.size()).page_count())
            except (ValueError, KeyError, TypeError, AttributeError, OSError, zlib.error) as e:
                out.append(_Pages(name, 0, [], str(e) or type(e).__name__))
                continue
            out += [_Pages(name, k, pages[k : k + self.per_task]) for k in range(0, len(pages), self.per_task)]
        return out

    def read(self, partition: _Pages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = filesystem(self.uri)
        doc = partition.path.rpartition("/")[2]
        stem = doc.rpartition(".")[0] or doc
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, types, strict=True)], [c.split(" ")[0] for c in SCHEMA.split(", ")])
        if partition.error:
            yield row(doc, None, None, None, None, None, partition.error)
            return
        with fs.open_input_file(partition.path) as f:
            held = Document(f, f.size())
            for n in partition.pages:
                name = f"{stem}-{n:04d}"
                try:
                    gray = held.gray(n)
                    if self.dpi:
                        box = held.get(held.page(n)["MediaBox"])
                        sides = [max(1, round(abs(float(held.get(box[k + 2])) - float(held.get(box[k]))) * self.dpi / 72)) for k in (0, 1)]
                        sides = sides[::-1] if int(held.get(held.page(n).get("Rotate")) or 0) % 180 else sides
                        gray = kernels.scaled(gray, *sides)
                    yield row(doc, n, name, gray.shape[1], gray.shape[0], np.ascontiguousarray(gray).tobytes(), None)
                except (ValueError, KeyError, TypeError, AttributeError, IndexError, zlib.error) as e:
                    yield row(doc, n, name, None, None, None, str(e) or type(e).__name__)


class PdfPages(DataSource):
    """Format "pdf". Options: path (a document or a folder of them), pages ("1-3,7"), pages_per_task, dpi (scales images to the page's size; without it they stay as they are)."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


def pdf_pages(spark: SparkSession, path: str, pages: str | None = None, dpi: int | None = None, pages_per_task: int = 8) -> DataFrame:
    """(doc, page, name, width, height, pixels, error) of the wanted pages of documents."""
    spark.dataSource.register(PdfPages)
    reader = spark.read.format("pdf").option("pages_per_task", pages_per_task)
    reader = reader if pages is None else reader.option("pages", pages)
    return (reader if dpi is None else reader.option("dpi", dpi)).load(path)
