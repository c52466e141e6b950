"""Files that tasks write under temporary names and that the driver names and lists once all tasks are done.

The base of this package's file-writing data sources. A task attempt writes
into a folder of its own under `_temporary-<job>`; Spark hands the driver the
messages of one attempt a task, whatever else was tried. Only then are those
files renamed and a manifest, itself written under a temporary name, lists
them with their sizes. Readers go by the manifest, so files of failed attempts
or of a job that ended half-way are never read; a job that fails removes its
folder (what a task still writes then is left there, unnamed). Paths are any URI that pyarrow's file systems open on driver and
executors alike.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest.jsonl"
#: Files that the driver renames at a time.
MOVES = 16


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it (with a scheme or without, nothing percent-encoded) and the path in it."""
    parts = re.fullmatch(r"(?:(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*):)?(?://[^/]*)?(?P<path>/.*)", uri, re.DOTALL)
    if parts is None or parts["scheme"] in (None, "file"):
        return pafs.LocalFileSystem(), (parts["path"] if parts else uri).rstrip("/")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def manifest(uri: str) -> list[dict]:
    """What a committed folder holds: a dict a file with `file`, `bytes`, `sha256` and what the writer added, by name."""
    fs, path = filesystem(uri)
    if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{uri} has no {MANIFEST}: nothing was committed there")
    with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


@dataclass
class Written(WriterCommitMessage):
    """Files of one task attempt: where they are, and what the manifest is to say."""

    files: list[tuple[str, dict]] = field(default_factory=list)


class OpenFile:
    """A file of a task: counts its bytes and their digest."""

    def __init__(self, fs: pafs.FileSystem, path: str, name: str) -> None:
        folder = f"{path}/{name}".rpartition("/")[0]
        fs.create_dir(folder, recursive=True)
        self.at, self.name, self.bytes, self._sum = f"{path}/{name}", name, 0, hashlib.sha256()
        self._out = fs.open_output_stream(self.at, compression=None)

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self._sum.update(data)
        self.bytes += len(data)

    def done(self, **more) -> tuple[str, dict]:
        self._out.close()
        return self.at, {"file": self.name, "bytes": self.bytes, "sha256": self._sum.hexdigest(), **more}


class CommittedWriter(DataSourceArrowWriter):
    """write() by files(); commit and abort as described above. overwrite replaces what a folder's manifest lists."""

    def __init__(self, uri: str, overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def files(self, batches: Iterator[pa.RecordBatch], new) -> Iterator[tuple[str, dict]]:
        """What done() says of each file made of the task's rows; new(name) opens one."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.uri)
        task = TaskContext.get()
        own = f"{path}/_temporary-{self.job}/{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}"
        return Written(list(self.files(iterator, lambda name: OpenFile(fs, own, name))))

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.uri)
        found = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]["file"])
        names = [f[1]["file"] for f in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote files of the same name")
        fs.create_dir(path, recursive=True)
        held: list[dict] = []
        if fs.get_file_info(f"{path}/{MANIFEST}").type != pafs.FileType.NotFound:
            held = manifest(self.uri)
            if not self.overwrite and (both := {x["file"] for x in held} & set(names)):
                self.abort(messages)
                raise FileExistsError(f"{self.uri} has {min(both)} already")
        if self.overwrite:
            if held:
                fs.delete_file(f"{path}/{MANIFEST}")  # from here on nothing counts as committed
            for x in held:
                fs.delete_file(f"{path}/{x['file']}")
            held = []
        for folder in {n.rpartition("/")[0] for n in names} - {""}:
            fs.create_dir(f"{path}/{folder}", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:  # a store answers many at a time
            list(pool.map(lambda f: fs.move(f[0], f"{path}/{f[1]['file']}"), found))
        lines = sorted([*held, *(said for _, said in found)], key=lambda x: x["file"])
        hidden = f"{path}/_temporary-{self.job}/{MANIFEST}"
        fs.create_dir(hidden.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(hidden, compression=None) as f:
            f.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
        fs.move(hidden, f"{path}/{MANIFEST}")
        fs.delete_dir(f"{path}/_temporary-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.uri)
        folder = f"{path}/_temporary-{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)
