"""Zip archives as a Spark data source, read and written: `spark.read.format("members")`, `df.write.format("members")`.

Reading gives (path, name, size, content), a row for each member. An archive larger than `split` bytes (64 MB) goes to several
tasks: a task takes the members whose header begins inside its stretch of the file, so nothing but file names and sizes is
looked at when the job is planned, and each task reads its archive's directory and its own members only. Options: `suffixes`
(comma-separated, any case; none: all members), `split`, `broken` ("raise", or "note": one row with null name, size and content
for an archive that can't be read, at its first stretch). Folders and resource forks (`._*`) are left out; members of one name
are rows of their own; empty members have empty content; a folder without archives gives no rows.

Writing takes name and content (null content: empty; a null name raises; other columns are refused) and puts an archive for
each MEMBERS rows of a task into a folder. A list of the archives is renamed into place when all tasks are done, and readers go by that list: an
attempt that was lost, or a job that failed, leaves nothing that is read. Overwriting puts a new list in place, then removes the
archives of the old one; appending lists both. Paths are whatever pyarrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LISTING = "_members.json"
SCHEMA = "path string, name string, size long, content binary"
#: Bytes of a stretch of an archive, and of members in one Arrow batch.
SPLIT, BATCH = 64 << 20, 16 << 20
#: Members of an archive that is written; a task begins another after it, so no task holds or reads a longer directory.
MEMBERS = 10_000


def located(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return afs.FileSystem.from_uri(path)


def listed(files: afs.FileSystem, folder: str) -> list[str]:
    """Names of the archives that a folder's list has; none without a list."""
    at = f"{folder}/{LISTING}"
    if files.get_file_info(at).type != afs.FileType.File:
        return []
    with files.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class MembersReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", "").split(",") if s.strip())
        self.broken = options.get("broken", "raise")
        if self.split < 1 or self.broken not in ("raise", "note"):
            raise ValueError(f"split {self.split}, broken {self.broken!r}")

    def partitions(self) -> list[InputPartition]:
        files, at = located(self.path)
        info = files.get_file_info(at)
        if info.type == afs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == afs.FileType.File:
            found = [info]
        elif files.get_file_info(f"{at}/{LISTING}").type == afs.FileType.File:
            found = files.get_file_info([f"{at}/{name}" for name in listed(files, at)])
        else:
            found = [f for f in files.get_file_info(afs.FileSelector(at, recursive=True)) if f.type == afs.FileType.File and f.path.lower().endswith(".zip")]
        return [Stretch(f.path, s, s + self.split) for f in sorted(found, key=lambda f: f.path) for s in range(0, max(f.size, 1), self.split)] or [Stretch("", 0, 0)]

    def _wanted(self, info: zipfile.ZipInfo, part: Stretch) -> bool:
        last = info.filename.rsplit("/", 1)[-1]
        fits = not self.suffixes or last.lower().endswith(self.suffixes)
        return part.start <= info.header_offset < part.stop and bool(last) and not last.startswith("._") and fits

    def _members(self, part: Stretch) -> Iterator[tuple[str | None, bytes | None]]:
        files, _ = located(self.path)
        with files.open_input_file(part.path) as f:
            try:
                with zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        if self._wanted(info, part):
                            yield info.filename, z.read(info)
            except zipfile.BadZipFile:
                if self.broken == "raise":
                    raise
                if part.start == 0:
                    yield None, None

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, content in self._members(part) if part.path else ():
            rows.append((part.path, name, None if content is None else len(content), content))
            held += len(content or b"")
            if held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "name", "size", "content"])


class MembersWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        if sorted(schema.fieldNames()) != ["content", "name"]:
            raise ValueError(f"needs name and content, has {schema.fieldNames()}")
        self.path, self.overwrite = options["path"], overwrite
        self.packing = zipfile.ZIP_STORED if options.get("deflate", "true") == "false" else zipfile.ZIP_DEFLATED

    def write(self, rows: Iterator) -> Written:
        files, at = located(self.path)
        first = next(rows, None)
        if first is None:
            return Written([])
        files.create_dir(at, recursive=True)
        names = []
        while first is not None:
            names.append(f"part-{uuid.uuid4().hex}.zip")
            with files.open_output_stream(f"{at}/{names[-1]}") as f, zipfile.ZipFile(f, "w", self.packing) as z:
                self._put(z, first)
                for row in islice(rows, MEMBERS - 1):
                    self._put(z, row)
            first = next(rows, None)
        return Written(names)

    def _put(self, z: zipfile.ZipFile, row) -> None:
        if row["name"] is None:
            raise ValueError("a member without a name")
        # a member's date is zip's first, so equal rows make equal archives
        z.writestr(zipfile.ZipInfo(row["name"]), bytes(row["content"] or b""), self.packing)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = located(self.path)
        files.create_dir(at, recursive=True)
        old = listed(files, at)
        new = sorted(name for m in messages if m is not None for name in m.names)
        fresh = f"{at}/{LISTING}-{uuid.uuid4().hex}"
        with files.open_output_stream(fresh) as f:
            f.write(json.dumps(new if self.overwrite else sorted(old + new)).encode())
        files.move(fresh, f"{at}/{LISTING}")
        if self.overwrite:
            self._drop(files, at, old)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = located(self.path)
        self._drop(files, at, [name for m in messages if m is not None for name in m.names])

    @staticmethod
    def _drop(files: afs.FileSystem, at: str, names: list[str]) -> None:
        for info in files.get_file_info([f"{at}/{name}" for name in names]):
            if info.type == afs.FileType.File:
                files.delete_file(info.path)


class Members(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MembersReader:
        return MembersReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MembersWriter:
        return MembersWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(Members)
