"""Members of tar and zip archives as a data source: ``spark.read.format("archive_members")``.

An archive is planned as ranges of whole members (about ``range_bytes`` each) from
its headers, which are read by seeking over the contents; a task opens the archive,
goes to its range and reads one member at a time.  So an archive may be of any
size, is read by many tasks, and only what is asked for is read.  A compressed tar
has no places to go to: it is one range, read as a stream.

Options: ``path`` (names or a folder of files, comma-separated), ``suffixes``
(comma-separated ends of member names, all if empty) and ``range_bytes``.
Files are opened through Arrow's file systems, so a path may be a URI of a store.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "archive_members"
RANGE_BYTES = 64 << 20


@dataclass
class Range(InputPartition):
    """Members of an archive from one place to another: offsets in a tar, numbers in a zip, neither in a compressed tar."""

    path: str
    kind: str
    start: int
    end: int


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}" if path.startswith(("/", "file:")) else path)
    return system.open_input_file(name)


def _kind(file) -> str:
    head = file.read(512)
    file.seek(0)
    if zipfile.is_zipfile(file):
        kind = "zip"
    else:
        kind = "tar" if head[257:262] == b"ustar" or not head.strip(b"\0") else "stream"
    file.seek(0)
    return kind


def ranges(path: str, size: int) -> Iterator[Range]:
    """The ranges of an archive; only its headers are read."""
    with _open(path) as file:
        kind = _kind(file)
        if kind == "stream":
            yield Range(path, kind, 0, 0)
        elif kind == "zip":
            first, held = 0, 0
            with zipfile.ZipFile(file) as z:
                members = z.infolist()
            for k, m in enumerate(members):
                held += m.file_size
                if held >= size or k == len(members) - 1:
                    yield Range(path, kind, first, k + 1)
                    first, held = k + 1, 0
        else:
            start, end = 0, 0
            with tarfile.open(fileobj=file, mode="r:") as t:
                while (m := t.next()) is not None:
                    t.members.clear()  # the headers of a large archive are not kept
                    if m.offset - start >= size:
                        yield Range(path, kind, start, m.offset)
                        start = m.offset
                    end = m.offset_data + m.size
            if end > start:
                yield Range(path, kind, start, end)


def members(part: Range, suffixes: tuple[str, ...]) -> Iterator[tuple[str, str, bytes]]:
    """(archive, member, content) of a range, one after the other."""
    wanted = lambda name: not suffixes or name.endswith(suffixes)
    with _open(part.path) as file:
        if part.kind == "zip":
            with zipfile.ZipFile(file) as z:
                for m in z.infolist()[part.start : part.end]:
                    if not m.is_dir() and wanted(m.filename):
                        yield part.path, m.filename, z.read(m)
            return
        file.seek(part.start)
        with tarfile.open(fileobj=file, mode="r|*" if part.kind == "stream" else "r:") as t:
            while (m := t.next()) is not None and (part.kind == "stream" or m.offset < part.end):
                t.members.clear()
                if m.isfile() and wanted(m.name):
                    yield part.path, m.name, t.extractfile(m).read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.size = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [r for p in self.paths for r in ranges(p, self.size)]

    def read(self, part: Range) -> Iterator[tuple[str, str, bytes]]:
        if part is not None:
            yield from members(part, self.suffixes)


class ArchiveMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ArchiveMembers)
