"""Trace archives: tar files, whole or split into parts, read as a data source with a partition for each archive."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_split_part

FORMAT = "trace_archive"
#: Members that are traces; others (indexes, acas files, pictures) are passed over.
MEMBER = re.compile(r"(^|/)traces/.*\.json(\.gz)?$")
#: Bytes of a part that are held while it streams by.
CHUNK = 1 << 20


class Joined(io.RawIOBase):
    """Parts of an archive one after the other, as one stream; a part is opened when the one before is at its end."""

    def __init__(self, fs, names: list[str]):
        self.fs, self.names, self.now = fs, list(names), None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.now is None:
                if not self.names:
                    return 0
                self.now = self.fs.open_input_stream(self.names.pop(0), buffer_size=CHUNK)
            body = self.now.read(len(buffer))
            if body:
                buffer[: len(body)] = body
                return len(body)
            self.now.close()
            self.now = None


def archives(names: list[str]) -> list[list[str]]:
    """Files of archives in order of their parts: ``x.tar`` alone, ``x.tar.aa``, ``x.tar.ab``, ... together."""
    found: dict[str, list[str]] = {}
    for name in sorted(names):
        if name.endswith(".tar"):
            found[name] = [name]
        elif is_split_part(name):
            found.setdefault(name[:-3] + ".parts", []).append(name)
    return [found[k] for k in sorted(found)]


def members(stream, skipped: list[str]) -> Iterator[tuple[str, str]]:
    """(name, text) of an archive's traces; a member that cannot be unpacked is passed over, its name goes to ``skipped``.

    Members stream by, one at a time is held. An archive that breaks off gives what came before.
    """
    try:
        with tarfile.open(fileobj=io.BufferedReader(stream, CHUNK), mode="r|") as tar:
            for member in tar:
                if not member.isfile() or not MEMBER.search(member.name):
                    continue
                try:
                    body = tar.extractfile(member).read()
                    # gzip by its first bytes: members are often packed whatever they are called
                    body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
                    yield member.name, body.decode("utf-8")
                except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                    skipped.append(member.name)
    except tarfile.TarError:
        skipped.append("(the archive's end)")


class _Archive(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        where = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        return fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", where) else where)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = self._store()
        if store.get_file_info(at).type == fs.FileType.File:
            return [_Archive([at])]
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        return [_Archive(a) for a in archives([f.path for f in found if f.type == fs.FileType.File])]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        store, _ = self._store()
        skipped: list[str] = []
        name = partition.names[0]
        for member, body in members(Joined(store, partition.names), skipped):
            yield name, member, body
            while skipped:
                yield name, skipped.pop(), None
        for member in skipped:
            yield name, member, None


class TraceArchives(DataSource):
    """``spark.read.format("trace_archive").load(path)``: (archive, name, body); body is null for a member that cannot be read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, name string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_archives(spark: SparkSession, path: str, batch_date: str) -> DataFrame:
    """Raw trace documents (name, body, batch_date) of the archives in a folder, as ``traces.read_traces`` has them of landed members.

    An archive is a task: it streams, and what is held is a member. Members that cannot be unpacked are left out of
    ``traces.points`` and named by ``traces.rejects``.
    """
    spark.dataSource.register(TraceArchives)
    return spark.read.format(FORMAT).load(path).select("name", "body", F.to_date(F.lit(batch_date)).alias("batch_date"))
