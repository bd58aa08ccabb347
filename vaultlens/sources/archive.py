"""``spark.read.format("archive")``: entries, and members if asked, of archive files below a folder.

One partition an archive.  Options: path, withPayload (default false), glob,
scheme, parameters (JSON), oneperkey.  Equality and prefix filters on file_name
are applied before members are read when
spark.sql.python.filterPushdown.enabled is true.  Files are opened by path in
the tasks, so the folder must be mounted on all executors; for any other store
read archives with ``operators.archives.read_archives``.

``df.write.format("archive")`` writes rows (archive, file_name, data), in the
order of ordinal if there is one, as one file for each archive below path; rows
of an archive must be in one partition (``repartition("archive")``).
"""

from __future__ import annotations

import fnmatch
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, StringStartsWith, WriterCommitMessage

from vaultlens.codecs.errors import MalformedError
from vaultlens.formats import registry
from vaultlens.formats.model import ENTRY_SCHEMA, Member

PAYLOAD = ", data binary, error string"


@dataclass
class File(InputPartition):
    path: str
    format: str


def local(path: str) -> str:
    return path.removeprefix("file://")


def find(root: str) -> Iterator[File]:
    """Archive files below root, in order; companions are found with their main file."""
    for folder, _, names in sorted(os.walk(local(root))):
        for name in sorted(names):
            path = os.path.join(folder, name)
            with open(path, "rb") as f:
                head = f.read(16)
                f.seek(max(0, os.path.getsize(path) - 6))
                kind = registry.identify(path, head, f.read(6))
            if kind:
                yield File(path, kind)


def load(file: File) -> bytes:
    with open(file.path, "rb") as f:
        data = f.read()
    stem = os.path.splitext(file.path)[0]
    if file.format == "det":
        files = {"det": data}
        for kind in ("nme", "at2", "atm"):
            if os.path.exists(f"{stem}.{kind}"):
                with open(f"{stem}.{kind}", "rb") as f:
                    files[kind] = f.read()
        return registry.bundle(files)
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.equal, self.prefix = None, ""

    def partitions(self) -> list[File]:
        return list(find(self.options["path"]))

    def wanted(self, name: str) -> bool:
        pattern = self.options.get("glob")
        return (self.equal is None or name == self.equal) and name.startswith(self.prefix) and (not pattern or fnmatch.fnmatchcase(name, pattern))

    def read(self, file: File) -> Iterator[tuple]:
        payload = self.options.get("withpayload", "false").lower() == "true"
        options = {"scheme": self.options.get("scheme"), "parameters": json.loads(self.options.get("parameters", "null"))}
        kind, data = registry.FORMATS[file.format], load(file)
        for k, e in enumerate(kind.parse(data)):
            if not self.wanted(e.file_name):
                continue
            row, content, error = e.row(file.path, k), None, None
            if payload:
                try:
                    content = kind.read(data, e, file.path, options)
                except MalformedError as problem:
                    error = str(problem)
                row += (content, error)
            yield row


class PushingArchiveReader(ArchiveReader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            match f:
                case EqualTo(("file_name",), value):
                    self.equal = value
                case StringStartsWith(("file_name",), value):
                    self.prefix = value
                case _:
                    yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """Files are written under temporary names and get their own on commit."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def write(self, rows: Iterator) -> Written:
        from vaultlens.operators.archives import BUILDERS

        held: dict[str, list] = {}
        for k, r in enumerate(rows):
            d = r.asDict()
            held.setdefault(d["archive"], []).append((d.get("ordinal", k), Member(d["file_name"], bytes(d["data"] or b""))))
        kind, root, done = self.options.get("archiveformat", "xp3"), local(self.options["path"]), []
        options = {"scheme": self.options["scheme"], "parameters": json.loads(self.options.get("parameters", "null"))} if "scheme" in self.options else {}
        os.makedirs(root, exist_ok=True)
        for archive, members in held.items():
            data = BUILDERS[kind]([m for _, m in sorted(members, key=lambda x: x[0])], options)
            parts = registry.unbundle(data) if kind == "det" else {kind: data}
            for ext, content in parts.items():
                temporary = os.path.join(root, f".{uuid.uuid4().hex}")
                with open(temporary, "wb") as f:
                    f.write(content)
                done.append((temporary, os.path.join(root, f"{archive}.{ext}")))
        return Written(done)

    def commit(self, messages: list) -> None:
        for m in filter(None, messages):
            for temporary, path in m.files:
                os.replace(temporary, path)

    def abort(self, messages: list) -> None:
        for m in filter(None, messages):
            for temporary, _ in m.files:
                if os.path.exists(temporary):
                    os.remove(temporary)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ENTRY_SCHEMA + (PAYLOAD if self.options.get("withPayload", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        spark = SparkSession.getActiveSession()
        pushing = spark is not None and spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
        return (PushingArchiveReader if pushing else ArchiveReader)({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter({k.lower(): v for k, v in self.options.items()}, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
