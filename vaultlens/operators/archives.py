"""Archives as relations: pack members into archives, scan entries, read members.

All functions take and give DataFrames.  Archives are rows (archive, format,
content), of the binaryFile source or packed here; entries are rows of
ENTRY_SCHEMA with a status; payload bytes are read in the task that holds the
archive and never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.codecs.errors import MalformedError
from vaultlens.formats import arc, det, gsp, registry, vf, xp3
from vaultlens.formats.model import ENTRY_SCHEMA, Entry, Member
from vaultlens.functions.batches import arrow_schema, batched, rows_of
from vaultlens.functions.paths import glob as glob_column
from vaultlens.functions.paths import identify_format

ENTRIES = ENTRY_SCHEMA + ", error string"
PAYLOADS = "archive string, format string, ordinal int, file_name string, data binary, status string, error string"
ARCHIVES = "archive string, format string, content binary"

BUILDERS = {
    "xp3": lambda members, options: xp3.build(members, **options),
    "gsp": lambda members, options: gsp.build(members, **options),
    "arc": lambda members, options: arc.build(members, **options),
    "vf": lambda members, options: vf.build(members, **options),
    "det": lambda members, options: registry.bundle(det.build(members, **options)),
}


def builder(format: str):
    """build(members, options) of a format, built in or added."""
    return BUILDERS.get(format) or registry.FORMATS[format].build


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, format, content) of all files below path that are archives; format by magic, then extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    head, tail = F.substring("content", 1, 16), F.expr("substring(content, -6, 6)")
    kind, added = identify_format(F.col("path"), head, tail), registry.added()
    if added:
        other = F.udf(lambda path, head, tail: next((f.name for f in added if f.matches(path, bytes(head), bytes(tail))), None), "string")
        kind = F.coalesce(kind, other("path", head, tail))
    return files.select(F.col("path").alias("archive"), kind.alias("format"), "content").where("format is not null")


def bundle_companions(spark: SparkSession, path: str) -> DataFrame:
    """Archives of three files below path, found by folder and stem, each as one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    parts = files.select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), kind.alias("kind"), "content").where(F.col("kind").isin("det", "nme", "atm", "at2"))
    grouped = parts.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct("kind", "content"))).alias("files")).where("map_contains_key(files, 'det')")
    join = F.udf(lambda files: registry.bundle(dict(files)), "binary")
    return grouped.select(F.concat("stem", F.lit(".det")).alias("archive"), F.lit("det").alias("format"), join("files").alias("content"))


def pack(members: DataFrame, format: str, **options) -> DataFrame:
    """ARCHIVES from members (archive, ordinal, file_name, data), one archive a task row."""

    build = builder(format)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", kind="stable")
        data = build([Member(n, bytes(d or b"")) for n, d in zip(rows.file_name, rows.data, strict=True)], options)
        return pd.DataFrame({"archive": rows.archive.iloc[:1], "format": [format], "content": [data]})

    return members.select("archive", "ordinal", "file_name", "data").groupBy("archive").applyInPandas(run, ARCHIVES)


def parse_row(format: str, content: bytes, one_per_key: bool = False, formats: dict[str, registry.Format] | None = None) -> list[Entry]:
    """formats: those of the session that planned the work, since a worker's registry has the built-in ones alone."""
    if format == "xp3" and one_per_key:
        return xp3.parse(content, one_per_key)
    return (formats or registry.FORMATS)[format].parse(content)


def scan(archives: DataFrame, one_per_key: bool = False) -> DataFrame:
    """ENTRIES of every archive; an archive that can't be parsed is one row with its error."""
    formats, schema = dict(registry.FORMATS), arrow_schema(ENTRIES)
    parts = [f.name for f in schema.field("segments").type.value_type]

    def entries(archive: str, format: str, content: bytes) -> Iterator[tuple]:
        try:
            for k, e in enumerate(parse_row(format, content, one_per_key, formats)):
                *row, segments = e.row(archive, k)
                yield *row, [dict(zip(parts, s, strict=True)) for s in segments], None
        except (MalformedError, KeyError) as e:
            yield archive, *[None] * 15, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((e for row in rows_of(batches, "archive", "format", "content") for e in entries(*row)), schema)

    return archives.select("archive", "format", "content").mapInArrow(run, ENTRIES)


def payloads(archives: DataFrame, glob: str | None = None, **options) -> DataFrame:
    """PAYLOADS of members whose name fits the glob; others aren't read.  options: scheme, parameters, force, decrypt, check.

    Columns scheme and parameters (JSON) of archives, if there are, count for
    their own archive; a null scheme there leaves the options as they are.
    """
    import fnmatch

    formats, own = dict(registry.FORMATS), [c for c in ("scheme", "parameters") if c in archives.columns]
    schema = arrow_schema(PAYLOADS)

    def members(archive: str, format: str, content: bytes, *given: str | None) -> Iterator[tuple]:
        own_options = dict(zip(own, given, strict=True))
        chosen = options
        if own_options.get("scheme") is not None:
            chosen = options | {"scheme": own_options["scheme"], "parameters": json.loads(own_options.get("parameters") or "null")}
        try:
            entries = parse_row(format, content, formats=formats)
        except (MalformedError, KeyError) as e:
            yield archive, format, None, None, None, "unreadable", str(e)
            return
        for k, e in enumerate(entries):
            if glob is not None and not fnmatch.fnmatchcase(e.file_name, glob):
                continue
            try:
                data = formats[format].read(content, e, archive, chosen)
            except (MalformedError, ValueError) as error:
                yield archive, format, k, e.file_name, None, "error", str(error)
            else:
                yield archive, format, k, e.file_name, data, "ok", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((m for row in rows_of(batches, "archive", "format", "content", *own) for m in members(*row)), schema)

    return archives.select("archive", "format", "content", *own).mapInArrow(run, PAYLOADS)


def segments(entries: DataFrame) -> DataFrame:
    """One row a segment, with its entry's checksum and flags."""
    return entries.select("archive", "ordinal", "file_name", "key", "encrypted", F.inline("segments").alias("segment", "segment_flags", "segment_packed", "segment_offset", "segment_size", "segment_stored"))


def member(rows: DataFrame, archive: str, name: str) -> DataFrame:
    """The first member of that name; an error where there is none."""
    found = rows.where((F.col("archive") == archive) & (F.col("file_name") == name)).orderBy("ordinal").limit(1)
    if found.isEmpty():
        raise KeyError(name)
    return found


def with_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """entries (archive, key, ...) and aliases (archive, key, file_name): each alias with its entry's values, appended."""
    named = aliases.select("archive", "key", F.col("file_name").alias("alias"))
    found = named.join(entries.drop("file_name"), ["archive", "key"], "left").withColumnRenamed("alias", "file_name")
    return entries.withColumn("is_alias", F.lit(False)).unionByName(found.withColumn("is_alias", F.lit(True)))


def matching(entries: DataFrame, pattern: str | None) -> DataFrame:
    return entries.where(glob_column(F.col("file_name"), pattern))
