"""Inventories: images by structure, installed games, engines, ZIP files, manifests.

Rows come from one pass over the files; everything after that is grouping,
counting and joining of small columns.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.codecs import tlg
from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.pe import version_strings
from vaultlens.functions import paths
from vaultlens.functions.batches import arrow_schema, batched, rows_of
from vaultlens.functions.bytes import content_sha256
from vaultlens.operators.relational import first_n_per_group, first_per_key, most_common, without_ancestors

# --- images -------------------------------------------------------------------------


def _strip_marks(body: bytes) -> Iterator[bool]:
    """Whether each channel of each strip is stored raw, as far as the bytes go."""
    channels, _, height, rows = tlg.strips_header(body)
    pos = 13 + 4 * -(-height // rows) if rows else len(body)
    for _ in range(channels * -(-height // rows) if rows else 0):
        if pos + 5 > len(body):
            return
        raw, size = struct.unpack_from("<BI", body, pos)
        yield bool(raw)
        pos += 5 + size


def _pool_methods(body: bytes) -> Iterator[tuple[int, int, int]]:
    """(block row, channel, method) of each pool, as far as the bytes go."""
    channels, _, _, _, _, height, _ = tlg.blocks_header(body)
    if len(body) < 20:
        return
    pos = 20 + struct.unpack_from("<I", body, 16)[0]
    for row in range(-(-height // tlg.EDGE)):
        for c in range(channels):
            if pos + 4 > len(body):
                return
            word = struct.unpack_from("<I", body, pos)[0]
            pos += 4 + -(-(word & 0x3FFFFFFF) // 8)
            yield row, c, word >> 30


def image_metrics(data: bytes) -> Iterator[tuple[str, str]]:
    """(metric, value) of an image and what it contains; metrics error, unusual and unknown_magic name what is odd."""
    if len(data) < tlg.MAGIC_SIZE:
        yield "error", "too short"
        return
    magic, body = data[: tlg.MAGIC_SIZE], data[tlg.MAGIC_SIZE :]
    if magic == tlg.CONTAINER:
        yield "kind", "container"
        if len(body) < 4:
            yield "error", "container truncated"
            return
        after = 4 + struct.unpack_from("<I", body)[0]
        yield "trailing", str(len(body) > after).lower()
        for name, content in tlg.metadata_chunks(body):
            yield "chunk", name.decode("ascii", "backslashreplace")
            if name == b"tags":
                for key, value in tlg.tags_by_length(content.decode("utf-8", "replace")):
                    yield "tag", key
                    yield "tag_value", f"{key}={value}"
        if len(inner := tlg.inner(body)) >= tlg.MAGIC_SIZE:
            yield from image_metrics(inner)
    elif magic == tlg.STRIPS:
        yield "kind", "strips"
        if len(body) < 13:
            yield "error", "strips header truncated"
            return
        channels, width, height, rows = tlg.strips_header(body)
        yield from (("strips_channels", str(channels)), ("strips_rows", str(rows)), ("dimensions", f"{width}x{height}"))
        if channels not in (3, 4):
            yield "unusual", f"strips channels={channels}"
        for raw in _strip_marks(body):
            yield "strip_block", "raw" if raw else "packed"
    elif magic == tlg.BLOCKS:
        yield "kind", "blocks"
        if len(body) < 16:
            yield "error", "blocks header truncated"
            return
        channels, flag, colour, table, width, height, longest = tlg.blocks_header(body)
        yield from (("blocks_channels", str(channels)), ("dimensions", f"{width}x{height}"), ("blocks_longest_pool", str(longest)))
        for name, value in (("data_flag", flag), ("color_type", colour), ("external_table", table)):
            yield f"blocks_{name}", str(value)
            if value:
                yield "unusual", f"blocks {name}={value}"
        if channels not in (3, 4):
            yield "unusual", f"blocks channels={channels}"
        for row, channel, method in _pool_methods(body):
            yield "blocks_method", str(method)
            if method:
                yield "unusual", f"blocks method={method} (row {row}, channel {channel})"
    else:
        yield "unknown_magic", magic.hex()


def image_fingerprint(data: bytes) -> dict | None:
    """What images of one make have in common; None if it can't be read."""
    if len(data) < tlg.MAGIC_SIZE:
        return None
    magic, body, out = data[: tlg.MAGIC_SIZE], data[tlg.MAGIC_SIZE :], {"outer": "raw"}
    try:
        if magic == tlg.CONTAINER:
            chunks, tags = tlg.metadata_chunks(body), {}
            for name, content in chunks:
                if name == b"tags":
                    try:
                        tags |= tlg.tags_by_split(content.decode())
                    except UnicodeDecodeError:
                        continue
            names = sorted(n.decode() if n.isascii() else n.hex() for n, _ in chunks)
            out = {"outer": "container", "chunks": names, "tags": dict(sorted(tags.items()))}
            magic, body = tlg.inner(body)[: tlg.MAGIC_SIZE], tlg.inner(body)[tlg.MAGIC_SIZE :]
        if magic == tlg.STRIPS:
            channels, _, height, rows = tlg.strips_header(body)
            out |= {"inner": "strips", "channels": channels, "rows": rows}
            if channels in (3, 4) and rows:
                out |= {"raw": any(_strip_marks(body)), "single": -(-height // rows) == 1}
            return out
        if magic == tlg.BLOCKS:
            channels, flag, colour, table, width, *_ = tlg.blocks_header(body)
            out |= {"inner": "blocks", "channels": channels, "data_flag": flag, "color_type": colour, "external_table": table}
            if len(body) >= 20:
                kinds = {int(k) for k in tlg.read_filters(body)[0].ravel()}
                predictors = sorted({"average" if k & 1 else "median" for k in kinds})
                out |= {"partial": width % tlg.EDGE != 0, "predictors": predictors, "transforms": sorted({k >> 1 for k in kinds})}
            return out
    except (struct.error, MalformedError):
        pass
    return None


def image_label(fingerprint: dict) -> str:
    return "  ".join(f"{k}={v}" for k, v in fingerprint.items())


def metric_rows(images: DataFrame) -> DataFrame:
    """path, metric, value of images (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, m, v) for p, c in zip(b.path, b.content, strict=True) for m, v in image_metrics(c)]
            yield pd.DataFrame(rows, columns=["path", "metric", "value"])

    return images.select("path", "content").mapInPandas(run, "path string, metric string, value string")


def image_survey(images: DataFrame) -> DataFrame:
    """metric, value, n: all counters in one shuffle."""
    return metric_rows(images).groupBy("metric", "value").agg(F.count("*").alias("n"))


def unusual_images(images: DataFrame) -> DataFrame:
    return metric_rows(images).where("metric in ('unusual', 'error', 'unknown_magic')")


def image_buckets(images: DataFrame) -> DataFrame:
    """path, fingerprint (JSON, null if unreadable), label."""

    @F.pandas_udf("fingerprint string, label string")
    def run(content: pd.Series) -> pd.DataFrame:
        found = [image_fingerprint(c) for c in content]
        return pd.DataFrame({"fingerprint": [f and json.dumps(f, sort_keys=True) for f in found], "label": [f and image_label(f) for f in found]})

    return images.select("path", run("content").alias("f")).select("path", "f.*")


def curate(images: DataFrame, manifest: DataFrame, n: int = 5) -> DataFrame:
    """The first n images of each fingerprint by path, with where they came from (manifest: name, archive, member)."""
    kept = first_n_per_group(image_buckets(images).where("fingerprint is not null"), ["fingerprint"], ["path"], n)
    named = kept.withColumn("name", paths.base_name(F.col("path")))
    source = first_per_key(manifest, ["name"], ["place"]).drop("place")
    return named.join(source, "name", "left").fillna("", ["archive", "member"])


def collect_images(members: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new contents by digest that have (sha) lacks, manifest row of every image member): members (archive, file_name, data)."""
    magic = F.substring("data", 1, tlg.MAGIC_SIZE).isin(tlg.CONTAINER, tlg.STRIPS, tlg.BLOCKS)
    images = members.where((paths.extension(F.col("file_name")) == ".tlg") & magic).withColumn("sha", content_sha256(F.col("data")))
    new = images.join(have.select("sha"), "sha", "left_anti").dropDuplicates(["sha"]).select("sha", "data")
    return new, images.select(F.concat("sha", F.lit(".tlg")).alias("name"), "archive", F.col("file_name").alias("member"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, archive, member, place of a tab-separated file; of rows with one name the first counts."""
    rows = spark.read.csv(path, sep="\t", schema="name string, archive string, member string", quote="")
    return first_per_key(rows.withColumn("place", F.monotonically_increasing_id()), ["name"], ["place"])


# --- installed games ------------------------------------------------------------------


def archive_folders(files: DataFrame) -> DataFrame:
    """Folders with archives by extension and magic, and their archives in order: files (path, content)."""
    from vaultlens.formats.xp3 import MAGIC

    found = files.where((paths.extension(F.col("path")) == ".xp3") & F.startswith("content", F.lit(MAGIC)))
    return found.groupBy(paths.folder(F.col("path")).alias("game_dir")).agg(F.array_sort(F.collect_list("path")).alias("archives"))


def plugin_files(files: DataFrame) -> DataFrame:
    """path, game_dir, name, utility, hash of plugin files."""
    plugins = files.where(paths.extension(F.col("path")) == ".tpm")
    path = F.col("path")
    return plugins.select("path", paths.folder(path).alias("game_dir"), paths.base_name(path).alias("name"), paths.is_utility_plugin(path).alias("utility"), content_sha256(F.col("content")).alias("hash"))


def plugin_for_programs(files: DataFrame) -> DataFrame:
    """game_dir, path: the plugin that program ciphers take their block from, first by name in the folder, else in its plugin/."""
    plugins = plugin_files(files).where("not utility")
    inner = plugins.where(F.col("game_dir").rlike("(^|/)plugin$")).withColumn("game_dir", F.regexp_replace("game_dir", "/?plugin$", "")).withColumn("depth", F.lit(1))
    both = plugins.withColumn("depth", F.lit(0)).unionByName(inner)
    return first_per_key(both.select("game_dir", "depth", "name", "path"), ["game_dir"], ["depth", "name"]).select("game_dir", "path")


def plugin_groups(plugins: DataFrame, books: DataFrame) -> DataFrame:
    """hash, games (sorted), n, known: largest groups first."""
    from vaultlens.operators.detect import hash_index

    grouped = plugins.where("not utility").groupBy("hash").agg(F.array_sort(F.collect_set("game_dir")).alias("games")).withColumn("n", F.size("games"))
    listed = hash_index(books, "tpm_hashes").select("hash", "game_key")
    return grouped.join(listed, "hash", "left").withColumn("known", F.col("game_key").isNotNull()).orderBy(F.desc("n"), "hash")


def flag_counts(entries: DataFrame) -> DataFrame:
    """archive, files, encrypted, error: null counts for archives that can't be read."""
    out = entries.groupBy("archive").agg(F.count("ordinal").alias("files"), F.count_if("encrypted").alias("encrypted"), F.max("error").alias("error"))
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("files", "encrypted")})


def survey_totals(counts: DataFrame, by: Column) -> DataFrame:
    """files, encrypted, errors, archives for each group of flag_counts."""
    return counts.groupBy(by.alias("group")).agg(
        F.sum("files").alias("files"), F.sum("encrypted").alias("encrypted"), F.count_if(F.col("files").isNull()).alias("errors"), F.count("*").alias("archives")
    )


def missing_by_game(missing: DataFrame) -> DataFrame:
    """game_key, game_dir, archives: missing (game_key, game_dir, archive)."""
    return missing.groupBy("game_key", "game_dir").agg(F.array_sort(F.collect_list(paths.base_name(F.col("archive")))).alias("archives"))


# --- engines ------------------------------------------------------------------------------

#: Version fields that tell engines apart.
VERSION_FIELDS = ("ProductName", "ProductVersion", "FileVersion", "InternalName", "OriginalFilename", "CompanyName")


def game_folders(files: DataFrame) -> DataFrame:
    """game_dir: the deepest folders with a program that isn't generic: files (path)."""
    name = F.lower(paths.base_name(F.col("path")))
    programs = files.where(name.endswith(".exe") & ~name.isin(*paths.GENERIC_PROGRAMS))
    return without_ancestors(programs.select(paths.folder(F.col("path")).alias("game_dir")), "game_dir")


def program_versions(files: DataFrame, libraries: bool = False) -> DataFrame:
    """game_dir, name, versions (map, null if there are none) of programs: files (path, content)."""
    kinds = (".exe", ".dll", ".scr") if libraries else (".exe",)
    path = F.col("path")

    @F.udf("map<string,string>")
    def strings(content):
        return version_strings(bytes(content)) or None

    found = files.where(paths.extension(path).isin(*kinds))
    return found.select(paths.folder(path).alias("game_dir"), paths.base_name(path).alias("name"), strings("content").alias("versions"))


def version_fingerprint(versions: Column) -> Column:
    """The non-empty fields of a map of version strings, trimmed, in order."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.try_element_at(versions, F.lit(f))).alias("value")) for f in VERSION_FIELDS))
    return F.filter(pairs, lambda p: p["value"] != "")


def fingerprint_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda p: F.concat(p["field"], F.lit("='"), p["value"], F.lit("'"))), ", ")


def engine_groups(programs: DataFrame) -> DataFrame:
    """fingerprint, folders, programs, n: programs (game_dir, name, versions map), largest groups first."""
    rows = programs.where("versions is not null").select("game_dir", "name", fingerprint_text(version_fingerprint(F.col("versions"))).alias("fingerprint"))
    out = rows.groupBy("fingerprint").agg(F.countDistinct("game_dir").alias("folders"), F.array_sort(F.collect_set("name")).alias("programs"), F.count("*").alias("n"))
    return out.orderBy(F.desc("folders"), "fingerprint")


# --- ZIP files ------------------------------------------------------------------------------

#: Charsets that names are tried in, in order.
NAME_CHARSETS = ("cp932", "euc_jp", "cp949", "big5")


def name_charset(infos: list[tuple[str, int]]) -> str | None:
    """The first charset that the first non-ASCII name (as code page 437) decodes in; None if all is ASCII or UTF-8."""
    for name, flags in infos:
        if flags & 0x800:
            return None
        try:
            raw = name.encode("cp437")
        except UnicodeEncodeError:
            continue
        if raw.isascii():
            continue
        for charset in NAME_CHARSETS:
            try:
                raw.decode(charset)
                return charset
            except UnicodeDecodeError:
                continue
    return None


def proper_name(name: str, flags: int, charset: str | None) -> str:
    if charset is None or flags & 0x800:
        return name
    try:
        return name.encode("cp437").decode(charset)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return name


ZIP = "path string, status string, charset string, file_name string, data binary"


def unzip(files: DataFrame, done: DataFrame) -> DataFrame:
    """ZIP rows of files (path, content): members of those with an archive in them; status extracted, exists, no archive or bad."""
    marked = files.select("path", "content").join(done.select("path", F.lit(True).alias("done")), "path", "left")

    schema = arrow_schema(ZIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "path", "content", "done")
        return batched((m for path, content, there in rows for m in ([(path, "exists", None, None, None)] if there else _members(path, content))), schema)

    return marked.mapInArrow(run, ZIP)


def _members(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if not any(i.filename.lower().endswith(".xp3") for i in infos):
                yield path, "no archive", None, None, None
                return
            charset = name_charset([(i.filename, i.flag_bits) for i in infos])
            for i in infos:
                if not i.is_dir():
                    yield path, "extracted", charset, proper_name(i.filename, i.flag_bits, charset), z.read(i)
    except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, EOFError):
        yield path, "bad", None, None, None


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.select("path", "status").distinct().groupBy("status").agg(F.count("*").alias("n"))


def top(df: DataFrame, value: str, k: int = 20) -> tuple[DataFrame, int]:
    """(the k most frequent values, how many more there are)."""
    return most_common(df, value, k), max(0, df.select(value).distinct().count() - k)
