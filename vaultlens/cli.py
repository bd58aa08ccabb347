"""python -m vaultlens.cli identify|extract|create|survey ..., and <format> extract|create ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.formats import registry
from vaultlens.functions import paths
from vaultlens.operators import archives, detect, relational, surveys
from vaultlens.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vaultlens")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("identify", help="print each file's format")
    p.add_argument("files", nargs="+")
    extract_options(commands.add_parser("extract", help="extract members of an archive, or of all archives below a folder"))
    p = commands.add_parser("create", help="pack a folder's files")
    p.add_argument("--format", required=True, choices=formats())
    create_options(p)
    for name in formats():
        each = commands.add_parser(name, help=f"extract or create {name} archives").add_subparsers(dest="action", required=True)
        extract_options(each.add_parser("extract"))
        create_options(each.add_parser("create"))
    p = commands.add_parser("survey", help="print a report about the files below a folder")
    p.add_argument("kind", choices=sorted(REPORTS))
    p.add_argument("input")
    p.add_argument("--library", help="TOML file of known schemes")
    p.add_argument("--rows", type=int, default=20, help="rows printed; how many more there are is said")
    return top


def formats() -> list[str]:
    return sorted({*archives.BUILDERS, *(n for n, f in registry.FORMATS.items() if f.build)})


def extract_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--glob")
    p.add_argument("--encryption", help="scheme of members; default: detected")
    p.add_argument("--key", help="its parameter: a shift, or hex digits")
    p.add_argument("--library", help="TOML file of known schemes")
    p.add_argument("--no-auto-detect", action="store_true")
    p.add_argument("--force-detect", action="store_true")
    p.add_argument("--force-encrypt", action="store_true", help="decrypt members without the flag too")
    p.add_argument("--convert-images", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--decode-text", action=argparse.BooleanOptionalAction, default=True)


def create_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--glob")
    p.add_argument("--compress", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--encryption")
    p.add_argument("--key")
    p.add_argument("--index-format", choices=("atm", "at2"), default="at2")
    p.add_argument("--scramble", action="store_true")


def scheme_parameters(name: str | None, key: str | None) -> dict:
    if name == "hash-xor":
        return {"shift": int(key or 0)}
    return {"key": key} if key else {}


def identify(spark: SparkSession, named: list[str]) -> list[tuple[str, str | None]]:
    out = []
    for path in named:
        try:
            with open(path, "rb") as f:
                head = f.read(16)
                f.seek(max(0, os.path.getsize(path) - 6))
                out.append((path, registry.identify(path, head, f.read(6))))
        except OSError:
            out.append((path, None))
    return out


def library(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    if not options.library:
        return detect.library(spark, "")
    with open(options.library, encoding="utf-8") as f:
        return detect.library(spark, f.read())


def schemed(spark: SparkSession, found: DataFrame, options: argparse.Namespace) -> DataFrame:
    """found with scheme and parameters of each archive: the one asked for, or the detected one by library structures and then by probing."""
    tagged = F.col("format") == "xp3"
    if options.encryption:
        given = json.dumps(scheme_parameters(options.encryption, options.key))
        return found.withColumns({"scheme": F.when(tagged, F.lit(options.encryption)), "parameters": F.when(tagged, F.lit(given))})
    if options.no_auto_detect:
        return found
    none = spark.createDataFrame([], "archive string, name string, hash string")
    rows = detect.detect(found.where(tagged).withColumn("plugin", F.lit(None).cast("binary")), none, library(spark, options), options.force_detect)
    rows = rows.groupBy("archive").agg(F.first(F.struct(F.col("encryption").alias("scheme"), "parameters")).alias("s")).select("archive", "s.*")
    return found.join(relational.settled(rows), "archive", "left")


def extract(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """One plan whatever the number of archives: each carries its own scheme."""
    found = archives.read_archives(spark, options.input).where("format != 'det'").unionByName(archives.bundle_companions(spark, options.input))
    if options.command != "extract":
        found = found.where(F.col("format") == options.command)
    out = archives.payloads(schemed(spark, found, options), options.glob, force=options.force_encrypt)
    return files.extract(out, options.output, options.convert_images, options.decode_text, options.input if os.path.isdir(options.input) else None)


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def report_plugins(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    return surveys.plugin_groups(surveys.plugin_files(binary_files(spark, options.input)), library(spark, options)).select("n", "known", "hash", F.array_join("games", ", ").alias("games"))


def report_engines(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    groups = surveys.engine_groups(surveys.program_versions(binary_files(spark, options.input)))
    return groups.select("folders", "n", "fingerprint", F.array_join("programs", ", ").alias("programs"))


def report_images(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    pictures = binary_files(spark, options.input).where("lower(path) like '%.tlg'")
    return surveys.image_survey(pictures).orderBy("metric", F.desc("n"), "value")


def report_archives(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    return surveys.flag_counts(archives.scan(archives.read_archives(spark, options.input).where("format != 'det'"))).orderBy("archive")


def report_games(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Each folder's scheme, identified and verified."""
    everything = binary_files(spark, options.input)
    found = archives.read_archives(spark, options.input).where("format = 'xp3'").drop("format")
    own = surveys.plugin_for_programs(everything).join(everything, "path").select("game_dir", F.col("content").alias("plugin"))
    rows = found.withColumn("game_dir", paths.folder(F.col("archive"))).join(own, "game_dir", "left").join(detect.structure_hashes(found), "archive")
    plugins = surveys.plugin_files(everything).where("not utility").select("game_dir", "name", "hash")
    books = library(spark, options)
    return detect.identify_games(rows, plugins, books, books.limit(0)).orderBy("status", "game_dir")


REPORTS = {"archives": report_archives, "engines": report_engines, "games": report_games, "images": report_images, "plugins": report_plugins}


def survey(spark: SparkSession, options: argparse.Namespace) -> None:
    """Print the first rows of a report, and how many more there are."""
    report = REPORTS[options.kind](spark, options)
    shown = report.limit(options.rows).collect()
    print("\t".join(report.columns))
    for r in shown:
        print("\t".join("" if x is None else str(x) for x in r))
    if len(shown) == options.rows and (more := report.count() - options.rows) > 0:
        print(f"and {more} more")


def create(spark: SparkSession, options: argparse.Namespace) -> int:
    """Pack every file below the input folder, in order of path; the number of members."""
    import fnmatch

    rows = []
    for folder, _, names in sorted(os.walk(options.input)):
        for name in sorted(names):
            path = os.path.relpath(os.path.join(folder, name), options.input)
            if options.glob is None or fnmatch.fnmatchcase(path, options.glob):
                with open(os.path.join(folder, name), "rb") as f:
                    rows.append((len(rows), path, f.read()))
    if not rows:
        raise SystemExit("no files to pack")
    extra: dict = {}
    if options.format == "xp3":
        extra = {"compress": options.compress is not False, "scheme": options.encryption, "parameters": scheme_parameters(options.encryption, options.key)}
    elif options.format == "vf":
        extra = {"compress": options.compress, "mix": options.scramble}
    elif options.format == "det":
        extra = {"kind": options.index_format, "compress": bool(options.compress)}
    from vaultlens.formats.model import Member

    data = archives.builder(options.format)([Member(n, d) for _, n, d in rows], extra)
    parts = registry.unbundle(data) if options.format == "det" else {None: data}
    for kind, content in parts.items():
        with open(options.output if kind in (None, "det") else f"{os.path.splitext(options.output)[0]}.{kind}", "xb") as f:
            f.write(content)
    return len(rows)


def main(arguments: list[str] | None = None) -> int:
    registry.discover()
    options = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("vaultlens").getOrCreate()
    action = getattr(options, "action", options.command)
    if action == "identify":
        for path, kind in identify(spark, options.files):
            print(f"{path}: {kind or 'unknown format'}")
    elif action == "survey":
        survey(spark, options)
    elif action == "create":
        options.format = getattr(options, "format", options.command)
        print(f"{create(spark, options)} members")
    else:
        if os.path.isfile(options.input) and identify(spark, [options.input])[0][1] is None:
            print(f"{options.input}: unknown format", file=sys.stderr)
            return 1
        for r in extract(spark, options).groupBy("status").count().orderBy("status").collect():
            print(f"{r.status}: {r['count']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
