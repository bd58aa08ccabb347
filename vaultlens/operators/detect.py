"""Which scheme an archive's members are obfuscated with: known plugins, known structures, then probing.

Libraries are tables (game_key, title, encryption, parameters, ...) from TOML
files of the caller's; their hashes are exploded lookups.  Each stage works on
what the earlier ones left.
"""

from __future__ import annotations

import itertools
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlens.codecs.ciphers import CIPHERS
from vaultlens.codecs.errors import MalformedError
from vaultlens.codecs.program import control_block
from vaultlens.formats import xp3
from vaultlens.functions import paths
from vaultlens.operators.relational import early_exit, first_match, last_wins, settled

RESERVED = {"title", "encryption", "tpm_hashes", "xp3_hashes"}
LIBRARY = "game_key string, ordinal int, title string, encryption string, parameters string, kind string, tpm_hashes array<string>, xp3_hashes array<string>"

#: Fixed values: (mask, offset) pairs that program ciphers are probed with.
PROGRAM_CUTS = ((0x1C9, 0x1F3), (0x20, 0x2), (0x100, 0x100), (0x200, 0x100), (0x0FF, 0x0FF))
#: Fixed values: (leaf, join, change) orders that they are probed with.
PROGRAM_ORDERS = (
    ((0, 1, 2), (0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 5, 6, 7)),
    ((2, 0, 1), (1, 2, 0, 4, 3, 5), (5, 4, 1, 0, 3, 2, 6, 7)),
    ((1, 2, 0), (1, 3, 2, 0, 4, 5), (1, 6, 4, 0, 3, 7, 5, 2)),
    ((1, 0, 2), (1, 4, 0, 3, 2, 5), (5, 4, 1, 0, 7, 6, 2, 3)),
    ((0, 2, 1), (3, 5, 2, 1, 4, 0), (7, 1, 0, 6, 3, 2, 4, 5)),
    ((2, 0, 1), (5, 0, 1, 4, 3, 2), (2, 4, 3, 0, 1, 5, 6, 7)),
    ((1, 2, 0), (2, 0, 5, 1, 3, 4), (1, 4, 2, 3, 0, 7, 6, 5)),
    ((0, 2, 1), (2, 1, 5, 4, 3, 0), (0, 4, 5, 7, 3, 1, 6, 2)),
    ((1, 2, 0), (4, 1, 3, 5, 2, 0), (5, 2, 0, 6, 4, 1, 7, 3)),
    ((0, 2, 1), (3, 4, 0, 1, 2, 5), (4, 1, 0, 3, 6, 2, 7, 5)),
    ((2, 1, 0), (3, 2, 0, 5, 4, 1), (5, 4, 7, 0, 6, 2, 3, 1)),
    ((1, 0, 2), (2, 1, 4, 5, 0, 3), (4, 6, 1, 5, 2, 7, 0, 3)),
)


def library(spark: SparkSession, toml: str, kind: str = "encrypted") -> DataFrame:
    """LIBRARY from the text of a TOML file with tables games.<key>; other than reserved keys are parameters."""
    rows = []
    for k, (key, game) in enumerate(tomllib.loads(toml).get("games", {}).items()):
        parameters = {p: v for p, v in game.items() if p not in RESERVED}
        rows.append((key, k, game.get("title"), game.get("encryption", "none"), json.dumps(parameters), kind, game.get("tpm_hashes", []), game.get("xp3_hashes", [])))
    return spark.createDataFrame(rows, LIBRARY)


def hash_index(books: DataFrame, hashes: str) -> DataFrame:
    """hash, game_key, encryption, parameters: of entries that list one hash, the last counts."""
    rows = books.select(F.explode(hashes).alias("hash"), "ordinal", "game_key", "encryption", "parameters")
    return last_wins(rows, ["hash"], "ordinal").drop("ordinal")


def by_plugin(plugins: DataFrame, books: DataFrame) -> DataFrame:
    """plugins (archive, name, hash) beside each archive: the first by name, without utilities, that is known."""
    useful = plugins.where(~paths.is_utility_plugin(F.col("name")))
    return first_match(useful, hash_index(books, "tpm_hashes"), "hash", ["archive"], ["name"]).withColumn("method", F.lit("plugin"))


def by_structure(archives: DataFrame, books: DataFrame) -> DataFrame:
    """archives (archive, hash)."""
    return archives.join(hash_index(books, "xp3_hashes"), "hash").withColumn("method", F.lit("structure"))


def structure_hashes(archives: DataFrame) -> DataFrame:
    """archive, hash of (archive, content); null where the structure can't be read."""

    @F.pandas_udf("string")
    def digest(content: pd.Series) -> pd.Series:
        def one(data):
            try:
                return xp3.structure_digest(data)
            except MalformedError:
                return None

        return content.map(one)

    return archives.select("archive", digest("content").alias("hash"))


def schemes(plugin: bytes | None = None) -> Iterator[tuple[str, dict]]:
    """What is probed, in order: schemes without parameters, then shifts, then programs of a plugin's block."""
    for name, cipher in CIPHERS.items():
        if not cipher.needs:
            yield name, {}
    for shift in range(32):
        yield "hash-xor", {"shift": shift}
    if plugin and (block := control_block(plugin)):
        for (mask, offset), (leaf, join, change) in itertools.product(PROGRAM_CUTS, PROGRAM_ORDERS):
            yield "cxcrypt", {"control_block": block, "mask": mask, "offset": offset, "prolog_order": leaf, "odd_branch_order": join, "even_branch_order": change}


def candidates(content: bytes, force: bool = False) -> list[tuple]:
    """(entry, extension, first segment's bytes) with a known signature, encrypted first, then the smallest segment."""
    out = []
    for e in xp3.parse(content):
        ext = next((x for x in paths.SIGNATURES if e.file_name.lower().endswith(x)), None)
        if ext and e.segments and e.segments[0].compressed_size > 0 and (force or e.encrypted):
            s = e.segments[0]
            out.append((e, ext, content[s.offset : s.offset + s.compressed_size]))
    return sorted(out, key=lambda c: (not c[0].encrypted, c[0].segments[0].compressed_size))


def probe_all(content: bytes, plugin: bytes | None = None, force: bool = False) -> Iterator[tuple[int, str, dict]]:
    """(place, scheme, parameters) of every scheme under which the smallest candidate begins as its extension says."""
    found = candidates(content, force)
    if not found:
        return
    entry, ext, raw = min(found, key=lambda c: c[0].segments[0].compressed_size)
    key, magic = entry.key or 0, paths.SIGNATURES[ext]
    for place, (name, parameters) in enumerate(schemes(plugin)):
        if name == "hash-xor" and not key >> parameters["shift"] & 0xFF:
            continue
        if (plain := xp3.try_decrypt(raw, entry.segments[0], key, name, parameters)) and plain.startswith(magic):
            yield place, name, parameters


def probe_one(content: bytes, plugin: bytes | None = None, force: bool = False) -> tuple[str, dict] | None:
    """The first scheme under which the smallest candidate begins as its extension says."""
    return next(((name, parameters) for _, name, parameters in probe_all(content, plugin, force)), None)


def probe_apart(content: bytes, plugin: bytes | None = None, force: bool = False) -> list[tuple[int, str, dict]]:
    """(place, scheme, parameters) of every scheme under which the smallest candidate begins as its extension says, told apart by the others.

    While several are left, the next candidate by size leaves those that fit it
    as well; one that fits none of them tells nothing.  A shift whose key byte
    is 0 changes nothing, but may be right, so it is kept until another
    candidate decides; the scheme "null" fits wherever it does, and is first.
    """
    found = sorted(candidates(content, force), key=lambda c: c[0].segments[0].compressed_size)
    left = [(place, *s) for place, s in enumerate(schemes(plugin))] if found else []
    for k, (entry, ext, raw) in enumerate(found):
        fit = [s for s in left if (plain := xp3.try_decrypt(raw, entry.segments[0], entry.key or 0, *s[1:])) and plain.startswith(paths.SIGNATURES[ext])]
        if not k or fit:
            left = fit
        if len(left) < 2:
            break
    return left


def shown(parameters: dict) -> str:
    return json.dumps({k: v for k, v in parameters.items() if k != "control_block"})


DETECTED = "archive string, encryption string, parameters string, method string"


def by_probe(archives: DataFrame, force: bool = False) -> DataFrame:
    """archives (archive, content, plugin): all schemes are tried in the task that holds the archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, content, plugin in zip(b.archive, b.content, b.plugin, strict=True):
                try:
                    rows += [(archive, name, shown(parameters), "probe") for _, name, parameters in probe_apart(content, plugin, force)[:1]]
                except MalformedError:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "encryption", "parameters", "method"])

    return archives.select("archive", "content", "plugin").mapInPandas(run, DETECTED)


GUESSES = "archive string, place int, encryption string, parameters string"


def fitting_schemes(archives: DataFrame, force: bool = False) -> DataFrame:
    """GUESSES: every scheme that fits the sample of an archive (archive, content, plugin) and that no other member rules out, with its place in schemes()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, content, plugin in zip(b.archive, b.content, b.plugin, strict=True):
                try:
                    rows += [(archive, place, name, shown(parameters)) for place, name, parameters in probe_apart(content, plugin, force)]
                except MalformedError:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "place", "encryption", "parameters"])

    return archives.select("archive", "content", "plugin").mapInPandas(run, GUESSES)


def detect(archives: DataFrame, plugins: DataFrame, books: DataFrame, force: bool = False) -> DataFrame:
    """DETECTED of every archive (archive, content, plugin) that some stage knows: plugin, then structure, then probe."""
    columns = ["archive", "encryption", "parameters", "method"]
    first = by_plugin(plugins, books).select(*columns)
    rest = archives.join(first.select("archive"), "archive", "left_anti")
    second = by_structure(structure_hashes(rest), books).select(*columns)
    rest = rest.join(second.select("archive"), "archive", "left_anti")
    return first.unionByName(second).unionByName(by_probe(rest, force))


CHECKS = "archive string, place int, file_name string, ext string, encrypted boolean, ok boolean, got string"


def fits(data: bytes | None, ext: str) -> bool:
    """Whether bytes begin as their extension says; a PNG of 16 bytes or more has its header chunk next."""
    return bool(data) and data.startswith(paths.SIGNATURES[ext]) and (ext != ".png" or len(data) < 16 or data[12:16] == b"IHDR")


def checks_of(content: bytes, scheme: str | None, parameters: dict, most: int) -> Iterator[tuple]:
    """(place, name, extension, flag, ok, first bytes) of an archive's candidates under a scheme, None: as they are."""
    place = 0
    for entry, ext, raw in candidates(content, force=True):
        segment = entry.segments[0]
        plain = xp3.try_decrypt(raw, segment, entry.key or 0, scheme or "null", parameters)
        ok = fits(plain, ext)
        if not scheme and plain is None:
            continue
        if scheme and not ok:
            bare = xp3.try_decrypt(raw, segment, 0, "null")
            if bare is not None and (segment.compressed or fits(bare, ext)):
                continue
        if scheme and place >= most:
            return
        yield place, entry.file_name, ext, entry.encrypted, ok, plain[:8].hex() if plain and len(plain) >= 8 else None
        place += 1


def scheme_checks(archives: DataFrame, most: int = 5) -> DataFrame:
    """CHECKS of archives (archive, content, plugin, encryption, parameters), each under its own scheme; null: as they are.

    Failures that are plain after all aren't counted; at most ``most`` checks of
    an archive under a scheme count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, content, plugin, scheme, parameters in zip(b.archive, b.content, b.plugin, b.encryption, b.parameters, strict=True):
                options = json.loads(parameters) if parameters else {}
                if scheme == "cxcrypt" and plugin is not None:
                    options["control_block"] = control_block(plugin) or ()
                try:
                    rows += [(archive, *check) for check in checks_of(content, scheme, options, most)]
                except MalformedError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHECKS.split(", ")])

    return archives.select("archive", "content", "plugin", "encryption", "parameters").mapInPandas(run, CHECKS)


def verification_checks(archives: DataFrame, scheme: str | None, parameters: dict | None = None, most: int = 5) -> DataFrame:
    """CHECKS of archives (archive, content) under one scheme."""
    one = {"plugin": F.lit(None).cast("binary"), "encryption": F.lit(scheme).cast("string"), "parameters": F.lit(json.dumps(parameters or {}))}
    return scheme_checks(archives.withColumns(one), most)


def verdict(checks: DataFrame, group: list[str], enough: int = 3) -> DataFrame:
    """checked, failures, confirmed: enough checks and no failure."""
    out = checks.groupBy(*group).agg(F.count("*").alias("checked"), F.count_if(~F.col("ok")).alias("failures"))
    return out.withColumn("confirmed", (F.col("checked") >= enough) & (F.col("failures") == 0))


def unencrypted(entries: DataFrame) -> DataFrame:
    """Archives none of whose entries has the encrypted flag."""
    return entries.groupBy("archive").agg(F.bool_or("encrypted").alias("any")).where("not any").select("archive")


def known(archives: DataFrame, plugins: DataFrame, books: DataFrame, plain: DataFrame) -> DataFrame:
    """Folders (game_dir) already known by a plugin, or by an archive (not a patch) of either library; plugins first."""
    a = first_match(plugins, hash_index(books, "tpm_hashes"), "hash", ["game_dir"], ["name"]).select("game_dir", "game_key", F.lit(0).alias("stage"), F.col("name"))
    hashes = hash_index(books, "xp3_hashes").unionByName(hash_index(plain, "xp3_hashes").join(hash_index(books, "xp3_hashes").select("hash"), "hash", "left_anti"))
    main = archives.where(~paths.is_patch(F.col("archive")))
    b = first_match(main, hashes, "hash", ["game_dir"], ["archive"]).select("game_dir", "game_key", F.lit(1).alias("stage"), F.col("archive").alias("name"))
    both = a.unionByName(b)
    return both.groupBy("game_dir").agg(F.min_by("game_key", F.struct("stage", "name")).alias("game_key"))


def missing_hashes(archives: DataFrame, books: DataFrame) -> DataFrame:
    """archives (archive, hash), no patches, whose hash no library lists."""
    listed = hash_index(books, "xp3_hashes").select("hash")
    return archives.where(~paths.is_patch(F.col("archive"))).where("hash is not null").join(listed, "hash", "left_anti")


def append_hashes(books: DataFrame, found: DataFrame) -> DataFrame:
    """books with found (game_key, hash) added to their entries' structure hashes, sorted, each once."""
    more = found.groupBy("game_key").agg(F.collect_set("hash").alias("more"))
    out = books.join(more, "game_key", "left")
    return out.withColumn("xp3_hashes", F.array_sort(F.array_union("xp3_hashes", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def toml_entry(key: str, title: str, encryption: str, parameters: dict, plugins: list[tuple[str, str]], archives: list[tuple[str, str]]) -> str:
    """A library entry; hashes are (hash, file name), patches are left out."""
    lines = [f"[games.{key}]", f"title = {json.dumps(title, ensure_ascii=False)}", f'encryption = "{encryption}"']
    lines += [f"{k} = {json.dumps(v)}" for k, v in parameters.items()]
    for name, hashes in (("tpm_hashes", plugins), ("xp3_hashes", [h for h in archives if not h[1].startswith("patch")])):
        lines += [f"{name} = [", *(f'    "{h}", # {file}' for h, file in hashes), "]"]
    return "\n".join(lines)


def identify_games(archives: DataFrame, plugins: DataFrame, books: DataFrame, plain: DataFrame, enough: int = 3) -> DataFrame:
    """game_dir, status, encryption, parameters, checked, failures for every folder of archives.

    archives: game_dir, archive, hash, content, plugin; plugins: game_dir, name,
    hash.  Statuses: known; unencrypted (no flags, and enough contents are as
    their names say); inconclusive (no flags, too few contents); confirmed (the
    first of all schemes that fit a sample that fits enough contents and fails
    none); failed.  Folders without
    flags whose contents don't fit are probed like flagged ones.
    """
    from vaultlens.operators import archives as relations

    blank = {"encryption": F.lit(None).cast("string"), "parameters": F.lit(None).cast("string")}
    counts = {"checked": F.lit(0).cast("long"), "failures": F.lit(0).cast("long")}
    columns = ["game_dir", "status", "encryption", "parameters", "checked", "failures"]
    listed = books.select("game_key", "encryption", "parameters").unionByName(plain.select("game_key", "encryption", "parameters"))
    seen = known(archives, plugins, books, plain).join(listed, "game_key", "left").withColumn("status", F.lit("known")).withColumns(counts).select(*columns)
    seen = settled(seen)  # each step's result is read by several of the next
    rest = archives.join(seen.select("game_dir"), "game_dir", "left_anti")
    flags = relations.scan(rest.select("archive", F.lit("xp3").alias("format"), "content")).groupBy("archive").agg(F.bool_or("encrypted").alias("flagged"))
    dirs = rest.select("game_dir", "archive").join(flags, "archive").groupBy("game_dir").agg(F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("flagged"))
    bare = rest.join(dirs.where("not flagged").select("game_dir"), "game_dir", "left_semi")
    checks = verification_checks(bare, None).join(bare.select("game_dir", "archive"), "archive").withColumn("bad", ~F.col("ok"))
    tally = early_exit(checks, ["game_dir"], ["archive", "place"], "bad", enough)
    tally = dirs.where("not flagged").select("game_dir").join(tally, "game_dir", "left").fillna({"checked": 0, "failures": 0, "confirmed": False})
    unflagged = tally.withColumn("status", F.when(F.col("confirmed"), "unencrypted").when(F.col("failures") == 0, "inconclusive")).withColumns(blank)
    done = settled(unflagged.where("status is not null").select(*columns))
    open_ = rest.join(done.select("game_dir"), "game_dir", "left_anti")
    guesses = fitting_schemes(open_, force=True).join(open_.select("game_dir", "archive"), "archive")
    guesses = settled(guesses.groupBy("game_dir", "encryption", "parameters").agg(F.min("place").alias("place")))
    tries = open_.where(~paths.is_patch(F.col("archive"))).join(guesses, "game_dir")
    tagged = tries.withColumn("archive", F.to_json(F.struct("archive", "encryption", "parameters")))
    results = scheme_checks(tagged).join(tagged.select("archive", "game_dir", F.col("place").alias("scheme"), "encryption", "parameters"), "archive")
    best = verdict(results, ["game_dir", "scheme", "encryption", "parameters"], enough).where("confirmed")
    best = best.groupBy("game_dir").agg(F.min(F.struct("scheme", "encryption", "parameters", "checked", "failures")).alias("b")).select("game_dir", "b.*")
    confirmed = settled(best.withColumn("status", F.lit("confirmed")).select(*columns))
    failed = open_.select("game_dir").distinct().join(confirmed.select("game_dir"), "game_dir", "left_anti")
    failed = failed.withColumn("status", F.lit("failed")).withColumns(blank).withColumns(counts).select(*columns)
    return seen.unionByName(done).unionByName(confirmed).unionByName(failed)


# --- what observed keys and byte maps say about an unknown scheme ------------------------


def matching_formulas(observations: DataFrame) -> DataFrame:
    """formula, scheme that give the key byte of every observation (h, key)."""
    from vaultlens.functions.bytes import key_formulas
    from vaultlens.operators.relational import all_hold

    tries = observations.select("key", F.inline(key_formulas(F.col("h"))).alias("formula", "scheme", "guess"))
    return all_hold(tries, ["formula", "scheme"], F.col("key") == F.col("guess")).select("formula", "scheme")


def formula_candidates(formulas: DataFrame) -> DataFrame:
    """Schemes that can be tried for matching formulas: encryption and its shift."""
    shift = F.regexp_extract("scheme", r"^hash-xor shift=(\d+)$", 1)
    return formulas.where(shift != "").select(F.lit("hash-xor").alias("encryption"), shift.cast("int").alias("shift"))


def map_traits(pairs: DataFrame) -> DataFrame:
    """One row about a byte map (given, made): bijective, involution, xor_key (null unless one fits all changed bytes), spins."""
    back = pairs.select(F.col("given").alias("made"), F.col("made").alias("again"))
    both = pairs.join(F.broadcast(back), "made", "left")  # 256 rows at most
    given, made = F.col("given"), F.col("made")
    turn = F.bit_count(given) % 8
    spun = F.expr("(given * int(pow(2, bit_count(given) % 8))) % 256 + (given * int(pow(2, bit_count(given) % 8))) div 256")
    keys = F.collect_set(F.when(given != made, given.bitwiseXOR(made)))
    return both.agg(
        (F.countDistinct("made") == 256).alias("bijective"), F.coalesce(F.bool_and(F.col("again") == given), F.lit(False)).alias("involution"),
        F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).alias("xor_key"), F.bool_and(made == F.when(turn == 0, given).otherwise(spun)).alias("spins"),
    )


def depends_on(observations: DataFrame, key: str, value: str) -> bool:
    """Whether one key was seen with more than one value."""
    return not observations.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1").isEmpty()
