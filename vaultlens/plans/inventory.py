"""Registered queries that run the library's surveys, identification and codecs on fixtures made of the driver's tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.codecs import pe
from vaultlens.functions import bytes as fb
from vaultlens.functions import paths
from vaultlens.operators import archives, detect, surveys
from vaultlens.operators import relational as rel
from vaultlens.plans.queries import ARCHIVE, ENCODERS, NAME, drawn, members, query, read

# --- golden bytes ---------------------------------------------------------------------

#: Fixed values: (case, function, input, its bytes decoded), all in hex.
GOLDEN = (
    ("escape before the escape", "lz77", "41FFFF42", "41FF42"),
    ("copy from four back", "lz77", "41424344FF0C", "41424344414243"),
    ("copy that overlaps itself", "lz77", "41FF03", "41414141414141"),
    ("escape at the end", "lz77", "41FF", "41"),
    ("copy from before the start", "lz77", "41FF08", None),
    ("ring copy of written bytes", "lzss", "0500000007414243" + "0010", "4142434142"),
    ("ring copy of blank bytes", "lzss", "050000000758595A" + "FFF0", "58595A0000"),
    ("ring copy that overlaps itself", "lzss", "060000000141" + "0013", "414141414141"),
    ("ring that ends early", "lzss", "060000000141", None),
    ("script byte", "script", "58", "16"),
    ("hash key F8 by 3", "hash", "00FF1FA0", "1FE000BF"),
    ("fixed key 0102", "fixed", "10203040", "11223142"),
    ("successor of hash 0", "successor", "00FFFEA0", "FE01005E"),
    ("spun bytes", "spin", "A5FF0180", "5AFF0201"),
    ("masked name", "mask", "0966D78CD5828389FF22CC96", "30303030303030312E6C7362"),
    ("framed mark", "frame", "FEFE01FFFE", "FFFE"),
    ("text without a frame", "frame", "706C61696E", "706C61696E"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {f'{chr(39)}{made}{chr(39)}' if made else 'NULL'})" for c, _, _, made in GOLDEN) + ") v(name, made)")
def golden_bytes(spark, sf_dir):
    """What published byte strings decode to, a null where they are malformed."""
    data, key = F.unhex("given"), F.lit(0).cast("long")
    out = {
        "lz77": fb.lz77_decode(data), "lzss": fb.lzss_decode(data), "script": fb.script_decrypt(data), "hash": fb.hash_xor(data, F.lit(0xF8), 3), "fixed": fb.fixed_xor(data, "0102"),
        "successor": fb.successor_xor(data, key), "spin": fb.spin_decrypt(data), "mask": fb.mask_names(data, F.lit(1)), "frame": fb.text_decode(data),
    }
    rows = spark.createDataFrame([(c, kind, given) for c, kind, given, _ in GOLDEN], "name string, kind string, given string")
    made = F.coalesce(*(F.when(F.col("kind") == k, F.hex(v)) for k, v in out.items()))
    return rows.select("name", made.alias("made"))


# --- libraries and known games ---------------------------------------------------------


def books(rows: DataFrame, kind: str = "encrypted", key: str = "source") -> DataFrame:
    """detect.LIBRARY with an entry for each key: rows (key, number, encryption, tpm, xp3), hashes null where there are none."""
    grouped = rows.groupBy(F.col(key).alias("game_key"), F.col("number").cast("int").alias("ordinal"), "encryption")
    lists = grouped.agg(F.collect_set("tpm").alias("tpm_hashes"), F.collect_set("xp3").alias("xp3_hashes"))
    return lists.select("game_key", "ordinal", F.col("game_key").alias("title"), "encryption", F.lit("{}").alias("parameters"), F.lit(kind).alias("kind"), "tpm_hashes", "xp3_hashes")


NUMBER = "int(regexp_extract(source, '([0-9]+)', 1))"
NUMBER_SQL = "regexp_extract(source, '([0-9]+)', 1)::INT"
NONE = "string(null)"


def plugin_fixture(spark, sf_dir) -> DataFrame:
    """Files (path, content) of plugins: each document is one, in a folder of its language and a seventh; a ninth are utilities."""
    name = F.when(F.col("doc_id") % 9 == 0, "menu.tpm").otherwise(F.concat("source", F.lit(".TPM")))
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/g"), F.col("doc_id") % 7, F.lit("/"), name)
    return members(spark, sf_dir).select(path.alias("path"), F.col("data").alias("content"), "doc_id", "source")


PLUGIN_SQL = """p AS (SELECT coalesce(lang, '') || '/g' || doc_id % 7 AS game_dir, source, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'menu.tpm' ELSE source || '.TPM' END AS name,
 sha256(coalesce(text, '')) AS hash FROM documents)"""


def listed(spark, sf_dir) -> DataFrame:
    """The library: an entry for each source, with the digests of its documents that labels call good."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = members(spark, sf_dir).join(good, "doc_id", "left_semi")
    return books(docs.select("source", F.expr(NUMBER).alias("number"), F.lit("poringsoft").alias("encryption"), fb.content_sha256(F.col("data")).alias("tpm"), F.expr(NONE).alias("xp3")))


LISTED_SQL = f"""l AS (SELECT sha256(coalesce(text, '')) AS hash, arg_max(source, {NUMBER_SQL}) AS game_key FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)"""


@query(
    f"""WITH {PLUGIN_SQL}, {LISTED_SQL}
SELECT hash, string_agg(DISTINCT game_dir, ',' ORDER BY game_dir) AS games, count(DISTINCT game_dir)::INT AS n, any_value(game_key) AS game_key, any_value(game_key) IS NOT NULL AS known
FROM p LEFT JOIN l USING (hash) WHERE name <> 'menu.tpm' GROUP BY hash"""
)
def plugin_group_survey(spark, sf_dir):
    groups = surveys.plugin_groups(surveys.plugin_files(plugin_fixture(spark, sf_dir)), listed(spark, sf_dir))
    return groups.select("hash", F.array_join("games", ",").alias("games"), "n", "game_key", "known")


@query(f"WITH {PLUGIN_SQL} SELECT game_dir, game_dir || '/' || min(name) AS path FROM p WHERE name <> 'menu.tpm' GROUP BY game_dir")
def plugin_of_folder(spark, sf_dir):
    """The plugin of each folder that a program cipher would take its block from."""
    return surveys.plugin_for_programs(plugin_fixture(spark, sf_dir)).select("game_dir", "path")


@query(
    f"""WITH {PLUGIN_SQL}, {LISTED_SQL}, f AS (SELECT game_dir, game_key FROM p JOIN l USING (hash) QUALIFY row_number() OVER (PARTITION BY game_dir ORDER BY name, doc_id) = 1),
a AS (SELECT DISTINCT game_dir FROM p), named AS (SELECT game_dir, min(CASE WHEN source LIKE 'src1%' THEN source END) AS key FROM p GROUP BY game_dir)
SELECT a.game_dir, coalesce(f.game_key, 'plain ' || n.key) AS game_key FROM a LEFT JOIN f USING (game_dir) JOIN named n USING (game_dir) WHERE coalesce(f.game_key, n.key) IS NOT NULL"""
)
def known_games(spark, sf_dir):
    """Folders known by a plugin, else by an archive that is no patch: every folder has an archive of its own for each source."""
    plugins = surveys.plugin_files(plugin_fixture(spark, sf_dir)).join(plugin_fixture(spark, sf_dir).select("path", "doc_id", fb.content_sha256(F.col("content")).alias("hash")), ["path", "hash"])
    plugins = plugins.where("not utility or true").select("game_dir", F.format_string("%s %020d", "name", "doc_id").alias("name"), "hash")
    rows = plugin_fixture(spark, sf_dir).select(paths.folder(F.col("path")).alias("game_dir"), "source").distinct()
    found = rows.select("game_dir", F.concat(F.when(F.col("source").like("src2%"), "patch_").otherwise(""), "source", F.lit(".xp3")).alias("archive"), F.sha2(F.concat("game_dir", "source"), 256).alias("hash"))
    plain = rows.where("source like 'src1%'").select(F.concat(F.lit("plain "), "source").alias("key"), F.expr(NUMBER).alias("number"), F.lit("none").alias("encryption"), F.expr(NONE).alias("tpm"), F.sha2(F.concat("game_dir", "source"), 256).alias("xp3"))
    return detect.known(found, plugins, listed(spark, sf_dir), books(plain, "plain", "key")).select("game_dir", "game_key")


@query(
    f"""WITH d AS (SELECT *, sha256(coalesce(text, '')) AS hash, {ARCHIVE} || CASE WHEN doc_id % 5 = 0 THEN '/patch' ELSE '/data' END || doc_id || '.xp3' AS archive FROM documents),
k AS (SELECT DISTINCT hash FROM d JOIN labels USING (doc_id) WHERE quality = 1)
SELECT source AS game_key, string_agg(replace(archive, {ARCHIVE} || '/', ''), ',' ORDER BY replace(archive, {ARCHIVE} || '/', '')) AS archives, count(*) AS n
FROM d WHERE doc_id % 5 <> 0 AND hash NOT IN (SELECT hash FROM k) GROUP BY source"""
)
def missing_by_game(spark, sf_dir):
    """Archives, patches aside, whose hash no entry of the library lists, by game."""
    name = F.concat("archive", F.when(F.col("doc_id") % 5 == 0, "/patch").otherwise("/data"), "doc_id", F.lit(".xp3"))
    found = members(spark, sf_dir).select("source", name.alias("archive"), fb.content_sha256(F.col("data")).alias("hash"))
    library = listed(spark, sf_dir).select("game_key", "ordinal", "title", "encryption", "parameters", "kind", F.col("xp3_hashes").alias("tpm_hashes"), F.col("tpm_hashes").alias("xp3_hashes"))
    missing = detect.missing_hashes(found, library).select(F.col("source").alias("game_key"), F.lit("all").alias("game_dir"), "archive")
    return surveys.missing_by_game(missing).select("game_key", F.array_join("archives", ",").alias("archives"), F.size("archives").cast("long").alias("n"))


@query(
    f"""WITH {LISTED_SQL}, m AS (SELECT game_key, list(hash) AS own FROM l GROUP BY game_key), a AS (SELECT source, list(DISTINCT sha256(source || doc_id)) AS more, list(DISTINCT sha256(coalesce(text, ''))) AS good
 FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source)
SELECT source AS game_key, array_to_string(list_sort(list_distinct(list_concat(more, good))), ',') AS hashes FROM a"""
)
def library_with_more_hashes(spark, sf_dir):
    """The library after archives' hashes were added to their entries."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = members(spark, sf_dir).join(good, "doc_id", "left_semi").select(F.col("source").alias("game_key"), F.sha2(F.concat("source", "doc_id"), 256).alias("hash"))
    swapped = listed(spark, sf_dir).withColumn("xp3_hashes", F.col("tpm_hashes"))
    return detect.append_hashes(swapped, found).select("game_key", F.array_join("xp3_hashes", ",").alias("hashes"))


# --- folders, engines, ZIP files --------------------------------------------------------

PAGE = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH f AS (SELECT {PAGE} AS game_dir, string_agg({PAGE} || '/' || page_id || '.XP3', ',' ORDER BY {PAGE} || '/' || page_id || '.XP3') AS archives FROM pages WHERE page_id % 3 = 0 GROUP BY 1)
SELECT game_dir, archives FROM f""")
def archive_folder_survey(spark, sf_dir):
    """Folders with archives by extension and first bytes; a third of the files has both, others the one or the other."""
    k, place = F.col("page_id") % 3, F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    name = F.concat(place, F.lit("/"), "page_id", F.when(k == 1, ".dat").otherwise(".XP3"))
    files = read(spark, sf_dir, "pages").select(name.alias("path"), F.when(k < 2, F.lit(b"XP3\r\n \n\x1a\x8b\x67\x01....")).otherwise(F.lit(b"XP3 but not quite")).alias("content"))
    return surveys.archive_folders(files).select("game_dir", F.array_join("archives", ",").alias("archives"))


@query(
    f"""WITH d AS (SELECT DISTINCT {PAGE} AS game_dir FROM pages WHERE page_id % 3 <> 1)
SELECT game_dir FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE starts_with(b.game_dir, a.game_dir || '/'))"""
)
def game_folder_survey(spark, sf_dir):
    """The deepest folders with a program of their own; a third of all programs is an installer."""
    place = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    name = F.when(F.col("page_id") % 3 == 1, "Setup.exe").otherwise(F.concat(F.lit("game"), "page_id", F.lit(".EXE")))
    return surveys.game_folders(read(spark, sf_dir, "pages").select(F.concat(place, F.lit("/"), name).alias("path")))


@query(
    """WITH v AS (SELECT source AS game_dir, doc_id || '.exe' AS name, 'ProductName=''' || lang || ''', FileVersion=''1.' || doc_id % 3 || '''' || CASE WHEN doc_id % 2 = 0 THEN ', CompanyName=''c''' ELSE '' END AS fingerprint
 FROM documents WHERE doc_id % 5 <> 0)
SELECT fingerprint, count(DISTINCT game_dir) AS folders, string_agg(DISTINCT name, ',' ORDER BY name) AS programs, count(*) AS n FROM v GROUP BY fingerprint"""
)
def engine_survey(spark, sf_dir):
    """Programs with a version resource, by what their version strings say; a fifth of the files has none."""

    @F.pandas_udf("binary")
    def program(lang: pd.Series, doc_id: pd.Series) -> pd.Series:
        def one(text, k):
            strings = {"FileVersion": f" 1.{k % 3}", "ProductName": text, "CompanyName": "c " if k % 2 == 0 else "", "LegalCopyright": "x"}
            return b"MZ" + bytes(77) + (pe.version_resource(strings) if k % 5 else b"")

        return pd.Series([one(*x) for x in zip(lang, doc_id, strict=True)])

    docs = read(spark, sf_dir, "documents")
    files = docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".exe")).alias("path"), program("lang", "doc_id").alias("content"))
    groups = surveys.engine_groups(surveys.program_versions(files))
    return groups.select("fingerprint", "folders", F.array_join("programs", ",").alias("programs"), "n")


@query(
    """SELECT doc_id || '.zip' AS path, CASE doc_id % 4 WHEN 0 THEN 'no archive' WHEN 1 THEN 'extracted' WHEN 2 THEN 'bad' ELSE 'exists' END AS status,
 CASE WHEN doc_id % 4 = 1 THEN 'cp932' END AS charset, CASE WHEN doc_id % 4 = 1 THEN 'テキスト' || doc_id || '.xp3' END AS file_name, CASE WHEN doc_id % 4 = 1 THEN sha256(coalesce(text, '')) END AS sha FROM documents"""
)
def zip_survey(spark, sf_dir):
    """ZIP files with an archive whose name is in another charset, without one, broken, and already there."""

    def one(d: bytes, k: int) -> bytes:
        if k % 4 == 2:
            return b"PK" + d
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            raw = f"テキスト{k}.{'xp3' if k % 2 else 'txt'}".encode("cp932")
            z.writestr(zipfile.ZipInfo("N" * len(raw)), d)
        return out.getvalue().replace(b"N" * len(raw), raw)

    zipped = fb.byte_function(one)
    files = members(spark, sf_dir).select(F.concat("doc_id", F.lit(".zip")).alias("path"), zipped("data", "doc_id").alias("content"), "doc_id")
    rows = surveys.unzip(files, files.where("doc_id % 4 = 3").select("path"))
    return rows.select("path", "status", "charset", "file_name", F.when(F.col("data").isNotNull(), F.sha2("data", 256)).alias("sha"))


# --- images ------------------------------------------------------------------------------

KINDS = tuple(ENCODERS)[:2]


def images(spark, sf_dir) -> DataFrame:
    """path, content, vec_id of pictures, of either kind by turns, and of something else at every fifth place."""
    rows = read(spark, sf_dir, "embeddings")
    path = F.format_string("img/%06d.tlg", "vec_id")
    content = F.when(F.col("vec_id") % 5 == 0, F.lit(b"not a picture at all")).when(F.col("vec_id") % 2 == 0, drawn(ENCODERS[KINDS[0]])("embedding")).otherwise(drawn(ENCODERS[KINDS[1]])("embedding"))
    return rows.select(path.alias("path"), content.alias("content"), "vec_id")


@query(
    """WITH e AS (SELECT vec_id % 5 = 0 AS bad, vec_id % 2 = 0 AS strips FROM embeddings), r AS (
 SELECT unnest(CASE WHEN bad THEN ['unknown_magic=6e6f7420612070696374 7'] WHEN strips THEN ['kind=strips', 'strips_channels=4', 'strips_rows=4', 'dimensions=8x8']
  ELSE ['kind=container', 'trailing=false', 'kind=blocks', 'blocks_channels=3', 'dimensions=8x8', 'blocks_data_flag=0', 'blocks_color_type=0', 'blocks_external_table=0', 'blocks_method=0', 'blocks_method=0', 'blocks_method=0'] END) AS item FROM e)
SELECT split_part(item, '=', 1) AS metric, count(*) AS n, string_agg(DISTINCT CASE WHEN item LIKE 'unknown%' THEN '' ELSE split_part(item, '=', 2) END, ',' ORDER BY CASE WHEN item LIKE 'unknown%' THEN '' ELSE split_part(item, '=', 2) END) AS vals FROM r GROUP BY 1"""
)
def image_header_survey(spark, sf_dir):
    """How often each header value occurs; the two that depend on the pixels are left out."""
    found = surveys.image_survey(images(spark, sf_dir)).where("metric not in ('strip_block', 'blocks_longest_pool')")
    value = F.when(F.col("metric") == "unknown_magic", "").otherwise(F.col("value"))
    return found.groupBy("metric").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("vals"))


@query(
    """WITH p AS (SELECT vec_id, printf('%06d.tlg', vec_id) AS name, CASE WHEN vec_id % 2 = 0 THEN 'strips' ELSE 'blocks' END AS kind FROM embeddings WHERE vec_id % 5 <> 0)
SELECT name, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'archive' || vec_id END AS archive, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'member' || vec_id END AS member, kind
FROM p QUALIFY row_number() OVER (PARTITION BY kind ORDER BY name) <= 5"""
)
def curated_images(spark, sf_dir):
    """The first five pictures of each make, with where two thirds of them came from."""
    rows = images(spark, sf_dir)
    name, other = paths.base_name(F.col("path")), F.concat(F.lit("later"), "vec_id")
    manifest = rows.where("vec_id % 3 <> 0").select(name.alias("name"), F.concat(F.lit("archive"), "vec_id").alias("archive"), F.concat(F.lit("member"), "vec_id").alias("member"), F.lit(0).alias("place"))
    again = rows.where("vec_id % 3 <> 0").select(name.alias("name"), other.alias("archive"), other.alias("member"), F.lit(1).alias("place"))
    kept = surveys.curate(rows, manifest.unionByName(again))
    return kept.select("name", "archive", "member", F.get_json_object("fingerprint", "$.inner").alias("kind"))


@query(
    """SELECT printf('dir/%d.TLG', vec_id) AS member, 'a' || vec_id % 3 AS archive, vec_id % 10 < 4 AS had FROM embeddings WHERE vec_id % 5 <> 0"""
)
def collected_images(spark, sf_dir):
    """Image members by name and first bytes, and whether their contents were already stored."""
    rows = images(spark, sf_dir).select(F.concat(F.lit("a"), F.col("vec_id") % 3).alias("archive"), F.format_string("dir/%d.TLG", "vec_id").alias("file_name"), F.col("content").alias("data"), "vec_id")
    have = rows.where("vec_id % 10 < 4").select(fb.content_sha256(F.col("data")).alias("sha"))
    new, manifest = surveys.collect_images(rows.drop("vec_id"), have)
    fresh = manifest.join(new.select(F.concat("sha", F.lit(".tlg")).alias("name"), F.lit(False).alias("had")), "name", "left")
    return fresh.select("member", "archive", F.coalesce("had", F.lit(True)).alias("had"))


# --- archives of several schemes --------------------------------------------------------

TURN = f"({NUMBER} + doc_id div 500) % 4"
TURN_SQL = f"({NUMBER_SQL} + doc_id // 500) % 4"
SCHEMES = (None, "poringsoft", "hash-xor", "pinpoint")


def packed(spark, sf_dir) -> DataFrame:
    """ARCHIVES of documents as pictures, plain or under one of three schemes by turns, with the turn."""
    rows = members(spark, sf_dir).withColumn("turn", F.expr(TURN)).withColumn("file_name", F.concat("file_name", F.lit(".png")))
    rows = rows.withColumn("data", F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), "data"))
    out = None
    for k, scheme in enumerate(SCHEMES):
        part = archives.pack(rows.where(F.col("turn") == k), "xp3", scheme=scheme, parameters={"shift": 5} if scheme == "hash-xor" else None).withColumn("turn", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return rel.settled(out)


def structures(found: DataFrame, turn: int) -> DataFrame:
    """A library that knows the archives of one turn by their structure."""
    hashes = detect.structure_hashes(found.where(F.col("turn") == turn))
    return books(hashes.select(F.lit("known").alias("source"), F.lit(1).alias("number"), F.lit(SCHEMES[turn]).alias("encryption"), F.expr(NONE).alias("tpm"), F.col("hash").alias("xp3")))


ARCHIVES_SQL = f"SELECT DISTINCT {ARCHIVE} AS archive, {TURN_SQL} AS turn FROM documents"


@query(
    f"""SELECT archive, CASE turn WHEN 3 THEN 'structure' WHEN 2 THEN 'plugin' ELSE 'probe' END AS method, CASE turn WHEN 1 THEN 'fits' WHEN 2 THEN 'listed' ELSE 'pinpoint' END AS encryption
FROM ({ARCHIVES_SQL}) WHERE turn <> 0"""
)
def detection_stages(spark, sf_dir):
    """Archives known by a plugin beside them, else by structure, else by probing, where any scheme that fits the sample may come first; plain ones by none."""
    found = packed(spark, sf_dir).withColumn("plugin", F.lit(None).cast("binary"))
    plugins = found.where("turn = 2").select("archive", F.explode(F.array(F.lit("menu.tpm"), F.lit("own.tpm"))).alias("name"), F.sha2(F.col("archive").cast("binary"), 256).alias("hash"))
    own = books(plugins.select(F.lit("own").alias("source"), F.lit(0).alias("number"), F.lit("listed").alias("encryption"), F.col("hash").alias("tpm"), F.expr(NONE).alias("xp3")))
    rows = detect.detect(found, plugins, own.unionByName(structures(found, 3)))
    return rows.select("archive", "method", F.when(F.col("method") == "probe", "fits").otherwise(F.col("encryption")).alias("encryption"))


@query(
    f"""SELECT archive AS game_dir, CASE turn WHEN 0 THEN 'unencrypted' WHEN 3 THEN 'known' ELSE 'confirmed' END AS status,
 CASE turn WHEN 1 THEN 'poringsoft' WHEN 2 THEN 'hash-xor' WHEN 3 THEN 'pinpoint' END AS encryption FROM ({ARCHIVES_SQL})"""
)
def identified_games(spark, sf_dir):
    """Whole folders, identified and verified."""
    found = packed(spark, sf_dir)
    hashes = detect.structure_hashes(found)
    rows = found.join(hashes, "archive").select(F.col("archive").alias("game_dir"), "archive", "hash", "content", F.lit(None).cast("binary").alias("plugin"))
    plugins = spark.createDataFrame([], "game_dir string, name string, hash string")
    library = structures(found, 3)
    out = detect.identify_games(rows, plugins, library, library.limit(0))
    return out.select("game_dir", "status", "encryption")


@query(
    f"""WITH a AS (SELECT {ARCHIVE} AS archive, source, count(*) AS n, any_value({TURN_SQL}) AS turn FROM documents GROUP BY 1, 2)
SELECT source AS "group", sum(CASE WHEN turn = 1 THEN 0 ELSE n END)::BIGINT AS files, sum(CASE WHEN turn < 2 THEN 0 ELSE n END)::BIGINT AS encrypted,
 count(*) FILTER (WHERE turn = 1) AS errors, count(*) AS archives FROM a GROUP BY source"""
)
def survey_totals(spark, sf_dir):
    """Files, encrypted files and unreadable archives of each source; the archives of one turn are cut short."""
    found = packed(spark, sf_dir)
    cut = F.when(F.col("turn") == 1, F.substring("content", 1, 25)).otherwise(F.col("content"))
    counts = surveys.flag_counts(archives.scan(found.withColumn("content", cut)))
    return surveys.survey_totals(counts, F.regexp_extract("archive", "^(.*)-", 1)).fillna(0)


@query(f"SELECT {ARCHIVE} AS archive, count(*) AS checked, 0::BIGINT AS failures, count(*) >= 3 AS confirmed FROM documents WHERE {TURN_SQL} = 2 GROUP BY 1")
def scheme_verification(spark, sf_dir):
    """All members of the archives of one scheme, checked under it."""
    found = packed(spark, sf_dir).where("turn = 2")
    return detect.verdict(detect.verification_checks(found, "hash-xor", {"shift": 5}, 1 << 30), ["archive"])


@query(f"SELECT archive FROM ({ARCHIVES_SQL}) WHERE turn = 0")
def plain_archives(spark, sf_dir):
    return detect.unencrypted(archives.scan(packed(spark, sf_dir)))


@query(
    f"""SELECT {ARCHIVE} AS archive, {NAME} || '.png' AS file_name, (16 + octet_length(encode(coalesce(text, ''))))::BIGINT AS size FROM documents WHERE {TURN_SQL} = 0"""
)
def segment_sizes(spark, sf_dir):
    """The segments of plain archives and the bytes their places in the archive hold once inflated."""
    found = packed(spark, sf_dir).where("turn = 0")
    parts = archives.segments(archives.scan(found)).join(found.select("archive", "content"), "archive")
    raw = F.expr("substring(content, int(segment_offset) + 1, int(segment_stored))")
    data = F.when(F.col("segment_packed"), fb.inflate(raw)).otherwise(raw)
    return parts.select("archive", "file_name", F.octet_length(data).cast("long").alias("size"))


@query(f"SELECT {ARCHIVE} AS archive, {NAME} || '.png' AS file_name, sha256(coalesce(text, '')) AS sha FROM documents WHERE ({NAME} || '.png') GLOB '*[13579].e?.png'")
def members_by_glob(spark, sf_dir):
    """Members whose names fit, read from archives that each have their own scheme."""
    found = packed(spark, sf_dir)
    scheme = F.coalesce(*(F.when(F.col("turn") == k, F.lit(s)) for k, s in enumerate(SCHEMES) if s))
    rows = archives.payloads(found.withColumns({"scheme": scheme, "parameters": F.when(F.col("turn") == 2, F.lit('{"shift": 5}'))}), "*[13579].e?.png")
    return rows.select("archive", "file_name", F.sha2(F.expr("substring(data, 17)"), 256).alias("sha"))


@query(
    """SELECT (SELECT count(DISTINCT made) FROM b) = 256 AS bijective, true AS involution, 93 AS xor_key, false AS spins
FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM b)""".replace("FROM b", "FROM (SELECT xor(x, 93) AS made FROM range(256) t(x)) b")
)
def byte_map_traits(spark, sf_dir):
    """What a map of bytes, seen between texts and what a fixed key makes of them, says about its scheme."""
    pairs = spark.range(256).select(F.col("id").alias("given"), F.col("id").bitwiseXOR(F.lit(93)).alias("made"))
    return detect.map_traits(pairs)


@query("SELECT user_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank = 1 GROUP BY user_id")
def first_occurrences(spark, sf_dir):
    return rel.first_per_key(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))
