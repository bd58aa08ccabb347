"""Registered queries of the archive operators over the driver's tables, each with SQL for DuckDB where SQL can say it.

A document stands for an archive member: its name is source/doc_id.lang, its
payload the UTF-8 of its text.  An archive holds the members of one source in
one range of 500 doc_ids, so archives stay bounded as the table grows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from vaultlens.codecs import gale, prng, tlg
from vaultlens.functions import bytes as fb
from vaultlens.functions import dos_time, paths
from vaultlens.operators import archives, detect
from vaultlens.operators import relational as rel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name or function.__name__] = (function, sql)
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


NAME = "coalesce(source, '') || '/' || doc_id || '.' || coalesce(lang, '')"
ARCHIVE = "coalesce(source, '') || '-' || (doc_id // 500)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, archive, ordinal, file_name, data, lang, source, n_chars of every document."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id"), F.lit("."), F.coalesce("lang", F.lit("")))
    archive = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.expr("doc_id div 500"))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", archive.alias("archive"), F.expr("int(doc_id % 500)").alias("ordinal"), name.alias("file_name"), data.alias("data"), "lang", "source", "n_chars")


# --- hashes and byte functions -------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def content_sha256(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", fb.content_sha256(F.col("data")).alias("sha"))


BYTES_SQL = "list_transform(string_split(rtrim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '), lambda x: CASE WHEN x = '' THEN 0 ELSE ('0x' || x)::BIGINT END)"


@query(
    f"""WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, {BYTES_SQL} AS l FROM documents)
SELECT doc_id, (((n + list_sum(list_transform(l, lambda x, i: (n - i + 1) * x))) % 65521) * 65536
                + (1 + list_sum(l)) % 65521)::BIGINT AS key FROM b"""
)
def adler_key(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", fb.adler32("data").alias("key"))


def mapped(expression: str) -> str:
    """SHA-256 of the upper-case hex of every byte x under an expression."""
    hexed = f"array_to_string(list_transform({BYTES_SQL}, lambda x: printf('%02X', ({expression})::INT)), '')"
    return f"SELECT doc_id, sha256(CASE WHEN coalesce(text, '') = '' THEN '' ELSE {hexed} END) AS sha FROM documents"


def hex_sha(data: Column) -> Column:
    return F.sha2(F.hex(data), 256).alias("sha")


SPIN_SQL = "CASE WHEN bit_count(x) % 8 = 0 THEN x ELSE ((x << (bit_count(x) % 8)) | (x >> (8 - bit_count(x) % 8))) & 255 END"


@query(mapped("xor(x, (doc_id >> 3) & 255)"))
def hash_xor(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", hex_sha(fb.hash_xor(F.col("data"), F.col("doc_id"), 3)))


@query(mapped("xor(x, (-(doc_id + 2)) & 255)"))
def successor_xor(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", hex_sha(fb.successor_xor("data", "doc_id")))


@query(mapped(SPIN_SQL))
def spin_decrypt(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", hex_sha(fb.spin_decrypt("data")))


@query(mapped("((x >> 2) | (x << 6)) & 255"))
def script_rotate(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", hex_sha(fb.script_decrypt("data")))


@query(
    "SELECT doc_id, sha256(CASE WHEN coalesce(text, '') = '' THEN '' ELSE array_to_string(list_transform("
    + BYTES_SQL
    + ", lambda x, i: printf('%02X', xor(x, CASE (i - 1) % 3 WHEN 0 THEN 161 WHEN 1 THEN 178 ELSE 195 END)::INT)), '') END) AS sha FROM documents"
)
def fixed_xor(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", hex_sha(fb.fixed_xor(F.col("data"), "a1b2c3")))


ROUND_TRIPS: dict[str, Callable[[Column], Column]] = {
    "lz77": lambda d: fb.lz77_decode(fb.lz77_encode(d)),
    "lz77_stored": lambda d: fb.lz77_decode(fb.lz77_store(d)),
    "zlib": lambda d: fb.inflate(fb.deflate(d)),
    "scramble": lambda d: fb.unscramble(fb.scramble(d, 64, 7)),
    "script": lambda d: fb.script_decrypt(fb.script_encrypt(d)),
    "spin": lambda d: fb.spin_decrypt(fb.spin_encrypt(d)),
}


def _round_trip(name: str) -> None:
    change = ROUND_TRIPS[name]

    @query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents", f"round_trip_{name}")
    def run(spark, sf_dir):
        return members(spark, sf_dir).select("doc_id", F.sha2(change(F.col("data")), 256).alias("sha"))


for _name in ("lz77", "lz77_stored", "zlib", "scramble", "script", "spin"):
    _round_trip(_name)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def round_trip_framed_text(spark, sf_dir):
    """UTF-16 with its mark, framed by swapped bits and by zlib, and back."""
    framed = F.concat(F.lit(b"\xff\xfe"), F.encode(F.decode("data", "UTF-8"), "UTF-16LE"))
    one = fb.text_decode(fb.text_encode(framed))
    two = fb.byte_function(lambda d: fb.ciphers.text_decode(fb.ciphers.text_encode(d, 2)))(one)
    return members(spark, sf_dir).select("doc_id", F.sha2(F.decode(F.substring(two, F.lit(3), F.octet_length(two)), "UTF-16LE"), 256).alias("sha"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def round_trip_keyed_script(spark, sf_dir):
    head = F.unhex(F.concat(F.lit("F"), F.hex(F.col("doc_id") % 8), F.lit("F"), F.hex(F.col("doc_id") % 4), F.lit("0000")))
    out = fb.keyed_decrypt(fb.keyed_encrypt(F.concat(head, F.col("data"))))
    return members(spark, sf_dir).select("doc_id", F.sha2(F.substring(out, F.lit(5), F.octet_length(out)), 256).alias("sha"))


PROGRAM_BLOCK = tuple(~(0x12345678 + i * 0x9ABCDEF0) & 0xFFFFFFFF for i in range(1024))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, false AS same FROM documents")
def round_trip_program(spark, sf_dir):
    parameters = {"control_block": PROGRAM_BLOCK, "mask": 0x1C9, "offset": 0x1F3}
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    packed = fb.cipher(F.col("data"), key, "cxcrypt", parameters, True)
    out = fb.cipher(packed, key, "cxcrypt", parameters)
    return members(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("sha"), ((packed == F.col("data")) & (F.octet_length("data") > 0)).alias("same"))


# --- generators, dates, strings -------------------------------------------------------


#: 5 ** (2 ** b) modulo 2 ** 34, from which DuckDB multiplies 5 ** n together.
SQUARES = ", ".join(f"{pow(5, 1 << b, 1 << 34)}::HUGEINT" for b in range(34))


@query(
    f"""WITH p AS (SELECT event_id, list_reduce(list_transform(range(0, 34), lambda b: CASE WHEN (event_id >> b) & 1 = 1 THEN [{SQUARES}][b + 1] ELSE 1::HUGEINT END),
 lambda x, y: (x * y) % 17179869184) AS power FROM events)
SELECT event_id, ((power - 1) // 4 * 1977019961 % 4294967296)::BIGINT AS state FROM p"""
)
def mask_states(spark, sf_dir):
    @arrow_udf("long")
    def state(n: pa.Array) -> pa.Array:
        return pa.array(prng.mask_states_at(n.to_numpy()).astype(np.int64), pa.int64())

    return read(spark, sf_dir, "events").select("event_id", state("event_id").alias("state"))


@query(
    """SELECT event_id, ((year(ts) - 1980) * 33554432 + month(ts) * 2097152 + day(ts) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS word,
       date_trunc('second', ts) - to_seconds((second(ts) % 2)::BIGINT) AS back FROM events"""
)
def dos_words(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("word", dos_time.encode_column(F.col("ts")))
    return events.select("event_id", "word", dos_time.decode_column(F.col("word")).alias("back"))


@query(
    r"""SELECT DISTINCT p_name AS title, CASE WHEN regexp_matches(p_name, '[^\x00-\x7F]') THEN substr(md5(p_name), 1, 8)
 WHEN trim(regexp_replace(regexp_replace(lower(p_name), '[^A-Za-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') = '' THEN 'unknown'
 ELSE trim(regexp_replace(regexp_replace(lower(p_name), '[^A-Za-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') END AS slug FROM part"""
)
def slugs(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct()
    return names.select("title", fb.slug(F.col("title")).alias("slug"))


@query(f"SELECT doc_id, {NAME} AS file_name FROM documents WHERE ({NAME}) GLOB '*[1-7]/*[!3-8].e?'")
def glob_filter(spark, sf_dir):
    return members(spark, sf_dir).where(paths.glob(F.col("file_name"), "*[1-7]/*[!3-8].e?")).select("doc_id", "file_name")


@query(
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'xp3' WHEN page_id % 7 IN (1, 2) THEN 'vf' WHEN page_id % 7 = 3 THEN 'gsp' WHEN page_id % 7 = 4 THEN 'det' END AS format FROM pages"""
)
def identify(spark, sf_dir):
    """Format by first bytes, executable trailer and extension, over made-up heads of every page."""
    k = F.col("page_id") % 7
    head = F.when(k == 0, F.lit(b"XP3\r\n \n\x1a\x8b\x67\x01....")).when(k == 1, F.lit(b"vf\x66\0\0\0")).when(k == 2, F.lit(b"MZ\x90\0")).otherwise(F.lit(b"no"))
    tail = F.when(k == 2, F.lit(b"\1\0\0\0lv")).otherwise(F.lit(b"......"))
    name = F.concat("url", F.when(k == 3, F.lit("index.GSP")).when(k == 4, F.lit("index.det")).otherwise(F.lit("index.html")))
    return read(spark, sf_dir, "pages").select("page_id", paths.identify_format(name, head, tail).alias("format"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
 split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS publisher FROM pages"""
)
def page_paths(spark, sf_dir):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(bare, "[?#].*$", "").alias("path"), paths.publisher_and_game(bare)["publisher"].alias("publisher"))


# --- joins ----------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT (event_id * 2654435761) % 4294967296 AS h FROM events), k AS (SELECT h, (h >> 3) & 255 AS key FROM o),
t AS (SELECT key, 'h >> ' || s AS formula, (h >> s) & 255 AS guess FROM k, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (16), (24)) v(s)
 UNION ALL SELECT key, '~(h + 1)', (-(h + 2)) & 255 FROM k UNION ALL SELECT key, 'h ^ cd', xor(h, 205) & 255 FROM k
 UNION ALL SELECT key, 'h ^ h >> 8', xor(h, h >> 8) & 255 FROM k UNION ALL SELECT key, '~(h >> 7)', 255 - ((h >> 7) & 255) FROM k
 UNION ALL SELECT key, 'bytes of h ^ 1ddb6e7a', CASE WHEN b = 0 THEN 208 ELSE b END FROM (SELECT key, xor(xor(x, x >> 8), xor(x >> 16, x >> 24)) & 255 AS b FROM (SELECT key, xor(h, 500919930) AS x FROM k)))
SELECT formula, count(*) AS n, count(*) FILTER (WHERE key = guess) AS hits, bool_and(key = guess) AS holds FROM t GROUP BY formula"""
)
def key_formula_hits(spark, sf_dir):
    """How often each formula gives the key byte observed for a hash, and whether it always does."""
    tries = _observed(spark, sf_dir).select("key", F.inline(fb.key_formulas(F.col("h"))).alias("formula", "scheme", "guess"))
    hit = F.col("key") == F.col("guess")
    return tries.groupBy("formula").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.bool_and(hit).alias("holds"))


def _observed(spark, sf_dir):
    """(h, key): a hash for each event, and a key byte made of it by one of the formulas."""
    seen = read(spark, sf_dir, "events").select(((F.col("event_id") * 2654435761) % 4294967296).alias("h"))
    return seen.withColumn("key", F.shiftright("h", 3).bitwiseAND(0xFF))


@query(
    """WITH k AS (SELECT (event_id * 2654435761) % 4294967296 AS h FROM events)
SELECT 'h >> ' || s AS formula, 'hash-xor shift=' || s AS scheme FROM k, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (16), (24)) v(s)
GROUP BY s HAVING bool_and((h >> s) & 255 = (h >> 3) & 255)"""
)
def key_formula_division(spark, sf_dir):
    """Formulas that hold on every observation (hash, key byte)."""
    return detect.matching_formulas(_observed(spark, sf_dir))


@query(
    f"""WITH e AS (SELECT {ARCHIVE} AS archive, doc_id AS key, {NAME} AS file_name, n_chars FROM documents)
SELECT archive, key, file_name, n_chars, false AS is_alias FROM e
UNION ALL SELECT archive, key, 'alias/' || file_name, n_chars, true FROM e WHERE key % 3 = 0"""
)
def alias_union(spark, sf_dir):
    entries = members(spark, sf_dir).select("archive", F.col("doc_id").alias("key"), "file_name", "n_chars")
    aliases = entries.where("key % 3 = 0").select("archive", "key", F.concat(F.lit("alias/"), "file_name").alias("file_name"))
    return archives.with_aliases(entries, aliases)


@query(
    """SELECT o_custkey AS key, min(o_orderkey) AS place, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price
FROM orders GROUP BY o_custkey"""
)
def last_wins(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return rel.last_wins(orders, ["key"], "place")


@query(
    """WITH lib AS (SELECT p_brand AS brand, max(p_partkey) AS p_partkey FROM part WHERE p_brand NOT LIKE '%2' AND p_brand NOT LIKE '%4' GROUP BY p_brand),
hits AS (SELECT l.l_orderkey AS archive, l.l_linenumber AS rank, l.l_partkey AS part, p.p_brand AS brand, lib.p_partkey AS entry FROM lineitem l
 JOIN part p ON p.p_partkey = l.l_partkey JOIN lib ON lib.brand = p.p_brand)
SELECT archive, rank, part, brand, entry FROM hits QUALIFY row_number() OVER (PARTITION BY archive ORDER BY rank, part) = 1"""
)
def lookup_first_match(spark, sf_dir):
    """The first line of each order whose part's brand a library lists; of entries of one brand the last counts."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    lib = part.where("brand not like '%2' and brand not like '%4'").groupBy("brand").agg(F.max("part").alias("entry"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("part"))
    return rel.first_match(lines.join(part, "part"), lib, "brand", ["archive"], ["rank", "part"]).select("archive", "rank", "part", "brand", "entry")


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (WHERE l.quality = 1) AS known, count(*) FILTER (WHERE l.doc_id IS NULL) AS unknown
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"""
)
def known_unknown_split(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("listed"))
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("known"), F.count_if(F.col("listed").isNull()).alias("unknown"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def known_semi(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query(
    """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(b.path, a.path || '/'))"""
)
def ancestor_anti(spark, sf_dir):
    return rel.without_ancestors(page_paths(spark, sf_dir).select("path"), "path")


@query(
    """WITH d AS (SELECT doc_id AS part, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start, sum(n_chars) OVER (ORDER BY doc_id) AS "end" FROM documents),
r AS (SELECT doc_id AS request, start + n_chars // 2 AS offset_, n_chars AS size FROM (SELECT part AS doc_id, n_chars, start FROM d))
SELECT request, part, (greatest(offset_, start) - start)::BIGINT AS "from", (least(offset_ + size, "end") - start)::BIGINT AS "to"
FROM r JOIN d ON start < offset_ + size AND "end" > offset_ WHERE size > 0"""
)
def interval_read(spark, sf_dir):
    """Each request spans the second half of one part and what follows, over parts laid end to end."""
    parts = rel.running_total(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("part"), "n_chars"), "part", "n_chars")
    parts = parts.withColumn("end", F.col("start") + F.col("n_chars"))
    requests = parts.select(F.col("part").alias("request"), (F.col("start") + F.expr("n_chars div 2")).alias("offset"), F.col("n_chars").alias("size"))
    return rel.overlaps(requests, parts.select("part", "start", "end"), 4096)


@query(
    f"""WITH c AS (SELECT {ARCHIVE} AS archive, doc_id, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars > 0),
s AS (SELECT archive, doc_id, n_chars FROM c QUALIFY row_number() OVER (PARTITION BY archive ORDER BY n_chars, doc_id) = 1)
SELECT archive, doc_id, shift FROM s, (SELECT unnest(range(32)) AS shift) WHERE (doc_id >> shift) & 255 = 1
QUALIFY row_number() OVER (PARTITION BY archive ORDER BY shift) = 1"""
)
def probe_smallest(spark, sf_dir):
    """The smallest candidate of each archive, and the first of 32 shifts that fits it."""
    found = members(spark, sf_dir).where("lang in ('en', 'de') and n_chars > 0")
    smallest = found.groupBy("archive").agg(F.min(F.struct("n_chars", "doc_id")).alias("s")).select("archive", "s.doc_id")
    tries = smallest.withColumn("shift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    tries = tries.where(F.expr("shiftright(doc_id, int(shift)) & 255") == 1)
    return tries.groupBy("archive", "doc_id").agg(F.min("shift").alias("shift"))


# --- aggregates, windows, orders, sets -------------------------------------------------------


@query(
    f"""SELECT {ARCHIVE} AS archive, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS encrypted, sum(n_chars)::BIGINT AS size,
 bool_or(doc_id % 3 = 0) AS any_encrypted FROM documents GROUP BY 1"""
)
def flag_counts(spark, sf_dir):
    flag = F.col("doc_id") % 3 == 0
    grouped = members(spark, sf_dir).groupBy("archive")
    return grouped.agg(F.count("*").alias("n"), F.count_if(flag).alias("encrypted"), F.sum("n_chars").alias("size"), F.bool_or(flag).alias("any_encrypted"))


@query(
    """SELECT 'priority' AS metric, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2"""
)
def multi_counter(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return rel.counters(orders, {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "year": F.year("o_orderdate")})


@query("SELECT * FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def first_five_per_fingerprint(spark, sf_dir):
    return rel.first_n_per_group(read(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], 5)


@query(
    f"""SELECT {ARCHIVE} AS archive, doc_id, coalesce(lead(doc_id) OVER (PARTITION BY {ARCHIVE} ORDER BY doc_id), 500 * (doc_id // 500 + 1)) - doc_id AS size FROM documents"""
)
def size_from_next(spark, sf_dir):
    rows = members(spark, sf_dir).select("archive", "doc_id", (F.expr("doc_id div 500 + 1") * 500).alias("stop"))
    return rel.size_from_next(rows, ["archive"], "doc_id", "doc_id", "stop").select("archive", "doc_id", "size")


@query(f"SELECT {ARCHIVE} AS archive, doc_id, (8 + sum(n_chars) OVER (PARTITION BY {ARCHIVE} ORDER BY doc_id) - n_chars)::BIGINT AS offset FROM documents".replace("AS offset", 'AS "offset"'))
def running_offset(spark, sf_dir):
    rows = members(spark, sf_dir).select("archive", "doc_id", "n_chars")
    return rel.running_offset(rows, ["archive"], ["doc_id"], "n_chars", 8).select("archive", "doc_id", "offset")


@query(
    """WITH c AS (SELECT user_id, event_id, value < 0.02 * 100 AS bad FROM events), r AS (SELECT *,
 count(*) OVER w AS n, count(*) FILTER (WHERE bad) OVER w AS f FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, coalesce(min(n) FILTER (WHERE n >= 3 AND f = 0), max(n)) AS checked,
 CASE WHEN min(n) FILTER (WHERE n >= 3 AND f = 0) IS NOT NULL THEN 0 ELSE max(f) END AS failures,
 min(n) FILTER (WHERE n >= 3 AND f = 0) IS NOT NULL AS confirmed FROM r GROUP BY user_id"""
)
def verify_early_exit(spark, sf_dir):
    checks = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") < F.lit(0.02) * 100).alias("bad"))
    return rel.early_exit(checks, ["user_id"], ["event_id"], "bad", 3)


@query(
    """SELECT l_orderkey, count(*) AS checked, count(*) FILTER (WHERE l_returnflag = 'R') AS failures,
 count(*) >= 3 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0 AS confirmed FROM lineitem GROUP BY l_orderkey"""
)
def verify_tally(spark, sf_dir):
    return detect.verdict(read(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_returnflag") != "R"), ["l_orderkey"])


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def most_common(spark, sf_dir):
    """A top-20 report."""
    return rel.most_common(read(spark, sf_dir, "part").select(F.col("p_type").alias("value")), "value", 20)


@query("SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def group_lists(spark, sf_dir):
    pairs = read(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("user")).distinct()
    return pairs.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("user")), ",").alias("users"), F.count("*").alias("n"))


@query(
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'less', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)"""
)
def set_operations(spark, sf_dir):
    a, b = read(spark, sf_dir, "orders").select("o_custkey"), read(spark, sf_dir, "customer").select("c_custkey")
    c, d = read(spark, sf_dir, "customer").select("c_nationkey"), read(spark, sf_dir, "supplier").select("s_nationkey")
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", a.intersect(b)).unionByName(count("less", b.subtract(a))).unionByName(count("all", c.union(d).distinct()))


@query("SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    """One row for each content: the first to have it, and how many do."""
    rows = members(spark, sf_dir).select(F.sha2("data", 256).alias("sha"), "doc_id")
    return rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id IS NOT NULL")
def props_field(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_id is not null").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- archives, detection, images ---------------------------------------------------------


SCAN_SQL = f"""SELECT {ARCHIVE} AS archive, count(*) AS n, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size,
 min(replace({NAME}, '/', '%s')) AS first_name, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1"""


def _scan(format: str, **options) -> None:
    @query(SCAN_SQL % ("\\" if format in ("det", "vf") else "/"), f"archive_{format}")
    def run(spark, sf_dir):
        packed = archives.pack(members(spark, sf_dir), format, **options)
        rows = archives.payloads(packed, scheme=options.get("scheme"), parameters=options.get("parameters"))
        digests = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.sha2("data", 256).alias("sha")))), lambda r: r["sha"])
        out = rows.groupBy("archive").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("size"), F.min("file_name").alias("first_name"), digests.alias("digests"))
        return out.select("archive", "n", F.col("size").cast("long").alias("size"), "first_name", F.sha2(F.array_join("digests", ""), 256).alias("digest"))


_scan("xp3", scheme="hash-xor", parameters={"shift": 3})
for _name in ("gsp", "arc", "det", "vf"):
    _scan(_name)


@query(f"SELECT {ARCHIVE} AS archive, count(*) AS entries, count(*) FILTER (WHERE length(coalesce(text, '')) > 0) AS nonempty, count(*) AS encrypted FROM documents GROUP BY 1")
def archive_entries(spark, sf_dir):
    """Entries of packed archives without reading their payloads."""
    entries = archives.scan(archives.pack(members(spark, sf_dir), "xp3", scheme="poringsoft"))
    return entries.groupBy("archive").agg(F.count("*").alias("entries"), F.count_if(F.col("original_size") > 0).alias("nonempty"), F.count_if("encrypted").alias("encrypted"))


KINDS = ("poringsoft", "pinpoint", "hash-xor")


@query(f"""SELECT archive, CASE k % 3 WHEN 0 THEN 'poringsoft' WHEN 1 THEN 'pinpoint' ELSE 'hash-xor' END AS encryption, 'probe' AS method
FROM (SELECT DISTINCT {ARCHIVE} AS archive, doc_id // 500 + length(coalesce(source, '')) AS k FROM documents)""")
def detect_schemes(spark, sf_dir):
    """Archives packed under three schemes and told apart by probing."""
    rows = members(spark, sf_dir).withColumn("k", F.expr("(doc_id div 500 + length(coalesce(source, ''))) % 3"))
    rows = rows.withColumn("file_name", F.concat("file_name", F.lit(".png"))).withColumn("data", F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), "data"))
    packed = None
    for k, scheme in enumerate(KINDS):
        part = archives.pack(rows.where(F.col("k") == k), "xp3", scheme=scheme, parameters={"shift": 5} if scheme == "hash-xor" else None)
        packed = part if packed is None else packed.unionByName(part)
    return detect.by_probe(packed.withColumn("plugin", F.lit(None).cast("binary"))).select("archive", "encryption", "method")


SHADE = "(floor(abs(embedding[%s]) * 1000)::BIGINT %% 256)"
IMAGE_SQL = f"""SELECT vec_id, 8 AS width, 8 AS height,
 list_sum(list_transform(range(1, 65), lambda i: i * ({SHADE % 'i'} + 300 * {SHADE % '65 - i'} + 90000 * ((7 * {SHADE % 'i'} + i) % 256))))::BIGINT AS pixels FROM embeddings"""


def shades(v: np.ndarray) -> np.ndarray:
    """The picture of 8 by 8 pixels that an embedding's 64 values draw: red by value, green backwards, blue of both value and place.

    Values are multiplied in their own width, as in SQL: a float times 1000 is rounded to a float before its floor.
    """
    red = (np.floor(np.abs(np.asarray(v)) * 1000).astype(np.int64) % 256).astype(np.uint8)
    blue = ((7 * red.astype(np.int64) + np.arange(1, 65)) % 256).astype(np.uint8)
    return np.stack([red, red[::-1], blue, np.full(64, 255, np.uint8)], axis=1).reshape(8, 8, 4)


def drawn(encode: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    @F.pandas_udf("binary")
    def draw(v: pd.Series) -> pd.Series:
        return v.map(lambda x: encode(shades(x).tobytes()))

    return draw


def _images(name: str, encode: Callable[[bytes], bytes]) -> None:
    """Pictures encoded and decoded again; the sum weighs every channel of every pixel by its place."""

    @query(IMAGE_SQL, f"image_{name}")
    def run(spark, sf_dir):
        @F.pandas_udf("long")
        def weighed(pixels: pd.Series, mode: pd.Series) -> pd.Series:
            def one(p, m):
                x = np.frombuffer(p, np.uint8).reshape(-1, len(m)).astype(np.int64)
                return int((np.arange(1, len(x) + 1) * (x[:, 0] + 300 * x[:, 1] + 90000 * x[:, 2])).sum())

            return pd.Series([one(p, m) for p, m in zip(pixels, mode, strict=True)], dtype="int64")

        rows = read(spark, sf_dir, "embeddings").select("vec_id", fb.image(drawn(encode)("embedding")).alias("i"))
        return rows.select("vec_id", "i.width", "i.height", weighed("i.pixels", "i.mode").alias("pixels"))


def _bgr(raw: bytes) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(8, 8, 4)[:, :, [2, 1, 0]].tobytes()


ENCODERS: dict[str, Callable[[bytes], bytes]] = {
    "strips": lambda raw: tlg.encode_strips(8, 8, raw),
    "blocks": lambda raw: tlg.wrap(tlg.encode_blocks(8, 8, raw, 3, np.array([[27]]))),
    "layers": lambda raw: gale.encode(8, 8, 24, _bgr(raw), version=107),
}
for _name, _encode in ENCODERS.items():
    _images(_name, _encode)


def queries() -> dict[str, Query]:
    return {name: function for name, (function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


from vaultlens.plans import inventory  # noqa: E402, F401  registers its queries
