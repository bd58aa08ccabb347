"""Formats: build, parse and read back; as DataFrames; detection end to end."""

import datetime
import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vaultlens.codecs import program
from vaultlens.codecs.errors import MalformedError
from vaultlens.formats import arc, det, gsp, registry, vf, xp3
from vaultlens.formats.model import Member
from vaultlens.operators import archives, detect

HELLO = [Member("hello.txt", b"Hello, world!"), Member("binary.bin", bytes(range(256))), Member("empty.dat", b"")]
PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes(range(200))


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("table", [True, False])
@pytest.mark.parametrize("scheme", [None, "poringsoft", "pinpoint"])
def test_xp3(compress, table, scheme):
    data = xp3.build(HELLO, compress, scheme, table_packed=table, aliases=[("again.txt", "hello.txt")])
    entries = xp3.parse(data)
    assert [e.file_name for e in entries] == ["hello.txt", "binary.bin", "empty.dat", "again.txt"]
    assert [xp3.read(data, e, scheme) for e in entries] == [*(m.data for m in HELLO), HELLO[0].data]
    assert all(e.encrypted == bool(scheme) for e in entries) and entries[3].is_alias
    assert len(xp3.structure_digest(data)) == 64


def test_xp3_false_flag_and_duplicates():
    plain = xp3.build(HELLO, True)
    entry = xp3.parse(plain)[1]
    entry.encrypted = True
    assert xp3.read(plain, entry, "hash-xor", {"shift": 3}) == HELLO[1].data
    twice = xp3.build([Member("a", b"x"), Member("b", b"y"), Member("c", b"x")])
    assert [e.file_name for e in xp3.parse(twice)] == ["a", "b", "c"]
    assert [e.file_name for e in xp3.parse(twice, one_per_key=True)] == ["c", "b"]
    with pytest.raises(MalformedError):
        xp3.parse(b"not an archive")


def test_structure_digest_of_a_plain_table():
    data = xp3.build(HELLO, table_packed=False)
    at = xp3.table_place(data)
    n = int.from_bytes(data[at + 1 : at + 9], "little")
    assert xp3.structure_digest(data) == hashlib.sha256(data[:19] + data[at : at + 17] + data[at + 17 : at + 17 + n]).hexdigest()


def test_gsp():
    script = bytes([0xF3, 0xF1, 0, 0]) + b"a script of some length"
    members = [*HELLO[:2], Member("start.spt", script)]
    data = gsp.build(members)
    entries = gsp.parse(data)
    assert [gsp.read(data, e) for e in entries] == [m.data for m in members]
    assert gsp.read(data, entries[2], decrypt=False) != script
    with pytest.raises(MalformedError):
        gsp.build([Member("n" * 57, b"")])
    with pytest.raises(MalformedError):
        gsp.parse(b"\xff\xff")


def test_arc():
    members = [*HELLO, Member("名前.ws2", b"script")]
    data = arc.build(members)
    entries = arc.parse(data)
    assert [arc.read(data, e) for e in entries] == [m.data for m in members]
    assert arc.read(data, entries[3], "/x/ModelA.arc") == arc.read(data, entries[3], decrypt=False) != b"script"
    with pytest.raises(MalformedError):
        arc.parse(data[:4] + b"\xff" + data[5:])


@pytest.mark.parametrize("kind", ["atm", "at2"])
@pytest.mark.parametrize("compress", [True, False])
def test_det(kind, compress):
    members = [*HELLO, Member("dir/テ.txt", b"abc" * 50)]
    files = det.build(members, kind, compress)
    entries = det.parse(files)
    assert [e.file_name for e in entries][3] == "dir\\テ.txt"
    assert [det.read(files["det"], e, check=True) for e in entries] == [m.data for m in members]
    if kind == "at2":
        assert det.parse({"det": files["det"], "nme": files["nme"], "atm": files["at2"]})[1].original_size == 256
    with pytest.raises(MalformedError):
        det.parse({"det": b"", "nme": files["nme"], kind: files[kind]})


@pytest.mark.parametrize("mix", [False, True])
@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("executable", [None, b"MZ" + bytes(300)])
def test_vf(mix, compress, executable):
    members = [Member("a/変.lsb", b"z" * 9000, datetime.datetime(2005, 10, 25, 23, 49, 14)), *HELLO]
    data = vf.build(members, compress, mix, executable)
    assert registry.identify("x.bin", data[:16], data[-6:]) == "vf"
    f = registry.FORMATS["vf"]
    entries = f.parse(data)
    assert entries[0].file_name == "a\\変.lsb" and entries[0].ts == members[0].ts and entries[1].ts == datetime.datetime(1980, 1, 1)
    assert [f.read(data, e, "", {"check": True}) for e in entries] == [m.data for m in members]
    assert vf.slice_parts([(0, 10), (10, 15)], 8, 6) == [(0, 8, 10), (1, 0, 4)]
    with pytest.raises(MalformedError):
        vf.slice_parts([(0, 10)], 8, 6)


def test_identify():
    assert registry.identify("a.GSP", b"", b"") == "gsp" and registry.identify("a.txt", b"", b"") is None
    assert registry.identify("a.txt", xp3.build(HELLO)[:16], b"") == "xp3"


@pytest.fixture
def members(spark):
    rows = [(a, k, f"{a}_{k}.{x}", bytearray(PNG if x == "png" else f"text {k} of {a}".encode())) for a in ("one", "two") for k, x in enumerate(("txt", "png", "json", "lsb"))]
    return spark.createDataFrame(rows, "archive string, ordinal int, file_name string, data binary")


@pytest.mark.parametrize("format", ["xp3", "gsp", "arc", "det", "vf"])
def test_pack_scan_read(spark, members, format):
    packed = archives.pack(members, format).cache()
    entries = archives.scan(packed)
    assert entries.where("error is not null").count() == 0
    assert [r.file_name for r in entries.where("archive = 'two'").orderBy("ordinal").collect()] == [f"two_{k}.{x}" for k, x in enumerate(("txt", "png", "json", "lsb"))]
    read = archives.payloads(packed, "*_[01].*")
    got = {(r.archive, r.file_name): bytes(r.data) for r in read.collect()}
    assert got == {(r.archive, r.file_name): bytes(r.data) for r in members.where("ordinal < 2").collect()}
    assert archives.member(entries, "one", "one_1.png").count() == 1
    with pytest.raises(KeyError):
        archives.member(entries, "one", "none")


def test_unreadable_archives_are_rows(spark):
    bad = spark.createDataFrame([("x", "xp3", bytearray(b"nonsense"))], archives.ARCHIVES)
    assert archives.scan(bad).first().error.startswith("MalformedError")
    assert archives.payloads(bad).first().status == "unreadable"


def build_game(scheme, parameters=None):
    names = (f"{scheme}{len(parameters or ())}.png", "y.png", "x.png", "w.txt")
    return xp3.build([Member(n, PNG + bytes([k]) * (k + 1)) for k, n in enumerate(names)], True, scheme, parameters)


BLOCK = [~(0x12345678 + i * 0x9ABCDEF0) & 0xFFFFFFFF for i in range(1024)]


def test_detection(spark):
    plugin = program.make_plugin(BLOCK)
    block = program.control_block(plugin)
    orders = detect.PROGRAM_ORDERS[7]
    cx = {"control_block": block, "mask": 0x20, "offset": 2, "prolog_order": orders[0], "odd_branch_order": orders[1], "even_branch_order": orders[2]}
    games = {
        "null": build_game(None), "shift": build_game("hash-xor", {"shift": 5}), "poring": build_game("poringsoft"), "pin": build_game("pinpoint"),
        "cx": build_game("cxcrypt", cx), "listed": build_game("fixed-xor", {"key": "aa55"}), "plugged": build_game("null"),
    }
    rows = [(k, bytearray(v), bytearray(plugin) if k == "cx" else None) for k, v in games.items()]
    found = spark.createDataFrame(rows, "archive string, content binary, plugin binary")
    toml = f'[games.a]\ntitle = "A"\nencryption = "fixed-xor"\nkey = "aa55"\ntpm_hashes = []\nxp3_hashes = ["{xp3.structure_digest(games["listed"])}"]\n[games.b]\ntitle = "B"\nencryption = "null"\ntpm_hashes = ["feed"]\nxp3_hashes = []\n'
    books = detect.library(spark, toml)
    plugins = spark.createDataFrame([("plugged", "b.tpm", "feed"), ("plugged", "menu.tpm", "feed"), ("pin", "a.tpm", "beef")], "archive string, name string, hash string")
    got = {r.archive: (r.encryption, json.loads(r.parameters), r.method) for r in detect.detect(found, plugins, books).collect()}
    assert got == {
        "shift": ("hash-xor", {"shift": 5}, "probe"), "poring": ("poringsoft", {}, "probe"), "pin": ("pinpoint", {}, "probe"),
        "cx": ("cxcrypt", {"mask": 0x20, "offset": 2, "prolog_order": list(orders[0]), "odd_branch_order": list(orders[1]), "even_branch_order": list(orders[2])}, "probe"),
        "listed": ("fixed-xor", {"key": "aa55"}, "structure"), "plugged": ("null", {}, "plugin"),
    }
    forced = detect.by_probe(found.where("archive = 'null'"), force=True).first()
    assert forced.encryption == "null"


def test_verification(spark):
    found = spark.createDataFrame([("good", bytearray(build_game("poringsoft"))), ("plain", bytearray(build_game(None)))], "archive string, content binary")
    right = {r.archive: r for r in detect.verdict(detect.verification_checks(found, "poringsoft"), ["archive"]).collect()}
    assert right["good"].confirmed and right["good"].checked == 3 and "plain" not in right
    wrong = {r.archive: r for r in detect.verdict(detect.verification_checks(found, "hash-xor", {"shift": 1}), ["archive"]).collect()}
    assert not wrong["good"].confirmed and wrong["good"].failures == 3
    bare = {r.archive: r for r in detect.verdict(detect.verification_checks(found, None), ["archive"]).collect()}
    assert bare["plain"].confirmed and "good" not in bare
    entries = archives.scan(found.select("archive", F.lit("xp3").alias("format"), "content"))
    assert [r.archive for r in detect.unencrypted(entries).collect()] == ["plain"]


def test_libraries(spark):
    toml = '[games.a]\nencryption = "null"\nxp3_hashes = ["1", "2"]\n[games.b]\nencryption = "poringsoft"\nxp3_hashes = ["2"]\ntpm_hashes = ["t"]\n'
    books, plain = detect.library(spark, toml), detect.library(spark, '[games.p]\nxp3_hashes = ["9", "9"]\n', "plain")
    assert {r.hash: r.game_key for r in detect.hash_index(books, "xp3_hashes").collect()} == {"1": "a", "2": "b"}
    files = spark.createDataFrame([("g1", "data.xp3", "1"), ("g1", "patch.xp3", "2"), ("g2", "data.xp3", "9"), ("g3", "new.xp3", "7"), ("g4", "x.xp3", "1")], "game_dir string, archive string, hash string")
    plugins = spark.createDataFrame([("g4", "a.tpm", "t")], "game_dir string, name string, hash string")
    assert {r.game_dir: r.game_key for r in detect.known(files, plugins, books, plain).collect()} == {"g1": "a", "g2": "p", "g4": "b"}
    assert sorted(r.hash for r in detect.missing_hashes(files, books).collect()) == ["7", "9"]
    more = spark.createDataFrame([("a", "7"), ("a", "1")], "game_key string, hash string")
    assert {r.game_key: r.xp3_hashes for r in detect.append_hashes(books, more).collect()}["a"] == ["1", "2", "7"]
    import tomllib

    text = detect.toml_entry("k", 'A "game"', "hash-xor", {"shift": 3}, [("t", "a.tpm")], [("h", "data.xp3"), ("i", "patch2.xp3")])
    assert tomllib.loads(text)["games"]["k"] == {"title": 'A "game"', "encryption": "hash-xor", "shift": 3, "tpm_hashes": ["t"], "xp3_hashes": ["h"]}


def test_observations(spark):
    from vaultlens.codecs.ciphers import SPIN

    seen = spark.createDataFrame([(h, h >> 3 & 255) for h in (0xDEADBEEF, 0x12345678, 77)], "h long, key long")
    formulas = detect.matching_formulas(seen)
    assert [r.formula for r in formulas.collect()] == ["h >> 3"]
    assert [tuple(r) for r in detect.formula_candidates(formulas).collect()] == [("hash-xor", 3)]
    yuzu = spark.createDataFrame([(0x1DDB6E7A, 0xD0), (0x1DDB6E7B, 1)], "h long, key long")
    assert [r.scheme for r in detect.matching_formulas(yuzu).collect()] == ["bytes"]
    spun = detect.map_traits(spark.createDataFrame([(i, SPIN[i]) for i in range(256)], "given int, made int")).first()
    assert spun.spins and spun.bijective == (len(set(SPIN)) == 256) and spun.xor_key is None
    xor = detect.map_traits(spark.createDataFrame([(i, i ^ 9) for i in range(256)], "given int, made int")).first()
    assert (xor.bijective, xor.involution, xor.xor_key, xor.spins) == (True, True, 9, False)
    assert detect.depends_on(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), "k", "v")


def test_identify_games(spark):
    plugin = program.make_plugin(BLOCK)
    orders = detect.PROGRAM_ORDERS[2]
    cx = {"control_block": program.control_block(plugin), "mask": 0x100, "offset": 0x100, "prolog_order": orders[0], "odd_branch_order": orders[1], "even_branch_order": orders[2]}
    games = {
        "listed": build_game("poringsoft"), "plain": build_game(None), "few": xp3.build([Member("a.txt", b"x")]), "spin": build_game("pinpoint"),
        "cx": build_game("cxcrypt", cx), "odd": build_game("fixed-xor", {"key": "0102"}),
    }
    rows = [(k, f"{k}/data.xp3", xp3.structure_digest(v), bytearray(v), bytearray(plugin) if k == "cx" else None) for k, v in games.items()]
    found = spark.createDataFrame(rows, "game_dir string, archive string, hash string, content binary, plugin binary")
    books = detect.library(spark, f'[games.l]\nencryption = "poringsoft"\nxp3_hashes = ["{rows[0][2]}"]\n')
    plugins = spark.createDataFrame([], "game_dir string, name string, hash string")
    got = {r.game_dir: r for r in detect.identify_games(found, plugins, books, detect.library(spark, "", "plain")).collect()}
    assert {k: (r.status, r.encryption) for k, r in got.items()} == {
        "listed": ("known", "poringsoft"), "plain": ("unencrypted", None), "few": ("inconclusive", None), "spin": ("confirmed", "pinpoint"),
        "cx": ("confirmed", "cxcrypt"), "odd": ("failed", None),
    }
    assert got["cx"].checked == 3 and got["cx"].failures == 0


def test_identify_games_verifies_every_fitting_scheme(spark):
    import zlib

    byte = lambda data, shift: zlib.adler32(data) >> shift & 0xFF
    some = (PNG + bytes([a, b]) for a in range(256) for b in range(256))
    small = next(d for d in some if byte(d, 9) and any(byte(d, s) == byte(d, 9) for s in range(9)) and all(byte(d, s) != byte(d, 9) for s in range(10, 32)))
    data = xp3.build([Member(n, d) for n, d in (("a.png", small), ("b.png", PNG + bytes(40)), ("c.png", PNG + bytes(range(70))))], True, "hash-xor", {"shift": 9})
    assert detect.probe_one(data)[1]["shift"] < 9
    found = spark.createDataFrame([("g", "g/data.xp3", "h", bytearray(data), None)], "game_dir string, archive string, hash string, content binary, plugin binary")
    none = spark.createDataFrame([], "game_dir string, name string, hash string")
    got = detect.identify_games(found, none, detect.library(spark, ""), detect.library(spark, "", "plain")).first()
    assert (got.status, got.encryption, json.loads(got.parameters), got.checked) == ("confirmed", "hash-xor", {"shift": 9}, 3)


@pytest.mark.parametrize(("scheme", "parameters", "blank"), [("poringsoft", None, 0xFE), ("hash-xor", {"shift": 5}, 0), ("hash-xor", {"shift": 5}, None)])
def test_probing_tells_schemes_apart(spark, scheme, parameters, blank):
    """The smallest member's key byte leaves its bytes as they are, or is that of an earlier scheme; the others decide."""
    import zlib

    def fools(data):
        key = zlib.adler32(data)
        if scheme == "poringsoft":
            return key & 0xFF == blank
        return key >> 5 & 0xFF == (blank if blank is not None else ~(key + 1) & 0xFF)

    small = next(d for d in (PNG + b"\xff" * n + bytes([a]) for n in range(40) for a in range(256)) if fools(d))
    others = [Member(f"{k}.png", PNG + hashlib.sha512(bytes([k])).digest()) for k in range(3)]
    data = xp3.build([Member("a.png", small), *others], True, scheme, parameters)
    assert detect.probe_one(data)[0] != scheme
    found = spark.createDataFrame([("g", "g/data.xp3", "h", bytearray(data), None)], "game_dir string, archive string, hash string, content binary, plugin binary")
    hit = detect.by_probe(found).first()
    assert (hit.encryption, json.loads(hit.parameters)) == (scheme, parameters or {})
    none = spark.createDataFrame([], "game_dir string, name string, hash string")
    got = detect.identify_games(found, none, detect.library(spark, ""), detect.library(spark, "", "plain")).first()
    assert (got.status, got.encryption, json.loads(got.parameters)) == ("confirmed", scheme, parameters or {})


def test_probing_without_candidates():
    assert detect.probe_apart(xp3.build([Member("a.txt", b"x")])) == []
    odd = xp3.build([Member("a.png", b"no"), Member("b.png", PNG + bytes(300))], True, "poringsoft")
    assert detect.probe_apart(odd) == []


class Held:
    """In place of a DataFrame: keeps the function that would run over its batches."""

    columns = ["archive", "format", "content"]

    def select(self, *columns):
        return self

    join = select

    def mapInArrow(self, function, schema):  # noqa: N802
        self.run = function
        return self


def test_scan_hands_on_bounded_batches(spark):
    data = xp3.build([Member(f"{k}.txt", b"") for k in range(100)])
    batch = pa.RecordBatch.from_pydict({"archive": [str(k) for k in range(99)] + ["bad"], "format": ["xp3"] * 100, "content": [data] * 99 + [b""]})
    sizes = [b.num_rows for b in archives.scan(Held()).run(iter([batch, batch]))]
    assert sum(sizes) == 2 * (99 * 100 + 1) and max(sizes) <= 4096


def test_payloads_hand_on_bounded_batches(spark):
    data = xp3.build([Member(f"{k}.txt", bytes(1 << 20)) for k in range(10)])
    batch = pa.RecordBatch.from_pydict({"archive": list("abcdefg"), "format": ["xp3"] * 7, "content": [data] * 7})
    sizes = [b.num_rows for b in archives.payloads(Held()).run(iter([batch]))]
    assert sum(sizes) == 70 and max(sizes) == 16 and len(sizes) == 5
