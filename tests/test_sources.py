"""Data source, extraction, streaming ingestion, surveys and the command line, on files of our own making."""

import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens import cli
from vaultlens.codecs import pe, png, tlg
from vaultlens.formats import arc, det, gsp, vf, xp3
from vaultlens.formats.model import Member
from vaultlens.operators import archives, detect, surveys
from vaultlens.sources import archive as source
from vaultlens.sources import files
from vaultlens.streaming import ingest

PICTURE = tlg.encode_strips(2, 2, bytes(range(16)))
MEMBERS = [Member("a/hello.txt", b"Hello"), Member("a/picture.tlg", PICTURE), Member("b.bin", bytes(range(256)))]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "one.xp3").write_bytes(xp3.build(MEMBERS))
    (root / "sub/two.gsp").write_bytes(gsp.build(MEMBERS[:1]))
    (root / "sub/three.arc").write_bytes(arc.build(MEMBERS))
    (root / "four.exe").write_bytes(vf.build(MEMBERS, executable=b"MZ" + bytes(99)))
    for kind, data in det.build(MEMBERS, "at2", True).items():
        (root / f"five.{kind}").write_bytes(data)
    (root / "notes.txt").write_bytes(b"nothing")
    return root


def test_archive_source(spark, tree):
    source.register(spark)
    entries = spark.read.format("archive").option("path", str(tree)).load()
    counts = {os.path.basename(r.archive): r["count"] for r in entries.groupBy("archive").count().collect()}
    assert counts == {"one.xp3": 3, "two.gsp": 1, "three.arc": 3, "four.exe": 3, "five.det": 3}
    read = spark.read.format("archive").option("path", str(tree)).option("withPayload", "true").option("glob", "*.txt").load()
    assert {bytes(r["data"]) for r in read.collect()} == {b"Hello"} and read.count() == 5
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("archive").option("path", str(tree)).load().where("file_name = 'b.bin'")
        assert pushed.count() == 4
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_archive_sink(spark, tmp_path):
    source.register(spark)
    rows = [(a, k, m.file_name, bytearray(m.data)) for a in ("x", "y") for k, m in enumerate(MEMBERS)]
    df = spark.createDataFrame(rows, "archive string, ordinal int, file_name string, data binary").repartition("archive")
    for kind in ("xp3", "det"):
        out = tmp_path / kind
        df.write.format("archive").option("path", str(out)).option("archiveFormat", kind).mode("append").save()
        back = spark.read.format("archive").option("path", str(out)).option("withPayload", "true").load()
        assert sorted(bytes(r["data"]) for r in back.collect()) == sorted(2 * [m.data for m in MEMBERS])
        assert not [n for n in os.listdir(out) if n.startswith(".")]


def test_read_archives_and_extract(spark, tree, tmp_path):
    found = archives.read_archives(spark, str(tree)).where("format != 'det'").unionByName(archives.bundle_companions(spark, str(tree)))
    out = tmp_path / "out"
    result = files.extract(archives.payloads(found), str(out), images=True)
    got = {(os.path.basename(r.archive), r.status) for r in result.collect()}
    assert got == {(n, "written") for n in ("one.xp3", "two.gsp", "three.arc", "four.exe", "five.det")}
    assert png.decode((out / "one/a/picture.png").read_bytes()) == (2, 2, "RGBA", bytes(range(16)))
    assert (out / "five/a/hello.txt").read_bytes() == b"Hello"
    assert {r.status for r in files.extract(archives.payloads(found), str(out), images=True).collect()} == {"exists"}


def test_extract_is_safe(spark, tmp_path):
    rows = [("d/x.xp3", "../../evil", bytearray(b"1"), "ok"), ("d/x.xp3", "n" * 300, bytearray(b"2"), "ok"), ("d/x.xp3", "bad.gal", bytearray(b"Gale999"), "ok"), ("d/x.xp3", "no", None, "error")]
    payloads = spark.createDataFrame(rows, "archive string, file_name string, data binary, status string")
    result = files.extract(payloads, str(tmp_path / "o"), images=True)
    got = {r.file_name[:8]: (r.status, r.reason) for r in result.collect()}
    assert (tmp_path / "o/x/evil").read_bytes() == b"1" and not (tmp_path / "evil").exists()
    assert got["n" * 8][0] == "name too long" and got["bad.gal"][0] == "kept as it was" and got["no"][0] == "error"
    again = files.failure_report(result)
    assert all(json.loads(r.value)["status"] != "written" for r in again.collect())


def test_streaming_ingest(spark, tmp_path):
    src, target, check = tmp_path / "src", tmp_path / "t", tmp_path / "c"
    src.mkdir()
    for name, data in (("a", b"1"), ("b", b"2"), ("c", b"1")):
        (src / name).write_bytes(data)
    for _ in range(2):
        ingest.ingest(spark, str(src), str(target), str(check)).awaitTermination()
        (src / "d").write_bytes(b"2")
        (src / "e").write_bytes(b"3")
    assert sorted(bytes(r.content) for r in spark.read.parquet(f"{target}/contents").collect()) == [b"1", b"2", b"3"]
    assert spark.read.parquet(f"{target}/manifest").count() == 5


def test_image_surveys(spark, tmp_path):
    blocks = tlg.encode_blocks(9, 3, np.zeros(108, np.uint8).tobytes(), 4, np.array([[3, 0]]))
    rows = [("1.tlg", PICTURE), ("2.tlg", tlg.wrap(PICTURE, [(b"tags", b"4:LEFT=2:20,")])), ("3.tlg", blocks), ("4.tlg", b"short"), ("5.tlg", b"x" * 30), ("6.tlg", PICTURE)]
    images = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    got = {(r.metric, r.value): r.n for r in surveys.image_survey(images).collect()}
    assert got["kind", "strips"] == 3 and got["tag", "LEFT"] == 1 and got["tag_value", "LEFT=20"] == 1 and got["dimensions", "2x2"] == 3
    assert got["blocks_method", "0"] == 4 and got["error", "too short"] == 1 and got["strip_block", "packed"] == 12
    assert {r.path for r in surveys.unusual_images(images).collect()} == {"4.tlg", "5.tlg"}
    buckets = {r.path: r.fingerprint and json.loads(r.fingerprint) for r in surveys.image_buckets(images).collect()}
    assert buckets["1.tlg"] == buckets["6.tlg"] == {"outer": "raw", "inner": "strips", "channels": 4, "rows": 4, "raw": False, "single": True}
    assert buckets["2.tlg"]["tags"] == {"LEFT": "20"} and buckets["4.tlg"] is None
    assert buckets["3.tlg"]["transforms"] == [0, 1] and buckets["3.tlg"]["predictors"] == ["average", "median"] and buckets["3.tlg"]["partial"]
    (tmp_path / "m.tsv").write_text("1.tlg\tA\tx\n1.tlg\tB\ty\n")
    kept = surveys.curate(images, surveys.read_manifest(spark, str(tmp_path / "m.tsv")).withColumn("place", F.lit(0)), 1).collect()
    assert {(r.path, r.archive) for r in kept} == {("1.tlg", "A"), ("2.tlg", ""), ("3.tlg", "")}
    members = spark.createDataFrame([("A", p, bytearray(d)) for p, d in rows], "archive string, file_name string, data binary")
    new, manifest = surveys.collect_images(members, spark.createDataFrame([], "sha string"))
    assert new.count() == 3 and manifest.count() == 4
    assert surveys.collect_images(members, new)[0].count() == 0


def test_game_surveys(spark):
    data = xp3.build(MEMBERS, scheme="poringsoft")
    rows = [("p/g1/data.xp3", data), ("p/g1/fake.xp3", b"no"), ("p/g1/a.tpm", b"T"), ("p/g2/b.tpm", b"T"), ("p/g2/menu.tpm", b"U"), ("p/g3/plugin/z.tpm", b"Z"), ("p/g3/GAME.exe", b""), ("p/setup.exe", b""), ("p/g3/sub/play.exe", b""), ("p/run.exe", b"")]
    table = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    assert [tuple(r) for r in surveys.archive_folders(table).collect()] == [("p/g1", ["p/g1/data.xp3"])]
    books = detect.library(spark, "[games.k]\nencryption = 'null'\ntpm_hashes = ['x']\n")
    groups = surveys.plugin_groups(surveys.plugin_files(table), books).collect()
    assert groups[0].games == ["p/g1", "p/g2"] and not groups[0].known
    chosen = {r.game_dir: r.path for r in surveys.plugin_for_programs(table).collect()}
    assert chosen["p/g3"] == "p/g3/plugin/z.tpm" and chosen["p/g2"] == "p/g2/b.tpm"
    assert sorted(r.game_dir for r in surveys.game_folders(table).collect()) == ["p/g3/sub"]
    packed = spark.createDataFrame([("p/g1/data.xp3", "xp3", bytearray(data)), ("p/g1/bad.xp3", "xp3", bytearray(b"x"))], archives.ARCHIVES)
    counts = surveys.flag_counts(archives.scan(packed))
    total = surveys.survey_totals(counts, F.lit("all")).first()
    assert (total.files, total.encrypted, total.errors, total.archives) == (3, 3, 1, 2)
    missing = spark.createDataFrame([("k", "d", "x/b.xp3"), ("k", "d", "x/a.xp3")], "game_key string, game_dir string, archive string")
    assert surveys.missing_by_game(missing).first().archives == ["a.xp3", "b.xp3"]
    programs = spark.createDataFrame([("d1", "a.exe", {"ProductName": " E ", "FileVersion": ""}), ("d2", "b.exe", {"ProductName": "E"}), ("d2", "c.exe", {})], "game_dir string, name string, versions map<string,string>")
    first = surveys.engine_groups(programs).first()
    assert (first.fingerprint, first.folders, first.programs) == ("ProductName='E'", 2, ["a.exe", "b.exe"])


def test_program_versions(spark):
    made = {"ProductName": "Éngine", "FileVersion": "1.2", "Odd": ""}
    exe = b"MZ" + bytes(77) + pe.version_resource(made) + bytes(9)
    assert pe.version_strings(exe) == made
    assert pe.version_strings(b"MZ nothing") == pe.version_strings(exe[2:]) == pe.version_strings(exe[:120]) == {}
    rows = [("g/a.exe", exe), ("g/b.dll", exe), ("g/c.exe", b"MZ"), ("h/d.EXE", exe)]
    files_ = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    assert {(r.name, r.versions is None) for r in surveys.program_versions(files_).collect()} == {("a.exe", False), ("c.exe", True), ("d.EXE", False)}
    group = surveys.engine_groups(surveys.program_versions(files_, True)).first()
    assert (group.fingerprint, group.folders, group.n) == ("ProductName='Éngine', FileVersion='1.2'", 2, 3)


def test_zip_files(spark):
    def pack(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"data")
        return out.getvalue()

    rows = [("a.zip", pack(["g/data.xp3", "g/readme.txt"])), ("b.zip", pack(["x.txt"])), ("c.zip", b"bad"), ("d.zip", pack(["data.xp3"]))]
    table = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    done = spark.createDataFrame([("d.zip",)], "path string")
    out = surveys.unzip(table, done)
    assert {r.status: r.n for r in surveys.status_counts(out).collect()} == {"extracted": 1, "no archive": 1, "bad": 1, "exists": 1}
    garbled = "ゲーム".encode("cp932").decode("cp437")
    assert surveys.name_charset([("plain", 0), (garbled + "/a", 0)]) == "cp932"
    assert surveys.proper_name(garbled, 0, "cp932") == "ゲーム" and surveys.name_charset([("é", 0x800)]) is None


def test_command_line(spark, tree, tmp_path, capsys):
    assert cli.main(["identify", str(tree / "one.xp3"), str(tree / "notes.txt")]) == 0
    said = capsys.readouterr().out
    assert "one.xp3: xp3" in said and "unknown format" in said
    for kind, options in (("xp3", ["--encryption", "hash-xor", "--key", "5"]), ("vf", ["--scramble"]), ("det", ["--compress"]), ("gsp", []), ("arc", [])):
        src, packed, out = tmp_path / f"{kind}-src", tmp_path / f"{kind}-p", tmp_path / f"{kind}-out"
        src.mkdir(), packed.mkdir()
        (src / "z.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes(50))
        (src / "t.txt").write_bytes(b"text")
        assert cli.main(["create", str(src), str(packed / f"p.{kind}"), "--format", kind, *options]) == 0
        assert cli.main(["extract", str(packed), str(out)]) == 0
        assert (out / "p/t.txt").read_bytes() == b"text" and (out / "p/z.png").read_bytes() == (src / "z.png").read_bytes()
    assert cli.main(["extract", str(tree / "notes.txt"), str(tmp_path / "none")]) == 1


def test_unzip_hands_on_bounded_batches(spark):
    import io
    import zipfile

    import pyarrow as pa

    from tests.test_archives import Held

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(3):
            z.writestr(f"{k}.xp3", bytes([k]) * (1 << 20))
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(5000)], "content": [b"PK"] * 4990 + [out.getvalue()] * 10, "done": [True] * 9 + [None] * 4991})
    got = list(surveys.unzip(spark.createDataFrame([], "path string, content binary"), spark.createDataFrame([], "path string")).schema.names)
    assert got == ["path", "status", "charset", "file_name", "data"]
    files = Held()
    batches = list(surveys.unzip(files, spark.createDataFrame([], "path string")).run(iter([batch])))
    assert [b.num_rows for b in batches] == [4096, 910, 14]
    assert {tuple(r.values()) for b in batches[:1] for r in b.slice(0, 9).to_pylist()} == {(str(k), "exists", None, None, None) for k in range(9)}
