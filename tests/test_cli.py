"""Commands, formats added at run time, and one plan for archives of several schemes."""

import pytest

from vaultlens import cli
from vaultlens.codecs import pe
from vaultlens.formats import registry, xp3
from vaultlens.formats.model import Entry, Member
from vaultlens.operators import archives

PICTURES = [Member(f"p{k}.png", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes([k]) * 40) for k in range(4)]


@pytest.fixture
def folder(tmp_path):
    for name, scheme, parameters in (("one", "poringsoft", None), ("two", "hash-xor", {"shift": 4}), ("three", None, None)):
        place = tmp_path / "games" / name
        place.mkdir(parents=True)
        (place / "data.xp3").write_bytes(xp3.build(PICTURES, scheme=scheme, parameters=parameters))
    (tmp_path / "games/one/game.exe").write_bytes(b"MZ" + bytes(77) + pe.version_resource({"ProductName": "E"}))
    (tmp_path / "games/one/own.tpm").write_bytes(b"plugin")
    return tmp_path


def test_archives_of_several_schemes_are_extracted_by_one_plan(spark, folder, capsys):
    options = cli.parser().parse_args(["extract", str(folder / "games"), str(folder / "out")])
    cli.extract(spark, options).collect()
    got = [p.read_bytes() for p in sorted((folder / "out").rglob("*.png"))]
    assert len(got) == 12 and set(got) == {m.data for m in PICTURES}
    options = cli.parser().parse_args(["xp3", "extract", str(folder / "games/two"), str(folder / "again"), "--encryption", "hash-xor", "--key", "4", "--glob", "p1*"])
    cli.extract(spark, options).collect()
    assert [p.read_bytes() for p in (folder / "again").rglob("*.png")] == [PICTURES[1].data]


def test_reports(spark, folder, capsys):
    for kind, words in (("archives", "data.xp3"), ("engines", "ProductName='E'"), ("plugins", "games/one"), ("games", "confirmed"), ("images", "metric")):
        cli.survey(spark, cli.parser().parse_args(["survey", kind, str(folder / "games")]))
        assert words in capsys.readouterr().out, kind
    cli.survey(spark, cli.parser().parse_args(["survey", "archives", str(folder / "games"), "--rows", "1"]))
    assert "and 2 more" in capsys.readouterr().out


def test_a_format_added_at_run_time(spark, tmp_path):
    def parse(content):
        return [Entry(file_name="all", offset=4, stored_size=len(content) - 4, original_size=len(content) - 4)]

    registry.register_format("plain", parse, lambda d, e, a, o: d[4:], lambda members, options: b"PLN:" + b"".join(m.data for m in members), lambda path, head, tail: head.startswith(b"PLN:"))
    try:
        assert registry.identify("x.bin", b"PLN:abc", b"") == "plain" and "plain" in cli.formats()
        (tmp_path / "x.bin").write_bytes(b"PLN:abc")
        found = archives.read_archives(spark, str(tmp_path))
        assert [(r.format, bytes(r.data)) for r in archives.payloads(found).collect()] == [("plain", b"abc")]
        assert [r.file_name for r in archives.scan(found).collect()] == ["all"]
        rows = spark.createDataFrame([("a", 1, "y", bytearray(b"2")), ("a", 0, "x", bytearray(b"1"))], "archive string, ordinal int, file_name string, data binary")
        assert bytes(archives.pack(rows, "plain").first().content) == b"PLN:12"
        assert registry.discover("no.such.group") == []
    finally:
        del registry.FORMATS["plain"]
