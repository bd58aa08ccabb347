"""Every registered archive query with SQL gives what DuckDB gives; column functions and relational helpers on small cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vaultlens.functions import bytes as fb
from vaultlens.functions import paths
from vaultlens.operators import relational as rel
from vaultlens.plans import queries as plans


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(map(str, r)) for r in frame[columns].itertuples(index=False)), key=str), columns


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    function, sql = plans.QUERIES[name]
    got = function(spark, DATA).toPandas()
    assert rows(got) == rows(duck.sql(sql).df())


@pytest.mark.parametrize("name", ["image_blocks", "image_layers", "image_strips"])
def test_images_of_values_that_round(spark, tmp_path, name):
    """0.009 as a float is below 0.009, but 1000 times it is 9 as a float."""
    values = [0.009, -0.037, 0.29] + [k / 1000 for k in range(1, 62)]
    spark.createDataFrame([(1, values)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    function, sql = plans.QUERIES[name]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert rows(function(spark, str(tmp_path)).toPandas()) == rows(c.sql(sql).df())


def column(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("name", "pattern", "fits"), [
    ("a/b.txt", "*.txt", True), ("a/b.txt", "a?b.*", True), ("a/b.TXT", "*.txt", False), ("x1", "x[0-9]", True), ("x1", "x[!0-9]", False), ("a\nb", "a*b", True), ("[x]", "[[]x]", True), ("n", None, True),
])
def test_glob(spark, name, pattern, fits):
    assert column(spark, name, lambda c: paths.glob(c, pattern)) is fits


def test_paths(spark):
    assert column(spark, "../..//C:x/./a\\b", paths.safe_path) == "C:x/a/b"
    assert column(spark, "c:\\..\\a", paths.safe_path) == "a"
    assert [column(spark, n, paths.extension) for n in ("d/A.WS2", ".hidden", "no", "a.b.c", "x/.a.txt")] == [".ws2", "", "", ".c", ".txt"]
    assert column(spark, "x/Menu.tpm", paths.is_utility_plugin) and column(spark, "a/patch2.xp3", paths.is_patch)
    assert column(spark, "A.JPG", paths.signature_extension) == ".jpg"
    assert column(spark, bytearray(b"\x89PNG" + bytes(12)), lambda c: paths.has_signature(c, F.lit(".png")), "binary") is False
    assert column(spark, bytearray(b"BMxx"), lambda c: paths.has_signature(c, F.lit(".bmp")), "binary") is True


def test_byte_columns(spark):
    assert column(spark, bytearray(b"ab\1\2\3\4"), lambda c: fb.little_endian(c, 2, 4), "binary") == 0x04030201
    assert column(spark, bytearray(b"ab"), lambda c: fb.little_endian(c, 0, 4), "binary") is None
    assert column(spark, bytearray(b"A\xff\x08"), fb.lz77_decode, "binary") is None
    assert column(spark, None, fb.lz77_decode, "binary") is None
    assert column(spark, bytearray("テ".encode("cp932")), lambda c: fb.charset_decode(c, "cp932"), "binary") == "テ"
    assert column(spark, "4:LEFT=2:20,bad, 3:TOP=3:120,", fb.tag_map) == {"LEFT": "20", "TOP": "120"}
    assert [column(spark, t, fb.slug) for t in ("A  b_c!", "テ", "--", "?")] == ["a-b-c", column(spark, "テ", lambda c: F.substring(F.md5(c), 1, 8)), "unknown", "unknown"]
    picture = column(spark, bytearray(b"TLG5.0\0raw\x1a"), fb.image, "binary")
    assert picture.pixels is None and "early" in picture.error


def test_byte_functions_hold_a_batch_once(spark):
    """Of 40 values of 250,000 bytes, the results and one value more are held: neither the values nor the results as lists."""
    import tracemalloc

    import pyarrow as pa

    data = pa.array([bytes([k]) * 250_000 for k in range(39)] + [None])
    tracemalloc.start()
    out = fb.byte_function(lambda d: bytes(x ^ 1 for x in d[:4]) + d[4:]).func(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [bytes([k ^ 1]) * 4 + bytes([k]) * 249_996 for k in range(39)] + [None]
    assert peak < 14_000_000


def test_binary_arrays():
    for given in ([], [None], [b""], [b"ab", None, b"", b"c"] * 5, [b"x"] * 9):
        made = fb.binary_array(iter(given))
        made.validate(full=True)
        assert made.to_pylist() == list(fb.values(made)) == given


def test_first_and_last(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("m", 5, None)], "key string, place int, v string")
    assert sorted(map(tuple, rel.last_wins(df, ["key"], "place").collect())) == [("k", 1, "c"), ("m", 5, None)]
    assert sorted(map(tuple, rel.first_per_key(df, ["key"], ["place"]).collect())) == [("k", 1, "a"), ("m", 5, None)]


def test_ancestors_and_overlaps(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b",), ("ab",), ("c/d/e",)], "path string")
    assert sorted(r.path for r in rel.without_ancestors(df, "path").collect()) == ["a/b", "ab", "c/d/e"]
    parts = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 10, 35)], "part int, start long, end long")
    ask = spark.createDataFrame([(7, 8, 20), (8, 0, 0), (9, 34, 9)], "request int, offset long, size long")
    for bucket in (1, 7, 1000):
        assert sorted(map(tuple, rel.overlaps(ask, parts, bucket).collect())) == [(7, 0, 8, 10), (7, 2, 0, 18), (9, 2, 24, 25)]


def test_running_total(spark, monkeypatch):
    df = spark.createDataFrame([(k, k % 7) for k in (5, 1, 900, 17, 18, 4000, 2)], "key long, size long")
    expected = {k: sum(x % 7 for x in (1, 2, 5, 17, 18, 900, 4000) if x < k) for k in (1, 2, 5, 17, 18, 900, 4000)}
    assert {r.key: r.start for r in rel.running_total(df, "key", "size", 3).collect()} == expected
    monkeypatch.setattr(rel, "WINDOW_GROUPS", 2)
    assert {r.key: r.start for r in rel.running_total(df, "key", "size", 3).collect()} == expected


def test_early_exit(spark):
    data = [("a", k, False) for k in range(5)] + [("b", 0, True), ("b", 1, False)] + [("c", k, k == 1) for k in range(4)]
    df = spark.createDataFrame(data, "g string, k int, bad boolean")
    got = {r.g: (r.checked, r.failures, r.confirmed) for r in rel.early_exit(df, ["g"], ["k"], "bad", 3).collect()}
    assert got == {"a": (3, 0, True), "b": (2, 1, False), "c": (4, 1, False)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, k int, bad boolean")
    assert rel.early_exit(empty, ["g"], ["k"], "bad", 3).count() == 0
    assert rel.counters(empty, {"g": F.col("g")}).count() == 0
    assert rel.last_wins(empty, ["g"], "k").count() == 0
