"""Each operator against a brute-force version on documents with every odd case, and on empty tables."""

import functools
import hashlib
import inspect
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import frame, prose
from vaultlens.llm import chat, common, decontamination, fingerprints, language_model, mixing, near_duplicates, quality, suffix_dedup, token_counts, token_files

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, kind=WORD):
    return kind.findall((text or "").translate(LOWER))


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1 suffix dedup


@pytest.mark.parametrize(("anchor_bytes", "most_hot", "group_windows"), [(suffix_dedup.ANCHOR_BYTES, 20_000, 100_000), (0, 20_000, 50), (1500, 3, 7), (0, 1, 1)])
def test_suffix_dedup(docs, rows, anchor_bytes, most_hot, group_windows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", most_hot)
    monkeypatch.setattr(suffix_dedup, "GROUP_WINDOWS", group_windows)
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = Counter()
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        expected[(i, len(t), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~np.append(False, gone[:-2]))) if len(t) else 0, hashlib.sha256(kept).hexdigest())] += 1
    assert collected(suffix_dedup.remove_repeats(docs, anchor_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_equal_rows_cost_no_more_than_other_rows(spark):
    text = prose(random.Random(7), 90)
    rows = [(None, text, "a")] * 1500 + [(1, text, "a")] * 500 + [(2, text[:50] + " and then " + text[40:], "a"), (3, "short", "a")]
    start = time.perf_counter()
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(4)).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert time.perf_counter() - start < 60
    n = len(text.encode())
    by = {r.doc_id: (r.n_removed, r.n_spans, r["count"]) for r in got}
    assert by[None] == (n, 1, 1500) and by[1] == (n, 1, 500) and by[3] == (0, 0, 1) and by[2][0] >= n - 60 and len(got) == 4


@pytest.mark.parametrize("shard", [3, 50, 10**6])
def test_equal_windows(shard):
    rng = np.random.default_rng(12)
    for n in (1, 2, 40, 300):
        blocks = rng.integers(0, 3, (n, suffix_dedup.DEPTH)).astype(np.uint64)
        seen = Counter(map(tuple, blocks.tolist()))
        assert suffix_dedup.equal_windows(blocks, shard).tolist() == [seen[tuple(b)] > 1 for b in blocks.tolist()]


def test_suffix_dedup_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("shard", [10**9, 700, 2000])
def test_merged_transforms_find_all_repeats(shard):
    rng = np.random.default_rng(3)
    some = lambda n: rng.choice(np.frombuffer(b"abcd", np.uint8), n).tobytes()
    for _ in range(6):
        base = [some(rng.integers(150, 600)) for _ in range(6)]
        pieces = lambda: [some(rng.integers(0, 90)), base[rng.integers(6)][rng.integers(60) :], b"x" * rng.integers(300), b"pq" * rng.integers(150)]
        texts = [b"".join(pieces()[rng.integers(4)] for _ in range(4)) for _ in range(14)]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        expected = [i + 200 <= len(t) and seen[t[i : i + 200]] > 1 for t in texts for i in range(len(t))]
        assert suffix_dedup.repeated_windows(data, off, shard).tolist() == expected
        _, _, doc, start, n = suffix_dedup.fragments(data, off)
        cover = np.zeros(len(data), int)
        for d, s, k in zip(doc, start, n, strict=True):
            cover[off[d] + s : off[d] + s + k] += 1
        assert cover.tolist() == [int(i + 200 <= len(t)) for t in texts for i in range(len(t))]


@pytest.mark.parametrize(("group_bytes", "rows_at_once"), [(500, 2), (500, 1), (3000, 3), (1_000_000, 4), (500, 1000)])
def test_an_anchor_over_many_batches_is_merged_at_once(spark, monkeypatch, group_bytes, rows_at_once):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    rng, key = np.random.default_rng(11), "spark.sql.execution.arrow.maxRecordsPerBatch"
    some = lambda n: rng.integers(32, 127, n).astype(np.uint8).tobytes()
    contents, expected, row = [], Counter(), 0
    for anchor, n in enumerate([1, 9, 2, 1, 1, 14, 3, 1]):
        shared = some(200)  # in the anchor's first and last fragment only
        for k in range(n):
            twice = n > 1 and k in (0, n - 1)
            before = some(rng.integers(1, 90))
            content = before + shared + some(5) if twice else some(rng.integers(200, 330))
            contents.append((anchor, row, 7, 1, bytearray(content)))
            if twice:
                expected[(row, 7 + len(before), 7 + len(before) + 200)] += 1
            row += 1
    contents = [(a, bytearray(str(row).encode()), *rest) for a, row, *rest in contents]
    df = spark.createDataFrame(contents, "anchor long, row binary, start long, n long, content binary").coalesce(1).sortWithinPartitions("anchor", "row")
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows_at_once))
    try:
        assert collected(suffix_dedup.merge_fragments(df).withColumn("row", F.col("row").cast("string").cast("long")), "row", "start", "end") == expected
    finally:
        spark.conf.set(key, old)


# 2 token counts


def test_token_counts_and_cache(spark, docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    cache = common.scratch(spark, "test-cache")
    expected = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert token_counts.count_tokens(none, path, cache).count() == 0
    assert collected(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, _ in rows})
    assert collected(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == expected
    assert spark.read.parquet(cache).count() == stored.count()
    piece = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert collected(token_counts.count_tokens(docs, piece, cache), "doc_id", "n_tokens") == Counter((i, len(sp.encode(t or ""))) for i, t, _ in rows)


def test_entries_that_two_calls_append_are_read_as_one(spark, docs, rows):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark, "test-cache")
    first = collected(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens")
    spark.read.schema(token_counts.CACHE).parquet(cache).coalesce(1).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    assert collected(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == first


def test_texts_are_cut_where_tokens_begin():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.cuts_at_blanks(path) and not token_counts.cuts_at_blanks(public_tokenizers.path("word_bpe_49k.json"))
    tok, rng = Tokenizer.from_file(path), np.random.default_rng(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "1", "é", "!", " <|endoftext|> ", "\t", "　"], 30))
        parts = token_counts.pieces(text, 5)
        assert "".join(parts) == text and [i for p in parts for i in tok.encode(p).ids] == tok.encode(text).ids


def test_words_behind_blanks_are_counted_as_in_whole_texts():
    import pyarrow as pa

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), np.random.default_rng(2)
    tok, counter = Tokenizer.from_file(path), token_counts.BlankCounter(path)
    signs = ["a", "b", "The", "über", "don't", "x1", "é", "!?", " ", " ", " ", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "\x85", "\x1c", "\u200b", "<|endoftext|>", "ﷺ", "\u0301"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)] + [" ", "", " a", "a ", "a b", "w " * 50_000]
    assert counter(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter(pa.array([], pa.string())).tolist() == []


# 3 quality


def test_quality(spark, docs, rows, none):
    rng = np.random.default_rng(2)
    noisy = lambda t: re.sub(" ", lambda m: rng.choice(["$$$ ", "%%% ", "!! "]), t)
    good = [t for _, t, _ in rows if t and len(t) > 50]
    many = [(k, noisy(good[k % len(good)]) if k % 3 == 0 else good[k % len(good)], "a") for k in range(900)]
    table = frame(spark, many + [(10_000, None, None), (10_001, "", "a")])
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(900)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    stats = common.stored(quality.features(table), "test-stats")
    model = quality.fit(quality.training_rows(stats, labels))
    got = {r.doc_id: r.score for r in quality.score_features(stats, model).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.3) == (k % 3 != 0) for k in held]) > 0.97
    kept = quality.keep(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.3}
    untrained = quality.fit(quality.training_rows(stats.limit(0), labels))
    assert {round(r.score, 2) for r in quality.score_features(stats, untrained).collect()} == {0.5}
    assert quality.features(none).count() == 0 and quality.keep(none, model).count() == 0
    assert quality.features(docs).count() == len(rows)


def dense_scores(x, y, fold, size=256, width=4.0, ridge=1e-4):
    """The scores of x by a least-squares fit of all rows with a label y at once, calibrated by the minimax formula."""
    known = [k for k, v in enumerate(y) if v is not None]
    rng, d = np.random.default_rng(11), x.shape[1]
    projection, phase = rng.normal(size=(d, size)) / width, rng.uniform(0, 2 * np.pi, size)
    mean, scale = x[known].mean(0), np.maximum(x[known].std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([math.sqrt(2 / size) * np.cos(z @ projection + phase), z, np.ones((len(x), 1))])

    def ridge_fit(rows):
        more = math.sqrt(ridge * max(1.0, len(rows))) * np.eye(z.shape[1])
        return np.linalg.lstsq(np.vstack([z[rows], more]), np.concatenate([[y[k] for k in rows], np.zeros(z.shape[1])]), rcond=None)[0]

    bins, n = defaultdict(list), 4000
    for f in range(4):
        w = ridge_fit([k for k in known if fold[k] != f])
        for k in known:
            if fold[k] == f:
                bins[min(n - 1, max(0, int((z[k] @ w + 0.5) / 2 * n)))].append(y[k])
    used = sorted(bins)
    total, weight = np.cumsum([0, *(sum(bins[b]) for b in used)]), np.cumsum([0, *(len(bins[b]) for b in used)])
    mean_of = lambda a, b: (total[b + 1] - total[a]) / (weight[b + 1] - weight[a])
    levels = [max(min(mean_of(a, b) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    raw = z @ ridge_fit(known)
    return np.clip(0.999 * np.interp(raw, [(b + 0.5) / n * 2 - 0.5 for b in used], levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def test_quality_equals_a_dense_fit(spark):
    rng = random.Random(3)
    table = frame(spark, [(k, " ".join(["$$$", "!!", "%"][k % 3] if rng.random() < (k % 5) / 8 else w for w in prose(rng, rng.randint(3, 60)).split()), "a") for k in range(160)] + [(500, "", "a")])
    labels = spark.createDataFrame([(k, int(k % 5 < 2 + (k % 7 == 0))) for k in range(160)], "doc_id long, quality int")
    stats = common.stored(quality.features(table), "test-stats")
    model = quality.fit(quality.training_rows(stats, labels))
    rows = stats.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))).orderBy("doc_id").collect()
    y = [None if r.doc_id == 500 or zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else float(r.doc_id % 5 < 2 + (r.doc_id % 7 == 0)) for r in rows]
    expected = dense_scores(np.array([r.stats for r in rows]), y, [r.fold for r in rows])
    got = {r.doc_id: r.score for r in quality.score_features(stats, model).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], expected, atol=1e-6) and 0.1 < np.std(expected)


def test_statistics_of_plain_counts():
    text = "The cat cat sat!\n\nÄÖ 12 $$ | the end.\nThe end."
    row = dict(zip(quality.NAMES, quality.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0], strict=True))
    said = text.split()
    assert row["bytes"] == pytest.approx(math.log1p(len(text.encode()))) and row["words"] == pytest.approx(math.log1p(len(said)))
    assert row["distinct_words"] == pytest.approx(len(set(said)) / len(said)) and row["top_run"] == pytest.approx(1 / len(said))
    assert row["digit"] == pytest.approx(2 / len(text)) and row["short_words"] == pytest.approx(sum(len(w.encode()) <= 3 for w in said) / len(said))
    assert row["distinct_lines"] == 1 and row["line_words"] == pytest.approx(math.log1p(len(said) / 3))


def test_isotonic():
    level = quality.isotonic(np.array([1, 1, 1, 2.0]), np.array([0, 1, 0, 2.0]))
    assert level.tolist() == [0, 0.5, 0.5, 1]


# 4 token files


def test_token_files(spark, docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    expected, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1] or "", r[1] is not None)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for files in (1, 5):
        out = common.scratch(spark, "test-tokens")
        token_files.write_shards(docs, out, path, 2, 49408, files)
        got = [tuple(r) for r in token_files.document_index(token_files.read_shards(spark, out)).orderBy("start").collect()]
        assert got == expected
    out = common.scratch(spark, "test-tokens")
    token_files.write_shards(none, out, path, 2, 49408)
    assert token_files.document_index(token_files.read_shards(spark, out)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_files_of_every_tokenizer(spark, docs, rows, name):
    path = public_tokenizers.path(name)
    assert token_files.cuts_at_words(path) == (name == "word_bpe_49k.json")
    if name.endswith(".json"):
        tok = Tokenizer.from_file(path)
        encode = lambda t: tok.encode(t, add_special_tokens=False).ids
        assert token_files.vocabulary_size(path) == max(tok.get_vocab().values()) + 1
    else:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    more = [(900, "Don't STOP  it's\tÄÖ 12 a1b2 x<|endoftext|>y\n\n ok...", "a"), (900, "ab", "a"), (900, "aa", "a")]
    expected = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows + more for ids in [[*encode(t or ""), 2]]]
    out = common.scratch(spark, "test-tokens")
    token_files.write_shards(docs.unionByName(frame(spark, more)), out, path, 2)
    got = token_files.document_index(token_files.read_shards(spark, out)).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expected)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_ids_that_need_more_bits_are_an_error():
    for ids, bits in (([65541], 16), ([0, 8], 3), ([-1], 16), ([1 << 20], 20)):
        with pytest.raises(OverflowError):
            token_files.pack(np.array(ids), bits)


def test_null_doc_id_comes_first(spark):
    docs = spark.createDataFrame([(3, "a"), (None, "b"), (1, None)], "doc_id long, text string")
    out = common.scratch(spark, "test-tokens")
    token_files.write_shards(docs, out, public_tokenizers.path("word_bpe_49k.json"), 2, 49408)
    got = token_files.document_index(token_files.read_shards(spark, out)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 2), (1, 1), (3, 2)]


@pytest.mark.parametrize("vocabulary", [2, 3, 50, 257, 49408, 65537, 1 << 20, 1 << 31])
def test_packed_ids(vocabulary):
    rng, bits = np.random.default_rng(4), token_files.bits_for(vocabulary)
    assert (1 << bits) >= vocabulary > (1 << bits) // 2
    for n in (0, 1, 7, token_files.BLOCK, 2 * token_files.BLOCK + 5):
        ids = rng.integers(0, vocabulary, n)
        raw, at = token_files.pack(ids, bits)
        shard = {"n_ids": n, "bits": bits, "block_offsets": at.tobytes(), "ids": raw}
        assert token_files.read_ids(shard, 0, n).tolist() == ids.tolist()
        for a, b in ((3, 4), (token_files.BLOCK - 2, token_files.BLOCK + 3), (n - 1, n + 9), (5, 2)):
            assert token_files.read_ids(shard, a, b).tolist() == ids[max(a, 0) : max(b, a)].tolist()[: max(0, b - a)]


# 5 decontamination


def brute_decontamination(texts, items, window):
    phrases = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases[tuple(w[k : k + window])].add("" if i is None else str(i))
    sizes = {len(p) for p in phrases}
    for i, t in texts:
        w, hit, found = words(t, ALNUM), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if got := phrases.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= got
        yield i, len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination(spark, docs, rows, block_words):
    long = next(t for i, t, _ in rows if i == 31)
    cut = long.split()
    items = [(1, " ".join(cut[3:40])), (2, "One two"), (10, None), (11, "!!"), (None, " ".join(cut[10:20]).upper()), (3, "absent words of which none occurs at all anywhere here"), (2, "one TWO"), (4, " ".join(cut[1:12]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    unique = docs.dropDuplicates(["doc_id"])  # blocks of queries are joined by doc_id
    texts = [(r.doc_id, r.text) for r in unique.select("doc_id", "text").collect()]
    unique = frame(spark, [(i, t, "a") for i, t in texts])
    got = decontamination.decontaminate(unique, table, block_words=block_words)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    assert got == Counter(brute_decontamination(texts, items, 10))
    spans = decontamination.decontaminate(unique, table, block_words=block_words).where("n_hit > 0").select("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n"))
    assert spans.where("n_hit != n").count() == 0 and spans.count() >= 3


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontamination_keeps_every_row_at_any_benchmark_size(spark, docs, rows, block_words):
    cut = next(t for i, t, _ in rows if i == 31).split()
    items = [(k, " ".join(cut[3 * k : 3 * k + 14])) for k in range(8)] + [(8, "one two"), (None, "same id")]
    again = [(6, "one two"), (6, "one two"), (6, "three one two"), (None, " ".join(cut[:30])), (None, " ".join(cut[:30])), (None, " ".join(cut[9:40]) + " one two"), (None, None), (None, "")]
    texts = [(i, t) for i, t, _ in rows] + again
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs.unionByName(frame(spark, [(i, t, "a") for i, t in again])), table, block_words=block_words)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    found = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    assert found == Counter(brute_decontamination(texts, items, 10)) and sum(found.values()) == len(texts)


def test_decontamination_proximity_and_empty(spark, none):
    item = spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id long, text string")
    docs = frame(spark, [(1, "see the quick old brown fox jumps over", "a"), (2, "the quick brown fox jumps", "a"), (3, "fox", "a"), (4, "jumps fox brown quick the", "a")])
    hits = lambda slop: sorted(r.doc_id for r in decontamination.decontaminate(docs, item, slop=slop).where("n_hit > 0").collect())
    assert hits(0) == [2] and hits(1) == [1, 2]
    assert decontamination.decontaminate(none, item).count() == 0
    assert decontamination.decontaminate(docs, item.limit(0)).where("n_hit > 0").count() == 0


# 6 language model


def brute_scores(rows, mu=100.0):
    texts = [(i, [*words(t), None]) for i, t, _ in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    one, two, three = Counter(), Counter(), Counter()
    for i, w in texts:
        if not held[i]:
            one.update(w)
            two.update(itertools.pairwise([None, *w]))
            three.update(zip([None, *w], w, w[1:], strict=False))
    total, kinds = sum(one.values()), len(one)
    p1 = lambda x: (one[x] + 1) / (total + kinds + 1)
    p2 = lambda h, x: (two[h, x] + mu * p1(x)) / (one[h] + mu)
    p3 = lambda g, h, x: (three[g, h, x] + mu * p2(h, x)) / (two[g, h] + mu)
    expected = defaultdict(list)
    for i, w in texts:
        base = sum(math.log10(p1(x)) for x in w)
        full = math.log10(p2(None, w[0])) + sum(math.log10(p3(*x)) for x in zip([None, *w], w, w[1:], strict=False))
        expected[i].append((held[i], len(w), sum(one[x] > 0 for x in w), total, base, full))
    return expected


@pytest.mark.parametrize("tasks", [language_model.MOST_TASKS, 1])  # a task for each group; several groups in a task
@pytest.mark.parametrize("small", [{}, {"block_bytes": 3000, "group_entries": 100}])
def test_language_model(docs, rows, none, small, tasks, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_TASKS", tasks)
    expected, got = brute_scores(rows), defaultdict(list)
    for r in language_model.score(docs, **small).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert got.keys() == expected.keys()
    for i, e in expected.items():
        assert np.allclose(np.array(sorted(got[i]), float), np.array(sorted(e), float), rtol=1e-9)
    assert language_model.score(none).count() == 0


def test_automaton_lanes_agree_with_one_walk(monkeypatch):
    rng = np.random.default_rng(6)
    n, one, two = 12, {}, {}  # word -> following words; bigram -> following words, each seen as a bigram with its second word
    text, first = rng.integers(0, n, 3000), [0, 7, 8, 900]
    for u in range(n):
        one[u] = set(rng.choice(n, 5, replace=False).tolist())
    for u in range(n):
        for v in one[u]:
            two[u, v] = {w for w in one[v] if rng.random() < 0.5}
    pairs = sorted(two)
    number = {p: n + k for k, p in enumerate(pairs)}
    arcs = {(u, v): (rng.normal(), number[u, v]) for u, v in pairs} | {(number[p], w): (rng.normal(), number[p[1], w]) for p in pairs for w in two[p]}
    keys = sorted(arcs)
    fail, root = rng.normal(size=n + len(pairs)), rng.normal(size=n)
    back = np.array([n + len(pairs)] * n + [v for _, v in pairs])
    weights, targets = (np.array(x) for x in zip(*(arcs[k] for k in keys), strict=True))
    a = language_model.Automaton(np.array([s * n + w for s, w in keys]), weights, targets, fail, back, root)
    state, expected, failures = None, [], Counter()
    for k, w in enumerate(text.tolist()):
        state, weight, steps = 3 if k in first else state, 0.0, 0
        while state < n + len(pairs) and (state, w) not in arcs:
            weight, state, steps = weight + fail[state], back[state], steps + 1
        gained, state = arcs[state, w] if state < n + len(pairs) else (root[w], w)
        expected.append(weight + gained)
        failures[steps] += 1
    assert min(failures[0], failures[1], failures[2]) > 100
    for lanes in (1, 5, 4096):
        monkeypatch.setattr(a, "LANES", lanes)
        assert np.allclose(a.read(text, np.array(first), 3), expected)


def test_counts_and_codes_have_no_fixed_width():
    for top in (1 << 16, (1 << 24) + 7, (1 << 32) + 1, (1 << 63) + 5):
        values = np.array([0, top, 3, top - 1], np.uint64)
        assert common.expand(common.squeeze(values)).tolist() == values.tolist()
    hashes = np.sort(common.mix64(np.arange(200_000, dtype=np.uint64)))
    at = language_model.bounds(hashes, 64, 100_000)  # more groups than 16 bits number
    assert at[0] == 0 and at[-1] == len(hashes) and np.diff(at).max() < 20


def thue_morse(k):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))


def test_words_that_sums_of_powers_confuse_count_apart(spark):
    pairs = [(thue_morse(k), thue_morse(k).translate(str.maketrans("ab", "ba"))) for k in (4, 10, 12)]
    rows = [(k, w, "a") for k, w in enumerate(w for p in pairs for w in p)]
    docs = frame(spark, rows)
    items = spark.createDataFrame([(k, p[0]) for k, p in enumerate(pairs)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).where("n_hit > 0").collect()) == [0, 2, 4]
    expected = brute_scores(rows)
    for r in language_model.score(docs).collect():
        assert (r.n_known, r.train_tokens) == expected[r.doc_id][0][2:4] and r.score == pytest.approx(expected[r.doc_id][0][5])
    assert near_duplicates.near_duplicates(docs).where("kept").count() == 6


# 7 fingerprints


def test_fingerprints(docs, rows, none, spark):
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    expected = Counter()
    for (i, t, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, half = t or "", len(t or "") // 2
        edited = t[: len(t) - half] + (after or "")[:half]
        expected[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.fingerprint(t.encode()), fingerprints.fingerprint(edited.encode()))] += 1
    for files in (1, 4):
        out = fingerprints.neighbours(docs, files)
        assert collected(out, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint") == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.collect())
    assert fingerprints.neighbours(none).count() == 0
    tied = frame(spark, [(None, f"{k} " + "x" * k, "a") for k in range(40)] + [(7, f"{k} y", "a") for k in range(40)])
    order = sorted(f"{k} y" for k in range(40)) + sorted(f"{k} " + "x" * k for k in range(40))
    expected = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode()).hexdigest() for t, x in zip(order, order[1:] + order[:1], strict=True))
    for files in (1, 6):
        assert Counter(r.edited_sha256 for r in fingerprints.neighbours(tied, files).collect()) == expected
    alone = fingerprints.neighbours(frame(spark, [(1, "abcd" * 30, "a")])).first()
    assert alone.near_next == 1


def plain_signature(text, size, most):
    mask, out, at = (1 << 64) - 1, "", 0
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    step = pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def piece(a, b):
        value = sum((text[j] + 1) * pow(step, j - a, 1 << 64) for j in range(a, b)) + (b - a) * 0xA24BAED4963EE407 & mask
        for _ in range(2):
            value = (value ^ value >> 32) * 0xD6E8FEB86659FD93 & mask
        return alphabet[(value ^ value >> 32) & 63]

    for i in range(len(text)):
        h = sum((text[i - k] + 1) * pow(0x01000193, k + 1, 1 << 32) for k in range(7) if i >= k) & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        if (h ^ h >> 13) % size == size - 1 and len(out) < most - 1:
            out, at = out + piece(at, i + 1), i + 1
    return out + piece(at, len(text)) if at < len(text) else out


def plain_fingerprint(text):
    size = 3
    while size * 64 < len(text):
        size *= 2
    while len(one := plain_signature(text, size, 64)) < 32 and size > 3:
        size //= 2
    return f"{size}:{one}:{plain_signature(text, 2 * size, 64)}"


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (a, *one), (b, *two) = x.split(":"), y.split(":")
    best = 0.0
    for p, s in enumerate(one):
        for q, t in enumerate(two):
            if s and t and int(a) << p == int(b) << q:
                k = max(1, min(7, min(len(s), len(t)) // 2))
                if any(s[i : i + k] in t for i in range(len(s) - k + 1)):
                    row = list(range(len(t) + 1))  # insertions and deletions
                    for i, c in enumerate(s):
                        last, row[0] = row[0], i + 1
                        for j, e in enumerate(t):
                            last, row[j + 1] = row[j + 1], last if c == e else 1 + min(row[j], row[j + 1])
                    best = max(best, 1 - row[-1] / (len(s) + len(t)))
    return best


def test_fingerprints_equal_plain_loops(spark):
    rng = random.Random(4)
    base = prose(rng, 150)
    texts = ["", "a", "abcdefg", "x" * 400, base, base[:400] + "!" + base[400:], base[300:] + base[:300], prose(rng, 40), prose(rng, 400), "ab" * 500, "é" * 70, base + base, base[:200]]
    texts += [base[: rng.randint(0, 600)] + prose(rng, rng.randint(0, 30)) for _ in range(8)]
    rows, expected = [(k, t, "a") for k, t in enumerate(texts)], []
    after = [texts[-1], *texts[:-1]]  # the next lower doc_id; the last comes after the first
    for (k, t, _), x in zip(rows, after, strict=True):
        half = len(t) // 2
        own, edited, following = (plain_fingerprint(s.encode()) for s in (t, t[: len(t) - half] + x[:half], x))
        expected.append((k, own, edited, plain_likeness(own, edited), plain_likeness(own, following)))
    got = sorted((r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.neighbours(frame(spark, rows)).collect())
    for g, e in zip(got, expected, strict=True):
        assert g[:3] == e[:3] and g[3:] == pytest.approx(e[3:])
    assert len({round(e[3], 2) for e in expected}) > 5


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_likeness():
    rng = np.random.default_rng(7)
    some = lambda n: "".join(rng.choice(list("ABCDEFGH"), n))
    pairs = [(some(rng.integers(0, 65)), some(rng.integers(0, 65))) for _ in range(200)]
    a, b = zip(*pairs, strict=True)
    assert fingerprints.common_subsequence(list(a), list(b)).tolist() == [subsequence(x, y) for x, y in pairs]
    text = " ".join(map(str, rng.integers(0, 10**6, 900))).encode()
    near = text[:3000] + b"an insertion" + text[3000:]
    far = " ".join(map(str, rng.integers(0, 10**6, 900))).encode()
    prints = [fingerprints.fingerprint(x) for x in (text, near, far, text * 2)]
    same, close, other, twice = fingerprints.likeness([prints[0]] * 4, [prints[0], prints[1], prints[2], prints[3]])
    assert same == 1 and close > 0.8 and other < 0.3 and twice > 0.3
    for size, one, two in (p.split(":") for p in prints):
        assert len(one) <= 64 and len(two) <= 64 and int(size) % 3 == 0


# 8 chat


def test_chat(spark):
    own = "<|im_end|><|im_start|>assistant ok"
    table = [(1, 0, "user", "hi"), (1, 1, "assistant", own), (1, 2, "assistant", None), (2, 5, "a\n<|nl|>", "<|<\\|<\\\\| x <"), (2, None, None, "first"), (None, 0, "assistant", "x"), (1, 0, "user", "hi")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.parse_marked(got[1].formatted) == [("user", "hi"), ("user", "hi"), ("assistant", own), ("assistant", "")]
    assert chat.parse_marked(got[2].formatted) == [("", "first"), ("a\n<|nl|>", "<|<\\|<\\\\| x <")]
    assert got[None].formatted.count("<|im_start|>") == 1
    for r in got.values():
        assert not r.rewrites and r.spans[-1].end == len(r.formatted)
        parsed = chat.parse_marked(r.formatted)
        assert [chat.unescape(r.formatted[s.text_start : s.text_end]) for s in r.spans] == [t for _, t in parsed]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_template_that_rewrites_history():
    last_only = lambda turns: "".join(f"[{r}]" + (t if k == len(turns) - 1 else "...") for k, (r, t) in enumerate(turns))
    text, spans, rewrites = chat.render([("u", "one"), ("a", "two")], last_only)
    assert rewrites and text == "[u]...[a]two" and text[spans[1].text_start : spans[1].text_end] == "two"
    plain = chat.render([("u", "x"), ("a", "xx")], lambda turns: "".join(f"{r}x{t}x" for r, t in turns))
    assert not plain[2] and [plain[0][s.text_start : s.text_end] for s in plain[1]] == ["x", "xx"]


@pytest.mark.parametrize("template", [
    chat.marked, lambda turns: "".join(f"{k}:{r}={t};" for k, (r, t) in enumerate(turns)), lambda turns: f"{len(turns)} " + chat.marked(turns),
    lambda turns: "<s>" + "".join(f"[{r if not k or turns[k - 1][0] != r else '..'}]{t}\n" for k, (r, t) in enumerate(turns)),
])
def test_rendering_equals_the_walk(template):
    turns = [("user" if k % 3 else "assistant", f"turn {k}" * (k % 4)) for k in range(40)]
    calls = []
    counted = lambda t: calls.append(len(t)) or template(t)
    assert chat.render(turns, template) == chat.render(turns, counted) == chat.walk(turns, template)
    assert set(range(41)) <= set(calls)  # every prefix is rendered unless the template declares more
    declared = chat.append_only(lambda t: calls.append(len(t)) or template(t))
    calls.clear()
    assert chat.render(turns, declared) == chat.walk(turns, template)  # declared rightly or not
    if template is chat.marked:
        assert sum(calls) < 4 * len(turns)


def test_the_default_template_is_rendered_at_every_prefix():
    default = inspect.signature(chat.format_conversations).parameters["template"].default
    calls = []
    spy = functools.wraps(default)(lambda turns: calls.append(len(turns)) or default(turns))  # declares what the default does
    turns = [("user" if k % 2 else "assistant", f"turn {k} <|") for k in range(300)]
    assert chat.render(turns, spy) == chat.walk(turns, default)
    assert set(calls) == set(range(301))


def test_a_rewrite_at_any_turn_is_seen():
    for n, at in ((600, 300), (600, 599), (3, 2), (600, 256), (600, 257)):
        bang = lambda turns, at=at: chat.marked(turns) + "!" * (len(turns) == at)
        turns = [("user" if k % 2 else "assistant", str(k)) for k in range(n)]
        got = chat.render(turns, bang)
        assert got[2] and got == chat.walk(turns, bang)


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<<||>", "<\\\\|x", "<", "|", "a<|im_end|>\n"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# 9 near duplicates


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i), i == find(i)) for i, s in sets)


def test_near_duplicates(spark, rows, none):
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(0, 50)}" for _ in range(60)]
    chain = []  # each near the one before, the ends far apart
    for k in range(25):
        base = list(base)
        base[(3 * k) % 60] = f"c{k}"
        chain.append((200 + k, " ".join(base), "a"))
    single = [r for r in rows if r[0] != 80] + chain
    got = near_duplicates.near_duplicates(frame(spark, single))
    assert collected(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(single)
    assert near_duplicates.near_duplicates(none).count() == 0
    odd = near_duplicates.near_duplicates(frame(spark, [(None, "a b c d e f", "a"), (1, "a b c d e f", "a"), (2, None, "a")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in odd} == {(None, None, False), (1, 1, True), (2, 2, True)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(9)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(40):
            a = common.mix64(rng.integers(0, 1 << 62, 300).astype(np.uint64))
            b = a.copy()
            k = int(300 * (1 - share) / (1 + share))
            b[:k] = common.mix64(rng.integers(0, 1 << 62, k).astype(np.uint64))
            x, y = near_duplicates.sketch([a, b])
            errors.append((x == y).mean() - (300 - k) / (300 + k))
        assert abs(np.mean(errors)) < 0.03
    small = near_duplicates.sketch([np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert (small[0] < np.iinfo(np.int64).max).all() and (small[1] == np.iinfo(np.int64).max).all()


# 10 mixing


def test_mixing(spark, docs, rows, none):
    plan = mixing.plan_mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    taken = Counter()
    for r in mixing.plan_mix(docs, packet=1).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    taken.clear()
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(plan) == len(rows) and all(abs(taken[s] - target[s]) <= mixing.PACKET for s in order)
    assert sum(taken.values()) == sum(sizes.values())
    same = lambda p: Counter((r.doc_id, r["size"], r.taken) for r in p)
    assert same(plan) == same(mixing.plan_mix(docs.repartition(7)).collect())
    mixed = mixing.schedule(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.plan_mix(none).count() == 0 and mixing.schedule(none).count() == 0


def served_in_turn(rows, share, packet):
    """taken by (doc_id, size): one queue for each source, the packet with the earliest virtual finish first."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    queues = defaultdict(list)
    for k in sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), rows[k][0] is not None, rows[k][0] or 0, size[k])):
        queues[rows[k][2]] += [(k, min(packet, size[k] - x)) for x in range(0, size[k], packet)]
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    waiting, done = {s: queues[s] * 3 for s in order}, Counter()
    taken, budget = [0] * len(rows), math.floor(sum(size) * share)
    while budget and any(waiting.values()):
        s = min((s for s in order if waiting[s]), key=lambda s: ((done[s] + waiting[s][0][1]) * 6 // (order.index(s) % 3 + 1), order.index(s)))
        k, n = waiting[s].pop(0)
        taken[k] += min(n, budget)
        done[s] += n
        budget -= min(n, budget)
    return Counter((r[0], r[2], n, x) for r, n, x in zip(rows, size, taken, strict=True))


@pytest.mark.parametrize(("share", "packet", "few", "ranges"), [(1.0, 256, 10_000, 10_000), (0.4, 7, 1, 3), (2.9, 50, 5, 10), (5.0, 256, 10, 10), (0.0, 256, 10, 10), (1.0, 10**6, 1, 2)])
def test_mix_is_served_in_order_of_virtual_finish(spark, rows, monkeypatch, share, packet, few, ranges):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "RANGES", ranges)
    more = rows + [(None, "null id", "a"), (None, "null id", "a"), (None, "other text of a null id", None), (6, "one id twice", "b")]
    got = collected(mixing.plan_mix(frame(spark, more), share, packet=packet), "doc_id", "source", "size", "taken")
    assert got == served_in_turn(more, share, packet)


def test_schedule_tells_rows_of_one_doc_id_apart(spark):
    text = lambda n: "w " * n
    rows = [(None, text(520), "a"), (None, text(60), "b"), (None, text(20), "c"), (7, text(40), "a"), (7, text(41), "a"), (8, text(30), "b"), (8, text(30), "b"), (8, text(30), "b")]
    docs = frame(spark, rows).selectExpr("*", "1 as _copy", "2 as _copies", "3 as _mix_id", "'x' as MIX_ID", "named_struct('a', 1) as mix_copies")
    plan = mixing.plan_mix(docs).collect()
    expected = defaultdict(int)
    for r in plan:
        expected[r.doc_id, r.source, r["size"]] += r.taken
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.schedule(docs).collect())
    assert {k: n for k, n in got.items()} == {k: c for k, x in expected.items() if (c := math.floor(x / k[2] + 0.5))}
    out = mixing.schedule(docs)
    assert out.columns == docs.columns and set(out.select("_copy", "_copies", "_mix_id", "MIX_ID", "mix_copies.a").distinct().collect()) == {(1, 2, 3, "x", 1)}


def test_capped_sources_share_their_excess(spark):
    docs = frame(spark, [(k, "w " * 100, "a") for k in range(10)] + [(20, "w " * 10, "b"), (21, "w " * 10, "c")])
    got = {r.source: r.target for r in mixing.plan_mix(docs).collect()}
    assert got == {"a": pytest.approx(960), "b": 30, "c": 30}


def test_mixing_runs_no_python(docs):
    plan = mixing.plan_mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
