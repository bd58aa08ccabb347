"""Token-ID output in fixed-width bit-packed blocks.

A shard row holds consecutive documents in ascending doc_id order:

* ``ids``: the token ids, ``bits`` each (the fewest that hold the largest id of
  the vocabulary), least significant bit first, in blocks of ``BLOCK`` ids that
  each start at a whole byte;
* ``block_offsets``: the first byte of every block as unsigned 64-bit integers;
* ``doc_ends``: the running count of ids at the end of each document, likewise.

The largest id is read from the tokenizer's file; an id that does not fit the
width is an error.  A block is unpacked by numpy without touching others (``unpack``), so the ids
``a`` to ``b`` of a shard need only the blocks that hold them (``read_ids``).
Shards are rows of a Parquet folder, so that Spark's committer makes the output
whole even when executors are lost, on any store that Spark writes.

Defined cases: null text is the empty text, which gives the end id alone; a
null doc_id comes first; repeated doc_ids stay as they are, next to each other
in the order of their texts (rows of one doc_id are dealt to several tasks by
the first characters of their texts); an empty table gives an empty folder and
result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.llm.common import arrow_schema, batch, picked, spark_type

BLOCK = 4096
#: Ids after which a shard is closed at the end of a slice.
SHARD_IDS = 1 << 18
#: Bytes of text that a worker encodes at once; a longer text is encoded alone, whole.
SLICE = 8 << 20
#: Rows up to which the shards' starts, 24 bytes each, are broadcast rather than joined by a shuffle.
MOST_STARTS = 500_000
#: Characters of texts by which rows of one doc_id are dealt to tasks.
HEAD = 32
SHARD = "part int, first_seq int, bits int, n_docs int, n_ids long, doc_ids array<bigint>, doc_ends binary, block_offsets binary, ids binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> tuple[bytes, np.ndarray]:
    """(packed bytes, byte offset of each block); raises if an id needs more bits."""
    if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
        raise OverflowError(f"ids from {ids.min()} to {ids.max()} do not fit in {bits} bits")
    size = (BLOCK * bits + 7) // 8
    n = len(ids)
    if bits == 16:
        raw = ids.astype("<u2").tobytes()
    else:
        pieces = []
        for i in range(0, n, BLOCK):
            b = ids[i : i + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4)
            pieces.append(np.packbits(np.unpackbits(b, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
        raw = b"".join(pieces)
    return raw, np.arange(0, -(-n // BLOCK), dtype="<u8") * np.uint64(size)


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The n ids that start at the first bit of raw, as unsigned 32-bit integers."""
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def read_ids(shard: dict, a: int, b: int) -> np.ndarray:
    """The ids a to b (exclusive) of a shard, from the blocks that hold them only."""
    a, b, n, bits = max(0, a), min(b, shard["n_ids"]), shard["n_ids"], shard["bits"]
    if a >= b:
        return np.zeros(0, "<u4")
    at = np.frombuffer(shard["block_offsets"], "<u8")
    view, out = memoryview(shard["ids"]), []
    for k in range(a // BLOCK, -(-b // BLOCK)):
        end = int(at[k + 1]) if k + 1 < len(at) else len(view)
        out.append(unpack(bytes(view[int(at[k]) : end]), bits, min(BLOCK, n - k * BLOCK)))
    first = a // BLOCK * BLOCK
    return np.concatenate(out)[a - first : b - first]


class WordEncoder:
    """Ids of whole texts by encoding each distinct word once.

    For vocabularies such as the word_bpe file's, which lower-cases a text and
    cuts it at blanks and between letters and other signs before it is encoded:
    lower-casing ASCII letters and cutting at blanks and between an ASCII letter
    and a sign that follows it changes no id.  Words with ``<|`` may hold special
    strings, which are found before all that, and stay as they are.
    """

    def __init__(self, path: str, most: int = 300_000, lead: str = ""):
        """lead: what every word is encoded behind, a blank where that is part of the word's first token."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.most, self.lead = most, lead
        vocabulary = self.tok.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or begin one behind a blank
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if lead else t.endswith("</w>"))]] = True
        self.known: dict[str, int] = {}
        self.pool, self.length, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum())), length

    def learn(self, words: list[str]) -> None:
        """Encode new words; those of letters alone are one word to the library too, so it gets many at once."""
        plain = [w for w in words if w.isalpha()] if self.edge.any() else []
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids, _ = self.encode([self.lead + " ".join(part[k : k + 64]) for k in range(0, len(part), 64)])
            edge = np.flatnonzero(self.edge[ids])
            length = np.diff(edge, append=len(ids)) if self.lead else np.diff(edge, prepend=-1)
            self.add(part, *((ids, length) if len(length) == len(part) and length.sum() == len(ids) else self.encode([self.lead + w for w in part])))
        other = [w for w in words if not w.isalpha()] if plain else words
        for i in range(0, len(other), 4096):
            self.add(other[i : i + 4096], *self.encode([self.lead + w for w in other[i : i + 4096]]))

    def add(self, words: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.pool, self.length = np.concatenate([self.pool, ids]), np.concatenate([self.length, length])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def forget(self) -> None:
        """Keep the words that several slices had, or none if those are too many."""
        keep = self.used >= 2
        if keep.sum() > self.most // 2:
            keep = self.used >= np.sort(self.used)[-self.most // 4]
        if keep.sum() > self.most // 2:
            keep[:] = False
        new = np.cumsum(keep) - 1
        self.known = {w: int(new[k]) for w, k in self.known.items() if keep[k]}
        self.pool = self.pool[np.repeat(keep, self.length)]
        self.length, self.used = self.length[keep], self.used[keep] // 2

    @staticmethod
    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts, words before each text and at the end)."""
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " ")
        odd = pc.match_substring(texts, "<|")
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,!?;:$%&*#])", r"\1 \2")
        if pc.any(odd).as_py():
            plain = pc.if_else(odd, texts, plain)
        words = pc.split_pattern(plain, " ")
        return words.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the known ones, after learning the new."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.used[at] += 1
        return at[coded.indices.to_numpy()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and at the end)."""
        words, ends = self.split(texts)
        at = self.places(words)
        start = np.concatenate([[0], np.cumsum(self.length)])[at]
        length = self.length[at]
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(start - before[:-1], length) + np.arange(before[-1])]
        return ids, before[ends]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, doc_ids) of about SLICE bytes: small batches together, large ones in parts."""
    texts, doc_ids, held = [], [], 0
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = held + np.cumsum(size)
        cut = np.searchsorted(total, np.arange(1, total[-1] // SLICE + 1) * SLICE) + 1 if len(total) else []
        edges = [0, *np.unique(np.minimum(cut, b.num_rows)).astype(int).tolist()]
        for i, j in zip(edges, [*edges[1:], b.num_rows], strict=True):
            texts.append(b.column("text").slice(i, j - i))
            doc_ids.append(b.column("doc_id").slice(i, j - i))
            if j in edges[1:] and j > i:
                yield pa.concat_arrays(texts), pa.concat_arrays(doc_ids)
                texts, doc_ids, held = [], [], 0
        held += int(size[edges[-1] :].sum())
    if sum(map(len, texts)):
        yield pa.concat_arrays(texts), pa.concat_arrays(doc_ids)


class TextEncoder:
    """Ids of whole texts as the file's library gives them, for any vocabulary."""

    #: Characters of text given to the library at once.
    PIECE = 100_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            tok = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: tok.encode(texts, num_threads=1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and at the end)."""
        rows = [t or "" for t in texts.to_pylist()]
        ids, length, i = [], [], 0
        total = np.cumsum([len(t) for t in rows])
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + self.PIECE, side="right")))
            for got in self.encode(rows[i:j]):
                ids.append(np.array(got, np.int32))
                length.append(len(got))
            i = j
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def specification(path: str) -> dict:
    if not path.endswith(".json"):
        return {}
    with open(path) as f:
        return json.load(f)


def cuts_at_words(path: str) -> bool:
    """Whether the file lower-cases texts, drops white space and cuts between letters and signs, as WordEncoder takes for granted."""
    spec = specification(path)
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (parts[0].get("pattern") or {}).get("Regex", "")
    cut = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return steps == ["NFC", "Replace", "Lowercase"] and bool(cut) and spec["model"].get("end_of_word_suffix") == "</w>"


def vocabulary_size(path: str) -> int:
    """One more than the largest id of the file's vocabulary."""
    if path.endswith(".json"):
        spec = specification(path)
        return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))])
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


@lru_cache(maxsize=4)
def word_encoder(path: str, lead: str = "") -> WordEncoder:
    """The worker's encoder, which keeps its words from task to task."""
    return WordEncoder(path, lead=lead)


@lru_cache(maxsize=4)
def encoder_for(path: str) -> WordEncoder | TextEncoder:
    return word_encoder(path) if cuts_at_words(path) else TextEncoder(path)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int | None = None, files: int | None = None) -> None:
    """Encode the whole texts of docs (doc_id, text) and write shards in ascending doc_id order.

    vocabulary: how many ids to make room for, by default what the tokenizer's file has, and end_id.
    """
    bits, out = bits_for(vocabulary or max(vocabulary_size(tokenizer_path), end_id + 1)), arrow_schema(SHARD)
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = encoder_for(tokenizer_path)
        held, names, ends, n = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            raw, at = pack(ids, bits)
            ids_of = pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names).cast(pa.int64()))
            last = np.concatenate(ends).astype("<u8")
            return batch(out, [part], [seq], [bits], [len(last)], [len(ids)], ids_of, [last.tobytes()], [at.tobytes()], [raw])

        for texts, doc_ids in slices(batches):
            ids, at = encoder(texts)
            ids = np.insert(ids, at[1:], end_id)
            at = at[1:] + np.arange(1, len(texts) + 1)
            pa.default_memory_pool().release_unused()
            held.append(ids)
            names.append(doc_ids)
            ends.append(at + n)
            n += len(ids)
            if n >= SHARD_IDS:
                yield shard()
                seq, n = seq + 1, 0
                held, names, ends = [], [], []
        if held:
            yield shard()

    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = picked(docs, "doc_id", "text").repartitionByRange(files, F.asc_nulls_first("doc_id"), F.substring("text", 1, HEAD))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(encode, spark_type(SHARD)).write.option("compression", "zstd").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all shards before each."""
    shards = spark.read.schema(spark_type(SHARD)).parquet(path)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("part", "first_seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "first_seq", before(Window.partitionBy("part").orderBy("first_seq")).alias("start")).join(parts, "part")
    starts = starts.select("part", "first_seq", (F.col("start") + F.col("part_start")).alias("start"))
    return shards.join(F.broadcast(starts) if starts.count() <= MOST_STARTS else starts, ["part", "first_seq"])


DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def document_index(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers, read back from the shards."""
    out = arrow_schema(DOCUMENT)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = {k: b.column(k)[i] for k in ("start", "bits", "n_ids", "doc_ids", "doc_ends", "block_offsets", "ids")}
                s = {k: v.as_buffer() if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v for k, v in s.items()}
                shard = {"n_ids": s["n_ids"].as_py(), "bits": s["bits"].as_py(), "block_offsets": s["block_offsets"], "ids": s["ids"]}
                ids = read_ids(shard, 0, shard["n_ids"])
                ends = np.frombuffer(s["doc_ends"], "<u8").astype(np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield batch(out, s["doc_ids"].values, begin + s["start"].as_py(), ends - begin, crc)

    return shards.select("start", "bits", "n_ids", "doc_ids", "doc_ends", "block_offsets", "ids").mapInArrow(read, DOCUMENT)
