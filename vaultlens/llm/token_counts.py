"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a
folder of the caller's choice, partitioned by tokenizer_digest.  A document is looked up by the SHA-256 of its
normalised content and of the tokenizer's version (library release and
vocabulary file); only distinct contents without an entry are encoded, once
each, and their counts are appended.  A later call with the same folder encodes
nothing that it has seen.  Two calls at once may both append an entry, which
say the same: entries of one content are read as one.

Defined cases: null text counts as the empty text; repeated rows and ties share
one entry and each keep their row; an empty table gives an empty result and
leaves the cache as it is; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import arrow_schema, batch, picked, stored
from vaultlens.llm.token_files import word_encoder

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


#: Characters of text that are encoded at once; the library needs some hundred bytes of memory for each.
PIECE = 100_000


def load_tokenizer(path: str) -> Callable[[list[str]], list]:
    """texts -> token id lists, as the file's library gives them by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    tok = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: tok.encode(texts, num_threads=1)


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    release = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(release.encode() + b"\0" + f.read()).hexdigest()


def cuts_at_blanks(path: str) -> bool:
    """Whether the file's tokens begin at every single blank between other characters, so that texts may be cut there."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")


def pieces(text: str, limit: int = PIECE) -> list[str]:
    """The text, cut before a single blank after each limit characters."""
    out, start = [], 0
    cut = re.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > limit and (m := cut.search(text, start + limit)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def batches_of(texts: list[str], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about limit characters."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


#: White space other than blanks and line ends, as the library's patterns see it and a little more, and control signs.
OTHER_BLANK = r"\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}"
#: Texts with more than single blanks and line ends between words, or with the mark below, are encoded as they are.
ODD = rf"[ \n][ \n]|^[ \n]|[ \n]$|^$|[{OTHER_BLANK}]"
#: Put before a word that no blank leads.
BARE = "\x02"


class BlankCounter:
    """Token counts of texts whose tokens begin at single blanks: each distinct word is encoded once.

    A word's first token takes in the blank before it.  No token spans a line
    end that stands alone, or goes from an ASCII letter to a sign, so texts are
    cut there too; what follows has no blank before it.
    """

    def __init__(self, path: str):
        self.led, self.bare, self.encode = word_encoder(path, " "), word_encoder(path), load_tokenizer(path)
        self.line = len(self.encode(["\n"])[0])

    def whole(self, texts: list[str]) -> np.ndarray:
        n = np.zeros(len(texts), np.int64)
        parts = [(k, p) for k, t in enumerate(texts) for p in pieces(t)]
        for i, j in batches_of([p for _, p in parts]):
            for (k, _), ids in zip(parts[i:j], self.encode([p for _, p in parts[i:j]]), strict=True):
                n[k] += len(ids)
        return n

    def cut(self, texts: pa.Array) -> np.ndarray:
        mark, none = pa.scalar(BARE, pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", f" {BARE}"), none)
        marked = pc.replace_substring_regex(marked, r"([A-Za-z])([.,!?;:$%&*#])", rf"\1 {BARE}\2")
        split = pc.split_pattern(marked, " ")
        words, row = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        bare = pc.starts_with(words, BARE)
        out = self.line * pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        for encoder, chosen in ((self.led, pc.invert(bare)), (self.bare, bare)):
            place = encoder.places(pc.replace_substring(words.filter(chosen), BARE, ""))
            out += np.bincount(row[chosen.to_numpy(zero_copy_only=False)], encoder.length[place], len(texts)).astype(np.int64)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros(len(texts), np.int64)
        out[odd] = self.whole(texts.filter(pa.array(odd)).to_pylist())
        out[~odd] = self.cut(texts.filter(pa.array(~odd)))
        return out


def normalised(text: Column) -> Column:
    """Content that the counts depend on: the text itself, null as empty, since case and blanks change tokens."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def cached(spark, cache: str, version: str) -> DataFrame:
    """content_digest, n_tokens: one entry for each content that the version of a tokenizer has counted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(cache)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE).drop("tokenizer_digest")
    entries = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer_digest") == version)
    return entries.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    out = arrow_schema(CACHE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cuts_at_blanks(tokenizer_path):
            counter = BlankCounter(tokenizer_path)
            for b in batches:
                yield batch(out, b.column("content_digest"), [version] * b.num_rows, counter(b.column("content")))
            return
        encode = load_tokenizer(tokenizer_path)
        for b in batches:
            texts = b.column("content").to_pylist()
            n = [len(ids) for i, j in batches_of(texts) for ids in encode(texts[i:j])]
            yield batch(out, b.column("content_digest"), [version] * len(n), n)

    return texts.select("content_digest", "content").mapInArrow(count, CACHE)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """The rows of docs (doc_id, text) as doc_id, n_bytes, n_tokens; fills the cache first."""
    spark, docs = docs.sparkSession, picked(docs, "doc_id", "text")
    version = tokenizer_digest(tokenizer_path)
    known = cached(spark, cache, version)
    content = normalised(F.col("text"))
    texts = docs.select(digest(content).alias("content_digest"), content.alias("content"))
    if not known.isEmpty():
        texts = texts.join(known, "content_digest", "left_anti")
    misses = encode_misses(texts.dropDuplicates(["content_digest"]), tokenizer_path, version)
    misses.write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    # stored, so that the join shuffles both sides, which Spark splits where many documents have one content
    known = stored(cached(spark, cache, version), "token-counts")
    keyed = docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), digest(content).alias("content_digest"))
    return keyed.join(known, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")
