"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, once, the postings of every word of every document.  A
run of whole documents of about 4 MB is a shard of the index: each distinct
word's ascending positions, numbered through the run, with the positions at
which its documents begin.  A shard answers for its documents alone, so no
posting is ever shuffled.  ``search`` looks phrases up in a shard: from its
rarest term there on, a phrase's offset-adjusted posting lists are intersected,
for all phrases side by side; with ``slop`` a term may stand that many words
from its place (a proximity match), with 0 the match is the exact phrase.

The benchmark is the query set: it is taken in blocks of about ``block_words``
words, each collected, made a table of numpy arrays (44 bytes a word) and sent
to the executors, so what is broadcast is bounded however large it grows.  All
blocks ask the same index.  Their hits meet by shard, and every shard then gives
each of its documents once.

Defined cases: null or empty texts have no words; items without words never
occur; a null item_id is written as the empty string; rows with one item_id
count as one item; repeated documents each have a row; empty tables give
zero hits or an empty result; other columns are not read.  doc_id may be of any
type; it is carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import ALNUM, arrow_schema, batch, expand, picked, scratch, spark_type, squeeze, stored

INDEX = "shard long, doc_ids array<{kind}>, doc_starts binary, terms binary, counts binary, gaps binary"
HIT = "shard long, doc int, items array<string>, spans array<struct<start:int,end:int>>"
FOUND = "doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
#: Candidate positions that are intersected at once.
AT_ONCE = 1 << 20


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, document index of each word)."""
    data = common.ascii_lower(data)
    starts, ends, doc = common.words(data, offsets, ALNUM)
    return common.span_hash(data, starts, ends), doc


class Queries:
    """Phrases over a vocabulary: a window of ``window`` words each, or a shorter item whole.

    terms: the distinct words' hashes, ascending; phrases[k]: the code of each
    phrase's word k, -1 past its end; phrase p belongs to the items
    of[first[p] : first[p + 1]], numbers in the sorted list ids.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.ids)}
        hashes, doc = tokenise(*common.text_buffers(pa.array(texts, pa.string())))
        self.terms = np.unique(hashes)
        code = np.searchsorted(self.terms, hashes).astype(np.int32)
        length = np.bincount(doc, minlength=len(ids))
        begin = np.cumsum(length) - length
        windows = np.where(length > window, length - window + 1, np.minimum(length, 1))
        owner = np.repeat(np.arange(len(ids)), windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
        size = np.minimum(length[owner], window)
        table = np.full((len(owner), window), -1, np.int32)
        for k in range(window):
            on = size > k
            table[on, k] = code[at[on] + k]
        _, kept, same = np.unique(table.view(np.dtype((np.void, table.itemsize * window))).ravel(), return_index=True, return_inverse=True)
        self.phrases = np.ascontiguousarray(table[kept].T)
        items = np.array([number[x] for x in ids], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        pairs = np.unique(same * max(1, len(self.ids)) + items)
        phrase, self.of = np.divmod(pairs, max(1, len(self.ids)))
        self.first = np.searchsorted(phrase, np.arange(len(kept) + 1))


def query_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Queries]:
    """The items (item_id, text) in blocks of about block_words words, one at a time on the driver."""
    rows = picked(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (block_words * 6)))
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Queries([r.item_id for r in got], [r.text for r in got], window)


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """INDEX: the postings of every word of docs (doc_id, text), stored at path."""
    schema = INDEX.format(kind=docs.select("doc_id").schema[0].dataType.simpleString())
    out = arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j, data, off in common.chunks(b.column("text")):
                hashes, doc = tokenise(data, off)
                starts = np.searchsorted(doc, np.arange(j - i + 1))
                order = np.argsort(hashes, kind="stable")
                hashes = hashes[order]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else order
                gaps = np.diff(order, prepend=0)
                gaps[first] = order[first]
                ids = b.column("doc_id").slice(i, j - i).cast(out.field("doc_ids").type.value_type)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids)
                counts = np.diff(first, append=len(hashes))
                yield batch(out, [shard], ids.cast(out.field("doc_ids").type), [squeeze(starts)], [squeeze(np.diff(hashes[first], prepend=np.uint64(0)))], [squeeze(counts)], [squeeze(gaps)])
                shard += 1

    docs.select("doc_id", "text").mapInArrow(index, spark_type(schema)).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(spark_type(schema)).parquet(path)


class Shard:
    """One shard's posting lists."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray):
        self.starts, self.terms, self.counts = starts.astype(np.int64), np.cumsum(terms, dtype=np.uint64), counts.astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        run = np.cumsum(gaps.astype(np.int64))
        self.places = run - np.repeat(run[self.first] - gaps[self.first].astype(np.int64), self.counts) if len(run) else run

    def candidates(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(phrases all of whose terms are here, [k, phrase]: the number here of its word k, -1 past its end)."""
        if not len(self.terms) or not len(queries.terms):
            return np.zeros(0, np.int64), np.zeros((len(queries.phrases), 0), np.int64)
        here = np.minimum(np.searchsorted(self.terms, queries.terms), len(self.terms) - 1)
        here = np.append(np.where(self.terms[here] == queries.terms, here, -2), -1)  # the code -1 takes the last
        on = np.arange(queries.phrases.shape[1])
        for codes in queries.phrases:
            on = on[here[codes[on]] != -2]
        return on, here[queries.phrases[:, on]]

    def look(self, queries: Queries, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, document, first word, word past the last) of each match, as numbered in the shard."""
        phrases, numbers = self.candidates(queries)
        window = len(numbers)
        length = (numbers >= 0).sum(0)
        frequency = np.where(numbers >= 0, self.counts[np.maximum(numbers, 0)] if len(self.counts) else 0, np.iinfo(np.int64).max)
        order = np.argsort(frequency, axis=0, kind="stable")
        span = int(self.starts[-1]) + window + slop + 1
        keys = np.repeat(np.arange(len(self.counts)), self.counts) * span + self.places
        rarest = order[0] if len(phrases) else np.zeros(0, np.int64)
        total = np.cumsum(frequency[rarest, np.arange(len(phrases))])
        found: list[tuple] = [(np.zeros(0, np.int64),) * 4]
        begin = 0
        while begin < len(phrases):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, side="right")))
            part = np.arange(begin, end)
            term, place = numbers[rarest[part], part], rarest[part]
            n = self.counts[term]
            which = np.repeat(part, n)
            at = self.places[np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(len(which))]
            doc = np.searchsorted(self.starts, at, side="right") - 1
            at = at - np.repeat(place, n)
            low, high = self.starts[doc], self.starts[doc + 1]
            if not slop:
                ok = (at >= low) & (at + length[which] <= high)
                which, at, doc, low, high = which[ok], at[ok], doc[ok], low[ok], high[ok]
            for k in range(1, window):  # from rare to frequent
                place = order[k, which]
                term = numbers[place, which]
                least, most = np.maximum(at + place - slop, low), np.minimum(at + place + slop, high - 1)
                near = np.minimum(np.searchsorted(keys, term * span + least), len(keys) - 1)
                ok = (term < 0) | ((keys[near] >= term * span + least) & (keys[near] <= term * span + most))
                which, at, doc, low, high = which[ok], at[ok], doc[ok], low[ok], high[ok]
            found.append((phrases[which], doc, np.maximum(at, low), np.minimum(at + length[which], high)))
            begin = end
        phrase, doc, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        return phrase, doc, low, high


def search(index: DataFrame, queries: Queries, slop: int = 0) -> DataFrame:
    """HIT for every indexed document with a match: the items that occur and the hit spans of words."""
    out, sent = arrow_schema(HIT), index.sparkSession.sparkContext.broadcast(queries)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for b in batches:
            for number, *lists in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_starts", "terms", "counts", "gaps")), strict=True):
                shard = Shard(*map(expand, lists))
                phrase, doc, low, high = shard.look(queries, slop)
                if not len(doc):
                    continue
                n = queries.first[phrase + 1] - queries.first[phrase]
                item = queries.of[np.repeat(queries.first[phrase] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                whose, item = np.divmod(np.unique(np.repeat(doc, n) * len(queries.ids) + item), len(queries.ids))
                order = np.lexsort((high, low))  # spans of a document are next to each other
                doc, low, high = doc[order], low[order], high[order]
                reach = np.maximum.accumulate(high)
                new = np.append(True, (doc[1:] != doc[:-1]) | (low[1:] > reach[:-1]))
                low, high, doc = low[new], reach[np.append(np.flatnonzero(new)[1:], len(new)) - 1], doc[new]
                docs = np.unique(doc)
                items = [[queries.ids[k] for k in part.tolist()] for part in np.split(item, np.searchsorted(whose, docs[1:]))]
                base = shard.starts[doc]
                spans = [{"start": x, "end": y} for x, y in zip((low - base).tolist(), (high - base).tolist(), strict=True)]
                cut = [*np.searchsorted(doc, docs).tolist(), len(doc)]
                yield batch(out, [number] * len(docs), docs, items, [spans[i:j] for i, j in zip(cut, cut[1:], strict=False)])

    return index.select("shard", "doc_starts", "terms", "counts", "gaps").mapInArrow(look, spark_type(HIT))


def united(spans: list[dict]) -> list[dict]:
    """Spans of several blocks without overlaps."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def every_document(index: DataFrame, hits: DataFrame) -> DataFrame:
    """FOUND for every indexed document, with the hits of all blocks."""
    schema = FOUND.format(kind=index.schema["doc_ids"].dataType.elementType.simpleString())
    out = arrow_schema(schema)
    hits = hits.groupBy("shard").agg(F.collect_list(F.struct("doc", "items", "spans")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                starts = expand(b.column("doc_starts")[k].as_py()).astype(np.int64)
                items, spans = [[] for _ in starts[1:]], [[] for _ in starts[1:]]
                for h in b.column("hits")[k].as_py() or ():
                    items[h["doc"]] = sorted({*items[h["doc"]], *h["items"]})
                    spans[h["doc"]] = united(spans[h["doc"]] + h["spans"])
                n_hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
                ids = b.column("doc_ids")[k].values.cast(out.field("doc_id").type)
                yield batch(out, ids, np.diff(starts), n_hit, items, spans)

    return index.select("shard", "doc_ids", "doc_starts").join(hits, "shard", "left").select("doc_ids", "doc_starts", "hits").mapInArrow(run, spark_type(schema))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, block_words: int = 500_000) -> DataFrame:
    """FOUND for every document of docs (doc_id, text) against items (item_id, text).

    Every row has its own result, however many blocks of queries there are.
    """
    index, hits = build_index(picked(docs, "doc_id", "text"), scratch(docs.sparkSession, "postings")), None
    for queries in query_blocks(items, window, block_words):
        part = stored(search(index, queries, slop), "hits")
        hits = part if hits is None else hits.unionByName(part)
    return every_document(index, hits)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
