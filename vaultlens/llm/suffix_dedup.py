"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of text shards.

A byte goes if a string of LENGTH bytes over it also starts anywhere else.

Candidates.  Every window of LENGTH bytes has an anchor, its least hashed
substring of ANCHOR bytes, the leftmost if several are equal.  Equal windows
have equal anchors at equal places, so only windows with the same anchor need
be compared.  The windows of one anchor's occurrence lie next to each other and
make a fragment.  An anchor that occurs once has no repeat; a fragment that
occurs twice has nothing but repeats.  What is left are the distinct fragments
of anchors with several, at the edges of repeats.

Merging.  These fragments are read as strings over blocks of UNIT bytes, one
string for each place at which blocks may begin, so that a window is the first
DEPTH blocks of a suffix.  A task cuts its fragments into shards, sorts each
shard's suffixes for its Burrows-Wheeler transform, and merges the transforms:
starting from the shards one after another, the interleaving is refined DEPTH
times by dealing its rows, in order, to the buckets of their preceding blocks.
After k rounds rows are in order of their first k blocks, and rows between
which no bucket or older boundary lies share them: their common prefix is k
blocks at least.  Rows of an interval that shares DEPTH blocks are repeats.

An anchor whose distinct fragments outgrow a task is merged by several: its
windows, as strings of DEPTH blocks, are dealt out by these blocks, so that
each task gets shards of a range of the suffixes and merges them alike.

Texts are known by their MD5 digest, so equal rows are one text with several
occurrences, whose spans are worked out once.  Anchors and fragments that hold
more than 1 / MOST_HOT of all occurrences, of which there can be no more than
MOST_HOT, are joined by a broadcast, so that no task gets all of a frequent one.

Defined cases: null text is the empty text; texts shorter than LENGTH keep all
bytes; repeated rows are repeats of each other and each have a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import arrow_schema, batch, discard, picked, stored

LENGTH = 200
ANCHOR = 64
UNIT = 50
DEPTH = LENGTH // UNIT
#: Bytes of fragments that a task merges at once and that a shard has; an anchor's fragments stay together.
GROUP_BYTES = 1_000_000
SHARD_BYTES = 250_000
#: Bytes of an anchor's distinct fragments up to which one task merges them.
ANCHOR_BYTES = 4_000_000
#: Windows of larger anchors that a task merges at once and that a shard has.
GROUP_WINDOWS = 100_000
SHARD_WINDOWS = 25_000
#: Keys that may be broadcast because each holds more than this share of all occurrences.
MOST_HOT = 20_000


def fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the fragment, document index, first window, number of windows) of every fragment."""
    n = len(data)
    size = np.diff(offsets)
    if not (size >= LENGTH).any():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    prefix = common.prefix_hash(data)
    up = common.powers(n + 1)[0]
    value = (prefix[ANCHOR:] - prefix[:-ANCHOR]) * up[: n + 1 - ANCHOR]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value &= np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(len(value), dtype=np.uint64)
    width, span = 1, LENGTH - ANCHOR + 1
    while 2 * width <= span:  # least value of the next `width` places
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if width < span:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    place = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(size >= LENGTH)
    edge = np.zeros(len(place) + 1, np.int8)
    edge[offsets[long]] += 1
    stop = offsets[long + 1] - LENGTH + 1
    edge[stop] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = place[1:] != place[:-1]
    new[offsets[long]] = True
    start = np.flatnonzero(new & inside)
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(place)), offsets[doc + 1] - LENGTH + 1)
    anchor = place[start]
    return common.span_hash(data, anchor, anchor + ANCHOR), common.span_hash(data, start, end + LENGTH - 1), doc, start - offsets[doc], end - start


def block_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the UNIT bytes from each place on, as long as there are so many."""
    n = len(data) - UNIT + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    lane = np.zeros(len(data), np.uint64)
    for k in range(8):
        lane[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    lane = common.mix64(lane)
    out = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, UNIT - 8, 8), UNIT - 8]):
        out += lane[at : at + n] * common.powers(k + 2)[0][k + 1]
    return common.mix64(out)


class Shard:
    """The suffixes of some fragments' block strings in order, with their Burrows-Wheeler transform."""

    def __init__(self, code: np.ndarray, first: np.ndarray, length: np.ndarray, unit: int = UNIT):
        """code: the block that begins at each place and the one row past the end, 0 where none does; unit: places of a block."""
        n = len(code)
        end = np.repeat(first + length, length + 1)
        rank, reach = code.astype(np.int64), unit
        at = np.arange(n)
        while True:
            # a suffix beyond its fragment is empty; equal suffixes stay in order of their place
            later = np.where(at + reach <= end, rank[np.minimum(at + reach, n - 1)], 0)
            order = np.argsort(rank * (int(rank.max(initial=0)) + 1) + later, kind="stable")
            if 2 * reach >= length.max(initial=0):
                break
            changed = np.empty(n, bool)
            changed[0] = False
            changed[1:] = (rank[order[1:]] != rank[order[:-1]]) | (later[order[1:]] != later[order[:-1]])
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(changed)
            rank, reach = new, 2 * reach
        begin = np.repeat(first, length + 1)
        before = np.where(at - unit >= begin, code[np.maximum(at - unit, 0)], 0)
        self.suffixes, self.transform, self.empty = order, before[order], int(np.count_nonzero(code == 0))


def interleave(shards: list[Shard], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each row of the merged order, whether each row shares its first depth blocks with the one before)."""
    symbols = np.concatenate([s.transform for s in shards])
    sizes = [len(s.transform) for s in shards]
    kind = np.uint8 if len(shards) < 256 else np.uint16
    which = np.repeat(np.arange(len(shards)), sizes).astype(kind)
    empty = np.repeat(np.arange(len(shards)), [s.empty for s in shards]).astype(kind)
    block = np.zeros(len(which), np.int64)
    same = np.ones(len(which), bool)
    for _ in range(depth):
        merged = np.empty_like(symbols)
        merged[np.argsort(which, kind="stable")] = symbols
        deal = np.argsort(merged, kind="stable")
        which, merged, block = which[deal], merged[deal], block[deal]
        which[: len(empty)] = empty
        same[0] = False
        same[1:] = (merged[1:] == merged[:-1]) & (block[1:] == block[:-1])
        block = np.cumsum(~same)
    return which, same


def repeated_windows(data: np.ndarray, offsets: np.ndarray, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """For each byte, whether a window that another place has too begins at it within its fragment."""
    n = len(data)
    size = np.diff(offsets)
    at = np.arange(n + len(size)) - np.repeat(np.arange(len(size)), size + 1)  # a row more for each fragment
    ends = np.repeat(offsets[1:], size + 1)
    full = at + UNIT <= ends
    code = np.zeros(len(at), np.int64)
    if full.any():
        byte = np.arange(len(at)) - np.repeat(np.arange(len(size)), size + 1)
        _, code[full] = np.unique(block_hashes(data)[byte[full]], return_inverse=True)
        code[full] += 1
    rows = offsets + np.arange(len(offsets))
    cut = np.searchsorted(offsets, np.arange(0, n, shard_bytes), side="left")
    bounds = np.unique(np.append(cut, len(size)))
    shards = [Shard(code[rows[i] : rows[j]], rows[i:j] - rows[i], size[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
    which, same = interleave(shards)
    order = np.empty(len(at), np.int64)
    order[np.argsort(which, kind="stable")] = np.concatenate([s.suffixes + rows[i] for s, i in zip(shards, bounds, strict=False)])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(at), bool)
    out[order] = twice
    out &= at + LENGTH <= ends
    return out[at != ends]


def equal_windows(blocks: np.ndarray, shard_windows: int = SHARD_WINDOWS) -> np.ndarray:
    """For each row of DEPTH block hashes, whether another row has the same."""
    n = len(blocks)
    code = np.zeros((n, DEPTH + 1), np.int64)
    code[:, :DEPTH] = np.unique(blocks, return_inverse=True)[1].reshape(n, DEPTH) + 1
    cut = [*range(0, n, shard_windows), n]
    shards = [Shard(code[i:j].ravel(), np.arange(j - i) * (DEPTH + 1), np.full(j - i, DEPTH), 1) for i, j in zip(cut, cut[1:], strict=False)]
    which, same = interleave(shards)
    order = np.empty(n * (DEPTH + 1), np.int64)
    order[np.argsort(which, kind="stable")] = np.concatenate([s.suffixes + i * (DEPTH + 1) for s, i in zip(shards, cut, strict=False)])
    out = np.zeros(len(order), bool)
    out[order] = same | np.append(same[1:], False)
    return out[:: DEPTH + 1]


OCCURRENCE = "anchor long, print long, row binary, start long, windows int"
SPAN = "row binary, start long, end long"


def occurrences(keyed: DataFrame) -> DataFrame:
    """OCCURRENCE: every fragment of keyed (row, text)."""
    out = arrow_schema(OCCURRENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, off in common.chunks(b.column("text"), 1 << 19):
                anchor, mark, doc, start, windows = fragments(data, off)
                yield batch(out, anchor.astype(np.int64), mark.astype(np.int64), b.column("row").take(pa.array(doc + i)), start, windows.astype(np.int32))

    return keyed.select("row", "text").mapInArrow(run, OCCURRENCE)


def having(found: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows of found, total in all, whose key is among keys (on, n); n: how many rows of found have it."""
    hot = F.col("n") * MOST_HOT > total
    frequent = F.broadcast(keys.where(hot).select(*on))
    rest = found.join(frequent, on, "left_anti").join(keys.where(~hot).select(*on), on, "left_semi")
    return found.join(frequent, on, "left_semi").unionByName(rest)


WINDOW = "row binary, start long, n long, " + ", ".join(f"b{k} long" for k in range(DEPTH))


def merge_windows(contents: DataFrame) -> DataFrame:
    """SPAN: the repeats among contents (row, start, n, content) of large anchors, for those with n = 1."""
    schema, blocks = arrow_schema(WINDOW), [f"b{k}" for k in range(DEPTH)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in common.chunks(b.column("content"), 1 << 18):
                hashes, windows = block_hashes(data).astype(np.int64), np.diff(off) - LENGTH + 1
                which = np.repeat(np.arange(j - i), windows)
                place = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                at, of = off[which] + place, pa.array(which + i)
                start = b.column("start").take(of).to_numpy() + place
                yield batch(schema, b.column("row").take(of), start, b.column("n").take(of), *(hashes[at + k * UNIT] for k in range(DEPTH)))

    out = arrow_schema(SPAN)

    def merge(held: list[pa.RecordBatch], known: bool, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch, bool]:
        """(spans decided, the last row, which is not yet unless last, whether it is known to repeat); known: so of the first row."""
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        hit = equal_windows(np.stack([t.column(c).to_numpy().view(np.uint64) for c in blocks], axis=1))
        hit[0] |= known
        tail, known = t.slice(t.num_rows - 1), bool(hit[-1])
        take = np.flatnonzero((hit if last else np.append(hit[:-1], False)) & (t.column("n").to_numpy() == 1))
        start = t.column("start").to_numpy()[take]
        return batch(out, t.column("row").take(pa.array(take)), start, start + LENGTH), tail, known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, False
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= GROUP_WINDOWS:
                # equal windows come one after another; the last row waits for what follows it
                spans, tail, known = merge(held, known, False)
                yield spans
                held, size = [tail], 1
        if held:
            yield merge(held, known, True)[0]

    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = contents.select("row", "start", "n", "content").mapInArrow(cut, WINDOW)
    return windows.repartition(n, *blocks).sortWithinPartitions(*blocks).mapInArrow(run, SPAN)


def merge_fragments(contents: DataFrame) -> DataFrame:
    """SPAN: the repeats among contents (anchor, row, start, n, content), for those with n = 1."""
    out = arrow_schema(SPAN)

    def merge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        data, off = common.text_buffers(t.column("content").combine_chunks())
        single = t.column("n").to_numpy() == 1
        frag = np.repeat(np.arange(t.num_rows), np.diff(off))
        hit = repeated_windows(data, off) & single[frag]
        first = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & (np.append(-1, frag[:-1]) == frag)))
        last = np.flatnonzero(hit & ~(np.append(hit[1:], False) & (np.append(frag[1:], -1) == frag)))
        f = frag[first]
        base = t.column("start").to_numpy()[f] - off[f]
        return batch(out, t.column("row").combine_chunks().take(pa.array(f)), base + first, base + last + LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # of whole anchors
        tail, more, open_ = [], 0, None  # of the last anchor, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column("anchor").to_numpy()
            edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), b.num_rows]
            bytes_at = np.concatenate([[0], np.cumsum(common.text_buffers(b.column("content"))[1][1:])])
            begin, i = edges[-2], 0
            if tail and (begin or anchor[0] != open_):  # the tail's anchor ends here, or in this batch's first run
                if held and size + more >= GROUP_BYTES:
                    yield merge(held)
                    held, size = [], 0
                held, size, tail, more = held + tail, size + more, [], 0
                if anchor[0] != open_ and size >= GROUP_BYTES:
                    yield merge(held)
                    held, size = [], 0
            for j in edges[1:-1]:
                if size + bytes_at[j] - bytes_at[i] >= GROUP_BYTES:
                    yield merge([*held, b.slice(i, j - i)])
                    held, size, i = [], 0, j
            if begin > i:
                held.append(b.slice(i, begin - i))
                size += bytes_at[begin] - bytes_at[i]
            tail.append(b.slice(begin))
            more += bytes_at[-1] - bytes_at[begin]
            open_ = anchor[-1]
        if held and size + more >= GROUP_BYTES:
            yield merge(held)
            held = []
        if held or tail:
            yield merge(held + tail)

    return contents.mapInArrow(run, SPAN)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted((s["start"], s["end"]) for s in spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def remove(spanned: DataFrame) -> DataFrame:
    """RESULT for rows (doc_id, text, spans): spans merged and cut out."""
    out = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.text_buffers(b.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            removed, kept, cut = [], [], []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                cut.append(union(spans or []))
                at, digest = int(off[i]), hashlib.sha256()
                for x, y in cut[-1]:
                    digest.update(view[at : int(off[i]) + x])
                    at = int(off[i]) + y
                digest.update(view[at : int(off[i + 1])])
                kept.append(digest.hexdigest())
                removed.append(sum(y - x for x, y in cut[-1]))
            yield batch(out, b.column("doc_id").cast(pa.int64()), np.diff(off), removed, list(map(len, cut)), kept, [[{"start": x, "end": y} for x, y in c] for c in cut])

    return spanned.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """RESULT for every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = picked(docs, "doc_id", "text").select(F.unhex(F.md5(text)).alias("row"), "doc_id", text.alias("text"))
    every = stored(occurrences(keyed), "fragments")
    # stored, so that the joins below shuffle both sides, which Spark splits where a key is frequent
    often = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "frequent-anchors")
    found = stored(having(every, often, ["anchor"], every.count()), "repeated-anchors")
    discard(every, often)
    prints = stored(found.groupBy("anchor", "print").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows")).alias("at")), "prints")
    whole = having(found, prints.where("n > 1"), ["anchor", "print"], found.count())
    whole = whole.select("row", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    size = F.sum(F.col("at.windows") + (LENGTH - 1))
    several = prints.groupBy("anchor").agg(F.count("*").alias("prints"), (size > anchor_bytes).alias("large")).where("prints > 1").select("anchor", "large")
    several = stored(several, "varied-anchors")
    wanted = prints.join(several, "anchor").groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("anchor", "large", "n", "at.start", "at.windows")).alias("wanted"))
    schema = "anchor long, large boolean, row binary, start long, n long, content binary"
    out = arrow_schema(schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = common.text_buffers(b.column("text"))
            raw = data.tobytes()
            rows = [(w["anchor"], w["large"], row, w["start"], w["n"], raw[(i := int(off[k]) + w["start"]) : i + w["windows"] + LENGTH - 1])
                    for k, (row, wanted) in enumerate(zip(b.column("row").to_pylist(), b.column("wanted").to_pylist(), strict=True)) for w in wanted]
            if rows:
                yield batch(out, *zip(*rows, strict=True))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed.groupBy("row").agg(F.first("text").alias("text"))  # of equal rows, one
    contents = stored(texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(take, schema), "fragment-texts")
    edges = merge_fragments(contents.where("not large").drop("large").repartition(n, "anchor").sortWithinPartitions("anchor"))
    edges = edges.unionByName(merge_windows(contents.where("large")))
    spans = whole.unionByName(edges).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = stored(spans, "spans")  # equal rows are many on the other side of the join
    discard(found, prints, several, contents)
    return remove(keyed.join(spans, "row", "left").select("row", "doc_id", "text", "spans"))
