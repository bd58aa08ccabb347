"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it is one less
than 0 modulo the block size; six bits of each chunk's hash make one character.
The block size is 3 times the power of two that gives at most 64 chunks, halved
while there are fewer than 32.  A fingerprint is ``size:signature:signature at
twice the size``.  Two are compared where their block sizes agree, as one minus
the edit distance (insertions and deletions) over the signatures' lengths.

Defined cases: null text is the empty text, whose fingerprint is ``3::``; equal
texts have equal fingerprints and likeness 1; an empty table gives an empty
result; a single document is its own neighbour; repeated rows and ties of
doc_id are ordered by text; a null doc_id is last; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import arrow_schema, batch, picked, spark_type, stored

LENGTH = 64
ROLL = 7
#: First characters of a text that deal out rows of one doc_id.
HEAD = 32
MULTIPLIERS = [pow(0x01000193, k + 1, 1 << 32) for k in range(ROLL)]
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CODE = np.zeros(256, np.int64)
CODE[ALPHABET] = np.arange(64)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of each byte and the six before it; bytes before the text are zero."""
    out = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    for k, m in enumerate(MULTIPLIERS[: len(data)]):
        out[k:] += wide[: len(wide) - k] * np.uint32(m)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


def signature(roll: np.ndarray, prefix: np.ndarray, size: int, most: int) -> str:
    """At most ``most`` characters; the last chunk takes whatever remains."""
    n = len(roll)
    if not n:
        return ""
    ends = np.flatnonzero(roll % np.uint32(size) == size - 1)[: most - 1] + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    return ALPHABET[(common.substring_hash(prefix, starts, ends) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    size = 3
    while size * LENGTH < len(data):
        size *= 2
    roll, prefix = rolling(data), common.prefix_hash(data)
    one = signature(roll, prefix, size, LENGTH)
    while len(one) < LENGTH // 2 and size > 3:
        size //= 2
        one = signature(roll, prefix, size, LENGTH)
    return f"{size}:{one}:{signature(roll, prefix, 2 * size, LENGTH)}"


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of strings of up to 64 characters, by bit-parallel rows."""
    n, rows = len(a), np.arange(len(a))
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))

    def codes(x: list[str]) -> np.ndarray:
        return CODE[np.frombuffer("".join(s.ljust(LENGTH, "A") for s in x).encode(), np.uint8)].reshape(n, LENGTH)

    ca, cb = codes(a), codes(b)
    match = np.zeros((n, 64), np.uint64)
    for k in range(int(la.max(initial=0))):
        on = la > k
        match[rows[on], ca[on, k]] |= np.uint64(1 << k)
    state = np.full(n, ~np.uint64(0))
    for k in range(int(lb.max(initial=0))):
        on = lb > k
        v = state[on]
        u = v & match[rows[on], cb[on, k]]
        state[on] = (v + u) | (v - u)
    mask = np.where(la == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & mask).astype(np.int64)


def shares_run(a: str, b: str) -> bool:
    """Whether the signatures have a run of seven characters in common, or half the shorter one's if that is less."""
    k = max(1, min(ROLL, min(len(a), len(b)) // 2))
    have = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in have for i in range(len(b) - k + 1))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; block sizes that differ by more than a factor of two give 0."""
    out = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        pairs += [(i, x1, y1), (i, x2, y2)] if bx == by else [(i, x1, y2)] if bx == 2 * by else [(i, x2, y1)] if by == 2 * bx else []
    pairs = [p for p in pairs if p[1] and p[2] and shares_run(p[1], p[2])]
    if pairs:
        i, a, b = (list(x) for x in zip(*pairs, strict=True))
        total = np.fromiter(map(len, a), np.int64) + np.fromiter(map(len, b), np.int64)
        np.maximum.at(out, i, 2 * common_subsequence(a, b) / total)
    return out


PRINT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
HELD = PRINT + ", part int, kind string, text string"


def compare(ids: list, texts: list[str], after: list[str]) -> list[list]:
    """Columns of PRINT for texts and the texts that come after them."""
    edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after, strict=True)]
    whole: dict[str, str] = {}
    for t in (*texts, *after, *edited):
        if t not in whole:
            whole[t] = fingerprint(t.encode())
    of, of_edited, of_after = ([whole[t] for t in x] for x in (texts, edited, after))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    return [ids, list(map(len, texts)), sha, of, of_edited, likeness(of, of_edited), likeness(of, of_after)]


def neighbours(docs: DataFrame, files: int | None = None) -> DataFrame:
    """PRINT for every row of docs (doc_id, text): its edited text takes its second half from the next lower doc_id.

    Rows are range-partitioned by doc_id and the first characters of the text,
    so rows of one doc_id are dealt to several tasks; each partition hands out
    its first and last text, and those few rows are matched across partitions.
    """
    out, spark = arrow_schema(HELD), docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        edge = lambda kind, row: batch(out, [row[0]], *[[None]] * 6, [part], [kind], [row[1]])
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                rows = list(zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), strict=True))
                if last is None:
                    yield edge("first", rows[0])
                else:
                    rows.insert(0, last)
                last = rows[-1]
                if len(rows) > 1:
                    n = len(rows) - 1
                    ids, texts = zip(*rows, strict=True)
                    got = compare(list(ids[:-1]), list(texts[:-1]), list(texts[1:]))
                    yield batch(out, *got, [part] * n, ["done"] * n, [None] * n)
        if last is not None:
            yield edge("last", last)

    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = picked(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, F.desc_nulls_last("doc_id"), F.substring("text", 1, HEAD)).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    rows = stored(rows.mapInArrow(run, spark_type(HELD)), "fingerprints")
    columns = PRINT.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    heads = rows.where("kind = 'first'").select(F.col("part").alias("following"), F.col("text").alias("after"))
    parts = rows.where("kind = 'first'").select(F.col("part").alias("following"))  # one number for each partition, no texts
    parts = parts.select("following", F.coalesce(F.lag("following").over(Window.orderBy("following")), F.max("following").over(Window.partitionBy())).alias("part"))
    tails = rows.where("kind = 'last'").select("doc_id", "text", "part").join(parts, "part").join(heads, "following")

    done = arrow_schema(PRINT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(done, *compare(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after"))))

    return rows.where("kind = 'done'").select(*columns).unionByName(tails.mapInArrow(finish, PRINT))
