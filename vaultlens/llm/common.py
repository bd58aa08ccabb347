"""Shared helpers: scratch tables, Arrow text buffers, vectorised hashing and integer packing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a worker; a longer document is handled alone, whole.
CHUNK_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Send Python workers at most 1,000 rows and about 32 MB at once, unless the session says otherwise: texts may be long."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")
    if int(spark.conf.get(size).removesuffix("b")) >= (1 << 31) - 1:
        spark.conf.set(size, str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Only a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vaultlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Hadoop removes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later reads don't depend on executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def anonymous(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """(docs with its columns named c0, c1, ..., the new names of the wanted ones): no name of the caller's can clash then.

    A name is taken as written or, if no column has it so, without regard to case.
    """
    lower = [c.lower() for c in docs.columns]
    places = [docs.columns.index(w) if w in docs.columns else lower.index(w.lower()) for w in wanted]
    return docs.toDF(*(f"c{k}" for k in range(len(lower)))), [f"c{k}" for k in places]


def picked(docs: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns alone, whatever others there are."""
    own, names = anonymous(docs, *wanted)
    return own.select(*(F.col(n).alias(w) for n, w in zip(names, wanted, strict=True)))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty; offsets has one more entry than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return raw[base : offsets[-1] if len(offsets) else 0], offsets - base


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole rows of about limit bytes."""
    raw, off = text_buffers(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = PRIME, INVERSE
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and INVERSE**i modulo 2**64 for i < n at least."""
    size = 1 << max(12, (max(1, n) - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring_hash takes any substring's hash."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[1], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up = powers(len(prefix))[0]
    return mix64((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


#: Bytes above which a span is hashed by a digest of the whole.
LONG_SPAN = 2048
LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, which depends on these bytes alone.

    Eight bytes at a time are mixed in by a bijection, so unlike sums of powers
    it has no family of texts that collide whatever the multiplier is.
    """
    starts, length = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - np.asarray(starts, np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix64(length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + PRIME)
    view, step = memoryview(padded), 0
    for k in np.flatnonzero(length > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(view[starts[k] : starts[k] + length[k]], digest_size=8).digest(), "little")
    on = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    while len(on):
        out[on] = mix64(out[on] ^ (lane[starts[on] + step] & LANE_MASKS[np.minimum(length[on] - step, 8)]))
        step += 8
        on = on[length[on] > step]
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(raw, codec="zstd", asbytes=True)


def expand(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), packed[8]
    raw = pa.decompress(packed[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words split at blanks: all but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words of letters and digits: 0-9, a-z and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document index) of the maximal runs of member bytes; runs end with their document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.empty(n + 1, bool)
    inside[:n] = member[data]
    inside[n] = False
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    prev = np.empty(n + 1, bool)
    prev[0] = False
    prev[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~prev | first))
    ends = np.flatnonzero(prev & (~inside | first))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spark_type(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_type(schema))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
