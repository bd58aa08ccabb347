"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each document becomes a few statistics of its whole text.  Cosines of random
projections of the standardised statistics approximate a Gaussian kernel.  The
normal equations are summed in the partitions, by fold, and added up; leaving
one fold out at a time gives scores for rows that a fit hasn't seen, on which
pool-adjacent-violators fits the calibration.

A fit takes at most about ``MOST_ROWS`` labelled rows, drawn by a hash of the
row; everything else covers all rows.  Labels, language, source and doc_id are
never inputs of a score.

Defined cases: null text is the empty text; rows without a label aren't learnt
from, several labels of one doc_id are averaged; without labelled rows every
score is 0.5; repeated rows each have a row; an empty table gives an empty
result; a table's further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm import common
from vaultlens.llm.common import arrow_schema, batch, picked

MOST_ROWS = 200_000
FOLDS = 4
BINS = 4000

LOWER, UPPER, DIGIT, SPACE, LINE, SHOUT, BAR, SYMBOL, PAUSE, WIDE, REST, OTHER = range(12)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = LOWER, UPPER, DIGIT
CLASS[[32, 10]] = SPACE, LINE
CLASS[[ord(c) for c in "!"]], CLASS[[ord(c) for c in "|"]] = SHOUT, BAR
CLASS[[ord(c) for c in "$%&*#@^~<>{}[]\\/=+_"]] = SYMBOL
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = PAUSE
CLASS[192:], CLASS[128:192] = WIDE, REST
NAMES = (
    "bytes words upper digit blank line shout bar symbol pause wide other word_bytes word_spread distinct_words "
    "odd_ends line_words distinct_lines short_words top_run"
).split()


def distinct_per_row(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    key = common.mix64(value + row.astype(np.uint64) * common.PRIME)
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount(row[order[first]], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = CLASS[data]
    row = np.repeat(np.arange(n), size)
    count = np.bincount(row * 12 + kind, minlength=12 * n).reshape(n, 12).astype(float)
    chars = np.maximum(count.sum(1) - count[:, REST], 1)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER] + count[:, WIDE], 1)
    starts, ends, doc = common.words(data, offsets, common.NOT_BLANK)
    n_words = np.bincount(doc, minlength=n)
    per = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    last = kind[ends - 1] if len(ends) else kind[:0]
    odd = np.bincount(doc, np.isin(last, (SHOUT, BAR, SYMBOL)), n) / per
    word = common.span_hash(data, starts, ends)
    unlined = np.ones(256, bool)
    unlined[10] = False
    a, b, line_doc = common.words(data, offsets, unlined)
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    distinct_lines = distinct_per_row(line_doc, common.span_hash(data, a, b), n) / n_lines
    same = np.zeros(len(word), bool)
    if len(word):
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    out = [
        np.log1p(size), np.log1p(n_words), count[:, UPPER] / letters, count[:, DIGIT] / chars, count[:, SPACE] / chars, count[:, LINE] / chars,
        count[:, SHOUT] / per, count[:, BAR] / per, count[:, SYMBOL] / per, count[:, PAUSE] / per, count[:, WIDE] / letters, count[:, OTHER] / chars,
        np.log1p(mean), np.log1p(spread), distinct_per_row(doc, word, n) / per, odd, np.log1p(n_words / n_lines), distinct_lines,
        np.bincount(doc, length <= 3, n) / per, np.bincount(doc, same, n) / per,
    ]
    return np.stack(out, 1)


FEATURES = "doc_id long, stats array<double>"


def features(docs: DataFrame) -> DataFrame:
    """FEATURES for every row of docs (doc_id, text)."""
    out = arrow_schema(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in common.chunks(b.column("text")):
                x = statistics(data, off)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield batch(out, b.column("doc_id").slice(i, j - i).cast(pa.int64()), rows.cast(out.field("stats").type))

    return picked(docs, "doc_id", "text").mapInArrow(run, FEATURES)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([cosines, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of the raw one keeps the order within a level."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def rows_of(b: pa.RecordBatch) -> np.ndarray:
    values = b.column("stats")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(NAMES)) if b.num_rows else np.zeros((0, len(NAMES)))


def isotonic(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to total / n."""
    blocks: list[list[float]] = []
    for w, s in zip(n.tolist(), total.tolist(), strict=True):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + k]
    return np.repeat([s / w for w, s, _ in blocks], [k for *_, k in blocks])


def fit(train: DataFrame, size: int = 256, width: float = 4.0, ridge: float = 1e-4, parts: int = 8) -> Model:
    """train: doc_id, stats, y (0 to 1).  parts bounds what the driver is sent: one sum of normal equations each."""
    d = len(NAMES)
    rng = np.random.default_rng(11)
    model = Model(np.zeros(d), np.ones(d), rng.normal(size=(d, size)) / width, rng.uniform(0, 2 * np.pi, size), np.zeros(size + d + 1), np.zeros(1), np.full(1, 0.5))
    n = train.count()
    if not n:
        return model
    if n > MOST_ROWS:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(MOST_ROWS / n * (1 << 20)))
    train = common.stored(train.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).repartition(parts), "quality-train")

    def summed(function, shape: tuple) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                function(total, rows_of(b), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        got = train.coalesce(parts).mapInArrow(run, "total binary").collect()
        return sum((np.frombuffer(r.total).reshape(shape) for r in got), np.zeros(shape))

    def moments(total, x, y, fold):
        total += [np.full(d, len(x)), x.sum(0), (x**2).sum(0)]

    rows, one, two = summed(moments, (3, d))
    model.mean = one / rows
    model.scale = np.maximum(np.sqrt(np.maximum(two / rows - model.mean**2, 0)), 1e-6)
    k = len(model.weights)

    def normal(total, x, y, fold):
        z = np.hstack([model.lift(x), y[:, None]])
        for f in range(FOLDS):
            total[f] += z[fold == f].T @ z[fold == f]

    gram = summed(normal, (FOLDS, k + 1, k + 1))

    def solve(g: np.ndarray) -> np.ndarray:
        return np.linalg.solve(g[:k, :k] + ridge * max(1.0, g[k - 1, k - 1]) * np.eye(k), g[:k, k])

    left_out = [solve(gram.sum(0) - gram[f]) for f in range(FOLDS)]
    model.weights = solve(gram.sum(0))

    def bins(total, x, y, fold):
        z = model.lift(x)
        for f in range(FOLDS):
            at = np.clip(((z[fold == f] @ left_out[f] + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, y[fold == f], BINS)

    n_in, y_in = summed(bins, (2, BINS))
    used = np.flatnonzero(n_in)
    model.knots, model.levels = (used + 0.5) / BINS * 2 - 0.5, isotonic(n_in[used], y_in[used])
    return model


def held_out(doc_id: Column, of: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == 0


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stats, y of the labelled rows that may be learnt from."""
    y = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    return stats.where(~held_out(F.col("doc_id"))).join(y, "doc_id")


def score_features(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(rows_of(b)))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [model.score(statistics(data, off)) >= threshold for _, _, data, off in common.chunks(b.column("text"))]
            yield b.filter(pa.array(np.concatenate(good))) if good else b

    return docs.mapInArrow(run, docs.schema)
