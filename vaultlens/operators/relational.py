"""Joins, windows and aggregates that archive inventories are made of, as DataFrame compositions.

Order matters in many of them (first match, last wins, first n), so each takes
the columns that give it; ties are broken by whatever the caller adds there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; beyond, the join shuffles both sides.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, which is counted first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: its last values, at the place of its first.  Partial aggregates, no sort."""
    values = [c for c in df.columns if c not in (*keys, order)]
    out = df.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*values), order).alias("_last"))
    return out.select(*keys, order, *(F.col(f"_last.{v}").alias(v) for v in values))


def first_match(left: DataFrame, lookup: DataFrame, on: str, keys: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """For each key of left the first row, by rank, that finds its ``on`` in the lookup; keys without one are left out."""
    hits = left.join(small(lookup), on)
    values = [c for c in hits.columns if c not in (*keys, *rank)]
    out = hits.groupBy(*keys).agg(F.min_by(F.struct(*rank, *values), F.struct(*rank)).alias("_first"))
    return out.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in (*rank, *values)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, without a sort."""
    values = [c for c in df.columns if c not in (*keys, *order)]
    out = df.groupBy(*keys).agg(F.min(F.struct(*order, *values)).alias("_first"))
    return out.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in (*order, *values)))


def first_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most n rows of each group; Spark keeps only n a group while sorting (window group limit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def size_from_next(df: DataFrame, group: Sequence[str], order: str, offset: str, end: str) -> DataFrame:
    """``size``: the next row's offset less this one's, the last up to ``end``."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("size", F.coalesce(F.lead(offset).over(w), F.col(end)) - F.col(offset))


def running_offset(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, base: Column | int = 0) -> DataFrame:
    """``offset``: base and the sizes of all rows before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)) + base)


#: Groups up to which one window adds up their totals.
WINDOW_GROUPS = 1_000_000


def running_total(df: DataFrame, key: str, size: str, span: int = 4096) -> DataFrame:
    """``start``: the sizes of all rows with a smaller whole-number key, without one task for all rows.

    Rows are summed within ranges of ``span`` keys; the ranges' totals are
    added up the same way until few enough are left for one window.
    """
    cell = F.floor(F.col(key) / span).alias("_cell")
    sums = df.groupBy(cell).agg(F.sum(size).alias("_sum"))
    if sums.limit(WINDOW_GROUPS + 1).count() <= WINDOW_GROUPS:
        order = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0)))
    else:
        before = running_total(sums.withColumnRenamed("_cell", "_key"), "_key", "_sum", span)
        before = before.select(F.col("_key").alias("_cell"), F.col("start").alias("_before"))
    within = Window.partitionBy("_cell").orderBy(key).rangeBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_cell", cell).withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    out = out.join(before.select("_cell", "_before"), "_cell")
    return out.withColumn("start", F.col("_within") + F.col("_before")).drop("_cell", "_within", "_before")


def without_ancestors(df: DataFrame, path: str) -> DataFrame:
    """Distinct paths that are no proper ancestor of another: every path's ancestors are an equi anti-join."""
    paths = df.select(path).distinct()
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = paths.where(F.size(parts) > 1).select(F.explode(ancestors).alias(path)).distinct()
    return paths.join(above, path, "left_anti")


def overlaps(requests: DataFrame, parts: DataFrame, bucket: int) -> DataFrame:
    """requests (request, offset, size) with parts (part, start, end): what each takes of each, as a bucketed range join.

    Both sides are dealt to the buckets of ``bucket`` bytes that they touch; a
    pair counts in the bucket where its overlap begins.  The bucket should be
    about the length of a part.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / bucket), F.floor((high - 1) / bucket)))
    a = requests.where("size > 0").withColumn("cell", cells(F.col("offset"), F.col("offset") + F.col("size")))
    b = parts.where("end > start").withColumn("cell", cells(F.col("start"), F.col("end")))
    first, last = F.greatest("offset", "start"), F.least(F.col("offset") + F.col("size"), F.col("end"))
    out = a.join(b, "cell").where((first < last) & (F.floor(first / bucket) == F.col("cell")))
    return out.select("request", "part", (first - F.col("start")).alias("from"), (last - F.col("start")).alias("to"))


def most_common(df: DataFrame, value: str, k: int, order: Sequence[str] = ()) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *(order or [value])).limit(k)


def counters(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value, n) of many columns in one shuffle: rows are unpivoted and counted before it."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in metrics.items()))
    return df.select(F.inline(pairs)).where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("n"))


def all_hold(observations: DataFrame, key: Sequence[str], condition: Column) -> DataFrame:
    """Relational division: the keys for which the condition holds on every row."""
    return observations.groupBy(*key).agg(F.bool_and(condition).alias("_all"), F.count("*").alias("n")).where("_all").drop("_all")


def early_exit(checks: DataFrame, group: Sequence[str], order: Sequence[str], failed: str, enough: int) -> DataFrame:
    """checked, failures, confirmed for each group, as a reader would count who stops once ``enough`` are checked without failure."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = checks.withColumn("_n", F.count("*").over(w)).withColumn("_f", F.sum(F.col(failed).cast("int")).over(w))
    stop = F.min(F.when((F.col("_n") >= enough) & (F.col("_f") == 0), F.col("_n")))
    out = run.groupBy(*group).agg(stop.alias("_stop"), F.max("_n").alias("_all"), F.max("_f").alias("_fails"))
    return out.select(
        *group, F.coalesce("_stop", "_all").alias("checked"), F.when(F.col("_stop").isNotNull(), 0).otherwise(F.col("_fails")).cast("long").alias("failures"),
        F.col("_stop").isNotNull().alias("confirmed"),
    )


def settled(df: DataFrame) -> DataFrame:
    """df, written to the session's shared folder once: what reads it often doesn't work it out again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="vaultlens-"))
    return df.checkpoint()
