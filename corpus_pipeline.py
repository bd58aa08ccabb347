"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultlens.llm import decontamination, mixing, near_duplicates, quality
from vaultlens.llm.common import anonymous, bounded, stored, table
from vaultlens.llm.queries import KEEP_FROM, write_and_read_tokens


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    train = stored(quality.training_rows(quality.features(docs), table(spark, sf_dir, "labels")), "pipeline-train")
    return quality.keep(docs, quality.fit(train), KEEP_FROM)


def numbered(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rows with ``key``, a number for each distinct pair of doc_id and text: the doc_id where it has one text.

    Of a doc_id's several texts, the one with the least digest has its number;
    the others and rows without a doc_id get numbers past the largest (or below
    the least) doc_id, in order of doc_id and digest.  Of rows alike in doc_id
    and text, the first by its other columns stays.
    """
    rows = rows.withColumns({"key": F.col(doc_id).cast("long"), "digest": F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("")))})
    odd = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 or key is null").select(F.col("key").alias("odd"))
    odd = stored(odd, "pipeline-odd-ids")
    if odd.isEmpty():
        return rows.drop("digest")
    plain = rows.join(odd, rows["key"].eqNullSafe(odd["odd"]), "left_anti").drop("digest")
    others = [F.col(c) for c in rows.columns if c not in ("key", "digest")]
    first = Window.partitionBy("key", "digest").orderBy(F.to_json(F.struct(*others)))
    several = rows.join(odd, rows["key"].eqNullSafe(odd["odd"]), "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    several = stored(several, "pipeline-odd-rows")
    pairs = several.select("key", "digest")
    heads = pairs.where("key is not null").groupBy("key").agg(F.min("digest").alias("digest"))
    rest = pairs.where("key is null").unionByName(pairs.where("key is not null").join(heads, ["key", "digest"], "left_anti")).withColumn("bucket", F.substring("digest", 1, 3))
    sizes = rest.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # 4,096 buckets at most
    ends = rows.agg(F.max("key").alias("high"), F.min("key").alias("low"), F.count("*").alias("n")).first()
    high = -1 if ends.high is None else ends.high
    base = high + 1 if high < (1 << 62) else ends.low - ends.n - 1
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", F.asc_nulls_first("key")))
    rest = rest.withColumn("rank", rank).join(sizes, "bucket").select(F.col("key").alias("was"), F.col("digest").alias("of"), (F.lit(base) + F.col("before") + F.col("rank") - 1).alias("new"))
    several = several.join(stored(rest, "pipeline-new-ids"), several["key"].eqNullSafe(F.col("was")) & (several["digest"] == F.col("of")), "left")
    return stored(plain.unionByName(several.withColumn("key", F.coalesce("new", "key")).select(*plain.columns)), "pipeline-numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id, null last; rows alike in doc_id and text are one."""
    bounded(spark)
    own, (doc_id, text) = anonymous(docs, "doc_id", "text")
    rows = numbered(own, doc_id, text)
    found = near_duplicates.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col(text).alias("text")))
    dropped = found.where("not kept").select(F.col("doc_id").alias("key"))
    return rows.join(dropped, "key", "left_anti").select(*own.columns).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    bounded(spark)
    own, (_, text) = anonymous(docs, "doc_id", "text")
    rows = own.withColumn("digest", F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    found = decontamination.decontaminate(rows.select(F.col("digest").alias("doc_id"), F.col(text).alias("text")), table(spark, sf_dir, "benchmark"))
    hit = stored(found.where("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct(), "pipeline-contaminated")
    return rows.join(hit, "digest", "left_anti").select(*own.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: each document as often as it is taken."""
    return mixing.schedule(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    bounded(spark)
    return write_and_read_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: SQL can't express the quality classifier; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
