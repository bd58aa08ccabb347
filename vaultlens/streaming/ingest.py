"""Content-addressed ingestion: files that arrive are kept once for each content, however often they arrive.

Each micro-batch is deduplicated by SHA-256, anti-joined with the contents
stored, and appended; its manifest rows are appended beside it.  Both carry the
batch's number, and a batch that is run again replaces its own partition, so a
restart leaves no double rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, pattern: str = "*", available_now: bool = True) -> StreamingQuery:
    """Stream binary files below source into target/contents (sha, content, batch) and target/manifest (sha, path, batch)."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    hashed = files.select(F.sha2("content", 256).alias("sha"), "path", "content")

    def keep(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        batch = batch.persist()
        try:
            known = stored(here, f"{target}/contents", "sha string, content binary, batch long").where(F.col("batch") != number).select("sha")
            new = batch.dropDuplicates(["sha"]).select("sha", "content").join(known, "sha", "left_anti")
            for name, rows in (("contents", new), ("manifest", batch.select("sha", "path"))):
                out = rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").partitionBy("batch")
                out.option("partitionOverwriteMode", "dynamic").parquet(f"{target}/{name}")
        finally:
            batch.unpersist()

    writer = hashed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
