"""Incremental ingest: documents and mentions arriving as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import first_by


def _timed(mentions: DataFrame, late: str) -> DataFrame:
    """With event time ``at`` and its watermark; a stream that has them already keeps its own."""
    return mentions if "at" in mentions.columns else mentions.withColumn("at", F.col("seen_at").cast("timestamp")).withWatermark("at", late)


def windowed_mentions(mentions: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, type, n) of mentions by tumbling window; rows later than the watermark are dropped."""
    return _timed(mentions, late).groupBy(F.window("at", window).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def first_mentions(mentions: DataFrame, late: str = "2 days") -> DataFrame:
    """The stream, with event time ``at``, without rows that were delivered twice within the watermark."""
    return _timed(mentions, late).dropDuplicatesWithinWatermark(["doc_id", "text", "prop_idx"])


def upsert_nodes(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Keeps a node table current: each micro-batch rewrites the buckets it touches.

    The table at ``path`` is bucketed by a hash of the node id into ``buckets`` folders; a batch rewrites only the
    buckets of its own nodes, keeping the latest row per node by seq. The new buckets are staged under the
    batch's number first. A batch that is run again after a failure takes a staged copy that is whole in place of
    reading the table, which may have lost buckets when the job died while it was overwritten.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        exists = lambda p: (q := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q)
        staged = f"{checkpoint}/staged/{epoch}"
        if not exists(f"{staged}/_SUCCESS"):
            rows = batch.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int"))
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
            if not touched:
                return
            if exists(path):
                old = spark.read.schema(rows.schema).parquet(path).filter(F.col("bucket").isin(touched))
                rows = old.unionByName(rows)
            first_by(rows, ["node_id"], [F.col("seq")], last=True).write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/state")
