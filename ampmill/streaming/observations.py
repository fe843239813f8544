"""An extra without counterpart: observations as a stream, fused as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampmill.operators.observations import STATS, fold

SCHEMA = T.StructType().add("part", "long").add("ord", "long").add("symbol", "string").add("vmin", "double").add("vtyp", "double").add("vmax", "double").add("seen_at", "timestamp")

#: Buckets of the stored observations.
BUCKETS = 64


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of observations as they land."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def counts_by_window(stream: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Observations per window and symbol; rows later than the watermark are dropped."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", width), "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("vtyp").alias("mean"))


def fuse_into(stream: DataFrame, table_path: str, checkpoint: str):
    """Keeps the fused record of every (part, symbol): each micro-batch's keys are folded anew with what is stored.

    The observations themselves are kept in buckets of their key, of which a batch reads those that its
    own keys fall in. Each batch writes a partition of its own, so that one that is tried again replaces
    what it wrote before.
    """

    bucket = F.pmod(F.xxhash64("part"), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/observations/epoch={epoch}")
        # at most BUCKETS numbers
        own = [r.bucket for r in rows.select("bucket").distinct().collect()]
        keys = batch.select("part", "symbol").distinct()
        known = spark.read.option("basePath", f"{table_path}/observations").parquet(f"{table_path}/observations")
        known = known.filter(F.col("bucket").isin(own)).join(keys, ["part", "symbol"], "left_semi")
        fold(known, ["part", "symbol"]).select("part", "symbol", *STATS).write.mode("overwrite").parquet(f"{table_path}/fused/epoch={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").start()
