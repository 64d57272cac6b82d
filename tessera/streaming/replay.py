"""Bounded streams: tables replayed file by file, and streaming queries run to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import scratch


def staged(df: DataFrame, batches: int, order: str) -> DataFrame:
    """A stream of df's rows in batches micro-batches of ascending order, as many files each: one for each task of the scan, or for each core if there are more.

    A batch with rows in fewer tasks is filled up with empty files, so that a trigger's files are one batch's, all of it.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "stream")
    low, high = df.select(F.col(order).cast("double").alias("x")).agg(F.min("x"), F.max("x")).first()
    place = F.lit(0) if low is None or low == high else F.least(F.floor((F.col(order).cast("double") - low) / (high - low) * batches), F.lit(batches - 1))
    parts = df.withColumn("_part", place.cast("int"))
    files = max(1, min(df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    for k in range(batches):
        parts.filter(F.col("_part") == k).drop("_part").coalesce(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            df.filter(F.lit(False)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a streaming query that has read all there is: a table in the shared folder of what it put out (complete: the last state).

    Each batch is written by the executors into a folder of its own, which a repeated batch overwrites, so no row passes the driver.
    """
    spark, path, done = stream.sparkSession, scratch(stream.sparkSession, "finished"), []

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/{'last' if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(at)
        if at not in done:
            done.append(at)

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema)


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The union of run(batch, number) over all batches, written as they come."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "batches")

    def put(batch: DataFrame, number: int) -> None:
        run(batch, number).write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)
