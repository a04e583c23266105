"""Streaming counterparts: windowed counts of late events, and profiles kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.profile import long_texts


def windowed(stream: DataFrame, time_col: str, keys: list[str], value_col: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` behind the newest are dropped."""
    at = F.col(time_col).cast("timestamp")
    return (
        stream.withColumn("_at", at)
        .withWatermark("_at", late)
        .groupBy(F.window("_at", window), *keys)
        .agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
        .select(F.col("window.start").alias("start"), *keys, "n", "total")
    )


def value_counts_to(spark: SparkSession, source: str, schema: T.StructType, columns: list[str], target: str, checkpoint: str) -> None:
    """Append the value counts of every new batch of files to ``target``; ``merged_counts`` adds them up.

    Each batch is written under its own id and rewritten if it is retried, so no file counts twice.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        long_texts(batch, columns).groupBy("name", "v").agg(F.count("*").alias("cnt")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_counts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("name", "v").agg(F.sum("cnt").alias("cnt"))
