"""Streams of responses: the latest one per region, kept by an upsert in each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest


def read_responses(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(folder)


def keep_latest(stream: DataFrame, key: list[str], order: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes version after version of the latest rows: version n is made of version n - 1 and batch n, so a
    batch that is run again after a failure gives the same result."""
    spark, schema = stream.sparkSession, stream.schema

    def upsert(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(schema).parquet(f"{folder}/v{number - 1}") if number else spark.createDataFrame([], schema)
        latest(old.unionByName(batch), key, order).select(*schema.names).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
