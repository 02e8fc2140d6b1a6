"""Incremental extraction from a growing folder, as a micro-batch stream into the checkpoint table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import IDENTITY, pending
from ..sources import files


def follow(spark: SparkSession, folder: str, schema: str, checkpoint: str, state: str, extractor: Callable[[DataFrame], DataFrame], record_schema: str, identity: list[str] = IDENTITY) -> StreamingQuery:
    """Start a query that answers new requests once; a repeated batch finds its rows in the table and asks nothing."""

    def batch(requests: DataFrame, _: int) -> None:
        done = files.optional(spark, checkpoint, record_schema)
        files.append(extractor(pending(requests, done, identity)), checkpoint)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
