"""Wildcard joins of a stream of texts with a static set of patterns.

A text's answer depends on no other text, so the probe keeps no state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildloom.operators.wildcard import wildcard_join
from wildloom.session import scratch_dir


def probe_stream(stream: DataFrame, patterns: DataFrame, text: str, pattern: str, **options) -> DataFrame:
    """Streaming pairs; options as for ``wildcard_join``. The static side is measured and its strategy chosen as for tables."""
    if not stream.isStreaming:
        raise ValueError("the texts are not a stream")
    return wildcard_join(stream, patterns, text, pattern, **options)


def windowed_counts(pairs: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Matches per window; rows later than ``late`` behind the newest time are left out."""
    timed = pairs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder and read that table."""
    spark: SparkSession = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
