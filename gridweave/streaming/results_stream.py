"""Best methods over a growing result log: an addition of this library, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", **options: str) -> DataFrame:
    """Files added to a log folder, as a stream."""
    return spark.readStream.schema(schema).options(**({"header": "true"} | options if fmt == "csv" else options)).format(fmt).load(path)


def best_methods(log: DataFrame, keys: Sequence[str], name: str = "name", time: str = "time") -> DataFrame:
    """Fastest method and number of runs of each group so far; state holds one row for each group."""
    return log.groupBy(*keys).agg(F.min(F.struct(F.col(time), F.col(name))).alias("best"), F.count(F.lit(1)).alias("runs")).select(
        *keys, F.col(f"best.{name}").alias("best_name"), F.col(f"best.{time}").alias("best_time"), "runs"
    )


def windowed_means(log: DataFrame, at: str, late: str, width: str, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Mean time in event-time windows; rows later than ``late`` are dropped by the watermark."""
    return log.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.avg(time).alias("mean_time"), F.count(F.lit(1)).alias("runs"))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Into an in-memory table, for small aggregates; processes what is there and stops."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
