"""Prefix sums and ranks over a whole table without a window that holds all of it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Integer keys that one window partition sums.
WIDTH = 4096
#: Bytes of input files for each of :func:`parts`.
DEALT_BYTES = 4 << 20


def parts(df: DataFrame) -> int:
    """Partitions for what ``df`` reads, in number by the size of its files."""
    spark = df.sparkSession
    files = df.inputFiles()
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / DEALT_BYTES))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys``, in partitions whose number grows with the files that it reads: left to
    itself, Spark joins small partitions again, and a task's sorts grow with the table until it stops."""
    return df.repartition(parts(df), *keys)


def exclusive_prefix(df: DataFrame, value: str | Column, key: str, coarse: Sequence[str] = (), by: Sequence[str] = (), out: str = "before", width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` over rows that stand before, within ``by``, in the order of
    ``coarse`` and then the integer ``key``.

    Rows are summed in groups of ``width`` keys; one window runs over the groups, another inside each.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [*by, *coarse, "_group"]
    rows = dealt(df.withColumn("_value", value).withColumn("_group", F.floor(F.col(key) / F.lit(width))), *keys)
    groups = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*by).orderBy(*coarse, "_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(groups, keys)
        .withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_group", "_before")
    )


def neighbours(df: DataFrame, key: str, by: Sequence[str], previous: str = "previous", following: str = "following", width: int = WIDTH) -> DataFrame:
    """``df`` with the next smaller and the next larger value of the integer ``key`` within ``by``, null at
    the ends; keys are unique within ``by``. A window holds ``width`` keys, however many one ``by`` has."""
    rows = dealt(df.withColumn("_group", F.floor(F.col(key) / F.lit(width))), *by, "_group")
    groups = rows.groupBy(*by, "_group").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    over = Window.partitionBy(*by).orderBy("_group")
    groups = groups.select(*by, "_group", F.lag("_high").over(over).alias("_before"), F.lead("_low").over(over).alias("_after"))
    inside = Window.partitionBy(*by, "_group").orderBy(key)
    return (
        rows.join(groups, [*by, "_group"])
        .withColumn(previous, F.coalesce(F.lag(key).over(inside), "_before"))
        .withColumn(following, F.coalesce(F.lead(key).over(inside), "_after"))
        .drop("_group", "_before", "_after")
    )
