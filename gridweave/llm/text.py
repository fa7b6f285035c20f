"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Texts of ASCII only take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns that are computed once for each row, however many filters on them
    follow: a filter is not pushed below the generator, so it names a value and not its expression."""
    value = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made")
    return rows.select("*", value).select(*[F.col(f"`{c}`") for c in rows.columns], "_made.*")


#: Rows and bytes of an Arrow batch of whole documents.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, where they are larger, to a size that suits whole documents.

    The defaults count rows of any length, and each batch is held several times: by the JVM that
    sends it, by the worker, and as the worker's answer. Plans are made when their result is asked for,
    so the settings stay lowered for the rest of the session; they change speed and memory only.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
