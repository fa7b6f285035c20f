"""Bit filters tested inside the scan, so that only likely matches are shuffled.

A filter is one row with an array of 64-bit words. It is built by grouped ``bit_or`` aggregates
and read as a scalar subquery, so its test stays in the JVM. It never misses a key; a false hit
only sends one more row through the exact join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of one chunk: what one task gathers at a time while a filter is put together.
CHUNK_WORDS = 1024
#: Bits for each key, and the largest filter in words (8 MB). Beyond it the filter only gets less
#: selective; results stay exact.
BITS_PER_KEY = 16
MAX_WORDS = 1 << 20
PROBES = 2


def filter_words(n_keys: int) -> int:
    """Words for ``n_keys`` keys: whole chunks, at most ``MAX_WORDS``."""
    chunks = -(-n_keys * BITS_PER_KEY // (64 * CHUNK_WORDS))
    return min(max(1, chunks) * CHUNK_WORDS, MAX_WORDS)


def _bits(key: Column, words: int, probes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(probe), key), F.lit(words * 64)) for probe in range(probes)]


def build_filter(keys: DataFrame, key: str, n_keys: int, probes: int = PROBES) -> tuple[DataFrame, int]:
    """One row ``(words array<bigint>)`` that holds every non-null ``key``; and its word count.

    With no keys the frame is empty, and :func:`maybe` is false for every row.
    """
    words = filter_words(n_keys)
    value = F.col(f"`{key}`")
    bit = keys.where(value.isNotNull()).select(F.explode(F.array(*_bits(value, words, probes))).alias("bit"))
    word = bit.groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("value")
    )
    blank = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    chunk = (
        word.unionByName(blank)
        .groupBy("word")
        .agg(F.bit_or("value").alias("value"))
        .groupBy((F.col("word") / CHUNK_WORDS).cast("long").alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("word", "value")))["value"].alias("values"))
    )
    return (
        chunk.agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "values")))["values"]).alias("words")),
        words,
    )


def maybe(key: Column, bits: DataFrame | Column, words: int, probes: int = PROBES) -> Column:
    """True if ``key`` may be in the filter; null keys give true, so that the exact step decides. Inside a
    function of array elements the filter must be a column, as subqueries are not allowed there."""
    array = bits if isinstance(bits, Column) else bits.scalar()
    tests = None
    for bit in _bits(key, words, probes):
        value = F.element_at(array, (bit / 64).cast("int") + 1)
        hit = F.getbit(value, (bit % 64).cast("int")) == 1
        tests = hit if tests is None else tests & hit
    return key.isNull() | F.coalesce(tests, F.lit(False))


def drop_ids(rows: DataFrame, id_col: str, dropped: DataFrame, n_dropped: int) -> DataFrame:
    """``rows`` whose id is not in ``dropped`` (one column, same name), all columns kept.

    Rows that fail the filter test pass without a shuffle; the rest go through an exact anti join.
    Null ids always stay.
    """
    if n_dropped == 0:
        return rows
    bits, words = build_filter(dropped, id_col, n_dropped)
    test = maybe(F.col(f"`{id_col}`"), bits, words)
    kept = rows.where(test).alias("r").join(dropped.alias("gone"), F.col(f"r.`{id_col}`") == F.col(f"gone.`{id_col}`"), "left_anti")
    return rows.where(~test).unionByName(kept)
