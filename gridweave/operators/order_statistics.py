"""Exact order statistics of groups of any size.

A group of at most ``MOST`` values is sorted where it is. A larger one is never in one task: its values
become 64 bits whose unsigned order is theirs, and the element of a rank is found digit by digit, 16 bits a
round. A round counts the values that share the digits so far by their next digit, with partial sums, so a task
sends at most 65,536 counts for a group and rank; those counts say which digit comes next. Four
rounds give all bits. Every round reads the rows of large groups only, of which there are at most
one for each ``MOST`` rows.

Nulls are left out; groups of nulls alone give null. NaN counts as larger than all else, and -0.0 equals
0.0. Values are integers, floats, doubles, or decimals of at most 18 digits. Keys can be null. No groups, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.plans.staging import materialise

#: Values of a group that one task sorts; large groups whose keys are broadcast.
MOST, MOST_BROADCAST = 1 << 14, 1 << 12
DIGIT = 16


def _bits_of_double(x: pd.Series) -> pd.Series:
    """Bits whose signed order is that of the numbers."""
    bits = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def _double_of_bits(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64))


def _as_bits(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        signed = F.pandas_udf(_bits_of_double, "bigint")(value.cast("double"))
    elif isinstance(kind, T.DecimalType):
        signed = (value * F.lit(10**kind.scale)).cast("bigint")
    else:
        signed = value.cast("bigint")
    return signed.bitwiseXOR(F.lit(-(2**63)))


def _from_bits(bits: Column, kind: T.DataType) -> Column:
    signed = bits.bitwiseXOR(F.lit(-(2**63)))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.pandas_udf(_double_of_bits, "double")(signed).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (signed.cast("decimal(38,0)") / F.lit(10**kind.scale)).cast(kind)
    return signed.cast(kind)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def elements(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], most: int = MOST) -> DataFrame:
    """One row for each group with any value: ``keys`` and, for each name in ``ranks``, the element whose place in the
    group's sorted values, from 0, the function gives for the number of values."""
    kind = df.schema[value].dataType
    if not isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)) and not (isinstance(kind, T.DecimalType) and kind.precision <= 18):
        raise TypeError(f"{value} is {kind.simpleString()}, which has no order of 64 bits")
    given = [f"k{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, given)], F.col(f"`{value}`").alias("value")).where("value is not null")
    large = materialise(rows.groupBy(*given).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large-groups")
    n_large = large.count()
    small = rows
    if n_large:
        test = F.broadcast(large) if n_large <= MOST_BROADCAST else large
        small = rows.alias("r").join(test.alias("g"), _same("r", "g", given), "left_anti")
    held = small.groupBy(*given).agg(F.sort_array(F.collect_list("value")).alias("x"))
    found = held.select(*given, *[F.element_at("x", (rank(F.size("x").cast("bigint")) + 1).cast("int")).alias(name) for name, rank in ranks.items()])
    if n_large:
        mine = rows.alias("r").join(test.alias("g"), _same("r", "g", given)).select(*[f"r.{g}" for g in given], _as_bits(F.col("r.value"), kind).alias("bits"))
        found = found.unionByName(_digits(mine, large, given, ranks, kind))
    return found.select(*[F.col(g).alias(k) for k, g in zip(keys, given)], *ranks)


def _digits(rows: DataFrame, large: DataFrame, given: list[str], ranks: dict[str, Callable[[Column], Column]], kind: T.DataType) -> DataFrame:
    n = F.col("n")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(n).cast("bigint").alias("rank")) for name, rank in ranks.items()])).alias("x")
    sought = large.select(*given, each).select(*given, "x.name", "x.rank", F.lit(0).cast("bigint").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        sought = materialise(sought, "sought")
        # Rows meet each prefix once, however many ranks have it. Before the first digit all prefixes are 0.
        prefixes = sought.select(*given, "prefix").distinct()
        if large.count() <= MOST_BROADCAST:
            prefixes = F.broadcast(prefixes)
        so_far = F.shiftrightunsigned("bits", shift + DIGIT) if shift + DIGIT < 64 else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND((1 << DIGIT) - 1).cast("int")
        inside = rows.withColumn("prefix", so_far).alias("r").join(prefixes.alias("p"), _same("r", "p", [*given, "prefix"]))
        counts = inside.groupBy(*[f"r.{g}" for g in given], "r.prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        met = sought.alias("s").join(counts.alias("c"), _same("s", "c", [*given, "prefix"]))
        order = Window.partitionBy(*given, "name").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # 2^16 digits at most
        upto = met.select(*[f"s.{g}" for g in given], "s.name", "s.rank", "s.prefix", "c.digit", "c.n").withColumn("upto", F.sum("n").over(order))
        hit = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))
        prefix = F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit").cast("bigint"))
        sought = upto.where(hit).select(*given, "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), prefix.alias("prefix"))
    valued = sought.select(*given, "name", _from_bits(F.col("prefix"), kind).alias("value"))
    return valued.groupBy(*given).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], most: int = MOST) -> DataFrame:
    """``keys`` and, for each name, the percentile of ``value`` at a fraction, between two elements in proportion; null for
    groups without values."""
    def at(fraction: float, up: bool) -> Callable[[Column], Column]:
        place = lambda n: (n - 1) * F.lit(float(fraction))
        return lambda n: (F.ceil(place(n)) if up else F.floor(place(n))).cast("bigint")

    names = list(fractions)
    ranks = {f"{side}{k}": at(fractions[name], side == "hi") for k, name in enumerate(names) for side in ("lo", "hi")}
    given = [f"k{n}" for n in range(len(keys))]
    named = df.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, given)], F.col(f"`{value}`").alias("value"))
    sizes = named.groupBy(*given).agg(F.count("value").alias("n")).alias("n")
    joined = sizes.join(elements(named, given, "value", ranks, most).alias("e"), _same("n", "e", given), "left")

    def between(k: int, fraction: float) -> Column:
        low, high = (F.col(f"e.{side}{k}").cast("double") for side in ("lo", "hi"))
        place = (F.col("n.n") - 1) * F.lit(float(fraction))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return joined.select(*[F.col(f"n.{g}").alias(k) for k, g in zip(keys, given)], *[between(k, fractions[name]).alias(name) for k, name in enumerate(names)])


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str, most: int = MOST) -> DataFrame:
    return percentiles(df, keys, value, {out: 0.5}, most)
