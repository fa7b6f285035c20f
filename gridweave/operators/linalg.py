"""Products of sparse and dense matrices as joins and sums.

All strategies of :func:`spmm` give the same product; they differ in the physical plan only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.matrix import delta_decode, delta_rows, tiles
from gridweave.plans.prefix import exclusive_prefix, parts

FLOAT_EPS, DOUBLE_EPS = 1.1920929e-7, 2.220446049250313e-16


def spmm_coord(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a(i, j, v)`` times ``b(j, c, w)``: one equi-join, one sum with partial aggregation."""
    return a.join(b, "j").groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("x"))


def spmm_vector(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b(j, row array)``: one row of the join for each entry of ``a``, whatever the width of ``b``."""
    met = a.join(b, "j").select("i", "v", F.posexplode("row").alias("c", "w"))
    return met.groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("x"))


def spmm_blocked(a: DataFrame, b: DataFrame, height: int = 64, depth: int = 1024) -> DataFrame:
    """Blocks of ``a`` against row blocks of ``b(j, row array)``; numpy multiplies a pair at a time.

    A block is what ``depth`` columns hold in some rows, ``height * depth`` entries at most: ``height`` rows where all
    places are taken, more where few are. So ``b`` is sent once for that many entries, and not once for each tile that has any.
    """
    most = height * depth

    def panelled(rows: DataFrame) -> DataFrame:
        """``j`` within its panel, and the panel's first column."""
        at = F.pmod(F.col("j").cast("long"), F.lit(depth))
        return rows.where("j is not null").withColumn("panel", F.col("j").cast("long") - at).withColumn("j", at.cast("int"))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        panel, *columns = pa.concat_batches(held).columns
        first = np.flatnonzero(np.diff(panel.to_numpy(), prepend=panel[0].as_py() - 1))
        ends = pa.array(np.append(first, len(panel)).astype(np.int32))
        return pa.RecordBatch.from_arrays([panel.take(pa.array(first)), *[pa.ListArray.from_arrays(ends, column) for column in columns]], names=["panel", "i", "j", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == most:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, v, rows = (column[k].values for column in batch.columns)
                lists = pc.struct_field(rows, "row")
                size = pc.list_value_length(lists).to_numpy()
                width = max(1, int(size.max()))
                cell = np.repeat(pc.struct_field(rows, "j").to_numpy() * width, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                w = lists.flatten()
                # of each place of the panel: the sum of its values, how many are not null, and how many rows are long enough for it
                dense, known, reached = (np.bincount(cell, x, depth * width).reshape(depth, width) for x in (w.fill_null(0), w.is_valid(), None))
                lines, ok, j, v = i.dictionary_encode("encode"), v.is_valid().to_numpy(zero_copy_only=False), j.to_numpy(), v.fill_null(0).to_numpy()
                line, step = lines.indices.to_numpy(), max(1, most // width)
                for some in (slice(start, start + step) for start in range(0, len(line), step)):
                    first = np.flatnonzero(np.diff(line[some], prepend=-1))
                    real = (known[j[some]] > 0) & ok[some, None]
                    with np.errstate(invalid="ignore"):
                        out = np.add.reduceat(np.where(real, dense[j[some]] * v[some, None], 0), first)
                    at, c = np.nonzero(np.logical_or.reduceat(reached[j[some]] > 0, first))
                    none = ~np.logical_or.reduceat(real, first)
                    yield pa.RecordBatch.from_arrays(
                        [lines.dictionary.take(pa.array(line[some][first][at])), pa.array(c.astype(np.int32)), pa.array(out[at, c], mask=none[at, c])], names=["i", "c", "x"]
                    )

    entries = panelled(a).select("panel", F.col("i").cast("long").alias("i"), "j", F.col("v").cast("double").alias("v"))
    blocks = entries.repartitionByRange(parts(entries), "panel", "i").sortWithinPartitions("panel", "i").mapInArrow(pack, "panel bigint, i array<bigint>, j array<int>, v array<double>")
    panels = panelled(b.where("row is not null")).groupBy("panel").agg(F.collect_list(F.struct("j", F.col("row").cast("array<double>").alias("row"))).alias("rows"))
    part = blocks.join(panels, "panel").select("i", "j", "v", "rows").mapInArrow(multiply, "i bigint, c int, x double")
    return part.groupBy("i", "c").agg(F.sum("x").alias("x"))


def spmm_pattern(a: DataFrame, b: DataFrame, mapping: DataFrame, height: int) -> DataFrame:
    """Rows in panels of ``height``: the entries of a panel's column form a bit pattern, the mapping
    turns patterns into kernels, and each entry is multiplied by the first kernel that has its bit.

    ``mapping(pattern, kernels array<int>)`` needs a row for each pattern met; entries that no
    kernel covers would be lost, so a pattern without full cover is an error.
    """
    cells = F.sort_array(F.collect_list(F.struct((F.col("i") % height).cast("int").alias("bit"), "v")))
    panel = a.groupBy(F.floor(F.col("i") / height).cast("long").alias("p"), "j").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("i") % height).cast("int"))).alias("pattern"), cells.alias("cells")
    )
    mapped = panel.join(mapping.select("pattern", "kernels"), "pattern", "left")
    cover = F.aggregate(F.coalesce("kernels", F.array().cast("array<int>")), F.lit(0), lambda x, y: x.bitwiseOR(y))
    checked = mapped.withColumn(
        "kernels", F.when(F.col("pattern").bitwiseAND(F.bitwise_not(cover)) == 0, F.col("kernels")).otherwise(F.raise_error(F.lit("a pattern is not covered by its kernels")))
    )
    each = checked.select("p", "j", "cells", F.posexplode("kernels").alias("at", "kernel"), "kernels")
    before = F.aggregate(F.slice("kernels", F.lit(1), F.col("at")), F.lit(0), lambda x, y: x.bitwiseOR(y))
    mine = F.filter("cells", lambda cell: (F.getbit("kernel", cell["bit"]) == 1) & (F.getbit(before, cell["bit"]) == 0))
    met = each.select("p", "j", F.explode(mine).alias("cell")).select((F.col("p") * height + F.col("cell.bit")).alias("i"), "j", F.col("cell.v").alias("v"))
    return spmm_coord(met, b)


def split_dense(a: DataFrame, height: int, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Entries in tiles of a density above ``threshold``, and the rest (J13's semi and anti join)."""
    tiled = tiles(a, height, width)
    dense = tiled.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold * height * width).select("ti", "tj")
    keep = ["i", "j", "v"]
    return tiled.join(dense, ["ti", "tj"], "left_semi").select(keep), tiled.join(dense, ["ti", "tj"], "left_anti").select(keep)


def spmm_hybrid(a: DataFrame, b: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """Dense tiles and sparse remainder multiplied apart and added up."""
    dense, sparse = split_dense(a, height, width, threshold)
    return spmm_coord(dense, b).unionByName(spmm_coord(sparse, b)).groupBy("i", "c").agg(F.sum("x").alias("x"))


def spmm_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product from column gaps: ``a`` is encoded, decoded by running sums and multiplied."""
    return spmm_coord(delta_decode(delta_rows(a)), b)


#: Strategies by name; each takes ``(a, b, **options)``.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "coord": spmm_coord,
    "vector": spmm_vector,
    "blocked": spmm_blocked,
    "pattern": spmm_pattern,
    "hybrid": spmm_hybrid,
    "delta": spmm_delta,
}


def spmm(a: DataFrame, b: DataFrame, strategy: str = "coord", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](a, b, **options)


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dense ``a(i, row array)`` times ``b(j, c, w)``; zeros take part."""
    return spmm_coord(a.select("i", F.posexplode("row").alias("j", "v")), b)


def close(x: Column, y: Column, eps: float = DOUBLE_EPS, factor: float = 64) -> Column:
    """Equal within ``factor * eps``, relative to the larger side or absolute; a missing side is not."""
    gap = F.abs(x - y)
    return F.coalesce((gap < F.greatest(F.abs(x), F.abs(y)) * (factor * eps)) | (gap < factor * eps), F.lit(False))


def compare(x: DataFrame, y: DataFrame, eps: float = DOUBLE_EPS) -> DataFrame:
    """Both products side by side: ``i, c, left, right, ok``; a missing entry is zero."""
    met = x.select("i", "c", F.col("x").alias("left")).join(y.select("i", "c", F.col("x").alias("right")), ["i", "c"], "full")
    met = met.select("i", "c", F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(0.0)).alias("right"))
    return met.withColumn("ok", close(F.col("left"), F.col("right"), eps))


def mismatches(compared: DataFrame, limit: int = 32) -> DataFrame:
    """The first ``limit`` entries that differ, by row and column: a report, not a result."""
    return compared.where(~F.col("ok")).orderBy("i", "c").limit(limit)


def l1_norm(x: DataFrame, value: str = "x") -> DataFrame:
    return x.agg(F.sum(F.abs(value)).alias("l1"))


def weight_partition(lines: DataFrame, key: str, weight: str, parts: int) -> DataFrame:
    """Consecutive lines in ``parts`` groups of about equal weight, by their prefix sums."""
    total = F.greatest(lines.agg(F.sum(weight)).scalar(), F.lit(1))
    placed = exclusive_prefix(lines, weight, key, out="weight_before")
    part = F.least(F.floor(F.col("weight_before") * parts / total), F.lit(parts - 1)).cast("int")
    return placed.withColumn("part", part).drop("weight_before")
