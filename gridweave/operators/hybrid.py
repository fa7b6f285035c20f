"""Splitting a matrix into dense rectangles of tiles and a sparse rest.

Rectangles are found relationally from the table of non-empty tiles: runs of neighbouring dense tiles
are islands, equal runs of neighbouring tile rows are islands again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import materialise


def dense_tiles(stats: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    """Tiles whose nominal density is above the threshold."""
    return stats.where(F.col("nnz") > threshold * height * width).select("ti", "tj", "nnz")


def row_rectangles(dense: DataFrame) -> DataFrame:
    """``(ti, tj, tiles, nnz)``: runs of neighbouring dense tiles of one tile row, from ``tj`` on."""
    island = F.col("tj") - F.row_number().over(Window.partitionBy("ti").orderBy("tj"))
    runs = dense.withColumn("island", island).groupBy("ti", "island")
    return runs.agg(F.min("tj").alias("tj"), F.count(F.lit(1)).alias("tiles"), F.sum("nnz").alias("nnz")).drop("island")


def merged_rectangles(dense: DataFrame) -> DataFrame:
    """``(ti, tj, rows, tiles, nnz)``: runs of the same columns in neighbouring tile rows as one rectangle."""
    runs = row_rectangles(dense)
    island = F.col("ti") - F.row_number().over(Window.partitionBy("tj", "tiles").orderBy("ti"))
    merged = runs.withColumn("island", island).groupBy("tj", "tiles", "island")
    return merged.agg(F.min("ti").alias("ti"), F.count(F.lit(1)).alias("rows"), F.sum("nnz").alias("nnz")).select("ti", "tj", "rows", "tiles", "nnz")


def corner_square(stats: DataFrame, tile_rows: int, tile_cols: int, share: float) -> DataFrame:
    """``(side, nnz)`` of the smallest square of tiles at the bottom right that holds ``share`` of all
    entries: where a density order moves the dense part. Rings are at most as many as tile rows or columns.
    """
    ring = F.greatest(F.lit(tile_rows - 1) - F.col("ti"), F.lit(tile_cols - 1) - F.col("tj"))
    rings = stats.groupBy(ring.alias("ring")).agg(F.sum("nnz").alias("nnz"))
    total = stats.agg(F.sum("nnz")).scalar()
    grown = rings.withColumn("held", F.sum("nnz").over(Window.orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)))
    enough = grown.where(F.col("held") >= F.lit(share) * total)
    return enough.agg(F.min(F.struct("ring", "held")).alias("x")).select((F.col("x.ring") + 1).alias("side"), F.col("x.held").alias("nnz"))


def rectangle_lines(rectangles: DataFrame, height: int, width: int) -> DataFrame:
    """Lines ``x,y,rows,cols`` of an export of rectangles, in entries."""
    return rectangles.select(F.concat_ws(",", F.col("ti") * height, F.col("tj") * width, F.col("rows") * height, F.col("tiles") * width).alias("value"))


def hybrid_record(stats: DataFrame, height: int, width: int, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: dense tiles, entries in them, zeros padded and the share of all entries."""
    volume = height * width
    each = stats.select("nnz", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    dense = F.col("nnz") > F.col("threshold") * volume
    return each.groupBy("threshold").agg(
        F.count_if(dense).alias("dense_tiles"),
        F.sum(F.when(dense, F.col("nnz")).otherwise(0)).alias("dense_nnz"),
        F.sum(F.when(dense, F.lit(volume) - F.col("nnz")).otherwise(0)).alias("padding"),
        (F.sum(F.when(dense, F.col("nnz")).otherwise(0)) / F.sum("nnz")).alias("dense_ratio"),
    )


def hybrid_records(stats: DataFrame, sizes: DataFrame, height: int, width: int, thresholds: Sequence[float], times: DataFrame) -> DataFrame:
    """One record for each matrix, density threshold and row of ``times``: counts of the split beside the
    measured times, and the speed-up of the best hybrid form over the dense product.

    ``stats(matrix_id, nnz)`` has the non-empty tiles, ``sizes(matrix_id, m, k)`` the matrices, and
    ``times(matrix_id, threshold, b_cols, spmm, gemm, sparse_<form>, dense_<form>)`` the measurements of
    the forms ``blocked``, ``sep`` and ``full``; the hybrid time of a form is the sum of its two parts.
    """
    volume = height * width
    each = stats.select("matrix_id", "nnz", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    dense = F.col("nnz") > F.col("threshold") * volume
    split = each.groupBy("matrix_id", "threshold").agg(
        F.sum("nnz").alias("nnz"),
        F.count(F.lit(1)).alias("filled"),
        F.sum(F.when(dense, F.lit(volume) - F.col("nnz")).otherwise(0)).alias("padding"),
        F.sum(F.when(dense, F.col("nnz")).otherwise(0)).alias("dense_nnz"),
        F.count_if(dense).alias("dense_tiles"),
        F.min("nnz").alias("least"),
        F.max("nnz").alias("most"),
    )
    tiles = F.ceil(F.col("m") / height) * F.ceil(F.col("k") / width)
    record = split.join(sizes, "matrix_id").select(
        "matrix_id", "m", "k", "nnz", "threshold", "padding", "dense_tiles",
        F.lit(f"{height}x{width}").alias("tile_shape"),
        F.lit(volume).alias("tile_vol"),
        F.when(F.col("filled") < tiles, F.lit(0.0)).otherwise(F.col("least") / volume).alias("tile_nnz_pct_min"),
        (F.col("most") / volume).alias("tile_nnz_pct_max"),
        (F.col("nnz") / volume / tiles).alias("tile_nnz_pct_mean"),
        (F.col("dense_nnz") / F.col("nnz")).alias("dense_ratio"),
    )
    made = record.join(times, ["matrix_id", "threshold"])
    forms = ("blocked", "sep", "full")
    for form in forms:
        made = made.withColumn(f"total_{form}", F.col(f"sparse_{form}") + F.col(f"dense_{form}"))
    return made.withColumn("speedup", F.greatest(*[F.try_divide("gemm", f"total_{form}") for form in forms]))


def best_records(records: DataFrame) -> DataFrame:
    """The record of the largest speed-up for each matrix and width of B; ties to the smaller threshold."""
    order = Window.partitionBy("matrix_id", "b_cols").orderBy(F.desc("speedup"), "threshold")
    return records.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def entry_rectangles(nz: DataFrame, rectangles: DataFrame) -> DataFrame:
    """``nz`` with ``rectangle``, the largest of ``rectangles(rectangle, i0, i1, j0, j1)`` (ends excluded) that holds the entry,
    ties to the smaller number; null in the remainder. Rectangles stand anywhere and may overlap.

    The range join is made of equalities: a rectangle has the grid of the powers of two that its sides do not
    exceed, where it meets four cells at most, and an entry has one cell in each grid that occurs. Grids are
    at most the product of the sides' bit lengths, whatever the matrix; a bit filter of the rectangles' cells drops most of an
    entry's cells before the join. Entries of one place are told from
    each other by nothing and share their rectangle; rectangles without an area, and nulls, hold nothing.
    """
    held = rectangles.where("i0 < i1 and j0 < j1")
    side = lambda low, high: F.ceil(F.log2((F.col(high) - F.col(low)).cast("double"))).cast("int")
    held = materialise(held.select("rectangle", "i0", "i1", "j0", "j1", side("i0", "i1").alias("gi"), side("j0", "j1").alias("gj")), "rectangles")
    grids = held.select("gi", "gj").distinct().collect()
    if not grids:
        return nz.withColumn("rectangle", F.lit(None).cast(rectangles.schema["rectangle"].dataType))
    at = lambda c, g: F.call_function("shiftright", F.col(c).cast("bigint"), F.col(g))
    # Sides are at most the grid's, so a rectangle begins and ends in the same cell or in neighbouring ones.
    cell = lambda low, high, g: F.explode(F.sequence(at(low, g), F.call_function("shiftright", (F.col(high) - 1).cast("bigint"), F.col(g))))
    cells = materialise(held.withColumn("ci", cell("i0", "i1", "gi")).withColumn("cj", cell("j0", "j1", "gj")), "cells")
    place = F.xxhash64("gi", "gj", "ci", "cj")
    bits, words = build_filter(cells.select(place.alias("place")), "place", cells.count())
    each = nz.select("i", "j", F.explode(F.array(*[F.struct(F.lit(x.gi).alias("gi"), F.lit(x.gj).alias("gj")) for x in grids])).alias("g")).select("i", "j", "g.gi", "g.gj")
    each = each.withColumn("ci", at("i", "gi")).withColumn("cj", at("j", "gj")).where(maybe(place, bits, words))
    met = each.join(cells, ["gi", "gj", "ci", "cj"]).where("i >= i0 and i < i1 and j >= j0 and j < j1")
    area = -((F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0")))
    best = met.groupBy("i", "j").agg(F.min(F.struct(area.alias("less"), "rectangle")).alias("x")).select("i", "j", "x.rectangle")
    return nz.join(best, ["i", "j"], "left")
