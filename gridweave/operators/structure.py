"""Structure of sparse matrices: tiles, gaps, runs, entropy, storage and row distances.

Tiles, rows and columns without entries are never built; their zeros are added by arithmetic from
the sizes ``m`` and ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import sparsity
from gridweave.operators.matrix import line_counts, tiles
from gridweave.plans.prefix import dealt, exclusive_prefix, neighbours


def tile_count(m: int, k: int, height: int, width: int) -> int:
    return math.ceil(m / height) * math.ceil(k / width)


#: Words of 64 marks that one aggregate has for a side of a tile.
MOST_WORDS = 16


def _marks(at: Column, size: int) -> list[Column]:
    """Words of 64 bits that mark which places below ``size`` occur."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    return [F.bit_or(bit)] if size <= 64 else [F.bit_or(F.when(F.floor(at / 64) == word, bit)) for word in range(math.ceil(size / 64))]


def _marked(prefix: str, n: int) -> Column:
    out = F.lit(0).cast("bigint")
    for k in range(n):
        out = out + F.coalesce(F.bit_count(f"{prefix}{k}"), F.lit(0))
    return out


def tile_stats(nz: DataFrame, m: int, k: int, height: int, width: int) -> DataFrame:
    """One row for each non-empty tile: entries, active rows and columns, and its clipped size.

    Rows and columns are marked in words of 64 bits while entries are summed, so no entry is copied and no
    list of rows is held. Tiles of more than ``MOST_WORDS`` words a side are marked in bit maps by segments first.
    """
    cells = tiles(nz, height, width)
    if max(height, width) <= 64 * MOST_WORDS:
        rows, cols = _marks(F.col("i") % height, height), _marks(F.col("j") % width, width)
        marked = cells.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("nnz"), *[x.alias(f"r{k}") for k, x in enumerate(rows)], *[x.alias(f"c{k}") for k, x in enumerate(cols)])
        made = marked.select("ti", "tj", "nnz", _marked("r", len(rows)).alias("active_rows"), _marked("c", len(cols)).alias("active_cols"))
    else:
        made = cells.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("nnz"))
        for line, size, out in (("i", height, "active_rows"), ("j", width, "active_cols")):
            at = F.col(line) % size
            segments = cells.groupBy("ti", "tj", F.bitmap_bucket_number(at).alias("segment")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(at))).alias("n"))
            made = made.join(segments.groupBy("ti", "tj").agg(F.sum("n").alias(out)), ["ti", "tj"])
    return (
        made.withColumn("tile_h", F.least(F.lit(height), F.lit(m) - F.col("ti") * height).cast("int"))
        .withColumn("tile_w", F.least(F.lit(width), F.lit(k) - F.col("tj") * width).cast("int"))
    )


def tile_shares(stats: DataFrame) -> DataFrame:
    """Density and shares of active rows and columns, over the clipped sizes."""
    return stats.select(
        "ti", "tj", "nnz",
        (F.col("nnz") / (F.col("tile_h") * F.col("tile_w"))).alias("density"),
        (F.col("active_rows") / F.col("tile_h")).alias("active_row_share"),
        (F.col("active_cols") / F.col("tile_w")).alias("active_col_share"),
    )


def unit_histogram(df: DataFrame, value: str, bins: int = 50, empty: int = 0) -> DataFrame:
    """Counts of values in [0, 1] by ``bins`` equal bins, the last one closed; ``empty`` more zeros."""
    place = F.least(F.width_bucket(F.col(value), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)) - 1
    found = df.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    if not empty:
        return found
    zero = df.sparkSession.range(1).select(F.lit(0).alias("bin"), F.lit(empty).cast("long").alias("cnt"))
    return found.unionByName(zero).groupBy("bin").agg(F.sum("cnt").alias("cnt"))


def working_sets(stats: DataFrame, height: int, width: int) -> DataFrame:
    """Bytes that a product touches for each tile: entries at the nominal size, panel, rows of B and C."""
    shares = tile_shares(stats)
    ws = (
        F.col("density") * (2 * height * width)
        + F.lit(height)
        + F.col("active_row_share") * (256 * height)
        + F.col("active_col_share") * (256 * width)
    )
    return shares.select("ti", "tj", ws.alias("ws"))


def moments_with_zeros(df: DataFrame, value: str, total: int, sample: bool = False) -> DataFrame:
    """``mean, std, cov`` of a column to which zeros are added up to ``total`` values."""
    sums = df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0)).alias("q"))
    mean = F.col("s") / F.lit(float(total))
    spread = F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0)) / F.lit(float(total - 1 if sample else total))
    return sums.select(mean.alias("mean"), F.sqrt(spread).alias("std"), F.try_divide(F.sqrt(spread), mean).alias("cov"))


def run_lengths(nz: DataFrame) -> DataFrame:
    """Mean, smallest and largest column gap; a row's first gap counts from column 0."""
    gap = F.col("j") - F.coalesce("previous", F.lit(0))
    return neighbours(nz.select("i", "j"), "j", ["i"]).select(gap.alias("gap")).agg(F.avg("gap").alias("avg_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def ordinals(nz: DataFrame) -> DataFrame:
    """Adds ``q``, the place of an entry in its row, from 0."""
    return exclusive_prefix(nz, F.lit(1), "j", by=["i"], out="q").withColumn("q", F.col("q").cast("int"))


def row_differences(nz: DataFrame) -> DataFrame:
    """Column difference of entries of one place in neighbouring rows; the last row gives none."""
    placed = ordinals(nz).select("i", "j", "q")
    below = placed.select((F.col("i") - 1).alias("i"), "q", F.col("j").alias("below"))
    return placed.join(below, ["i", "q"]).select("i", "q", (F.col("below") - F.col("j")).alias("dj"))


def stride_runs(nz: DataFrame, longest: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """``(bin, cnt)``: runs of equal column differences in rows; a run is cut after ``longest``
    differences, and the entry after a cut starts anew, so a cut run takes ``longest + 1`` of them.
    The bin is the run's length less one."""
    keys = [*by, "i"]
    step = neighbours(nz.select(*keys, "j"), "j", keys).where("following is not null")
    # A run starts where the difference is not that of the entry before.
    start = F.coalesce(((F.col("following") - F.col("j")) != (F.col("j") - F.col("previous"))).cast("int"), F.lit(1))
    runs = exclusive_prefix(step.withColumn("start", start), "start", "j", by=keys, out="before")
    lengths = runs.groupBy(*keys, (F.col("before") + F.col("start")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    # A cut run is some whole pieces and what is left of it.
    whole, rest = F.floor(F.col("n") / (longest + 1)), F.col("n") % (longest + 1)
    pieces = F.array(F.struct(F.lit(longest - 1).alias("bin"), whole.alias("cnt")), F.struct((rest - 1).cast("int").alias("bin"), (rest > 0).cast("long").alias("cnt")))
    each = lengths.select(*by, F.explode(pieces).alias("x")).where("x.cnt > 0")
    return each.groupBy(*by, F.col("x.bin").alias("bin")).agg(F.sum("x.cnt").alias("cnt"))


def weighted_shares(hist: DataFrame, key: str, weight: str = "bin", count: str = "cnt") -> DataFrame:
    """A histogram's counts times its bins, as shares of each ``key``."""
    mass = F.col(weight) * F.col(count)
    return hist.withColumn("share", F.try_divide(mass.cast("double"), F.sum(mass).over(Window.partitionBy(key))))


def ell_padding(nz: DataFrame, m: int) -> DataFrame:
    """Zeros that rows need to reach the longest one."""
    rows = nz.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return rows.agg((F.coalesce(F.max("n"), F.lit(0)) * m - F.coalesce(F.sum("n"), F.lit(0))).alias("padding"))


def line_cov(nz: DataFrame, size: int, axis: str) -> DataFrame:
    """Population deviation over mean of the entries per row or column, empty ones included."""
    found = nz.groupBy(axis).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return moments_with_zeros(found, "n", size).select(F.col("cov"))


def tile_rows(nz: DataFrame, height: int, width: int) -> DataFrame:
    """Entries of each row of each tile, without the empty ones."""
    return dealt(tiles(nz, height, width), "ti", "tj").groupBy("ti", "tj", "i").agg(F.count(F.lit(1)).alias("n"))


def entropy(rows: DataFrame) -> DataFrame:
    """Entropy of entries over tile rows, as a share of ln(nnz)."""
    total = rows.agg(F.sum("n").alias("nnz"), F.sum(F.col("n") * F.log("n")).alias("s"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    return total.select(F.try_divide(F.log("nnz") - F.col("s") / F.col("nnz"), F.log("nnz")).alias("h_norm"))


def spread_factor(nz: DataFrame, m: int, height: int, width: int) -> DataFrame:
    """Mean share of non-empty tile rows in a strip, times entries per row, times 1 - entropy."""
    rows = tile_rows(nz, height, width)
    strips = math.ceil(m / height)
    one = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("nnz"), F.sum(F.col("n") * F.log("n")).alias("s"))
    h = F.try_divide(F.log("nnz") - F.col("s") / F.col("nnz"), F.log("nnz"))
    return one.select((F.col("r") / strips / m * (F.col("nnz") / m) * (1 - h)).alias("ssf"))


def column_overlap(stats: DataFrame, total: int) -> DataFrame:
    """Mean, and variance over mean, of ``(nnz - active columns) / nnz`` over all tiles."""
    share = stats.select(((F.col("nnz") - F.col("active_cols")) / F.col("nnz")).alias("x"))
    moments = moments_with_zeros(share, "x", total)
    return moments.select(F.col("mean").alias("col_ovl_mean"), F.try_divide(F.col("std") * F.col("std"), F.col("mean")).alias("col_ovl_spread"))


def dense_share(stats: DataFrame, height: int, width: int, threshold: float = 0.35) -> DataFrame:
    """Share of entries in tiles whose nominal density is above the threshold, and their number."""
    dense = F.col("nnz") > threshold * height * width
    return stats.agg(
        (F.sum(F.when(dense, F.col("nnz")).otherwise(0)) / F.sum("nnz")).alias("dense_ratio"), F.count_if(dense).alias("dense_tiles")
    )


def tile_ell_padding(nz: DataFrame, height: int, width: int) -> DataFrame:
    """Padding of each tile to its longest row at the nominal height, as a share of all entries."""
    per_tile = tile_rows(nz, height, width).groupBy("ti", "tj").agg((F.max("n") * height - F.sum("n")).alias("pad"), F.sum("n").alias("nnz"))
    return per_tile.agg((F.sum("pad") / F.sum("nnz")).alias("tile_ell_padding"))


def properties(nz: DataFrame, m: int, k: int, height: int, width: int) -> DataFrame:
    """The property record of a matrix as one row.

    Each part is an aggregate of its own; scalar subqueries put them side by side.
    """
    stats, rows = tile_stats(nz, m, k, height, width), tile_rows(nz, height, width)
    total, volume = tile_count(m, k, height, width), float(height * width)
    fill = moments_with_zeros(stats.select((F.col("nnz") / volume).alias("x")), "x", total)
    overlap, dense = column_overlap(stats, total), dense_share(stats, height, width)
    parts: dict[str, Column] = {
        "nnz": nz.agg(F.count(F.lit(1))).scalar(),
        "row_cov": line_cov(nz, m, "i").scalar(),
        "col_cov": line_cov(nz, k, "j").scalar(),
        "ell_padding": ell_padding(nz, m).scalar(),
        "h_norm": entropy(rows).scalar(),
        "ssf": spread_factor(nz, m, height, width).scalar(),
        "tile_fill_mean": fill.select("mean").scalar(),
        "tile_fill_cov": fill.select("cov").scalar(),
        "tile_fill_max": stats.agg(F.max(F.col("nnz") / volume)).scalar(),
        "tile_fill_min": stats.agg(F.when(F.count(F.lit(1)) < total, F.lit(0.0)).otherwise(F.min(F.col("nnz") / volume))).scalar(),
        "empty_tiles": stats.agg(F.lit(total) - F.count(F.lit(1))).scalar(),
        "col_ovl_mean": overlap.select("col_ovl_mean").scalar(),
        "col_ovl_spread": overlap.select("col_ovl_spread").scalar(),
        "tile_ell_padding": tile_ell_padding(nz, height, width).scalar(),
        "dense_ratio": dense.select("dense_ratio").scalar(),
        "dense_tiles": dense.select("dense_tiles").scalar(),
    }
    one = nz.sparkSession.range(1)
    return one.select(F.lit(m).alias("m"), F.lit(k).alias("k"), *[c.alias(n) for n, c in parts.items()])


def csr_bytes(nnz: Column, m: Column) -> Column:
    return nnz * 8 + (m + 1) * 4


def storage(nz: DataFrame, m: int, k: int, block: int) -> DataFrame:
    """Bytes of CSR and of block CSR, and CSR's share of the dense matrix."""
    blocks = tiles(nz, block, block).groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("n"))
    one = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("nnz"))
    csr = csr_bytes(F.col("nnz"), F.lit(m))
    return one.select(
        "nnz",
        csr.alias("csr_bytes"),
        (csr / F.lit(float(m * k * 4))).alias("csr_share"),
        (F.col("blocks") * (block * block * 4 + 4) + (math.ceil(m / block) + 1) * 4).alias("bsr_bytes"),
    )


def consecutive_distances(nz: DataFrame, m: int) -> DataFrame:
    """``(i, both, size, next_size)`` for each row and the one below, from shared columns and sizes.

    Rows are neighbours by number, so the join is on ``(i + 1, j)`` and never forms pairs of a column.
    """
    shared = nz.select("i", "j").join(nz.select((F.col("i") - 1).alias("i"), "j"), ["i", "j"]).groupBy("i").agg(F.count(F.lit(1)).alias("both"))
    sizes = line_counts(nz, m, "i").withColumnRenamed("line", "i").withColumnRenamed("n", "size")
    below = sizes.select((F.col("i") - 1).alias("i"), F.col("size").alias("next_size"))
    return sizes.join(below, "i").join(shared, "i", "left").select("i", F.coalesce("both", F.lit(0)).alias("both"), "size", "next_size")


def hamming(both: Column, size: Column, other: Column) -> Column:
    return size + other - 2 * both


def jaccard_distance(both: Column, size: Column, other: Column) -> Column:
    return F.coalesce(1 - F.try_divide(both.cast("double"), size + other - both), F.lit(0.0))


def panel_distances(nz: DataFrame, m: int, height: int = 16) -> DataFrame:
    """Sum of Hamming distances of neighbouring rows in each panel; the last panel is cut short."""
    near = consecutive_distances(nz, m)
    inside = near.where(F.floor(F.col("i") / height) == F.floor((F.col("i") + 1) / height))
    panels = inside.groupBy(F.floor(F.col("i") / height).alias("p")).agg(F.sum(hamming(F.col("both"), F.col("size"), F.col("next_size"))).alias("distance"))
    n = math.ceil(m / height)
    return panels.agg(
        (F.coalesce(F.sum("distance"), F.lit(0)) / n).alias("avg_distance"), F.coalesce(F.sum("distance"), F.lit(0)).alias("total_distance")
    ).withColumn("num_panels", F.lit(n)).withColumn("panel_height", F.lit(height))


def panel_overlap(nz: DataFrame, height: int = 16) -> DataFrame:
    """Per panel: entries that share their column with another row of it, as a share of its entries."""
    return (
        nz.groupBy(F.floor(F.col("i") / height).cast("long").alias("p"))
        .agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("j").alias("cols"))
        .select("p", ((F.col("nnz") - F.col("cols")) / F.col("nnz")).alias("overlap"))
    )


def row_pairs(nz: DataFrame, rows: DataFrame) -> DataFrame:
    """``(i1, i2, both, size1, size2)`` for the pairs of ``rows(i)`` that share a column.

    The stated rows are a bounded set, such as one panel; all pairs of a matrix's rows are not formed.
    Pairs without a shared column have ``both`` 0 and are left to the caller's arithmetic.
    """
    mine = nz.join(rows.select("i"), "i", "left_semi").select("i", "j")
    sizes = mine.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    left, right = mine.select(F.col("i").alias("i1"), "j"), mine.select(F.col("i").alias("i2"), "j")
    both = left.join(right, "j").where("i1 < i2").groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("both"))
    return both.join(sizes.select(F.col("i").alias("i1"), F.col("n").alias("size1")), "i1").join(
        sizes.select(F.col("i").alias("i2"), F.col("n").alias("size2")), "i2"
    ).select("i1", "i2", "both", "size1", "size2")


def panel_pairs(nz: DataFrame, m: int | None, height: int = 16) -> DataFrame:
    """``(p, i1, i2, both, size1, size2)`` for all pairs of rows inside each panel of ``height`` rows of
    the whole matrix, those without a shared column (``both`` 0) and, if ``m`` is given, empty rows included.

    The join is on panel and column, so a column adds at most ``height * (height - 1) / 2`` pairs a panel.
    """
    panel = F.floor(F.col("i") / height).cast("long").alias("p")
    mine = nz.select(panel, F.col("i").cast("long").alias("i"), "j")
    left, right = mine.select("p", "j", F.col("i").alias("i1")), mine.select("p", "j", F.col("i").alias("i2"))
    both = left.join(right, ["p", "j"]).where("i1 < i2").groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("both"))
    if m is None:
        sizes = mine.groupBy("p", "i").agg(F.count(F.lit(1)).alias("n"))
    else:
        sizes = line_counts(nz, m, "i").select(F.col("line").cast("long").alias("i"), "n").select(panel, "i", "n")
    first = sizes.select("p", F.col("i").alias("i1"), F.col("n").alias("size1"))
    pairs = first.join(sizes.select("p", F.col("i").alias("i2"), F.col("n").alias("size2")), "p").where("i1 < i2")
    return pairs.join(both, ["i1", "i2"], "left").select("p", "i1", "i2", F.coalesce("both", F.lit(0)).alias("both"), "size1", "size2")


def greedy_order(nz: DataFrame, height: int) -> DataFrame:
    """Rows of each panel of ``height`` rows in nearest-neighbour order: from its first row on, always
    the nearest row not yet placed, by Hamming distance, ties to the smaller row. ``(p, i, place)``.

    The walk is sequential, so it runs panel by panel; it sees the distances of a panel's pairs only.
    """
    import pandas as pd

    def walk(panel: pd.DataFrame) -> pd.DataFrame:
        distance = {(int(r.i1), int(r.i2)): int(r.distance) for r in panel.itertuples()}
        left = sorted({r for pair in distance for r in pair})
        order = [left.pop(0)]
        while left:
            here = order[-1]
            nearest = min(left, key=lambda r: (distance[min(here, r), max(here, r)], r))
            order.append(nearest)
            left.remove(nearest)
        return pd.DataFrame({"p": int(panel.p.iloc[0]), "i": order, "place": range(len(order))})

    rows = nz.select(F.col("i").cast("long").alias("i"), "j").distinct()
    pairs = panel_pairs(rows, None, height).select("p", "i1", "i2", hamming(F.col("both"), F.col("size1"), F.col("size2")).alias("distance"))
    alone = rows.groupBy("i").agg(F.lit(0).cast("long").alias("distance"))  # panels of one row have no pair
    alone = alone.select(F.floor(F.col("i") / height).cast("long").alias("p"), F.col("i").alias("i1"), F.col("i").alias("i2"), "distance")
    return pairs.unionByName(alone).groupBy("p").applyInPandas(walk, "p long, i long, place int")


def normalised_run_lengths(nz: DataFrame, k: int) -> DataFrame:
    """Mean and largest column gap as shares of the number of columns."""
    return run_lengths(nz).select((F.col("avg_gap") / k).alias("avg_share"), (F.col("max_gap") / F.lit(float(k))).alias("max_share"))


def histogram_by_range(nz: DataFrame, shapes: DataFrame, height: int, width: int, range_of, bins: int = 50) -> DataFrame:
    """``(range, bin, cnt)``: tile densities of many matrices together, by the range of each matrix's
    sparsity. ``nz(matrix_id, i, j)``, ``shapes(matrix_id, m, k)``; ``range_of`` maps a sparsity to a range.
    Empty tiles are counted in bin 0.
    """
    tile = nz.groupBy("matrix_id", F.floor(F.col("i") / height).alias("ti"), F.floor(F.col("j") / width).alias("tj")).agg(F.count(F.lit(1)).alias("nnz"))
    tile = tile.join(shapes, "matrix_id")
    rows, cols = F.least(F.lit(height), F.col("m") - F.col("ti") * height), F.least(F.lit(width), F.col("k") - F.col("tj") * width)
    place = F.least(F.width_bucket(F.col("nnz") / (rows * cols), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)) - 1
    found = tile.groupBy("matrix_id", "m", "k", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.sum("nnz").alias("nnz"))
    whole = found.groupBy("matrix_id", "m", "k").agg(F.sum("cnt").alias("filled"), F.sum("nnz").alias("nnz"))
    whole = whole.withColumn("range", range_of(sparsity(F.col("nnz"), F.col("m"), F.col("k"))))
    empty = (F.ceil(F.col("m") / height) * F.ceil(F.col("k") / width) - F.col("filled")).cast("bigint").alias("cnt")
    parts = found.join(whole.select("matrix_id", "range"), "matrix_id").select("range", "bin", "cnt").unionByName(whole.select("range", F.lit(0).alias("bin"), empty))
    return parts.groupBy("range", "bin").agg(F.sum("cnt").alias("cnt"))


def pooled_shares(hists: DataFrame, key: str, weight: str = "bin", count: str = "cnt") -> DataFrame:
    """Weighted shares of each ``key``'s histogram, summed over keys and brought to 1 again."""
    summed = weighted_shares(hists, key, weight, count).groupBy(weight).agg(F.sum("share").alias("s"))
    return summed.select(weight, F.try_divide("s", summed.agg(F.sum("s")).scalar()).alias("share"))
