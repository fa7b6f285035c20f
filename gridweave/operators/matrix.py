"""Sparse matrices as coordinate tables ``(i, j, v)``, 0-based; sizes come from metadata.

``by`` names key columns, such as a matrix id, that tell many matrices of one table apart.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.plans.prefix import dealt, exclusive_prefix, neighbours


def coo(df: DataFrame, i: str, j: str, v: Column | str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(v) if isinstance(v, str) else v
    return df.select(*by, F.col(i).alias("i"), F.col(j).alias("j"), v.alias("v"))


def coalesce(nz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds up the values of repeated coordinates. Few repeat, so rows are dealt before they are added up: a table of
    all coordinates of a split of the files would save no shuffle."""
    return dealt(nz, *by, "i", "j").groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def transpose(nz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return nz.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mirror(nz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entries of a symmetric matrix whose file stores one triangle."""
    pair = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return nz.select(*by, F.explode(pair).alias("p"), "v").select(*by, "p.i", "p.j", "v")


def line_counts(nz: DataFrame, size: int, axis: str = "i", by: Sequence[str] = ()) -> DataFrame:
    """``(line, n)``: entries of every row (``axis`` i) or column (j), empty ones included."""
    if by:
        raise ValueError("counts with empty lines are for one matrix")
    found = nz.groupBy(F.col(axis).cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return nz.sparkSession.range(size).withColumnRenamed("id", "line").join(found, "line", "left").select("line", F.coalesce("n", F.lit(0)).alias("n"))


def pointers(nz: DataFrame, size: int, axis: str = "i") -> DataFrame:
    """``(line, ptr)`` for 0..size: the row pointers of CSR, or the column pointers of CSC."""
    return exclusive_prefix(line_counts(nz, size + 1, axis), "n", "line", out="ptr").select("line", "ptr")


def delta_encode(nz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Column gaps of each row, the first from column 0."""
    return neighbours(nz.select(*by, "i", "j"), "j", [*by, "i"]).select(*by, "i", "j", (F.col("j") - F.coalesce("previous", F.lit(0))).alias("gap"))


def delta_rows(nz: DataFrame) -> DataFrame:
    """``(i, q, gap, v)``: a row's entries by place, with column gaps in place of columns."""
    placed = exclusive_prefix(nz.select("i", "j", "v"), F.lit(1), "j", by=["i"], out="q")
    return neighbours(placed, "j", ["i"]).select("i", "q", (F.col("j") - F.coalesce("previous", F.lit(0))).alias("gap"), "v")


def delta_decode(coded: DataFrame) -> DataFrame:
    """Entries ``(i, j, v)`` of :func:`delta_rows`: columns are the running sums of the gaps."""
    return exclusive_prefix(coded, "gap", "q", by=["i"], out="before").select("i", (F.col("before") + F.col("gap")).alias("j"), "v")


def density_order(nz: DataFrame, size: int, axis: str = "j") -> DataFrame:
    """``(line, n, place)``: lines by ascending number of entries, ties by index; empty ones first."""
    counts = line_counts(nz, size, axis)
    return exclusive_prefix(counts, F.lit(1), "line", coarse=["n"], out="place").select("line", "n", "place")


def tiles(nz: DataFrame, height: int, width: int) -> DataFrame:
    """Adds the tile coordinates ``(ti, tj)``."""
    return nz.withColumn("ti", F.floor(F.col("i") / height).cast("long")).withColumn("tj", F.floor(F.col("j") / width).cast("long"))


def random_matrix(spark, m: int, k: int, sparsity: float, seed: int = 0) -> DataFrame:
    """Entries drawn by a hash of their place: the same matrix on any cluster."""
    place = spark.range(m * k)
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    value = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return place.where(share < 1 - sparsity).select(F.floor(F.col("id") / k).alias("i"), (F.col("id") % k).alias("j"), value.alias("v"))


def codelet_widths(codes: Sequence[tuple[int, float]], width: int, lower: bool = True) -> list[tuple[int, int]]:
    """``(code, columns)`` of a panel of ``width`` columns: ``max(floor(p * width), 1)`` each, without the
    empty code; what is missing or over is dealt one by one in the order of the codes, and no code goes
    below one column. Without ``lower`` what is over stays, in a wider panel."""
    held = [(code, max(int(p * width), 1)) for code, p in codes if code]
    if len(held) > width and lower:
        raise ValueError("there are more codes than columns")
    over = sum(n for _, n in held) - width
    if over <= 0:
        each, first = divmod(-over, max(1, len(held)))
        return [(code, n + each + (k < first)) for k, (code, n) in enumerate(held)]
    if not lower:
        return held
    # As many whole rounds as fit, in which a code of one column gives none; the rest come from the first codes that have more.
    taken = lambda rounds: sum(min(n - 1, rounds) for _, n in held)
    rounds = bisect_right(range(1, width + 1), over, key=taken)
    more, out = over - taken(rounds), []
    for code, n in held:
        one = n - 1 > rounds and more > 0
        out.append((code, n - min(n - 1, rounds) - one))
        more -= one
    return out


def codelet_matrix(spark, codes: Sequence[tuple[int, float]], height: int, width: int, lower: bool = True) -> DataFrame:
    """A synthetic panel of codes ``(bit pattern, probability)``, side by side in their order; bit 0 is
    the first row. At most ``2 ** height`` codes, whose widths (:func:`codelet_widths`) are dealt on the driver."""
    share = codelet_widths(codes, width, lower)
    runs = [(code, sum(n for _, n in share[:at]), sum(n for _, n in share[: at + 1])) for at, (code, _) in enumerate(share)]
    panel = spark.createDataFrame(runs, "code long, first long, stop long")
    column = panel.select("code", F.explode(F.sequence("first", F.col("stop") - 1)).alias("j"))
    rows = F.filter(F.sequence(F.lit(0), F.lit(height - 1)), lambda b: F.getbit("code", b) == 1)
    return column.select(F.explode(rows).alias("i"), "j").select(F.col("i").cast("long").alias("i"), "j", F.lit(1.0).alias("v"))


def ones_panel(spark, nnz: int, cols: int) -> DataFrame:
    """A synthetic panel of ``cols`` columns whose first ``nnz`` rows are set."""
    return spark.range(cols).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nnz - 1).cast("long"))).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def by_value(nz: DataFrame) -> DataFrame:
    """Entries by ascending value, ties by place."""
    return nz.orderBy("v", "i", "j")
