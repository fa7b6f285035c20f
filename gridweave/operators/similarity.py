"""Exact similarity self-join of the rows of a sparse matrix, as sets of columns.

Rows of equal columns form a class; one row stands for all of them, so copies never make pairs. The
columns of a row are put in one global order, rarest first. Two rows of Jaccard similarity ``t`` or more
share at least ``t * size`` columns of either, so the k-th column that they share is among the first
``size - ceil(t * size) + k`` of both (prefix filter), and their sizes differ by a factor of ``1 / t`` at most.

A pair therefore meets at its first shared column. Where too many rows have that column in their prefix,
they meet at the first two shared columns instead, and so on: a key that is too common is extended by a
column before any pair is formed, so a hot column's pairs are never formed. What meets is compared exactly.

A row's columns are one array, so a row has at most as many entries as the matrix has columns. Rows
without entries are no rows here; nulls take no part. An empty matrix gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.plans.staging import materialise

#: Rows of a key from which it is extended, and columns of the longest key.
COMMON, DEPTH = 200, 4


def row_sets(nz: DataFrame) -> DataFrame:
    """``(i, columns)`` of ``nz(i, j)``: ranks of the row's columns by how many rows have them, rarest first."""
    cells = nz.select("i", "j").where("i is not null and j is not null").distinct()
    held = cells.groupBy("j").agg(F.count(F.lit(1)).alias("held"))
    # The order of columns needs no dense ranks: the pair of count and column is the rank.
    ranked = cells.join(held, "j").select("i", F.struct("held", "j").alias("rank"))
    return ranked.groupBy("i").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).select("i", F.col("ranks.j").alias("columns"))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(i, class_id)``, the smallest row of equal columns; and the columns of one row of each class."""
    named = sets.select("i", "columns", F.unhex(F.md5(F.to_json("columns"))).alias("digest"))
    first = named.groupBy("digest").agg(F.min("i").alias("class_id"))
    held = materialise(named.join(first, "digest").select("i", "class_id", "columns"), "classes")
    return held.select("i", "class_id"), held.where("i = class_id").select("i", "columns")


def _required(size: Column, threshold: float) -> Column:
    """Columns that a row shares with any similar one; rounding may ask for one too few, never too many."""
    return F.greatest(F.lit(1), F.ceil(size * F.lit(threshold) - 1e-9)).cast("int")


def candidates(sets: DataFrame, threshold: float, common: int = COMMON, depth: int = DEPTH) -> DataFrame:
    """``(i1, i2)``, ``i1 < i2``, each once: all pairs that can reach the threshold."""
    size = F.size("columns")
    rows = sets.select("i", size.alias("n"), _required(size, threshold).alias("needs"), "columns")
    # Keys are the first columns that are shared, as an array, and where the last one stands in the row.
    at = F.explode(F.sequence(F.lit(1), F.col("n") - F.col("needs") + 1))
    keys = rows.select("i", "n", "needs", at.alias("at"), "columns")
    keys = keys.select("i", "n", "needs", "at", F.array(F.element_at("columns", F.col("at"))).alias("key"), "columns")
    made = None
    for level in range(1, depth + 1):
        keys = materialise(keys, "prefix-keys")
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        last = level == depth
        settled = keys if last else keys.join(counts.where(F.col("rows") <= common), "key", "left_semi")
        pairs = _meet(settled, threshold)
        if not last:
            hot = keys.join(counts.where(F.col("rows") > common), "key", "left_semi")
            # Rows that need no more than these columns may share no others: they meet each other here.
            pairs = pairs.unionByName(_meet(hot.where(F.col("needs") <= level), threshold))
            later = F.sequence(F.col("at") + 1, F.col("n") - F.col("needs") + level + 1)
            more = F.explode(F.when(F.col("at") < F.least(F.col("n"), F.col("n") - F.col("needs") + level + 1), F.filter(later, lambda x: x <= F.col("n"))))
            keys = hot.select("i", "n", "needs", "key", "columns", more.alias("at"))
            keys = keys.select("i", "n", "needs", "at", F.concat("key", F.array(F.element_at("columns", F.col("at")))).alias("key"), "columns")
        made = pairs if made is None else made.unionByName(pairs)
    return made.distinct()


def _meet(keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one key whose sizes and places of it leave enough columns to share."""
    left = keys.select("key", F.col("i").alias("i1"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    right = keys.select("key", F.col("i").alias("i2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    most = F.size("key") + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    enough = most * (1 + threshold) + 1e-9 >= threshold * (F.col("n1") + F.col("n2"))
    return left.join(right, "key").where("i1 < i2").where(enough).select("i1", "i2")


def similar_rows(nz: DataFrame, threshold: float, common: int = COMMON, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(i, class_id)`` of all rows; and ``(i1, i2, both, size1, size2)`` for the pairs of classes of
    Jaccard similarity ``threshold`` or more."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    members, sets = classes(materialise(row_sets(nz), "row-sets"))
    met = candidates(sets, threshold, common, depth)
    one, two = (sets.select(F.col("i").alias(f"i{k}"), F.col("columns").alias(f"columns{k}")) for k in (1, 2))
    both = F.size(F.array_intersect("columns1", "columns2"))
    pairs = met.join(one, "i1").join(two, "i2").select("i1", "i2", both.alias("both"), F.size("columns1").alias("size1"), F.size("columns2").alias("size2"))
    enough = F.col("both") >= threshold * (F.col("size1") + F.col("size2") - F.col("both")) - 1e-9
    return members, pairs.where(enough)


def link_counts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(i, class_id, copies, links)``: rows of equal columns, itself included, and similar classes."""
    ends = pairs.select(F.col("i1").alias("class_id")).unionByName(pairs.select(F.col("i2").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")).join(links, "class_id", "left")
    return members.join(sizes, "class_id").select("i", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
