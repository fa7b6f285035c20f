"""Matrix files read by byte ranges: no task holds a file, or a line of a file whose lines are whole arrays.

Spark splits text files at any separator. Formats of short lines are split at line ends; SMTX, whose second and
third line are arrays of the matrix's size, at blanks, so that a record is a number. What a record means
depends on its place in the file: tasks number records inside their ranges, counts of the ranges before
are added, and an entry is told from a pointer, or a block from a tile, by that number.

With ``parts`` a folder's files are one matrix, in the order of their names, and its path is the id; this is what the
writers here leave. Otherwise each file is a matrix. Values are longs or doubles; a word that is neither is an error.
Empty files and folders have no entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.operators.matrix import pointers
from gridweave.plans.staging import materialise

#: Files whose sizes are broadcast.
MOST_FILES = 10_000
#: Places of a stretch in which entries look for their row, and lines for their tile.
ROW_STRETCH, TILE_STRETCH = 256, 4096


def _words() -> Column:
    return F.filter(F.split("value", r"[,\s]+"), lambda x: x != "")


def _records(spark: SparkSession, paths: str | Sequence[str], separator: str | None) -> DataFrame:
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", _words().alias("words"))


def _numbered(records: DataFrame, weight: Column, matrix_id: Column, whole: bool) -> DataFrame:
    """``records`` as ``matrix_id, at, words``: ``at`` counts ``weight`` over all records before, by file and range."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, start, weights = batch.column(0), batch.column(1).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
            # The records of a range come one after another, in their order.
            other = (start[1:] != start[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero(other) + 1))
            at = np.cumsum(weights) - weights
            base = -at[first]
            base[0] = before if (file[0].as_py(), start[0]) == here else 0
            at += np.repeat(base, np.diff(np.append(first, len(at))))
            here, before = (file[-1].as_py(), start[-1]), int(at[-1] + weights[-1])
            yield pa.RecordBatch.from_arrays([file, batch.column(1), batch.column(2), pa.array(at)], names=["file", "start", "value", "at"])

    inside = records.select("file", "start", "value", weight.cast("int").alias("weight"))
    ranges = inside.groupBy("file", "start").agg(F.sum("weight").alias("n"))
    # One row for each range of a file, whatever it holds.
    order = Window.partitionBy(F.lit(0) if whole else F.col("file")).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialise(ranges.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"), "ranges")
    placed = inside.mapInArrow(scan, "file string, start bigint, value string, at bigint").join(ranges, ["file", "start"])
    return placed.select(matrix_id.alias("matrix_id"), (F.col("base") + F.col("at")).alias("at"), _words().alias("words"))


def _located(rows: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """``rows(matrix_id, at, ...)`` with the columns of the one of ``spans(matrix_id, low, high, ...)`` that holds ``at``; others are
    dropped. Spans do not overlap. They are cut into stretches of ``width`` places, so rows meet few spans and none is made for each place."""
    stretch = F.floor(F.col("at") / width).alias("stretch")
    cut = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("stretch")
    return rows.select("*", stretch).join(spans.where("low < high").select("*", cut), ["matrix_id", "stretch"]).where("at >= low and at < high").drop("stretch")


def _lines(spark: SparkSession, paths: str | Sequence[str], parts: bool) -> tuple[DataFrame, DataFrame, Column]:
    matrix_id = F.lit(paths) if parts else F.col("file")
    records = _records(spark, paths, None)
    comment = F.startswith(F.trim("value"), F.lit("%"))
    return _numbered(records.where(~comment & (F.size("words") > 0)), F.lit(1), matrix_id, parts), records.where(comment), matrix_id


def _small(heads: DataFrame) -> DataFrame:
    """Sizes of matrices, broadcast if there are few."""
    heads = materialise(heads, "matrix-sizes")
    return F.broadcast(heads) if heads.count() <= MOST_FILES else heads


def _word(k: int) -> Column:
    return F.element_at("words", k + 1)


def read_smtx_ranges(spark: SparkSession, paths: str | Sequence[str], parts: bool = False, rows: tuple[int, int] | None = None) -> DataFrame:
    """SMTX as ``(matrix_id, i, j, v)``. With ``rows``, only those from the first up to the second: the columns
    of other rows are dropped by their place, before they are shuffled."""
    numbers = _numbered(_records(spark, paths, " ").where(F.size("words") > 0), F.size("words"), F.lit(paths) if parts else F.col("file"), parts)
    numbers = numbers.select("matrix_id", "at", F.posexplode("words").alias("k", "word")).select("matrix_id", (F.col("at") + F.col("k")).alias("at"), F.col("word").cast("bigint").alias("x"))
    numbers = materialise(numbers, "numbers")
    heads = _small(numbers.where("at = 0").select("matrix_id", F.col("x").alias("m")))
    placed = numbers.join(heads, "matrix_id")
    pointer = placed.where((F.col("at") >= 3) & (F.col("at") <= F.col("m") + 3)).select("matrix_id", (F.col("at") - 3).alias("i"), F.col("x").alias("low"))
    column = placed.where(F.col("at") > F.col("m") + 3).select("matrix_id", (F.col("at") - F.col("m") - 4).alias("at"), F.col("x").alias("j"))
    spans = pointer.join(pointer.select("matrix_id", (F.col("i") - 1).alias("i"), F.col("low").alias("high")), ["matrix_id", "i"]).where("low < high")
    if rows is not None:
        spans = spans.where((F.col("i") >= rows[0]) & (F.col("i") < rows[1]))
        kept = _small(spans.groupBy("matrix_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        column = column.join(kept, "matrix_id").where("at >= low and at < high").select("matrix_id", "at", "j")
    return _located(column, spans, ROW_STRETCH).select("matrix_id", "i", "j", F.lit(1.0).alias("v"))


def smtx_sizes(spark: SparkSession, paths: str | Sequence[str], parts: bool = False) -> DataFrame:
    """``(matrix_id, m, k, nnz)`` of SMTX files, from their first three numbers; no task holds a line."""
    found = _records(spark, paths, " ").where(F.size("words") > 0)
    # The first three ranges that have records hold the first three numbers.
    ranges = found.select("file", "start").distinct()
    order = Window.partitionBy(F.lit(0) if parts else F.col("file")).orderBy("file", "start")
    first = materialise(ranges.withColumn("place", F.row_number().over(order)).where("place <= 3").select("file", "start", "place"), "first-ranges")
    numbered = _numbered(found.join(F.broadcast(first.select("file", "start")), ["file", "start"], "left_semi"), F.size("words"), F.lit(paths) if parts else F.col("file"), parts)
    numbers = numbered.where("at < 3").select("matrix_id", "at", F.posexplode("words").alias("k", "word")).select("matrix_id", (F.col("at") + F.col("k")).alias("at"), F.col("word").cast("bigint").alias("x"))
    return numbers.groupBy("matrix_id").agg(*[F.max(F.when(F.col("at") == k, F.col("x"))).alias(n) for k, n in enumerate(("m", "k", "nnz"))])


def read_mtx_ranges(spark: SparkSession, paths: str | Sequence[str], parts: bool = False) -> DataFrame:
    """MatrixMarket as ``(matrix_id, i, j, v)``, coordinate or array, general, symmetric or skew-symmetric.
    Entries of patterns are 1; zeros of the array layout are left out."""
    body, comments, matrix_id = _lines(spark, paths, parts)
    banner = F.lower("value")
    said = comments.where(F.startswith(banner, F.lit("%%matrixmarket"))).select(
        matrix_id.alias("matrix_id"), banner.contains("array").alias("dense"), banner.contains("symmetric").alias("mirrored"), banner.contains("skew").alias("skew")
    )
    sizes = body.where("at = 0").select("matrix_id", _word(0).cast("bigint").alias("m"))
    no = F.lit(False)
    heads = _small(sizes.join(said, "matrix_id", "left").select("matrix_id", "m", *[F.coalesce(c, no).alias(c) for c in ("dense", "mirrored", "skew")]))
    line = body.where("at > 0").join(heads, "matrix_id").withColumn("at", F.col("at") - 1)
    cell = line.where("not dense").select(
        "matrix_id", (_word(0).cast("bigint") - 1).alias("i"), (_word(1).cast("bigint") - 1).alias("j"), F.coalesce(F.try_element_at("words", F.lit(3)).cast("double"), F.lit(1.0)).alias("v"), "mirrored", "skew"
    )
    # The array layout goes column by column; of a symmetric one each column starts at the diagonal, of a skew one below it.
    at, m = F.col("at"), F.col("m") - F.col("skew").cast("int")
    head = lambda j: j * m - (j * (j - 1) / 2).cast("bigint")
    guess = F.floor((2 * m + 1 - F.sqrt(((2 * m + 1) * (2 * m + 1) - 8 * at).cast("double"))) / 2).cast("bigint")
    packed = guess + F.when(head(guess + 1) <= at, 1).when(head(guess) > at, -1).otherwise(0)
    column = F.when(F.col("mirrored"), packed).otherwise(F.floor(at / F.col("m")))
    row = F.when(F.col("mirrored"), at - head(F.col("j")) + F.col("j") + F.col("skew").cast("int")).otherwise(at % F.col("m"))
    full = line.where("dense").withColumn("j", column).select("matrix_id", row.alias("i"), "j", _word(0).cast("double").alias("v"), "mirrored", "skew").where("v <> 0")
    cells = cell.unionByName(full)
    one, other = F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.when(F.col("skew"), -F.col("v")).otherwise(F.col("v")).alias("v"))
    both = F.when(F.col("mirrored") & (F.col("i") != F.col("j")), F.array(one, other)).otherwise(F.array(one))
    return cells.select("matrix_id", F.explode(both).alias("x")).select("matrix_id", "x.i", "x.j", "x.v")


def read_tiled_blocks(spark: SparkSession, paths: str | Sequence[str], parts: bool = False) -> DataFrame:
    """Coordinate-block files as ``(matrix_id, tile, block, values, rows, cols)``: after the sizes of the matrix, of a block
    and of a tile and the number of tiles, each tile is a line with its number of blocks and three lines for each of them.

    A tile's place follows from all tiles before. Lines of one number are where a tile can start; each points past its
    blocks, and doubling the pointers tells in a few rounds which are reached from the first.
    """
    body, _, _ = _lines(spark, paths, parts)
    body = materialise(body, "block-lines")
    tiles = _small(body.where("at = 3").select("matrix_id", _word(0).cast("bigint").alias("tiles")))
    alone = body.where((F.col("at") > 3) & (F.size("words") == 1)).select("matrix_id", "at", _word(0).try_cast("bigint").alias("blocks")).where("blocks >= 0")
    jump = materialise(alone.select("matrix_id", "at", (F.col("at") + 1 + 3 * F.col("blocks")).alias("to")), "jumps")
    # A way of 2^k tiles from each start; a start is reached if some way from the first line leads to it.
    reached = materialise(jump.where("at = 4").select("matrix_id", "at", F.lit(0).cast("bigint").alias("tile")), "reached")
    most, steps = tiles.agg(F.coalesce(F.max("tiles"), F.lit(0))).first()[0], 1
    while steps < most:
        further = reached.join(jump, ["matrix_id", "at"]).select("matrix_id", F.col("to").alias("at"), (F.col("tile") + steps).alias("tile"))
        reached = materialise(reached.unionByName(further), "reached")
        jump = materialise(jump.join(jump.select("matrix_id", F.col("at").alias("to"), F.col("to").alias("next")), ["matrix_id", "to"]).select("matrix_id", "at", F.col("next").alias("to")), "jumps")
        steps *= 2
    heads = reached.join(alone, ["matrix_id", "at"]).join(tiles, "matrix_id").where("tile < tiles")
    spans = heads.select("matrix_id", "tile", (F.col("at") + 1).alias("low"), (F.col("at") + 1 + 3 * F.col("blocks")).alias("high"))
    inside = _located(body, spans, TILE_STRETCH).withColumn("line", F.col("at") - F.col("low"))
    held = inside.groupBy("matrix_id", "tile", F.floor(F.col("line") / 3).alias("block")).agg(*[F.max(F.when(F.col("line") % 3 == k, F.col("words"))).alias(n) for k, n in enumerate(("values", "rows", "cols"))])
    cast = lambda c, kind: F.transform(c, lambda x: x.cast(kind)).alias(c)
    return held.select("matrix_id", "tile", "block", cast("values", "float"), cast("rows", "bigint"), cast("cols", "bigint"))


def write_smtx_parts(nz: DataFrame, m: int, k: int, path: str) -> None:
    """One matrix as a folder whose files, one after another, are an SMTX file: records end in a blank, and the
    first number of a line brings the line end along."""
    nz = materialise(nz.select("i", "j"), "entries")
    place = lambda section, at, low: F.struct(F.lit(section).alias("section"), at.cast("bigint").alias("at"), low.cast("bigint").alias("low"))
    zero = F.lit(0)
    head = nz.agg(F.concat(F.lit(f"{m}, {k}, "), F.count(F.lit(1))).alias("value")).select(place(0, zero, zero).alias("place"), "value")
    first = lambda is_first, value: F.concat(F.when(is_first, "\n").otherwise(""), value.cast("string"))
    starts = pointers(nz, m).select(place(1, F.col("line"), zero).alias("place"), first(F.col("line") == 0, F.col("ptr")).alias("value"))
    # The line of columns starts with a record of its own, so that an entry need not know that it is the first.
    mark = nz.sparkSession.range(1).select(place(2, F.lit(-1), zero).alias("place"), F.lit("\n").alias("value"))
    columns = nz.select(place(2, F.col("i"), F.col("j")).alias("place"), F.col("j").cast("string").alias("value"))
    lines = head.unionByName(starts).unionByName(mark).unionByName(columns)
    lines.orderBy("place.section", "place.at", "place.low").select("value").write.option("lineSep", " ").text(path)


def block_lines(blocks: DataFrame, m: int, k: int, block: tuple[int, int], tile: tuple[int, int], tiles: int) -> DataFrame:
    """``(place, value)`` lines of one coordinate-block file of ``blocks(tile, block, values, rows, cols)``; empty tiles are written too."""
    place = lambda at, b, line: F.struct(at.cast("bigint").alias("tile"), b.cast("bigint").alias("block"), F.lit(line).alias("line"))
    spark, blocks = blocks.sparkSession, materialise(blocks, "blocks")
    head = spark.createDataFrame([(k_, f"{a} {b}".strip()) for k_, (a, b) in enumerate(((m, k), block, tile, (tiles, "")))], "at int, value string")
    head = head.select(F.struct(F.lit(-1).cast("bigint").alias("tile"), F.col("at").cast("bigint").alias("block"), F.lit(0).alias("line")).alias("place"), "value")
    counts = blocks.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    starts = spark.range(tiles).withColumnRenamed("id", "tile").join(counts, "tile", "left").select(place(F.col("tile"), F.lit(-1), 0).alias("place"), F.coalesce("n", F.lit(0)).cast("string").alias("value"))
    body = blocks.select("tile", "block", F.posexplode(F.array(*[F.array_join(F.transform(c, lambda x: x.cast("string")), " ") for c in ("values", "rows", "cols")])).alias("line", "value"))
    return head.unionByName(starts).unionByName(body.select(F.struct(F.col("tile").cast("bigint").alias("tile"), F.col("block").cast("bigint").alias("block"), "line").alias("place"), "value"))
