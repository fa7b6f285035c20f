"""Readers and writers of sparse matrices in text formats.

Readers return ``(matrix_id, i, j, v)``; ``matrix_id`` is the file's path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.plans.staging import materialise


def _numbers(text: Column) -> Column:
    """Integers of a line, whatever blanks or commas stand between."""
    return F.transform(F.filter(F.split(text, r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("long"))


def read_smtx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SMTX: sizes, row pointers, column numbers. A pattern only, so every value is 1."""
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("matrix_id"), F.split("value", r"\r?\n").alias("l"))
    parts = lines.select("matrix_id", _numbers(F.get("l", F.lit(1))).alias("ptr"), _numbers(F.coalesce(F.get("l", F.lit(2)), F.lit(""))).alias("col"))
    # Rows are cut out of the array before anything is exploded, so no row carries the whole array.
    at = F.sequence(F.lit(1), F.greatest(F.size("ptr") - 1, F.lit(1)))
    width = lambda i: F.element_at("ptr", i + 1) - F.element_at("ptr", i)
    cut = lambda i: F.slice("col", (F.element_at("ptr", i) + 1).cast("int"), width(i).cast("int"))
    row = parts.where(F.size("ptr") > 1).select("matrix_id", F.posexplode(F.transform(at, cut)).alias("i", "cols"))
    return row.select("matrix_id", F.col("i").cast("long").alias("i"), F.explode("cols").alias("j"), F.lit(1.0).alias("v"))


def smtx_sizes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(matrix_id, m, k, nnz)`` from the first lines."""
    head = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("matrix_id"), _numbers(F.substring_index("value", "\n", 1)).alias("n"))
    return head.select("matrix_id", F.col("n")[0].alias("m"), F.col("n")[1].alias("k"), F.col("n")[2].alias("nnz"))


def read_mtx(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """MatrixMarket, coordinate or array; 1-based in files. Symmetric files store one triangle;
    entries without a value are 1. Zeros of the array layout are left out."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("matrix_id"), F.split("value", r"\r?\n").alias("l"))
    banner = F.lower(F.get("l", F.lit(0)))
    body = F.filter("l", lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("%")))
    head = text.select("matrix_id", F.contains(banner, F.lit("symmetric")).alias("symmetric"), F.contains(banner, F.lit("array")).alias("dense"), body.alias("body"))
    sized = head.withColumn("m", _numbers(F.get("body", F.lit(0)))[0])
    line = sized.select("matrix_id", "symmetric", "dense", "m", F.posexplode(F.slice("body", F.lit(2), F.greatest(F.size("body") - 1, F.lit(0)))).alias("at", "line"))
    word = line.withColumn("w", F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    cells = word.select(
        "matrix_id",
        "symmetric",
        F.when(F.col("dense"), F.col("at") % F.col("m")).otherwise(F.get("w", F.lit(0)).try_cast("long") - 1).alias("i"),
        F.when(F.col("dense"), F.floor(F.col("at") / F.col("m"))).otherwise(F.get("w", F.lit(1)).try_cast("long") - 1).alias("j"),
        F.when(F.col("dense"), F.get("w", F.lit(0)).try_cast("double")).otherwise(F.coalesce(F.get("w", F.lit(2)).try_cast("double"), F.lit(1.0))).alias("v"),
        "dense",
    ).where("not dense or v <> 0")
    both = F.when(F.col("symmetric") & (F.col("i") != F.col("j")), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return cells.select("matrix_id", F.explode(both.otherwise(F.array(F.struct("i", "j")))).alias("p"), "v").select("matrix_id", "p.i", "p.j", "v")


def read_mtx_parts(spark: SparkSession, path: str) -> DataFrame:
    """A folder of part files that are one MatrixMarket matrix in coordinate form, line by line: no task
    holds more of it than Spark's splits of the files. The banner says whether it is symmetric."""
    lines = spark.read.text(path)
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    mark = F.startswith(F.trim("value"), F.lit("%"))
    symmetric = lines.where(F.startswith("value", F.lit("%%MatrixMarket"))).agg(F.coalesce(F.bool_or(F.contains(F.lower("value"), F.lit("symmetric"))), F.lit(False)).alias("x")).first()["x"]
    body = lines.where(~mark & (F.trim("value") != "")).select(words.alias("w"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    # The line of sizes is the first one that is no comment, in the file of the smallest name.
    sizes = body.groupBy("file", "start").agg(F.min("at").alias("at")).agg(F.min(F.struct("file", "start", "at")).alias("x")).first()["x"]
    if sizes is None:
        return spark.createDataFrame([], "matrix_id string, i long, j long, v double")
    cells = body.where((F.col("file") != sizes["file"]) | (F.col("start") != sizes["start"]) | (F.col("at") != sizes["at"])).select(
        F.lit(path).alias("matrix_id"), (F.get("w", F.lit(0)).cast("long") - 1).alias("i"), (F.get("w", F.lit(1)).cast("long") - 1).alias("j"), F.coalesce(F.get("w", F.lit(2)).cast("double"), F.lit(1.0)).alias("v")
    )
    if not symmetric:
        return cells
    return cells.unionByName(cells.where("i <> j").select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def scan_dataset(
    spark: SparkSession, root: str, pattern: str = "*.smtx", models: Sequence[str] = (), prunings: Sequence[str] = (), sparsities: Sequence[str] = (),
    sample: int | None = None, seed: int = 42, keyed: bool = False,
) -> DataFrame:
    """``(path, model, pruning, sparsity, file)`` of the files below ``root``, by the names of their last
    folders (``keyed``: folders ``name=value``); empty lists take all. ``sample`` draws so many files by a
    hash of their path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    found = with_path_parts(files, path="path")
    names = ("model", "pruning", "sparsity")
    if keyed:
        found = found.select("path", *[F.regexp_replace(n, "^[^=]*=", "").alias(n) for n in names], "file")
    for name, wanted in zip(names, (models, prunings, sparsities)):
        if wanted:
            found = found.where(F.col(name).isin(list(wanted)))
    return found if sample is None else found.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(sample)


#: Readers by file extension.
READERS: dict[str, Callable[[SparkSession, str | Sequence[str]], DataFrame]] = {".smtx": read_smtx, ".mtx": read_mtx}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    for extension, reader in READERS.items():
        if path.endswith(extension):
            return reader(spark, path)
    raise ValueError(f"{path}: known extensions are {', '.join(READERS)}")


def with_path_parts(df: DataFrame, names: Sequence[str] = ("model", "pruning", "sparsity", "file"), path: str = "matrix_id") -> DataFrame:
    """Adds the last directories of a path as columns."""
    parts = F.split(path, "/")
    return df.select("*", *[F.try_element_at(parts, F.lit(k - len(names))).alias(n) for k, n in enumerate(names)])


def read_blocks(spark: SparkSession, paths: str | Sequence[str], header: int = 4) -> DataFrame:
    """Coordinate-block files: after ``header`` lines, three lines for each block, with its values,
    row numbers and column numbers. ``(matrix_id, block, values, rows, cols)``."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("matrix_id"), F.split("value", r"\r?\n").alias("l"))
    body = F.filter(F.slice("l", F.lit(header + 1), F.greatest(F.size("l") - header, F.lit(0))), lambda x: F.trim(x) != "")
    line = text.select("matrix_id", F.posexplode(body).alias("at", "line"))
    blocks = line.groupBy("matrix_id", F.floor(F.col("at") / 3).cast("long").alias("block")).agg(
        *[F.max(F.when(F.col("at") % 3 == k, F.col("line"))).alias(n) for k, n in enumerate(("values", "rows", "cols"))]
    )
    floats = F.transform(F.filter(F.split("values", r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("float"))
    return blocks.select("matrix_id", "block", floats.alias("values"), _numbers(F.col("rows")).alias("rows"), _numbers(F.col("cols")).alias("cols"))


def blocks_to_coo(blocks: DataFrame) -> DataFrame:
    """Entries of dense blocks, stored row by row."""
    cell = blocks.select("matrix_id", "rows", "cols", F.posexplode("values").alias("at", "v"))
    n = F.size("cols")
    return cell.select(
        "matrix_id", F.element_at("rows", (F.floor(F.col("at") / n) + 1).cast("int")).alias("i"), F.element_at("cols", (F.col("at") % n + 1).cast("int")).alias("j"), F.col("v").cast("double").alias("v")
    )


def mtx_lines(nz: DataFrame, m: int, k: int, kind: str = "general") -> DataFrame:
    """Lines ``(place, value)`` of one matrix in MatrixMarket format."""
    head = nz.agg(F.count(F.lit(1)).alias("n")).select(
        F.posexplode(F.array(F.lit(f"%%MatrixMarket matrix coordinate real {kind}"), F.concat_ws(" ", F.lit(m), F.lit(k), "n"))).alias("at", "value")
    )
    head = head.select(F.struct((F.col("at") - 2).cast("long").alias("j"), F.lit(0).cast("long").alias("i")).alias("place"), "value")
    body = nz.select(F.struct(F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i")).alias("place"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value"))
    return head.unionByName(body)


def write_mtx(nz: DataFrame, m: int, k: int, path: str, kind: str = "general") -> None:
    """One matrix, column by column; the parts of the folder in their order are the file."""
    mtx_lines(materialise(nz.select("i", "j", "v"), "entries"), m, k, kind).orderBy("place.j", "place.i").select("value").write.text(path)


def write_smtx(nz: DataFrame, m: int, k: int, path: str) -> None:
    """One matrix as a single SMTX file. Its second and third line each hold a whole array, so one
    task writes them, as the format demands."""
    from gridweave.operators.matrix import pointers

    line = lambda df, order, value, at: df.agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, value)))[value], " ").alias("value")).withColumn("at", F.lit(at))
    ptr = line(pointers(nz, m).withColumn("ptr", F.col("ptr").cast("string")), "line", "ptr", 1)
    place = nz.select(F.struct("i", "j").alias("place"), F.col("j").cast("string").alias("col"))
    col = line(place, "place", "col", 2)
    head = nz.agg(F.concat_ws(", ", F.lit(m), F.lit(k), F.count(F.lit(1))).alias("value")).withColumn("at", F.lit(0))
    head.unionByName(ptr).unionByName(col).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
