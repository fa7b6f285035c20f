"""Readers and writers of experiment lists, mappings, result logs and timings."""

from __future__ import annotations

import re
import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Core columns of a result log; others are read as strings.
LOG_TYPES = {
    "name": StringType(), "matrixPath": StringType(), "config": StringType(), "correct": StringType(),
    "m": IntegerType(), "k": IntegerType(), "n": IntegerType(), "nnz": LongType(), "numThreads": IntegerType(), "iterations": LongType(),
    "time mean": DoubleType(), "time median": DoubleType(), "time stddev": DoubleType(), "cpufreq": DoubleType(), "required_storage": DoubleType(),
    "m_tile": IntegerType(), "k_tile": IntegerType(), "n_tile": IntegerType(), "tiling_strategy": IntegerType(), "sparse_a": IntegerType(), "beta_10x": IntegerType(),
}


def read_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result logs, united by column name. Every line ends with a comma, so the reader's last column
    is empty and dropped; empty fields are null."""
    out = None
    for path in paths:
        raw = spark.read.csv(path, header=True, inferSchema=False)
        names = [c for c in raw.columns if c and not c.startswith("_c")]
        frame = raw.select(*[F.col(f"`{c}`").try_cast(LOG_TYPES.get(c, StringType())).alias(c) for c in names])
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def log_schema(extra: Sequence[str] = ()) -> StructType:
    return StructType([StructField(k, t) for k, t in LOG_TYPES.items()] + [StructField(k, StringType()) for k in extra])


def append_results(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Adds rows to a log folder under fixed, sorted columns; what a row lacks is empty. A column
    that the log does not have is an error."""
    unknown = set(rows.columns) - set(columns)
    if unknown:
        raise ValueError(f"the log has no columns {', '.join(sorted(unknown))}")
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in sorted(columns)]
    rows.select(*filled).write.mode("append").csv(path, header=True, emptyValue="")


def append_growing(rows: DataFrame, path: str) -> None:
    """Adds rows to a log that takes any columns: rows of one set of columns share a folder, so no file is written
    anew when columns come up later."""
    names = sorted(rows.columns)
    header = hashlib.md5("\n".join(names).encode()).hexdigest()
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names]
    rows.select(*filled).write.mode("append").csv(f"{path}/header={header}", header=True, emptyValue="")


def read_growing(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a growing log under all columns that it has; those that a row came without are null.
    Folders are listed by Spark, and there is one read for each set of columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    folders = sorted(r[0] for r in files.select(F.regexp_extract("path", "^(.*/header=[0-9a-f]+)/", 1)).distinct().collect())
    if not folders:
        raise ValueError(f"{path} is no log")
    return read_results(spark, folders)


def read_file_list(spark: SparkSession, path: str, names: Sequence[str] = ()) -> DataFrame:
    """``(ord, path, b_cols, options)`` of lines ``path[,b_cols[,option...]]``; shorter than three
    characters are skipped. ``names`` name the options."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).where(F.length("line") >= 3)
    parts = lines.select("ord", F.split("line", ",").alias("p"))
    option = [x for k, n in enumerate(names) for x in (F.lit(n), F.get("p", F.lit(k + 2)))]
    options = F.map_filter(F.create_map(*option), lambda _, v: v.isNotNull()) if option else F.create_map().cast("map<string,string>")
    return parts.select("ord", F.col("p")[0].alias("path"), F.get("p", F.lit(1)).try_cast("int").alias("b_cols"), options.alias("options"))


def slice_list(files: DataFrame, low: int, high: int) -> DataFrame:
    """Entries ``low <= ord < high``."""
    return files.where((F.col("ord") >= low) & (F.col("ord") < high))


def first_percent(files: DataFrame, percent: float) -> DataFrame:
    """The first ``percent`` of a list, by its order."""
    return files.where(F.col("ord") < F.floor(files.agg(F.count(F.lit(1))).scalar() * F.lit(percent / 100.0)))


def skip_listed(files: DataFrame, words: Sequence[str]) -> DataFrame:
    """Entries whose path has none of the words."""
    for word in words:
        files = files.where(~F.contains("path", F.lit(word)))
    return files


def read_mapping(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(mapping_id, m_r, pattern, kernels)``: the first line is the panel height, the others
    ``pattern: [kernels]``."""
    text = spark.read.text(paths, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/_]+?)(?:\.txt)?$", 1)
    lines = text.select(name.alias("mapping_id"), F.split("value", r"\r?\n").alias("l"))
    each = lines.select("mapping_id", F.trim(F.col("l")[0]).cast("int").alias("m_r"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line")).where(F.trim("line") != "")
    return each.select(
        "mapping_id", "m_r", F.regexp_extract("line", r"^\s*(\d+)\s*:", 1).cast("int").alias("pattern"), F.from_json(F.regexp_extract("line", r"(\[.*\])", 1), "array<int>").alias("kernels")
    )


def mapping_lines(mapping: DataFrame, m_r: int) -> DataFrame:
    """Lines ``(at, value)`` of a mapping's file."""
    body = mapping.select(F.col("pattern").alias("at"), F.concat(F.col("pattern"), F.lit(": ["), F.array_join("kernels", ", "), F.lit("]")).alias("value"))
    head = mapping.sparkSession.range(1).select(F.lit(-1).alias("at"), F.lit(str(m_r)).alias("value"))
    return head.unionByName(body)


def mapping_id(mapping: DataFrame, length: int = 5) -> DataFrame:
    """Short digest of a mapping, a table of at most ``2 ** m_r`` rows, as ``mapping_id``."""
    rows = F.to_json(F.sort_array(F.collect_list(F.struct("pattern", "kernels"))))
    return mapping.agg(F.right(F.md5(rows), F.lit(length)).alias("mapping_id"))


def write_mapping(mapping: DataFrame, m_r: int, path: str) -> None:
    mapping_lines(mapping, m_r).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """``(target, key)`` of lines ``target,key,key,...``."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split("value", ","), lambda x: F.trim(x).cast("int")).alias("p"))
    return parts.select(F.col("p")[0].alias("target"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("key"))


def merged_lines(merged: DataFrame) -> DataFrame:
    """Lines of a merged-bucket file from ``(target, key)``."""
    keys = F.array_join(F.transform(F.sort_array(F.collect_list("key")), lambda x: x.cast("string")), ",")
    return merged.groupBy("target").agg(keys.alias("keys")).select(F.concat_ws(",", "target", "keys").alias("value"))


def read_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """``(pattern, prob)`` of lines ``0bXXXXXXXX, prob``."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", r"\s*,\s*").alias("p"))
    return parts.select(F.conv(F.regexp_replace(F.col("p")[0], "^0b", ""), 2, 10).cast("int").alias("pattern"), F.col("p")[1].cast("double").alias("prob"))


def probability_lines(shares: DataFrame, height: int) -> DataFrame:
    """Lines ``(pattern, value)`` of a probability file from ``(pattern, prob)``."""
    code = F.concat(F.lit("0b"), F.lpad(F.bin(F.col("pattern").cast("long")), height, "0"))
    return shares.select("pattern", F.concat_ws(", ", code, "prob").alias("value"))


def keyed_name(name: Column, keys: Mapping[str, Column]) -> Column:
    """``name_k1v1_k2v2``: a cache's file name with its keys."""
    return F.concat_ws("_", name, *[F.concat(F.lit(k), v.cast("string")) for k, v in keys.items()])


def name_keys(path: Column, keys: Sequence[str]) -> Column:
    """``(id, key...)`` out of a path whose file name carries ``keys`` in this order; values are texts,
    null where the name does not carry them."""
    file = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    pattern = "^(.*)" + "".join(f"_{re.escape(k)}([^_]*)" for k in keys) + "$"
    found = [F.when(file.rlike(pattern), F.regexp_extract(file, pattern, at + 1)).alias(name) for at, name in enumerate(["id", *keys])]
    return F.struct(*found)


def read_keyed(spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """CSV caches united, with the keys of their file names as columns."""
    rows = spark.read.csv(paths, header=True).select("*", name_keys(F.col("_metadata.file_path"), keys).alias("_keys"))
    return rows.select("*", "_keys.*").drop("_keys")


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """``(name, threads, real_time, layer, layer_time)`` of a timing file with keys ``layer_<n>``."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<benchmarks:array<map<string,string>>>").alias("x"))
    return explode_layers(text.select(F.explode("x.benchmarks").alias("b")))


def explode_layers(rows: DataFrame) -> DataFrame:
    """One row for each key ``layer_<n>`` of the map ``b``."""
    name = F.col("b")["name"]
    entry = rows.select(
        F.regexp_extract(name, "^([^/]*)", 1).alias("name"), F.nullif(F.regexp_extract(name, r"threads:(\d+)", 1), F.lit("")).cast("int").alias("threads"),
        F.col("b")["real_time"].cast("double").alias("real_time"), F.explode("b").alias("key", "value"),
    )
    layer = F.nullif(F.regexp_extract("key", r"^layer_(\d+)$", 1), F.lit("")).cast("int")
    return entry.select("name", "threads", "real_time", layer.alias("layer"), F.col("value").try_cast("double").alias("layer_time")).where("layer is not null")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A cache whose folders carry the key values, so that readers prune by them."""
    df.write.partitionBy(*keys).parquet(path)


def heuristic_json(heuristic: DataFrame) -> DataFrame:
    """``heuristic(lo, hi, n, methods)`` as JSON lines."""
    return heuristic.select(F.to_json(F.struct("lo", "hi", "n", "methods")).alias("value"))
