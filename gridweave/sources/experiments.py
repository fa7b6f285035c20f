"""Experiments: runs of methods over matrices from a specification, and files that state them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.results import grid


def read_spec(spark: SparkSession, path: str) -> dict:
    """A specification in YAML, a small file of a person's making: options, methods, grids, matrices."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {}


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _configs(spec: dict, method: dict) -> list[str]:
    """Configurations of a method: its own options, crossed with the axes of the grid it names."""
    fixed = [f"{k}:{_text(v)}" for k, v in method.get("options", {}).items()]
    name = method.get("tune", {}).get("grid")
    if name is None:
        return ["|".join(fixed)]
    axes = next((g for g in spec.get("tuning_grids", []) if g["name"] == name), None)
    if axes is None:
        raise ValueError(f"method {method['name']} names an unknown grid {name}")
    out = [fixed]
    for axis, values in axes.items():
        if axis != "name":
            out = [[*config, f"{axis}:{_text(v)}"] for config in out for v in values]
    return ["|".join(config) for config in out]


def runs(spark: SparkSession, spec: dict, matrices: DataFrame, overrides: dict | None = None) -> DataFrame:
    """``matrix, method, config, b_cols, n_threads``: every method and configuration on each of
    ``matrices(matrix)``, for each width and thread count. ``overrides`` are options given on the command
    line, which win over the file's."""
    options = {**spec.get("options", {}), **(overrides or {})}
    listed = {k: v if isinstance(v, list) else [v] for k, v in options.items()}
    configs = [(m["name"], config) for m in spec.get("methods", []) for config in _configs(spec, m)]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("method"), F.lit(b).alias("config")) for a, b in configs])).alias("x")
    out = matrices.select("matrix", each).select("matrix", "x.method", "x.config")
    for option in ("b_cols", "n_threads"):
        out = out.withColumn(option, F.explode(F.lit(list(listed.get(option, [1])))))
    return out


def files(spark: SparkSession, packs: Sequence[str], parts: int, b_cols: Sequence[int], threads: Sequence[int], apart: str = "aspt") -> DataFrame:
    """``(file, script, text)``: an experiment file for each pack of methods, part of the matrices, width
    and thread count, and the run script that starts it; packs named ``apart`` have scripts of their own."""
    each = grid(spark, {"pack": list(packs), "part": list(range(1, parts + 1)), "b": list(b_cols), "t": list(threads)})
    name = F.concat(F.concat_ws("_", "pack", F.concat(F.lit("part"), "part"), "b", "t"), F.lit(".yaml"))
    script = F.concat(F.when(F.contains("pack", F.lit(apart)), F.lit(f"all_{apart}_part")).otherwise("all_part"), F.col("part").cast("string"), F.lit(".sh"))
    lines = [F.lit("options:"), F.concat(F.lit("  b_cols: ["), "b", F.lit("]")), F.concat(F.lit("  n_threads: ["), "t", F.lit("]")), F.lit("matrices:"), F.concat(F.lit("  filelist: part"), "part", F.lit(".txt"))]
    return each.select(name.alias("file"), script.alias("script"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))


def resolve_paths(listed: DataFrame, known: DataFrame, dataset_dir: str, list_dir: str) -> DataFrame:
    """``listed(path)`` with ``found``: a path that starts at the root as it is, else the first of the data
    set's folder and the list's folder where ``known(path)`` has it; null if none has."""
    dirs = F.array(F.lit(dataset_dir.rstrip("/")), F.lit(list_dir.rstrip("/")))
    tried = F.when(F.startswith("path", F.lit("/")), F.array(F.col("path"))).otherwise(F.transform(dirs, lambda x: F.concat(x, F.lit("/"), "path")))
    each = listed.select("path", F.posexplode(tried).alias("at", "candidate"))
    there = known.select(F.col("path").alias("candidate")).distinct()
    found = each.join(there, "candidate", "left_semi").groupBy("path").agg(F.min_by("candidate", "at").alias("found"))
    return listed.join(found, "path", "left")
