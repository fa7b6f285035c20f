import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import matrix, patterns
from gridweave.sources import logs, matrices
from gridweave.streaming import results_stream


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def cells(df):
    return sorted((x["i"], x["j"], x["v"]) for x in df.collect())


def test_smtx(spark, folder):
    (folder / "a.smtx").write_text("2, 3, 3\n0 2 3\n0 2 1\n")
    df = matrices.read_matrix(spark, str(folder / "a.smtx"))
    assert cells(df) == [(0, 0, 1.0), (0, 2, 1.0), (1, 1, 1.0)]
    assert matrices.smtx_sizes(spark, str(folder / "a.smtx")).select("m", "k", "nnz").first()[:] == (2, 3, 3)
    matrices.write_smtx(df.select("i", "j", "v"), 2, 3, str(folder / "b.smtx"))
    assert cells(matrices.read_smtx(spark, str(folder / "b.smtx"))) == cells(df)


def test_smtx_empty_rows(spark, folder):
    (folder / "a.smtx").write_text("3, 3, 1\n0 0 1 1\n2\n")
    assert cells(matrices.read_smtx(spark, str(folder / "a.smtx"))) == [(1, 2, 1.0)]
    (folder / "b.smtx").write_text("2, 2, 0\n0 0 0\n\n")
    assert cells(matrices.read_smtx(spark, str(folder / "b.smtx"))) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("%%MatrixMarket matrix coordinate real symmetric\n%\n3 3 3\n1 1 2.0\n2 1 5.0\n3 3 1.0\n", [(0, 0, 2.0), (0, 1, 5.0), (1, 0, 5.0), (2, 2, 1.0)]),
        ("%%MatrixMarket matrix coordinate real symmetric\n4 4 0\n", []),
        ("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n", [(1, 0, 1.0)]),
        ("%%MatrixMarket matrix array real general\n2 2\n1\n0\n3\n4\n", [(0, 0, 1.0), (0, 1, 3.0), (1, 1, 4.0)]),
    ],
)
def test_mtx(spark, folder, text, want):
    (folder / "a.mtx").write_text(text)
    assert cells(matrices.read_matrix(spark, str(folder / "a.mtx"))) == want


def test_mtx_round_trip(spark, folder):
    nz = spark.createDataFrame([(0, 1, 2.5), (2, 0, -1.0)], "i long, j long, v double")
    matrices.write_mtx(nz, 3, 3, str(folder / "out"))
    text = "".join(p.read_text() for p in sorted((folder / "out").glob("part-*")))
    (folder / "back.mtx").write_text(text)
    assert text.startswith("%%MatrixMarket") and cells(matrices.read_mtx(spark, str(folder / "back.mtx"))) == [(0, 1, 2.5), (2, 0, -1.0)]


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        matrices.read_matrix(spark, "a.csv")


def test_blocks(spark, folder):
    (folder / "a.coob").write_text("h\nh\nh\nh\n1 2 3 4\n0 1\n5 6\n7\n2\n2\n")
    assert cells(matrices.blocks_to_coo(matrices.read_blocks(spark, str(folder / "a.coob")))) == [(0, 5, 1.0), (0, 6, 2.0), (1, 5, 3.0), (1, 6, 4.0), (2, 2, 7.0)]


def test_path_parts(spark):
    df = spark.createDataFrame([("/data/dlmc/rn50/magnitude/0.8/a.smtx",)], "matrix_id string")
    assert matrices.with_path_parts(df).select("model", "pruning", "sparsity", "file").first()[:] == ("rn50", "magnitude", "0.8", "a.smtx")


def test_mapping_round_trip(spark, folder):
    mapping = patterns.greedy_mapping(spark, 3, [1, 2, 4, 7])
    logs.write_mapping(mapping, 3, str(folder / "m"))
    part = next((folder / "m").glob("part-*"))
    (folder / "mapping_abc.txt").write_text(part.read_text())
    back = logs.read_mapping(spark, str(folder / "mapping_abc.txt"))
    assert back.select("mapping_id", "m_r").distinct().collect() == [("abc", 3)]
    assert back.select("pattern", "kernels").exceptAll(mapping).count() == 0 and back.count() == 7
    assert len(logs.mapping_id(mapping).first()[0]) == 5


def test_merged_and_probabilities(spark, folder):
    (folder / "g.txt").write_text("15,3,12\n7,1\n")
    merged = logs.read_merged(spark, str(folder / "g.txt"))
    assert sorted(map(tuple, merged.collect())) == [(7, 1), (15, 3), (15, 12)]
    assert sorted(x[0] for x in logs.merged_lines(merged).collect()) == ["15,3,12", "7,1"]
    (folder / "p.csv").write_text("0b00000011, 0.12\n0b11111111, 0.5\n")
    assert sorted(map(tuple, logs.read_probabilities(spark, str(folder / "p.csv")).collect())) == [(3, 0.12), (255, 0.5)]
    assert matrix.codelet_matrix(spark, [(3, 0.12), (255, 0.5)], 8, 10).count() == 3 * 2 + 7 * 8


def test_result_log(spark, folder):
    (folder / "a.csv").write_text("config,correct,name,time median,\nm_tile:32|k_tile:64,correct,X,40.5,\n,correct,Y,81.0,\n")
    (folder / "b.csv").write_text("name,nnz,time median,\nX,12,1.5,\n")
    df = logs.read_results(spark, [str(folder / "a.csv"), str(folder / "b.csv")])
    assert set(df.columns) == {"config", "correct", "name", "time median", "nnz"} and df.count() == 3
    assert df.where("name = 'X' and config is not null").select(scalar.config_map(F.col("config"))["k_tile"]).first()[0] == "64"
    with pytest.raises(ValueError):
        logs.append_results(df, str(folder / "log"), ["name"])
    logs.append_results(df.select("name", "nnz"), str(folder / "log"), ["name", "nnz", "extra"])
    logs.append_results(df.select("name"), str(folder / "log"), ["name", "nnz", "extra"])
    assert spark.read.csv(str(folder / "log"), header=True).count() == 6


def test_file_list(spark, folder):
    (folder / "l.txt").write_text("a.mtx,32,7\nb.mtx\n\nc.mtx,128\n")
    files = logs.read_file_list(spark, str(folder / "l.txt"), ["opt"])
    got = {x["path"]: (x["ord"], x["b_cols"], x["options"]) for x in files.collect()}
    assert got == {"a.mtx": (0, 32, {"opt": "7"}), "b.mtx": (1, None, {}), "c.mtx": (3, 128, {})}
    assert logs.skip_listed(logs.slice_list(files, 0, 2), ["b."]).count() == 1


def test_layers(spark, folder):
    (folder / "t.json").write_text('{"benchmarks":[{"name":"Base/threads:1","real_time":"30.0","layer_1":"10.0","layer_2":"20.0"}]}')
    assert sorted(map(tuple, logs.read_layers(spark, str(folder / "t.json")).collect())) == [("Base", 1, 30.0, 1, 10.0), ("Base", 1, 30.0, 2, 20.0)]


def test_partitioned_cache_prunes(spark, folder):
    logs.write_partitioned(spark.range(10).withColumn("threads", F.col("id") % 2), str(folder / "c"), ["threads"])
    df = spark.read.parquet(str(folder / "c")).where("threads = 1")
    assert df.count() == 5 and "PartitionFilters: [isnotnull(threads" in df._jdf.queryExecution().toString()


def test_stream_of_results(spark, folder, small_dir):
    schema = spark.read.parquet(f"{small_dir}/events.parquet").schema
    source = folder / "events"
    spark.read.parquet(f"{small_dir}/events.parquet").repartition(3).write.parquet(str(source))
    log = results_stream.read_log_stream(spark, str(source), schema, "parquet").select("user_id", F.col("event_type").alias("name"), F.col("value").alias("time"))
    query = results_stream.start(results_stream.best_methods(log, ["user_id"]), "best", str(folder / "cp"))
    query.awaitTermination(120)
    batch = results_stream.best_methods(spark.read.parquet(str(source)).select("user_id", F.col("event_type").alias("name"), F.col("value").alias("time")), ["user_id"])
    assert spark.table("best").exceptAll(batch).count() == 0 and spark.table("best").count() == batch.count()


def test_scalars(spark):
    one = spark.range(1)
    name = F.lit("M8N3_NKM_LB_TLB128_SA_orig")
    got = one.select(scalar.method_fields(name).alias("f")).first()["f"]
    assert got[:] == (8, 3, "NKM", True, 128, True, "orig")
    assert one.select(scalar.rounded(F.lit(0.125))).first()[0] == 0.12
    assert one.select(scalar.bucket_right(F.lit(0.0), [0.0, 0.7]), scalar.bucket_right(F.lit(0.7), [0.0, 0.7, 0.8]), scalar.bucket_left(F.lit(0.7), [0.0, 0.7, 0.8])).first()[:] == (None, 0, 1)
    assert one.select(scalar.extract_int(F.lit("no"), r"M(\d)")).first()[0] is None
    assert one.select(scalar.upper_median(F.array(*map(F.lit, [4, 1, 3, 2])))).first()[0] == 3
