"""Matrices whose sizes, lines or rows are large."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import linalg, patterns, structure
from gridweave.plans import prefix
from gridweave.sources import split_readers

M, K = 60_000, 1_200_000  # their product exceeds 32 bits


@pytest.fixture
def large(spark):
    nz = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", M - 1, K - 1)], "matrix_id string, i long, j long")
    return nz, spark.createDataFrame([("a", M, K)], "matrix_id string, m int, k int")


def test_pattern_counts_of_a_large_matrix(large):
    got = patterns.keyed_counts(*large, [4]).orderBy("pattern").collect()
    assert [tuple(x) for x in got] == [(4, 1.0, 3, 1), (4, 1.0, 8, 1)]


def test_tile_densities_of_a_large_matrix(large):
    got = structure.histogram_by_range(*large, 16, 64, lambda x: scalar.sparsity_range(x, (0.0, 0.5, 1.0))).collect()
    assert [tuple(x) for x in got] == [(1, 0, M // 16 * K // 64)]


def test_sparsity_of_a_large_matrix(spark):
    row = spark.range(1).select(scalar.sparsity(F.lit(7_200_000), F.lit(M), F.lit(K)).alias("s")).first()
    assert row.s == 1 - 7_200_000 / (M * K)


def test_located_rows_have_the_span_that_holds_them(spark):
    spans = spark.createDataFrame([("a", 2, 5, 0), ("a", 5, 5, 1), ("a", 5, 40, 2), ("b", 0, 1, 3)], "matrix_id string, low long, high long, i int")
    rows = spark.range(50).selectExpr("'a' as matrix_id", "id as at").unionByName(spark.range(3).selectExpr("'b' as matrix_id", "id as at"))
    got = {(x.matrix_id, x["at"], x.i) for x in split_readers._located(rows, spans, 4).collect()}
    assert got == {("a", x, 0) for x in range(2, 5)} | {("a", x, 2) for x in range(5, 40)} | {("b", 0, 3)}


def test_sizes_of_smtx_by_ranges(spark, tmp_path):
    (tmp_path / "m.smtx").write_text("3, 40, 5\n0 2 2 5\n1 39 0 1 7\n")
    (tmp_path / "n.smtx").write_text("2,2,0\n0 0 0\n\n")
    got = {x.matrix_id.rsplit("/", 1)[1]: (x.m, x.k, x.nnz) for x in split_readers.smtx_sizes(spark, str(tmp_path)).collect()}
    assert got == {"m.smtx": (3, 40, 5), "n.smtx": (2, 2, 0)}


def test_partitions_of_windows_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id div 100 as i", "id * id % 9973 as j").write.parquet(str(tmp_path / "nz"))
    nz = spark.read.parquet(str(tmp_path / "nz"))
    monkeypatch.setattr(prefix, "DEALT_BYTES", 4096)
    assert prefix.dealt(nz, "i").rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(prefix, "DEALT_BYTES", 1 << 30)
    assert prefix.dealt(nz, "i").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def joined_rows(plan):
    """Rows out of the joins of a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return joined_rows(plan.executedPlan())
    below = [plan.plan()] if "QueryStage" in name else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for child in below for n in joined_rows(child)]


def test_panels_are_sent_for_many_tiles(spark):
    a = spark.range(2000).selectExpr("id * 8 as i", "id * 7 % 48 as j", "double(id % 5) as v")  # 2,000 tiles of one entry
    b = spark.range(48).selectExpr("id as j", "array(double(id), 1.0) as row")
    made = linalg.spmm_blocked(a, b, 8, 16)
    got = {(x.i, x.c): x.x for x in made.collect()}
    assert got == {(k * 8, c): float(k % 5 * (k * 7 % 48 if c == 0 else 1)) for k in range(2000) for c in range(2)}
    assert 16 <= sum(joined_rows(made._jdf.queryExecution().executedPlan())) < 60


@pytest.mark.parametrize("height, depth", [(64, 1024), (2, 3), (1, 1)])
def test_blocks_of_odd_values_agree_with_the_join(spark, height, depth):
    inf, far = float("inf"), 2**40 + 5
    entries = [(0, 0, 1.0), (0, 5, None), (1, 5, None), (None, 3, 2.0), (2, None, 1.0), (3, 99, 1.0), (4, 7, inf), (4, 3, 1.0), (5, 8, 2.0), (5, 2, 3.0), (6, -3, 4.0), (7, 9, 1.0), (8, far, 1.5), (9, 10, 3.0)]
    rows = [(0, [1.0, 2.0, 3.0]), (5, [1.0]), (3, [1.0, None]), (7, [1.0, 0.5]), (8, []), (2, [None, 5.0]), (-3, [1.0, 1.0, 1.0, 1.0]), (9, None), (far, [2.0]), (10, [1.0]), (10, [1.0, 7.0]), (None, [1.0])]
    a, b = spark.createDataFrame(entries, "i long, j long, v double"), spark.createDataFrame(rows, "j long, row array<double>")
    assert {tuple(x) for x in linalg.spmm_blocked(a, b, height, depth).collect()} == {tuple(x) for x in linalg.spmm_vector(a, b).collect()}
    assert linalg.spmm_blocked(a.where("i > 99"), b).count() == linalg.spmm_blocked(a, b.where("j < -9")).count() == 0
