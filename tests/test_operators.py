import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import graph, linalg, matrix, membership, patterns, results, structure
from gridweave.plans.prefix import exclusive_prefix


def random_coo(spark, m=37, k=53, density=0.3, seed=1):
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((m, k)) < density, rng.integers(1, 9, (m, k)), 0).astype(float)
    i, j = np.nonzero(dense)
    rows = [(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j)]
    return dense, spark.createDataFrame(rows, "i long, j long, v double")


@pytest.mark.parametrize("strategy", ["coord", "vector", "blocked", "pattern", "hybrid", "delta"])
def test_products_agree_with_numpy(spark, strategy):
    dense, a = random_coo(spark)
    b = np.arange(53 * 3).reshape(53, 3) % 11
    coord = spark.createDataFrame([(j, c, float(b[j, c])) for j in range(53) for c in range(3)], "j long, c int, w double")
    vector = spark.createDataFrame([(j, b[j].astype(float).tolist()) for j in range(53)], "j long, row array<double>")
    options = {
        "blocked": {"height": 8, "depth": 16},
        "pattern": {"mapping": patterns.greedy_mapping(spark, 4, [1, 2, 4, 8, 15, 3]), "height": 4},
        "hybrid": {"height": 8, "width": 16, "threshold": 0.3},
    }.get(strategy, {})
    made = linalg.spmm(a, vector if strategy in ("vector", "blocked") else coord, strategy, **options)
    got = np.zeros((37, 3))
    for row in made.collect():
        got[row["i"], row["c"]] = row["x"]
    assert np.allclose(got, dense @ b)


def test_uncovered_pattern_is_an_error(spark):
    _, a = random_coo(spark)
    b = spark.createDataFrame([(0, 0, 1.0)], "j long, c int, w double")
    mapping = spark.createDataFrame([(1, [1])], "pattern int, kernels array<int>")
    with pytest.raises(Exception, match="not covered"):
        linalg.spmm_pattern(a.where("j = 0"), b, mapping, 4).collect()


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        linalg.spmm(None, None, "none")


def test_tiles_conserve_entries_and_patterns_count_all_columns(spark):
    dense, a = random_coo(spark)
    stats = structure.tile_stats(a, 37, 53, 16, 16)
    assert stats.agg(F.sum("nnz")).first()[0] == int((dense != 0).sum())
    assert stats.agg(F.max("tile_h"), F.min("tile_h"), F.min("tile_w")).first()[:] == (16, 5, 5)
    hist = patterns.histogram(a, 37, 53, 8)
    assert hist.agg(F.sum("cnt")).first()[0] == math.ceil(37 / 8) * 53


def test_properties_against_numpy(spark):
    dense, a = random_coo(spark, 40, 64)
    on = dense != 0
    got = structure.properties(a, 40, 64, 8, 16).first()
    per_row, per_col = on.sum(1), on.sum(0)
    assert got["row_cov"] == pytest.approx(per_row.std() / per_row.mean())
    assert got["col_cov"] == pytest.approx(per_col.std() / per_col.mean())
    assert got["ell_padding"] == per_row.max() * 40 - on.sum()
    fill = on.reshape(5, 8, 4, 16).sum((1, 3)) / 128
    assert got["tile_fill_mean"] == pytest.approx(fill.mean()) and got["tile_fill_cov"] == pytest.approx(fill.std() / fill.mean())
    rows = on.reshape(5, 8, 4, 16).sum(3).ravel()
    p = rows[rows > 0] / on.sum()
    assert got["h_norm"] == pytest.approx(-(p * np.log(p)).sum() / np.log(on.sum()))


def brute_strides(on, longest):
    out = {}
    for row in on:
        steps = np.diff(np.nonzero(row)[0]).tolist()
        at = 0
        while at < len(steps):
            end = at
            while end < len(steps) and steps[end] == steps[at]:
                end += 1
            run = end - at
            while run > 0:
                take = min(run, longest)
                out[take - 1] = out.get(take - 1, 0) + 1
                run -= longest + 1
            at = end
    return out


def test_stride_runs(spark):
    dense, a = random_coo(spark, 20, 40, 0.8)
    assert {x["bin"]: x["cnt"] for x in structure.stride_runs(a, 3).collect()} == brute_strides(dense != 0, 3)


def test_row_distances(spark):
    dense, a = random_coo(spark, 20, 30)
    on = dense != 0
    got = structure.panel_distances(a, 20, 8).first()
    want = sum((on[r] ^ on[r + 1]).sum() for r in range(19) if r // 8 == (r + 1) // 8)
    assert got["total_distance"] == want and got["num_panels"] == 3
    order = {(x["p"], x["place"]): x["i"] for x in structure.greedy_order(a, 8).collect()}
    assert order[0, 0] == 0 and sorted(order.values()) == list(range(20))


def test_empty_matrix(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    assert structure.tile_stats(empty, 10, 10, 4, 4).count() == 0
    assert patterns.histogram(empty, 10, 10, 4).collect() == [(0, 30)]
    assert matrix.pointers(empty, 3).orderBy("line").collect() == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_prefix_crosses_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = exclusive_prefix(df, "v", "k", width=13).orderBy("k").collect()
    total = 0
    for row in got:
        assert row["before"] == total
        total += row["v"]


def test_exact_cover_and_matching():
    sets = [(0b11, 1.0), (0b100, 1.0), (0b111, 2.5), (0b1, 0.2), (0b10, 0.2)]
    assert patterns.exact_cover(0b111, sets) == ([3, 4, 1], 1.4)
    assert patterns.exact_cover(0b111, sets, 1) == ([2], 2.5)
    assert patterns.exact_cover(0b1000, sets) is None
    chosen, cost = patterns.greedy_cover(0b111, sets)
    assert sorted(chosen) == [1, 3, 4] and cost == pytest.approx(1.4)
    assert patterns.greedy_matching([(0, 1, 3), (1, 2, 1), (2, 3, 2)]) == [(1, 2)]


def test_least_squares_needs_independent_features(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 8.0), (2.0, 1.0, 7.0), (3.0, 3.0, 15.0)], "a double, b double, y double")
    assert patterns.least_squares(rows, ["a", "b"], "y") == pytest.approx([2.0, 3.0])
    with pytest.raises(ValueError):
        patterns.least_squares(rows.withColumn("b", F.col("a") * 2), ["a", "b"], "y")


def test_four_constants_of_the_panel_cost(spark):
    """Panel, check, base and entry constants are found again from panel costs."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 900), rng.integers(0, 50, 900))})
    a = spark.createDataFrame(rows, "i long, j long")
    cost = patterns.panel_cost(a, patterns.identity_mapping(spark, 4), 4, panel=5.0, check=2.0, base=3.0, entry=4.0)
    counts = [F.lit(1.0).alias("panel"), F.count_distinct("pattern").alias("kinds"), F.count(F.lit(1)).alias("cols"), F.sum(F.bit_count("pattern")).alias("nnz")]
    features = patterns.codes(a, 4).groupBy("p").agg(*counts)
    assert patterns.least_squares(features.join(cost, "p"), ["panel", "kinds", "cols", "nnz"], "cost") == pytest.approx([5.0, 2.0, 3.0, 4.0])


def test_pivot_rejects_repeats_unless_told(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 1.0), (2, "b", 3.0)], "k int, name string, time double")
    with pytest.raises(Exception, match="occurs twice"):
        results.pivot_methods(df, ["k"], ["a", "b"], ["time"]).collect()
    got = results.pivot_methods(df, ["k"], ["a", "b"], ["time"], dedup=True).orderBy("k").collect()
    assert got == [(1, 1.0, None), (2, None, 3.0)]
    back = results.unpivot_columns(spark.createDataFrame(got, "k int, `time|a` double, `time|b` double"), ["k"], ["time|a", "time|b"], "n", "t").where("t is not null")
    assert back.count() == 2


def test_speedup_without_baseline_is_null(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (2, "base", 0.0)], "k int, name string, time double")
    assert [x["speedup"] for x in results.speedups(df, ["k"], "base").orderBy("k").collect()] == [None, None]


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(50, 51)]])
def test_components(spark, edges):
    found = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert found == {x: root(x) for x in parent}


def test_filter_has_no_misses(spark):
    keys = spark.range(5000).select((F.col("id") * 3).alias("k"))
    bits, words = membership.build_filter(keys, "k", 5000)
    probe = spark.range(15000).select(F.col("id").alias("k")).withColumn("hit", membership.maybe(F.col("k"), bits, words))
    found = probe.groupBy(F.col("k") % 3 == 0, "hit").count().collect()
    counts = {(a, b): n for a, b, n in found}
    assert counts[True, True] == 5000 and (True, False) not in counts and counts[False, False] > 9500
    rest = membership.drop_ids(spark.range(10).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k long")), "k", keys, 5000)
    assert sorted(x[0] for x in rest.collect() if x[0] is not None) == [1, 2, 4, 5, 7, 8] and rest.where("k is null").count() == 1


def test_released_folders_are_gone(spark):
    import os

    from gridweave.plans import staging

    path = staging.new_path(spark, "test")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    staging.release(spark, [path])
    assert not os.path.isdir(local) and path not in staging._made
