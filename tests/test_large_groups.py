"""Order statistics, bit maps, profiles and matchings against plain Python."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridweave.operators import hybrid, order_statistics, patterns, results, structure


def values(kind, seed):
    rng = random.Random(seed)
    if kind == "double":
        return [rng.choice([0.0, -0.0, 1.5, math.inf, -math.inf, rng.uniform(-1e300, 1e300), rng.gauss(0, 1), 1e-310]) for _ in range(200)] + [None] * 5
    if kind == "float":
        return [float(rng.randint(-50, 50)) / 8 for _ in range(150)]
    if kind.startswith("decimal"):
        return [Decimal(rng.randint(-(10**12), 10**12)).scaleb(-3) for _ in range(120)] + [None]
    return [rng.choice([-(2**31), 2**31 - 1, rng.randint(-9, 9), 7, 7]) for _ in range(180)]


@pytest.mark.parametrize("kind", ["double", "float", "bigint", "int", "decimal(18,3)"])
@pytest.mark.parametrize("most", [3, 1000])
def test_elements_of_sorted_values(spark, kind, most):
    rows = [(k, "a", v) for k, seed in (("x", 1), (None, 2)) for v in values(kind, seed)] + [("y", "a", v) for v in values(kind, 3)[:2]] + [("z", "a", None)]
    df = spark.createDataFrame(rows, f"n string, k0 string, value {kind}").repartition(3)
    got = {r.n: r for r in order_statistics.elements(df, ["n"], "value", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "high": lambda n: n - 1}, most).collect()}
    assert set(got) == {"x", "y", None}
    for group, row in got.items():
        held = sorted(v for k, _, v in rows if k == group and v is not None)
        assert (row.low, row.mid, row.high) == (held[0], held[len(held) // 2], held[-1])


def test_percentiles_are_those_of_small_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.gauss(0, 10)) for _ in range(300)] + [("d", None), ("e", math.nan), ("e", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {"p0": 0.0, "p3": 0.3, "med": 0.5, "p99": 0.99, "p1": 1.0}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in asked.items()]).collect()}
    got = order_statistics.percentiles(df, ["k"], "v", asked, most=5).collect()
    assert len(got) == len(want) == 5
    for row in got:
        for name in asked:
            assert row[name] == pytest.approx(want[row.k][name], nan_ok=True) if want[row.k][name] is not None else row[name] is None
    assert order_statistics.medians(df.where("false"), ["k"], "v", "m").collect() == []
    with pytest.raises(TypeError):
        order_statistics.elements(df, ["v"], "k", {"x": lambda n: F.lit(0)})


@pytest.mark.parametrize("height, width", [(16, 64), (5, 200), (1, 1), (300, 2000), (64, 1024), (40000, 40000)])
def test_active_lines_of_tiles(spark, height, width):
    rng = random.Random(height)
    cells = {(rng.randrange(700), rng.randrange(5000)) for _ in range(1500)}
    nz = spark.createDataFrame([(i, j, 1.0) for i, j in cells], "i long, j long, v double")
    tiles = {}
    for i, j in cells:
        tiles.setdefault((i // height, j // width), []).append((i, j))
    got = {(r.ti, r.tj): (r.nnz, r.active_rows, r.active_cols, r.tile_h, r.tile_w) for r in structure.tile_stats(nz, 700, 5000, height, width).collect()}
    assert got == {t: (len(x), len({i for i, _ in x}), len({j for _, j in x}), min(height, 700 - t[0] * height), min(width, 5000 - t[1] * width)) for t, x in tiles.items()}


def test_tiles_are_marked_in_one_aggregate(spark):
    nz = spark.createDataFrame([(1, 2, 1.0)], "i long, j long, v double")
    plan = structure.tile_stats(nz, 10, 10, 16, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def profile(spark, events, mapping):
    df = spark.createDataFrame(events, "event long, parent long, name string, total double, up long, inner boolean")
    return dict(results.profile_shares(df, mapping).collect())


def test_profile_of_a_long_chain(spark):
    n = 120
    events = [(k, k - 1 if k else None, "hit" if k == 100 else "x", float(n - k), 0, True) for k in range(n)]
    assert profile(spark, events, {"hit": "kernel"}) == {"remaining": 100.0, "kernel": 20.0}


def test_profile_of_random_trees(spark):
    rng = random.Random(5)
    parents = [None if k < 3 else rng.randrange(k) for k in range(150)]
    names, own = [rng.choice("aabbcdefgh") for _ in parents], [rng.randint(1, 9) for _ in parents]
    total = list(own)
    for k in reversed(range(len(parents))):
        if parents[k] is not None:
            total[parents[k]] += total[k]
    want = {}
    for k in range(len(parents)):
        above, covered = parents[k], False
        while above is not None:
            covered, above = covered or names[above] in "ab", parents[above]
        if not covered:
            kernel = {"a": "A", "b": "B"}.get(names[k], "rest")
            want[kernel] = want.get(kernel, 0) + (total[k] if kernel != "rest" else own[k])
    events = [(k, p, name, float(t), 0, True) for k, (p, name, t) in enumerate(zip(parents, names, total))] + [(999, 888, "a", 5.0, 0, True)]
    df = spark.createDataFrame(events, "event long, parent long, name string, total double, up long, inner boolean")
    assert dict(results.profile_shares(df, {"a": "A", "b": "B"}, "rest").collect()) == want
    assert results.profile_shares(df.where("false"), {"a": "A"}).collect() == []


def test_cycles_of_a_profile_are_errors(spark):
    with pytest.raises(ValueError, match="cycle"):
        profile(spark, [(1, 2, "x", 1.0, 0, True), (2, 1, "x", 1.0, 0, True), (3, None, "x", 1.0, 0, True)], {"a": "A"})


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, rng.randint(0, 6)) for a in range(25) for b in range(a, 25) if rng.random() < 0.6]
    df = spark.createDataFrame([(b, a, c, "x") if k % 2 else (a, b, c, "x") for k, (a, b, c) in enumerate(pairs)] + [(1, 2, None, "x")], "a long, b long, padding long, pair string")
    got = patterns.matching(df).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(patterns.greedy_matching(pairs))
    assert patterns.matching(df.where("false")).collect() == []


def test_dropped_ids_and_clashing_names(spark):
    from gridweave.operators.membership import drop_ids

    rows = spark.createDataFrame([(k, k + 1, "x") for k in range(50)] + [(None, 1, "y")], "doc_id long, _gone long, gone string")
    dropped = spark.createDataFrame([(k,) for k in range(0, 50, 3)], "doc_id long")
    got = drop_ids(rows, "doc_id", dropped, 17).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [k for k in range(50) if k % 3] and len(got) == 34
    assert rows.columns == ["doc_id", "_gone", "gone"] and all(r._gone == r.doc_id + 1 for r in got if r.doc_id is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_entries_in_free_rectangles(spark, seed):
    rng = random.Random(seed)
    cells = sorted({(rng.randrange(60), rng.randrange(90)) for _ in range(700)})
    free = [(k, i, i + rng.choice([0, 1, 2, 7, 30]), j, j + rng.choice([1, 3, 8, 64])) for k, i, j in ((k, rng.randrange(60), rng.randrange(90)) for k in range(25))]
    free += [(40, 5, 13, 5, 13), (41, 5, 13, 5, 13), (42, 0, None, 0, 9)]
    nz = spark.createDataFrame([(i, j, 1.0, k) for k, (i, j) in enumerate(cells)], "i long, j long, v double, gi long")
    got = hybrid.entry_rectangles(nz, spark.createDataFrame(free, "rectangle long, i0 long, i1 long, j0 long, j1 long")).collect()
    want = {}
    for i, j in cells:
        inside = [(-(b - a) * (d - c), k) for k, a, b, c, d in free if b is not None and a <= i < b and c <= j < d]
        want[i, j] = min(inside)[1] if inside else None
    assert {(r.i, r.j): r.rectangle for r in got} == want and len(got) == len(cells)
    assert hybrid.entry_rectangles(nz, spark.createDataFrame([], "rectangle long, i0 long, i1 long, j0 long, j1 long")).where("rectangle is null").count() == len(cells)


def test_rectangles_meet_entries_by_equality(spark):
    nz = spark.createDataFrame([(1, 2, 1.0)], "i long, j long, v double")
    plan = hybrid.entry_rectangles(nz, spark.createDataFrame([(1, 0, 3, 0, 9)], "rectangle long, i0 long, i1 long, j0 long, j1 long"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_without_a_rectangle_are_not_joined(spark):
    nz = spark.createDataFrame([(1, 2, 1.0)], "i long, j long, v double")
    free = spark.createDataFrame([(k, 0, 1 + k, 0, 1 + 3 * k) for k in range(9)], "rectangle long, i0 long, i1 long, j0 long, j1 long")
    plan = hybrid.entry_rectangles(nz, free)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan.lower() or "bit_get" in plan.lower()


@pytest.mark.parametrize("name, dealt", [("hybrid_records", 2), ("profile_of_chains", 1), ("coalesce", 1)])
def test_rows_are_dealt_by_the_files_before_they_are_held(spark, small_dir, name, dealt):
    from gridweave.plans import catalog, extra, whole  # noqa: F401

    made = extra._records(spark, small_dir) if name == "hybrid_records" else catalog.matrix_a(spark, small_dir) if name == "coalesce" else whole._chains(spark, small_dir)
    assert made._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= dealt
