"""Queries without SQL against brute force on small tables of their own."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from oracle import assert_same

from gridweave.functions import scalar
from gridweave.operators import matrix, patterns, structure
from gridweave.plans import catalog, staging
from gridweave.sources import experiments


def tables(spark, path, entries, suppliers=40, parts=60):
    """``lineitem`` with one row for each ``(supplier, part)``, and tables of the two sizes."""
    spark.createDataFrame([(i, j, 1.0) for i, j in entries], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.range(suppliers).write.parquet(f"{path}/supplier.parquet")
    spark.range(parts).write.parquet(f"{path}/part.parquet")
    return str(path)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_set_cover_is_the_cheapest(spark, tmp_path):
    columns = [1] * 20 + [15, 14, 13, 11, 7]
    entries = [(r, j) for j, p in enumerate(columns) for r in range(4) if p >> r & 1]
    count = Counter(columns)

    def cost(group):
        union = 0
        for p in group:
            union |= p
        return patterns.N_CHECK + sum(count[p] for p in group) / len(columns) * 128 * (patterns.N_BASE + patterns.N_ENTRY * union.bit_count())

    best = min(sum(map(cost, split)) for split in partitions(list(count)))
    got = catalog.queries()["set_cover"](spark, tables(spark, tmp_path, entries, suppliers=4, parts=len(columns))).collect()
    capped = min(sum(map(cost, split)) for split in partitions(list(count)) if max(map(len, split)) <= 3)
    assert best < capped - 1e-3 and all(x["total_cost"] == pytest.approx(best, abs=1e-5) for x in got)
    assert sorted(p for x in got for p in x["patterns"]) == sorted(count)
    assert sum(cost(x["patterns"]) for x in got) == pytest.approx(best)


def test_cheapest_partition():
    rng = random.Random(2)
    for n in range(7):
        cost = [0.0] + [rng.random() for _ in range((1 << n) - 1)]
        chosen, total = patterns.cheapest_partition(n, cost)
        assert sum(chosen) == (1 << n) - 1 and sum(cost[c] for c in chosen) == pytest.approx(total)
        assert total == pytest.approx(min(sum(cost[sum(1 << b for b in g)] for g in split) for split in partitions(list(range(n)))))


def test_large_groups_are_tried():
    assert patterns.cheapest_partition(5, [0.0] + [1.0] * 31) == ([31], 1.0)


def test_method_components(spark, tmp_path):
    rng = random.Random(3)
    entries = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(45)})
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in entries:
        parent[root((1, j))] = root((0, i))
    sizes = {}
    for x in list(parent):
        sizes[root(x)] = sizes.get(root(x), 0) + 1
    got = catalog.queries()["method_components"](spark, tables(spark, tmp_path, entries)).collect()
    assert len(sizes) > 3 and sorted(x["nodes"] for x in got) == sorted(sizes.values())


def test_hamming_panels(spark, tmp_path):
    rng = random.Random(4)
    entries = sorted({(rng.randrange(37), rng.randrange(60)) for _ in range(150)} | {(39, 0)})
    cols = [{j for i, j in entries if i == k} for k in range(40)]
    want = {(a // 16, a, b, len(cols[a] ^ cols[b])) for a in range(40) for b in range(a + 1, 40) if a // 16 == b // 16}
    got = catalog.queries()["hamming_panels"](spark, tables(spark, tmp_path, entries)).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert not all(cols) and any(not cols[a] & cols[b] for _, a, b, _ in want)


def test_greedy_order_sees_distances_only(spark, monkeypatch):
    rng = random.Random(6)
    entries = [(rng.randrange(37), rng.randrange(20)) for _ in range(200)] + [(48, 0)]
    cols = {k: {j for i, j in entries if i == k} for k, _ in entries}
    want = set()
    for p in {k // 16 for k in cols}:
        left = sorted(k for k in cols if k // 16 == p)
        order = [left.pop(0)]
        while left:
            order.append(min(left, key=lambda r: (len(cols[order[-1]] ^ cols[r]), r)))
            left.remove(order[-1])
        want |= {(p, k, place) for place, k in enumerate(order)}
    asked, real = [], structure.panel_pairs
    monkeypatch.setattr(structure, "panel_pairs", lambda *a: asked.append(a) or real(*a))
    made = structure.greedy_order(spark.createDataFrame(entries, "i long, j long"), 16)
    assert {tuple(x) for x in made.collect()} == want and asked


def brute_kernels(pattern, merges, taken=0):
    """Kernels of one pattern, mapped again and again."""
    if pattern == 0 or pattern.bit_count() < 2:
        return [pattern]
    free = [k for k in merges if not k & taken]
    if not free:
        return [1 << b for b in range(8) if pattern >> b & 1]
    costs = [1.1 * (pattern & ~k).bit_count() + (k & ~pattern).bit_count() for k in free]
    best = free[costs.index(min(costs))]
    rest = pattern & ~best
    return [best] + (brute_kernels(rest, merges, taken | best) if rest else [])


@pytest.mark.parametrize("merges", [[15, 240, 51, 204, 255], [3, 12, 48, 192], [7, 24]])
def test_recursive_mapping(spark, merges):
    made = patterns.merge_split_mapping(spark, 8, merges, recursive=True)
    got = {x["pattern"]: x["kernels"] for x in made.collect()}
    assert got == {p: brute_kernels(p, merges) for p in range(256)} and max(map(len, got.values())) > 1


def test_overlap_subsets_of_eight_rows(spark):
    """The large family: windows, strides, runs and suffixes."""
    items = sorted(range(1, 256), key=lambda x: (x.bit_count(), x), reverse=True)
    made = patterns.overlap_subsets(spark, 8)
    near = [min(7, 254 - f) for f in range(255)]
    far = [len([o for o in range(1, 32, 4) if f + o < 255]) for f in range(255)]
    runs = sum(max(0, 255 - (f + 8)) for f in range(255))
    assert made.count() == sum(2 * (2**n - 1) for n in near + far) + 255 + runs + 1
    some = made.where("first = 200 and with_first and size(members) = 3").select("members", "union").collect()
    assert some and all(items[200] in x["members"] and set(x["members"]) <= set(items[200:232]) and x["union"] == x["members"][0] | x["members"][1] | x["members"][2] for x in some)


def test_checksums(spark, tmp_path):
    names = ["", "a", "Wikipedia", "é漢", "x" * 6000]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {x["p_partkey"]: x["checksum"] for x in catalog.queries()["file_list_checksum"](spark, str(tmp_path)).collect()}
    assert got == {k: zlib.adler32(n.encode()) for k, n in enumerate(names)}


def test_codelet_widths():
    for probs in ([0.1, 0.2, 0.7], [0.9, 0.9, 0.9], [0.0, 0.0, 1.0], [0.01] * 5):
        got = matrix.codelet_widths([(0, 0.5)] + [(k + 1, p) for k, p in enumerate(probs)], 10)
        assert sum(n for _, n in got) == 10 and min(n for _, n in got) >= 1 and [c for c, _ in got] == list(range(1, len(probs) + 1))
    with pytest.raises(ValueError):
        matrix.codelet_widths([(k, 0.1) for k in range(1, 12)], 10)


def test_codelet_panel_of_rare_patterns(spark, tmp_path):
    """Rare patterns that get a column each take the panel beyond 6,000 columns, as in the SQL."""
    cells = [(k % 4, 10 + k) for k in range(40_000)] + [(i, j) for j, code in enumerate((3, 5, 6, 7, 9, 10, 11, 12, 13, 14)) for i in range(4) if code >> i & 1]
    spark.createDataFrame([(i, j, 1.0) for i, j in cells], "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    made = catalog.queries()["codelet_panel"](spark, str(tmp_path))
    assert made.select("j").distinct().count() > 6000
    assert_same(made, db, catalog.oracle_sql()["codelet_panel"])


def test_sparsity_below_the_ranges_is_an_error(spark):
    rows = spark.createDataFrame([(0.7,), (1.0,), (None,)], "s double")
    assert [x["r"] for x in rows.select(scalar.sparsity_range(rows.s).alias("r")).collect()] == [0, 2, None]
    with pytest.raises(Exception, match="no range"):
        rows.select(scalar.sparsity_range(rows.s - 0.5).alias("r")).collect()


def test_experiment_in_yaml(spark, tmp_path):
    (tmp_path / "e.yaml").write_text("options:\n  b_cols: [32]\n  n_threads: 2\nmethods:\n- name: a\n- name: b\n  tune: {grid: g}\ntuning_grids:\n- name: g\n  m: [1, 2]\n  k: [3]\n")
    spec = experiments.read_spec(spark, str(tmp_path / "e.yaml"))
    files = spark.createDataFrame([("x",), ("y",)], "matrix string")
    got = {tuple(x) for x in experiments.runs(spark, spec, files, {"b_cols": 64}).collect()}
    assert got == {(f, m, c, 64, 2) for f in "xy" for m, c in (("a", ""), ("b", "m:1|k:3"), ("b", "m:2|k:3"))}
    with pytest.raises(ValueError):
        experiments.runs(spark, {"methods": [{"name": "a", "tune": {"grid": "none"}}]}, files)


def test_released_tables_are_our_own(spark):
    path, table = staging.new_table(spark, "blocks")
    spark.range(3).write.bucketBy(2, "id").format("parquet").option("path", path).saveAsTable(table)
    spark.sql("CREATE TABLE gridweave_of_another (x INT) USING parquet")
    staging.release(spark, [path])
    left = {t.name for t in spark.catalog.listTables()}
    assert table not in left and "gridweave_of_another" in left
    spark.sql("DROP TABLE gridweave_of_another")
