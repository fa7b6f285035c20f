"""Similarity join and order of all rows of a matrix against plain loops."""

import random
import time

import numpy as np
import pytest

from gridweave.operators import reordering, similarity
from gridweave.plans import whole


def frame(spark, rows):
    cells = [(i, j, "x", 1) for i, columns in rows.items() for j in columns]
    return spark.createDataFrame(cells, "i long, j long, key string, at int").repartition(3)


def some_rows(seed, n=120, columns=40):
    rng = random.Random(seed)
    base = [rng.sample(range(columns), rng.randint(1, 14)) for _ in range(20)]
    rows = {}
    for k in range(n):
        row = set(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            row ^= {rng.randrange(columns)}
        rows[k * 3] = row | {99} if k % 3 else row or {5}  # two thirds of all rows have column 99
    return {i: r for i, r in rows.items() if r}


@pytest.mark.parametrize("threshold, common, depth", [(0.8, 200, 4), (0.8, 3, 4), (0.5, 1, 2), (0.3, 2, 5), (1.0, 1, 2)])
def test_similar_rows_are_all_found(spark, threshold, common, depth):
    rows = some_rows(int(threshold * 100))
    members, pairs = similarity.similar_rows(frame(spark, rows), threshold, common, depth)
    first = {}
    for i in sorted(rows):
        first.setdefault(frozenset(rows[i]), i)
    assert dict(members.collect()) == {i: first[frozenset(r)] for i, r in rows.items()}
    reps = sorted(first.values())
    expected = {(a, b) for a in reps for b in reps if a < b and len(rows[a] & rows[b]) >= threshold * len(rows[a] | rows[b]) - 1e-9}
    got = [(r.i1, r.i2) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    counts = {r.i: (r.class_id, r.copies, r.links) for r in similarity.link_counts(members, pairs).collect()}
    assert counts[reps[0]] == (reps[0], sum(rows[i] == rows[reps[0]] for i in rows), sum(reps[0] in p for p in expected))


def test_common_keys_make_no_pairs(spark):
    rows = {k: {0, 1, 2, 3, 10 + k} for k in range(300)}  # four columns that all rows have
    _, sets = similarity.classes(similarity.row_sets(frame(spark, rows)))
    assert similarity.candidates(sets, 0.8).count() == 0


def walk(rows, distance):
    """The sequential walk: always the nearest row that is left."""
    left = sorted(rows)
    order = [left.pop(0)]
    while left:
        order.append(min(left, key=lambda r: (distance(order[-1], r), r)))
        left.remove(order[-1])
    return order


@pytest.mark.parametrize("finish, n", [(25, 90), (1024, 150)])
def test_order_is_a_permutation_near_the_walk(spark, finish, n):
    rows = some_rows(7, n)
    nz = frame(spark, rows)
    placed = reordering.nearest_order(nz, finish=finish)
    distances = sorted((r.place, r.i, r.distance) for r in reordering.path_distances(nz, placed).collect())
    order = [i for _, i, _ in distances]
    assert [p for p, _, _ in distances] == list(range(len(rows))) and sorted(order) == sorted(rows)
    between = lambda a, b: len(rows[a] ^ rows[b])
    assert [d for _, _, d in distances[1:]] == [between(a, b) for a, b in zip(order, order[1:])] and distances[0][2] is None
    path = lambda o: sum(map(between, o, o[1:]))
    assert path(order) <= 1.1 * path(walk(rows, between))
    panels = lambda o: sum(between(a, b) for k, (a, b) in enumerate(zip(o, o[1:])) if (k + 1) % 16)
    assert panels(order) <= 1.1 * panels(walk(rows, between))


def test_orders_of_few_rows(spark):
    for finish, rows in ((512, {}), (1, {4: {1}}), (1, {4: {1}, 2: {3}}), (512, {k: {1} for k in range(5)})):
        assert sorted(r.place for r in reordering.nearest_order(frame(spark, rows), finish=finish).collect()) == list(range(len(rows)))


def test_joined_ends_take_the_nearest_first():
    ends = [(0, [1, 2]), (1, [8, 9]), (5, [1, 2, 3]), (6, [8, 9, 7])]
    placed = reordering.joined_ends(ends, [(0, 0, 1, 2), (5, 5, 6, 3)])
    assert sorted(f for f, _, _ in placed) == [0, 5] and len({flip for _, _, flip in placed}) == 2


def test_order_of_the_small_table(spark, small_dir):
    cells = whole.matrix_o(spark, small_dir)
    rows = {}
    for i, j in cells.collect():
        rows.setdefault(i, set()).add(j)
    between = lambda a, b: len(rows[a] ^ rows[b])
    got = sorted((r.place, r.i) for r in reordering.nearest_order(cells).collect())
    order = [i for _, i in got]
    assert [p for p, _ in got] == list(range(len(rows))) and sorted(order) == sorted(rows)
    theirs = walk(rows, between)
    assert sum(map(between, order, order[1:])) <= 1.1 * sum(map(between, theirs, theirs[1:]))


def test_shared_columns_of_rare_and_common_ones():
    rng = random.Random(3)
    rows = [{j for j in range(60) if rng.random() < (0.9 if j < 5 else 0.2)} for _ in range(100)] + [set()]
    values = [j for row in rows for j in sorted(row)]
    got = reordering.shared_columns(np.array(values, dtype=np.int64), np.array([len(r) for r in rows]))
    assert all(got[x, y] == len(rows[x] & rows[y]) for x in range(101) for y in range(101) if x != y)


def test_last_fragments_of_long_rows_are_joined_fast():
    rng = random.Random(4)
    ends = [(k, sorted(rng.sample(range(100_000), 500))) for k in range(800)]
    start = time.monotonic()
    placed = reordering.joined_ends(ends, [(k, k, k, 1) for k in range(800)])
    assert sorted(f for f, _, _ in placed) == list(range(800)) and time.monotonic() - start < 20


def test_rounds_are_few(spark, monkeypatch):
    labels, write = [], reordering.materialise
    monkeypatch.setattr(reordering, "materialise", lambda df, label: labels.append(label) or write(df, label))
    rows = some_rows(9, 3000, 60)
    placed = reordering.nearest_order(frame(spark, rows), finish=30).collect()
    assert sorted(r.place for r in placed) == list(range(len(rows))) and sorted(r.i for r in placed) == sorted(rows)
    assert labels.count("joins") <= 6


def test_keys_of_rows_are_made_without_a_join(spark, monkeypatch):
    plans, write = {}, similarity.materialise
    monkeypatch.setattr(similarity, "materialise", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()) and write(df, label))
    similarity.similar_rows(frame(spark, some_rows(5)), 0.8)
    assert "Join" not in plans["prefix-keys"]
