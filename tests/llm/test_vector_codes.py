import hashlib
import math
import random

import numpy as np
import pytest

from gridweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label string, id long, weights int, code string, error long, same string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x", 3, "y") for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows, entries, rounds, parts=4):
    """Plain loops over whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for _, w, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for k, xs in groups.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    coded = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    out, by_label = [], {}
    for (i, _, label), found in zip(kept, coded):
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    return sorted([(*r, by_label[r[1]]) for r in out], key=repr), digest


def odd_rows(seed, width, n=60):
    rng = random.Random(seed)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(width)], rng.choice(["a", "b", None])) for k in range(n)]
    rows += [(k + 500, list(rows[3][1]), "a") for k in range(20)]  # copies and repeated ids
    rows += [(7, [0.0] * width, None), (7, [0.0] * width, None), (None, [0.5] * width, "b"), (None, rows[0][1], "b")]
    return rows + [(900, None, "a"), (901, [], "a"), (902, [None] + [0.1] * (width - 1), "a"), (903, [math.nan] + [0.1] * (width - 1), "a"), (904, [math.inf] + [0.1] * (width - 1), "b")]


@pytest.mark.parametrize("width, entries", [(4, 256), (8, 5), (28, 16), (24, 16), (64, 9)])
def test_codes_are_those_of_plain_loops(spark, width, entries):
    rows = odd_rows(width, width)
    coded, books = vc.compress(frame(spark, rows), entries=entries, rounds=3)
    got = sorted([(r.id, r.label, r.code, r.error, r.label_error) for r in coded.collect()], key=repr)
    assert (got, books.digest()) == brute(rows, entries, 3)


def test_nothing_comes_of_nothing(spark):
    coded, books = vc.compress(frame(spark, []))
    assert coded.collect() == [] and books.books.size == 0
    coded, _ = vc.compress(frame(spark, [(1, None, "a")]))
    assert coded.collect() == []


def test_wrong_lengths_and_sizes_are_errors(spark):
    with pytest.raises(ValueError):
        vc.compress(frame(spark, [(1, [0.1] * 6, "a")]))
    with pytest.raises(Exception, match="one length"):
        vc.compress(frame(spark, [(k, [0.1] * 8, "a") for k in range(300)] + [(999, [0.1] * 12, "a")]))
    with pytest.raises(Exception, match="too large"):
        vc.compress(frame(spark, [(1, [1e7] * 8, "a"), (2, [1.0] * 8, "a")]))
    with pytest.raises(Exception, match="64 bits"):
        vc.compress(frame(spark, [(1, [1e30] * 8, "a")]))


@pytest.mark.parametrize("length", [1, 2, 5, 12, 16, 30])
@pytest.mark.parametrize("scale", [2, 1000, 1 << 20])
def test_bounds_filter_no_nearest_entry(length, scale):
    rng = np.random.default_rng(length * scale)
    rows, book = rng.integers(-scale, scale, (300, length)), rng.integers(-scale, scale, (40, length))
    book[7] = book[3]
    rows[::9] = book[rng.integers(0, 40, len(rows[::9]))]
    entry, distance, asked = vc.nearest(rows, book)
    every = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    if scale > 2 and length >= 12:
        assert asked < rows.shape[0] * len(book)


@pytest.mark.parametrize("length", [1, 7, 12, 64])
def test_levels_refine_each_other(length):
    made = vc.levels(length)
    assert all(length % k == 0 for k in made) and all(b % a == 0 for a, b in zip(made, made[1:]))


def test_round_trip_of_codes(spark):
    rows = odd_rows(1, 8)
    staged = vc.whole_numbers(frame(spark, rows))
    books = vc.fit(staged, entries=6, rounds=2)
    codes = vc.encode(staged, books)
    back = {(r.id, r.code): r.weights for r in vc.decode(codes, books).collect()}
    for r in codes.join(staged, "id").collect():
        assert len(back[r.id, r.code]) == 8
    errors = {r.id: (r.error, r.code) for r in codes.where("id < 7").collect()}
    for r in staged.where("id < 7").collect():
        error, code = errors[r.id]
        assert error == sum((a - b) ** 2 for a, b in zip(r.weights, back[r.id, code]))
