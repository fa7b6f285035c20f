"""Covers of families of sets against the cheapest of all, and their bounds."""

import random

import pytest

from gridweave.operators import covers, patterns
from gridweave.plans import whole


def frames(spark, sets):
    members = spark.createDataFrame([(k, e, "x") for k, (held, _) in enumerate(sets) for e in held], "subset_id long, element long, price string")
    return members.repartition(3), spark.createDataFrame([(k, float(c), 1) for k, (_, c) in enumerate(sets)], "subset_id long, cost double, size int")


def cheapest(n, sets):
    best = [0.0] + [float("inf")] * ((1 << n) - 1)
    masks = [(sum(1 << e for e in held), c) for held, c in sets]
    for done in range(1 << n):
        for mask, c in masks:
            if not mask & done:
                best[done | mask] = min(best[done | mask], best[done] + c)
    return best[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_is_whole_and_bounded(spark, seed):
    rng = random.Random(seed)
    n = 12
    sets = [({e}, rng.uniform(1, 6)) for e in range(n)] + [(set(rng.sample(range(n), rng.randint(2, 6))), rng.uniform(2, 12)) for _ in range(60)]
    chosen, bound = covers.cover(*frames(spark, sets))
    got = chosen.collect()
    assert sorted(e for r in got for e in sets[r.subset_id][0]) == list(range(n))
    total, least = sum(r.cost for r in got), cheapest(n, sets)
    assert bound <= least + 1e-9 and least - 1e-9 <= total <= 2 * least
    assert all(r.cost == sets[r.subset_id][1] for r in got)


def test_prices_are_feasible_and_rise(spark):
    rng = random.Random(3)
    sets = [({e}, 3.0) for e in range(9)] + [(set(rng.sample(range(9), 4)), rng.uniform(3, 9)) for _ in range(30)]
    members, costs = frames(spark, sets)
    sums = []
    for rounds in (0, 4):
        price = dict(covers.prices(members.select("subset_id", "element"), costs.select("subset_id", "cost"), rounds).collect())
        assert all(sum(price[e] for e in held) <= c + 1e-9 for held, c in sets)
        sums.append(sum(price.values()))
    assert sums[0] <= sums[1]


def test_covers_that_are_forced(spark):
    members, costs = frames(spark, [({0, 1}, 5), ({2}, 1)])
    chosen, bound = covers.cover(members, costs)
    assert sorted(r.subset_id for r in chosen.collect()) == [0, 1] and bound == pytest.approx(6)
    with pytest.raises(ValueError, match="no set"):
        covers.cover(*frames(spark, [({0, 1}, 1), ({1, 2}, 1.5)]))
    chosen, bound = covers.cover(*[df.where("false") for df in (members, costs)])
    assert chosen.collect() == [] and bound == 0


def test_four_rows_are_near_the_cheapest(spark, small_dir):
    named, members, costs = whole.pattern_family(spark, small_dir, 4)
    sets = {r.subset_id: r.patterns for r in named.collect()}
    items = sorted({p for s in sets.values() for p in s})
    price = dict(costs.collect())
    by_mask = {sum(1 << items.index(p) for p in s): price[k] for k, s in sets.items()}
    chosen, bound = covers.cover(members, costs)
    total = sum(r.cost for r in chosen.collect())
    inf = float("inf")
    _, least = patterns.cheapest_partition(len(items), [by_mask.get(mask, inf if mask else 0.0) for mask in range(1 << len(items))])
    assert bound <= least + 1e-9 and least - 1e-9 <= total <= 1.1 * least
