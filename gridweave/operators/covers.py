"""Cheap exact covers from large families of sets, with a bound that says how far from the cheapest they can be.

``members(subset_id, element)`` are the sets of a family and ``costs(subset_id, cost)`` their positive costs; a cover takes
disjoint sets that hold every element once. The linear relaxation's dual gives each element a price so that
no set's elements cost more than the set: the sum of prices is then a lower bound of any cover. Prices start at
the least cost for an element that any set has, and rise in rounds by the slack that the tightest set of
each element leaves, which keeps them feasible: in each round a set's ratio of prices to cost is summed up and
an element takes the largest ratio of its sets.

The cover is greedy in rounds of thresholds. Sets whose cost is at most ``threshold`` times the prices of
their elements are candidates; a candidate that is the best of all its elements is taken, all such at once, and sets that
meet taken ones are dropped. When none is left the threshold rises. No task holds the family; what is
collected is one sum a round.

Elements and sets are named by numbers. Repeated members count once. Sets without a cost, or costs that are not positive, are left
out; elements that cannot be covered any more are an error, so a family should hold each element alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.plans.staging import materialise

#: Rounds in which prices rise, and the factor between two thresholds.
ROUNDS, STEP = 8, 1.05


def prices(members: DataFrame, costs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(element, price)`` whose sum over the elements of any set is at most its cost."""
    sized = members.groupBy("subset_id").agg(F.count(F.lit(1)).alias("size")).join(costs, "subset_id")
    start = members.join(sized.select("subset_id", (F.col("cost") / F.col("size")).alias("share")), "subset_id")
    price = materialise(start.groupBy("element").agg(F.min("share").alias("price")), "prices")
    for _ in range(rounds):
        held = members.join(price, "element")
        ratio = held.groupBy("subset_id").agg(F.sum("price").alias("sum")).join(costs, "subset_id").select("subset_id", (F.col("sum") / F.col("cost")).alias("ratio"))
        most = members.join(ratio, "subset_id").groupBy("element").agg(F.max("ratio").alias("ratio"))
        price = materialise(price.join(most, "element").select("element", (F.col("price") / F.col("ratio")).alias("price")), "prices")
    return price


def cover(members: DataFrame, costs: DataFrame, rounds: int = ROUNDS, step: float = STEP) -> tuple[DataFrame, float]:
    """``(subset_id, cost)`` of a cover, and a lower bound of the cost of all covers."""
    costs = costs.where("cost > 0").select("subset_id", F.col("cost").cast("double").alias("cost"))
    members = materialise(members.select("subset_id", "element").distinct().join(costs.select("subset_id"), "subset_id", "left_semi"), "members")
    price = prices(members, costs, rounds)
    bound = price.agg(F.coalesce(F.sum("price"), F.lit(0.0))).first()[0]
    sets = members.join(price, "element").groupBy("subset_id").agg(F.sum("price").alias("sum"), F.count(F.lit(1)).alias("size")).join(costs, "subset_id")
    sets = materialise(sets.select("subset_id", "cost", "size", (F.col("cost") / F.col("sum")).alias("over")), "sets")
    left, taken_all, open_, threshold = members, None, members.select("element").distinct().count(), 1.0
    while open_:
        alive = materialise(left.join(sets, "subset_id"), "alive")
        least = alive.agg(F.min("over")).first()[0]
        if least is None:
            raise ValueError(f"{open_} elements are in no set that is left")
        threshold = max(threshold, least * step)
        # Of sets at one price the larger comes first.
        best = alive.where(F.col("over") <= threshold).groupBy("element").agg(F.min(F.struct("over", (-F.col("size")).alias("smaller"), "subset_id")).alias("x"))
        won = best.groupBy("x.subset_id").agg(F.count(F.lit(1)).alias("won")).join(sets, "subset_id").where(F.col("won") == F.col("size"))
        taken = materialise(won.select("subset_id", "cost", "size"), "taken")
        taken_all = taken if taken_all is None else taken_all.unionByName(taken)
        open_ -= taken.agg(F.sum("size")).first()[0]
        gone = left.join(taken.select("subset_id"), "subset_id", "left_semi").select("element")
        met = left.join(gone, "element", "left_semi").select("subset_id").distinct()
        left = materialise(left.join(met, "subset_id", "left_anti"), "members")
    if taken_all is None:
        return costs.where("false"), 0.0
    return taken_all.select("subset_id", "cost"), bound
