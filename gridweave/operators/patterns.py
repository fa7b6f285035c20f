"""Bit patterns of row panels: codes, histograms, mappings to kernels, costs and covers.

A panel is ``height`` consecutive rows; the entries of one of its columns form a pattern whose bit 0
is the panel's first row. The last panel may be short.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import sparsity
from gridweave.plans.prefix import dealt
from gridweave.plans.staging import materialise

#: Constants of the subset cost (fixed values): check, base and entry cost.
N_CHECK, N_BASE, N_ENTRY = 2.0, 1.15, 0.2
#: Most groups that pair costs are made for: patterns of eight rows.
MOST_GROUPS = 256


def codes(nz: DataFrame, height: int) -> DataFrame:
    """``(p, j, pattern)`` of each non-empty panel column."""
    bit = F.call_function("shiftleft", F.lit(1), (F.col("i") % height).cast("int"))
    return nz.groupBy(F.floor(F.col("i") / height).cast("long").alias("p"), "j").agg(F.bit_or(bit).alias("pattern"))


def histogram(nz: DataFrame, m: int, k: int, height: int) -> DataFrame:
    """``(pattern, cnt)`` over all panel columns; the empty pattern is counted by arithmetic."""
    found = codes(nz, height).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    empty = found.agg((F.lit(math.ceil(m / height) * k) - F.coalesce(F.sum("cnt"), F.lit(0))).alias("cnt")).select(F.lit(0).alias("pattern"), "cnt")
    return found.unionByName(empty)


def all_patterns(spark: SparkSession, height: int, bits: int | None = None) -> DataFrame:
    """Every pattern of a panel, or those with ``bits`` bits set."""
    every = spark.range(1 << height).select(F.col("id").cast("int").alias("pattern"))
    return every if bits is None else every.where(F.bit_count("pattern") == bits)


def rows_of(pattern: Column, height: int) -> Column:
    """Row numbers of a pattern's bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(height - 1)), lambda b: F.getbit(pattern, b) == 1)


def text_of(pattern: Column, height: int) -> Column:
    return F.concat(F.lit("0b"), F.lpad(F.bin(pattern.cast("long")), height, "0"))


def cyclic_shift(pattern: Column, by: int, height: int) -> Column:
    mask = (1 << height) - 1
    by %= height
    return F.shiftleft(pattern, by).bitwiseOR(F.shiftright(pattern, height - by)).bitwiseAND(F.lit(mask))


def random_probability(pattern: Column, sparsity: Column | float, height: int) -> Column:
    """Chance of a pattern when entries fall at random."""
    s = F.lit(sparsity) if isinstance(sparsity, float) else sparsity
    bits = F.bit_count(pattern)
    return F.pow(s, F.lit(height) - bits) * F.pow(1 - s, bits)


def by_popcount(hist: DataFrame) -> DataFrame:
    """``(bits, cnt, nnz_share)``: columns by the number of entries, and the share of entries."""
    counts = hist.groupBy(F.bit_count("pattern").cast("int").alias("bits")).agg(F.sum("cnt").alias("cnt"))
    mass = F.col("bits") * F.col("cnt")
    total = counts.agg(F.sum(mass).cast("double")).scalar()
    return counts.withColumn("nnz_share", F.try_divide(mass.cast("double"), total))


def panel_popcounts(nz: DataFrame, height: int) -> DataFrame:
    """``(p, bits, cnt)``: columns of each panel by their number of entries."""
    return codes(nz, height).groupBy("p", F.bit_count("pattern").cast("int").alias("bits")).agg(F.count(F.lit(1)).alias("cnt"))


def distance_from_random(hist: DataFrame, sparsity: float, height: int) -> DataFrame:
    """Entry-weighted observed share of each pattern less its weighted chance at random."""
    every = all_patterns(hist.sparkSession, height)
    seen = every.join(hist, "pattern", "left").select("pattern", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    total = hist.agg(F.sum("cnt").cast("double")).scalar()
    bits = F.bit_count("pattern")
    return seen.select("pattern", (bits * (F.col("cnt") / total - random_probability(F.col("pattern"), sparsity, height))).alias("distance"))


def average_distribution(hists: DataFrame, key: str, height: int) -> DataFrame:
    """Mean over matrices of their normalised histograms; a pattern that one lacks counts as 0."""
    share = F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key))
    n = hists.agg(F.count_distinct(key)).scalar()
    summed = hists.withColumn("share", share).groupBy("pattern").agg(F.sum("share").alias("s"))
    every = all_patterns(hists.sparkSession, height)
    return every.join(summed, "pattern", "left").select("pattern", F.coalesce(F.col("s") / n, F.lit(0.0)).alias("share"))


def identity_mapping(spark: SparkSession, height: int) -> DataFrame:
    """Each non-empty pattern is its own kernel."""
    return all_patterns(spark, height).where("pattern > 0").select("pattern", F.array("pattern").alias("kernels"))


def single_bit_mapping(spark: SparkSession, height: int) -> DataFrame:
    """A kernel for each entry."""
    bit = F.transform(rows_of(F.col("pattern"), height), lambda b: F.call_function("shiftleft", F.lit(1), b))
    return all_patterns(spark, height).where("pattern > 0").select("pattern", bit.alias("kernels"))


def greedy_map(pattern: int, kernels: Sequence[int], split_cost: float = 1.1) -> list[int]:
    """Kernels for one pattern: again and again the one of the lowest cost, ``split_cost`` for using
    one more kernel and 1 for each padded zero, per entry that it newly covers. Ties go to the
    kernel that covers more, then to the smaller one."""
    left, chosen = pattern, []
    while left:
        options = [(k, (k & left).bit_count()) for k in kernels if k & left]
        if not options:
            raise ValueError(f"no kernel covers pattern {pattern:b}")
        best = min(options, key=lambda x: ((split_cost + (x[0] & ~pattern).bit_count()) / x[1], -x[1], x[0]))[0]
        chosen.append(best)
        left &= ~best
    return chosen


def greedy_mapping(spark: SparkSession, height: int, kernels: Sequence[int], split_cost: float = 1.1) -> DataFrame:
    """:func:`greedy_map` for all patterns; at most ``2 ** height`` rows."""
    rows = [(p, greedy_map(p, kernels, split_cost)) for p in range(1, 1 << height)]
    return spark.createDataFrame(rows, "pattern int, kernels array<int>")


def _cheapest_merge(pattern: Column, taken: Column, merges: Sequence[int], split_cost: float, merge_cost: float) -> Column:
    """``(cost, at, kernel)`` of the merge kernel of the lowest cost among those that meet nothing in
    ``taken``; ties go to the first listed. Null if there is none."""
    options = []
    for at, kernel in enumerate(merges):
        k = F.lit(kernel)
        missed = F.bit_count(pattern.bitwiseAND(F.bitwise_not(k)))
        padded = F.bit_count(k.bitwiseAND(F.bitwise_not(pattern)))
        cost = (F.lit(split_cost) * missed + F.lit(merge_cost) * padded).alias("cost")
        options.append(F.when(k.bitwiseAND(taken) == 0, F.struct(cost, F.lit(at).alias("at"), k.alias("kernel"))))
    return F.array_min(F.array_compact(F.array(*options)))


def single_bits(pattern: Column, height: int) -> Column:
    return F.transform(rows_of(pattern, height), lambda b: F.call_function("shiftleft", F.lit(1), b))


def merge_split_mapping(
    spark: SparkSession, height: int, merges: Sequence[int], split_cost: float = 1.1, merge_cost: float = 1.0, min_merge: int = 2, recursive: bool = False
) -> DataFrame:
    """``(pattern, kernels)`` for every pattern of a panel: one merge kernel, the cheapest by ``split_cost``
    for each entry that it leaves and ``merge_cost`` for each zero that it pads; what it leaves becomes
    kernels of one bit or, with ``recursive``, is mapped again by merge kernels that meet none chosen.
    Patterns of fewer than ``min_merge`` entries are their own kernel; so is the empty one.
    """
    state = all_patterns(spark, height).select(
        "pattern", F.col("pattern").alias("left"), F.lit(0).alias("taken"), F.array().cast("array<int>").alias("kernels"), F.lit(False).alias("done")
    )
    for step in range(len(merges) if recursive else 1):
        few = F.bit_count("left") < min_merge
        own = (F.col("left") == 0) | few if step == 0 else (F.col("left") > 0) & few
        best = _cheapest_merge(F.col("left"), F.col("taken"), merges, split_cost, merge_cost)["kernel"]
        state = state.withColumn("best", F.when(~F.col("done") & ~few & (F.col("left") > 0), best))
        grown = F.when(~F.col("done") & own, F.array_append("kernels", F.col("left"))).when(F.col("best").isNotNull(), F.array_append("kernels", F.col("best"))).otherwise(F.col("kernels"))
        rest = F.when(F.col("best").isNotNull(), F.col("left").bitwiseAND(F.bitwise_not("best"))).when(own, F.lit(0)).otherwise(F.col("left"))
        state = state.select(
            "pattern",
            rest.alias("left"),
            F.col("taken").bitwiseOR(F.coalesce("best", F.lit(0))).alias("taken"),
            grown.alias("kernels"),
            (F.col("done") | own | (rest == 0)).alias("done"),
        )
    return state.select("pattern", F.concat("kernels", single_bits(F.col("left"), height)).alias("kernels"))


def elements(spark: SparkSession, height: int) -> DataFrame:
    """``(pattern, nnz, row)``: the set Q of non-empty patterns and, one row each, the set R of pairs of
    a pattern and a row that it has."""
    every = all_patterns(spark, height).where("pattern > 0")
    return every.select("pattern", F.bit_count("pattern").alias("nnz"), F.explode(rows_of(F.col("pattern"), height)).alias("row"))


def merge_subsets(spark: SparkSession, items: Sequence[int]) -> DataFrame:
    """``(mask, members, union)`` for every non-empty subset of patterns, one row each: for the 15
    patterns of four rows, 2^15 - 1 candidates of a cover."""
    members = F.filter(F.lit(list(items)), lambda x, at: F.call_function("shiftright", F.col("mask"), at).bitwiseAND(F.lit(1)) == 1)
    rows = spark.range(1, 1 << len(items)).select(F.col("id").cast("int").alias("mask"))
    return rows.select("mask", members.alias("members")).select("mask", "members", _union(F.col("members")).alias("union"))


def _union(members: Column) -> Column:
    return F.aggregate(members, F.lit(0), lambda x, y: x.bitwiseOR(y))


#: Offsets of the neighbours whose subsets a pattern is joined with, by the least number of patterns
#: (fixed values).
OVERLAP_WINDOWS = {255: [list(range(1, 8)), list(range(1, 32, 4))], 63: [list(range(1, 15))], 15: [list(range(1, 16))]}


def overlap_subsets(spark: SparkSession, height: int) -> DataFrame:
    """``(first, with_first, members, union)``: a smaller family of candidates for a cover. Patterns are
    ordered by entries and value, both descending; each is joined with the subsets of the patterns
    near it, which are candidates without it too. From 255 patterns on, runs from a pattern to each later
    one are candidates as well. The set of all patterns comes last.
    """
    items = sorted(range(1, 1 << height), key=lambda x: (x.bit_count(), x), reverse=True)
    n = len(items)
    order = F.lit(items)
    first = spark.range(n).select(F.col("id").cast("int").alias("first"))
    parts = [first.where("first = 0").select(F.lit(None).cast("int").alias("first"), F.lit(True).alias("with_first"), order.alias("members"))]
    for offsets in next((w for least, w in OVERLAP_WINDOWS.items() if n >= least), []):
        near = F.filter(F.transform(F.lit(offsets), lambda o: F.col("first") + o), lambda x: x < n)
        masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("near")) - 1)
        chosen = F.filter("near", lambda x, at: F.call_function("shiftright", F.col("mask"), at).bitwiseAND(F.lit(1)) == 1)
        picks = first.select("first", near.alias("near")).where(F.size("near") > 0).select("first", "near", F.explode(masks).alias("mask"))
        picks = picks.select("first", F.explode(F.array(F.lit(False), F.lit(True))).alias("with_first"), F.transform(chosen, lambda x: F.get(order, x)).alias("members"))
        own = F.when(F.col("with_first"), F.array_append("members", F.get(order, F.col("first")))).otherwise(F.col("members"))
        parts.append(picks.select("first", "with_first", own.alias("members")))
    if n >= 255:
        suffix = first.select("first", F.lit(True).alias("with_first"), F.slice(order, F.col("first") + 1, F.lit(n)).alias("members"))
        stops = F.sequence(F.col("first") + 8, F.lit(n - 1))
        runs = first.where(F.col("first") + 8 < n).select("first", F.explode(stops).alias("stop"))
        runs = runs.select("first", F.lit(True).alias("with_first"), F.slice(order, F.col("first") + 1, F.col("stop") - F.col("first")).alias("members"))
        parts += [suffix, runs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("union", _union(F.col("members")))


def alternative_costs(subsets: DataFrame, shares: DataFrame, entry: float = 1.0, base: float = 2.0) -> DataFrame:
    """Cost of each ``subsets(subset_id, pattern)`` by rows: the share of its distinct patterns is the
    width of the merged group, and each column costs ``base`` and an entry for each row of the union."""
    summed = subsets.distinct().join(shares, "pattern").groupBy("subset_id").agg(F.bit_or("pattern").alias("union"), F.sum("share").alias("share"))
    return summed.select("subset_id", "union", (F.bit_count("union") * F.col("share") * entry + F.col("share") * base).alias("cost"))


def consecutive_groups(nz: DataFrame, height: int) -> DataFrame:
    """``(p, pattern, first_j, cols, nnz)``: runs of neighbouring non-empty columns of a panel that have
    the same pattern, merged into one group."""
    order = Window.partitionBy("p").orderBy("j")
    change = F.coalesce((F.col("pattern") != F.lag("pattern").over(order)).cast("int"), F.lit(1))
    runs = dealt(codes(nz, height), "p").withColumn("new", change).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("p", "run", "pattern").agg(F.min("j").alias("first_j"), F.count(F.lit(1)).alias("cols"))
    return merged.select("p", "pattern", "first_j", "cols", (F.col("cols") * F.bit_count("pattern")).alias("nnz"))


def keyed_counts(nz: DataFrame, shapes: DataFrame, heights: Sequence[int]) -> DataFrame:
    """``(m_r, sparsity, pattern, cnt)`` over many matrices: ``nz(matrix_id, i, j)`` and their sizes
    ``shapes(matrix_id, m, k)``; non-empty patterns, by panel height and sparsity in hundredths."""
    counts = nz.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).join(shapes, "matrix_id")
    keyed = counts.select("matrix_id", F.bround(sparsity(F.col("n"), F.col("m"), F.col("k")), 2).alias("sparsity"))
    each = nz.select("matrix_id", "i", "j", F.explode(F.lit(list(heights))).alias("m_r"))
    bit = F.call_function("shiftleft", F.lit(1), (F.col("i") % F.col("m_r")).cast("int"))
    found = each.groupBy("matrix_id", "m_r", F.floor(F.col("i") / F.col("m_r")).alias("p"), "j").agg(F.bit_or(bit).alias("pattern"))
    return found.groupBy("matrix_id", "m_r", "pattern").agg(F.count(F.lit(1)).alias("cnt")).join(keyed, "matrix_id").groupBy("m_r", "sparsity", "pattern").agg(F.sum("cnt").alias("cnt"))


def kernel_counts(nz: DataFrame, mapping: DataFrame, height: int) -> DataFrame:
    """``(kernel, instances, nnz, padding)``: uses of each kernel over all panel columns."""
    met = codes(nz, height).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt")).join(mapping, "pattern")
    each = met.select("pattern", "cnt", F.posexplode("kernels").alias("at", "kernel"), "kernels")
    before = F.aggregate(F.slice("kernels", F.lit(1), F.col("at")), F.lit(0), lambda x, y: x.bitwiseOR(y))
    own = F.col("kernel").bitwiseAND(F.col("pattern")).bitwiseAND(F.bitwise_not(before))
    return each.groupBy("kernel").agg(
        F.sum("cnt").alias("instances"),
        F.sum(F.col("cnt") * F.bit_count(own)).alias("nnz"),
        F.sum(F.col("cnt") * (F.bit_count("kernel") - F.bit_count(own))).alias("padding"),
    )


def subset_costs(subsets: DataFrame, shares: DataFrame, columns: float = 128.0) -> DataFrame:
    """Cost of each ``subsets(subset_id, pattern)``: a check, and for the columns of its patterns the
    base cost plus an entry cost for each row of their union. ``shares(pattern, share)``."""
    summed = subsets.join(shares, "pattern").groupBy("subset_id").agg(F.bit_or("pattern").alias("union"), F.sum("share").alias("share"))
    cost = F.lit(N_CHECK) + F.col("share") * columns * (F.lit(N_BASE) + F.lit(N_ENTRY) * F.bit_count("union"))
    return summed.select("subset_id", "union", cost.alias("cost"))


def panel_cost(nz: DataFrame, mapping: DataFrame, height: int, panel: float = 5.0, check: float = 2.0, base: float = 3.0, entry: float = 4.0) -> DataFrame:
    """``(p, cost)``: panel cost, and for each kernel met a check plus its columns' base and entries."""
    uses = codes(nz, height).join(mapping, "pattern").select("p", F.explode("kernels").alias("kernel"))
    kinds = uses.groupBy("p", "kernel").agg(F.count(F.lit(1)).alias("cols"))
    term = F.lit(check) + F.col("cols") * (F.lit(base) + F.lit(entry) * F.bit_count("kernel"))
    return kinds.groupBy("p").agg((F.lit(panel) + F.sum(term)).alias("cost"))


def least_squares(rows: DataFrame, features: Sequence[str], target: str) -> list[float]:
    """Coefficients of a linear fit without intercept: one aggregate, then a small solve."""
    import numpy as np

    n = len(features)
    terms = [F.sum(F.col(features[a]) * F.col(features[b])).alias(f"x{a}_{b}") for a in range(n) for b in range(a, n)]
    row = rows.agg(*terms, *[F.sum(F.col(f) * F.col(target)).alias(f"y{k}") for k, f in enumerate(features)]).first()
    gram = np.array([[row[f"x{min(a, b)}_{max(a, b)}"] for b in range(n)] for a in range(n)], dtype=float)
    if np.linalg.matrix_rank(gram) < n:
        raise ValueError("the features are not independent")
    return np.linalg.solve(gram, np.array([row[f"y{k}"] for k in range(n)], dtype=float)).tolist()


def bounded_powerset(items: Sequence[int], largest: int) -> Iterable[tuple[int, ...]]:
    """Non-empty subsets of at most ``largest`` items, small ones first."""
    return itertools.chain.from_iterable(itertools.combinations(items, n) for n in range(1, largest + 1))


def exact_cover(universe: int, sets: Sequence[tuple[int, float]], most: int | None = None) -> tuple[list[int], float] | None:
    """Cheapest choice of ``(bit mask, cost)`` sets that covers each bit of ``universe`` exactly once,
    with at most ``most`` sets; None if there is none. Branches on the lowest open bit, so it is meant
    for the small universes of patterns."""
    by_bit: dict[int, list[int]] = {}
    for k, (mask, _) in enumerate(sets):
        for bit in range(mask.bit_length()):
            if mask >> bit & 1:
                by_bit.setdefault(bit, []).append(k)
    memo: dict[tuple[int, int], tuple[float, tuple[int, ...]] | None] = {}

    def solve(left: int, budget: int):
        if not left:
            return 0.0, ()
        if not budget:
            return None
        if (left, budget) not in memo:
            low = (left & -left).bit_length() - 1
            found = None
            for k in by_bit.get(low, []):
                mask, cost = sets[k]
                if mask & ~left:
                    continue
                rest = solve(left & ~mask, budget - 1)
                if rest and (found is None or rest[0] + cost < found[0]):
                    found = rest[0] + cost, (k, *rest[1])
            memo[left, budget] = found
        return memo[left, budget]

    best = solve(universe, len(sets) if most is None else most)
    return (list(best[1]), best[0]) if best else None


def cheapest_partition(n: int, cost: Sequence[float]) -> tuple[list[int], float]:
    """Cheapest split of ``n`` items into groups, of all that there are; ``cost`` has one value for each
    bit mask. The group of the lowest open item is tried in full, 3^(n-1) steps: for 15 items or so."""
    best, group = [0.0] * (1 << n), [0] * (1 << n)
    for left in range(1, 1 << n):
        low = left & -left
        rest = sub = left ^ low
        least = None
        while True:
            total = cost[sub | low] + best[rest ^ sub]
            if least is None or total < least:
                least, group[left] = total, sub | low
            if not sub:
                break
            sub = (sub - 1) & rest
        best[left] = least
    chosen, left = [], (1 << n) - 1
    while left:
        chosen.append(group[left])
        left ^= group[left]
    return chosen, best[-1]


def greedy_cover(universe: int, sets: Sequence[tuple[int, float]]) -> tuple[list[int], float]:
    """Disjoint sets by the lowest cost per bit, for universes too large for :func:`exact_cover`."""
    left, chosen, total = universe, [], 0.0
    while left:
        options = [(c / m.bit_count(), -m.bit_count(), k) for k, (m, c) in enumerate(sets) if m and not m & ~left]
        if not options:
            raise ValueError("the sets do not cover the universe")
        k = min(options)[2]
        chosen.append(k)
        total += sets[k][1]
        left &= ~sets[k][0]
    return chosen, total


def group_pair_costs(groups: DataFrame) -> DataFrame:
    """``(a, b, padding)`` for each pair ``a <= b`` of ``groups(group_id, pattern, cnt)``: zeros padded
    when both take the union of their patterns.

    Each group meets its partners by number, so no condition but an equality joins them: groups are the
    patterns of a panel, at most ``2 ** height`` rows, and their numbers are below ``MOST_GROUPS``.
    """
    numbers = F.sequence(F.col("group_id"), groups.agg(F.max("group_id")).scalar())
    bounded = F.when(F.col("group_id") < MOST_GROUPS, numbers).otherwise(F.raise_error(F.lit("too many groups for pairs")).cast("array<int>"))
    left = groups.select(F.col("group_id").alias("a"), F.col("pattern").alias("pa"), F.col("cnt").alias("ca"), F.explode(bounded).alias("b"))
    right = groups.select(F.col("group_id").alias("b"), F.col("pattern").alias("pb"), F.col("cnt").alias("cb"))
    union = F.bit_count(F.col("pa").bitwiseOR(F.col("pb")))
    padding = F.col("ca") * (union - F.bit_count("pa")) + F.col("cb") * (union - F.bit_count("pb"))
    return left.join(right, "b").select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(padding).alias("padding"))


def greedy_matching(pairs: Sequence[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Disjoint pairs by ascending cost, ties by number."""
    taken: set[int] = set()
    chosen = []
    for a, b, _ in sorted(pairs, key=lambda x: (x[2], x[0], x[1])):
        if a != b and a not in taken and b not in taken:
            taken |= {a, b}
            chosen.append((a, b))
    return chosen


def matching(pairs: DataFrame) -> DataFrame:
    """``(a, b, padding, round)`` of ``pairs(a, b, padding)``: the disjoint pairs that greedy matching takes, by
    ascending cost, ties by number.

    Nothing is sorted: a pair that is the least of both its groups is taken whatever comes before it, so each
    round takes all such pairs at once and drops the pairs that meet them. ``round`` tells when. A null cost is
    no pair, nor is a group with itself.
    """
    left = materialise(pairs.where("a <> b and padding is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "padding"), "pairs")
    chosen, number = None, 0
    while chosen is None or not left.isEmpty():
        each = left.select(F.explode(F.array("a", "b")).alias("group"), F.struct("padding", "a", "b").alias("pair"))
        best = each.groupBy("group").agg(F.min("pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
        taken = materialise(best.where("n = 2").select("pair.a", "pair.b", "pair.padding", F.lit(number).alias("round")), "taken")
        chosen, number = taken if chosen is None else chosen.unionByName(taken), number + 1
        gone = taken.select(F.explode(F.array("a", "b")).alias("group"))
        for end in ("a", "b"):
            left = left.join(gone.withColumnRenamed("group", end), end, "left_anti")
        left = materialise(left.select("a", "b", "padding"), "pairs")
    return chosen
