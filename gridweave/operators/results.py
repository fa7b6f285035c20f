"""Analysis of benchmark logs: speed-ups, best methods, pivots, buckets and heuristics.

A log has a row for each run; a group of rows, such as one matrix at one width and thread count, is
named by ``keys``. Windows stay inside groups, whose size is the number of methods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import any_of
from gridweave.operators.order_statistics import elements, medians
from gridweave.plans.staging import materialise


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal, or are in, everything wanted; all rows if nothing is."""
    test = any_of(df.columns, wanted)
    missing = set(wanted) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
    return df if test is None else df.where(test)


def baseline_time(keys: Sequence[str], is_baseline: Column, time: str) -> Column:
    """The baseline's time in each row of its group; null if the group has none."""
    return F.min(F.when(is_baseline, F.col(time))).over(Window.partitionBy(*keys))


def speedups(df: DataFrame, keys: Sequence[str], baseline: str, name: str = "name", time: str = "time", fallback: str | None = None) -> DataFrame:
    """Adds ``speedup`` over the named baseline, or over methods containing ``fallback`` if it is absent."""
    base = baseline_time(keys, F.col(name) == baseline, time)
    if fallback is not None:
        base = F.coalesce(base, baseline_time(keys, F.contains(F.col(name), F.lit(fallback)), time))
    return df.withColumn("speedup", F.try_divide(base, F.col(time)))


def flag_first_best(df: DataFrame, keys: Sequence[str], time: str = "time", tie: str = "name", out: str = "is_best") -> DataFrame:
    """Flags one row of each group: the least time, ties to the smaller ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), tie)
    return df.withColumn(out, F.row_number().over(order) == 1)


def flag_best(df: DataFrame, keys: Sequence[str], time: str = "time", out: str = "is_best") -> DataFrame:
    """Flags every row that has the least time of its group."""
    return df.withColumn(out, F.coalesce(F.col(time) == F.min(time).over(Window.partitionBy(*keys)), F.lit(False)))


def flag_subset_best(df: DataFrame, keys: Sequence[str], member: Column, time: str = "time", strict: bool = False, out: str = "best_of_subset") -> DataFrame:
    """Flags rows whose time is the least of the group's members; with ``strict`` members only. Adds
    the number of members as ``num_subset``."""
    group = Window.partitionBy(*keys)
    hit = F.coalesce(F.col(time) == F.min(F.when(member, F.col(time))).over(group), F.lit(False))
    return df.withColumn(out, hit & member if strict else hit).withColumn("num_subset", F.count_if(member).over(group))


def complete_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the groups that are as large as the largest one."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_methods"))
    most = sizes.agg(F.max("num_methods")).scalar()
    return df.withColumn("num_methods", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("num_methods") == most)


def fastest_names(df: DataFrame, keys: Sequence[str], without: Sequence[str] = (), name: str = "name", time: str = "time") -> DataFrame:
    """Adds the fastest method of the group, of all and of those not in ``without``; '' if there is none."""
    group = Window.partitionBy(*keys)
    rank = F.struct(F.col(time), F.col(name))
    other = F.min(F.when(~F.col(name).isin(list(without)), rank)).over(group) if without else F.min(rank).over(group)
    return df.withColumn("fastest", F.coalesce(F.min(rank).over(group)[name], F.lit(""))).withColumn("fastest_other", F.coalesce(other[name], F.lit("")))


def geometric_means(df: DataFrame, keys: Sequence[str], value: str = "speedup") -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.exp(F.avg(F.log(value))).alias("gmean"), F.count(F.lit(1)).alias("n"))


def percent_faster(df: DataFrame, keys: Sequence[str], inside: Column, value: str = "speedup", much: float = 1.5) -> DataFrame:
    """Share of rows faster than the baseline; of those at least ``much`` faster, the share ``inside``."""
    fast = F.col(value) >= much
    return df.groupBy(*keys).agg(
        (F.count_if(F.col(value) > 1) / F.count(F.lit(1))).alias("pct_faster"),
        F.try_divide(F.count_if(fast & inside).cast("double"), F.count_if(fast)).alias("pct_much_inside"),
    )


def value_shares(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of each value and its share, within ``keys``; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(*keys)) if keys else counts.agg(F.sum("cnt")).scalar()
    return counts.withColumn("share", F.col("cnt") / total)


def mean_by_config(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of numeric columns; null keys form groups."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def complete_and_correct(df: DataFrame, keys: Sequence[str], variant: str, flag: str = "correct") -> DataFrame:
    """``keys`` and whether all rows are correct and every variant of the table is there."""
    wanted = df.agg(F.count_distinct(variant)).scalar()
    rows = df.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(flag) == "correct", F.lit(False))).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return rows.select(*keys, (F.col("_ok") & (F.col("_n") >= wanted)).alias("all_correct"))


def pivot_methods(df: DataFrame, index: Sequence[str], methods: Sequence[str], values: Sequence[str], name: str = "name", dedup: bool = False) -> DataFrame:
    """Long to wide, columns ``value|method``. Repeated (index, method) rows are an error unless
    ``dedup`` keeps the least."""
    cells = df.where(F.col(name).isin(list(methods))).groupBy(*index, name).agg(F.count(F.lit(1)).alias("_n"), *[F.min(v).alias(v) for v in values])
    if not dedup:
        once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a method occurs twice under one index")).cast("boolean"))
        cells = cells.where(once)
    picks = [F.first(F.when(F.col(name) == m, F.col(v)), ignorenulls=True).alias(f"{v}|{m}") for v in values for m in methods]
    return cells.groupBy(*index).agg(*picks)


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str, value: str) -> DataFrame:
    """Wide to long over the ``columns`` that exist."""
    there = [c for c in columns if c in df.columns]
    return df.unpivot(list(ids), there, variable, value)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def best_of_variants(times: Sequence[Column], correct: Sequence[Column]) -> Column:
    """Least time over variants; an incorrect one counts as 1e16."""
    return F.least(*[F.when(F.coalesce(c == "correct", F.lit(False)), t).otherwise(F.lit(1e16)) for t, c in zip(times, correct)])


def top_winners(df: DataFrame, keys: Sequence[str], winner: str, k: int = 6) -> DataFrame:
    """The ``k`` most frequent winners of each key, as an array, most frequent first."""
    counts = df.groupBy(*keys, winner).agg(F.count(F.lit(1)).alias("cnt"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), winner))
    kept = counts.withColumn("place", place).where(F.col("place") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", winner)))[winner].alias("methods"))


def heuristic_lookup(queries: DataFrame, heuristic: DataFrame) -> DataFrame:
    """``queries(id, s, n)`` against ``heuristic(lo, hi, n, methods)``: the range ``lo < s <= hi``, and
    of its rows the largest ``n`` that is no larger; null methods if there is none.

    The edges of all ranges, which are a small table, cut the line into cells; queries and rules meet by
    an equi-join on the cell.
    """
    rules = heuristic.select("lo", "hi", F.col("n").alias("rule_n"), "methods")
    edges = heuristic.select(F.explode(F.array("lo", "hi")).alias("edge")).agg(F.sort_array(F.collect_set("edge")))

    def cell(x: str) -> Column:
        """How many edges lie below a column."""
        return F.size(F.filter("edges", lambda e: e < F.col(x)))

    # A rule spans the cells from its lower edge to its upper one.
    spread = rules.withColumn("edges", edges.scalar()).where("lo < hi").withColumn("cell", F.explode(F.sequence(cell("lo") + 1, cell("hi"))))
    asked = queries.withColumn("edges", edges.scalar()).withColumn("cell", F.when(F.col("s").isNotNull(), cell("s")))
    met = asked.drop("edges").join(spread.select("cell", "rule_n", "methods"), "cell", "left").withColumn("fits", F.col("rule_n") <= F.col("n"))
    return met.groupBy("id", "s", "n").agg(F.max_by("methods", F.when(F.col("fits"), F.col("rule_n"))).alias("methods"), F.max(F.when(F.col("fits"), F.col("rule_n"))).alias("rule_n"))


def cumulative(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def tuned(runs: DataFrame, keys: Sequence[str], config: Sequence[str], time: str = "time") -> DataFrame:
    """Best configuration of each key by the median over its repetitions, ties to the smaller one."""
    middle = medians(runs, [*keys, *config], time, "median_time")
    best = F.min(F.struct("median_time", *config)).alias("best")
    return middle.groupBy(*keys).agg(best).select(*keys, "best.*")


def upper_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, upper_med``: element ``n div 2`` of each group's sorted values, from 0."""
    return elements(df, keys, value, {"upper_med": lambda n: F.floor(n / 2)})


def max_speedups(df: DataFrame, keys: Sequence[str], baseline: str, forms: Sequence[str]) -> DataFrame:
    """For each key the largest ratio of ``baseline`` to each form's time, and the largest of these."""
    best = df.groupBy(*keys).agg(*[F.max(F.try_divide(F.col(baseline).cast("double"), F.col(f))).alias(f"max_{f}") for f in forms])
    return best.withColumn("max_speedup", F.greatest(*[F.col(f"max_{f}") for f in forms]))


def fitting_tiles(grid_: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """Configurations to start from: tiles that are not set, or no larger than the dimension."""
    for tile, limit in limits.items():
        grid_ = grid_.where(F.col(tile).isNull() | (F.col(tile) <= limit))
    return grid_


def first_values(grid_: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first configuration of each key by ``order``."""
    return keep_first(grid_, keys, order)


def profile_shares(events: DataFrame, mapping: dict[str, str], rest: str = "remaining") -> DataFrame:
    """``(kernel, time)`` of a profile: ``events(event, parent, name, total)``, where the total of an event
    includes its children. Mapped names take their whole total; of the others, children are looked at, and
    their own time, without the children's, counts as ``rest``. Events below one that is not there count nowhere.

    Trees can have any depth: every event points to an ancestor and knows whether a mapped one stands on the way,
    and each round doubles the way, so a chain of a million events takes twenty rounds. A cycle is an error.
    """
    kernel = F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col("name"))
    named = events.select("event", "parent", "total", kernel.alias("kernel"))
    children = named.groupBy(F.col("parent").alias("event")).agg(F.sum("total").alias("below"))
    # ``inner``: whether the events from here on up to the pointer, this one included, hold a mapped one.
    way = materialise(named.select("event", F.col("parent").alias("up"), F.col("kernel").isNotNull().alias("inner")), "ways")
    for _ in range(way.count().bit_length() + 1):
        if way.where("up is not null").isEmpty():
            break
        above = way.select(F.col("event").alias("up"), F.col("up").alias("next"), F.col("inner").alias("more"))
        # An ancestor that is not there covers what is below it.
        joined = way.join(above, "up", "left")
        covered = F.col("up").isNotNull() & F.coalesce("more", F.lit(True))
        way = materialise(joined.select("event", F.col("next").alias("up"), (F.col("inner") | covered).alias("inner")), "ways")
    else:
        if not way.where("up is not null").isEmpty():
            raise ValueError("the events of the profile form a cycle")
    # An event counts if no event above it is mapped: its parent's way holds none.
    above = way.select(F.col("event").alias("parent"), F.col("inner").alias("covered"))
    open_ = named.join(above, "parent", "left").where(F.col("parent").isNull() | ~F.coalesce("covered", F.lit(True)))
    time = F.when(F.col("kernel").isNotNull(), F.col("total")).otherwise(F.col("total") - F.coalesce("below", F.lit(0)))
    parts = open_.join(children, "event", "left").select(F.coalesce("kernel", F.lit(rest)).alias("kernel"), time.alias("time"))
    return parts.groupBy("kernel").agg(F.sum("time").alias("time"))


def grid(spark, axes: dict[str, Sequence]) -> DataFrame:
    """Cross product of parameter values, one row for each configuration."""
    out = spark.range(1).select(*[F.array(*[F.lit(x) for x in values]).alias(k) for k, values in axes.items()])
    for k in axes:
        out = out.withColumn(k, F.explode(k))
    return out


def tagged_union(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of all frames with their name; columns that one lacks are null."""
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of ``n`` distinct keys, drawn by a hash that other engines have too."""
    chosen = df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary")), key).limit(n)
    return df.join(chosen, key, "left_semi")


def split_list(df: DataFrame, key: str, parts: int, seed: int = 42) -> DataFrame:
    """Adds ``part``: keys dealt into ``parts`` shares by a hash that other engines have too."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary"))
    return df.withColumn("part", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % parts).cast("int"))


def less_baseline(df: DataFrame, keys: Sequence[str], is_baseline: Column, value: str, out: str) -> DataFrame:
    """Adds ``value`` less that of the group's baseline; null without one."""
    return df.withColumn(out, F.col(value) - baseline_time(keys, is_baseline, value))


def fastest_entry(times: Column) -> Column:
    """``(time, name)`` of the least value of a map from names to times; null values are left out."""
    entries = F.filter(F.map_entries(times), lambda x: x["value"].isNotNull())
    return F.array_min(F.transform(entries, lambda x: F.struct(x["value"].alias("time"), x["key"].alias("name"))))


def layer_speedups(layers: DataFrame, baseline: str) -> DataFrame:
    """``layers(name, threads, layer, layer_time)`` with running times, and their ratio to the baseline's."""
    running = cumulative(layers, ["name", "threads"], "layer", "layer_time", "running")
    base = F.min(F.when(F.col("name") == baseline, F.col("running"))).over(Window.partitionBy("threads", "layer"))
    return running.withColumn("speedup", F.try_divide(base, F.col("running")))


def leading_features(df: DataFrame, features: Sequence[str], k: int = 8) -> DataFrame:
    """``(feature, weight)``: the ``k`` largest weights, by size, of the first principal direction of
    the standardised features: one aggregate for the moments, then a small eigenproblem."""
    import numpy as np

    n = len(features)
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    row = df.agg(*[F.corr(features[a], features[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    corr = np.eye(n)
    for a, b in pairs:
        value = row[f"c{a}_{b}"]
        corr[a, b] = corr[b, a] = 0.0 if value is None or np.isnan(value) else value
    direction = np.linalg.eigh(corr)[1][:, -1]
    direction *= np.sign(direction[np.abs(direction).argmax()])
    order = np.argsort(-np.abs(direction), kind="stable")[:k]
    return df.sparkSession.createDataFrame([(features[i], float(direction[i])) for i in order], "feature string, weight double")
