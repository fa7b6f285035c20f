"""Column expressions for sizes, rates, names, paths and buckets."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparsity(nnz: Column, m: Column, k: Column) -> Column:
    """Sizes are multiplied as doubles: as integers, those of a large matrix exceed 32 bits."""
    return 1 - nnz / (m.cast("double") * k)


def rounded(x: Column, places: int = 2) -> Column:
    """Half to even."""
    return F.bround(x, places)


def aspect_ratio(m: Column, k: Column) -> Column:
    """Long side over short side; negative if there are fewer rows than columns."""
    ratio = F.greatest(m, k) / F.least(m, k)
    return F.when(m < k, -ratio).otherwise(ratio)


def gflops(n: Column, nnz: Column) -> Column:
    return 2 * n * nnz / F.lit(1e9)


def gflops_per_second(n: Column, nnz: Column, microseconds: Column) -> Column:
    return F.try_divide(gflops(n, nnz), microseconds / F.lit(1e6))


def extract_int(text: Column, pattern: str) -> Column:
    """First group of a regular expression as an integer; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def config_map(config: Column) -> Column:
    """``key:value|key:value`` as a map."""
    return F.str_to_map(config, F.lit(r"\|"), F.lit(":"))


def method_fields(name: Column) -> Column:
    """Parts of a method name such as ``M8N3_NKM_LB_TLB128_SA_orig``."""
    return F.struct(
        extract_int(name, r"M(\d+)N").alias("m_r"),
        extract_int(name, r"M\d+N(\d+)").alias("n_r"),
        F.nullif(F.regexp_extract(name, r"_([MNK]{3})(?:_|$)", 1), F.lit("")).alias("schedule"),
        name.rlike(r"(^|_)LB(_|$)").alias("load_balance"),
        extract_int(name, r"TLB(\d+)").alias("tlb"),
        name.rlike(r"(^|_)SA(_|$)").alias("sparse_a"),
        F.element_at(F.split(name, "_"), -1).alias("mapping"),
    )


def path_part(path: Column, place: int) -> Column:
    """Part of a path, counted from 1, or from -1 at the end; null if there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(place))


def matrix_name(path: Column) -> Column:
    """Last part of a path without its matrix extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.s?mtx$", "")


def joined_id(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def first_match(text: Column, kinds: Sequence[tuple[str, str]], default: str = "Unknown") -> Column:
    """Label of the first key that ``text`` contains."""
    out = F.lit(default)
    for key, label in reversed(kinds):
        out = F.when(F.contains(text, F.lit(key)), F.lit(label)).otherwise(out)
    return out


def bucket_right(x: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed bucket, from 0; null outside all of them."""
    out = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((x > lo) & (x <= hi), F.lit(k)).otherwise(out)
    return out


def bucket_left(x: Column, edges: Sequence[float]) -> Column:
    """Number of the left-closed bucket, from 0; null outside all of them."""
    out = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((x >= lo) & (x < hi), F.lit(k)).otherwise(out)
    return out


def near_target(x: Column, targets: Mapping[str, tuple[float, float]]) -> Column:
    """Label of the first range that holds ``x`` strictly."""
    out = F.lit(None).cast("string")
    for label, (lo, hi) in reversed(list(targets.items())):
        out = F.when((x > lo) & (x < hi), F.lit(label)).otherwise(out)
    return out


def all_correct(flags: Sequence[Column]) -> Column:
    """True if every flag is 'correct'; a missing one is not."""
    return functools.reduce(operator.and_, [F.coalesce(f == "correct", F.lit(False)) for f in flags])


def any_of(df_columns: Sequence[str], wanted: Mapping[str, object]) -> Column | None:
    """Conjunction of equalities, and of memberships where a list is wanted; None without any."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if k in df_columns]
    return functools.reduce(operator.and_, tests) if tests else None


def cache_ratios(hits: Column, misses: Column) -> dict[str, Column]:
    total = hits + misses
    return {"hit_rate": F.try_divide(hits, total), "miss_rate": F.try_divide(misses, total)}


def vector_flops(single: Column, sse: Column, avx: Column, avx_wide: Column) -> Column:
    """Single-precision operations from counters of 1, 4, 8 and 16 lanes."""
    return single + 4 * sse + 8 * avx + 16 * avx_wide


def upper_median(values: Column) -> Column:
    """Element ``n div 2`` of the sorted values, from 0."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def power_of_two_at_least(x: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(x)))


def short_digest(x: Column, length: int = 5) -> Column:
    """Last characters of the MD5 of a value's JSON or text."""
    return F.right(F.md5(x.cast("binary")), F.lit(length))


def clamp_density(density: Column, is_collection: Column, least: float = 0.05) -> Column:
    """Densities below ``least`` are drawn at it, but for matrices of the general collection."""
    return F.when(~is_collection & (density < least), F.lit(least)).otherwise(density)


def sparsity_range(sparsity: Column, edges: Sequence[float] = (0.7, 0.9, 0.95, 1.0)) -> Column:
    """Number of the left-closed range; 1 counts to the last range. Below the first edge is an error."""
    found = bucket_left(F.when(sparsity.isNotNull(), F.least(sparsity, F.lit(0.9999999999))), edges)
    return F.when(sparsity.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no range for sparsity "), sparsity.cast("string"))).cast("int"))


def is_tuned(tuning: Column) -> Column:
    """Whether a run was a step of a search: its text lists alternatives. Null is none."""
    return F.coalesce(F.contains(tuning, F.lit("|")), F.lit(False))


def is_saved(tuning: Column) -> Column:
    """Whether a run took a stored configuration; a null text counts as one."""
    return F.coalesce(F.contains(tuning, F.lit("saved result")), F.lit(True))


def pad_numbers(text: Column) -> Column:
    """A space before each number between underscores, so that names sort by it."""
    return F.regexp_replace(text, r"_(\d+)(?=_)", r"_ $1")


def combinations(n: Column, k: Column) -> Column:
    """Binomial coefficient as a product of ``k`` exact ratios."""
    steps = F.sequence(F.lit(1), F.least(k, n - k))
    product = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: F.try_divide(acc * (n - F.least(k, n - k) + i), i).cast("bigint"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).when(F.least(k, n - k) == 0, F.lit(1).cast("bigint")).otherwise(product)


def counter_ratios(c: Mapping[str, Column]) -> dict[str, Column]:
    """Shares from counters: hits of the instruction cache and of the second level, and missed branches."""
    return {
        "l1i_ratio": F.try_divide((c["l1i_accesses"] - c["l1i_misses"]).cast("double"), c["l1i_accesses"]),
        "l2_ratio": F.try_divide((c["l1_misses"] - c["l2_misses"]).cast("double"), c["l1_misses"]),
        "branch_miss_ratio": F.try_divide(c["branch_misses"].cast("double"), c["branches"]),
    }


def loads_per_fma(loads: Column, single: Column, sse: Column, avx: Column, avx_wide: Column) -> Column:
    """Loads for each multiply-add instruction, which counters count as two."""
    return F.try_divide(loads.cast("double"), (single + sse + avx + avx_wide) / 2)


def nested(document: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text; null if there is none."""
    return F.get_json_object(document, "$." + path)


def renamed(x: Column, names: Mapping[str, str]) -> Column:
    """A value's entry in a dictionary; null if it has none."""
    pairs = [F.lit(y) for pair in names.items() for y in pair]
    return F.try_element_at(F.create_map(*pairs), x)


def tiled_storage_share(recorded: Column, m: Column, k: Column, m_tile: Column, k_tile: Column) -> Column:
    """Storage of the tiled form as a share of the dense matrix. Records hold eight bytes for a number
    and 192 bytes of alignment and 40 of flags for each panel that are not needed; eight are."""
    panels = F.ceil(m / m_tile) * F.ceil(k / k_tile)
    return ((recorded - panels * 192 - panels * 40 + panels) / 2 + panels * 8) / (m * k * 4)


def adler32(text: Column) -> Column:
    """Checksum of the bytes of a text: two sums modulo 65521."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))

    def step(acc: Column, byte: Column) -> Column:
        a = F.pmod(acc["a"] + byte, F.lit(65521))
        return F.struct(a.alias("a"), F.pmod(acc["b"] + a, F.lit(65521)).alias("b"))

    sums = F.aggregate(bytes_, start, step, lambda acc: acc["b"] * 65536 + acc["a"])
    return F.when(F.octet_length(text) == 0, F.lit(1).cast("bigint")).otherwise(sums)
