"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Weights: a source with ``t`` tokens gets a weight in proportion to ``t ** exponent``. The exponent in
[0, 1] is bisected until the weights meet a target entropy, or until no source is repeated more often
than a limit; with both targets the larger exponent holds. One pass over the table of sources probes
31 exponents, which is five bisections at once.

Realisation: a source's budget is its weight times the whole budget. Its documents are dealt into
blocks of about ``block_tokens`` tokens by a hash of the id; each epoch permutes the blocks, and the
documents inside each block, by hashes that the seed and the epoch fix. Whole epochs come first; the
last one ends where the budget does. Offsets are prefix sums on three levels (groups of blocks,
blocks, documents of a block), so no window ever holds a whole source.

Without a budget, the smallest one is taken that uses every source whole at least once: the mix then
repeats documents of small sources and drops none.

Defined results: tokens are runs of characters other than ASCII white space; a null text has none. A
null source is a source of its own. Documents without tokens cost nothing: they are placed in whole
epochs, and once where their source has no tokens at all. Rows that repeat an id, or have none, are
placed one after the other; where the last epoch ends among rows of equal id, source and text, it takes
as many rows as fit, all with the other columns of one of them. Equal hashes are ordered by id, tokens
and a hash of the text. Empty input gives an empty result. Extra columns are carried along and may have
any name. Texts are counted where they are read, whatever their length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import checkpoint, materialise

WORD = r"[^\x20\x09-\x0D]+"
PROBES = 31
PASSES = 8
#: Blocks whose offsets one window sums.
GROUP = 1024
#: A table of sources of at most so many rows is broadcast (under 20 MB); a larger one is shuffled.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    max_repetition: float | None = 4.0
    entropy_share: float | None = None  # of the entropy of equal weights
    budget_tokens: int | None = None
    block_tokens: int = 1 << 16
    seed: int = 17


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, mark, n_tokens, text_hash)``: mark tells a null source from every string."""
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        source.alias("source"),
        _mark(source).alias("mark"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.xxhash64(text).alias("text_hash"),
    )


def _mark(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _probe(sources: DataFrame, largest: float, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy, and ln of the largest over the smallest repetition, for each exponent."""
    scaled = F.log("tokens") - F.lit(math.log(largest))
    terms = []
    for k, a in enumerate(exponents):
        power = F.exp(scaled * F.lit(a))
        terms += [F.sum(power).alias(f"s{k}"), F.sum(power * scaled).alias(f"d{k}")]
    row = sources.agg(F.min(scaled).alias("low"), *terms).first()
    return [(math.log(row[f"s{k}"]) - a * row[f"d{k}"] / row[f"s{k}"], -(1 - a) * row["low"]) for k, a in enumerate(exponents)]


def _largest_repetition(sources: DataFrame, largest: float, exponents: list[float], budget: int) -> list[float]:
    scaled = F.log("tokens") - F.lit(math.log(largest))
    row = sources.agg(F.min(scaled).alias("low"), *[F.sum(F.exp(scaled * F.lit(a))).alias(f"s{k}") for k, a in enumerate(exponents)]).first()
    # budget * weight / tokens is largest for the smallest source, as exponents are at most 1.
    return [budget / largest * math.exp((a - 1) * row["low"]) / row[f"s{k}"] for k, a in enumerate(exponents)]


def _bisect(fits) -> float:
    """Smallest exponent in [0, 1] that fits, if ever larger ones fit too; 1 if none does."""
    low, high = 0.0, 1.0
    if fits([0.0])[0]:
        return 0.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / (PROBES + 1) for k in range(1, PROBES + 1)]
        good = next((k for k, ok in enumerate(fits(grid)) if ok), PROBES)
        low, high = (grid[good - 1] if good else low), (grid[good] if good < PROBES else high)
    return high


def weights(counts: DataFrame, target: Target = Target()) -> DataFrame:
    """One row for each source: ``source, mark, tokens, exponent, weight, budget, whole, part, n_blocks``.

    ``whole`` epochs are used in full, then ``part`` tokens of one more.
    """
    by_source = checkpoint(counts.groupBy("mark").agg(F.first("source").alias("source"), F.sum("n_tokens").alias("tokens")))
    filled = by_source.where("tokens > 0")
    total = filled.agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("largest"), F.sum("tokens").alias("tokens")).first()
    exponent, largest, scale = 1.0, 1.0, 1.0
    if total["n"]:
        largest, exponent = float(total["largest"]), 0.0
        if target.entropy_share is not None:
            goal = target.entropy_share * math.log(total["n"]) if total["n"] > 1 else 0.0
            exponent = _bisect(lambda xs: [h <= goal for h, _ in _probe(filled, largest, xs)])
        if target.max_repetition is not None:
            if target.budget_tokens is None:
                limit = math.log(target.max_repetition)
                least = _bisect(lambda xs: [r <= limit for _, r in _probe(filled, largest, xs)])
            else:
                least = _bisect(lambda xs: [r <= target.max_repetition for r in _largest_repetition(filled, largest, xs, target.budget_tokens)])
            exponent = max(exponent, least)
        scale = filled.agg(F.sum(F.pow(F.col("tokens") / F.lit(largest), F.lit(exponent))).alias("s")).first()["s"]
    budget = float(target.budget_tokens) if target.budget_tokens is not None else largest * scale
    weight = F.pow(F.col("tokens") / F.lit(largest), F.lit(exponent)) / F.lit(scale)
    # The small addend keeps a budget that is a whole number but for rounding.
    share = F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6)).cast("bigint")
    return checkpoint(
        by_source.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0)))
        .withColumn("budget", share)
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.try_divide(F.col("budget").cast("double"), "tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("part", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(target.block_tokens))).cast("bigint"))
        .withColumn("exponent", F.lit(exponent))
        .select("source", "mark", "tokens", "exponent", "weight", "budget", "whole", "part", "n_blocks")
    )


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def placements(counts: DataFrame, sources: DataFrame, target: Target = Target()) -> DataFrame:
    """One row for each placement: ``id, source, mark, n_tokens, text_hash, epoch, block, at`` and ``mix_key``.

    ``at`` is the token offset in the source's stream; sorting by ``mix_key`` interleaves the sources
    in proportion to their weights.
    """
    seed = F.lit(target.seed)
    docs = counts.join(_small(sources.select("mark", "n_blocks", "whole", "part", "tokens", "budget")), "mark").withColumn(
        "block", F.pmod(F.xxhash64(seed, "id"), F.col("n_blocks"))
    )
    blocks = (
        docs.groupBy("mark", "block", "n_blocks", "whole", "part", "tokens", "budget")
        .agg(F.sum("n_tokens").alias("block_tokens"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole") + 1)))
        .where((F.col("epoch") <= F.col("whole")) | (F.col("part") > 0))
        .withColumn("order", F.xxhash64(seed, "mark", "epoch", "block"))
        .withColumn("group", F.floor((F.shiftrightunsigned("order", 33) / F.lit(2.0**31)) * F.ceil(F.col("n_blocks") / GROUP)).cast("bigint"))
    )
    blocks = checkpoint(blocks)
    groups = blocks.groupBy("mark", "epoch", "group").agg(F.sum("block_tokens").alias("group_tokens"))
    over = Window.partitionBy("mark", "epoch").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("mark", "epoch", "group", F.coalesce(F.sum("group_tokens").over(over), F.lit(0)).alias("group_at"))
    # "order" sorts the blocks of a group; groups are ranges of its upper bits, unsigned.
    inside = Window.partitionBy("mark", "epoch", "group").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(groups, ["mark", "epoch", "group"]).select(
        "mark", "block", "epoch", "whole", "part", "tokens", "budget",
        (F.col("group_at") + F.coalesce(F.sum("block_tokens").over(inside), F.lit(0))).alias("block_at"),
    )
    each = docs.select("id", "source", "mark", "n_tokens", "text_hash", "block").join(placed, ["mark", "block"])
    within = Window.partitionBy("mark", "block", "epoch").orderBy(F.xxhash64(seed, "epoch", "id"), "id", "n_tokens", "text_hash")
    end = F.col("block_at") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("end") - F.col("n_tokens") + (F.col("epoch") - 1) * F.col("tokens")
    return (
        each.withColumn("end", end)
        .where((F.col("epoch") <= F.col("whole")) | ((F.col("end") <= F.col("part")) & (F.col("n_tokens") > 0)))
        .withColumn("at", at)
        .withColumn("mix_key", F.coalesce(F.try_divide(F.col("at").cast("double"), F.col("budget")), F.lit(0.0)))
        .select("id", "source", "mark", "n_tokens", "text_hash", "epoch", "block", "at", "mix_key")
    )


def mixed(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix uses them: a row for each placement, columns and types unchanged.

    Whole epochs repeat rows where they are; only documents of a last, partial epoch are looked up.
    """
    counts = materialise(token_counts(docs, id_col, text_col, source_col), "counts")
    sources = weights(counts, target)
    whole = _small(sources.select("mark", "whole")).alias("s")
    repeated = (
        docs.select(F.struct("*").alias("doc"), _mark(F.col(f"`{source_col}`").cast("string")).alias("mark"))
        .join(whole, "mark")
        .where("whole > 0")
        .select(F.explode(F.array_repeat("doc", F.col("whole"))).alias("doc"))
        .select("doc.*")
    )
    last = placements(counts, sources.where("part > 0"), target).join(_small(sources.select("mark", "whole")), "mark").where("epoch > whole")
    same = ["id", "mark", "text_hash"]
    once = materialise(last.groupBy(*same).agg(F.count(F.lit(1)).cast("int").alias("times"), F.xxhash64(*same).alias("key")), "last-epoch")
    n = once.count()
    if not n:
        return repeated
    bits, words = build_filter(once, "key", n)
    named = docs.select(
        F.struct("*").alias("doc"),
        F.col(f"`{id_col}`").alias("id"),
        _mark(F.col(f"`{source_col}`").cast("string")).alias("mark"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
    )
    # Rows of equal id, source and text collapse before the shuffle.
    found = named.where(maybe(F.xxhash64(*same), bits, words)).groupBy(*same).agg(F.first("doc").alias("doc")).alias("f")
    equal = (F.col("f.mark") == F.col("o.mark")) & (F.col("f.text_hash") == F.col("o.text_hash")) & F.col("f.id").eqNullSafe(F.col("o.id"))
    again = found.join(once.alias("o"), equal).select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select("doc.*")
    return repeated.unionByName(again)
