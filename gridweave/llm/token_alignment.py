"""Alignment of two tokenizers' tokens: a static interval index, bisect stabbing queries, groups, links and their counts.

Both sides encode a text to tokens that tile the same bytes: a space and the text. The tokens of B are
an index of intervals that never changes, their starts and ends in ascending order. For each token of A
two bisections list the B tokens that its bytes overlap. A gap between two A tokens that no B token
spans is a boundary of groups: what lies between two boundaries is the smallest piece that both sides
cut the same way. All A and B tokens of a group are linked.

Counts of linked id pairs are over documents. A task writes each document's different pairs once;
they are counted with partial sums. For the look-up, pairs of the highest counts, at most ``FREQUENT``
of them however large the corpus is, go to every task, which settles nearly all links where they are;
pairs below that count meet the table of counts in a join, where no key is hot since its count is low.
The highest count of each A id is one number for each id of the vocabulary.

A group of many tokens makes a product of links. Different ids are multiplied, with how often each
occurs, and a document's pairs are written in slices of whole A ids of about ``SLICE`` products, so
memory is bounded by that and by the tokens of one document.

Tokenizers are a JSON file of byte-level BPE and a sentencepiece model with byte fallback, named by a
path or by their name in the package of public tokenizers; every executor reads its own copy.

Defined results: a text that is null or empty, or whose tokens do not give back a space and the text
on both sides (B's normaliser can change a text), has no tokens: zeros and no groups. Strings of
special tokens are plain text. Every row is a document of its own, rows that repeat an id or a text
too. A text is encoded in one task, so texts go up to Spark's 2 GB of a value. Extra columns are not read and
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.text import small_batches
from gridweave.plans.staging import materialise

#: Products of ids in one slice of a document's pairs, and pairs whose counts every task holds.
SLICE = 1 << 20
FREQUENT = 1 << 17
#: Width of a B id in a pair.
SHIFT = 32


class Pieces:
    """A sentencepiece model and the bytes of its pieces, U+2581 being a space."""

    def __init__(self, path: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path if os.path.sep in path else public_tokenizers.path(path))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Side:
    """Ids of one tokenizer with their bytes, their lengths and their decimal texts before each separator."""

    def __init__(self, tokenizer: bpe.Vocabulary | Pieces):
        self.tokenizer = tokenizer
        self.sizes = np.array([len(x) for x in tokenizer.bytes_of], np.int64)
        self.texts = np.array([[f"{i}{mark}" for i in range(len(self.sizes))] for mark in ",|;"], dtype=object)

    def bytes_for(self, ids: np.ndarray) -> bytes:
        table = self.tokenizer.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def sides(vocab: str, pieces: str) -> tuple[Side, Side]:
    return Side(bpe.vocabulary(vocab)), Side(Pieces(pieces))


class Intervals:
    """Static index over intervals that tile a range."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last interval that overlaps each ``[start, end)``."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


def group_starts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of each group."""
    own = Intervals(a_sizes)
    low, high = Intervals(b_sizes).stab(own.starts, own.ends)
    first = np.concatenate(([0], 1 + np.flatnonzero(high[:-1] <= low[1:])))
    return first, low[first]


def group_text(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, one: Side, two: Side) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    a_last, b_last = np.append(a_first[1:], len(a)), np.append(b_first[1:], len(b))
    out = np.empty(len(a) + len(b), dtype=object)
    for ids, first, last, shift, side, mark in ((a, a_first, a_last, b_first, one, 1), (b, b_first, b_last, a_last, two, 2)):
        marks = np.zeros(len(ids), np.int64)
        marks[last - 1] = mark
        out[np.arange(len(ids)) + np.repeat(shift, last - first)] = side.texts[marks, ids]
    return "".join(out.tolist())[:-1]


def _different(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and occurrences of the different ids of each group, by group."""
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
    keys, times = np.unique(group << SHIFT | ids, return_counts=True)
    return keys >> SHIFT, keys & ((1 << SHIFT) - 1), times


def pair_slices(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different linked pairs (A id above ``SHIFT`` bits) and their links; no pair is in two slices."""
    a_group, a_id, a_times = _different(a, a_first)
    b_group, b_id, b_times = _different(b, b_first)
    b_low = np.searchsorted(b_group, np.arange(len(a_first)))
    width = np.diff(b_low, append=len(b_id))
    order = np.argsort(a_id, kind="stable")
    a_group, a_id, a_times = a_group[order], a_id[order], a_times[order]
    made = np.cumsum(width[a_group])
    heads = np.flatnonzero(np.diff(a_id, prepend=-1))
    low = 0
    while low < len(a_id):
        # As many whole A ids as stay within the limit, one at least.
        later = np.append(heads[heads > low], len(a_id))
        fits = later[made[later - 1] - (made[low - 1] if low else 0) <= most]
        high = int(fits[-1] if len(fits) else later[0])
        n = width[a_group[low:high]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b_low[a_group[low:high]], n)
        keys = np.repeat(a_id[low:high], n) << SHIFT | b_id[at]
        times = np.repeat(a_times[low:high], n) * b_times[at]
        by_key = np.argsort(keys, kind="stable")
        keys = keys[by_key]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(times[by_key], first)
        low = high


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model", slice_links: int = SLICE) -> DataFrame:
    """``row, id, n_a, n_b, n_groups, n_links, groups, pairs, times``.

    ``groups`` has the ids of each group as text, empty without tokens; ``pairs`` the different linked pairs,
    ``times`` their links. A document of more pairs has more rows of the same ``row`` number, null but
    for pairs. Row numbers hold within one evaluation: write the result before it is read twice.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(vocab, pieces)
        for batch in batches:
            rows: list[tuple] = []
            for row, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = " " + (text.as_py() or "")
                data = whole.encode()
                a, b = (one.tokenizer.encode_text(whole).astype(np.int64), two.tokenizer.encode(whole[1:])) if len(data) > 1 else ([], [])
                if not len(a) or one.bytes_for(a) != data or two.bytes_for(b) != data:
                    rows.append((row, id_, 0, 0, 0, 0, "", [], []))
                    continue
                a_first, b_first = group_starts(one.sizes[a], two.sizes[b])
                links = int((np.diff(a_first, append=len(a)) * np.diff(b_first, append=len(b))).sum())
                head = (row, id_, len(a), len(b), len(a_first), links, group_text(a, b, a_first, b_first, one, two))
                for keys, times in pair_slices(a, b, a_first, b_first, slice_links):
                    rows.append((*head, keys, times))
                    head = (row, *[None] * 6)
            types = [pa.int64(), batch.schema.field(1).type, *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["row", "id", *numbers, "groups", "pairs", "times"])

    schema = f"row bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(scan, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n)``: how many documents hold each pair linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs above a count that at most ``most`` pairs reach, their counts, and whether those are all pairs."""
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    heights = sorted(((r["step"], r["count"]) for r in counts.groupBy(step).count().collect()), reverse=True)
    least, held = None, 0
    for height, n in heights:
        if held + n > most:
            break
        least, held = height, held + n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), not heights
    found = counts.where(step >= least).toPandas().sort_values("pair")
    return found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), held == sum(n for _, n in heights)


def with_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The documents of :func:`align`, whatever columns it was given or left with besides ``row, pairs,
    times``, with ``n_best`` (links whose count is the highest of their A id) and ``count_sum`` (over links)."""
    spark = aligned.sparkSession
    aligned = materialise(aligned, "aligned")
    counts = materialise(pair_counts(aligned), "pair-counts")
    # A row for each id of A's vocabulary at most.
    best = materialise(counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("highest")), "highest-counts")
    held = best.toPandas()
    highest = np.zeros(int(held["a"].max()) + 1 if len(held) else 1, np.int64)
    highest[held["a"].to_numpy(np.int64)] = held["highest"].to_numpy(np.int64)
    keys, numbers, complete = _frequent(counts, frequent)
    shared = spark.sparkContext.broadcast((keys, numbers, highest))
    carried = [c for c in aligned.columns if c not in ("row", "pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, highest = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
            pair, links = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            n = np.where(known, numbers[at] if len(keys) else 0, 0)
            top = known & (n == highest[pair >> SHIFT])
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, row[top], links[top])
            np.add.at(total, row, links * n)
            left = np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))))
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known], pa.int64())) for x in (pair, links)]
            own = [batch.column(c) for c in ("row", *carried)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(best), pa.array(total), *rest], names=["row", *carried, "n_best", "count_sum", "pairs", "times"])

    fields = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in ("row", *carried))
    small_batches(spark)
    found = aligned.mapInArrow(look_up, f"{fields}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    settled = found.drop("pairs", "times")
    if not complete:
        found = materialise(found, "looked-up")
        rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
        joined = rest.join(counts, "pair").join(F.broadcast(best), F.shiftright("pair", SHIFT) == F.col("a"))
        top = F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)
        more = joined.groupBy("row").agg(F.sum(top).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        settled = found.drop("pairs", "times").unionByName(more, allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    return settled.groupBy("row").agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in carried], *sums).drop("row")
