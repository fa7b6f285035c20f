"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Components are the terms. Candidates are dealt into blocks by a hash of their id, and a block keeps,
for each term, the posting list of its rows and weights. Queries are dealt into blocks likewise. For
each pair of blocks, every term's query weights scatter the weighted postings into a dense array of
scores; a partition selects each query's best of the block, and the blocks' winners are merged by a
ranked window. Every query meets every candidate once; nothing is pruned or approximated.

Blocks bound the memory of a task: ``query_block * block`` scores and two posting lists. Blocks of
queries, packed as one row each, are sent to every block of candidates; rows are sorted so that a
block of candidates comes first and is read once, and the blocks of queries stream past it. Neither
side passes through the driver.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part, nor
does a row whose id is null. An id names a vector: rows that share the query's id are not its
candidates, and a repeated query id is asked once, with its smallest vector. Equal scores rank by the
smaller id; candidates that repeat an id and a score take a rank each. Missing terms of shorter
vectors count as zero. Scores are exact integers; a component or a score beyond 64 bits is an error.
Ids are integers; one that does not cast to a long is an error. Extra columns are not read and may have
any name. A query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.text import small_batches
from gridweave.plans.staging import materialise

#: Rows of a block of candidates and of a block of queries.
BLOCK = 1024
QUERY_BLOCK = 256
PACKED = "block bigint, n int, ids binary, terms binary, starts binary, rows binary, weights binary"
PARTS = ["ids", "terms", "starts", "rows", "weights"]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, weights)`` with ``floor(scale * x)`` of each component, for the vectors that take part."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))

    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(scale))
        return F.when(F.abs(scaled) < F.lit(2.0**63), F.floor(scaled).cast("bigint")).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("bigint"))

    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("vector"))
        .where("id is not null and vector is not null")
        .where(usable)
        .select("id", F.transform("vector", whole).alias("weights"))
    )


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    """A block as one row: ids in ascending order and, by term, its rows and non-zero weights."""
    group = group.sort_by("id").combine_chunks()
    lists = group["weights"].chunk(0)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = flat != 0
    flat, rows, terms = flat[keep], rows[keep], terms[keep]
    order = np.argsort(terms, kind="stable")
    names, starts = np.unique(terms[order], return_index=True)
    parts = (names.astype(np.int64), np.append(starts, len(terms)).astype(np.int64), rows[order], flat[order])
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "n": pa.array([len(lengths)], pa.int32()),
            "ids": pa.array([group["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("terms", "starts", "rows", "weights"), parts)},
        }
    )


class _Postings:
    def __init__(self, ids: bytes, terms: bytes, starts: bytes, rows: bytes, weights: bytes):
        self.ids, self.starts = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)
        self.rows, self.weights = np.frombuffer(rows, np.int32), np.frombuffer(weights, np.int64)
        self.place = {int(t): k for k, t in enumerate(np.frombuffer(terms, np.int64))}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.place[term]
        a, b = self.starts[k], self.starts[k + 1]
        return self.rows[a:b], self.weights[a:b]

    def largest(self) -> int:
        return max((abs(int(self.weights.min())), abs(int(self.weights.max())))) if len(self.weights) else 0


def _scores(queries: _Postings, candidates: _Postings) -> np.ndarray:
    """Dense scores of two blocks, term by term."""
    shape = (len(queries.ids), len(candidates.ids))
    shared = [t for t in queries.place if t in candidates.place]
    wide = queries.largest() * candidates.largest() * max(1, len(shared)) >= 1 << 63
    scores = np.zeros(shape, dtype=object if wide else np.int64)
    for term in shared:
        q_rows, q_weights = queries.of(term)
        c_rows, c_weights = candidates.of(term)
        if wide:
            q_weights, c_weights = q_weights.astype(object), c_weights.astype(object)
        add = q_weights[:, None] * c_weights[None, :]
        if add.shape == shape:
            scores += add
        else:
            scores[np.ix_(q_rows, c_rows)] += add
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id; ``ids`` ascend, ``own`` is left out."""
    others = np.flatnonzero(ids != own)
    values = scores[others]
    if len(others) > k:
        limit = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > limit)
        ties = np.flatnonzero(values == limit)[: k - len(above)]
        others = others[np.concatenate((above, ties))]
    return others


def _winners(queries: _Postings, candidates: _Postings, k: int) -> pa.RecordBatch:
    """The k best of a block of candidates for each query of a block."""
    scores = _scores(queries, candidates)
    out: list[list] = [[], [], []]
    for at, own in enumerate(queries.ids):
        best = _best(scores[at], candidates.ids, own, k)
        out[0] += [own] * len(best)
        out[1] += candidates.ids[best].tolist()
        out[2] += scores[at, best].tolist()
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each query; both sides come as
    ``(id, weights array<bigint>)``."""
    asked = queries.groupBy("id").agg(F.min("weights").alias("weights"))
    asked, stored = materialise(asked, "queries"), materialise(candidates, "candidates")
    n_blocks = max(1, -(-stored.count() // block))
    n_query_blocks = max(1, -(-asked.count() // query_block))

    def packed(rows: DataFrame, n: int) -> DataFrame:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        return materialise(dealt.groupBy("block").applyInArrow(_pack, PACKED), "packed")

    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block")
    sent = packed(asked, n_query_blocks).select(blocks, F.lit(True).alias("asks"), *PARTS)
    both = packed(stored, n_blocks).select("block", F.lit(False).alias("asks"), *PARTS).unionByName(sent)
    small_batches(queries.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, candidates = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                number, asks, *parts = (column[row].as_py() for column in batch.columns)
                if not asks:
                    block, candidates = number, _Postings(*parts)
                elif number == block:
                    yield _winners(_Postings(*parts), candidates, k)

    # As many partitions as blocks of candidates, so that a task has about one; more come by turns.
    met = both.repartition(n_blocks, "block").sortWithinPartitions("block", "asks")
    found = met.select("block", "asks", *PARTS).mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
