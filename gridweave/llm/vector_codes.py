"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

A vector of whole numbers is cut into equal consecutive parts, each with a codebook of its own. Which
entry is nearest is asked coarse to fine. At each level a part is cut into equal segments; with ``m``
for the block means and ``r`` for the norm of what the means leave over,

    |x - c|^2  >=  sum over segments of length * (m_x - m_c)^2  +  (r_x - r_c)^2,

as means and residuals are orthogonal. The entry of the least bound of a level gets its exact distance,
entries whose bound is above the best distance so far are filtered out, and what survives the finest
level is decided by exact integer distances. Bounds are floating point and get a slack that covers
their rounding, so no nearest entry is ever filtered; ties go to the lower index.

Codebooks hold ``entries`` times the dimension of a vector, whatever the number of rows, so they go to
every task. A round of fitting is a scan of the staged vectors: tasks sum the parts of each entry, and
only those sums (one row for an entry and place from each task) are shuffled.

Defined results: a vector that is null, empty, or holds a null or a non-finite component takes no part.
All others must have one length that the number of parts divides, and components small enough for exact
sums of 64 bits (below 65,536 for parts of 16); anything else is an error. Codebooks start from the
smallest ids, ties by the components; rows whose id is null are coded and counted but start no entry
unless there are no others left. Rows that repeat an id count row by row. With fewer rows than entries
a codebook has as many entries as rows. Extra columns are not read and may have any name. Empty input
gives empty codebooks and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.plans.staging import materialise

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows whose bounds to all entries are held at a time.
ROWS = 2048
#: Bytes of labels and their sums that are broadcast; more are joined by a shuffle.
MOST_LABELS = 1 << 20


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 1024) -> DataFrame:
    """``(id, label, weights array<bigint>)`` with ``floor(scale * x)`` of each component, for the vectors that take part."""
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(scale))
        too_large = F.raise_error(F.lit("a component does not fit 64 bits")).cast("bigint")
        return F.when(F.abs(scaled) < F.lit(2.0**62), F.floor(scaled).cast("bigint")).otherwise(too_large)

    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.alias("vector"))
    return rows.where(usable & (F.size("vector") > 0)).select("id", "label", F.transform("vector", whole).alias("weights"))


def levels(length: int) -> list[int]:
    """Numbers of equal segments, each a multiple of the one before, short of single components."""
    out, count = [], 1
    while count < length:
        out.append(count)
        rest = length // count
        count *= next(k for k in range(2, rest + 1) if rest % k == 0)
    return out


class Sketch:
    """Segment sums and residual norms of the rows of an integer matrix, by level."""

    def __init__(self, rows: np.ndarray):
        self.sums, self.rest = {}, {}
        length = rows.shape[1]
        energy = (rows * rows).sum(axis=1)
        for count in levels(length):
            width = length // count
            sums = rows.reshape(len(rows), count, width).sum(axis=2)
            # A whole number, so that nothing cancels before the root.
            left = energy * width - (sums * sums).sum(axis=1)
            self.sums[count], self.rest[count] = sums.astype(np.float64), np.sqrt(left / width)
        self.most = float(energy.max(initial=0))


def _distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((rows - entries) ** 2).sum(axis=1)


def nearest(rows: np.ndarray, book: np.ndarray, sketch: Sketch | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact distance of each row's nearest entry, and how many exact distances that took."""
    length, theirs = rows.shape[1], sketch or Sketch(book)
    mine = Sketch(rows)
    slack = 1e-11 * (mine.most + theirs.most)
    n = len(rows)
    if not levels(length):
        at, entry = np.repeat(np.arange(n), len(book)), np.tile(np.arange(len(book)), n)
    else:
        bound = (mine.sums[1] - theirs.sums[1].T) ** 2 / length + (mine.rest[1][:, None] - theirs.rest[1]) ** 2
        best = _distances(rows, book[bound.argmin(axis=1)])
        at, entry = np.nonzero(bound - slack <= best[:, None])
    asked = n
    for count in levels(length)[1:]:
        means = ((mine.sums[count][at] - theirs.sums[count][entry]) ** 2).sum(axis=1) * (count / length)
        bound = means + (mine.rest[count][at] - theirs.rest[count][entry]) ** 2
        # Every row still has its nearest entry, so each row has a stretch of pairs.
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        least = np.flatnonzero(bound == np.repeat(np.minimum.reduceat(bound, starts), np.diff(starts, append=len(at))))
        np.minimum.at(best, at[least], _distances(rows[at[least]], book[entry[least]]))
        asked += len(least)
        keep = bound - slack <= best[at]
        at, entry = at[keep], entry[keep]
    exact = _distances(rows[at], book[entry])
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    found = np.minimum.reduceat(exact, starts)
    ties = np.flatnonzero(exact == np.repeat(found, np.diff(starts, append=len(at))))
    first = ties[np.flatnonzero(np.diff(at[ties], prepend=-1))]
    return entry[first], found, asked + len(exact)


@dataclass
class Codebooks:
    """``books[part, entry, place]``."""

    books: np.ndarray

    def __getstate__(self) -> dict:
        return {"books": self.books}

    @cached_property
    def sketches(self) -> list[Sketch]:
        return [Sketch(book) for book in self.books]

    @property
    def most(self) -> int:
        """Components of at most this size have exact bounds and errors."""
        parts, _, length = self.books.shape
        return int((2**62 // (4 * parts * length * max(parts, length))) ** 0.5)

    def assign(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, by row and part."""
        parts, _, length = self.books.shape
        if len(weights) and max(-int(weights.min()), int(weights.max())) > self.most:
            raise ValueError(f"components above {self.most} after scaling are too large for exact sums")
        codes, errors = np.zeros((len(weights), parts), np.int64), np.zeros((len(weights), parts), np.int64)
        for low in range(0, len(weights), ROWS):
            for part in range(parts):
                rows = weights[low : low + ROWS, part * length : (part + 1) * length]
                codes[low : low + ROWS, part], errors[low : low + ROWS, part], _ = nearest(rows, self.books[part], self.sketches[part])
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    if set(np.unique(np.diff(column.offsets.to_numpy()))) - {dimension}:
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def initial(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the rows of the smallest ids."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "weights").limit(entries).select("weights").collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    dimension = len(first[0].weights)
    if dimension % parts or {len(r.weights) for r in first} != {dimension}:
        raise ValueError(f"vectors must have one length that {parts} divides")
    start = np.array([r.weights for r in first], np.int64)
    return Codebooks(start.reshape(len(start), parts, dimension // parts).swapaxes(0, 1).copy())


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of the parts nearest to it; entries that none is nearest to stay."""
    parts, entries, length = books.books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, count = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            weights = _matrix(batch.column(0), parts * length)
            codes, _ = own.assign(weights)
            for part in range(parts):
                places = part * entries + codes[:, part]
                np.add.at(total, places, weights[:, part * length : (part + 1) * length])
                count += np.bincount(places, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"entry": pa.array(used, pa.int32()), "n": pa.array(count[used], pa.int64()), "sums": pa.array(list(total[used]), pa.list_(pa.int64()))}
        )

    found = rows.select("weights").mapInArrow(sums, "entry int, n bigint, sums array<bigint>")
    places = found.select("entry", "n", F.posexplode("sums").alias("place", "value"))
    made = places.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    new = books.books.reshape(parts * entries, length).copy()
    new[made["entry"], made["place"]] = made["value"].to_numpy(np.int64) // made["n"].to_numpy(np.int64)
    return Codebooks(new.reshape(parts, entries, length))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``(id, weights)`` after ``rounds`` rounds; ``rows`` are scanned once a round."""
    books = initial(rows, parts, entries)
    for _ in range(rounds if books.books.size else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` as ``(id, label, code, error)``: two hex digits for each part, and the squared distance of the whole vector."""
    parts, entries, length = books.books.shape
    if entries > 256:
        raise ValueError("codes of two hex digits need at most 256 entries")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {types['id']}, label {types['label']}, code string, error bigint"
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = shared.value.assign(_matrix(batch.column(2), parts * length))
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors.sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    return rows.select("id", "label", "weights").mapInArrow(scan, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``weights``, the entries that the code names put together."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<bigint>")
    def named(code):
        own = shared.value.books
        return code.map(lambda c: np.concatenate([book[i] for book, i in zip(own, bytes.fromhex(c))]))

    return codes.withColumn("weights", named("code"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``(id, label, code, error)`` with ``label_error``, the sum over equal labels, nulls together."""
    coded = materialise(coded, "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    size = totals.agg(F.coalesce(F.sum(F.octet_length(F.col("label").cast("string")) + 32), F.lit(0))).first()[0]
    totals = totals.withColumnRenamed("label", "same")
    if size <= MOST_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("same"))).drop("same")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """``(id, label, code, error, label_error)`` of every vector that takes part, and the codebooks."""
    rows = whole_numbers(vectors, id_col, vector_col, label_col, scale)
    rows = materialise(rows, "whole-vectors")
    books = fit(rows, parts, entries, rounds)
    return with_label_errors(encode(rows, books)), books
