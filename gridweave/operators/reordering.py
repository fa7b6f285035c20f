"""Order of all rows of a sparse matrix in which neighbours share many columns.

Rows are vertices, distances are Hamming distances of their columns, and the order is a path made of
fragments. At first each row is a fragment. In a round, fragments are sorted by minimal hashes of the columns of
one of their ends, by another hash function each round; rows of many shared columns come to stand near each other. The sort is cut
into blocks of ``BLOCK`` fragments, and those of a block are joined, nearest free ends first, until ``SHARE`` of the joins that
would leave one path are made. Joins of far ends so wait for another sort. A fragment is in one block of a round, with both of its ends,
so no join closes a circle. Fragments that are left when they fit one task (``FINISH`` fragments and
``FINISH_ENTRIES`` entries of their ends, both counted first) are joined there by the same rule over all pairs of ends.

A round works on fragments, not rows: their number falls by a constant factor a round, and where
rows stand is composed once, from the last round back to the first. No task holds a column's rows
or more than a few blocks of a sort, so hot columns cost nothing.

Rows without entries are no rows here: any place serves them. Nulls take no part; row numbers are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.plans.staging import materialise

#: Least values of a hash function that order the ends.
HASHES = 4
#: Fragments and entries of a block, the share of its joins that are made, and the nearest ends that one end may join.
BLOCK, BLOCK_ENTRIES, SHARE, NEAR = 256, 1 << 18, 0.75, 8
#: Fragments and entries of a task of a round.
TASK, TASK_ENTRIES = 1 << 15, 1 << 21
FINISH, FINISH_ENTRIES = 1024, 1 << 20
#: Rows of a column from which it is compared by a product of dense matrices, and columns of one product.
DENSE, PRODUCT = 32, 4096


def row_columns(nz: DataFrame) -> DataFrame:
    """``(i, columns)``: the different columns of each row in ascending order."""
    cells = nz.where("i is not null and j is not null").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    return cells.groupBy("i").agg(F.sort_array(F.collect_set("j")).alias("columns"))


def shared_columns(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many columns each two of some rows share; ``values`` are the rows' different columns one after another."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    row, column = row[order], values[order]
    new = np.concatenate(([True], column[1:] != column[:-1])) if len(column) else np.zeros(0, dtype=bool)
    code = np.cumsum(new) - 1
    held = np.bincount(code)
    hot = held[code] > DENSE
    # Columns of few rows by pairs of entries that stand next to each other, then one further apart, and so on.
    light, of = row[~hot], code[~hot]
    met = []
    for shift in range(1, DENSE):
        same = np.flatnonzero(of[shift:] == of[:-shift])
        if not len(same):
            break
        met.append(light[same] * n + light[same + shift])
    shared = np.bincount(np.concatenate(met), minlength=n * n).reshape(n, n) if met else np.zeros((n, n), dtype=np.int64)
    shared = shared + shared.T
    # Those of many rows by dense products, a bounded number of columns at a time.
    names = np.flatnonzero(held > DENSE)
    place, of = row[hot], np.searchsorted(names, code[hot])
    for at in range(0, len(names), PRODUCT):
        low, high = np.searchsorted(of, (at, at + PRODUCT))
        dense = np.zeros((n, min(PRODUCT, len(names) - at)), dtype=np.float32)
        dense[place[low:high], of[low:high] - at] = 1
        shared += (dense @ dense.T).astype(np.int64)
    return shared


def _nearest_pairs(values: np.ndarray, sizes: np.ndarray, fragment: np.ndarray, near: int | None) -> list[tuple[int, int]]:
    """Pairs ``x < y`` of ends of different fragments by ascending distance, ties by place: all, or those that are
    among the ``near`` nearest of one of both."""
    n = len(sizes)
    distance = sizes[:, None] + sizes[None, :] - 2 * shared_columns(values, sizes)
    far = np.iinfo(np.int64).max
    distance[fragment[:, None] == fragment[None, :]] = far
    if near is None or near >= n - 1:
        x, y = np.triu_indices(n, 1)
    else:
        best = np.argpartition(distance, near - 1, axis=1)[:, :near]
        x, y = np.repeat(np.arange(n), near), best.reshape(-1)
        x, y = np.divmod(np.unique(np.minimum(x, y) * n + np.maximum(x, y)), n)
    keep = distance[x, y] < far
    x, y = x[keep], y[keep]
    order = np.argsort(distance[x, y], kind="stable")
    return list(zip(x[order].tolist(), y[order].tolist()))


def _paths(names: list[int], pairs: list[tuple[int, int]], fragments: list[tuple], joins: int) -> list[tuple[list[tuple[int, bool]], int, int]]:
    """Paths ``([(fragment, flipped), ...], head, tail)`` after at most ``joins`` joins of ``pairs`` in their order."""
    of = {e: f for f, head, tail, _ in fragments for e in (head, tail)}
    paths = {f: [(f, False)] for f, *_ in fragments}
    outer = {f: [head, tail] for f, head, tail, _ in fragments}
    for x, y in pairs:
        if not joins:
            break
        u, v = names[x], names[y]
        a, b = of[u], of[v]
        if a is None or b is None or a == b:
            continue
        joins -= 1
        if outer[a][1] != u:
            paths[a], outer[a] = [(f, not flip) for f, flip in reversed(paths[a])], outer[a][::-1]
        if outer[b][0] != v:
            paths[b], outer[b] = [(f, not flip) for f, flip in reversed(paths[b])], outer[b][::-1]
        paths[a] += paths.pop(b)
        outer[a] = [outer[a][0], outer.pop(b)[1]]
        for e in (u, v):
            if e not in outer[a]:
                of[e] = None
        of[outer[a][0]] = of[outer[a][1]] = a
    return [(path, *outer[f]) for f, path in paths.items()]


def joined_ends(ends: list[tuple], fragments: list[tuple]) -> list[tuple[int, int, bool]]:
    """``(fragment, start, flipped)``: joins the nearest ends of different fragments until one path is left."""
    if not fragments:
        return []
    ends = sorted(ends)
    names = [e for e, _ in ends]
    of = {e: f for f, head, tail, _ in fragments for e in (head, tail)}
    values = np.array([j for _, c in ends for j in c], dtype=np.int64)
    pairs = _nearest_pairs(values, np.array([len(c) for _, c in ends]), np.array([of[e] for e in names]), None)
    ((path, _, _),) = _paths(names, pairs, fragments, len(fragments))
    size = {f: n for f, _, _, n in fragments}
    starts = np.cumsum([0] + [size[f] for f, _ in path])
    return [(f, int(start), flip) for (f, flip), start in zip(path, starts)]


_STEP = pa.schema(
    [("fragment", pa.int64()), ("n", pa.int64()), ("parent", pa.int64()), ("before", pa.int64()), ("flip", pa.bool_()), ("whole", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("head_columns", "tail_columns")]
)


def _block(rows: pa.RecordBatch, near: int) -> pa.RecordBatch:
    """A row of the round for each fragment of a block: where it stands in the path that it is in now, which is named
    after its first fragment; that one's row has the ends of the path too."""
    fragment, head, tail, n = (rows.column(c).to_numpy() for c in range(4))
    two = np.flatnonzero(head != tail)
    lists = pa.concat_arrays([rows.column(4), rows.column(5).take(pa.array(two))])
    names = np.concatenate((head, tail[two]))
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    pairs = _nearest_pairs(lists.flatten().to_numpy(), sizes, np.concatenate((fragment, fragment[two])), near)
    each = list(zip(fragment.tolist(), head.tolist(), tail.tolist(), n.tolist()))
    place, size = {e: k for k, e in enumerate(names.tolist())}, {f: k for f, _, _, k in each}
    out, ends = [], []
    for path, first, last in _paths(names.tolist(), pairs, each, max(1, math.ceil(SHARE * (len(each) - 1)))):
        at, whole, parent = 0, sum(size[f] for f, _ in path), path[0][0]
        for f, flip in path:
            new = f == parent
            out.append((f, size[f], parent, at, flip, whole, first if new else None, last if new else None))
            ends.append((place[first] if new else None, place[last] if new and first != last else None))
            at += size[f]
    columns = [pa.array(x, t) for x, t in zip(zip(*out), _STEP.types)]
    return pa.RecordBatch.from_arrays(columns + [lists.take(pa.array(x, pa.int64())) for x in zip(*ends)], schema=_STEP)


def _round(fragments: DataFrame, seed: int, partitions: int, near: int) -> DataFrame:
    """The joins of one round, a row of :data:`_STEP` for each fragment."""
    # The end that places the fragment, by a hash.
    first = F.col("tail_columns").isNull() | (F.pmod(F.xxhash64(F.lit(seed), "fragment"), F.lit(2)) == 0)
    hashes = F.slice(F.sort_array(F.transform(F.when(first, F.col("head_columns")).otherwise(F.col("tail_columns")), lambda j: F.xxhash64(F.lit(seed), j))), 1, HASHES)
    placed = fragments.withColumn("hashes", hashes).repartitionByRange(partitions, "hashes", "fragment").sortWithinPartitions("hashes", "fragment")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
            held = None
            if rows:
                held, made = _cut(rows[0], near, False)
                yield from made
        if held is not None:
            yield from _cut(held, near, True)[1]

    return placed.select("fragment", "head", "tail", "n", "head_columns", "tail_columns").mapInArrow(
        scan, "fragment bigint, n bigint, parent bigint, before bigint, flip boolean, whole bigint, head bigint, tail bigint, head_columns array<bigint>, tail_columns array<bigint>"
    )


def _cut(rows: pa.RecordBatch, near: int, last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
    """Blocks of ``rows``, and the rows after the last one that is full. A block has two fragments at least, if there are as many."""
    entries = sum(np.diff(rows.column(c).offsets.to_numpy()).astype(np.int64) for c in (4, 5))
    total, at, made = np.concatenate(([0], np.cumsum(entries))), 0, []
    while at < rows.num_rows:
        full = int(np.searchsorted(total, total[at] + BLOCK_ENTRIES, side="right")) - 1
        stop = min(at + BLOCK, max(full, at + 2))
        if stop >= rows.num_rows and not last:
            return rows.slice(at), made
        made.append(_block(rows.slice(at, stop - at), near))
        at = stop
    return None, made


def _finished(fragments: DataFrame) -> DataFrame:
    """``fragment, start, flipped``: all fragments joined in one task, nearest free ends first."""
    whole = fragments.agg(F.collect_list(F.struct("fragment", "head", "tail", "n", "head_columns", "tail_columns")).alias("fragments")).select("fragments")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rows,) in (x.values() for x in batch.to_pylist()):
                ends = [(x[e], x[f"{e}_columns"]) for x in rows for e in ("head", "tail") if x[f"{e}_columns"] is not None]
                placed = joined_ends(ends, [(x["fragment"], x["head"], x["tail"], x["n"]) for x in rows])
                yield pa.RecordBatch.from_pydict(dict(zip(("fragment", "start", "flipped"), map(list, zip(*placed)))))

    return whole.mapInArrow(join, "fragment bigint, start bigint, flipped boolean")


def nearest_order(nz: DataFrame, near: int = NEAR, finish: int = FINISH) -> DataFrame:
    """``(i, place)``: a permutation of all rows that have entries, places from 0."""
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("array<bigint>")
    names = [F.col("i").alias(c) for c in ("fragment", "head", "tail")]
    fragments = materialise(row_columns(nz).select(*names, one.alias("n"), F.col("columns").alias("head_columns"), none.alias("tail_columns")), "fragments")
    cores = nz.sparkSession.sparkContext.defaultParallelism
    entries = F.size("head_columns") + F.coalesce(F.size("tail_columns"), F.lit(0))
    steps = []
    while True:
        count, held = fragments.agg(F.count(F.lit(1)), F.sum(F.when(F.col("tail_columns").isNull(), F.size("head_columns")).otherwise(entries))).first()
        if count < 2 or count <= finish and held <= FINISH_ENTRIES:
            break
        # Some task has four fragments, so that some are joined, and small tables occupy all cores.
        tasks = max(math.ceil(count / TASK), math.ceil(held / TASK_ENTRIES), min(cores, count // (4 * BLOCK)))
        step = materialise(_round(fragments, len(steps), max(1, min(tasks, count // 4)), near), "joins")
        steps.append(step.select("fragment", "n", "parent", "before", "flip", "whole"))
        fragments = step.where("fragment = parent").select("fragment", "head", "tail", F.col("whole").alias("n"), "head_columns", "tail_columns")
    placed = _finished(fragments) if count > 1 else fragments.select("fragment", F.lit(0).cast("bigint").alias("start"), F.lit(False).alias("flipped"))
    for step in reversed(steps):
        placed = _opened(materialise(placed, "placed"), step)
    return materialise(placed.select(F.col("fragment").alias("i"), F.col("start").alias("place")), "places")


def _opened(placed: DataFrame, step: DataFrame) -> DataFrame:
    """Places of the fragments before a round, from those of the fragments after it."""
    joined = step.join(placed.withColumnRenamed("fragment", "parent"), "parent")
    start = F.when(F.col("flipped"), F.col("start") + F.col("whole") - F.col("before") - F.col("n")).otherwise(F.col("start") + F.col("before"))
    return joined.select("fragment", start.alias("start"), (F.col("flip") != F.col("flipped")).alias("flipped"))


def path_distances(nz: DataFrame, order: DataFrame) -> DataFrame:
    """``(place, i, distance)``: Hamming distance of each row of an order to the one before, null for the first."""
    rows = materialise(row_columns(nz).join(order, "i"), "placed-rows")
    last = rows.select((F.col("place") + 1).alias("place"), F.col("columns").alias("last"))
    distance = F.size("columns") + F.size("last") - 2 * F.size(F.array_intersect("columns", "last"))
    return rows.join(last, "place", "left").select("place", "i", F.when(F.col("last").isNotNull(), distance.cast("bigint")).alias("distance"))
