"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprint: every word shingle (repeats included) is hashed by XXH64; a bit is set if it is set in
more than half of the hashes. Two documents link if their fingerprints differ in at most ``radius``
bits, and a document's component is all that its links reach.

Covering masks: bit ``i`` of the fingerprint gets the non-zero vector ``1 + i mod (2^(radius+1)-1)``
over GF(2); the table of vector ``v`` keeps the bits whose vector has an odd product with ``v``.
For any ``radius`` differing bits some non-zero ``v`` is orthogonal to all of their vectors, so that
table keeps none of them: every pair within the radius shares a bucket of some table, for certain.

Buckets are never expanded into pairs. A bucket of two fingerprints is compared at once. In a larger
one each fingerprint emits itself and its variants with one free bit flipped (the bits which the
table does not keep): fingerprints of one bucket differ by two bits or fewer exactly if they share a
variant, and all that share one link through the smallest of them. A variant has at most one member
for each free bit, so no group grows with the data.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link
like any other; fewer words than a shingle make one shingle. Rows that repeat an id are judged row
by row. A null id takes part in links but is never a component id unless the whole component has
none. A text is read whole in one task, so texts go up to Spark's 2 GB of a value. Extra columns are
not read, those of :func:`near_dedup` are carried along, and they may have any name. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import small_batches
from gridweave.operators.graph import components
from gridweave.operators.membership import drop_ids
from gridweave.plans.staging import checkpoint, materialise

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time: bounds memory on very long texts.
COUNT_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 bytes as an unsigned integer. Lower-cases A-Z, splits at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), COUNT_BLOCK):
        part = zip(starts[at : at + COUNT_BLOCK].tolist(), ends[at : at + COUNT_BLOCK].tolist())
        counts += bit_counts(np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8"))
    return majority(counts, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes set each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes set."""
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for each row; ``fp`` is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint"
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"]
            )

    return rows.mapInArrow(scan, schema)


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits; as signed 64-bit integers."""
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _buckets(nodes: DataFrame, masks: list[int]) -> DataFrame:
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]
    return nodes.select("fp", F.explode(F.array(*tables)).alias("b")).select("fp", "b.t", "b.key")


def _variants(fp: Column, t: Column, masks: list[int]) -> Column:
    """The fingerprint and its variants with one bit flipped that table ``t`` does not keep."""
    out = None
    for table, mask in enumerate(masks):
        free = [1 << i for i in range(BITS) if not (mask >> i) & 1]
        flips = [F.lit(0).cast("long"), *(F.lit(x - (1 << BITS) if x >> (BITS - 1) else x).cast("long") for x in free)]
        array = F.transform(F.array(*flips), lambda x: fp.bitwiseXOR(x))
        out = F.when(t == table, array) if out is None else out.when(t == table, array)
    return out


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``nodes(fp)``: enough of them that components
    over the edges are those over all pairs within ``radius``, which is 2: two fingerprints share a
    one-flip variant exactly if they differ in two bits or fewer."""
    if radius != 2:
        raise ValueError("variants with one flipped bit settle radius 2 only")
    masks = covering_masks(radius)
    buckets = _buckets(nodes, masks)
    full = checkpoint(
        buckets.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = full.where(F.col("n") == 2).where(near).select("u", "v")
    crowded = buckets.join(full.where("n > 2").select("t", "key"), ["t", "key"])
    shared = (
        crowded.select("fp", "t", F.explode(_variants(F.col("fp"), F.col("t"), masks)).alias("variant"))
        .groupBy("t", "variant")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    star = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return pairs.unionByName(star.where("u <> v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id, fp, component_id`` (the smallest id reachable)."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    linked = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = checkpoint(nodes.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    heads = checkpoint(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = checkpoint(rooted.join(heads, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns unchanged.

    Ids name documents: rows that repeat an id stay or go together, null ids always stay.
    """
    judged = near_duplicates(docs, id_col, text_col, shingle, radius)
    gone = materialise(judged.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "near")
    return drop_ids(docs, id_col, gone, gone.count())


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
