"""Near copies by the similarity of word shingles: SimHash tables and MinHash bands propose pairs, an
exact check decides.

Two documents link if the Jaccard similarity of their sets of word shingles is at least ``similarity``
(words as in :mod:`gridweave.llm.simhash`). A link is never made without that check, so documents that
only resemble each other stay.

Candidates are, first, the links of the covering tables of :mod:`gridweave.llm.simhash`. They alone
cannot find such pairs: at similarity 0.8 these differ in about 10 of 64 bits, where tables that cover
the radius are thousands and shorter keys meet at random. So there are, second, 64 minima in 16 bands
of 4: a pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8^4)^16 = 0.9998, one of 0.9
with more.

A bucket of at most ``CROWD`` rows is judged by its smallest member first; pairs with a row that this does
not settle follow. A crowded bucket is never expanded into pairs (:func:`crowd_links`): its rows are sets that
differ from a common set, and two rows that are not settled can only be similar if they differ from it in the
same way in many places. Both lose no link of rows that share a bucket.

Defined results: a null text counts as empty; texts without words are copies of each other; fewer
words than a shingle make one shingle. Ids name documents: rows that repeat an id stay or go together,
null ids always stay. A text is read whole in one task, so texts go up to Spark's 2 GB of a value. Extra columns
are carried along and may have any name. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm import simhash
from gridweave.llm.text import small_batches
from gridweave.operators.graph import components
from gridweave.operators.membership import build_filter, drop_ids, maybe
from gridweave.plans.staging import checkpoint, materialise

BANDS, ROWS = 16, 4
#: Shingles that one step of the minima takes: bounds memory on long texts.
BLOCK = 1024
#: Pairs that meet one copy of a leader's text.
SPREAD = 256
#: Rows of a bucket, or pairs for each row, that are still compared pair by pair.
CROWD = 32
#: Rows that make a group's common set, and rows that say which of its differences are frequent.
CENTRAL, SAMPLE = 15, 64
#: Times that groups are formed within groups before pairs are compared whatever their number.
DEPTH = 4
#: Slack of bounds that are computed in doubles; pairs are judged exactly.
SLACK = 1e-6

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 64, size=(BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included, in order."""
    words = text.lower().split()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, len(words) if len(words) < shingle else shingle, dtype=np.uint64)
    for k in range(min(shingle, len(words))):
        out = (out ^ hashed[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed integer."""
    counts = sum(simhash.bit_counts(hashes[at : at + simhash.COUNT_BLOCK]) for at in range(0, len(hashes), simhash.COUNT_BLOCK))
    value = simhash.majority(counts, len(hashes))
    return value - (1 << 64) if value >> 63 else value


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK] ^ _XOR) * _ODD).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))


def _node(text: Column) -> Column:
    """Name of a text: rows of one text are one node."""
    return F.unhex(F.md5(text))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, node, fp, keys)`` for each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _node(_bytes(text_col)).alias("node"), _bytes(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, node binary, fp bigint, keys array<bigint>"
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x.as_py(), shingle) for x in batch.column(2)]
            fps, keys = [fingerprint(x) for x in hashes], [band_keys(np.unique(x)) for x in hashes]
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "fp", "keys"])

    return rows.mapInArrow(scan, schema)


def _judged(pairs: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``(u, v, near)`` for each of ``pairs(u, v)`` by their texts. A text ``u`` of many pairs is
    copied once for each ``SPREAD`` of them, so that no task reads all pairs of one text."""
    spark = docs.sparkSession
    wanted = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    bits, words = build_filter(wanted, "node", wanted.count())
    rows = docs.select(_node(_bytes(text_col)).alias("node"), _bytes(text_col).alias("text"))
    texts = rows.where(maybe(F.col("node"), bits, words)).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    texts = materialise(texts, "texts")
    copies = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    firsts = texts.withColumnRenamed("node", "u").join(copies, "u").select("u", F.col("text").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    spread = pairs.join(copies, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int").alias("part"))
    both = spread.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(firsts, ["u", "part"]).select("u", "v", "a", "b")
    small_batches(spark)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            near = []
            for u, a, b in zip(batch.column(0), batch.column(2), batch.column(3)):
                if u.as_py() != last:
                    last, first = u.as_py(), shingles(a.as_py(), shingle)
                near.append(jaccard(first, shingles(b.as_py(), shingle)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["u", "v", "near"])

    return both.mapInArrow(judge, "u binary, v binary, near boolean")


def bucket_links(member: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` between similar rows of one bucket of ``member(key, node)``."""
    heads = member.groupBy("key").agg(F.min("node").alias("u"))
    met = checkpoint(member.join(heads, "key").where("u < node").select("key", "u", F.col("node").alias("v")))
    first = checkpoint(_judged(checkpoint(met.select("u", "v").distinct()), docs, text_col, shingle, similarity))
    open_rows = met.join(first.where("not near"), ["u", "v"]).select("key", F.col("v").alias("a"))
    pairs = open_rows.join(met.select("key", F.col("v").alias("b")), "key").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    asked = checkpoint(pairs.distinct().join(first, ["u", "v"], "left_anti"))
    return first.unionByName(_judged(asked, docs, text_col, shingle, similarity)).where("near").select("u", "v")


def _sets(wanted: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(node, items)``: the shingles of each text of ``wanted(node)``."""
    bits, words = build_filter(wanted, "node", wanted.count())
    rows = docs.select(_node(_bytes(text_col)).alias("node"), _bytes(text_col).alias("text"))
    rows = rows.where(maybe(F.col("node"), bits, words)).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])

    return materialise(rows.mapInArrow(scan, "node binary, items array<bigint>"), "sets")


def _core(rows: pa.Table) -> pa.Table:
    """Of a group's sample: the items that most central rows hold, and what rows often differ in, the rarest first."""
    sets = [np.array(x, dtype=np.int64) for x in rows.column("items").to_pylist()]
    central = rows.column("central").to_pylist()
    items, counts = np.unique(np.concatenate([x for x, c in zip(sets, central) if c]), return_counts=True)
    core = items[2 * counts > sum(central)]
    other = [np.setxor1d(x, core, assume_unique=True) for x, c in zip(sets, central) if not c]
    items, counts = np.unique(np.concatenate(other), return_counts=True)
    common = items[np.argsort(counts, kind="stable")][np.sort(counts) > 1]
    columns = [rows.column("g").combine_chunks()[:1], pa.array([core], pa.list_(pa.int64())), pa.array([common], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, names=["g", "core", "common"])


def _differences(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(g, node, part, n, holes, core, v, items)`` for each of ``rows(g, node, w)``: in what it differs from the
    common set of its group, frequent ones last, of these what it lacks, and the weight ``v`` of :func:`crowd_links`."""
    ranked = lambda *order: rows.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    sample = ranked(F.desc("w"), "node").where(F.col("at") <= CENTRAL).withColumn("central", F.lit(True))
    sample = sample.unionByName(ranked("node").where(F.col("at") <= SAMPLE).withColumn("central", F.lit(False)))
    cores = sample.join(sets, "node").select("g", "central", "items").groupBy("g").applyInArrow(_core, "g binary, core array<bigint>, common array<bigint>")
    copies = checkpoint(rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies")))
    cores = cores.join(copies, "g").select("g", "core", "common", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    dealt = rows.join(copies, "g").select("g", "node", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("part"))
    dealt = dealt.join(sets, "node").join(cores, ["g", "part"]).select("g", "node", "part", "items", "core", "common")
    small_batches(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, holes, size, made = [], [], [], []
            for items, core, common in zip(*batch.columns[3:]):
                items, core, common = (x.values.to_numpy() for x in (items, core, common))
                less, more = np.setdiff1d(core, items, assume_unique=True), np.setdiff1d(items, core, assume_unique=True)
                both = np.concatenate([more, less])
                rank = np.zeros(len(both), dtype=np.int64)
                if len(common):
                    order = np.argsort(common)
                    at = np.minimum(np.searchsorted(common, both, sorter=order), len(common) - 1)
                    rank = np.where(common[order[at]] == both, order[at] + 1, 0)
                n.append(len(items)), holes.append(len(less)), size.append(len(core))
                made.append(both[np.lexsort((both, rank))])
            counts = [pa.array(x, pa.int32()) for x in (n, holes, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts, pa.array(made, pa.list_(pa.int64()))], names=["g", "node", "part", "n", "holes", "core", "items"])

    made = dealt.mapInArrow(scan, "g binary, node binary, part int, n int, holes int, core int, items array<bigint>")
    v = F.col("holes") + similarity * (F.size("items") - F.col("holes")) - F.col("core") * (1 - similarity) / 2
    return materialise(made.withColumn("v", v), "differences")


def crowd_links(member: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` that connect all similar rows of one bucket of ``member(key, node, n)``.

    Buckets with the same most central row (that of the most bucket mates) are one group. Any set ``C`` can be a
    group's common set. With ``D`` the items in which a row differs from it, ``h`` of them items that it lacks and
    ``a`` others, and with ``v = h + s a - |C| (1 - s) / 2``, two rows have similarity ``s`` or more exactly if
    ``(1 + s) |D1 & D2| >= v1 + v2``. All rows are compared with the row of the smallest ``v``. Two rows that
    are not both similar to it must then share an item of ``D``, and so many that one is among the first
    items of both: keys of a prefix filter. Of two rows that of the smaller ``v`` is found by its index, the few first
    items that partners of no smaller ``v`` ask for; the other one probes with more, and of these only what some
    index of the group holds (a bit filter) is made a key. The first item that two rows share has all others
    behind it in both, so what is left of the rows there (``reach``) bounds what they share. Keys of many
    pairs are buckets of a next round."""
    found, sets = [], _sets(checkpoint(member.select("node").distinct()), docs, text_col, shingle)
    for depth in range(DEPTH):
        weight = member.groupBy("node").agg(F.sum("n").alias("w"))
        weighed = checkpoint(member.join(weight, "node"))
        hubs = weighed.groupBy("key").agg(F.max(F.struct("w", "node")).getField("node").alias("g"))
        rows = _differences(checkpoint(weighed.join(hubs, "key").select("g", "node", "w").distinct()), sets, similarity)
        best = rows.groupBy("g").agg(F.min(F.struct("v", "node", "n", "holes", "items")).alias("m"), F.max("part").alias("last"))
        best = best.select("g", "m", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
        same = lambda a, b: F.expr(f"core - {a}.holes - {b}.holes + size(array_intersect({a}.items, {b}.items))")
        row = F.struct("v", "node", "n", "holes", "items").alias("x")
        near = lambda a, b: F.col("c") / (F.col(f"{a}.n") + F.col(f"{b}.n") - F.col("c")) >= similarity
        edge = lambda a, b: (F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v"))
        met = rows.select("g", "part", "core", row).join(best, ["g", "part"]).withColumn("c", same("x", "m"))
        met = materialise(met.select("g", "core", "x", "m.v", F.col("m.node").alias("head"), near("x", "m").alias("settled")).withColumnRenamed("v", "least"), "met")
        found.append(met.where("settled and x.node <> head").select(F.least("x.node", "head").alias("u"), F.greatest("x.node", "head").alias("v")))
        unsettled = met.where("not settled").groupBy("g").agg(F.min("x.v").alias("open"))
        first = lambda bound: F.greatest(F.lit(0), F.size("x.items") + 1 - F.greatest(F.lit(1), F.ceil((F.col("x.v") + bound) / (1 + similarity) - SLACK))).cast("int")
        index = first(F.when(F.col("settled"), F.greatest("x.v", "open")).otherwise(F.col("x.v")))
        probe = first(F.when(F.col("settled"), F.col("open")).otherwise(F.col("least")))
        entries = F.transform("x.items", lambda e, at: F.struct(e.alias("e"), (F.size("x.items") - at).alias("reach")))
        wide = met.join(unsettled, "g").select("g", "x.node", "settled", "x.v", index.alias("index"), probe.alias("probe"), entries.alias("entries"))
        indexed = materialise(wide.select("g", "node", "settled", "v", F.inline(F.slice("entries", F.lit(1), F.col("index")))), "index")
        bits, words = build_filter(indexed.select(F.xxhash64("g", "e").alias("hash")), "hash", indexed.count(), probes=1)
        rest = F.slice("entries", F.col("index") + 1, F.col("probe") - F.col("index"))
        met_by = F.filter(rest, lambda x: maybe(F.xxhash64("g", x["e"]), F.col("bits"), words, probes=1))
        probing = wide.withColumn("bits", bits.scalar()).select("g", "node", "settled", "v", F.inline(met_by))
        keyed = materialise(indexed.withColumn("first", F.lit(True)).unionByName(probing.withColumn("first", F.lit(False))), "keyed")
        number = lambda settled, first: F.count_if((F.col("settled") == settled) & (F.col("first") == first))
        counts = keyed.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n"), number(True, True).alias("si"), number(True, False).alias("sp"), number(False, True).alias("oi"), number(False, False).alias("op"))
        pairs = F.col("oi") * (F.col("oi") - 1) / 2 + F.col("oi") * (F.col("si") + F.col("sp")) + (F.col("oi") + F.col("si")) * F.col("op")
        counts = counts.where(pairs > 0).select("g", "e", "n", (pairs > CROWD * F.col("n")).alias("crowded"))
        keyed = checkpoint(keyed.join(counts, ["g", "e"]))
        plain = keyed if depth + 1 == DEPTH else keyed.where("not crowded")
        end = lambda k: F.struct("v", "node", "settled", "reach").alias(k)
        met_at = lambda one, two: plain.where(one).select("g", "e", end("a")).join(plain.where(two).select("g", "e", end("b")), ["g", "e"])
        both = met_at("first", "not settled").unionByName(met_at("first and not settled", "settled"))
        enough = F.least("a.reach", "b.reach") >= (F.col("a.v") + F.col("b.v")) / (1 + similarity) - SLACK
        both = both.where("(a.v, a.node) < (b.v, b.node)").where(enough)
        asked = checkpoint(both.select("g", F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
        ends = {k: met.select("g", F.col("x.node").alias(k), F.col("x").alias(f"{k}x"), *(["core"] if k == "a" else [])) for k in "ab"}
        judged = asked.join(ends["a"], ["g", "a"]).join(ends["b"], ["g", "b"]).withColumn("c", same("ax", "bx"))
        found.append(checkpoint(judged.where(near("ax", "bx")).select(*edge("ax", "bx")).distinct()))
        if depth + 1 < DEPTH:
            member = checkpoint(keyed.where("crowded").select(F.xxhash64("g", "e").alias("key"), "node", "n").distinct())
            if member.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def links(nodes: DataFrame, docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges ``(u, v)`` that connect all similar ones of ``nodes(node, keys)`` with a key in common, the texts of ``docs``."""
    member = nodes.select(F.explode("keys").alias("key"), "node").distinct()
    sizes = checkpoint(member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    member = checkpoint(member.join(sizes, "key").select("key", "node", "n"))
    found = bucket_links(member.where(F.col("n") <= CROWD).select("key", "node"), docs, text_col, shingle, similarity)
    crowded = member.where(F.col("n") > CROWD)
    return found if crowded.isEmpty() else found.unionByName(crowd_links(crowded, docs, text_col, shingle, similarity))


def simhash_links(nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` between similar ones of ``nodes(node, fp)`` that the covering tables propose: texts
    of one fingerprint through the smallest of them, and fingerprints within ``radius`` bits."""
    least = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("u")))
    equal = nodes.join(least, "fp").where("u < node").select("u", F.col("node").alias("v"))
    ends = {end: least.select(F.col("fp").alias(f"fp_{end}"), F.col("u").alias(end)) for end in ("a", "b")}
    close = simhash.links(least.select("fp"), radius).select(F.col("u").alias("fp_a"), F.col("v").alias("fp_b"))
    close = close.join(ends["a"], "fp_a").join(ends["b"], "fp_b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    asked = checkpoint(equal.unionByName(close).distinct())
    return _judged(asked, docs, text_col, shingle, similarity).where("near").select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: ``id, component_id`` (the smallest id that links reach)."""
    rows = materialise(signatures(docs, id_col, text_col, shingle), "signatures")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first_id"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    close = simhash_links(nodes.select("node", "fp"), docs, text_col, shingle, similarity)
    linked = components(close.unionByName(links(nodes.select("node", "keys"), docs, text_col, shingle, similarity)))
    rooted = checkpoint(nodes.select("node", "first_id").join(linked, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpoint(rooted.join(heads, "root").select("node", "component_id"))
    return rows.select("id", "node").join(named, "node").select("id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns unchanged."""
    judged = near_copies(docs, id_col, text_col, shingle, similarity)
    gone = materialise(judged.where("id <> component_id").select(F.col("id").alias(id_col)).distinct(), "near")
    return drop_ids(docs, id_col, gone, gone.count())
