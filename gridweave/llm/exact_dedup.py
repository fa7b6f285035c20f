"""Exact de-duplication with a log-structured merge index, in DataFrame operations only.

Rows come in batches. A batch is a memtable: it is reduced to one entry for each digest, with the
smallest and the largest identifier and the number of rows, sorted by digest and flushed as a run
with a filter of its digests; the Parquet files of a run carry min/max statistics. When ``fanout`` runs have gathered, compaction merges them: an entry that no other run's filter
passes is new and moves on as it is, the others meet by digest. The largest and the smallest
identifier of a group are those of its compacted entry.

Digests that occur again are hits. The whole texts of hits are compared byte for byte before any of
them counts as a copy; where different texts share a digest, only equal texts do.

Defined results: a null text counts as empty. A null id never wins over another id; in a group of
null ids only, the null id is the one that stays. Rows that repeat an id and a text are counted in
``group_size`` and share their fate; :func:`exact_dedup` keeps one of them. An empty input gives an
empty result. Texts are hashed and compared as values, so they go up to Spark's 2 GB of a value. Extra columns are
carried along and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.text import ascii_lower, once
from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import checkpoint, materialise, new_path

ENTRY = "digest string, smallest {id_type}, largest {id_type}, n bigint"
#: Batches that the rows of one call are dealt into: at least so many, and more if a batch would have
#: more rows than a memtable takes.
BATCHES = 4
MEMTABLE_ROWS = 500_000_000
#: Groups of at most so many rows of some 120 bytes are broadcast; more of them are shuffled.
BROADCAST_GROUPS = 20_000


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass
class Run:
    """A flushed run: unique digests, sorted, and a filter of them."""

    rows: DataFrame
    n: int
    bits: DataFrame
    words: int

    def maybe(self) -> Column:
        """Whether the run may hold the row's ``digest``."""
        return maybe(F.col("digest"), self.bits, self.words) if self.n else F.lit(False)


class DigestIndex:
    """Sorted digest runs in the shared folder; the driver holds their paths only."""

    def __init__(self, spark: SparkSession, id_type: str = "bigint", fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.schema = ENTRY.format(id_type=id_type)
        self.runs: list[Run] = []

    def _write(self, entries: DataFrame, label: str) -> Run:
        path = new_path(self.spark, label)
        entries.sortWithinPartitions("digest").write.parquet(path)
        rows = self.spark.read.schema(self.schema).parquet(path)
        n = rows.count()
        bits, words = build_filter(rows, "digest", n)
        return Run(rows, n, materialise(bits, f"{label}-filter"), words)

    def append(self, batch: DataFrame) -> None:
        """Flush ``batch(digest, id)`` as a run; compact when there are ``fanout`` runs."""
        entries = batch.groupBy("digest").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
        self.runs.append(self._write(entries, "run"))
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> Run:
        """Merge all runs into one that has an entry for each digest."""
        if len(self.runs) != 1:
            alone = shared = None
            for run in self.runs:
                known = F.lit(False)
                for other in self.runs:
                    if other is not run:
                        known = known | other.maybe()
                fresh, met = run.rows.where(~known), run.rows.where(known)
                alone = fresh if alone is None else alone.unionByName(fresh)
                shared = met if shared is None else shared.unionByName(met)
            if alone is None:
                merged = self.spark.createDataFrame([], self.schema)
            else:
                merged = alone.unionByName(
                    shared.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
                )
            self.runs = [self._write(merged, "merged")]
        return self.runs[0]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Entries of ``digests(digest)`` that runs hold already, one for each run that has it; each
        run's filter decides which digests are looked up in it."""
        found = self.spark.createDataFrame([], self.schema)
        for run in self.runs:
            found = found.unionByName(run.rows.join(digests.where(run.maybe()), "digest", "left_semi"))
        return found

    def hits(self) -> DataFrame:
        """Entries of digests that more than one row has."""
        return self.compact().rows.where("n > 1")


class _Decided:
    """What one pass over ``docs`` has settled."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: str, digest):
        if keep not in ("largest", "smallest"):
            raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
        spark = docs.sparkSession
        self.docs, self.id, self.digest, self.keep = docs, F.col(f"`{id_col}`"), digest, keep
        self.text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
        self.rows = materialise(docs.select(digest(self.text).alias("digest"), self.id.alias("id")), "digests")
        n_batches = max(BATCHES, -(-self.rows.count() // MEMTABLE_ROWS))
        index = DigestIndex(spark, docs.schema[id_col].dataType.simpleString())
        for k in range(n_batches):
            index.append(self.rows.where(F.pmod(F.xxhash64("id"), F.lit(n_batches)) == k))
        self.entries = index.compact().rows
        self.hits = materialise(index.hits().select("digest", F.col(keep).alias("keep_id"), F.col("n").alias("group_size")), "hits")
        self.n_hits = self.hits.count()
        self.hit_bits, self.hit_words = build_filter(self.hits, "digest", self.n_hits)
        # Byte verification: the texts of hits, whole. Equal ones collapse before the shuffle.
        texts = self._classes().groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        self.clashes = checkpoint(texts.where("texts > 1").select("digest").join(self.hits, "digest", "left_semi"))
        self.any_clash = not self.clashes.isEmpty()

    def hot(self) -> Column:
        """Whether a row's ``digest`` may be a hit."""
        return maybe(F.col("digest"), self.hit_bits, self.hit_words) if self.n_hits else F.lit(False)

    def texts(self) -> DataFrame:
        """``(id, digest, text)`` of the rows that may be hits; the text is normalised."""
        rows = once(self.docs.select(self.id.alias("id"), self.text.alias("text")), digest=self.digest(F.col("text")))
        return rows.where(self.hot())

    def _classes(self) -> DataFrame:
        best = F.max if self.keep == "largest" else F.min
        return self.texts().groupBy("digest", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def groups(self) -> DataFrame:
        """``(digest, keep_id, group_size)`` of verified groups, from the compacted entries."""
        found = self.hits.join(self.clashes, "digest", "left_anti") if self.any_clash else self.hits
        return F.broadcast(found) if self.n_hits <= BROADCAST_GROUPS else found

    def split(self) -> DataFrame:
        """``(digest, text, keep_id, group_size)`` of the texts whose digests clash."""
        return self._classes().join(self.clashes, "digest", "left_semi")


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest``.

    ``digest`` maps the normalised text to a string column; a weak one costs time, never
    correctness, since texts of equal digest are compared whole.
    """
    made = _Decided(docs, id_col, text_col, keep, digest)
    alone = [F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")]
    columns = ["id", "digest", "keep_id", "group_size"]
    out = made.rows.where(~made.hot()).select("id", "digest", *alone)
    likely = made.rows.where(made.hot()).join(made.groups(), "digest", "left")
    if made.any_clash:  # digests of different texts met: only the texts tell them apart
        likely = likely.join(made.clashes, "digest", "left_anti")
        out = out.unionByName(made.texts().join(made.clashes, "digest", "left_semi").join(made.split(), ["digest", "text"]).select(columns))
    single = F.col("group_size").isNull()
    likely = likely.select("id", "digest", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"))
    return out.unionByName(likely).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest=sha256) -> DataFrame:
    """``docs`` without the copies, one row for each distinct text; columns and types unchanged.

    Which id of a digest stays is known from the index, so copies go where they are read: only rows
    that are kept of a group, and those whose digests a filter takes for a hit, are shuffled.
    """
    made = _Decided(docs, id_col, text_col, keep, digest)
    if not made.n_hits:
        return docs
    rows = once(docs.select(F.struct("*").alias("doc"), made.id.alias("id"), made.text.alias("text")), digest=digest(F.col("text")))
    stay = rows.where(~made.hot()).select("doc.*")
    # Digests of one row that the filter takes for hits stay with the id of their entry.
    single = made.entries.where("n = 1").where(made.hot()).select("digest", F.col("smallest").alias("keep_id"))
    key = F.xxhash64("digest", "keep_id").alias("key")
    kept = materialise(made.groups().select("digest", "keep_id", key).unionByName(single.select("digest", "keep_id", key)), "kept")
    bits, words = build_filter(kept, "key", kept.count())
    likely = rows.where(made.hot() & maybe(F.xxhash64("digest", "id"), bits, words)).alias("r")
    same = (F.col("r.digest") == F.col("k.digest")) & F.col("r.id").eqNullSafe(F.col("k.keep_id"))
    found = likely.join(kept.alias("k"), same, "left_semi").dropDuplicates(["digest", "id"]).select("doc.*")
    stay = stay.unionByName(found)
    if made.any_clash:
        clashing = rows.where(made.hot()).join(made.clashes, "digest", "left_semi").join(made.split(), ["digest", "text"])
        stay = stay.unionByName(clashing.where(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest", "text"]).select("doc.*"))
    return stay
