"""URL rules judged through Bloom filter cascades.

Rules name a host, with all its subdomains, and a path prefix. Every way in which a rule could fit a
URL is a key: a suffix of the host's labels joined to a prefix of the path. Only label counts and
path lengths that some rule has are tried, so a URL has few keys. The corpus's distinct keys are the
cascade's complete universe.

A cascade holds the rules of one verdict. Level 1 encodes the listed keys; level 2 the keys of the
universe that level 1 wrongly passes; level 3 the listed keys that level 2 passes; and so on until a
level passes no wrong key. A key is listed if the first level that does not pass it has an even
number, or, when all pass it, if the number of levels is odd. Over the universe that answer is
exact, and judging takes no join: the filters are broadcast.

Levels are built with grouped ``bit_or`` aggregates; the driver sees filters and counts only. Level 1
is sized from the numbers of listed keys and of keys in the universe, later levels pass half of the
wrong keys. A task must hold the filters it asks. If they would exceed ``max_bytes``, which takes
some 50 million listed keys that the corpus has, keys meet the rules in a shuffled equi-join
instead, with the same results.

Defined results: a null URL, or one without ``://``, has empty host and path; the empty host has one
key for each path length, which only a rule of empty host could list. Of fitting rules the longest
string wins, then the longer host. URLs may have any length and number of labels. Without a fitting rule the verdict is ``allow``. Repeated rules count
once; a rule listed under both verdicts is an error. Repeated rows are judged alike. An empty table gives an
empty result. Extra columns are
carried in ``page`` and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.text import UPPER
from gridweave.plans.staging import materialise

#: Pairs of label count and path length of rules up to which each has its own expression.
UNROLLED_KINDS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``rules(rule, verdict)`` with host (up to the first ``/``), path, labels and path length."""
    host = F.translate(F.substring_index("rule", "/", 1), UPPER, UPPER.lower())
    path = F.when(F.instr("rule", "/") > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    return (
        rules.where("rule is not null and verdict is not null")
        .select(host.alias("host"), path.alias("path"), "verdict")
        .distinct()
        .select(
            F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("reach")
        )
    )


def candidate_keys(host: Column, path: Column, kinds: list[tuple[int, int]]) -> Column:
    """Keys of one URL, for the ``(labels, path length)`` kinds of the rules; longest first."""
    labels = F.size(F.split(host, r"\."))
    if len(kinds) > UNROLLED_KINDS:
        parts = F.split(host, r"\.")
        table = F.arrays_zip(F.lit([n for n, _ in kinds]).alias("n"), F.lit([reach for _, reach in kinds]).alias("reach"))
        fits = F.filter(table, lambda k: (labels >= k["n"]) & (F.length(path) >= k["reach"]))

        def named(k: Column) -> Column:
            key = F.concat(F.array_join(F.slice(parts, -k["n"], k["n"]), "."), F.substring(path, F.lit(1), k["reach"]))
            return F.struct(F.length(key).alias("size"), k["n"].alias("labels"), key.alias("key"))

        return F.sort_array(F.transform(fits, named), asc=False)["key"]
    options = []
    for n, reach in kinds:
        key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, reach))
        options.append(F.when((labels >= n) & (F.length(path) >= reach), F.struct(F.length(key).alias("size"), F.lit(n).alias("labels"), key.alias("key"))))
    if not options:
        return F.array().cast("array<string>")
    return F.sort_array(F.array_compact(F.array(*options)), asc=False)["key"]


@dataclass
class Level:
    bits: int
    probes: int
    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Of unsigned 64-bit hashes: whether every probe's bit is set."""
        ok = np.ones(len(hashes), dtype=bool)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            bit = (hashes + np.uint64(k) * step) % np.uint64(self.bits)
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return ok


@dataclass
class Cascade:
    verdict: str
    levels: list[Level] = field(default_factory=list)

    def lists(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Membership of keys, given each key's hash for every level."""
        n = len(hashes[0]) if hashes else 0
        open_, listed = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
        for k, level in enumerate(self.levels):
            passed = level.passes(hashes[k])
            listed |= open_ & ~passed & (k % 2 == 1)
            open_ &= passed
        return listed | (open_ & (len(self.levels) % 2 == 1))

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def level_hash(key: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), key)


def build_level(keys: DataFrame, level: int, n_keys: int, rate: float) -> Level:
    """A filter of the column ``key``; its size follows from ``n_keys``, which is distinct keys."""
    bits = max(64, math.ceil(-n_keys * math.log(rate) / math.log(2) ** 2))
    probes = max(1, round(bits / max(1, n_keys) * math.log(2)))
    probes = min(probes, 20)
    unsigned = level_hash(F.col("key"), level).cast("decimal(20,0)")
    two64 = F.lit(str(1 << 64)).cast("decimal(21,0)")
    hash_ = F.when(unsigned < 0, unsigned + two64).otherwise(unsigned).cast("decimal(21,0)")
    step = F.shiftrightunsigned(level_hash(F.col("key"), level), 32).bitwiseOR(F.lit(1).cast("long")).cast("decimal(20,0)")
    positions = F.array(*[(((hash_ + step * k) % two64) % F.lit(bits)).cast("bigint") for k in range(probes)])
    words = (
        keys.select(F.explode(positions).alias("bit"))
        .groupBy((F.col("bit") / 64).cast("bigint").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("value"))
    )
    out = np.zeros(-(-bits // 64), dtype=np.int64)
    found = words.toArrow()  # at most as many rows as the filter has words
    out[found["word"].to_numpy()] = found["value"].to_numpy()
    return Level(bits, probes, out.view(np.uint64))


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """``keys(key)`` that pass one level."""
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(cascade.levels[level])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = shared.value.passes(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select([0]).filter(pa.array(ok))

    return keys.select("key", level_hash(F.col("key"), level).alias("h")).mapInArrow(scan, "key string")


def build_cascade(universe: DataFrame, n_universe: int, listed: DataFrame, verdict: str, max_bytes: int) -> Cascade | None:
    """The cascade of ``listed(key)`` over ``universe(key)``, or None if it would exceed ``max_bytes``.

    ``universe`` may repeat keys; what a level wrongly passes is made distinct before it is counted.
    """
    cascade = Cascade(verdict)
    # Listed keys that no URL has need no place; those of the universe do.
    inside = materialise(universe.join(listed, "key", "left_semi").distinct(), "listed")
    outside, n_in = universe, inside.count()
    if n_in == 0:
        return cascade
    n_out = max(1, n_universe - n_in)
    rate = min(0.5, n_in * math.sqrt(0.5) / n_out)
    here, n_here, there, there_listed = inside, n_in, outside, False
    while n_here:
        level = len(cascade.levels)
        expected = -n_here * math.log(rate) / math.log(2) ** 2 / 8
        if cascade.nbytes + expected > max_bytes:
            return None
        cascade.levels.append(build_level(here, level, n_here, rate))
        passed = _passing(there, cascade, level).distinct()
        if level == 0:
            passed = passed.join(inside, "key", "left_anti")
        passed = materialise(passed, "passed")
        here, there, n_here, rate = passed, here, passed.count(), 0.5
    return cascade


def judge(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_bytes: int = 64 << 20
) -> DataFrame:
    """Two structs for each row: ``page``, the row itself, and ``judged(host, path, rule, verdict)``."""
    spark = pages.sparkSession
    listed = materialise(parse_rules(rules), "rules")
    # At most the labels of a host times the lengths of a path, however many rules there are.
    kinds = sorted((r["labels"], r["reach"]) for r in listed.select("labels", "reach").distinct().collect())
    if not listed.groupBy("rule").agg(F.count_distinct("verdict").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a rule is listed under two verdicts")
    # Copies of a verdict's name are few: block and allow, or as many as the caller uses.
    verdicts = sorted(r["verdict"] for r in listed.select("verdict").distinct().collect())
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"), candidate_keys(host, path, kinds).alias("keys"))
    universe = materialise(rows.select(F.explode("keys").alias("key")).distinct(), "universe")
    n_universe = universe.count()
    cascades = []
    for verdict in verdicts:
        made = build_cascade(universe, n_universe, listed.where(F.col("verdict") == verdict).select(F.col("rule").alias("key")), verdict, max_bytes)
        if made is None:
            return _judge_by_join(rows, listed, default)
        cascades.append(made)
    shared = spark.sparkContext.broadcast(cascades)
    depth = max([len(c.levels) for c in cascades], default=0)
    hashes = F.transform("keys", lambda key: F.array(*[level_hash(key, k) for k in range(depth)])) if depth else F.array()

    @F.pandas_udf("struct<pick:int,verdict:string>")
    def first_listed(column):
        import pandas as pd

        sizes = np.array([len(x) for x in column], dtype=np.int64)
        pick, verdict = np.full(len(column), -1), np.full(len(column), default, dtype=object)
        if depth and sizes.sum():
            flat = np.array([h for row in column for h in row], dtype=np.int64).view(np.uint64).reshape(-1, depth)
            owner = np.repeat(np.arange(len(column)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            best = np.full(len(column), np.iinfo(np.int64).max)
            for cascade in shared.value:
                hit = cascade.lists([flat[:, k] for k in range(len(cascade.levels))]) if cascade.levels else np.zeros(len(flat), dtype=bool)
                first = np.full(len(column), np.iinfo(np.int64).max)
                np.minimum.at(first, owner[hit], place[hit])
                better = first < best
                verdict[better], best = cascade.verdict, np.minimum(best, first)
            pick = np.where(best < np.iinfo(np.int64).max, best, -1)
        return pd.DataFrame({"pick": pick.astype(np.int32), "verdict": verdict})

    judged = rows.withColumn("got", first_listed(hashes))
    rule = F.when(F.col("got.pick") >= 0, F.get("keys", F.col("got.pick")))
    return judged.select("page", F.struct("host", "path", rule.alias("rule"), F.col("got.verdict").alias("verdict")).alias("judged"))


def _judge_by_join(rows: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule lists whose filters are too large to broadcast."""
    places = rows.select("host", "path", "keys").distinct()
    fitting = places.select("host", "path", F.posexplode("keys").alias("at", "rule")).join(listed.select("rule", "verdict"), "rule")
    best = fitting.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "at").alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page",
        F.struct("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias("judged"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule)`` pairs as a table."""
    return spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "rule string, verdict string")


def keep_allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` that no block rule decides; columns unchanged."""
    return judge(pages, rules, url_col).where("judged.verdict <> 'block'").select("page.*")
