"""Removal of repeated phrases: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located.

A window is ``length`` consecutive words of one document. A word goes if a window over it also starts
earlier, in a document of a smaller id or further up in the same one.

1. Of equal texts the one of the smallest id goes on; the others are repeated as a whole if they have a window.
2. Every window has an anchor, its ``GRAM`` words of the smallest hash. Equal windows have equal anchors,
   and neighbouring windows mostly share one, so there is an anchor for every six or so windows. Anchors
   are counted with partial sums; those counted once are settled, as nothing can repeat their windows.
3. Passages around recurring anchors are sent to the shard of their anchor. A shard confirms which
   windows recur and which occurrence is the first, in words and not in hashes; compiles an automaton
   whose phrases are the words that neighbouring recurring windows share; and streams its passages
   through it. Around each occurrence of a phrase, the windows that recur and are not the first are repeated.
4. An anchor of more than ``HOT`` passages is dealt over several shards by document. Each of them finds
   what is repeated among its own passages and sends on one occurrence of each window, which shards by
   windows then compare in the same way. So no shard grows with the number of copies of a passage.

Hashes only propose: two windows with one anchor hash meet in one shard and are told apart by their words.
What goes has an equal earlier window that the shard has seen, so a proposal too many changes nothing.
All passages are streamed, and only those, since every occurrence of a recurring window has a recurring anchor.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, compared byte for byte.

Defined results: a null text counts as empty; texts of fewer words than a window keep all. Of rows that
repeat an id, that of the smaller digest of its text comes first; of equal rows one is first. Null ids come after
all others. Extra columns are not read and may have any name. A text is a value of a row, so texts go
up to Spark's 2 GB of a value; a word of any length is a word. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import once, small_batches
from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import materialise

LENGTH = 20
GRAM = 10
#: Passages that a shard expects, and the most of one anchor that go to one shard; windows of a second shard.
PASSAGES, HOT, WINDOWS = 8192, 4096, 50_000
#: Anchors that are dealt over several shards; above it only still more frequent ones are.
MOST_HOT = 1 << 20
#: Bits for each recurring anchor, and the most words of the filter of anchors (8 MB).
FILTER_BITS, FILTER_WORDS = 16, 1 << 20
#: Bytes of words that are hashed at a time.
HASHED = 1 << 20
ODD, FACTOR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return (x ^ (x >> np.uint64(29))) * FACTOR


class Words:
    """Words of a column of binary texts: their places in one buffer, and their hashes."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        places = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
        places -= places[0]
        edge = np.ones(len(self.data) + 1, bool)
        edge[:-1] = (self.data == 0x20) | ((self.data >= 0x09) & (self.data <= 0x0D))
        inside = ~edge[:-1]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[places] = True
        before = np.concatenate(([True], edge[:-2])) if len(self.data) else np.zeros(0, bool)
        self.starts = np.flatnonzero(inside & (before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (edge[1:] | cut[1:])) + 1
        self.doc = np.searchsorted(places, self.starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(column)))
        self.counts = np.diff(self.first, append=len(self.starts))

    def hashes(self) -> np.ndarray:
        powers = np.cumprod(np.full(4096, ODD, np.uint64))
        out = np.zeros(len(self.starts), np.uint64)
        sizes = self.ends - self.starts
        total = np.cumsum(sizes)
        low = 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + HASHED, "right")))
            n = sizes[low:high]
            begins = np.cumsum(n) - n
            within = np.arange(n.sum()) - np.repeat(begins, n)
            values = (self.data[np.repeat(self.starts[low:high], n) + within].astype(np.uint64) + np.uint64(1)) * powers[within & 4095]
            out[low:high] = np.add.reduceat(values, begins)
            low = high
        return _mixed(out + sizes.astype(np.uint64) * FACTOR)

    def passage(self, low: int, high: int) -> bytes:
        """Words ``low`` to ``high`` as they stand in the text."""
        return self.data[self.starts[low] : self.ends[high - 1]].tobytes()


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive hashes."""
    block, factor, width, out, done = hashes, FACTOR, 1, None, 0
    while True:
        if n & width:
            size = len(hashes) - done - width + 1
            if size <= 0:
                return np.zeros(0, np.uint64)
            out = block[:size] if out is None else out[:size] * factor + block[done : done + size]
            done += width
        if done == n:
            return _mixed(out)
        if len(block) <= width:
            return np.zeros(0, np.uint64)
        block = block[:-width] * factor + block[width:]
        factor, width = np.uint64(int(factor) ** 2 & (2**64 - 1)), 2 * width


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least of each ``n`` consecutive values."""
    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(values[y] < values[x], y, x)

    at, width = np.arange(len(values)), 1
    while 2 * width <= n:
        at, width = lower(at[:-width], at[width:]), 2 * width
    more = n - width
    return lower(at[: len(at) - more], at[more:]) if more else at


class Passages:
    """Stretches of windows that share an anchor: first and last window by place, document, hash of the anchor."""

    def __init__(self, words: Words, length: int, gram: int):
        hashes = words.hashes()
        grams = rolling(hashes, gram)
        n = len(hashes) - length + 1
        if n <= 0:
            self.low = self.high = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.int64)
            return
        at = _least(grams, length - gram + 1)
        whole = words.doc[:n] == words.doc[length - 1 :]
        places = np.flatnonzero(whole)
        fresh = np.ones(len(places), bool)
        fresh[1:] = (np.diff(places) > 1) | (np.diff(at[places]) != 0) | (np.diff(words.doc[places]) != 0)
        heads = np.flatnonzero(fresh)
        self.low = places[heads]
        self.high = places[np.append(heads[1:], len(places)) - 1] if len(heads) else places
        self.doc = words.doc[self.low]
        self.anchor = grams[at[self.low]].view(np.int64)


def repeated(runs: list[bytes], length: int) -> tuple[list[list[int]], Iterable[tuple[int, int]]]:
    """Of passages in document order: the windows of each that an earlier place has too, and the first places of all windows.

    Words become characters of a string, so a window is a string of ``length`` characters that is equal
    if the words are.
    """
    code: dict[bytes, int] = {}
    coded = ["".join([chr(code.setdefault(w, len(code))) for w in run.split()]) for run in runs]
    first: dict[str, tuple[int, int]] = {}
    again: set[str] = set()
    for k, run in enumerate(coded):
        for i in range(len(run) - length + 1):
            if first.setdefault(run[i : i + length], (k, i)) != (k, i):
                again.add(run[i : i + length])
    phrases = phrase_automaton(coded, sorted(first[w] for w in again), length)
    marks: list[list[int]] = []
    for k, run in enumerate(coded):
        found: set[int] = set()
        for end, size in phrases.iter(run) if len(phrases) else ():
            for i in range(max(0, end + 1 - length), min(end + 1 - size, len(run) - length) + 1):
                window = run[i : i + length]
                if window in again and first[window] != (k, i):
                    found.add(i)
        marks.append(sorted(found))
    return marks, first.values()


def phrase_automaton(coded: list[str], places: list[tuple[int, int]], length: int):
    """The automaton of the words that stretches of neighbouring windows share, ``GRAM`` words at least;
    its values are the phrases' lengths. Whatever holds one of the windows holds such a phrase."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    most = max(1, length - GRAM + 1)
    low = 0
    while low < len(places):
        high = low
        k, i = places[low]
        while high + 1 < len(places) and high + 1 - low < most and places[high + 1] == (k, i + high + 1 - low):
            high += 1
        phrase = coded[k][places[high][1] : i + length]
        made.add_word(phrase, len(phrase))
        low = high + 1
    if len(made):
        made.make_automaton()
    return made


def _rows_by_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
    return once(docs.select(F.col(f"`{id_col}`").alias("id"), text), key=F.unhex(F.sha2("text", 256)))


def _anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(anchor, n)`` of the anchors that more than one stretch of windows has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Passages(Words(batch.column(0)), length, gram).anchor)], names=["anchor"])

    found = texts.select("text").mapInArrow(scan, "anchor bigint")
    return found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class Recurring:
    """Which anchors may recur, and which are dealt over several shards."""

    def __init__(self, counts: DataFrame, hot: int):
        total = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        self.passages = total["n"]
        self.words = min(FILTER_WORDS, 1 + total["k"] * FILTER_BITS // 64)
        bits = self.words * 64
        halves = F.array(F.shiftrightunsigned("anchor", 32) % bits, F.col("anchor").bitwiseAND(0xFFFFFFFF) % bits)
        value = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int")))
        made = counts.select(F.explode(halves).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(value.alias("value")).toPandas()
        self.bits = np.zeros(self.words, np.int64)
        self.bits[made["word"].to_numpy(np.int64)] = made["value"].to_numpy(np.int64)
        least = max(hot, self.passages // MOST_HOT)
        held = counts.where(F.col("n") > least).toPandas().sort_values("anchor")
        self.hot, self.salts = held["anchor"].to_numpy(np.int64), -(-held["n"].to_numpy(np.int64) // least)

    def has(self, anchors: np.ndarray) -> np.ndarray:
        whole = anchors.view(np.uint64)
        found = np.ones(len(anchors), bool)
        for half in (whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF)):
            bit = (half % np.uint64(self.words * 64)).astype(np.int64)
            found &= (self.bits[bit >> 6] >> (bit & 63)) & 1 == 1
        return found

    def dealt(self, anchors: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that tell shards apart, and whether the anchor is hot; ``by`` deals hot ones."""
        at = np.minimum(np.searchsorted(self.hot, anchors), max(0, len(self.hot) - 1))
        hot = self.hot[at] == anchors if len(self.hot) else np.zeros(len(anchors), bool)
        salt = np.where(hot, by % np.maximum(1, self.salts[at] if len(self.hot) else 1), 0)
        return _mixed(anchors.view(np.uint64) + salt.astype(np.uint64) * ODD), hot


def _sent(texts: DataFrame, recurring: Recurring, shards: int, id_type: str, length: int, gram: int) -> DataFrame:
    """``shard, hot, id, key, start, passage``: passages that overlap in one shard are one."""
    shared = texts.sparkSession.sparkContext.broadcast(recurring)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words = Words(batch.column(2))
            all_ = Passages(words, length, gram)
            take = np.flatnonzero(known.has(all_.anchor))
            # Documents are dealt by bytes of their digests.
            digest = np.array([int.from_bytes(x[:4], "big") for x in batch.column(1).to_pylist()], np.int64)
            mixed, hot = known.dealt(all_.anchor[take], digest[all_.doc[take]])
            shard = (mixed % np.uint64(shards)).astype(np.int64) * 2 + hot
            order = np.lexsort((all_.low[take], shard, all_.doc[take]))
            take, shard = take[order], shard[order]
            low, high, doc = all_.low[take], all_.high[take] + length, all_.doc[take]
            fresh = np.ones(len(take), bool)
            fresh[1:] = (np.diff(shard) != 0) | (np.diff(doc) != 0) | (low[1:] > high[:-1])
            heads = np.flatnonzero(fresh)
            last = high[np.append(heads[1:], len(take)) - 1] if len(heads) else high
            low, doc, shard = low[heads], doc[heads], shard[heads]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard >> 1),
                    pa.array(shard & 1 == 1),
                    batch.column(0).take(pa.array(doc)),
                    batch.column(1).take(pa.array(doc)),
                    pa.array(low - words.first[doc]),
                    pa.array([words.passage(a, b) for a, b in zip(low.tolist(), last.tolist())], pa.binary()),
                ],
                names=["shard", "hot", "id", "key", "start", "passage"],
            )

    return texts.select("id", "key", "text").mapInArrow(scan, f"shard bigint, hot boolean, id {id_type}, key binary, start bigint, passage binary")


def _located(sent: DataFrame, id_type: str, length: int) -> DataFrame:
    """``key, starts, id, start, passage`` by shard: the repeated windows of a passage or, where the shard is hot, one
    occurrence of each window."""

    def locate(key: tuple, group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("id", "ascending"), ("key", "ascending"), ("start", "ascending")], null_placement="at_end")
        group = group.take(order)
        # A window can come from two shards: passages that overlap are sent as one.
        places = list(zip(group["key"].to_pylist(), group["start"].to_pylist()))
        group = group.take(pa.array([k for k in range(len(places)) if not k or places[k] != places[k - 1]], pa.int64())).combine_chunks()
        passages, starts = group["passage"].to_pylist(), group["start"].to_pylist()
        marks, first = repeated(passages, length)
        with_marks = [k for k, found in enumerate(marks) if found]
        out = {
            "key": group["key"].take(pa.array(with_marks, pa.int64())).to_pylist(),
            "starts": [[starts[k] + i for i in marks[k]] for k in with_marks],
        }
        n = len(with_marks)
        if key[1].as_py():
            first = sorted(first)
            split = {k: passages[k].split() for k in {k for k, _ in first}}
            places = pa.array([k for k, _ in first], pa.int64())
            ids = pa.concat_arrays([pa.nulls(n, group["id"].type), group["id"].take(places).combine_chunks()])
            more = [b" ".join(split[k][i : i + length]) for k, i in first]
            out = {"key": out["key"] + group["key"].take(places).to_pylist(), "starts": out["starts"] + [None] * len(first)}
        else:
            ids, more, first = pa.nulls(n, group["id"].type), [], []
        columns = [
            pa.array(out["key"], pa.binary()),
            pa.array(out["starts"], pa.list_(pa.int64())),
            ids,
            pa.array([None] * n + [starts[k] + i for k, i in first], pa.int64()),
            pa.array([None] * n + more, pa.binary()),
        ]
        return pa.table(columns, names=["key", "starts", "id", "start", "passage"])

    schema = f"key binary, starts array<bigint>, id {id_type}, start bigint, passage binary"
    return sent.groupBy("shard", "hot").applyInArrow(locate, schema)


def _removed(texts: DataFrame, id_type: str, length: int, gram: int, passages: int, hot: int) -> DataFrame:
    """``key, starts``: the repeated windows of the texts that have any."""
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recurring = Recurring(materialise(_anchors(texts, length, gram), "anchors"), hot)
    sent = _sent(texts, recurring, max(partitions, 1 + recurring.passages // passages), id_type, length, gram)
    located = _located(sent, id_type, length)
    if len(recurring.hot):
        located = materialise(located, "located")
        windows = located.where("passage is not null")
        shards = max(partitions, 1 + windows.count() // WINDOWS)
        by_window = windows.select(F.pmod(F.xxhash64("passage"), F.lit(shards)).alias("shard"), F.lit(False).alias("hot"), "id", "key", "start", "passage")
        located = located.where("starts is not null").select("key", "starts").unionByName(_located(by_window, id_type, length).select("key", "starts"))
    return located.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _kept(texts: DataFrame, id_type: str, length: int) -> DataFrame:
    """``id, n_words, starts, ends, kept`` of ``(id, text, windows)``: what the windows cover goes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, ends, kept = [], [], [], []
            for text, windows in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                if windows.is_valid:
                    places = windows.values.to_numpy()
                    np.add.at(change, places, 1)
                    np.add.at(change, places + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                counts.append(len(words))
                starts.append(edges[::2])
                ends.append(edges[1::2])
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if len(edges) else words))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *lists, pa.array(kept, pa.binary())], names=["id", "n_words", "starts", "ends", "kept"])

    made = texts.select("id", "text", "windows").mapInArrow(scan, f"id {id_type}, n_words bigint, starts array<bigint>, ends array<bigint>, kept binary")
    return made.withColumn("kept", F.col("kept").cast("string"))


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passages: int = PASSAGES, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, starts, ends, kept``: spans of removed words, as arrays of
    their first words and of the words after their last, and the words that stay, joined by a space."""
    if not 0 < gram <= length:
        raise ValueError("an anchor has at most the words of a window")
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows_by_digest(docs, id_col, text_col)
    groups = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-texts")
    n_groups = groups.count()
    texts, copies = rows, None
    if n_groups:
        bits, words = build_filter(groups, "key", n_groups)
        test = maybe(F.col("key"), bits, words)
        # Summed up before the shuffle, so a hot text travels once from each task.
        order = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least")
        hits = materialise(rows.where(test).groupBy("key").agg(F.first("text").alias("text"), order).select("least.id", "text", "key"), "first-texts")
        texts = rows.where(~test).unionByName(hits)
        copies = _copies(rows.where(test).groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")), hits, id_type, length)
    removed = materialise(_removed(texts, id_type, length, gram, passages, hot), "repeated-windows")
    n_removed = removed.count()
    none = F.lit(None).cast("array<bigint>").alias("windows")
    found = texts.select("id", "text", none)
    if n_removed:
        bits, words = build_filter(removed, "key", n_removed)
        test = maybe(F.col("key"), bits, words)
        joined = texts.where(test).join(removed, "key", "left").select("id", "text", F.col("starts").alias("windows"))
        found = texts.where(~test).select("id", "text", none).unionByName(joined)
    made = _kept(found, id_type, length)
    return made if copies is None else made.unionByName(copies)


def _copies(counted: DataFrame, hits: DataFrame, id_type: str, length: int) -> DataFrame:
    """The rows of equal texts but for the first of each: a text with a window goes whole, another stays."""
    whole = _kept(hits.select(F.struct("key", "id").alias("id"), "text", F.lit(None).cast("array<bigint>").alias("windows")), f"struct<key: binary, id: {id_type}>", length)
    none, all_ = F.array().cast("array<bigint>"), F.col("n_words") >= length
    spans = [F.when(all_, F.array(x)).otherwise(none).alias(name) for x, name in ((F.lit(0).cast("bigint"), "starts"), (F.col("n_words"), "ends"))]
    first = whole.select(F.col("id.key").alias("key"), F.col("id.id").alias("first_id"), "n_words", *spans, F.when(all_, "").otherwise(F.col("kept")).alias("kept"))
    # The text that goes on stands for one of its rows.
    left = F.col("n") - F.when(F.col("id").eqNullSafe(F.col("first_id")), 1).otherwise(0)
    rows = counted.join(first, "key").withColumn("left", left).where("left > 0")
    return rows.select("id", "n_words", "starts", "ends", "kept", F.explode(F.sequence(F.lit(1).cast("bigint"), "left"))).drop("col")
