"""Removal of repeated byte strings: blockwise suffix buckets over difference-cover samples, byte-exact.

A byte goes if some string of ``length`` bytes over it also starts anywhere else. Only the first
``length`` bytes of a suffix decide. All that one task holds is a block of texts or a bucket of keys.

1. Texts that equal another are told apart by their digest; one of each group goes on. A copy of at
   least ``length`` bytes is repeated as a whole, a shorter one not at all.
2. Texts are packed into blocks of about ``BLOCK_BYTES``, written once and bucketed by block number,
   so that later rounds meet their answers without another shuffle of the texts. A longer text is
   split into blocks that overlap by ``length - 1`` bytes, so every suffix starts in one block.
3. Cover samples: suffixes at offsets whose residue modulo ``v`` is in a difference cover of ``v``.
   For any two suffixes some shift below ``v`` leads both to samples, and if they share ``length``
   bytes, those samples share ``length - v + 1``. Sample keys are sorted in their buckets, which
   answer the ones that more than one place has. Suffixes that no tied sample follows within ``v``
   bytes are settled: nothing can tie with them.
4. Keys of the other suffixes are sorted in their buckets, each with the byte before and the byte
   after its string. A bucket answers which keys tie, and which tied keys are edges: those whose
   holders differ in a neighbouring byte, or stand at an end of their text.
5. The strings of edges, and one string every ``length`` bytes between two edges, are sent whole;
   a bucket sorts them by their bytes, and neighbours that share all ``length`` bytes are repeated.

Keys only save work: what goes is what step 5 has compared byte for byte, and nothing is missed if
keys of different strings are equal. Equal strings have equal keys, so a repeated string that is no
edge has a neighbour on either side that is repeated too, up to the next edges, which all holders
have at the same distance: they send the same strings, and those cover all bytes between. Clashes
make more edges and so more strings, never another result.

Ranks of cover samples decide here which suffixes can tie, not how ties are ordered: a string ends after
``length`` bytes, so a tie goes on from the sample at shift ``s`` for just ``length - s`` bytes, which a
rank of one depth cannot say. Strings are bounded, so their bytes are sorted instead.

Defined results: a null text counts as empty. Texts shorter than ``length`` keep all bytes. Matches
never cross texts. Rows that repeat an id are judged row by row; equal rows are copies. Removing
bytes can leave text that is no UTF-8, so what stays is binary. Extra columns are not read and may
have any name. A row holds a text and what stays of it, so texts go up to Spark's 2 GB of a value.
Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import once, small_batches
from gridweave.operators.membership import build_filter, maybe
from gridweave.plans.staging import materialise, new_table

LENGTH = 200
BLOCK_BYTES = 1 << 20
#: Bytes of texts whose blocks make one bucket of the table of blocks, so one task.
TABLE_BUCKET_BYTES = 32 << 20
#: Expected samples, and most suffixes and strings, of a bucket.
SAMPLES, SUFFIXES, STRINGS = 1 << 20, 1 << 21, 1 << 20
#: Bits of a sample's key and of a suffix's key; two bytes of a suffix's word are its neighbours.
SAMPLE_BITS, SUFFIX_BITS = 40, 48
SENT = "bucket bigint, block bigint, keys binary, flags binary"
ANSWERS = "block bigint, bucket bigint, mask binary, more binary"
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_WORDS = np.random.default_rng(200).integers(0, 1 << 64, size=256, dtype=np.uint64)


@lru_cache(maxsize=8)
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """``v = q*q + q + 1`` and a perfect difference cover of it, for a prime ``q``: the exponents at
    which powers of ``x`` in GF(q^3) have no square term."""
    v = q * q + q + 1
    for coefficients in np.ndindex(q, q, q):
        a, b, c = coefficients
        if c == 0:
            continue
        power, cover = [1, 0, 0], []
        for k in range(v):  # x^3 = a x^2 + b x + c
            if power[2] == 0:
                cover.append(k)
            power = [c * power[2] % q, (power[0] + b * power[2]) % q, (power[1] + a * power[2]) % q]
        if len(cover) == q + 1 and len({(i - j) % v for i in cover for j in cover}) == v:
            return v, tuple(cover)
    raise ValueError(f"{q} is not a prime")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose samples keep at least a third of ``length``; all residues if none."""
    primes = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31) if 3 * (q * q + q + 1) <= 2 * length]
    return difference_cover(primes[-1]) if primes else (1, (0,))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2^64, and of its inverse."""
    out = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        powers = np.full(n, np.uint64(base))
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


class Block:
    """Texts of one block, end to end, with each place's distance from its text's start and end."""

    def __init__(self, payload: bytes, sizes: list[int]):
        import zstandard

        self.data = np.frombuffer(zstandard.decompress(payload, max_output_size=max(1, sum(sizes))), dtype=np.uint8)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def measure(self) -> None:
        n = len(self.data)
        self.offset = np.arange(n, dtype=np.int32)
        self.offset -= np.repeat(self.starts.astype(np.int32), self.sizes)
        self.left = np.repeat(self.sizes.astype(np.int32), self.sizes)
        self.left -= self.offset
        powers, self.inverse = _powers(((n >> 18) + 1) << 18)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        BYTE_WORDS.take(self.data, out=self.sums[1:])
        self.sums[1:] *= powers[:n]
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def names(self, places: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit name of the ``length`` bytes from each place."""
        h = (self.sums[places + length] - self.sums[places]) * self.inverse[places]
        h ^= h >> np.uint64(31)
        h *= MIX
        h ^= h >> np.uint64(29)
        return h


def bucket_of(names: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((names >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(bucket, from, to)`` of an ascending array."""
    if len(bucket):
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip(np.append(0, edges), np.append(edges, len(bucket))):
            yield int(bucket[a]), int(a), int(b)


def _flags(bucket: np.ndarray, answers: list[dict] | None, column: str = "mask") -> np.ndarray:
    """The bits that buckets answered for ascending ``bucket``."""
    out = np.zeros(len(bucket), dtype=bool)
    masks = {x["bucket"]: x[column] for x in answers or []}
    for b, start, end in _slices(bucket):
        if b in masks:
            out[start:end] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=end - start).astype(bool)
    return out


class Keyed:
    """Places of a block with their keys; distinct keys, sorted by bucket and key."""

    def __init__(self, block: Block, places: np.ndarray, length: int, n_buckets: int, bits: int):
        self.places = places
        names = block.names(places, length)
        bucket, key = bucket_of(names, n_buckets), names & np.uint64((1 << bits) - 1)
        if n_buckets <= 1 << (64 - bits):
            self.order = np.argsort((bucket.astype(np.uint64) << np.uint64(bits)) | key)
        else:
            self.order = np.lexsort((key, bucket))
        key, bucket = key[self.order], bucket[self.order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        self.first = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        self.rank = np.empty(len(key), dtype=np.int64)
        self.rank[self.order] = rank
        self.keys, self.bucket = key[new], bucket[new]
        self.several = np.diff(np.append(self.first, len(key))) > 1


class Job:
    """Parameters of a run, and what each round does to a block."""

    def __init__(self, length: int, n_samples: int, n_suffixes: int, n_strings: int, sample_bits: int, suffix_bits: int):
        self.length, self.n_samples, self.n_suffixes, self.n_strings = length, n_samples, n_suffixes, n_strings
        self.sample_bits, self.suffix_bits = sample_bits, suffix_bits
        self.v, self.cover = cover_for(length)
        self.sampled = np.zeros(self.v, dtype=bool)
        self.sampled[list(self.cover)] = True

    def _samples(self, block: Block) -> Keyed:
        block.measure()
        depth = self.length - self.v + 1
        places = np.flatnonzero(self.sampled[block.offset % self.v] & (block.left >= depth))
        return Keyed(block, places, depth, self.n_samples, self.sample_bits)

    def samples(self, block: Block, number: int) -> Iterator[tuple]:
        """Round 1: ``(bucket, keys, flags)`` of distinct sample keys."""
        found = self._samples(block)
        low = np.ascontiguousarray(found.keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : SAMPLE_BITS // 8]
        for bucket, a, b in _slices(found.bucket):
            yield bucket, low[a:b].tobytes(), b""

    def _suffixes(self, block: Block, answers: list[dict] | None) -> tuple[Keyed, np.ndarray, np.ndarray]:
        """Suffixes that a tied sample follows within ``v`` bytes; of each distinct key a word of the
        key and the neighbouring bytes, and whether its places here make it an edge."""
        samples = self._samples(block)
        hit = samples.places[(samples.several | _flags(samples.bucket, answers))[samples.rank]]
        change = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.add.at(change, hit - np.minimum(self.v - 1, block.offset[hit]), 1)
        np.add.at(change, hit + 1, -1)
        places = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (block.left >= self.length))
        found = Keyed(block, places, self.length, self.n_suffixes, self.suffix_bits)
        if not len(places):
            return found, found.keys, np.zeros(0, dtype=bool)
        at = places[found.order]
        data = np.append(block.data, np.uint8(0))
        around = (data[at - 1].astype(np.uint64) << np.uint64(8)) | data[at + self.length]
        ends = (block.offset[at] == 0) | (block.left[at] == self.length)
        least = np.minimum.reduceat(around, found.first)
        edge = (least != np.maximum.reduceat(around, found.first)) | np.logical_or.reduceat(ends, found.first)
        return found, (found.keys << np.uint64(16)) | least, edge

    def suffixes(self, block: Block, number: int, sample_answers: list[dict] | None) -> Iterator[tuple]:
        """Round 2: ``(bucket, words, edges)`` of distinct suffix keys."""
        found, words, edge = self._suffixes(block, sample_answers)
        for bucket, a, b in _slices(found.bucket):
            yield bucket, words[a:b].astype("<u8").tobytes(), np.packbits(edge[a:b]).tobytes()

    def strings(self, block: Block, number: int, sample_answers: list[dict] | None, suffix_answers: list[dict] | None) -> Iterator[tuple]:
        """Round 3: ``(bucket, strings, b"")`` of distinct strings, and one row, with a bucket of its
        own, that says which places they stand for."""
        import zstandard

        found, _, edge = self._suffixes(block, sample_answers)
        tied = (found.several | _flags(found.bucket, suffix_answers))[found.rank]
        edge = (edge | _flags(found.bucket, suffix_answers, "more"))[found.rank] & tied
        where = np.where(edge, np.arange(len(edge)), len(edge))
        following = np.minimum.accumulate(where[::-1])[::-1]
        known = following < len(edge)
        far = np.zeros(len(edge), dtype=np.int64)
        far[known] = found.places[following[known]] - found.places[known]
        picked = found.places[tied & (edge | (known & (far % self.length == 0)))]
        bucket = bucket_of(block.names(picked, self.length), self.n_strings)
        text = np.zeros((0, self.length), np.uint8)
        if len(picked):
            text = np.lib.stride_tricks.sliding_window_view(block.data, self.length)[picked]
        order = np.argsort(text.reshape(-1).view(f"S{self.length}"), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        text, bucket, picked = text[order], bucket[order], picked[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (text[1:] != text[:-1]).any(axis=1)
        rank, text, bucket = np.cumsum(new) - 1, text[new], bucket[new]
        for b, start, end in _slices(bucket):
            yield b, zstandard.compress(text[start:end].tobytes(), 1), b""
        sizes = np.array([len(picked), len(bucket)], dtype="<i8")
        yield -1 - number, b"".join(x.astype("<i8").tobytes() for x in (sizes, picked, rank, bucket)), b""

    def removed(self, block: Block, answers: list[dict] | None) -> np.ndarray:
        """For each byte, whether it goes."""
        change = np.zeros(len(block.data) + 1, dtype=np.int32)
        state = next((x["mask"] for x in answers or [] if x["bucket"] < 0), None)
        if state is not None:
            numbers = np.frombuffer(state, "<i8")
            n, m = numbers[:2]
            places, rank, bucket = numbers[2 : 2 + n], numbers[2 + n : 2 + 2 * n], numbers[2 + 2 * n :]
            repeated = (np.bincount(rank, minlength=m) > 1) | _flags(bucket, answers)
            hit = places[repeated[rank]]
            change[hit] += 1
            np.add.at(change, hit + self.length, -1)
        return np.cumsum(change[:-1]) > 0


def _pack_blocks(rows: DataFrame, id_type: str, length: int) -> DataFrame:
    """``rows(id, digest, text, emit)`` packed into compressed blocks. A block of a part of a long text
    has the text's digest in ``part`` and the part's place in ``base``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number, id_kind = TaskContext.get().partitionId() << 32, None
        ids: list = []
        texts: list = []
        emits: list[bool] = []
        size = 0

        def block(ids, texts, emits, part=None, base=0) -> pa.RecordBatch:
            nonlocal number
            number += 1
            columns = {
                "block": pa.array([number], pa.int64()),
                "part": pa.array([part], pa.string()),
                "base": pa.array([base], pa.int64()),
                "ids": pa.array([ids], pa.list_(id_kind)),
                "emits": pa.array([emits], pa.list_(pa.bool_())),
                "sizes": pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
                "payload": pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_kind = batch.column(0).type
            for id_, digest, text, emit in zip(*batch.columns):
                whole = memoryview(text.as_buffer())
                if len(whole) > BLOCK_BYTES:
                    for base in range(0, len(whole), BLOCK_BYTES):
                        yield block([id_.as_py()], [whole[base : base + BLOCK_BYTES + length - 1]], [emit.as_py()], digest.as_py(), base)
                    continue
                ids.append(id_.as_py())
                texts.append(bytes(whole))
                emits.append(emit.as_py())
                size += len(whole)
                if size >= BLOCK_BYTES:
                    yield block(ids, texts, emits)
                    ids, texts, emits, size = [], [], [], 0
        if ids:
            yield block(ids, texts, emits)

    schema = f"block bigint, part string, base bigint, ids array<{id_type}>, emits array<boolean>, sizes array<bigint>, payload binary"
    return rows.select("id", "digest", "text", "emit").mapInArrow(scan, schema)


def _answer_samples(group: pa.Table) -> pa.Table:
    """Sorts one bucket's keys and marks those that more than one block has. A block sends a key once."""
    width = SAMPLE_BITS // 8
    low = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint8).reshape(-1, width)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, :width] = low
    keys = keys.view("<u8").reshape(-1)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    tied = np.zeros(len(keys), dtype=bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    return _masks(group, [len(x) // width for x in group["keys"].to_pylist()], tied, tied & False)


def _answer_suffixes(group: pa.Table) -> pa.Table:
    """Sorts one bucket's words; a key is tied if more than one block has it, and an edge if its words
    differ in a neighbouring byte or a block says so."""
    sizes = [len(x) // 8 for x in group["keys"].to_pylist()]
    words = np.frombuffer(b"".join(group["keys"].to_pylist()), "<u8")
    marked = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group["flags"].to_pylist(), sizes)]).astype(bool)
    order = np.argsort(words)
    words, marked = words[order], marked[order]
    keys = words >> np.uint64(16)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    several = last > first
    edge = several & ((words[first] != words[last]) | np.logical_or.reduceat(marked, first))
    rank = np.cumsum(new) - 1
    tied_at, edge_at = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    tied_at[order], edge_at[order] = several[rank], edge[rank]
    return _masks(group, sizes, tied_at, edge_at)


def _answer_strings(length: int):
    def answer(group: pa.Table) -> pa.Table:
        """Sorts one bucket's strings by their bytes and marks those that more than one block has."""
        import zstandard

        if group["bucket"][0].as_py() < 0:
            return pa.table({"block": group["block"], "bucket": group["bucket"], "mask": group["keys"], "more": group["flags"]})
        parts = [zstandard.decompress(x) for x in group["keys"].to_pylist()]
        text = np.frombuffer(b"".join(parts), f"S{length}")
        order = np.argsort(text, kind="stable")
        same = text[order[1:]] == text[order[:-1]]
        repeated = np.zeros(len(text), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        return _masks(group, [len(x) // length for x in parts], repeated, repeated & False)

    return answer


def _masks(group: pa.Table, sizes: list[int], mask: np.ndarray, more: np.ndarray) -> pa.Table:
    """One row for each of a bucket's blocks that has a bit to be told."""
    ends = np.cumsum(sizes)
    spans = [(k, end - size, end) for k, (size, end) in enumerate(zip(sizes, ends)) if mask[end - size : end].any()]
    keep = pa.array([k for k, _, _ in spans], pa.int64())
    return pa.table(
        {
            "block": group["block"].take(keep),
            "bucket": group["bucket"].take(keep),
            "mask": pa.array([np.packbits(mask[a:b]).tobytes() for _, a, b in spans], pa.binary()),
            "more": pa.array([np.packbits(more[a:b]).tobytes() for _, a, b in spans], pa.binary()),
        }
    )


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time."""
    for k in range(batch.num_rows):
        yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _round(blocks: DataFrame, send, answered: list[str], answer, name: str, n_tasks: int) -> DataFrame:
    """``blocks`` with one more column of answers, ``name``; buckets are dealt over ``n_tasks`` tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                sent = list(send(Block(row["payload"], row["sizes"]), row["block"], *[row[x] for x in answered]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in sent], pa.int64()),
                        pa.array([row["block"]] * len(sent), pa.int64()),
                        pa.array([x[1] for x in sent], pa.binary()),
                        pa.array([x[2] for x in sent], pa.binary()),
                    ],
                    names=["bucket", "block", "keys", "flags"],
                )

    sent = blocks.select("block", "sizes", "payload", *answered).mapInArrow(scan, SENT)
    answers = sent.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(answer, ANSWERS)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "mask", "more")).alias(name))
    return blocks.join(materialise(by_block, name), "block", "left")


def _settle(blocks: DataFrame, job: Job, id_type: str) -> DataFrame:
    """``id, n_bytes, starts, ends, kept`` of whole texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.column(0).type.value_type
            for row in _rows(batch):
                block = Block(row["payload"], row["sizes"])
                gone = job.removed(block, row["answers"])
                out: list[list] = [[], [], [], [], []]
                for id_, emit, start, size in zip(row["ids"], row["emits"], block.starts.tolist(), row["sizes"]):
                    if emit:
                        starts, ends = _spans(gone[start : start + size])
                        text = block.data[start : start + size]
                        for column, value in zip(out, (id_, size, starts, ends, (text[~gone[start : start + size]] if len(starts) else text).tobytes())):
                            column.append(value)
                types = (id_kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["id", "n_bytes", "starts", "ends", "kept"])

    schema = f"id {id_type}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"
    return blocks.where("part is null").select("ids", "emits", "sizes", "payload", "answers").mapInArrow(scan, schema)


def _settle_parts(blocks: DataFrame, job: Job, id_type: str) -> DataFrame:
    """The same of texts that are split into blocks: what goes in each part, put together by text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.column(2).type.value_type
            for row in _rows(batch):
                block = Block(row["payload"], row["sizes"])
                starts, ends = _spans(job.removed(block, row["answers"]))
                columns = [
                    pa.array([row["part"]], pa.string()),
                    pa.array([row["base"]], pa.int64()),
                    pa.array(row["ids"], id_kind),
                    pa.array([starts + row["base"]], pa.list_(pa.int64())),
                    pa.array([ends + row["base"]], pa.list_(pa.int64())),
                    pa.array([block.data.tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "base", "id", "starts", "ends", "bytes"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("base")
        parts = group["bytes"].to_pylist()
        data = np.frombuffer(b"".join([x[:BLOCK_BYTES] for x in parts[:-1]] + parts[-1:]), np.uint8)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        for column, step in (("starts", 1), ("ends", -1)):
            np.add.at(change, np.concatenate([np.array(x, dtype=np.int64) for x in group[column].to_pylist()]), step)
        gone = np.cumsum(change[:-1]) > 0
        starts, ends = _spans(gone)
        return pa.table(
            {
                "id": group["id"].slice(0, 1),
                "n_bytes": pa.array([len(data)], pa.int64()),
                "starts": pa.array([starts], pa.list_(pa.int64())),
                "ends": pa.array([ends], pa.list_(pa.int64())),
                "kept": pa.array([data[~gone].tobytes()], pa.binary()),
            }
        )

    columns = f"part string, base bigint, id {id_type}, starts array<bigint>, ends array<bigint>, bytes binary"
    rows = blocks.where("part is not null and emits[0]").select("part", "base", "ids", "sizes", "payload", "answers").mapInArrow(scan, columns)
    return rows.groupBy("part").applyInArrow(merge, f"id {id_type}, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def _spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_bytes, starts, ends, kept``: the removed spans, as
    arrays of their first bytes and of the bytes after their last, and what stays."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
    rows = once(docs.select(F.col(f"`{id_col}`").alias("id"), text), digest=F.sha2("text", 256))
    size = F.octet_length("text").cast("bigint")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialise(groups, "equal-texts")
    n_groups, total = groups.count(), docs.select(text).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total")).first()["total"]
    distinct = rows.select("digest", "id", "text", F.lit(True).alias("emit"))
    copies = None
    if n_groups:
        bits, words = build_filter(groups, "digest", n_groups)
        test = maybe(F.col("digest"), bits, words)
        # Aggregated before the shuffle, so a hot text travels once from each task. Texts of groups stand
        # for their copies and have no row of their own; a false hit of the filter is a text like any other.
        hits = rows.where(test).groupBy("digest").agg(F.first(F.struct("id", "text")).alias("x"), F.count(F.lit(1)).alias("n"))
        distinct = distinct.where(~test).unionByName(hits.select("digest", "x.id", "x.text", (F.col("n") == 1).alias("emit")))
        whole = F.col("n_bytes") >= length
        # Only short copies keep bytes: no long text takes part in this join.
        copied = rows.where(test).select("id", "digest", size.alias("n_bytes"), F.when(size < length, F.col("text")).otherwise(F.lit(b"")).alias("kept"))
        none = F.array().cast("array<bigint>")
        copies = copied.join(groups, "digest", "left_semi").select(
            "id",
            "n_bytes",
            F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(none).alias("starts"),
            F.when(whole, F.array("n_bytes")).otherwise(none).alias("ends"),
            "kept",
        )

    path, table = new_table(spark, "blocks")
    n_files = 1 + max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TABLE_BUCKET_BYTES)
    packed = _pack_blocks(distinct, id_type, length).repartition(n_files, "block")
    packed.write.bucketBy(n_files, "block").format("parquet").option("path", path).saveAsTable(table)
    v, cover = cover_for(length)
    # At least a bucket for each task, so that all have work on small inputs too.
    buckets = [max(n_files, 1 + n) for n in (total * len(cover) // v // SAMPLES, total // SUFFIXES, total // STRINGS)]
    job = Job(length, *buckets, SAMPLE_BITS, SUFFIX_BITS)
    blocks = spark.table(table)
    blocks = _round(blocks, job.samples, [], _answer_samples, "sample_answers", n_files)
    blocks = _round(blocks, job.suffixes, ["sample_answers"], _answer_suffixes, "suffix_answers", n_files)
    blocks = _round(blocks, job.strings, ["sample_answers", "suffix_answers"], _answer_strings(length), "answers", n_files)
    settled = _settle(blocks, job, id_type).unionByName(_settle_parts(blocks, job, id_type))
    return settled.unionByName(copies) if copies is not None else settled
