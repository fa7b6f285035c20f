"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters, ``width`` bytes wide, are table look-ups over the bytes. A document is covered whole
by chunks of ``chunk`` bytes that overlap by half; each filter is max-pooled over a chunk, rectified,
and the pooled values give the chunk's probability. Mean and smallest chunk probability combine into
the document's.

The network is fitted on a bounded sample of labelled rows: at most ``rows_per_class`` rows of each
label, chosen by a hash of the id, and at most ``sample_bytes`` bytes of whole texts; a row that would
exceed these is left out. Every chunk of a sampled row is learned from at least once. Scoring reads
every byte of every text.

Defined results: a null text counts as empty; an empty text is one chunk of padding. Rows that
repeat an id are scored alike, and the first of them by text is learned from. If the labelled rows hold
label 0 only, every score is 0; if they hold label 1 only, or none, it is 1, so nothing is rejected.
Labels other than 0 and 1, null labels and null ids are not learned from; of two labels of an id the
smaller counts. A text is scored chunk by chunk, whatever its length, and is one value of a row, so it goes up to
Spark's 2 GB. An empty table gives no scores. Extra columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import small_batches


@dataclass(frozen=True)
class Settings:
    width: int = 6
    filters: int = 12
    chunk: int = 1024
    rows_per_class: int = 1500
    sample_bytes: int = 64 << 20
    steps: int = 1000
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 5
    threshold: float = 0.7


#: Positions scored at a time; a multiple of half a chunk.
SEGMENT = 1 << 16


class Network:
    """Look-up filters, pooling and the output unit. Byte 0 is padding and adds nothing."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.taps = rng.normal(0, 0.1, (s.width, 256, s.filters)).astype(np.float32)
        self.taps[:, 0] = 0
        self.bias = np.zeros(s.filters, dtype=np.float32)
        self.out = rng.normal(0, 0.3, s.filters).astype(np.float32)
        self.out_bias = np.zeros(1, dtype=np.float32)
        self.combine = np.array([4.0, 2.0, -3.0])
        self.constant: float | None = None

    def respond(self, data: np.ndarray, n: int) -> np.ndarray:
        """Filter responses at ``n`` positions; ``data`` has width - 1 bytes more."""
        got = np.broadcast_to(self.bias, (n, self.s.filters)).copy()
        for k in range(self.s.width):
            got += self.taps[k].take(data[k : k + n], axis=0)
        return got

    def chunk_logits(self, text: bytes) -> np.ndarray:
        s, half = self.s, self.s.chunk // 2
        raw = np.frombuffer(text or b"\0", dtype=np.uint8)
        data = np.concatenate((raw, np.zeros(s.width - 1, dtype=np.uint8)))
        tops = []
        for at in range(0, len(raw), SEGMENT):
            n = min(SEGMENT, len(raw) - at)
            got = self.respond(data[at : at + n + s.width - 1], n)
            tops.append(np.maximum.reduceat(got, np.arange(0, n, half), axis=0))
        top = np.concatenate(tops)
        if len(top) > 1:  # a chunk is two halves; the next chunk shares one of them
            top = np.maximum(top[:-1], top[1:])
        return np.maximum(top, 0) @ self.out + self.out_bias[0]

    def document_features(self, text: bytes) -> tuple[float, float]:
        p = 1 / (1 + np.exp(-self.chunk_logits(text).astype(np.float64)))
        return float(p.mean()), float(p.min())

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        mean, low = self.document_features(text)
        return float(1 / (1 + np.exp(-(self.combine[0] * mean + self.combine[1] * low + self.combine[2]))))

    def fit(self, texts: list[bytes], labels: np.ndarray) -> Network:
        """Adam on the cross-entropy of all chunks of ``texts``; the gradient passes through the pooled
        positions only."""
        s, size = self.s, self.s.chunk
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.all())
            return self
        texts = [x or b"\0" for x in texts]
        places = [(k, at) for k, x in enumerate(texts) for at in chunk_starts(len(x), size)]
        n = len(places)
        names = ("taps", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        rng, step, unit = np.random.default_rng(s.seed), 0, np.arange(s.filters)
        outside = np.arange(size)[None, :, None]
        while step < s.steps:
            order = rng.permutation(n)
            for at in range(0, n, s.batch):
                pick = [places[k] for k in order[at : at + s.batch]]
                x = np.zeros((len(pick), size + s.width - 1), dtype=np.uint8)
                length = np.zeros(len(pick), dtype=np.int64)
                for row, (k, start) in enumerate(pick):
                    raw = np.frombuffer(texts[k][start : start + x.shape[1]], dtype=np.uint8)
                    x[row, : len(raw)], length[row] = raw, min(size, len(texts[k]) - start)
                y = labels[[k for k, _ in pick]]
                got = np.broadcast_to(self.bias, (len(pick), size, s.filters)).copy()
                for k in range(s.width):
                    got += self.taps[k].take(x[:, k : k + size], axis=0)
                got[np.broadcast_to(outside >= length[:, None, None], got.shape)] = -np.inf
                where = got.argmax(axis=1)
                top = np.take_along_axis(got, where[:, None], axis=1)[:, 0]
                pooled = np.maximum(top, 0)
                z = pooled @ self.out + self.out_bias[0]
                dz = ((1 / (1 + np.exp(-z)) - y) / len(pick)).astype(np.float32)
                dtop = dz[:, None] * self.out * (top > 0)
                grad = {"out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True), "bias": dtop.sum(axis=0)}
                rows = np.arange(len(pick))[:, None]
                grad["taps"] = np.zeros_like(self.taps)
                for k in range(s.width):
                    np.add.at(grad["taps"][k], (x[rows, where + k], unit[None]), dtop)
                step += 1
                for k in names:
                    g = grad[k] + s.decay * getattr(self, k)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    rate = s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, k, (getattr(self, k) - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32))
                self.taps[:, 0] = 0
        self._fit_combination(texts, labels)
        return self

    def _fit_combination(self, texts: list[bytes], labels: np.ndarray) -> None:
        """Logistic regression on each sampled document's mean and smallest chunk probability."""
        x = np.array([[*self.document_features(text), 1.0] for text in texts])
        w = self.combine.copy()
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-x @ w))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.1
            w -= np.linalg.solve(hessian, x.T @ (p - labels) + 0.1 * w)
        self.combine = w


def chunk_starts(n: int, chunk: int) -> range:
    """Where the chunks of ``n`` bytes start: halves overlap, and the last chunk ends with the text."""
    return range(0, max(1, n - chunk // 2), chunk // 2)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, label, text)``: the labelled rows that the network may be fitted on, in a fixed order."""
    key = F.col("id").cast("string")
    rows = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(key.cast("binary")) % 4 != 2))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    picked = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(s.seed), "id"), "id").limit(s.rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    # Bounded by 2 * rows_per_class rows of 12 bytes.
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
    found = docs.select(F.col(f"`{id_col}`").alias("id"), text).join(F.broadcast(picked), "id").select("id", "label", "text")
    return found.repartition(8, "id").sortWithinPartitions(F.xxhash64(F.lit(s.seed), "id"), "id", "text")


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on the driver, on at most ``2 * rows_per_class`` rows of ``sample_bytes`` bytes together."""
    texts, marks, size, last = [], [], 0, object()
    for row in training_rows(docs, labels, s, id_col, text_col, label_col).toLocalIterator():
        if row["id"] == last or size + len(row["text"]) > s.sample_bytes:
            continue
        last = row["id"]
        texts.append(bytes(row["text"]))
        marks.append(row["label"])
        size += len(texts[-1])
    return Network(s).fit(texts, np.array(marks, dtype=np.float32))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [network.score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(scan, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored under the threshold; columns and types unchanged."""
    at = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [network.score((x.as_py() or "").encode()) >= network.s.threshold for x in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
