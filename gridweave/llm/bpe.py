"""BPE encoding and decoding by tree concatenation.

A text of more than ``LEAF`` characters is cut in halves, and these again, wherever the middle falls,
until each part is a leaf. Leaves are encoded on their own by a public tokenizer library and joined
pairwise up the tree. Every node holds exactly what its own text, taken alone, is encoded to.

A join encodes a window anew, from some tokens before the cut to some tokens after it. It starts and
ends where a space stands before another character: there a pre-token starts whatever precedes, as
no alternative of the pattern runs on over such a place. The window grows until it agrees with both
sides: its first pre-tokens are the left side's and its last ones the right side's, token for token.

Where text has no such place for ``2 * LEAF`` bytes, the cut lies in a long pre-token, and the
merges themselves are joined: the pattern finds the pre-token over the cut, and the tokens of its two
parts are joined by windows of tokens that double until their first token is the left side's and
their last one the right side's. Then all neighbouring tokens are compatible, each pair being what the
encoder makes of its own bytes, and a byte-pair encoding is the only sequence with that property.

A text of at most ``CHUNK`` characters is encoded where it is read. A longer one becomes several rows,
one for each of its subtrees of that size, that Spark spreads over all tasks; they are joined by text.

Vocabularies are tokenizer JSON files of byte-level BPE, named by a path or by their name in the
package of public tokenizers; every executor reads its own copy.

Defined results: a null text counts as empty and has no tokens. The text of a special token counts
as that token, as in the library. Rows that repeat an id are encoded row by row. The ids of a text
are one value of a row, four bytes for each token, so texts go up to Spark's 2 GB of a value. Extra
columns are not read and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.text import small_batches

#: Characters of a row that is one subtree, and of a leaf.
CHUNK = 1 << 15
LEAF = 1 << 11
#: Tokens of each side in the first window of a join.
WINDOW = 8


class Vocabulary:
    """A byte-level BPE vocabulary; its encoders are built when they are first used."""

    def __init__(self, path: str):
        import public_tokenizers

        self.path = path if os.path.sep in path else public_tokenizers.path(path)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.to_char, to_byte = _alphabet()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = {k.encode(): v for k, v in added.items()}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.special_ids = added

    @cached_property
    def model(self):
        """Merges alone."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).model

    @cached_property
    def words(self):
        """Pattern and merges, for text whose pre-tokens are short."""
        import public_tokenizers
        import tiktoken

        special = set(self.special.values())
        ranks = {token: i for i, token in enumerate(self.bytes_of) if token and i not in special}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def pattern(self):
        import public_tokenizers
        import regex

        return regex.compile(public_tokenizers.PATTERN)

    @cached_property
    def starts_word(self) -> np.ndarray:
        """By token: whether it is a space and at least one whole character that is none."""
        out = np.zeros(len(self.bytes_of), dtype=bool)
        special = set(self.special_ids.values())
        for i, token in enumerate(self.bytes_of):
            rest = token[1:].decode("utf-8", "ignore")
            out[i] = token[:1] == b" " and bool(rest) and rest[0].encode() == token[1 : 1 + len(rest[0].encode())] and not rest[0].isspace() and i not in special
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """Merges alone, for the bytes of one pre-token or a part of it."""
        return [t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.to_char))]

    def bytes_for(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def text_for(self, ids) -> str:
        return self.bytes_for(ids).decode("utf-8", "replace")

    def join_merges(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of one pre-token, from their own encodings."""
        if not left or not right:
            return left + right
        size = WINDOW
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self.encode_piece(self.bytes_for(left[i:]) + self.bytes_for(right[:j]))
            agree_left = i == 0 or window[0] == left[i]
            agree_right = j == len(right) or window[-1] == right[j - 1]
            if agree_left and agree_right and (len(window) > 1 or (i == 0 and j == len(right))):
                return left[:i] + window + right[j:]
            size *= 2

    def encode_pretoken(self, data: bytes) -> list[int]:
        """Merges alone; halves of a long pre-token are encoded apart and joined."""
        if len(data) <= LEAF:
            return self.encode_piece(data)
        half = len(data) // 2
        return self.join_merges(self.encode_pretoken(data[:half]), self.encode_pretoken(data[half:]))

    def _word_starts(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.starts_word[ids])

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two neighbouring texts put together, from their own encodings."""
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        size = WINDOW
        while True:
            low, high = max(0, len(left) - 4 * size), min(len(right), 4 * size)
            # Places in the last and the first tokens; the window takes at least ``size`` of each side.
            before, after = self._word_starts(left[low:]) + low, self._word_starts(right[:high])
            i = next((int(x) for x in before[::-1] if x <= len(left) - size), 0 if low == 0 else None)
            j = next((int(x) for x in after if x >= size), len(right) if high == len(right) else None)
            if i is not None and j is not None:
                joined = self._join_window(left, right, i, j, before, after)
                if joined is not None:
                    return joined
            if low == 0 and high == len(right) or sum(map(len, map(self.bytes_of.__getitem__, left[low:].tolist()))) > 2 * LEAF or size * 4 > 2 * LEAF:
                return self._join_unsplit(left, right)
            size *= 2

    def _join_window(self, left: np.ndarray, right: np.ndarray, i: int, j: int, before: np.ndarray, after: np.ndarray) -> np.ndarray | None:
        """The joined tokens if the window ``left[i:], right[:j]`` agrees with both sides."""
        head, tail = before[before > i], after[after < j]
        first, last = (int(head[0]) if len(head) else None), (int(tail[-1]) if len(tail) else None)
        whole_left, whole_right = i == 0, j == len(right)
        if (not whole_left and first is None) or (not whole_right and last is None):
            return None
        data = self.bytes_for(left[i:]) + self.bytes_for(right[:j])
        if len(data) > 4 * LEAF:
            return None
        window = np.array(self.words.encode_ordinary(data.decode()), "<u4")
        if not whole_left and not np.array_equal(window[: first - i], left[i:first]):
            return None
        if not whole_right and not np.array_equal(window[len(window) - (j - last) :], right[last:j]):
            return None
        return np.concatenate((left[:i], window, right[j:]))

    def _join_unsplit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A join whose cut lies in a long pre-token, or in texts without a place to start a window."""
        before, after = self._word_starts(left), self._word_starts(right)
        # The last word of the left side may end in the cut: one more is taken with it.
        i = int(before[-2]) if len(before) > 1 else 0
        j = int(after[1]) if len(after) > 1 else len(right)
        tail, head = left[i:], right[:j]
        one, two = self.bytes_for(tail).decode(), self.bytes_for(head).decode()
        text, cut = one + two, len(one)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            a, b = m.span()
            data = m[0].encode()
            mine = one[a:cut]
            # Either part was one pre-token of its own side if the pattern takes it whole there.
            if len(data) > LEAF and a < cut < b and self.pattern.match(one, a)[0] == mine and self.pattern.match(two)[0] == two[: b - cut]:
                ids = self.join_merges(self._last_bytes(tail, len(mine.encode())), self._first_bytes(head, len(two[: b - cut].encode())))
            else:
                ids = self.encode_pretoken(data)
            out += ids
        return np.concatenate((left[:i], np.array(out, "<u4"), right[j:]))

    def _last_bytes(self, ids: np.ndarray, n: int) -> list[int]:
        """The last tokens, which are ``n`` bytes together."""
        sizes = np.cumsum([len(self.bytes_of[i]) for i in ids[::-1].tolist()])
        return ids[len(ids) - 1 - int(np.searchsorted(sizes, n)) :].tolist()

    def _first_bytes(self, ids: np.ndarray, n: int) -> list[int]:
        sizes = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()])
        return ids[: int(np.searchsorted(sizes, n)) + 1].tolist()

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """Joins neighbours pairwise until one encoding is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, "<u4")

    def encode_text(self, text: str) -> np.ndarray:
        """A text without special tokens: a leaf, or its halves joined."""
        if len(text) <= LEAF:
            return np.array(self.words.encode_ordinary(text), "<u4")
        half = len(text) // 2
        return self.join(self.encode_text(text[:half]), self.encode_text(text[half:]))

    def sections(self, text: str) -> list[str]:
        """The text around special tokens and, between, the special tokens."""
        return self.split_special.split(text) if self.split_special else [text]

    def encode(self, text: str) -> np.ndarray:
        parts = [np.array([self.special_ids[x]], "<u4") if k % 2 else self.encode_text(x) for k, x in enumerate(self.sections(text))]
        return np.concatenate(parts)


def _alphabet() -> tuple[dict[int, str], dict[str, int]]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves,
    the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in own]
    to_char = {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(other)}
    return to_char, {c: b for b, c in to_char.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def subtrees(text: str) -> Iterator[str]:
    """Halves of halves of ``text``, none longer than CHUNK, in order."""
    if len(text) <= CHUNK:
        yield text
        return
    half = len(text) // 2
    yield from subtrees(text[:half])
    yield from subtrees(text[half:])


def cut(vocab: Vocabulary, text: str) -> Iterator[tuple[int, bool, bytes]]:
    """``(section, special, payload)`` rows of a long text, in order: text that one task encodes, or
    the ids of a special token. Subtrees of one section are to be joined."""
    for section, part in enumerate(vocab.sections(text)):
        if section % 2:
            yield section, True, np.array([vocab.special_ids[part]], "<u4").tobytes()
        else:
            for subtree in subtrees(part):
                yield section, False, subtree.encode()


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = "byte_bpe_50k.json", decoded: bool = False
) -> DataFrame:
    """``(id, ids)`` for every row; ids are little-endian unsigned 32-bit integers. With ``decoded``
    also ``text``, what the ids decode to, without a second pass through Python."""
    id_type = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    short = rows.where(F.length("text") <= CHUNK)
    # Pieces are told apart by id and text, which no retry of a task can change; pieces of rows that
    # repeat both are the same, and are counted when they are put together.
    long = rows.where(F.length("text") > CHUNK).withColumn("row", F.sha2(F.col("text").cast("binary"), 256))

    result = f"id {id_type}, ids binary" + ", text string" * decoded

    def columns_of(v: Vocabulary, coded: list[np.ndarray]) -> dict[str, pa.Array]:
        made = {"ids": pa.array([ids.tobytes() for ids in coded], pa.binary())}
        if decoded:
            made["text"] = pa.array([v.text_for(ids) for ids in coded], pa.string())
        return made

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **columns_of(v, [v.encode(x.as_py()) for x in batch.column(1)])})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        schema = pa.schema([("row", pa.string()), ("seq", pa.int64()), ("section", pa.int64()), ("special", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for id_, text_, row in zip(batch.column(0), batch.column(1), batch.column(2)):
                out = [(row.as_py(), seq, *piece) for seq, piece in enumerate(cut(v, text_.as_py()))]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()] * len(out), batch.column(0).type), *columns], names=["id", *schema.names])

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for batch in batches:
            payloads = zip(batch.column("special").to_pylist(), batch.column("payload").to_pylist())
            coded = [x if special else v.encode_text(x.decode()).tobytes() for special, x in payloads]
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(coded, pa.binary()))

    def assemble(group: pa.Table) -> pa.Table:
        v = vocabulary(vocab)
        group = group.sort_by("seq")
        copies = sum(x == 0 for x in group["seq"].to_pylist())
        group = group.take(pa.array(range(0, group.num_rows, copies)))
        sections: dict[int, list[np.ndarray]] = {}
        for section, payload in zip(group["section"].to_pylist(), group["payload"]):
            sections.setdefault(section, []).append(np.frombuffer(payload.as_buffer(), "<u4"))
        out = np.concatenate([v.join_all(parts) for parts in sections.values()])
        return pa.table({"id": group["id"].take(pa.array([0] * copies)), **columns_of(v, [out] * copies)})

    columns = f"id {id_type}, row string, seq bigint, section bigint, special boolean, payload binary"
    coded = long.mapInArrow(pieces, columns).repartition("row", "seq").mapInArrow(subtree, columns)
    joined = coded.groupBy("id", "row").applyInArrow(assemble, result)
    return short.mapInArrow(whole, result).unionByName(joined)


def decode(encoded: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """``(id, ids, text)``: the text of each row's ids, special tokens included. Bytes that are not
    UTF-8 become replacement characters, as in the library."""
    id_type = encoded.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab)
        for batch in batches:
            texts = [v.text_for(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(scan, f"id {id_type}, ids binary, text string")


def digests(decoded: DataFrame) -> list[Column]:
    """n_tokens and the digests of ids and decoded text."""
    return [
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    ]
