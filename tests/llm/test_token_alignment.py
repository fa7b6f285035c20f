import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, frame

from gridweave.llm import catalog, token_alignment as ta

ODD = [
    "<|endoftext|> and <s> as text </s>", "▁ already a mark", "\0 a NUL", "  spaces   in  rows ", "naïve café — “quotes”", "中文字符和日本語のテキスト", "🙂🙃 👩‍👩‍👧", "a", " ", "\n\n\t", "=" * 700, "x" * 3000,
    "12345678901234567890", "é é ﬁ Å", "<0x41> <0x0A>", "don't we'll I'M", "a b　c", "﻿ bom", "ab" * 500 + " " * 65 + "c",
]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    return one, two


def byte_of():
    """Bytes of the characters that byte-level vocabularies write."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            table[chr(more)], more = b, more + 1
    return table


def brute(rows, tokenizers):
    """Groups by the set of common ends, links by two loops, counts by a counter."""
    one, two = tokenizers
    table, found = byte_of(), []
    for id_, text in rows:
        whole = (" " + (text or "")).encode()
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            a_bytes = [bytes(table[c] for c in one.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
                a, b = [], []
            else:
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
                common, lows = sorted({*ends[0]} & {*ends[1]}), [0, 0]
                for end in common:
                    highs = [es.index(end, low) + 1 for es, low in zip(ends, lows)]
                    group = [ids[low:high] for ids, low, high in zip((a, b), lows, highs)]
                    groups.append(group)
                    links.update((x, y) for x in group[0] for y in group[1])
                    lows = highs
        found.append((id_, a, b, groups, links))
    counts = Counter(pair for *_, links in found for pair in links)
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for id_, a, b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        best = sum(n for (x, y), n in links.items() if counts[x, y] == highest[x])
        total = sum(n * counts[pair] for pair, n in links.items())
        out.append((id_, len(a), len(b), len(groups), sum(links.values()), best, total, text))
    return sorted(out, key=repr)


def scored(docs, slice_links=ta.SLICE, frequent=ta.FREQUENT):
    made = ta.with_counts(ta.align(docs, slice_links=slice_links), frequent)
    return sorted([(r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in made.collect()], key=repr)


@pytest.mark.parametrize("slice_links, frequent", [(ta.SLICE, ta.FREQUENT), (5, 20), (1, 0)])
def test_same_as_loops(spark, tokenizers, slice_links, frequent):
    rows = documents() + [(500 + k, text, "en", "s", 0, "x", "y", 5, 6, "z", 7, 8, 9) for k, text in enumerate(ODD)]
    expected = brute([(r[0], r[1]) for r in rows], tokenizers)
    assert scored(frame(spark, rows), slice_links, frequent) == expected
    assert any(r[1] == 0 and r[0] == 501 for r in expected)


def test_small_table(spark, tokenizers, small_dir):
    found = catalog.queries()["op12_token_alignment"](spark, small_dir).collect()
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows, tokenizers)]
    assert sorted([tuple(r) for r in found], key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert scored(frame(spark, [])) == []
    assert scored(frame(spark, [documents()[44], documents()[43]])) == [(102, 0, 0, 0, 0, 0, 0, ""), (103, 0, 0, 0, 0, 0, 0, "")]


def test_slices_are_whole_and_bounded():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50, 400), rng.integers(0, 30, 300)
    a_first, b_first = np.array([0, 150, 151]), np.array([0, 200, 202])
    once = Counter()
    for low, high, low_b, high_b in ((0, 150, 0, 200), (150, 151, 200, 202), (151, 400, 202, 300)):
        once.update((x, y) for x in a[low:high].tolist() for y in b[low_b:high_b].tolist())
    for most in (1, 100, 10**6):
        parts = list(ta.pair_slices(a, b, a_first, b_first, most))
        keys = np.concatenate([k for k, _ in parts])
        assert len(np.unique(keys)) == len(keys)
        assert {(int(k) >> ta.SHIFT, int(k) & 0xFFFFFFFF): int(n) for ks, ns in parts for k, n in zip(ks, ns)} == once
