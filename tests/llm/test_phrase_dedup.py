import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, frame

from gridweave.llm import catalog
from gridweave.llm import phrase_dedup as pd

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, length):
    """``(id, words, removed, kept)`` by a dictionary of windows, in document order."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).digest()))
    seen, out = set(), []
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out.append((rows[k][0], len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def found(docs, **options):
    made = pd.remove_phrases(docs, **options).collect()
    return sorted([(r.id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), r.kept) for r in made], key=repr)


def rows_of(texts):
    return [(k, t, "en", "s", 0, "x", "y", 5, 6, "z", 7, 8, 9) for k, t in texts]


def odd_texts(seed):
    """Shared passages at every offset, periods, copies, a line that many texts hold, ids that repeat or are null."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["ÀÉ", "a b", "", "é"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, line = [words(rng.randint(3, 60)) for _ in range(12)], words(9)
    texts = []
    for k in range(150):
        parts = [words(rng.randint(0, 8)) for _ in range(3)] + rng.sample(shared, 2) + [line, line]
        rng.shuffle(parts)
        texts.append((rng.choice([k, k, k, 3, None]), rng.choice([" ", "  ", "\n"]).join(w for p in parts for w in p)))
    texts += [(200, "ab " * 500), (201, "ab cd\x0b" * 300), (202, "ab\x0ccd ef" * 100), (203, None), (203, ""), (None, None), (204, " \t\n")]
    texts += [(205, texts[0][1]), (1, texts[0][1]), (206, texts[5][1]), (206, texts[5][1]), (None, texts[5][1])]
    return texts + [(207, " ".join(words(5))), (208, "x" * 5000 + " y" * 30), (209, "x" * 5000 + " y" * 30 + " z")]


@pytest.mark.parametrize("length, gram, passages, hot", [(20, 10, 8192, 4096), (7, 4, 40, 10), (5, 5, 3, 2), (8, 1, 50, 3), (1, 1, 20, 2)])
def test_same_as_a_dictionary_of_windows(spark, length, gram, passages, hot):
    rows = odd_texts(length)
    docs = frame(spark, rows_of(rows))
    assert found(docs, length=length, gram=gram, passages=passages, hot=hot) == brute(rows, length)


def test_documents_of_every_kind(spark):
    rows = documents()
    assert found(frame(spark)) == brute([(r[0], r[1]) for r in rows], 20)


def test_small_table(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 20)]
    got = catalog.queries()["op13_phrase_dedup"](spark, small_dir).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(expected, key=repr)
    assert any(r.n_removed for r in got)


def test_nothing_comes_of_nothing(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, rows_of([(1, None), (2, "")]))) == [(1, 0, 0, ""), (2, 0, 0, "")]


def test_words_are_those_of_the_pattern():
    texts = ["", " a  bc\n", "é\x0b\x0cü", "\x85\xa0 x\x1cy", "   ", "end"]
    words = pd.Words(pa.array([t.encode() for t in texts]).slice(1))
    expected = [(k, w.encode()) for k, t in enumerate(texts[1:]) for w in WORD.findall(t)]
    assert [(int(d), words.passage(i, i + 1)) for i, d in enumerate(words.doc)] == expected
    assert words.counts.tolist() == [len(WORD.findall(t)) for t in texts[1:]]


def test_hashes_are_of_words_and_their_order():
    column = pa.array([b"a b c a b", b"a b", b"b a", b"x" * 9000 + b" " + b"x" * 9001])
    hashes = pd.Words(column).hashes()
    assert hashes[0] == hashes[3] == hashes[5] and len(set(hashes.tolist())) == 5
    pairs = pd.rolling(hashes, 2)
    assert pairs[0] == pairs[3] == pairs[5] and pairs[7] != pairs[5]
    assert len(pd.rolling(hashes, 12)) == 0 and len(pd.rolling(hashes, 11)) == 1


@pytest.mark.parametrize("n", range(1, 13))
def test_least_is_leftmost(n):
    values = np.random.default_rng(n).integers(0, 5, 40).astype(np.uint64)
    assert pd._least(values, n).tolist() == [i + int(values[i : i + n].argmin()) for i in range(40 - n + 1)]


def test_phrases_of_the_automaton_are_in_every_window():
    coded = ["".join(map(chr, range(1, 80)))]
    phrases = pd.phrase_automaton(coded, [(0, i) for i in (*range(30), 40, 41)], 20)
    for i in (*range(30), 40, 41):
        assert list(phrases.iter(coded[0][i : i + 20]))
    assert all(len(p) >= pd.GRAM for p in phrases.keys())
