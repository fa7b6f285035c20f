import random

import pytest
import xxhash
from fixtures import documents, frame, lowered
from pyspark.sql import functions as F

from gridweave.llm import exact_dedup, simhash


def groups_of(rows, key):
    out = {}
    for row in rows:
        out.setdefault(key(row), []).append(row)
    return out


@pytest.mark.parametrize("keep,weak", [("largest", False), ("smallest", True)])
def test_exact_decisions(spark, keep, weak):
    rows = documents()
    digest = (lambda text: F.substring(exact_dedup.sha256(text), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.dedup_decisions(frame(spark), keep=keep, digest=digest).collect()
    best = max if keep == "largest" else min
    want = []
    for group in groups_of(rows, lambda r: lowered(r[1])).values():
        ids = [r[0] for r in group]
        known = [i for i in ids if i is not None]
        keep_id = best(known) if known else None
        want += [(i, keep_id, len(ids), i == keep_id) for i in ids]
    assert sorted((tuple(x[:4]) for x in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_keeps_one_row_of_each_text(spark, weak):
    digest = (lambda text: F.substring(exact_dedup.sha256(text), 1, 1)) if weak else exact_dedup.sha256
    docs = frame(spark)
    kept = exact_dedup.exact_dedup(docs, digest=digest)
    assert kept.schema == docs.schema
    texts = [lowered(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in documents()})


def test_exact_without_rows(spark):
    assert exact_dedup.dedup_decisions(frame(spark, [])).count() == 0
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_index_merges_runs(spark):
    """Runs are flushed, looked up through their filters and compacted, more than once."""
    rng = random.Random(2)
    index = exact_dedup.DigestIndex(spark, fanout=3)
    seen, counts = {}, []
    for _ in range(5):
        batch = [(f"d{rng.randint(0, 60)}", rng.randint(0, 999)) for _ in range(40)]
        frame_ = spark.createDataFrame(batch, "digest string, id long")
        known = {x["digest"] for x in index.lookup(frame_.select("digest").distinct()).collect()}
        assert known == {d for d, _ in batch} & set(seen)
        index.append(frame_)
        counts.append(len(index.runs))
        for d, i in batch:
            low, high, n = seen.get(d, (i, i, 0))
            seen[d] = (min(low, i), max(high, i), n + 1)
    assert counts == [1, 2, 1, 2, 1]
    assert {x[0]: tuple(x[1:]) for x in index.compact().rows.collect()} == seen
    assert {x["digest"] for x in index.hits().collect()} == {d for d, x in seen.items() if x[2] > 1}
    assert exact_dedup.DigestIndex(spark).hits().count() == 0


def test_copies_of_a_hot_group_are_not_shuffled(spark):
    rows = [(k, "the same text", "en", "s", 1, "x", "y", 5, 6, "z", 7, 8, 9) for k in range(500)]
    kept = exact_dedup.exact_dedup(frame(spark, rows + documents()))
    assert [x["doc_id"] for x in kept.where("text = 'the same text'").collect()] == [499]


def brute_fingerprint(text, shingle=3):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in lowered(text)).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " ", "one", "one two", "A b\tC", "a b c d", "x " * 700, "é\u00a0ü ß\x1c z", "w" * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_counts_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "COUNT_BLOCK", 7)
    text = " ".join(str(k * k) for k in range(100))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_masks_cover_every_pair_of_bits():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m & ((1 << i) | (1 << j)) for m in masks)


def brute_components(pairs_of):
    """Smallest id reachable for ``[(id, fp)]``."""
    parent = list(range(len(pairs_of)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs_of)):
        for b in range(a):
            if (pairs_of[a][1] ^ pairs_of[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(pairs_of):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(pairs_of))]


def test_links_reach_all_near_pairs(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(25):  # chains, crowded buckets and lone ones
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12, 30])):
            fps.add(at)
            for _ in range(rng.choice([1, 2, 3])):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    from gridweave.operators.graph import components

    found = {x["node"]: x["root"] for x in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    labels = [found.get(s[0], s[0]) for s in signed]
    want = brute_components(list(enumerate(fps)))
    assert len(set(zip(labels, want))) == len(set(labels)) == len(set(want))


def test_near_duplicates(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark)).collect()
    fps = [(r[0], brute_fingerprint(r[1] or "")) for r in rows]
    want = sorted(((i, fp, c) for (i, fp), c in zip(fps, brute_components(fps))), key=str)
    assert sorted(((x["id"], x["fp"] % (1 << 64), x["component_id"]) for x in got), key=str) == want
    docs = frame(spark)
    kept = simhash.near_dedup(docs)
    assert kept.schema == docs.schema
    ids = [x["doc_id"] for x in kept.collect()]
    assert {i for i in ids if i is not None} == {c for _, _, c in want if c is not None} and ids.count(None) == 2


def test_near_without_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), radius=3)
