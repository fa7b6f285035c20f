import random

import pytest
from fixtures import frame, text
from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import near_copies, simhash
from gridweave.operators.graph import components


def row(i, body):
    return (i, body, "en", "src", len(body or ""), "x", "y", 5, 6, "z", 7, 8, 9)


def sets(body, n=5):
    words = (body or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def similarity(a, b):
    return len(sets(a) & sets(b)) / len(sets(a) | sets(b))


def planted():
    """Clean texts, and copies with words changed: 24 at 0.8 or more, 24 well below."""
    rng = random.Random(5)
    rows = [row(k, text(rng, 300)) for k in range(60)]
    near, far = [], []
    for k in range(48):
        words = rows[k][1].split()
        for at in rng.sample(range(10, 290), rng.randint(2, 5) if k < 24 else 40):
            words[at] = "changed"
        (near if k < 24 else far).append(row(1000 + k, " ".join(words)))
    return rows, near, far


def test_stage_drops_planted_near_copies_only(spark):
    rows, near, far = planted()
    assert all(similarity(rows[k][1], near[k][1]) >= 0.8 for k in range(24))
    assert all(similarity(rows[24 + k][1], far[k][1]) < 0.7 for k in range(24))
    bits = [(simhash.fingerprint(rows[k][1].encode(), 3) ^ simhash.fingerprint(near[k][1].encode(), 3)).bit_count() for k in range(24)]
    assert max(bits) > 2
    docs = frame(spark, rows + near + far)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.schema == docs.schema
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows + far}


def test_crowded_bucket_of_several_groups(spark, monkeypatch):
    """Every text is in one bucket: leaders settle them all."""
    rows, near, far = planted()
    crowd = [row(2000 + k, rows[0][1] + f" tail{k}") for k in range(30)]
    docs = frame(spark, rows[:30] + near[:20] + crowd)
    monkeypatch.setattr(near_copies, "SPREAD", 4)
    named = docs.select("doc_id", near_copies._node(near_copies._bytes("text")).alias("node"))
    edges = near_copies.links(named.selectExpr("node", "array(1L) as keys"), docs)
    groups = components(edges).join(named, "node").groupBy("root").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    want = [[0, 1000, *range(2000, 2030)]] + [[k, 1000 + k] for k in range(1, 20)]
    assert sorted(x["ids"] for x in groups) == want


def brute(bodies):
    """Components of pairs of similarity 0.8 or more."""
    root = list(range(len(bodies)))
    for b in range(len(bodies)):
        for a in range(b):
            if similarity(bodies[a], bodies[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return root


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [4, 1])
def test_crowded_bucket_asks_few_pairs_and_loses_no_link(spark, monkeypatch, crowd):
    """One bucket of copies from near to far, of versions of the text, of texts without a copy and of short ones."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    version, other = edited(rng, base, 12).split(), edited(rng, base, 14).split()
    bodies = [edited(rng, base, k % 13) for k in range(110)] + [edited(rng, version, k % 5) for k in range(30)] + [edited(rng, other, 2 + k % 3) for k in range(20)]
    bodies += [" ".join(base[: 120 - k]) for k in range(0, 60, 4)] + [text(rng, 100) for _ in range(10)] + ["a b", "b", "a b c d e f", "", "A  B"]
    bodies = list(dict.fromkeys(bodies))
    docs = frame(spark, [row(k, body) for k, body in enumerate(bodies)])
    named = docs.select("doc_id", near_copies._node(near_copies._bytes("text")).alias("node"))
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "SPREAD", 16)
    asked, judged = [], near_copies._judged
    monkeypatch.setattr(near_copies, "_judged", lambda pairs, *rest: asked.append(pairs.count()) or judged(pairs, *rest))
    edges = near_copies.links(named.selectExpr("node", "array(1L) as keys"), docs)
    groups = components(edges).join(named, "node").groupBy("root").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    want = {}
    for k, root in enumerate(brute(bodies)):
        want.setdefault(root, []).append(k)
    assert sorted(x["ids"] for x in groups) == sorted(x for x in want.values() if len(x) > 1)
    assert sum(asked) <= 2 * len(bodies)


def test_crowded_group_keeps_few_keys(spark, monkeypatch):
    """Differences that no other row of a crowded group has are not all made keys; copies among the far rows are still found."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    bodies = [edited(rng, base, k % 4 if k % 10 == 0 else 5 + k % 4) for k in range(160)]
    bodies += [edited(rng, bodies[k].split(), 1) for k in range(1, 160, 8)]
    bodies = list(dict.fromkeys(bodies))
    docs = frame(spark, [row(k, body) for k, body in enumerate(bodies)])
    named = docs.select("doc_id", near_copies._node(near_copies._bytes("text")).alias("node"))
    written, materialise = {}, near_copies.materialise

    def counted(made, label, **options):
        out = materialise(made, label, **options)
        size = F.sum(F.size("items")) if label == "differences" else F.count(F.lit(1))
        written[label] = written.get(label, 0) + out.agg(size).first()[0]
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    edges = near_copies.links(named.selectExpr("node", "array(1L) as keys"), docs)
    groups = components(edges).join(named, "node").groupBy("root").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    want = {}
    for k, root in enumerate(brute(bodies)):
        want.setdefault(root, []).append(k)
    assert sorted(x["ids"] for x in groups) == sorted(x for x in want.values() if len(x) > 1)
    assert written["keyed"] < 0.5 * written["differences"]


def test_odd_rows(spark):
    rng = random.Random(1)
    one = text(rng, 80)
    rows = [row(1, one), row(2, one.upper()), row(3, None), row(4, ""), row(5, " \n"), row(6, "a b"), row(7, "A  b"), row(8, "b a"), row(None, one), row(9, "c")]
    kept = [x["doc_id"] for x in near_copies.drop_near_copies(frame(spark, rows)).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 6, 8, 9] and kept.count(None) == 1
    assert near_copies.drop_near_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 2000])
def test_shingles_and_jaccard(n):
    body = " ".join(str(k % 700) for k in range(n))
    other = body + " one more"
    mine, theirs = near_copies.shingles(body.encode()), near_copies.shingles(other.encode())
    assert len(mine) == len(sets(body)) and near_copies.jaccard(mine, theirs) == similarity(body, other)


def test_covering_tables_propose_and_the_check_decides(spark):
    rng = random.Random(7)
    body = text(rng, 400)
    rows = [row(1, body), row(2, body + " end"), row(3, text(rng, 400)), row(4, "a b"), row(5, "A  b")]
    docs = frame(spark, rows)
    named = near_copies.signatures(docs, "doc_id", "text", 5)
    ids = {x["node"]: x["id"] for x in named.collect()}
    edges = near_copies.simhash_links(named.select("node", "fp"), docs, "text", 5, 0.8).collect()
    assert {frozenset((ids[x["u"]], ids[x["v"]])) for x in edges} == {frozenset((1, 2)), frozenset((4, 5))}
    fps = {x["id"]: x["fp"] for x in named.collect()}
    for i, a, *_ in rows:
        hashes = near_copies.shingle_hashes(a.encode()).tolist()
        assert fps[i] % (1 << 64) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
