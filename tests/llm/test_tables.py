import hashlib
import math
import random

import pytest
from fixtures import documents, frame
from oracle import assert_same, connect
from pyspark.sql import functions as F

from gridweave.llm import catalog, mixing, topk, url_filter, warc


def key(x):
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, small_dir, name):
    assert_same(catalog.queries()[name](spark, small_dir), connect(small_dir), catalog.oracle_sql()[name])


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{k}" for k in range(1, 14)]


# ---- mixing -----------------------------------------------------------------------------------


def mix(spark, rows, target):
    docs = frame(spark, rows)
    counts = mixing.token_counts(docs)
    sources = mixing.weights(counts, target)
    return docs, sources.collect(), mixing.placements(counts, sources, target).collect()


def check_placements(rows, sources, placed, target):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(len((row[1] or "").split()))
    total = {s: sum(x) for s, x in by_source.items()}
    filled = {s: t for s, t in total.items() if t}
    exponent = sources[0]["exponent"]
    scale = sum(t**exponent for t in filled.values())
    for s in sources:
        tokens = total[s["source"]]
        assert s["tokens"] == tokens
        assert s["weight"] == pytest.approx(tokens**exponent / scale if tokens else 0)
        mine = sorted((p for p in placed if p["source"] == s["source"]), key=lambda p: (p["at"], p["n_tokens"]))
        for epoch in range(1, s["whole"] + 1):
            assert sum(p["epoch"] == epoch for p in mine) == len(by_source[s["source"]])
        used = [p for p in mine if p["n_tokens"]]
        assert all(b["at"] == a["at"] + a["n_tokens"] for a, b in zip(used, used[1:]))
        spent = sum(p["n_tokens"] for p in used)
        longest = max(by_source[s["source"]])
        assert s["budget"] - longest < spent <= s["budget"] or not tokens


@pytest.mark.parametrize("target", [mixing.Target(max_repetition=2.0, block_tokens=64), mixing.Target(None, 0.95, block_tokens=64), mixing.Target(3.0, None, 5000, 64)])
def test_mix(spark, monkeypatch, target):
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = documents()
    _, sources, placed = mix(spark, rows, target)
    check_placements(rows, sources, placed, target)
    filled = [s for s in sources if s["tokens"]]
    if target.max_repetition:
        assert max(s["budget"] / s["tokens"] for s in filled) <= target.max_repetition * (1 + 1e-6)
    if target.entropy_share:
        h = -sum(s["weight"] * math.log(s["weight"]) for s in filled)
        assert h == pytest.approx(target.entropy_share * math.log(len(filled)), rel=1e-6)
    if target.budget_tokens is None:  # every document at least once
        assert len({(p["id"], p["source"]) for p in placed}) == len({(r[0], r[3]) for r in rows})


@pytest.mark.parametrize("target", [mixing.Target(max_repetition=2.5, block_tokens=64), mixing.Target(None, None, 700, 64), mixing.Target(3.0, None, 5000, 64)])
def test_mixed_rows_are_the_placements(spark, target):
    """Null and repeated ids, one id in two sources, and ties included."""
    rows = documents()
    again = rows[0][:3] + ("src2",) + rows[0][4:]
    rows += [again] + [rows[5]] * 5 + [(None, "the same words", "en", "src1", *rows[0][4:])] * 6
    docs, _, placed = mix(spark, rows, target)
    made = mixing.mixed(docs, target)
    assert made.schema == docs.schema
    got, want = {}, {}
    for x in made.collect():
        name = (x["doc_id"], x["source"], len((x["text"] or "").split()))
        got[name] = got.get(name, 0) + 1
    for p in placed:
        name = (p["id"], p["source"], p["n_tokens"])
        want[name] = want.get(name, 0) + 1
    assert got == want and (target.budget_tokens != 700 or any(i is None for i, *_ in want))


def whole_epochs(rows, sources, target):
    """Placements and tokens of each source's whole epochs, from the weights and plain sums."""
    out = {}
    for s in sources:
        mine = [len((r[1] or "").split()) for r in rows if r[3] == s["source"]]
        times = math.floor(s["weight"] * target.budget_tokens + 1e-6) // sum(mine) if sum(mine) else 1
        out[s["source"]] = (times * len(mine), times * sum(mine))
    return out


def test_whole_epochs(spark):
    rows, target = documents(), mixing.Target(3.0, None, 5000, 64)
    _, sources, placed = mix(spark, rows, target)
    for source, (n, tokens) in whole_epochs(rows, sources, target).items():
        whole = next(s["whole"] for s in sources if s["source"] == source)
        mine = [p for p in placed if p["source"] == source and p["epoch"] <= whole]
        assert len(mine) == n and sum(p["n_tokens"] for p in mine) == tokens


def test_mix_of_a_very_long_text(spark):
    rows = documents(n=3)[:3] + [(50, "word " * 400_000, "en", "src0", 9, "x", "y", 5, 6, "z", 7, 8, 9)]
    target = mixing.Target(max_repetition=2.0)
    docs, sources, placed = mix(spark, rows, target)
    check_placements(rows, sources, placed, target)
    assert mixing.mixed(docs, target).count() == len(placed)


def test_mix_without_rows(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    _, sources, placed = mix(spark, [], mixing.Target())
    assert sources == [] and placed == []


# ---- URLs -------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fits.append((len(rule), len(rule_host.split(".")), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


RULES = [*catalog.URL_RULES, ("block", "sub.example.com"), ("allow", "a.b.c.net/"), ("block", "x/1/2"), ("block", "never.seen/")]


def urls():
    rng = random.Random(6)
    hosts = ["example.com", "SUB.Example.COM", "a.b.c.net", "y.a.b.c.net", "org", "my.org", "x", "notexample.com", "", "h:80", "com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71/b", "/de/8", "/es/", "/1/2", "/1/2/3"]
    made = ["http://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#f", "?a://b"]) for _ in range(150)]
    return [*made, None, "", "no scheme/en/", "://", "http://org/es/\nx", "http://" + "a." * 3000 + "com/en/" + "p" * 9000]


@pytest.mark.parametrize("max_bytes", [64 << 20, 1])
def test_rules(spark, max_bytes):
    rows = [(k, u, "p", "j") for k, u in enumerate(urls())] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, page string, judged string")
    rules = url_filter.rule_table(spark, RULES + RULES[:1])
    got = url_filter.judge(pages, rules, max_bytes=max_bytes).select("page.page_id", "judged.*").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((k, *brute_verdict(u, RULES)) for k, u, *_ in rows), key=key)


def test_rules_of_many_kinds(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "UNROLLED_KINDS", 3)
    rows = list(enumerate(urls()))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, RULES)).select("page.page_id", "judged.*").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((k, *brute_verdict(u, RULES)) for k, u in rows), key=key)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 9 == 0)
    made = url_filter.build_cascade(universe, 3000, listed, "block", 1 << 20)
    assert len(made.levels) > 1
    import numpy as np

    rows = universe.select("key", *[url_filter.level_hash(F.col("key"), k).alias(f"h{k}") for k in range(len(made.levels))]).toPandas()
    got = made.lists([rows[f"h{k}"].to_numpy().view(np.uint64) for k in range(len(made.levels))])
    assert set(rows.key[got]) == {x["key"] for x in listed.collect()}


def test_rules_for_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://org/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert url_filter.judge(pages, none).select("judged.*").collect() == [("org", "/es/", None, "allow")]
    assert url_filter.judge(pages.where("false"), url_filter.rule_table(spark, RULES)).count() == 0
    assert url_filter.keep_allowed(pages, url_filter.rule_table(spark, RULES)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, url_filter.rule_table(spark, [("allow", "org/"), ("block", "org/")]))


# ---- top k ------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(rng.choice([0, 3, 5]))]) for k in range(60)]
    rows += [(k, [0.5, 0.5, 0.5]) for k in range(100, 130)]  # ties
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [9.0]), (204, [1.0]), (204, [1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("weights", F.lit(1)))
    got = topk.top_k(vectors.where("id % 10 = 0 or id = 204"), vectors, k=4, block=16, query_block=3).collect()
    import numpy as np

    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in usable if i % 10 == 0 or i == 204}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_and_none(spark):
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    vectors = topk.quantised(one)
    assert topk.top_k(vectors, vectors).count() == 0
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0
    big = spark.createDataFrame([(1, [4e9]), (2, [4e9])], "id long, x array<double>").select("id", F.transform("x", lambda x: x.cast("long")).alias("weights"))
    with pytest.raises(Exception):
        topk.top_k(big, big.withColumn("weights", F.array(F.lit(1 << 40)))).collect()


def test_components_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.quantised(rows).collect()
    rows = spark.createDataFrame([(1, [9e15]), (2, [-9e15])], "vec_id long, embedding array<double>")
    assert [x["weights"] for x in topk.quantised(rows).sort("id").collect()] == [[9 * 10**15 * 256], [-9 * 10**15 * 256]]


# ---- WARC -------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_round_trip(spark, chunk):
    big, exact, under = "x\r\n\r\n" * 300, "e" * 100, "u" * 99
    rows = [(5, "u", big), (3, "http://a b\r\nX: y", big), (None, None, big), (7, "é", exact), (6, "u", exact), (8, "u", under), (9, "u", under)]
    rows += [(10, "u", None), (11, "u", ""), (12, "u", "ü" * 70), (3, "v", big), (13, "u", "solo" * 50)]
    rows += [(k, "hot", big) for k in range(100, 160)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, record int, digest string").repartition(2)
    got = warc.round_trip(pages, chunk_bytes=chunk).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((r[0] for r in rows if r[2] == html and r[0] is not None), default=None)
        refers = first if len(data) >= 100 and i != first else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_damaged_archives_are_noticed():
    reader = warc.RecordReader()
    chunks = list(warc.record_chunks("1", "u", memoryview(b"payload" * 30), 210, hashlib.sha256(b"payload" * 30).hexdigest(), None, 50))
    assert len(chunks) == 5
    reader.feed(0, chunks[0][2], chunks[0][3])
    with pytest.raises(ValueError):
        reader.result()
    with pytest.raises(ValueError):
        reader.feed(2, chunks[2][2], chunks[2][3])
    reader = warc.RecordReader()
    with pytest.raises(ValueError):
        reader.feed(0, chunks[0][2][:-1] + b"?", chunks[0][3])


def test_ids_that_are_no_numbers(spark):
    rows = [("b >\r\nx: é", "u", "p" * 100), ("none", "u", "p" * 100), ("", "u", "q" * 100), (None, "u", "p" * 100)]
    got = warc.round_trip(spark.createDataFrame(rows, "name string, url string, html string"), id_col="name").select("id", "record_type", "refers_to").collect()
    want = [(rows[0][0], "response", None), ("none", "revisit", rows[0][0]), ("", "response", None), (None, "revisit", rows[0][0])]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_payloads_of_hot_revisits_are_not_joined(spark):
    pages = spark.createDataFrame([(k, "u", "same" * 100) for k in range(50)] + [(99, "u", "other" * 50)], "page_id long, url string, html string")
    made = warc.decided(pages, "page_id", "url", "html", 100).collect()
    assert sorted((x["id"], len(x["payload"])) for x in made if x["payload"]) == [(0, 400), (99, 250)]
    assert {x["n_bytes"] for x in made} == {400, 250}


def test_archive_without_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
