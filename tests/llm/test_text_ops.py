import hashlib
import math
import random
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridweave.llm import bpe, html_text, quality, suffix_dedup

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def key(x):
    return str(x)


# ---- BPE --------------------------------------------------------------------------------------


def test_encode_and_decode_as_the_library(spark):
    rows = documents()
    got = bpe.decode(bpe.encode(frame(spark))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, bpe.encode(frame(spark), decoded=True).collect()), key=key)
    want = []
    for row in rows:
        ids = LIBRARY.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], ids, LIBRARY.decode(ids, skip_special_tokens=False)))
    assert sorted(((x["id"], np.frombuffer(x["ids"], "<u4").tolist(), x["text"]) for x in got), key=key) == sorted(want, key=key)


def test_encode_without_rows(spark):
    assert bpe.decode(bpe.encode(frame(spark, []))).count() == 0


@pytest.fixture
def tiny(monkeypatch):
    """Small pieces, so that short texts take every way that long ones do."""
    monkeypatch.setattr(bpe, "LEAF", 5)
    monkeypatch.setattr(bpe, "WINDOW", 1)
    monkeypatch.setattr(bpe, "CHUNK", 16)
    return bpe.vocabulary("byte_bpe_50k.json")


def pieces_encoded(v, text):
    """What the tasks of a long text do, one after the other."""
    sections = {}
    for section, special, payload in bpe.cut(v, text):
        sections.setdefault(section, []).append(np.frombuffer(payload, "<u4") if special else v.encode_text(payload.decode()))
    return np.concatenate([v.join_all(x) for x in sections.values()]).tolist()


@pytest.mark.parametrize("leaf,window", [(5, 1), (24, 2), (60, 8)])
def test_tree_concatenation_is_exact(tiny, monkeypatch, leaf, window):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "WINDOW", window)
    rng = random.Random(leaf)
    alphabets = ["ab", "etaoin shrdlu", "aé漢 \n", "'s l!l\"9 ", "   \n\t x", "\x1c\x85 a", "th<|endoftext|>", "re've 'll d", "a \u00a0\u3000b"]
    for k in range(1500):
        alphabet = alphabets[k % len(alphabets)]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90 if k % 5 else 600)))
        if k % 9 == 0:
            text = text[:20] + "<|endoftext|>" + text[20:]
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert tiny.encode(text).tolist() == want and pieces_encoded(tiny, text) == want, repr(text)


@pytest.mark.parametrize("text", ["ab" * 40000, "x" + " " * 50000 + "y", "!?" * 30000 + "'s", "é" * 30000, "word " * 20000, "a" * 9000 + " b c " + "d" * 9000])
def test_long_unsplit_text(text):
    v = bpe.vocabulary("byte_bpe_50k.json")
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert v.encode(text).tolist() == want and pieces_encoded(v, text) == want


def test_texts_of_the_tables_are_joined(spark, small_dir, monkeypatch):
    """Real joins: many, nearly all settled by a window, and none of them changes a token."""
    v, count = bpe.vocabulary("byte_bpe_50k.json"), {"join": 0, "unsplit": 0}
    join, unsplit = bpe.Vocabulary.join, bpe.Vocabulary._join_unsplit

    def counted(name, f):
        def run(*args):
            count[name] += 1
            return f(*args)

        return run

    monkeypatch.setattr(bpe.Vocabulary, "join", counted("join", join))
    monkeypatch.setattr(bpe.Vocabulary, "_join_unsplit", counted("unsplit", unsplit))
    texts = [x["text"] or "" for x in spark.read.parquet(f"{small_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        assert v.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert count["join"] > 50 and count["unsplit"] < count["join"] / 10


# ---- quality ----------------------------------------------------------------------------------


def naive_score(net, text):
    """Convolution, pooling and combination in plain loops."""
    data, s = text or b"\0", net.s
    half = s.chunk // 2
    logits = []
    for at in range(0, max(1, len(data) - half), half):
        pooled = []
        for f in range(s.filters):
            best = -math.inf
            for i in range(at, min(at + s.chunk, len(data))):
                taps = [float(net.taps[k, data[i + k], f]) for k in range(s.width) if i + k < len(data) and data[i + k]]
                best = max(best, float(net.bias[f]) + sum(taps))
            pooled.append(max(best, 0.0))
        logits.append(sum(x * float(w) for x, w in zip(pooled, net.out)) + float(net.out_bias[0]))
    p = [1 / (1 + math.exp(-z)) for z in logits]
    a, b, c = net.combine
    return 1 / (1 + math.exp(-(a * sum(p) / len(p) + b * min(p) + c)))


def test_scores_of_a_naive_network(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 64)
    rng = random.Random(9)
    texts = [bytes(rng.choices(b"abc \0\xc3", k=n)) for n in (0, 1, 7, 8, 15, 16, 17, 24, 63, 64, 65, 300)]
    net = quality.Network(quality.Settings(chunk=16, filters=3, steps=8, batch=4))
    net.fit(texts, np.array([k % 2 for k in range(len(texts))], dtype=np.float32))
    assert net.constant is None
    for text in texts:
        assert net.score(text) == pytest.approx(naive_score(net, text), abs=1e-5)


def test_every_byte_counts():
    net = quality.Network(quality.Settings())
    net.taps[:] = 0
    net.taps[0, ord("#"), 0] = 5
    net.out[:] = 0
    net.out[0] = 1
    for at in (0, 511, 512, 70_000, quality.SEGMENT - 1, quality.SEGMENT, 99_999):
        data = bytearray(b"a" * 100_000)
        data[at] = ord("#")
        assert net.chunk_logits(bytes(data)).max() == 5
    assert net.chunk_logits(b"a" * 100_000).max() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 17, 24, 25, 100])
def test_chunks_cover_the_text(n):
    starts = list(quality.chunk_starts(n, 16))
    assert starts[0] == 0 and starts[-1] + 16 >= n and all(b - a == 8 for a, b in zip(starts, starts[1:]))


def labelled(spark, n=240):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = [rng.choice(["the", "stone", "river", "falls", "and", "under"]) for _ in range(80)]
        docs.append((k, " ".join(words) if good else "!! ".join(words).upper()))
        labels.append((k, int(good), 0))
    labels += [(None, 1, 0), (5000, None, 0), (5001, 7, 1), (0, 1, 0)]
    extra = [(1000, None), (1001, ""), (None, "the river"), (1000, None)]
    return spark.createDataFrame(docs + extra, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    net = quality.train(docs, labels, quality.Settings(steps=120))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    scored = quality.score(docs, net).withColumn("held", held).collect()
    assert len(scored) == 244 and all(0 <= x["score"] <= 1 for x in scored)
    tested = [(x["score"] >= 0.7) == (x["id"] % 3 > 0) for x in scored if x["held"] and x["id"] is not None and x["id"] < 240]
    assert len(tested) > 30 and all(tested)
    kept = quality.keep_good(docs.withColumn("score", F.lit(1)), net)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {x["doc_id"] for x in kept.where("doc_id < 240").collect()} == {k for k in range(240) if k % 3}


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    s = quality.Settings()
    ids = [x["id"] for x in quality.training_rows(docs, labels, s, "doc_id", "text", "quality").select("id").distinct().collect()]
    import zlib

    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    few = quality.training_rows(docs, labels, quality.Settings(rows_per_class=5), "doc_id", "text", "quality")
    assert few.select("id").distinct().count() <= 10


def test_columns_of_clashing_names_and_a_long_text(spark):
    docs, labels = labelled(spark)
    long = spark.createDataFrame([(7000, "the river falls " * 100_000)], "doc_id long, text string")
    docs = docs.unionByName(long).withColumns({"id": F.lit(1), "label": F.lit(2), "score": F.lit(3), "held_out": F.lit(True)})
    labels = labels.withColumn("id", F.lit(1)).withColumn("label", F.lit(0))
    net = quality.train(docs, labels, quality.Settings(steps=120))
    scored = {x["id"]: x["score"] for x in quality.score(docs, net).where("id in (0, 1, 7000)").collect()}
    assert scored[0] < 0.7 <= min(scored[1], scored[7000])
    assert quality.keep_good(docs, net).columns == docs.columns


def test_sampled_bytes_are_bounded(spark):
    docs, labels = labelled(spark)
    texts = []

    class Spy(quality.Network):
        def fit(self, got, marks):
            texts.extend(got)
            return super().fit(got, marks)

    original, quality.Network = quality.Network, Spy
    try:
        quality.train(docs, labels, quality.Settings(steps=5, sample_bytes=3000))
    finally:
        quality.Network = original
    assert texts and sum(map(len, texts)) <= 3000


def test_nothing_to_learn_from(spark):
    docs, labels = labelled(spark)
    assert quality.score(docs.limit(3), quality.train(docs, labels.where("false"))).select("score").distinct().collect() == [(1.0,)]
    assert quality.score(docs.limit(3), quality.train(docs, labels.where("quality = 0"))).select("score").distinct().collect() == [(0.0,)]
    assert quality.score(docs.where("false"), quality.Network(quality.Settings())).count() == 0


# ---- HTML -------------------------------------------------------------------------------------

LONG = "Some words of an article that go on for quite a while, as they do. " * 3


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("<html></html>", ""),
        ("plain text &amp; more", "plain text & more"),
        (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p><p>Two&nbsp;&lt;b&gt;</p></article><footer>f</footer></body>", f"T\n\n{LONG.strip()}\n\nTwo <b>"),
        (f"<body><article><p><b>{LONG}<br><p>Next\n  line</article><div class='comments'><p>{LONG}</p></div>", f"{LONG.strip()}\n\nNext line"),
        (f"<main><header><h1>Title</h1></header><p>{LONG}</p><form>Name <input></form><aside>{LONG}</aside></main>", f"Title\n\n{LONG.strip()}"),
        (f"<div id=page><header>Top</header><div><p>{LONG}</p><p>{LONG}</p></div><aside>{LONG}</aside></div>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}<script>if (a < b) x('</p>')</script><style>p{{}}</style><!-- <p>no</p> --> end</p></article>", f"{LONG}end"),
        (f"<article><ul><li>one<li>two</ul><p>a<i>b</i>c</p>{LONG}</article>", f"one\n\ntwo\n\nabc\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><p>2 < 3 and <3", f"{LONG.strip()}\n\n2 < 3 and <3"),
        (f"<article><p>{LONG}</p><!-- never ended <p>x</p>", LONG.strip()),
        (f"<article><p>{LONG}</p></b></div></p>tail</article>", f"{LONG.strip()}\n\ntail"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_deep_nesting_is_read():
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_links_make_a_part_less_dense():
    menu = "".join(f"<li><a href=/{k}>entry number {k}</a></li>" for k in range(40))
    html = f"<body><div><ul>{menu}</ul></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.main_text(html) == "\n\n".join([LONG.strip()] * 3)


@pytest.mark.parametrize(
    "part,want",
    [
        (f'<section id="related-work"><p>{LONG}</p></section>', LONG.strip()),
        ('<div class="share-price-table"><p>42 points</p></div>', "42 points"),
        ('<p class="notice-board-history">Boards of wood.</p>', "Boards of wood."),
        ("<p>where <math><mi>x</mi></math> is small</p>", "where x is small"),
        ("<p>press <button>OK</button> now</p>", "press OK now"),
        ("<div><a href=1>Buy now</a> | <a href=2>Click</a> | <a href=3>More</a></div>", None),
        (f"<article><p>{LONG}</p></article>", None),
        ("<p>See <a href=1>one</a> and <a href=2>two</a></p>", "See one and two"),
        ("<p><a href=1>The paper</a></p>", "The paper"),
        (f"<form><p>{LONG}</p></form><aside>{LONG}</aside><nav>{LONG}</nav><script>{LONG}</script>", None),
    ],
)
def test_parts_of_an_article(part, want):
    """What stays and goes inside an article: by tags and density, never by names."""
    html = f"<body><div class=ad>{LONG}</div><article><h1>T</h1><p>{LONG}</p>{part}<p>Last.</p></article><div><p>{LONG}</p></div></body>"
    assert html_text.main_text(html) == "\n\n".join(x for x in ("T", LONG.strip(), want, "Last.") if x)


def test_the_denser_of_two_articles():
    html = f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p><p>{LONG}</p></article></body>"
    assert html_text.main_text(html) == f"{LONG.strip()}\n\n{LONG.strip()}"


def test_sections_without_an_article():
    """Neighbours over the threshold are text; a lone block beside the core is not."""
    two = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    html = f"<body><div><div>{''.join(f'<p>{LONG}</p>' for _ in range(4))}</div>{two}</div><div>{LONG}</div></body>"
    assert html_text.main_text(html) == "\n\n".join([LONG.strip()] * 6)


class Tree(HTMLParser):
    """A plain tree of a well-formed page."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.nodes = [("html", [])]
        self.open = [self.nodes[0]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        self.nodes.append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def naive_densities(html):
    """Counts and composite densities by recursion over a tree, each element for itself."""
    tree = Tree(html)

    def counts(node, linked):
        c = t = lc = lt = 0
        for child in node[1]:
            if isinstance(child, str):
                c += len(child.strip())
                lc += len(child.strip()) if linked else 0
            elif child[0] not in ("nav", "footer", "aside", "form"):
                got = counts(child, linked or child[0] == "a")
                c, t, lc, lt = c + got[0], t + got[1] + 1, lc + got[2], lt + got[3] + (child[0] == "a")
        return c, t, lc, lt

    def linked_nodes(node, linked, skipped, out):
        linked, skipped = linked or node[0] == "a", skipped or node[0] in ("nav", "footer", "aside", "form")
        out.append((node, linked, skipped))
        for child in node[1]:
            if not isinstance(child, str):
                linked_nodes(child, linked, skipped, out)
        return out

    everything = linked_nodes(tree.nodes[0], False, False, [])
    page = counts(tree.nodes[0], False)
    share = page[2] / max(1, page[0])

    def composite(c, t, lc, lt):
        if not c:
            return 0.0
        plain = max(1, c - lc)
        inner = math.log((c / plain) * max(1, lc) + (share * c) + math.e)
        return (c / max(1, t)) * max(0.0, math.log((c / max(1, lc)) * (max(1, t) / max(1, lt)), inner))

    dense = {id(n): 0.0 if s else composite(*counts(n, k)) for n, k, s in everything}
    total = []
    for node, linked, skipped in everything:
        own = sum(len(x.strip()) for x in node[1] if isinstance(x, str))
        mine = 0.0 if skipped else composite(own, 1, own if linked else 0, 1)
        total.append(mine + sum(dense[id(x)] for x in node[1] if not isinstance(x, str)) if not skipped else 0.0)
    return [dense[id(n)] for n, _, _ in everything], total


def test_densities_of_a_naive_tree():
    rng = random.Random(12)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randint(0, 30)
        tag = rng.choice(["div", "section", "a", "b", "span", "nav", "em", "footer"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(60):
        html = "<body>" + "".join(part(5) for _ in range(4)) + "</body>"
        got, want = html_text.Page(html).densities(), naive_densities(html)
        assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_a_page_of_megabytes():
    html = "<body><article>" + f"<p>{LONG}</p>" * 8000 + "</article></body>"
    assert html_text.main_text(html) == "\n\n".join([LONG.strip()] * 8000)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", f"<p>{LONG}</p>", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=key)
    assert got == sorted([(1, "u", LONG.strip())] * 2 + [(2, None, ""), (None, "v", "")], key=key)
    assert html_text.extract(pages.where("false")).count() == 0


# ---- repeated strings -------------------------------------------------------------------------


def brute_removed(texts, length):
    seen = {}
    for text in texts:
        for i in range(len(text) - length + 1):
            seen[text[i : i + length]] = seen.get(text[i : i + length], 0) + 1
    out = []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def rows_of(got):
    return sorted(((x["id"], x["n_bytes"], x["starts"], x["ends"], bytes(x["kept"])) for x in got), key=key)


def brute_rows(ids, texts, length):
    want = []
    for i, text, gone in zip(ids, texts, brute_removed([(t or "").encode() for t in texts], length)):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(int))).tolist()
        data = np.frombuffer((text or "").encode(), np.uint8)
        want.append((i, len(data), edges[::2], edges[1::2], data[~gone].tobytes()))
    return sorted(want, key=key)


@pytest.mark.parametrize("length,bits", [(1, None), (7, None), (16, None), (50, None), (200, None), (21, 3), (200, 3)])
def test_removed_bytes(spark, monkeypatch, length, bits):
    """Blocks and buckets of a few hundred bytes; with ``bits``, keys of different strings clash all the time."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 600)
    for name in ("SAMPLES", "SUFFIXES", "STRINGS"):
        monkeypatch.setattr(suffix_dedup, name, 3000)
    if bits:
        monkeypatch.setattr(suffix_dedup, "SAMPLE_BITS", bits)
        monkeypatch.setattr(suffix_dedup, "SUFFIX_BITS", bits)
    rng = random.Random(length)
    shared = "".join(rng.choices("abcd", k=90))
    texts = ["".join(rng.choices("abcd", k=rng.choice([0, 1, 30, 200]))) for _ in range(30)]
    texts += [texts[5] + shared, shared + texts[6], "é" * 60, shared, shared, "x" * 120, None, ""]
    # Passages in texts longer than a block, at every distance from the blocks' ends, and near copies.
    passage = "".join(rng.choices("abcdefgh", k=450))
    texts += ["".join(rng.choices("abcdefgh", k=n)) + passage[k : k + 330] + "".join(rng.choices("abcdefgh", k=900)) for k, n in enumerate((0, 1, 180, 399, 400, 401, 599, 600, 700))]
    texts += [passage[:k] + "!" + passage[k + 1 :] for k in (3, 120, 224, 225, 440)]
    rows = [(k if k != 3 else None, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3)
    assert rows_of(suffix_dedup.remove_repeats(docs, length=length).collect()) == brute_rows([r[0] for r in rows], texts, length)


def test_removed_bytes_of_the_tables(spark, small_dir):
    """The query's own length and cover, on the texts of the smallest tables."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("id"), F.lit(2).alias("digest"))
    rows = docs.collect()
    assert rows_of(suffix_dedup.remove_repeats(docs).collect()) == brute_rows([r[0] for r in rows], [r[1] for r in rows], 200)


def test_very_long_text(spark):
    """A text of several blocks that repeats itself and shares a passage with a short one."""
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 5 << 20, dtype=np.uint8)
    long[4_000_000:4_001_000] = long[1_000_000:1_001_000]
    cut = 2 << 20
    docs = spark.createDataFrame([(1, long.tobytes().decode()), (2, long[cut - 150 : cut + 150].tobytes().decode())], "doc_id long, text string")
    got = {x["id"]: x for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1]["starts"] == [1_000_000, cut - 150, 4_000_000] and got[1]["ends"] == [1_001_000, cut + 150, 4_001_000]
    gone = np.zeros(len(long), bool)
    for a, b in zip(got[1]["starts"], got[1]["ends"]):
        gone[a:b] = True
    assert bytes(got[1]["kept"]) == long[~gone].tobytes() and bytes(got[2]["kept"]) == b""


def test_repeats_without_rows(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11])
def test_difference_cover(q):
    v, cover = suffix_dedup.difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))
    with pytest.raises(ValueError):
        suffix_dedup.difference_cover(4)


def test_names_go_by_the_bytes():
    import zstandard

    data = bytes(random.Random(1).choices(b"ab", k=3000))
    block = suffix_dedup.Block(zstandard.compress(data), [3000])
    block.measure()
    for length in (1, 5, 8, 12, 68, 200):
        names = block.names(np.arange(len(data) - length + 1), length)
        strings = [data[i : i + length] for i in range(len(names))]
        assert len(set(strings)) == len(set(zip(strings, names.tolist()))) == len(set(names.tolist()))


def test_kept_digest_of_whole_copies(spark):
    docs = spark.createDataFrame([(1, "z" * 300), (2, "z" * 300), (3, "short"), (4, "short")], "doc_id long, text string")
    got = {x["id"]: x for x in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1]["starts"] == [0] and got[1]["ends"] == [300] and bytes(got[2]["kept"]) == b""
    assert bytes(got[3]["kept"]) == b"short" and hashlib.sha256(bytes(got[4]["kept"])).hexdigest() == hashlib.sha256(b"short").hexdigest()
