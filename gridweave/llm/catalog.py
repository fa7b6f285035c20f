"""The operators for training data as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, exact_dedup, html_text, mixing, phrase_dedup, quality, simhash, suffix_dedup, token_alignment, topk, url_filter, vector_codes, warc
from gridweave.llm.text import table
from gridweave.plans.staging import materialise


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placement of a document in the mix, with its source's exponent and weight."""
    target = mixing.Target(max_repetition=4.0)
    counts = materialise(mixing.token_counts(table(spark, sf_dir, "documents")), "counts")
    sources = mixing.weights(counts, target)
    placed = mixing.placements(counts, sources, target).join(sources.select("mark", "exponent", "weight"), "mark")
    return placed.select(
        F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block", F.col("at").alias("token_offset"), "mix_key", "exponent", "weight"
    )


#: The rules that the query judges by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))
    return judged.select("page.page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


OP2_SQL = """
WITH r(verdict, rhost, rpath) AS (
    VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
        ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), p AS (
    SELECT row_number() OVER () AS n, page_id,
        coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), m AS (
    SELECT n, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
        arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
    FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fate of every document under exact de-duplication; the largest doc_id stays."""
    made = exact_dedup.dedup_decisions(table(spark, sf_dir, "documents"), keep="largest")
    return made.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    decoded = bpe.encode(table(spark, sf_dir, "documents"), vocab="byte_bpe_50k.json", decoded=True)
    return decoded.select(F.col("id").alias("doc_id"), *bpe.digests(decoded))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the network fitted on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    return quality.score(docs, network).select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= network.s.threshold, 1).otherwise(0).alias("predicted"),
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of the largest inner product with each vector whose id is divisible by 50."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), scale=256)
    return topk.top_k(vectors.where("id % 50 = 0"), vectors, k=5)


OP7_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when bytes under strings of 200 bytes that start elsewhere too go."""
    made = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return made.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold that are written from every page and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP9_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS x, strlen(coalesce(html, '')) AS n,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages
)
SELECT page_id, n AS payload_bytes, sha256(x) AS payload_digest,
    CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash component of every document: three-word shingles, two bits or fewer apart."""
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return made.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector, with its error, its label's error and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 4) -> str:
    """A round is a pair of views: places of the nearest entries, and their means. Whole numbers in doubles are exact here."""
    out = ["""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n, vec_id, label,
        list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT n, part, w[part * (len(w) // 4) + 1 : (part + 1) * (len(w) // 4)] AS x FROM v, range(4) AS r(part)
), b0 AS MATERIALIZED (SELECT part, n AS entry, x AS c FROM p WHERE n < 256)"""]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
    SELECT n, part, any_value(x) AS x, min([d, entry])[2] AS entry, CAST(min(d) AS BIGINT) AS d
    FROM (SELECT n, part, x, entry, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM p JOIN b{k} USING (part))
    GROUP BY n, part
)""")
        if k < rounds:
            out.append(f"""m{k} AS MATERIALIZED (
    SELECT part, entry, list(floor(total / count) ORDER BY place) AS mean
    FROM (SELECT part, entry, place, sum(value) AS total, count(*) AS count
        FROM (SELECT part, entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM a{k}) GROUP BY part, entry, place)
    GROUP BY part, entry
), b{k + 1} AS MATERIALIZED (SELECT part, b.entry, coalesce(mean, c) AS c FROM b{k} b LEFT JOIN m{k} USING (part, entry))""")
    return ", ".join(out) + f""", s AS (
    SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(c) AS value, generate_subscripts(c, 1) AS place FROM b{rounds})
), e AS (
    SELECT n, lower(string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a{rounds} GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e USING (n), s
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers align in every document, and how common its linked pairs are in all of them."""
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), vocab="byte_bpe_50k.json", pieces="piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = token_alignment.with_counts(aligned.select("row", "id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when words under windows of 20 words that start earlier too go."""
    made = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents"), length=20)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return made.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS n, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), w AS (SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
x AS (
    SELECT n, i, word, count(*) OVER ahead AS held, list(word) OVER ahead AS phrase
    FROM w WINDOW ahead AS (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), y AS (SELECT n, i, word, held = 20 AND row_number() OVER (PARTITION BY phrase ORDER BY n, i) > 1 AS again FROM x),
z AS (SELECT n, i, word, bool_or(again) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM y),
k AS (
    SELECT n, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM z GROUP BY n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_temperature_mix": op1_temperature_mix,
    "op2_url_filter": op2_url_filter,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_topk": op7_topk,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_phrase_dedup": op13_phrase_dedup,
}
SQL = {"op2_url_filter": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op7_topk": OP7_SQL, "op9_warc": OP9_SQL, "op11_vector_codes": _op11_sql(), "op13_phrase_dedup": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
