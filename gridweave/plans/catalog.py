"""Queries over the driver's tables, each with an equivalent DuckDB statement.

Bindings: the sparse matrix A is lineitem, supplier by part, with summed quantities; its sizes are the
numbers of suppliers and parts. B is part's size. The benchmark log is events: user as matrix, event
type as method, value as time, ``view`` as baseline. Tiles are 16 by 64, panels 8 rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import hybrid, linalg, matrix, patterns, results, structure
from gridweave.operators.order_statistics import medians

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

HEIGHT, WIDTH, PANEL = 16, 64, 8

A_SQL = "(SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
M_SQL, K_SQL = "(SELECT count(*) FROM supplier)", "(SELECT count(*) FROM part)"
#: One row for each user and method: the median of its values.
LOG_SQL = "(SELECT user_id, event_type AS name, median(value) AS time FROM events GROUP BY 1, 2)"


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is any."""

    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            filled = sql.replace("{A}", A_SQL).replace("{M}", M_SQL).replace("{K}", K_SQL).replace("{LOG}", LOG_SQL)
            _SQL[function.__name__] = filled
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.coalesce(matrix.coo(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_quantity"))


def sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()


def part_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.lit(0).alias("c"), F.col("p_size").alias("w"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return medians(events.withColumnRenamed("event_type", "name"), ["user_id", "name"], "value", "time")


def mined_sql(height: int) -> str:
    """Different patterns of A's panels of ``height`` rows and how many columns have each."""
    return f"(SELECT pattern, count(*) AS cnt FROM (SELECT CAST(bit_or(1 << CAST(i % {height} AS INTEGER)) AS INTEGER) AS pattern FROM {A_SQL} GROUP BY i // {height}, j) GROUP BY 1)"


def mined(spark: SparkSession, sf_dir: str, height: int) -> DataFrame:
    return patterns.codes(matrix_a(spark, sf_dir), height).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))


def r(column, places: int = 6):
    return F.round(column, places)


# ---- products ---------------------------------------------------------------------------------

_SPMM = "SELECT a.i, CAST(sum(a.v * p.p_size) AS DOUBLE) AS c FROM {A} a JOIN part p ON a.j = p.p_partkey GROUP BY a.i"


@query(_SPMM)
def spmm_coord(spark, d):
    return linalg.spmm(matrix_a(spark, d), part_b(spark, d), "coord").select("i", F.col("x").alias("c"))


@query(
    """SELECT a.i, CAST(sum(a.v * p.p_size) AS DOUBLE) AS c0, CAST(sum(a.v * (p.p_size % 7)) AS DOUBLE) AS c1
    FROM {A} a JOIN part p ON a.j = p.p_partkey GROUP BY a.i"""
)
def spmm_vector(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.array(F.col("p_size"), F.col("p_size") % 7).alias("row"))
    made = linalg.spmm(matrix_a(spark, d), b, "vector")
    return made.groupBy("i").agg(*[F.max(F.when(F.col("c") == k, F.col("x"))).alias(f"c{k}") for k in (0, 1)])


@query(_SPMM)
def spmm_blocked(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("j"), F.array("p_size").alias("row"))
    return linalg.spmm(matrix_a(spark, d), b, "blocked", height=64, depth=1024).select("i", F.col("x").alias("c"))


@query(_SPMM)
def spmm_pattern(spark, d):
    mapping = patterns.greedy_mapping(spark, PANEL, [1 << b for b in range(PANEL)] + [0b11, 0b1100, 0b110000, 0b11000000, 255])
    return linalg.spmm(matrix_a(spark, d), part_b(spark, d), "pattern", mapping=mapping, height=PANEL).select("i", F.col("x").alias("c"))


@query(_SPMM)
def spmm_hybrid_split(spark, d):
    return linalg.spmm(matrix_a(spark, d), part_b(spark, d), "hybrid", height=HEIGHT, width=WIDTH, threshold=0.26).select("i", F.col("x").alias("c"))


@query(_SPMM)
def spmm_delta(spark, d):
    return linalg.spmm(matrix_a(spark, d), part_b(spark, d), "delta").select("i", F.col("x").alias("c"))


@query(
    """SELECT vec_id AS i, c, round(sum(w * ((j * (c + 1)) % 5)), 3) AS x
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS w, unnest(range(len(embedding))) AS j FROM embeddings), range(2) t(c) GROUP BY 1, 2"""
)
def gemm_dense(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row"))
    b = spark.range(64).select(F.col("id").cast("int").alias("j"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("c"))
    b = b.withColumn("w", ((F.col("j") * (F.col("c") + 1)) % 5).cast("double"))
    return linalg.gemm(a, b).select("i", "c", r("x", 3).alias("x"))


@query("""SELECT count(*) AS entries, 0 AS wrong FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def verify_tolerance(spark, d):
    a, b = matrix_a(spark, d), part_b(spark, d)
    checked = linalg.compare(linalg.spmm_coord(a, b), linalg.spmm_hybrid(a, b, HEIGHT, WIDTH, 0.26))
    return checked.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("ok")).cast("int").alias("wrong"))


@query(
    f"""WITH x AS ({_SPMM}) SELECT i, c AS "left", CASE WHEN i % 3 = 0 THEN c + 1 ELSE c END AS "right"
    FROM x WHERE i % 3 = 0 ORDER BY i LIMIT 32"""
)
def mismatch_topk(spark, d):
    x = linalg.spmm_coord(matrix_a(spark, d), part_b(spark, d))
    y = x.withColumn("x", F.when(F.col("i") % 3 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return linalg.mismatches(linalg.compare(x, y)).select("i", "left", "right")


@query(f"SELECT sum(abs(c)) AS l1 FROM ({_SPMM})")
def l1_norm(spark, d):
    return linalg.l1_norm(linalg.spmm_coord(matrix_a(spark, d), part_b(spark, d)))


@query(
    """WITH n AS (SELECT i, count(*) AS n FROM {A} GROUP BY 1), p AS (SELECT i, n, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum(n) OVER () AS t FROM n) SELECT CAST(least(floor(b * 4 / t), 3) AS INTEGER) AS part, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM p GROUP BY 1"""
)
def weight_partition(spark, d):
    rows = matrix_a(spark, d).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return linalg.weight_partition(rows, "i", "n", 4).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("weight"))


# ---- matrix forms -----------------------------------------------------------------------------


@query("SELECT j AS i, i AS j, v FROM {A}")
def transpose(spark, d):
    return matrix.transpose(matrix_a(spark, d))


@query("SELECT i, j, v FROM {A} WHERE i >= j UNION ALL SELECT j, i, v FROM {A} WHERE i > j")
def symmetric_mirror(spark, d):
    return matrix.mirror(matrix_a(spark, d).where("i >= j"))


@query("SELECT l_returnflag AS matrix_id, l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3")
def coalesce(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "matrix_id")
    return matrix.coalesce(matrix.coo(rows, "l_suppkey", "l_partkey", "l_quantity", ["matrix_id"]), ["matrix_id"])


@query("SELECT line, (SELECT count(*) FROM {A} WHERE i < line) AS ptr FROM (SELECT unnest(range({M} + 1)) AS line)")
def csr_row_ptr(spark, d):
    return matrix.pointers(matrix_a(spark, d), sizes(spark, d)[0], "i")


@query(
    """WITH n AS (SELECT j, count(*) AS n FROM {A} GROUP BY 1) SELECT line, CAST(coalesce(sum(n) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr
    FROM (SELECT unnest(range({K} + 1)) AS line) LEFT JOIN n ON j = line"""
)
def csc_col_ptr(spark, d):
    return matrix.pointers(matrix_a(spark, d), sizes(spark, d)[1], "j")


@query("SELECT i, j, j - lag(j, 1, 0) OVER (PARTITION BY i ORDER BY j) AS gap FROM {A}")
def xnn_delta_encode(spark, d):
    return matrix.delta_encode(matrix_a(spark, d))


@query(
    """SELECT line, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0), line) - 1 AS place
    FROM (SELECT unnest(range({K})) AS line) LEFT JOIN (SELECT j, count(*) AS n FROM {A} GROUP BY 1) ON j = line"""
)
def density_sort_perm(spark, d):
    return matrix.density_order(matrix_a(spark, d), sizes(spark, d)[1], "j")


# ---- tiles and structure ----------------------------------------------------------------------

_STATS = f"""SELECT i // {HEIGHT} AS ti, j // {WIDTH} AS tj, count(*) AS nnz, count(DISTINCT i) AS active_rows, count(DISTINCT j) AS active_cols,
    least({HEIGHT}, {{M}} - (i // {HEIGHT}) * {HEIGHT}) AS tile_h, least({WIDTH}, {{K}} - (j // {WIDTH}) * {WIDTH}) AS tile_w FROM {{A}} GROUP BY ti, tj, tile_h, tile_w"""
_TOTAL = f"(ceil({{M}} / {HEIGHT}.0) * ceil({{K}} / {WIDTH}.0))"


def _stats(spark, d):
    m, k = sizes(spark, d)
    return structure.tile_stats(matrix_a(spark, d), m, k, HEIGHT, WIDTH), structure.tile_count(m, k, HEIGHT, WIDTH)


@query(f"SELECT ti, tj, nnz FROM ({_STATS})")
def tile_nnz(spark, d):
    return _stats(spark, d)[0].select("ti", "tj", "nnz")


@query(f"SELECT ti, tj, nnz, nnz / (tile_h * tile_w) AS density, active_rows / tile_h AS active_row_share, active_cols / tile_w AS active_col_share FROM ({_STATS})")
def tile_active(spark, d):
    return structure.tile_shares(_stats(spark, d)[0])


@query(
    f"""WITH s AS ({_STATS}), h AS (SELECT CAST(least(floor(nnz / (tile_h * tile_w) * 50), 49) AS INTEGER) AS bin FROM s)
    SELECT bin, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT bin, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT 0, {_TOTAL} - (SELECT count(*) FROM s)) GROUP BY 1 HAVING sum(n) > 0"""
)
def tile_density_hist50(spark, d):
    stats, total = _stats(spark, d)
    return structure.unit_histogram(structure.tile_shares(stats), "density", 50, total - stats.count())


_WS = f"""SELECT nnz / (tile_h * tile_w) * {2 * HEIGHT * WIDTH} + {HEIGHT} + active_rows / tile_h * {256 * HEIGHT} + active_cols / tile_w * {256 * WIDTH} AS ws FROM ({_STATS})"""


@query(f"WITH w AS ({_WS}), t AS (SELECT {_TOTAL} AS n) SELECT round(sum(ws) / n, 4) AS mean, round(sqrt(greatest(sum(ws * ws) / n - (sum(ws) / n) ** 2, 0)) / (sum(ws) / n), 6) AS cov FROM w, t GROUP BY n")
def working_set_cov_pop(spark, d):
    stats, total = _stats(spark, d)
    return structure.moments_with_zeros(structure.working_sets(stats, HEIGHT, WIDTH), "ws", total).select(r("mean", 4).alias("mean"), r("cov").alias("cov"))


@query(f"WITH w AS ({_WS}), t AS (SELECT {_TOTAL} AS n) SELECT round(sqrt(greatest(sum(ws * ws) - sum(ws) ** 2 / n, 0) / (n - 1)) / (sum(ws) / n), 6) AS cov FROM w, t GROUP BY n")
def working_set_cov_sample(spark, d):
    stats, total = _stats(spark, d)
    return structure.moments_with_zeros(structure.working_sets(stats, HEIGHT, WIDTH), "ws", total, sample=True).select(r("cov").alias("cov"))


_STORAGE = """WITH b AS (SELECT i // 4 AS ti, j // 4 AS tj, count(*) AS n FROM {A} GROUP BY 1, 2), s AS (SELECT count(*) AS blocks, CAST(sum(n) AS BIGINT) AS nnz FROM b) """


@query(_STORAGE + "SELECT nnz, CAST(blocks * 68 + (ceil({M} / 4.0) + 1) * 4 AS BIGINT) AS bsr_bytes FROM s")
def bsr_storage(spark, d):
    return structure.storage(matrix_a(spark, d), *sizes(spark, d), block=4).select("nnz", "bsr_bytes")


@query(_STORAGE + "SELECT nnz, nnz * 8 + ({M} + 1) * 4 AS csr_bytes, round((nnz * 8 + ({M} + 1) * 4) / ({M} * {K} * 4.0), 6) AS csr_share FROM s")
def csr_storage_pct(spark, d):
    return structure.storage(matrix_a(spark, d), *sizes(spark, d), block=4).select("nnz", "csr_bytes", r("csr_share").alias("csr_share"))


@query("SELECT max(n) * {M} - CAST(sum(n) AS BIGINT) AS padding FROM (SELECT count(*) AS n FROM {A} GROUP BY i)")
def ell_padding(spark, d):
    return structure.ell_padding(matrix_a(spark, d), sizes(spark, d)[0])


@query(
    """WITH a AS (SELECT i, j FROM {A}), r AS (SELECT count(*) AS n FROM a GROUP BY i), c AS (SELECT count(*) AS n FROM a GROUP BY j)
    SELECT (SELECT round(sqrt(sum(n * n) / {M} - (sum(n) / {M}) ** 2) / (sum(n) / {M}), 6) FROM r) AS row_cov,
        (SELECT round(sqrt(sum(n * n) / {K} - (sum(n) / {K}) ** 2) / (sum(n) / {K}), 6) FROM c) AS col_cov"""
)
def row_col_cov(spark, d):
    (m, k), a = sizes(spark, d), matrix_a(spark, d)
    row, col = structure.line_cov(a, m, "i").scalar(), structure.line_cov(a, k, "j").scalar()
    return spark.range(1).select(r(row).alias("row_cov"), r(col).alias("col_cov"))


_ROWS = f"SELECT i // {HEIGHT} AS ti, j // {WIDTH} AS tj, i, count(*) AS n FROM {{A}} GROUP BY 1, 2, 3"


@query(f"WITH t AS ({_ROWS}), s AS (SELECT sum(n) AS z FROM t) SELECT round(-sum(n / z * ln(n / z)) / ln(max(z)), 6) AS h_norm FROM t, s")
def entropy_hnorm(spark, d):
    return structure.entropy(structure.tile_rows(matrix_a(spark, d), HEIGHT, WIDTH)).select(r("h_norm").alias("h_norm"))


@query(
    f"""WITH t AS ({_ROWS}), s AS (SELECT sum(n) AS z FROM t), h AS (SELECT -sum(n / z * ln(n / z)) / ln(max(z)) AS h, count(*) AS r, max(z) AS z FROM t, s)
    SELECT round(r / ceil({{M}} / {HEIGHT}.0) / {{M}} * (z / {{M}}) * (1 - h), 5) AS ssf FROM h"""
)
def ssf(spark, d):
    return structure.spread_factor(matrix_a(spark, d), sizes(spark, d)[0], HEIGHT, WIDTH).select(r("ssf", 5).alias("ssf"))


@query(
    f"""WITH x AS (SELECT (nnz - active_cols) / nnz AS x FROM ({_STATS})), t AS (SELECT {_TOTAL} AS n)
    SELECT round(sum(x) / n, 6) AS col_ovl_mean, round((sum(x * x) / n - (sum(x) / n) ** 2) / (sum(x) / n), 6) AS col_ovl_spread FROM x, t GROUP BY n"""
)
def col_overlap(spark, d):
    stats, total = _stats(spark, d)
    return structure.column_overlap(stats, total).select(*[r(c).alias(c) for c in ("col_ovl_mean", "col_ovl_spread")])


@query(f"SELECT round(sum(CASE WHEN nnz > 0.26 * {HEIGHT * WIDTH} THEN nnz ELSE 0 END) / sum(nnz), 6) AS dense_ratio, count(*) FILTER (nnz > 0.26 * {HEIGHT * WIDTH}) AS dense_tiles FROM ({_STATS})")
def dense_tile_ratio(spark, d):
    return structure.dense_share(_stats(spark, d)[0], HEIGHT, WIDTH, 0.26).select(r("dense_ratio").alias("dense_ratio"), "dense_tiles")


@query(f"WITH t AS ({_ROWS}), p AS (SELECT max(n) * {HEIGHT} - sum(n) AS pad, sum(n) AS nnz FROM t GROUP BY ti, tj) SELECT round(sum(pad) / sum(nnz), 6) AS tile_ell_padding FROM p")
def tile_ell_padding(spark, d):
    return structure.tile_ell_padding(matrix_a(spark, d), HEIGHT, WIDTH).select(r("tile_ell_padding").alias("tile_ell_padding"))


@query(
    f"""WITH s AS ({_STATS}), f AS (SELECT nnz / {HEIGHT * WIDTH}.0 AS x FROM s), t AS (SELECT {_TOTAL} AS n)
    SELECT CAST({{M}} AS INTEGER) AS m, CAST({{K}} AS INTEGER) AS k, (SELECT count(*) FROM {{A}}) AS nnz, round(sum(x) / n, 6) AS tile_fill_mean,
        round(max(x), 6) AS tile_fill_max, CASE WHEN count(*) < n THEN 0 ELSE round(min(x), 6) END AS tile_fill_min, CAST(n - count(*) AS BIGINT) AS empty_tiles FROM f, t GROUP BY n"""
)
def matrix_properties(spark, d):
    made = structure.properties(matrix_a(spark, d), *sizes(spark, d), HEIGHT, WIDTH)
    return made.select("m", "k", "nnz", *[r(c).alias(c) for c in ("tile_fill_mean", "tile_fill_max", "tile_fill_min")], "empty_tiles")


@query(
    f"""WITH a AS (SELECT i, j FROM {{A}}), t AS ({_ROWS}), s AS ({_STATS}), z AS (SELECT {{M}} AS m, {{K}} AS k, count(*) AS nnz, {_TOTAL} AS tiles FROM a),
    rr AS (SELECT count(*) AS n FROM a GROUP BY i), cc AS (SELECT count(*) AS n FROM a GROUP BY j),
    rc AS (SELECT sqrt(greatest(sum(n * n) / max(m) - (sum(n) / max(m)) ** 2, 0)) / (sum(n) / max(m)) AS row_cov, max(n) * max(m) - sum(n) AS ell FROM rr, z), ck AS (SELECT sqrt(greatest(sum(n * n) / max(k) - (sum(n) / max(k)) ** 2, 0)) / (sum(n) / max(k)) AS col_cov FROM cc, z),
    h AS (SELECT (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(sum(n)) AS h_norm, count(*) AS r FROM t),
    f AS (SELECT sum(x) AS s1, sum(x * x) AS s2, max(x) AS hi, min(x) AS lo, count(*) AS filled, sum(o) AS o1, sum(o * o) AS o2, sum(CASE WHEN nnz > 0.35 * {HEIGHT * WIDTH} THEN nnz ELSE 0 END) / sum(nnz) AS dense_ratio, count(*) FILTER (nnz > 0.35 * {HEIGHT * WIDTH}) AS dense_tiles
        FROM (SELECT nnz, nnz / {HEIGHT * WIDTH}.0::DOUBLE AS x, (nnz - active_cols) / nnz AS o FROM s)),
    p AS (SELECT sum(pad) / sum(nnz) AS tile_ell_padding FROM (SELECT max(n) * {HEIGHT} - sum(n) AS pad, sum(n) AS nnz FROM t GROUP BY ti, tj))
    SELECT CAST(m AS INTEGER) AS m, CAST(k AS INTEGER) AS k, nnz, round(row_cov, 9) AS row_cov, round(col_cov, 9) AS col_cov, CAST(ell AS BIGINT) AS ell_padding, round(h_norm, 9) AS h_norm,
        round(r / ceil(m / {HEIGHT}.0) / m * (nnz / m) * (1 - h_norm), 9) AS ssf, round(s1 / tiles, 9) AS tile_fill_mean, round(sqrt(greatest(s2 / tiles - (s1 / tiles) ** 2, 0)) / (s1 / tiles), 9) AS tile_fill_cov, round(hi, 9) AS tile_fill_max,
        round(CASE WHEN filled < tiles THEN 0 ELSE lo END, 9) AS tile_fill_min, CAST(tiles - filled AS BIGINT) AS empty_tiles, round(o1 / tiles, 9) AS col_ovl_mean, round(greatest(o2 / tiles - (o1 / tiles) ** 2, 0) / (o1 / tiles), 9) AS col_ovl_spread,
        round(tile_ell_padding, 9) AS tile_ell_padding, round(dense_ratio, 9) AS dense_ratio, dense_tiles FROM z, rc, ck, h, f, p"""
)
def property_record(spark, d):
    """The whole record; its parts have queries of their own."""
    made = structure.properties(matrix_a(spark, d), *sizes(spark, d), HEIGHT, WIDTH)
    return made.select([r(c, 9).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


@query("WITH g AS (SELECT j - lag(j, 1, 0) OVER (PARTITION BY i ORDER BY j) AS gap FROM {A}) SELECT round(avg(gap), 6) AS avg_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM g")
def run_length_stats(spark, d):
    return structure.run_lengths(matrix_a(spark, d)).select(r("avg_gap").alias("avg_gap"), "min_gap", "max_gap")


_Q = "SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS q FROM {A}"


@query(f"WITH p AS ({_Q}) SELECT i, CAST(q AS INTEGER) AS q, next - j AS dj FROM (SELECT *, lead(i) OVER w AS below, lead(j) OVER w AS next FROM p WINDOW w AS (PARTITION BY q ORDER BY i)) WHERE below = i + 1")
def fopd_dim0(spark, d):
    return structure.row_differences(matrix_a(spark, d))


_STRIDES = """WITH s AS (SELECT i, j, lead(j) OVER w - j AS d FROM {A} WINDOW w AS (PARTITION BY i ORDER BY j)), c AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY i ORDER BY j) THEN 0 ELSE 1 END AS new FROM s WHERE d IS NOT NULL),
    g AS (SELECT *, sum(new) OVER (PARTITION BY i ORDER BY j) AS island FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY i, island ORDER BY j) - 1 AS pos FROM g),
    h AS (SELECT i, island, pos // 9 AS piece, count(*) AS n FROM p GROUP BY 1, 2, 3), b AS (SELECT CAST(least(n, 8) - 1 AS INTEGER) AS bin, count(*) AS cnt FROM h GROUP BY 1) """


@query(_STRIDES + "SELECT bin, cnt FROM b")
def fopd_dim1_hist(spark, d):
    return structure.stride_runs(matrix_a(spark, d), 8)


@query(_STRIDES + "SELECT bin, cnt, round(bin * cnt / sum(bin * cnt) OVER (), 6) AS share FROM b")
def hist_weight_normalise(spark, d):
    hist = structure.stride_runs(matrix_a(spark, d), 8).withColumn("matrix_id", F.lit("a"))
    return structure.weighted_shares(hist, "matrix_id").select("bin", "cnt", r("share").alias("share"))


_PAIRS = """WITH n AS (SELECT line AS i, line // 16 AS p, count(j) AS n FROM (SELECT unnest(range({M})) AS line) LEFT JOIN {A} ON i = line GROUP BY 1, 2),
    b AS (SELECT x.i AS i1, y.i AS i2, count(*) AS shared FROM {A} x JOIN {A} y ON x.i // 16 = y.i // 16 AND x.j = y.j AND x.i < y.i GROUP BY 1, 2),
    h AS (SELECT x.p, x.i AS i1, y.i AS i2, CAST(x.n + y.n - 2 * coalesce(shared, 0) AS BIGINT) AS hamming FROM n x JOIN n y ON x.p = y.p AND x.i < y.i LEFT JOIN b ON i1 = x.i AND i2 = y.i) """


@query(_PAIRS + "SELECT i1, i2, hamming FROM h")
def hamming_pairs(spark, d):
    """Hamming distance of every pair of rows that share a panel of 16, over the whole matrix."""
    return hamming_panels(spark, d).drop("p")


@query(_PAIRS + "SELECT p, i1, i2, hamming FROM h")
def hamming_panels(spark, d):
    """Hamming distance of every pair of rows inside each panel of 16 rows of the whole matrix."""
    pairs = structure.panel_pairs(matrix_a(spark, d), sizes(spark, d)[0], 16)
    return pairs.select("p", "i1", "i2", structure.hamming(F.col("both"), F.col("size1"), F.col("size2")).alias("hamming"))


@query("SELECT i // 16 AS p, round((count(*) - count(DISTINCT j)) / count(*), 6) AS overlap FROM {A} GROUP BY 1")
def overlap_panel(spark, d):
    return structure.panel_overlap(matrix_a(spark, d), 16).select("p", r("overlap").alias("overlap"))


@query(
    """WITH a AS (SELECT i, j FROM {A}), n AS (SELECT line AS i, count(j) AS n FROM (SELECT unnest(range({M})) AS line) LEFT JOIN a ON i = line GROUP BY 1),
    o AS (SELECT x.i, count(*) AS shared FROM a x JOIN a y ON y.i = x.i + 1 AND y.j = x.j GROUP BY 1),
    h AS (SELECT p.i, p.n + q.n - 2 * coalesce(shared, 0) AS h FROM n p JOIN n q ON q.i = p.i + 1 LEFT JOIN o ON o.i = p.i WHERE p.i // 16 = (p.i + 1) // 16)
    SELECT round(sum(h) / ceil({M} / 16.0), 6) AS avg_distance, CAST(sum(h) AS BIGINT) AS total_distance, CAST(ceil({M} / 16.0) AS INTEGER) AS num_panels, 16 AS panel_height FROM h"""
)
def panel_distance(spark, d):
    made = structure.panel_distances(matrix_a(spark, d), sizes(spark, d)[0], 16)
    return made.withColumn("avg_distance", r("avg_distance"))


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT i // 16 AS p, i, j FROM {A}), n AS MATERIALIZED (SELECT p, i, count(*) AS n FROM e GROUP BY 1, 2),
    b AS MATERIALIZED (SELECT x.i AS a, y.i AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.j = y.j AND x.i <> y.i GROUP BY 1, 2),
    d AS MATERIALIZED (SELECT x.p, x.i AS a, y.i AS b, x.n + y.n - 2 * coalesce(shared, 0) AS dist FROM n x JOIN n y ON x.p = y.p AND x.i <> y.i LEFT JOIN b ON b.a = x.i AND b.b = y.i),
    w AS (SELECT p, [min(i)] AS seen, min(i) AS i, 0 AS place FROM n GROUP BY p UNION ALL
        SELECT p, list_append(seen, k.b), k.b, place + 1 FROM (SELECT w.p, seen, place, min(struct_pack(dist := dist, b := b)) AS k FROM w JOIN d ON d.p = w.p AND d.a = w.i AND NOT list_contains(seen, d.b) GROUP BY w.p, seen, place))
    SELECT p, i, CAST(place AS INTEGER) AS place FROM w"""
)
def greedy_reorder(spark, d):
    return structure.greedy_order(matrix_a(spark, d), 16)


_DENSE = f"SELECT ti, tj, nnz FROM ({_STATS}) WHERE nnz > 0.25 * {HEIGHT * WIDTH}"
_RUNS = f"SELECT ti, min(tj) AS tj, count(*) AS tiles, CAST(sum(nnz) AS BIGINT) AS nnz FROM (SELECT *, tj - row_number() OVER (PARTITION BY ti ORDER BY tj) AS g FROM ({_DENSE})) GROUP BY ti, g"


def _dense(spark, d):
    return hybrid.dense_tiles(_stats(spark, d)[0], HEIGHT, WIDTH, 0.25)


@query(_RUNS)
def dense_row_rectangles(spark, d):
    return hybrid.row_rectangles(_dense(spark, d))


@query(
    f"""SELECT min(ti) AS ti, tj, count(*) AS rows, tiles, CAST(sum(nnz) AS BIGINT) AS nnz
    FROM (SELECT *, ti - row_number() OVER (PARTITION BY tj, tiles ORDER BY ti) AS g FROM ({_RUNS})) GROUP BY tj, tiles, g"""
)
def dense_merged_rectangles(spark, d):
    return hybrid.merged_rectangles(_dense(spark, d))


@query(
    f"""WITH s AS ({_STATS}), r AS (SELECT greatest(ceil({{M}} / {HEIGHT}.0) - 1 - ti, ceil({{K}} / {WIDTH}.0) - 1 - tj) AS ring, sum(nnz) AS nnz FROM s GROUP BY 1),
    h AS (SELECT ring, sum(nnz) OVER (ORDER BY ring) AS held FROM r) SELECT CAST(min(ring) + 1 AS BIGINT) AS side, CAST(min(held) AS BIGINT) AS nnz FROM h WHERE held >= 0.5 * (SELECT sum(nnz) FROM s)"""
)
def dense_corner_square(spark, d):
    m, k = sizes(spark, d)
    return hybrid.corner_square(_stats(spark, d)[0], -(-m // HEIGHT), -(-k // WIDTH), 0.5)


@query(
    f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (nnz > t * {HEIGHT * WIDTH}) AS dense_tiles, CAST(sum(CASE WHEN nnz > t * {HEIGHT * WIDTH} THEN nnz ELSE 0 END) AS BIGINT) AS dense_nnz,
    CAST(sum(CASE WHEN nnz > t * {HEIGHT * WIDTH} THEN {HEIGHT * WIDTH} - nnz ELSE 0 END) AS BIGINT) AS padding, round(sum(CASE WHEN nnz > t * {HEIGHT * WIDTH} THEN nnz ELSE 0 END) / sum(nnz), 6) AS dense_ratio
    FROM ({_STATS}), (VALUES (0.2), (0.25), (0.35)) v(t) GROUP BY 1"""
)
def hybrid_record(spark, d):
    made = hybrid.hybrid_record(_stats(spark, d)[0], HEIGHT, WIDTH, [0.2, 0.25, 0.35])
    return made.withColumn("dense_ratio", r("dense_ratio"))


# ---- patterns ---------------------------------------------------------------------------------

_CODES = f"SELECT i // {PANEL} AS p, j, CAST(bit_or(1 << CAST(i % {PANEL} AS INTEGER)) AS INTEGER) AS pattern FROM {{A}} GROUP BY 1, 2"
_HIST = f"SELECT pattern, count(*) AS cnt FROM ({_CODES}) GROUP BY 1 UNION ALL SELECT 0, CAST(ceil({{M}} / {PANEL}.0) * {{K}} AS BIGINT) - (SELECT count(*) FROM ({_CODES}))"


def _hist(spark, d):
    return patterns.histogram(matrix_a(spark, d), *sizes(spark, d), PANEL)


@query(_CODES)
def pattern_codes(spark, d):
    return patterns.codes(matrix_a(spark, d), PANEL)


@query(_HIST)
def pattern_hist(spark, d):
    return _hist(spark, d)


@query(f"WITH h AS ({_HIST}), b AS (SELECT CAST(bit_count(pattern) AS INTEGER) AS bits, CAST(sum(cnt) AS BIGINT) AS cnt FROM h GROUP BY 1) SELECT bits, cnt, round(bits * cnt / sum(bits * cnt) OVER (), 6) AS nnz_share FROM b")
def popcount_hist(spark, d):
    return patterns.by_popcount(_hist(spark, d)).select("bits", "cnt", r("nnz_share").alias("nnz_share"))


@query(f"SELECT p, CAST(bit_count(pattern) AS INTEGER) AS bits, count(*) AS cnt FROM ({_CODES}) GROUP BY 1, 2")
def panel_popcounts(spark, d):
    return patterns.panel_popcounts(matrix_a(spark, d), PANEL)


@query(f"SELECT x AS pattern, cnt, round(0.7 ** ({PANEL} - bit_count(x)) * 0.3 ** bit_count(x), 9) AS prob, '0b' || lpad(bin(x), {PANEL}, '0') AS text FROM (SELECT pattern AS x, cnt FROM {mined_sql(PANEL)})")
def pattern_prob_random(spark, d):
    return mined(spark, d, PANEL).select(
        "pattern", "cnt", r(patterns.random_probability(F.col("pattern"), 0.7, PANEL), 9).alias("prob"), patterns.text_of(F.col("pattern"), PANEL).alias("text")
    )


@query(
    f"""WITH h AS ({_HIST}), t AS (SELECT sum(cnt) AS t FROM h) SELECT CAST(x AS INTEGER) AS pattern,
    round(bit_count(x) * (coalesce(cnt, 0) / t - 0.7 ** ({PANEL} - bit_count(x)) * 0.3 ** bit_count(x)), 9) + 0.0 AS distance FROM (SELECT CAST(unnest(range(256)) AS INTEGER) AS x) LEFT JOIN h ON pattern = x, t"""
)
def distance_from_random(spark, d):
    return patterns.distance_from_random(_hist(spark, d), 0.7, PANEL).select("pattern", (r("distance", 9) + F.lit(0.0)).alias("distance"))


@query(f"SELECT pattern AS kernel, count(*) AS instances, CAST(sum(bit_count(pattern)) AS BIGINT) AS nnz, CAST(0 AS BIGINT) AS padding FROM ({_CODES}) GROUP BY 1")
def pattern_mapping_identity(spark, d):
    return patterns.kernel_counts(matrix_a(spark, d), patterns.identity_mapping(spark, PANEL), PANEL)


@query(
    f"""WITH c AS ({_CODES}), k AS (SELECT pattern & 15 AS low, pattern & 240 AS high FROM c),
    e AS (SELECT 15 AS kernel, low AS own FROM k WHERE low > 0 UNION ALL SELECT 240, high FROM k WHERE high > 0)
    SELECT kernel, count(*) AS instances, CAST(sum(bit_count(own)) AS BIGINT) AS nnz, CAST(sum(4 - bit_count(own)) AS BIGINT) AS padding FROM e GROUP BY 1"""
)
def pattern_padding(spark, d):
    halves = patterns.all_patterns(spark, PANEL).where("pattern > 0").select("pattern", F.array_compact(F.array(*[F.when(F.col("pattern").bitwiseAND(x) > 0, F.lit(x)) for x in (15, 240)])).alias("kernels"))
    return patterns.kernel_counts(matrix_a(spark, d), halves, PANEL)


@query(
    f"""WITH h AS ({_HIST}), s AS (SELECT pattern, cnt / (SELECT sum(cnt) FROM h) AS share FROM h WHERE pattern > 0)
    SELECT CAST(pattern % 15 AS INTEGER) AS subset_id, CAST(bit_or(pattern) AS INTEGER) AS "union", round(2.0 + sum(share) * 128.0 * (1.15 + 0.2 * bit_count(bit_or(pattern))), 6) AS cost FROM s GROUP BY 1"""
)
def subset_cost(spark, d):
    hist = _hist(spark, d)
    shares = hist.where("pattern > 0").select("pattern", (F.col("cnt") / hist.agg(F.sum("cnt")).scalar()).alias("share"))
    subsets = shares.select((F.col("pattern") % 15).alias("subset_id"), "pattern")
    return patterns.subset_costs(subsets, shares).withColumn("cost", r("cost"))


@query(f"WITH k AS (SELECT p, pattern, count(*) AS cols FROM ({_CODES}) GROUP BY 1, 2) SELECT p, round(5.0 + sum(2.0 + cols * (3.0 + 4.0 * bit_count(pattern))), 6) AS cost FROM k GROUP BY 1")
def panel_cost_model(spark, d):
    return patterns.panel_cost(matrix_a(spark, d), patterns.identity_mapping(spark, PANEL), PANEL).withColumn("cost", r("cost"))


@query(
    f"""WITH h AS (SELECT l_returnflag AS f, l_suppkey // {PANEL} AS p, l_partkey AS j, CAST(bit_or(1 << CAST(l_suppkey % {PANEL} AS INTEGER)) AS INTEGER) AS pattern FROM lineitem GROUP BY 1, 2, 3),
    c AS (SELECT f, pattern, count(*) AS n FROM h GROUP BY 1, 2), s AS (SELECT pattern, n / sum(n) OVER (PARTITION BY f) AS share FROM c)
    SELECT CAST(x AS INTEGER) AS pattern, round(coalesce(sum(share), 0) / (SELECT count(DISTINCT f) FROM c), 9) AS share FROM (SELECT unnest(range(256)) AS x) LEFT JOIN s ON pattern = x GROUP BY 1"""
)
def average_distribution(spark, d):
    rows = table(spark, d, "lineitem")
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_suppkey") % PANEL).cast("int"))
    codes = rows.groupBy("l_returnflag", F.floor(F.col("l_suppkey") / PANEL).alias("p"), "l_partkey").agg(F.bit_or(bit).alias("pattern"))
    hists = codes.groupBy(F.col("l_returnflag").alias("matrix_id"), "pattern").agg(F.count(F.lit(1)).alias("cnt"))
    return patterns.average_distribution(hists, "matrix_id", PANEL).select("pattern", r("share", 9).alias("share"))


@query(
    """WITH c AS (SELECT i // 2 AS p, j, CAST(bit_or(1 << CAST(i % 2 AS INTEGER)) AS INTEGER) AS pattern FROM {A} GROUP BY 1, 2), k AS (SELECT p, pattern, count(*) AS n FROM c GROUP BY 1, 2),
    f AS (SELECT p, sum(n)::DOUBLE AS x, sum(n * bit_count(pattern))::DOUBLE AS y, 5 + sum(2 + n * (3 + 4 * bit_count(pattern)))::DOUBLE AS z FROM k GROUP BY 1),
    g AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x * z) AS u, sum(y * z) AS v FROM f)
    SELECT 'cols' AS feature, round((u * c - v * b) / (a * c - b * b), 4) AS coefficient FROM g UNION ALL SELECT 'nnz', round((a * v - b * u) / (a * c - b * b), 4) FROM g"""
)
def lsq_cost_fit(spark, d):
    """Coefficients of cost over panel counts, by least squares; panels of two rows."""
    a = matrix_a(spark, d)
    cost = patterns.panel_cost(a, patterns.identity_mapping(spark, 2), 2)
    counts = [F.count(F.lit(1)).alias("cols"), F.sum(F.bit_count("pattern")).alias("nnz")]
    features = patterns.codes(a, 2).groupBy("p").agg(*counts)
    fit = patterns.least_squares(features.join(cost, "p"), ["cols", "nnz"], "cost")
    return spark.createDataFrame([(n, round(x, 4)) for n, x in zip(("cols", "nnz"), fit)], "feature string, coefficient double")


@query()
def set_cover(spark, d):
    """Cheapest exact cover of the four-row patterns by groups that share a union."""
    hist = patterns.histogram(matrix_a(spark, d), *sizes(spark, d), 4).where("pattern > 0").orderBy("pattern")
    shares = {x["pattern"]: x["cnt"] for x in hist.collect()}  # at most 15 rows
    total, seen = sum(shares.values()), sorted(shares)
    unions, counts, costs = [0], [0], [0.0]
    for mask in range(1, 1 << len(seen)):  # every group: its first pattern, and the rest before it
        pattern, rest = seen[(mask & -mask).bit_length() - 1], mask & (mask - 1)
        unions.append(unions[rest] | pattern)
        counts.append(counts[rest] + shares[pattern])
        costs.append(patterns.N_CHECK + counts[mask] / total * 128 * (patterns.N_BASE + patterns.N_ENTRY * unions[mask].bit_count()))
    chosen, cost = patterns.cheapest_partition(len(seen), costs)
    groups = sorted(([p for b, p in enumerate(seen) if mask >> b & 1] for mask in chosen), key=lambda g: (len(g), g))
    rows = [(k, g, round(cost, 6)) for k, g in enumerate(groups)]
    return spark.createDataFrame(rows, "group_id int, patterns array<int>, total_cost double")


@query(
    f"""WITH h AS (SELECT i // 4 AS p, j, CAST(bit_or(1 << CAST(i % 4 AS INTEGER)) AS INTEGER) AS pattern FROM {{A}} GROUP BY 1, 2), g AS (SELECT pattern, count(*) AS cnt FROM h GROUP BY 1)
    SELECT x.pattern AS a, y.pattern AS b, CAST(CASE WHEN x.pattern = y.pattern THEN 0 ELSE x.cnt * (bit_count(x.pattern | y.pattern) - bit_count(x.pattern)) + y.cnt * (bit_count(x.pattern | y.pattern) - bit_count(y.pattern)) END AS BIGINT) AS padding
    FROM g x JOIN g y ON x.pattern <= y.pattern"""
)
def group_pair_cost(spark, d):
    hist = patterns.codes(matrix_a(spark, d), 4).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    return patterns.group_pair_costs(hist.select(F.col("pattern").alias("group_id"), "pattern", "cnt"))


@query(f"SELECT x AS pattern, cnt, CAST(((x << 3) | (x >> 5)) & 255 AS INTEGER) AS shifted, list_filter(range(8), lambda b: (x >> b) & 1 = 1)::INTEGER[] AS rows FROM (SELECT pattern AS x, cnt FROM {mined_sql(PANEL)})")
def pattern_bits(spark, d):
    p = F.col("pattern")
    return mined(spark, d, PANEL).select(p, "cnt", patterns.cyclic_shift(p, 3, PANEL).alias("shifted"), patterns.rows_of(p, PANEL).alias("rows"))


@query(f"SELECT CAST(x AS INTEGER) AS pattern, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range(256)) AS x) LEFT JOIN {mined_sql(PANEL)} m ON m.pattern = x WHERE bit_count(x) = 3")
def patterns_of_bits(spark, d):
    """Every pattern of three rows of a panel, and how often the matrix has it."""
    return patterns.all_patterns(spark, PANEL, 3).join(mined(spark, d, PANEL), "pattern", "left").select("pattern", F.coalesce("cnt", F.lit(0)).alias("cnt"))


# ---- scalars ----------------------------------------------------------------------------------


@query(
    """SELECT l_returnflag AS f, count(DISTINCT (l_suppkey, l_partkey)) AS nnz, round(1 - count(DISTINCT (l_suppkey, l_partkey)) / ({M} * {K}), 6) AS sparsity
    FROM lineitem GROUP BY 1"""
)
def sparsity_props(spark, d):
    m, k = sizes(spark, d)
    nnz = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count_distinct("l_suppkey", "l_partkey").alias("nnz"))
    return nnz.select("f", "nnz", r(scalar.sparsity(F.col("nnz"), F.lit(m), F.lit(k))).alias("sparsity"))


@query("SELECT p_partkey, round(CASE WHEN p_size < 25 THEN -1 ELSE 1 END * greatest(p_size, 25) / least(p_size, 25), 6) AS aspect FROM part")
def aspect_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", r(scalar.aspect_ratio(F.col("p_size"), F.lit(25))).alias("aspect"))


@query("SELECT event_id, round(2 * 128 * 26214 / 1e9, 9) AS gflops, round(CASE WHEN value = 0 THEN NULL ELSE 2 * 128 * 26214 / 1e9 / (value / 1e6) END, 3) AS gflops_s FROM events")
def gflops(spark, d):
    n, nnz = F.lit(128), F.lit(26214)
    return table(spark, d, "events").select("event_id", r(scalar.gflops(n, nnz), 9).alias("gflops"), r(scalar.gflops_per_second(n, nnz, F.col("value")), 3).alias("gflops_s"))


@query("SELECT p_partkey, p_size % 9 AS m_r, p_size % 4 AS n_r, 'NKM' AS schedule, p_size % 2 = 0 AS load_balance, p_size AS tlb, 'orig' AS mapping FROM part")
def name_parse(spark, d):
    size = F.col("p_size")
    name = F.concat(
        F.lit("M"), (size % 9).cast("string"), F.lit("N"), (size % 4).cast("string"), F.lit("_NKM_"), F.when(size % 2 == 0, "LB_").otherwise(""), F.lit("TLB"), size.cast("string"), F.lit("_orig")
    )
    made = table(spark, d, "part").select("p_partkey", scalar.method_fields(name).alias("f"))
    return made.select("p_partkey", "f.m_r", "f.n_r", "f.schedule", "f.load_balance", "f.tlb", "f.mapping")


@query("SELECT p_partkey, p_size AS m_tile, p_size * 2 AS k_tile FROM part")
def config_parse(spark, d):
    config = scalar.config_map(F.concat(F.lit("m_tile:"), F.col("p_size").cast("string"), F.lit("|k_tile:"), (F.col("p_size") * 2).cast("string")))
    return table(spark, d, "part").select("p_partkey", config["m_tile"].cast("int").alias("m_tile"), config["k_tile"].cast("int").alias("k_tile"))


@query(
    r"""SELECT page_id, split_part(url, '/', -1) AS last, CASE WHEN len(string_split(url, '/')) >= 2 THEN string_split(url, '/')[-2] END AS before,
    regexp_replace(split_part(url, '/', -1), '\.s?mtx$', '') AS name, len(string_split(url, '/')) AS depth FROM pages"""
)
def path_split(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", scalar.path_part(url, -1).alias("last"), scalar.path_part(url, -2).alias("before"), scalar.matrix_name(url).alias("name"), F.size(F.split(url, "/")).cast("long").alias("depth")
    )


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)
    SELECT event_id, 'Base' AS name, 1 AS threads, round(value, 6) AS real_time, l AS layer, round(CAST(k AS DOUBLE) * l, 6) AS layer_time FROM e, (VALUES (1), (2)) t(l)"""
)
def json_layers(spark, d):
    """Timing records built from events' JSON, and read back as layers."""
    from gridweave.sources.logs import explode_layers

    k = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(
        F.struct(F.lit("Base/threads:1").alias("name"), F.col("value").cast("string").alias("real_time"), k.cast("string").alias("layer_1"), (k * 2).cast("string").alias("layer_2"), F.col("event_id").cast("string").alias("event_id"))
    )
    rows = table(spark, d, "events").select(F.from_json(record, "map<string,string>").alias("b"))
    # The map's event id travels in the name, as the record's keys become rows.
    named = rows.select(F.map_concat(F.map_filter("b", lambda key, _: key != "name"), F.create_map(F.lit("name"), F.concat(F.col("b")["event_id"], F.lit("/threads:1")))).alias("b"))
    made = explode_layers(named)
    return made.select(F.col("name").cast("long").alias("event_id"), F.lit("Base").alias("name"), "threads", r("real_time").alias("real_time"), "layer", r("layer_time").alias("layer_time"))


@query("SELECT event_id, CASE WHEN k + 7 = 0 THEN NULL ELSE round(k / (k + 7), 6) END AS hit_rate, round(7 / (k + 7), 6) AS miss_rate, CAST(k + 4 * 2 + 8 * 3 + 16 AS BIGINT) AS flops FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def cache_ratios(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    ratios = scalar.cache_ratios(k, F.lit(7))
    flops = scalar.vector_flops(k, F.lit(2), F.lit(3), F.lit(1))
    return table(spark, d, "events").select("event_id", *[r(c).alias(n) for n, c in ratios.items()], flops.alias("flops"))


# ---- results ----------------------------------------------------------------------------------


@query("SELECT user_id, name, time, round(b / nullif(time, 0), 6) AS speedup FROM (SELECT *, min(CASE WHEN name = 'view' THEN time END) OVER (PARTITION BY user_id) AS b FROM {LOG})")
def speedup_baseline(spark, d):
    return results.speedups(log(spark, d), ["user_id"], "view").withColumn("speedup", r("speedup"))


@query("SELECT user_id, name, time, round(b / nullif(time, 0), 6) AS speedup FROM (SELECT *, min(CASE WHEN contains(name, 'sign') THEN time END) OVER (PARTITION BY user_id) AS b FROM {LOG})")
def speedup_fallback(spark, d):
    return results.speedups(log(spark, d), ["user_id"], "dense", fallback="sign").withColumn("speedup", r("speedup"))


@query("SELECT user_id, name, time, row_number() OVER (PARTITION BY user_id ORDER BY time, name) = 1 AS is_best FROM {LOG}")
def best_idxmin(spark, d):
    return results.flag_first_best(log(spark, d), ["user_id"])


@query("SELECT user_id, name, time, time = min(time) OVER (PARTITION BY user_id) AS is_best FROM {LOG}")
def best_ties(spark, d):
    return results.flag_best(log(spark, d), ["user_id"])


@query(
    """SELECT user_id, name, time, coalesce(time = min(CASE WHEN contains(name, 'i') THEN time END) OVER w, false) AS best_of_subset,
    count(*) FILTER (contains(name, 'i')) OVER w AS num_subset FROM {LOG} WINDOW w AS (PARTITION BY user_id)"""
)
def best_subset(spark, d):
    return results.flag_subset_best(log(spark, d), ["user_id"], F.contains("name", F.lit("i")))


@query("WITH g AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS num_methods FROM {LOG}) SELECT * FROM g WHERE num_methods = (SELECT max(num_methods) FROM g)")
def group_size_filter(spark, d):
    return results.complete_groups(log(spark, d), ["user_id"])


@query(
    """SELECT l.user_id, l.name, l.time, f.fastest, coalesce(o.fastest, '') AS fastest_other FROM {LOG} l
    JOIN (SELECT user_id, arg_min(name, (time, name)) AS fastest FROM {LOG} GROUP BY 1) f USING (user_id)
    LEFT JOIN (SELECT user_id, arg_min(name, (time, name)) AS fastest FROM {LOG} WHERE name <> 'view' GROUP BY 1) o USING (user_id)"""
)
def fastest_name(spark, d):
    return results.fastest_names(log(spark, d), ["user_id"], without=["view"])


@query("SELECT name, cnt, round(cnt / sum(cnt) OVER (), 6) AS share FROM (SELECT event_type AS name, count(*) AS cnt FROM events GROUP BY 1)")
def value_counts_norm(spark, d):
    return results.value_shares(table(spark, d, "events").withColumnRenamed("event_type", "name"), "name").withColumn("share", r("share"))


_SPEED = "(SELECT user_id, name, time, min(CASE WHEN name = 'view' THEN time END) OVER (PARTITION BY user_id) / nullif(time, 0) AS speedup FROM {LOG})"


@query(f"SELECT name, round(exp(avg(ln(speedup))), 6) AS gmean, count(*) AS n FROM {_SPEED} WHERE speedup > 0 GROUP BY 1")
def gmean_speedup(spark, d):
    return results.geometric_means(results.speedups(log(spark, d), ["user_id"], "view"), ["name"]).withColumn("gmean", r("gmean"))


@query(
    f"""SELECT name, round(count(*) FILTER (speedup > 1) / count(*), 6) AS pct_faster,
    round(count(*) FILTER (speedup >= 1.5 AND user_id % 2 = 0) / nullif(count(*) FILTER (speedup >= 1.5), 0), 6) AS pct_much_inside FROM {_SPEED} GROUP BY 1"""
)
def pct_faster(spark, d):
    made = results.percent_faster(results.speedups(log(spark, d), ["user_id"], "view"), ["name"], F.col("user_id") % 2 == 0)
    return made.select("name", r("pct_faster").alias("pct_faster"), r("pct_much_inside").alias("pct_much_inside"))


METHODS = ["view", "click", "error", "signup", "purchase"]


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN name = '{m}' THEN time END) AS \"time|{m}\"" for m in METHODS) + " FROM {LOG} GROUP BY 1")
def pivot_methods(spark, d):
    return results.pivot_methods(log(spark, d), ["user_id"], METHODS, ["time"])


@query("SELECT p_partkey, CAST(b AS INTEGER) AS bcols, round(p_retailprice * b, 2) AS t FROM part, (VALUES (32), (128)) v(b)")
def unpivot_bcols(spark, d):
    wide = table(spark, d, "part").select("p_partkey", *[r(F.col("p_retailprice") * b, 2).alias(f"bCol={b}") for b in (32, 128)])
    long = results.unpivot_columns(wide, ["p_partkey"], ["bCol=32", "bCol=128", "bCol=256"], "bcols", "t")
    return long.withColumn("bcols", F.element_at(F.split("bcols", "="), -1).cast("int"))


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def drop_duplicates(spark, d):
    kept = results.keep_first(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"])
    return kept


_DENS = "(SELECT i, round(1 - count(*) / {K}, 6) AS s FROM {A} GROUP BY 1)"


def _row_sparsity(spark, d):
    k = sizes(spark, d)[1]
    return matrix_a(spark, d).groupBy("i").agg(r(1 - F.count(F.lit(1)) / F.lit(k)).alias("s"))


@query(f"SELECT i, s, CASE WHEN s > 0 AND s <= 0.7 THEN 0 WHEN s > 0.7 AND s <= 0.8 THEN 1 WHEN s > 0.8 AND s <= 0.9 THEN 2 WHEN s > 0.9 AND s <= 1 THEN 3 END AS bucket FROM {_DENS}")
def cut_right(spark, d):
    return _row_sparsity(spark, d).withColumn("bucket", scalar.bucket_right(F.col("s"), [0.0, 0.7, 0.8, 0.9, 1.0]))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0 AND l_discount < 0.03 THEN 0 WHEN l_discount >= 0.03 AND l_discount < 0.06 THEN 1 WHEN l_discount >= 0.06 AND l_discount < 0.09 THEN 2 END AS bucket, l_discount AS s FROM lineitem")
def cut_left(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.bucket_left(F.col("l_discount"), [0.0, 0.03, 0.06, 0.09]).alias("bucket"), F.col("l_discount").alias("s"))


@query("SELECT l_tax, CASE WHEN l_tax > 0.0 AND l_tax < 0.025 THEN 'low' WHEN l_tax > 0.045 AND l_tax < 0.065 THEN 'mid' END AS target, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def cut_targets(spark, d):
    near = scalar.near_target(F.col("l_tax"), {"low": (0.0, 0.025), "mid": (0.045, 0.065)})
    return table(spark, d, "lineitem").groupBy("l_tax", near.alias("target")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    """WITH c AS (SELECT l_partkey, stddev_pop(l_quantity) / avg(l_quantity) AS cov, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1)
    SELECT bucket, count(*) AS n, round(avg(x), 4) AS mean_price FROM (SELECT CASE WHEN cov >= 0.01 AND cov < 0.1 THEN 0 WHEN cov >= 0.1 AND cov < 1 THEN 1 WHEN cov >= 1 AND cov < 10 THEN 2 END AS bucket, x FROM c) GROUP BY 1"""
)
def cov_decades(spark, d):
    cov = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.stddev_pop("l_quantity") / F.avg("l_quantity")).alias("cov"), F.avg("l_extendedprice").alias("x"))
    return cov.groupBy(scalar.bucket_left(F.col("cov"), [0.01, 0.1, 1.0, 10.0]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("x"), 4).alias("mean_price"))


@query(f"SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n FROM {_DENS}, (VALUES (0.2), (0.25), (0.3), (0.5)) v(t) WHERE 1 - s <= t GROUP BY 1")
def density_thresholds(spark, d):
    rows = _row_sparsity(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.25, 0.3, 0.5)])))
    return rows.where(1 - F.col("s") <= F.col("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, bool_and(name <> 'error' OR time < 20) AND count(*) >= (SELECT count(DISTINCT name) FROM {LOG}) AS all_correct FROM {LOG} GROUP BY 1")
def all_correct(spark, d):
    flagged = log(spark, d).withColumn("correct", F.when((F.col("name") != "error") | (F.col("time") < 20), "correct").otherwise("incorrect"))
    return results.complete_and_correct(flagged, ["user_id"], "name")


_WINNERS = "SELECT user_id % 10 AS bucket, name FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, name) AS n FROM {LOG}) WHERE n = 1"


def _winners(spark, d):
    best = results.flag_first_best(log(spark, d), ["user_id"]).where("is_best")
    return best.select((F.col("user_id") % 10).alias("bucket"), "name")


@query(
    f"""WITH w AS ({_WINNERS}), c AS (SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, name) AS place FROM w GROUP BY 1, 2)
    SELECT bucket, string_agg(name, ',' ORDER BY place) AS methods FROM c WHERE place <= 6 GROUP BY 1"""
)
def heuristic_top6(spark, d):
    return results.top_winners(_winners(spark, d), ["bucket"], "name", 6).withColumn("methods", F.array_join("methods", ","))


@query(
    """WITH h(lo, hi, n, methods) AS (VALUES (0.0, 0.75, 32, 'a'), (0.0, 0.75, 128, 'b'), (0.75, 1.0, 32, 'c'), (0.75, 1.0, 512, 'd')), q AS (SELECT p_partkey AS id, (p_size % 10) / 10 AS s, p_size * 16 AS n FROM part)
    SELECT id, s, q.n, arg_max(methods, h.n) AS methods, max(h.n) AS rule_n FROM q LEFT JOIN h ON s > lo AND s <= hi AND h.n <= q.n GROUP BY 1, 2, 3"""
)
def heuristic_range_asof(spark, d):
    rules = spark.createDataFrame([(0.0, 0.75, 32, "a"), (0.0, 0.75, 128, "b"), (0.75, 1.0, 32, "c"), (0.75, 1.0, 512, "d")], "lo double, hi double, n int, methods string")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 10) / 10).alias("s"), (F.col("p_size") * 16).alias("n"))
    return results.heuristic_lookup(asked, rules)


@query(
    """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(sum(o_totalprice) OVER w / (count(*) OVER w), 4) AS ratio FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def cumulative_layers(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lit(1).alias("one"))
    made = results.cumulative(results.cumulative(rows, ["o_custkey"], "o_orderkey", "o_totalprice", "a"), ["o_custkey"], "o_orderkey", "one", "b")
    return made.select("o_custkey", "o_orderkey", r("a", 2).alias("running"), r(F.col("a") / F.col("b"), 4).alias("ratio"))


@query(
    """WITH g AS (SELECT user_id, event_type AS m_tile, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS k_tile, median(value) AS t FROM events GROUP BY 1, 2, 3)
    SELECT user_id, arg_min(t, (t, m_tile, k_tile)) AS median_time, arg_min(m_tile, (t, m_tile, k_tile)) AS m_tile, arg_min(k_tile, (t, m_tile, k_tile)) AS k_tile FROM g GROUP BY 1"""
)
def grid_cross_argmin(spark, d):
    runs = table(spark, d, "events").select("user_id", F.col("event_type").alias("m_tile"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("k_tile"), F.col("value").alias("time"))
    return results.tuned(runs, ["user_id"], ["m_tile", "k_tile"])


@query("SELECT CAST(m AS INTEGER) AS m_tile, s AS strategy, l_suppkey AS matrix FROM (VALUES (4), (8)) a(m), (SELECT DISTINCT l_returnflag AS s FROM lineitem) b, (SELECT DISTINCT l_suppkey FROM lineitem) c")
def experiment_grid(spark, d):
    """Every configuration of an experiment for every matrix: return flags as strategies, suppliers as matrices."""
    rows = table(spark, d, "lineitem")
    modes = sorted(x[0] for x in rows.select("l_returnflag").distinct().collect())  # three flags
    axes = results.grid(spark, {"m_tile": [4, 8], "strategy": modes})
    configs = F.explode(F.array(*[F.struct(F.lit(x.m_tile).alias("m_tile"), F.lit(x.strategy).alias("strategy")) for x in axes.collect()])).alias("x")
    return rows.select(F.col("l_suppkey").alias("matrix")).distinct().select("matrix", configs).select("x.m_tile", "x.strategy", "matrix")


@query("SELECT event_id, event_type AS name, value AS time FROM events ORDER BY value, event_id LIMIT 30")
def top30(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.col("value").alias("time")).orderBy("time", "event_id").limit(30)


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier")
def union_tagged(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return results.tagged_union({"customer": c, "supplier": s})


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def list_semi(spark, d):
    listed = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(listed, "doc_id", "left_semi")


@query(f"WITH a AS (SELECT *, i // {HEIGHT} AS ti, j // {WIDTH} AS tj FROM {{A}}) SELECT i, j, v FROM a WHERE (ti, tj) NOT IN (SELECT (ti, tj) FROM a GROUP BY ti, tj HAVING count(*) > 0.26 * {HEIGHT * WIDTH})")
def sparse_remainder_anti(spark, d):
    return linalg.split_dense(matrix_a(spark, d), HEIGHT, WIDTH, 0.26)[1]


@query("SELECT event_id, event_type AS name, value FROM events WHERE event_type IN ('view', 'click') AND user_id = 3 AND value BETWEEN 0 AND 100")
def filter_conjunction(spark, d):
    rows = results.where_all(table(spark, d, "events"), event_type=["view", "click"], user_id=3).where(F.col("value").between(0, 100))
    return rows.select("event_id", F.col("event_type").alias("name"), "value")


@query(
    """SELECT kind, count(*) AS cnt FROM (SELECT CASE WHEN contains(p_name, 'red') THEN 'warm' WHEN contains(p_name, 'ring') THEN 'round' WHEN contains(p_name, 'blue') THEN 'cold' ELSE 'Unknown' END AS kind FROM part) GROUP BY 1"""
)
def classify_first_match(spark, d):
    kind = scalar.first_match(F.col("p_name"), [("red", "warm"), ("ring", "round"), ("blue", "cold")])
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT user_id, event_type AS name, median(value) AS med, list_sort(list(value))[count(*) // 2 + 1] AS upper_med, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1, 2")
def repetition_summary(spark, d):
    """Median, upper median, mean and deviation of the repetitions of one method on one matrix."""
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("name"), "value")
    made = rows.groupBy("user_id", "name").agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"))
    made = made.join(medians(rows, ["user_id", "name"], "value", "med"), ["user_id", "name"])
    return made.join(results.upper_medians(rows, ["user_id", "name"], "value"), ["user_id", "name"], "left")


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM orders GROUP BY 1, 2")
def mean_by_config(spark, d):
    return results.mean_by_config(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]).withColumn("mean_o_totalprice", r("mean_o_totalprice", 4))


@query(
    """WITH w AS (SELECT user_id, max(CASE WHEN name = 'view' THEN time END) AS a, max(CASE WHEN name = 'click' THEN time END) AS b FROM {LOG} GROUP BY 1)
    SELECT user_id, least(CASE WHEN a < 20 THEN a ELSE 1e16 END, CASE WHEN b < 20 THEN b ELSE 1e16 END) AS best FROM w"""
)
def best_of_variants(spark, d):
    wide = results.pivot_methods(log(spark, d), ["user_id"], ["view", "click"], ["time"])
    times = [F.col("time|view"), F.col("time|click")]
    return wide.select("user_id", results.best_of_variants(times, [F.when(t < 20, "correct").otherwise("incorrect") for t in times]).alias("best"))


@query(
    """SELECT CAST(bucket AS INTEGER) AS bucket, name, round(avg(g), 4) AS mean_gflops FROM (SELECT user_id % 4 AS bucket, name, 2 * 128 * 26214 / 1e9 / (nullif(time, 0) / 1e6) AS g FROM {LOG}) GROUP BY 1, 2"""
)
def mean_per_bucket(spark, d):
    rate = scalar.gflops_per_second(F.lit(128), F.lit(26214), F.col("time"))
    rows = log(spark, d).select((F.col("user_id") % 4).cast("int").alias("bucket"), "name", rate.alias("g"))
    return rows.groupBy("bucket", "name").agg(r(F.avg("g"), 4).alias("mean_gflops"))


@query("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS cnt, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def count_by_shape(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT user_id, name, round(time - min(CASE WHEN name = 'view' THEN time END) OVER (PARTITION BY user_id), 6) AS extra FROM {LOG}")
def subtract_baseline(spark, d):
    made = results.less_baseline(log(spark, d), ["user_id"], F.col("name") == "view", "time", "extra")
    return made.select("user_id", "name", r("extra").alias("extra"))


@query("SELECT user_id, min(time) AS time, arg_min(name, (time, name)) AS name FROM {LOG} GROUP BY 1")
def map_argmin(spark, d):
    """Fastest method out of a map from methods to times."""
    maps = log(spark, d).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "time"))).alias("times"))
    return maps.select("user_id", results.fastest_entry(F.col("times")).alias("x")).select("user_id", "x.time", "x.name")


@query(
    """WITH l AS (SELECT event_type AS name, user_id % 3 AS threads, user_id AS layer, sum(value) AS t FROM events GROUP BY 1, 2, 3), c AS (SELECT name, threads, layer, sum(t) OVER (PARTITION BY name, threads ORDER BY layer) AS running FROM l)
    SELECT name, threads, layer, round(running, 4) AS running, round(min(CASE WHEN name = 'view' THEN running END) OVER (PARTITION BY threads, layer) / running, 6) AS speedup FROM c"""
)
def layer_speedups(spark, d):
    layers = table(spark, d, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("threads"), F.col("user_id").alias("layer")).agg(F.sum("value").alias("layer_time"))
    made = results.layer_speedups(layers, "view")
    return made.select("name", "threads", "layer", r("running", 4).alias("running"), r("speedup").alias("speedup"))


@query(
    """WITH RECURSIVE f AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS feature, unnest(range(5)) AS n),
    x AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS e, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t, CAST(l_linenumber AS DOUBLE) AS l FROM lineitem),
    c AS MATERIALIZED (SELECT [[1, corr(q, e), corr(q, d), corr(q, t), corr(q, l)], [corr(q, e), 1, corr(e, d), corr(e, t), corr(e, l)], [corr(q, d), corr(e, d), 1, corr(d, t), corr(d, l)],
        [corr(q, t), corr(e, t), corr(d, t), 1, corr(t, l)], [corr(q, l), corr(e, l), corr(d, l), corr(t, l), 1]] AS m FROM x),
    u AS (SELECT 0 AS step, m::DOUBLE[][] AS m FROM c UNION ALL
        SELECT step + 1, list_transform(m, lambda row: list_transform(m, lambda other: list_dot_product(row, other) / t)) FROM (SELECT step, m, list_sum(list_transform(m, lambda row: list_dot_product(row, row))) AS t FROM u WHERE step < 50)),
    g AS (SELECT m, list_transform(range(5), lambda k: m[k + 1][k + 1]) AS diagonal FROM u WHERE step = 50), h AS (SELECT m[list_position(diagonal, list_max(diagonal))] AS v FROM g),
    z AS (SELECT feature, v[n + 1] / sqrt(list_dot_product(v, v)) AS w FROM h, f), s AS (SELECT sign(arg_max(w, abs(w))) AS s FROM z)
    SELECT feature, round(w * s, 4) AS weight FROM z, s ORDER BY abs(w) DESC LIMIT 3"""
)
def leading_features(spark, d):
    """Weights of lineitem's columns in their first principal direction."""
    made = results.leading_features(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], 3)
    return made.withColumn("weight", r("weight", 4))


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42:' || user_id), user_id LIMIT 20)")
def seeded_sample(spark, d):
    """Rows of twenty users drawn by a hash."""
    return results.seeded_sample(table(spark, d, "events").select("user_id", "event_id"), "user_id", 20)


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS u, l_partkey + 1099511627776 AS v FROM lineitem), b AS MATERIALIZED (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e),
    c(node, root) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, min(c.root) FROM c JOIN b ON b.x = c.node JOIN recurring.c AS r ON r.node = b.y WHERE c.root < r.root GROUP BY b.y)
    SELECT root, count(*) AS nodes FROM c GROUP BY 1"""
)
def method_components(spark, d):
    """Groups of suppliers and parts that lineitems connect, as connected components of all entries."""
    from gridweave.operators.graph import components

    a = matrix_a(spark, d).select(F.col("i").cast("long").alias("u"), (F.lit(1 << 40) + F.col("j")).cast("long").alias("v"))
    return components(a).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


# Registers the queries of the other modules.
from gridweave.plans import extra, files, whole  # noqa: E402, F401
