"""More queries: covers and mappings of patterns, matrices together, tuning, counters and small steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import hybrid, matrix, patterns, results, structure
from gridweave.plans.catalog import HEIGHT, PANEL, WIDTH, log, matrix_a, mined, mined_sql, query, r, sizes, table
from gridweave.plans.prefix import dealt
from gridweave.sources import experiments

#: Three matrices of one table: lineitem by return flag.
MANY_SQL = "(SELECT DISTINCT l_returnflag AS matrix_id, l_suppkey AS i, l_partkey AS j FROM lineitem)"


def many(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("matrix_id"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    return dealt(rows, "matrix_id", "i", "j").distinct()


def shapes(spark, d):
    m, k = sizes(spark, d)
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("matrix_id")).distinct().select("matrix_id", F.lit(m).alias("m"), F.lit(k).alias("k"))


# ---- patterns ---------------------------------------------------------------------------------

MERGES = [15, 240, 51, 204, 255]


@query(
    f"""WITH k(pos, kernel) AS (VALUES (0, 15), (1, 240), (2, 51), (3, 204), (4, 255)), p AS {mined_sql(PANEL)},
    c AS (SELECT pattern, pos, kernel, 1.1 * bit_count(pattern & ~kernel) + 1.0 * bit_count(kernel & ~pattern) AS cost FROM p, k WHERE bit_count(pattern) >= 2),
    b AS (SELECT pattern, kernel FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY cost, pos) AS n FROM c) WHERE n = 1)
    SELECT p.pattern, p.cnt, CASE WHEN kernel IS NULL THEN [p.pattern] ELSE list_concat([kernel], list_transform(list_filter(range(8), lambda x: ((p.pattern & ~kernel) >> CAST(x AS INTEGER)) & 1 = 1), lambda x: CAST(1 << CAST(x AS INTEGER) AS INTEGER))) END AS kernels
    FROM p LEFT JOIN b USING (pattern)"""
)
def merge_split_kernels(spark, d):
    """Kernels of every pattern of eight rows that the matrix has: the cheapest merge kernel, and single bits for the rest."""
    return patterns.merge_split_mapping(spark, PANEL, MERGES).join(mined(spark, d, PANEL), "pattern")


@query(
    f"""WITH RECURSIVE k(pos, kernel) AS (VALUES (0, 15), (1, 240), (2, 51), (3, 204), (4, 255)),
    r AS (SELECT x AS pattern, x AS rest, 0 AS taken, []::INTEGER[] AS kernels, 0 AS step FROM (SELECT pattern AS x FROM {mined_sql(PANEL)}) UNION ALL
        SELECT pattern, rest & ~best, taken | best, list_append(kernels, best), step + 1 FROM
        (SELECT r.pattern, r.rest, r.taken, r.kernels, r.step, arg_min(kernel, (1.1 * bit_count(rest & ~kernel) + 1.0 * bit_count(kernel & ~rest), pos)) AS best FROM r JOIN k ON kernel & taken = 0 WHERE bit_count(rest) >= 2 GROUP BY ALL)),
    z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY step DESC) = 1)
    SELECT pattern, CASE WHEN rest = 0 AND step > 0 THEN kernels WHEN bit_count(rest) < 2 THEN list_append(kernels, rest) ELSE list_concat(kernels, list_transform(list_filter(range(8), lambda x: (rest >> CAST(x AS INTEGER)) & 1 = 1), lambda x: CAST(1 << CAST(x AS INTEGER) AS INTEGER))) END AS kernels FROM z"""
)
def merge_recursive_kernels(spark, d):
    """The same with the rest mapped again by kernels that meet none chosen."""
    return patterns.merge_split_mapping(spark, PANEL, MERGES, recursive=True).join(mined(spark, d, PANEL), "pattern", "left_semi")


@query(f"SELECT x AS pattern, cnt, CAST(bit_count(x) AS INTEGER) AS nnz, CAST(b AS INTEGER) AS row FROM (SELECT pattern AS x, cnt FROM {mined_sql(PANEL)}), (SELECT CAST(unnest(range(8)) AS INTEGER) AS b) WHERE (x >> b) & 1 = 1")
def pattern_elements(spark, d):
    """The elements of the patterns that the matrix has."""
    return patterns.elements(spark, PANEL).join(mined(spark, d, PANEL), "pattern").select("pattern", "cnt", "nnz", "row")


@query(
    f"""WITH q AS (SELECT pattern AS x, cnt, row_number() OVER (ORDER BY pattern) - 1 AS b FROM {mined_sql(4)}), s AS (SELECT CAST(unnest(range(1, 32768)) AS INTEGER) AS mask), e AS (SELECT mask, x, cnt FROM s, q WHERE (mask >> CAST(b AS INTEGER)) & 1 = 1 AND mask < (1 << CAST((SELECT count(*) FROM q) AS INTEGER)))
    SELECT mask, list(x ORDER BY x)::INTEGER[] AS members, CAST(bit_or(x) AS INTEGER) AS "union", CAST(sum(cnt) AS BIGINT) AS cols FROM e GROUP BY 1"""
)
def merge_subsets(spark, d):
    """Every non-empty set of the patterns of four rows that the matrix has, and the columns of its panels that it is for."""
    held = sorted(tuple(x) for x in mined(spark, d, 4).collect())  # fifteen patterns at most
    counts = F.create_map(*[F.lit(v) for pair in held for v in pair])
    cols = F.aggregate("members", F.lit(0).cast("bigint"), lambda a, x: a + F.element_at(counts, x))
    return patterns.merge_subsets(spark, [pattern for pattern, _ in held]).withColumn("cols", cols)


@query(
    f"""WITH q AS (SELECT x, coalesce(cnt, 0) AS c, row_number() OVER (ORDER BY bit_count(x) DESC, x DESC) - 1 AS pos FROM (SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS x) LEFT JOIN {mined_sql(4)} ON pattern = x),
    m AS (SELECT f, mask FROM (SELECT CAST(unnest(range(15)) AS INTEGER) AS f), (SELECT CAST(unnest(range(1, 16384)) AS INTEGER) AS mask) WHERE mask < (1 << (14 - f))),
    u AS (SELECT f, mask, count(*) AS n, bit_or(x) AS u, sum(c) AS s FROM m JOIN q ON pos > f AND pos <= 14 AND (mask >> CAST(pos - f - 1 AS INTEGER)) & 1 = 1 GROUP BY 1, 2),
    a AS (SELECT f AS first, false AS with_first, n AS size, u AS "union", s FROM u UNION ALL SELECT f, true, n + 1, u | x, s + c FROM u JOIN q ON pos = f UNION ALL SELECT NULL, true, 15, 15, sum(c) FROM q)
    SELECT first, with_first, size, "union", count(*) AS cnt, CAST(sum(s) AS BIGINT) AS cols FROM a GROUP BY ALL"""
)
def overlap_subsets(spark, d):
    """The smaller family of sets of the fifteen patterns of four rows, by size and union, with the columns of the matrix's panels that they are for."""
    counts = mined(spark, d, 4).withColumnRenamed("cnt", "n")
    each = patterns.overlap_subsets(spark, 4).select("first", "with_first", F.size("members").cast("bigint").alias("size"), "union", F.explode("members").alias("pattern"))
    return each.join(counts, "pattern", "left").groupBy("first", "with_first", "size", "union").agg(
        (F.count(F.lit(1)) / F.col("size")).cast("bigint").alias("cnt"), F.sum(F.coalesce("n", F.lit(0))).alias("cols")
    )


_CODES4 = "SELECT i // 4 AS p, j, CAST(bit_or(1 << CAST(i % 4 AS INTEGER)) AS INTEGER) AS pattern FROM {A} GROUP BY 1, 2"


@query(
    f"""WITH h AS (SELECT pattern, count(*) AS cnt FROM ({_CODES4}) GROUP BY 1), s AS (SELECT pattern, cnt / (SELECT sum(cnt) FROM h) AS share FROM h)
    SELECT CAST(pattern % 5 AS INTEGER) AS subset_id, CAST(bit_or(pattern) AS INTEGER) AS "union", round(bit_count(bit_or(pattern)) * sum(share) + 2 * sum(share), 6) AS cost FROM s GROUP BY 1"""
)
def subset_cost_by_rows(spark, d):
    hist = patterns.codes(matrix_a(spark, d), 4).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    shares = hist.select("pattern", (F.col("cnt") / hist.agg(F.sum("cnt")).scalar()).alias("share"))
    return patterns.alternative_costs(shares.select((F.col("pattern") % 5).alias("subset_id"), "pattern"), shares).withColumn("cost", r("cost"))


@query(
    f"""WITH c AS ({_CODES4}), n AS (SELECT *, CASE WHEN pattern = lag(pattern) OVER (PARTITION BY p ORDER BY j) THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY j) AS run FROM n)
    SELECT p, pattern, min(j) AS first_j, count(*) AS cols, count(*) * bit_count(pattern) AS nnz FROM g GROUP BY p, run, pattern"""
)
def consecutive_groups(spark, d):
    return patterns.consecutive_groups(matrix_a(spark, d), 4)


@query(
    f"""WITH a AS (SELECT matrix_id, round_even(1 - count(*) / ({{M}} * {{K}}), 2) AS sparsity FROM {MANY_SQL} GROUP BY 1),
    h AS (SELECT matrix_id, m_r, i // m_r AS p, j, bit_or(1 << CAST(i % m_r AS INTEGER)) AS pattern FROM {MANY_SQL}, (VALUES (4), (8)) v(m_r) GROUP BY 1, 2, 3, 4)
    SELECT CAST(m_r AS INTEGER) AS m_r, sparsity, CAST(pattern AS INTEGER) AS pattern, count(*) AS cnt FROM h JOIN a USING (matrix_id) GROUP BY 1, 2, 3"""
)
def pattern_counts_by_key(spark, d):
    return patterns.keyed_counts(many(spark, d), shapes(spark, d), [4, 8])


@query(f"SELECT pattern, cnt, row_number() OVER (ORDER BY bit_count(pattern), pattern) AS place FROM {mined_sql(PANEL)}")
def patterns_sorted(spark, d):
    from pyspark.sql import Window

    order = Window.orderBy(F.bit_count("pattern"), "pattern")  # 2^8 rows
    return mined(spark, d, PANEL).withColumn("place", F.row_number().over(order))


@query(
    f"""WITH g AS (SELECT pattern AS id, count(*) AS n, bit_count(pattern) AS bits FROM ({_CODES4}) GROUP BY 1),
    x AS (SELECT a.id AS a, b.id AS b, a.n * (bit_count(a.id | b.id) - a.bits) + b.n * (bit_count(a.id | b.id) - b.bits) AS padding FROM g a JOIN g b ON a.id < b.id)
    SELECT a, b, CAST(padding AS BIGINT) AS padding FROM x WHERE padding = (SELECT min(padding) FROM x) ORDER BY a, b LIMIT 1"""
)
def first_matched_pair(spark, d):
    """The pair of groups that greedy matching takes first."""
    hist = patterns.codes(matrix_a(spark, d), 4).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    costs = patterns.group_pair_costs(hist.select(F.col("pattern").alias("group_id"), "pattern", "cnt"))
    rows = [(x["a"], x["b"], x["padding"]) for x in costs.collect()]  # at most 120 pairs and 15 groups
    a, b = patterns.greedy_matching(rows)[0]
    return costs.where((F.col("a") == a) & (F.col("b") == b))


# ---- matrices together ------------------------------------------------------------------------

_RANGE = "CASE WHEN s < 0.5 THEN 0 WHEN s < 0.7 THEN 1 WHEN s < 0.9 THEN 2 WHEN s < 0.95 THEN 3 ELSE 4 END"


@query(
    f"""WITH t AS (SELECT matrix_id, i // {HEIGHT} AS ti, j // {WIDTH} AS tj, count(*) AS nnz FROM {MANY_SQL} GROUP BY 1, 2, 3), w AS (SELECT matrix_id, {_RANGE} AS range, filled FROM
    (SELECT matrix_id, 1 - sum(nnz) / ({{M}} * {{K}}) AS s, count(*) AS filled FROM t GROUP BY 1)),
    b AS (SELECT matrix_id, least(floor(50 * (nnz / (least({HEIGHT}, {{M}} - ti * {HEIGHT}) * least({WIDTH}, {{K}} - tj * {WIDTH})))), 49) AS bin FROM t),
    u AS (SELECT range, bin, count(*) AS cnt FROM b JOIN w USING (matrix_id) GROUP BY 1, 2 UNION ALL SELECT range, 0, ceil({{M}} / {HEIGHT}.0) * ceil({{K}} / {WIDTH}.0) - filled FROM w)
    SELECT CAST(range AS INTEGER) AS range, CAST(bin AS INTEGER) AS bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM u GROUP BY 1, 2"""
)
def tile_density_by_range(spark, d):
    return structure.histogram_by_range(many(spark, d), shapes(spark, d), HEIGHT, WIDTH, lambda x: scalar.sparsity_range(x, (0.0, 0.5, 0.7, 0.9, 0.95, 1.0)))


@query("WITH g AS (SELECT j - lag(j, 1, 0) OVER (PARTITION BY i ORDER BY j) AS gap FROM {A}) SELECT round(avg(gap) / {K}, 9) AS avg_share, round(max(gap) / {K}, 9) AS max_share FROM g")
def run_length_shares(spark, d):
    made = structure.normalised_run_lengths(matrix_a(spark, d), sizes(spark, d)[1])
    return made.select(r("avg_share", 9).alias("avg_share"), r("max_share", 9).alias("max_share"))


@query(
    f"""WITH s AS (SELECT matrix_id, i, j, lead(j) OVER w - j AS d FROM {MANY_SQL} WINDOW w AS (PARTITION BY matrix_id, i ORDER BY j)), c AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY matrix_id, i ORDER BY j) THEN 0 ELSE 1 END AS new FROM s WHERE d IS NOT NULL),
    g AS (SELECT *, sum(new) OVER (PARTITION BY matrix_id, i ORDER BY j) AS island FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY matrix_id, i, island ORDER BY j) - 1 AS pos FROM g),
    h AS (SELECT matrix_id, i, island, pos // 9 AS piece, count(*) AS n FROM p GROUP BY 1, 2, 3, 4), b AS (SELECT matrix_id, least(n, 8) - 1 AS bin, count(*) AS cnt FROM h GROUP BY 1, 2),
    w AS (SELECT bin, bin * cnt / nullif(sum(bin * cnt) OVER (PARTITION BY matrix_id), 0) AS share FROM b), z AS (SELECT bin, sum(share) AS s FROM w GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, round(s / (SELECT sum(s) FROM z), 9) AS share FROM z"""
)
def stride_shares_pooled(spark, d):
    hists = structure.stride_runs(many(spark, d), 8, by=["matrix_id"])
    return structure.pooled_shares(hists, "matrix_id").select("bin", r("share", 9).alias("share"))


_TIMES = """SELECT matrix_id, t AS threshold, b AS b_cols, 10.0::DOUBLE + b AS spmm, 20.0 + b * t AS gemm, 4.0 + b * t AS sparse_blocked, 9.0 - 10 * t AS dense_blocked, 5.0 + b * t AS sparse_sep, 7.0 - 8 * t AS dense_sep, 6.0 + t AS sparse_full, 8.0 + b / 100.0 AS dense_full
    FROM (SELECT DISTINCT l_returnflag AS matrix_id FROM lineitem), (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) x(t), (VALUES (32), (128)) y(b)"""


def _times(spark, d):
    """Times by a formula, as a stand for measurements."""
    t, b = F.col("threshold"), F.col("b_cols")
    made = shapes(spark, d).select("matrix_id", F.explode(F.lit([0.05, 0.1, 0.15])).alias("threshold")).select("matrix_id", "threshold", F.explode(F.lit([32, 128])).alias("b_cols"))
    forms = {"spmm": 10.0 + b, "gemm": 20.0 + b * t, "sparse_blocked": 4.0 + b * t, "dense_blocked": 9.0 - 10 * t, "sparse_sep": 5.0 + b * t, "dense_sep": 7.0 - 8 * t, "sparse_full": 6.0 + t, "dense_full": 8.0 + b / 100.0}
    return made.select("matrix_id", "threshold", "b_cols", *[x.alias(n) for n, x in forms.items()])


_RECORDS = f"""WITH t AS (SELECT matrix_id, i // {HEIGHT} AS ti, j // {WIDTH} AS tj, count(*) AS n FROM {MANY_SQL} GROUP BY 1, 2, 3), x AS ({_TIMES}), z AS (SELECT ceil({{M}} / {HEIGHT}.0) * ceil({{K}} / {WIDTH}.0) AS tiles),
    s AS (SELECT matrix_id, v AS threshold, sum(n) AS nnz, count(*) AS filled, sum(CASE WHEN n > v * {HEIGHT * WIDTH} THEN {HEIGHT * WIDTH} - n ELSE 0 END) AS padding, sum(CASE WHEN n > v * {HEIGHT * WIDTH} THEN n ELSE 0 END) AS dense_nnz,
        count(*) FILTER (n > v * {HEIGHT * WIDTH}) AS dense_tiles, min(n) AS least, max(n) AS most FROM t, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) y(v) GROUP BY 1, 2),
    f AS (SELECT matrix_id, threshold, b_cols, CAST({{M}} AS INTEGER) AS m, CAST({{K}} AS INTEGER) AS k, CAST(nnz AS BIGINT) AS nnz, CAST(padding AS BIGINT) AS padding, dense_tiles, '{HEIGHT}x{WIDTH}' AS tile_shape, {HEIGHT * WIDTH} AS tile_vol,
        round(CASE WHEN filled < tiles THEN 0 ELSE least / {HEIGHT * WIDTH} END, 6) AS tile_nnz_pct_min, round(most / {HEIGHT * WIDTH}, 6) AS tile_nnz_pct_max, round(nnz / {HEIGHT * WIDTH} / tiles, 6) AS tile_nnz_pct_mean, round(dense_nnz / nnz, 6) AS dense_ratio,
        spmm, gemm, round(sparse_blocked + dense_blocked, 6) AS total_blocked, round(sparse_sep + dense_sep, 6) AS total_sep, round(sparse_full + dense_full, 6) AS total_full,
        round(greatest(gemm / (sparse_blocked + dense_blocked), gemm / (sparse_sep + dense_sep), gemm / (sparse_full + dense_full)), 6) AS speedup FROM s JOIN x USING (matrix_id, threshold), z) """


def _records(spark, d):
    cells = many(spark, d).select("matrix_id", F.floor(F.col("i") / HEIGHT).alias("ti"), F.floor(F.col("j") / WIDTH).alias("tj"))
    tile = dealt(cells, "matrix_id", "ti", "tj").groupBy("matrix_id", "ti", "tj").agg(F.count(F.lit(1)).alias("nnz"))
    return hybrid.hybrid_records(tile, shapes(spark, d), HEIGHT, WIDTH, [0.05, 0.1, 0.15], _times(spark, d))


def _shown(records):
    drop = [f"{part}_{form}" for part in ("sparse", "dense") for form in ("blocked", "sep", "full")]
    shown = records.drop(*drop)
    return shown.select([r(c).alias(c) if t == "double" and c not in ("threshold",) else F.col(c) for c, t in shown.dtypes])


@query(_RECORDS + "SELECT * FROM f")
def hybrid_records(spark, d):
    return _shown(_records(spark, d))


@query(_RECORDS + "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY matrix_id, b_cols ORDER BY speedup DESC, threshold) AS n FROM f) WHERE n = 1")
def hybrid_best_records(spark, d):
    return _shown(hybrid.best_records(_records(spark, d)))


@query(_RECORDS + "SELECT matrix_id, round(max(gemm / total_blocked), 4) AS max_total_blocked, round(max(gemm / total_sep), 4) AS max_total_sep, round(greatest(max(gemm / total_blocked), max(gemm / total_sep)), 4) AS max_speedup FROM f GROUP BY 1")
def hybrid_max_speedup(spark, d):
    made = results.max_speedups(_records(spark, d), ["matrix_id"], "gemm", ["total_blocked", "total_sep"])
    return made.select("matrix_id", *[r(c, 4).alias(c) for c in made.columns[1:]])


# ---- filters, tuning, names and counters ------------------------------------------------------


@query("SELECT user_id, name, round(s, 6) AS speedup FROM (SELECT user_id, name, min(CASE WHEN name = 'view' THEN time END) OVER (PARTITION BY user_id) / nullif(time, 0) AS s FROM {LOG}) WHERE s > 0 AND s < 10")
def outlier_trim(spark, d):
    made = results.speedups(log(spark, d), ["user_id"], "view")
    return made.where((F.col("speedup") > 0) & (F.col("speedup") < 10)).select("user_id", "name", r("speedup").alias("speedup"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'm_tile:4|8' WHEN 1 THEN 'saved result 1' WHEN 2 THEN 'plain' END AS tuning, p_size % 4 = 0 AS tuned, p_size % 4 IN (1, 3) AS saved FROM part"""
)
def tuning_flags(spark, d):
    """Searches and stored results by their text, nulls included."""
    size = F.col("p_size") % 4
    text = F.when(size == 0, "m_tile:4|8").when(size == 1, "saved result 1").when(size == 2, "plain")
    return table(spark, d, "part").select("p_partkey", text.alias("tuning")).select("*", scalar.is_tuned(F.col("tuning")).alias("tuned"), scalar.is_saved(F.col("tuning")).alias("saved"))


@query(
    """WITH g AS (SELECT * FROM (VALUES (NULL), (4), (16), (32)) a(m_tile), (VALUES (8), (64)) b(k_tile)), p AS (SELECT p_partkey, p_size AS m, p_size * 2 AS k FROM part)
    SELECT p_partkey, CAST(m_tile AS INTEGER) AS m_tile, CAST(k_tile AS INTEGER) AS k_tile FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY m_tile DESC NULLS LAST, k_tile DESC) AS n FROM p, g WHERE (m_tile IS NULL OR m_tile <= m) AND k_tile <= k) WHERE n = 1"""
)
def initial_tiles(spark, d):
    """The largest tiles that fit a matrix, from which tuning starts."""
    grid = F.array(*[F.struct(F.lit(a).cast("int").alias("m_tile"), F.lit(b).alias("k_tile")) for a in (None, 4, 16, 32) for b in (8, 64)])
    each = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("m"), (F.col("p_size") * 2).alias("k"), F.explode(grid).alias("g")).select("p_partkey", "m", "k", "g.*")
    fit = results.fitting_tiles(each, {"m_tile": F.col("m"), "k_tile": F.col("k")})
    best = results.first_values(fit.withColumn("a", -F.coalesce("m_tile", F.lit(-1))).withColumn("b", -F.col("k_tile")), ["p_partkey"], ["a", "b"])
    return best.select("p_partkey", "m_tile", "k_tile")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' AND l_discount < 0.05 THEN 0.05 ELSE l_discount END AS density FROM lineitem")
def density_clamped(spark, d):
    density = scalar.clamp_density(F.col("l_discount"), F.col("l_returnflag") == "N")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", density.alias("density"))


@query("SELECT x AS s, CAST(CASE WHEN x >= 0.95 THEN 2 WHEN x >= 0.9 THEN 1 ELSE 0 END AS INTEGER) AS range FROM (SELECT p_partkey, 0.7 + (p_size % 31) / 100.0::DOUBLE AS x FROM part) WHERE x <= 1")
def sparsity_ranges(spark, d):
    s = F.lit(0.7) + (F.col("p_size") % 31) / F.lit(100.0)
    return table(spark, d, "part").select(s.alias("s")).where("s <= 1").select("s", scalar.sparsity_range(F.col("s")).alias("range"))


@query(f"SELECT i, s FROM (SELECT i, round(1 - count(*) / {{K}}, 6) AS s FROM {{A}} GROUP BY 1) ORDER BY s, i")
def sparsest_last(spark, d):
    """All rows by their sparsity, in order."""
    k = sizes(spark, d)[1]
    rows = matrix_a(spark, d).groupBy("i").agg(r(1 - F.count(F.lit(1)) / k).alias("s"))
    return rows.orderBy("s", "i")


@query("SELECT i, j, v FROM {A} ORDER BY v, i, j")
def entries_by_value(spark, d):
    """All entries by their value."""
    return matrix.by_value(matrix_a(spark, d))


@query("SELECT p_partkey, 'bench_ ' || p_size || '_ ' || (p_size % 7) || '_x' AS name, upper(p_type[1:1]) || '|' || p_partkey || '|' || p_size AS id FROM part")
def names_padded(spark, d):
    raw = F.concat_ws("_", F.lit("bench"), "p_size", F.col("p_size") % 7, F.lit("x"))
    rows = table(spark, d, "part")
    return rows.select("p_partkey", scalar.pad_numbers(raw).alias("name"), scalar.joined_id(F.upper(F.substring("p_type", 1, 1)), F.col("p_partkey"), F.col("p_size")).alias("id"))


@query("SELECT p_partkey, CASE WHEN k > n THEN 0 ELSE CAST(round(factorial(CAST(n AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(n - k AS INTEGER)))) AS BIGINT) END AS ncr FROM (SELECT p_partkey, p_size % 17 AS n, p_partkey % 9 AS k FROM part)")
def n_choose_k(spark, d):
    n, k = (F.col("p_size") % 17).cast("bigint"), (F.col("p_partkey") % 9).cast("bigint")
    return table(spark, d, "part").select("p_partkey", scalar.combinations(n, k).alias("ncr"))


@query(
    """SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE round((k - k % 3) / k, 6) END AS l1i_ratio, round((k + 9 - (k % 5)) / (k + 9), 6) AS l2_ratio, round((k % 4) / (k + 1), 6) AS branch_miss_ratio,
    CASE WHEN k = 0 THEN NULL ELSE round((k + 5) / (k * 10 / 2), 6) END AS loads_per_fma, 2 * k + 5 AS loads_and_stores FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
)
def counter_ratios(spark, d):
    k = F.col("k")
    rows = table(spark, d, "events").select("event_id", scalar.nested(F.col("props"), "k").cast("bigint").alias("k"))
    made = scalar.counter_ratios({"l1i_accesses": k, "l1i_misses": k % 3, "l1_misses": k + 9, "l2_misses": k % 5, "branches": k + 1, "branch_misses": k % 4})
    loads = scalar.loads_per_fma(k + 5, k, k * 2, k * 3, k * 4)
    return rows.select("event_id", *[r(x).alias(n) for n, x in made.items()], r(loads).alias("loads_per_fma"), (k + 5 + k).alias("loads_and_stores"))


@query("SELECT event_id, json_extract_string(x, '$.a.b.k') AS k, json_extract_string(x, '$.a.c') AS missing FROM (SELECT event_id, '{\"a\": {\"b\": ' || props || '}}' AS x FROM events)")
def dotted_paths(spark, d):
    document = F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}"))
    return table(spark, d, "events").select("event_id", scalar.nested(document, "a.b.k").alias("k"), scalar.nested(document, "a.c").alias("missing"))


@query("SELECT event_type AS name, CASE event_type WHEN 'view' THEN 'Dense' WHEN 'click' THEN 'Sparse' END AS label, count(*) AS cnt FROM events GROUP BY 1, 2")
def names_mapped(spark, d):
    label = scalar.renamed(F.col("event_type"), {"view": "Dense", "click": "Sparse"})
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name"), label.alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT p_partkey, 2 ** ceil(log2(p_size)) AS height, right(md5(p_name), 5) AS digest, round((p_size * 1000 - t * 192 - t * 40 + t) / 2 + t * 8, 4) / (p_size * 64 * 4) AS storage FROM (SELECT *, ceil(p_size / 8.0) * 2 AS t FROM part)")
def heights_and_digests(spark, d):
    rows, size = table(spark, d, "part"), F.col("p_size")
    share = scalar.tiled_storage_share(size * 1000, size, F.lit(64), F.lit(8), F.lit(32))
    return rows.select("p_partkey", scalar.power_of_two_at_least(size).alias("height"), scalar.short_digest(F.col("p_name")).alias("digest"), share.alias("storage"))


@query(
    """WITH c AS (SELECT p_partkey, length(p_name) AS n, i, ascii(substr(p_name, CAST(i AS INTEGER), 1)) AS x FROM part, unnest(range(1, length(p_name) + 1)) t(i))
    SELECT p_partkey, CAST((n + sum((n - i + 1) * x)) % 65521 * 65536 + (1 + sum(x)) % 65521 AS BIGINT) AS checksum FROM c GROUP BY p_partkey, n"""
)
def file_list_checksum(spark, d):
    """Adler-32 of every part's name."""
    return table(spark, d, "part").select("p_partkey", scalar.adler32(F.col("p_name")).alias("checksum"))


@query(
    """WITH w AS (SELECT user_id, max(CASE WHEN name = 'view' THEN time END) AS a, max(CASE WHEN name = 'click' THEN time END) AS b FROM {LOG} GROUP BY 1)
    SELECT user_id, a AS "time|view", b AS "time|click", coalesce(a < 60, false) AND coalesce(b < 60, false) AS all_correct FROM w"""
)
def pivot_all_correct(spark, d):
    wide = results.pivot_methods(log(spark, d), ["user_id"], ["view", "click"], ["time"])
    flags = [F.when(F.col(f"time|{m}") < 60, "correct").otherwise("incorrect") for m in ("view", "click")]
    return wide.withColumn("all_correct", scalar.all_correct(flags))


@query(
    """WITH o AS (SELECT o_orderkey, sum(o_totalprice) AS own FROM orders GROUP BY 1), l AS (SELECT l_orderkey, l_returnflag AS name, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, sum(t) AS below FROM l GROUP BY 1),
    u AS (SELECT 'remaining' AS kernel, own - coalesce(below, 0) AS t FROM o LEFT JOIN b ON l_orderkey = o_orderkey UNION ALL SELECT CASE name WHEN 'A' THEN 'spmm' WHEN 'R' THEN 'gemm' ELSE 'remaining' END, t FROM l JOIN o ON l_orderkey = o_orderkey)
    SELECT kernel, round(sum(t), 2) AS time FROM u GROUP BY 1"""
)
def profile_by_kernel(spark, d):
    """Orders as events and their items by flag as events below them, rolled up by mapped name."""
    top = table(spark, d, "orders").groupBy("o_orderkey").agg(F.sum("o_totalprice").alias("total"))
    top = top.select(F.concat(F.lit("o"), "o_orderkey").alias("event"), F.lit(None).cast("string").alias("parent"), F.lit("order").alias("name"), "total")
    low = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.sum("l_extendedprice").alias("total"))
    low = low.select(F.concat(F.lit("l"), "l_orderkey", "name").alias("event"), F.concat(F.lit("o"), "l_orderkey").alias("parent"), "name", "total")
    made = results.profile_shares(top.unionByName(low), {"A": "spmm", "R": "gemm"})
    return made.select("kernel", r("time", 2).alias("time"))


# ---- experiments ------------------------------------------------------------------------------

_SPEC = {
    "options": {"b_cols": [32, 128], "n_threads": [1, 8], "scalar_type": "float"},
    "methods": [{"name": "nano", "tune": {"grid": "g4"}, "options": {"m_r": 4}}, {"name": "mkl", "options": {"inspector": True}}],
    "tuning_grids": [{"name": "g4", "m_tile": [4, 8], "k_tile": [64]}],
}


@query(
    """WITH g AS (SELECT 'nano' AS method, 'm_r:4|m_tile:' || m || '|k_tile:64' AS config FROM (VALUES (4), (8)) a(m) UNION ALL SELECT 'mkl', 'inspector:true')
    SELECT n_name AS matrix, method, config, CAST(b AS INTEGER) AS b_cols, CAST(t AS INTEGER) AS n_threads FROM g, nation, (VALUES (32), (128)) b(b), (VALUES (4)) c(t)"""
)
def experiment_runs(spark, d):
    """Runs of an experiment over a list of matrices, with a thread count given on the command line."""
    return experiments.runs(spark, _SPEC, table(spark, d, "nation").select(F.col("n_name").alias("matrix")), overrides={"n_threads": 4})


@query(
    """SELECT pack || '_part' || CAST(p AS INTEGER) || '_' || b || '_' || t || '.yaml' AS file, CASE WHEN pack = 'aspt' THEN 'all_aspt_part' ELSE 'all_part' END || CAST(p AS INTEGER) || '.sh' AS script,
    'options:' || chr(10) || '  b_cols: [' || b || ']' || chr(10) || '  n_threads: [' || t || ']' || chr(10) || 'matrices:' || chr(10) || '  filelist: part' || CAST(p AS INTEGER) || '.txt' || chr(10) AS text
    FROM (SELECT DISTINCT l_returnflag AS pack FROM lineitem UNION ALL SELECT 'aspt') k, (SELECT unnest(range(1, 4)) AS p), (VALUES (32), (256)) b(b), (VALUES (1), (20)) t(t)"""
)
def experiment_files(spark, d):
    """Experiment files for each return flag as a pack of methods, and for the one that has scripts of its own."""
    packs = sorted(x[0] for x in table(spark, d, "lineitem").select("l_returnflag").distinct().collect())  # three flags
    return experiments.files(spark, [*packs, "aspt"], 3, [32, 256], [1, 20])
