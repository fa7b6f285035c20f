"""Queries over all rows of a matrix at once: similarity, order, bit maps and what else no panel bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import covers, hybrid, linalg, patterns, reordering, results, similarity
from gridweave.operators.order_statistics import percentiles
from gridweave.plans.catalog import HEIGHT, PANEL, matrix_a, mined, mined_sql, part_b, query, r, sizes, table
from gridweave.plans.prefix import dealt, exclusive_prefix
from gridweave.plans.staging import materialise, new_path
from gridweave.sources import matrices, split_readers

#: Orders by suppliers: many short rows, with copies.
O_SQL = "(SELECT DISTINCT l_orderkey AS i, l_suppkey AS j FROM lineitem)"


def matrix_o(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j")).distinct()


@query(
    f"""WITH o AS MATERIALIZED {O_SQL}, s AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS columns FROM o GROUP BY 1),
    c AS MATERIALIZED (SELECT i, min(i) OVER (PARTITION BY columns) AS class_id, count(*) OVER (PARTITION BY columns) AS copies, len(columns) AS n FROM s),
    e AS MATERIALIZED (SELECT o.i, j, n FROM o JOIN c ON o.i = c.i AND c.i = class_id),
    p AS (SELECT x.i AS a, y.i AS b FROM e x JOIN e y ON x.j = y.j AND x.i <> y.i AND x.n * 4 <= y.n * 5 AND y.n * 4 <= x.n * 5 GROUP BY x.i, y.i, x.n, y.n HAVING count(*) * 9 >= 4 * (x.n + y.n)),
    l AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
    SELECT c.i, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN l ON a = class_id"""
)
def similar_rows(spark, d):
    """All pairs of rows of Jaccard similarity 0.8 or more: each row's class of equal rows and that class's links."""
    members, pairs = similarity.similar_rows(matrix_o(spark, d), 0.8)
    return similarity.link_counts(members, pairs)


@query()
def nearest_row_order(spark, d):
    """All rows of A in an order of near neighbours, with the distance to the row before."""
    rows = matrix_a(spark, d)
    return reordering.path_distances(rows, reordering.nearest_order(rows))


@query(
    f"""WITH o AS MATERIALIZED {O_SQL}, n AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS place, count(*) AS n FROM o GROUP BY 1),
    c AS MATERIALIZED (SELECT place, j FROM o JOIN n USING (i)), b AS (SELECT x.place, count(*) AS shared FROM c x JOIN c y ON x.j = y.j AND x.place = y.place + 1 GROUP BY 1)
    SELECT count(*) AS n_rows, count(*) AS places, CAST(0 AS BIGINT) AS first_place, count(*) - 1 AS last_place, true AS nearer,
        CAST(sum(x.n + y.n - 2 * coalesce(shared, 0)) AS BIGINT) AS distance_before
    FROM n x LEFT JOIN n y ON x.place = y.place + 1 LEFT JOIN b ON b.place = x.place"""
)
def row_order_gain(spark, d):
    """The order is a permutation of all rows, and its distance is at most three quarters of that of the rows by number."""
    rows = matrix_o(spark, d)
    before = exclusive_prefix(rows.select("i").distinct(), F.lit(1), "i", out="place").select("i", "place")
    before = reordering.path_distances(rows, before).agg(F.sum("distance").alias("distance_before"))
    after = reordering.path_distances(rows, reordering.nearest_order(rows)).agg(
        F.count_distinct("i").alias("n_rows"), F.count_distinct("place").alias("places"), F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.sum("distance").alias("reached")
    )
    return after.crossJoin(before).select("n_rows", "places", "first_place", "last_place", (F.col("reached") * 4 <= F.col("distance_before") * 3).alias("nearer"), "distance_before")


# ---- order statistics, profiles, matchings ----------------------------------------------------


@query("SELECT l_returnflag AS f, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, quantile_cont(l_linenumber, 0.5) AS line FROM lineitem GROUP BY 1")
def price_percentiles(spark, d):
    """Percentiles of a few groups that hold all rows."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f")
    prices = percentiles(rows, ["f"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "p99": 0.99})
    return prices.join(percentiles(rows, ["f"], "l_linenumber", {"line": 0.5}), "f").select("f", *[r(c, 4).alias(c) for c in ("q1", "q2", "p99")], "line")


def _chains(spark, d):
    """Orders as events, each below the one before it of the same customer."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")  # one customer's orders
    total = F.sum("o_totalprice").over(by.rowsBetween(0, Window.unboundedFollowing))
    orders = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "o_custkey")
    return orders.select(F.col("o_orderkey").alias("event"), F.lag("o_orderkey").over(by).alias("parent"), F.col("o_orderpriority").alias("name"), total.alias("total"))


@query(
    """WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AS hit, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    t AS (SELECT hit, o_totalprice AS own, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total,
        coalesce(bool_or(hit) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS covered FROM o)
    SELECT CASE WHEN hit THEN 'urgent' ELSE 'remaining' END AS kernel, round(sum(CASE WHEN hit THEN total ELSE own END), 1) AS time FROM t WHERE NOT covered GROUP BY 1"""
)
def profile_of_chains(spark, d):
    """Each customer's orders as a chain of events, each below the one before, rolled up by mapped name."""
    return results.profile_shares(_chains(spark, d), {"1-URGENT": "urgent"}).select("kernel", r("time", 1).alias("time"))


@query(
    f"""WITH RECURSIVE h AS (SELECT i // {PANEL} AS p, j, CAST(bit_or(1 << CAST(i % {PANEL} AS INTEGER)) AS INTEGER) AS pattern FROM {{A}} GROUP BY 1, 2), g AS (SELECT pattern AS id, count(*) AS n, bit_count(pattern) AS bits FROM h GROUP BY 1),
    x AS MATERIALIZED (SELECT a.id AS a, b.id AS b, CAST(a.n * (bit_count(a.id | b.id) - a.bits) + b.n * (bit_count(a.id | b.id) - b.bits) AS BIGINT) AS padding FROM g a JOIN g b ON a.id < b.id),
    m AS (SELECT CAST([] AS INTEGER[]) AS taken, CAST(NULL AS STRUCT(padding BIGINT, a INTEGER, b INTEGER)) AS e
        UNION ALL SELECT list_concat(taken, [e.a, e.b]), e FROM (SELECT taken, min(struct_pack(padding := padding, a := a, b := b)) AS e FROM m JOIN x ON NOT list_contains(taken, x.a) AND NOT list_contains(taken, x.b) GROUP BY taken))
    SELECT e.a AS a, e.b AS b, e.padding AS padding FROM m WHERE e IS NOT NULL"""
)
def matched_groups(spark, d):
    """Greedy matching of all patterns of eight rows by the zeros that a shared kernel pads."""
    hist = patterns.codes(matrix_a(spark, d), PANEL).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    costs = patterns.group_pair_costs(hist.select(F.col("pattern").alias("group_id"), "pattern", "cnt"))
    return patterns.matching(costs).select("a", "b", F.col("padding").cast("bigint").alias("padding"))


# ---- files by ranges --------------------------------------------------------------------------


@query("SELECT i, j, 1.0::DOUBLE AS v FROM {A}")
def smtx_by_ranges(spark, d):
    """The matrix through SMTX files that are written and read by parts."""
    path = new_path(spark, "smtx-parts")
    split_readers.write_smtx_parts(matrix_a(spark, d), *sizes(spark, d), path)
    return split_readers.read_smtx_ranges(spark, path, parts=True).select("i", "j", "v")


@query("SELECT i, j, 1.0::DOUBLE AS v FROM {A}")
def smtx_to_mtx(spark, d):
    """SMTX files made MatrixMarket files in one job, and read back."""
    source, target = new_path(spark, "smtx-parts"), new_path(spark, "mtx")
    m, k = sizes(spark, d)
    split_readers.write_smtx_parts(matrix_a(spark, d), m, k, source)
    matrices.write_mtx(split_readers.read_smtx_ranges(spark, source, parts=True), m, k, target)
    return split_readers.read_mtx_ranges(spark, target, parts=True).select("i", "j", "v")


@query("SELECT i, j, 1.0::DOUBLE AS v FROM {A} WHERE i >= 3 AND i < 9")
def smtx_rows(spark, d):
    """Some rows of a file; the columns of others are dropped by their place."""
    path = new_path(spark, "smtx-parts")
    split_readers.write_smtx_parts(matrix_a(spark, d), *sizes(spark, d), path)
    return split_readers.read_smtx_ranges(spark, path, parts=True, rows=(3, 9)).select("i", "j", "v")


@query("SELECT l_suppkey AS i, CAST(l_linenumber - 1 AS BIGINT) AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2")
def mtx_array_file(spark, d):
    """A dense matrix, suppliers by line numbers, through a MatrixMarket file of the array layout."""
    path, m = new_path(spark, "mtx"), table(spark, d, "supplier").count()
    found = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("bigint").alias("i"), (F.col("l_linenumber") - 1).cast("bigint").alias("j")).agg(F.sum("l_quantity").alias("v"))
    k = found.agg(F.max("j")).first()[0] + 1
    cells = spark.range(m * k).select((F.col("id") % m).alias("i"), F.floor(F.col("id") / m).alias("j")).join(found, ["i", "j"], "left")
    body = cells.select(F.struct("j", "i").alias("place"), F.coalesce("v", F.lit(0.0)).cast("string").alias("value"))
    lines = [("%%MatrixMarket matrix array real general", -2), (f"{m} {k}", -1)]
    head = spark.createDataFrame(lines, "value string, j bigint").select(F.struct("j", F.lit(0).cast("bigint").alias("i")).alias("place"), "value")
    head.unionByName(body).orderBy("place").select("value").write.text(path)
    return split_readers.read_mtx_ranges(spark, path, parts=True).select("i", "j", "v")


@query("SELECT i, j, CAST(v AS DOUBLE) AS v FROM {A}")
def block_tiles_file(spark, d):
    """The matrix as blocks of two by two in tiles of rows, through a coordinate-block file."""
    path, (m, k) = new_path(spark, "blocks"), sizes(spark, d)
    cell = matrix_a(spark, d).select(F.floor(F.col("i") / HEIGHT).alias("tile"), F.floor(F.col("i") / 2).alias("bi"), F.floor(F.col("j") / 2).alias("bj"), (F.col("i") % 2 * 2 + F.col("j") % 2).alias("at"), "v")
    held = cell.groupBy("tile", "bi", "bj").agg(*[F.coalesce(F.max(F.when(F.col("at") == n, F.col("v"))), F.lit(0)).cast("float").alias(f"v{n}") for n in range(4)])
    named = exclusive_prefix(held, F.lit(1), "bj", coarse=["bi"], by=["tile"], out="block")
    pair = lambda c: F.array(F.col(c) * 2, F.col(c) * 2 + 1)
    blocks = named.select("tile", "block", F.array(*[f"v{n}" for n in range(4)]).alias("values"), pair("bi").alias("rows"), pair("bj").alias("cols"))
    split_readers.block_lines(blocks, m, k, (2, 2), (HEIGHT, k), -(-m // HEIGHT)).orderBy("place.tile", "place.block", "place.line").select("value").write.text(path)
    return matrices.blocks_to_coo(split_readers.read_tiled_blocks(spark, path, parts=True)).where("v <> 0").select("i", "j", "v")


# ---- covers -----------------------------------------------------------------------------------


def pattern_family(spark, d, height):
    """``members, costs`` of the candidate groups of the patterns that the matrix has: the smaller family, and each alone."""
    counts = patterns.codes(matrix_a(spark, d), height).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
    shares = materialise(counts.select("pattern", (F.col("cnt") / counts.agg(F.sum("cnt")).scalar()).alias("share")), "shares")
    sets = patterns.overlap_subsets(spark, height).select("members").unionByName(shares.select(F.array("pattern").alias("members")))
    # Patterns that the matrix lacks cost nothing; sets that differ in them only are one.
    each = sets.select(F.monotonically_increasing_id().alias("n"), "members").select("n", F.explode("members").alias("pattern")).join(shares.select("pattern"), "pattern", "left_semi")
    whole = each.groupBy("n").agg(F.sort_array(F.collect_list("pattern")).alias("patterns")).select("patterns").distinct()  # at most 2^height patterns
    named = materialise(whole.select(F.monotonically_increasing_id().alias("subset_id"), "patterns"), "family")
    members = named.select("subset_id", F.explode("patterns").alias("pattern"))
    return named, members.withColumnRenamed("pattern", "element"), patterns.subset_costs(members, shares).select("subset_id", "cost")


@query()
def pattern_cover(spark, d):
    """Groups of the patterns of eight rows that share a kernel, at nearly the least cost: the groups, and how far the whole is from the bound."""
    named, members, costs = pattern_family(spark, d, PANEL)
    chosen, bound = covers.cover(members, costs)
    chosen = materialise(chosen, "cover")
    total = chosen.agg(F.sum("cost").alias("total_cost"))
    return chosen.join(named, "subset_id").crossJoin(total).select("patterns", "cost", "total_cost", F.lit(bound).alias("lower_bound"), ((F.col("total_cost") - F.lit(bound)) / F.col("total_cost")).alias("gap"))


@query(f"SELECT pattern, cnt, CAST(1 AS BIGINT) AS groups, true AS priced, true AS near FROM {mined_sql(4)}")
def pattern_cover_of_four(spark, d):
    """The patterns of four rows: each is in one group of the cover, no group costs more than its patterns alone, and the whole is within a quarter of the bound."""
    counts = mined(spark, d, 4)
    named, members, costs = pattern_family(spark, d, 4)
    chosen, bound = covers.cover(members, costs)
    held = chosen.join(named, "subset_id").select("cost", "patterns", F.explode("patterns").alias("pattern"))
    single = named.where(F.size("patterns") == 1).join(costs, "subset_id").select(F.col("patterns")[0].alias("pattern"), F.col("cost").alias("alone"))
    priced = held.join(single, "pattern").groupBy("patterns", "cost").agg((F.first("cost") <= F.sum("alone") + 1e-9).alias("priced")).select("patterns", "priced")
    total = chosen.agg((F.sum("cost") * 0.75 <= F.lit(bound)).alias("near"))
    each = held.join(priced, "patterns").groupBy("pattern").agg(F.count(F.lit(1)).alias("groups"), F.bool_and("priced").alias("priced"))
    return counts.join(each, "pattern").crossJoin(total).select("pattern", "cnt", "groups", "priced", "near")


# ---- rectangles -------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT s_suppkey AS rectangle, s_suppkey * 7 % {M} AS i0, s_suppkey * 7 % {M} + 1 + s_suppkey % 9 AS i1, s_suppkey * 131 % {K} AS j0, s_suppkey * 131 % {K} + 1 + s_suppkey * 37 % 500 AS j1 FROM supplier),
    h AS (SELECT i, j, arg_min(rectangle, (-(i1 - i0) * (j1 - j0), rectangle)) AS rectangle FROM {A} JOIN r ON i >= i0 AND i < i1 AND j >= j0 AND j < j1 GROUP BY 1, 2)
    SELECT i, j, v, rectangle FROM {A} LEFT JOIN h USING (i, j)"""
)
def entry_rectangles(spark, d):
    """Every entry with the largest of free rectangles, one for each supplier, that holds it."""
    m, k = sizes(spark, d)
    s = F.col("s_suppkey")
    i0, j0 = s * 7 % m, s * 131 % k
    free = table(spark, d, "supplier").select(s.alias("rectangle"), i0.alias("i0"), (i0 + 1 + s % 9).alias("i1"), j0.alias("j0"), (j0 + 1 + s * 37 % 500).alias("j1"))
    return hybrid.entry_rectangles(matrix_a(spark, d), free)


@query("SELECT i, 0 AS c, round(sum(v * p_size), 4) AS x FROM {A} JOIN part ON j = p_partkey GROUP BY 1")
def spmm_rectangles(spark, d):
    """The product by its parts: entries inside free rectangles, and the remainder."""
    parts = materialise(entry_rectangles(spark, d), "parts")
    inside, rest = (linalg.spmm_coord(parts.where(test).select("i", "j", "v"), part_b(spark, d)) for test in ("rectangle is not null", "rectangle is null"))
    return inside.unionByName(rest).groupBy("i", "c").agg(r(F.sum("x"), 4).alias("x"))


# ---- fits -------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE k AS (SELECT i // 4 AS p, pattern, count(*) AS n FROM (SELECT i // 4 AS p4, i // 4 * 4 AS i, j, bit_or(1 << CAST(i % 4 AS INTEGER)) AS pattern FROM {O_SQL} GROUP BY 1, 2, 3) GROUP BY 1, 2),
    f AS (SELECT p, 1::DOUBLE AS a, count(*)::DOUBLE AS b, sum(n)::DOUBLE AS c, sum(n * bit_count(pattern))::DOUBLE AS d FROM k GROUP BY 1), t AS (SELECT l_orderkey // 4 AS p, CAST(sum(l_extendedprice) AS DOUBLE) AS y FROM lineitem GROUP BY 1),
    g AS (SELECT [[sum(a * a), sum(a * b), sum(a * c), sum(a * d), sum(a * y)], [sum(a * b), sum(b * b), sum(b * c), sum(b * d), sum(b * y)], [sum(a * c), sum(b * c), sum(c * c), sum(c * d), sum(c * y)], [sum(a * d), sum(b * d), sum(c * d), sum(d * d), sum(d * y)]] AS m FROM f JOIN t USING (p)),
    s AS (SELECT 1 AS step, m FROM g UNION ALL SELECT step + 1, list_transform(range(1, 5), lambda r: CASE WHEN r = step THEN list_transform(m[step], lambda x: x / m[step][step]) ELSE list_transform(range(1, 6), lambda q: m[r][q] - m[r][step] * m[step][q] / m[step][step]) END) FROM s WHERE step < 5)
    SELECT feature, round(m[n][5], 2) AS coefficient FROM s, (SELECT unnest(['base', 'codes', 'cols', 'nnz']) AS feature, unnest(range(1, 5)) AS n) WHERE step = 5"""
)
def cost_fit_of_panels(spark, d):
    """What a panel of four orders costs by a base, its different patterns, its columns and its entries: a least-squares
    fit of prices."""
    found = patterns.codes(matrix_o(spark, d), 4).groupBy("p", "pattern").agg(F.count(F.lit(1)).alias("n"))
    features = found.groupBy("p").agg(F.lit(1.0).alias("base"), F.count(F.lit(1)).cast("double").alias("codes"), F.sum("n").cast("double").alias("cols"), F.sum(F.col("n") * F.bit_count("pattern")).cast("double").alias("nnz"))
    price = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 4).alias("p")).agg(F.sum("l_extendedprice").cast("double").alias("price"))
    names = ["base", "codes", "cols", "nnz"]
    fit = patterns.least_squares(features.join(price, "p"), names, "price")
    return spark.createDataFrame([(n, round(x, 2)) for n, x in zip(names, fit)], "feature string, coefficient double")
