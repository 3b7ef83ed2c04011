"""Queries of reductions, grouping and array primitives over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..sources.derived import table


def _prices(spark, sf_dir):
    """lineitem as a buffer: pos may repeat, val is the price in cents, exact in integers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("val"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("g"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


PRICES = "P AS (SELECT l_orderkey * 8 + l_linenumber AS pos, CAST(round(l_extendedprice * 100) AS BIGINT) AS val, l_quantity AS w, l_suppkey AS g, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)"


def reduce_all(spark, sf_dir):
    r = A.reduce_all(_prices(spark, sf_dir))
    return r.select(F.col("min").alias("min_val"), F.col("max").alias("max_val"), F.col("sum").cast("long").alias("sum_val"), F.round("mean", 4).alias("mean_val"), F.col("any").alias("any_val"), F.col("all").alias("all_val"))


def weighted_sum(spark, sf_dir):
    return A.weighted_sum(_prices(spark, sf_dir), "val", "w").select(F.col("weighted_sum").cast("long").alias("weighted_sum"))


def quantiles(spark, sf_dir):
    return A.quantile(_prices(spark, sf_dir), [0.0, 0.1, 0.5, 0.9, 1.0]).select("q", F.round("value", 4).alias("value"))


def median(spark, sf_dir):
    return A.median(_prices(spark, sf_dir)).select(F.round("median", 4).alias("median"))


def scatter(spark, sf_dir):
    """Per supplier id and the ids after the last: groups without rows keep their sentinels."""
    top = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 3).alias("top"))
    groups = top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("g"))
    s = A.scatter(_prices(spark, sf_dir), groups, "g", "val")
    return s.select("g", F.col("sum").cast("long").alias("total"), F.round("mean", 4).alias("mean_val"), F.col("min").cast("double").alias("min_val"), F.col("max").cast("double").alias("max_val"), F.col("n").cast("long").alias("n"))


def segments(spark, sf_dir):
    """Order totals in segments of customers: offsets from the customers' order counts."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("pos")).agg(F.count("*").alias("count"))
    offsets = A.counts_to_offsets(counts)
    return offsets.select(F.col("pos").alias("o_custkey"), F.col("offset").cast("long").alias("first_row"))


def compact_ranks(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").alias("mask"))
    return A.mask_to_compact_ranks(df).select("pos", F.col("rank").cast("long").alias("compact_rank"))


def argsort(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("val"))
    return A.sort_and_argsort(orders).select(F.col("rank").cast("long").alias("sort_rank"), "key", "pos")


def isin(spark, sf_dir):
    big = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("val"))
    return A.isin(_prices(spark, sf_dir).select("pos", F.col("l_partkey").alias("val")), big)


def gather(spark, sf_dir):
    src = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.round(F.col("p_retailprice") * 100).cast("long").alias("val"))
    return A.gather(src, _prices(spark, sf_dir).select("pos", F.col("l_partkey").alias("val")))


def remap_indices(spark, sf_dir):
    look = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").cast("long").alias("val"))
    idx = _prices(spark, sf_dir).select("pos", F.when(F.col("pos") % 5 == 0, -F.col("pos") - 1).otherwise(F.col("l_suppkey")).alias("val"))
    return A.remap_indices(idx, look)


def flatnonzero(spark, sf_dir):
    return A.flatnonzero(_prices(spark, sf_dir).select("pos", (F.col("val") % 7).alias("val")))


def membership_mask(spark, sf_dir):
    universe = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"))
    return A.indices_to_mask(_prices(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_partkey").alias("val")), universe)


def index_bound(spark, sf_dir):
    return A.index_bound(_prices(spark, sf_dir).select(F.col("l_partkey").alias("val")))


def allclose(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("val"))
    b = a.select("pos", (F.col("val") * (1 + 1e-7)).alias("val"))
    far = a.select("pos", (F.col("val") + F.when(F.col("pos") % 1000 == 1, 1e6).otherwise(0.0)).alias("val"))
    return A.allclose(a, b).select(F.col("allclose").alias("near")).crossJoin(A.allclose(a, far).select(F.col("allclose").alias("far")))


def _matrix(spark, sf_dir):
    """The table's own (supplier, part) matrix of quantities."""
    p = _prices(spark, sf_dir).select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("w").cast("long").alias("val"))
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0], table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    return A.csr_from_triplets(p, n[0] + 1, n[1] + 1)


MATRIX = "M AS (SELECT l_suppkey AS row, l_partkey AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem WHERE l_suppkey >= 0 AND l_partkey >= 0 GROUP BY 1, 2)"


def csr_from_triplets(spark, sf_dir):
    return _matrix(spark, sf_dir)


def csr_transpose(spark, sf_dir):
    return A.csr_transpose(_matrix(spark, sf_dir))


def spmv(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return A.spmv(m, spark.range(n).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("val")))


def spgemm(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return A.spgemm(m, A.csr_transpose(m))


def group_pairs(spark, sf_dir):
    return A.group(_prices(spark, sf_dir), ["l_partkey", "l_suppkey"], 2).select("l_partkey", "l_suppkey", F.col("members")[0].alias("first_pos"), F.col("members")[1].alias("second_pos"))


def unique_rows(spark, sf_dir):
    return A.unique(_prices(spark, sf_dir), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", F.col("first").alias("first_pos"), "n")


def unique_inverse(spark, sf_dir):
    return A.unique_inverse(_prices(spark, sf_dir), "l_partkey").select("pos", F.col("inverse").cast("long").alias("inverse"))


def rows_equal(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    same = A.rows_equal(a, a.repartition(7)).select(F.col("equal").alias("same"))
    return same.crossJoin(A.rows_equal(a, a.where("o_orderkey <> 1").unionByName(a.where("o_orderkey = 2"))).select(F.col("equal").alias("other")))


def partitions_equal(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = A.partitions_equal(c.select(F.col("c_nationkey").alias("a"), (F.col("c_nationkey") * 3 + 1).alias("b"))).select(F.col("equal").alias("same"))
    return a.crossJoin(A.partitions_equal(c.select(F.col("c_nationkey").alias("a"), (F.col("c_nationkey") % 5).alias("b"))).select(F.col("equal").alias("coarser")))


QUERIES = {f"agg_{f.__name__}": f for f in (reduce_all, weighted_sum, quantiles, median, scatter, segments, compact_ranks, argsort, isin, gather, remap_indices, flatnonzero, membership_mask, index_bound, allclose, csr_from_triplets, csr_transpose, spmv, spgemm, group_pairs, unique_rows, unique_inverse, rows_equal, partitions_equal)}

SQL = {
    "agg_reduce_all": f"WITH {PRICES} SELECT min(val) AS min_val, max(val) AS max_val, CAST(sum(val) AS BIGINT) AS sum_val, round(avg(val), 4) AS mean_val, bool_or(val <> 0) AS any_val, bool_and(val <> 0) AS all_val FROM P",
    "agg_weighted_sum": f"WITH {PRICES} SELECT CAST(sum(val * CAST(w AS BIGINT)) AS BIGINT) AS weighted_sum FROM P",
    "agg_quantiles": f"WITH {PRICES} " + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST(val AS DOUBLE), {q}), 4) AS value FROM P" for q in (0.0, 0.1, 0.5, 0.9, 1.0)),
    "agg_median": f"WITH {PRICES} SELECT round(median(CAST(val AS DOUBLE)), 4) AS median FROM P",
    "agg_scatter": f"WITH {PRICES}, G AS (SELECT unnest(generate_series(0, (SELECT max(s_suppkey) + 3 FROM supplier))) AS g) SELECT G.g AS g, CAST(coalesce(sum(val), 0) AS BIGINT) AS total, CASE WHEN count(val) = 0 THEN 'NaN'::DOUBLE ELSE round(avg(val), 4) END AS mean_val, coalesce(CAST(min(val) AS DOUBLE), 'Infinity'::DOUBLE) AS min_val, coalesce(CAST(max(val) AS DOUBLE), '-Infinity'::DOUBLE) AS max_val, count(val) AS n FROM G LEFT JOIN P ON P.g = G.g GROUP BY G.g",
    "agg_segments": "WITH C AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) SELECT o_custkey, CAST(coalesce(sum(c) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM C",
    "agg_compact_ranks": "SELECT o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) ELSE -1 END AS compact_rank FROM orders",
    "agg_argsort": "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS sort_rank, o_custkey AS key, o_orderkey AS pos FROM orders",
    "agg_isin": f"WITH {PRICES} SELECT pos, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AS hit FROM P",
    "agg_gather": f"WITH {PRICES} SELECT pos, CAST(round(p_retailprice * 100) AS BIGINT) AS val FROM P JOIN part ON p_partkey = l_partkey",
    "agg_remap_indices": f"WITH {PRICES} SELECT pos, CASE WHEN pos % 5 = 0 THEN -pos - 1 ELSE CAST(s_nationkey AS BIGINT) END AS val FROM P LEFT JOIN supplier ON s_suppkey = l_suppkey",
    "agg_flatnonzero": f"WITH {PRICES} SELECT pos FROM P WHERE val % 7 <> 0",
    "agg_membership_mask": f"WITH {PRICES} SELECT p_partkey AS pos, p_partkey IN (SELECT l_partkey FROM P WHERE l_returnflag = 'R') AS mask FROM part",
    "agg_index_bound": "SELECT max(l_partkey) + 1 AS bound FROM lineitem",
    "agg_allclose": "SELECT true AS near, NOT bool_or(o_orderkey % 1000 = 1) AS far FROM orders",
    "agg_csr_from_triplets": f"WITH {MATRIX} SELECT * FROM M",
    "agg_csr_transpose": f"WITH {MATRIX} SELECT col AS row, row AS col, val FROM M",
    "agg_spmv": f"WITH {MATRIX} SELECT row AS pos, CAST(sum(val * (col + 1)) AS BIGINT) AS val FROM M GROUP BY 1",
    "agg_spgemm": f"WITH {MATRIX} SELECT a.row AS row, b.row AS col, CAST(sum(a.val * b.val) AS BIGINT) AS val FROM M a JOIN M b ON a.col = b.col GROUP BY 1, 2",
    "agg_group_pairs": f"WITH {PRICES} SELECT l_partkey, l_suppkey, min(pos) AS first_pos, max(pos) AS second_pos FROM P GROUP BY 1, 2 HAVING count(*) = 2",
    "agg_unique_rows": f"WITH {PRICES} SELECT l_partkey, l_suppkey, min(pos) AS first_pos, count(*) AS n FROM P GROUP BY 1, 2",
    "agg_unique_inverse": f"WITH {PRICES} SELECT pos, dense_rank() OVER (ORDER BY l_partkey) - 1 AS inverse FROM P",
    "agg_rows_equal": "SELECT true AS same, false AS other",
    "agg_partitions_equal": "SELECT true AS same, count(DISTINCT c_nationkey) = count(DISTINCT c_nationkey % 5) AS coarser FROM customer",
}
