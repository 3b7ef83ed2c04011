"""Reductions, per-group and per-segment aggregates, grouping, and array primitives.

A buffer is a relation (pos, val); positions run from 0. Groups that must exist without rows come from a
relation of group ids. Sums combine before the shuffle; nothing is gathered by a driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def reduce_all(df: DataFrame, val: str = "val") -> DataFrame:
    """One row: min, max, sum, mean, any and all of a column; empty gives 0, NaN, false and true."""
    v = F.col(val)
    return df.agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.avg(v), F.lit(NAN)).alias("mean"),
        F.coalesce(F.bool_or(v != 0), F.lit(False)).alias("any"),
        F.coalesce(F.bool_and(v != 0), F.lit(True)).alias("all"),
    )


def weighted_sum(df: DataFrame, val: str, weight: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.col(val) * F.col(weight)), F.lit(0.0)).alias("weighted_sum"))


def quantile(df: DataFrame, q: float | list[float], val: str = "val") -> DataFrame:
    """Exact quantiles with linear interpolation, one row each."""
    qs = [q] if isinstance(q, (int, float)) else list(q)
    wide = df.agg(F.percentile(val, F.array(*[F.lit(float(x)) for x in qs])).alias("all"))
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("q"), F.col("all")[i].alias("value")) for i, x in enumerate(qs)])
    return wide.select(F.inline(pairs))


def median(df: DataFrame, val: str = "val") -> DataFrame:
    return df.agg(F.percentile(val, 0.5).alias("median"))


def scatter(df: DataFrame, groups: DataFrame, group: str, val: str) -> DataFrame:
    """Per group of ``groups``: sum, mean, min, max and count; a group without rows has 0, NaN, inf, -inf, 0."""
    v = F.col(val)
    found = df.groupBy(group).agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    fill = {"sum": 0.0, "mean": NAN, "min": INF, "max": -INF}
    joined = groups.select(group).distinct().join(found, group, "left")
    return joined.select(group, *[F.coalesce(F.col(c), F.lit(x)).alias(c) for c, x in fill.items()], F.coalesce("n", F.lit(0)).alias("n"))


def segments_of(offsets: DataFrame) -> DataFrame:
    """(segment, lo, hi) from total-terminated (segment, offset) rows."""
    following = F.lead("offset").over(W.orderBy("segment"))
    return offsets.withColumn("hi", following).where("hi is not null").select("segment", F.col("offset").alias("lo"), "hi")


def segment(df: DataFrame, spans: DataFrame, pos: str = "pos", val: str = "val") -> DataFrame:
    """``scatter`` over contiguous segments (segment, lo, hi), found by an equi-join on exploded positions."""
    inside = spans.where("hi > lo").select("segment", F.explode(F.sequence("lo", F.col("hi") - 1)).alias(pos))
    return scatter(inside.join(df, pos), spans, "segment", val)


def counts_to_offsets(df: DataFrame, pos: str = "pos", count: str = "count", parts: int = 64) -> DataFrame:
    """(pos, offset): exclusive running sums in order of pos, in two levels.

    Positions are cut into ``parts`` equal ranges; ranges are summed, their few sums are scanned, and each
    range is scanned on its own, so that no task sees all rows.
    """
    top = df.agg(F.max(pos).alias("top"))
    cut = df.crossJoin(F.broadcast(top)).withColumn("part", F.floor(F.col(pos) * parts / (F.col("top") + 1)))
    sums = cut.groupBy("part").agg(F.sum(count).alias("s")).withColumn("carry", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(count).over(W.partitionBy("part").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("within", within).join(F.broadcast(sums.select("part", "carry")), "part").select(pos, (F.col("carry") + F.col("within")).alias("offset"))


def mask_to_compact_ranks(df: DataFrame, mask: str = "mask", invert: bool = False) -> DataFrame:
    """(pos, rank): the rank among true positions, -1 elsewhere."""
    flag = (~F.col(mask) if invert else F.col(mask)).cast("long")
    ranks = counts_to_offsets(df.select("pos", flag.alias("count")))
    return df.select("pos", flag.alias("flag")).join(ranks, "pos").select("pos", F.when(F.col("flag") == 1, F.col("offset")).otherwise(-1).alias("rank"))


def sort_and_argsort(df: DataFrame, key: str = "val") -> DataFrame:
    """(rank, key, pos) in a stable ascending order; NaN last."""
    return df.select(F.col(key).alias("key"), "pos").withColumn("rank", F.row_number().over(W.orderBy("key", "pos")) - 1)


def isin(df: DataFrame, test: DataFrame, val: str = "val") -> DataFrame:
    """(pos, hit): whether each value is in ``test``."""
    known = test.select(F.col(val).alias("_known")).distinct()
    return df.join(known, df[val] == known["_known"], "left").select("pos", F.col("_known").isNotNull().alias("hit"))


def gather(src: DataFrame, indices: DataFrame) -> DataFrame:
    """(pos, val): src at each index, in the order of the indices."""
    return indices.select("pos", F.col("val").alias("at")).join(src.select(F.col("pos").alias("at"), "val"), "at").select("pos", "val")


def remap_indices(indices: DataFrame, lookup: DataFrame) -> DataFrame:
    """Indices through a table; negative ones pass as they are."""
    found = indices.select("pos", F.col("val").alias("at")).join(lookup.select(F.col("pos").alias("at"), F.col("val").alias("to")), "at", "left")
    return found.select("pos", F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("to")).alias("val"))


def flatnonzero(df: DataFrame, val: str = "val") -> DataFrame:
    return df.where(F.col(val) != 0).select("pos")


def indices_to_mask(indices: DataFrame, universe: DataFrame) -> DataFrame:
    marked = indices.select(F.col("val").alias("pos")).distinct().withColumn("_hit", F.lit(True))
    return universe.select("pos").join(marked, "pos", "left").select("pos", F.coalesce("_hit", F.lit(False)).alias("mask"))


def index_bound(indices: DataFrame) -> DataFrame:
    return indices.agg(F.coalesce(F.max("val") + 1, F.lit(0)).alias("bound"))


def allclose(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: whether two buffers agree within a tolerance; unequal lengths do not."""
    both = a.select("pos", F.col("val").alias("x")).join(b.select("pos", F.col("val").alias("y")), "pos", "full_outer")
    near = F.coalesce(F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(near), F.lit(True)).alias("allclose"))


def csr_from_triplets(df: DataFrame, n_rows: int, n_cols: int, prune_zeros: bool = False) -> DataFrame:
    """(row, col, val): triplets in range, duplicates summed."""
    inside = df.where((F.col("row") >= 0) & (F.col("row") < n_rows) & (F.col("col") >= 0) & (F.col("col") < n_cols))
    summed = inside.groupBy("row", "col").agg(F.sum("val").alias("val"))
    return summed.where("val <> 0") if prune_zeros else summed


def csr_transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(pos, val): the product with a vector; rows without entries are left out."""
    x = vector.select(F.col("pos").alias("col"), F.col("val").alias("x"))
    return matrix.join(x, "col").groupBy(F.col("row").alias("pos")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, val): the product of two sparse matrices, a join on the inner index and a grouped sum."""
    left, right = a.select("row", F.col("col").alias("k"), F.col("val").alias("x")), b.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def group(df: DataFrame, keys: list[str], length: int, pos: str = "pos") -> DataFrame:
    """(members): sorted positions of values that occur exactly ``length`` times."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == length).drop("_n")
    return df.join(counted, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(pos)).alias("members"))


def unique(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys..., first position and count of each different row."""
    return df.groupBy(*keys).agg(F.min(pos).alias("first"), F.count("*").alias("n"))


def unique_inverse(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """(pos, inverse): the rank of each value among the sorted different ones."""
    ranks = df.select(key).distinct().withColumn("inverse", F.row_number().over(W.orderBy(key)) - 1)
    return df.join(ranks, key).select(pos, "inverse")


def rows_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows as often, in any order."""
    columns = a.columns
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return counted.agg(F.coalesce(F.max(F.abs("_n")), F.lit(0)).alias("_m")).select((F.col("_m") == 0).alias("equal"))


def partitions_equal(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: whether two labellings of the same rows are the same partition."""
    pairs = labels.select(a, b).distinct()
    return pairs.agg(F.count("*").alias("p"), F.countDistinct(a).alias("x"), F.countDistinct(b).alias("y")).select(((F.col("p") == F.col("x")) & (F.col("p") == F.col("y"))).alias("equal"))


def space_cell(columns: list[str], size: float) -> list[Column]:
    """Integer cell columns of points at a cell size."""
    return [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in columns]
