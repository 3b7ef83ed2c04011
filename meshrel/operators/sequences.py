"""Ranges, packed arrays, row keys, bit ranks, block-diagonal matrices and equality of unordered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def arange(spark: SparkSession, stop: int, start: int = 0, step: int = 1) -> DataFrame:
    """(pos, val): start, start + step, ... before ``stop``."""
    n = max(0, -(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * step + start).alias("val"))


def arange_repeat(spark: SparkSession, count: int, repeats: int) -> DataFrame:
    """(pos, val): each number below ``count``, ``repeats`` times in a row."""
    return spark.range(count * repeats).select(F.col("id").alias("pos"), F.floor(F.col("id") / repeats).alias("val"))


def pack_arrays(arrays: list[DataFrame]) -> DataFrame:
    """(array, pos, val): several arrays (pos, val) as one table; ``array`` is the number of each."""
    return reduce(DataFrame.unionByName, [a.select(F.lit(i).cast("long").alias("array"), "pos", "val") for i, a in enumerate(arrays)])


def concatenate(arrays: list[DataFrame]) -> DataFrame:
    """(pos, val): one after the other; one row per array is counted first."""
    packed = pack_arrays(arrays)
    sizes = packed.groupBy("array").agg(F.count("*").alias("n"))
    # One row per array.
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(W.orderBy("array").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return packed.join(F.broadcast(offsets), "array").select((F.col("pos") + F.col("offset")).alias("pos"), "val")


def split(df: DataFrame, bounds: list[int]) -> DataFrame:
    """(piece, pos, val): an array (pos, val) cut before each of the ascending ``bounds``; positions begin anew."""
    edges = [0, *bounds]
    piece = sum(((F.col("pos") >= b).cast("int") for b in bounds), F.lit(0))
    return df.withColumn("piece", piece).select("piece", (F.col("pos") - F.element_at(F.array(*map(F.lit, edges)), F.col("piece") + 1)).alias("pos"), "val")


def sort_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` in lexicographic order of its columns: a range partitioning at sampled splitters, sorted inside."""
    return df.orderBy(*columns)


def hash_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``key``: 64 bits that are equal for equal rows."""
    return df.withColumn("key", F.xxhash64(*columns))


def hashed_occurrence_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, n): how often each key of rows occurs."""
    return hash_rows(df, columns).groupBy("key").agg(F.count("*").alias("n"))


def undirected_edge_keys(edges: DataFrame, n: int) -> DataFrame:
    """(key): lo + hi * n of the different edges (a, b), for membership tests by an equi-join."""
    return edges.select((F.least("a", "b") + F.greatest("a", "b") * n).alias("key")).distinct()


def edges_unique_inverse(faces: DataFrame) -> DataFrame:
    """(f, k, edge): the edge of each corner, as the least half-edge on it."""
    from .topology import halfedges

    h = halfedges(faces).select("h", "f", "k", "lo", "hi")
    return h.join(h.groupBy("lo", "hi").agg(F.min("h").alias("edge")), ["lo", "hi"]).select("f", "k", "edge")


def bit_ranks(words: DataFrame) -> DataFrame:
    """(pos, rank): the bits set in the words up to each one, itself included; sums of blocks of 4,096 words first."""
    bits = words.select("pos", F.floor(F.col("pos") / 4096).alias("block"), F.bit_count("word").cast("long").alias("bits"))
    blocks = bits.groupBy("block").agg(F.sum("bits").alias("n"))
    # One row per block.
    before = F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("bits").over(W.partitionBy("block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return bits.withColumn("within", within).join(blocks.select("block", before.alias("before")), "block").select("pos", (F.col("before") + F.col("within")).alias("rank"))


def block_diagonal(matrices: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """(row, col, val) of matrices (entries, rows, columns) along the diagonal."""
    out, r, c = [], 0, 0
    for m, rows, columns in matrices:
        out.append(m.select((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), "val"))
        r, c = r + rows, c + columns
    return reduce(DataFrame.unionByName, out)


def canonical_faces(faces: DataFrame) -> DataFrame:
    """(i0, i1, i2) turned until the least vertex is first; the winding stays."""
    least = F.least("i0", "i1", "i2")
    turn = lambda a, b, c: F.when(F.col("i0") == least, F.col(a)).when(F.col("i1") == least, F.col(b)).otherwise(F.col(c))
    return faces.select(turn("i0", "i1", "i2").alias("i0"), turn("i1", "i2", "i0").alias("i1"), turn("i2", "i0", "i1").alias("i2"))


def faces_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same faces, up to their order and turns; as often."""
    sides = canonical_faces(a).withColumn("w", F.lit(1)).unionByName(canonical_faces(b).withColumn("w", F.lit(-1)))
    return sides.groupBy("i0", "i1", "i2").agg(F.sum("w").alias("w")).agg(F.coalesce(F.bool_and(F.col("w") == 0), F.lit(True)).alias("equal"))


def points_allclose(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """One row: whether two point sets (p, x, y, z) have as many points, and each has one of the other within ``tolerance``."""
    from .spatial import ball_join

    near = ball_join(a.withColumnRenamed("p", "q"), b, tolerance).select("q", "p")
    counts = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m")))
    matched = near.agg(F.countDistinct("q").alias("met"), F.countDistinct("p").alias("found"))
    return counts.crossJoin(matched).select(((F.col("n") == F.col("m")) & (F.col("met") == F.col("n")) & (F.col("found") == F.col("m"))).alias("close"))
