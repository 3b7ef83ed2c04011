"""Spatial joins by grid cells, voxel sets, and polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import settle

SIX = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"c{x}": F.floor(F.col(x) / size) for x in "xyz"})


def ball_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(q, p, d) of all pairs within ``radius``: an equi-join on grid cells of that size, then the exact distance.

    Queries (q, x, y, z) go to the 27 cells around them; points (p, x, y, z) stay in theirs.
    """
    near = _cells(queries, radius)
    for x in "xyz":
        near = near.withColumn(f"c{x}", F.explode(F.sequence(F.col(f"c{x}") - 1, F.col(f"c{x}") + 1)))
    near = near.select("q", "cx", "cy", "cz", *[F.col(x).alias("q" + x) for x in "xyz"])
    d = F.sqrt(sum(((F.col(x) - F.col("q" + x)) ** 2 for x in "yz"), (F.col("x") - F.col("qx")) ** 2))
    return near.join(_cells(points, radius), ["cx", "cy", "cz"]).withColumn("d", d).where(F.col("d") <= radius).select("q", "p", "d")


def knn_join(queries: DataFrame, points: DataFrame, k: int, radius: float, most_rounds: int = 24) -> DataFrame:
    """(q, p, d, rank): the k nearest points of each query, ties by p; exact.

    Balls of ``radius`` first; a query with k points within its ball is settled, the rest go on with twice
    the radius, until all have k points or the ball covers everything. Rounds follow the logarithm of the
    largest distance. What is settled and what is left are written in each round, so no round computes the ones before.
    """
    total = points.limit(k).count()
    ranked = W.partitionBy("q").orderBy("d", "p")
    left, out = queries, None
    for _ in range(most_rounds):
        found = settle(ball_join(left, points, radius).withColumn("rank", F.row_number().over(ranked) - 1).where(F.col("rank") < k))
        full = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= total).select("q")
        settled = found.join(full, "q", "left_semi")
        out = settled if out is None else out.unionByName(settled)
        left = settle(left.join(full, "q", "left_anti"))
        if left.isEmpty():
            return out
        radius *= 2
    raise RuntimeError("the radius is too small for these points")


def voxelize(points: DataFrame, size: float) -> DataFrame:
    """(i, j, k) of the cells that hold points."""
    return points.select(*[F.floor(F.col(x) / size).alias(c) for x, c in zip("xyz", "ijk")]).distinct()


def pool_by_voxel(points: DataFrame, size: float) -> DataFrame:
    """(i, j, k, n, x, y, z): the number and mean of the points of each cell."""
    return points.groupBy(*[F.floor(F.col(x) / size).alias(c) for x, c in zip("xyz", "ijk")]).agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in "xyz"])


def _around(cells: DataFrame) -> DataFrame:
    return cells.select(F.inline(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip("ijk", o)], *[F.col(c).alias("o" + c) for c in "ijk"]) for o in SIX])))


def dilate(cells: DataFrame) -> DataFrame:
    """The cells and their six neighbours."""
    return _around(cells).select(*"ijk").distinct()


def erode(cells: DataFrame) -> DataFrame:
    """The cells whose six neighbours are all there."""
    inside = _around(cells).join(cells, list("ijk"), "left_semi")
    return inside.groupBy("oi", "oj", "ok").agg(F.count("*").alias("n")).where(F.col("n") == len(SIX)).select(F.col("oi").alias("i"), F.col("oj").alias("j"), F.col("ok").alias("k"))


def voxel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def voxel_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, list("ijk"), "left_semi")


def voxel_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, list("ijk"), "left_anti")


def _steps(lines: DataFrame) -> DataFrame:
    w = W.partitionBy("line_id").orderBy("x", "pos")
    square = sum(((F.col(x) - F.lag(x).over(w)) ** 2 for x in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2)
    return lines.withColumn("step", F.sqrt(square))


def polyline_lengths(lines: DataFrame) -> DataFrame:
    """(line_id, n_points, length) of polylines (line_id, pos, x, y, z) in order of x."""
    return _steps(lines).groupBy("line_id").agg(F.count("*").alias("n_points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def cumulative_arc_length(lines: DataFrame) -> DataFrame:
    """(line_id, pos, arc): the length up to each point."""
    w = W.partitionBy("line_id").orderBy("x", "pos").rowsBetween(W.unboundedPreceding, 0)
    return _steps(lines).select("line_id", "pos", "x", F.coalesce("step", F.lit(0.0)).alias("step")).select("line_id", "pos", F.sum("step").over(w).alias("arc"))


def ball_sum(queries: DataFrame, points: DataFrame, radius: float, val: str) -> DataFrame:
    """(q, n, total): the number of points (p, x, y, z, val) within ``radius`` of each query, and the sum of their values."""
    near = ball_join(queries, points, radius).join(points.select("p", F.col(val).alias("val")), "p")
    found = near.groupBy("q").agg(F.count("*").alias("n"), F.sum("val").alias("total"))
    return queries.select("q").join(found, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def initial_radius(points: DataFrame, k: int) -> float:
    """The radius of a ball that holds k points on average, if the points filled their box evenly; one row is read."""
    r = points.agg(F.count("*").alias("n"), *[(F.max(x) - F.min(x)).alias(x) for x in "xyz"]).first()
    sides = [max(r[x] or 0.0, 1e-9) for x in "xyz"]
    return max(1e-9, (3 * k * sides[0] * sides[1] * sides[2] / (4 * 3.141592653589793 * max(1, r["n"]))) ** (1 / 3))


def mutual_nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(p, q, d) of points of two clouds (p, x, y, z) that are each other's nearest, ties by the least id."""
    there = knn_join(a.withColumnRenamed("p", "q"), b, 1, radius).select(F.col("q").alias("a"), F.col("p").alias("b"), "d")
    back = knn_join(b.withColumnRenamed("p", "q"), a, 1, radius).select(F.col("q").alias("b"), F.col("p").alias("a"))
    return there.join(back, ["a", "b"]).select(F.col("a").alias("p"), F.col("b").alias("q"), "d")


def closest_pair(points: DataFrame, radius: float) -> DataFrame:
    """One row (p, q, d): the two points nearest to each other, p < q, ties by the least ids; none of fewer than two points."""
    if points.limit(2).count() < 2:
        return points.limit(0).select("p", F.col("p").alias("q"), F.lit(0.0).alias("d"))
    near = knn_join(points.withColumnRenamed("p", "q"), points, 2, radius).where("q <> p")
    pairs = near.select(F.struct("d", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).alias("b"))
    return pairs.agg(F.min("b").alias("b")).select("b.p", "b.q", "b.d")


def cell_indices(points: DataFrame, size: float, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """``points`` with i, j, k: the cell that each falls in."""
    return points.withColumns({c: F.floor((F.col(x) - float(o)) / size) for c, x, o in zip("ijk", "xyz", origin)})


def occupancy_at_cells(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (i, j, k) with ``occupied``: whether the grid has them."""
    return cells.join(grid.select("i", "j", "k").distinct().withColumn("occupied", F.lit(True)), ["i", "j", "k"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))


def sample_surface(vertices: DataFrame, faces: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(f, k, x, y, z): about ``count`` points, uniform over the surface.

    A face gets the whole part of its share of the count, and one more with the probability of the rest. Draws are
    digests of seed, face and number, so that reruns and other partitionings give the same points.
    """
    from .geometry import corners, face_geometry

    draw = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("double") / 2.0**32
    area = face_geometry(vertices, faces).select("f", "area")
    total = F.broadcast(area.agg(F.sum("area").alias("whole")))
    wanted = area.crossJoin(total).withColumn("n", F.floor(F.col("area") / F.col("whole") * count + draw("f", F.lit("n"))))
    rows = wanted.where("n > 0").select("f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    r, t = F.sqrt(draw("f", "k", F.lit("r"))), draw("f", "k", F.lit("t"))
    at = rows.join(corners(vertices, faces), "f").withColumn("r", r).withColumn("t", t)
    return at.select("f", "k", *[((1 - F.col("r")) * F.col("a" + x) + F.col("r") * (1 - F.col("t")) * F.col("b" + x) + F.col("r") * F.col("t") * F.col("c" + x)).alias(x) for x in "xyz"])
