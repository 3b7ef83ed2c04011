"""Points against meshes: nearest faces by growing grid cells, vertical lines by columns of cells, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elements import closest_points
from .geometry import corners
from .graph import settle


def _box_cells(c: DataFrame, size: float, reach: float, axes: str) -> DataFrame:
    """``c`` once for each cell (gx, ...) that the box of a face, ``reach`` larger on all sides, touches."""
    for x in axes:
        low, high = F.least(*[F.col(n + x) for n in "abc"]) - reach, F.greatest(*[F.col(n + x) for n in "abc"]) + reach
        c = c.withColumn("g" + x, F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    return c


def closest_point_on_mesh(queries: DataFrame, vertices: DataFrame, faces: DataFrame, radius: float, most_rounds: int = 24) -> DataFrame:
    """(q, f, x, y, z, d): the nearest point of the mesh to each query (q, x, y, z) and its face, ties by the least face; exact.

    Faces go to the grid cells, as wide as the radius, that their boxes reach within it; a query looks into its own
    cell and is settled if it finds a face within the radius. The rest go on with twice the radius; what is left is
    written each round. Without faces nothing comes out.
    """
    c = settle(corners(vertices, faces))
    if c.isEmpty():
        return queries.limit(0).select("q", F.lit(0).cast("long").alias("f"), *[F.col(x) for x in "xyz"], F.lit(0.0).alias("d"))
    left, out = queries.select("q", "x", "y", "z"), None
    for _ in range(most_rounds):
        cells = _box_cells(c, radius, radius, "xyz").select("f", "gx", "gy", "gz")
        at = left.withColumns({"g" + x: F.floor(F.col(x) / radius) for x in "xyz"})
        pairs = at.join(cells, ["gx", "gy", "gz"]).select(F.struct("q", "f").alias("pair"), "q", "f", "x", "y", "z")
        found = closest_points(vertices, faces.join(pairs.select("f", "pair"), "f").select(F.col("pair").alias("f"), "i0", "i1", "i2"), pairs.select(F.col("pair").alias("f"), "x", "y", "z"))
        near = found.where(F.col("d") <= radius).select(F.col("f.q").alias("q"), F.struct("d", F.col("f.f").alias("f"), "x", "y", "z").alias("b"))
        done = settle(near.groupBy("q").agg(F.min("b").alias("b")).select("q", "b.f", "b.x", "b.y", "b.z", "b.d"))
        out = done if out is None else out.unionByName(done)
        left = settle(left.join(done.select("q"), "q", "left_anti"))
        if left.isEmpty():
            return out
        radius *= 2
    raise RuntimeError("the radius is too small for these points")


def distance_to_mesh(queries: DataFrame, vertices: DataFrame, faces: DataFrame, radius: float) -> DataFrame:
    """One row: the mean, mean square and largest distance of the queries from the mesh, as one-sided Chamfer and Hausdorff measures."""
    d = closest_point_on_mesh(queries, vertices, faces, radius)
    return d.agg(F.avg("d").alias("chamfer"), F.avg(F.col("d") ** 2).alias("chamfer_squared"), F.max("d").alias("hausdorff"))


def transfer_onto_points(queries: DataFrame, vertices: DataFrame, faces: DataFrame, values: DataFrame, radius: float) -> DataFrame:
    """(p, val): a vertex field (v, val) at the point of the mesh nearest to each query."""
    from .elements import points_to_barycentric
    from .fields import interpolate_barycentric

    at = settle(closest_point_on_mesh(queries, vertices, faces, radius))
    pair = F.struct("q", "f")
    placed = faces.join(at.select("f", "q"), "f").select(F.struct("q", "f").alias("f"), "i0", "i1", "i2")
    w = points_to_barycentric(vertices, placed, at.select(pair.alias("f"), "x", "y", "z"))
    return interpolate_barycentric(faces, w.select(F.col("f.q").alias("p"), F.col("f.f").alias("f"), "w0", "w1", "w2"), values)


def column_hits(queries: DataFrame, vertices: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """(q, f, height): where the vertical line through each query (q, x, y, z) meets faces; ``height`` is over the query.

    Queries meet the faces of their column of cells. A side belongs to the face for whose turned corners it runs
    upwards in y, so that of two faces beside it one is met; faces upright over their shadow are not met.
    """
    c = _box_cells(corners(vertices, faces), size, 0.0, "xy")
    at = queries.select("q", *[F.col(x).alias("q" + x) for x in "xyz"]).withColumns({"g" + x: F.floor(F.col("q" + x) / size) for x in "xy"})
    j = at.join(c, ["gx", "gy"])

    def crossed(p: str, q: str):
        """Whether the side p - q crosses the ray from the query towards greater x, by the half-open rule."""
        py, qy = F.col(p + "y"), F.col(q + "y")
        at_x = F.col(p + "x") + (F.col("qy") - py) / (qy - py) * (F.col(q + "x") - F.col(p + "x"))
        return ((py > F.col("qy")) != (qy > F.col("qy"))) & (F.col("qx") < at_x)

    odd = sum((F.coalesce(crossed(*s), F.lit(False)).cast("int") for s in ("bc", "ca")), F.coalesce(crossed("a", "b"), F.lit(False)).cast("int")) % 2 == 1
    ux, uy, uz, vx, vy, vz = (F.col(n + x) - F.col("a" + x) for n in "bc" for x in "xyz")
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    height = F.col("az") - (nx * (F.col("qx") - F.col("ax")) + ny * (F.col("qy") - F.col("ay"))) / nz - F.col("qz")
    return j.where(odd).select("q", "f", height.alias("height"))


def contains_points(queries: DataFrame, vertices: DataFrame, faces: DataFrame, size: float) -> DataFrame:
    """(q, inside): whether a closed mesh holds each query: an odd number of faces lies above it."""
    above = column_hits(queries, vertices, faces, size).where("height > 0").groupBy("q").agg(F.count("*").alias("n"))
    return queries.select("q").join(above, "q", "left").select("q", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))
