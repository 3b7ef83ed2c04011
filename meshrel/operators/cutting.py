"""Plane cuts and level sets of meshes, each face by itself: no face needs another one's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import corners


def plane_field(vertices: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """(v, val): the signed height over a plane, in units of the normal's length."""
    return vertices.select("v", sum((float(n) * (F.col(x) - float(o)) for n, o, x in zip(normal, origin, "xyz")), F.lit(0.0)).alias("val"))


def segments_with_plane(segments: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0), line_segments: bool = True) -> DataFrame:
    """(s, valid, x, y, z): where segments (s, ax .. bz), or their lines, meet a plane; null if they do not."""
    height = lambda p: sum((float(n) * (F.col(p + x) - float(o)) for n, o, x in zip(normal, origin, "xyz")), F.lit(0.0))
    cut = segments.withColumn("da", height("a")).withColumn("db", height("b")).withColumn("t", F.when(F.col("da") != F.col("db"), F.col("da") / (F.col("da") - F.col("db"))))
    valid = F.col("t").isNotNull()
    if line_segments:
        valid = valid & F.col("t").between(0.0, 1.0)
    cut = cut.withColumn("valid", valid)
    return cut.select("s", "valid", *[F.when(F.col("valid"), F.col("a" + x) + F.col("t") * (F.col("b" + x) - F.col("a" + x))).alias(x) for x in "xyz"])


def _valued(vertices: DataFrame, faces: DataFrame, field: DataFrame, level: float) -> DataFrame:
    """Faces with their corners and da, db, dc: the field over ``level``; corners turn until the odd one out is a."""
    c = corners(vertices, faces)
    for k, name in (("i0", "a"), ("i1", "b"), ("i2", "c")):
        c = c.join(field.select(F.col("v").alias(k), (F.col("val") - level).alias("d" + name)), k)
    c = c.withColumn("above", sum(((F.col("d" + n) >= 0).cast("int") for n in "bc"), (F.col("da") >= 0).cast("int")))
    odd = lambda n: (F.col("d" + n) >= 0) == (F.col("above") == 1)
    first = F.when(F.col("above").isin(0, 3), 0).when(odd("a"), 0).when(odd("b"), 1).otherwise(2)
    c = c.withColumn("first", first)
    pick = lambda k, part: F.when(F.col("first") == 0, F.col(part["abc"[k]])).when(F.col("first") == 1, F.col(part["abc"[(k + 1) % 3]])).otherwise(F.col(part["abc"[(k + 2) % 3]]))
    turned = [pick(k, {n: n + x for n in "abc"}).alias(f"{'pqr'[k]}{x}") for k in range(3) for x in "xyz"]
    heights = [pick(k, {n: "d" + n for n in "abc"}).alias(f"d{'pqr'[k]}") for k in range(3)]
    return c.select("f", "above", *turned, *heights)


def _crossing(a: str, b: str) -> list[Column]:
    t = F.col("d" + a) / (F.col("d" + a) - F.col("d" + b))
    return [F.col(a + x) + t * (F.col(b + x) - F.col(a + x)) for x in "xyz"]


def level_segments(vertices: DataFrame, faces: DataFrame, field: DataFrame, level: float = 0.0) -> DataFrame:
    """(f, ax .. bz): the piece of the level set of a vertex field (v, val) inside each face; corners at the level count as above."""
    c = _valued(vertices, faces, field, level).where("above in (1, 2)")
    return c.select("f", *[p.alias("a" + x) for p, x in zip(_crossing("p", "q"), "xyz")], *[p.alias("b" + x) for p, x in zip(_crossing("p", "r"), "xyz")])


def mesh_with_plane(vertices: DataFrame, faces: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """(f, ax .. bz): the segments in which faces meet a plane."""
    return level_segments(vertices, faces, plane_field(vertices, normal, origin))


def clip_with_field(vertices: DataFrame, faces: DataFrame, field: DataFrame, level: float = 0.0) -> DataFrame:
    """(f, part, ax .. cz): the triangles of what lies at or above the level; part numbers those of one face."""
    c = _valued(vertices, faces, field, level)
    p, q, r = ([F.col(n + x) for x in "xyz"] for n in "pqr")
    pq, pr = _crossing("p", "q"), _crossing("p", "r")

    def triangle(part: int, a, b, d):
        return F.struct(F.lit(part).alias("part"), *[v.alias(n + x) for n, at in zip("abc", (a, b, d)) for v, x in zip(at, "xyz")])

    whole, tip = F.array(triangle(0, p, q, r)), F.array(triangle(0, p, pq, pr))
    base = F.array(triangle(0, pq, q, r), triangle(1, pq, r, pr))
    parts = F.when(F.col("above") == 3, whole).when(F.col("above") == 1, tip).when(F.col("above") == 2, base)
    return c.where("above > 0").select("f", F.inline(parts))


def slice_with_plane(vertices: DataFrame, faces: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """The triangles on the side of a plane to which its normal points."""
    return clip_with_field(vertices, faces, plane_field(vertices, normal, origin))


def split_with_plane(vertices: DataFrame, faces: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """The triangles of both sides, with ``side`` 1 or -1; a face in the plane goes to both."""
    back = tuple(-n for n in normal)
    return slice_with_plane(vertices, faces, normal, origin).withColumn("side", F.lit(1)).unionByName(slice_with_plane(vertices, faces, back, origin).withColumn("side", F.lit(-1)))


def split_faces_along_field(vertices: DataFrame, faces: DataFrame, field: DataFrame, level: float = 0.0) -> DataFrame:
    """All faces, those that the level crosses cut along it; ``side`` tells above (1) from below (-1)."""
    below = field.select("v", (-F.col("val")).alias("val"))
    return clip_with_field(vertices, faces, field, level).withColumn("side", F.lit(1)).unionByName(clip_with_field(vertices, faces, below, -level).withColumn("side", F.lit(-1)))


def triangle_areas(triangles: DataFrame) -> DataFrame:
    """``triangles`` (ax .. cz) with their area."""
    u, v = ([F.col(n + x) - F.col("a" + x) for x in "xyz"] for n in "bc")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return triangles.withColumn("area", F.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2) / 2)
