"""Generators: (vertices, faces) as arithmetic on ranges, so that any size is made where it is used."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry
from .topology import boundary_edges

Mesh = tuple[DataFrame, DataFrame]


def from_rows(spark: SparkSession, vertices: list, faces: list) -> Mesh:
    """A mesh of literal rows."""
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vertices)], "v long, x double, y double, z double")
    return v, spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(faces)], "f long, i0 long, i1 long, i2 long")


def _fan(rings: list) -> list:
    return [(r[0], r[k], r[k + 1]) for r in rings for k in range(1, len(r) - 1)]


def box(spark: SparkSession, extents: tuple = (1.0, 1.0, 1.0)) -> Mesh:
    """A cuboid around the origin, with outward faces."""
    corners = [[(i >> (2 - k) & 1) * e - e / 2 for k, e in enumerate(extents)] for i in range(8)]
    return from_rows(spark, corners, _fan([(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]))


def tetrahedron(spark: SparkSession) -> Mesh:
    s = 1 / math.sqrt(3)
    return from_rows(spark, [(s, s, s), (s, -s, -s), (-s, s, -s), (-s, -s, s)], [(0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2)])


def octahedron(spark: SparkSession) -> Mesh:
    points = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return from_rows(spark, points, [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)])


def icosahedron_rows() -> tuple[list, list]:
    ring = lambda z, turn: [(2 / math.sqrt(5) * math.cos(a), 2 / math.sqrt(5) * math.sin(a), z) for a in ((2 * k + turn) * math.pi / 5 for k in range(5))]
    points = [(0, 0, 1), *ring(1 / math.sqrt(5), 0), *ring(-1 / math.sqrt(5), 1), (0, 0, -1)]
    faces = []
    for k in range(5):
        a, b, c, d = 1 + k, 1 + (k + 1) % 5, 6 + k, 6 + (k + 1) % 5
        faces += [(0, a, b), (a, c, b), (b, c, d), (11, d, c)]
    return points, faces


def icosahedron(spark: SparkSession) -> Mesh:
    """Two poles and two rings of five, on the unit sphere."""
    return from_rows(spark, *icosahedron_rows())


def dodecahedron(spark: SparkSession) -> Mesh:
    """On the unit sphere, with outward faces: a vertex for each face of the icosahedron, a fan of three for each of its vertices."""
    tops, faces = icosahedron_rows()
    points = []
    for f in faces:
        middle = [sum(tops[i][x] for i in f) for x in range(3)]
        size = math.sqrt(sum(c * c for c in middle))
        points.append([c / size for c in middle])
    rings = []
    for i, top in enumerate(tops):
        after = {f[(f.index(i) + 1) % 3]: (n, f[(f.index(i) + 2) % 3]) for n, f in enumerate(faces) if i in f}
        at, ring = min(after), []
        for _ in range(5):
            n, at = after[at]
            ring.append(n)
        rings.append(ring)
    return from_rows(spark, points, _fan(rings))


def extrude_triangulation(vertices: DataFrame, faces: DataFrame, height: float) -> Mesh:
    """A planar mesh (x, y) as a closed solid between z = 0 and ``height``: the bottom turned, a wall on each side of the boundary."""
    top = vertices.agg((F.max("v") + 1).alias("n"))
    last = faces.agg((F.max("f") + 1).alias("m"))
    sides = boundary_edges(faces).select("org", "dst")
    v = vertices.crossJoin(F.broadcast(top)).select(F.inline(F.array(F.struct("v", "x", "y", F.lit(0.0).alias("z")), F.struct((F.col("v") + F.col("n")).alias("v"), "x", "y", F.lit(float(height)).alias("z")))))
    sizes = F.broadcast(top.crossJoin(last))
    up = lambda c: F.col(c) + F.col("n")
    lids = faces.crossJoin(sizes).select(F.inline(F.array(F.struct("f", "i0", F.col("i2").alias("i1"), F.col("i1").alias("i2")), F.struct((F.col("f") + F.col("m")).alias("f"), up("i0").alias("i0"), up("i1").alias("i1"), up("i2").alias("i2")))))
    # A wall's number follows from the least corner of its side, of which each boundary vertex begins one.
    number = F.col("m") * 2 + F.col("org") * 2
    walls = sides.crossJoin(sizes).select(F.inline(F.array(F.struct(number.alias("f"), F.col("org").alias("i0"), F.col("dst").alias("i1"), up("dst").alias("i2")), F.struct((number + 1).alias("f"), F.col("org").alias("i0"), up("dst").alias("i1"), up("org").alias("i2")))))
    return v, lids.unionByName(walls)


def icosphere(spark: SparkSession, subdivisions: int = 3, radius: float = 1.0) -> Mesh:
    """The icosahedron, each round split at edge midpoints and pushed out to the sphere."""
    v, f = icosahedron(spark)
    for k in range(subdivisions):
        v, f = geometry.subdivide(v, f, 10 * 4**k + 2)
        norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        v = v.select("v", *[(F.col(c) / norm).alias(c) for c in "xyz"])
    return v.select("v", *[(F.col(c) * radius).alias(c) for c in "xyz"]), f


def grid(spark: SparkSession, count: tuple = (10, 10), extents: tuple = (1.0, 1.0), center: bool = True) -> Mesh:
    """A flat rectangle of nx * ny vertices, two faces a cell, upwards."""
    nx, ny = count
    step = [e / (n - 1) for e, n in zip(extents, count)]
    shift = [e / 2 if center else 0.0 for e in extents]
    row, col = F.floor(F.col("id") / nx), F.col("id") % nx
    v = spark.range(nx * ny).select(F.col("id").alias("v"), (col * step[0] - shift[0]).alias("x"), (row * step[1] - shift[1]).alias("y"), F.lit(0.0).alias("z"))
    at = F.col("at")
    cells = spark.range((nx - 1) * (ny - 1)).withColumn("at", F.floor(F.col("id") / (nx - 1)) * nx + F.col("id") % (nx - 1))
    face = lambda k, *corners: F.struct((F.col("id") * 2 + k).alias("f"), *[(at + c).alias(f"i{i}") for i, c in enumerate(corners)])
    two = F.array(face(0, 0, 1, nx + 1), face(1, 0, nx + 1, nx))
    return v, cells.select(F.inline(two))


def revolve(spark: SparkSession, profile: list, sections: int = 32) -> Mesh:
    """A profile [(r, z), ...] turned around Z; a profile that goes up on the outside gives outward faces.

    A point on the axis is one vertex, any other one per section; a profile that ends where it began closes.
    """
    closed = profile[0] == profile[-1] and len(profile) > 2
    points = profile[:-1] if closed else profile
    base = [0]
    for r, _ in points:
        base.append(base[-1] + (1 if r == 0 else sections))
    angle = F.col("id") * (2 * math.pi / sections)
    rows = [F.struct(F.lit(base[i]).alias("base"), F.lit(float(r)).alias("r"), F.lit(float(z)).alias("z")) for i, (r, z) in enumerate(points)]
    v = spark.range(sections).select("id", angle.alias("angle"), F.inline(F.array(*rows))).where("r <> 0 or id = 0")
    v = v.select((F.col("base") + F.when(F.col("r") == 0, F.lit(0)).otherwise(F.col("id"))).cast("long").alias("v"), (F.col("r") * F.cos("angle")).alias("x"), (F.col("r") * F.sin("angle")).alias("y"), "z")
    s, t = F.col("id"), (F.col("id") + 1) % sections
    faces, made = [], 0
    for i in range(len(points) if closed else len(points) - 1):
        j = (i + 1) % len(points)
        lower, upper = points[i][0] != 0, points[j][0] != 0
        p = lambda k, at, off: (F.lit(base[k]) + (at if off else F.lit(0))).cast("long")
        for wanted, corners in ((lower, (p(i, s, lower), p(i, t, lower), p(j, t, upper))), (upper, (p(i, s, lower), p(j, t, upper), p(j, s, upper)))):
            if wanted:
                faces.append(F.struct((F.lit(made) + s).cast("long").alias("f"), *[c.alias(f"i{k}") for k, c in enumerate(corners)]))
                made += sections
    return v, spark.range(sections).select(F.inline(F.array(*faces)))


def uv_sphere(spark: SparkSession, radius: float = 1.0, count: tuple = (32, 64)) -> Mesh:
    """Lines of latitude, poles included, by sections of longitude; both are rounded up to even."""
    rows, sections = (n + n % 2 for n in count)
    inner = [(radius * math.sin(math.pi * k / (rows - 1)), -radius * math.cos(math.pi * k / (rows - 1))) for k in range(1, rows - 1)]
    return revolve(spark, [(0, -radius), *inner, (0, radius)], sections)


def cylinder(spark: SparkSession, radius: float, height: float, sections: int = 32) -> Mesh:
    return revolve(spark, [(0, -height / 2), (radius, -height / 2), (radius, height / 2), (0, height / 2)], sections)


def cone(spark: SparkSession, radius: float, height: float, sections: int = 32) -> Mesh:
    return revolve(spark, [(0, 0), (radius, 0), (0, height)], sections)


def capsule(spark: SparkSession, height: float = 1.0, radius: float = 1.0, rows: int = 16, sections: int = 32) -> Mesh:
    """A cylinder along Z closed by half spheres, each of ``rows`` steps."""
    arc = [(radius * math.cos(math.pi / 2 * k / rows), radius * math.sin(math.pi / 2 * k / rows)) for k in range(rows)]
    return revolve(spark, [(0, -height / 2 - radius), *[(r, -height / 2 - z) for r, z in reversed(arc)], *[(r, height / 2 + z) for r, z in arc], (0, height / 2 + radius)], sections)


def annulus(spark: SparkSession, r_min: float, r_max: float, height: float, sections: int = 32) -> Mesh:
    if r_min < 1e-8:
        return cylinder(spark, r_max, height, sections)
    h = height / 2
    return revolve(spark, [(r_min, -h), (r_max, -h), (r_max, h), (r_min, h), (r_min, -h)], sections)


def torus(spark: SparkSession, major_radius: float, minor_radius: float, major_sections: int = 32, minor_sections: int = 32) -> Mesh:
    turn = [2 * math.pi * k / minor_sections for k in range(minor_sections)]
    ring = [(major_radius + minor_radius * math.cos(a), minor_radius * math.sin(a)) for a in turn]
    return revolve(spark, [*ring, ring[0]], major_sections)
