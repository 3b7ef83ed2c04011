"""Per-face and per-vertex geometry, measures, bounds, transforms, curvature and Laplacian operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topology import boundary_edges, halfedges, vertex_neighbors

ZERO = 1e-12


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: ax .. cz."""
    out = faces
    for i, name in (("i0", "a"), ("i1", "b"), ("i2", "c")):
        out = out.join(vertices.select(F.col("v").alias(i), *[F.col(x).alias(name + x) for x in "xyz"]), i)
    return out


def _vec(a: str, b: str) -> list[Column]:
    return [F.col(b + x) - F.col(a + x) for x in "xyz"]


def _cross(p: list[Column], q: list[Column]) -> list[Column]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _dot(p: list[Column], q: list[Column]) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def _norm(p: list[Column]) -> Column:
    return F.sqrt(_dot(p, p))


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, cross product, area, centroid) of every face."""
    c = corners(vertices, faces)
    n = _cross(_vec("a", "b"), _vec("a", "c"))
    c = c.select("f", "i0", "i1", "i2", *[x.alias(k) for x, k in zip(n, ("nx", "ny", "nz"))], *[((F.col("a" + x) + F.col("b" + x) + F.col("c" + x)) / 3).alias("g" + x) for x in "xyz"])
    return c.withColumn("area", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / 2)


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, x, y, z): unit normals; zero for degenerate faces."""
    g = face_geometry(vertices, faces)
    return g.select("f", *[F.when(F.col("area") > ZERO, F.col("n" + x) / (2 * F.col("area"))).otherwise(0.0).alias(x) for x in "xyz"])


def face_angles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, a0, a1, a2): interior angles by atan2."""
    c = corners(vertices, faces)

    def angle(p, q, r):
        u, v = _vec(p, q), _vec(p, r)
        return F.atan2(_norm(_cross(u, v)), _dot(u, v))

    return c.select("f", "i0", "i1", "i2", angle("a", "b", "c").alias("a0"), angle("b", "c", "a").alias("a1"), angle("c", "a", "b").alias("a2"))


def triangle_quality(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, aspect, compactness): longest edge over shortest altitude; 4 sqrt(3) area over the squared edges."""
    c = corners(vertices, faces)
    u, v, w = _vec("a", "b"), _vec("b", "c"), _vec("c", "a")
    longest = F.greatest(_norm(u), _norm(v), _norm(w))
    double = _norm(_cross(u, _vec("a", "c")))
    edges = _dot(u, u) + _dot(v, v) + _dot(w, w)
    return c.select("f", F.when(double > ZERO, longest * longest / double).otherwise(float("inf")).alias("aspect"), F.when(edges > 0, 2 * math.sqrt(3) * double / edges).otherwise(0.0).alias("compactness"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, x, y, z): area-weighted normals; zero without faces."""
    g = face_geometry(vertices, faces)
    parts = g.select(F.explode(F.array("i0", "i1", "i2")).alias("v"), "nx", "ny", "nz").groupBy("v").agg(*[F.sum("n" + x).alias("n" + x) for x in "xyz"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    joined = vertices.select("v").join(parts, "v", "left")
    return joined.select("v", *[F.when(size > ZERO, F.col("n" + x) / size).otherwise(0.0).alias(x) for x in "xyz"])


def measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: area, signed volume, and the area-weighted centroid."""
    c = corners(vertices, faces)
    a, b, d = ([F.col(k + x) for x in "xyz"] for k in "abc")
    n = _cross(_vec("a", "b"), _vec("a", "c"))
    area = _norm(n) / 2
    c = c.select(area.alias("area"), (_dot(a, _cross(b, d)) / 6).alias("volume"), *[((a[i] + b[i] + d[i]) / 3 * area).alias(f"m{x}") for i, x in enumerate("xyz")])
    sums = c.agg(F.sum("area").alias("area"), F.sum("volume").alias("volume"), *[F.sum(f"m{x}").alias(f"m{x}") for x in "xyz"])
    return sums.select("area", "volume", *[(F.col(f"m{x}") / F.col("area")).alias(f"c{x}") for x in "xyz"])


def aabb(points: DataFrame) -> DataFrame:
    """One row: the axis-aligned bounds, their diagonal and their centre."""
    b = points.agg(*[f(x).alias(f"{k}{x}") for k, f in (("min_", F.min), ("max_", F.max)) for x in "xyz"])
    size = [F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"]
    return b.withColumn("diagonal", _norm(size)).withColumns({f"mid_{x}": (F.col(f"min_{x}") + F.col(f"max_{x}")) / 2 for x in "xyz"})


def face_bounds(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    c = corners(vertices, faces)
    return c.select("f", *[f(*[F.col(k + x) for k in "abc"]).alias(n + x) for n, f in (("min_", F.least), ("max_", F.greatest)) for x in "xyz"])


def points_in_aabb(points: DataFrame, low: tuple, high: tuple) -> DataFrame:
    inside = F.lit(True)
    for x, lo, hi in zip("xyz", low, high):
        inside &= (F.col(x) >= lo) & (F.col(x) <= hi)
    return points.where(inside)


def apply_transform(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Points under an affine 4 x 4 matrix, whose entries are literals of the plan."""
    row = lambda r: sum((F.col(x) * float(r[i]) for i, x in enumerate("xyz")), F.lit(float(r[3])))
    return points.withColumns({x: row(matrix[i]) for i, x in enumerate("xyz")})


def rotation(axis: tuple, angle: float) -> list[list[float]]:
    """The 4 x 4 matrix of a turn about an axis through the origin."""
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = math.cos(angle), math.sin(angle)
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0], [t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0], [t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0], [0, 0, 0, 1]]


def normalize(points: DataFrame) -> DataFrame:
    """Points moved to the centre of their bounds and scaled to a unit longest side."""
    b = points.agg(*[f(x).alias(f"{k}{x}") for k, f in (("lo", F.min), ("hi", F.max)) for x in "xyz"])
    scale = F.greatest(*[F.col(f"hi{x}") - F.col(f"lo{x}") for x in "xyz"])
    joined = points.crossJoin(F.broadcast(b))
    return joined.select(*[c for c in points.columns if c not in "xyz"], *[F.when(scale > 0, (F.col(x) - (F.col(f"lo{x}") + F.col(f"hi{x}")) / 2) / scale).otherwise(0.0).alias(x) for x in "xyz"])


def angle_defects(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, defect): 2 pi, or pi on a boundary, less the angles at the vertex."""
    a = face_angles(vertices, faces)
    at = a.select(F.inline(F.array(*[F.struct(F.col(f"i{k}").alias("v"), F.col(f"a{k}").alias("angle")) for k in range(3)]))).groupBy("v").agg(F.sum("angle").alias("total"))
    rim = boundary_edges(faces).select(F.explode(F.array("org", "dst")).alias("v")).distinct().withColumn("rim", F.lit(True))
    return at.join(rim, "v", "left").select("v", (F.when(F.col("rim"), F.lit(math.pi)).otherwise(2 * math.pi) - F.col("total")).alias("defect"))


def cotangent_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(row, col, val): half the cotangents opposite each edge, the diagonal negative."""
    c = corners(vertices, faces)

    def cot(p, q, r):
        u, v = _vec(p, q), _vec(p, r)
        return _dot(u, v) / F.greatest(_norm(_cross(u, v)), F.lit(ZERO)) / 2

    three = F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), cot(*p).alias("w")) for i, j, p in (("i1", "i2", "abc"), ("i2", "i0", "bca"), ("i0", "i1", "cab"))])
    w = c.select(F.inline(three))
    four = F.array(*[F.struct(F.col(r).alias("row"), F.col(k).alias("col"), (F.col("w") * s).alias("val")) for r, k, s in (("i", "j", 1), ("j", "i", 1), ("i", "i", -1), ("j", "j", -1))])
    return w.select(F.inline(four)).groupBy("row", "col").agg(F.sum("val").alias("val"))


def mass_matrix(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(row, col, val): the barycentric lumped mass, a third of the area of the faces at each vertex."""
    g = face_geometry(vertices, faces)
    return g.select(F.explode(F.array("i0", "i1", "i2")).alias("row"), (F.col("area") / 3).alias("m")).groupBy("row").agg(F.sum("m").alias("val")).select("row", F.col("row").alias("col"), "val")


def dihedral_angles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(lo, hi, angle): the angle between the normals of the two faces at each inner edge."""
    n = face_normals(vertices, faces)
    h = halfedges(faces)
    pairs = h.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("n = 2 and f0 <> f1")
    for k in ("0", "1"):
        pairs = pairs.join(n.select(F.col("f").alias("f" + k), *[F.col(x).alias(k + x) for x in "xyz"]), "f" + k)
    u, v = ([F.col(k + x) for x in "xyz"] for k in "01")
    return pairs.select("lo", "hi", F.atan2(_norm(_cross(u, v)), _dot(u, v)).alias("angle"))


def laplacian_smoothing(vertices: DataFrame, faces: DataFrame, weight: float = 0.5, rounds: int = 1) -> DataFrame:
    """Vertices moved towards the mean of their neighbours, ``rounds`` times; rim vertices move too."""
    near = vertex_neighbors(faces)
    out = vertices.select("v", "x", "y", "z")
    for _ in range(rounds):
        mean = near.join(out.withColumnRenamed("v", "neighbor"), "neighbor").groupBy("v").agg(*[F.avg(x).alias("m" + x) for x in "xyz"])
        out = out.join(mean, "v", "left").select("v", *[(F.col(x) + weight * (F.coalesce(F.col("m" + x), F.col(x)) - F.col(x))).alias(x) for x in "xyz"])
    return out


def taubin_smoothing(vertices: DataFrame, faces: DataFrame, shrink: float = 0.5, grow: float = -0.53, rounds: int = 1) -> DataFrame:
    """Pairs of a shrinking and a growing step."""
    out = vertices
    for _ in range(rounds):
        out = laplacian_smoothing(laplacian_smoothing(out, faces, shrink), faces, grow)
    return out


def subdivide(vertices: DataFrame, faces: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """Every face in four at the middles of its edges; the middle of (lo, hi) gets an id from ``base`` up, by rank."""
    from pyspark.sql import Window as W

    h = halfedges(faces)
    e = h.select("lo", "hi").distinct().withColumn("m", F.row_number().over(W.orderBy("hi", "lo")) - 1 + base)
    ends = e
    for k in ("lo", "hi"):
        ends = ends.join(vertices.select(F.col("v").alias(k), *[F.col(x).alias(k + x) for x in "xyz"]), k)
    middles = ends.select(F.col("m").alias("v"), *[((F.col("lo" + x) + F.col("hi" + x)) / 2).alias(x) for x in "xyz"])
    wide = h.join(e, ["lo", "hi"]).groupBy("f").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in range(3)])
    full = faces.join(wide, "f")
    four = F.array(*[F.struct((F.col("f") * 4 + j).alias("f"), *[F.col(c).alias(f"i{i}") for i, c in enumerate(t)]) for j, t in enumerate((("i0", "m0", "m2"), ("i1", "m1", "m0"), ("i2", "m2", "m1"), ("m0", "m1", "m2")))])
    return vertices.select("v", "x", "y", "z").unionByName(middles), full.select(F.inline(four))
