"""Fields on meshes: averages, transfers through operators, gradients, intrinsic entries, losses, measures in balls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import ZERO, _cross, _dot, _norm, _vec, corners, face_normals
from .spatial import ball_join
from .topology import boundary_edges, halfedges, unique_edges


def _at_corners(faces: DataFrame, values: DataFrame) -> DataFrame:
    """``faces`` with u0, u1, u2: the vertex values (v, val) of the corners."""
    for k in range(3):
        faces = faces.join(values.select(F.col("v").alias(f"i{k}"), F.col("val").alias(f"u{k}")), f"i{k}")
    return faces


def average_onto_faces(faces: DataFrame, values: DataFrame) -> DataFrame:
    """(f, val): the mean of the corners' values."""
    return _at_corners(faces, values).select("f", ((F.col("u0") + F.col("u1") + F.col("u2")) / 3).alias("val"))


def average_onto_vertices(vertices: DataFrame, faces: DataFrame, values: DataFrame) -> DataFrame:
    """(v, val): the mean of the values (f, val) of the faces around; NaN without faces."""
    found = halfedges(faces).join(values, "f").groupBy(F.col("org").alias("v")).agg(F.avg("val").alias("val"))
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("val", F.lit(float("nan"))).alias("val"))


def average_from_edges_onto_vertices(vertices: DataFrame, faces: DataFrame, values: DataFrame) -> DataFrame:
    """(v, val): the mean of the values (lo, hi, val) of the edges around, for each half-edge that runs from lo to hi; 0 without any."""
    h = halfedges(faces).where("org = lo").join(values, ["lo", "hi"])
    found = h.select(F.explode(F.array("lo", "hi")).alias("v"), "val").groupBy("v").agg(F.avg("val").alias("val"))
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("val", F.lit(0.0)).alias("val"))


def interpolate_barycentric(faces: DataFrame, points: DataFrame, values: DataFrame) -> DataFrame:
    """(p, val) of points (p, f, w0, w1, w2): the corners' values weighted by the barycentric coordinates."""
    joined = _at_corners(faces, values).join(points.select("p", "f", "w0", "w1", "w2"), "f")
    return joined.select("p", (F.col("w0") * F.col("u0") + F.col("w1") * F.col("u1") + F.col("w2") * F.col("u2")).alias("val"))


def transfer_through_index(values: DataFrame, index: DataFrame) -> DataFrame:
    """(row, val) of an index map (row, src): the value of src, 0 where it is -1."""
    return index.join(values.select(F.col("v").alias("src"), "val"), "src", "left").select("row", F.coalesce("val", F.lit(0.0)).alias("val"))


def operator_from_index(index: DataFrame) -> DataFrame:
    """(row, col, val): a one at column src of each row; rows of -1 are empty."""
    return index.where("src >= 0").select("row", F.col("src").alias("col"), F.lit(1.0).alias("val"))


def transfer_through_operator(values: DataFrame, operator: DataFrame) -> DataFrame:
    """(row, val): each row's weighted sum of the values (v, val) of its columns."""
    joined = operator.join(values.select(F.col("v").alias("col"), F.col("val").alias("u")), "col")
    return joined.groupBy("row").agg(F.sum(F.col("val") * F.col("u")).alias("val"))


def compose_operators(first: DataFrame, second: DataFrame) -> DataFrame:
    """(row, col, val) of ``first`` and then ``second``: the product second @ first."""
    mid = first.select(F.col("row").alias("mid"), "col", F.col("val").alias("w"))
    joined = second.select("row", F.col("col").alias("mid"), "val").join(mid, "mid")
    return joined.groupBy("row", "col").agg(F.sum(F.col("val") * F.col("w")).alias("val"))


def operator_representatives(operator: DataFrame) -> DataFrame:
    """(row, col): the column of each row's largest weight, the least of equal ones."""
    return operator.groupBy("row").agg(F.max_by("col", F.struct("val", -F.col("col"))).alias("col"))


def face_gradients(vertices: DataFrame, faces: DataFrame, values: DataFrame) -> DataFrame:
    """(f, x, y, z): the gradient of a vertex field inside each face; zero for degenerate ones."""
    c = _at_corners(corners(vertices, faces), values)
    n = _cross(_vec("a", "b"), _vec("a", "c"))
    square = _dot(n, n)
    turned = [_cross(n, side) for side in (_vec("b", "c"), _vec("c", "a"), _vec("a", "b"))]
    parts = [sum((F.col(f"u{k}") * turned[k][i] for k in (1, 2)), F.col("u0") * turned[0][i]) for i in range(3)]
    return c.select("f", *[F.when(square > ZERO**2, p / square).otherwise(0.0).alias(x) for p, x in zip(parts, "xyz")])


def face_edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, l0, l1, l2): the length of the side opposite each corner."""
    c = corners(vertices, faces)
    return c.select("f", *[_norm(_vec(*s)).alias(f"l{k}") for k, s in enumerate(("bc", "ca", "ab"))])


def cotangent_entries(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, c0, c1, c2): half the cotangent of each corner's angle; zero for degenerate faces."""
    c = corners(vertices, faces)
    double = _norm(_cross(_vec("a", "b"), _vec("a", "c")))
    half = [_dot(_vec(p, q), _vec(p, r)) / double / 2 for p, q, r in ("abc", "bca", "cab")]
    return c.select("f", *[F.when(double > ZERO, h).otherwise(0.0).alias(f"c{k}") for k, h in enumerate(half)])


def cotangent_entries_intrinsic(lengths: DataFrame) -> DataFrame:
    """The same entries from side lengths (f, l0, l1, l2) alone, by Heron's formula."""
    s = [F.col(f"l{k}") ** 2 for k in range(3)]
    half = (F.col("l0") + F.col("l1") + F.col("l2")) / 2
    area = F.sqrt(F.greatest(half * (half - F.col("l0")) * (half - F.col("l1")) * (half - F.col("l2")), F.lit(0.0)))
    cot = [(s[(k + 1) % 3] + s[(k + 2) % 3] - s[k]) / (8 * area) for k in range(3)]
    return lengths.select("f", *[F.when(area > ZERO, c).otherwise(0.0).alias(f"c{k}") for k, c in enumerate(cot)])


def mass_entries(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, mass): a third of the area of the faces around; vertices without faces are left out."""
    c = corners(vertices, faces).select(F.explode(F.array("i0", "i1", "i2")).alias("v"), (_norm(_cross(_vec("a", "b"), _vec("a", "c"))) / 6).alias("m"))
    return c.groupBy("v").agg(F.sum("m").alias("mass"))


def edge_length_loss(vertices: DataFrame, faces: DataFrame, target: float = 0.0) -> DataFrame:
    """One row: the mean squared deviation of the edge lengths from ``target``."""
    from .topology import edge_lengths

    return edge_lengths(vertices, unique_edges(faces)).agg(F.avg((F.col("length") - target) ** 2).alias("loss"))


def face_pairs(faces: DataFrame) -> DataFrame:
    """(f, g) with f < g of every two faces that share an edge of two faces."""
    pairs = halfedges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("f").alias("f"), F.max("f").alias("g"))
    return pairs.where("n = 2 and f < g").select("f", "g")


def normal_consistency_loss(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: the mean of 1 - cos of the angle between the normals of neighbouring faces."""
    n = face_normals(vertices, faces)
    joined = face_pairs(faces).join(n, "f").join(n.select(F.col("f").alias("g"), *[F.col(x).alias("g" + x) for x in "xyz"]), "g")
    dot = F.col("x") * F.col("gx") + F.col("y") * F.col("gy") + F.col("z") * F.col("gz")
    return joined.agg(F.avg(1 - dot).alias("loss"))


def laplacian_smoothing_loss(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: the mean distance of a vertex from the mean of its neighbours; vertices without any count 0."""
    e = unique_edges(faces)
    both = e.select(F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("w")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("w")))))
    means = both.join(vertices.withColumnRenamed("v", "w"), "w").groupBy("v").agg(*[F.avg(x).alias("m" + x) for x in "xyz"])
    joined = vertices.join(means, "v", "left")
    return joined.agg(F.avg(F.coalesce(_norm([F.col("m" + x) - F.col(x) for x in "xyz"]), F.lit(0.0))).alias("loss"))


def vector_area_entries(faces: DataFrame, n: int) -> DataFrame:
    """(row, col, val) of the form that gives the signed area inside the boundary of a planar layout (x at v, y at n + v)."""
    h = boundary_edges(faces)
    entry = lambda r, c, s: F.struct(r.alias("row"), c.alias("col"), F.lit(s).alias("val"))
    p, q = F.col("org"), F.col("dst")
    four = F.array(entry(p, q + n, 0.25), entry(q + n, p, 0.25), entry(q, p + n, -0.25), entry(p + n, q, -0.25))
    return h.select(F.inline(four)).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def mean_vertex_normals(vertices: DataFrame, faces: DataFrame, normals: DataFrame) -> DataFrame:
    """(v, x, y, z): unit sums of the given face normals (f, x, y, z); zero without faces."""
    sums = halfedges(faces).join(normals, "f").groupBy(F.col("org").alias("v")).agg(*[F.sum(x).alias("s" + x) for x in "xyz"])
    size = _norm([F.col("s" + x) for x in "xyz"])
    return vertices.select("v").join(sums, "v", "left").select("v", *[F.when(size > ZERO, F.col("s" + x) / size).otherwise(0.0).alias(x) for x in "xyz"])


def corner_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, k, x, y, z): the area-weighted vertex normal at each corner, without creases."""
    from .geometry import vertex_normals

    return halfedges(faces).select("f", "k", F.col("org").alias("v")).join(vertex_normals(vertices, faces), "v").select("f", "k", "x", "y", "z")


def curvature_in_balls(queries: DataFrame, vertices: DataFrame, defects: DataFrame, radius: float) -> DataFrame:
    """(q, curvature): the sum of the angle defects (v, defect) of the vertices within ``radius`` of each point."""
    found = ball_join(queries, vertices.withColumnRenamed("v", "p"), radius).join(defects.withColumnRenamed("v", "p"), "p")
    sums = found.groupBy("q").agg(F.sum("defect").alias("curvature"))
    return queries.select("q").join(sums, "q", "left").select("q", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))
