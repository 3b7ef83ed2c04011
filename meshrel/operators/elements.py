"""Pairing codes and masks of half-edges and faces, adjacent faces, shape, barycentric forms, curvature, mass properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import ZERO, _cross, _dot, _norm, _vec, corners, dihedral_angles, face_angles, face_normals
from .topology import halfedges

#: How far above the plane of its neighbour a vertex may lie for a pair of faces to count as convex.
MERGE = 1e-8


def halfedge_mates(faces: DataFrame) -> DataFrame:
    """(h, mate): the other half-edge of an edge that two share, -1 for a lone one, -2 - least for three or more."""
    h = halfedges(faces).select("h", "lo", "hi")
    edges = h.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.sum("h").alias("total"))
    mate = F.when(F.col("n") == 1, F.lit(-1)).when(F.col("n") == 2, F.col("total") - F.col("h")).otherwise(-2 - F.col("least"))
    return h.join(edges, ["lo", "hi"]).select("h", mate.alias("mate"))


def _shares(faces: DataFrame) -> DataFrame:
    """(f, k, n): how many half-edges lie on the edge of each corner."""
    h = halfedges(faces).select("f", "k", "lo", "hi")
    return h.join(h.groupBy("lo", "hi").agg(F.count("*").alias("n")), ["lo", "hi"])


def edge_manifold_mask(faces: DataFrame, allow_boundary: bool = True) -> DataFrame:
    """(f, ok): whether no edge of a face has more than two faces, nor one if a boundary is not allowed."""
    good = (F.col("n") == 2) | (F.lit(allow_boundary) & (F.col("n") == 1))
    return _shares(faces).groupBy("f").agg(F.bool_and(good).alias("ok"))


def watertight_mask(faces: DataFrame) -> DataFrame:
    """(f, ok): whether all three edges of a face have exactly two faces."""
    return edge_manifold_mask(faces, False)


def edge_winding_mask(faces: DataFrame) -> DataFrame:
    """(lo, hi, ok) of edges with two faces: whether they run along it in opposite directions."""
    e = halfedges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("org") == F.col("lo")).alias("forward"))
    return e.where("n = 2").select("lo", "hi", (F.col("forward") == 1).alias("ok"))


def is_volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: whether every edge has two faces that run in opposite directions, and the volume is positive."""
    e = halfedges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("org") == F.col("lo")).alias("forward"))
    closed = e.agg(F.coalesce(F.bool_and((F.col("n") == 2) & (F.col("forward") == 1)), F.lit(False)).alias("closed"))
    inside = signed_volumes(vertices, faces).agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    return closed.crossJoin(inside).select((F.col("closed") & (F.col("volume") > 0)).alias("is_volume"))


def ears(faces: DataFrame) -> DataFrame:
    """(f, opposite) of faces with two edges on the boundary: the corner that faces the inner edge."""
    by_face = _shares(faces).groupBy("f").agg(F.count_if(F.col("n") == 1).alias("open"), F.max(F.when(F.col("n") != 1, F.col("k"))).alias("inner"))
    return by_face.where("open = 2").select("f", ((F.col("inner") + 2) % 3).cast("long").alias("opposite"))


def adjacent_apexes(faces: DataFrame) -> DataFrame:
    """(f0, f1, lo, hi, u0, u1) of face pairs over edges that two share: the corner of each off the edge, else -1."""
    side = lambda a, b, c: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(F.col(c).isin(F.col(a), F.col(b)), F.lit(-1)).otherwise(F.col(c)).cast("long").alias("apex"))
    sides = faces.select("f", F.inline(F.array(side("i0", "i1", "i2"), side("i1", "i2", "i0"), side("i2", "i0", "i1"))))
    one = F.struct("f", "apex")
    pairs = sides.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(one).alias("p"), F.max(one).alias("q")).where("n = 2 and p.f <> q.f")
    return pairs.select(F.col("p.f").alias("f0"), F.col("q.f").alias("f1"), "lo", "hi", F.col("p.apex").alias("u0"), F.col("q.apex").alias("u1"))


def adjacent_projections(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f0, f1, lo, hi, height, convex): how far the apex of f1 lies above the plane of f0; 0 if it has none."""
    pairs = adjacent_apexes(faces)
    normal = face_normals(vertices, faces).select(F.col("f").alias("f0"), *[F.col(x).alias("n" + x) for x in "xyz"])
    at = lambda name: vertices.select(F.col("v").alias(name), *[F.col(x).alias(name + x) for x in "xyz"])
    wide = pairs.join(normal, "f0").join(at("lo"), "lo").join(at("u1"), "u1", "left")
    height = sum((F.col("n" + x) * (F.col("u1" + x) - F.col("lo" + x)) for x in "yz"), F.col("nx") * (F.col("u1x") - F.col("lox")))
    return wide.withColumn("height", F.coalesce(height, F.lit(0.0))).select("f0", "f1", "lo", "hi", "height", (F.col("height") < MERGE).alias("convex"))


def crease_edges(vertices: DataFrame, faces: DataFrame, angle: float = 30.0) -> DataFrame:
    """(lo, hi, angle) of edges where the surface bends by more than ``angle`` degrees."""
    return dihedral_angles(vertices, faces).where(F.col("angle") > math.radians(angle))


def face_quality(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, aspect_ratio, radius_ratio, area_max_side, mean_ratio, area).

    Circumradius over twice the inradius, infinite for a degenerate face; its inverse; twice the area over the
    longest side squared; 4 sqrt(3) area over the sum of the squared sides.
    """
    c = corners(vertices, faces)
    u, v, w = _vec("a", "b"), _vec("b", "c"), _vec("c", "a")
    c = c.select("f", _norm(u).alias("p"), _norm(v).alias("q"), _norm(w).alias("r"), (_norm(_cross(u, _vec("a", "c"))) / 2).alias("area"))
    spread = F.col("p") * F.col("q") * F.col("r") * (F.col("p") + F.col("q") + F.col("r"))
    square = 16 * F.col("area") ** 2
    flat = F.col("area") <= ZERO
    longest = F.greatest("p", "q", "r")
    return c.select(
        "f",
        F.when(flat, F.lit(float("inf"))).otherwise(spread / square).alias("aspect_ratio"),
        F.when(flat, F.lit(0.0)).otherwise(square / spread).alias("radius_ratio"),
        F.when(longest > 0, 2 * F.col("area") / longest**2).otherwise(0.0).alias("area_max_side"),
        F.when(longest > 0, 4 * math.sqrt(3) * F.col("area") / (F.col("p") ** 2 + F.col("q") ** 2 + F.col("r") ** 2)).otherwise(0.0).alias("mean_ratio"),
        "area",
    )


def signed_volumes(vertices: DataFrame, faces: DataFrame, apex: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """(f, volume) of the tetrahedra that an apex spans with each face."""
    c = corners(vertices, faces)
    rel = [[F.col(k + x) - float(o) for x, o in zip("xyz", apex)] for k in "abc"]
    return c.select("f", (_dot(rel[0], _cross(rel[1], rel[2])) / 6).alias("volume"))


def nondegenerate_mask(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    c = corners(vertices, faces)
    return c.select("f", (_norm(_cross(_vec("a", "b"), _vec("a", "c"))) > 0).alias("ok"))


def barycentric_to_points(vertices: DataFrame, faces: DataFrame, weights: DataFrame) -> DataFrame:
    """(f, x, y, z) of weights (f, w0, w1, w2), one or more a face."""
    c = corners(vertices, faces).join(weights, "f")
    return c.select("f", *[(F.col("a" + x) * F.col("w0") + F.col("b" + x) * F.col("w1") + F.col("c" + x) * F.col("w2")).alias(x) for x in "xyz"])


def _weights(p: list[Column]) -> list[Column]:
    """Barycentric weights of a point over the corners a, b, c, by Cramer's rule on dot products."""
    u, v, w = _vec("a", "b"), _vec("a", "c"), [p[i] - F.col("a" + x) for i, x in enumerate("xyz")]
    uu, uv, vv, wu, wv = _dot(u, u), _dot(u, v), _dot(v, v), _dot(w, u), _dot(w, v)
    det = uu * vv - uv * uv
    second, third = (vv * wu - uv * wv) / det, (uu * wv - uv * wu) / det
    return [1 - second - third, second, third]


def points_to_barycentric(vertices: DataFrame, faces: DataFrame, points: DataFrame) -> DataFrame:
    """(f, w0, w1, w2) of points (f, x, y, z), each over its own face; a point off the plane is projected."""
    c = corners(vertices, faces).join(points.select("f", *[F.col(x).alias("p" + x) for x in "xyz"]), "f")
    return c.select("f", *[w.alias(f"w{k}") for k, w in enumerate(_weights([F.col("p" + x) for x in "xyz"]))])


def closest_points(vertices: DataFrame, faces: DataFrame, points: DataFrame) -> DataFrame:
    """(f, x, y, z, d): the point of each face nearest to its own point (f, x, y, z).

    The projection if it falls inside; else the nearest of the nearest points of the three sides.
    """
    c = corners(vertices, faces).join(points.select("f", *[F.col(x).alias("p" + x) for x in "xyz"]), "f")
    p = [F.col("p" + x) for x in "xyz"]

    def candidate(at: list[Column]) -> Column:
        gap = [p[i] - at[i] for i in range(3)]
        return F.struct(_norm(gap).alias("d"), *[a.alias(x) for a, x in zip(at, "xyz")])

    def on_side(a: str, b: str) -> Column:
        side = _vec(a, b)
        t = _dot([p[i] - F.col(a + x) for i, x in enumerate("xyz")], side) / F.greatest(_dot(side, side), F.lit(ZERO**2))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return candidate([F.col(a + x) + t * side[i] for i, x in enumerate("xyz")])

    w = _weights(p)
    inside = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0)
    within = candidate([sum((w[k] * F.col(n + x) for k, n in ((1, "b"), (2, "c"))), w[0] * F.col("a" + x)) for x in "xyz"])
    sides = F.array_min(F.array(on_side("a", "b"), on_side("b", "c"), on_side("c", "a")))
    return c.select("f", F.when(inside, within).otherwise(sides).alias("at")).select("f", "at.x", "at.y", "at.z", "at.d")


def weighted_normals(vertices: DataFrame, faces: DataFrame, weighting: str = "angle") -> DataFrame:
    """(v, x, y, z): unit sums of face normals weighted at each corner.

    ``angle``: by the interior angle. ``mwselr``: by its sine over the product of the two sides.
    """
    c = corners(vertices, faces)
    rows = []
    for k, (p, q, r) in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))):
        u, v = _vec(p, q), _vec(p, r)
        n = _cross(u, v)
        size = _norm(n)
        if weighting == "angle":
            weight = F.atan2(size, _dot(u, v)) / size
        elif weighting == "mwselr":
            weight = 1 / (_dot(u, u) * _dot(v, v))
        else:
            raise ValueError(f"no such weighting: {weighting}")
        rows.append(F.struct(F.col(f"i{k}").alias("v"), *[F.when(size > ZERO, x * weight).otherwise(0.0).alias("n" + a) for x, a in zip(n, "xyz")]))
    sums = c.select(F.inline(F.array(*rows))).groupBy("v").agg(*[F.sum("n" + x).alias("n" + x) for x in "xyz"])
    size = _norm([F.col("n" + x) for x in "xyz"])
    return vertices.select("v").join(sums, "v", "left").select("v", *[F.when(size > ZERO, F.col("n" + x) / size).otherwise(0.0).alias(x) for x in "xyz"])


def moments(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row (volume, cx, cy, cz, ixx, iyy, izz, ixy, iyz, ixz): of the solid, at unit density, about its centre.

    Integrals of the coordinates and of their products over the tetrahedra that the origin spans with each face.
    """
    c = corners(vertices, faces)
    a, b, d = ([F.col(k + x) for x in "xyz"] for k in "abc")
    v = _dot(a, _cross(b, d)) / 6
    s = [a[i] + b[i] + d[i] for i in range(3)]
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (1, 2), (0, 2)]
    product = lambda i, j: v / 20 * (a[i] * a[j] + b[i] * b[j] + d[i] * d[j] + s[i] * s[j])
    c = c.select(v.alias("v"), *[(v * s[i] / 4).alias(f"m{i}") for i in range(3)], *[product(i, j).alias(f"m{i}{j}") for i, j in pairs])
    t = c.agg(*[F.sum(x).alias(x) for x in c.columns])
    t = t.withColumns({f"g{i}": F.col(f"m{i}") / F.col("v") for i in range(3)})
    about = {(i, j): F.col(f"m{i}{j}") - F.col("v") * F.col(f"g{i}") * F.col(f"g{j}") for i, j in pairs}
    axes = [about[1, 1] + about[2, 2], about[0, 0] + about[2, 2], about[0, 0] + about[1, 1]]
    return t.select(F.col("v").alias("volume"), *[F.col(f"g{i}").alias("c" + x) for i, x in enumerate("xyz")], *[axis.alias(f"i{x}{x}") for axis, x in zip(axes, "xyz")], (-about[0, 1]).alias("ixy"), (-about[1, 2]).alias("iyz"), (-about[0, 2]).alias("ixz"))


def vertex_curvatures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, mean, gaussian): pointwise curvatures over the mixed area, after Meyer, Desbrun, Schroder and Barr (2002).

    The mean is positive where the surface bends away from its normal. On a rim the angle between the two rim
    edges is taken off too, so a straight flat rim has none. Zero where the mixed area vanishes.
    """
    c = corners(vertices, faces)
    half = math.pi / 2
    angle = {}
    for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        u, v = _vec(p, q), _vec(p, r)
        angle[p] = F.atan2(_norm(_cross(u, v)), _dot(u, v)).alias("t" + p)
    normal = _cross(_vec("a", "b"), _vec("a", "c"))
    c = c.select("*", *angle.values(), *[x.alias("n" + k) for x, k in zip(normal, "xyz")])
    double = _norm([F.col("n" + x) for x in "xyz"])
    acute = (F.col("ta") < half) & (F.col("tb") < half) & (F.col("tc") < half)
    cot = lambda p: F.cos("t" + p) / F.sin("t" + p)
    rows = []
    for k, (p, q, r) in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))):
        to_q, to_r = _vec(p, q), _vec(p, r)
        whole = double > ZERO
        area = F.when(acute, (_dot(to_q, to_q) * cot(r) + _dot(to_r, to_r) * cot(q)) / 8).when(F.col("t" + p) >= half, double / 4).otherwise(double / 8)
        pull = [F.when(whole, -(to_q[i] * cot(r) + to_r[i] * cot(q)) / 4).otherwise(0.0) for i in range(3)]
        rows.append(F.struct(F.col(f"i{k}").alias("v"), F.when(whole, area).otherwise(0.0).alias("area"), F.when(whole, F.col("t" + p)).otherwise(0.0).alias("angle"), *[x.alias("l" + a) for x, a in zip(pull, "xyz")], *[F.col("n" + a).alias("n" + a) for a in "xyz"]))
    sums = c.select(F.inline(F.array(*rows)))
    sums = sums.groupBy("v").agg(*[F.sum(x).alias(x) for x in sums.columns[1:]])
    from .topology import boundary_edges

    rim = boundary_edges(faces)
    ends = rim.select(F.inline(F.array(F.struct(F.col("org").alias("v"), F.col("dst").alias("out"), F.lit(None).cast("long").alias("back")), F.struct(F.col("dst").alias("v"), F.lit(None).cast("long").alias("out"), F.col("org").alias("back")))))
    ends = ends.groupBy("v").agg(F.count("out").alias("outs"), F.max("out").alias("out"), F.max("back").alias("back")).where("outs = 1 and back is not null")
    at = lambda name: vertices.select(F.col("v").alias(name), *[F.col(x).alias(name + x) for x in "xyz"])
    wide = ends.join(at("v"), "v").join(at("out"), "out").join(at("back"), "back")
    u, w = _vec("v", "out"), _vec("v", "back")
    turn = wide.select("v", F.atan2(_norm(_cross(u, w)), _dot(u, w)).alias("turn"))
    all_ = vertices.select("v").join(sums, "v", "left").join(turn, "v", "left")
    pull, n = [F.col("l" + x) for x in "xyz"], [F.col("n" + x) for x in "xyz"]
    solid = F.col("area") > 2.0**-52
    sign = F.when(_dot(pull, n) > 0, F.lit(1.0)).otherwise(-1.0)
    defect = 2 * math.pi - F.col("angle") - F.coalesce("turn", F.lit(0.0))
    return all_.select("v", F.when(solid, sign * _norm(pull) / F.col("area")).otherwise(0.0).alias("mean"), F.when(solid, defect / F.col("area")).otherwise(0.0).alias("gaussian"))


def face_angle_sums(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, angle): the sum of the angles of faces at each vertex that has some."""
    a = face_angles(vertices, faces)
    return a.select(F.inline(F.array(*[F.struct(F.col(f"i{k}").alias("v"), F.col(f"a{k}").alias("angle")) for k in range(3)]))).groupBy("v").agg(F.sum("angle").alias("angle"))
