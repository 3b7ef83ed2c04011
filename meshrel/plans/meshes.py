"""Queries of topology and geometry over the height field of part and its torn form."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import topology as T
from ..sources.derived import CORNERS_SQL, FIELD, TORN, height_field, torn_field

R = 5


def _r(df, *columns):
    return df.withColumns({c: F.round(c, R) + 0.0 for c in columns})


def _longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def halfedges(spark, sf_dir):
    return _longs(T.halfedges(height_field(spark, sf_dir)[1]), "k")


def unique_edges(spark, sf_dir):
    return T.unique_edges(torn_field(spark, sf_dir)[1])


def edge_lengths(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(T.edge_lengths(v, T.unique_edges(f)).select("lo", "hi", "length"), "length")


def mean_edge_length(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    by_face = T.edge_lengths(v, T.halfedges(f)).agg(F.avg("length").alias("per_face"), F.sum("length").alias("total"))
    by_edge = T.edge_lengths(v, T.unique_edges(f)).agg(F.avg("length").alias("per_edge"))
    return _r(by_face.crossJoin(by_edge), "per_face", "total", "per_edge")


def twins(spark, sf_dir):
    return T.twins(height_field(spark, sf_dir)[1])


def face_adjacency(spark, sf_dir):
    return T.face_adjacency(torn_field(spark, sf_dir)[1])


def vertex_neighbors(spark, sf_dir):
    return T.vertex_neighbors(height_field(spark, sf_dir)[1])


def vertex_degrees(spark, sf_dir):
    return T.vertex_degrees(*torn_field(spark, sf_dir))


def vertex_faces(spark, sf_dir):
    return T.vertex_faces(height_field(spark, sf_dir)[1]).select("v", F.size("faces").cast("long").alias("n"), F.col("faces")[0].alias("first_face"), F.array_max("faces").alias("last_face"))


def boundary_edges(spark, sf_dir):
    return T.boundary_edges(torn_field(spark, sf_dir)[1])


def boundary_vertices(spark, sf_dir):
    return T.boundary_vertices(torn_field(spark, sf_dir)[1])


def non_manifold_edges(spark, sf_dir):
    return T.non_manifold_edges(torn_field(spark, sf_dir)[1])


def euler(spark, sf_dir):
    return T.euler_characteristic(torn_field(spark, sf_dir)[1])


def validity(spark, sf_dir):
    return _longs(T.validity(torn_field(spark, sf_dir)[1]), "n_duplicate", "n_degenerate")


def remove_degenerate(spark, sf_dir):
    return T.remove_degenerate(torn_field(spark, sf_dir)[1])


def remove_duplicates(spark, sf_dir):
    return T.remove_duplicates(torn_field(spark, sf_dir)[1])


def canonical_faces(spark, sf_dir):
    return T.canonical_faces(torn_field(spark, sf_dir)[1])


def referenced_vertices(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return T.referenced_vertices(v, f.where("f % 10 = 0")).select("v")


def graph_laplacian(spark, sf_dir):
    return T.graph_laplacian(height_field(spark, sf_dir)[1])


def face_geometry(spark, sf_dir):
    return _r(G.face_geometry(*height_field(spark, sf_dir)).select("f", "area", "gx", "gy", "gz"), "area", "gx", "gy", "gz")


def face_normals(spark, sf_dir):
    return _r(G.face_normals(*height_field(spark, sf_dir)), *"xyz")


def face_angles(spark, sf_dir):
    return _r(G.face_angles(*height_field(spark, sf_dir)).select("f", "a0", "a1", "a2"), "a0", "a1", "a2")


def triangle_quality(spark, sf_dir):
    return _r(G.triangle_quality(*height_field(spark, sf_dir)), "aspect", "compactness")


def vertex_normals(spark, sf_dir):
    return _r(G.vertex_normals(*height_field(spark, sf_dir)), *"xyz")


def measures(spark, sf_dir):
    m = G.measures(*height_field(spark, sf_dir))
    return m.select(*[F.round(c, 3).alias(c) for c in ("area", "volume", "cx", "cy", "cz")])


def bounds(spark, sf_dir):
    b = G.aabb(height_field(spark, sf_dir)[0])
    return _r(b, *b.columns)


def face_bounds(spark, sf_dir):
    b = G.face_bounds(*height_field(spark, sf_dir))
    return _r(b, *[c for c in b.columns if c != "f"])


def points_in_box(spark, sf_dir):
    return G.points_in_aabb(height_field(spark, sf_dir)[0], (5, 5, 0), (20, 30, 12)).select("v")


TURN = [[0.0, -2.0, 0.0, 1.0], [1.0, 0.0, 0.5, -3.0], [0.0, 0.0, 1.5, 2.0], [0.0, 0.0, 0.0, 1.0]]


def apply_transform(spark, sf_dir):
    return _r(G.apply_transform(height_field(spark, sf_dir)[0], TURN), *"xyz")


def normalize(spark, sf_dir):
    return _r(G.normalize(height_field(spark, sf_dir)[0]), *"xyz")


def angle_defects(spark, sf_dir):
    return _r(G.angle_defects(*height_field(spark, sf_dir)), "defect")


def cotangent_laplacian(spark, sf_dir):
    return _r(G.cotangent_laplacian(*height_field(spark, sf_dir)), "val")


def mass_matrix(spark, sf_dir):
    return _r(G.mass_matrix(*height_field(spark, sf_dir)), "val")


def dihedral_angles(spark, sf_dir):
    return _r(G.dihedral_angles(*height_field(spark, sf_dir)), "angle")


def laplacian_smoothing(spark, sf_dir):
    out = G.laplacian_smoothing(*height_field(spark, sf_dir))
    return out.select("v", *[(F.round(x, 7) + 0.0).alias(x) for x in "xyz"])


def subdivided_area(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    v2, f2 = G.subdivide(v, f, 1 << 40)
    return G.measures(v2, f2).select(F.round("area", 3).alias("area")).crossJoin(T.euler_characteristic(f2))


QUERIES = {
    f"mesh_{f.__name__}": f
    for f in (
        halfedges, unique_edges, edge_lengths, mean_edge_length, twins, face_adjacency, vertex_neighbors, vertex_degrees, vertex_faces,
        boundary_edges, boundary_vertices, non_manifold_edges, euler, validity, remove_degenerate, remove_duplicates, canonical_faces,
        referenced_vertices, graph_laplacian, face_geometry, face_normals, face_angles, triangle_quality, vertex_normals, measures, bounds,
        face_bounds, points_in_box, apply_transform, normalize, angle_defects, cotangent_laplacian, mass_matrix, dihedral_angles,
        laplacian_smoothing, subdivided_area,
    )
}

_E = ", E AS (SELECT lo, hi, count(*) AS n_faces FROM H GROUP BY 1, 2)"
_L = _E + ", EL AS (SELECT lo, hi, n_faces, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS length FROM E JOIN V a ON a.v = lo JOIN V b ON b.v = hi)"
_NB = ", NB AS (SELECT DISTINCT lo AS v, hi AS neighbor FROM H WHERE lo <> hi UNION SELECT DISTINCT hi, lo FROM H WHERE lo <> hi)"
_BE = _E + ", BE AS (SELECT org, dst, f FROM H JOIN E USING (lo, hi) WHERE n_faces = 1)"
_AREA = ", A AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area FROM N)"


def _angle(p, q, r):
    u, v = [f"({q}_{x} - {p}_{x})" for x in "xyz"], [f"({r}_{x} - {p}_{x})" for x in "xyz"]
    c = [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
    size = "sqrt(" + " + ".join(f"{x} * {x}" for x in c) + ")"
    dot = "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v)) + ")"
    return size, dot


def _atan(*p):
    size, dot = _angle(*p)
    return f"atan2({size}, {dot})"


def _cot(*p):
    size, dot = _angle(*p)
    return f"({dot} / greatest({size}, 1e-12) / 2)"


def _rounds(columns, digits=R):
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


_UNIT = {x: f"CASE WHEN area > 1e-12 THEN n{x} / (2 * area) ELSE 0.0 END" for x in "xyz"}
_EDGES2 = " + ".join(f"({q}_{x} - {p}_{x}) ** 2" for p, q in ("ab", "bc", "ca") for x in "xyz")
_LONGEST = "greatest(" + ", ".join("sqrt(" + " + ".join(f"({q}_{x} - {p}_{x}) ** 2" for x in "xyz") + ")" for p, q in ("ab", "bc", "ca")) + ")"
_VOL = "(a_x * (b_y * c_z - b_z * c_y) + a_y * (b_z * c_x - b_x * c_z) + a_z * (b_x * c_y - b_y * c_x)) / 6"

SQL = {
    "mesh_halfedges": FIELD + "SELECT h, f, CAST(k AS BIGINT) AS k, org, dst, lo, hi FROM H",
    "mesh_unique_edges": TORN + _E + "SELECT * FROM E",
    "mesh_edge_lengths": FIELD + _L + f"SELECT lo, hi, {_rounds({'length': 'length'})} FROM EL",
    "mesh_mean_edge_length": FIELD + _L + "SELECT round(sum(length * n_faces) / sum(n_faces), 5) + 0.0 AS per_face, round(sum(length * n_faces), 5) + 0.0 AS total, round(avg(length), 5) + 0.0 AS per_edge FROM EL",
    "mesh_twins": FIELD + "SELECT a.h AS h, coalesce(min(b.h), -1) AS twin FROM H a LEFT JOIN H b ON a.org = b.dst AND a.dst = b.org GROUP BY a.h",
    "mesh_face_adjacency": TORN + "SELECT lo, hi, min(f) AS f0, max(f) AS f1 FROM H GROUP BY lo, hi HAVING count(*) = 2 AND min(f) <> max(f)",
    "mesh_vertex_neighbors": FIELD + _NB + "SELECT * FROM NB",
    "mesh_vertex_degrees": TORN + _NB + "SELECT V.v AS v, count(neighbor) AS degree FROM V LEFT JOIN NB ON NB.v = V.v GROUP BY V.v",
    "mesh_vertex_faces": FIELD + "SELECT org AS v, count(DISTINCT f) AS n, min(f) AS first_face, max(f) AS last_face FROM H GROUP BY org",
    "mesh_boundary_edges": TORN + _BE + "SELECT * FROM BE",
    "mesh_boundary_vertices": TORN + _BE + "SELECT org AS v FROM BE UNION SELECT dst FROM BE",
    "mesh_non_manifold_edges": TORN + _E + "SELECT * FROM E WHERE n_faces > 2",
    "mesh_euler": TORN + _E + "SELECT (SELECT count(DISTINCT org) FROM H) AS n_vertices, (SELECT count(*) FROM E) AS n_edges, (SELECT count(*) FROM F) AS n_faces, (SELECT count(DISTINCT org) FROM H) - (SELECT count(*) FROM E) + (SELECT count(*) FROM F) AS euler",
    "mesh_validity": TORN + ", D AS (SELECT count(*) AS n, sum(CASE WHEN org = lo THEN 1 ELSE 0 END) AS fw FROM H GROUP BY lo, hi) SELECT bool_and(n <= 2) AS edge_manifold, bool_and(n = 2) AS watertight, bool_and(n <> 2 OR fw = 1) AS winding_consistent, (SELECT count(*) - count(DISTINCT list_sort([i0, i1, i2])) FROM F) AS n_duplicate, (SELECT count(*) FROM F WHERE i0 = i1 OR i1 = i2 OR i2 = i0) AS n_degenerate FROM D",
    "mesh_remove_degenerate": TORN + "SELECT * FROM F WHERE i0 <> i1 AND i1 <> i2 AND i2 <> i0",
    "mesh_remove_duplicates": TORN + "SELECT f, i0, i1, i2 FROM (SELECT *, row_number() OVER (PARTITION BY list_sort([i0, i1, i2]) ORDER BY f) AS rn FROM F) WHERE rn = 1",
    "mesh_canonical_faces": TORN + "SELECT f, CASE WHEN i0 <= i1 AND i0 <= i2 THEN i0 WHEN i1 < i0 AND i1 <= i2 THEN i1 ELSE i2 END AS i0, CASE WHEN i0 <= i1 AND i0 <= i2 THEN i1 WHEN i1 < i0 AND i1 <= i2 THEN i2 ELSE i0 END AS i1, CASE WHEN i0 <= i1 AND i0 <= i2 THEN i2 WHEN i1 < i0 AND i1 <= i2 THEN i0 ELSE i1 END AS i2 FROM F",
    "mesh_referenced_vertices": FIELD + "SELECT DISTINCT org AS v FROM H WHERE f % 10 = 0",
    "mesh_graph_laplacian": FIELD + _NB + "SELECT v AS row, neighbor AS col, CAST(-1 AS DOUBLE) AS val FROM NB UNION ALL SELECT v, v, CAST(count(*) AS DOUBLE) FROM NB GROUP BY v",
    "mesh_face_geometry": FIELD + CORNERS_SQL + _AREA + "SELECT f, " + _rounds({"area": "area", **{f"g{x}": f"(a_{x} + b_{x} + c_{x}) / 3" for x in "xyz"}}) + " FROM A",
    "mesh_face_normals": FIELD + CORNERS_SQL + _AREA + f"SELECT f, {_rounds(_UNIT)} FROM A",
    "mesh_face_angles": FIELD + CORNERS_SQL + "SELECT f, " + _rounds({"a0": _atan(*"abc"), "a1": _atan(*"bca"), "a2": _atan(*"cab")}) + " FROM C",
    "mesh_triangle_quality": FIELD + CORNERS_SQL + _AREA + "SELECT f, " + _rounds({"aspect": f"{_LONGEST} ** 2 / (2 * area)", "compactness": f"2 * sqrt(3) * (2 * area) / ({_EDGES2})"}) + " FROM A",
    "mesh_vertex_normals": FIELD + CORNERS_SQL + ", S AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT i0 AS v, nx, ny, nz FROM N UNION ALL SELECT i1, nx, ny, nz FROM N UNION ALL SELECT i2, nx, ny, nz FROM N) GROUP BY v) SELECT v, " + _rounds({x: f"n{x} / sqrt(nx * nx + ny * ny + nz * nz)" for x in "xyz"}) + " FROM S",
    "mesh_measures": FIELD + CORNERS_SQL + _AREA + f"SELECT round(sum(area), 3) AS area, round(sum({_VOL}), 3) AS volume, " + ", ".join(f"round(sum((a_{x} + b_{x} + c_{x}) / 3 * area) / sum(area), 3) AS c{x}" for x in "xyz") + " FROM A",
    "mesh_bounds": FIELD + "SELECT " + _rounds({**{f"min_{x}": f"min({x})" for x in "xyz"}, **{f"max_{x}": f"max({x})" for x in "xyz"}, "diagonal": "sqrt(" + " + ".join(f"(max({x}) - min({x})) ** 2" for x in "xyz") + ")", **{f"mid_{x}": f"(min({x}) + max({x})) / 2" for x in "xyz"}}) + " FROM V",
    "mesh_face_bounds": FIELD + CORNERS_SQL + "SELECT f, " + _rounds({**{f"min_{x}": f"least(a_{x}, b_{x}, c_{x})" for x in "xyz"}, **{f"max_{x}": f"greatest(a_{x}, b_{x}, c_{x})" for x in "xyz"}}) + " FROM C",
    "mesh_points_in_box": FIELD + "SELECT v FROM V WHERE x BETWEEN 5 AND 20 AND y BETWEEN 5 AND 30 AND z BETWEEN 0 AND 12",
    "mesh_apply_transform": FIELD + "SELECT v, " + _rounds({x: " + ".join([f"{TURN[i][3]}", *[f"{c} * {TURN[i][j]}" for j, c in enumerate("xyz")]]) for i, x in enumerate("xyz")}) + " FROM V",
    "mesh_normalize": FIELD + ", B AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM V) SELECT v, " + _rounds({x: f"({x} - (l{x} + h{x}) / 2) / greatest(hx - lx, hy - ly, hz - lz)" for x in "xyz"}) + " FROM V, B",
    "mesh_angle_defects": FIELD + CORNERS_SQL + _BE + f", T AS (SELECT i0 AS v, {_atan(*'abc')} AS t FROM C UNION ALL SELECT i1, {_atan(*'bca')} FROM C UNION ALL SELECT i2, {_atan(*'cab')} FROM C), RIM AS (SELECT org AS v FROM BE UNION SELECT dst FROM BE) SELECT v, round(CASE WHEN v IN (SELECT v FROM RIM) THEN {math.pi!r} ELSE {2 * math.pi!r} END - sum(t), 5) + 0.0 AS defect FROM T GROUP BY v",
    "mesh_cotangent_laplacian": FIELD + CORNERS_SQL + f", W AS (SELECT i1 AS i, i2 AS j, {_cot(*'abc')} AS w FROM C UNION ALL SELECT i2, i0, {_cot(*'bca')} FROM C UNION ALL SELECT i0, i1, {_cot(*'cab')} FROM C) SELECT row, col, round(sum(val), 5) + 0.0 AS val FROM (SELECT i AS row, j AS col, w AS val FROM W UNION ALL SELECT j, i, w FROM W UNION ALL SELECT i, i, -w FROM W UNION ALL SELECT j, j, -w FROM W) GROUP BY 1, 2",
    "mesh_mass_matrix": FIELD + CORNERS_SQL + _AREA + "SELECT v AS row, v AS col, round(sum(area / 3), 5) + 0.0 AS val FROM (SELECT i0 AS v, area FROM A UNION ALL SELECT i1, area FROM A UNION ALL SELECT i2, area FROM A) GROUP BY v",
    "mesh_dihedral_angles": FIELD + CORNERS_SQL + _AREA + f", U AS (SELECT f, {', '.join(f'{e} AS {x}' for x, e in _UNIT.items())} FROM A), P2 AS (SELECT lo, hi, min(f) AS f0, max(f) AS f1 FROM H GROUP BY 1, 2 HAVING count(*) = 2) SELECT lo, hi, round(atan2(sqrt((p.y * q.z - p.z * q.y) ** 2 + (p.z * q.x - p.x * q.z) ** 2 + (p.x * q.y - p.y * q.x) ** 2), p.x * q.x + p.y * q.y + p.z * q.z), 5) + 0.0 AS angle FROM P2 JOIN U p ON p.f = f0 JOIN U q ON q.f = f1",
    "mesh_laplacian_smoothing": FIELD + _NB + ", MN AS (SELECT NB.v AS v, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM NB JOIN V ON V.v = neighbor GROUP BY NB.v) SELECT V.v AS v, " + _rounds({x: f"{x} + 0.5 * (coalesce(m{x}, {x}) - {x})" for x in "xyz"}, 7) + " FROM V LEFT JOIN MN ON MN.v = V.v",
    "mesh_subdivided_area": FIELD + CORNERS_SQL + _AREA + _E + "SELECT (SELECT round(sum(area), 3) FROM A) AS area, (SELECT count(*) FROM V) + (SELECT count(*) FROM E) AS n_vertices, 2 * (SELECT count(*) FROM E) + 3 * (SELECT count(*) FROM F) AS n_edges, 4 * (SELECT count(*) FROM F) AS n_faces, (SELECT count(*) FROM V) - (SELECT count(*) FROM E) + (SELECT count(*) FROM F) AS euler",
}
