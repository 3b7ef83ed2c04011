"""Queries of pairing codes, masks, adjacent faces, shape, curvature, moments and selections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import elements as E
from ..operators import selection as S
from ..operators import topology as T
from ..sources.derived import CORNERS_SQL, FIELD, TORN, height_field, torn_field

R = 5
ANGLE = 60.0
APEX = (1.0, -2.0, 3.0)


def _r(df, *columns):
    return df.withColumns({c: F.round(c, R) + 0.0 for c in columns})


def mates(spark, sf_dir):
    return E.halfedge_mates(torn_field(spark, sf_dir)[1])


def masks(spark, sf_dir):
    _, f = torn_field(spark, sf_dir)
    return E.edge_manifold_mask(f).withColumnRenamed("ok", "manifold").join(E.watertight_mask(f).withColumnRenamed("ok", "watertight"), "f")


def winding(spark, sf_dir):
    return E.edge_winding_mask(torn_field(spark, sf_dir)[1])


def volume_flag(spark, sf_dir):
    return E.is_volume(*height_field(spark, sf_dir))


def ears(spark, sf_dir):
    return E.ears(torn_field(spark, sf_dir)[1])


def apexes(spark, sf_dir):
    return E.adjacent_apexes(height_field(spark, sf_dir)[1])


def projections(spark, sf_dir):
    return _r(E.adjacent_projections(*height_field(spark, sf_dir)), "height")


def creases(spark, sf_dir):
    return _r(E.crease_edges(*height_field(spark, sf_dir), ANGLE), "angle")


def quality(spark, sf_dir):
    q = E.face_quality(*height_field(spark, sf_dir))
    return _r(q, *q.columns[1:])


def volumes(spark, sf_dir):
    return _r(E.signed_volumes(*height_field(spark, sf_dir), APEX), "volume")


def closest(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    at = f.select("f", (F.col("f") % 40).cast("double").alias("x"), (F.col("f") % 37).cast("double").alias("y"), (F.col("f") % 11).cast("double").alias("z"))
    return _r(E.closest_points(v, f, at).select("f", "d"), "d")


def barycentric(spark, sf_dir):
    """There and back: the largest error over all faces, and the sum of the coordinates."""
    v, f = height_field(spark, sf_dir)
    w = f.select("f", ((F.col("f") % 5 + 1) / 10.0).alias("w0"), ((F.col("f") % 3 + 1) / 10.0).alias("w1")).withColumn("w2", 1 - F.col("w0") - F.col("w1"))
    p = E.barycentric_to_points(v, f, w)
    back = E.points_to_barycentric(v, f, p).select("f", F.col("w0").alias("r0"), F.col("w1").alias("r1"), F.col("w2").alias("r2"))
    off = F.max(F.greatest(*[F.abs(F.col(f"w{k}") - F.col(f"r{k}")) for k in range(3)])) < 1e-6
    return w.join(back, "f").join(p, "f").agg(off.alias("exact"), *[F.round(F.sum(x), 3).alias(x) for x in "xyz"])


def normals_by_angle(spark, sf_dir):
    return _r(E.weighted_normals(*height_field(spark, sf_dir)), *"xyz")


def normals_by_sine(spark, sf_dir):
    return _r(E.weighted_normals(*height_field(spark, sf_dir), "mwselr"), *"xyz")


def curvatures(spark, sf_dir):
    """The size of the mean curvature: on a flat rim the pull lies in the plane, and its sign is that of rounding."""
    c = E.vertex_curvatures(*height_field(spark, sf_dir))
    return c.select("v", F.round(F.abs("mean"), 4).alias("mean"), F.round("gaussian", 4).alias("gaussian"))


def _chosen(faces):
    return faces.where("f % 7 < 3").select("f")


def region(spark, sf_dir):
    _, f = height_field(spark, sf_dir)
    return S.region_boundary_edges(f, _chosen(f))


def incident(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    chosen = v.where("v % 3 < 2")
    counts = lambda mode: S.faces_of_vertices(f, chosen, mode).agg(F.count("*").alias("n_" + mode), F.sum("f").alias("sum_" + mode))
    return counts("all").crossJoin(counts("any"))


def compacted(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return S.compact(v, f.where("f % 5 = 1"))[1]


def concatenated(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    return S.concatenate([mesh, mesh])[1]


def flips(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    turned = f.select("f", "i0", F.when(F.expr("f % 53 = 7"), F.col("i2")).otherwise(F.col("i1")).alias("i1"), F.when(F.expr("f % 53 = 7"), F.col("i1")).otherwise(F.col("i2")).alias("i2"))
    return S.face_flips(turned)


def filled(spark, sf_dir):
    """Square rings of faces around every eighth cell are filled."""
    v, f = height_field(spark, sf_dir)
    at = f.join(v.select(F.col("v").alias("i0"), F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy")), "i0")
    ring = at.where("greatest(abs(cx % 8 - 4), abs(cy % 8 - 4)) = 2").select("f")
    return S.fill_holes(v, f, ring)


def welded(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    out = S.merge_vertices(v, f, 2.0)
    return out[1]


def manifold_vertices(spark, sf_dir):
    """Strips of faces that meet at corners only."""
    v, f = height_field(spark, sf_dir)
    at = f.join(v.select(F.col("v").alias("i0"), F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy")), "i0")
    return S.vertex_manifold_mask(v, at.where("(cx + cy) % 2 = 0").select("f", "i0", "i1", "i2"))


SHARES = ", S AS (SELECT *, count(*) OVER (PARTITION BY lo, hi) AS n FROM H)"
PAIRS = SHARES + ", O AS (SELECT f, k, lo, hi, n, CASE k WHEN 0 THEN i2 WHEN 1 THEN i0 ELSE i1 END AS apex FROM S JOIN F USING (f)), P AS (SELECT a.f AS f0, b.f AS f1, a.lo AS lo, a.hi AS hi, a.apex AS u0, b.apex AS u1 FROM O a JOIN O b ON a.lo = b.lo AND a.hi = b.hi AND a.f < b.f WHERE a.n = 2)"
UNIT = ", U AS (SELECT f, i0, nx / sqrt(nx*nx+ny*ny+nz*nz) AS ux, ny / sqrt(nx*nx+ny*ny+nz*nz) AS uy, nz / sqrt(nx*nx+ny*ny+nz*nz) AS uz FROM N)"
SIDES = ", L AS (SELECT f, sqrt((b_x-a_x)**2+(b_y-a_y)**2+(b_z-a_z)**2) AS p, sqrt((c_x-b_x)**2+(c_y-b_y)**2+(c_z-b_z)**2) AS q, sqrt((a_x-c_x)**2+(a_y-c_y)**2+(a_z-c_z)**2) AS r, sqrt(nx*nx+ny*ny+nz*nz) / 2 AS area FROM N)"
# Each corner first, with its two sides and the angles at all three.
AROUND = """, K AS (SELECT f, i0 AS v, a_x AS x, a_y AS y, a_z AS z, b_x AS qx, b_y AS qy, b_z AS qz, c_x AS rx, c_y AS ry, c_z AS rz, nx, ny, nz FROM N
    UNION ALL SELECT f, i1, b_x, b_y, b_z, c_x, c_y, c_z, a_x, a_y, a_z, nx, ny, nz FROM N UNION ALL SELECT f, i2, c_x, c_y, c_z, a_x, a_y, a_z, b_x, b_y, b_z, nx, ny, nz FROM N),
  D AS (SELECT *, (qx-x)*(rx-x)+(qy-y)*(ry-y)+(qz-z)*(rz-z) AS dp, (x-qx)*(rx-qx)+(y-qy)*(ry-qy)+(z-qz)*(rz-qz) AS dq, (x-rx)*(qx-rx)+(y-ry)*(qy-ry)+(z-rz)*(qz-rz) AS dr,
      (qx-x)**2+(qy-y)**2+(qz-z)**2 AS qq, (rx-x)**2+(ry-y)**2+(rz-z)**2 AS rr, sqrt(nx*nx+ny*ny+nz*nz) AS w FROM K)"""
NORMAL = "SELECT V.v, round(coalesce(sx / len, 0), 5) + 0.0 AS x, round(coalesce(sy / len, 0), 5) + 0.0 AS y, round(coalesce(sz / len, 0), 5) + 0.0 AS z FROM V LEFT JOIN (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS len FROM G) USING (v)"
_CELL = "CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy"
_FLAT = "least(greatest(t, 0), 1)"
SQL = {
    "mesh_halfedge_mates": TORN + ", S AS (SELECT *, count(*) OVER w AS n, min(h) OVER w AS first, sum(h) OVER w AS total FROM H WINDOW w AS (PARTITION BY lo, hi)) SELECT h, CAST(CASE n WHEN 1 THEN -1 WHEN 2 THEN total - h ELSE -2 - first END AS BIGINT) AS mate FROM S",
    "mesh_face_masks": TORN + SHARES + " SELECT f, max(n) <= 2 AS manifold, min(n) = 2 AND max(n) = 2 AS watertight FROM S GROUP BY f",
    "mesh_edge_winding": TORN + " SELECT lo, hi, count(*) FILTER (org = lo) = 1 AS ok FROM H GROUP BY lo, hi HAVING count(*) = 2",
    "mesh_is_volume": FIELD + " SELECT (SELECT bool_and(n = 2) FROM (SELECT count(*) AS n FROM H GROUP BY lo, hi)) AS is_volume",
    "mesh_ears": TORN + SHARES + " SELECT f, CAST((max(k) FILTER (n <> 1) + 2) % 3 AS BIGINT) AS opposite FROM S GROUP BY f HAVING count(*) FILTER (n = 1) = 2",
    "mesh_adjacent_apexes": FIELD + PAIRS + " SELECT * FROM P",
    "mesh_adjacent_projections": FIELD + CORNERS_SQL + UNIT + PAIRS + ", T AS (SELECT f0, f1, lo, hi, ux * (q.x - p.x) + uy * (q.y - p.y) + uz * (q.z - p.z) AS height FROM P JOIN U ON U.f = f0 JOIN V p ON p.v = lo JOIN V q ON q.v = u1) SELECT f0, f1, lo, hi, round(height, 5) + 0.0 AS height, height < 1e-8 AS convex FROM T",
    "mesh_crease_edges": FIELD + CORNERS_SQL + UNIT + PAIRS + f", T AS (SELECT lo, hi, atan2(sqrt((a.uy*b.uz-a.uz*b.uy)**2 + (a.uz*b.ux-a.ux*b.uz)**2 + (a.ux*b.uy-a.uy*b.ux)**2), a.ux*b.ux + a.uy*b.uy + a.uz*b.uz) AS angle FROM P JOIN U a ON a.f = f0 JOIN U b ON b.f = f1) SELECT lo, hi, round(angle, 5) + 0.0 AS angle FROM T WHERE angle > {math.radians(ANGLE)}",
    "mesh_face_quality": FIELD + CORNERS_SQL + SIDES + " SELECT f, round(p*q*r*(p+q+r) / (16*area**2), 5) + 0.0 AS aspect_ratio, round(16*area**2 / (p*q*r*(p+q+r)), 5) + 0.0 AS radius_ratio, round(2*area / greatest(p, q, r)**2, 5) + 0.0 AS area_max_side, round(4*sqrt(3)*area / (p*p+q*q+r*r), 5) + 0.0 AS mean_ratio, round(area, 5) + 0.0 AS area FROM L",
    "mesh_signed_volumes": FIELD + CORNERS_SQL + f", M AS (SELECT f, {', '.join(f'{k}_{x} - ({o}::DOUBLE) AS {k}_{x}' for k in 'abc' for x, o in zip('xyz', APEX))} FROM C) SELECT f, round((a_x*(b_y*c_z-b_z*c_y) + a_y*(b_z*c_x-b_x*c_z) + a_z*(b_x*c_y-b_y*c_x)) / 6, 5) + 0.0 AS volume FROM M",
    "mesh_closest_points": FIELD + CORNERS_SQL + f""", K AS (SELECT *, (f % 40)::DOUBLE AS x, (f % 37)::DOUBLE AS y, (f % 11)::DOUBLE AS z FROM N),
        A AS (SELECT f, a_x AS ax, a_y AS ay, a_z AS az, b_x - a_x AS sx, b_y - a_y AS sy, b_z - a_z AS sz, x, y, z FROM K UNION ALL SELECT f, b_x, b_y, b_z, c_x - b_x, c_y - b_y, c_z - b_z, x, y, z FROM K UNION ALL SELECT f, c_x, c_y, c_z, a_x - c_x, a_y - c_y, a_z - c_z, x, y, z FROM K),
        B AS (SELECT *, ((x-ax)*sx + (y-ay)*sy + (z-az)*sz) / (sx*sx+sy*sy+sz*sz) AS t FROM A),
        E AS (SELECT f, min(sqrt((x-ax-{_FLAT}*sx)**2 + (y-ay-{_FLAT}*sy)**2 + (z-az-{_FLAT}*sz)**2)) AS d FROM B GROUP BY f),
        I AS (SELECT f, ((x-a_x)*nx + (y-a_y)*ny + (z-a_z)*nz) / sqrt(nx*nx+ny*ny+nz*nz) AS h,
            ((b_y-a_y)*(z-a_z)-(b_z-a_z)*(y-a_y))*nx + ((b_z-a_z)*(x-a_x)-(b_x-a_x)*(z-a_z))*ny + ((b_x-a_x)*(y-a_y)-(b_y-a_y)*(x-a_x))*nz AS s0,
            ((c_y-b_y)*(z-b_z)-(c_z-b_z)*(y-b_y))*nx + ((c_z-b_z)*(x-b_x)-(c_x-b_x)*(z-b_z))*ny + ((c_x-b_x)*(y-b_y)-(c_y-b_y)*(x-b_x))*nz AS s1,
            ((a_y-c_y)*(z-c_z)-(a_z-c_z)*(y-c_y))*nx + ((a_z-c_z)*(x-c_x)-(a_x-c_x)*(z-c_z))*ny + ((a_x-c_x)*(y-c_y)-(a_y-c_y)*(x-c_x))*nz AS s2 FROM K)
        SELECT f, round(CASE WHEN s0 >= 0 AND s1 >= 0 AND s2 >= 0 THEN abs(h) ELSE d END, 5) + 0.0 AS d FROM E JOIN I USING (f)""",
    "mesh_barycentric": FIELD + CORNERS_SQL + ", B AS (SELECT *, (f % 5 + 1) / 10.0::DOUBLE AS w0, (f % 3 + 1) / 10.0::DOUBLE AS w1 FROM C) SELECT true AS exact, " + ", ".join(f"round(sum(w0 * a_{x} + w1 * b_{x} + (1 - w0 - w1) * c_{x}), 3) AS {x}" for x in "xyz") + " FROM B",
    "mesh_normals_by_angle": FIELD + CORNERS_SQL + AROUND + ", G AS (SELECT v, " + ", ".join(f"sum(n{x} / w * atan2(w, dp)) AS s{x}" for x in "xyz") + f" FROM D GROUP BY v) {NORMAL}",
    "mesh_normals_by_sine": FIELD + CORNERS_SQL + AROUND + ", G AS (SELECT v, " + ", ".join(f"sum(n{x} / (qq * rr)) AS s{x}" for x in "xyz") + f" FROM D GROUP BY v) {NORMAL}",
    "mesh_vertex_curvatures": FIELD + CORNERS_SQL + AROUND + """,
        M AS (SELECT v, nx, ny, nz, atan2(w, dp) AS t, CASE WHEN dp > 0 AND dq > 0 AND dr > 0 THEN (qq * dr + rr * dq) / w / 8 WHEN dp <= 0 THEN w / 4 ELSE w / 8 END AS area,
              ((x-qx)*dr + (x-rx)*dq) / w / 4 AS lx, ((y-qy)*dr + (y-ry)*dq) / w / 4 AS ly, ((z-qz)*dr + (z-rz)*dq) / w / 4 AS lz FROM D),
        G AS (SELECT v, sum(area) AS area, sum(t) AS t, sum(lx) AS lx, sum(ly) AS ly, sum(lz) AS lz, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM M GROUP BY v),
        B AS (SELECT org, dst FROM H JOIN (SELECT lo, hi FROM H GROUP BY ALL HAVING count(*) = 1) USING (lo, hi)),
        T AS (SELECT o.org AS v, p.x - h.x AS ux, p.y - h.y AS uy, p.z - h.z AS uz, q.x - h.x AS wx, q.y - h.y AS wy, q.z - h.z AS wz FROM B o JOIN B i ON i.dst = o.org JOIN V h ON h.v = o.org JOIN V p ON p.v = o.dst JOIN V q ON q.v = i.org)
        SELECT v, round(sqrt(lx*lx + ly*ly + lz*lz) / area, 4) AS mean,
               round((2 * pi() - t - coalesce(atan2(sqrt((uy*wz-uz*wy)**2 + (uz*wx-ux*wz)**2 + (ux*wy-uy*wx)**2), ux*wx + uy*wy + uz*wz), 0)) / area, 4) AS gaussian FROM G LEFT JOIN T USING (v)""",
    "mesh_region_boundary": FIELD + SHARES + " SELECT a.org AS org, a.dst AS dst, a.f AS f FROM S a JOIN S b ON a.lo = b.lo AND a.hi = b.hi AND a.f <> b.f WHERE a.n = 2 AND a.f % 7 < 3 AND b.f % 7 >= 3",
    "mesh_faces_of_vertices": FIELD + ", A AS (SELECT f, (i0 % 3 < 2)::INT + (i1 % 3 < 2)::INT + (i2 % 3 < 2)::INT AS n FROM F) SELECT count(*) FILTER (n = 3) AS n_all, CAST(sum(f) FILTER (n = 3) AS BIGINT) AS sum_all, count(*) FILTER (n >= 1) AS n_any, CAST(sum(f) FILTER (n >= 1) AS BIGINT) AS sum_any FROM A",
    "mesh_compact": FIELD + ", K AS (SELECT * FROM F WHERE f % 5 = 1), U AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT i0 AS v FROM K UNION SELECT i1 FROM K UNION SELECT i2 FROM K)) SELECT row_number() OVER (ORDER BY f) - 1 AS f, a.id AS i0, b.id AS i1, c.id AS i2, f AS source FROM K JOIN U a ON a.v = i0 JOIN U b ON b.v = i1 JOIN U c ON c.v = i2",
    "mesh_concatenate": FIELD + " SELECT f, i0, i1, i2 FROM F UNION ALL SELECT f + (SELECT max(f) + 1 FROM F), i0 + m, i1 + m, i2 + m FROM F, (SELECT max(v) + 1 AS m FROM V)",
    "mesh_face_flips": FIELD + " SELECT f, f % 53 = 7 AS flip, true AS orientable FROM F",
    "mesh_fill_holes": FIELD + f", K AS (SELECT f, n, {_CELL} FROM F JOIN VN ON v = i0), L AS (SELECT f, greatest(abs(cx % 8 - 4), abs(cy % 8 - 4)) AS d, (cx // 8) * 8 + 6 <= n - 2 AND (cy // 8) * 8 + 6 <= n - 2 AS whole FROM K) SELECT f FROM L WHERE d = 2 OR d < 2 AND whole",
    "mesh_merge_vertices": FIELD + ", G AS (SELECT v, min(v) OVER (PARTITION BY floor((x - (SELECT min(x) FROM V)) / 2), floor((y - (SELECT min(y) FROM V)) / 2), floor((z - (SELECT min(z) FROM V)) / 2)) AS t FROM V) SELECT f, a.t AS i0, b.t AS i1, c.t AS i2 FROM F JOIN G a ON a.v = i0 JOIN G b ON b.v = i1 JOIN G c ON c.v = i2",
    "mesh_manifold_vertices": FIELD + f", K AS (SELECT f, i0, i1, i2, {_CELL} FROM F JOIN V ON v = i0), A AS (SELECT v, (cx, cy) AS cell FROM K, unnest([i0, i1, i2]) u(v) WHERE (cx + cy) % 2 = 0) SELECT V.v, count(DISTINCT cell) = 1 AS ok FROM V LEFT JOIN A USING (v) GROUP BY V.v",
}
QUERIES = {
    "mesh_halfedge_mates": mates, "mesh_face_masks": masks, "mesh_edge_winding": winding, "mesh_is_volume": volume_flag, "mesh_ears": ears, "mesh_adjacent_apexes": apexes,
    "mesh_adjacent_projections": projections, "mesh_crease_edges": creases, "mesh_face_quality": quality, "mesh_signed_volumes": volumes, "mesh_closest_points": closest,
    "mesh_barycentric": barycentric, "mesh_normals_by_angle": normals_by_angle, "mesh_normals_by_sine": normals_by_sine, "mesh_vertex_curvatures": curvatures,
    "mesh_region_boundary": region, "mesh_faces_of_vertices": incident, "mesh_compact": compacted, "mesh_concatenate": concatenated, "mesh_face_flips": flips,
    "mesh_fill_holes": filled, "mesh_merge_vertices": welded, "mesh_manifold_vertices": manifold_vertices,
}
