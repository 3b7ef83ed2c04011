"""Queries of point clouds, voxel sets and polylines beyond joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import curves as L
from ..operators import points as P
from ..operators import voxels as X
from .clouds import CELL, CLOUD, LINES, _cloud, _lines

NORMAL = (1.0, 2.0, 2.0)
RADIUS, STEP, COUNT = 0.08, 40.0, 9


def _polylines(spark, sf_dir):
    at = W.partitionBy("line_id").orderBy("x", "pos")
    return _lines(spark, sf_dir).withColumn("pos", (F.row_number().over(at) - 1).cast("long"))


def _cells(spark, sf_dir):
    return _cloud(spark, sf_dir).select(*[F.floor(F.col(x) / CELL).alias(c) for x, c in zip("xyz", "ijk")]).distinct()


def _r(df, n, *columns):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in columns})


def plane(spark, sf_dir):
    return _r(P.plane_distances(_cloud(spark, sf_dir), NORMAL, (0.1, 0.0, 0.0)), 6, "d")


def moments(spark, sf_dir):
    m = P.second_moments(_cloud(spark, sf_dir))
    return _r(m, 6, *m.columns[1:])


def duplicates(spark, sf_dir):
    c = _cloud(spark, sf_dir)
    return P.duplicate_mask(c.unionByName(c.where("p % 3 = 0").withColumn("p", F.col("p") + 1_000_000)))


def radius_outliers(spark, sf_dir):
    return P.radius_outliers(_cloud(spark, sf_dir), RADIUS, 2)


def statistical_outliers(spark, sf_dir):
    return P.statistical_outliers(_cloud(spark, sf_dir), 4, 0.05)


def directions(spark, sf_dir):
    d = P.fibonacci_directions(spark, 500)
    return _r(d, 6, *"xyz")


def radial(spark, sf_dir):
    return _r(P.radial_angles(_cloud(spark, sf_dir), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)), 6, "angle")


def hull_points(spark, sf_dir):
    return P.convex_subset(_cloud(spark, sf_dir), 64)


def morton(spark, sf_dir):
    return P.morton_codes(_cells(spark, sf_dir).select(*[(F.col(c) + 32).alias(c) for c in "ijk"]), 6)


def surface(spark, sf_dir):
    return X.surface(X.dilate(_cells(spark, sf_dir), 26), 6)


def closing(spark, sf_dir):
    return X.closing(_cells(spark, sf_dir), 18)


def opening(spark, sf_dir):
    return X.opening(X.dilate(_cells(spark, sf_dir), 6), 6)


def orthographic(spark, sf_dir):
    return X.fill_orthographic(_cells(spark, sf_dir))


def revoxelized(spark, sf_dir):
    return X.revoxelize(_cells(spark, sf_dir), CELL, 0.07)


def voxel_corners(spark, sf_dir):
    return X.corners(_cells(spark, sf_dir))


def occupied(spark, sf_dir):
    c = _cloud(spark, sf_dir)
    cells = c.where("p % 4 = 0").select(*[F.floor(F.col(x) / CELL).alias(k) for x, k in zip("xyz", "ijk")])
    return X.occupancy(c, cells, CELL)


def dense(spark, sf_dir):
    return X.to_dense(_cells(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if("full").alias("n_full"))


def splat(spark, sf_dir):
    c = _cloud(spark, sf_dir).withColumn("val", (F.col("p") % 17).cast("double"))
    return _r(X.splat(c, (5, 5, 5), (-0.5, -0.5, -0.5), (0.5, 0.5, 0.5)), 5, "val", "density")


def boxes(spark, sf_dir):
    v, f = X.to_boxes(_cells(spark, sf_dir), CELL)
    return v.agg(F.count("*").alias("n_vertices")).crossJoin(f.agg(F.count("*").alias("n_faces")))


def centroids(spark, sf_dir):
    return _r(L.centroids(_polylines(spark, sf_dir)), 3, *"xyz")


def newell(spark, sf_dir):
    return _r(L.normals(_polylines(spark, sf_dir)), 5, *"xyz")


def angles(spark, sf_dir):
    return _r(L.turning_angles(_polylines(spark, sf_dir)), 5, "angle")


def upsampled(spark, sf_dir):
    return L.upsample(_polylines(spark, sf_dir), STEP).groupBy("line_id").agg(F.count("*").alias("n"), F.round(F.avg("y"), 5).alias("y"))


def resampled(spark, sf_dir):
    return _r(L.resample(_polylines(spark, sf_dir), COUNT), 2, *"xyz")


def radii(spark, sf_dir):
    return _r(L.radii(_polylines(spark, sf_dir), (0.0, 5.0, 1.0), (1.0, 0.0, 0.0)), 5, "least", "greatest", "mean", "middle")


def closed(spark, sf_dir):
    return L.ends(L.close_lines(_polylines(spark, sf_dir)))


_SQ = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"
_S = CLOUD + f", S AS (SELECT DISTINCT CAST(floor(x / {CELL}) AS BIGINT) AS i, CAST(floor(y / {CELL}) AS BIGINT) AS j, CAST(floor(z / {CELL}) AS BIGINT) AS k FROM P)"
_POLY = LINES + ", Q AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY x, pos) - 1 AS pos, x, y FROM L)"
_SEG = _POLY + ", G AS (SELECT * FROM (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS yb FROM Q WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE bx IS NOT NULL), E AS (SELECT *, sqrt((bx - x) ** 2 + (yb - y) ** 2) AS len FROM G)"


def _near(n, source, name):
    """The cells of ``source`` and their neighbours over up to ``n`` axes."""
    return f"{name} AS (SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM {source}, D WHERE abs(a) + abs(b) + abs(c) <= {n})"


def _inner(n, size, source, name):
    return f"{name} AS (SELECT s.i, s.j, s.k FROM {source} s, D JOIN {source} t ON t.i = s.i + a AND t.j = s.j + b AND t.k = s.k + c WHERE abs(a) + abs(b) + abs(c) <= {n} GROUP BY ALL HAVING count(*) = {size})"


_D = ", O AS (SELECT unnest([-1, 0, 1]) AS o), D AS (SELECT p.o AS a, q.o AS b, r.o AS c FROM O p, O q, O r), "
_BITS = lambda c, a: " + ".join(f"((({c} + 32) >> {b}) & 1) * {1 << (3 * b + a)}" for b in range(6))
_SPAN = lambda c, o, p: f"SELECT {o}, {p}, min({c}) AS lo, max({c}) AS hi FROM S GROUP BY {o}, {p}"
_AX = lambda x, c: f"least(greatest(({x} + 0.5) * 4, 0), 4) AS p{c}"
SQL = {
    "cloud_plane_distances": f"WITH {CLOUD} SELECT p, round((x - 0.1 + 2 * y + 2 * z) / 3, 6) + 0.0 AS d, x - 0.1 + 2 * y + 2 * z > 0 AS above FROM P",
    "cloud_moments": f"WITH {CLOUD} SELECT count(*) AS n, " + ", ".join([f"round(avg({x}), 6) + 0.0 AS c{x}" for x in "xyz"] + [f"round(sum({a} * {b}), 6) + 0.0 AS g{a}{b}, round(covar_pop({a}, {b}) * count(*), 6) + 0.0 AS s{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "yz", "xz")]) + " FROM P",
    "cloud_duplicates": f"WITH {CLOUD}, U AS (SELECT * FROM P UNION ALL SELECT p + 1000000, x, y, z FROM P WHERE p % 3 = 0) SELECT p, row_number() OVER (PARTITION BY x, y, z ORDER BY p) > 1 AS duplicate FROM U",
    "cloud_radius_outliers": f"WITH {CLOUD} SELECT a.p AS p, count(*) <= 2 AS outlier FROM P a JOIN P b ON sqrt({_SQ}) <= {RADIUS} GROUP BY a.p",
    "cloud_statistical_outliers": f"WITH {CLOUD}, D AS (SELECT a.p AS p, sqrt({_SQ}) AS d, row_number() OVER (PARTITION BY a.p ORDER BY {_SQ}, b.p) AS r FROM P a, P b), M AS (SELECT p, avg(d) AS m FROM D WHERE r <= 4 GROUP BY p) SELECT p, m > (SELECT avg(m) + 2 * stddev_samp(m) FROM M) OR m <= 0 AS outlier FROM M",
    "sample_directions": "WITH R AS (SELECT range AS i, 1 - 2 * (range + 0.5::DOUBLE) / 500 AS z, range * (pi() * (3 - sqrt(5))) AS t FROM range(500)) SELECT i, round(sqrt(1 - z * z) * cos(t), 6) + 0.0 AS x, round(sqrt(1 - z * z) * sin(t), 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM R",
    "cloud_radial_angles": f"WITH {CLOUD} SELECT p, round(atan2(y, x), 6) + 0.0 AS angle FROM P",
    "cloud_convex_subset": f"WITH {CLOUD}, R AS (SELECT range AS i, 1 - (range + 0.5::DOUBLE) / 64 AS dz, range * (pi() * (3 - sqrt(5))) AS t FROM range(64)), D AS (SELECT i, p, x * sqrt(1 - dz * dz) * cos(t) + y * sqrt(1 - dz * dz) * sin(t) + z * dz AS dot FROM P, R), M AS (SELECT *, min(dot) OVER w AS lo, max(dot) OVER w AS hi FROM D WINDOW w AS (PARTITION BY i)) SELECT DISTINCT p FROM M WHERE dot = lo OR dot = hi",
    "voxel_morton": f"WITH {_S} SELECT i + 32 AS i, j + 32 AS j, k + 32 AS k, {_BITS('i', 0)} + {_BITS('j', 1)} + {_BITS('k', 2)} AS code FROM S",
    "voxel_surface": f"WITH {_S}{_D}{_near(3, 'S', 'A')}, {_inner(1, 7, 'A', 'B')} SELECT * FROM A EXCEPT SELECT * FROM B",
    "voxel_closing": f"WITH {_S}{_D}{_near(2, 'S', 'A')}, {_inner(2, 19, 'A', 'B')} SELECT * FROM B",
    "voxel_opening": f"WITH {_S}{_D}{_near(1, 'S', 'A')}, {_inner(1, 7, 'A', 'B')}, {_near(1, 'B', 'C')} SELECT * FROM C",
    "voxel_fill_orthographic": f"WITH {_S}, A AS ({_SPAN('i', 'j', 'k')}), B AS ({_SPAN('j', 'i', 'k')}), C AS ({_SPAN('k', 'i', 'j')}), R AS (SELECT unnest(range(lo, hi + 1)) AS i, j, k FROM A) SELECT R.i, R.j, R.k FROM R JOIN B ON B.i = R.i AND B.k = R.k AND R.j BETWEEN B.lo AND B.hi JOIN C ON C.i = R.i AND C.j = R.j AND R.k BETWEEN C.lo AND C.hi",
    "voxel_revoxelize": f"WITH {_S}, N AS (SELECT unnest(range(-40, 40)) AS n), M AS (SELECT n, CAST(floor((n + 0.5::DOUBLE) * 0.07::DOUBLE / {CELL}::DOUBLE) AS BIGINT) AS o FROM N) SELECT a.n AS i, b.n AS j, c.n AS k FROM S JOIN M a ON a.o = i JOIN M b ON b.o = j JOIN M c ON c.o = k",
    "voxel_corners": f"WITH {_S}, O AS (SELECT unnest([0, 1]) AS o) SELECT DISTINCT i + a.o AS i, j + b.o AS j, k + c.o AS k FROM S, O a, O b, O c",
    "voxel_occupancy": f"WITH {CLOUD}, C AS (SELECT p, floor(x / {CELL}) AS i, floor(y / {CELL}) AS j, floor(z / {CELL}) AS k FROM P) SELECT p, (i, j, k) IN (SELECT (i, j, k) FROM C WHERE p % 4 = 0) AS inside FROM C",
    "voxel_dense": f"WITH {_S} SELECT CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) * (max(k) - min(k) + 1) AS BIGINT) AS n, count(*) AS n_full FROM S",
    "lattice_splat": f"WITH {CLOUD}, A AS (SELECT p % 17 AS val, {_AX('x', 'i')}, {_AX('y', 'j')}, {_AX('z', 'k')} FROM P), N AS (SELECT unnest(range(5)) AS n), B AS (SELECT a.n AS i, b.n AS j, c.n AS k, val, (1 - abs(pi - a.n)) * (1 - abs(pj - b.n)) * (1 - abs(pk - c.n)) AS w FROM A JOIN N a ON abs(pi - a.n) < 1 JOIN N b ON abs(pj - b.n) < 1 JOIN N c ON abs(pk - c.n) < 1) SELECT i, j, k, round(sum(w * val) / greatest(sum(w), 0.0001), 5) + 0.0 AS val, round(sum(w), 5) + 0.0 AS density FROM B GROUP BY ALL",
    "voxel_boxes": f"WITH {_S}, O AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c)), X AS (SELECT i, j, k, a, b, c FROM S, O WHERE (i + a, j + b, k + c) NOT IN (SELECT (i, j, k) FROM S)), Z AS (SELECT unnest([0, 1]) AS o) SELECT (SELECT count(*) FROM (SELECT DISTINCT i + p.o, j + q.o, k + r.o FROM X, Z p, Z q, Z r WHERE (a = 0 OR p.o = (a > 0)::INT) AND (b = 0 OR q.o = (b > 0)::INT) AND (c = 0 OR r.o = (c > 0)::INT))) AS n_vertices, count(*) * 2 AS n_faces FROM X",
    "line_centroids": f"WITH {_SEG} SELECT line_id, round(sum((x + bx) / 2 * len) / sum(len), 3) + 0.0 AS x, round(sum((y + yb) / 2 * len) / sum(len), 3) + 0.0 AS y, 0.0::DOUBLE AS z FROM E GROUP BY line_id",
    "line_normals": f"WITH {_POLY}, C AS (SELECT line_id, x * coalesce(lead(y) OVER w, first(y) OVER w) - y * coalesce(lead(x) OVER w, first(x) OVER w) AS c FROM Q WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, sign(sum(c))::DOUBLE AS z FROM C GROUP BY line_id",
    "line_turning_angles": f"WITH {_POLY}, C AS (SELECT line_id, pos, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM Q WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, pos, round(coalesce(atan2(abs(ux * vy - uy * vx), ux * vx + uy * vy), 0), 5) + 0.0 AS angle FROM C",
    "line_upsample": f"WITH {_SEG}, N AS (SELECT *, CAST(greatest(floor(len / {STEP}), 1) AS BIGINT) AS n FROM E), K AS (SELECT *, unnest(range(n)) AS part FROM N) SELECT line_id, count(*) AS n, round(avg(y + (yb - y) * part / n), 5) AS y FROM K GROUP BY line_id",
    "line_resample": f"""WITH {_SEG}, A AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) AS hi FROM E), B AS (SELECT *, hi - len AS lo, max(hi) OVER (PARTITION BY line_id) AS total, row_number() OVER (PARTITION BY line_id ORDER BY pos DESC) = 1 AS fin FROM A),
        T AS (SELECT *, k * total / {COUNT - 1} AS t FROM B, (SELECT unnest(range({COUNT})) AS k)), U AS (SELECT *, row_number() OVER (PARTITION BY line_id, k ORDER BY pos DESC) AS r FROM T WHERE t >= lo - 1e-9)
        SELECT line_id, k, round(x + (bx - x) * least(1, (t - lo) / len), 2) + 0.0 AS x, round(y + (yb - y) * least(1, (t - lo) / len), 2) + 0.0 AS y, 0.0::DOUBLE AS z FROM U WHERE r = 1""",
    "line_radii": f"WITH {_SEG}, D AS (SELECT line_id, sqrt((y - 5 + least(greatest((5 - y) * (yb - y) / greatest((yb - y) ** 2, 1e-24), 0), 1) * (yb - y)) ** 2 + 1) AS d FROM E) SELECT line_id, round(min(d), 5) + 0.0 AS least, round(max(d), 5) + 0.0 AS greatest, round(avg(d), 5) + 0.0 AS mean, round(median(d), 5) + 0.0 AS middle FROM D GROUP BY line_id",
    "line_closed": f"WITH {_POLY} SELECT line_id, count(*) + (count(*) > 1)::INT AS n, count(*) > 1 AS closed FROM Q GROUP BY line_id",
}
QUERIES = {
    "cloud_plane_distances": plane, "cloud_moments": moments, "cloud_duplicates": duplicates, "cloud_radius_outliers": radius_outliers, "cloud_statistical_outliers": statistical_outliers,
    "sample_directions": directions, "cloud_radial_angles": radial, "cloud_convex_subset": hull_points, "voxel_morton": morton, "voxel_surface": surface, "voxel_closing": closing,
    "voxel_opening": opening, "voxel_fill_orthographic": orthographic, "voxel_revoxelize": revoxelized, "voxel_corners": voxel_corners, "voxel_occupancy": occupied, "voxel_dense": dense,
    "lattice_splat": splat, "voxel_boxes": boxes, "line_centroids": centroids, "line_normals": newell, "line_turning_angles": angles, "line_upsample": upsampled,
    "line_resample": resampled, "line_radii": radii, "line_closed": closed,
}
