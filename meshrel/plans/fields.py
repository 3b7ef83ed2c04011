"""Queries of fields, losses, transforms, boxes, cuts, sequences and points against meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affine, boxes, creation, cutting, geometry, proximity, topology
from ..operators import fields as D
from ..operators import selection as S
from ..operators import sequences as Q
from ..operators import spatial as P
from ..sources.derived import CORNERS_SQL, FIELD, height_field, table

R = 5
NORMAL, ORIGIN = (0.5, 0.25, 1.0), (3.0, 4.0, 11.0)
MATRIX = [[0.0, -2.0, 0.0, 1.0], [2.0, 0.0, 0.0, -3.0], [0.0, 0.0, 2.0, 0.5]]
SHEAR = [[1.0, 0.5, 0.0, 0.0], [0.0, 2.0, 0.25, 0.0], [0.0, 0.0, -1.0, 0.0]]
BOX = ((0.6, -0.8, 0.0), (0.8, 0.6, 0.0), (0.0, 0.0, 1.0))
LOW, HIGH = (2.0, 5.0, 9.0), (20.0, 31.0, 14.0)


def _r(df, *columns):
    return df.withColumns({c: F.round(c, R) + 0.0 for c in columns})


def _heights(v):
    return v.select("v", F.col("z").alias("val"))


def _thirds(f):
    return f.select(F.col("f").alias("row"), F.explode(F.array("i0", "i1", "i2")).alias("col")).withColumn("val", F.lit(1.0) / 3)


def on_faces(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(D.average_onto_faces(f, _heights(v)), "val")


def on_vertices(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    out = D.average_onto_vertices(v, f, f.select("f", (F.col("f") % 13).cast("double").alias("val")))
    return _r(out.withColumn("val", F.when(F.isnan("val"), -1.0).otherwise(F.col("val"))), "val")


def from_edges(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    values = topology.unique_edges(f).select("lo", "hi", ((F.col("lo") + F.col("hi")) % 7).cast("double").alias("val"))
    return _r(D.average_from_edges_onto_vertices(v, f, values), "val")


def barycentric(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    points = f.select(F.col("f").alias("p"), "f", ((F.col("f") % 4) / 8.0).alias("w0"), F.lit(0.25).alias("w1")).withColumn("w2", 0.75 - F.col("w0"))
    return _r(D.interpolate_barycentric(f, points, _heights(v)), "val")


def through_index(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    index = v.select(F.col("v").alias("row"), F.when(F.expr("v % 5 = 0"), -1).otherwise(F.col("v") - 1).alias("src"))
    ones = D.operator_from_index(index).groupBy("row").agg(F.sum("col").alias("src"))
    return _r(D.transfer_through_index(_heights(v), index), "val").join(ones, "row", "left")


def through_operator(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(D.transfer_through_operator(_heights(v), _thirds(f)), "val")


def composed(spark, sf_dir):
    _, f = height_field(spark, sf_dir)
    groups = f.select((F.col("f") % 50).alias("row"), F.col("f").alias("col"), F.lit(1.0).alias("val"))
    return _r(D.compose_operators(_thirds(f), groups), "val")


def representatives(spark, sf_dir):
    _, f = height_field(spark, sf_dir)
    return D.operator_representatives(f.select((F.col("f") % 50).alias("row"), F.col("f").alias("col"), (F.col("f") % 11).cast("double").alias("val")))


def gradients(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(D.face_gradients(v, f, v.select("v", (F.col("v") % 10).cast("double").alias("val"))), *"xyz")


def side_lengths(spark, sf_dir):
    return _r(D.face_edge_lengths(*height_field(spark, sf_dir)), "l0", "l1", "l2")


def cot_entries(spark, sf_dir):
    return _r(D.cotangent_entries(*height_field(spark, sf_dir)), "c0", "c1", "c2")


def cot_intrinsic(spark, sf_dir):
    return _r(D.cotangent_entries_intrinsic(D.face_edge_lengths(*height_field(spark, sf_dir))), "c0", "c1", "c2")


def masses(spark, sf_dir):
    return _r(D.mass_entries(*height_field(spark, sf_dir)), "mass")


def losses(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    parts = [d.withColumnRenamed("loss", n) for n, d in (("edges", D.edge_length_loss(v, f, 1.0)), ("normals", D.normal_consistency_loss(v, f)), ("laplacian", D.laplacian_smoothing_loss(v, f)))]
    return _r(parts[0].crossJoin(parts[1]).crossJoin(parts[2]), "edges", "normals", "laplacian")


def area_form(spark, sf_dir):
    """The form applied to the layout (x, y): the signed area inside the boundary."""
    v, f = height_field(spark, sf_dir)
    n = v.agg(F.max("v") + 1).first()[0]
    flat = v.select("v", F.col("x").alias("u")).unionByName(v.select((F.col("v") + n).alias("v"), F.col("y").alias("u")))
    m = D.vector_area_entries(f, n).join(flat.select(F.col("v").alias("row"), F.col("u").alias("a")), "row").join(flat.select(F.col("v").alias("col"), F.col("u").alias("b")), "col")
    return m.agg(F.round(F.sum(F.col("a") * F.col("val") * F.col("b")), 4).alias("area"))


def mean_normals(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(D.mean_vertex_normals(v, f, geometry.face_normals(v, f)), *"xyz")


def corner_normals(spark, sf_dir):
    return _r(D.corner_normals(*height_field(spark, sf_dir)), *"xyz").withColumn("k", F.col("k").cast("long"))


def ball_curvature(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(D.curvature_in_balls(v.withColumnRenamed("v", "q"), v, geometry.angle_defects(v, f), 1.5), "curvature")


def moved_points(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    return _r(affine.transform_points(v, MATRIX), *"xyz")


def moved_vectors(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    return _r(affine.transform_vectors(v, SHEAR), *"xyz")


def moved_normals(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(affine.transform_normals(geometry.face_normals(v, f), SHEAR), *"xyz")


def moved_mesh(spark, sf_dir):
    v, f = affine.transform_mesh(*height_field(spark, sf_dir), affine.scale_matrix((1.0, 1.0, -2.0)))
    return geometry.measures(v, f).select(F.round("volume", 3).alias("volume")).crossJoin(f.agg(F.sum(F.col("i1") - F.col("i2")).alias("turn")))


def matrix_facts(spark, sf_dir):
    mirror = affine.reflection_matrix((0.0, 3.0, 0.0), (1.0, 2.0, 3.0))
    moved = affine.translation_matrix((1.0, 2.0, 3.0)) @ mirror
    rows = [(n, affine.classify_transform(m), round(affine.transform_scale(m), 6), affine.reverses_orientation(m)) for n, m in (("mirror", mirror), ("moved", moved), ("similar", MATRIX), ("shear", SHEAR), ("scaled", affine.scale_matrix(3.0)))]
    return spark.createDataFrame(rows, "name string, kind string, scale double, reverses boolean")


def box_facts(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    moved = affine.transform_points(v, MATRIX)
    both = boxes.aabb_union(geometry.aabb(v), geometry.aabb(moved))
    return _r(both.crossJoin(boxes.enclosing_diagonal(v, moved)), *both.columns, "diagonal")


def oriented_box(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    return boxes.points_in_obb_mask(v, BOX, LOW, HIGH).select("v", "inside")


def cropped(spark, sf_dir):
    v, f = boxes.crop_mesh(*height_field(spark, sf_dir), LOW, HIGH)
    return f.select("f", "i0", "i1", "i2").crossJoin(v.agg(F.count("*").alias("n_vertices")))


def edge_cuts(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    end = lambda c, n: v.select(F.col("v").alias(c), *[F.col(x).alias(n + x) for x in "xyz"])
    e = topology.unique_edges(f).join(end("lo", "a"), "lo").join(end("hi", "b"), "hi")
    cut = cutting.segments_with_plane(e.withColumn("s", F.struct("lo", "hi")), NORMAL, ORIGIN)
    return _r(cut.where("valid").select("s.lo", "s.hi", *"xyz"), *"xyz")


def plane_segments(spark, sf_dir):
    s = cutting.mesh_with_plane(*height_field(spark, sf_dir), NORMAL, ORIGIN)
    length = F.sqrt(sum(((F.col("a" + x) - F.col("b" + x)) ** 2 for x in "yz"), (F.col("ax") - F.col("bx")) ** 2))
    return _r(s.select("f", length.alias("length")), "length")


def level_segments(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    s = cutting.level_segments(v, f, _heights(v), 9.4996)
    return _r(s.select("f", F.least("ax", "bx").alias("low"), F.greatest("ax", "bx").alias("high")), "low", "high")


def split_areas(spark, sf_dir):
    t = cutting.triangle_areas(cutting.split_with_plane(*height_field(spark, sf_dir), NORMAL, ORIGIN))
    return t.groupBy("f").agg(F.round(F.sum("area"), R).alias("area"))


def sliced_area(spark, sf_dir):
    """Each face's part above the plane, by its share of the whole face."""
    t = cutting.triangle_areas(cutting.slice_with_plane(*height_field(spark, sf_dir), NORMAL, ORIGIN))
    return t.groupBy("f").agg(F.round(F.sum("area"), R).alias("area"))


def field_split(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    t = cutting.triangle_areas(cutting.split_faces_along_field(v, f, _heights(v), 9.4996))
    return t.groupBy("f").agg(F.round(F.sum("area"), R).alias("area"))


def ranges(spark, sf_dir):
    a, b = Q.arange(spark, 100, 10, 7), Q.arange_repeat(spark, 20, 3)
    joined = Q.concatenate([a, b])
    pieces = Q.split(joined, [5, 40])
    return pieces.select(F.col("piece").cast("long").alias("piece"), F.col("pos").cast("long").alias("pos"), F.col("val").cast("long").alias("val"))


def packed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    arrays = [o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("val")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").cast("long").alias("val"))]
    return Q.pack_arrays(arrays)


def key_counts(spark, sf_dir):
    """How many different rows occur how often, by their keys."""
    counts = Q.hashed_occurrence_counts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])
    return counts.groupBy("n").agg(F.count("*").alias("keys"))


def sorted_rows(spark, sf_dir):
    return Q.sort_rows(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("line")), ["l_partkey", "l_suppkey", "l_orderkey", "line"])


def edge_keys(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return Q.undirected_edge_keys(topology.halfedges(f).select(F.col("org").alias("a"), F.col("dst").alias("b")), v.agg(F.max("v") + 1).first()[0])


def edge_inverse(spark, sf_dir):
    return Q.edges_unique_inverse(height_field(spark, sf_dir)[1]).withColumn("k", F.col("k").cast("long"))


def bit_ranks(spark, sf_dir):
    return Q.bit_ranks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("word")))


def block_diagonal(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem")
    a = p.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.count("*").alias("val"))
    b = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).first()[0], table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    return Q.block_diagonal([(a, n[0], n[1]), (b, n[1], n[0])])


def same_faces(spark, sf_dir):
    _, f = height_field(spark, sf_dir)
    turned = f.select("f", F.col("i1").alias("i0"), F.col("i2").alias("i1"), F.col("i0").alias("i2"))
    flipped = f.select("f", "i0", F.col("i2").alias("i1"), F.col("i1").alias("i2"))
    return Q.faces_equal(f, turned).withColumnRenamed("equal", "turned").crossJoin(Q.faces_equal(f, flipped).withColumnRenamed("equal", "flipped"))


def same_points(spark, sf_dir):
    v = height_field(spark, sf_dir)[0].withColumnRenamed("v", "p")
    moved, far = v.withColumn("x", F.col("x") + 1e-4), v.withColumn("x", F.col("x") + F.when(F.col("p") == 7, 0.5).otherwise(0.0))
    return Q.points_allclose(v, moved, 1e-3).withColumnRenamed("close", "near").crossJoin(Q.points_allclose(v, far, 1e-3).withColumnRenamed("close", "far"))


def sub_of_vertices(spark, sf_dir):
    v, f = S.submesh_of_vertices(*height_field(spark, sf_dir), height_field(spark, sf_dir)[0].where("x + y < 60"))
    return f.select("f", "source").crossJoin(v.agg(F.count("*").alias("n_vertices")))


def sub_groups(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    gv, gf = S.submeshes(v, f, f.select((F.col("f") % 7).alias("g"), "f"))
    return gv.groupBy("g").agg(F.count("*").alias("n_vertices")).join(gf.groupBy("g").agg(F.count("*").alias("n_faces")), "g")


def sub_components(spark, sf_dir):
    """The field cut along every seventh column."""
    v, f = height_field(spark, sf_dir)
    at = v.select(F.col("v").alias("i0"), F.col("x").cast("long").alias("x"))
    gv, gf = S.split_components(v, f.join(at, "i0").where("x % 7 <> 3").select("f", "i0", "i1", "i2"))
    return gv.groupBy("g").agg(F.count("*").alias("n_vertices")).join(gf.groupBy("g").agg(F.count("*").alias("n_faces")), "g")


def _cloud(v):
    return v.select(F.col("v").alias("p"), *"xyz")


def ball_sums(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    points = _cloud(v).withColumn("val", (F.col("p") % 5).cast("double"))
    return _r(P.ball_sum(_over(v), points, 1.3, "val"), "total")


def mutual(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    return _r(P.mutual_nearest(_cloud(v), _over(v).withColumnRenamed("q", "p"), 1.0), "d")


def closest_pair(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    return _r(P.closest_pair(_cloud(v), P.initial_radius(_cloud(v), 2)), "d")


def point_cells(spark, sf_dir):
    v, _ = height_field(spark, sf_dir)
    cells = P.cell_indices(v, 0.7, (0.1, 0.2, 0.3)).select("v", *"ijk")
    grid = cells.where("i + j < 30")
    return P.occupancy_at_cells(grid, cells).select("v", *"ijk", "occupied")


def surface_points(spark, sf_dir):
    return _r(P.sample_surface(*height_field(spark, sf_dir), 5000), *"xyz")


def _over(v):
    return v.select(F.col("v").alias("q"), (F.col("x") + 0.37).alias("x"), (F.col("y") + 0.41).alias("y"), (F.col("z") + F.col("v") % 3 - 1).alias("z"))


def nearest_on_mesh(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(proximity.closest_point_on_mesh(_over(v), v, f, 1.0).select("q", "d"), "d")


def mesh_distance(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(proximity.distance_to_mesh(_over(v), v, f, 1.0), "chamfer", "chamfer_squared", "hausdorff")


def column_hits(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return _r(proximity.column_hits(_over(v), v, f, 1.0), "height")


def contained(spark, sf_dir):
    """Points on a lattice against a torus, whose inside is known."""
    v, f = creation.torus(spark, 2.0, 0.5)
    at = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), ((F.col("p_partkey") * 37 % 61) / 10.0 - 3).alias("x"), ((F.col("p_partkey") * 53 % 67) / 11.0 - 3).alias("y"), ((F.col("p_partkey") * 11 % 13) / 10.0 - 0.6).alias("z"))
    # Within the flat sides' error of the surface either answer is right.
    clear = F.abs((F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 2) ** 2 + F.col("z") ** 2 - 0.25) > 0.06
    return proximity.contains_points(at.where(clear), v, f, 0.5)


HEIGHT = lambda p: f"(0.5 * ({p}x - 3.0) + 0.25 * ({p}y - 4.0) + ({p}z - 11.0))"
FC = FIELD + CORNERS_SQL
LEN = lambda p, q: f"sqrt(({p}_x - {q}_x) ** 2 + ({p}_y - {q}_y) ** 2 + ({p}_z - {q}_z) ** 2)"
COT = lambda p, q, r: f"(({q}_x - {p}_x) * ({r}_x - {p}_x) + ({q}_y - {p}_y) * ({r}_y - {p}_y) + ({q}_z - {p}_z) * ({r}_z - {p}_z)) / sqrt(nx ** 2 + ny ** 2 + nz ** 2) / 2"
AREAS = ", A AS (SELECT *, sqrt(nx ** 2 + ny ** 2 + nz ** 2) / 2 AS area FROM N)"
E_SQL = ", E AS (SELECT lo, hi, count(*) AS n, min(f) AS f, max(f) AS g FROM H GROUP BY lo, hi)"
OVER = ", O AS (SELECT v AS q, x + 0.37 AS x, y + 0.41 AS y, z + v % 3 - 1 AS z FROM V)"
#: Each face's crossing points by side: da, db, dc are the corners' heights.
CROSS = lambda d: f""", K AS (SELECT *, {d('a_')} AS da, {d('b_')} AS db, {d('c_')} AS dc FROM C),
  S AS (SELECT f, a_x + da / (da - db) * (b_x - a_x) AS x, a_y + da / (da - db) * (b_y - a_y) AS y, a_z + da / (da - db) * (b_z - a_z) AS z FROM K WHERE (da >= 0) <> (db >= 0)
        UNION ALL SELECT f, b_x + db / (db - dc) * (c_x - b_x), b_y + db / (db - dc) * (c_y - b_y), b_z + db / (db - dc) * (c_z - b_z) FROM K WHERE (db >= 0) <> (dc >= 0)
        UNION ALL SELECT f, c_x + dc / (dc - da) * (a_x - c_x), c_y + dc / (dc - da) * (a_y - c_y), c_z + dc / (dc - da) * (a_z - c_z) FROM K WHERE (dc >= 0) <> (da >= 0))"""  # noqa: E731
#: The part of a face above the level: with one corner above, the product of the two cut shares; with two, the rest.
ABOVE = """CASE WHEN da >= 0 AND db >= 0 AND dc >= 0 THEN 1.0
  WHEN da >= 0 AND db < 0 AND dc < 0 THEN da / (da - db) * da / (da - dc) WHEN db >= 0 AND da < 0 AND dc < 0 THEN db / (db - da) * db / (db - dc) WHEN dc >= 0 AND da < 0 AND db < 0 THEN dc / (dc - da) * dc / (dc - db)
  WHEN da < 0 AND db >= 0 AND dc >= 0 THEN 1 - da / (da - db) * da / (da - dc) WHEN db < 0 AND da >= 0 AND dc >= 0 THEN 1 - db / (db - da) * db / (db - dc) WHEN dc < 0 AND da >= 0 AND db >= 0 THEN 1 - dc / (dc - da) * dc / (dc - db) ELSE 0.0 END"""
PLANE = CROSS(HEIGHT)
PAIR = "round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 5) + 0.0"
SQL = {
    "field_on_faces": FC + " SELECT f, round((a_z + b_z + c_z) / 3, 5) + 0.0 AS val FROM C",
    "field_on_vertices": FIELD + " SELECT v, round(coalesce(avg((f % 13)::DOUBLE), -1.0), 5) + 0.0 AS val FROM V LEFT JOIN H ON org = v GROUP BY v",
    "field_from_edges": FIELD + ", P AS (SELECT lo, hi, ((lo + hi) % 7)::DOUBLE AS val FROM H WHERE org = lo), B AS (SELECT lo AS v, val FROM P UNION ALL SELECT hi, val FROM P) SELECT V.v, round(coalesce(avg(val), 0.0), 5) + 0.0 AS val FROM V LEFT JOIN B ON B.v = V.v GROUP BY V.v",
    "field_barycentric": FC + " SELECT f AS p, round(f % 4 / 8.0::DOUBLE * a_z + 0.25 * b_z + (0.75 - f % 4 / 8.0::DOUBLE) * c_z, 5) + 0.0 AS val FROM C",
    "field_through_index": FIELD + " SELECT p.v AS row, round(coalesce(q.z, 0.0), 5) + 0.0 AS val, CASE WHEN p.v % 5 <> 0 THEN p.v - 1 END AS src FROM V p LEFT JOIN V q ON q.v = p.v - 1 AND p.v % 5 <> 0",
    "field_through_operator": FC + " SELECT f AS row, round((a_z + b_z + c_z) / 3, 5) + 0.0 AS val FROM C",
    "field_composed": FIELD + " SELECT f % 50 AS row, org AS col, round(count(*) / 3.0::DOUBLE, 5) + 0.0 AS val FROM H GROUP BY 1, 2",
    "field_representatives": FIELD + " SELECT row, f AS col FROM (SELECT f % 50 AS row, f, row_number() OVER (PARTITION BY f % 50 ORDER BY f % 11 DESC, f) AS r FROM F) WHERE r = 1",
    "field_gradients": FC + """, U AS (SELECT *, i0 % 10 AS u0, i1 % 10 AS u1, i2 % 10 AS u2, nx ** 2 + ny ** 2 + nz ** 2 AS s FROM N),
        W AS (SELECT *, u0 * (c_x - b_x) + u1 * (a_x - c_x) + u2 * (b_x - a_x) AS ex, u0 * (c_y - b_y) + u1 * (a_y - c_y) + u2 * (b_y - a_y) AS ey, u0 * (c_z - b_z) + u1 * (a_z - c_z) + u2 * (b_z - a_z) AS ez FROM U)
        SELECT f, round((ny * ez - nz * ey) / s, 5) + 0.0 AS x, round((nz * ex - nx * ez) / s, 5) + 0.0 AS y, round((nx * ey - ny * ex) / s, 5) + 0.0 AS z FROM W""",
    "mesh_side_lengths": FC + f" SELECT f, round({LEN('b', 'c')}, 5) + 0.0 AS l0, round({LEN('c', 'a')}, 5) + 0.0 AS l1, round({LEN('a', 'b')}, 5) + 0.0 AS l2 FROM C",
    "mesh_cot_entries": FC + f" SELECT f, round({COT('a', 'b', 'c')}, 5) + 0.0 AS c0, round({COT('b', 'c', 'a')}, 5) + 0.0 AS c1, round({COT('c', 'a', 'b')}, 5) + 0.0 AS c2 FROM N",
    "mesh_mass_entries": FC + AREAS + " SELECT org AS v, round(sum(area / 3), 5) + 0.0 AS mass FROM H JOIN A ON A.f = H.f GROUP BY org",
    "mesh_losses": FC + AREAS + E_SQL + """, L AS (SELECT avg((sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) - 1) ** 2) AS edges FROM E JOIN V p ON p.v = lo JOIN V q ON q.v = hi),
        NN AS (SELECT avg(1 - (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / (4 * a.area * b.area)) AS normals FROM E JOIN A a ON a.f = E.f JOIN A b ON b.f = E.g WHERE n = 2),
        W AS (SELECT lo AS v, hi AS w FROM E UNION ALL SELECT hi, lo FROM E), M AS (SELECT W.v AS v, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM W JOIN V ON V.v = W.w GROUP BY W.v),
        LL AS (SELECT avg(coalesce(sqrt((mx - x) ** 2 + (my - y) ** 2 + (mz - z) ** 2), 0.0)) AS laplacian FROM V LEFT JOIN M ON M.v = V.v)
        SELECT round(edges, 5) + 0.0 AS edges, round(normals, 5) + 0.0 AS normals, round(laplacian, 5) + 0.0 AS laplacian FROM L, NN, LL""",
    "mesh_area_form": FIELD + ", B AS (SELECT lo, hi FROM H GROUP BY lo, hi HAVING count(*) = 1) SELECT round(sum(p.x * q.y - p.y * q.x) / 2, 4) AS area FROM H JOIN B ON B.lo = H.lo AND B.hi = H.hi JOIN V p ON p.v = org JOIN V q ON q.v = dst",
    "mesh_mean_normals": FC + AREAS + """, S AS (SELECT org AS v, sum(nx / (2 * area)) AS x, sum(ny / (2 * area)) AS y, sum(nz / (2 * area)) AS z FROM H JOIN A ON A.f = H.f GROUP BY org)
        SELECT V.v, round(coalesce(S.x / sqrt(S.x ** 2 + S.y ** 2 + S.z ** 2), 0.0), 5) + 0.0 AS x, round(coalesce(S.y / sqrt(S.x ** 2 + S.y ** 2 + S.z ** 2), 0.0), 5) + 0.0 AS y, round(coalesce(S.z / sqrt(S.x ** 2 + S.y ** 2 + S.z ** 2), 0.0), 5) + 0.0 AS z FROM V LEFT JOIN S ON S.v = V.v""",
    "mesh_corner_normals": FC + """, S AS (SELECT org AS v, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM H JOIN N ON N.f = H.f GROUP BY org), U AS (SELECT v, x / sqrt(x ** 2 + y ** 2 + z ** 2) AS x, y / sqrt(x ** 2 + y ** 2 + z ** 2) AS y, z / sqrt(x ** 2 + y ** 2 + z ** 2) AS z FROM S)
        SELECT f, k::BIGINT AS k, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM H JOIN U ON v = org""",
    "mesh_ball_curvature": FC + """, G AS (SELECT f, i0 AS v, acos(((b_x - a_x) * (c_x - a_x) + (b_y - a_y) * (c_y - a_y) + (b_z - a_z) * (c_z - a_z)) / sqrt(((b_x - a_x) ** 2 + (b_y - a_y) ** 2 + (b_z - a_z) ** 2) * ((c_x - a_x) ** 2 + (c_y - a_y) ** 2 + (c_z - a_z) ** 2))) AS t FROM C
          UNION ALL SELECT f, i1, acos(((c_x - b_x) * (a_x - b_x) + (c_y - b_y) * (a_y - b_y) + (c_z - b_z) * (a_z - b_z)) / sqrt(((c_x - b_x) ** 2 + (c_y - b_y) ** 2 + (c_z - b_z) ** 2) * ((a_x - b_x) ** 2 + (a_y - b_y) ** 2 + (a_z - b_z) ** 2))) FROM C
          UNION ALL SELECT f, i2, acos(((a_x - c_x) * (b_x - c_x) + (a_y - c_y) * (b_y - c_y) + (a_z - c_z) * (b_z - c_z)) / sqrt(((a_x - c_x) ** 2 + (a_y - c_y) ** 2 + (a_z - c_z) ** 2) * ((b_x - c_x) ** 2 + (b_y - c_y) ** 2 + (b_z - c_z) ** 2))) FROM C),
        B AS (SELECT lo, hi FROM H GROUP BY lo, hi HAVING count(*) = 1), RIM AS (SELECT lo AS v FROM B UNION SELECT hi FROM B),
        DF AS (SELECT G.v AS v, CASE WHEN max(RIM.v) IS NULL THEN 2 * pi() ELSE pi() END - sum(t) AS defect FROM G LEFT JOIN RIM ON RIM.v = G.v GROUP BY G.v),
        DV AS (SELECT x, y, z, defect FROM DF JOIN V ON V.v = DF.v)
        SELECT V.v AS q, round(coalesce(sum(defect), 0.0), 5) + 0.0 AS curvature FROM V LEFT JOIN DV d ON (V.x - d.x) ** 2 + (V.y - d.y) ** 2 + (V.z - d.z) ** 2 <= 2.25 GROUP BY V.v""",
    "affine_points": FIELD + " SELECT v, round(-2 * y + 1, 5) + 0.0 AS x, round(2 * x - 3, 5) + 0.0 AS y, round(2 * z + 0.5, 5) + 0.0 AS z FROM V",
    "affine_vectors": FIELD + " SELECT v, round(x + 0.5 * y, 5) + 0.0 AS x, round(2 * y + 0.25 * z, 5) + 0.0 AS y, round(-z, 5) + 0.0 AS z FROM V",
    "affine_normals": FC + """, T AS (SELECT f, nx AS x, -0.25 * nx + 0.5 * ny AS y, -0.0625 * nx + 0.125 * ny - nz AS z FROM N)
        SELECT f, round(x / sqrt(x ** 2 + y ** 2 + z ** 2), 5) + 0.0 AS x, round(y / sqrt(x ** 2 + y ** 2 + z ** 2), 5) + 0.0 AS y, round(z / sqrt(x ** 2 + y ** 2 + z ** 2), 5) + 0.0 AS z FROM T""",
    "affine_mesh": FC + " SELECT round(2 * sum(a_x * (b_y * c_z - b_z * c_y) + a_y * (b_z * c_x - b_x * c_z) + a_z * (b_x * c_y - b_y * c_x)) / 6, 3) AS volume, sum(i2 - i1)::BIGINT AS turn FROM C",
    "affine_facts": "SELECT * FROM (VALUES ('mirror', 'reflection', 1.0::DOUBLE, true), ('moved', 'reflection', 1.0, true), ('similar', 'similarity', 2.0, false), ('shear', 'affine', round(pow(2.0, 1.0 / 3), 6), true), ('scaled', 'similarity', 3.0, false)) t(name, kind, scale, reverses)",
    "box_facts": FIELD + ", P AS (SELECT x, y, z FROM V UNION ALL SELECT -2 * y + 1, 2 * x - 3, 2 * z + 0.5 FROM V) SELECT " + ", ".join(f"round({f}({x}), 5) + 0.0 AS {f}_{x}" for f in ("min", "max") for x in "xyz") + ", round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 5) + 0.0 AS diagonal FROM P",
    "box_oriented": FIELD + " SELECT v, (0.6::DOUBLE * x - 0.8::DOUBLE * y BETWEEN 2 AND 20) AND (0.8::DOUBLE * x + 0.6::DOUBLE * y BETWEEN 5 AND 31) AND z BETWEEN 9 AND 14 AS inside FROM V",
    "box_crop": FIELD + ", I AS (SELECT v FROM V WHERE x BETWEEN 2 AND 20 AND y BETWEEN 5 AND 31 AND z BETWEEN 9 AND 14), P AS (SELECT f, i0, i1, i2 FROM F WHERE i0 IN (FROM I) AND i1 IN (FROM I) AND i2 IN (FROM I)), U AS (SELECT i0 AS v FROM P UNION SELECT i1 FROM P UNION SELECT i2 FROM P) SELECT P.*, (SELECT count(*) FROM U) AS n_vertices FROM P",
    "cut_edges": FIELD + f""", E AS (SELECT DISTINCT lo, hi FROM H), K AS (SELECT lo, hi, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, {HEIGHT('p.')} AS da, {HEIGHT('q.')} AS db FROM E JOIN V p ON p.v = lo JOIN V q ON q.v = hi)
        SELECT lo, hi, round(ax + da / (da - db) * (bx - ax), 5) + 0.0 AS x, round(ay + da / (da - db) * (by_ - ay), 5) + 0.0 AS y, round(az + da / (da - db) * (bz - az), 5) + 0.0 AS z FROM K WHERE da <> db AND da / (da - db) BETWEEN 0 AND 1""",
    "cut_plane": FC + PLANE + f" SELECT f, {PAIR} AS length FROM S GROUP BY f",
    "cut_level": FC + CROSS(lambda p: f"({p}z - 9.4996)") + " SELECT f, round(min(x), 5) + 0.0 AS low, round(max(x), 5) + 0.0 AS high FROM S GROUP BY f",
    "cut_split": FC + AREAS + " SELECT f, round(area, 5) AS area FROM A",
    "cut_slice": FC + PLANE + AREAS + f" SELECT A.f, round(area * {ABOVE}, 5) AS area FROM A JOIN K ON K.f = A.f WHERE da >= 0 OR db >= 0 OR dc >= 0",
    "cut_along_field": FC + AREAS + " SELECT f, round(area, 5) AS area FROM A",
    "seq_ranges": "WITH J AS (SELECT range AS pos, range * 7 + 10 AS val FROM range(13) UNION ALL SELECT range + 13, range // 3 FROM range(60)) SELECT ((pos >= 5)::INT + (pos >= 40)::INT)::BIGINT AS piece, (pos - CASE WHEN pos >= 40 THEN 40 WHEN pos >= 5 THEN 5 ELSE 0 END)::BIGINT AS pos, val::BIGINT AS val FROM J",
    "seq_packed": "SELECT 0::BIGINT AS array, o_orderkey AS pos, o_custkey AS val FROM orders UNION ALL SELECT 1, c_custkey, c_nationkey FROM customer",
    "seq_key_counts": "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY n",
    "seq_sorted_rows": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber::BIGINT AS line FROM lineitem ORDER BY ALL",
    "seq_edge_keys": FIELD + " SELECT DISTINCT lo + hi * (SELECT max(v) + 1 FROM V) AS key FROM H",
    "seq_edge_inverse": FIELD + " SELECT f, k::BIGINT AS k, min(h) OVER (PARTITION BY lo, hi) AS edge FROM H",
    "seq_bit_ranks": "SELECT o_orderkey AS pos, (sum(bit_count(o_custkey)) OVER (ORDER BY o_orderkey))::BIGINT AS rank FROM orders",
    "seq_block_diagonal": "WITH A AS (SELECT l_suppkey AS row, l_partkey AS col, count(*) AS val FROM lineitem GROUP BY 1, 2), S AS (SELECT (SELECT max(s_suppkey) + 1 FROM supplier) AS s, (SELECT max(p_partkey) + 1 FROM part) AS p) SELECT row, col, val FROM A UNION ALL SELECT col + s, row + p, val FROM A, S",
    "same_faces": "SELECT true AS turned, false AS flipped",
    "same_points": "SELECT true AS near, false AS far",
    "near_column_hits": FC + OVER + """ SELECT q, f, round(a_z - (nx * (x - a_x) + ny * (y - a_y)) / nz - z, 5) + 0.0 AS height FROM O JOIN N ON x BETWEEN least(a_x, b_x, c_x) AND greatest(a_x, b_x, c_x) AND y BETWEEN least(a_y, b_y, c_y) AND greatest(a_y, b_y, c_y)
        WHERE (b_x - a_x) * (y - a_y) - (b_y - a_y) * (x - a_x) > 0 AND (c_x - b_x) * (y - b_y) - (c_y - b_y) * (x - b_x) > 0 AND (a_x - c_x) * (y - c_y) - (a_y - c_y) * (x - c_x) > 0""",
    "sub_of_vertices": FIELD + """, I AS (SELECT v FROM V WHERE x + y < 60), K AS (SELECT f, i0, i1, i2 FROM F WHERE i0 IN (FROM I) AND i1 IN (FROM I) AND i2 IN (FROM I)), U AS (SELECT i0 AS v FROM K UNION SELECT i1 FROM K UNION SELECT i2 FROM K)
        SELECT row_number() OVER (ORDER BY f) - 1 AS f, f AS source, (SELECT count(*) FROM U) AS n_vertices FROM K""",
    "sub_groups": FIELD + " SELECT f % 7 AS g, count(DISTINCT org) AS n_vertices, count(DISTINCT f) AS n_faces FROM H GROUP BY 1",
    "sub_components": FIELD + ", K AS (SELECT f, CAST(x AS BIGINT) AS x FROM F JOIN V ON v = i0 WHERE CAST(x AS BIGINT) % 7 <> 3) SELECT min(f) AS g, count(DISTINCT org) AS n_vertices, count(DISTINCT f) AS n_faces FROM K JOIN H USING (f) GROUP BY (x + 3) // 7",
    "near_ball_sums": FIELD + OVER + " SELECT O.q, count(V.v) AS n, round(coalesce(sum((V.v % 5)::DOUBLE), 0.0), 5) + 0.0 AS total FROM O LEFT JOIN V ON (O.x - V.x) ** 2 + (O.y - V.y) ** 2 + (O.z - V.z) ** 2 <= 1.69 GROUP BY O.q",
    "near_mutual": FIELD + OVER + """, D AS (SELECT v AS p, q, sqrt((O.x - V.x) ** 2 + (O.y - V.y) ** 2 + (O.z - V.z) ** 2) AS d FROM V, O),
        A AS (SELECT p, q, d, row_number() OVER (PARTITION BY p ORDER BY d, q) AS r, row_number() OVER (PARTITION BY q ORDER BY d, p) AS s FROM D) SELECT p, q, round(d, 5) + 0.0 AS d FROM A WHERE r = 1 AND s = 1""",
    "near_closest_pair": FIELD + " SELECT a.v AS p, b.v AS q, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 5) + 0.0 AS d FROM V a JOIN V b ON a.v < b.v ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), a.v, b.v LIMIT 1",
    "near_cells": FIELD + ", K AS (SELECT v, floor((x - 0.1::DOUBLE) / 0.7::DOUBLE)::BIGINT AS i, floor((y - 0.2::DOUBLE) / 0.7::DOUBLE)::BIGINT AS j, floor((z - 0.3::DOUBLE) / 0.7::DOUBLE)::BIGINT AS k FROM V) SELECT v, i, j, k, i + j < 30 AS occupied FROM K",
    "near_surface_points": FC + AREAS + """, W AS (SELECT *, sum(area) OVER () AS whole FROM A), U AS (SELECT *, CAST(floor(area / whole * 5000 + ('0x' || substr(md5('1:' || f || ':n'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS BIGINT) AS n FROM W),
        K AS (SELECT *, unnest(range(n)) AS k FROM U WHERE n > 0), T AS (SELECT *, sqrt(('0x' || substr(md5('1:' || f || ':' || k || ':r'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS r, ('0x' || substr(md5('1:' || f || ':' || k || ':t'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS t FROM K)
        SELECT f, k, round((1 - r) * a_x + r * (1 - t) * b_x + r * t * c_x, 5) + 0.0 AS x, round((1 - r) * a_y + r * (1 - t) * b_y + r * t * c_y, 5) + 0.0 AS y, round((1 - r) * a_z + r * (1 - t) * b_z + r * t * c_z, 5) + 0.0 AS z FROM T""",
    "near_contained": """WITH P AS (SELECT p_partkey AS q, p_partkey * 37 % 61 / 10.0::DOUBLE - 3 AS x, p_partkey * 53 % 67 / 11.0::DOUBLE - 3 AS y, p_partkey * 11 % 13 / 10.0::DOUBLE - 0.6::DOUBLE AS z FROM part), D AS (SELECT q, (sqrt(x ** 2 + y ** 2) - 2) ** 2 + z ** 2 - 0.25 AS d FROM P) SELECT q, d < 0 AS inside FROM D WHERE abs(d) > 0.06""",
}
SQL["mesh_cot_intrinsic"] = SQL["mesh_cot_entries"]
QUERIES = {
    "field_on_faces": on_faces, "field_on_vertices": on_vertices, "field_from_edges": from_edges, "field_barycentric": barycentric, "field_through_index": through_index, "field_through_operator": through_operator,
    "field_composed": composed, "field_representatives": representatives, "field_gradients": gradients, "mesh_side_lengths": side_lengths, "mesh_cot_entries": cot_entries, "mesh_cot_intrinsic": cot_intrinsic,
    "mesh_mass_entries": masses, "mesh_losses": losses, "mesh_area_form": area_form, "mesh_mean_normals": mean_normals, "mesh_corner_normals": corner_normals, "mesh_ball_curvature": ball_curvature,
    "affine_points": moved_points, "affine_vectors": moved_vectors, "affine_normals": moved_normals, "affine_mesh": moved_mesh, "affine_facts": matrix_facts, "box_facts": box_facts, "box_oriented": oriented_box, "box_crop": cropped,
    "cut_edges": edge_cuts, "cut_plane": plane_segments, "cut_level": level_segments, "cut_split": split_areas, "cut_slice": sliced_area, "cut_along_field": field_split,
    "seq_ranges": ranges, "seq_packed": packed, "seq_key_counts": key_counts, "seq_sorted_rows": sorted_rows, "seq_edge_keys": edge_keys, "seq_edge_inverse": edge_inverse, "seq_bit_ranks": bit_ranks, "seq_block_diagonal": block_diagonal,
    "same_faces": same_faces, "same_points": same_points, "near_on_mesh": nearest_on_mesh, "near_distance": mesh_distance, "near_column_hits": column_hits, "near_contained": contained, "sub_of_vertices": sub_of_vertices, "sub_groups": sub_groups, "sub_components": sub_components, "near_ball_sums": ball_sums, "near_mutual": mutual, "near_closest_pair": closest_pair, "near_cells": point_cells, "near_surface_points": surface_points,
}
