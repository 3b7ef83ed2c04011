"""Points against meshes by brute force, cuts of degenerate cases, transforms of small meshes, empty tables."""

import math
import random

import pytest

from meshrel.operators import affine, boxes, creation, cutting, geometry, proximity
from meshrel.operators import fields as D
from meshrel.operators import sequences as Q


def _triangle_distance(p, t):
    """By many points of the triangle and its exact plane projection."""
    import numpy as np

    a, b, c = (np.array(x) for x in t)
    p = np.array(p)
    n = np.cross(b - a, c - a)
    best = math.inf
    if n @ n > 0:
        q = p - n * ((p - a) @ n) / (n @ n)
        w = np.linalg.lstsq(np.stack([b - a, c - a], 1), q - a, rcond=None)[0]
        if w.min() >= 0 and w.sum() <= 1:
            best = np.linalg.norm(p - q)
    for s, e in ((a, b), (b, c), (c, a)):
        u = min(1, max(0, (p - s) @ (e - s) / max(1e-30, (e - s) @ (e - s))))
        best = min(best, np.linalg.norm(p - s - u * (e - s)))
    return best


def test_nearest_faces_against_brute_force(spark):
    v, f = creation.icosphere(spark, 1)
    at = {r.v: (r.x, r.y, r.z) for r in v.collect()}
    tris = {r.f: (at[r.i0], at[r.i1], at[r.i2]) for r in f.collect()}
    rng = random.Random(5)
    queries = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(40)] + [(40, 0.0, 0.0, 0.0)]
    q = spark.createDataFrame(queries, "q long, x double, y double, z double")
    got = {r.q: r for r in proximity.closest_point_on_mesh(q, v, f, 0.7).collect()}
    assert len(got) == len(queries)
    for i, *p in queries:
        want = min(_triangle_distance(p, t) for t in tris.values())
        assert got[i].d == pytest.approx(want, abs=1e-9) and _triangle_distance(p, tris[got[i].f]) == pytest.approx(want, abs=1e-9)
        assert math.dist(p, (got[i].x, got[i].y, got[i].z)) == pytest.approx(want, abs=1e-9)
    assert proximity.closest_point_on_mesh(q, v, f.limit(0), 1.0).count() == 0
    field = v.select("v", v["x"].alias("val"))
    moved = {r.p: r.val for r in proximity.transfer_onto_points(q, v, f, field, 3.0).collect()}
    assert all(moved[i] == pytest.approx(got[i].x, abs=1e-9) for i, *_ in queries)


def test_containment_of_a_box(spark):
    v, f = creation.box(spark, (2.0, 2.0, 2.0))
    points = [(0, 0.0, 0.0, 0.0), (1, 0.9, -0.9, 0.5), (2, 1.1, 0.0, 0.0), (3, 0.0, 0.0, 1.5), (4, 0.0, 0.0, -1.5), (5, 0.5, 0.5, 0.99)]
    got = {r.q: r.inside for r in proximity.contains_points(spark.createDataFrame(points, "q long, x double, y double, z double"), v, f, 0.7).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}


def test_cuts_through_corners_and_beside(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], "v long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "f long, i0 long, i1 long, i2 long")
    area = lambda t: sum(r.area for r in cutting.triangle_areas(t).collect())
    assert area(cutting.slice_with_plane(v, f, (1.0, 0.0, 0.0), (1.0, 0.0, 0.0))) == pytest.approx(0.5)
    assert area(cutting.slice_with_plane(v, f, (-1.0, 0.0, 0.0), (1.0, 0.0, 0.0))) == pytest.approx(1.5)
    assert cutting.slice_with_plane(v, f, (1.0, 0.0, 0.0), (3.0, 0.0, 0.0)).count() == 0
    assert cutting.mesh_with_plane(v, f, (0.0, 0.0, 1.0)).count() == 0
    assert area(cutting.slice_with_plane(v, f, (1.0, -1.0, 0.0))) == pytest.approx(1.0)
    assert cutting.mesh_with_plane(v, f.limit(0), (1.0, 0.0, 0.0)).count() == 0


def test_mirrored_boxes_keep_a_positive_volume(spark):
    v, f = creation.box(spark, (1.0, 2.0, 3.0))
    mirrored = affine.transform_mesh(v, f, affine.reflection_matrix((1.0, 1.0, 0.0), (0.3, 0.2, 0.1)))
    assert geometry.measures(*mirrored).first().volume == pytest.approx(6.0)
    assert affine.classify_transform(affine.as_matrix([[1, 0, 0], [0, 1, 0], [0, 0, 1]])) == "rigid"
    with pytest.raises(ValueError):
        affine.as_matrix([1.0, 2.0])
    assert boxes.enclosing_diagonal(v.limit(0)).first().diagonal == math.inf


def test_averages_and_operators_of_few_rows(spark):
    v, f = creation.box(spark)
    ones = v.selectExpr("v", "1.0d as val")
    assert {r.val for r in D.average_onto_faces(f, ones).collect()} == {1.0}
    index = spark.createDataFrame([(0, 3), (1, -1)], "row long, src long")
    assert sorted((r.row, r.val) for r in D.transfer_through_index(ones, index).collect()) == [(0, 1.0), (1, 0.0)]
    assert D.operator_from_index(index).count() == 1
    assert Q.arange(spark, 5, 10).count() == 0 and [r.val for r in Q.arange(spark, 10, 1, 4).orderBy("pos").collect()] == [1, 5, 9]
