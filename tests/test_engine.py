import math

import pytest

from meshrel.operators import aggregate as A
from meshrel.operators import geometry as G
from meshrel.operators import spatial as S
from meshrel.operators import topology as T

CUBE_V = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
QUADS = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]


@pytest.fixture(scope="module")
def cube(spark):
    faces = [f for a, b, c, d in QUADS for f in ((a, b, c), (a, c, d))]
    return spark.createDataFrame(CUBE_V, "v long, x double, y double, z double"), spark.createDataFrame([(i, *f) for i, f in enumerate(faces)], "f long, i0 long, i1 long, i2 long")


def test_cube_is_a_closed_manifold(cube):
    _, faces = cube
    e = T.euler_characteristic(faces).first()
    assert (e.n_vertices, e.n_edges, e.n_faces, e.euler) == (8, 18, 12, 2)
    v = T.validity(faces).first()
    assert v.edge_manifold and v.watertight and v.winding_consistent and v.n_duplicate == v.n_degenerate == 0
    assert T.boundary_edges(faces).count() == 0
    assert T.face_adjacency(faces).count() == 18
    assert T.twins(faces).where("twin = -1").count() == 0


def test_cube_measures(cube):
    m = G.measures(*cube).first()
    assert math.isclose(m.area, 6) and math.isclose(abs(m.volume), 1) and math.isclose(m.cx, 0.5)
    defect = G.angle_defects(*cube).groupBy().sum("defect").first()[0]
    assert math.isclose(defect, 4 * math.pi)


def test_laplacian_rows_sum_to_zero(cube):
    worst = G.cotangent_laplacian(*cube).groupBy("row").sum("val").selectExpr("max(abs(`sum(val)`))").first()[0]
    assert worst < 1e-12


def test_subdivision_keeps_the_surface(cube):
    v, f = G.subdivide(*cube, 1000)
    assert math.isclose(G.measures(v, f).first().area, 6)
    assert T.euler_characteristic(f).first().euler == 2


def test_rotation_keeps_lengths(cube):
    turned = G.apply_transform(cube[0], G.rotation((1, 2, 3), 0.7))
    a = T.edge_lengths(turned, T.unique_edges(cube[1])).groupBy().sum("length").first()[0]
    b = T.edge_lengths(cube[0], T.unique_edges(cube[1])).groupBy().sum("length").first()[0]
    assert math.isclose(a, b)


def test_empty_groups_have_sentinels(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0)], "g long, val double")
    rows = {r.g: r for r in A.scatter(df, spark.range(2).withColumnRenamed("id", "g"), "g", "val").collect()}
    assert rows[0].sum == 4 and rows[1].sum == 0 and math.isnan(rows[1].mean) and rows[1].min == math.inf and rows[1].max == -math.inf


def test_segments_and_offsets(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([2, 0, 3, 1])], "pos long, count long")
    assert [r.offset for r in A.counts_to_offsets(counts, parts=2).orderBy("pos").collect()] == [0, 2, 2, 5]
    spans = A.segments_of(spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 5)], "segment long, offset long"))
    values = spark.createDataFrame([(i, float(i)) for i in range(5)], "pos long, val double")
    assert {r.segment: r.sum for r in A.segment(values, spans).collect()} == {0: 1.0, 1: 0.0, 2: 9.0}


def test_partitions_and_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "a long, b long")
    assert A.partitions_equal(df).first().equal
    assert not A.rows_equal(df, df.distinct()).first().equal
    assert A.allclose(*[spark.createDataFrame([], "pos long, val double")] * 2).first().allclose


def test_nearest_neighbours_are_exact(spark):
    points = [(i, math.sin(i * 12.9898) * 3, math.cos(i * 78.233), (i * 37 % 11) / 5) for i in range(60)]
    df = spark.createDataFrame(points, "p long, x double, y double, z double")
    got = {(r.q, r.rank): r.p for r in S.knn_join(df.withColumnRenamed("p", "q"), df, 3, 0.2).collect()}
    for q in points:
        want = sorted((math.dist(q[1:], p[1:]), p[0]) for p in points)[:3]
        assert [got[q[0], k] for k in range(3)] == [p for _, p in want]


def test_voxels(spark):
    one = spark.createDataFrame([(0, 0, 0)], "i long, j long, k long")
    assert S.dilate(one).count() == 7
    assert S.erode(S.dilate(one)).collect() == one.collect()
    assert S.voxel_difference(S.dilate(one), one).count() == 6
