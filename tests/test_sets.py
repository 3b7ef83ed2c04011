import math
import random
import struct

import numpy as np
import pytest

from meshrel.operators import creation as C
from meshrel.operators import curves as L
from meshrel.operators import elements as E
from meshrel.operators import geometry as G
from meshrel.operators import points as P
from meshrel.operators import selection as S
from meshrel.operators import topology as T
from meshrel.operators import voxels as X
from meshrel.plans import clouds
from meshrel.sources import meshfiles


@pytest.fixture(scope="module")
def cloud(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 3), rng.gauss(0, 2), rng.gauss(0, 1)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "p long, x double, y double, z double")


def test_frames_and_moments(cloud):
    rows, df = cloud
    at = np.array([r[1:] for r in rows])
    values, _ = np.linalg.eigh(np.cov(at.T) * (len(at) - 1))
    r = P.principal_axes(df).first()
    axes = np.array([[r[f"a{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose([r.e0, r.e1, r.e2], values[::-1]) and np.allclose(axes @ axes.T, np.eye(3)) and np.isclose(np.linalg.det(axes), 1)
    u, v = P.plane_basis((1, 2, 3))
    assert np.allclose(np.cross(u, v), np.array([1, 2, 3]) / 14**0.5)


def test_procrustes_finds_a_known_transform(spark, cloud):
    m = G.rotation((1, 2, 3), 0.8)
    rows = [(*p, *[2 * sum(m[i][j] * p[j] for j in range(3)) + i for i in range(3)]) for _, *p in cloud[0]]
    r = P.procrustes(spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")).first()
    assert np.allclose([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)], 2 * np.array(m)[:3, :3]) and np.allclose([r.m03, r.m13, r.m23], [0, 1, 2]) and r.cost < 1e-9


def test_farthest_points_and_outlier_probabilities(cloud):
    rows, df = cloud
    at = np.array([r[1:] for r in rows])
    want, d = [3], np.full(len(at), np.inf)
    for _ in range(5):
        d = np.minimum(d, ((at - at[want[-1]]) ** 2).sum(1))
        want.append(int(d.argmax()))
    assert [r.p for r in P.farthest_points(df, 6, 3).orderBy("rank").collect()] == want
    gap = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    near = np.argsort(gap, axis=1, kind="stable")[:, :5]
    sigma = np.sqrt((np.take_along_axis(gap, near, 1) ** 2).mean(1))
    plof = sigma / sigma[near].mean(1) - 1
    norm = 3 * np.sqrt((plof**2).mean())
    found = {r.p: r.probability for r in P.outlier_probabilities(df, 5, 2.0).collect()}
    assert all(math.isclose(found[i], max(0.0, math.erf(plof[i] / norm / 2**0.5)), abs_tol=1e-9) for i in found)


def test_curves_through_a_cube_of_cells(spark):
    cells = [(i, j, k) for i in range(8) for j in range(8) for k in range(8)]
    code = P._hilbert(np.array(cells).T, 3)
    order = [c for _, c in sorted(zip(code.tolist(), cells))]
    assert sorted(code.tolist()) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))
    df = spark.createDataFrame(cells, "i long, j long, k long")
    back = P.morton_cells(P.morton_codes(df, 3).select("code", *[df[c].alias("w" + c) for c in "ijk"]), 3)
    assert back.where("i <> wi or j <> wj or k <> wk").count() == 0 and back.select("code").distinct().count() == 512


def test_cavities_fill_and_boxes_close(spark):
    shell = [(i, j, k) for i in range(4) for j in range(4) for k in range(4) if not (0 < i < 3 and 0 < j < 3 and 0 < k < 3)]
    cells = spark.createDataFrame(shell, "i long, j long, k long")
    assert X.fill_cavities(cells).distinct().count() == 64
    assert X.fill_cavities(cells.where("not (i = 1 and j = 1 and k = 0)")).count() == len(shell) - 1
    v, f = X.to_boxes(cells, 0.5)
    assert math.isclose(G.measures(v, f).first().volume, len(shell) / 8) and T.validity(f).first().watertight


def test_simplify_downsample_and_ends(spark):
    rows = [(1, i, float(i), 0.1 * (i % 2) + (5.0 if i == 10 else 0.0), 0.0) for i in range(21)] + [(2, i, math.cos(i * math.pi / 2), math.sin(i * math.pi / 2), 0.0) for i in range(5)]
    lines = spark.createDataFrame(rows, L.LINE)
    kept = {(r.line_id, r.pos) for r in L.simplify(lines, 0.5).collect()}
    assert {p for i, p in kept if i == 1} == {0, 9, 10, 11, 20}
    assert sorted(r.pos for r in L.downsample(lines.where("line_id = 2"), 2.0).collect()) == [0, 2, 4]
    assert {r.line_id: (r.n, r.closed) for r in L.ends(lines).collect()} == {1: (21, False), 2: (5, True)}
    assert L.open_lines(lines).where("line_id = 2").count() == 4
    assert all(math.isclose(r.angle, math.pi / 2) for r in L.turning_angles(lines.where("line_id = 2")).collect())


def test_curvature_and_moments_of_solids(spark):
    v, f = C.icosphere(spark, 2, 2.0)
    r = E.vertex_curvatures(v, f).selectExpr("avg(mean) mean", "avg(gaussian) gaussian").first()
    assert math.isclose(r["mean"], 0.5, rel_tol=0.03) and math.isclose(r["gaussian"], 0.25, rel_tol=0.05)
    m = E.moments(*C.box(spark, (1.0, 2.0, 3.0))).first()
    assert math.isclose(m.volume, 6) and math.isclose(m.ixx, 6.5) and math.isclose(m.iyy, 5) and math.isclose(m.izz, 2.5) and abs(m.ixy) < 1e-12
    assert E.is_volume(*C.box(spark)).first().is_volume


def test_winding_is_mended(spark):
    v, f = C.box(spark)
    turned = f.selectExpr("f", "i0", "if(f % 3 = 1, i2, i1) i1", "if(f % 3 = 1, i1, i2) i2")
    assert not T.validity(turned).first().winding_consistent and T.validity(S.consistent_winding(turned)).first().winding_consistent


def test_mesh_files(spark, tmp_path):
    points, faces = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)]
    (tmp_path / "a.obj").write_text("".join(f"v {x} {y} {z}\n" for x, y, z in points) + "f 1/1 2/2 3/3 -1\n")
    (tmp_path / "b.off").write_text("OFF # square\n4 1 0\n" + "".join(f"{x} {y} {z}\n" for x, y, z in points) + "4 0 1 2 3 255 0 0\n")
    head = "ply\nformat {}\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "c.ply").write_text(head.format("ascii 1.0") + "".join(f"{x} {y} {z}\n" for x, y, z in points) + "4 0 1 2 3\n")
    (tmp_path / "d.ply").write_bytes(head.format("binary_big_endian 1.0").encode() + b"".join(struct.pack(">3f", *p) for p in points) + struct.pack(">B4i", 4, 0, 1, 2, 3))
    (tmp_path / "e.stl").write_bytes(b" " * 80 + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *points[a], *points[b], *points[c], 0) for a, b, c in faces))
    (tmp_path / "notes.txt").write_text("no mesh")
    v, f = meshfiles.read_meshes(spark, str(tmp_path))
    for name in ("a.obj", "b.off", "c.ply", "d.ply", "e.stl"):
        mine = lambda df: df.where(df.mesh_id == name).drop("mesh_id")  # noqa: B023, E731
        m = G.measures(mine(v), mine(f)).first()
        assert mine(v).count() == 4 and mine(f).count() == 2 and math.isclose(m.area, 1)


def test_balls_hold_pairs_whose_rounded_distance_is_the_radius(spark, tmp_path):
    at = [(0, 0.0), (1, 0.0500003), (2, 0.1000012), (3, 0.1499995)]
    spark.createDataFrame([(p, [x, 0.0, 0.0]) for p, x in at], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted((r.q, r.p, r.d) for r in clouds.ball(spark, str(tmp_path)).collect())
    assert found == [(0, 1, 0.05), (1, 0, 0.05), (2, 3, 0.049998), (3, 2, 0.049998)]
