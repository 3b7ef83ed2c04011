"""Queries of the fixpoint operators and generators.

Recursive SQL lists all pairs that reach each other, which no whole mesh allows; labels, parities and the envelope
have none, and are held against brute force on small graphs in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import creation as C
from ..operators import geometry, topology
from ..operators import graph as G
from ..sources.derived import FIELD, height_field, table

HOPS, STRIDE = 5, 84


def _edges(faces):
    return topology.unique_edges(faces).select(F.col("lo").alias("a"), F.col("hi").alias("b"))


def labels(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return G.component_labels(_edges(f), v)


def parity(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return G.parity_labels(_edges(f).withColumn("sign", (F.col("a") % 2).cast("int")), v).withColumn("parity", F.col("parity").cast("long"))


def hops(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return G.hop_distances(_edges(f), v.where("v % 211 = 7"), v, HOPS).withColumn("hops", F.col("hops").cast("long"))


def expand(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return G.expand_selection(_edges(f), v.where("v % 211 = 7"), v, 2)


def shrink(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    return G.shrink_selection(_edges(f), v.where("v % 211 <> 7"), v, 2)


def envelope(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    values = v.select("v", F.when(F.expr("v % 211 = 7"), F.lit(0.0)).otherwise(F.lit(1000.0)).alias("value"))
    return G.path_envelope(_edges(f).withColumn("w", ((F.col("a") + F.col("b")) % 7).cast("double")), values)


def cycles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"), F.min("p_partkey").alias("k0"))
    return G.successor_cycles(part.crossJoin(F.broadcast(n)).select((F.col("p_partkey") - F.col("k0")).alias("a"), ((F.col("p_partkey") - F.col("k0") + STRIDE) % F.col("n")).alias("b")))


def loops(spark, sf_dir):
    v, f = height_field(spark, sf_dir)
    m = G.loop_measures(v, G.boundary_loops(f))
    return m.select("cycle", "n", F.round("perimeter", 4).alias("perimeter"), F.round("az", 4).alias("az"))


def longest(spark, sf_dir):
    return G.longest_loop(G.boundary_loops(height_field(spark, sf_dir)[1])).select("v")


def faces_by_component(spark, sf_dir):
    """The field cut along every seventh column leaves strips."""
    v, f = height_field(spark, sf_dir)
    at = v.select(F.col("v").alias("i0"), F.col("x").alias("x"))
    strips = f.join(at, "i0").where("cast(x as long) % 7 <> 3").select("f", "i0", "i1", "i2")
    return G.face_components(strips).groupBy("label").agg(F.count("*").alias("n"), F.max("f").alias("last"))


def _made(mesh):
    v, f = mesh
    m = geometry.measures(v, f).select("area", "volume").crossJoin(topology.euler_characteristic(f))
    return m.select("n_vertices", "n_edges", "n_faces", "euler", F.round("area", 5).alias("area"), F.round("volume", 5).alias("volume"))


def solids(spark, sf_dir):
    """Counts and measures of the generated solids."""
    made = {"box": C.box(spark, (1.0, 2.0, 3.0)), "tetrahedron": C.tetrahedron(spark), "octahedron": C.octahedron(spark), "icosahedron": C.icosahedron(spark), "dodecahedron": C.dodecahedron(spark), "uv_sphere": C.uv_sphere(spark), "cylinder": C.cylinder(spark, 1.0, 2.0), "cone": C.cone(spark, 1.0, 2.0), "capsule": C.capsule(spark), "annulus": C.annulus(spark, 0.5, 1.0, 1.0), "torus": C.torus(spark, 2.0, 0.5)}
    out = None
    for name, mesh in made.items():
        one = _made(mesh).withColumn("solid", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def icospheres(spark, sf_dir):
    return _made(C.icosphere(spark, 2))


def extruded(spark, sf_dir):
    return _made(C.extrude_triangulation(*height_field(spark, sf_dir), 2.5))


def create_grid(spark, sf_dir):
    v, f = C.grid(spark, (40, 30), (2.0, 1.0))
    corners = f.join(v.withColumnRenamed("v", "i0"), "i0")
    return corners.select("f", "i0", "i1", "i2", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


EDGES = FIELD + ", E AS (SELECT DISTINCT lo AS a, hi AS b FROM H), W AS (SELECT a, b FROM E UNION ALL SELECT b, a FROM E)"
REC = "WITH RECURSIVE" + EDGES.removeprefix("WITH")
REACH = REC + f", R AS (SELECT v, 0 AS hops FROM V WHERE v % 211 = 7 UNION SELECT b, hops + 1 FROM R JOIN W ON a = v WHERE hops < {HOPS}), D AS (SELECT v, min(hops) AS hops FROM R GROUP BY v)"
SQL = {
    "graph_hops": REACH + f" SELECT V.v, CAST(coalesce(hops, {G.UNREACHED}) AS BIGINT) AS hops FROM V LEFT JOIN D USING (v)",
    "graph_expand": REACH + " SELECT v FROM D WHERE hops <= 2",
    "graph_shrink": REACH + " SELECT V.v FROM V LEFT JOIN D USING (v) WHERE coalesce(hops, 99) > 2",
    "graph_cycles": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), R AS (SELECT range AS cycle, CAST(0 AS BIGINT) AS pos, range AS v FROM n, range(gcd({STRIDE}, n))
        UNION ALL SELECT cycle, pos + 1, (v + {STRIDE}) % n FROM R, n WHERE (v + {STRIDE}) % n <> cycle) SELECT cycle, pos, v FROM R""",
    "graph_loops": FIELD + """, B AS (SELECT org, dst FROM H JOIN (SELECT lo, hi FROM H GROUP BY ALL HAVING count(*) = 1) USING (lo, hi))
        SELECT min(org) AS cycle, count(*) AS n, round(sum(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2)), 4) AS perimeter, round(sum(p.x * q.y - p.y * q.x) / 2, 4) AS az
        FROM B JOIN V p ON p.v = org JOIN V q ON q.v = dst""",
    "graph_longest_loop": FIELD + ", B AS (SELECT lo, hi FROM H GROUP BY ALL HAVING count(*) = 1) SELECT lo AS v FROM B UNION SELECT hi FROM B",
    "graph_face_components": FIELD + """, S AS (SELECT f, CAST(x AS BIGINT) AS x FROM F JOIN V ON v = i0 WHERE CAST(x AS BIGINT) % 7 <> 3)
        SELECT min(f) AS label, count(*) AS n, max(f) AS last FROM S GROUP BY (x + 3) // 7""",
    "create_solids": """WITH
        P AS (SELECT 'uv_sphere' AS solid, 64 AS s, range AS i, sin(pi() * range / 31) AS r, -cos(pi() * range / 31) AS z, 32 AS m, false AS closed FROM range(32)
          UNION ALL SELECT 'cylinder', 32, * FROM (VALUES (0, 0.0, -1.0, 4, false), (1, 1.0, -1.0, 4, false), (2, 1.0, 1.0, 4, false), (3, 0.0, 1.0, 4, false))
          UNION ALL SELECT 'cone', 32, * FROM (VALUES (0, 0.0, 0.0, 3, false), (1, 1.0, 0.0, 3, false), (2, 0.0, 2.0, 3, false))
          UNION ALL SELECT 'capsule', 32, range, CASE WHEN range IN (0, 33) THEN 0.0 WHEN range <= 16 THEN cos(pi() / 2 * (16 - range) / 16) ELSE cos(pi() / 2 * (range - 17) / 16) END,
                           CASE WHEN range = 0 THEN -1.5 WHEN range = 33 THEN 1.5 WHEN range <= 16 THEN -0.5 - sin(pi() / 2 * (16 - range) / 16) ELSE 0.5 + sin(pi() / 2 * (range - 17) / 16) END, 34, false FROM range(34)
          UNION ALL SELECT 'annulus', 32, * FROM (VALUES (0, 0.5, -0.5, 4, true), (1, 1.0, -0.5, 4, true), (2, 1.0, 0.5, 4, true), (3, 0.5, 0.5, 4, true))
          UNION ALL SELECT 'torus', 32, range, 2 + 0.5 * cos(2 * pi() * range / 32), 0.5 * sin(2 * pi() * range / 32), 32, true FROM range(32)),
        R AS (SELECT solid, s, i, m, closed, z, CASE WHEN (solid <> 'annulus' AND solid <> 'torus') AND i IN (0, m - 1) THEN 0.0 ELSE r END AS r FROM P),
        B AS (SELECT a.solid, a.s, a.r AS r1, a.z AS z1, b.r AS r2, b.z AS z2 FROM R a JOIN R b ON a.solid = b.solid AND (b.i = a.i + 1 OR a.closed AND a.i = a.m - 1 AND b.i = 0)),
        T AS (SELECT solid, sum(s * (r1 + r2) * sin(pi() / s) * sqrt((z2 - z1) ** 2 + ((r2 - r1) * cos(pi() / s)) ** 2)) AS area, sum(s / 2.0 * sin(2 * pi() / s) * (z2 - z1) / 3 * (r1 ** 2 + r1 * r2 + r2 ** 2)) AS volume,
                     sum(CASE WHEN r1 > 0 THEN s ELSE 0 END + CASE WHEN r2 > 0 THEN s ELSE 0 END) AS n_faces FROM B GROUP BY solid),
        N AS (SELECT solid, sum(CASE WHEN r > 0 THEN s ELSE 1 END) AS n_vertices FROM R GROUP BY solid),
        S AS (SELECT solid, n_vertices, n_faces, area, volume FROM T JOIN N USING (solid)
          UNION ALL SELECT 'box', 8, 12, 22, 6
          UNION ALL SELECT 'tetrahedron', 4, 4, sqrt(3.0) * 8 / 3, pow(8.0 / 3, 1.5) / (6 * sqrt(2.0))
          UNION ALL SELECT 'octahedron', 6, 8, 4 * sqrt(3.0), 4.0 / 3
          UNION ALL SELECT 'icosahedron', 12, 20, 5 * sqrt(3.0) / sin(2 * pi() / 5) ** 2, 5 * (3 + sqrt(5.0)) / 12 / sin(2 * pi() / 5) ** 3
          UNION ALL SELECT 'dodecahedron', 20, 36, 3 * sqrt(25 + 10 * sqrt(5.0)) * pow(4 / (sqrt(3.0) * (1 + sqrt(5.0))), 2), (15 + 7 * sqrt(5.0)) / 4 * pow(4 / (sqrt(3.0) * (1 + sqrt(5.0))), 3))
        SELECT solid, n_vertices::BIGINT AS n_vertices, (n_faces * 3 / 2)::BIGINT AS n_edges, n_faces::BIGINT AS n_faces, (n_vertices - n_faces / 2)::BIGINT AS euler, round(area, 5) AS area, round(volume, 5) AS volume FROM S""",
    "create_extruded": FIELD + """, E AS (SELECT lo, hi, count(*) AS n FROM H GROUP BY lo, hi), B AS (SELECT sum(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS rim, count(*) AS n FROM E JOIN V p ON p.v = lo JOIN V q ON q.v = hi WHERE E.n = 1),
        U AS (SELECT count(DISTINCT org) AS nv FROM H), A AS (SELECT count(*) AS nf, sum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) / 2 AS area FROM F JOIN V p ON p.v = i0 JOIN V q ON q.v = i1 JOIN V r ON r.v = i2)
        SELECT (2 * nv)::BIGINT AS n_vertices, ((2 * nf + 2 * B.n) * 3 / 2)::BIGINT AS n_edges, (2 * nf + 2 * B.n)::BIGINT AS n_faces, (2 * nv - (nf + B.n))::BIGINT AS euler, round(2 * area + 2.5 * rim, 5) AS area, round(2.5 * area, 5) AS volume FROM A, B, U""",
    "create_grid": """WITH c AS (SELECT range AS id, range // 39 * 40 + range % 39 AS c0 FROM range(39 * 29)),
        f AS (SELECT id * 2 AS f, c0 AS i0, c0 + 1 AS i1, c0 + 41 AS i2 FROM c UNION ALL SELECT id * 2 + 1, c0, c0 + 41, c0 + 40 FROM c)
        SELECT f, i0, i1, i2, round(i0 % 40 * (2.0 / 39)::DOUBLE - 1, 6) + 0.0 AS x, round(i0 // 40 * (1.0 / 29)::DOUBLE - 0.5, 6) + 0.0 AS y FROM f""",
}
QUERIES = {
    "graph_labels": labels, "graph_parity": parity, "graph_hops": hops, "graph_expand": expand, "graph_shrink": shrink, "graph_envelope": envelope,
    "graph_cycles": cycles, "graph_loops": loops, "graph_longest_loop": longest, "graph_face_components": faces_by_component, "create_solids": solids, "create_icosphere": icospheres, "create_extruded": extruded, "create_grid": create_grid,
}
