"""Edges, half-edges, adjacency, boundaries and validity of triangle meshes as joins and aggregates.

Faces are (f, i0, i1, i2); a half-edge h = 3 f + k runs from corner k to the next. A ``mesh_id`` column, if
there, belongs to every key, so that collections of meshes are handled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by(df: DataFrame) -> list[str]:
    return ["mesh_id"] if "mesh_id" in df.columns else []


def halfedges(faces: DataFrame) -> DataFrame:
    """(h, f, k, org, dst, lo, hi) of every corner."""
    corner = lambda k, a, b: F.struct((F.col("f") * 3 + k).alias("h"), F.lit(k).alias("k"), F.col(a).alias("org"), F.col(b).alias("dst"))
    rows = faces.select(*_by(faces), "f", F.inline(F.array(corner(0, "i0", "i1"), corner(1, "i1", "i2"), corner(2, "i2", "i0"))))
    return rows.withColumn("lo", F.least("org", "dst")).withColumn("hi", F.greatest("org", "dst"))


def unique_edges(faces: DataFrame) -> DataFrame:
    """(lo, hi, n_faces) of every undirected edge."""
    h = halfedges(faces)
    return h.groupBy(*_by(h), "lo", "hi").agg(F.count("*").alias("n_faces"))


def edge_lengths(vertices: DataFrame, edges: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    by = _by(edges)
    end = lambda c: vertices.select(*by, F.col("v").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in "xyz"])
    joined = edges.join(end(a), [*by, a]).join(end(b), [*by, b])
    square = sum(((F.col(f"{a}_{x}") - F.col(f"{b}_{x}")) ** 2 for x in "yz"), (F.col(f"{a}_x") - F.col(f"{b}_x")) ** 2)
    return joined.withColumn("length", F.sqrt(square)).select(*edges.columns, "length")


def twins(faces: DataFrame) -> DataFrame:
    """(h, twin): the opposite half-edge, or -1 on a boundary; of several, the least."""
    h = halfedges(faces)
    by = _by(h)
    other = h.select(*by, F.col("dst").alias("org"), F.col("org").alias("dst"), F.col("h").alias("t"))
    return h.join(other, [*by, "org", "dst"], "left").groupBy(*by, "h").agg(F.coalesce(F.min("t"), F.lit(-1)).alias("twin"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """(f0, f1, lo, hi): pairs of faces over edges that exactly two share."""
    h = halfedges(faces)
    two = h.groupBy(*_by(h), "lo", "hi").agg(F.count("*").alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1"))
    return two.where("n = 2 and f0 <> f1").drop("n")


def vertex_neighbors(faces: DataFrame) -> DataFrame:
    """(v, neighbor): distinct, both ways."""
    e = unique_edges(faces).where("lo <> hi")
    by = _by(e)
    return e.select(*by, F.inline(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("neighbor")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("neighbor")))))


def vertex_degrees(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, degree) of every vertex, 0 without faces."""
    n = vertex_neighbors(faces)
    by = _by(n)
    return vertices.select(*by, "v").join(n.groupBy(*by, "v").agg(F.count("*").alias("degree")), [*by, "v"], "left").select(*by, "v", F.coalesce("degree", F.lit(0)).alias("degree"))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """(v, faces): the sorted faces at each vertex."""
    by = _by(faces)
    rows = faces.select(*by, "f", F.explode(F.array_distinct(F.array("i0", "i1", "i2"))).alias("v"))
    return rows.groupBy(*by, "v").agg(F.sort_array(F.collect_list("f")).alias("faces"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """(org, dst, f) of half-edges whose edge has one face."""
    h = halfedges(faces)
    by = _by(h)
    single = h.groupBy(*by, "lo", "hi").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return h.join(single, [*by, "lo", "hi"], "left_semi").select(*by, "org", "dst", "f")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    b = boundary_edges(faces)
    return b.select(*_by(b), F.explode(F.array("org", "dst")).alias("v")).distinct()


def non_manifold_edges(faces: DataFrame) -> DataFrame:
    return unique_edges(faces).where("n_faces > 2")


def euler_characteristic(faces: DataFrame) -> DataFrame:
    """(n_vertices, n_edges, n_faces, euler) over the vertices that faces use."""
    by = _by(faces)
    used = faces.select(*by, F.explode(F.array("i0", "i1", "i2")).alias("v")).distinct()
    counts = [used.groupBy(*by).agg(F.count("*").alias("n_vertices")), unique_edges(faces).groupBy(*by).agg(F.count("*").alias("n_edges")), faces.groupBy(*by).agg(F.count("*").alias("n_faces"))]
    joined = counts[0].join(counts[1], by).join(counts[2], by) if by else counts[0].crossJoin(counts[1]).crossJoin(counts[2])
    return joined.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def validity(faces: DataFrame) -> DataFrame:
    """One row of flags: edge-manifold, watertight, consistent winding, duplicate and degenerate faces."""
    h = halfedges(faces)
    by = _by(h)
    directed = h.groupBy(*by, "lo", "hi").agg(F.count("*").alias("n"), F.sum((F.col("org") == F.col("lo")).cast("int")).alias("forward"))
    flags = directed.groupBy(*by).agg(
        F.bool_and(F.col("n") <= 2).alias("edge_manifold"),
        F.bool_and(F.col("n") == 2).alias("watertight"),
        F.bool_and((F.col("n") != 2) | (F.col("forward") == 1)).alias("winding_consistent"),
    )
    key = F.array_sort(F.array("i0", "i1", "i2"))
    double = faces.groupBy(*by, key.alias("key")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))
    flat = faces.groupBy(*by).agg(F.count_if((F.col("i0") == F.col("i1")) | (F.col("i1") == F.col("i2")) | (F.col("i2") == F.col("i0"))).alias("n_degenerate"))
    return flags.join(double, by).join(flat, by) if by else flags.crossJoin(double).crossJoin(flat)


def remove_degenerate(faces: DataFrame) -> DataFrame:
    return faces.where("i0 <> i1 and i1 <> i2 and i2 <> i0")


def remove_duplicates(faces: DataFrame) -> DataFrame:
    """Of faces on the same three vertices, the first by f."""
    by = _by(faces)
    return faces.groupBy(*by, F.array_sort(F.array("i0", "i1", "i2")).alias("_key")).agg(F.min(F.struct("f", "i0", "i1", "i2")).alias("_one")).select(*by, "_one.*")


def canonical_faces(faces: DataFrame) -> DataFrame:
    """Faces turned so that their least corner comes first."""
    turn = F.when((F.col("i0") <= F.col("i1")) & (F.col("i0") <= F.col("i2")), F.array("i0", "i1", "i2")).when((F.col("i1") < F.col("i0")) & (F.col("i1") <= F.col("i2")), F.array("i1", "i2", "i0")).otherwise(F.array("i2", "i0", "i1"))
    return faces.withColumn("_t", turn).select(*_by(faces), "f", *[F.col("_t")[k].alias(f"i{k}") for k in range(3)])


def referenced_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The vertices that some face uses."""
    by = _by(faces)
    used = faces.select(*by, F.explode(F.array("i0", "i1", "i2")).alias("v"))
    return vertices.join(used, [*by, "v"], "left_semi")


def submesh(vertices: DataFrame, faces: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The faces that meet a condition, and the vertices they use."""
    kept = faces.where(keep)
    return referenced_vertices(vertices, kept), kept


def graph_laplacian(faces: DataFrame) -> DataFrame:
    """(row, col, val): degree on the diagonal, -1 for each neighbour."""
    n = vertex_neighbors(faces)
    off = n.select(F.col("v").alias("row"), F.col("neighbor").alias("col"), F.lit(-1.0).alias("val"))
    return off.unionByName(n.groupBy(F.col("v").alias("row")).agg(F.count("*").cast("double").alias("val")).select("row", F.col("row").alias("col"), "val"))
