"""Selections of faces and vertices: seams of regions, enclosed holes, components, orientation, compact ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import face_geometry
from .graph import both_ways, component_labels, parity_labels
from .topology import face_adjacency, halfedges, referenced_vertices, unique_edges


def dense_ids(df: DataFrame, key: str = "v", name: str = "id", parts: int = 256) -> DataFrame:
    """``df`` with 0, 1, 2, ... in order of a distinct integer ``key``.

    Ranks within ``parts`` equal ranges of the key, each its own task, plus the number of rows in the ranges
    before, from a table of ``parts`` rows; no window runs over all rows.
    """
    span = df.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    placed = df.crossJoin(F.broadcast(span)).withColumn("_part", F.floor((F.col(key) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * parts)).drop("_lo", "_hi")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1)
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def compact(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vertices that faces use, renumbered from zero in order, with their old id as ``source``; faces likewise."""
    used = dense_ids(referenced_vertices(vertices, faces))
    out = faces.withColumnRenamed("f", "source")
    for k in range(3):
        out = out.join(used.select(F.col("v").alias(f"i{k}"), F.col("id").alias(f"n{k}")), f"i{k}")
    out = dense_ids(out.select("source", *[F.col(f"n{k}").alias(f"i{k}") for k in range(3)]), "source", "f")
    return used.select(F.col("id").alias("v"), "x", "y", "z", F.col("v").alias("source")), out.select("f", "i0", "i1", "i2", "source")


def concatenate(meshes: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Meshes one after another: each one's ids follow the greatest of those before."""
    vertices = faces = None
    for v, f in meshes:
        v, f = v.select("v", "x", "y", "z"), f.select("f", "i0", "i1", "i2")
        if vertices is not None:
            base = vertices.agg((F.coalesce(F.max("v"), F.lit(-1)) + 1).alias("bv")).crossJoin(faces.agg((F.coalesce(F.max("f"), F.lit(-1)) + 1).alias("bf")))
            v = v.crossJoin(F.broadcast(base)).select((F.col("v") + F.col("bv")).alias("v"), "x", "y", "z")
            f = f.crossJoin(F.broadcast(base)).select((F.col("f") + F.col("bf")).alias("f"), *[(F.col(f"i{k}") + F.col("bv")).alias(f"i{k}") for k in range(3)])
        vertices = v if vertices is None else vertices.unionByName(v)
        faces = f if faces is None else faces.unionByName(f)
    return vertices, faces


def region_boundary_edges(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """(org, dst, f) of the half-edges of ``chosen`` faces (f) whose edge has one other face, not chosen: region on the left."""
    h = halfedges(faces).join(chosen.select("f").distinct().withColumn("mine", F.lit(True)), "f", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    own = F.max(F.when(F.col("mine"), F.struct("org", "dst", "f")))
    seam = h.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if("mine").alias("m"), own.alias("own")).where("n = 2 and m = 1")
    return seam.select("own.org", "own.dst", "own.f")


def faces_of_vertices(faces: DataFrame, chosen: DataFrame, mode: str = "all") -> DataFrame:
    """The ids of faces all (or any) of whose corners are in ``chosen`` (v)."""
    at = faces.select("f", F.explode(F.array("i0", "i1", "i2")).alias("v")).join(chosen.select("v").distinct(), "v", "left_semi")
    n = {"all": 3, "any": 1}[mode]
    return at.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= n).select("f")


def vertex_manifold_mask(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(v, ok): whether the faces at a vertex hang together over edges at it; false without faces.

    Corners are nodes, 3 f + k; those at the same end of a shared edge are linked.
    """
    h = halfedges(faces).where("org <> dst")
    head = F.col("f") * 3 + (F.col("k") + 1) % 3
    ends = h.select(F.inline(F.array(*[F.struct("lo", "hi", F.lit(e).alias("end"), F.when(F.col("org") == F.col(e), F.col("h")).otherwise(head).alias("corner")) for e in ("lo", "hi")])))
    hub = ends.groupBy("lo", "hi", "end").agg(F.min("corner").alias("a"))
    links = ends.join(hub, ["lo", "hi", "end"]).where("a <> corner").select("a", F.col("corner").alias("b"))
    corners = halfedges(faces).select(F.col("h").alias("v"))
    fans = component_labels(links, corners).join(halfedges(faces).select(F.col("h").alias("v"), F.col("org").alias("at")), "v")
    fans = fans.groupBy(F.col("at").alias("v")).agg((F.min("label") == F.max("label")).alias("ok"))
    return vertices.select("v").join(fans, "v", "left").select("v", F.coalesce("ok", F.lit(False)).alias("ok"))


def face_flips(faces: DataFrame) -> DataFrame:
    """(f, flip, orientable): whether a face runs against the least face of its component, and whether the component has a consistent winding."""
    e = halfedges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if(F.col("org") == F.col("lo")).alias("forward"), F.min("f").alias("a"), F.max("f").alias("b"))
    pairs = e.where("n = 2 and a <> b").select("a", "b", (F.col("forward") != 1).cast("int").alias("sign"))
    found = parity_labels(pairs, faces.select(F.col("f").alias("v")))
    return found.select(F.col("v").alias("f"), (F.col("parity") == 1).alias("flip"), F.col("consistent").alias("orientable"))


def consistent_winding(faces: DataFrame) -> DataFrame:
    """Faces turned over where they run against the least face of their component."""
    marked = faces.join(face_flips(faces).where("flip").select("f", "flip"), "f", "left")
    turned = F.coalesce("flip", F.lit(False))
    return marked.select("f", "i0", F.when(turned, F.col("i2")).otherwise(F.col("i1")).alias("i1"), F.when(turned, F.col("i1")).otherwise(F.col("i2")).alias("i2"))


def exclude_full_components(edges: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chosen`` (v) without those whose whole component of ``edges`` (a, b) is chosen."""
    label = component_labels(edges, nodes)
    marked = label.join(chosen.select("v").distinct().withColumn("in", F.lit(1)), "v", "left")
    mixed = marked.groupBy("label").agg(F.count("*").alias("n"), F.count("in").alias("m")).where("m < n").select("label")
    return marked.where("`in` is not null").join(mixed, "label", "left_semi").select("v")


def fill_holes(vertices: DataFrame, faces: DataFrame, chosen: DataFrame) -> DataFrame:
    """(f): ``chosen`` faces and every region of other faces that they enclose.

    On a component with a rim a region is outside if it reaches the rim along an edge; on a closed one the
    largest by area is, the one of the least face on a tie. An edge of three or more faces joins them all.
    """
    h = halfedges(faces).where("org <> dst")
    e = h.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("f").alias("a"))
    links = h.join(e, ["lo", "hi"]).select("lo", "hi", "n", "a", F.col("f").alias("b"))
    whole = component_labels(links.where("a <> b").select("a", "b"), faces.select(F.col("f").alias("v")))
    rim = links.where("n = 1").select(F.col("b").alias("f")).distinct().withColumn("rim", F.lit(True))
    rest = faces.join(chosen.select("f"), "f", "left_anti")
    free = h.join(rest.select("f"), "f", "left_semi")
    hub = free.groupBy("lo", "hi").agg(F.min("f").alias("a"))
    region = component_labels(free.join(hub, ["lo", "hi"]).where("a <> f").select("a", F.col("f").alias("b")), rest.select(F.col("f").alias("v")))
    at = region.select(F.col("v").alias("f"), F.col("label").alias("region")).join(whole.select(F.col("v").alias("f"), F.col("label").alias("body")), "f")
    at = at.join(face_geometry(vertices, faces).select("f", "area"), "f").join(rim, "f", "left")
    regions = at.groupBy("body", "region").agg(F.sum("area").alias("area"), F.coalesce(F.bool_or("rim"), F.lit(False)).alias("reaches"))
    open_ = whole.join(rim.withColumnRenamed("f", "v"), "v").select(F.col("label").alias("body")).distinct().withColumn("open", F.lit(True))
    largest = regions.groupBy("body").agg(F.max(F.struct("area", (-F.col("region")).alias("least"))).alias("top")).select("body", (-F.col("top.least")).alias("top"))
    judged = regions.join(open_, "body", "left").join(largest, "body")
    holes = judged.where("(open and not reaches) or (open is null and region <> top)").select("region")
    return chosen.select("f").unionByName(at.join(holes, "region", "left_semi").select("f")).distinct()


def remove_small_components(faces: DataFrame, least_faces: int) -> DataFrame:
    """Faces of components (over edges that two share) of at least ``least_faces`` faces."""
    pairs = face_adjacency(faces).select(F.col("f0").alias("a"), F.col("f1").alias("b"))
    label = component_labels(pairs, faces.select(F.col("f").alias("v")))
    big = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_faces).select("label")
    return faces.join(label.join(big, "label", "left_semi").select(F.col("v").alias("f")), "f", "left_semi")


def merge_vertices(vertices: DataFrame, faces: DataFrame, epsilon: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices at one place as one, the least of them; with ``epsilon``, those in one cell of that size from the least corner."""
    place = [F.col(x) + 0.0 for x in "xyz"]
    v = vertices
    if epsilon > 0:
        low = vertices.agg(*[F.min(x).alias("l" + x) for x in "xyz"])
        v = vertices.crossJoin(F.broadcast(low))
        place = [F.floor((F.col(x) - F.col("l" + x)) / epsilon) for x in "xyz"]
    keyed = v.select("v", *[p.alias(f"k{i}") for i, p in enumerate(place)])
    first = keyed.groupBy("k0", "k1", "k2").agg(F.min("v").alias("to"))
    moved = keyed.join(first, ["k0", "k1", "k2"]).select("v", "to")
    out = faces
    for k in range(3):
        out = out.join(moved.select(F.col("v").alias(f"i{k}"), F.col("to").alias(f"t{k}")), f"i{k}").drop(f"i{k}").withColumnRenamed(f"t{k}", f"i{k}")
    return vertices.join(moved.where("v = to").select("v"), "v", "left_semi"), out.select("f", "i0", "i1", "i2")


def vertex_adjacency(faces: DataFrame) -> DataFrame:
    """(row, col, val): 1 for every edge, both ways."""
    e = unique_edges(faces).where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return both_ways(e).select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(1.0).alias("val"))


def submesh(vertices: DataFrame, faces: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The faces (f) of ``chosen``, and the vertices that they use, renumbered as by ``compact``."""
    return compact(vertices, faces.join(chosen.select("f").distinct(), "f", "left_semi"))


def submesh_of_vertices(vertices: DataFrame, faces: DataFrame, chosen: DataFrame, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """The faces of which all, or any, vertices are chosen (v), renumbered as by ``compact``."""
    return submesh(vertices, faces, faces_of_vertices(faces, chosen, mode))


def submeshes(vertices: DataFrame, faces: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For groups (g, f) of faces: the vertices (g, v, x, y, z) and faces (g, f, i0, i1, i2) of each; ids stay, a face may be in several."""
    own = faces.join(groups.select("g", "f").distinct(), "f")
    used = own.select("g", F.explode(F.array("i0", "i1", "i2")).alias("v")).distinct()
    return used.join(vertices.select("v", "x", "y", "z"), "v"), own.select("g", "f", "i0", "i1", "i2")


def split_components(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The connected parts of a mesh as ``submeshes``, named by their least face."""
    from .graph import face_components

    return submeshes(vertices, faces, face_components(faces).select(F.col("label").alias("g"), "f"))
