"""Boxes: unions, diagonals, points in oriented boxes, and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import aabb


def aabb_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the smallest box around two boxes (min_x .. max_z)."""
    names = [f"{k}_{x}" for k in ("min", "max") for x in "xyz"]
    both = a.select(*names).unionByName(b.select(*names))
    return both.agg(*[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in names])


def enclosing_diagonal(points: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """One row: the diagonal of the box around one or two sets of points; infinite without points."""
    points = points.select("x", "y", "z")
    whole = points if other is None else points.unionByName(other.select("x", "y", "z"))
    return aabb(whole).select(F.coalesce("diagonal", F.lit(float("inf"))).alias("diagonal"))


def box_diagonal(low: tuple, high: tuple) -> float:
    return sum((b - a) ** 2 for a, b in zip(low, high)) ** 0.5


def _inside(rotation, low: tuple, high: tuple) -> Column:
    """Whether (x, y, z), turned into the box's frame by the rows of ``rotation``, lies between the corners."""
    out = F.lit(True)
    for axis, a, b in zip(rotation, low, high):
        along = F.col("x") * float(axis[0]) + F.col("y") * float(axis[1]) + F.col("z") * float(axis[2])
        out = out & along.between(float(a), float(b))
    return out


UPRIGHT = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def points_in_obb_mask(points: DataFrame, rotation, low: tuple, high: tuple) -> DataFrame:
    """``points`` with ``inside``; the box's faces are inside."""
    return points.withColumn("inside", _inside(rotation, low, high))


def crop_points(points: DataFrame, low: tuple, high: tuple, rotation=UPRIGHT) -> DataFrame:
    """The points inside a box; their ids tell where they came from."""
    return points.where(_inside(rotation, low, high))


def crop_mesh(vertices: DataFrame, faces: DataFrame, low: tuple, high: tuple, rotation=UPRIGHT) -> tuple[DataFrame, DataFrame]:
    """The faces whose three vertices lie inside a box, and the vertices that they use; ids stay."""
    kept = crop_points(vertices, low, high, rotation).select("v")
    for k in range(3):
        faces = faces.join(kept.withColumnRenamed("v", f"i{k}"), f"i{k}", "left_semi")
    used = faces.select(F.explode(F.array("i0", "i1", "i2")).alias("v")).distinct()
    return vertices.join(used, "v", "left_semi"), faces
