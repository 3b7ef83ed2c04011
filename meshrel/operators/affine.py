"""Affine transforms: matrices on the driver (4 x 4, row by row), and their application to tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = np.ndarray


def as_matrix(matrix) -> Matrix:
    """A 4 x 4 matrix of doubles from 3 x 3, 3 x 4 or 4 x 4 numbers."""
    m = np.asarray(matrix, float)
    if m.shape not in ((3, 3), (3, 4), (4, 4)):
        raise ValueError(f"no affine matrix has the shape {m.shape}")
    out = np.eye(4)
    out[: m.shape[0], : m.shape[1]] = m
    return out


def translation_matrix(offset) -> Matrix:
    out = np.eye(4)
    out[:3, 3] = offset
    return out


def scale_matrix(factors, center=None) -> Matrix:
    """Scaling by one factor or three about ``center``, the origin by default."""
    linear = np.diag(np.broadcast_to(np.asarray(factors, float), 3))
    return _about(linear, center)


def reflection_matrix(normal, center=None) -> Matrix:
    """Reflection through the plane with the given normal and point."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    return _about(np.eye(3) - 2 * np.outer(n, n), center)


def _about(linear: np.ndarray, center) -> Matrix:
    at = np.zeros(3) if center is None else np.asarray(center, float)
    out = as_matrix(linear)
    out[:3, 3] = at - linear @ at
    return out


def normal_matrix(matrix) -> np.ndarray:
    """The inverse transpose of the linear block: the map that carries normals."""
    return np.linalg.inv(as_matrix(matrix)[:3, :3]).T


def transform_scale(matrix) -> float:
    """The uniform scale factor: the cube root of the volume's."""
    return float(abs(np.linalg.det(as_matrix(matrix)[:3, :3])) ** (1 / 3))


def reverses_orientation(matrix) -> bool:
    return bool(np.linalg.det(as_matrix(matrix)[:3, :3]) < 0)


def classify_transform(matrix, rtol: float = 1e-5) -> str:
    """``rigid`` if lengths are kept, ``reflection`` if mirrored too, ``similarity`` if angles are, else ``affine``."""
    linear = as_matrix(matrix)[:3, :3]
    square = linear.T @ linear
    scale = np.trace(square) / 3
    if scale <= 0 or np.abs(square - scale * np.eye(3)).max() > rtol * scale:
        return "affine"
    if abs(scale - 1) > rtol:
        return "similarity"
    return "reflection" if reverses_orientation(matrix) else "rigid"


def _mapped(linear, offset=(0.0, 0.0, 0.0)):
    return [sum((F.col(x) * float(linear[i][j]) for j, x in enumerate("xyz")), F.lit(float(offset[i]))) for i in range(3)]


def transform_points(points: DataFrame, matrix) -> DataFrame:
    m = as_matrix(matrix)
    return points.withColumns(dict(zip("xyz", _mapped(m[:3, :3], m[:3, 3]))))


def transform_vectors(vectors: DataFrame, matrix) -> DataFrame:
    """Directions: the linear block alone."""
    return vectors.withColumns(dict(zip("xyz", _mapped(as_matrix(matrix)[:3, :3]))))


def transform_normals(normals: DataFrame, matrix) -> DataFrame:
    """Unit normals by the inverse transpose, of unit length again; zero ones stay zero."""
    out = normals.withColumns(dict(zip("xyz", _mapped(normal_matrix(matrix)))))
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return out.withColumns({x: F.when(size > 1e-12, F.col(x) / size).otherwise(0.0) for x in "xyz"})


def transform_mesh(vertices: DataFrame, faces: DataFrame, matrix) -> tuple[DataFrame, DataFrame]:
    """Both tables; faces turn round if the transform mirrors, so that normals stay outward."""
    if reverses_orientation(matrix):
        faces = faces.withColumns({"i1": F.col("i2"), "i2": F.col("i1")})
    return transform_points(vertices, matrix), faces
