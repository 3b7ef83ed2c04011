"""Reads folders of OBJ, OFF, PLY and STL files as relations; one file is one mesh and one task's unit of work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: PLY scalar types, as NumPy's.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
VERTICES = "mesh_id string, v long, x double, y double, z double"
FACES = "mesh_id string, f long, i0 long, i1 long, i2 long"


def _fans(polygons: list) -> np.ndarray:
    """Polygons as triangles around their first corners."""
    out = [(p[0], p[k], p[k + 1]) for p in polygons for k in range(1, len(p) - 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def parse_obj(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    points, polygons = [], []
    for line in data.decode("utf-8", "replace").replace("\\\n", " ").splitlines():
        part = line.split("#", 1)[0].split()
        if part[:1] == ["v"]:
            points.append([float(x) for x in part[1:4]])
        elif part[:1] == ["f"]:
            at = [int(x.split("/", 1)[0]) for x in part[1:]]
            polygons.append([a - 1 if a > 0 else len(points) + a for a in at])
    return np.array(points, float).reshape(-1, 3), _fans(polygons)


def parse_off(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = [w for line in data.decode("utf-8", "replace").splitlines() for w in line.split("#", 1)[0].split()]
    if words[:1] and words[0].upper() == "OFF":
        words = words[1:]
    n, m = int(words[0]), int(words[1])
    points = np.array(words[3 : 3 + 3 * n], float).reshape(-1, 3)
    # Colours may follow a face, so faces are read line by line where there are lines.
    lines = [x for x in (line.split("#", 1)[0].split() for line in data.decode("utf-8", "replace").splitlines()) if x][-m:] if m else []
    return points, _fans([[int(x) for x in part[1 : 1 + int(part[0])]] for part in lines])


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = data.index(b"end_header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "ascii", []
    for line in data[:end].decode().splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            kind = part[1]
        elif part[:1] == ["element"]:
            elements.append((part[1], int(part[2]), []))
        elif part[:1] == ["property"]:
            elements[-1][2].append(part[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    words, at = body.split() if kind == "ascii" else None, 0

    def take(code: str, n: int) -> np.ndarray:
        nonlocal at
        if words is not None:
            out = np.array(words[at : at + n], float)
            at += n
        else:
            out = np.frombuffer(body, order + code, n, at)
            at += out.nbytes
        return out

    points, polygons = np.zeros((0, 3)), []
    for name, count, fields in elements:
        flat = all(f[0] != "list" for f in fields)
        if flat and words is None:
            table = np.frombuffer(body, np.dtype([(f[1], order + PLY_TYPES[f[0]]) for f in fields]), count, at)
            at += table.nbytes
            columns = {f[1]: table[f[1]] for f in fields}
        elif flat:
            columns = dict(zip([f[1] for f in fields], take("f8", count * len(fields)).reshape(count, -1).T))
        else:
            for _ in range(count):
                for f in fields:
                    n = int(take(PLY_TYPES[f[1]], 1)[0]) if f[0] == "list" else 1
                    values = take(PLY_TYPES[f[2] if f[0] == "list" else f[0]], n)
                    if name == "face" and f[-1] in ("vertex_indices", "vertex_index"):
                        polygons.append([int(v) for v in values])
            continue
        if name == "vertex":
            points = np.stack([np.asarray(columns[x], float) for x in "xyz"], 1)
    return points, _fans(polygons)


def parse_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Corners at one place become one vertex, in order of their coordinates."""
    n = int.from_bytes(data[80:84], "little") if len(data) >= 84 else -1
    if n >= 0 and len(data) == 84 + 50 * n:
        rows = np.frombuffer(data, np.dtype([("normal", "<f4", 3), ("at", "<f4", (3, 3)), ("rest", "<u2")]), n, 84)
        soup = rows["at"].reshape(-1, 3).astype(float)
    else:
        soup = np.array([line.split()[1:4] for line in data.decode("utf-8", "replace").splitlines() if line.split()[:1] == ["vertex"]], float).reshape(-1, 3)
    points, at = np.unique(soup, axis=0, return_inverse=True)
    return points, np.asarray(at, np.int64).reshape(-1, 3)


PARSERS = {"obj": parse_obj, "off": parse_off, "ply": parse_ply, "stl": parse_stl}


def _rows(part: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = PARSERS[path.rsplit(".", 1)[-1].lower()](bytes(content))[part]
                names = ("v", "x", "y", "z") if part == 0 else ("f", "i0", "i1", "i2")
                yield pd.DataFrame({"mesh_id": path.rsplit("/", 1)[-1], names[0]: np.arange(len(found)), **{n: found[:, k] for k, n in enumerate(names[1:])}})

    return read


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of every mesh file under ``path``, keyed by ``mesh_id``, the file's name; other files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.where("lower(regexp_extract(path, '[.]([^./]*)$', 1)) in ('obj', 'off', 'ply', 'stl')")
    return files.mapInPandas(_rows(0), VERTICES), files.mapInPandas(_rows(1), FACES)


def mesh_from_arrays(spark: SparkSession, points, faces) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of arrays of three columns, or of a flat array of corners."""
    points, faces = np.asarray(points, float).reshape(-1, 3), np.asarray(faces, np.int64).reshape(-1, 3)
    v = pd.DataFrame({"v": np.arange(len(points)), **{x: points[:, k] for k, x in enumerate("xyz")}})
    f = pd.DataFrame({"f": np.arange(len(faces)), **{f"i{k}": faces[:, k] for k in range(3)}})
    return spark.createDataFrame(v, "v long, x double, y double, z double"), spark.createDataFrame(f, "f long, i0 long, i1 long, i2 long")
