"""Point clouds (p, x, y, z): planes, moments, frames, outliers, samples, orders along space-filling curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import component_labels, settle
from .spatial import ball_join, knn_join

GOLDEN = math.pi * (3 - math.sqrt(5))


def _along(direction, columns=("x", "y", "z"), origin=(0.0, 0.0, 0.0)):
    return sum(((F.col(c) - float(o)) * float(d) for c, d, o in list(zip(columns, direction, origin))[1:]), (F.col(columns[0]) - float(origin[0])) * float(direction[0]))


def plane_distances(points: DataFrame, normal: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """(p, d, above): the signed distance to a plane, and whether a point is strictly on the normal's side."""
    size = math.sqrt(sum(n * n for n in normal))
    d = _along([n / size for n in normal], origin=origin)
    return points.select("p", d.alias("d"), (d > 0).alias("above"))


def plane_basis(normal: tuple) -> tuple[tuple, tuple]:
    """Unit (u, v) with (u, v, normal) right-handed: u is across the axis least along the normal."""
    n = np.array(normal, float) / np.linalg.norm(normal)
    axis = np.eye(3)[int(np.argmin(np.abs(n)))]
    u = np.cross(axis, n)
    u /= np.linalg.norm(u)
    return tuple(u), tuple(np.cross(n, u))


def second_moments(points: DataFrame) -> DataFrame:
    """One row: n, the centroid, the sums of products about the origin (gxx ..) and about the centroid (sxx ..)."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("y", "z"), ("x", "z")]
    return points.agg(F.count("*").alias("n"), *[F.avg(x).alias("c" + x) for x in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"g{a}{b}") for a, b in pairs], *[(F.covar_pop(a, b) * F.count("*")).alias(f"s{a}{b}") for a, b in pairs])


def principal_axes(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., cx, cy, cz, e0, e1, e2, a00 .. a22): axes as rows of a rotation, the widest first, with their scatters.

    Sums per group are combined before the shuffle; only one row a group meets the eigensolver.
    """
    by = by or []
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("y", "z"), ("x", "z")]
    sums = points.groupBy(*by).agg(*[F.avg(x).alias("c" + x) for x in "xyz"], *[(F.covar_pop(a, b) * F.count("*")).alias(f"s{a}{b}") for a, b in pairs])
    axes = [f"a{i}{j}" for i in range(3) for j in range(3)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in by], *[f"{c} double" for c in ("cx", "cy", "cz", "e0", "e1", "e2", *axes)]])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.empty((len(b), 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    m[:, i, j] = b[f"s{p}{q}" if f"s{p}{q}" in b else f"s{q}{p}"]
            values, vectors = np.linalg.eigh(np.nan_to_num(m))
            values, rows = values[:, ::-1], np.swapaxes(vectors, 1, 2)[:, ::-1, :].copy()
            rows[np.linalg.det(rows) < 0, 2] *= -1
            out = b[[*by, "cx", "cy", "cz"]].copy()
            for k in range(3):
                out[f"e{k}"] = values[:, k]
            for k, name in enumerate(axes):
                out[name] = rows[:, k // 3, k % 3]
            yield out

    return sums.mapInPandas(solve, schema)


def fit_planes(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., nx, ny, nz, cx, cy, cz): the normal of least scatter, of either sign, and the centroid."""
    return principal_axes(points, by).select(*(by or []), *[F.col(f"a2{k}").alias("n" + x) for k, x in enumerate("xyz")], "cx", "cy", "cz")


def estimate_normals(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(p, nx, ny, nz): normals of the planes through each point's k nearest, towards the outside of the centroid."""
    near = knn_join(points.withColumnRenamed("p", "q"), points, k, radius).join(points, "p").select("q", "x", "y", "z")
    planes = fit_planes(near, ["q"]).select(F.col("q").alias("p"), "nx", "ny", "nz")
    middle = points.agg(*[F.avg(x).alias("m" + x) for x in "xyz"])
    wide = points.join(planes, "p").crossJoin(F.broadcast(middle))
    out = sum((F.col("n" + x) * (F.col(x) - F.col("m" + x)) for x in "yz"), F.col("nx") * (F.col("x") - F.col("mx")))
    return wide.select("p", *[(F.when(out < 0, F.lit(-1.0)).otherwise(1.0) * F.col("n" + x)).alias("n" + x) for x in "xyz"])


def duplicate_mask(points: DataFrame) -> DataFrame:
    """(p, duplicate): whether a point of a lesser p has the very same place."""
    same = W.partitionBy(*[F.col(x) + 0.0 for x in "xyz"]).orderBy("p")
    return points.select("p", (F.row_number().over(same) > 1).alias("duplicate"))


def finite_mask(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for x in "xyz":
        ok &= ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    return points.select("p", F.coalesce(ok, F.lit(False)).alias("finite"))


def statistical_outliers(points: DataFrame, k: int, radius: float, ratio: float = 2.0) -> DataFrame:
    """(p, outlier): mean distance to the k nearest, itself among them, over the cloud's mean by ``ratio`` deviations, or zero."""
    mean = knn_join(points.withColumnRenamed("p", "q"), points, k, radius).groupBy(F.col("q").alias("p")).agg(F.avg("d").alias("mean"))
    bound = mean.agg((F.avg("mean") + ratio * F.stddev_samp("mean")).alias("bound"))
    return mean.crossJoin(F.broadcast(bound)).select("p", ((F.col("mean") > F.col("bound")) | (F.col("mean") <= 0)).alias("outlier"))


def radius_outliers(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(p, outlier): whether no more than ``least`` points, itself among them, lie within ``radius``."""
    near = ball_join(points.withColumnRenamed("p", "q"), points, radius).groupBy(F.col("q").alias("p")).agg(F.count("*").alias("n"))
    return points.select("p").join(near, "p", "left").select("p", (F.coalesce("n", F.lit(0)) <= least).alias("outlier"))


def cluster_outliers(points: DataFrame, radius: float, most: int = 20) -> DataFrame:
    """(p, outlier): whether the points linked within ``radius``, step by step, are no more than ``most``."""
    pairs = ball_join(points.withColumnRenamed("p", "q"), points, radius).where("q < p").select(F.col("q").alias("a"), F.col("p").alias("b"))
    label = component_labels(pairs, points.select(F.col("p").alias("v")))
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    return label.join(sizes, "label").select(F.col("v").alias("p"), (F.col("n") <= most).alias("outlier"))


def outlier_probabilities(points: DataFrame, k: int, radius: float, scale: float = 3.0) -> DataFrame:
    """(p, probability): local outlier probability of Kriegel et al. over the k nearest, itself among them."""
    near = settle(knn_join(points.withColumnRenamed("p", "q"), points, k, radius))
    spread = near.groupBy("q").agg(F.sqrt(F.avg(F.col("d") ** 2)).alias("sigma"))
    around = near.join(spread.select(F.col("q").alias("p"), F.col("sigma").alias("s")), "p").groupBy("q").agg(F.avg("s").alias("around"))
    plof = spread.join(around, "q").select("q", F.when(F.col("around") > 0, F.col("sigma") / F.col("around") - 1).otherwise(0.0).alias("plof"))
    norm = plof.agg((scale * F.sqrt(F.avg(F.col("plof") ** 2))).alias("norm"))

    @F.pandas_udf("double")
    def erf(x: pd.Series) -> pd.Series:
        return pd.Series([math.erf(v) for v in x], dtype=float)

    wide = plof.crossJoin(F.broadcast(norm))
    return wide.select(F.col("q").alias("p"), F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), erf(F.col("plof") / (F.col("norm") * math.sqrt(2))))).otherwise(0.0).alias("probability"))


def farthest_points(points: DataFrame, count: int, start: int) -> DataFrame:
    """(rank, p): ``start``, then each time the point farthest from those picked, the least p on a tie.

    A round is one aggregate over the running distances; they are written every few rounds.
    """
    spark = points.sparkSession
    picked, state = [start], settle(points.select("p", "x", "y", "z").withColumn("d", F.lit(float("inf"))))
    at = state.where(F.col("p") == start).first()
    while len(picked) < count:
        gap = sum(((F.col(x) - float(at[x])) ** 2 for x in "yz"), (F.col("x") - float(at["x"])) ** 2)
        state = state.withColumn("d", F.least("d", gap))
        if len(picked) % 16 == 0:
            state = settle(state)
        at = state.agg(F.max(F.struct("d", (-F.col("p")).alias("q"), "x", "y", "z")).alias("top")).select("top.*").first()
        picked.append(-at["q"])
    return spark.createDataFrame(list(enumerate(picked[:count])), "rank long, p long")


def fibonacci_directions(spark: SparkSession, count: int, half_angle: float = math.pi) -> DataFrame:
    """(i, x, y, z): unit vectors at golden angles, evenly down a cone around +z; pi is the sphere."""
    z = 1 - (1 - math.cos(half_angle)) * (F.col("id") + 0.5) / count
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    turn = F.col("id") * GOLDEN
    return spark.range(count).select(F.col("id").alias("i"), (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def convex_subset(points: DataFrame, directions: int = 128) -> DataFrame:
    """(p) of the points farthest along some of the directions of a half sphere, or against it: corners of the hull."""
    spread = fibonacci_directions(points.sparkSession, directions, math.pi / 2).agg(F.collect_list(F.struct("i", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))).alias("all"))
    dots = points.crossJoin(F.broadcast(spread)).select("p", "x", "y", "z", F.inline("all")).select("i", "p", (F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")).alias("dot"))
    ends = dots.groupBy("i").agg(F.min("dot").alias("low"), F.max("dot").alias("high"))
    return dots.join(F.broadcast(ends), "i").where("dot = low or dot = high").select("p").distinct()


def radial_angles(points: DataFrame, origin: tuple, normal: tuple, start: tuple) -> DataFrame:
    """(p, angle) around an axis, counter-clockwise from ``start``; the radial order is that of falling angles."""
    n = np.array(normal, float) / np.linalg.norm(normal)
    u = np.array(start, float) - n * float(np.dot(n, start))
    u /= np.linalg.norm(u)
    v = np.cross(n, u)
    return points.select("p", F.atan2(_along(v, origin=origin), _along(u, origin=origin)).alias("angle"))


def morton_codes(cells: DataFrame, bits: int) -> DataFrame:
    """``cells`` (i, j, k, ...) with ``code``: their bits interleaved, i lowest."""
    code = F.lit(0).cast("long")
    for b in range(bits):
        for a, c in enumerate("ijk"):
            code = code + F.shiftleft(F.shiftright(F.col(c).cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + a)
    return cells.withColumn("code", code)


def morton_cells(codes: DataFrame, bits: int) -> DataFrame:
    """``codes`` (code, ...) with the cell (i, j, k) of each."""
    out = codes
    for a, c in enumerate("ijk"):
        value = F.lit(0).cast("long")
        for b in range(bits):
            value = value + F.shiftleft(F.shiftright(F.col("code"), 3 * b + a).bitwiseAND(F.lit(1).cast("long")), b)
        out = out.withColumn(c, value)
    return out


def _hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Indices along the Hilbert curve by Skilling's transform (2004); axes: three rows of coordinates."""
    x = axes.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for a in range(3):
            on = (x[a] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(on, low, 0) ^ swap
            x[a] ^= swap
        q >>= 1
    for a in (1, 2):
        x[a] ^= x[a - 1]
    fold = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fold ^= np.where((x[2] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fold
    code = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for a in range(3):
            code = (code << 1) | ((x[a] >> b) & 1)
    return code


def hilbert_codes(cells: DataFrame, bits: int) -> DataFrame:
    """``cells`` (i, j, k, ...) with ``code`` along the Hilbert curve through a cube of 2 ** bits."""

    @F.pandas_udf("long")
    def code(i: pd.Series, j: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(_hilbert(np.stack([i, j, k]), bits))

    return cells.withColumn("code", code("i", "j", "k"))


def procrustes(pairs: DataFrame, reflection: bool = True, scale: bool = True) -> DataFrame:
    """One row (m00 .. m23, cost): the similarity that takes (ax, ay, az) closest to (bx, by, bz), by squared distance.

    Sums of products are one aggregate; a 3 x 3 singular value decomposition of that row gives the rotation.
    """
    a, b = ["ax", "ay", "az"], ["bx", "by", "bz"]
    sums = pairs.agg(*[F.avg(c).alias("m" + c) for c in a + b], *[F.covar_pop(p, q).alias(f"{p}{q}") for p in a for q in b], *[F.var_pop(c).alias("v" + c) for c in a + b])
    names = [f"m{i}{j}" for i in range(3) for j in range(4)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for r in t.to_dict("records"):
                h = np.array([[r[f"{p}{q}"] for p in a] for q in b])
                u, s, vt = np.linalg.svd(h)
                if not reflection and np.linalg.det(u @ vt) < 0:
                    u[:, 2] *= -1
                    s[2] *= -1
                turn, spread = u @ vt, sum(r["v" + c] for c in a)
                factor = s.sum() / spread if scale and spread > 0 else 1.0
                middle = [np.array([r["m" + c] for c in side]) for side in (a, b)]
                m = np.hstack([factor * turn, (middle[1] - factor * turn @ middle[0])[:, None]])
                cost = factor**2 * spread + sum(r["v" + c] for c in b) - 2 * factor * s.sum()
                rows.append([*m.ravel(), max(0.0, cost)])
            yield pd.DataFrame(rows, columns=[*names, "cost"])

    return sums.mapInPandas(solve, ", ".join(f"{n} double" for n in [*names, "cost"]))
