"""Polylines (line_id, pos, x, y, z) in order of pos: segments, centroids, normals, angles, resampling, simplification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import ZERO, _cross, _dot, _norm, _vec

LINE = "line_id long, pos long, x double, y double, z double"


def _in_order():
    return W.partitionBy("line_id").orderBy("pos")


def _whole():
    return _in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def ends(lines: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(line_id, n, closed): the number of points, and whether the first and the last, of two or more, are at one place."""
    at = lambda f, name: f(F.struct("pos", "x", "y", "z")).alias(name)
    e = lines.groupBy("line_id").agg(F.count("*").alias("n"), at(F.min, "a"), at(F.max, "b"))
    near = F.lit(True)
    for x in "xyz":
        near &= F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")) <= atol + rtol * F.abs(F.col(f"b.{x}"))
    return e.select("line_id", "n", ((F.col("n") >= 2) & near).alias("closed"))


def close_lines(lines: DataFrame) -> DataFrame:
    """Lines that end where they begin: the first point is put after the last where it is not there already."""
    edge = lines.groupBy("line_id").agg(F.min(F.struct("pos", "x", "y", "z")).alias("a"), F.max("pos").alias("end"))
    extra = edge.join(ends(lines).where("not closed and n >= 2"), "line_id").select("line_id", (F.col("end") + 1).alias("pos"), "a.x", "a.y", "a.z")
    return lines.select("line_id", "pos", "x", "y", "z").unionByName(extra)


def open_lines(lines: DataFrame) -> DataFrame:
    """Lines without a last point that repeats the first."""
    last = lines.groupBy("line_id").agg(F.max("pos").alias("pos")).join(ends(lines).where("closed").select("line_id"), "line_id")
    return lines.join(last, ["line_id", "pos"], "left_anti")


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, pos, ax, ay, az, bx, by, bz, length) from each point to the next."""
    s = lines.select("line_id", "pos", *[F.col(x).alias("a" + x) for x in "xyz"], *[F.lead(x).over(_in_order()).alias("b" + x) for x in "xyz"], F.lead("pos").over(_in_order()).alias("to"))
    return s.where("to is not null").drop("to").withColumn("length", _norm(_vec("a", "b")))


def centroids(lines: DataFrame) -> DataFrame:
    """(line_id, x, y, z): midpoints of segments weighted by length; null for a line without length."""
    s = segments(lines)
    total = F.sum("length")
    return s.groupBy("line_id").agg(*[(F.sum((F.col("a" + x) + F.col("b" + x)) / 2 * F.col("length")) / F.when(total > 0, total)).alias(x) for x in "xyz"])


def normals(lines: DataFrame) -> DataFrame:
    """(line_id, x, y, z): Newell's unit normal of the closed line; zero if the line spans no plane."""
    first = W.partitionBy("line_id").orderBy("pos")
    loop = lines.select("line_id", *[F.col(x).alias("a" + x) for x in "xyz"], *[F.coalesce(F.lead(x).over(first), F.first(x).over(_whole())).alias("b" + x) for x in "xyz"])
    c = _cross([F.col("a" + x) for x in "xyz"], [F.col("b" + x) for x in "xyz"])
    sums = loop.groupBy("line_id").agg(*[F.sum(v).alias("n" + x) for v, x in zip(c, "xyz")])
    size = _norm([F.col("n" + x) for x in "xyz"])
    return sums.select("line_id", *[F.when(size > ZERO, F.col("n" + x) / size).otherwise(0.0).alias(x) for x in "xyz"])


def turning_angles(lines: DataFrame) -> DataFrame:
    """(line_id, pos, angle) between the segments before and after each point; 0 at the ends of an open line.

    On a closed one both ends have the angle of the last segment to the first.
    """
    o = _in_order()
    at = lines.join(ends(lines).select("line_id", "closed"), "line_id")
    near = at.select("line_id", "pos", "closed", "x", "y", "z", *[F.lag(x).over(o).alias("a" + x) for x in "xyz"], *[F.lead(x).over(o).alias("b" + x) for x in "xyz"], *[F.nth_value(x, 2).over(_whole()).alias("s" + x) for x in "xyz"])
    near = near.withColumns({"l" + x: F.last("a" + x).over(_whole()) for x in "xyz"})
    for x in "xyz":
        near = near.withColumn("p" + x, F.col(x)).withColumn("f" + x, F.when(F.col("closed") & F.col("ax").isNull(), F.col("l" + x)).otherwise(F.col("a" + x))).withColumn("t" + x, F.when(F.col("closed") & F.col("bx").isNull(), F.col("s" + x)).otherwise(F.col("b" + x)))
    u, v = _vec("f", "p"), _vec("p", "t")
    return near.select("line_id", "pos", F.coalesce(F.atan2(_norm(_cross(u, v)), _dot(u, v)), F.lit(0.0)).alias("angle"))


def upsample(lines: DataFrame, step: float, method: str = "floor") -> DataFrame:
    """(line_id, pos, part, x, y, z): segments in equal pieces, at least ``step`` long (floor), or at most (bisect).

    The last point of a line is not among them; a line of one point stays.
    """
    s = segments(lines)
    if method == "floor":
        pieces = F.greatest(F.floor(F.col("length") / step), F.lit(1))
    elif method == "bisect":
        pieces = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.greatest(F.col("length"), F.lit(ZERO)) / step)), F.lit(0)))
    else:
        raise ValueError(f"no such method: {method}")
    s = s.withColumn("n", pieces.cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    out = s.select("line_id", "pos", "part", *[(F.col("a" + x) + (F.col("b" + x) - F.col("a" + x)) * F.col("part") / F.col("n")).alias(x) for x in "xyz"])
    single = lines.join(ends(lines).where("n = 1").select("line_id"), "line_id", "left_semi")
    return out.unionByName(single.select("line_id", "pos", F.lit(0).cast("long").alias("part"), "x", "y", "z"))


def resample(lines: DataFrame, count: int) -> DataFrame:
    """(line_id, k, x, y, z): ``count`` points evenly along each line's length, both ends among them.

    Each segment makes the points that fall on it, so nothing but running lengths crosses segments.
    """
    s = segments(lines)
    upto = F.sum("length").over(_in_order().rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("end", upto).withColumn("start", F.coalesce(F.lag("end").over(_in_order()), F.lit(0.0)))
    s = s.withColumn("total", F.last("end").over(_whole())).withColumn("final", F.lead("pos").over(_in_order()).isNull()).where("total > 0")
    spot = lambda c: F.ceil(F.col(c) * (count - 1) / F.col("total"))
    s = s.withColumn("k0", spot("start")).withColumn("k1", F.when(F.col("final"), F.lit(count - 1)).otherwise(spot("end") - 1)).where("k1 >= k0")
    s = s.withColumn("k", F.explode(F.sequence("k0", "k1")))
    t = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") * F.col("total") / max(1, count - 1) - F.col("start")) / F.col("length")))).otherwise(0.0)
    out = s.select("line_id", "k", *[(F.col("a" + x) + (F.col("b" + x) - F.col("a" + x)) * t).alias(x) for x in "xyz"])
    still = lines.groupBy("line_id").agg(F.min(F.struct("pos", "x", "y", "z")).alias("p")).join(s.select("line_id").distinct(), "line_id", "left_anti")
    return out.unionByName(still.select("line_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("k"), "p.x", "p.y", "p.z"))


def radii(lines: DataFrame, center: tuple, normal: tuple) -> DataFrame:
    """(line_id, least, greatest, mean, middle): distances of segments from ``center`` within the plane across ``normal``."""
    n = np.array(normal, float) / np.linalg.norm(normal)
    s = segments(lines)
    for k in "ab":
        off = [F.col(k + x) - float(c) for x, c in zip("xyz", center)]
        along = sum((o * float(m) for o, m in list(zip(off, n))[1:]), off[0] * float(n[0]))
        s = s.withColumns({f"{k}{x}": o - along * float(m) for x, o, m in zip("xyz", off, n)})
    side = _vec("a", "b")
    t = -_dot([F.col("a" + x) for x in "xyz"], side) / F.greatest(_dot(side, side), F.lit(ZERO**2))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    s = s.select("line_id", _norm([F.col("a" + x) + t * side[i] for i, x in enumerate("xyz")]).alias("d"))
    return s.groupBy("line_id").agg(F.min("d").alias("least"), F.max("d").alias("greatest"), F.avg("d").alias("mean"), F.median("d").alias("middle"))


def segment_distances(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(p, line_id, d): of points (p, line_id, x, y, z), each to the nearest segment of its own line."""
    s = segments(lines).join(points.select("p", "line_id", *[F.col(x).alias("p" + x) for x in "xyz"]), "line_id")
    side = _vec("a", "b")
    t = _dot(_vec("a", "p"), side) / F.greatest(_dot(side, side), F.lit(ZERO**2))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = _norm([F.col("p" + x) - F.col("a" + x) - t * side[i] for i, x in enumerate("xyz")])
    best = s.select("p", "line_id", d.alias("d")).groupBy("p", "line_id").agg(F.min("d").alias("d"))
    return points.select("p", "line_id").join(best, ["p", "line_id"], "left").select("p", "line_id", F.coalesce("d", F.lit(float("inf"))).alias("d"))


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """The points that Ramer, Douglas and Peucker keep: each split at the point farthest from the chord's segment, if beyond ``tolerance``.

    A line is the unit of work and must fit a task; lines are independent.
    """

    def keep(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("pos", kind="stable")
        p = line[["x", "y", "z"]].to_numpy()
        kept = np.zeros(len(p), bool)
        kept[[0, -1]] = True
        todo = [(0, len(p) - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2:
                continue
            chord, off = p[hi] - p[lo], p[lo + 1 : hi] - p[lo]
            square = float(chord @ chord)
            t = np.clip(off @ chord / square, 0, 1) if square > 0 else np.zeros(len(off))
            d = np.sqrt(((off - t[:, None] * chord) ** 2).sum(1))
            far = int(d.argmax())
            if d[far] > tolerance:
                kept[lo + 1 + far] = True
                todo += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
        return line[kept]

    return lines.selectExpr("cast(line_id as long) line_id", "cast(pos as long) pos", "x", "y", "z").groupBy("line_id").applyInPandas(keep, LINE)


def downsample(lines: DataFrame, step: float) -> DataFrame:
    """The first point of each line and every next one at least ``step`` of length beyond the one kept before."""

    def keep(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("pos", kind="stable")
        p = line[["x", "y", "z"]].to_numpy()
        arc = np.concatenate(([0.0], np.cumsum(np.sqrt((np.diff(p, axis=0) ** 2).sum(1)))))
        kept, at = [], 0
        while at < len(p):
            kept.append(at)
            at = max(at + 1, int(np.searchsorted(arc, arc[at] + step, "left")))
        return line.iloc[kept]

    return lines.selectExpr("cast(line_id as long) line_id", "cast(pos as long) pos", "x", "y", "z").groupBy("line_id").applyInPandas(keep, LINE)
