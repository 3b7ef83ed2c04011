"""Voxel sets (i, j, k): morphology, fills, resampling, boxes, codes; scattering onto and reading from lattices."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import component_labels
from .selection import dense_ids

KEYS = list("ijk")
_BIAS = 1 << 20


def offsets(connectivity: int = 6) -> list[tuple[int, int, int]]:
    """The steps to the 6, 18 or 26 neighbours of a cell."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]


def _shifted(cells: DataFrame, steps: list) -> DataFrame:
    """Each cell at each step, with the cell it came from as oi, oj, ok."""
    moved = [F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(KEYS, o)], *[F.col(c).alias("o" + c) for c in KEYS]) for o in steps]
    return cells.select(F.inline(F.array(*moved)))


def dilate(cells: DataFrame, connectivity: int = 6, iterations: int = 1) -> DataFrame:
    steps = [(0, 0, 0), *offsets(connectivity)]
    for _ in range(iterations):
        cells = _shifted(cells, steps).select(*KEYS).distinct()
    return cells


def erode(cells: DataFrame, connectivity: int = 6, iterations: int = 1) -> DataFrame:
    """The cells whose whole neighbourhood is there."""
    steps = offsets(connectivity)
    for _ in range(iterations):
        held = _shifted(cells, steps).join(cells, KEYS, "left_semi").groupBy("oi", "oj", "ok").agg(F.count("*").alias("n"))
        cells = held.where(F.col("n") == len(steps)).select(*[F.col("o" + c).alias(c) for c in KEYS])
    return cells


def closing(cells: DataFrame, connectivity: int = 6, iterations: int = 1) -> DataFrame:
    return erode(dilate(cells, connectivity, iterations), connectivity, iterations)


def opening(cells: DataFrame, connectivity: int = 6, iterations: int = 1) -> DataFrame:
    return dilate(erode(cells, connectivity, iterations), connectivity, iterations)


def surface(cells: DataFrame, connectivity: int = 6) -> DataFrame:
    """The cells with an empty neighbour."""
    return cells.join(erode(cells, connectivity), KEYS, "left_anti")


def fill_orthographic(cells: DataFrame) -> DataFrame:
    """The cells that lie between two cells, or at one, along all three axes.

    Spans along one axis are laid out; the spans of the other two only test them.
    """
    span = lambda axis: cells.groupBy(*[c for c in KEYS if c != axis]).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    out = span("i").select(F.explode(F.sequence("lo", "hi")).alias("i"), "j", "k")
    for axis in "jk":
        out = out.join(span(axis), [c for c in KEYS if c != axis]).where(F.col(axis).between(F.col("lo"), F.col("hi"))).select(*KEYS)
    return out


def fill_cavities(cells: DataFrame) -> DataFrame:
    """The cells and every empty one that no path of empty cells leads out of.

    Empty cells of the box, one cell wider than the set, are joined by runs along k, so the graph has one node a
    run rather than one a cell; the run at the corner of the box is outside.
    """
    box = cells.agg(*[f(c).alias(n + c) for c in KEYS for n, f in (("lo", F.min), ("hi", F.max))])
    lines = box.select("*", F.explode(F.sequence(F.col("loi") - 1, F.col("hii") + 1)).alias("i")).withColumn("j", F.explode(F.sequence(F.col("loj") - 1, F.col("hij") + 1)))
    held = cells.groupBy("i", "j").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    lines = lines.join(held, ["i", "j"], "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<bigint>")))
    below = F.concat(F.array(F.col("lok") - 2), F.col("ks"))
    above = F.concat(F.col("ks"), F.array(F.col("hik") + 2))
    runs = lines.select("i", "j", "loi", "loj", "lok", F.explode(F.arrays_zip(below.alias("b"), above.alias("a"))).alias("r")).select("i", "j", "loi", "loj", "lok", (F.col("r.b") + 1).alias("lo"), (F.col("r.a") - 1).alias("hi")).where("hi >= lo")
    runs = runs.withColumn("node", F.xxhash64("i", "j", "lo"))
    links = None
    for di, dj in ((1, 0), (0, 1)):
        other = runs.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("b"))
        pair = runs.join(other, ["i", "j"]).where("lo <= hi2 and lo2 <= hi").select(F.col("node").alias("a"), "b")
        links = pair if links is None else links.unionByName(pair)
    label = component_labels(links, runs.select(F.col("node").alias("v")))
    named = runs.join(label.withColumnRenamed("v", "node"), "node")
    out = named.where("i = loi - 1 and j = loj - 1").select("label").distinct()
    inner = named.join(out, "label", "left_anti").select("i", "j", F.explode(F.sequence("lo", "hi")).alias("k"))
    return cells.select(*KEYS).unionByName(inner)


def revoxelize(cells: DataFrame, size: float, new_size: float) -> DataFrame:
    """The cells of width ``new_size`` whose centre lies in a cell of width ``size``, both from the origin."""
    out = cells
    for c in KEYS:
        lo, hi = F.floor(F.col(c) * size / new_size - 0.5), F.floor((F.col(c) + 1) * size / new_size - 0.5) + 1
        out = out.withColumn("n" + c, F.explode(F.sequence(lo, hi))).where(F.floor((F.col("n" + c) + 0.5) * new_size / size) == F.col(c))
    return out.select(*[F.col("n" + c).alias(c) for c in KEYS]).distinct()


def centers(cells: DataFrame, size: float) -> DataFrame:
    """``cells`` with the middle (x, y, z) of each."""
    return cells.withColumns({x: (F.col(c) + 0.5) * size for x, c in zip("xyz", KEYS)})


def occupancy(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(p, inside): whether the cell of each point is in the set."""
    at = points.select("p", *[F.floor(F.col(x) / size).alias(c) for x, c in zip("xyz", KEYS)])
    return at.join(cells.select(*KEYS).distinct().withColumn("inside", F.lit(True)), KEYS, "left").select("p", F.coalesce("inside", F.lit(False)).alias("inside"))


def to_dense(cells: DataFrame) -> DataFrame:
    """(i, j, k, full) of every cell of the box of the set."""
    box = cells.agg(*[f(c).alias(n + c) for c in KEYS for n, f in (("lo", F.min), ("hi", F.max))])
    for c in KEYS:
        box = box.withColumn(c, F.explode(F.sequence("lo" + c, "hi" + c)))
    return box.select(*KEYS).join(cells.select(*KEYS).distinct().withColumn("full", F.lit(True)), KEYS, "left").select(*KEYS, F.coalesce("full", F.lit(False)).alias("full"))


def corners(cells: DataFrame) -> DataFrame:
    """(i, j, k) of the distinct corners of the cells."""
    return _shifted(cells, list(product((0, 1), repeat=3))).select(*KEYS).distinct()


def corner_code(i, j, k):
    """One number for a corner, of coordinates within a million."""
    return F.shiftleft(i.cast("long") + _BIAS, 42) + F.shiftleft(j.cast("long") + _BIAS, 21) + k.cast("long") + _BIAS


def to_boxes(cells: DataFrame, size: float, cull: bool = True) -> tuple[DataFrame, DataFrame]:
    """A mesh of the sides of the cells, outwards; with ``cull``, of those between a cell and an empty one only.

    Vertices are numbered by ``corner_code``, so that cells share corners without a pass over them.
    """
    sides = []
    for axis, up in product(range(3), (0, 1)):
        step = [0, 0, 0]
        step[axis] = 1 if up else -1
        u, v = (axis + 1) % 3, (axis + 2) % 3
        ring = []
        for du, dv in ((0, 0), (1, 0), (1, 1), (0, 1)):
            at = [0, 0, 0]
            at[axis], at[u], at[v] = up, du, dv
            ring.append(corner_code(*[F.col(c) + a for c, a in zip(KEYS, at)]))
        ring = ring if up else ring[::-1]
        sides.append(F.struct(*[(F.col(c) + d).alias("n" + c) for c, d in zip(KEYS, step)], F.lit(2 * axis + up).alias("side"), *[r.alias(f"q{n}") for n, r in enumerate(ring)]))
    named = dense_ids(cells.select(*KEYS).distinct().withColumn("code", corner_code(*[F.col(c) for c in KEYS])), "code", "cell")
    out = named.select("cell", F.inline(F.array(*sides)))
    if cull:
        out = out.join(cells.select(*[F.col(c).alias("n" + c) for c in KEYS]), ["ni", "nj", "nk"], "left_anti")
    halves = F.array(*[F.struct(F.lit(h).alias("half"), *[F.col(f"q{q}").alias(f"i{n}") for n, q in enumerate(t)]) for h, t in enumerate(((0, 1, 2), (0, 2, 3)))])
    faces = out.select("cell", "side", F.inline(halves)).select((F.col("cell") * 12 + F.col("side") * 2 + F.col("half")).alias("f"), "i0", "i1", "i2")
    used = faces.select(F.explode(F.array("i0", "i1", "i2")).alias("v")).distinct()
    part = lambda shift: (F.shiftright("v", shift).bitwiseAND(F.lit((1 << 21) - 1)) - _BIAS) * size
    return used.select("v", part(42).alias("x"), part(21).alias("y"), part(0).alias("z")), faces


def lattice(spark: SparkSession, shape: tuple, low: tuple, high: tuple) -> DataFrame:
    """(i, j, k, x, y, z): the points of a regular lattice whose ends are at ``low`` and ``high``."""
    nx, ny, nz = shape
    ids = spark.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).alias("i"), (F.floor(F.col("id") / nz) % ny).alias("j"), (F.col("id") % nz).alias("k"))
    at = lambda c, n, lo, hi: F.lit(float(lo)) + F.col(c) * ((hi - lo) / max(1, n - 1))
    return ids.select(*KEYS, *[at(c, n, lo, hi).alias(x) for x, c, n, lo, hi in zip("xyz", KEYS, shape, low, high)])


def _stencil(points: DataFrame, shape: tuple, low: tuple, high: tuple) -> DataFrame:
    """The eight lattice corners around each point, with weights; a point outside takes the nearest place inside."""
    out = points
    for x, c, n, lo, hi in zip("xyz", KEYS, shape, low, high):
        place = (F.col(x) - float(lo)) * ((n - 1) / (hi - lo)) if hi > lo else F.lit(0.0)
        place = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), place))
        out = out.withColumn("_" + c, F.least(F.floor(place), F.lit(max(0, n - 2)))).withColumn("_f" + c, place - F.col("_" + c))
    eight = []
    for o in product((0, 1), repeat=3):
        weight = F.lit(1.0)
        for c, d in zip(KEYS, o):
            weight = weight * (F.col("_f" + c) if d else 1 - F.col("_f" + c))
        eight.append(F.struct(*[F.least(F.col("_" + c) + d, F.lit(n - 1)).alias(c) for c, d, n in zip(KEYS, o, shape)], weight.alias("weight")))
    return out.select(*points.columns, F.inline(F.array(*eight))).where("weight > 0")


def splat(points: DataFrame, shape: tuple, low: tuple, high: tuple, least_weight: float = 1e-4) -> DataFrame:
    """(i, j, k, val, density) of points (x, y, z, val): the mean by trilinear weights at every corner that some point reaches."""
    s = _stencil(points, shape, low, high).groupBy(*KEYS).agg(F.sum(F.col("weight") * F.col("val")).alias("total"), F.sum("weight").alias("density"))
    return s.select(*KEYS, (F.col("total") / F.greatest("density", F.lit(least_weight))).alias("val"), "density")


def sample_lattice(field: DataFrame, points: DataFrame, shape: tuple, low: tuple, high: tuple) -> DataFrame:
    """(p, val): a lattice field (i, j, k, val) read at points (p, x, y, z) by trilinear weights; absent corners are 0."""
    s = _stencil(points.select("p", "x", "y", "z"), shape, low, high).join(field, KEYS, "left")
    return s.groupBy("p").agg(F.sum(F.col("weight") * F.coalesce("val", F.lit(0.0))).alias("val"))
