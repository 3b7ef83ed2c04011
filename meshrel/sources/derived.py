"""Geometry derived from the driver tables, once as DataFrames and once as the SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (v, x, y, z) and faces (f, i0, i1, i2) of an open disk: all parts on a grid, the price as height; the last rows may be ragged."""
    part = table(spark, sf_dir, "part")
    side = part.agg(F.floor(F.sqrt(F.count("*"))).cast("long").alias("n"), F.min("p_partkey").alias("k0"), F.max("p_partkey").alias("k1"))
    at = part.crossJoin(F.broadcast(side)).withColumn("v", F.col("p_partkey") - F.col("k0")).withColumn("last", F.col("k1") - F.col("k0"))
    verts = at.select("v", (F.col("v") % F.col("n")).cast("double").alias("x"), F.floor(F.col("v") / F.col("n")).cast("double").alias("y"), (F.col("p_retailprice") / 100).alias("z"), "n", "last")
    v, n = F.col("v"), F.col("n")
    halves = F.array(F.struct((v * 2).alias("f"), v.alias("i0"), (v + 1).alias("i1"), (v + n + 1).alias("i2")), F.struct((v * 2 + 1).alias("f"), v.alias("i0"), (v + n + 1).alias("i1"), (v + n).alias("i2")))
    faces = verts.where("x < n - 1 and v + n + 1 <= last").select(F.inline(halves))
    return verts.drop("n", "last"), faces


def torn_field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The height field with faults: holes, flipped faces, repeated faces and degenerate faces."""
    verts, faces = height_field(spark, sf_dir)
    f = F.col("f")
    kept = faces.where("f % 97 <> 5")
    flipped = f % 53 == 7
    kept = kept.select("f", "i0", F.when(flipped, F.col("i2")).otherwise(F.col("i1")).alias("i1"), F.when(flipped, F.col("i1")).otherwise(F.col("i2")).alias("i2"))
    twice = kept.where("f % 71 = 3").select((f + 10_000_000).alias("f"), F.col("i1").alias("i0"), F.col("i2").alias("i1"), F.col("i0").alias("i2"))
    flat = kept.where("f % 89 = 11").select((f + 20_000_000).alias("f"), "i0", F.col("i0").alias("i1"), "i2")
    return verts, kept.unionByName(twice).unionByName(flat)


FIELD_SQL = """
side AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n, min(p_partkey) AS k0, max(p_partkey) AS k1 FROM part),
VN AS (SELECT p_partkey - k0 AS v, CAST((p_partkey - k0) % n AS DOUBLE) AS x,
              CAST((p_partkey - k0) // n AS DOUBLE) AS y, p_retailprice / 100 AS z, n, k1 - k0 AS last
       FROM part CROSS JOIN side),
V AS (SELECT v, x, y, z FROM VN),
Q AS (SELECT v, n FROM VN WHERE x < n - 1 AND v + n + 1 <= last),
F0 AS (SELECT v * 2 AS f, v AS i0, v + 1 AS i1, v + n + 1 AS i2 FROM Q
       UNION ALL SELECT v * 2 + 1, v, v + n + 1, v + n FROM Q)
"""
HALFEDGES_SQL = """
H AS (SELECT f * 3 AS h, f, 0 AS k, i0 AS org, i1 AS dst, least(i0, i1) AS lo, greatest(i0, i1) AS hi FROM F
      UNION ALL SELECT f * 3 + 1, f, 1, i1, i2, least(i1, i2), greatest(i1, i2) FROM F
      UNION ALL SELECT f * 3 + 2, f, 2, i2, i0, least(i2, i0), greatest(i2, i0) FROM F)
"""
#: WITH clauses that give V(v, x, y, z), F(f, i0, i1, i2) and H.
FIELD = "WITH " + FIELD_SQL + ", F AS (SELECT * FROM F0), " + HALFEDGES_SQL
TORN = (
    "WITH "
    + FIELD_SQL
    + """,
K AS (SELECT f, i0, CASE WHEN f % 53 = 7 THEN i2 ELSE i1 END AS i1, CASE WHEN f % 53 = 7 THEN i1 ELSE i2 END AS i2 FROM F0 WHERE f % 97 <> 5),
F AS (SELECT * FROM K
      UNION ALL SELECT f + 10000000, i1, i2, i0 FROM K WHERE f % 71 = 3
      UNION ALL SELECT f + 20000000, i0, i0, i2 FROM K WHERE f % 89 = 11), """
    + HALFEDGES_SQL
)

CORNERS_SQL = """,
C AS (SELECT f, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z, c.x AS c_x, c.y AS c_y, c.z AS c_z, i0, i1, i2
      FROM F JOIN V a ON a.v = i0 JOIN V b ON b.v = i1 JOIN V c ON c.v = i2),
N AS (SELECT *, (b_y - a_y) * (c_z - a_z) - (b_z - a_z) * (c_y - a_y) AS nx, (b_z - a_z) * (c_x - a_x) - (b_x - a_x) * (c_z - a_z) AS ny,
             (b_x - a_x) * (c_y - a_y) - (b_y - a_y) * (c_x - a_x) AS nz FROM C)
"""
