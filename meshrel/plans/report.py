"""Mesh report over the height field of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEIGHT_FIELD = """
WITH side AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n, min(p_partkey) AS k0 FROM part),
V AS (SELECT p_partkey - k0 AS v, CAST((p_partkey - k0) % n AS DOUBLE) AS x,
             CAST(floor((p_partkey - k0) / n) AS DOUBLE) AS y, p_retailprice / 100 AS z, n
      FROM part CROSS JOIN side WHERE p_partkey - k0 < n * n),
Q AS (SELECT v, n FROM V WHERE x < n - 1 AND y < n - 1),
F AS (SELECT v * 2 AS f, v AS i0, v + 1 AS i1, v + n + 1 AS i2 FROM Q
      UNION ALL SELECT v * 2 + 1, v, v + n + 1, v + n FROM Q)
"""

MESH_REPORT = HEIGHT_FIELD + """
, H AS (SELECT f, i0 AS org, i1 AS dst FROM F UNION ALL SELECT f, i1, i2 FROM F UNION ALL SELECT f, i2, i0 FROM F),
E AS (SELECT least(org, dst) AS lo, greatest(org, dst) AS hi, count(*) AS n_faces FROM H GROUP BY 1, 2)
SELECT (SELECT count(*) FROM V) AS n_vertices, (SELECT count(*) FROM E) AS n_edges, (SELECT count(*) FROM F) AS n_faces,
       (SELECT count(*) FROM E WHERE n_faces = 1) AS n_boundary_edges, (SELECT max(n_faces) FROM E) AS max_multiplicity
"""


def with_views(spark: SparkSession, sf_dir: str, names: list[str], sql: str) -> DataFrame:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def mesh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_views(spark, sf_dir, ["part"], MESH_REPORT)


QUERIES = {"mesh_report": mesh_report}
SQL = {"mesh_report": MESH_REPORT}
