"""DataFrame helpers of this subpackage: lineage cuts, grouped Arrow streams, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: An Arrow batch ends at so many bytes, so that wide rows do not fill the executor's memory outside the heap.
BATCH_BYTES = 4_000_000
#: A key is hot if it has more than this part of all rows; there are fewer such keys than that, whatever the data.
HOT_PARTS = 1_000
SALTS = 256
#: Spark's setting by which a plan's shuffle files are removed when it has run.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches of at most ``BATCH_BYTES``, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"-?\d+", spark.conf.get(key))[0]) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(key, BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where all runs in one process."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` computed once and cut from its lineage by a reliable checkpoint in the shared folder.

    With ``free``, the files of its shuffles go as soon as the checkpoint is written, not when the driver's
    garbage is collected, so that they do not add up on the disks from step to step.
    """
    conf = lean(df.sparkSession).conf
    shared_folder(df.sparkSession)
    if free:
        # Spark reads this where a plan is made, so only the plan of this copy of ``df`` has it.
        before = conf.get(FREE_SHUFFLES, "false")
        conf.set(FREE_SHUFFLES, "true")
        try:
            df = df.select("*")
        finally:
            conf.set(FREE_SHUFFLES, before)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream that is sorted by ``keys`` into one table per key; only the open key is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns))
        lo = 0
        for i, key in enumerate(rows):
            if last is not None and key != last:
                if i > lo:
                    held.append(pa.Table.from_batches([batch.slice(lo, i - lo)]))
                if held:
                    yield pa.concat_tables(held)
                held, lo = [], i
            last = key
        held.append(pa.Table.from_batches([batch.slice(lo)]))
    if held:
        yield pa.concat_tables(held)


def grouped(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deals rows by ``keys``, sorts them, and streams each partition through ``kernel``."""
    n = partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(kernel, schema)


def joined_back(rows: DataFrame, counted: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with the columns of ``counted``, a settled table of one row a key and ``n``, its number of ``rows``.

    Rows of a hot key are dealt by the ``spread`` columns over ``SALTS`` partitions, and its one row is copied to
    each. Of all n, fewer than ``HOT_PARTS`` keys exceed a ``HOT_PARTS``-th, so the list of hot keys is bounded.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PARTS > F.lit(total)
    marked = rows.join(F.broadcast(counted.where(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = counted.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return marked.join(copied.drop("n").hint("merge"), [*keys, "_salt"]).drop("_hot", "_salt")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, label) per node, the label the least node.

    Alternating stars: every node hangs its greater neighbours, then itself and its lesser neighbours, on the
    least neighbour, until each component is one star. A round is three exchanges and no join, so nothing is
    broadcast; rounds follow the logarithm of the component sizes. A centre's neighbours pass through one sorted
    window, which spills. Each round is cut by a checkpoint, so that a lost executor costs one round. Loops, repeated edges and an empty input are fine; rows with a null end are
    ignored.
    """
    n, near = partitions(edges.sparkSession), F.min("v").over(W.partitionBy("u"))
    stars = settle(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = both.repartition(n, "u").withColumn("m", F.least("u", near)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.repartition(n, "u").distinct().withColumn("m", near)
        stars = settle(small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
