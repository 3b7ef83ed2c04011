"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import settle, table
from .textkernel import text_slices, word_spans

MAX_EPOCHS = 3
WEIGHT_CYCLE = 3
SEED = "mix-1"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, off in text_slices(batch.column("text")):
            size[lo:hi] = np.diff(word_spans(data, off)[2])
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(size)], names=[*kept, "size"])


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of runs of characters other than space and tab to carriage return."""
    return _sized(docs)


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    names = "".join(f"`{m}` string, " for m in more)
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *more, F.col("text").cast("string")).mapInArrow(_sizes, f"doc_id long, source string, {names}size long")


def source_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of the total by weight, capped.

    Water-filling in closed form. With sources in order of cap / weight, the level that the remaining
    total reaches over the remaining weight falls below a source's own ratio at the first source that
    keeps under its cap; all before it are clamped, and all from it on share the rest by weight. This is
    the fixed point of clamping and sharing out the excess again until no source is above its cap. The
    windows run over one row per source, never over documents.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    cap = F.col("source_size") * max_epochs
    level = (F.col("total") - F.col("clamped")) / F.col("rest")
    return (
        sources.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("clamped", F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("own_level", level)
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("own_level"), F.col("own_level"))).over(everything))
        .withColumn("target", F.when(F.col("ratio") > F.col("own_level"), F.col("weight") * F.col("level")).otherwise(cap.cast("double")))
        .select("source", "source_size", "weight", "target")
    )


def _cut(cells: DataFrame, parts: DataFrame, start) -> DataFrame:
    """(source, part, place, before): the first place of each source at which the sum of its cells, from ``start``, reaches its part, and the sum before it."""
    until = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    filled = cells.withColumn("until", F.sum("cell").over(until)).withColumnRenamed("source", "cell_source")
    found = filled.join(parts, filled["cell_source"].eqNullSafe(parts["source"])).withColumn("until", F.col("until") + start)
    found = found.where((F.col("part") > 0) & (F.col("until") >= F.col("part")))
    found = found.groupBy("source", "part").agg(F.min(F.struct("place", (F.col("until") - F.col("cell")).alias("before"))).alias("cut"))
    return found.select("source", "part", "cut.place", "cut.before")


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Mixes documents so that each source takes its target number of words.

    Returns (doc_id, source, size, source_size, target, copies, taken), one row per input row. A source's
    whole repetitions give every document as many copies; the fractional one takes documents in order of
    a seeded digest of doc_id until the source's remaining words are met, the last one if that comes nearer.
    The order is settled by sums over 65,536 digest buckets per source, in two levels of 256; only the one bucket
    that the fraction cuts is sorted, so a source with most of the rows needs no task of its own.

    Null or empty texts have size 0 and take 0 words. A null source is a source, last in the order of
    weights. Rows without doc_id are dealt by a digest of their text. Repeated rows are documents of their own. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "source", "text", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("name"))
    sized = settle(_sized(docs, "name").withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), "name"))).drop("name").withColumn("bucket", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")))
    cells = settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell")))
    sources = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    sources = source_targets(sources.withColumn("weight", (F.row_number().over(in_order) - 1) % WEIGHT_CYCLE + 1), max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sources = settle(sources.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")))

    # Two levels, of 256 coarse and 256 fine buckets: no window has more rows than that for a source.
    coarse = cells.groupBy("source", (F.col("bucket") / 256).cast("int").alias("place")).agg(F.sum("cell").alias("cell"))
    high = _cut(coarse, sources.select("source", "part"), F.lit(0))
    fine = cells.withColumn("place", F.col("bucket"))
    fine = fine.join(high.select(F.col("source").alias("s"), "part", F.col("place").alias("high"), "before"), fine["source"].eqNullSafe(F.col("s")) & ((F.col("bucket") / 256).cast("int") == F.col("high")))
    cut = _cut(fine.select("source", "place", "cell"), high.select("source", "part", "before"), F.col("before")).select(F.col("source").alias("plan_source"), F.col("place").alias("cut_bucket"), F.col("before").alias("cut_before"))
    plan = settle(sources.join(cut, sources["source"].eqNullSafe(cut["plan_source"]), "left").select(sources["source"].alias("plan_source"), "source_size", "target", "whole", "part", "cut_bucket", "cut_before"))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["plan_source"]))
    outside = rows.where("not (bucket <=> cut_bucket)").withColumn("extra", F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    inside = rows.where("bucket <=> cut_bucket")
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("extra", F.col("cut_before") + before + F.col("size") / 2 <= F.col("part"))
    copies = (F.col("whole") + F.col("extra").cast("long")).cast("long")
    return outside.unionByName(inside).withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each."""
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = {
    "op5_source_mix": r"""
    WITH sized AS (
      SELECT doc_id, source,
             CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
             md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS digest
      FROM documents),
    weighed AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM sized GROUP BY source),
    ratios AS (
      SELECT *, (source_size * 3)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM weighed),
    levels AS (
      SELECT *, (total - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
      FROM ratios),
    targets AS (
      SELECT *, CASE WHEN ratio > own_level THEN weight * max(CASE WHEN ratio > own_level THEN own_level END) OVER ()
                     ELSE (source_size * 3)::DOUBLE END AS target
      FROM levels),
    plan AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
    taken AS (
      SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole,
             p.target - p.whole * p.source_size AS part,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
    counted AS (
      SELECT *, (whole + (part > 0 AND before + size / 2 <= part)::BIGINT)::BIGINT AS copies FROM taken)
    SELECT doc_id, source, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM counted
    """,
}
QUERIES = {"op5_source_mix": op5_source_mix}
