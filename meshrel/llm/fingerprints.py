"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import partitions, table
from .textkernel import mix, span_hashes, text_slices, word_spans

SAMPLES = 64
_CACHED = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Variates:
    """Gamma and uniform variates of terms, drawn from the term's hash alone; a bounded cache."""

    def __init__(self, samples: int):
        self.samples = samples
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.rows = np.zeros((3, _CACHED, samples), np.float32)

    def _draw(self, terms: np.ndarray) -> np.ndarray:
        seeds = mix(terms[:, None] + (np.arange(self.samples, dtype=np.uint64) * _STEP)[None, :])

        def uniform(j: int) -> np.ndarray:
            return ((mix(seeds + np.uint64(j * 0xD1342543DE82EF95 % 2**64)) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)

        r = -np.log(uniform(1) * uniform(2))  # Gamma(2, 1)
        c = -np.log(uniform(3) * uniform(4))
        return np.stack([r, uniform(5), np.log(c)])

    def of(self, terms: np.ndarray) -> np.ndarray:
        """The places in ``rows`` (r, beta, ln c) of the sorted distinct ``terms``; new ones are drawn and appended."""
        at = np.minimum(np.searchsorted(self.known, terms), max(0, len(self.known) - 1))
        old = self.known[at] == terms if len(self.known) else np.zeros(len(terms), bool)
        new = terms[~old]
        if len(self.known) + len(new) > self.rows.shape[1]:
            self.known, self.place, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), terms
            if len(new) > self.rows.shape[1]:
                self.rows = np.zeros((3, len(new), self.samples), np.float32)
        if len(new):
            first = len(self.known)
            for a in range(0, len(new), 4096):
                part = new[a : a + 4096]
                self.rows[:, first + a : first + a + len(part)] = self._draw(part)
            known = np.concatenate([self.known, new])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate([self.place, np.arange(first, first + len(new))])[order]
        return self.place[np.searchsorted(self.known, terms)]


def signatures(column: pa.Array, variates: _Variates) -> np.ndarray:
    """(rows, samples) of 16-bit samples; texts without words give zeros.

    For each sample and each word of weight S (its count), with r and c from Gamma(2, 1) and beta uniform:
    t = floor(ln S / r + beta), ln y = r * (t - beta), ln a = ln c - ln y - r. The word of the least a and
    its t are the sample; two texts have the same with probability sum min / sum max of their weights.
    """
    k = variates.samples
    out = np.zeros((len(column), k), np.uint16)
    for lo, hi, data, off in text_slices(column):
        starts, ends, word_off = word_spans(data, off)
        if not len(starts):
            continue
        terms, at = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        row = np.repeat(np.arange(hi - lo), np.diff(word_off))
        pairs, count = np.unique(row.astype(np.int64) * len(terms) + at, return_counts=True)
        row, at = pairs // len(terms), pairs % len(terms)
        logs = np.log(count).astype(np.float32)
        place = variates.of(terms)[at]
        edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
        # Whole rows at a time, so that the working set stays near 4,096 pairs.
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + 4096, "right")) - 1)
            a, b = edges[i], edges[j]
            r, beta, ln_c = (x[place[a:b]] for x in variates.rows)
            t = np.floor(logs[a:b, None] / r + beta)
            ln_a = ln_c - r * (t - beta + 1)
            first = edges[i:j] - a
            least = np.minimum.reduceat(ln_a, first, axis=0)
            pair, sample = np.nonzero(ln_a == np.repeat(least, np.diff(edges[i : j + 1]), axis=0))
            # The samples of rows, from the few places of the least; of equal ones the greatest.
            value = mix(terms[at[a:b][pair]] + t[pair, sample].astype(np.int64).astype(np.uint64) * _STEP)
            owner = lo + row[a:b][pair]
            np.maximum.at(out, (owner, sample), (value >> np.uint64(48)).astype(np.uint16))
            i = j
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _hex(samples: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in samples.astype(">u2")]


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): ``samples`` consistent weighted samples of the text's words, 16 bits each, in hex.

    The share of equal 4-digit groups of two fingerprints estimates the generalised Jaccard similarity of
    the texts' word counts. Null texts are empty; texts without words have the zero fingerprint.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variates = _Variates(samples)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(_hex(signatures(batch.column("text"), variates)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(mark, "doc_id long, fingerprint string")


def _comparer(samples: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variates = _Variates(samples)
        held: list[tuple] = []
        weight = 0

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """Of each document of ``rows`` that the next row follows in the same range."""
            mine = [i for i in range(len(rows) - 1) if rows[i][1] == 0 and rows[i + 1][0] == rows[i][0]]
            texts = [r[3] for r in rows]
            edited = []
            for i in mine:
                q = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - q] + texts[i + 1][:q])
            plain = signatures(pa.array(texts, pa.large_string()), variates)
            changed = signatures(pa.array(edited, pa.large_string()), variates)
            at = np.array(mine, np.int64)
            return pa.record_batch(
                [
                    pa.array([rows[i][2] for i in mine], pa.int64()),
                    pa.array([len(texts[i]) for i in mine], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(_hex(plain[at]), pa.string()),
                    pa.array(_hex(changed), pa.string()),
                    pa.array(_likeness(plain[at], changed) if mine else [], pa.float64()),
                    pa.array(_likeness(plain[at], plain[at + 1]) if mine else [], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bucket", "role", "doc_id")]
            texts = batch.column("text")
            for i, key in enumerate(zip(*columns)):
                text = texts[i].as_py() or ""
                held.append((*key, text))
                weight += len(text)
                if weight > 2_000_000:
                    yield emit(held)
                    held, weight = held[-1:], len(held[-1][3])
        if held:
            yield emit(held)

    return compare


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next document by doc_id.

    The edited form replaces the last floor(n / 4) code points by the first as many of the next document,
    or all of it; the first document follows the last. Documents are dealt into ranges of doc_id at
    approximate quantiles; the first document of a range also goes to the range before it, so each range is
    settled by one pass over its sorted rows, as a task of its own, and no window spans the table.

    Null texts are empty. Rows without doc_id come first in the order. Repeated doc_ids are ordered by
    text, each row following the one before it. A table of one row is its own next. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts = docs.select(F.percentile_approx(place, [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"]
    edges = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    placed = docs.withColumn("place", place).withColumn("bucket", bucket_of("place"))
    # One row per range: the ranges that have rows, and the first id of each.
    firsts = sorted((r["bucket"], r["first"]) for r in docs.select(place.alias("place")).withColumn("bucket", bucket_of("place")).groupBy("bucket").agg(F.min("place").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "place long, bucket int")
    tails = docs.withColumn("place", place).join(F.broadcast(before), "place").select("bucket", F.lit(1).alias("role"), "doc_id", "text")
    rows = placed.select("bucket", F.lit(0).alias("role"), "doc_id", "text").unionByName(tails)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "role", "doc_id", "text").mapInArrow(_comparer(samples), schema)


def op7_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and the next documents."""
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op7_weighted_fingerprints": op7_weighted_fingerprints}
