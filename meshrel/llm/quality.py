"""Quality classifier: Naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .textkernel import mix, text_slices

DIMENSION_BITS = 17
TRAIN_ROWS = 6_000
EPOCHS = 12
SMOOTHING = 1.0
PENALTY = 0.1
_STEP = np.uint64(0xD1342543DE82EF95)

#: Character classes: 0 space, 1 digit, 2 lower-case and bytes above 127, 3 upper-case, 4 and above one for each mark.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[*range(0x21, 0x7F)]] = np.arange(4, 4 + 0x7F - 0x21)
CLASSES[48:58] = 1
CLASSES[97:123] = 2
CLASSES[128:] = 2
CLASSES[65:91] = 3


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's tokens: runs of letters, of digits, or of one mark; and each row's offsets.

    A run of letters counts twice in effect: its hash also holds whether it is all upper-case, so that
    shouted words differ from plain ones.
    """
    kind = CLASSES[data].copy()
    letters = (kind == 2) | (kind == 3)
    group = np.where(letters, 2, kind)
    new = np.ones(len(data), bool)
    new[1:] = group[1:] != group[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    new |= cut[:-1]
    edge = np.append(np.flatnonzero(new), len(data))
    start, size = edge[:-1], np.diff(edge)
    solid = group[start] != 0
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    lower = np.where(kind == 3, data + 32, data).astype(np.uint64)
    inside = np.arange(len(data)) - np.repeat(start, size)
    base = np.cumprod(np.full(64, 1_000_003, np.uint64))
    value = np.add.reduceat((lower + np.uint64(1)) * base[np.minimum(inside, 63)], start)
    upper = np.add.reduceat((kind == 3).astype(np.int64), start)
    shout = ((upper == size) & (size > 1)).astype(np.uint64)
    value = mix(value * _STEP + shout)
    return value[solid], np.searchsorted(start[solid], off)


def features(data: np.ndarray, off: np.ndarray, bits: int = DIMENSION_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed token uni- and bigrams of each row, and each row's offsets into them.

    A repeated neighbour (the same token twice in a row) has a feature of its own besides its bigram.
    """
    value, word_off = tokens(data, off)
    count = np.diff(word_off)
    row = np.repeat(np.arange(len(count)), count)
    mask = np.uint64((1 << bits) - 1)
    one = value & mask
    parts, rows = [one], [row]
    if len(value) > 1:
        pair = mix(value[:-1] * _STEP + value[1:])
        same = row[:-1] == row[1:]
        parts.append(pair[same] & mask)
        rows.append(row[:-1][same])
        twin = same & (value[:-1] == value[1:])
        parts.append(np.full(int(twin.sum()), 7, np.uint64))
        rows.append(row[:-1][twin])
    key = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(bits)) | np.concatenate(parts))
    return (key & mask).astype(np.int64), np.searchsorted(key >> np.uint64(bits), np.arange(len(count) + 1))


def _counter(bits: int):
    """(text, label) to the number of rows of each label that have each feature, summed within a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for lo, hi, data, off in text_slices(batch.column("text")):
                found, at = features(data, off, bits)
                own = np.repeat(label[lo:hi], np.diff(at))
                for y in (0, 1):
                    sums[y] += np.bincount(found[own == y], minlength=1 << bits)
                    rows[y] += int((label[lo:hi] == y).sum())
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(sums[0][used], rows[0])), pa.array(np.append(sums[1][used], rows[1]))], names=["feature", "n0", "n1"])

    return count


def log_count_ratios(labelled: DataFrame, bits: int = DIMENSION_BITS, smoothing: float = SMOOTHING) -> tuple[np.ndarray, np.ndarray]:
    """ln of the smoothed shares of each feature among rows of label 1 and of label 0, over all rows; and the rows of each."""
    sums = labelled.select("text", "label").mapInArrow(_counter(bits), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    count = np.full((2, 1 << bits), smoothing)
    at = sums.column("feature").to_numpy()
    totals = np.zeros(2)
    for y, name in enumerate(("n0", "n1")):
        value = sums.column(name).to_numpy()
        count[y, at[at >= 0]] += value[at >= 0]
        totals[y] = value[at < 0].sum()
    share = count / (totals + 2 * smoothing)[:, None]
    return np.log(share[1] / share[0]), totals


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear model of least hinge loss by dual coordinate descent, over indicators times ``scale``.

    Each step solves for one row's dual variable in [0, penalty], the upper bound weighted so that both
    labels weigh alike, and moves the weights along that row. Rows have unit length; the last weight is the bias.
    """
    rng = np.random.default_rng(seed)
    sign = np.where(labels > 0, 1.0, -1.0)
    values = [scale[r] / max(1e-9, np.sqrt((scale[r] ** 2).sum())) for r in rows]
    weight = np.zeros(len(scale))
    bias = 0.0
    dual = np.zeros(len(rows))
    share = max(1e-9, (labels > 0).mean())
    bound = penalty * 10 * np.where(labels > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    square = np.array([(v**2).sum() + 1 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), bound[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weight, bias


def fit_quality(rows: DataFrame, labels: DataFrame | None = None, bits: int = DIMENSION_BITS, most_rows: int = TRAIN_ROWS) -> dict:
    """A model from rows (doc_id, text) and their labels (doc_id, label), 0 or 1; others are ignored.

    Without ``labels``, label is a column of ``rows``. Texts meet their labels in one shuffle at every size; the
    sample is chosen from the ids alone, and its texts are read by a broadcast of at most ``most_rows`` ids.

    The log-count ratios come from all rows. The hinge loss is fitted on the ``most_rows`` rows of each
    label at most that come first by a hash of doc_id: a bounded sample that the driver can hold. With rows
    of one label only, or none, every text scores 0.5.
    """
    own = [] if labels is not None else [F.col("label").cast("int").alias("label")]
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *own)
    if labels is None:
        labelled = rows.where("label in (0, 1)")
        ids = labelled.select("doc_id", "label")
    else:
        labels = labels.where("label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
        labelled = rows.join(labels.hint("merge"), "doc_id")
        ids = labels.join(rows.select("doc_id").hint("merge"), "doc_id")
    ratio, totals = log_count_ratios(labelled, bits)
    if not totals.all():
        return {"bits": bits, "weight": np.zeros(1 << bits, np.float32), "bias": 0.0, "slope": 1.0, "ratio": ratio.astype(np.float32)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_slices(batch.column("text")):
                found, at = features(data, off, bits)
                yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))], names=["label", "found"])

    vectors, targets = [], []
    for label in (0, 1):
        kept = ids.where(F.col("label") == label).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most_rows // 2)
        pool = rows.where(F.col("label") == label) if own else rows
        sample = pool.join(F.broadcast(kept.select("doc_id").distinct()), "doc_id", "left_semi").select(F.lit(label).alias("label"), "text")
        # In order of the rows' features, so that reruns fit the same model.
        for found in sorted(r["found"] for r in sample.mapInArrow(sparse, "label int, found array<int>").toArrow().to_pylist()):
            vectors.append(np.array(found, np.int64))
            targets.append(label)
    weight, bias = fit_hinge(vectors, np.array(targets), ratio)
    model = {"bits": bits, "weight": weight.astype(np.float32), "bias": float(bias), "slope": 4.0, "ratio": ratio.astype(np.float32)}
    return model


def _scorer(model: dict):
    bits, weight, ratio = model["bits"], model["weight"], model["ratio"]
    product = (weight * ratio).astype(np.float64)
    square = ratio.astype(np.float64) ** 2

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, off in text_slices(batch.column("text")):
                found, at = features(data, off, bits)
                totals = np.concatenate(([0.0], np.cumsum(product[found])))
                lengths = np.concatenate(([0.0], np.cumsum(square[found])))
                norm = np.sqrt(np.maximum(lengths[at[1:]] - lengths[at[:-1]], 1e-18))
                margin = (totals[at[1:]] - totals[at[:-1]]) / norm + model["bias"]
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(model["slope"] * margin, -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return score


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted): the score of each whole text, from its text alone.

    Null texts score as empty ones, by the bias. Repeated rows score alike; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, score double, predicted int")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 by 3; a null id is not held out, and no label belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id", F.col("quality").alias("label"))
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    scored = score_quality(docs, fit_quality(train, labels.where(~held_out(F.col("doc_id")))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op1_nb_svm_quality": op1_nb_svm_quality}
