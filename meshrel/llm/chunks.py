"""Substring dedup by content-defined chunks with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import joined_back, settle, table
from .suffixes import kept_bytes
from .textkernel import BASE_INVERSE, BYTE_VALUES, SPACE, mix, powers, text_slices

WINDOW = 16
SPREAD = 23
SMALLEST = 16
LARGEST = 256
LEAST_RUN = 160
#: Bytes to either side of a run that the first round of growth compares; each further round takes 16 times as many.
REACH = 256
LONGEST_WORD = 64

#: Values of bytes for the second digest of a chunk; 32 bits of it are kept.
CHECK_VALUES = np.random.default_rng(20240613).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GEAR = np.random.default_rng(20240612).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + gear[byte i] modulo 2 ** 64, by doubling: a byte shifts out after 64 steps."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step].copy() << np.uint64(step))
    return h


def _least_within(x: np.ndarray, size: int) -> np.ndarray:
    """The least of x[i : i + size] for every i, by doubling; past the end nothing is less."""
    x = np.concatenate((x, np.full(size, np.iinfo(x.dtype).max, x.dtype)))
    step = 1
    while 2 * step <= size:
        x[:-step] = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:-size], x[size - step : -step])


def chunk_ends(data: np.ndarray, spread: int = SPREAD, smallest: int = SMALLEST, largest: int = LARGEST) -> np.ndarray:
    """The ends of the chunks of one text.

    A chunk ends after a byte where the lowest WINDOW bits of the gear hash are less than at the ``spread`` bytes
    before and at most what they are at the ``spread`` bytes after, at ``smallest`` bytes or more; without one, at
    ``largest``. Bit k of the hash depends on the last k + 1 bytes, so a cut depends on the WINDOW + ``spread``
    bytes before it and the ``spread`` bytes after only: equal passages are cut alike but for their edges.
    """
    n = len(data)
    low = (gear_hashes(data) & np.uint64(2**WINDOW - 1)).astype(np.uint32)
    ahead = _least_within(low, spread + 1)
    before = np.full(n, 2**WINDOW, np.uint32)
    before[1:] = _least_within(low[::-1], spread)[::-1][: n - 1]
    cuts = (np.flatnonzero((low == ahead) & (low < before)) + 1).tolist()
    ends, last = [], 0
    for cut in cuts:
        while cut - last > largest:
            last += largest
            ends.append(last)
        if cut - last >= smallest:
            last = cut
            ends.append(last)
    while n - last > largest:
        last += largest
        ends.append(last)
    if last < n:
        ends.append(n)
    return np.array(ends, np.int64)


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, t1, text) to one row per text: parallel arrays of two chunk digests and ends."""
    for batch in batches:
        digests, checks, ends = [], [], []
        for lo, hi, data, off in text_slices(batch.column("text")):
            prefixes = np.zeros((2, len(data) + 1), np.uint64)
            for prefix, values in zip(prefixes, (BYTE_VALUES, CHECK_VALUES)):
                np.cumsum(values[data] * powers(len(data)), out=prefix[1:])
            inverse = powers(len(data) + 1, BASE_INVERSE)
            for i in range(hi - lo):
                end = chunk_ends(data[off[i] : off[i + 1]])
                at = np.concatenate(([0], end[:-1])) + off[i] if len(end) else end
                size = (end + off[i] - at).astype(np.uint64)
                for prefix, out in zip(prefixes, (digests, checks)):
                    out.append(mix(mix((prefix[end + off[i]] - prefix[at]) * inverse[at]) + size).view(np.int64))
                ends.append(end.astype(np.int32))
        rows = np.concatenate(([0], np.cumsum([len(x) for x in ends]))).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(rows), pa.array(np.concatenate(x) if x else np.zeros(0, kind), kind())) for x, kind in ((digests, pa.int64), (checks, pa.int64), (ends, pa.int32))]
        yield pa.record_batch([batch.column("row"), batch.column("t1"), *out], names=["row", "t1", "digests", "checks", "ends"])


def _exploder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, t1, text) to (digest, check, row, t1, packed start and end) for each chunk."""
    for batch in _chunker(batches):
        count = batch.column("ends").value_lengths().to_numpy()
        rows = pa.array(np.repeat(np.arange(len(count)), count))
        digest, check, hi = batch.column("digests").flatten(), pa.array((batch.column("checks").flatten().to_numpy() >> 32).astype(np.int32)), batch.column("ends").flatten().to_numpy().astype(np.int64)
        if not len(hi):
            continue
        lo = np.concatenate(([0], hi[:-1]))
        lo[(np.cumsum(count) - count)[count > 0]] = 0
        packed = pa.array((lo << 32) | hi)
        for a in range(0, len(hi), 100_000):
            at = rows.slice(a, 100_000)
            yield pa.record_batch([digest.slice(a, 100_000), check.slice(a, 100_000), batch.column("row").take(at), batch.column("t1").take(at), packed.slice(a, 100_000)], names=["digest", "check", "row", "t1", "packed"])


def _run_finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated chunks of each row to unbroken runs, with the first places of their first and last chunks.

    A chunk that is its digest's first place stays.
    """
    names = ["row", "t1", "lo", "hi", "left_row", "left_t1", "left", "right_row", "right_t1", "right"]
    for batch in batches:
        out = []
        for row, t1, chunks in zip(batch.column("row").to_pylist(), batch.column("t1").to_pylist(), batch.column("chunks")):
            x, r, t, p = (chunks.values.field(n).to_numpy(zero_copy_only=False) for n in ("packed", "first_row", "first_t1", "first"))
            x, at = np.unique(x, return_index=True)
            r, t, p = r[at], t[at], p[at]
            again = (r != row) | (t != t1) | (p != x)
            x, r, t, p = x[again], r[again], t[again], p[again]
            if not len(x):
                continue
            lo, hi = x >> 32, x & 0xFFFFFFFF
            new = np.flatnonzero(np.concatenate(([True], lo[1:] != hi[:-1])))
            last = np.concatenate((new[1:], [len(x)])) - 1
            out.append(np.stack([np.full(len(new), row), np.full(len(new), t1), lo[new], hi[last], r[new], t[new], p[new] >> 32, r[last], t[last], p[last] & 0xFFFFFFFF]))
        whole = np.concatenate(out, axis=1) if out else np.zeros((len(names), 0), np.int64)
        yield pa.record_batch([pa.array(x) for x in whole], names=names)


def _surroundings(width: int):
    """(row, t1, text, places) to the ``width`` bytes before (even places) or after (odd) each place; place // 2 is the byte."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["row", "t1", "place", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for row, t1, text, places in zip(*(batch.column(n) for n in ("row", "t1", "text", "places"))):
                row, t1, data = row.as_py(), t1.as_py(), text.as_py().encode()
                for place in places.as_py():
                    at = place >> 1
                    out.append((row, t1, place, data[at : at + width] if place & 1 else data[max(0, at - width) : at]))
                    size += len(out[-1][3]) + 100
                    if size > 16_000_000:
                        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return cut


def _agreeing(width: int):
    """(row, t1, place, mine, theirs) to the number of bytes that agree from the place on, and whether all ``width`` do.

    Half a word that agrees at the outer end, of less than LONGEST_WORD bytes, is left: it agrees by chance.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for place, x, y in zip(*(batch.column(n).to_pylist() for n in ("place", "mine", "theirs"))):
                mine, y = (x, y) if place & 1 else (x[::-1], y[::-1])
                n = min(len(mine), len(y))
                x, y = mine[:n], y[:n]
                if x != y:
                    n = int(np.argmax(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)))
                if n < len(mine):
                    back = next((i for i in range(min(n + 1, LONGEST_WORD)) if SPACE[mine[n - i]] or (n > i and SPACE[mine[n - i - 1]])), 0 if n >= LONGEST_WORD else n)
                    n -= back
                sizes.append(n)
            size = np.array(sizes, np.int64)
            kept = ["row", "t1", "place", "from_row", "from_t1", "from_place"]
            yield pa.record_batch([*(batch.column(n) for n in kept), pa.array(size), pa.array(size == width)], names=[*kept, "size", "open"])

    return compare


def _growth(texts: DataFrame, runs: DataFrame, reach: int) -> list[DataFrame]:
    """(row, t1, lo, hi): the bytes before and after each run that agree with those around its first places.

    A round compares a bounded number of bytes; the ends where all of them agree go to the next round, with 16
    times as many, until there are none.
    """
    ends = [F.struct((F.col("lo") * 2).alias("place"), F.col("left_row").alias("from_row"), F.col("left_t1").alias("from_t1"), (F.col("left") * 2).alias("from_place"))]
    ends.append(F.struct((F.col("hi") * 2 + 1).alias("place"), F.col("right_row").alias("from_row"), F.col("right_t1").alias("from_t1"), (F.col("right") * 2 + 1).alias("from_place")))
    todo = runs.select("row", "t1", F.explode(F.array(*ends)).alias("e")).select("row", "t1", "e.*").where("place > 0 and from_place > 0")
    out = []
    while True:
        places = todo.select("row", "t1", "place").unionByName(todo.select(F.col("from_row").alias("row"), F.col("from_t1").alias("t1"), F.col("from_place").alias("place"))).distinct()
        places = places.groupBy("row", "t1").agg(F.collect_list("place").alias("places"))
        # Repeated rows are one place.
        around = texts.join(places, ["row", "t1"]).groupBy("row", "t1").agg(F.first("text").alias("text"), F.first("places").alias("places"))
        around = settle(around.mapInArrow(_surroundings(reach), "row long, t1 long, place long, bytes binary"), free=True)
        theirs = around.select(F.col("row").alias("from_row"), F.col("t1").alias("from_t1"), F.col("place").alias("from_place"), F.col("bytes").alias("theirs"))
        pairs = todo.join(around.withColumnRenamed("bytes", "mine"), ["row", "t1", "place"]).join(theirs, ["from_row", "from_t1", "from_place"])
        found = settle(pairs.mapInArrow(_agreeing(reach), "row long, t1 long, place long, from_row long, from_t1 long, from_place long, size long, open boolean"), free=True)
        at = F.shiftright("place", 1)
        before = F.col("place") % 2 == 0
        out.append(found.where("size > 0 and not open").select("row", "t1", F.when(before, at - F.col("size")).otherwise(at).alias("lo"), F.when(before, at).otherwise(at + F.col("size")).alias("hi")))
        todo = found.where("open").select("row", "t1", "place", "from_row", "from_t1", "from_place")
        if todo.isEmpty():
            return out
        reach *= 16


def _span_merger():
    """Merges the packed spans of each row; spans that touch are one."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed in batch.column("packed"):
                x = np.sort(packed.values.to_numpy())
                lo, hi = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                last = np.concatenate((new[1:], [len(x)])) - 1
                out.append([{"lo": a, "hi": b} for a, b in zip(lo[new].tolist(), hi[last].tolist())])
            yield pa.record_batch([batch.column("row"), batch.column("t1"), pa.array(out, kind)], names=["row", "t1", "spans"])

    return merge


def repeated_chunks(docs: DataFrame, least_run: int = LEAST_RUN, reach: int = REACH) -> DataFrame:
    """(doc_id, text, spans): each row with the spans of its text that repeat earlier places.

    Texts are cut into content-defined chunks of 16 to 256 bytes, 48 on average. A chunk repeats if its
    digest also occurs at an earlier place, in order of doc_id, text digest and position; its first place
    stays. Unbroken runs of repeated chunks are seeds: they grow to both sides, byte by byte, as far as whole
    words agree with those around the first place of their outermost chunk. Only what is then at least ``least_run``
    bytes, or a whole text, is a span, so that a common phrase alone is left in place. Digests have 96 bits; their counts are grouped sums, combined
    before the shuffle; only chunks with a repeated digest are gathered again, by row.

    Null texts are empty and have no spans. Rows without doc_id come first in the order. Repeated rows (equal
    doc_id and text) are one place: each keeps its text. An empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("t1", F.xxhash64("text"))
    texts = rows.where("text <> ''").select("row", "t1", "text")
    chunks = texts.mapInArrow(_exploder, "digest long, check int, row long, t1 long, packed long")
    counted = settle(chunks.groupBy("digest", "check").agg(F.count("*").alias("n"), F.min(F.struct("row", "t1", "packed")).alias("first")).where("n > 1"), free=True)
    chunk = F.struct("packed", F.col("first.row").alias("first_row"), F.col("first.t1").alias("first_t1"), F.col("first.packed").alias("first"))
    again = joined_back(chunks, counted, ["digest", "check"], ["row", "t1", "packed"]).groupBy("row", "t1").agg(F.collect_list(chunk).alias("chunks"))
    schema = ", ".join(f"{n} long" for n in ("row", "t1", "lo", "hi", "left_row", "left_t1", "left", "right_row", "right_t1", "right"))
    runs = settle(again.mapInArrow(_run_finder, schema), free=True)
    pieces = runs.select("row", "t1", "lo", "hi")
    for grown in _growth(texts, runs, reach):
        pieces = pieces.unionByName(grown)
    packed = F.shiftleft(F.col("lo"), 32).bitwiseOR(F.col("hi"))
    spans = pieces.groupBy("row", "t1").agg(F.collect_list(packed).alias("packed")).mapInArrow(_span_merger(), "row long, t1 long, spans array<struct<lo:int,hi:int>>")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    large = F.filter("spans", lambda s: (s["hi"] - s["lo"] >= least_run) | ((s["lo"] == 0) & (s["hi"] == F.octet_length("text"))))
    return rows.join(spans, ["row", "t1"], "left").select("doc_id", "text", F.coalesce(large, none).alias("spans"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what repeats earlier places, and the digest of the other bytes."""
    rows = repeated_chunks(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["hi"] - s["lo"])
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept_sha256"),
    )


QUERIES = {"op3_chunk_dedup": op3_chunk_dedup}
