"""Exact removal of repeated byte strings by a range-partitioned sparse suffix array.

A string of ``length`` bytes that occurs twice holds the same content-chosen *anchor* in both places: the
leftmost least of the mixed hashes of its ``length / 2``-byte grams. Each window (a start position) belongs
to one anchor, and an anchor owns a run of window starts; its *context* is the bytes that they span.

1. Every text gives its anchors with a hash of the gram and one of the context. Texts that are equal as a
   whole give them once.
2. Anchors whose gram occurs once own no repeated window. Anchors whose whole context occurs twice own
   repeated windows only. The rest, where repeats begin and end, need their bytes compared.
3. Those suffixes are range-partitioned by their leading bytes at sampled splitters. A bucket sorts them by
   multikey quicksort over 8-byte words, to the right of the anchor and, reversed, to the left, and takes
   the common prefixes of neighbours. A window that begins o bytes before the anchor is repeated if another
   suffix shares o bytes to the left and length - o to the right. Equal leading bytes never cross a bucket
   boundary, as splitters are values of them; a gram with very many different contexts is instead compared
   across buckets by the digests of its windows, counted by a grouped aggregation.
4. The covered spans of each text are merged, and its bytes outside them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .frames import HOT_PARTS, SALTS, joined_back, partitions, runs, settle, table
from .textkernel import BASE_INVERSE, BYTE_VALUES, mix, powers, text_slices

LENGTH = 400
LEAD = 24
CROWD = 2_000


def _prefix(data: np.ndarray) -> np.ndarray:
    """P[i]: the sum of value[byte j] * BASE ** j over j < i; windows follow by difference."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def _window(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((prefix[hi] - prefix[lo]) * powers(len(prefix), BASE_INVERSE)[lo])


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost position of the least of values[i : i + width]."""
    n = len(values)
    # The least by doubling: pairs of overlapping spans of a power of two.
    best = np.arange(n)
    span = 1
    low = values
    while span * 2 <= width:
        right = low[span:]
        left = low[: len(low) - span]
        take = right < left
        best = np.where(take, best[span:], best[: len(best) - span])
        low = np.where(take, right, left)
        span *= 2
    rest = width - span
    count = n - width + 1
    a, b = low[:count], low[rest : rest + count]
    return np.where(b < a, best[rest : rest + count], best[:count])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, gram hash, context hash) of each anchor of one text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = length // 2
    prefix = _prefix(data)
    at = np.arange(n - gram + 1)
    grams = _window(prefix, at, at + gram)
    owner = _leftmost_least(grams, length - gram + 1)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.concatenate((new[1:], [len(owner)])) - 1
    anchor = owner[new]
    raw = memoryview(data.tobytes())
    digests = b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(new.tolist(), (last + length).tolist())])
    context = mix(np.frombuffer(digests, np.uint64) + mix((anchor - new).astype(np.uint64)))
    return new, last, anchor, grams[anchor], context


def _anchorer(length: int):
    """Rows (t1, t2, text) to the anchors of each: ``place`` packs first window, last window and anchor."""
    names = ["t1", "t2", "gram", "context", "place"]

    def pack(held: list[tuple]) -> pa.RecordBatch:
        n = [len(h[2]) for h in held]
        t1, t2 = (np.repeat(np.array([h[j] for h in held], np.int64), n) for j in (0, 1))
        first, last, anchor, gram, context = (np.concatenate([h[j] for h in held]) for j in range(2, 7))
        place = (first << 32) | ((last - first) << 16) | (anchor - first)
        return pa.record_batch([t1, t2, gram.view(np.int64), context.view(np.int64), place], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            held: list[tuple] = []
            size, seen = 0, set()
            for lo, hi, data, off in text_slices(batch.column("text")):
                for i in range(hi - lo):
                    tid = t1[lo + i], t2[lo + i]
                    if tid in seen:
                        continue
                    seen.add(tid)
                    held.append((*tid, *anchors(data[off[i] : off[i + 1]], length)))
                    size += len(held[-1][2])
                    if size > 100_000:
                        yield pack(held)
                        held, size = [], 0
            if held:
                yield pack(held)

    return find


def _cutter(length: int):
    """Rows (t1, t2, text, wanted: list of place, gram, crowd) to one row per wanted context with its bytes."""
    names = ["lead", "gram", "left", "right", "low", "high", "t1", "t2", "anchor", "crowd"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            wanted_of, texts = batch.column("wanted"), batch.column("text").cast(pa.large_binary())
            for i, (t1, t2) in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())):
                text = texts[i].as_py()
                for w in wanted_of[i].as_py():
                    first = w["place"] >> 32
                    last, p = first + ((w["place"] >> 16) & 0xFFFF), first + (w["place"] & 0xFFFF)
                    right = text[p : last + length]
                    rows.append((right[: min(LEAD, length // 2)], w["gram"], text[first:p], right, max(0, p - last), p - first, t1, t2, p, w["crowd"]))
                    held += len(right) + p - first
                    if held > 4_000_000:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)

    return cut


def multikey_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings, and the bytes that each shares with the one before it (at most ``width``).

    Multikey quicksort by words of 8 bytes: each pass orders the strings of every tied group by their next
    word only, and goes on with the groups that are still tied. Shorter strings come first.
    """
    n = len(strings)
    words = -(-width // 8)
    size = np.array([min(len(s), width) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(s[:width].ljust(words * 8, b"\0") for s in strings), ">u8").reshape(n, words)
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # by sorted position; of the tied ones
    tied = np.arange(n)  # sorted positions that still share their group
    for w in range(words):
        if len(tied) < 2:
            break
        word = flat[order[tied], w].astype(np.uint64)
        step = np.lexsort((word, group[tied]))
        order[tied] = order[tied][step]
        word = word[step]
        same_group = np.zeros(len(tied), bool)
        same_group[1:] = group[tied][1:] == group[tied][:-1]
        equal = np.zeros(len(tied), bool)
        equal[1:] = same_group[1:] & (word[1:] == word[:-1])
        differ = np.flatnonzero(same_group & ~equal)
        if len(differ):
            bits = word[differ] ^ word[differ - 1]
            shared[tied[differ]] = w * 8 + _leading_zero_bytes(bits)
        ends = np.flatnonzero(equal)
        shared[tied[ends]] = (w + 1) * 8
        new_group = np.cumsum(~equal)
        group[tied] = new_group
        keep = equal.copy()
        keep[:-1] |= equal[1:]
        tied = tied[keep]
    # Equal but for the padding: by length, then bounded by the shorter.
    tie = np.flatnonzero(shared >= words * 8)
    if len(tie):
        run = np.cumsum(shared < words * 8)
        step = np.lexsort((size[order], run))
        order = order[step]
    if n > 1:
        shared[1:] = np.minimum(shared[1:], np.minimum(size[order][1:], size[order][:-1]))
    return order, shared


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out


def _ranks_at(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """A group number for each string: equal where strings share ``least`` bytes."""
    new = shared < least
    new[0] = True
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_windows(rights: list[bytes], lefts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """(suffix, o) pairs of the windows that occur more than once, as rows."""
    if len(rights) < 2:
        return np.zeros((0, 2), np.int64)
    right = multikey_sort(rights, length)
    left = multikey_sort([x[::-1] for x in lefts], max(1, max(map(len, lefts))))
    out = []
    for o in range(int(low.min()), int(high.max()) + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        key = _ranks_at(*right, length - o)[rows] * np.int64(len(rights) + 2) + (_ranks_at(*left, o)[rows] if o else 0)
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = rows[count[at] > 1]
        out.append(np.stack([hit, np.full(len(hit), o)], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _runs_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [lo, hi) spans that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    last = np.concatenate((new[1:], [len(starts)])) - 1
    return starts[new], starts[last] + length


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["t1", "t2", "lo", "hi"])


def _bucket_sorter(length: int, crowd: int):
    """Sorts a bucket's suffixes; those of one gram arrive together, and small groups are sorted as one lot."""

    def settle_rows(groups: list[pa.Table]) -> pa.RecordBatch:
        c = pa.concat_tables(groups).to_pydict()
        one = {}  # a repeated row brings its suffixes again
        for i, key in enumerate(zip(c["t1"], c["t2"], c["anchor"], c["high"])):
            one.setdefault(key, i)
        pick = list(one.values())
        c = {k: [v[i] for i in pick] for k, v in c.items()}
        hits = repeated_windows(c["right"], c["left"], np.array(c["low"]), np.array(c["high"]), length)
        spans = []
        if len(hits):
            hits = hits[np.lexsort((-hits[:, 1], hits[:, 0]))]
            edge = np.flatnonzero(np.concatenate(([True], hits[1:, 0] != hits[:-1, 0], [True])))
            for a, b in zip(edge[:-1], edge[1:]):
                i = hits[a, 0]
                for lo, hi in zip(*_runs_of(c["anchor"][i] - hits[a:b, 1], length)):
                    spans.append((c["t1"][i], c["t2"][i], int(lo), int(hi)))
        return _span_batch(spans)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for group in runs(batches, ["lead", "gram"]):
            if group.num_rows > 1:
                held.append(group)
                rows += group.num_rows
            if rows > crowd:
                yield settle_rows(held)
                held, rows = [], 0
        if held:
            yield settle_rows(held)

    return sort


def _window_digester(length: int):
    """(a, b, t1, t2, lo): a digest of 128 bits of every window of the given contexts."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            for left, right, low, high, t1, t2, anchor in zip(c["left"], c["right"], c["low"], c["high"], c["t1"], c["t2"], c["anchor"]):
                raw = memoryview(left + right)
                at = np.arange(high - low + 1)
                pair = np.frombuffer(b"".join([blake2b(raw[i : i + length], digest_size=16).digest() for i in at.tolist()]), np.int64).reshape(-1, 2)
                yield pa.record_batch([pair[:, 0].copy(), pair[:, 1].copy(), np.full(len(at), t1), np.full(len(at), t2), (at + anchor - high).astype(np.int32)], names=["a", "b", "t1", "t2", "lo"])

    return digest


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts and merges the packed spans of each text; spans that touch are one."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        out = []
        for packed in batch.column("packed"):
            x = np.sort(packed.values.to_numpy())
            lo, hi = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
            new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
            last = np.concatenate((new[1:], [len(x)])) - 1
            out.append([{"lo": a, "hi": b} for a, b in zip(lo[new].tolist(), hi[last].tolist())])
        yield pa.record_batch([batch.column("t1"), batch.column("t2"), pa.array(out, kind)], names=["t1", "t2", "spans"])


def _text(docs: DataFrame, name: str):
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def _digests(text) -> list:
    """t1 and t2: a digest of 128 bits."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row: all columns of ``docs``, text: its text, null as empty, spans: those of its text or null).

    The columns stay in one struct, so that their names meet no other. A hot text's spans are joined salted.
    """
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), _text(docs, "text").alias("text"))
    rows = rows.select("row", "text", *_digests(F.col("text")))
    counted = rows.groupBy("t1", "t2").agg(F.count("*").alias("n"))
    counted = settle(counted.join(spans, ["t1", "t2"]))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PARTS > F.lit(total)
    marked = rows.join(F.broadcast(counted.where(hot).select("t1", "t2", F.lit(True).alias("hot"))), ["t1", "t2"], "left")
    marked = marked.withColumn("salt", F.when(F.col("hot"), F.floor(F.rand(1) * SALTS).cast("int")).otherwise(0)).drop("hot")
    copied = counted.select("t1", "t2", "spans", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return marked.join(copied, ["t1", "t2", "salt"], "left").select("row", "text", "spans")


def spans_by_text(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(t1, t2, spans): of each different text, by its 128-bit digest, the sorted [lo, hi) byte spans that repeat.

    A span is covered by ``length``-byte strings that also start anywhere else, in the same text or another;
    a text that occurs twice as a whole is one span. Texts without such spans are left out.
    """
    n = partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row"), _text(docs, "text").alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select("row", *_digests(F.col("text")), "text")
    whole = settle(texts.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.max(F.octet_length("text")).alias("size")))
    copied = whole.where("copies > 1").select("t1", "t2", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    # Of a text with very many copies, one row gives the anchors; fewer than a thousand texts have so many.
    rows = whole.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(whole.where(F.col("copies") * HOT_PARTS > F.lit(rows)).select("t1", "t2", F.col("row").alias("only")))
    single = texts.join(hot, ["t1", "t2"], "left").where("only is null or row = only")

    found = single.select("t1", "t2", "text").mapInArrow(_anchorer(length), "t1 long, t2 long, gram long, context long, place long")
    found = found.withColumn("spot", F.xxhash64("t1", "t2", "place"))
    ends = [F.min("spot").alias("s0"), F.max("spot").alias("s1"), F.count("*").alias("n")]
    grams = found.groupBy("gram").agg(*ends, F.min("context").alias("c0"), F.max("context").alias("c1"))
    grams = settle(grams.where("s0 <> s1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed"), "n"))
    again = settle(joined_back(found, grams, ["gram"], ["spot"]))
    contexts = settle(again.groupBy("gram", "context").agg(*ends, F.max("mixed").alias("mixed")))
    first = F.shiftright("place", 32).cast("int")
    last = first + F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sure = joined_back(again, contexts.where("s0 <> s1").select("gram", "context", "n"), ["gram", "context"], ["spot"]).select("t1", "t2", first.alias("lo"), (last + length).alias("hi"))

    mixed = contexts.where("mixed").select("gram", "context", F.col("s0").alias("spot"), (F.col("s0") != F.col("s1")).alias("settled"))
    sized = settle(mixed.groupBy("gram").agg(F.count("*").alias("n"), F.min("settled").alias("settled")).where("not settled").select("gram", "n", (F.col("n") > crowd).alias("crowd")))
    edges = joined_back(mixed.drop("settled"), sized, ["gram"], ["context"]).select("gram", "context", "spot", "crowd")
    edges = again.join(edges, ["gram", "context", "spot"]).select("t1", "t2", "gram", "place", "crowd").distinct()
    wanted = edges.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "gram", "crowd")).alias("wanted"))
    wanted = wanted.join(whole.select("t1", "t2", "row"), ["t1", "t2"])
    schema = "lead binary, gram long, left binary, right binary, low int, high int, t1 long, t2 long, anchor int, crowd boolean"
    cut = settle(texts.join(wanted, ["row", "t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(_cutter(length), schema))
    bucketed = cut.where("not crowd").repartitionByRange(n, "lead", "gram").sortWithinPartitions("lead", "gram")
    sorted_ = bucketed.mapInArrow(_bucket_sorter(length, crowd), "t1 long, t2 long, lo int, hi int")
    windows = cut.where("crowd").mapInArrow(_window_digester(length), "a long, b long, t1 long, t2 long, lo int").withColumn("spot", F.xxhash64("t1", "t2", "lo"))
    twice = windows.groupBy("a", "b").agg(F.min("spot").alias("s0"), F.max("spot").alias("s1")).where("s0 <> s1").select("a", "b")
    crossed = windows.join(twice, ["a", "b"]).select("t1", "t2", "lo", (F.col("lo") + length).alias("hi"))

    spans = copied.unionByName(sure).unionByName(sorted_).unionByName(crossed).distinct()
    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    return spans.groupBy("t1", "t2").agg(F.collect_list(packed).alias("packed")).mapInArrow(_merger, "t1 long, t2 long, spans array<struct<lo:int,hi:int>>")


def repeated_substrings(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, spans): each row of ``docs`` with the byte spans of its text that repeat.

    Texts are UTF-8 bytes, null ones empty; spans are half-open, sorted, disjoint and not adjacent. Matches
    stay within a text. Strings are judged on the input: overlapping strings count, and every occurrence is
    marked, the first too. Rows that occur twice repeat each other as whole texts do. Rows without doc_id
    take part. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return _with_spans(docs, spans_by_text(docs, length, crowd)).select("row.doc_id", "text", F.coalesce("spans", none).alias("spans"))


def kept_bytes(text, spans):
    """The bytes of ``text`` outside ``spans``, concatenated."""
    raw = text.cast("binary")
    ends = F.concat(F.transform(spans, lambda s: s["lo"]), F.array(F.octet_length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["hi"]))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(raw, a + 1, b - a))
    return F.when(F.size(spans) == 0, raw).otherwise(F.aggregate(gaps, F.lit(b""), lambda x, y: F.concat(x, y)))


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the whole characters inside their spans; null spans are none."""
    out = []
    for t, found in zip(text, spans):
        if found is None or not len(found):
            out.append(t)
            continue
        raw = t.encode()
        parts, at = [], 0
        for s in found:
            lo, hi = s["lo"], s["hi"]
            while lo < hi and raw[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi -= 1
            parts.append(raw[at:lo])
            at = hi
        out.append(b"".join([*parts, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings of ``length`` bytes or more cut from their texts, as ``spans_by_text`` finds them.

    Every occurrence goes, and of a character that a span cuts nothing. n_chars, if it is a column, follows the
    text. Rows that lose all but spaces go; rows that were empty before, null ones too, stay as they are.
    """
    joined = _with_spans(docs, spans_by_text(docs.select("doc_id", "text"), length))
    cut = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), kept_text(F.col("text"), F.col("spans"))))
    cut = cut.where(r"cut is null or cut rlike '[^\\x20\\x09-\\x0D]'")
    new = {"text": F.coalesce("cut", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what strings of 400 bytes that occur elsewhere cover, the digest of the other bytes, and those as text."""
    rows = repeated_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["hi"] - s["lo"])
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept_sha256"),
        F.when(F.size("spans") == 0, F.col("text")).otherwise(kept_text(F.col("text"), F.col("spans"))).alias("text"),
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
