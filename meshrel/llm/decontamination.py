"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .textkernel import mix, span_hashes, texts_of, word_spans

#: The masks; 1 is a word that must agree, 0 one that may differ. They hit every overlap of at least 12
#: equal words and a share of 0.8: with m words changed and no four equal ones in a row, 4 m <= equal words <= 3 (m + 1),
#: so m is 3 and the only such overlap is 111011101110111.
MASKS = ["1111", "1110111"]
LEAST_WORDS = 12
LEAST_SHARE = 0.8
BLOCK_WORDS = 2_000_000
PIECE = 1_000_000
_STEP = np.uint64(0xD1342543DE82EF95)


def _seeds(words: np.ndarray, word_off: np.ndarray, mask: str, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every placement of ``mask`` that stays within one row."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(len(words) - span + 1, tag + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            value = mix(value * _STEP + words[j : len(words) - span + 1 + j])
    row_end = np.repeat(word_off[1:], np.diff(word_off))
    at = np.flatnonzero(np.arange(len(value)) + span <= row_end[: len(value)])
    return value[at], at


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, off in texts_of(column):
        starts, ends, word_off = word_spans(data, off)
        yield lo, hi, span_hashes(data, starts, ends), word_off


class Tests:
    """The words and sorted seed hashes of one block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], masks: list[str]):
        parts = [(w, o) for _, _, w, o in _words(pa.array(texts, pa.large_string()))]
        self.ids = np.array(ids, np.int64)
        self.words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
        counts = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
        self.off = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.seeds = []
        whole = ["1" * n for n in range(1, min(map(len, masks)))]
        self.masks = [*masks, *whole]
        for tag, mask in enumerate(self.masks):
            value, at = _seeds(self.words, self.off, mask, tag)
            if tag >= len(masks):
                # Items shorter than any mask are hit as a whole.
                item = np.searchsorted(self.off, at, "right") - 1
                fit = counts[item] == len(mask)
                value, at = value[fit], at[fit]
            order = np.argsort(value, kind="stable")
            self.seeds.append((value[order], at[order]))

    def _diagonals(self, words: np.ndarray, word_off: np.ndarray) -> np.ndarray:
        """The different (row, item, distance) of all hits, as columns."""
        found = [np.zeros((0, 3), np.int64)]
        for tag, mask in enumerate(self.masks):
            known, places = self.seeds[tag]
            if not len(known):
                continue
            value, at = _seeds(words, word_off, mask, tag)
            first = np.searchsorted(known, value, "left")
            hit = first < len(known)
            hit[hit] = known[first[hit]] == value[hit]
            at, first = at[hit], first[hit]
            count = np.searchsorted(known, value[hit], "right") - first
            for a, b in _pieces(count):
                n = count[a:b]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                here, there = np.repeat(at[a:b], n), places[np.repeat(first[a:b], n) + inside]
                row, item = (np.searchsorted(off, x, "right") - 1 for off, x in ((word_off, here), (self.off, there)))
                found.append(_different(np.stack([row, item, here - there], 1)))
        return _different(np.concatenate(found))

    def spans(self, words: np.ndarray, word_off: np.ndarray, least_words: int, least_share: float) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, equal words) of the overlaps of one slice.

        On each diagonal (row, item, distance) with a hit, the window with the most equal words whose share of equal
        words is at least ``least_share`` counts if it has ``least_words`` of them, or all of a shorter item's; then
        the best ones before and after it.
        """
        row, item, diagonal = self._diagonals(words, word_off).T
        low = np.maximum(word_off[row], self.off[item] + diagonal)
        size = np.minimum(word_off[row + 1], self.off[item + 1] + diagonal) - low
        least = np.minimum(least_words, self.off[item + 1] - self.off[item])
        out = []
        for a, b in _pieces(size):
            n = size[a:b]
            start = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(start - low[a:b], n)
            equal = words[at] == self.words[at - np.repeat(diagonal[a:b], n)]
            for i in np.flatnonzero(np.add.reduceat(equal, start, dtype=np.int64) >= least[a:b]).tolist():
                r, t = int(row[a + i]), int(item[a + i])
                shift = int(low[a + i] - word_off[r])
                for lo, hi, same in _windows(equal[start[i] : start[i] + n[i]], int(least[a + i]), least_share):
                    out.append((r, t, shift + lo, shift + hi, same))
        return out


def _pieces(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts positive counts into stretches of PIECE in sum, or of one."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PIECE, "right")))
        yield a, b
        a = b


def _different(x: np.ndarray) -> np.ndarray:
    x = x[np.lexsort(x.T[::-1])]
    return x[np.concatenate(([True], (x[1:] != x[:-1]).any(1)))] if len(x) else x


def _windows(equal: np.ndarray, least: int, share: float) -> list[tuple[int, int, int]]:
    """(lo, hi, equal words) of disjoint windows with ``share`` and ``least`` equal words, the best first."""
    out, todo = [], [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        same = np.concatenate(([0], np.cumsum(equal[a:b], dtype=np.int64)))
        if same[-1] < least:
            continue
        # A window [i, j) has the share if the surplus at j is not under that at i; the farthest such j is best for i.
        surplus = same * 1_000_000 - np.arange(len(same)) * round(share * 1_000_000)
        ahead = np.maximum.accumulate(surplus[::-1])
        far = len(same) - 1 - np.searchsorted(ahead, surplus, "left")
        gain = same[far] - same
        i = int(len(gain) - 1 - np.argmax(gain[::-1]))
        if gain[i] < least:
            continue
        j = int(np.searchsorted(same, same[far[i]], "left"))
        out.append((a + i, a + j, int(gain[i])))
        todo += [(a, a + i), (a + j, b)]
    return out


def _matcher(tests: Tests, least_words: int, least_share: float):
    names = ["doc_id", "item_id", "first_word", "end_word", "equal_words"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for lo, _, words, word_off in _words(batch.column("text")):
                for r, t, first, end, same in tests.spans(words, word_off, least_words, least_share):
                    rows.append((ids[lo + r], int(tests.ids[t]), first, end, same))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return match


def contaminated_spans(docs: DataFrame, items: DataFrame, masks: list[str] | None = None, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Overlaps of documents with benchmark items: (doc_id, item_id, first_word, end_word, equal_words).

    Words are runs of characters other than space and tab to carriage return, A-Z lower-cased. Each mask is
    laid at every word of both sides and hashes the words under its ones; equal hashes are hits. Along
    hits the two texts are compared word by word without shifts: an overlap has at least ``least_words``
    equal words (or all those of a shorter item) and a share of at least ``least_share`` of its words. At the
    default rule the default masks hit every such overlap; items shorter than any mask are hit as a whole.

    The benchmark goes to the executors in blocks of at most ``block_words`` words (32 bytes each and as many
    for each mask), one pass over the documents for each block, so nothing that is shipped grows with either
    table. Null and empty texts on either side give nothing; repeated rows give repeated overlaps. Rows without doc_id come out without one. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    masks = masks or MASKS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, end_word long, equal_words long"
    out = None
    block: tuple[list[int], list[str]] = ([], [])
    size = 0

    def search():
        found = rows.mapInArrow(_matcher(Tests(*block, masks), least_words, least_share), schema)
        return found if out is None else out.unionByName(found)

    for r in items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        block[0].append(r.item_id)
        block[1].append(r.text)
        size += len(r.text) // 2 + 1
        if size > block_words:
            out = search()
            block, size = ([], []), 0
    if block[0]:
        out = search()
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; rows are told apart by a digest of the text, not by doc_id."""
    key = F.xxhash64(F.col("text").cast("string"))
    bad = contaminated_spans(docs.select(key.alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key == bad["_bad"], "left_anti")


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: whether it is contaminated, by how many items, and by how many words."""
    docs = table(spark, sf_dir, "documents")
    spans = contaminated_spans(docs, table(spark, sf_dir, "benchmark"))
    found = spans.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("equal_words").alias("equal_words"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), "first_item", F.coalesce("equal_words", zero).alias("equal_words"))


QUERIES = {"op6_spaced_seed_decontamination": op6_spaced_seed_decontamination}
