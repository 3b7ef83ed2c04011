"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of their 64-bit hashes; a *fragment* is an equal interval of it.

1. Each document's n-gram set is cut into the fragments of its two size classes. Two sets of Jaccard
   similarity of at least t differ in at most (1 - t) / (1 + t) * (|A| + |B|) n-grams, each of which spoils
   one fragment; with more fragments than that, at least one is the same on both sides. The sets of an equal
   fragment are a *meeting*. Its hub is a set whose own class it is; a meeting without one is of no use.
2. A bit per narrow interval of the order tells whether a set has n-grams there. Bits that differ bound the
   n-grams that differ from below, so they rule out most pairs. Hubs are compared with the other sets of their
   meetings by bits, as many pairs as there are sets in meetings. Connected sets need no more comparison.
3. Only meetings of three sets or more that are not all connected by then, each different one once, are compared
   in full by bits; large ones in hashed blocks, each pair of blocks a task of bounded size. Unlike the
   components of all meetings, single meetings do not run together as the corpus grows. The components of
   all that bits have not ruled out hold every linked pair, and only their whole sets are shipped.
4. Within a pair of blocks of those the n-grams are cut into fragments again; the overlaps of all pairs of
   documents are counted fragment by fragment as a product of incidence matrices, and summed per pair. Only
   links of the exact similarity leave the task, as one row per document: its least linked partner and its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import SALTS, components, joined_back, partitions, runs, settle, table
from .textkernel import distinct_sorted, mix, shingle_hashes, span_hashes, texts_of, word_spans

#: A block of a cluster has about so many sets at most, and so many bytes of them.
BLOCK = 384
BLOCK_BYTES = 4_000_000
CELLS = 3_000_000
#: A node is the short signature of a set, with a multiple of this for its class.
NODE = 0x9E3779B97F4A7
_SHIFT = np.uint64(32)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, off in texts_of(column):
        starts, ends, word_off = word_spans(data, off)
        yield from distinct_sorted(*shingle_hashes(span_hashes(data, starts, ends), word_off, k))


def _signature(ngrams: np.ndarray) -> bytes:
    """128 bits of the set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        a = mix(ngrams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        b = mix(ngrams * np.uint64(0xA24BAED4963EE407) + np.uint64(1)).sum(dtype=np.uint64)
    return int(mix(np.array([a + np.uint64(len(ngrams))]))[0]).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _short(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "big", signed=True)


def _node(short: int, c: int, top: bool) -> int:
    """The set ``short`` in class ``c``; negative, so before others in order, if that is the set's own class."""
    low = (short ^ (c + 1) * NODE) & (1 << 63) - 1
    return low - (1 << 63) if top else low


def own_class(n: int, per: int) -> int:
    """The power of 100 / per below or at a size of n."""
    return int(math.floor(math.log(n) / math.log(100 / per) + 1e-9))


def fragment_keys(ngrams: np.ndarray, per: int) -> list[tuple[int, np.ndarray]]:
    """(class, keys of a set's fragments) for both of its size classes; ``per``: least similarity in hundredths.

    Class c holds pairs whose larger set is within the c-th power of 100 / per; a set meets partners in its
    own class and the next. The number of fragments exceeds the largest difference by a slack, so two linked
    sets agree on at least 1 + slack fragments. A set in which no more than slack fragments hold a single
    n-gram or none needs keys for the fuller ones only: its partner agrees on one of those. Failing that, a
    set with no more than slack empty ones gives keys for all that are not empty, and any other for all. A
    linked partner that shares only poor fragments is in the same case, as they are poor on both sides.
    """
    n = len(ngrams)
    own = own_class(n, per)
    out = []
    high = ngrams >> _SHIFT
    for c in (own, own + 1):
        largest = int(math.floor((100 / per) ** (c + 1) + 1e-6)) + 1
        spoilt = (100 - per) * 2 * largest // (100 + per)
        slack = 2 + spoilt // 4
        m = spoilt + 1 + slack
        at = (high * np.uint64(m)) >> _SHIFT
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        size = np.diff(np.append(first, n))
        tag = np.uint64(c * 0x1000003)
        key = mix(np.add.reduceat(mix(ngrams), first) + mix(at[first] + (tag << _SHIFT)))
        empty = m - len(first)
        if empty + int((size == 1).sum()) <= slack:
            key = key[size > 1]
        elif empty > slack:
            full = np.zeros(m, bool)
            full[at[first].astype(np.int64)] = True
            key = np.concatenate([mix(np.flatnonzero(~full).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + tag), key])
        out.append((c, key))
    return out


def presence(ngrams: np.ndarray, own: int, per: int) -> np.ndarray:
    """Packed bits of the intervals of the order that hold n-grams; four or more intervals to an n-gram."""
    out = np.zeros(1 << _width(own, per), np.uint8)
    out[(ngrams >> np.uint64(64 - _width(own, per))).astype(np.int64)] = 1
    return np.packbits(out)


def _width(own: int, per: int) -> int:
    return max(3, math.ceil(math.log2(4 * (100 / per) ** (own + 1))))


def _signer(k: int, per: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, sign, own, bits = [], [], [], []
            for s in _sets(batch.column("text"), k):
                count.append(len(s))
                sign.append(_signature(s) if len(s) else None)
                own.append(own_class(len(s), per) if len(s) else None)
                bits.append(presence(s, own[-1], per).tobytes() if len(s) else None)
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(sign, pa.binary()), pa.array(own, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "sig", "own", "bits"])

    return sign


def _keyer(k: int, per: int):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, held = [], [], 0
            seen = set()
            for s in _sets(batch.column("text"), k):
                if not len(s):
                    continue
                node = _short(_signature(s))
                if node in seen:
                    continue
                seen.add(node)
                for up, (c, key) in enumerate(fragment_keys(s, per)):
                    keys.append(key.view(np.int64))
                    nodes.append(np.full(len(key), _node(node, c, not up), np.int64))
                    held += len(key)
                if held > 200_000:
                    yield pa.record_batch([np.concatenate(keys), np.concatenate(nodes)], names=["key", "node"])
                    keys, nodes, held = [], [], 0
            if keys:
                yield pa.record_batch([np.concatenate(keys), np.concatenate(nodes)], names=["key", "node"])

    return key


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): (key, first node of the key, node) for each other node of it, if the first is of its own class."""
    last_key = last_node = hub = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        if last_key is not None and key[0] == last_key:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        hubs = np.where(start >= 0, node[np.maximum(start, 0)], np.int64(hub if hub is not None else 0))
        fresh = np.ones(n, bool)
        fresh[1:] = (node[1:] != node[:-1]) | new[1:]
        if not new[0] and node[0] == last_node:
            fresh[0] = False
        keep = fresh & (hubs != node) & (hubs < 0)
        last_key, last_node, hub = int(key[-1]), int(node[-1]), int(hubs[-1])
        if keep.any():
            yield pa.record_batch([key[keep], hubs[keep], node[keep]], names=["key", "a", "b"])


def _halved(bits: np.ndarray, least: int) -> np.ndarray:
    while len(bits) > least:
        wide = np.unpackbits(bits)
        bits = np.packbits(wide[::2] | wide[1::2])
    return bits


def _closer(per: int):
    """Keeps the pairs (a, b) that their bits do not rule out."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - per)
            differ = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bits_a"), batch.column("bits_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                least = min(len(x), len(y))
                differ[i] = np.bitwise_count(_halved(x, least) ^ _halved(y, least)).sum()
            yield batch.select(["a", "b"]).filter(pa.array((100 + per) * differ <= both))

    return close


def _packer(k: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed, held = [], [], 0
            sigs = batch.column("id").to_pylist()

            def out():
                part = batch.select(["id", "places"]).take(pa.array(rows, pa.int64()))
                return pa.record_batch([*part.columns, pa.array(packed, pa.binary())], names=[*part.schema.names, "packed"])

            for i, s in enumerate(_sets(batch.column("text"), k)):
                if len(s) and _signature(s) == sigs[i]:
                    rows.append(i)
                    packed.append(s.tobytes())
                    held += s.nbytes
                    if held > 4_000_000:
                        yield out()
                        rows, packed, held = [], [], 0
            if rows:
                yield out()

    return pack


def overlaps(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``.

    The n-grams that occur on both sides, in global order, are cut into fragments of bounded size; each
    gives the partial overlaps as one matrix product, and the partial overlaps are summed.
    """
    total = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    width = max(1, cells // max(len(left), len(right)))

    def incidence(sets, part):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        hit = part[at] == flat
        out = np.zeros((len(sets), len(part)), np.float32)
        out[rows[hit], at[hit]] = 1
        return out

    for lo in range(0, len(both), width):
        part = both[lo : lo + width]
        own = [[s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")] for s in sets] for sets in (left, right)]
        total += incidence(own[0], part) @ incidence(own[1], part).T
    return total


def shared_bits(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(common, differing) bits of all of ``left`` with all of ``right``; longer ones are halved to the shortest."""
    least = min(len(b) for b in (*left, *right))
    sides = []
    for side in (left, right):
        sides.append(np.stack([_halved(b, least) for b in side]))
    common = np.zeros((len(left), len(right)), np.float32)
    held = [np.zeros(len(side), np.float32) for side in sides]
    step = max(1, cells // 8 // max(len(left), len(right)))
    for lo in range(0, least, step):
        a, b = (np.unpackbits(side[:, lo : lo + step], axis=1).astype(np.float32) for side in sides)
        common += a @ b.T
        held[0] += a.sum(1)
        held[1] += b.sum(1)
    return common, held[0][:, None] + held[1][None, :] - 2 * common


def _meetings(batches: Iterator[pa.RecordBatch], per: int, exact: bool) -> Iterator[tuple[list, list, np.ndarray, bool]]:
    """(ids, other ids, linked, whether both sides are one) of each pair of blocks; ``exact``: by sets, else by bits.

    A pair is for the class of its larger set, so two sets that are both of the class below do not meet.
    """
    for group in runs(batches, ["cluster", "low", "high"]):
        c = group.to_pydict()
        low, high = c["low"][0], c["high"][0]
        sides: list[dict] = [{}, {}]
        for name, block, top, n, packed in zip(c["id"], c["block"], c["top"], c["n_shingles"], c["packed"]):
            sides[int(block != low)][name] = (top, n, np.frombuffer(packed, np.uint64 if exact else np.uint8))
        left = sides[0]
        right = left if low == high else sides[1]
        if not left or not right or low == high and len(left) < 2:
            continue
        top, n, held = ([x[i] for x in left.values()] for i in range(3))
        other_top, other_n, other_held = ([x[i] for x in right.values()] for i in range(3))
        both = np.array(n, np.float64)[:, None] + np.array(other_n, np.float64)[None, :]
        if exact:
            shared = overlaps(held, other_held).astype(np.float64)
            linked = 100 * shared >= per * (both - shared)
        else:
            linked = (100 + per) * shared_bits(held, other_held)[1].astype(np.float64) <= (100 - per) * both
        linked &= np.array(top)[:, None] | np.array(other_top)[None, :]
        if low == high:
            np.fill_diagonal(linked, False)
        yield list(left), list(right), linked, low == high


def _bounder(per: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, near, same in _meetings(batches, per, False):
            edges = _trees(near, ids, others, same)
            if edges:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])

    return bound


def _linker(per: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"a": [], "b": [], "links": []}
        for sigs, others, linked, same in _meetings(batches, per, True):
            for mine, theirs, hits in ((sigs, others, linked), *([] if same else [(others, sigs, linked.T)])):
                order = sorted(range(len(theirs)), key=theirs.__getitem__)
                hits = hits[:, order]
                for i in np.flatnonzero(hits.any(1)):
                    held["a"].append(mine[i])
                    held["b"].append(theirs[order[int(hits[i].argmax())]])
                    held["links"].append(int(hits[i].sum()))
            if not same or len(sigs) > 2:
                # The least partner of each row may leave parts of one component apart; stars join them.
                for a, b in _trees(linked, sigs, others, same):
                    held["a"].append(a)
                    held["b"].append(b)
                    held["links"].append(0)
            if len(held["a"]) > 20_000:
                yield pa.record_batch([pa.array(held["a"], pa.binary()), pa.array(held["b"], pa.binary()), pa.array(held["links"], pa.int64())], names=list(held))
                held = {k: [] for k in held}
        yield pa.record_batch([pa.array(held["a"], pa.binary()), pa.array(held["b"], pa.binary()), pa.array(held["links"], pa.int64())], names=list(held))

    return link


def _trees(linked: np.ndarray, ids: list, others: list, same: bool) -> list[tuple]:
    """(least id, id) for the other ids of each connected part of the links, so that every part is one star."""
    n, m = linked.shape
    new_row, new_col = np.ones(n, bool), np.ones(m, bool)
    out = []
    for root in range(n):
        if not new_row[root]:
            continue
        new_row[root] = False
        if same:
            new_col[root] = False
        part, todo = {ids[root]}, [(root, True)]
        while todo:
            at, is_row = todo.pop()
            fresh = np.flatnonzero(linked[at] & new_col if is_row else linked[:, at] & new_row).tolist()
            if is_row:
                new_col[fresh] = False
                part.update(others[j] for j in fresh)
                if same:
                    new_row[fresh] = False
                todo += [(j, same) for j in fresh]
            else:
                new_row[fresh] = False
                part.update(ids[i] for i in fresh)
                todo += [(i, True) for i in fresh]
        if len(part) > 1:
            least = min(part)
            out += [(least, x) for x in part if x != least]
    return out


def _met(sets: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over each pair of blocks of each cluster; sets: id, cluster, blocks, top, n_shingles, packed."""
    placed = sets.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("id", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "top", "n_shingles", "packed")
    keys = ["cluster", "low", "high"]
    return placed.repartition(partitions(sets.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(kernel, schema)


def _sized(inside: DataFrame, row: str, size) -> DataFrame:
    """``inside`` with the number of blocks of its row's cluster; ``size``: the bytes of a row's packed set.

    Most clusters are one block; the others' numbers are copied over salts, so that no task gathers a large cluster.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / BLOCK_BYTES)).cast("int")
    many = inside.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1")
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = inside.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    return salted.join(many, ["cluster", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("salt")


def _near(pairs: DataFrame, places: DataFrame, bits: DataFrame, per: int) -> DataFrame:
    """(node, label): components that hold every linked pair; pairs: (key, a, b), the meetings as hub and other node.

    Rows of a hot hub or a hot meeting are dealt over salts.
    """
    edges = settle(pairs.select("a", "b").distinct())
    degree = settle(edges.groupBy("a").agg(F.count("*").alias("n")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = settle(places.join(nodes, "node").join(bits, ["rep", "sig"]).select("node", "own", "top", "n_shingles", "packed"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("packed").alias(f"bits_{name}"))

    both = joined_back(edges, settle(degree.join(side("a"), "a")), ["a"], ["b"]).join(side("b"), "b")
    close = settle(both.mapInArrow(_closer(per), "a long, b long"))

    labels = components(close)
    hubs = settle(degree.join(labels.toDF("a", "of_a"), "a", "left").select("a", "n", F.coalesce("of_a", "a").alias("of_a")))
    apart = joined_back(edges, hubs, ["a"], ["b"]).join(labels.toDF("b", "of_b"), "b", "left").where(F.coalesce("of_b", "b") != F.col("of_a"))
    # A meeting of two is settled by its one pair. Meetings of the same sets are told by two sums of hashes.
    open_keys = pairs.join(apart.select("a", "b"), ["a", "b"], "left_semi").select("key").distinct()
    one, two = F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", F.lit(1), "a").cast("decimal(38,0)"))
    meetings = pairs.groupBy("key").agg(F.count("*").alias("n"), F.first("a").alias("a"), one.alias("one"), two.alias("two")).where("n > 1")
    meetings = settle(meetings.join(open_keys, "key", "left_semi").groupBy("a", "n", "one", "two").agg(F.min("key").alias("key")).select("key", "a", "n"))
    others = joined_back(pairs.select("key", "b"), meetings.select("key", "n"), ["key"], ["b"])
    inside = others.toDF("cluster", "node").unionByName(meetings.select(F.col("key").alias("cluster"), F.col("a").alias("node")))
    inside = settle(inside.join(sets.select("node", "own"), "node"))
    inside = _sized(inside, "node", F.pow(F.lit(100 / per), F.col("own")) / 2).drop("own")
    found = _met(inside.join(sets.drop("own"), "node").withColumnRenamed("node", "id"), _bounder(per), "a long, b long")
    return components(close.unionByName(found))


def jaccard_links(docs: DataFrame, k: int = 5, per: int = 80) -> DataFrame:
    """Links documents whose sets of k-word shingles have a Jaccard similarity of at least per / 100.

    Words are runs of characters other than space and tab to carriage return, with A-Z lower-cased; a
    text of fewer than k words has its whole sequence as one shingle; a text without words, or a null one,
    has the empty set and links with nothing. The test is in integers: 100 * intersection >= per * union.

    Returns (doc_id, n_shingles, component_id, n_links) for every input row: the least doc_id that links
    reach, and the number of *different* sets linked with the row's own. Rows with equal sets are one class
    with one component; copies are never expanded. Repeated rows come back as often as they came. A row
    without doc_id has a null component_id and links with nothing. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(docs.mapInArrow(_signer(k, per), "doc_id long, n_shingles long, sig binary, own int, bits binary"))
    named = docs.where("doc_id is not null")
    keys = named.mapInArrow(_keyer(k, per), "key long, node long")
    pairs = settle(keys.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_stars, "key long, a long, b long"))

    rows = signed.where("sig is not null and doc_id is not null")
    classes = rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("own").alias("own"), F.count("*").alias("n"))
    short = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    places = classes.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    low = short.bitwiseXOR((F.col("own") + F.col("up") + 1) * F.lit(NODE)).bitwiseAND(F.lit((1 << 63) - 1))
    node = F.when(F.col("up") == 0, low.bitwiseOR(F.expr("shiftleft(1L, 63)"))).otherwise(low)
    places = places.select("sig", "rep", "n_shingles", "own", node.alias("node"), (F.col("up") == 0).alias("top"))
    bits = rows.groupBy(F.col("doc_id").alias("rep"), "sig").agg(F.first("bits").alias("packed"))
    near = _near(pairs, places, bits, per)

    inside = _sized(places.join(near.withColumnRenamed("label", "cluster"), "node"), "node", F.col("n_shingles") * 8)
    inside = inside.groupBy(F.col("sig").alias("id"), F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("cluster", "blocks", "top", "n_shingles")).alias("places"))
    # Repeated rows are packed once.
    packed = inside.join(named, "doc_id").groupBy("doc_id", "id").agg(F.first("places").alias("places"), F.first("text").alias("text"))
    packed = packed.select("id", "places", "text").mapInArrow(_packer(k), f"id binary, places {inside.schema['places'].dataType.simpleString()}, packed binary")
    links = settle(_met(packed.select("id", F.inline("places"), "packed"), _linker(per), "a binary, b binary, links long"))

    joined = components(links)
    counted = links.groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("n_links"))
    classes = settle(classes.select("sig", "rep", F.col("n").alias("n_rows")).join(joined.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")))
    least = settle(classes.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    classes = joined_back(classes, least, ["label"], ["sig"]).join(counted, "sig", "left").select("sig", F.col("n_rows").alias("n"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = signed.where("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined_back(rows.select("doc_id", "n_shingles", "sig"), settle(classes), ["sig"], ["doc_id"]).select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, per: int = 80) -> DataFrame:
    """``docs`` with one row of each component of linked texts: that of the least doc_id.

    Rows are told apart by a digest of doc_id and text, so that rows without doc_id take part; they come first in
    the order, as in the other stages. Of repeated rows (equal doc_id and text) one stays. Rows without words are in no component and stay.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = jaccard_links(keyed.select(F.col("_key").alias("doc_id"), "text"), k, per).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("label")).distinct()
    places = keyed.groupBy("_key").agg(F.first("doc_id").alias("id")).join(found, "_key")
    first = settle(places.groupBy("label").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "_key")).alias("first")).select(F.col("first._key").alias("_first")))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(worded).join(first, F.col("_key") == F.col("_first"), "left_semi").dropDuplicates(["_key"])
    return kept.unionByName(keyed.where(~worded)).select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 of 100 of their 4-word shingles."""
    return jaccard_links(table(spark, sf_dir, "documents"), k=4, per=85).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
