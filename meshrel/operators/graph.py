"""Fixpoint operators over edges (a, b): components, hop distances, envelopes, cycles, boundary loops.

Each is a loop of joins and aggregates on the driver; the state of a round is written by a reliable
checkpoint, so that plans stay short and a lost executor costs one round. Edges with a null end are ignored.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import topology

#: Hops of a node that no seed reaches within the bound.
UNREACHED = 2**31 - 1
#: Nodes of a block of the envelope, and the nodes or edges that one task may hold of it.
BLOCK_NODES, BLOCK_EDGES = 2**16, 2**21


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names.

    Spark hands the estimated size of a plan on to its checkpoint, and that of a join is the product of its sides:
    joined with itself, it has twice the digits after each round, which fill the driver after some twenty. So only
    the checkpoint's rows are taken over, without the estimate.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; other columns stay."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.where("a is not null and b is not null").select(F.inline(F.array(F.struct("a", "b", *rest), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), *rest)))).distinct()


def component_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, label): the least node of each node's component; ``nodes`` (v) adds isolated ones, labelled by themselves.

    A round hangs every node on the least label around it, then lets labels follow their own label, so the
    number of rounds grows with the logarithm of the diameter in all but contrived cases.
    """
    pairs = settle(both_ways(edges.select("a", "b")))
    known = pairs.select(F.col("a").alias("v"))
    known = (known if nodes is None else known.unionByName(nodes.select("v"))).distinct()
    labels = settle(known.select("v", F.col("v").alias("label")))
    while True:
        of = labels.select(F.col("v").alias("b"), F.col("label").alias("seen"))
        around = pairs.join(of, "b").groupBy(F.col("a").alias("v")).agg(F.min("seen").alias("seen"))
        hung = labels.join(around, "v", "left").withColumn("near", F.least("label", F.coalesce("seen", "label")))
        # A root takes the least label that any of its nodes has seen.
        roots = hung.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("lower"))
        hung = hung.join(roots, hung["label"] == roots["root"]).select("v", "label", F.least("near", "lower").alias("next"))
        hung = settle(hung)
        jump = hung.select(F.col("v").alias("next"), F.col("next").alias("far"))
        after = settle(hung.join(jump, "next").select("v", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")))
        labels = after.select("v", "label")
        if not after.where("moved").limit(1).count():
            return labels


def parity_labels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, label, parity, consistent) for edges (a, b, sign in 0, 1): parities that differ over edges of sign 1.

    Every node stands twice, once for each parity; ``parity`` is relative to the least node of the component.
    A component in which both stand together admits no such parities.
    """
    doubled = edges.select(F.inline(F.array(*[F.struct((F.col("a") * 2 + p).alias("a"), (F.col("b") * 2 + F.expr(f"sign ^ {p}")).alias("b")) for p in (0, 1)])))
    twice = None if nodes is None else nodes.select(F.explode(F.array(F.col("v") * 2, F.col("v") * 2 + 1)).alias("v"))
    code = component_labels(doubled, twice)
    even, odd = F.max(F.when(F.col("v") % 2 == 0, F.col("label"))), F.max(F.when(F.col("v") % 2 == 1, F.col("label")))
    both = code.groupBy(F.floor(F.col("v") / 2).alias("v")).agg(even.alias("even"), odd.alias("odd"))
    return both.select("v", F.floor(F.col("even") / 2).alias("label"), (F.col("even") % 2).cast("int").alias("parity"), (F.col("even") != F.col("odd")).alias("consistent"))


def hop_distances(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, max_hops: int) -> DataFrame:
    """(v, hops) of all ``nodes``: edges to the nearest of ``seeds`` (v), UNREACHED beyond ``max_hops``."""
    pairs = settle(both_ways(edges.select("a", "b")))
    front = settle(seeds.select("v").distinct())
    reached = front.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        step = pairs.join(front.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        front = settle(step.join(reached, "v", "left_anti"))
        if not front.limit(1).count():
            break
        reached = reached.unionByName(front.withColumn("hops", F.lit(hop)))
    return nodes.select("v").join(reached, "v", "left").select("v", F.coalesce("hops", F.lit(UNREACHED)).alias("hops"))


def expand_selection(edges: DataFrame, chosen: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """The nodes within ``hops`` edges of ``chosen``."""
    return hop_distances(edges, chosen, nodes, hops).where(F.col("hops") <= hops).select("v")


def shrink_selection(edges: DataFrame, chosen: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """The nodes of ``chosen`` with no node outside it within ``hops`` edges."""
    outside = nodes.select("v").join(chosen.select("v"), "v", "left_anti")
    return hop_distances(edges, outside, nodes, hops).where(F.col("hops") > hops).select("v")


def path_envelope(edges: DataFrame, values: DataFrame, max_rounds: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(v, value) lowered to the least of value(u) + d(u, v) over edges (a, b, w >= 0), both ways.

    With ``max_rounds`` each round relaxes over one more edge. With 0 nothing is left to lower: blocks of about ``block_nodes``
    nodes near in id are settled whole, then offer each other what their cross edges give, until none takes an offer, so
    rounds follow the blocks that a path passes. Blocks too heavy for a task, and ids or values that are no numbers of
    64 bits, take the way of one edge a round.
    """
    pairs = settle(both_ways(edges.select("a", "b", "w")))
    state, done = settle(values.select("v", "value")), 0
    dealt = None if max_rounds else _dealt(pairs, state, block_nodes)
    if dealt is not None:
        return _envelope_by_blocks(*dealt)
    while True:
        over = pairs.join(state.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min(F.col("value") + F.col("w")).alias("over"))
        after = settle(state.join(over, "v", "left").select("v", F.least("value", "over").alias("value"), (F.col("over") < F.col("value")).alias("moved")))
        state, done = after.select("v", "value"), done + 1
        if done == max_rounds or not after.where("moved").limit(1).count():
            return state


def _dealt(pairs: DataFrame, state: DataFrame, block_nodes: int) -> tuple[DataFrame, DataFrame] | None:
    """(block, v, value) and (block, other, a, b, w), the blocks of b and a; none if a block would not do."""
    kinds = dict(state.dtypes) | dict(pairs.dtypes)
    if not {kinds[c] for c in "vab"} <= {"int", "bigint"} or "double" not in (kinds["value"], kinds["w"]):
        return None
    parts = max(1, -(-state.count() // block_nodes))
    bounds = state.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    block = lambda c: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(c))) if bounds else F.lit(0)
    known = lambda c: state.select(F.col("v").alias(c))
    links = pairs.withColumn("w", F.col("w").cast("double")).where("w is not null and not isnan(w)").join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi")
    links = settle(links.select(block("b").alias("block"), block("a").alias("other"), "a", "b", "w"))
    nodes = settle(state.select(block("v").alias("block"), "v", F.col("value").cast("double").alias("value")))
    most = lambda df: df.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most(nodes) > BLOCK_EDGES or most(links.where("block = other")) > BLOCK_EDGES:
        return None
    return nodes, links


def _envelope_by_blocks(state: DataFrame, links: DataFrame) -> DataFrame:
    inner, cross = links.where("block = other").select("block", "a", "b", "w"), links.where("block <> other")
    nodes, near, first = state.withColumn("over", F.col("value")), inner, True
    while True:
        low = settle(nodes.groupBy("block").cogroup(near.groupBy("block")).applyInPandas(_settled_block, "v long, low double"))
        state = settle(state.join(low, "v", "left").select("block", "v", F.coalesce("low", "value").alias("value")))
        source = state.select(F.col("v").alias("a"), F.col("value").alias("low")) if first else low.withColumnRenamed("v", "a")
        offers = cross.join(source, "a").groupBy(F.col("b").alias("v")).agg(F.min(F.col("low") + F.col("w")).alias("over"))
        offers, first = settle(offers.join(state, "v").where("over is not null and (value is null or over < value)").select("block", "v", "over")), False
        if offers.isEmpty():
            return state.select("v", "value")
        open_ = F.broadcast(offers.select("block").distinct())
        nodes = state.join(open_, "block", "left_semi").join(offers.select("v", "over"), "v", "left")
        near = inner.join(open_, "block", "left_semi")


def _settled_block(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(v, low) of a block's nodes (v, value, over) that the offers ``over`` lower, along its edges (a, b, w): Dijkstra's."""
    nodes = nodes.sort_values("v")
    v, value, over = nodes["v"].to_numpy(), nodes["value"].fillna(np.inf).to_numpy(), nodes["over"].fillna(np.inf).to_numpy()
    edges = edges.sort_values("a")
    first = np.searchsorted(edges["a"].to_numpy(), v, "left").tolist()
    last = np.searchsorted(edges["a"].to_numpy(), v, "right").tolist()
    ends, w = np.searchsorted(v, edges["b"].to_numpy()).tolist(), edges["w"].tolist()
    best = np.minimum(value, over).tolist()
    heap = [(over[i].item(), i) for i in np.flatnonzero(over < np.inf).tolist()]
    heapq.heapify(heap)
    while heap:
        x, i = heapq.heappop(heap)
        if x > best[i]:
            continue
        for k in range(first[i], last[i]):
            if (y := x + w[k]) < best[ends[k]]:
                best[ends[k]] = y
                heapq.heappush(heap, (y, ends[k]))
    found = np.array(best, dtype="float64")
    return pd.DataFrame({"v": v[found < value], "low": found[found < value]})


def successor_cycles(edges: DataFrame) -> DataFrame:
    """(cycle, pos, v) of the cycles of a -> b: from its least node, which names it, along the edges.

    Pointer doubling: after steps of more than the number of nodes only nodes on a cycle are hit, and the
    least node seen is that of the cycle. A second doubling, which stops at the least node, ranks them. Of
    several successors the least counts; chains that lead into a cycle or end are in no cycle.
    """
    start = settle(edges.where("a is not null and b is not null").groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")))
    n = start.count()
    jump = start.withColumn("least", F.col("v"))
    span = 1
    while span <= n:
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("least").alias("other"))
        jump, span = settle(jump.join(ahead, "to").select("v", F.col("far").alias("to"), F.least("least", "other").alias("least"))), span * 2
    ring = start.join(jump.select("v", F.col("least").alias("cycle")), "v").join(jump.select(F.col("to").alias("v")).distinct(), "v", "left_semi")
    ring = settle(ring.select("cycle", "v", "to"))
    rank = ring.withColumn("left", F.when(F.col("v") == F.col("cycle"), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    rank = rank.withColumn("to", F.when(F.col("v") == F.col("cycle"), F.col("v")).otherwise(F.col("to")))
    span = 1
    while span <= n:
        ahead = rank.select(F.col("v").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        rank, span = settle(rank.join(ahead, "to").select("cycle", "v", F.col("far").alias("to"), (F.col("left") + F.col("more")).alias("left"))), span * 2
    size = rank.groupBy("cycle").agg(F.count("*").alias("size"))
    return rank.join(size, "cycle").select("cycle", ((F.col("size") - F.col("left")) % F.col("size")).alias("pos"), "v")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(cycle, pos, v) of the loops along the boundary; at a vertex where loops touch, its least successor counts."""
    return successor_cycles(topology.boundary_edges(faces).select(F.col("org").alias("a"), F.col("dst").alias("b")))


def loop_measures(vertices: DataFrame, loops: DataFrame) -> DataFrame:
    """(cycle, n, perimeter, ax, ay, az): length and directed area of each loop."""
    at = loops.join(vertices, "v").select("cycle", "pos", "x", "y", "z")
    size = loops.groupBy("cycle").agg(F.count("*").alias("size"))
    follow = at.join(size, "cycle").select("cycle", ((F.col("pos") + F.col("size") - 1) % F.col("size")).alias("pos"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    cross = lambda p, q: F.sum(F.col(p) * F.col(f"{q}1") - F.col(q) * F.col(f"{p}1")) / 2
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(c)) ** 2 for c in "yz"), (F.col("x1") - F.col("x")) ** 2))
    return at.join(follow, ["cycle", "pos"]).groupBy("cycle").agg(F.count("*").alias("n"), F.sum(length).alias("perimeter"), cross("y", "z").alias("ax"), cross("z", "x").alias("ay"), cross("x", "y").alias("az"))


def longest_loop(loops: DataFrame) -> DataFrame:
    """(pos, v) of the loop of most vertices; of several, that of the least vertex."""
    best = loops.groupBy("cycle").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "cycle")).alias("best")).select(F.col("best.cycle").alias("cycle"))
    return loops.join(best, "cycle", "left_semi").select("pos", "v")


def face_components(faces: DataFrame) -> DataFrame:
    """(f, label): components of faces over edges that two share, labelled by the least face."""
    pairs = topology.face_adjacency(faces).select(F.col("f0").alias("a"), F.col("f1").alias("b"))
    return component_labels(pairs, faces.select(F.col("f").alias("v"))).select(F.col("v").alias("f"), "label")
