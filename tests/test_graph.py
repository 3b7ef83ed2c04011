import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from meshrel.operators import creation as C
from meshrel.operators import geometry, topology
from meshrel.operators import graph as G


def test_components_of_a_path_a_hub_and_loose_nodes(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    nodes = spark.createDataFrame([(v,) for v in [*range(100, 161), *range(500, 540), 7, 8]], "v long")
    found = dict(map(tuple, G.component_labels(spark.createDataFrame(edges, "a long, b long"), nodes).collect()))
    assert found == {**{v: 100 for v in range(100, 161)}, **{v: 500 for v in range(500, 540)}, 7: 7, 8: 8}


def test_components_of_no_edges(spark):
    assert G.component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_of_an_odd_ring_is_inconsistent(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 0, 1), (5, 6, 1), (6, 7, 0)], "a long, b long, sign int")
    rows = {r.v: (r.label, r.parity, r.consistent) for r in G.parity_labels(edges).collect()}
    assert [rows[v][2] for v in (0, 1, 2)] == [False] * 3
    assert rows[5] == (5, 0, True) and rows[6] == (5, 1, True) and rows[7] == (5, 1, True)


def test_cycles_start_at_the_least_node_and_chains_are_none(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (4, 5), (6, 7), (9, 9)], "a long, b long")
    assert sorted(map(tuple, G.successor_cycles(edges).collect())) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (4, 1, 5), (9, 0, 9)]


def test_a_chain_that_meets_a_cycle_is_not_of_it(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1)], "a long, b long")
    assert sorted(map(tuple, G.successor_cycles(edges).collect())) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_the_estimated_size_does_not_grow_with_the_rounds(spark):
    state, sizes = G.settle(spark.range(4).select(F.col("id").alias("v"), F.col("id").alias("to"))), []
    for _ in range(6):
        state = G.settle(state.join(state.select(F.col("v").alias("to"), F.col("to").alias("far")), "to").select("v", F.col("far").alias("to")))
        sizes.append(int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert state.count() == 4 and sizes[-1] <= sizes[0]


def test_envelope_agrees_with_dijkstra(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 9))) for _ in range(70)]
    start = {v: float(rng.randrange(60)) for v in range(40)}
    best, heap = dict(start), [(x, v) for v, x in start.items()]
    heapq.heapify(heap)
    while heap:
        x, v = heapq.heappop(heap)
        for a, b, w in edges:
            for p, q in ((a, b), (b, a)):
                if p == v and x + w < best[q]:
                    best[q] = x + w
                    heapq.heappush(heap, (x + w, q))
    found = G.path_envelope(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame(list(start.items()), "v long, value double"))
    assert dict(map(tuple, found.collect())) == best


@pytest.mark.parametrize("block_nodes", [2**16, 60])
def test_envelope_takes_few_rounds_on_a_long_path(spark, monkeypatch, block_nodes):
    rounds, settle = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df: settle(df) if len(rounds) < 24 and not rounds.append(1) else pytest.fail("too many rounds"))
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(199)] + [(7, 9999, 1.0), (3, 4, None)], "a long, b long, w double")
    values = spark.createDataFrame([(v, 10.0 if v == 0 else None if v == 50 else 1000.0) for v in range(201)], "v long, value double")
    kwargs = {} if block_nodes == 2**16 else {"block_nodes": block_nodes}
    found = dict(map(tuple, G.path_envelope(edges, values, **kwargs).collect()))
    assert found == {**{v: 10 + v / 2 for v in range(200)}, 200: 1000.0}


def test_hops_stop_at_the_bound(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(8)], "v long")
    found = dict(map(tuple, G.hop_distances(edges, nodes.where("v = 0"), nodes, 3).collect()))
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, **{v: G.UNREACHED for v in (4, 5, 6, 7)}}
    assert sorted(r.v for r in G.shrink_selection(edges, nodes.where("v < 4"), nodes, 1).collect()) == [0, 1, 2]


def test_the_rim_of_a_grid_is_one_loop(spark):
    v, f = C.grid(spark, (5, 4), (4.0, 3.0), center=False)
    m = G.loop_measures(v, G.boundary_loops(f)).collect()
    assert len(m) == 1 and m[0].cycle == 0 and m[0].n == 14 and math.isclose(m[0].perimeter, 14) and math.isclose(m[0].az, 12)


def test_the_longest_loop_keeps_a_short_size_estimate(spark):
    """Estimates that grew with the rounds filled the driver."""
    _, f = C.grid(spark, (5, 4), (4.0, 3.0))
    found = G.longest_loop(G.boundary_loops(f))
    assert found.count() == 14 and int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**1000


def test_loop_measures_keep_a_short_size_estimate(spark):
    v, f = C.grid(spark, (5, 4), (4.0, 3.0))
    found = G.loop_measures(v, G.boundary_loops(f))
    assert found.count() == 1 and int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**1500


@pytest.mark.parametrize(
    "make, counts, euler, volume",
    [
        (lambda s: C.box(s, (1, 2, 3)), (8, 12), 2, 6.0),
        (C.tetrahedron, (4, 4), 2, 8 / (3 * 3**1.5)),
        (C.octahedron, (6, 8), 2, 4 / 3),
        (C.icosahedron, (12, 20), 2, 2.53615),
        (lambda s: C.icosphere(s, 1), (42, 80), 2, None),
        (lambda s: C.uv_sphere(s, 1.0, (7, 8)), (50, 96), 2, None),
        (lambda s: C.cylinder(s, 1.0, 2.0, 8), (18, 32), 2, 4 * math.sqrt(2)),
        (lambda s: C.cone(s, 1.0, 3.0, 8), (10, 16), 2, 2 * math.sqrt(2)),
        (lambda s: C.annulus(s, 0.5, 1.0, 1.0, 8), (32, 64), 0, None),
        (lambda s: C.torus(s, 2.0, 0.5, 8, 6), (48, 96), 0, None),
    ],
)
def test_generated_solids_are_closed_and_face_outwards(spark, make, counts, euler, volume):
    v, f = make(spark)
    assert (v.count(), f.count()) == counts
    assert topology.euler_characteristic(f).first().euler == euler
    flags = topology.validity(f).first()
    assert flags.watertight and flags.winding_consistent and flags.n_degenerate == 0
    found = geometry.measures(v, f).first().volume
    assert found > 0 and (volume is None or math.isclose(found, volume, rel_tol=1e-4))
