"""Similarity graphs, components and labels: brute force and the linear system's solution."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument, NotConverged, Unsupported
from tidegraph.graph import EdgeBatch, Graph
from tidegraph.operators import knn, labels
from tidegraph.operators.components import connected_components
from tidegraph.operators.knn import knn_graph, nearest_by_cosine
from tidegraph.sources.generators import vertex_arrivals
from tidegraph.testing.oracles import harmonic_labels, propagated_labels
from tidegraph.update import update


def test_nearest_by_cosine_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "id AS block", "id AS u")
    got = {}
    for r in nearest_by_cosine(df, 4).collect():
        got.setdefault(r.u, []).append((r["rank"], r.v))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.minimum(unit @ unit.T, 1)
    np.fill_diagonal(s, -2)
    for u in range(60):
        want = sorted(range(60), key=lambda v: (-s[u, v], v))[:4]
        assert [v for _, v in sorted(got[u])] == want
    edges = knn_graph(df, 4, "shift")
    assert edges.where("w <= 0 OR w > 1").count() == 0
    assert edges.join(edges.selectExpr("dst AS src", "src AS dst"), ["src", "dst"], "left_anti").count() == 0
    assert nearest_by_cosine(df.limit(0), 4).count() == 0


def test_nearest_over_many_panels(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 4)
    monkeypatch.setattr(knn, "PANEL_BYTES", 8 * 4 * 5 * 2)  # two blocks of four vectors of five components
    x = np.random.default_rng(6).integers(-2, 3, size=(70, 5)).astype(float)  # many equal cosines
    x[~x.any(1)] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {}
    for r in nearest_by_cosine(df, 3).collect():
        got.setdefault(r.u, []).append((r["rank"], r.v, r.s))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.minimum(unit @ unit.T, 1)
    np.fill_diagonal(s, -2)
    for u in range(70):
        own = sorted(got[u])
        assert np.allclose([v for _, _, v in own], np.sort(s[u])[::-1][:3]) and np.allclose([s[u, v] for _, v, _ in own], [v for _, _, v in own])
        assert len({v for _, v, _ in own}) == 3


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for u, v in pairs:
        if u != v:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {v: root(v) for u, v in [(u, x) for u, w in pairs if u != w for x in (u, w)]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def numbers(result):
    return [r.label for r in sorted(result.labels().collect())]


def test_labels_follow_a_stream(spark):
    stream = vertex_arrivals(spark, 60, 4, 2, seed=3, ground_truth_fraction=0.15)
    graph = stream.graph()
    tau = stream.similarity_threshold
    damped = labels.compute(graph, update_schedule="damped", similarity_threshold=tau, tolerance=5e-3)
    in_place = labels.compute(graph, tolerance=5e-3)
    assert numbers(damped) == [0.5] * 60
    for b in stream.batches():
        stats = update(graph, b, damped, in_place)
        assert all(s.converged for s in stats)
    status = {r.id: (r.status, r.seed) for r in graph.status.collect()}
    active = {v for v, (s, _) in status.items() if s == 1}
    seeds = {v: c for v, (_, c) in status.items() if c >= 0}
    arcs = [(r.src, r.dst, r.w0) for r in graph.edges.collect()]
    want = harmonic_labels(60, arcs, seeds, active)
    for result in (damped, in_place):
        got = numbers(result)
        assert all(got[v] == c for v, c in seeds.items())
        assert max(abs(got[v] - want[v]) for v in active) < 0.1
    fresh = labels.compute(graph, spark.createDataFrame([(v, c) for v, c in seeds.items() if v in active], "id long, label int"), tolerance=1e-4)
    assert max(abs(numbers(fresh)[v] - want[v]) for v in active) < 1e-2
    assert fresh.accuracy(stream.true_labels()) > 0.6
    assert stream.row_capacity().agg(F.sum("capacity")).first()[0] == 2 * stream.edges.count()


def test_first_labels_of_components(spark):
    arrived = spark.createDataFrame([(1, -1), (2, -1), (3, -1), (4, 1)], "id long, label tinyint")
    edges = [(1, 2, 0.9), (2, 3, 0.1), (1, 10, 0.5), (2, 11, 0.25), (3, 12, 1.0)]
    both = spark.createDataFrame(edges + [(v, u, w) for u, v, w in edges], "src long, dst long, w float")
    seeds = spark.createDataFrame([(10, 0), (11, 1), (4, 1), (1, -1)], "id long, seed int")
    start = labels.start_labels(arrived, both, both, seeds, 0.5)
    got = {r.id: round(r.label, 6) for r in start.labels.collect()}
    assert got == {1: round(0.25 / 0.75, 6), 2: round(0.25 / 0.75, 6), 3: 0.5, 4: 1.0}
    assert (start.components, start.edges) == (3, 1)


def test_vertex_batches_have_their_net_effect(spark):
    g = Graph.with_capacity(spark, 6)
    s = g.apply(EdgeBatch.of(spark, [(0, 1, 0.5), (1, 2, 0.5), (0, 5, 0.5)], [], [(0, 1), (1, -1), (2, 0)], [2], True))
    assert (s.inserted_vertices, s.deleted_vertices, s.inserted_edges, s.dropped_insertions) == (2, 0, 1, 2)
    assert g.num_active() == 2
    with pytest.raises(InvalidArgument):
        g.apply(EdgeBatch.of(spark, insert_vertices=[2]))
    with pytest.raises(Unsupported):
        g.apply(EdgeBatch.of(spark, delete=[(0, 1)]))
    s = g.apply(EdgeBatch.of(spark, delete_vertices=[1, 4]))
    assert s.deleted_vertices == 1 and g.live_edges().count() == 0 and g.version == 2


def test_halves_are_the_mixing_on_32_bits(spark):
    def half(v, tag):
        x = (v ^ (tag * 0x9E3779B9)) & 0xFFFFFFFF
        x ^= x >> 16
        x = x * 0x7FEB352D & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x846CA68B & 0xFFFFFFFF
        x ^= x >> 16
        return x & 1

    for tag in (0, 1, 77):
        rows = spark.range(3000).select("id", labels.half(F.col("id"), tag).alias("h")).collect()
        assert all(r.h == half(r.id, tag) for r in rows)


def test_seeds_of_both_classes_and_isolated_vertices(spark):
    from tidegraph.plans.registry import SIMILAR

    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.25), (5, 6, 1.0)], "src long, dst long, w0 float")
    seeds = spark.createDataFrame([(0, 0), (3, 1), (7, 1)], "id long, label int")
    got = numbers(labels.compute(Graph.from_edges(edges, 9, SIMILAR), seeds, tolerance=1e-6))
    want = harmonic_labels(9, [(r[0], r[1], r[2]) for e in edges.collect() for r in (e, (e[1], e[0], e[2]))], {0: 0, 3: 1, 7: 1})
    assert np.allclose(got, want, atol=1e-4) and got[0] == 0.0 and got[3] == got[7] == 1.0 and got[4] == got[5] == got[8] == 0.5


@pytest.mark.parametrize("schedule", ["damped", "in_place"])
def test_rounds_follow_the_plain_model(spark, schedule):
    rng = np.random.default_rng(6)
    pairs = {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))): float(np.float32(rng.uniform(0.1, 1))) for _ in range(90)}
    arcs = [(u, v, w) for u, v, w in ((a, b, w) for (a, b), w in pairs.items())] + [(b, a, w) for (a, b), w in pairs.items()]
    seeds = {0: 0, 1: 1, 2: 1}
    first = {v: float(seeds.get(v, 0.5)) for v in range(40)}
    free, front = set(range(40)) - set(seeds) - {39}, set(range(3, 30))
    want, rounds = propagated_labels(arcs, first, free, front, 1e-3, schedule, 5)
    rows = [(v, first[v], seeds.get(v, -1), v != 39, v in front) for v in range(40)]
    state = spark.createDataFrame(rows, "id long, label float, seed int, active boolean, front boolean")
    got, n, _, done = labels.propagate(spark.createDataFrame(arcs, "src long, dst long, w float"), state, schedule, 1e-3, 1_000, 5)
    assert done and n == rounds
    assert all(abs(r.label - want[r.id]) < 1e-6 for r in got.collect())


def test_limits_and_options(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5)], "src long, dst long, w0 float")
    from tidegraph.plans.registry import SIMILAR

    g = Graph.from_edges(edges, 3, SIMILAR)
    seeds = spark.createDataFrame([(0, 0), (2, 1)], "id long, label int")
    assert abs(numbers(labels.compute(g, seeds))[1] - 0.5) < 1e-3
    with pytest.raises(NotConverged):
        labels.compute(g, spark.createDataFrame([(0, 0)], "id long, label int"), max_iterations=1, tolerance=1e-9, on_iteration_limit="error")
    with pytest.raises(InvalidArgument):
        labels.compute(g, seeds, tolerance=0)
    with pytest.raises(InvalidArgument):
        labels.compute(g, spark.createDataFrame([(9, 0)], "id long, label int"))
