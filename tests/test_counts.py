"""Cycles, triangles and triads: worked examples, chains of batches against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph import hypergraph
from tidegraph.errors import InvalidArgument, OutOfRange, Unsupported
from tidegraph.functions.motifs import CLASSES, class_of_mask
from tidegraph.graph import EdgeBatch, Graph, Properties, Semantics
from tidegraph.hypergraph import HyperBatch, HyperProperties, Hypergraph
from tidegraph.operators import cycles, hyper_sssp, patterns, triads, triangles
from tidegraph.operators.problems import AggregateDeltaProblem
from tidegraph.sources import generators
from tidegraph.testing import oracles
from tidegraph.update import update


def directed(spark, edges, n):
    return Graph.from_edges(spark.createDataFrame(list(edges), "src long, dst long"), n, Properties.structural())


def test_cycle_example(spark):
    g = directed(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 0), (3, 1), (1, 0)], 4)
    r = cycles.compute(g, 4)
    assert r.counts == [0, 0, 1, 2, 1]
    cycles.update(g, EdgeBatch.of(spark, [(0, 3)], [(2, 0)]), r)
    assert r.to_dict() == {2: 2, 3: 2, 4: 1} and sum(r.removed.values()) == 1 and sum(r.added.values()) == 2


def test_cycles_over_chains_of_batches(spark):
    rng = random.Random(3)
    n = 9
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(26)}
    g = directed(spark, edges, n)
    r = cycles.compute(g, 5)
    for _ in range(2):
        dels = rng.sample(sorted(edges), 3) + [(0, 0), (8, 8)]
        ins = [(rng.randrange(n), rng.randrange(n)) for _ in range(4)] + dels[:1] + [(1, 1)]
        cycles.update(g, EdgeBatch.of(spark, ins, dels), r)
        loops = {e for e in edges if e[0] == e[1]}
        edges = (edges - {d for d in dels if d[0] != d[1]}) | {e for e in ins if e[0] != e[1]} | loops
        assert r.to_dict() == oracles.histogram(edges, 5)
    assert cycles.compute(g, n).to_dict() == oracles.histogram(edges, n)
    with pytest.raises(InvalidArgument):
        cycles.compute(g, 1)


@pytest.mark.parametrize("local", [0, 10**9])
def test_cycles_are_closed_from_halves(spark, monkeypatch, local):
    monkeypatch.setattr(cycles, "LOCAL", local)
    rng = random.Random(11)
    n = 40
    pairs = [(a, b) for a in range(8) for b in range(8)]  # a dense corner, the other vertices stay alone
    edges = set(rng.sample(pairs, 30))
    g = directed(spark, edges, n)
    assert cycles.compute(g, 7).to_dict() == oracles.histogram(edges, 7)
    r = cycles.compute(g, 6)
    dels, ins = rng.sample(sorted(edges), 6), rng.sample(pairs, 6)
    ins.append(dels[0])
    ins, dels = ([e for e in x if e[0] != e[1]] for x in (ins, dels))
    kept = edges - set(dels)
    before, after = oracles.histogram(edges, 6), oracles.histogram(kept | set(ins), 6)
    cycles.update(g, EdgeBatch.of(spark, ins, dels), r)
    same = oracles.histogram(kept, 6)
    assert r.to_dict() == after
    assert r.removed == {k: before[k] - same.get(k, 0) for k in before if before[k] > same.get(k, 0)}
    assert r.added == {k: after[k] - same.get(k, 0) for k in after if after[k] > same.get(k, 0)}


def test_no_path_is_longer_than_half_a_cycle(spark, monkeypatch):
    made = []
    longer = cycles._longer
    monkeypatch.setattr(cycles, "_longer", lambda p, e, name, n, *a: made.append(n) or longer(p, e, name, n, *a))
    edges = {(a, b) for a in range(6) for b in range(6)}
    assert cycles.compute(directed(spark, edges, 6), 4).to_dict() == oracles.histogram(edges, 4)
    assert max(made) == 2


def test_set_batches_count_their_no_ops(spark):
    g = directed(spark, [(0, 1), (1, 2)], 3)
    s = g.apply(EdgeBatch.of(spark, [(0, 1), (1, 2), (2, 2), (2, 0)], [(0, 1), (2, 1), (1, 1)]))
    assert (s.inserted_edges, s.deleted_edges, s.cancelled_pairs, s.ignored_insertions, s.ignored_deletions, s.dropped_self_loops) == (2, 1, 1, 1, 1, 2)
    with pytest.raises(Unsupported):
        Properties(semantics=Semantics(as_sets=True))


def test_triangle_example_and_chain(spark):
    props = Properties(directed=False, semantics=Semantics.sets())
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), 4, props)
    r = triangles.compute(g)
    assert r.total == 2
    triangles.update(g, EdgeBatch.of(spark, [(2, 3)]), r)
    assert r.total == 4
    triangles.update(g, EdgeBatch.of(spark, [], [(0, 1), (0, 2)]), r)
    assert (r.total, r.destroyed) == (1, 3)
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(40)}
    g = Graph.from_edges(spark.createDataFrame(sorted(pairs), "src long, dst long"), 12, props)
    r = triangles.compute(g)
    for _ in range(2):
        dels = rng.sample(sorted(pairs), 5)
        ins = [tuple(rng.sample(range(12), 2)) for _ in range(6)] + dels[:1]
        triangles.update(g, EdgeBatch.of(spark, ins, dels), r)
        pairs = (pairs - set(dels)) | {tuple(sorted(p)) for p in ins}
        assert r.total == oracles.triangle_count(pairs)


def test_classes_are_all_patterns_of_three_that_hang_together():
    table = class_of_mask()
    assert len(CLASSES) == 30 and len(set(CLASSES)) == 30

    def touching(m):  # at least two of the three pairs share a vertex
        return sum(bool(m & 64 or m >> b & 1) for b in (3, 4, 5)) >= 2

    closed = {m for m in range(128) if touching(m)}
    assert set(table) <= closed and {m for m in closed if m & 64} <= set(table)


HG = [[0, 1, 2], [1, 2, 3], [2, 3, 4], [0, 2, 4], [4, 5, 6], [5, 6, 7], [0, 4, 6, 8], [1, 3, 5, 7], [6, 7, 8, 9], [2, 8, 9], [3, 4, 5]]


def test_triads_over_two_batches(spark):
    h = Hypergraph.from_lists(spark, HG, num_vertices=10)
    r, one = triads.compute(h), triads.compute(h, "type1")
    assert (r.total, one.total) == (45, 20)
    assert {b: n for b, n in enumerate(r.counts) if n} == {3: 2, 9: 9, 14: 19, 15: 6, 28: 1, 29: 8}
    assert all(r.count(b) == 0 for b in range(20, 26))
    done = h.commit(HyperBatch.of(spark, delete=[1, 6], insert=[[0, 4, 8], [1, 2, 5, 9]]))
    assert [x.h for x in done.inserted.orderBy("seq").collect()] == [1, 6]
    update(h, HyperBatch.of(spark, delete=[1, 6], insert=[[0, 4, 8], [1, 2, 5, 9]]), r, one)
    assert (r.total, sum(r.removed.values()), sum(r.added.values()), one.total) == (53, 27, 35, 20)
    assert {b: d for b, d in enumerate(r.delta()) if d} == {3: 1, 9: 7, 14: -6, 15: -1, 27: 2, 29: 5}
    update(h, HyperBatch.of(spark, delete=[3], insert=[[2, 3, 4]]), r, one)
    assert (r.total, one.total) == (58, 20)
    assert {b: d for b, d in enumerate(r.delta()) if d} == {3: 2, 6: 7, 9: -5, 14: -3, 29: 4}


@pytest.mark.parametrize("reuse,want", [("erase_first", 1), ("insert_first", 3)])
def test_ids_that_are_given_again(spark, reuse, want):
    h = Hypergraph.from_lists(spark, [[0, 1, 2, 3], [4], [5, 6]], num_vertices=9, properties=HyperProperties(reuse=reuse))
    done = h.apply(HyperBatch.of(spark, delete=[1], insert=[[7, 8]]))
    assert done.inserted.first().h == want


@pytest.mark.parametrize("reuse", ["erase_first", "insert_first"])
def test_chains_of_all_kinds_of_hyperedge_batches(spark, reuse):
    n = 12
    start = [sorted(set(m)) for m in ([1, 2, 3], [3, 4], [4, 5, 6, 7, 8], [0, 11], [9], [2, 9, 10], [5, 6], [7, 8, 9, 10])]
    h = Hypergraph.from_lists(spark, start, [3, 1, 4, 1, 5, 9, 2, 6], n, HyperProperties(reuse=reuse, weighted=True))
    h.line_graph()
    model = oracles.SlotStore(start, reuse)
    weights = dict(enumerate([3, 1, 4, 1, 5, 9, 2, 6]))
    r, paths = triads.compute(h), hyper_sssp.compute(h, 2)
    kinds = ["incidence_mixed", "dead_ids", "larger"] if reuse == "erase_first" else ["incidence_same_batch", "reuse"]
    for i, mix in enumerate(kinds):
        b = generators.hyperedge_batch(h, mix, 3, seed=i)
        raw = {k: [tuple(x)[1:] for x in getattr(b, k).orderBy("seq").collect()] for k in ("deletes", "removals", "additions", "inserts")}
        ids = model.apply([x[0] for x in raw["deletes"]], raw["removals"], raw["additions"], [list(x[0]) for x in raw["inserts"]])
        s = update(h, b, r, paths)[0].batch
        asked = sum(map(len, raw.values()))
        assert s.inserted_hyperedges + s.deleted_hyperedges + s.inserted_incidences + s.deleted_incidences + s.skipped_ops - s.dropped_members == asked
        live = {x.h: list(x.members) for x in h.members().collect()}
        assert live == model.live, mix
        assert {x.h: x.length for x in h.slots.collect()} == model.length, mix
        h.check()
        weights = {k: w for k, w in weights.items() if k in model.live} | {k: x[1] for k, x in zip(ids, raw["inserts"])}
        sets = {k: set(m) for k, m in model.live.items()}
        assert {b_: c for b_, c in enumerate(r.counts) if c} == oracles.motif_counts(sets), mix
        pairs = {(x.a, x.b): x.overlap for x in h.line_graph().collect()}
        assert pairs == {(a, c): len(sets[a] & sets[c]) for a in sets for c in sets if a < c and sets[a] & sets[c]}, mix
        dist, parent = oracles.hyper_paths(sets, weights, 2)
        got = {x.h: (x.distance, x.parent) for x in paths.hyperedges().collect()}
        assert got == {k: (dist.get(k, 2**61 - 1), parent.get(k, -1)) for k in sets}, mix


def test_patterns(spark):
    h = Hypergraph.from_lists(spark, HG, num_vertices=10)
    sets = {i: set(m) for i, m in enumerate(HG)}
    tri = oracles.triads(sets)
    assert patterns.compute(h, patterns.line_graph_triangles()).total == len(tri) == 45
    pairs = [(a, b) for a in sets for b in sets if a < b]
    assert patterns.compute(h, patterns.strong_pairs(2)).total == sum(len(sets[a] & sets[b]) >= 2 for a, b in pairs)
    core = patterns.compute(h, patterns.core_triads())
    assert core.counts == [sum(min(2, len(sets[a] & sets[b] & sets[c])) == k for a, b, c in tri) for k in range(3)]
    hub = patterns.compute(h, patterns.hub_pairs(4))
    assert hub.total == sum(4 in sets[a] & sets[b] for a, b in pairs)
    batch = HyperBatch.of(spark, delete=[2, 7], remove=[(3, 0)], add=[(5, 4)], insert=[[4, 9], [1, 4, 5]])
    update(h, batch, core, hub)
    assert core.counts == patterns.compute(h, patterns.core_triads()).counts
    assert hub.total == patterns.compute(h, patterns.hub_pairs(4)).total
    with pytest.raises(InvalidArgument):
        patterns.Pattern("x", "squares", 1, lambda: None)


def test_triples_are_counted_by_shape(spark, monkeypatch):
    rng = random.Random(9)
    n = 11
    lists = [sorted({0, *rng.sample(range(n), rng.randint(0, 4))}) if i % 3 else rng.sample(range(n), rng.randint(1, 5)) for i in range(22)]
    h = Hypergraph.from_lists(spark, lists, num_vertices=n)
    listed = []
    whole = patterns.rows_of
    monkeypatch.setattr(patterns, "rows_of", lambda h, p: listed.append(p.name) or whole(h, p))
    r = triads.compute(h)
    sets = dict(enumerate(map(set, lists)))
    assert {b: c for b, c in enumerate(r.counts) if c} == oracles.motif_counts(sets)
    shapes = {tuple(x)[:-1]: int(x.times) for x in patterns.shapes(h.incidence, "triangles").where("times <> 0").collect()}
    assert sum(shapes.values()) == len(oracles.triads(sets)) and min(shapes.values()) > 0
    update(h, HyperBatch.of(spark, delete=[2, 7], remove=[(4, 0)], add=[(5, 10)], insert=[[4, 9], [1, 4, 5]]), r)
    sets = {x.h: set(x.members) for x in h.members().collect()}
    assert {b: c for b, c in enumerate(r.counts) if c} == oracles.motif_counts(sets)
    assert not listed


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(hypergraph, "PAIRS_A_PART", 20)
    h = Hypergraph.from_lists(spark, HG, num_vertices=10)
    sets = dict(enumerate(map(set, HG)))
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    whole = hypergraph.pairs_of(h.incidence)
    assert {(x.a, x.b): x.overlap for x in whole.collect()} == want
    # 66 meetings at vertices: four parts, and nothing is summed before the pairs are dealt
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f", {-(-sum(want.values()) // 20)}" in plan
    marked = hypergraph.pairs_of(h.incidence, spark.createDataFrame([(2,), (6,)], "h long"))
    assert {(x.a, x.b): x.overlap for x in marked.collect()} == {p: n for p, n in want.items() if {2, 6} & set(p)}


def test_weighted_statistics(spark):
    h = Hypergraph.from_lists(spark, HG, num_vertices=10)
    sets = [set(m) for m in HG]
    two = three = 0
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j])
            x, y = len(a) - s, len(sets[j]) - s
            two += s * (s - 1) // 2 * x * y if s >= 2 and x and y else 0
    for t in oracles.triads(dict(enumerate(sets))):
        a, b, c = (sets[i] for i in t)
        g = len(a & b & c)
        x, y, z = len(a & b) - g, len(b & c) - g, len(a & c) - g
        three += x * y * z
    assert [triads.compute(h, k).total for k in ("type1", "type2", "type3")] == [20, two, three]


def test_hyperpaths_over_two_batches(spark):
    lists = [[0, 1, 2], [2, 3], [3, 4, 5], [1, 6], [6, 7], [5, 7, 8], [8, 9], [9, 10, 11], [4, 11]]
    weights = [4, 2, 7, 9, 3, 1, 5, 2, 8]
    h = Hypergraph.from_lists(spark, lists, weights, 12, HyperProperties(weighted=True))
    r = hyper_sssp.compute(h, 0)
    model, w = oracles.SlotStore(lists), dict(enumerate(weights))
    for delete, remove, add, insert, new in (([3], [(5, 7)], [(1, 6)], [[0, 11]], [6]), ([6], [(0, 1)], [(8, 2)], [[3, 9]], [1])):
        ids = model.apply(delete, remove, add, insert)
        w |= dict(zip(ids, new))
        hyper_sssp.update(h, HyperBatch.of(spark, delete, remove, add, insert, new), r)
        dist, parent = oracles.hyper_paths({k: set(m) for k, m in model.live.items()}, w, 0)
        assert {x.h: (x.distance, x.parent) for x in r.hyperedges().collect()} == {k: (dist.get(k, 2**61 - 1), parent.get(k, -1)) for k in model.live}
        vertex = {x.v: x.distance for x in r.vertex_distances().collect()}
        assert vertex[0] == 0 and all(vertex[v] == min([dist[k] for k, m in model.live.items() if v in m and k in dist], default=2**61 - 1) for v in range(1, 12))
    with pytest.raises(OutOfRange):
        h.apply(HyperBatch.of(spark, insert=[[99]], weights=[1]))


def test_hyperpaths_write_no_line_graph(spark, monkeypatch):
    rng = random.Random(5)
    n, hub = 14, 3
    lists = [sorted({hub, *rng.sample(range(n), 2)}) if i % 2 else rng.sample(range(n), rng.randint(1, 4)) for i in range(24)]
    weights = [rng.randint(1, 6) for _ in lists]
    h = Hypergraph.from_lists(spark, lists, weights, n, HyperProperties(weighted=True))
    asked = []
    monkeypatch.setattr(Hypergraph, "line_graph", lambda self: asked.append("line graph"))
    monkeypatch.setattr(hypergraph.HyperCommit, "pair_delta", lambda self: asked.append("pairs"))
    source = lists[0][0]
    r = hyper_sssp.compute(h, source)
    model, w = oracles.SlotStore(lists), dict(enumerate(weights))
    for seed in range(2):
        rng = random.Random(seed)
        live = sorted(model.live)
        delete = rng.sample(live, 2)
        rest = [k for k in live if k not in delete]
        remove = [(k, model.live[k][0]) for k in rng.sample(rest, 3)]
        add = [(k, rng.randrange(n)) for k in rng.sample(rest, 3)]
        insert, new = [rng.sample(range(n), 3) for _ in range(3)], [rng.randint(1, 6) for _ in range(3)]
        ids = model.apply(delete, remove, add, insert)
        w |= dict(zip(ids, new))
        hyper_sssp.update(h, HyperBatch.of(spark, delete, remove, add, insert, new), r)
        dist, parent = oracles.hyper_paths({k: set(m) for k, m in model.live.items()}, w, source)
        assert {x.h: (x.distance, x.parent) for x in r.hyperedges().collect()} == {k: (dist.get(k, 2**61 - 1), parent.get(k, -1)) for k in model.live}
    assert not asked


def test_the_budget_of_hyperpaths_is_that_of_the_line_graph(spark):
    lists = [[i, i + 1] for i in range(12)]
    h = Hypergraph.from_lists(spark, lists, [1] * 12, 13, HyperProperties(weighted=True))
    assert hyper_sssp.least_entries(h) <= 2 * h.line_graph().count() == 22
    for budget, over in ((0.6, "none"), (0.4, "work_budget")):  # 11 hyperedges lose their values and get them back
        r = hyper_sssp.compute(h, 0, work_budget=budget)
        s = hyper_sssp.update(h, HyperBatch.of(spark, delete=[0], insert=[[0, 1]], weights=[2 if over == "none" else 3]), r)
        assert s.more["fallback_reason"] == over and (s.more["line_graph_deletions"], s.more["line_graph_insertions"]) == (1, 1)
        assert r.state.count() == 12


class Wedges(AggregateDeltaProblem):
    """Paths a -> b -> c by their middle's id modulo 3; ``through`` counts each at its smallest changed edge."""

    name = "wedges"

    def _paths(self, edges):
        return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")

    def total(self, graph):
        return self._paths(graph.edges).groupBy((F.col("b") % 3).alias("bin")).agg(F.count(F.lit(1)).alias("value"))

    def through(self, graph, changed):
        mark = changed.select("src", "dst").withColumn("hit", F.lit(True))
        paths = self._paths(graph.edges)
        for u, v in ("ab", "bc"):
            paths = paths.join(mark.select(F.col("src").alias(u), F.col("dst").alias(v), F.col("hit").alias(u + v)), [u, v], "left")
        return paths.where("ab OR bc").groupBy((F.col("b") % 3).alias("bin")).agg(F.count(F.lit(1)).alias("value"))


def test_a_new_delta_problem(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)], "src long, dst long"), 6, Properties(semantics=Semantics.sets()))
    problem = Wedges()
    result = problem.compute(g)
    for ins, dels in (([(3, 4), (4, 1)], [(1, 2)]), ([(1, 2), (5, 5)], [(0, 1), (3, 4), (9, 9)])):
        problem.update(g, EdgeBatch.of(spark, ins, dels), result)
        assert result.by_bin == problem.compute(g).by_bin and result.graph_version == g.version
