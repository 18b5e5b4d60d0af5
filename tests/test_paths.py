"""Shortest paths on one and several objectives and breadth-first levels: worked examples, chains of batches against plain models."""

import random

import pytest

from tidegraph import fixpoint, store
from tidegraph.errors import InvalidArgument, OutOfRange, StaleResult
from tidegraph.fixpoint import INFINITE
from tidegraph.graph import EdgeBatch, Graph, Properties, Semantics
from tidegraph.operators import bfs, mosp, sssp
from tidegraph.operators.problems import FixedPointProblem
from tidegraph.testing.oracles import combined_paths, dijkstra, upsert
from tidegraph.update import update


def graph_of(spark, rows, n, properties=Properties(), k=1):
    cols = "src long, dst long" + "".join(f", w{i} int" for i in range(k)) + ", at long"
    return Graph.from_edges(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], cols), n, properties, order="at")


def tree(result):
    rows = sorted(result.tree().collect())
    return [r[1] for r in rows], [r[2] for r in rows]


def test_one_objective_example(spark):
    g = graph_of(spark, [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 1)], 4)
    r = sssp.compute(g, 0)
    assert tree(r) == ([0, 3, 1, 4], [-1, 2, 0, 1])
    stats = sssp.update(g, EdgeBatch.of(spark, [(2, 3, 1)], [(2, 1)]), r)
    assert tree(r) == ([0, 4, 1, 2], [-1, 0, 0, 2])
    assert stats.invalidated == 2 and g.version == 1


def test_two_objectives_example(spark):
    g = graph_of(spark, [(0, 1, 4, 1), (0, 2, 1, 5), (2, 1, 2, 1), (1, 3, 1, 1), (1, 2, 3, 3)], 4, k=2)
    a, b = sssp.compute(g, 0, objective=0), sssp.compute(g, 0, objective=1)
    sa, sb = update(g, EdgeBatch.of(spark, [(2, 3, 1, 9)], [(2, 1)]), a, b)
    assert tree(a) == ([0, 4, 1, 2], [-1, 0, 0, 2]) and sa.invalidated == 2
    assert tree(b) == ([0, 1, 4, 2], [-1, 0, 1, 1]) and sb.invalidated == 0


def random_batch(rng, rows, n, k, size):
    deletes = [r[:2] for r in rng.sample(rows, min(len(rows), size))] + [(rng.randrange(n), rng.randrange(n))]
    inserts = [(rng.randrange(n), rng.randrange(n), *[rng.randint(1, 9) for _ in range(k)]) for _ in range(size)]
    inserts += [(*r[:2], *[max(1, w + rng.choice((-2, 3))) for w in r[2:]]) for r in rng.sample(rows, min(len(rows), size))]
    return inserts, deletes


def cheapest(rows, k=0):
    out = {}
    for r in rows:
        out[r[:2]] = min(out.get(r[:2], 10**9), r[2 + k])
    return out


@pytest.mark.parametrize("parallel", [False, True])
def test_chains_of_batches(spark, parallel):
    rng = random.Random(5 + parallel)
    n, k = 24, 2
    rows = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(60)]
    if not parallel:
        rows = list({r[:2]: r for r in rows}.values())
    g = graph_of(spark, rows, n, Properties(parallel=parallel), k)
    r, levels, paths = sssp.compute(g, 0), bfs.compute(g, 0), mosp.compute(g, 0, preferences=[2, 1])
    for _ in range(2):
        inserts, deletes = random_batch(rng, rows, n, k, 4)
        update(g, EdgeBatch.of(spark, inserts, deletes), r, levels, paths)
        rows = upsert(rows, deletes, inserts)
        assert sorted(tuple(x) for x in g.edges.select("src", "dst", "w0", "w1").collect()) == sorted(rows)
        assert tree(r) == dijkstra(n, cheapest(rows), 0)
        dist, parent = dijkstra(n, {p: 1 for p in cheapest(rows)}, 0)
        assert tree(levels) == ([-1 if d == INFINITE else d for d in dist], parent)
        again = mosp.compute(g, 0, preferences=[2, 1])
        assert sorted(paths.combined().collect()) == sorted(again.combined().collect())
        assert sorted(map(str, paths.path_costs().collect())) == sorted(map(str, again.path_costs().collect()))


def test_empty_batch_changes_no_value(spark):
    g = graph_of(spark, [(0, 1, 2), (1, 2, 2)], 4)
    r = sssp.compute(g, 0)
    before = tree(r)
    stats = sssp.update(g, EdgeBatch.of(spark), r)
    assert tree(r) == before and stats.affected == 0 and g.version == 1


def test_an_inverse_batch_restores(spark):
    g = graph_of(spark, [(0, 1, 2), (1, 2, 2), (0, 2, 9)], 3)
    r = sssp.compute(g, 0)
    before = tree(r)
    sssp.update(g, EdgeBatch.of(spark, [], [(1, 2)]), r)
    assert tree(r)[0] == [0, 2, 9]
    sssp.update(g, EdgeBatch.of(spark, [(1, 2, 2)]), r)
    assert tree(r) == before


def test_no_counting_to_infinity(spark):
    g = graph_of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 1, 1)], 4)
    r = sssp.compute(g, 0)
    sssp.update(g, EdgeBatch.of(spark, [], [(0, 1)]), r)
    assert tree(r) == ([0, INFINITE, INFINITE, INFINITE], [-1] * 4)


def test_vertices_grow_and_refused_batches_change_nothing(spark):
    g = graph_of(spark, [(0, 1, 2)], 2)
    r = sssp.compute(g, 0)
    sssp.update(g, EdgeBatch.of(spark, [(1, 4, 1)]), r)
    assert g.num_vertices == 5 and tree(r)[0] == [0, 2, INFINITE, INFINITE, 3]
    for bad, error in (([(0, 1, 0)], OutOfRange), ([(-1, 1, 1)], OutOfRange)):
        with pytest.raises(error):
            sssp.update(g, EdgeBatch.of(spark, bad), r)
    fixed = graph_of(spark, [(0, 1, 2)], 2, Properties(semantics=Semantics(growth=False)))
    with pytest.raises(OutOfRange):
        fixed.apply(EdgeBatch.of(spark, [(1, 4, 1)]))
    assert g.version == 1 and fixed.version == 0


def test_stale_results_are_refused(spark):
    g = graph_of(spark, [(0, 1, 2)], 2)
    r = sssp.compute(g, 0)
    g.apply(EdgeBatch.of(spark, [(1, 0, 1)]))
    with pytest.raises(StaleResult):
        sssp.update(g, EdgeBatch.of(spark), r)
    with pytest.raises(InvalidArgument):
        update(g, EdgeBatch.of(spark))


def test_adopted_trees(spark):
    g = graph_of(spark, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)], 4)
    given = spark.createDataFrame([(0, 0, -1), (1, 1, 0), (2, 1, 0), (3, 2, 2)], "v long, distance long, parent long")
    assert tree(sssp.ShortestPaths.from_tree(g, 0, given, canonicalize=False))[1][3] == 2
    assert tree(sssp.ShortestPaths.from_tree(g, 0, given))[1][3] == 1
    kept = sssp.ShortestPaths.from_tree(g, 0, given, canonicalize=False)
    sssp.update(g, EdgeBatch.of(spark, [(3, 1, 5)]), kept)
    assert tree(kept)[1][3] == 2  # the batch doesn't reach it
    wrong = spark.createDataFrame([(0, 0, -1), (1, 1, 0), (2, 1, 0), (3, 1, 2)], "v long, distance long, parent long")
    with pytest.raises(InvalidArgument):
        sssp.ShortestPaths.from_tree(g, 0, wrong)


def test_the_thesis_graph(spark):
    """Preferences decide which of two paths the combination takes."""
    rows = [(0, 1, 1, 9), (1, 2, 1, 9), (0, 3, 5, 1), (3, 2, 5, 1)]
    g = graph_of(spark, rows, 4, Properties.multi_objective(), 2)
    fast = {r.v: (r.c0, r.c1) for r in mosp.compute(g, 0, preferences=[1, 4]).path_costs().collect()}
    short = {r.v: (r.c0, r.c1) for r in mosp.compute(g, 0, preferences=[4, 1]).path_costs().collect()}
    assert fast[2] == (2, 18) and short[2] == (10, 2)
    with pytest.raises(InvalidArgument):
        mosp.compute(g, 0, preferences=[0, 1])
    with pytest.raises(InvalidArgument):
        mosp.compute(g, 0, preferences=[2**19, 3])


def test_levels_example(spark):
    g = graph_of(spark, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1)], 5)
    r = bfs.compute(g, 0)
    stats = bfs.update(g, EdgeBatch.of(spark, [], [(1, 3)]), r)
    assert tree(r)[0] == [0, 1, 1, 2, 3] and stats.invalidated == 2


def test_a_parallel_edge_that_stays_keeps_the_level(spark):
    g = graph_of(spark, [(0, 1, 1), (0, 1, 1), (1, 2, 1)], 3, Properties(parallel=True))
    r = bfs.compute(g, 0)
    assert bfs.update(g, EdgeBatch.of(spark, [], [(0, 1)]), r).invalidated == 0
    assert tree(r)[0] == [0, 1, 2]


@pytest.mark.parametrize("name", ["components", "sssp_compute", "mosp_compute", "dynamic_bfs_compute"])
def test_queries_of_the_whole_part_graph_match_their_sql(spark, sf, name):
    import duckdb

    from tidegraph.plans import registry

    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    rows = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))


class NearestDepot(FixedPointProblem):
    """Cheapest way from any of several depots, each with a charge of its own."""

    name = "nearest_depot"

    def __init__(self, depots):
        self.depots = depots

    def arcs(self, graph):
        return graph.arcs(0)

    def base(self, graph):
        return graph.spark.createDataFrame(list(self.depots.items()), "id long, distance long")


def test_a_new_fixed_point_problem(spark):
    rng = random.Random(3)
    rows = list({(rng.randrange(20), rng.randrange(20)): rng.randint(1, 9) for _ in range(50)}.items())
    g = graph_of(spark, [(u, v, w) for (u, v), w in rows], 20)
    problem = NearestDepot({0: 3, 7: 0, 19: 12})
    result = problem.compute(g)
    for _ in range(2):
        left = [tuple(r) for r in g.edges.select("src", "dst", "w0").collect()]
        ins, dels = random_batch(rng, left, 20, 1, 5)
        problem.update(g, EdgeBatch.of(spark, ins, dels), result)
        arcs = cheapest([tuple(r) for r in g.edges.select("src", "dst", "w0").collect()])
        want, _ = dijkstra(21, arcs | {(20, d): max(c, 0) for d, c in problem.depots.items()}, 20)
        assert {r.id: r.distance for r in result.state.collect()} == {v: d for v, d in enumerate(want[:20]) if d < INFINITE}


def test_the_combination_of_trees_follows_the_plain_model(spark):
    rng = random.Random(8)
    rows = list({(rng.randrange(15), rng.randrange(15)): (rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9)) for _ in range(45)}.items())
    g = graph_of(spark, [(u, v, *w) for (u, v), w in rows], 15, k=3)
    result = mosp.compute(g, 0, preferences=[4, 1, 2])
    trees = [[r.parent for r in sorted(result.tree(k).collect())] for k in range(3)]
    dist, parent = combined_paths(15, trees, [4, 1, 2], 0)
    assert [(r.distance, r.parent) for r in sorted(result.combined().collect())] == list(zip(dist, parent))


def test_a_narrow_front_moves_no_arcs(spark, monkeypatch):
    """However large the file of changes is that the front comes from."""
    plans = []
    monkeypatch.setattr(fixpoint, "measured", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store.measured(df, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arcs = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (0, 2, 5)], "src long, dst long, w long")
        out = fixpoint.solve(arcs, spark.createDataFrame([(0, 0)], "id long, distance long"))
        assert {tuple(r) for r in out.state.collect()} == {(0, 0, -1), (1, 2, 0), (2, 4, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 2 and all("BroadcastHashJoin [src" in p for p in plans[1:])
