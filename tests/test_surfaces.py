"""Streams, snapshots, generators, the command line and the entry points."""

import json

import pytest
from pyspark.sql import functions as F

from tidegraph import cli
from tidegraph.errors import FileFormat, InvalidArgument
from tidegraph.graph import EdgeBatch, Graph, Properties
from tidegraph.hypergraph import HyperProperties, Hypergraph
from tidegraph.operators import cycles, sssp
from tidegraph.profiler import profile
from tidegraph.sources import generators, results
from tidegraph.streaming import runner, snapshots
from tidegraph.update import stats_frame


def ring(spark, n=6, properties=Properties(), weights=("w0",)):
    return Graph.from_edges(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(2).alias("w0")), n, properties, weights)


def test_a_stream_of_operations(spark, tmp_path):
    log = str(tmp_path / "log")
    for i, rows in enumerate([[(0, "+e", 0, 3, [1.0], None)], [(0, "-e", 0, 1, None, None), (1, "+e", 3, 1, [4.0], None)]]):
        spark.createDataFrame(rows, runner.GRAPH_OPERATIONS).coalesce(1).write.mode("append").parquet(log)
    g = ring(spark)
    r = sssp.compute(g, 0)
    seen = []
    run = runner.Runner(g, r, sink=lambda i, results, stats: seen.append((i, stats[0].batch.inserted_edges)))
    run.start(runner.operation_log(spark, log), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert [i for i, _ in seen] == [0, 1] and g.version == 2
    assert sorted(r.tree().collect()) == sorted(sssp.compute(g, 0).tree().collect())
    run.apply(spark.createDataFrame([], runner.GRAPH_OPERATIONS), 1)  # delivered again
    assert g.version == 2
    with pytest.raises(Exception):
        run.apply(spark.createDataFrame([], runner.GRAPH_OPERATIONS), 7)
    at = snapshots.save(g, str(tmp_path / "state"), {"tree": r.tree()})
    back, frames = snapshots.load(spark, str(tmp_path / "state"))
    assert at.endswith("v=2") and back.version == 2 and back.properties == g.properties
    assert sorted(back.edges.collect()) == sorted(g.edges.collect()) and frames["tree"].count() == 6
    with pytest.raises(FileFormat):
        snapshots.load(spark, str(tmp_path / "state"), 1)


def test_generators_repeat_themselves(spark):
    a, b = (sorted(map(tuple, generators.uniform_hypergraph(spark, 20, 30, 2, 5, seed=4).collect())) for _ in range(2))
    assert a == b
    sizes = {}
    for h, v in a:
        assert 0 <= v < 20
        sizes[h] = sizes.get(h, 0) + 1
    assert len(sizes) == 30 and set(sizes.values()) <= {2, 3, 4, 5}
    g = ring(spark, 30, Properties.structural())
    c = generators.cycle_changes(g, 4, 6, seed=3, locality_window=15)
    assert c.deletes.count() == 4 and c.inserts.count() == 6
    ends = {x for r in [*c.deletes.collect(), *c.inserts.collect()] for x in (r.src, r.dst)}
    assert max(ends) - min(ends) < 15
    assert c.inserts.join(g.edges, ["src", "dst"], "left_semi").count() == 0
    with pytest.raises(InvalidArgument):
        generators.cycle_changes(g, 0, 10**6)


@pytest.mark.parametrize("mode", ["uniform", "targeted", "reweight", "increase"])
def test_path_changes(spark, mode):
    g = ring(spark, 12)
    c = generators.path_changes(g, 6, 50, mode, seed=2, safe_deletions=mode == "targeted", local_hops=4 if mode == "uniform" else 0)
    rows = c.batch.inserts.collect()
    assert len(rows) == (6 if mode in ("reweight", "increase") else 3) and all(r.w0 >= 1 for r in rows)
    if mode == "targeted":
        after = g.commit(c.batch).after
        assert sssp.compute(after, 0).state.count() == 12
    if mode == "increase":
        assert all(r.w0 > 2 for r in rows)


def test_every_kind_of_batch(spark):
    h = Hypergraph.from_lists(spark, [[0, 1], [1, 2, 3], [4], [2, 5]], num_vertices=6, properties=HyperProperties())
    with pytest.raises(InvalidArgument):
        generators.hyperedge_batch(h, "other")
    for mix in ("duplicates", "limits", "empty", "incidence_emptying", "incidence_out_of_range"):
        done = h.commit(generators.hyperedge_batch(h, mix, 2))
        done.after.check()
    s = generators.closed_batch(h, 2, 2, sample=True)
    assert s.deletes.count() == 2 and s.inserts.count() == 2


def test_profiles(spark):
    with profile() as p:
        g = ring(spark)
        r = cycles.compute(ring(spark, 4, Properties.structural(), ()), 4)
        stats = cycles.update(r.container, EdgeBatch.of(spark, [(1, 0)]), r)
        assert r.to_dict() == {2: 1, 4: 1} and g.num_active() == 6
    assert {"graph.commit", "cycle_count.update"} <= set(p.totals()) and json.loads(p.to_json())["stages"]
    assert p.to_csv().startswith("stage,seconds,depth\n") and stats_frame(spark, [stats]).count() == 1


def test_insertions_carry_the_graph_s_weights(spark):
    weighted = ring(spark, 4, Properties.structural())
    with pytest.raises(InvalidArgument):
        weighted.apply(EdgeBatch.of(spark, [(1, 0)]))
    assert weighted.apply(EdgeBatch.of(spark, [(1, 0, 3)], [(0, 1)])).inserted_edges == 1
    assert {(r.src, r.dst): r.w0 for r in weighted.edges.collect()} == {(1, 0): 3, (1, 2): 2, (2, 3): 2, (3, 0): 2}


def test_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("0 1 4\n0 2 1\n2 1 2\n1 3 1\n3 0 1\n")
    (tmp_path / "b.dgt").write_text("%dgt 1\n-e 2 1\n+e 2 3 1\n")
    (tmp_path / "c.dgt").write_text("%dgt 1\n-e 2 1\n+e 2 3\n")
    g = str(tmp_path / "g.txt")
    assert cli.main(["sssp", "update", "--graph", g, "--num-weights", "1", "--batch", str(tmp_path / "b.dgt"), "--out", str(tmp_path)], spark) == 0
    assert (tmp_path / "distances.txt").read_text() == "0 0\n1 4\n2 1\n3 2\n" and (tmp_path / "parents.txt").read_text() == "0 -1\n1 0\n2 0\n3 2\n"
    assert cli.main(["cycle_count", "update", "--graph", g, "--max-length", "4", "--batch", str(tmp_path / "c.dgt"), "--compare-recompute"], spark) == 0
    assert capsys.readouterr().out == "# cycle_size, num_of_cycles\n3, 2\nTotal, 2\n"
    (tmp_path / "h.hg").write_text("1 2 3\n2 3 4\n3 4 5\n1 3 5\n")
    assert cli.main(["triad_count", "compute", "--input", str(tmp_path / "h.hg")], spark) == 0
    assert sum(json.loads(capsys.readouterr().out)["counts"]) == 4
    assert cli.main(["convert", "--graph", g, "--num-weights", "1", "--output", str(tmp_path / "o.mtx")], spark) == 0
    assert (tmp_path / "o.mtx").read_text().splitlines()[1] == "4 4 5"
    assert cli.main(["generate", "hyperedge_batch", "--hypergraph", str(tmp_path / "h.hg"), "--mix", "insert_only", "--output", str(tmp_path / "m.dgt")], spark) == 0
    assert (tmp_path / "m.dgt").read_text().count("+h") == 4
    (tmp_path / "bad.txt").write_text("0 x\n")
    assert cli.main(["dynamic_bfs", "compute", "--graph", str(tmp_path / "bad.txt")], spark) == 1
    assert len(cli.algorithms()) == 8


def test_stream_files(spark, tmp_path):
    out = str(tmp_path / "stream")
    assert cli.main(["generate", "vertex_arrivals", "--total-vertices", "30", "--average-degree", "3", "--num-batches", "2", "--seed", "4", "--output", out], spark) == 0
    stream = generators.vertex_arrivals(spark, 30, 3, 2, 4)
    facts = json.loads((tmp_path / "stream" / "stream.json").read_text())
    assert (facts["num_vertices"], facts["num_batches"], facts["num_edges"]) == (30, 2, stream.edges.count())
    assert sorted(map(tuple, results.read_classes(spark, f"{out}/true_labels.txt").collect())) == sorted(map(tuple, stream.true_labels().collect()))
    assert sorted(map(tuple, results.read_capacities(spark, f"{out}/row_capacity.txt").collect())) == sorted(map(tuple, stream.row_capacity().collect()))


def test_entry_points(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "sssp_compute" in names
    assert e.entry(spark).columns == ["v", "distance", "parent"]
