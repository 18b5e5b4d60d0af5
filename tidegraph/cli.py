"""Command line: the operators on files.

    python -m tidegraph sssp compute --graph PATH [--format csr|mtx|edges] --source S --out DIR
    python -m tidegraph cycle_count update --graph PATH --batch FILE.dgt --max-length K

Options of an operator are flags of the same names, with dashes.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import EngineError, InvalidArgument
from tidegraph.graph import EdgeBatch, Graph, Properties
from tidegraph.operators import bfs, cycles, hyper_sssp, labels, mosp, sssp, triads, triangles
from tidegraph.plans import registry
from tidegraph.sources import batches as B
from tidegraph.sources import binary, generators, graphs, hypergraphs, results
from tidegraph.update import toward, update

PRESETS = {"multi_objective": Properties.multi_objective, "structural": Properties.structural, "default": Properties}


def algorithms() -> dict[str, str]:
    """The operators by name, with a line on each."""
    found = {"sssp": sssp, "mosp": mosp, "dynamic_bfs": bfs, "cycle_count": cycles, "triangle_delta": triangles, "triad_count": triads, "hyper_sssp": hyper_sssp, "label_propagation": labels}
    return {name: (module.__doc__ or "").strip().splitlines()[0] for name, module in found.items()}


def session(app: str = "tidegraph") -> SparkSession:
    return SparkSession.builder.appName(app).getOrCreate()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_graph(spark: SparkSession, a: argparse.Namespace, preset: str) -> Graph:
    props = PRESETS[a.properties or preset]()
    kind = a.format
    if kind == "auto":
        kind = "csr" if _exists(spark, f"{a.graph}RowPtr.txt") else "mtx" if a.graph.endswith(".mtx") else "edges"
    if kind == "csr":
        return graphs.read_csr_triplet(spark, a.graph, a.num_weights, props)
    if kind == "mtx":
        random = tuple(map(int, a.random_weights.split(","))) if a.random_weights else None
        g = graphs.read_matrix_market(spark, a.graph, "random" if random else "values" if preset == "multi_objective" else "none", (a.num_weights or 1, *random) if random else (1, 1, 100, 12345))
        return Graph.from_edges(g.edges, g.num_vertices, props, g.weights, order="pos")
    return graphs.read_edge_list(spark, a.graph, a.num_weights or 0, a.ids, a.index_base, a.symmetrize, not a.keep_self_loops, a.duplicates, properties=props)[0]


def load_batches(spark: SparkSession, a: argparse.Namespace) -> Iterator[EdgeBatch]:
    """The batches that the arguments name, each made when it is asked for."""
    if a.changes:
        yield B.read_pair_files(spark, f"{a.changes}/insert.txt", f"{a.changes}/delete.txt")
        return
    if a.insert or a.delete:
        if not (a.insert and a.delete):
            raise InvalidArgument("--insert and --delete go together")
        yield B.read_pair_files(spark, a.insert, a.delete)
        return
    for path in a.batch or []:
        if path.endswith(".dgb"):
            yield from (r.batch(spark) for r in binary.records(spark, path))
        elif path.endswith(".dgt"):
            yield from (b for _, b in B.read_batches(spark, path))
        else:
            yield B.read_signed_lines(spark, path)


def _graph_command(spark: SparkSession, a: argparse.Namespace) -> int:
    name = a.command
    g = load_graph(spark, a, "structural" if name == "cycle_count" else "multi_objective")
    if name == "sssp":
        result = sssp.compute(g, a.source, objective=a.objective)
    elif name == "mosp":
        result = mosp.compute(g, a.source, preferences=[int(x) for x in a.preferences.split(",")] if a.preferences else None, num_objectives=a.num_objectives)
    elif name == "dynamic_bfs":
        result = bfs.compute(g, a.source)
    else:
        if a.task == "update" and a.max_length is None:
            raise SystemExit(2)
        result = cycles.compute(g, a.max_length or max(2, g.num_vertices))
    if a.task == "update":
        todo = load_batches(spark, a)
        first = next(todo, None)
        todo = chain([first], todo) if first is not None else []
        if name == "cycle_count" and first is None:
            todo = [generators.cycle_changes(g, a.num_deletions, a.num_insertions, a.seed, a.locality_window)]
        began = time.perf_counter()
        toward(todo, g, result)
        print(f"update_seconds={time.perf_counter() - began:.6f}", file=sys.stderr)
    if name == "cycle_count":
        text = results.histogram_csv(result.to_dict())
        if a.output:
            _put(spark, a.output, text)
        else:
            print(text, end="")
        if a.task == "update" and a.compare_recompute:
            same = cycles.compute(g, a.max_length).to_dict() == result.to_dict()
            print(f"match={'yes' if same else 'no'}", file=sys.stderr)
            return int(not same)
        return 0
    if name == "sssp":
        results.write_distances(result.tree(), f"{a.out}/distances.txt")
        results.write_parents(result.tree(), f"{a.out}/parents.txt")
    elif name == "mosp":
        results.write_distances(result.combined(), f"{a.out}/combined_distances.txt")
        results.write_parents(result.combined(), f"{a.out}/combined_parents.txt")
        results.write_path_costs(result.path_costs(), f"{a.out}/path_costs.txt")
    else:
        results.write_distances(result.tree().select("v", F.col("level").alias("distance"), "parent"), f"{a.out}/levels.txt")
    return 0


def _put(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _hyper_command(spark: SparkSession, a: argparse.Namespace) -> int:
    weighted = a.command == "hyper_sssp"
    preset = dict(hypergraphs.PRESETS[a.read_options])
    f = hypergraphs.read_hypergraph(spark, a.input, weighted and "random_weights" not in preset, a.index_base, dedupe_hyperedges=a.dedupe_hyperedges, num_vertices=a.num_vertices, **preset)
    h = f.hypergraph
    result = hyper_sssp.compute(h, a.source) if weighted else triads.compute(h, a.kind)
    deltas = []
    if a.task == "update":
        for path in a.batches or []:
            todo = (r.batch(spark) for r in binary.records(spark, path)) if path.endswith(".dgb") else [b for _, b in B.read_hyperedge_batches(spark, path, weighted)]
            for b in todo:
                update(h, b, result)
                if not weighted:
                    deltas.append(result.delta())
    if weighted:
        own = result.hyperedges().withColumnRenamed("h", "v")
        results.write_distances(own, f"{a.out}/hyperedge_distances.txt")
        results.write_parents(own, f"{a.out}/hyperedge_parents.txt")
        results.write_distances(result.vertex_distances().withColumn("parent", F.lit(-1)), f"{a.out}/vertex_distances.txt")
        return 0
    text = results.bins_json(result.counts, a.kind, result.graph_version, deltas)
    if a.output:
        _put(spark, a.output, text)
    else:
        print(text, end="")
    if a.task == "update" and a.compare_recompute:
        return int(triads.compute(h, a.kind).counts != result.counts)
    return 0


def _label_command(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.task == "compute":
        g, _ = graphs.read_edge_list(spark, a.graph, 1, "as_is", 0, float_weights=True, properties=registry.SIMILAR)
        seeds = results.read_classes(spark, a.seeds).select(F.col("v").alias("id"), F.col("class").alias("label"))
        result = labels.compute(g, seeds, tolerance=a.tolerance, max_iterations=a.max_iterations)
    else:
        stream = generators.vertex_arrivals(spark, a.total_vertices, a.average_degree, a.num_batches, a.seed)
        g = stream.graph()
        threshold = stream.similarity_threshold if a.similarity_threshold == "published" else None if a.similarity_threshold == "current" else float(a.similarity_threshold)
        result = labels.compute(g, similarity_threshold=threshold, tolerance=a.tolerance, max_iterations=a.max_iterations, update_schedule=a.update_schedule)
        rows = ["batch,time_ms,iterations,frontier_visits,components,accuracy,affected,initial_frontier,sparsified_edges,converged,fallback_used,inserted_vertices,deleted_vertices,inserted_edges,dropped_insertions"]
        for i, b in enumerate(stream.batches()):
            began = time.perf_counter()
            s = labels.update(g, b, result)
            ms, exact = (time.perf_counter() - began) * 1000, result.accuracy(stream.true_labels())
            c = s.batch
            rows.append(f"{i},{ms:.3f},{s.iterations},{s.frontier_visits},{s.more['components']},{exact if exact is not None else ''},{s.affected},{s.more['initial_frontier']},{s.more['sparsified_edges']},{int(s.converged)},{int(s.fallback_used)},{c.inserted_vertices},{c.deleted_vertices},{c.inserted_edges},{c.dropped_insertions}")
        _put(spark, f"{a.out}/stats.csv", "\n".join(rows) + "\n")
    results.write_labels(result.labels(), f"{a.out}/labels.txt")
    return 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    g = load_graph(spark, a, "default")
    kind = a.to or ("mtx" if a.output.endswith(".mtx") else "edges")
    if kind == "csr":
        graphs.write_csr_triplet(g, a.output)
    elif kind == "mtx":
        graphs.write_matrix_market(g, a.output, 0 if g.num_weights else None)
    else:
        graphs.write_edge_list(g, a.output)
    return 0


def _prep(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.what == "mtx2csr":
        g = graphs.read_matrix_market(spark, a.graph, "random", (a.num_weights or 1, a.low, a.high, a.seed))
        graphs.write_csr_triplet(g, a.output)
    elif a.what == "widen":
        graphs.write_csr_triplet(graphs.widen(graphs.read_csr_triplet(spark, a.graph), a.num_weights, a.low, a.high, a.seed), a.output)
    else:  # a tree for each objective, before or after a batch
        g = graphs.read_csr_triplet(spark, a.graph, a.num_weights)
        if a.what == "expected":
            for b in load_batches(spark, a):
                g.apply(b)
        for k in range(g.num_weights):
            t = sssp.compute(g, a.source, objective=k).tree()
            results.write_distances(t, f"{a.output}/obj{k}/distances.txt")
            results.write_parents(t, f"{a.output}/obj{k}/parents.txt")
    return 0


def _generate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.generator == "vertex_arrivals":
        s = generators.vertex_arrivals(spark, a.total_vertices, a.average_degree, a.num_batches, a.seed)
        B.write_batches(spark, f"{a.output}/batches.dgt", s.batches())
        s.operations().write.mode("overwrite").partitionBy("batch").parquet(f"{a.output}/operations")
        results.write_classes(s.true_labels(), f"{a.output}/true_labels.txt")
        results.write_capacities(s.row_capacity(), f"{a.output}/row_capacity.txt")
        options = {k: getattr(a, k) for k in ("total_vertices", "average_degree", "num_batches", "seed")}
        _put(spark, f"{a.output}/stream.json", results.stream_json(s, options))
        return 0
    if a.generator == "hyperedge_batch":
        h = hypergraphs.read_hypergraph(spark, a.hypergraph, index_base=a.index_base).hypergraph
        if a.deletions or a.insertions:
            batch = generators.closed_batch(h, a.deletions, a.insertions, a.least, a.most, a.sample, a.seed)
        else:
            batch = generators.hyperedge_batch(h, a.mix, a.size, a.least, a.most, a.seed)
        B.write_hyperedge_batches(spark, a.output, [batch])
        return 0
    if a.generator == "uniform_hypergraph":
        inc = generators.uniform_hypergraph(spark, a.num_vertices, a.num_hyperedges, a.least, a.most, a.seed)
        from tidegraph.hypergraph import Hypergraph

        hypergraphs.write_hypergraph(Hypergraph.from_incidence(inc, None, a.num_vertices), a.output)
        return 0
    g = load_graph(spark, a, "multi_objective" if a.generator == "path_changes" else "structural")
    if a.generator == "path_changes":
        c = generators.path_changes(g, a.num_changes, a.insertion_percentage, a.mode, a.low, a.high, a.seed, a.local_hops, a.safe_deletions, a.source)
        B.write_pair_files(c.batch, f"{a.output}/insert.txt", f"{a.output}/delete.txt")
    else:
        B.write_batches(spark, a.output, [generators.cycle_changes(g, a.num_deletions, a.num_insertions, a.seed, a.locality_window)])
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def graph_flags(q, with_batch=True):
        q.add_argument("--graph", "--input", dest="graph", required=True)
        q.add_argument("--format", default="auto", choices=["auto", "csr", "mtx", "edges"])
        q.add_argument("--properties", choices=sorted(PRESETS))
        q.add_argument("--num-weights", type=int)
        q.add_argument("--random-weights")
        q.add_argument("--ids", default="compact", choices=["compact", "as_is"])
        q.add_argument("--index-base", type=int, default=0)
        q.add_argument("--symmetrize", action="store_true")
        q.add_argument("--keep-self-loops", action="store_true")
        q.add_argument("--duplicates", default="merge", choices=["merge", "keep"])
        if with_batch:
            q.add_argument("--batch", nargs="*")
            for f in ("--changes", "--insert", "--delete"):
                q.add_argument(f)

    def draw_flags(q):
        q.add_argument("--num-deletions", type=int, default=0)
        q.add_argument("--num-insertions", type=int, default=0)
        q.add_argument("--locality-window", type=int, default=-1)

    for name in ("sssp", "mosp", "dynamic_bfs", "cycle_count"):
        q = sub.add_parser(name, help=algorithms()[name])
        q.add_argument("task", choices=["compute", "update"])
        graph_flags(q)
        if name == "cycle_count":
            q.add_argument("--max-length", type=int)
            q.add_argument("--output")
            q.add_argument("--seed", type=int, default=0)
            q.add_argument("--compare-recompute", action="store_true")
            draw_flags(q)
        else:
            q.add_argument("--source", type=int, default=0)
            q.add_argument("--out", default=".")
        if name == "sssp":
            q.add_argument("--objective", type=int, default=0)
        if name == "mosp":
            q.add_argument("--preferences")
            q.add_argument("--num-objectives", type=int, default=0)
    for name in ("triad_count", "hyper_sssp"):
        q = sub.add_parser(name, help=algorithms()[name])
        q.add_argument("task", choices=["compute", "update"])
        q.add_argument("--input", "--hypergraph", dest="input", required=True)
        q.add_argument("--read-options", default="plain", choices=sorted(hypergraphs.PRESETS))
        q.add_argument("--index-base", type=int, default=1)
        q.add_argument("--dedupe-hyperedges", action="store_true")
        q.add_argument("--num-vertices", type=int)
        q.add_argument("--batches", nargs="*")
        if name == "triad_count":
            q.add_argument("--kind", default="h_motif", choices=sorted(triads.PATTERNS))
            q.add_argument("--output")
            q.add_argument("--compare-recompute", action="store_true")
        else:
            q.add_argument("--source", type=int, default=0)
            q.add_argument("--out", default=".")
    q = sub.add_parser("label_propagation", help=algorithms()["label_propagation"])
    q.add_argument("task", choices=["compute", "update"])
    q.add_argument("--graph")
    q.add_argument("--seeds")
    q.add_argument("--out", default=".")
    q.add_argument("--tolerance", type=float, default=1e-4)
    q.add_argument("--max-iterations", type=int, default=100_000)
    q.add_argument("--update-schedule", default="in_place", choices=["in_place", "damped"])
    q.add_argument("--similarity-threshold", default="published")

    def stream_flags(q):
        q.add_argument("--total-vertices", type=int, default=50_000)
        q.add_argument("--average-degree", type=int, default=5)
        q.add_argument("--num-batches", type=int, default=10)
        q.add_argument("--seed", type=int, default=42)

    stream_flags(q)
    q = sub.add_parser("convert", help="A graph from one format to another")
    graph_flags(q, False)
    q.add_argument("--output", required=True)
    q.add_argument("--to", choices=["csr", "mtx", "edges"])
    q = sub.add_parser("prep", help="Weighted inputs and expected trees")
    q.add_argument("what", choices=["mtx2csr", "widen", "init", "expected"])
    graph_flags(q)
    q.add_argument("--output", required=True)
    for flag, value in (("--low", 1), ("--high", 100), ("--seed", 12345), ("--source", 0)):
        q.add_argument(flag, type=int, default=value)
    q = sub.add_parser("generate", help="Seeded graphs, hypergraphs and batches")
    gen = q.add_subparsers(dest="generator", required=True)
    g = gen.add_parser("vertex_arrivals")
    stream_flags(g)
    g.add_argument("--output", required=True)
    g = gen.add_parser("uniform_hypergraph")
    for flag, value in (("--num-vertices", 100), ("--num-hyperedges", 100), ("--least", 1), ("--most", 4), ("--seed", 1)):
        g.add_argument(flag, type=int, default=value)
    g.add_argument("--output", required=True)
    g = gen.add_parser("hyperedge_batch")
    g.add_argument("--hypergraph", required=True)
    g.add_argument("--mix", default="mixed")
    for flag, value in (("--index-base", 1), ("--size", 4), ("--deletions", 0), ("--insertions", 0), ("--least", 1), ("--most", 4), ("--seed", 1)):
        g.add_argument(flag, type=int, default=value)
    g.add_argument("--sample", action="store_true")
    g.add_argument("--output", required=True)
    g = gen.add_parser("path_changes")
    graph_flags(g, False)
    for flag, value in (("--num-changes", 0), ("--low", 1), ("--high", 100), ("--seed", 1), ("--local-hops", 0), ("--source", 0)):
        g.add_argument(flag, type=int, default=value)
    g.add_argument("--insertion-percentage", type=float, default=50.0)
    g.add_argument("--mode", default="uniform", choices=["uniform", "targeted", "reweight", "increase"])
    g.add_argument("--safe-deletions", action="store_true")
    g.add_argument("--output", required=True)
    g = gen.add_parser("cycle_changes")
    graph_flags(g, False)
    draw_flags(g)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--output", required=True)
    sub.add_parser("config", help="The session and its settings")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or session()
    run = {"convert": _convert, "prep": _prep, "generate": _generate, "label_propagation": _label_command, "triad_count": _hyper_command, "hyper_sssp": _hyper_command}.get(a.command, _graph_command)
    try:
        if a.command == "config":
            print(f"spark {spark.version}, {spark.sparkContext.master}")
            for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.checkpoint.dir"):
                print(f"{k} {spark.conf.get(k, None)}")
            return 0
        return run(spark, a)
    except EngineError as e:
        print(f"tidegraph: error: {e}", file=sys.stderr)
        return 1
