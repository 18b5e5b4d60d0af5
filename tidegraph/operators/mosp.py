"""Multi-objective shortest paths: a tree for each objective, their combination by preferences, and the costs along it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument
from tidegraph.fixpoint import NONE, Limit, Solved, solve
from tidegraph.functions.trees import path_sums
from tidegraph.graph import Commit, EdgeBatch, Graph
from tidegraph.operators.sssp import ShortestPaths, _solve, dense, repaired_tree
from tidegraph.store import materialize
from tidegraph.update import Result, Stats, update as _update

MAX_SCALE = 2**20


def scale_of(preferences: list[int]) -> int:
    """Least common multiple of the preferences; it keeps combined weights whole."""
    if any(p < 1 for p in preferences):
        raise InvalidArgument("preferences are 1 or more")
    scale = math.lcm(*preferences)
    if scale > MAX_SCALE:
        raise InvalidArgument(f"the least common multiple {scale} of the preferences is beyond {MAX_SCALE}")
    return scale


def combined_arcs(trees: list[DataFrame], preferences: list[int]) -> DataFrame:
    """(src, dst, w): arcs of the trees; w is scale * (K + 1) less scale / preference for each tree that has the arc."""
    scale, k = scale_of(preferences), len(trees)
    terms = None
    for tree, p in zip(trees, preferences):
        own = tree.where(F.col("parent") != NONE).select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit(scale // p).cast("long").alias("term"))
        terms = own if terms is None else terms.unionByName(own)
    return terms.groupBy("src", "dst").agg((F.lit(scale * (k + 1)) - F.sum("term")).cast("long").alias("w"))


class MultiObjectivePaths(Result):
    name = "mosp"

    def __init__(self, graph: Graph, source: int, trees: list[DataFrame], options: dict):
        super().__init__(graph, options)
        self.source, self.trees = source, trees
        for k, v in _combine(graph, source, trees, options).items():
            setattr(self, k, v)

    @property
    def preference_scale(self) -> int:
        return scale_of(self.options["preferences"])

    @classmethod
    def from_trees(cls, graph: Graph, source: int, trees: list[DataFrame], canonicalize: bool = True, **options) -> MultiObjectivePaths:
        """Adopt a tree (v, distance, parent) for each objective."""
        opt = _options(graph, options)
        own = [ShortestPaths.from_tree(graph, source, t, canonicalize, objective=k, validate_inputs=opt["validate_inputs"]).state for k, t in enumerate(trees)]
        return cls(graph, source, own, opt)

    def tree(self, objective: int) -> DataFrame:
        return dense(self.container, self.trees[objective])

    def combined(self) -> DataFrame:
        """(v, distance, parent) on the combined graph; distances in units of 1 / scale."""
        return dense(self.container, self.combined_state)

    def path_costs(self) -> DataFrame:
        """(v, c0, ..): cost of each objective along the combined tree; null for unreached vertices."""
        if self.costs is None:
            raise InvalidArgument("path costs weren't asked for")
        return self.container.vertices().withColumnRenamed("id", "v").join(self.costs, F.col("v") == F.col("id"), "left").drop("id")

    def repaired(self, done: Commit) -> tuple[dict, Stats]:
        limit = Limit(self.options["max_rounds"], "error")
        each = [repaired_tree(t, done, self.source, k, limit) for k, t in enumerate(self.trees)]
        trees = [e.solved.state for e in each]
        values = _combine(done.after, self.source, trees, self.options) | {"trees": trees}
        was, now = self.combined_state, values["combined_state"].select(F.col("id").alias("i"), F.col("distance").alias("d"), F.col("parent").alias("p"))
        affected = was.join(now, F.col("id") == F.col("i"), "full_outer").where(~(F.col("distance").eqNullSafe(F.col("d")) & F.col("parent").eqNullSafe(F.col("p")))).count()
        more = {"combined_edges": values["combined_edges"], "preference_scale": self.preference_scale, "invalidated": [e.invalidated for e in each], "objective_affected": [e.affected for e in each]}
        return values, Stats(affected, sum(e.solved.rounds for e in each), sum(e.solved.visits for e in each), invalidated=sum(e.invalidated for e in each), batch=done.summary, more=more)


def _combine(graph: Graph, source: int, trees: list[DataFrame], opt: dict) -> dict:
    arcs = materialize(combined_arcs(trees, opt["preferences"]), "combined")
    out: Solved = solve(arcs, graph.spark.createDataFrame([(source, 0)], "id long, distance long"), Limit(opt["max_rounds"], "error"))
    costs = None
    if opt["compute_path_costs"]:
        k = len(trees)
        names = [f"c{i}" for i in range(k)]
        taken = out.state.where(F.col("parent") != NONE).select("id", "parent")
        first = graph.edges.join(taken, (F.col("src") == F.col("parent")) & (F.col("dst") == F.col("id"))).groupBy("id")
        first = first.agg(F.min_by(F.struct(*[F.col(f"w{i}").alias(n) for i, n in enumerate(names)]), "pos").alias("w")).select("id", "w.*")
        costs = path_sums(out.state, first, names)
    return {"combined_state": out.state, "combined_edges": arcs.count(), "costs": costs}


def _options(graph: Graph, options: dict) -> dict:
    known = {"preferences": None, "compute_path_costs": True, "validate_inputs": True, "num_objectives": 0, "max_rounds": 1_000_000}
    unknown = set(options) - set(known)
    if unknown:
        raise InvalidArgument(f"unknown options {sorted(unknown)}")
    opt = known | options
    k = opt["num_objectives"] or graph.num_weights
    if not 1 <= k <= graph.num_weights:
        raise InvalidArgument(f"{k} objectives on {graph.num_weights} weights")
    opt["num_objectives"], opt["preferences"] = k, list(opt["preferences"] or [1] * k)
    if len(opt["preferences"]) != k:
        raise InvalidArgument("one preference for each objective is needed")
    scale_of(opt["preferences"])
    return opt


def compute(graph: Graph, source: int, **options) -> MultiObjectivePaths:
    opt = _options(graph, options)
    trees = [_solve(graph, source, {"objective": k, "max_rounds": opt["max_rounds"], "on_limit": "error"}).state for k in range(opt["num_objectives"])]
    return MultiObjectivePaths(graph, source, trees, opt)


def update(graph: Graph, batch: EdgeBatch, result: MultiObjectivePaths) -> Stats:
    return _update(graph, batch, result)[0]
