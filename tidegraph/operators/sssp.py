"""Single-source shortest paths on one objective, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument
from tidegraph.fixpoint import INFINITE, NONE, Limit, lowest_parents, repair, solve
from tidegraph.functions.trees import check_tree
from tidegraph.graph import Commit, EdgeBatch, Graph
from tidegraph.store import materialize
from tidegraph.update import Result, Stats, update as _update


def dense(graph: Graph, state: DataFrame, missing: int = INFINITE) -> DataFrame:
    """(v, distance, parent) of every vertex; unreached ones have ``missing`` and parent -1."""
    out = graph.vertices().withColumnRenamed("id", "v").join(state, F.col("v") == F.col("id"), "left")
    return out.select("v", F.coalesce("distance", F.lit(missing)).cast("long").alias("distance"), F.coalesce("parent", F.lit(NONE)).cast("long").alias("parent"))


def price_changes(done: Commit, objective: int | None) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of pairs that became dearer or went, and of those that became cheaper or came. Of parallel edges the cheapest counts."""
    w = F.lit(1) if objective is None else F.col(f"w{objective}")
    was = done.old.groupBy("src", "dst").agg(F.min(w).alias("was"))
    now = done.new.groupBy("src", "dst").agg(F.min(w).alias("now"))
    both = materialize(was.join(now, ["src", "dst"], "full_outer"), "prices")
    return both.where("was IS NOT NULL AND (now IS NULL OR now > was)").select("src", "dst"), both.where("now IS NOT NULL AND (was IS NULL OR now < was)").select("src", "dst")


def repaired_tree(state: DataFrame, done: Commit, source: int, objective: int | None, limit: Limit):
    dearer, cheaper = price_changes(done, objective)
    roots = dearer.join(state, (F.col("dst") == F.col("id")) & (F.col("src") == F.col("parent"))).select("id")
    base = done.after.spark.createDataFrame([(source, 0)], "id long, distance long")
    return repair(state, done.after.arcs(objective), roots, cheaper.select(F.col("dst").alias("id")).distinct(), base, limit=limit)


class ShortestPaths(Result):
    """Distances and parents from ``source``. The parent is the smallest in-neighbour on a shortest path; an update changes the parents of
    vertices it looks at again only, which makes no difference to trees that were such to begin with."""

    name = "sssp"

    def __init__(self, graph: Graph, source: int, state: DataFrame, options: dict):
        super().__init__(graph, options)
        self.source, self.state = source, state

    @classmethod
    def from_tree(cls, graph: Graph, source: int, tree: DataFrame, canonicalize: bool = True, **options) -> ShortestPaths:
        """Adopt (v, distance, parent); ``canonicalize`` sets each parent to the smallest possible one."""
        opt = _options(options)
        state = tree.where(F.col("distance") < INFINITE // 2).select(F.col("v").cast("long").alias("id"), F.col("distance").cast("long"), F.col("parent").cast("long"))
        arcs = graph.arcs(opt["objective"])
        if opt["validate_inputs"]:
            check_tree(state, arcs, source)
        state = materialize(lowest_parents(state, arcs) if canonicalize else state, "tree")
        return cls(graph, source, state, opt)

    def tree(self) -> DataFrame:
        return dense(self.container, self.state)

    def distances(self) -> DataFrame:
        return self.tree().select("v", "distance")

    def parents(self) -> DataFrame:
        return self.tree().select("v", "parent")

    def repaired(self, done: Commit) -> tuple[dict, Stats]:
        out = repaired_tree(self.state, done, self.source, self.options["objective"], Limit(self.options["max_rounds"], self.options["on_limit"]))
        s = out.solved
        if not s.converged and self.options["on_limit"] == "fallback":
            again = _solve(done.after, self.source, {**self.options, "on_limit": "error", "max_rounds": 10**9})
            return {"state": again.state}, Stats(out.affected, s.rounds + again.rounds, s.visits + again.visits, True, True, out.invalidated, done.summary)
        return {"state": s.state}, Stats(out.affected, s.rounds, s.visits, False, s.converged, out.invalidated, done.summary)


def _options(options: dict) -> dict:
    known = {"objective": 0, "validate_inputs": True, "max_rounds": 1_000_000, "on_limit": "error"}
    unknown = set(options) - set(known)
    if unknown:
        raise InvalidArgument(f"unknown options {sorted(unknown)}")
    return known | options


def _solve(graph: Graph, source: int, opt: dict):
    if not 0 <= source < graph.num_vertices:
        raise InvalidArgument(f"source {source} of {graph.num_vertices} vertices")
    base = graph.spark.createDataFrame([(source, 0)], "id long, distance long")
    return solve(graph.arcs(opt["objective"]), base, Limit(opt["max_rounds"], opt["on_limit"]))


def compute(graph: Graph, source: int, **options) -> ShortestPaths:
    opt = _options(options)
    return ShortestPaths(graph, source, _solve(graph, source, opt).state, opt)


def update(graph: Graph, batch: EdgeBatch, result: ShortestPaths) -> Stats:
    return _update(graph, batch, result)[0]
