"""Breadth-first levels from one source, kept up to date: shortest paths with arcs of length 1."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegraph.fixpoint import Limit
from tidegraph.graph import Commit, EdgeBatch, Graph
from tidegraph.operators.sssp import _solve, dense, repaired_tree
from tidegraph.update import Result, Stats, update as _update

UNREACHED = -1


class Levels(Result):
    name = "dynamic_bfs"

    def __init__(self, graph: Graph, source: int, state: DataFrame):
        super().__init__(graph)
        self.source, self.state = source, state

    def tree(self) -> DataFrame:
        """(v, level, parent) of every vertex; level -1: not reached."""
        return dense(self.container, self.state, UNREACHED).withColumnRenamed("distance", "level")

    def repaired(self, done: Commit) -> tuple[dict, Stats]:
        out = repaired_tree(self.state, done, self.source, None, Limit())
        s = out.solved
        return {"state": s.state}, Stats(out.affected, s.rounds, s.visits, invalidated=out.invalidated, batch=done.summary)


def compute(graph: Graph, source: int = 0) -> Levels:
    return Levels(graph, source, _solve(graph, source, {"objective": None, "max_rounds": 1_000_000, "on_limit": "error"}).state)


def update(graph: Graph, batch: EdgeBatch, result: Levels) -> Stats:
    return _update(graph, batch, result)[0]
