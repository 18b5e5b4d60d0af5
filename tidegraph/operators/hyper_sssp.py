"""Shortest hyperpaths: the cheapest walk over hyperedges that share vertices, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument, NotConverged, OutOfRange
from tidegraph.fixpoint import INFINITE, NONE, WIDE_FRONT, Arcs, Limit, dealt_by, repair, solve
from tidegraph.hypergraph import HyperBatch, HyperCommit, Hypergraph
from tidegraph.store import materialize
from tidegraph.update import Later, Result, Stats, update as _update

MAX_WEIGHT = 2**28


class Shared(Arcs):
    """The arcs of the line graph in both directions, never written: a hyperedge offers its distance to its vertices, a vertex hands the least one
    (the smallest id among equals) to all its hyperedges, and entering one costs its weight. A round so moves no more rows than there are
    incidences. Weights are 1 or more, so what comes back to the hyperedge itself, or is hidden by it, is never better than what it has."""

    def __init__(self, h: Hypergraph):
        self.h = h
        super().__init__(h.incidence)

    @staticmethod
    def _weighed(h: Hypergraph) -> DataFrame:
        return h.incidence.join(h.live().select("h", "w"), "h")

    def open(self) -> None:
        if self.dealt is None:
            self.dealt = self.keep(dealt_by(self._weighed(self.h), "h")), self.keep(dealt_by(self._weighed(self.h), "v"))

    def _handed(self, at: DataFrame, to: DataFrame) -> DataFrame:
        """(node, o) from (v, distance, src) over ``to`` (v, h, w)."""
        best = at.groupBy("v").agg(F.min(F.struct("distance", F.col("src").alias("parent"))).alias("b"))
        return to.join(best, "v").select(F.col("h").alias("node"), F.struct((F.col("b.distance") + F.col("w")).cast("long").alias("distance"), F.col("b.parent").alias("parent")).alias("o"))

    def offers(self, front: DataFrame, n: int) -> DataFrame:
        self.open()
        by_h, by_v = self.dealt
        front = F.broadcast(front) if n <= WIDE_FRONT else front
        return self._handed(by_h.join(front.withColumnRenamed("src", "h"), "h").select("v", "distance", F.col("h").alias("src")), by_v)

    def pulls(self, seeds: DataFrame, kept: DataFrame) -> DataFrame:
        self.open()
        by_h, by_v = self.dealt
        to = by_h.join(seeds.select(F.col("id").alias("h")), "h", "left_semi")
        near = by_v.join(to.select("v").distinct(), "v", "left_semi")
        return self._handed(near.join(kept.select(F.col("id").alias("h"), "distance"), "h").select("v", "distance", F.col("h").alias("src")), to)


def entries(h: Hypergraph, source: int) -> DataFrame:
    """(id, distance): the hyperedges that hold the source, at their own weights."""
    return h.incidence.where(F.col("v") == source).select("h").join(h.live().select("h", "w"), "h").select(F.col("h").alias("id"), F.col("w").cast("long").alias("distance"))


def least_entries(h: Hypergraph) -> int:
    """A number of line-graph entries that there are at least: each hyperedge meets all others of its most frequent vertex."""
    degree = h.incidence.groupBy("v").agg((F.count(F.lit(1)) - 1).alias("n"))
    return h.incidence.join(degree, "v").groupBy("h").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class HyperPaths(Result):
    """Distance and parent of every live hyperedge; the parent is the smallest neighbour on a cheapest walk, -1 where the source is in it."""

    name = "hyper_sssp"

    def __init__(self, hypergraph: Hypergraph, source: int, state: DataFrame, options: dict):
        super().__init__(hypergraph, options)
        self.source, self.state = source, state

    def hyperedges(self) -> DataFrame:
        """(h, distance, parent) for ids of live hyperedges."""
        out = self.container.live().select("h").join(self.state, F.col("h") == F.col("id"), "left")
        return out.select("h", F.coalesce("distance", F.lit(INFINITE)).cast("long").alias("distance"), F.coalesce("parent", F.lit(NONE)).cast("long").alias("parent"))

    def vertex_distances(self) -> DataFrame:
        """(v, distance): the least distance of the live hyperedges that hold v, 0 for the source."""
        self.require_fresh()
        h = self.container
        own = h.incidence.join(self.state, F.col("h") == F.col("id")).groupBy("v").agg(F.min("distance").alias("d"))
        out = h.spark.range(h.num_vertices).withColumnRenamed("id", "v").join(own, "v", "left")
        return out.select("v", F.when(F.col("v") == self.source, 0).otherwise(F.coalesce("d", F.lit(INFINITE))).cast("long").alias("distance"))

    def distance_to(self, v: int) -> int:
        return self.vertex_distances().where(F.col("v") == v).first().distance

    def repaired(self, done: HyperCommit) -> tuple[dict, Stats]:
        new, opt = done.after, self.options
        if opt["validate_inputs"]:
            _weights(new.live().join(done.inserted.select("h"), "h", "left_semi"))
        changed = materialize(done.changed().select(F.col("h").alias("id")), "changed")
        came = done.inserted.select(F.col("h").alias("id"))
        went = done.deleted.select(F.col("h").alias("id"))
        # tree arcs at a changed hyperedge that stand no more: their ends share no vertex now, or the parent's id was freed
        links = self.state.where(F.col("parent") != NONE).select("id", "parent")
        near = materialize(links.join(changed, "id", "left_semi").union(links.join(changed.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")).distinct(), "links")
        ends = near.join(went.select(F.col("id").alias("parent")), "parent", "left_anti").join(new.incidence.select(F.col("h").alias("id"), "v"), "id")
        stand = ends.join(new.incidence.select(F.col("h").alias("parent"), "v"), ["parent", "v"], "left_semi").select("id", "parent")
        cut = near.join(stand, ["id", "parent"], "left_anti").select("id")
        left = done.lost.where(F.col("v") == self.source).select(F.col("h").alias("id")).join(self.state.where(F.col("parent") == NONE).select("id"), "id", "left_semi")
        roots = cut.union(came).union(went).union(left)
        grown = done.gained.select(F.col("h").alias("id"))
        gone = materialize(went.join(came, "id", "left_anti"), "gone")
        base = entries(new, self.source)
        budget = lambda entries: int(opt["work_budget"] * max(1, entries))
        limit = Limit(opt["max_iterations"], "report", budget(least_entries(new)), lambda: budget(2 * new.line_graph().count()))
        arcs = Shared(new)
        out = repair(self.state, arcs, roots, grown.union(came).distinct(), base, gone, limit, grown)
        s, over = out.solved, out.solved.stopped_by
        more = Later({"line_graph_deletions": lambda: done.pair_delta()[0].count(), "line_graph_insertions": lambda: done.pair_delta()[1].count(), "fallback_reason": over})
        state = s.state
        if over != "none":
            if opt["on_budget"] == "error":
                raise NotConverged(f"the update went beyond its budget ({over}): {s.rounds} rounds, {s.visits} visits")
            state = solve(arcs, base).state
        stats = Stats(out.invalidated, s.rounds, s.visits, over != "none", True, out.invalidated, done.summary, more)
        return {"state": state}, stats


def _weights(live: DataFrame) -> None:
    if live.where(F.col("w").isNull() | (F.col("w") < 1) | (F.col("w") > MAX_WEIGHT)).head(1):
        raise OutOfRange(f"weights are 1 to {MAX_WEIGHT}")


def _options(options: dict) -> dict:
    known = {"work_budget": 1.0, "max_iterations": 4096, "on_budget": "recompute", "validate_inputs": True}
    unknown = set(options) - set(known)
    if unknown or options.get("on_budget", "error") not in ("recompute", "error"):
        raise InvalidArgument(f"unknown options {sorted(unknown) or options['on_budget']}")
    return known | options


def compute(hypergraph: Hypergraph, source: int, **options) -> HyperPaths:
    """Options: ``max_iterations`` (rounds of an update before ``on_budget`` acts: ``recompute`` or ``error``), ``work_budget`` (visits of an
    update for each line-graph entry; a round that would exceed it isn't begun), ``validate_inputs``."""
    opt = _options(options)
    if not 0 <= source < hypergraph.num_vertices:
        raise InvalidArgument(f"source {source} of {hypergraph.num_vertices} vertices")
    if opt["validate_inputs"]:
        _weights(hypergraph.live())
    return HyperPaths(hypergraph, source, solve(Shared(hypergraph), entries(hypergraph, source)).state, opt)


def update(hypergraph: Hypergraph, batch: HyperBatch, result: HyperPaths) -> Stats:
    return _update(hypergraph, batch, result)[0]
