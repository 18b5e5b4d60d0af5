"""Where new problems are added: cheapest values over arcs (fixed points), and sums over small patterns that a change touches (deltas).

A problem says what its input is and what a commit changes; computing, repairing and versioning are the same for all.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import Internal
from tidegraph.fixpoint import Limit, repair, solve
from tidegraph.store import materialize
from tidegraph.update import Result, Stats, update as _update


class FixedPointProblem(ABC):
    """Each node's value is its own start or the least of a neighbour's value plus the arc's weight (1 or more), whichever is less."""

    name = "fixed_point"

    @abstractmethod
    def arcs(self, container) -> DataFrame:
        """(src, dst, w), one row for a pair."""

    @abstractmethod
    def base(self, container) -> DataFrame:
        """(id, distance): the nodes that have a start, and it."""

    def changes(self, done) -> tuple[DataFrame, DataFrame]:
        """(src, dst) of arcs that a commit made dearer or took away, and of those it made cheaper or brought. By default the arcs before and after
        are compared whole; a problem that can tell from the commit alone should."""
        was, now = (self.arcs(c).select("src", "dst", F.col("w").alias(n)) for c, n in ((done.before, "was"), (done.after, "now")))
        both = materialize(was.join(now, ["src", "dst"], "full_outer").where("NOT was <=> now"), "changes")
        return both.where("was IS NOT NULL AND (now IS NULL OR now > was)").select("src", "dst"), both.where("now IS NOT NULL AND (was IS NULL OR now < was)").select("src", "dst")

    def compute(self, container, limit: Limit = Limit()) -> FixedPoint:
        return FixedPoint(self, container, solve(self.arcs(container), self.base(container), limit).state, limit)

    def update(self, container, batch, result: FixedPoint) -> Stats:
        return _update(container, batch, result)[0]


class FixedPoint(Result):
    """``state``: (id, distance, parent) of the nodes that have a value; parent -1 where it is the node's own start."""

    def __init__(self, problem: FixedPointProblem, container, state: DataFrame, limit: Limit):
        super().__init__(container)
        self.name, self.problem, self.state, self.limit = problem.name, problem, state, limit

    def repaired(self, done) -> tuple[dict, Stats]:
        p = self.problem
        dearer, cheaper = p.changes(done)
        was, now = p.base(done.before).select("id", F.col("distance").alias("was")), p.base(done.after).select("id", F.col("distance").alias("now"))
        starts = materialize(was.join(now, "id", "full_outer").where("NOT was <=> now"), "starts")
        roots = dearer.join(self.state, (F.col("dst") == F.col("id")) & (F.col("src") == F.col("parent"))).select("id")
        roots = roots.union(starts.where("was IS NOT NULL").join(self.state.where("parent = -1"), "id", "left_semi").select("id"))
        heads = cheaper.select(F.col("dst").alias("id")).union(starts.where("now IS NOT NULL").select("id")).distinct()
        out = repair(self.state, p.arcs(done.after), roots, heads, p.base(done.after), limit=self.limit)
        s = out.solved
        return {"state": s.state}, Stats(out.affected, s.rounds, s.visits, False, s.converged, out.invalidated, done.summary)


class AggregateDeltaProblem(ABC):
    """Sums by bin over instances of a pattern: the new sums are the old ones less the instances through what went, plus those through what came."""

    name = "aggregate_delta"

    @abstractmethod
    def total(self, container) -> DataFrame:
        """(bin, value) over all instances."""

    @abstractmethod
    def through(self, container, changed: DataFrame) -> DataFrame:
        """(bin, value) over the instances that hold an element of ``changed``, each counted once."""

    def gone(self, done) -> DataFrame:
        """What the commit took away, as ``through`` on the container before takes it. Graphs: (src, dst) of pairs."""
        return done.removed

    def come(self, done) -> DataFrame:
        return done.added

    def compute(self, container) -> Sums:
        return Sums(self, container, _sums(self.total(container)))

    def update(self, container, batch, result: Sums) -> Stats:
        return _update(container, batch, result)[0]


class Sums(Result):
    """``by_bin``: bin to value, bins of value 0 left out; ``removed`` and ``added``: of the last update."""

    def __init__(self, problem: AggregateDeltaProblem, container, by_bin: dict):
        super().__init__(container)
        self.name, self.problem, self.by_bin, self.removed, self.added = problem.name, problem, by_bin, {}, {}

    def repaired(self, done) -> tuple[dict, Stats]:
        minus, plus = _sums(self.problem.through(done.before, self.problem.gone(done))), _sums(self.problem.through(done.after, self.problem.come(done)))
        new = {b: self.by_bin.get(b, 0) - minus.get(b, 0) + plus.get(b, 0) for b in {*self.by_bin, *minus, *plus}}
        if any(v < 0 for v in new.values()):
            raise Internal("a sum below 0")
        affected = sum(minus.values()) + sum(plus.values())
        return {"by_bin": {b: v for b, v in new.items() if v}, "removed": minus, "added": plus}, Stats(affected, batch=done.summary)


def _sums(rows: DataFrame) -> dict:
    return {r["bin"]: r["value"] for r in rows.groupBy("bin").agg(F.sum("value").alias("value")).where("value <> 0").collect()}  # a row for each bin
