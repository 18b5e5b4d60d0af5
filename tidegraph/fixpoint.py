"""Shortest-path trees as fixed points: relaxing rounds, invalidation of subtrees, repair after a change.

A state is a table (id, distance, parent) of the reached nodes; a node that isn't there is unreached. Arcs are (src, dst, w). Pairs
(distance, parent) are compared in this order, so ties go to the smallest parent and a root (parent -1) wins over all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument, NotConverged
from tidegraph.store import counted, discard, materialize, measured

NONE = -1
INFINITE = 2**61 - 1  # distance of an unreached node in results and files
STATE = "id long, distance long, parent long"
WIDE_FRONT = 200_000  # nodes from which on arcs are dealt by their source
MOST_CHANGES = 50_000  # rows that may have changed, however small the state is, before they join it


@dataclass(frozen=True)
class Limit:
    """What a loop does at ``rounds`` or ``visits``: ``error``, ``report`` (stop, not converged) or ``fallback`` (compute afresh)."""

    rounds: int = 1_000_000
    policy: str = "error"
    visits: int | None = None  # a bound of the nodes visited in all rounds; the round that would exceed it isn't begun
    exact: Callable[[], int] | None = None  # the bound itself where ``visits`` is a cheap one from below; asked for when that is exceeded

    def __post_init__(self):
        if self.policy not in ("error", "report", "fallback"):
            raise InvalidArgument(f"unknown policy {self.policy!r}")

    def beyond(self, visits: int) -> bool:
        return self.visits is not None and visits > self.visits and (self.exact is None or visits > self.exact())


@dataclass(frozen=True)
class Solved:
    state: DataFrame
    rounds: int = 0
    visits: int = 0
    converged: bool = True
    stopped_by: str = "none"  # or iterations, work_budget


def pair(distance: str, parent: str) -> Column:
    return F.struct(F.col(distance).alias("distance"), F.col(parent).alias("parent"))


class Arcs:
    """Arcs as a table (src, dst, w). What isn't a table (the line graph of a hypergraph) answers the same two questions: what a front offers to
    its neighbours, and what kept nodes offer to seeds. Between ``open`` and ``close`` its tables are kept."""

    def __init__(self, rows: DataFrame):
        self.rows, self.kept, self.dealt = rows, [], None

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def keep(self, rows: DataFrame) -> DataFrame:
        self.kept.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
        return self.kept[-1]

    def open(self) -> None:
        self.keep(self.rows)

    def close(self) -> None:
        for rows in self.kept:
            rows.unpersist()
        self.kept, self.dealt = [], None

    def offers(self, front: DataFrame, n: int) -> DataFrame:
        """(node, o) from ``front`` (src, distance) of ``n`` nodes. A large front deals the arcs by their source, once; a smaller one goes to where the
        arcs lie. Its number is known, while Spark judges it by the file of all changes, which outgrows a broadcast, and would deal all arcs again."""
        if self.dealt is None and n > WIDE_FRONT:
            self.dealt = self.keep(dealt_by(self.rows, "src"))
        offer = F.struct((F.col("distance") + F.col("w")).cast("long").alias("distance"), F.col("src").alias("parent"))
        front = F.broadcast(front) if n <= WIDE_FRONT else front
        return (self.rows if self.dealt is None else self.dealt).join(front, "src").select(F.col("dst").alias("node"), offer.alias("o"))

    def pulls(self, seeds: DataFrame, kept: DataFrame) -> DataFrame:
        """(node, o): what nodes of the state ``kept`` offer to ``seeds`` (id)."""
        near = self.rows.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").join(kept.select(F.col("id").alias("src"), "distance"), "src")
        offer = F.struct((F.col("distance") + F.col("w")).cast("long").alias("distance"), F.col("src").alias("parent"))
        return near.select(F.col("dst").alias("node"), offer.alias("o"))


def dealt_by(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt and ordered by ``keys``, so that a join on them moves and sorts the other side only."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def _merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, distance, parent): each node's smaller pair of the two."""
    both = base.select("id", pair("distance", "parent").alias("s")).union(delta.select("id", pair("distance", "parent").alias("s")))
    return both.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.distance", "s.parent")


def relax(arcs: DataFrame | Arcs, base: DataFrame, offers: DataFrame, limit: Limit = Limit()) -> Solved:
    """Rounds of offers to nodes until none moves any more. ``base``: (id, distance, parent), ``offers``: (node, o), the first of them.

    ``base`` is dealt and ordered by node once and kept; what has changed since is a table of its own, and that is all that a round writes: the best
    offers to each node, reduced before their shuffle (a hub receives one row from each task), are held against it and against ``base``
    where it lies. When the changes outgrow ``base`` they become part of it. Arcs are kept as they are while the front is small; a large front
    deals and orders them by their source, once. What an executor loses of kept tables is read again. The number of moved nodes comes off the
    round's job.
    """
    arcs = arcs if isinstance(arcs, Arcs) else Arcs(arcs)
    spark = arcs.spark
    count = F.count(F.lit(1)).alias("rows")
    moved = F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("n")
    base, n_base = counted(base.select("id", "distance", "parent"), "relax-base")
    arcs.open()
    at_hand = dealt_by(base, "id").persist(StorageLevel.MEMORY_AND_DISK)
    delta = spark.createDataFrame([], STATE + ", moved boolean")
    n_delta = rounds = visits = 0
    try:
        while True:
            best = offers.groupBy("node").agg(F.min("o").alias("o"))
            known = at_hand.select(F.col("id").alias("b"), pair("distance", "parent").alias("own"))
            better = best.join(known, F.col("node") == F.col("b"), "left").where("own IS NULL OR o < own")
            new = better.select(F.col("node").alias("id"), F.col("o").alias("s"), F.col("own.distance").alias("was"))
            both = delta.select("id", pair("distance", "parent").alias("s"), F.col("distance").alias("was")).union(new).groupBy("id").agg(F.min("s").alias("s"), F.min("was").alias("was"))
            nxt, seen = measured(both.select("id", "s.distance", "s.parent", (F.col("was").isNull() | (F.col("s.distance") < F.col("was"))).alias("moved")), "relax", moved, count)
            if n_delta:
                discard(delta)
            delta, n_delta = nxt, seen["rows"]
            if not seen["n"]:
                return Solved(materialize(_merged(base, delta), "relaxed") if n_delta else base, rounds, visits)
            over = "iterations" if rounds >= limit.rounds else "work_budget" if limit.beyond(visits + seen["n"]) else None
            if over:
                if limit.policy == "error":
                    raise NotConverged(f"no fixed point after {rounds} rounds and {visits} visits")
                return Solved(materialize(_merged(base, delta), "relaxed"), rounds, visits, False, over)
            visits += seen["n"]
            rounds += 1
            if n_delta > max(MOST_CHANGES, n_base):
                merged, n_base = counted(_merged(base, delta), "relax-base")
                at_hand.unpersist()
                base, at_hand = merged, dealt_by(merged, "id").persist(StorageLevel.MEMORY_AND_DISK)
                front_rows = materialize(delta.where("moved"), "relax")  # the front alone: its values are in the base now
                discard(delta)
                delta, n_delta = front_rows, seen["n"]
            offers = arcs.offers(delta.where("moved").select(F.col("id").alias("src"), "distance"), seen["n"])
    finally:
        at_hand.unpersist()
        arcs.close()


def solve(arcs: DataFrame | Arcs, base: DataFrame, limit: Limit = Limit()) -> Solved:
    """The fixed point from ``base`` (id, distance; parent -1)."""
    none = base.sparkSession.createDataFrame([], STATE)
    first = base.select(F.col("id").cast("long").alias("node"), F.struct(F.col("distance").cast("long").alias("distance"), F.lit(NONE).cast("long").alias("parent")).alias("o"))
    return relax(arcs, none, first, limit)


def subtree(state: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of ``roots`` (id) that are in the tree and of all below them, by pointer doubling: rounds grow with the logarithm of the depth."""
    roots = roots.select(F.col("id").alias("root")).distinct()
    cur = state.join(roots, F.col("id") == F.col("root"), "left").select("id", F.when(F.col("root").isNull(), F.col("parent")).otherwise(NONE).cast("long").alias("up"), F.col("root").isNotNull().alias("hit"))
    open_ = F.coalesce(F.sum(((F.col("up") != NONE) & ~F.col("hit")).cast("long")), F.lit(0)).alias("n")
    hits = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits")
    cur, seen = measured(cur, "subtree", open_, hits)
    while seen["n"] and seen["hits"]:
        above = cur.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("hit").alias("a_hit"))
        step = cur.join(above, F.col("up") == F.col("a"), "left")
        hit = F.col("hit") | F.coalesce("a_hit", F.lit(False))
        nxt, seen = measured(step.select("id", F.when(hit, NONE).otherwise(F.coalesce("a_up", F.lit(NONE))).cast("long").alias("up"), hit.alias("hit")), "subtree", open_, hits)
        discard(cur)
        cur = nxt
    return cur.where("hit").select("id")


@dataclass(frozen=True)
class Repaired:
    solved: Solved
    invalidated: int
    affected: int


def repair(state: DataFrame, arcs: DataFrame | Arcs, roots: DataFrame, heads: DataFrame, base: DataFrame, gone: DataFrame | None = None, limit: Limit = Limit(), tails: DataFrame | None = None) -> Repaired:
    """The state after a change.

    ``roots`` (id): nodes whose tree arc went or grew; their subtrees lose their values first, so that no value can rest on itself.
    Those and the ``heads`` (id) of new or cheaper arcs then take the best pair over their arcs and ``base``; decreases spread from
    there. Other nodes keep their parents. ``gone`` (id): nodes that no longer exist. ``tails`` (id): nodes with new arcs whose heads aren't named.
    """
    arcs = arcs if isinstance(arcs, Arcs) else Arcs(arcs)
    lost, invalidated = counted(subtree(state, roots), "invalid")
    kept = state.join(lost, "id", "left_anti")
    seeds = lost.union(heads.select("id")).distinct()
    if gone is not None:
        seeds = seeds.join(gone.select("id"), "id", "left_anti")
    seeds = materialize(seeds, "seeds")
    own = base.join(seeds, "id", "left_semi").select(F.col("id").alias("node"), F.struct(F.col("distance").cast("long").alias("distance"), F.lit(NONE).cast("long").alias("parent")).alias("o"))
    offers = arcs.pulls(seeds, kept).unionByName(own)
    if tails is not None:
        front, n = counted(kept.join(tails.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("src"), "distance"), "tails")
        offers = offers.unionByName(arcs.offers(front, n))
    out = relax(arcs, kept, offers, limit)
    new = out.state.select(F.col("id").alias("i"), F.col("distance").alias("d"), F.col("parent").alias("p"))
    same = F.col("distance").eqNullSafe(F.col("d")) & F.col("parent").eqNullSafe(F.col("p"))
    affected = state.join(new, F.col("id") == F.col("i"), "full_outer").where(~same).count()
    return Repaired(out, invalidated, affected)


def lowest_parents(state: DataFrame, arcs: DataFrame) -> DataFrame:
    """The state with each parent set to the smallest node that an arc of exactly the missing length leads from; roots stay roots."""
    near = arcs.join(state.select(F.col("id").alias("src"), F.col("distance").alias("from_d")), "src").join(state.select(F.col("id").alias("dst"), F.col("distance").alias("to_d")), "dst")
    tight = near.where("from_d + w = to_d").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("p"))
    joined = state.join(tight, F.col("id") == F.col("node"), "left")
    return joined.select("id", "distance", F.when(F.col("parent") == NONE, NONE).otherwise(F.coalesce("p", "parent")).cast("long").alias("parent"))
