"""Histogram of directed simple cycles by length, up to a bound, kept up to date by the cycles through changed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import Internal, InvalidArgument
from tidegraph.graph import Commit, EdgeBatch, Graph
from tidegraph.store import counted, materialize, measured
from tidegraph.update import Result, Stats, update as _update


LOCAL = 50  # an update looks at the paths around changed edges if they are less than one in so many; else it counts what it keeps and what it has


def _apart(new: str, path: list[str]) -> Column:
    out = F.lit(True)
    for c in path:
        out &= F.col(new) != F.col(c)
    return out


def _closing(paths: DataFrame, edges: DataFrame, last: str, first: str) -> DataFrame:
    back = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_t"))
    return paths.join(back, (F.col(last) == F.col("_s")) & (F.col(first) == F.col("_t"))).drop("_s", "_t")


def count_cycles(edges: DataFrame, bound: int) -> DataFrame:
    """(length, count) of the cycles of 2 to ``bound`` edges (src, dst); each is found once, from its smallest vertex.

    A cycle is cut opposite its smallest vertex v0: a path of f edges from v0 meets one of f - 1 or f edges back to v0 at its end, so only
    paths of half the bound are ever made (rounded up), and both halves are dealt by v0 and the meeting point. Paths are columns of vertices larger
    than v0. With a column ``kept``, (length, count, kept): also the number of the cycles whose edges are all kept.
    """
    flagged = "kept" in edges.columns
    edges = edges.where("src <> dst").select("src", "dst", F.col("kept") if flagged else F.lit(True).alias("kept")).distinct()
    edges = materialize(edges, "cycle-edges")
    forth = edges.where("src < dst").select(F.col("src").alias("v0"), F.col("dst").alias("v1"), "kept")
    back = edges.where("dst < src").select(F.col("dst").alias("v0"), F.col("src").alias("x1"), "kept")
    shorter, counts = None, []
    for f in range(1, (bound + 1) // 2 + 1):
        if f > 1:
            forth = _longer(forth, edges, "v", f, "src", "dst")
            shorter, back = back, _longer(back, edges, "x", f, "dst", "src") if 2 * f <= bound else None
        if f > 2:
            forth, seen = measured(forth, "paths", F.count(F.lit(1)).alias("n"))
            if not seen["n"]:
                break
            back = back if back is None else materialize(back, "paths")
        counts.append(_met(forth, f, {f - 1: shorter, f: back}))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    out = out.groupBy("length").agg(F.sum("count").alias("count"), F.sum("kept").alias("kept"))
    return out if flagged else out.select("length", "count")


def _longer(paths: DataFrame, edges: DataFrame, name: str, n: int, near: str, far: str) -> DataFrame:
    """Paths (v0, <name>1, .., kept) of ``n`` - 1 edges, longer by an edge between their end, its ``near`` end, and a vertex not on them."""
    path = [f"{name}{i}" for i in range(1, n)]
    new = f"{name}{n}"
    step = edges.select(F.col(near).alias("_n"), F.col(far).alias(new), F.col("kept").alias("_k"))
    out = paths.join(step, F.col(path[-1]) == F.col("_n")).where((F.col(new) > F.col("v0")) & _apart(new, path))
    return out.select("v0", *path, new, (F.col("kept") & F.col("_k")).alias("kept"))


def _met(forth: DataFrame, f: int, backs: dict[int, DataFrame | None]) -> DataFrame:
    """(length, count, kept) of the cycles of a path of ``f`` edges and one back of as many as its key in ``backs``, apart but for their ends."""
    inner = [f"x{i}" for i in range(1, f)]
    both = None
    for n, back in backs.items():
        if back is not None:
            own = [F.col(x) if int(x[1:]) < n else F.lit(None).cast("long").alias(x) for x in inner]
            rows = back.select(F.col("v0").alias("_v0"), F.col(f"x{n}").alias("_end"), *own, F.col("kept").alias("_k"), F.lit(f + n).alias("length"))
            both = rows if both is None else both.unionByName(rows)
    apart = F.lit(True)
    for x in inner:
        apart &= F.col(x).isNull() | _apart(x, [f"v{i}" for i in range(1, f)])
    met = forth.join(both, (F.col("v0") == F.col("_v0")) & (F.col(f"v{f}") == F.col("_end"))).where(apart)
    return met.groupBy("length").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("kept") & F.col("_k")).alias("kept"))


def cycles_through(edges: DataFrame, changed: DataFrame, bound: int) -> DataFrame:
    """(length, count) of the cycles of distinct ``edges`` that hold one of ``changed`` (src, dst), each counted at its smallest changed edge.

    Paths begin with a changed edge of ``edges``, and each further edge is looked up among the changed ones; nothing of ``edges`` is written.
    """
    edges = edges.where("src <> dst").select("src", "dst")
    mark = changed.select("src", "dst").where("src <> dst").distinct().join(edges, ["src", "dst"], "left_semi")
    mark = materialize(mark, "changed")  # its size is known before the joins

    def later(paths: DataFrame, s: str, t: str) -> DataFrame:
        own = mark.select(F.col("src").alias("_cs"), F.col("dst").alias("_ct"))
        out = paths.join(own, (F.col(s) == F.col("_cs")) & (F.col(t) == F.col("_ct")), "left")
        after = F.struct(F.col(s).alias("v0"), F.col(t).alias("v1")) > F.struct("v0", "v1")
        return out.where(F.col("_cs").isNull() | after).drop("_cs", "_ct")

    path = ["v0", "v1"]
    paths = mark.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    counts = []
    for length in range(2, bound + 1):
        closed = later(_closing(paths, edges, path[-1], "v0"), path[-1], "v0")
        counts.append(closed.agg(F.count(F.lit(1)).alias("count")).select(F.lit(length).alias("length"), "count"))
        if length == bound:
            break
        nxt = f"v{length}"
        step = edges.select(F.col("src").alias("_s"), F.col("dst").alias(nxt))
        paths = paths.join(step, F.col(path[-1]) == F.col("_s")).where(_apart(nxt, path)).select(*path, nxt)
        paths = later(paths, path[-1], nxt)
        path.append(nxt)
        if length >= 4:
            paths, seen = measured(paths, "paths", F.count(F.lit(1)).alias("n"))
            if not seen["n"]:
                break
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.where("count > 0")


def _pairs(graph: Graph) -> DataFrame:
    out = graph.edges.select("src", "dst")
    return out.distinct() if graph.properties.parallel else out


def _differences(counts: dict[int, int], less: dict[int, int]) -> dict[int, int]:
    return {k: n - less.get(k, 0) for k, n in counts.items() if n - less.get(k, 0)}


def _as_dict(hist: DataFrame) -> dict[int, int]:
    return {r["length"]: r["count"] for r in hist.collect()}  # at most one row for each length


class CycleHistogram(Result):
    """Counts by length; entries 0 and 1 are always 0, self-loops lie on no cycle and two opposite edges make a cycle of 2."""

    name = "cycle_count"

    def __init__(self, graph: Graph, by_length: dict[int, int], max_length: int):
        super().__init__(graph, {"max_length": max_length})
        self.by_length, self.removed, self.added = by_length, {}, {}

    @property
    def bound(self) -> int:
        return min(self.options["max_length"], max(self.container.num_vertices, 2))

    @property
    def counts(self) -> list[int]:
        return [self.by_length.get(i, 0) for i in range(self.bound + 1)]

    def count(self, length: int) -> int:
        return self.by_length.get(length, 0)

    @property
    def total(self) -> int:
        return sum(self.by_length.values())

    def to_dict(self) -> dict[int, int]:
        return {k: n for k, n in sorted(self.by_length.items()) if n}

    def frame(self) -> DataFrame:
        """(length, count), lengths with cycles only."""
        return self.container.spark.createDataFrame(sorted(self.to_dict().items()), "length int, count long")

    def repaired(self, done: Commit) -> tuple[dict, Stats]:
        bound = min(self.options["max_length"], max(done.after.num_vertices, 2))
        (removed, n_removed), (added, n_added) = counted(done.removed.select("src", "dst"), "removed"), counted(done.added.select("src", "dst"), "added")
        now = _pairs(done.after)
        if (n_removed + n_added) * LOCAL <= now.count() and n_removed + n_added <= done.after.num_vertices // 2:
            minus = _as_dict(cycles_through(_pairs(done.before), removed, bound))
            plus = _as_dict(cycles_through(now, added, bound))
        else:  # what was there before and after lies on the same cycles on both sides
            came = added.withColumn("_came", F.lit(True))
            hist = count_cycles(now.join(came, ["src", "dst"], "left").select("src", "dst", F.col("_came").isNull().alias("kept")), bound).collect()
            kept, total = {r["length"]: r["kept"] for r in hist}, {r["length"]: r["count"] for r in hist}
            minus = _differences(self.by_length, kept)
            plus = _differences(total, kept)
        new = {k: self.by_length.get(k, 0) - minus.get(k, 0) + plus.get(k, 0) for k in {*self.by_length, *minus, *plus}}
        if any(n < 0 for n in new.values()):
            raise Internal("a count below 0")
        affected = sum(minus.values()) + sum(plus.values())
        return {"by_length": new, "removed": minus, "added": plus}, Stats(affected, batch=done.summary, more={"removed": sum(minus.values()), "added": sum(plus.values())})


def compute(graph: Graph, max_length: int) -> CycleHistogram:
    """Cycles of at most ``max_length`` edges. A bound of the number of vertices counts all; their number may grow exponentially."""
    if max_length < 2:
        raise InvalidArgument("cycles have 2 edges or more")
    if not graph.properties.directed:
        raise InvalidArgument("cycles are counted on directed graphs")
    bound = min(max_length, max(graph.num_vertices, 2))
    return CycleHistogram(graph, _as_dict(count_cycles(graph.edges, bound)), max_length)


def update(graph: Graph, batch: EdgeBatch, result: CycleHistogram) -> Stats:
    return _update(graph, batch, result)[0]
