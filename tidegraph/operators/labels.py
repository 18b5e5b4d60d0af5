"""Harmonic labels on a similarity graph: seeds keep their class, all others tend to the weighted mean of their neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument, NotConverged
from tidegraph.graph import ACTIVE, Commit, EdgeBatch, Graph
from tidegraph.operators.components import connected_components
from tidegraph.store import discard, materialize, measured
from tidegraph.update import Result, Stats, update as _update

NO_SEED = -1
START = 0.5
TINY = 1e-10
SCALE = 2.0**32  # weights to seeds are summed in units of 2^-32, so sums don't depend on their order
UNROLL = 4  # rounds of ``compute`` in one job

#: Fixed values of the mixing that deals vertices to the two halves of an in-place round.
HALF_STEP, HALF_A, HALF_B = 0x9E3779B9, 0x7FEB352D, 0x846CA68B
_MASK = 0xFFFFFFFF


def half(vertex: Column, tag: int) -> Column:
    """0 or 1: the half of a round in which a vertex moves; neighbours differ with probability 1/2."""
    cut = lambda x: x.bitwiseAND(F.lit(_MASK))

    def times(x: Column, k: int) -> Column:  # modulo 2^32 without leaving 63 bits
        low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
        return cut(low * F.lit(k) + F.shiftleft(cut(high * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16))

    x = cut(vertex.bitwiseXOR(F.lit((tag * HALF_STEP) & _MASK)))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = times(x, HALF_A)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = times(x, HALF_B)
    x = x.bitwiseXOR(F.shiftright(x, 16))
    return x.bitwiseAND(F.lit(1)).cast("int")


def _clamped(x: Column) -> Column:
    """``x`` held in [0, 1]; ``x`` must not be null, since Spark's ``least`` and ``greatest`` skip nulls."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)).cast("float")


def harmonic(arcs: DataFrame, state: DataFrame, tolerance: float, max_rounds: int) -> tuple[DataFrame, int, bool]:
    """Jacobi rounds over all vertices without a seed until none moves by more than ``tolerance``.

    ``arcs``: (src, dst, w) between active vertices, ``state``: (id, label, seed). Weights are normed once; several rounds make one job,
    which reports the largest move of each, so the result is that of the first round that is still enough.
    """
    free = state.where(F.col("seed") < 0).select(F.col("id").alias("src"))
    own = arcs.join(free, "src", "left_semi")
    total = own.groupBy("src").agg(F.sum(F.col("w").cast("double")).alias("total")).where(F.col("total") > TINY)
    share = materialize(own.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "shares")
    cur = materialize(state.select("id", F.col("label").cast("float"), "seed"), "labels")
    rounds = 0
    while rounds < max_rounds:
        n = min(UNROLL, max_rounds - rounds)
        step = cur.withColumn("f0", F.col("label"))
        for i in range(n):
            mean = share.join(step.select(F.col("id").alias("dst"), f"f{i}"), "dst").groupBy(F.col("src").alias("s")).agg(F.sum(F.col("p") * F.col(f"f{i}")).alias("mean"))
            step = step.join(mean, F.col("id") == F.col("s"), "left").withColumn(f"f{i + 1}", F.when(F.col("s").isNotNull(), _clamped(F.col("mean"))).otherwise(F.col(f"f{i}"))).drop("s", "mean")
        moves = [F.coalesce(F.max(F.abs(F.col(f"f{i + 1}") - F.col(f"f{i}"))), F.lit(0.0)).alias(f"m{i}") for i in range(n)]
        step, seen = measured(step, "labels", *moves)
        enough = next((i for i in range(n) if seen[f"m{i}"] <= tolerance), None)
        last = n if enough is None else enough + 1
        discard(cur)
        cur = step.select("id", F.col(f"f{last}").alias("label"), "seed")
        rounds += last
        if enough is not None:
            return cur, rounds, True
    return cur, rounds, False


def propagate(arcs: DataFrame, state: DataFrame, schedule: str, tolerance: float, max_rounds: int, tag: int = 0) -> tuple[DataFrame, int, int, bool]:
    """Rounds over a front until it is empty. ``state``: (id, label, seed, active, front).

    ``damped``: a vertex of the front moves half the way to its neighbours' mean, all from the labels before the round. ``in_place``: two
    halves of the front move all the way one after the other, the second seeing the first. A vertex that moves by more than
    ``tolerance`` puts itself and its active neighbours without a seed on the next front.
    """
    size = F.coalesce(F.sum(F.col("front").cast("long")), F.lit(0)).alias("n")
    cur, seen = measured(state.select("id", F.col("label").cast("float"), "seed", "active", "front"), "labels", size)
    rounds = visits = 0
    while seen["n"] and rounds < max_rounds:
        visits += seen["n"]
        step = cur.withColumn("now", F.col("label"))
        for turn in (None,) if schedule == "damped" else (0, 1):
            mine = F.col("front") if turn is None else F.col("front") & (half(F.col("id"), tag) == turn)
            near = step.where(mine).select(F.col("id").alias("src")).join(arcs, "src").join(step.select(F.col("id").alias("dst"), F.col("now").alias("x")), "dst")
            mean = near.groupBy(F.col("src").alias("s")).agg(F.sum(F.col("w").cast("double")).alias("ww"), F.sum(F.col("w").cast("double") * F.col("x")).alias("wx"))
            goal = F.when(F.col("ww") > TINY, F.col("wx") / F.col("ww")).otherwise(F.col("now").cast("double"))
            goal = (F.col("now") + goal) / 2 if turn is None else goal
            step = step.join(mean, F.col("id") == F.col("s"), "left").withColumn("now", F.when(F.col("s").isNotNull(), _clamped(goal)).otherwise(F.col("now"))).drop("s", "ww", "wx")
        step = materialize(step, "labels")
        moved = step.where(F.col("front") & (F.abs(F.col("now") - F.col("label")) > tolerance)).select(F.col("id").alias("m"))
        wake = moved.join(arcs, F.col("m") == F.col("src")).select(F.col("dst").alias("wake")).union(moved).distinct()
        nxt = step.join(wake, F.col("id") == F.col("wake"), "left")
        nxt, seen = measured(nxt.select("id", F.col("now").alias("label"), "seed", "active", (F.col("wake").isNotNull() & F.col("active") & (F.col("seed") < 0)).alias("front")), "labels", size)
        discard(cur)
        discard(step)
        cur = nxt
        rounds += 1
        tag += 1
    return cur, rounds, visits, not seen["n"]


@dataclass(frozen=True)
class Start:
    """First labels of arrived vertices: components of the strong edges among them, each from its weights to seeds."""

    labels: DataFrame
    components: int
    edges: int


def start_labels(arrived: DataFrame, added: DataFrame, entries: DataFrame, seeds: DataFrame, threshold: float) -> Start:
    """``arrived``: (id, label), ``added`` and ``entries``: (src, dst, w) in both directions, new ones and all, ``seeds``: (id, seed).

    A component's label is its weight to class 1 over its weight to both; seeds count whether they are still active or not.
    """
    ids = arrived.select("id")
    strong = added.where((F.col("w") > threshold) & (F.col("src") < F.col("dst"))).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    strong = materialize(strong.select(F.col("src").alias("u"), F.col("dst").alias("v")), "strong")
    part = connected_components(strong).select(F.col("id").alias("i"), "component")
    own = materialize(arrived.join(part, F.col("id") == F.col("i"), "left").select("id", F.col("label").alias("own"), F.coalesce("component", "id").alias("component")), "components")
    known = seeds.where(F.col("seed") >= 0).select(F.col("id").alias("dst"), "seed")
    weight = F.rint(F.col("w").cast("double") * SCALE).cast("long")
    sums = entries.join(own.select(F.col("id").alias("src"), "component"), "src").join(known, "dst").groupBy("component")
    sums = sums.agg(F.sum(F.when(F.col("seed") == 0, weight).otherwise(0)).alias("w0"), F.sum(F.when(F.col("seed") == 1, weight).otherwise(0)).alias("w1"))
    l0, l1 = F.col("w0") / SCALE, F.col("w1") / SCALE
    first = F.when(F.col("own") >= 0, F.col("own").cast("double")).when(l0 + l1 > TINY, l1 / (l0 + l1)).otherwise(START)
    labels = own.join(sums, "component", "left").select("id", first.cast("float").alias("label"), "own", "component")
    return Start(labels, own.select("component").distinct().count(), strong.count())


class Labels(Result):
    """A label in [0, 1] for each vertex that has been active; the class is 1 from 0.5 on. Others stand at 0.5."""

    name = "label_propagation"

    def __init__(self, graph: Graph, state: DataFrame, options: dict):
        super().__init__(graph, options)
        self.state, self.tag, self.iterations, self.converged = state, 0, 0, True

    def labels(self) -> DataFrame:
        """(v, label) of all vertices."""
        out = self.container.vertices().withColumnRenamed("id", "v").join(self.state, F.col("v") == F.col("id"), "left")
        return out.select("v", F.coalesce("label", F.lit(START)).cast("float").alias("label"))

    def seed_labels(self) -> DataFrame:
        out = self.container.vertices().withColumnRenamed("id", "v").join(self.state, F.col("v") == F.col("id"), "left")
        return out.select("v", F.coalesce("seed", F.lit(NO_SEED)).cast("int").alias("seed"))

    def classes(self) -> DataFrame:
        return self.labels().select("v", (F.col("label") >= 0.5).cast("int").alias("class"))

    def accuracy(self, truth: DataFrame) -> float | None:
        """Share of active vertices without a seed whose class is that of ``truth`` (v, class)."""
        own = self.state.where(F.col("seed") < 0).join(self.container.active(), "id", "left_semi").join(truth.withColumnRenamed("v", "id"), "id")
        return own.agg(F.avg((F.col("class") == (F.col("label") >= 0.5).cast("int")).cast("int"))).first()[0]

    def repaired(self, done: Commit) -> tuple[dict, Stats]:
        opt, new, spark = self.options, done.after, done.after.spark
        none = spark.createDataFrame([], "id long, label tinyint")
        arrived = done.arrived.select("id", "label") if done.arrived is not None else none
        left = done.left.select("id") if done.left is not None else none.select("id")
        w = lambda df: df.select("src", "dst", F.col("w0").alias("w"))
        arcs = materialize(w(new.live_edges()), "live")
        near_gone = done.before.edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        touched = near_gone.union(arrived.select("id")).union(done.added.select(F.col("src").alias("id"))).union(done.added.select(F.col("dst").alias("id")))
        if done.removed is not None:
            touched = touched.union(done.removed.select(F.col("src").alias("id"))).union(done.removed.select(F.col("dst").alias("id")))
        touched = touched.distinct().withColumn("touched", F.lit(True))
        old = self.state.select(F.col("id").alias("o"), F.col("label").alias("was"), F.col("seed").alias("had"))
        seeds = self.state.select("id", "seed").join(arrived.select("id"), "id", "left_anti").unionByName(arrived.select("id", F.col("label").alias("seed")))
        threshold = opt["similarity_threshold"]
        if threshold is None:
            mean = arcs.agg(F.avg(F.col("w").cast("double"))).first()[0]
            threshold = START if mean is None else mean
        start = start_labels(materialize(arrived, "arrived"), materialize(w(done.new), "new"), w(new.edges), materialize(seeds, "seeds"), threshold)
        first = start.labels.select(F.col("id").alias("a"), F.col("label").alias("init"), F.col("own"))
        rows = old.join(first, F.col("o") == F.col("a"), "full_outer").select(F.coalesce("o", "a").alias("id"), F.coalesce("init", "was").alias("label"), F.coalesce("own", "had").cast("int").alias("seed"))
        live = new.active().withColumn("active", F.lit(True))
        rows = rows.join(live, "id", "full_outer").join(touched, "id", "left")
        active = F.coalesce("active", F.lit(False))
        rows = rows.select("id", F.coalesce("label", F.lit(START)).alias("label"), F.coalesce("seed", F.lit(NO_SEED)).alias("seed"), active.alias("active"), (F.coalesce("touched", F.lit(False)) & active & (F.coalesce("seed", F.lit(NO_SEED)) < 0)).alias("front"))
        rows, seen = measured(rows, "labels", F.coalesce(F.sum(F.col("front").cast("long")), F.lit(0)).alias("n"))
        state, rounds, visits, done_ = propagate(arcs, rows, opt["update_schedule"], opt["tolerance"], opt["max_iterations"], self.tag)
        fallback = False
        if not done_ and opt["on_iteration_limit"] == "error":
            raise NotConverged(f"labels still move after {rounds} rounds")
        if not done_ and opt["on_iteration_limit"] == "fallback":
            state, more, done_ = harmonic(arcs, state.select("id", "label", "seed"), opt["tolerance"], 10 * opt["max_iterations"])
            rounds, fallback = rounds + more, True
        final = F.when(F.col("seed") >= 0, F.col("seed").cast("float")).otherwise(F.col("label"))
        state = materialize(state.select("id", final.cast("float").alias("label"), F.col("seed").cast("int")), "labels")
        affected = state.join(old, F.col("id") == F.col("o"), "left").where(F.col("label") != F.coalesce("was", F.lit(START).cast("float"))).count()
        more = {"components": start.components, "sparsified_edges": start.edges, "initial_frontier": seen["n"], "similarity_threshold": threshold}
        values = {"state": state, "tag": self.tag + rounds + 1, "iterations": rounds, "converged": done_}
        return values, Stats(affected, rounds, visits, fallback, done_, batch=done.summary, more=more)


def _options(options: dict) -> dict:
    known = {"similarity_threshold": None, "tolerance": 1e-4, "max_iterations": 100_000, "on_iteration_limit": "report", "update_schedule": "in_place"}
    unknown = set(options) - set(known)
    if unknown:
        raise InvalidArgument(f"unknown options {sorted(unknown)}")
    opt = known | options
    if opt["tolerance"] <= 0 or opt["update_schedule"] not in ("in_place", "damped") or opt["on_iteration_limit"] not in ("report", "error", "fallback"):
        raise InvalidArgument("an option out of its range")
    return opt


def compute(graph: Graph, seeds: DataFrame | None = None, **options) -> Labels:
    """``seeds``: (id, label 0 or 1) of present vertices; others start at 0.5."""
    if graph.num_weights < 1 or graph.properties.directed:
        raise InvalidArgument("labels need an undirected weighted graph")
    opt = _options(options)
    spark = graph.spark
    seeds = seeds.select(F.col("id").cast("long").alias("s"), F.col("label").cast("int").alias("seed")) if seeds is not None else spark.createDataFrame([], "s long, seed int")
    seeds = materialize(seeds, "seeds")
    if seeds.where("s IS NULL OR seed IS NULL OR seed NOT IN (0, 1)").head(1) or seeds.groupBy("s").count().where("count > 1").head(1):
        raise InvalidArgument("seeds are distinct vertices of class 0 or 1")
    if seeds.join(graph.active(), F.col("s") == F.col("id"), "left_anti").head(1):
        raise InvalidArgument("a seed isn't an active vertex")
    kept = graph.status.where((F.col("status") != ACTIVE) & (F.col("seed") >= 0)).select(F.col("id"), F.col("seed").cast("int").alias("old")) if graph.status is not None else None
    rows = graph.active().join(seeds, F.col("id") == F.col("s"), "left").select("id", F.coalesce("seed", F.lit(NO_SEED)).alias("seed"))
    if kept is not None:
        rows = rows.unionByName(kept.select("id", F.col("old").alias("seed")))
    rows = rows.select("id", F.when(F.col("seed") >= 0, F.col("seed").cast("float")).otherwise(F.lit(START).cast("float")).alias("label"), "seed")
    arcs = graph.live_edges().select("src", "dst", F.col("w0").alias("w"))
    state, rounds, ok = harmonic(arcs, rows, opt["tolerance"], opt["max_iterations"])
    if not ok and opt["on_iteration_limit"] == "error":
        raise NotConverged(f"labels still move after {rounds} rounds")
    out = Labels(graph, materialize(state, "labels"), opt)
    out.iterations, out.converged = rounds, ok
    return out


def update(graph: Graph, batch: EdgeBatch, result: Labels) -> Stats:
    return _update(graph, batch, result)[0]
