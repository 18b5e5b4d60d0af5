"""Seeded generators of graphs, hypergraphs and batches.

Every draw is a digest of the seed and of what is drawn, so results don't depend on partitions, reruns or engines. They aren't the random
streams of other tools.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument
from tidegraph.functions.ordinals import numbered
from tidegraph.graph import EdgeBatch, Graph
from tidegraph.hypergraph import HyperBatch, Hypergraph
from tidegraph.operators import bfs, sssp
from tidegraph.sources.graphs import draw, drawn_weights
from tidegraph.store import materialize


def chosen(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows of ``df`` by the smallest draws, with ``seq`` in that order; all if there are fewer."""
    ordered = df.withColumn("_d", draw(seed, *keys)).orderBy("_d", *keys).limit(n)
    return numbered(ordered, ["_d", *keys], "seq").drop("_d")


def random_pairs(spark: SparkSession, n: int, count: int, seed: int, vertices: DataFrame | None = None) -> DataFrame:
    """(seq, src, dst): ``count`` pairs of vertices, self-loops left out by drawing the other end among the rest."""
    rows = spark.range(count).withColumnRenamed("id", "seq")
    if vertices is None:
        src = F.floor(draw(seed, "seq", F.lit("s")) * n)
        other = F.floor(draw(seed, "seq", F.lit("t")) * (n - 1))
        return rows.select("seq", src.cast("long").alias("src"), F.pmod(src + 1 + other, F.lit(n)).cast("long").alias("dst"))
    own = materialize(numbered(vertices.select("id"), ["id"], "nth"), "region")
    m = own.count()
    picked = random_pairs(spark, m, count, seed)
    for c in ("src", "dst"):
        picked = picked.join(own.select(F.col("nth").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return picked.select("seq", "src", "dst")


@dataclass(frozen=True)
class Changes:
    batch: EdgeBatch
    centre: int = -1
    region: int = 0
    requested_deletes: int = 0
    deletes: int = 0


def path_changes(
    graph: Graph, num_changes: int, insertion_percentage: float = 50.0, mode: str = "uniform", low: int = 1, high: int = 100, seed: int = 1, local_hops: int = 0, safe_deletions: bool = False, source: int = 0,
) -> Changes:
    """A batch for weighted graphs.

    ``uniform``: random insertions, deletions of random edges. ``targeted``: insertions below the average weight, deletions of shortest-
    path tree edges. ``reweight``: present edges get new weights. ``increase``: tree edges get larger weights. ``local_hops``: all ends lie
    so near a random centre. ``safe_deletions``: deletions after which a reached vertex would not be reached are left out.
    """
    if mode not in ("uniform", "targeted", "reweight", "increase") or num_changes < 0 or not 1 <= low <= high or graph.num_vertices < 2 or graph.num_weights < 1:
        raise InvalidArgument("an option out of its range")
    spark, names = graph.spark, graph.weights
    region, centre = None, -1
    if local_hops > 0:
        centre = chosen(graph.vertices(), 1, seed, "id").first().id
        both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        near = bfs.compute(Graph.from_edges(both, graph.num_vertices, weights=[]), centre).state
        region = materialize(near.where(F.col("distance") <= local_hops).select("id"), "region")
        if region.count() < 2:
            raise InvalidArgument("a region of fewer than 2 vertices")
    edges = graph.edges.select("src", "dst", *names).dropDuplicates(["src", "dst"])
    if region is not None:
        for c in ("src", "dst"):
            edges = edges.join(region.withColumnRenamed("id", c), c, "left_semi")
    n_ins = round(num_changes * insertion_percentage / 100)
    none = spark.createDataFrame([], "seq long, src long, dst long")
    if mode in ("targeted", "increase"):
        tree = None
        for k in range(graph.num_weights):
            own = sssp.compute(graph, source, objective=k).state.where("parent >= 0").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
            tree = own if tree is None else tree.unionByName(own)
        targets = edges.join(tree.distinct(), ["src", "dst"], "left_semi")
    else:
        targets = edges
    if mode in ("reweight", "increase"):
        rows = chosen(targets, num_changes, seed, "src", "dst")
        if mode == "reweight":
            rows = drawn_weights(rows.drop(*names), names, low, high, seed + 1)
        else:
            for w in names:
                rows = rows.withColumn(w, F.least(F.lit(2**31 - 1), F.col(w) + 1 + F.floor(draw(seed + 1, "src", "dst", F.lit(w)) * high)).cast("int"))
        return Changes(EdgeBatch(rows.select("seq", "src", "dst", *names), none), centre, region.count() if region is not None else 0)
    if mode == "targeted":
        top = edges.agg(*[F.avg(w).alias(w) for w in names]).first()
        ins = random_pairs(spark, graph.num_vertices, n_ins, seed + 2, region)
        for w in names:
            ins = ins.withColumn(w, (1 + F.floor(draw(seed + 3, "seq", F.lit(w)) * max(1, int(top[w] or 1) - 1))).cast("int"))
    else:
        ins = drawn_weights(random_pairs(spark, graph.num_vertices, n_ins, seed + 2, region), names, low, high, seed + 3)
    dels = materialize(chosen(targets, num_changes - n_ins, seed + 4, "src", "dst").select("seq", "src", "dst"), "deletions")
    wanted = dels.count()
    if safe_deletions:
        dels = _safe(graph, EdgeBatch(ins, dels), dels, source)
    return Changes(EdgeBatch(ins, dels), centre, region.count() if region is not None else 0, wanted, dels.count())


def _safe(graph: Graph, batch: EdgeBatch, dels: DataFrame, source: int) -> DataFrame:
    """Deletions without those at vertices that would no longer be reached; again until none is lost."""
    reached = materialize(bfs.compute(graph, source).state.select("id"), "reached")
    while True:
        after = graph.commit(EdgeBatch(batch.inserts, dels)).after
        lost = materialize(reached.join(bfs.compute(after, source).state.select("id"), "id", "left_anti"), "lost")
        if not lost.head(1):
            return dels
        kept = materialize(dels.join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti").select("seq", "src", "dst"), "deletions")
        if kept.count() == dels.count():
            return kept.limit(0)
        dels = kept


def cycle_changes(graph: Graph, num_deletions: int, num_insertions: int, seed: int = 0, locality_window: int = -1) -> EdgeBatch:
    """Deletions of present edges and insertions of missing ones without self-loops; with a window, all ends lie in so many consecutive ids."""
    spark, n = graph.spark, graph.num_vertices
    edges, first, width = graph.edges.select("src", "dst").where("src <> dst").distinct(), 0, n
    if 0 <= locality_window < n:
        width = min(n, max(2, locality_window))
        first = int(spark.range(1).select(F.floor(draw(seed, F.lit("window")) * (n - width + 1))).first()[0])
        edges = edges.where((F.col("src") >= first) & (F.col("dst") >= first) & (F.col("src") < first + width) & (F.col("dst") < first + width))
    dels = chosen(edges, num_deletions, seed + 1, "src", "dst").select("seq", "src", "dst")
    edges = materialize(edges, "present")
    free = width * (width - 1) - edges.count()
    if free < num_insertions:
        raise InvalidArgument(f"{num_insertions} insertions where {free} edges are missing")
    found, tries = None, 2 * num_insertions + 16
    while num_insertions:
        some = random_pairs(spark, width, tries, seed + 2).select((F.col("src") + first).alias("src"), (F.col("dst") + first).alias("dst"), "seq")
        once = some.groupBy("src", "dst").agg(F.min("seq").alias("at")).join(edges, ["src", "dst"], "left_anti")
        found = materialize(once, "missing")
        if found.count() >= num_insertions:
            break
        tries *= 4
    ins = numbered(found.orderBy("at").limit(num_insertions), ["at"], "seq").select("seq", "src", "dst") if found is not None else dels.limit(0)
    return EdgeBatch(ins, dels)


def uniform_hypergraph(spark: SparkSession, num_vertices: int, num_hyperedges: int, least: int = 1, most: int = 4, seed: int = 1) -> DataFrame:
    """(h, v): sizes uniform in [least, most], members distinct: the first of drawn ones that are distinct, so a member needs no second look
    at the others of its hyperedge."""
    if least < 1 or most < least or num_vertices < 1 and num_hyperedges:
        raise InvalidArgument("an option out of its range")
    least, most = min(least, num_vertices), min(most, num_vertices)
    tries = most * 3 + 8 if most * 3 < num_vertices else num_vertices * 24
    rows = spark.range(num_hyperedges).withColumnRenamed("id", "h").withColumn("size", (least + F.floor(draw(seed, "h", F.lit("size")) * (most - least + 1))).cast("int"))
    picks = rows.select("h", "size", F.explode(F.sequence(F.lit(0), F.lit(tries))).alias("i")).withColumn("v", F.floor(draw(seed, "h", "i") * num_vertices).cast("long"))
    own = picks.groupBy("h", "size").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("all"))
    distinct = F.array_distinct(F.transform("all", lambda x: x.v))
    return own.select("h", F.explode(F.slice(distinct, 1, F.col("size"))).alias("v"))


def random_weights(hyperedges: DataFrame, low: int = 1, high: int = 100, seed: int = 1) -> DataFrame:
    return hyperedges.select("h", (low + F.floor(draw(seed, "h", F.lit("w")) * (high - low + 1))).cast("int").alias("w"))


MIXES = (
    "insert_only", "delete_only", "mixed", "reuse", "heavy_delete", "delete_all", "reinsert", "larger", "duplicates", "dead_ids", "skewed", "limits", "empty",
    "incidence_removals", "incidence_additions", "incidence_mixed", "incidence_emptying", "incidence_same_batch", "incidence_repeats", "incidence_out_of_range",
)


def hyperedge_batch(h: Hypergraph, mix: str, size: int = 4, least: int = 1, most: int = 4, seed: int = 1, skewed: int = 64) -> HyperBatch:
    """A batch of one of the kinds ``MIXES``, small enough for the driver: it is a test helper as well as a generator."""
    if mix not in MIXES:
        raise InvalidArgument(f"unknown kind {mix!r}")
    spark, n, weighted = h.spark, h.num_vertices, h.properties.weighted
    k, bound = size, h.id_bound()
    ids = [r.h for r in chosen(h.live().select("h"), 10**6, seed, "h").orderBy("seq").collect()]
    members = {r.h: list(r.members) for r in h.members().collect()}
    weights = {r.h: r.w for r in h.live().select("h", "w").collect()}

    def fresh(count: int, lo: int = least, hi: int = most) -> list[list[int]]:
        rows = uniform_hypergraph(spark, n, count, lo, max(lo, hi), seed + 7).groupBy("h").agg(F.sort_array(F.collect_list("v")).alias("m")).orderBy("h").collect()
        return [list(r.m) for r in rows]

    dead = [i for i in range(bound) if i not in members]
    half = (k + 1) // 2
    delete: list[int] = []
    insert: list[list[int]] = []
    remove: list[tuple[int, int]] = []
    add: list[tuple[int, int]] = []
    given: list[int] | None = None
    outsider = lambda i: next(((i, v) for v in range(n) if v not in members[i]), None)
    wide = [i for i in ids if len(members[i]) > 1]
    if mix == "insert_only":
        insert = fresh(k)
    elif mix == "delete_only":
        delete = ids[:k]
    elif mix == "mixed":
        delete, insert = ids[:half], fresh(half)
    elif mix == "reuse":
        delete = sorted(ids, key=lambda i: -len(members[i]))[:k]
        insert = fresh(k, 1, min((len(members[i]) for i in delete), default=most))
    elif mix == "heavy_delete":
        delete, insert = ids[: len(ids) * 9 // 10], fresh(k)
    elif mix == "delete_all":
        delete = ids
    elif mix == "reinsert":
        delete = ids[:k]
        insert, given = [members[i] for i in delete], [weights[i] for i in delete]
    elif mix == "larger":
        delete, insert = ids[: len(ids) // 2], fresh(2 * len(ids) + 3)
    elif mix == "duplicates":
        insert = [m + m[::-1] for m in fresh(k)] + [members[min(ids)] for _ in ids[:1]]
    elif mix == "dead_ids":
        delete = ids[:2] + ids[:2] + dead[:1] + [bound, -1]
        insert = fresh(1)
    elif mix == "skewed":
        delete, insert = ids[:2], fresh(1, min(n, skewed), min(n, skewed)) + fresh(1, 1, 1)
    elif mix == "limits":
        delete, insert = [max(ids)] * bool(ids) + [-(2**63), 2**63 - 1, bound], [[0, n - 1], [n - 1], [0]]
    elif mix == "incidence_removals":
        remove = [(i, members[i][0]) for i in wide[:k]]
    elif mix == "incidence_additions":
        add = [x for i in ids[:k] if (x := outsider(i))]
    elif mix == "incidence_mixed":
        delete, rest = ids[:half], ids[half:]
        remove = [(i, members[i][0]) for i in rest if len(members[i]) > 1][:half]
        add, insert = [x for i in rest[:half] if (x := outsider(i))], fresh(half)
    elif mix == "incidence_emptying":
        remove, insert = [(i, v) for i in ids[:2] for v in members[i]], fresh(1)
    elif mix == "incidence_same_batch":
        delete, rest = ids[:2], ids[2:]
        remove = [(i, members[i][0]) for i in delete] + [(bound, 0)] + [(i, members[i][0]) for i in rest if len(members[i]) > 1][:1]
        add = [(i, 0) for i in delete] + [(bound, 0)] + [x for i in rest[:1] if (x := outsider(i))]
        insert = fresh(2)
    elif mix == "incidence_repeats":
        remove = [(i, members[i][0]) for i in wide[:1]] * 2
        add = [x for i in ids[-1:] if (x := outsider(i))] * 2 + [(ids[-1], members[ids[-1]][-1])] * bool(ids)
    elif mix == "incidence_out_of_range":
        some = ids[:1]
        bad = [(i, v) for i in some for v in (-1, n)] + [(i, 0) for i in (-1, bound, 2**63 - 1, *dead[:1])]
        remove, add = bad, bad + [x for i in some if (x := outsider(i))]
    if weighted and given is None:
        given = [1 + (seed * 31 + i * 17) % 100 for i in range(len(insert))]
    return HyperBatch.of(spark, delete, remove, add, insert, given)


def closed_batch(h: Hypergraph, deletions: int, insertions: int, least: int = 1, most: int = 4, sample: bool = False, seed: int = 1) -> HyperBatch:
    """``deletions`` live hyperedges go; ``insertions`` are random ones or (``sample``) copies of live ones."""
    spark = h.spark
    dels = chosen(h.live().select("h"), deletions, seed, "h").select("seq", "h")
    if sample:
        new = chosen(h.members(), insertions, seed + 1, "h").select("seq", "members")
    else:
        new = uniform_hypergraph(spark, h.num_vertices, insertions, least, most, seed + 1).groupBy(F.col("h").alias("seq")).agg(F.sort_array(F.collect_list("v")).alias("members"))
    w = (1 + F.floor(draw(seed + 2, "seq") * 100)).cast("int") if h.properties.weighted else F.lit(None).cast("int")
    return HyperBatch(dels, None, None, new.select("seq", "members", w.alias("w")))


@dataclass(frozen=True)
class ArrivalStream:
    """``edges``: (src, dst, w, batch) of the whole graph, u < v, in its batches; ``vertices``: (id, batch, class, label, leaves)."""

    edges: DataFrame
    vertices: DataFrame
    num_batches: int
    num_vertices: int

    @property
    def similarity_threshold(self) -> float:
        """The mean weight of the whole graph."""
        return self.edges.agg(F.avg(F.col("w").cast("double"))).first()[0] or 0.5

    def row_capacity(self) -> DataFrame:
        """(v, capacity): each vertex's degree in the whole graph."""
        ends = self.edges.select(F.col("src").alias("v")).unionByName(self.edges.select(F.col("dst").alias("v"))).groupBy("v").count()
        return self.vertices.select(F.col("id").alias("v")).join(ends, "v", "left").select("v", F.coalesce("count", F.lit(0)).alias("capacity"))

    def true_labels(self) -> DataFrame:
        return self.vertices.select(F.col("id").alias("v"), "class")

    def batch(self, i: int) -> EdgeBatch:
        come = self.vertices.where(F.col("batch") == i).select(F.col("id").alias("seq"), "id", "label")
        gone = self.vertices.where(F.col("leaves") == i).select("id")
        new = numbered(self.edges.where(F.col("batch") == i), ["src", "dst"], "seq").select("seq", "src", "dst", F.col("w").alias("w0"))
        return EdgeBatch(new, None, come, gone)

    def batches(self) -> list[EdgeBatch]:
        return [self.batch(i) for i in range(self.num_batches)]

    def graph(self) -> Graph:
        return Graph.with_capacity(self.edges.sparkSession, self.num_vertices)

    def operations(self) -> DataFrame:
        """(batch, seq, op, src, dst, w, label): the stream as a log of operations."""
        none, w = F.lit(None), F.array(F.col("w").cast("double"))
        come = self.vertices.select("batch", F.col("id").alias("seq"), F.lit("+v").alias("op"), F.col("id").alias("src"), none.cast("long").alias("dst"), none.cast("array<double>").alias("w"), "label")
        gone = self.vertices.where("leaves IS NOT NULL").select(F.col("leaves").alias("batch"), F.col("id").alias("seq"), F.lit("-v").alias("op"), F.col("id").alias("src"), none.cast("long").alias("dst"), none.cast("array<double>").alias("w"), none.cast("tinyint").alias("label"))
        new = self.edges.select("batch", (F.col("src") * self.num_vertices + F.col("dst")).alias("seq"), F.lit("+e").alias("op"), "src", "dst", w.alias("w"), none.cast("tinyint").alias("label"))
        return come.unionByName(gone).unionByName(new)


def vertex_arrivals(spark: SparkSession, total_vertices: int = 50_000, average_degree: int = 5, num_batches: int = 10, seed: int = 42, ground_truth_fraction: float = 0.01, deleted_fraction: float = 0.09) -> ArrivalStream:
    """Two classes of vertices; a random tree and random edges, heavy within a class (0.5 to 1) and light between (0.01 to 0.5).

    Batch 0 is the first ground truth; the others arrive in the later batches, a share of them labelled. An edge comes with the later of
    its ends. From batch 2 on, vertices of earlier batches leave, as many as ``deleted_fraction`` of the arrivals.
    """
    n = total_vertices
    if n < 2 or average_degree < 1 or num_batches < 1:
        raise InvalidArgument("an option out of its range")
    ids = spark.range(n)
    first = draw(seed, "id", F.lit("truth")) < ground_truth_fraction
    later = (1 + F.floor(draw(seed, "id", F.lit("batch")) * max(1, num_batches - 1))).cast("int")
    kind = F.floor(draw(seed, "id", F.lit("class")) * 2).cast("int")
    rows = ids.select("id", kind.alias("class"), F.when(first, 0).otherwise(F.least(later, F.lit(num_batches - 1))).cast("int").alias("batch"))
    known = (F.col("batch") == 0) | (draw(seed, "id", F.lit("label")) < ground_truth_fraction)
    leave = F.col("batch") + 1 + F.floor(draw(seed, "id", F.lit("when")) * num_batches).cast("int")
    leaves = F.when((draw(seed, "id", F.lit("leaves")) < 2 * deleted_fraction) & (F.col("batch") > 0) & (leave < num_batches), leave)
    vertices = materialize(rows.select("id", "class", "batch", F.when(known, F.col("class")).otherwise(-1).cast("tinyint").alias("label"), leaves.alias("leaves")), "arrivals")
    tree = spark.range(1, n).select(F.floor(draw(seed, "id", F.lit("tree")) * F.col("id")).cast("long").alias("src"), F.col("id").alias("dst"))
    more = random_pairs(spark, n, max(0, n * average_degree // 2 - (n - 1)), seed + 1).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = tree.unionByName(more).distinct()
    of = vertices.select("id", "class", "batch")
    ends = pairs.join(of.toDF("src", "ca", "ba"), "src").join(of.toDF("dst", "cb", "bb"), "dst")
    u = draw(seed, "src", "dst", F.lit("weight"))
    w = F.when(F.col("ca") == F.col("cb"), 0.5 + u * 0.5).otherwise(0.01 + u * 0.49)
    edges = materialize(ends.select("src", "dst", w.cast("float").alias("w"), F.greatest("ba", "bb").alias("batch")), "arrival-edges")
    return ArrivalStream(edges, vertices, num_batches, n)
