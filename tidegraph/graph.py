"""Graphs that change in batches: vertices and edges as DataFrames, batch semantics, commits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument, OutOfRange, Unsupported
from tidegraph.functions.columns import both_ways, swapped
from tidegraph.store import counted, materialize, measured

ACTIVE, DELETED = 1, 2
MAX_INT = 2**31 - 1
SMALL_BATCH = 100_000  # a batch of at most so many rows leaves the edge table as it was written, less the pairs it names, plus what they are now;
MOST_PENDING = 4  # after so many of them the table is written anew


@dataclass(frozen=True)
class Semantics:
    """How a batch is read.

    By default deletions come first, each removing the first remaining (u, v) in row order; then insertions, each overwriting the
    weights of the first remaining (u, v) or, if there is none, appending an edge, so the last insertion of a pair wins. ``as_sets``:
    both lists are sets; deletions of missing and insertions of present edges drop out, but an edge that is deleted and inserted stays
    in both. ``net_effect``: vertices arrive and leave, and edges whose two ends are active afterwards are appended.
    """

    existing: str = "upsert"  # insertion of a present edge: upsert, ignore, error
    missing: str = "ignore"  # deletion of a missing edge: ignore, error
    loops: str = "keep"  # self-loops: keep, drop, error
    deletions_first: bool = True
    growth: bool = True
    as_sets: bool = False
    net_effect: bool = False

    @classmethod
    def upsert_last_wins(cls) -> Semantics:
        return cls()

    @classmethod
    def sets(cls) -> Semantics:
        return cls(existing="ignore", loops="drop", as_sets=True)

    @classmethod
    def arrivals(cls) -> Semantics:
        return cls(growth=False, net_effect=True)


@dataclass(frozen=True)
class Properties:
    """Fixed when a graph is built. ``parallel``: parallel edges are kept; else the last of a pair wins. An undirected graph holds both
    directions of every edge."""

    directed: bool = True
    parallel: bool = False
    float_weights: bool = False
    semantics: Semantics = field(default_factory=Semantics)

    def __post_init__(self):
        s = self.semantics
        for value, known in ((s.existing, ("upsert", "ignore", "error")), (s.missing, ("ignore", "error")), (s.loops, ("keep", "drop", "error"))):
            if value not in known:
                raise InvalidArgument(f"{value!r} is none of {known}")
        if s.as_sets and (s.existing == "upsert" or not s.deletions_first or self.parallel):
            raise Unsupported("batches as sets take neither upserts, insertions first, nor parallel edges")

    @classmethod
    def multi_objective(cls) -> Properties:
        """Directed, parallel edges in append order, upserts."""
        return cls(parallel=True)

    @classmethod
    def structural(cls) -> Properties:
        """Directed simple graph whose batches are sets."""
        return cls(semantics=Semantics.sets())


@dataclass(frozen=True)
class Summary:
    """What a commit did. Edges of undirected graphs count once for each direction."""

    inserted_edges: int = 0
    updated_edges: int = 0
    deleted_edges: int = 0
    ignored_deletions: int = 0
    dropped_self_loops: int = 0
    cancelled_pairs: int = 0
    inserted_vertices: int = 0
    deleted_vertices: int = 0
    num_vertices_after: int = 0
    ignored_insertions: int = 0
    dropped_insertions: int = 0
    relocated_rows: int = 0  # rows have no slots here
    compactions: int = 0


@dataclass(frozen=True)
class Commit:
    """A commit as results see it: both graphs, the rows of all pairs it names before and after, and the net lists of pairs."""

    before: Graph
    after: Graph
    old: DataFrame
    new: DataFrame
    removed: DataFrame
    added: DataFrame
    summary: Summary
    arrived: DataFrame | None = None
    left: DataFrame | None = None


def weight_names(k: int) -> list[str]:
    return [f"w{i}" for i in range(k)]


class EdgeBatch:
    """One batch: ``inserts`` (seq, src, dst, w0, ...), ``deletes`` (seq, src, dst), ``arrivals`` (seq, id, label -1, 0 or 1), ``departures`` (id)."""

    def __init__(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None, arrivals: DataFrame | None = None, departures: DataFrame | None = None):
        self.inserts, self.deletes, self.arrivals, self.departures = inserts, deletes, arrivals, departures

    @classmethod
    def of(cls, spark: SparkSession, insert: Iterable = (), delete: Iterable = (), insert_vertices: Iterable = (), delete_vertices: Iterable = (), float_weights: bool = False) -> EdgeBatch:
        """From Python lists: insertions (u, v, w0, ...), deletions (u, v), vertices (id, label) or ids, departing ids."""
        insert, delete = [tuple(x) for x in insert], [tuple(x) for x in delete]
        vertices = [(v, -1) if isinstance(v, int) else tuple(v) for v in insert_vertices]
        k = max((len(x) - 2 for x in insert), default=0)
        kind = "float" if float_weights else "int"
        return cls(
            spark.createDataFrame([(i, *x) for i, x in enumerate(insert)], "seq long, src long, dst long" + "".join(f", {w} {kind}" for w in weight_names(k))),
            spark.createDataFrame([(i, *x) for i, x in enumerate(delete)], "seq long, src long, dst long"),
            spark.createDataFrame([(i, *x) for i, x in enumerate(vertices)], "seq long, id long, label tinyint"),
            spark.createDataFrame([(x,) for x in delete_vertices], "id long"),
        )


class Graph:
    """A versioned graph. ``edges``: (src, dst, pos, w0, ..); ``pos`` orders the edges of a row. ``status``: (id, status, seed) of vertices
    that arrived, where batches bring vertices. A commit replaces references, so a batch that is refused changes nothing.
    """

    def __init__(self, edges: DataFrame, num_vertices: int, num_weights: int, properties: Properties, next_pos: int, version: int = 0, status: DataFrame | None = None, pending: int = 0):
        self.pending = pending  # commits since the edges were written as one table
        self.edges, self.num_vertices, self.num_weights, self.properties = edges, num_vertices, num_weights, properties
        self.next_pos, self.version, self.status = next_pos, version, status

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weights(self) -> list[str]:
        return weight_names(self.num_weights)

    # construction

    @classmethod
    def from_edges(
        cls, edges: DataFrame, num_vertices: int | None = None, properties: Properties = Properties(), weights: Iterable[str] | None = None, src: str = "src", dst: str = "dst", order: str | None = None,
    ) -> Graph:
        """From any DataFrame. ``weights``: its weight columns (default: w0, w1, ...); ``order``: the column that orders the input
        (default: as it is read), which decides the last of a pair and, with parallel edges, the first in a row."""
        weights = list(weights) if weights is not None else [c for c in edges.columns if c[:1] == "w" and c[1:].isdigit()]
        kind = "float" if properties.float_weights else "int"
        names = weight_names(len(weights))
        pos = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        rows = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), pos.alias("pos"), *[F.col(w).cast(kind).alias(n) for w, n in zip(weights, names)])
        if not properties.directed:
            rows = both_ways(rows)
        if not properties.parallel:
            rows = rows.groupBy("src", "dst").agg(F.max_by(F.struct("pos", *names), "pos").alias("r")).select("src", "dst", "r.*")
        rows, seen = measured(rows, "edges", F.max(F.greatest("src", "dst")).alias("top"), F.min(F.least("src", "dst")).alias("least"), F.max("pos").alias("pos"), *[F.count_if(~_weight_ok(w, properties.float_weights)).alias(f"bad_{w}") for w in names])
        if seen["least"] is not None and seen["least"] < 0:
            raise OutOfRange("a negative vertex id")
        if any(seen[f"bad_{w}"] for w in names):
            raise OutOfRange("a weight out of range")
        n = num_vertices if num_vertices is not None else (seen["top"] + 1 if seen["top"] is not None else 0)
        if seen["top"] is not None and seen["top"] >= n:
            raise OutOfRange(f"vertex {seen['top']} of {n}")
        return cls(rows, n, len(names), properties, (seen["pos"] or 0) + 1)

    @classmethod
    def from_csr(cls, spark: SparkSession, row_ptr: list[int], col_ind: list[int], weights: list[list[int]] | None = None, properties: Properties = Properties()) -> Graph:
        """From row offsets, neighbours and, for each objective, the weights in the edges' order."""
        if not row_ptr or row_ptr[0] != 0 or row_ptr[-1] != len(col_ind) or any(a > b for a, b in zip(row_ptr, row_ptr[1:])):
            raise InvalidArgument("row offsets don't rise from 0 to the number of edges")
        weights = weights or []
        rows = [(u, col_ind[e], e, *[w[e] for w in weights]) for u, (a, b) in enumerate(zip(row_ptr, row_ptr[1:])) for e in range(a, b)]
        kind = "float" if properties.float_weights else "int"
        df = spark.createDataFrame(rows, "src long, dst long, at long" + "".join(f", {w} {kind}" for w in weight_names(len(weights))))
        return cls.from_edges(df, len(row_ptr) - 1, properties, order="at")

    @classmethod
    def with_capacity(cls, spark: SparkSession, num_vertices: int, weights: int = 1) -> Graph:
        """No edges and no vertex has arrived; batches bring both."""
        props = Properties(directed=False, parallel=True, float_weights=True, semantics=Semantics.arrivals())
        edges = spark.createDataFrame([], "src long, dst long, pos long" + "".join(f", {w} float" for w in weight_names(weights)))
        return cls(edges, num_vertices, weights, props, 0, status=spark.createDataFrame([], "id long, status int, seed tinyint"))

    # views

    def arcs(self, objective: int | None = 0) -> DataFrame:
        """(src, dst, w): the cheapest of parallel edges; weight 1 with ``objective`` None."""
        if objective is None:
            return self.edges.select("src", "dst").distinct().withColumn("w", F.lit(1)) if self.properties.parallel else self.edges.select("src", "dst", F.lit(1).alias("w"))
        if not 0 <= objective < self.num_weights:
            raise InvalidArgument(f"objective {objective} of {self.num_weights}")
        w = F.col(f"w{objective}")
        return self.edges.groupBy("src", "dst").agg(F.min(w).alias("w")) if self.properties.parallel else self.edges.select("src", "dst", w.alias("w"))

    def transpose(self) -> DataFrame:
        """In-edges: the same table with the roles of its columns exchanged."""
        return swapped(self.edges)

    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_vertices).select("id")

    def active(self) -> DataFrame:
        """Ids of active vertices; all, where vertices don't arrive in batches."""
        return self.vertices() if self.status is None else self.status.where(F.col("status") == ACTIVE).select("id")

    def num_active(self) -> int:
        return self.num_vertices if self.status is None else self.active().count()

    def live_edges(self) -> DataFrame:
        """Edges between active vertices."""
        if self.status is None:
            return self.edges
        on = self.active()
        return self.edges.join(on.withColumnRenamed("id", "src"), "src", "left_semi").join(on.withColumnRenamed("id", "dst"), "dst", "left_semi").select(self.edges.columns)

    def rows(self) -> DataFrame:
        """(id, edges): each vertex's neighbours in row order, as an array of structs; vertices without edges have an empty one."""
        key = ["pos"] if self.properties.parallel else ["dst", "pos"]
        own = self.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)], "dst", *self.weights))).alias("edges"))
        return self.vertices().join(own, F.col("id") == F.col("src"), "left").select("id", F.coalesce(F.transform("edges", lambda e: F.struct(e.dst.alias("dst"), *[e[w].alias(w) for w in self.weights])), F.array()).alias("edges"))

    def csr(self) -> tuple[DataFrame, DataFrame]:
        """(id, row_ptr) with id = num_vertices at the end, and (e, dst, w0, ..) in row order."""
        from tidegraph.functions.ordinals import numbered, running_sum

        degree = self.vertices().join(self.edges.groupBy("src").count(), F.col("id") == F.col("src"), "left").select("id", F.coalesce("count", F.lit(0)).alias("n"))
        ptr = running_sum(degree, "id", "n", "row_ptr").select("id", "row_ptr")
        end = self.edges.agg(F.lit(self.num_vertices).cast("long").alias("id"), F.count(F.lit(1)).alias("row_ptr"))
        order = ["src", "pos"] if self.properties.parallel else ["src", "dst", "pos"]
        return ptr.unionByName(end), numbered(self.edges, order, "e").select("e", "dst", *self.weights)

    def clone(self) -> Graph:
        """Tables never change, so a clone shares them."""
        return Graph(self.edges, self.num_vertices, self.num_weights, self.properties, self.next_pos, self.version, self.status, self.pending)

    def check(self) -> None:
        """Raise if an invariant doesn't hold."""
        bad = F.lit(False)
        for w in self.weights:
            bad |= ~_weight_ok(w, self.properties.float_weights)
        seen = self.edges.agg(F.count_if((F.col("src") < 0) | (F.col("dst") < 0) | (F.greatest("src", "dst") >= self.num_vertices)).alias("ids"), F.count_if(bad).alias("weights")).first()
        if seen.ids or seen.weights:
            raise InvalidArgument(f"{seen.ids} edges with ids and {seen.weights} with weights out of range")
        if not self.properties.parallel and self.edges.groupBy("src", "dst").count().where("count > 1").head(1):
            raise InvalidArgument("parallel edges in a simple graph")
        if not self.properties.directed:
            back = self.edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
            if self.edges.join(back, ["src", "dst"], "left_anti").head(1):
                raise InvalidArgument("an edge without its reverse in an undirected graph")

    # commits

    def commit(self, batch: EdgeBatch) -> Commit:
        """What ``batch`` makes of this graph; the graph itself stays as it is."""
        if self.properties.semantics.net_effect:
            return self._arrivals(batch)
        if batch.arrivals is not None and batch.arrivals.head(1) or batch.departures is not None and batch.departures.head(1):
            raise Unsupported("vertices arrive and leave only under net-effect semantics")
        s = self.properties.semantics
        ins, dels = self._lists(batch)
        ins, dels, loops = self._loops(ins, dels)
        if not self.properties.directed:
            ins, dels = (both_ways(x) for x in (ins, dels))
        ins, of_ins = measured(ins, "inserts", *self._facts(ins))
        dels, of_dels = measured(dels, "deletes", *self._facts(dels))
        n = self._validated(of_ins, of_dels)
        pairs = materialize(ins.select("src", "dst").union(dels.select("src", "dst")).distinct(), "pairs")
        old, n_old = counted(self.edges.join(pairs, ["src", "dst"], "left_semi"), "touched")
        rest = self.edges.join(pairs, ["src", "dst"], "left_anti")
        sizes = of_ins["n"], of_dels["n"], n_old, (of_ins["last"] or 0) + 1 if of_ins["n"] else 0
        new, counts, removed, added = (self._as_sets if s.as_sets else self._in_order)(old, ins, dels, *sizes)
        edges, pending = rest.unionByName(new), self.pending + 1
        if of_ins["n"] + of_dels["n"] > SMALL_BATCH or pending > MOST_PENDING:
            edges, pending = materialize(edges, "edges"), 0
        after = Graph(edges, n, self.num_weights, self.properties, self.next_pos + counts.pop("used"), self.version + 1, self.status, pending)
        summary = Summary(dropped_self_loops=loops, inserted_vertices=n - self.num_vertices, num_vertices_after=n, **counts)
        return Commit(self.clone(), after, old, new, removed, added, summary)

    def adopt(self, done: Commit) -> None:
        """Become the graph after a commit of this version."""
        if done.before.version != self.version:
            raise InvalidArgument("the commit is of another version")
        a = done.after
        self.edges, self.num_vertices, self.next_pos, self.version, self.status, self.pending = a.edges, a.num_vertices, a.next_pos, a.version, a.status, a.pending

    def apply(self, batch: EdgeBatch) -> Summary:
        done = self.commit(batch)
        self.adopt(done)
        return done.summary

    def _lists(self, batch: EdgeBatch) -> tuple[DataFrame, DataFrame]:
        kind = "float" if self.properties.float_weights else "int"
        empty = self.spark.createDataFrame([], "seq long, src long, dst long" + "".join(f", {w} {kind}" for w in self.weights))
        ins, dels = batch.inserts, batch.deletes
        if ins is None or len([c for c in ins.columns if c not in ("seq", "src", "dst")]) < self.num_weights:
            if ins is not None and ins.head(1):
                raise InvalidArgument(f"insertions need {self.num_weights} weights")
            ins = empty
        names = ["seq", "src", "dst"]
        ins = ins.select(*[F.col(c).cast("long").alias(c) for c in names], *[F.col(w).cast("float" if self.properties.float_weights else "long").alias(w) for w in self.weights])
        dels = (empty if dels is None else dels).select(*[F.col(c).cast("long").alias(c) for c in names])
        return ins, dels

    def _loops(self, ins: DataFrame, dels: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        how = self.properties.semantics.loops
        if how == "keep":
            return ins, dels, 0
        loops = ins.where("src = dst").count() + dels.where("src = dst").count()
        if loops and how == "error":
            raise InvalidArgument(f"{loops} self-loops in the batch")
        return ins.where("src <> dst"), dels.where("src <> dst"), loops

    def _facts(self, rows: DataFrame) -> list[Column]:
        """What is asked of a list of a batch: its size, last position, ids and weights."""
        bad = F.lit(False)
        for w in self.weights:
            bad |= ~_weight_ok(w, self.properties.float_weights) if w in rows.columns else F.lit(False)
        return [
            F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.min(F.least("src", "dst")).alias("least"), F.max(F.greatest("src", "dst")).alias("top"),
            F.count_if(bad).alias("bad"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls"),
        ]

    def _validated(self, ins: dict, dels: dict) -> int:
        """The number of vertices after the batch, or an error before anything has changed."""
        if ins["nulls"] or dels["nulls"]:
            raise InvalidArgument("a null vertex id")
        if min(x["least"] if x["least"] is not None else 0 for x in (ins, dels)) < 0:
            raise OutOfRange("a negative vertex id")
        if ins["bad"]:
            raise OutOfRange(f"{ins['bad']} weights out of range")
        top = ins["top"] if ins["top"] is not None else -1
        if top >= self.num_vertices and not self.properties.semantics.growth:
            raise OutOfRange(f"vertex {top} of {self.num_vertices}")
        return max(self.num_vertices, top + 1)

    def _in_order(self, old: DataFrame, ins: DataFrame, dels: DataFrame, n_ins: int, n_dels: int, n_old: int, used: int):
        """Deletions and insertions in order, on the rows of the pairs they name."""
        s = self.properties.semantics

        def delete(rows: DataFrame) -> DataFrame:
            gone = dels.groupBy(F.col("src").alias("s"), F.col("dst").alias("t")).agg(F.count(F.lit(1)).alias("n"))
            nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("pos"))
            return rows.withColumn("nth", nth).join(gone, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("t")), "left").where(F.col("nth") > F.coalesce("n", F.lit(0))).select(rows.columns)

        def insert(rows: DataFrame) -> DataFrame:
            w = F.struct(*self.weights) if self.weights else F.struct(F.lit(0).alias("none"))
            new = ins.groupBy(F.col("src").alias("s"), F.col("dst").alias("t")).agg((F.min_by if s.existing == "ignore" else F.max_by)(w, "seq").alias("new"), F.min("seq").alias("seq"))
            on = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("t"))
            first = F.min("pos").over(Window.partitionBy("src", "dst"))
            over = F.col("new").isNotNull() & (F.col("pos") == F.col("first")) & F.lit(s.existing == "upsert")
            kept = rows.withColumn("first", first).join(new, on, "left").select("src", "dst", "pos", *[F.when(over, F.col(f"new.{x}")).otherwise(F.col(x)).cast(rows.schema[x].dataType).alias(x) for x in self.weights])
            more = new.join(rows.select(F.col("src").alias("s"), F.col("dst").alias("t")).distinct(), ["s", "t"], "left_anti")
            return kept.unionByName(more.select(F.col("s").alias("src"), F.col("t").alias("dst"), (F.col("seq") + self.next_pos).alias("pos"), *[F.col(f"new.{x}").cast(rows.schema[x].dataType).alias(x) for x in self.weights]))

        if s.deletions_first:
            mid, n_mid = counted(delete(old), "touched")
            new, n_new = counted(insert(mid), "touched")
            deleted, inserted = n_old - n_mid, n_new - n_mid
        else:
            mid, n_mid = counted(insert(old), "touched")
            new, n_new = counted(delete(mid), "touched")
            inserted, deleted = n_mid - n_old, n_mid - n_new
        if s.missing == "error" and deleted < n_dels:
            raise InvalidArgument(f"{n_dels - deleted} deletions of missing edges")
        if s.existing == "error" and inserted < n_ins:
            raise InvalidArgument(f"{n_ins - inserted} insertions of present edges")
        kept = n_ins - inserted
        counts = {"inserted_edges": inserted, "deleted_edges": deleted, "ignored_deletions": n_dels - deleted, "updated_edges": kept * (s.existing == "upsert"), "ignored_insertions": kept * (s.existing != "upsert"), "used": used}
        was, now = old.select("src", "dst").distinct(), new.select("src", "dst").distinct()
        return new, counts, was.join(now, ["src", "dst"], "left_anti"), now.join(was, ["src", "dst"], "left_anti")

    def _as_sets(self, old: DataFrame, ins: DataFrame, dels: DataFrame, n_ins: int, n_dels: int, n_old: int, used: int):
        """(E minus Del) plus Ins, and the net lists; a pair that is deleted and inserted stays in both."""
        s = self.properties.semantics
        w = F.struct("seq", *self.weights)
        once = ins.groupBy("src", "dst").agg(F.min_by(w, "seq").alias("r")).select("src", "dst", "r.*")
        want = dels.select("src", "dst").distinct()
        was = old.select("src", "dst")
        removed, n_removed = counted(want.join(was, ["src", "dst"], "left_semi"), "removed")
        stays = was.join(removed, ["src", "dst"], "left_anti")
        added, n_added = counted(once.join(stays, ["src", "dst"], "left_anti"), "added")
        missing, present = want.count() - n_removed, once.count() - n_added
        if s.missing == "error" and missing:
            raise InvalidArgument(f"{missing} deletions of missing edges")
        if s.existing == "error" and present:
            raise InvalidArgument(f"{present} insertions of present edges")
        plus = added.select("src", "dst", (F.col("seq") + self.next_pos).alias("pos"), *[F.col(x).cast(old.schema[x].dataType).alias(x) for x in self.weights])
        new = materialize(old.join(removed, ["src", "dst"], "left_anti").select(old.columns).unionByName(plus), "touched")
        cancelled = added.join(removed, ["src", "dst"], "left_semi").count()
        counts = {"inserted_edges": n_added, "deleted_edges": n_removed, "ignored_deletions": missing, "ignored_insertions": present, "cancelled_pairs": cancelled, "used": used}
        return new, counts, removed, added.select("src", "dst")

    def _arrivals(self, batch: EdgeBatch) -> Commit:
        """The net effect: arrivals that don't depart at once, departures, and edges whose ends are both active afterwards."""
        spark = self.spark
        if batch.deletes is not None and batch.deletes.head(1):
            raise Unsupported("edges leave with their vertices only")
        status = self.status if self.status is not None else self.vertices().select("id", F.lit(ACTIVE).alias("status"), F.lit(-1).cast("tinyint").alias("seed"))
        come = batch.arrivals if batch.arrivals is not None else spark.createDataFrame([], "seq long, id long, label tinyint")
        gone = (batch.departures if batch.departures is not None else spark.createDataFrame([], "id long")).select(F.col("id").cast("long")).distinct()
        come, gone = materialize(come.select("seq", F.col("id").cast("long"), F.coalesce("label", F.lit(-1)).cast("tinyint").alias("label")), "arrivals"), materialize(gone, "departures")
        seen = come.agg(F.min("id").alias("least"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(~F.col("label").isin(-1, 0, 1)).alias("labels")).first()
        out = gone.agg(F.min("id").alias("least"), F.max("id").alias("top")).first()
        if min(seen.least or 0, out.least or 0) < 0 or max(seen.top if seen.top is not None else -1, out.top if out.top is not None else -1) >= self.num_vertices:
            raise OutOfRange("a vertex id out of range")
        if seen.n != seen.distinct or seen.labels:
            raise InvalidArgument("a vertex that arrives twice, or a label that is none of -1, 0, 1")
        if come.join(status, "id", "left_semi").head(1):
            raise InvalidArgument("a vertex id that was used before")
        ins, of_ins = measured(self._lists(batch)[0], "inserts", *self._facts(self._lists(batch)[0]))
        self._validated(of_ins, {"nulls": 0, "least": 0})
        arrived, n_arrived = counted(come.join(gone, "id", "left_anti"), "arrived")
        left, n_left = counted(gone.join(status.where(F.col("status") == ACTIVE), "id", "left_semi"), "left")
        stays = status.join(gone, "id", "left_anti")
        retired = gone.join(status.select("id", "seed"), "id", "left").join(come.select("id", "label"), "id", "left")
        retired = retired.select("id", F.lit(DELETED).alias("status"), F.coalesce("seed", "label", F.lit(-1)).cast("tinyint").alias("seed"))
        new_status = materialize(stays.unionByName(retired).unionByName(arrived.select("id", F.lit(ACTIVE).alias("status"), F.col("label").alias("seed"))), "status")
        active = new_status.where(F.col("status") == ACTIVE).select("id")
        kept = ins.join(active.withColumnRenamed("id", "src"), "src", "left_semi").join(active.withColumnRenamed("id", "dst"), "dst", "left_semi")
        rows = kept.select("src", "dst", (F.col("seq") + self.next_pos).alias("pos"), *self.weights)
        once = F.coalesce(F.sum((F.col("src") <= F.col("dst")).cast("long")), F.lit(0)).alias("once")  # both directions are there, loops once
        rows, seen_rows = measured(both_ways(rows), "appended", once)
        n_in, n_kept = of_ins["n"], seen_rows["once"]
        used = (of_ins["last"] or 0) + 1 if n_in else 0
        after = Graph(materialize(self.edges.unionByName(rows), "edges"), self.num_vertices, self.num_weights, self.properties, self.next_pos + used, self.version + 1, new_status)
        summary = Summary(inserted_edges=n_kept, dropped_insertions=n_in - n_kept, inserted_vertices=n_arrived, deleted_vertices=n_left, num_vertices_after=self.num_vertices)
        none = rows.limit(0)
        return Commit(self.clone(), after, none, rows, none.select("src", "dst"), rows.select("src", "dst").distinct(), summary, arrived, left)


def _weight_ok(w: str, is_float: bool):
    col = F.col(w)
    good = (col > 0) & (col <= 1) if is_float else (col >= 1) & (col <= MAX_INT)
    return F.coalesce(good, F.lit(False))


def undirected(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v, of (src, dst)."""
    return pairs.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def with_semantics(p: Properties, s: Semantics) -> Properties:
    return replace(p, semantics=s)
