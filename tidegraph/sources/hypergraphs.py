"""Readers and writers of hypergraphs: one hyperedge on a line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import FileFormat, InvalidArgument
from tidegraph.functions.ordinals import numbered
from tidegraph.hypergraph import HyperProperties, Hypergraph
from tidegraph.sources.graphs import draw
from tidegraph.sources.lines import lines, refuse, whole, write_lines
from tidegraph.store import materialize


@dataclass(frozen=True)
class HyperFile:
    hypergraph: Hypergraph
    external_ids: DataFrame  # (v, external)
    dropped_large: int
    dropped_duplicates: int


#: Two sets of options: every line as it is; or small hyperedges only, vertices by first appearance, drawn weights.
PRESETS = {"plain": {}, "hyperpaths": {"max_cardinality": 25, "relabel": "first_appearance", "random_weights": (1, 100, 20260725)}}


def read_hypergraph(
    spark: SparkSession, path: str, weighted: bool = False, index_base: int = 1, max_cardinality: int | None = None, dedupe_hyperedges: bool = False, relabel: str = "none",
    random_weights: tuple[int, int, int] | None = None, num_vertices: int | None = None, properties: HyperProperties | None = None,
) -> HyperFile:
    """``v1 v2 .. [; w]`` on a line, split by blanks and commas; lines that begin with ``#`` or ``%`` are comments.

    Options act in this order: ``max_cardinality`` drops larger hyperedges, ``dedupe_hyperedges`` keeps the first of each vertex set,
    ``relabel`` numbers vertices (``none``: the id minus ``index_base``; ``dense_sorted``; ``first_appearance``), ``random_weights`` (low,
    high, seed) draws a weight for each. Hyperedge i is the i-th line that is kept.
    """
    if relabel not in ("none", "dense_sorted", "first_appearance"):
        raise InvalidArgument(f"unknown numbering {relabel!r}")
    raw = materialize(lines(spark, path), "hypergraph")
    head = raw.where("line = 0").first()
    if head and (head.value.lower().startswith("%%matrixmarket") or head.value.startswith("%dgt")):
        raise FileFormat(f"{path}:1: a file of another format")
    rows = raw.where("substring(value, 1, 1) NOT IN ('#', '%')").withColumn("t", F.filter(F.split(F.split("value", ";")[0], r"[ \t\r,]+"), lambda x: x != ""))
    rows = rows.where(F.size("t") > 0).withColumn("w", whole(F.trim(F.get(F.split("value", ";"), F.lit(1))))).withColumn("m", F.transform("t", lambda x: whole(x)))
    bad = F.exists("m", lambda x: x.isNull()) | ((F.col("w").isNull() | (F.col("w") < 1)) if weighted else F.col("value").contains(";"))
    refuse(rows, bad, path, "not a hyperedge" + (" with its weight" if weighted else ""))
    rows = rows.select("line", F.array_sort(F.array_distinct("m")).alias("m"), F.col("w").cast("int").alias("w"))
    n = rows.count()
    if max_cardinality:
        rows = rows.where(F.size("m") <= max_cardinality)
    n_small = rows.count()
    if dedupe_hyperedges:
        rows = rows.groupBy("m").agg(F.min_by(F.struct("line", "w"), "line").alias("r")).select("m", "r.line", "r.w")
    rows = materialize(numbered(rows, ["line"], "h"), "hyperedges")
    inc = rows.select("h", F.posexplode("m").alias("i", "external"))
    if relabel == "none":
        inc = inc.withColumn("v", F.col("external") - index_base)
        table = inc.select("v", "external").distinct()
    else:
        first = inc.groupBy("external").agg(F.min(F.struct("h", "i")).alias("at"))
        table = materialize(numbered(first.select("external", F.col("at.h").alias("a"), F.col("at.i").alias("b")), ["external"] if relabel == "dense_sorted" else ["a", "b"], "v").select("v", "external"), "vertex-ids")
        inc = inc.join(table, "external")
    weights = rows.select("h", "w") if weighted else None
    if random_weights:
        low, high, seed = random_weights
        weights = rows.select("h", (low + F.floor(draw(seed, "h") * (high - low + 1))).cast("int").alias("w"))
    p = properties or HyperProperties(weighted=weights is not None)
    return HyperFile(Hypergraph.from_incidence(inc.select("h", "v"), weights, num_vertices, p), table, n - n_small, n_small - rows.count())


def write_hypergraph(h: Hypergraph, path: str, index_base: int = 1, single: bool = True) -> None:
    """Live hyperedges by id."""
    own = h.incidence.groupBy("h").agg(F.sort_array(F.collect_list(F.col("v") + index_base)).alias("m")).join(h.live().select("h", "w"), "h")
    text = F.concat_ws(" ", F.array_join(F.col("m").cast("array<string>"), " "), F.when(F.col("w").isNotNull(), F.concat(F.lit("; "), F.col("w").cast("string"))))
    write_lines(own.orderBy("h").select(text.alias("value")), path, single)


def from_simplices(sizes: DataFrame, members: DataFrame) -> DataFrame:
    """(h, v) of distinct vertex sets, the first occurrence kept, numbered densely. ``sizes``: (at, n) of simplices in order, ``members``:
    (at, v) of all their vertices in one sequence."""
    from tidegraph.functions.ordinals import running_sum

    start = running_sum(sizes, "at", "n", "start")
    own = start.where("n > 0").select("at", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("m"))
    sets = own.join(members.select(F.col("at").alias("m"), "v"), "m").groupBy("at").agg(F.array_sort(F.collect_set("v")).alias("s"))
    first = numbered(sets.groupBy("s").agg(F.min("at").alias("at")), ["at"], "h")
    return first.select("h", F.explode("s").alias("v"))
