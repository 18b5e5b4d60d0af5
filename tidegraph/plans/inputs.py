"""Graphs, hypergraphs and batches derived from the order tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.graph import EdgeBatch, Graph, Properties, undirected
from tidegraph.hypergraph import HyperBatch, HyperProperties, Hypergraph
from tidegraph.store import materialize

INFINITE_SQL = "2305843009213693951"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w0, w1, w2, k): parts on consecutive lines of an order; the least quantity, discount and tax, and the first order."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").cast("long").alias("q"), F.floor(F.col("l_discount") * 100 + 0.5).alias("d"), F.floor(F.col("l_tax") * 100 + 0.5).alias("t"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").groupBy("src", "dst")
    return pairs.agg(F.min("q").cast("int").alias("w0"), (1 + F.min("d")).cast("int").alias("w1"), (1 + F.min("t")).cast("int").alias("w2"), F.min("l_orderkey").alias("k"))


EDGES = """
e AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(min(CAST(a.l_quantity AS BIGINT)) AS BIGINT) AS w0,
         CAST(1 + min(floor(a.l_discount * 100 + 0.5)) AS BIGINT) AS w1, CAST(1 + min(floor(a.l_tax * 100 + 0.5)) AS BIGINT) AS w2, min(a.l_orderkey) AS k
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
n AS (SELECT max(p_partkey) AS top FROM part)"""

#: The graph before and after the batch: residue 9 of k arrives, 0 goes, 5 grows by 3, 6 shrinks by 1.
WHOLE = "g AS (SELECT * FROM e)"
AFTER = """g AS (
  SELECT src, dst, CASE k % 10 WHEN 5 THEN w0 + 3 WHEN 6 THEN greatest(w0 - 1, 1) ELSE w0 END AS w0,
         CASE k % 10 WHEN 5 THEN w1 + 3 WHEN 6 THEN greatest(w1 - 1, 1) ELSE w1 END AS w1,
         CASE k % 10 WHEN 5 THEN w2 + 3 WHEN 6 THEN greatest(w2 - 1, 1) ELSE w2 END AS w2 FROM e WHERE k % 10 <> 0)"""


def num_parts(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(part_edges(spark, sf_dir), "part-edges")


def part_graph(spark: SparkSession, sf_dir: str, weights: int = 1, where: str = "true", properties: Properties = Properties()) -> tuple[Graph, DataFrame]:
    """The graph of the edges that fulfil ``where``, and all edges."""
    edges = _edges(spark, sf_dir)
    names = [f"w{i}" for i in range(weights)]
    return Graph.from_edges(edges.where(where).select("src", "dst", "k", *names), num_parts(spark, sf_dir), properties, names, order="k"), edges


def reweighting(edges: DataFrame, weights: int = 1) -> EdgeBatch:
    """Residue 0 goes, 9 arrives, 5 and 6 change their weights; a missing edge and a self-loop's deletion are named as well."""
    names = [f"w{i}" for i in range(weights)]
    r = F.col("k") % 10
    new = [F.when(r == 5, F.col(w) + 3).when(r == 6, F.greatest(F.col(w) - 1, F.lit(1))).otherwise(F.col(w)).cast("int").alias(w) for w in names]
    inserts = edges.where(r.isin(5, 6, 9)).select(F.col("k").alias("seq"), "src", "dst", *new)
    deletes = edges.where(r == 0).select(F.col("k").alias("seq"), "src", "dst")
    odd = edges.sparkSession.createDataFrame([(0, 0, 10**12), (1, 0, 0)], "seq long, src long, dst long")
    return EdgeBatch(inserts, deletes.unionByName(odd))


def structural(edges: DataFrame) -> EdgeBatch:
    """Residue 0 goes, 9 arrives, and what is also there: 1 arrives again, 2 goes and comes back, a self-loop."""
    r = F.col("k") % 10
    inserts = edges.where(r.isin(1, 2, 9)).select(F.col("k").alias("seq"), "src", "dst")
    loop = edges.sparkSession.createDataFrame([(0, 1, 1)], "seq long, src long, dst long")
    return EdgeBatch(inserts.unionByName(loop), edges.where(r.isin(0, 2, 9)).select(F.col("k").alias("seq"), "src", "dst"))


def part_pairs(edges: DataFrame) -> DataFrame:
    """(u, v, k): parts next to each other either way."""
    return edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("k").alias("k"))


PAIRS = "p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(k) AS k FROM e GROUP BY 1, 2)"


def incidences(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(h, v): orders (that fulfil ``where``) as hyperedges of their parts."""
    return table(spark, sf_dir, "lineitem").where(where).select(F.col("l_orderkey").alias("h"), F.col("l_partkey").alias("v")).distinct()


def weights_of(incidence: DataFrame) -> DataFrame:
    return incidence.select("h").distinct().withColumn("w", (1 + F.col("h") * 7919 % 97).cast("int"))


def order_hypergraph(spark: SparkSession, sf_dir: str, reuse: str = "erase_first") -> Hypergraph:
    inc = materialize(incidences(spark, sf_dir), "incidences")
    return Hypergraph.from_incidence(inc, weights_of(inc), num_parts(spark, sf_dir), HyperProperties(reuse=reuse, weighted=True))


def order_batch(spark: SparkSession, sf_dir: str, h: Hypergraph) -> HyperBatch:
    """Every hundredth hyperedge goes, others lose their smallest member or gain the one after it, and the orders 1, 51, 101, ...
    arrive once more, as new hyperedges."""
    ends = h.incidence.groupBy("h").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    new = incidences(spark, sf_dir, "l_orderkey % 50 = 1").groupBy("h").agg(F.sort_array(F.collect_list("v")).alias("members"))
    top = h.num_vertices
    return HyperBatch(
        h.live().where("h % 100 = 0").select(F.col("h").alias("seq"), "h"), ends.where("h % 100 = 20 AND n > 1").select(F.col("h").alias("seq"), "h", "v"),
        ends.where(f"h % 100 = 30 AND v + 1 < {top}").select(F.col("h").alias("seq"), "h", (F.col("v") + 1).alias("v")),
        new.select(F.col("h").alias("seq"), "members", (1 + F.col("h") * 7919 % 97).cast("int").alias("w")),
    )


HYPER_BEFORE = """
i0 AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS v FROM lineitem),
nv AS (SELECT max(p_partkey) + 1 AS nv FROM part)"""

HYPER_AFTER = HYPER_BEFORE + """,
ends AS (SELECT h, min(v) AS v, count(*) AS n FROM i0 GROUP BY h),
i1 AS (
  SELECT i0.h, i0.v FROM i0 JOIN ends USING (h) WHERE h % 100 <> 0 AND NOT (h % 100 = 20 AND n > 1 AND i0.v = ends.v)
  UNION SELECT h, v + 1 FROM ends, nv WHERE h % 100 = 30 AND v + 1 < nv.nv
  UNION SELECT DISTINCT 1000000000000 + l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 50 = 1),
changed AS (
  SELECT DISTINCT h FROM (SELECT h FROM i0 WHERE h % 100 = 0 UNION ALL SELECT h FROM ends WHERE h % 100 = 20 AND n > 1
  UNION ALL SELECT e.h FROM ends e, nv WHERE e.h % 100 = 30 AND e.v + 1 < nv.nv AND NOT EXISTS (SELECT 1 FROM i0 WHERE i0.h = e.h AND i0.v = e.v + 1)))"""


def pair_graph(edges: DataFrame, n: int, properties: Properties) -> Graph:
    return Graph.from_edges(part_pairs(edges).select(F.col("u").alias("src"), F.col("v").alias("dst"), "k"), n, properties, [], order="k")


def similarity(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    from tidegraph.operators.knn import knn_graph

    return knn_graph(table(spark, sf_dir, "embeddings"), k, id_col="vec_id", vector_col="embedding")


__all__ = [n for n in dir() if not n.startswith("_")] + ["undirected"]
