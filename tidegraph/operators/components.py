"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.store import discard, measured


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every endpoint of ``edges`` (u, v); a component is named by its smallest id.

    Large-star then small-star in each round: every vertex hangs its larger neighbours, then its smaller ones, under the smallest vertex
    it sees. Rounds grow with the logarithm of the diameter; minima are aggregated before the shuffle, so a hub is no single group.
    The loop ends when a round changes no edge.
    """
    cur = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct()
    cur, n_edges, digest = _settle(cur)
    for _ in range(max_rounds):
        if n_edges == 0:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m0")).select(F.col("a").alias("x"), F.least("a", "m0").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
        small = large.join(low, F.col("a") == F.col("x"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("a"), F.col("m").alias("b")))
        nxt, n_next, digest_next = _settle(small.where("a <> b").distinct())
        same = (n_next, digest_next) == (n_edges, digest)
        discard(cur)
        cur, n_edges, digest = nxt, n_next, digest_next
        if same:
            break
    tops = cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)


def _settle(edges: DataFrame) -> tuple[DataFrame, int, int]:
    out, seen = measured(edges, "stars", F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
    return out, seen["n"], seen["h"] or 0
