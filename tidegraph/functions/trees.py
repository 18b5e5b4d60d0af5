"""Checks and folds of parent trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument
from tidegraph.fixpoint import NONE, subtree


def check_tree(state: DataFrame, arcs: DataFrame, source: int) -> None:
    """Raise unless (id, distance, parent) is a shortest-path tree from ``source``: one row for each node, the source alone a root at 0,
    parents at exactly an arc's distance, no arc that would shorten or reach a node, no cycle of parents."""
    seen = state.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("parent") == NONE).alias("roots"), F.count_if((F.col("id") == source) & (F.col("parent") == NONE) & (F.col("distance") == 0)).alias("source")).first()
    if seen.n != seen.ids or seen.roots != 1 or seen.source != 1:
        raise InvalidArgument("not one row for each vertex, or another root than the source")
    near = arcs.join(state.select(F.col("id").alias("src"), F.col("distance").alias("a")), "src").join(state.select(F.col("id").alias("dst"), F.col("distance").alias("b"), "parent"), "dst", "left")
    bad = near.where("b IS NULL OR a + w < b").head(1)
    tight = near.where("src = parent AND a + w = b").select("dst").distinct().count()
    if bad or tight != seen.n - 1:
        raise InvalidArgument("distances or parents that the edges don't bear out")
    if subtree(state, state.where(F.col("parent") == NONE).select("id")).count() != seen.n:
        raise InvalidArgument("a cycle of parents")


def path_sums(state: DataFrame, steps: DataFrame, names: list[str]) -> DataFrame:
    """(id, names): sums of the steps (id, names) from the root down to each node, by pointer doubling in log-depth rounds."""
    from tidegraph.store import discard, measured

    cur = state.select("id", F.col("parent").alias("up")).join(steps, "id", "left").select("id", "up", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    open_ = F.coalesce(F.sum((F.col("up") != NONE).cast("long")), F.lit(0)).alias("n")
    cur, seen = measured(cur, "sums", open_)
    while seen["n"]:
        above = cur.select(F.col("id").alias("a"), F.col("up").alias("a_up"), *[F.col(n).alias(f"a_{n}") for n in names])
        step = cur.join(above, F.col("up") == F.col("a"), "left")
        nxt, seen = measured(step.select("id", F.coalesce("a_up", F.lit(NONE)).cast("long").alias("up"), *[(F.col(n) + F.coalesce(f"a_{n}", F.lit(0))).alias(n) for n in names]), "sums", open_)
        discard(cur)
        cur = nxt
    return cur.drop("up")
