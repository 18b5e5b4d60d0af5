"""Small helpers on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def swapped(edges: DataFrame) -> DataFrame:
    """The same rows with ``src`` and ``dst`` exchanged."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, self-loops once."""
    return edges.unionByName(swapped(edges.where("src <> dst")))
