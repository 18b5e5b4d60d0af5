"""Batches from a stream of operations: each micro-batch is one commit, and all results follow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.errors import Internal
from tidegraph.graph import EdgeBatch, Graph
from tidegraph.hypergraph import HyperBatch, Hypergraph
from tidegraph.store import materialize
from tidegraph.update import Result, Stats, update

GRAPH_OPERATIONS = "seq long, op string, src long, dst long, w array<double>, label tinyint"
HYPER_OPERATIONS = "seq long, op string, h long, v long, members array<long>, w int"


def graph_batch(ops: DataFrame, num_weights: int, float_weights: bool = False) -> EdgeBatch:
    """A batch from rows (seq, op, src, dst, w, label) with op ``+e``, ``-e``, ``+v`` (src) or ``-v`` (src)."""
    kind = "float" if float_weights else "int"
    w = [F.get("w", F.lit(i)).cast(kind).alias(f"w{i}") for i in range(num_weights)]
    of = lambda op: ops.where(F.col("op") == op)
    return EdgeBatch(
        of("+e").select("seq", "src", "dst", *w), of("-e").select("seq", "src", "dst"),
        of("+v").select("seq", F.col("src").alias("id"), F.coalesce("label", F.lit(-1)).cast("tinyint").alias("label")), of("-v").select(F.col("src").alias("id")),
    )


def hyper_batch(ops: DataFrame) -> HyperBatch:
    of = lambda op: ops.where(F.col("op") == op)
    return HyperBatch(of("-h").select("seq", "h"), of("-i").select("seq", "h", "v"), of("+i").select("seq", "h", "v"), of("+h").select("seq", "members", "w"))


class Runner:
    """Applies micro-batches to a container and its results.

    A micro-batch's number is the container's version less the first one, so a batch that is delivered again after a restart is known and
    skipped, and one out of turn is an error. ``sink`` gets (number, results, stats) after each commit.
    """

    def __init__(self, container: Graph | Hypergraph, *results: Result, sink: Callable[[int, tuple, list[Stats]], None] | None = None):
        self.container, self.results, self.sink, self.first = container, results, sink, container.version
        self.stats: list[list[Stats]] = []

    def apply(self, ops: DataFrame, number: int) -> None:
        done = self.container.version - self.first
        if number < done:
            return
        if number > done:
            raise Internal(f"micro-batch {number} after {done} commits")
        ops = materialize(ops, "micro-batch")
        if isinstance(self.container, Graph):
            batch = graph_batch(ops, self.container.num_weights, self.container.properties.float_weights)
        else:
            batch = hyper_batch(ops)
        stats = update(self.container, batch, *self.results)
        self.stats.append(stats)
        if self.sink:
            self.sink(number, self.results, stats)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Run on a streaming frame of operations."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def operation_log(spark, folder: str, schema: str = GRAPH_OPERATIONS) -> DataFrame:
    """A stream of the parquet files in ``folder``, one file to a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed_batches(stream: DataFrame, time_col: str, width: str, lateness: str) -> DataFrame:
    """Operations with event times, each marked with the start of its window; later ones than ``lateness`` are left to the watermark."""
    return stream.withWatermark(time_col, lateness).withColumn("window_start", F.window(time_col, width).start)
