"""Batches of graphs and hypergraphs as text, one operation on a line.

``%batch <id>`` begins a batch; ids rise. Graphs: ``+e u v w..``, ``-e u v``, ``+v u [label]``, ``-v u``. Hypergraphs: ``+h v.. [; w]``,
``-h id``, ``+i h v``, ``-i h v``. The first line may be ``%dgt 1 [graph|hypergraph]``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import FileFormat, InvalidArgument
from tidegraph.graph import EdgeBatch, weight_names
from tidegraph.hypergraph import HyperBatch
from tidegraph.sources.lines import lines, refuse, tokens, whole, write_lines
from tidegraph.store import materialize

GRAPH_OPS, HYPER_OPS = ("+e", "-e", "+v", "-v"), ("+h", "-h", "+i", "-i")


def operations(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(batch, seq, op, t, value, line): operations with their tokens. ``seq`` is the line, so each list keeps the file's order."""
    rows = tokens(lines(spark, path)).where(~F.col("t")[0].startswith("#"))
    rows = materialize(rows, "operations")
    head = rows.orderBy("line").first()
    if head is not None and head.t[0] == "%dgt":
        if len(head.t) < 2 or head.t[1] != "1" or len(head.t) > 3:
            raise FileFormat(f"{path}:1: only version 1 is known")
        if len(head.t) == 3 and head.t[2] != kind:
            raise FileFormat(f"{path}:1: batches of a {head.t[2]}, not of a {kind}")
        rows = rows.where(F.col("line") > head.line)
    marks = rows.where(F.col("t")[0] == "%batch").select("line", "value", whole(F.get("t", F.lit(1))).alias("id"))
    marks = materialize(marks, "marks")  # one row for each batch
    refuse(marks, F.col("id").isNull() | (F.col("id") < 0), path, "not a batch's number")
    ops = rows.where(F.col("t")[0] != "%batch")
    known, other = (GRAPH_OPS, HYPER_OPS) if kind == "graph" else (HYPER_OPS, GRAPH_OPS)
    refuse(ops, ~F.col("t")[0].isin(*known), path, f"not an operation on a {kind}")
    found = sorted((r.line, r.id) for r in marks.collect())  # the driver applies batches one by one, so it holds their numbers
    if any(a >= b for (_, a), (_, b) in zip(found, found[1:])):
        raise FileFormat(f"{path}: the numbers of batches don't rise")
    if found:
        at, ids = F.array(*[F.lit(line) for line, _ in found]), F.array(*[F.lit(i) for _, i in found])
        out = ops.withColumn("batch", F.get(ids, F.size(F.filter(at, lambda x: x < F.col("line"))) - 1))
        refuse(out, F.col("batch").isNull(), path, "an operation before the first batch")
    else:
        out = ops.withColumn("batch", F.lit(0).cast("long"))
    return materialize(out.select("batch", F.col("line").alias("seq"), F.col("t")[0].alias("op"), "t", "value", "line"), "operations")


def read_batches(spark: SparkSession, path: str, num_weights: int = -1, float_weights: bool = False) -> list[tuple[int, EdgeBatch]]:
    """(id, batch) of a graph's batches; ``num_weights`` -1: as many as the first insertion has."""
    ops = operations(spark, path, "graph")
    if num_weights < 0:
        first = ops.where("op = '+e'").orderBy("seq").first()
        num_weights = len(first.t) - 3 if first else 0
    names = weight_names(num_weights)
    token = lambda i: F.get("t", F.lit(i))
    w = [(token(3 + i).try_cast("float") if float_weights else whole(token(3 + i))).alias(n) for i, n in enumerate(names)]
    id1, id2 = whole(token(1)), whole(token(2))
    is_edge = F.col("op").isin("+e", "-e")
    bad = id1.isNull() | (id1 < 0) | F.when(is_edge, id2.isNull() | (id2 < 0)).otherwise(F.lit(False))
    for x in w:
        bad |= F.when(F.col("op") == "+e", x.isNull()).otherwise(F.lit(False))
    size = F.when(F.col("op") == "+e", F.size("t") != 3 + num_weights).when(F.col("op") == "-e", F.size("t") != 3).when(F.col("op") == "-v", F.size("t") != 2)
    label = F.when(F.size("t") == 2, F.lit(-1)).otherwise(whole(token(2)))
    size = size.otherwise((F.size("t") > 3) | label.isNull() | ~label.isin(-1, 0, 1))
    refuse(ops, bad | size, path, "not a complete operation")
    out = []
    for b in _ids(ops):
        own = ops.where(F.col("batch") == b)
        out.append((b, EdgeBatch(
            own.where("op = '+e'").select("seq", id1.alias("src"), id2.alias("dst"), *w), own.where("op = '-e'").select("seq", id1.alias("src"), id2.alias("dst")),
            own.where("op = '+v'").select("seq", id1.alias("id"), label.cast("tinyint").alias("label")), own.where("op = '-v'").select(id1.alias("id")),
        )))
    return out


def read_hyperedge_batches(spark: SparkSession, path: str, weighted: bool = False) -> list[tuple[int, HyperBatch]]:
    ops = operations(spark, path, "hypergraph")
    plain = ops.withColumn("t", F.filter(F.split(F.split("value", ";")[0], r"[ \t\r]+"), lambda x: x != "")).withColumn("weight", whole(F.trim(F.get(F.split("value", ";"), F.lit(1)))))
    members = F.transform(F.slice("t", 2, F.size("t")), lambda x: whole(x))
    bad = F.exists(members, lambda x: x.isNull() | (x < 0)) | (F.size("t") < 2) | F.when(F.col("op").isin("+i", "-i"), F.size("t") != 3).when(F.col("op") == "-h", F.size("t") != 2).otherwise(F.lit(False))
    bad |= F.when(F.col("op") == "+h", (F.col("weight").isNull() | (F.col("weight") < 1)) if weighted else F.col("value").contains(";")).otherwise(F.col("value").contains(";"))
    refuse(plain, bad, path, "not a complete operation")
    v1, v2 = members[0], F.get(members, F.lit(1))
    out = []
    for b in _ids(ops):
        own = plain.where(F.col("batch") == b)
        out.append((b, HyperBatch(
            own.where("op = '-h'").select("seq", v1.alias("h")), own.where("op = '-i'").select("seq", v1.alias("h"), v2.alias("v")),
            own.where("op = '+i'").select("seq", v1.alias("h"), v2.alias("v")), own.where("op = '+h'").select("seq", members.alias("members"), F.col("weight").cast("int").alias("w")),
        )))
    return out


def _ids(ops: DataFrame) -> list[int]:
    return sorted(r.batch for r in ops.select("batch").distinct().collect())  # the driver applies batches one by one


def batch_lines(spark: SparkSession, batches: Iterable[EdgeBatch]) -> DataFrame:
    """(value): the text of a graph's batches, numbered from 0."""
    out = spark.createDataFrame([(-1, 0, 0, "%dgt 1")], "b long, part int, seq long, value string")
    for i, x in enumerate(batches):
        parts = [spark.createDataFrame([(i, 0, 0, f"%batch {i}")], "b long, part int, seq long, value string")]
        ops = [
            (x.arrivals, "seq", lambda d: F.concat_ws(" ", F.lit("+v"), "id", F.when(F.col("label") >= 0, F.col("label").cast("string")))),
            (x.departures, "id", lambda d: F.concat_ws(" ", F.lit("-v"), "id")), (x.deletes, "seq", lambda d: F.concat_ws(" ", F.lit("-e"), "src", "dst")),
            (x.inserts, "seq", lambda d: F.concat_ws(" ", F.lit("+e"), "src", "dst", *[F.col(c).cast("string") for c in d.columns if c not in ("seq", "src", "dst")])),
        ]
        parts += [d.select(F.lit(i).cast("long").alias("b"), F.lit(p + 1).alias("part"), F.col(key).cast("long").alias("seq"), text(d).alias("value")) for p, (d, key, text) in enumerate(ops) if d is not None]
        for p in parts:
            out = out.unionByName(p)
    return out.orderBy("b", "part", "seq").select("value")


def write_batches(spark: SparkSession, path: str, batches: Iterable[EdgeBatch], single: bool = True) -> None:
    write_lines(batch_lines(spark, batches), path, single)


def write_hyperedge_batches(spark: SparkSession, path: str, batches: Iterable[HyperBatch], single: bool = True) -> None:
    out = spark.createDataFrame([(-1, 0, 0, "%dgt 1 hypergraph")], "b long, part int, seq long, value string")
    for i, x in enumerate(batches):
        parts = [spark.createDataFrame([(i, 0, 0, f"%batch {i}")], "b long, part int, seq long, value string")]
        ops = [
            (x.deletes, F.concat_ws(" ", F.lit("-h"), "h")), (x.removals, F.concat_ws(" ", F.lit("-i"), "h", "v")), (x.additions, F.concat_ws(" ", F.lit("+i"), "h", "v")),
            (x.inserts, F.concat_ws(" ", F.lit("+h"), F.array_join(F.col("members").cast("array<string>"), " "), F.when(F.col("w").isNotNull(), F.concat(F.lit("; "), F.col("w").cast("string"))))),
        ]
        parts += [d.select(F.lit(i).cast("long").alias("b"), F.lit(p + 1).alias("part"), F.col("seq").cast("long").alias("seq"), text.alias("value")) for p, (d, text) in enumerate(ops) if d is not None]
        for p in parts:
            out = out.unionByName(p)
    write_lines(out.orderBy("b", "part", "seq").select("value"), path, single)


def read_pair_files(spark: SparkSession, insert_path: str, delete_path: str) -> EdgeBatch:
    """A batch from a file of insertions ``u v w..`` and one of deletions ``u v``."""
    ins, dels = (materialize(tokens(lines(spark, p)), "pairs") for p in (insert_path, delete_path))
    first = ins.orderBy("line").first()
    k = len(first.t) - 2 if first else 0
    at = lambda i: whole(F.get("t", F.lit(i)))
    refuse(ins, (F.size("t") != k + 2) | F.exists("t", lambda x: whole(x).isNull()), insert_path, f"two ids and {k} weights are needed")
    refuse(dels, (F.size("t") != 2) | F.exists("t", lambda x: whole(x).isNull()), delete_path, "two ids are needed")
    return EdgeBatch(ins.select(F.col("line").alias("seq"), at(0).alias("src"), at(1).alias("dst"), *[at(2 + i).alias(n) for i, n in enumerate(weight_names(k))]), dels.select(F.col("line").alias("seq"), at(0).alias("src"), at(1).alias("dst")))


def write_pair_files(batch: EdgeBatch, insert_path: str, delete_path: str, single: bool = True) -> None:
    if batch.inserts is None or batch.deletes is None:
        raise InvalidArgument("both lists are needed; they may be empty")
    w = [c for c in batch.inserts.columns if c not in ("seq", "src", "dst")]
    write_lines(batch.inserts.orderBy("seq").select(F.concat_ws(" ", "src", "dst", *w).alias("value")), insert_path, single)
    write_lines(batch.deletes.orderBy("seq").select(F.concat_ws(" ", "src", "dst").alias("value")), delete_path, single)


def read_signed_lines(spark: SparkSession, path: str) -> EdgeBatch:
    """A batch of lines ``- u v`` and ``+ u v [w..]``."""
    rows = materialize(tokens(lines(spark, path)).where(~F.col("t")[0].startswith("#")), "signed")
    k = rows.where(F.col("t")[0] == "+").agg(F.max(F.size("t"))).first()[0]
    k = max(0, (k or 3) - 3)
    at = lambda i: whole(F.get("t", F.lit(i)))
    bad = ~F.col("t")[0].isin("+", "-") | at(1).isNull() | at(2).isNull() | F.when(F.col("t")[0] == "-", F.size("t") != 3).otherwise(F.size("t") != 3 + k)
    refuse(rows, bad, path, "not a signed edge")
    own = lambda s: rows.where(F.col("t")[0] == s)
    return EdgeBatch(own("+").select(F.col("line").alias("seq"), at(1).alias("src"), at(2).alias("dst"), *[at(3 + i).alias(n) for i, n in enumerate(weight_names(k))]), own("-").select(F.col("line").alias("seq"), at(1).alias("src"), at(2).alias("dst")))
