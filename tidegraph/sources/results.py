"""Readers and writers of results: distances, parents, path costs, labels, histograms, bins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import FileFormat, InvalidArgument
from tidegraph.fixpoint import INFINITE
from tidegraph.sources.lines import lines, refuse, tokens, whole, write_lines
from tidegraph.store import materialize


def _values(spark: SparkSession, path: str, n: int, value, name: str) -> DataFrame:
    rows = materialize(tokens(lines(spark, path)), name)
    refuse(rows, (F.size("t") != 2) | whole(F.col("t")[0]).isNull() | value.isNull(), path, f"not a vertex and a {name}")
    out = rows.select(whole(F.col("t")[0]).alias("v"), value.alias(name))
    seen = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.min("v").alias("least"), F.max("v").alias("top")).first()
    if seen.n != n or seen.d != n or n and (seen.least != 0 or seen.top != n - 1):
        raise FileFormat(f"{path}: not every vertex below {n} exactly once")
    return out


def read_distances(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(v, distance); ``INF`` is an unreached vertex."""
    t = F.get("t", F.lit(1))
    return _values(spark, path, n, F.when(t == "INF", F.lit(INFINITE)).otherwise(whole(t)), "distance")


def read_parents(spark: SparkSession, path: str, n: int) -> DataFrame:
    return _values(spark, path, n, whole(F.get("t", F.lit(1))), "parent")


def read_labels(spark: SparkSession, path: str, n: int) -> DataFrame:
    return _values(spark, path, n, F.get("t", F.lit(1)).try_cast("float"), "label")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(v, class): seeds or true labels."""
    rows = materialize(tokens(lines(spark, path)), "classes")
    refuse(rows, (F.size("t") != 2) | F.exists("t", lambda x: whole(x).isNull()), path, "not a vertex and a class")
    return rows.select(whole(F.col("t")[0]).alias("v"), whole(F.col("t")[1]).cast("int").alias("class"))


def read_capacities(spark: SparkSession, path: str) -> DataFrame:
    """(v, capacity): one whole number on a line."""
    from tidegraph.functions.ordinals import numbered

    rows = materialize(tokens(lines(spark, path)), "capacities")
    refuse(rows, (F.size("t") != 1) | whole(F.col("t")[0]).isNull(), path, "not a whole number")
    return numbered(rows, ["line"], "v").select("v", whole(F.col("t")[0]).alias("capacity"))


def _write(df: DataFrame, path: str, *parts, single: bool = True) -> None:
    write_lines(df.orderBy("v").select(F.concat_ws(" ", F.col("v").cast("string"), *parts).alias("value")), path, single)


def write_distances(tree: DataFrame, path: str, single: bool = True) -> None:
    _write(tree, path, F.when(F.col("distance") >= INFINITE // 2, F.lit("INF")).otherwise(F.col("distance").cast("string")), single=single)


def write_parents(tree: DataFrame, path: str, single: bool = True) -> None:
    _write(tree, path, F.col("parent").cast("string"), single=single)


def write_path_costs(costs: DataFrame, path: str, single: bool = True) -> None:
    """``v c0 ..``; ``INF`` for each objective of an unreached vertex."""
    _write(costs, path, *[F.coalesce(F.col(c).cast("string"), F.lit("INF")) for c in costs.columns if c != "v"], single=single)


def write_labels(labels: DataFrame, path: str, single: bool = True) -> None:
    """Six decimals, halves to even: a float has 24 bits, so its decimal expansion fits the decimal type it is rounded in."""
    exact = F.col("label").cast("double").cast("decimal(38,30)")
    _write(labels, path, F.bround(exact, 6).cast("decimal(38,6)").cast("string"), single=single)


def write_classes(truth: DataFrame, path: str, single: bool = True) -> None:
    """``v class``."""
    _write(truth, path, F.col("class").cast("string"), single=single)


def write_capacities(capacities: DataFrame, path: str, single: bool = True) -> None:
    """The capacity of each vertex in the vertices' order, without their numbers."""
    write_lines(capacities.orderBy("v").select(F.col("capacity").cast("string").alias("value")), path, single)


def stream_json(stream, options: dict) -> str:
    """What a reader of a stream needs besides its files: sizes, the mean weight of the whole graph, the largest batch."""
    at_most = lambda df: df.groupBy("batch").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    facts = {
        "num_vertices": stream.num_vertices, "num_edges": stream.edges.count(), "num_batches": stream.num_batches, "similarity_threshold": stream.similarity_threshold,
        "max_batch_vertices": at_most(stream.vertices), "max_batch_edges": at_most(stream.edges), "options": options,
    }
    return json.dumps(facts, indent=2, sort_keys=True) + "\n"


def histogram_csv(by_length: dict[int, int]) -> str:
    rows = ["# cycle_size, num_of_cycles", *(f"{k}, {n}" for k, n in sorted(by_length.items()) if n), f"Total, {sum(by_length.values())}"]
    return "\n".join(rows) + "\n"


BIN_KINDS = {"h_motif": ("h_motif", 30), "type1": ("stathyper_type1", 1), "type2": ("stathyper_type2", 1), "type3": ("stathyper_type3", 1)}


def bins_json(counts: list[int], kind: str, graph_version: int = 0, deltas: list[list[int]] | None = None, vendor: str = "tidegraph") -> str:
    """Version 1 of the bins document; its ``format`` is ``<vendor>.triad_bins``."""
    name, n = BIN_KINDS[kind]
    if len(counts) != n or any(len(d) != n for d in deltas or []):
        raise InvalidArgument(f"{kind} has {n} bins")
    rows = [f'  "format": "{vendor}.triad_bins"', '  "version": 1', f'  "kind": "{name}"', f'  "num_bins": {n}', f'  "graph_version": {graph_version}', f'  "counts": [{", ".join(map(str, counts))}]']
    if deltas:
        rows.append('  "deltas": [\n' + ",\n".join(f"    [{', '.join(map(str, d))}]" for d in deltas) + "\n  ]")
    return "{\n" + ",\n".join(rows) + "\n}\n"


def read_bins_json(text: str) -> dict:
    """counts, deltas, kind and graph_version of a bins document of any vendor."""
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise FileFormat("a key is there twice")
        return dict(pairs)

    def never(x):
        raise FileFormat(f"not a whole number: {x}")

    try:
        d = json.loads(text, object_pairs_hook=once, parse_float=never, parse_constant=never)
    except json.JSONDecodeError as e:
        raise FileFormat(f"{e.lineno}:{e.colno}: {e.msg}") from e
    kinds = {name: (kind, n) for kind, (name, n) in BIN_KINDS.items()}
    if not isinstance(d, dict) or not str(d.get("format", "")).endswith(".triad_bins") or d.get("version") != 1 or d.get("kind") not in kinds:
        raise FileFormat("not version 1 of a bins document")
    kind, n = kinds[d["kind"]]
    rows, deltas = d.get("counts"), d.get("deltas", [])
    ok = lambda x, low, high: isinstance(x, list) and len(x) == n and all(type(i) is int and low <= i <= high for i in x)
    if d.get("num_bins") != n or not ok(rows, 0, 2**64 - 1) or not isinstance(deltas, list) or not all(ok(x, -(2**63), 2**63 - 1) for x in deltas):
        raise FileFormat("counts or deltas that aren't of the kind")
    return {"kind": kind, "counts": rows, "deltas": deltas, "graph_version": d.get("graph_version", 0)}
