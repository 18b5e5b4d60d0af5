"""Versioned tables of a container in a shared folder, so that a stream's state survives its driver."""

from __future__ import annotations

from dataclasses import asdict
import json

from pyspark.sql import SparkSession

from tidegraph.errors import FileFormat
from tidegraph.graph import Graph, Properties, Semantics


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save(graph: Graph, folder: str, results: dict | None = None) -> str:
    """Write the graph and the frames ``results`` under ``folder``/v=N; the description is written last, so a snapshot is whole or absent."""
    at = f"{folder}/v={graph.version}"
    graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
    if graph.status is not None:
        graph.status.write.mode("overwrite").parquet(f"{at}/status")
    for name, df in (results or {}).items():
        df.write.mode("overwrite").parquet(f"{at}/result-{name}")
    about = {"num_vertices": graph.num_vertices, "num_weights": graph.num_weights, "next_pos": graph.next_pos, "version": graph.version, "status": graph.status is not None, "properties": asdict(graph.properties), "results": sorted(results or {})}
    graph.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/about")
    return at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of whole snapshots, ascending."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    out = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{folder}/{n}/about/_SUCCESS")[0])]
    return sorted(out)


def load(spark: SparkSession, folder: str, version: int | None = None) -> tuple[Graph, dict]:
    """The graph and result frames of a version (default: the last)."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileFormat(f"{folder}: no snapshot {version if version is not None else ''}")
    at = f"{folder}/v={known[-1] if version is None else version}"
    about = json.loads(spark.read.text(f"{at}/about").first().value)
    p = about["properties"]
    props = Properties(**{**p, "semantics": Semantics(**p["semantics"])})
    status = spark.read.parquet(f"{at}/status") if about["status"] else None
    graph = Graph(spark.read.parquet(f"{at}/edges"), about["num_vertices"], about["num_weights"], props, about["next_pos"], about["version"], status)
    return graph, {name: spark.read.parquet(f"{at}/result-{name}") for name in about["results"]}
