"""Tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument

_own_dir: list[str] = []
_runs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets a folder of its own; on a
    cluster that would not be shared, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        folder = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir.append("file://" + folder)
    return _own_dir[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside the block go to one folder, which is deleted at its end: results must be written or collected before."""
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        _delete(spark, folder)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_runs[-1] if _runs else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """``materialize`` and the number of rows, from the same job."""
    out, seen = measured(df, name, F.count(F.lit(1)).alias("n"))
    return out, seen["n"]


def measured(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and, from the same job, the values of ``metrics``."""
    seen = Observation()
    return materialize(df.observe(seen, *metrics), name), seen.get


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads them."""
    name = getattr(df, "_table", None)
    if name:
        _delete(df.sparkSession, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
