"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.store import materialize  # noqa: F401


def id_text(id_col: str) -> Column:
    """The id as text; a null id counts as the empty string."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``."""
    return F.crc32(id_text(id_col).cast("binary")) % F.lit(k)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that no other column can clash; a null text becomes empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch with the columns cast to ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Arrow batches between the JVM and Python workers take ``size`` bytes at most, unless the session has a bound of its own: the default of
    64 MB is held several times over in both, for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(size))


def strings(arr: pa.Array, step: int = 4 << 20) -> Iterator[str | None]:
    """The strings of ``arr``, made a few MB at a time, so that a batch of long texts isn't held twice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        yield from arr.slice(at, to - at).to_pylist()
        at = to


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(raw: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text (what ASCII white space separates) in lists from about ``step`` bytes each, so that a very long text isn't held as words at once."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + step) if at + step < len(raw) else None
        to = cut.start() if cut else len(raw)
        yield raw[at:to].split()
        at = to


def before(count: DataFrame, keys: list[str], at: str, value: str, out: str, span: int = 1024) -> DataFrame:
    """``count`` with the sum of ``value`` over the rows of the same ``keys`` (nulls are equal) with smaller ``at`` (unique there, from 0).

    Sums of ``span`` rows come first, so no task orders more than ``span`` of the rows, or a ``span``-th of them.
    """
    run = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = count.withColumn("_span", F.floor(F.col(at) / span))
    total = rows.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    total = total.withColumn("_up", F.coalesce(F.sum("_sum").over(run(keys or [F.lit(0)], "_span")), F.lit(0))).drop("_sum")
    own = [*keys, "_span"]
    for c in own:
        total = total.withColumnRenamed(c, f"_of{c}")
    on = F.lit(True)
    for c in own:
        on &= F.col(c).eqNullSafe(F.col(f"_of{c}"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(run(own, at)), F.lit(0)))
    return rows.join(total, on).withColumn(out, F.col("_in") + F.col("_up")).drop("_in", "_up", "_span", *[f"_of{c}" for c in own])


def spare(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def groups(n_rows: int, per_group: int, least: int = 1) -> int:
    """How many hash groups hold ``n_rows`` at about ``per_group`` each."""
    return max(least, -(-int(n_rows) // per_group))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of ``arr`` in one array, and the n + 1 offsets of the strings."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]
