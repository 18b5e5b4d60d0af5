"""Text files as numbered lines, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.errors import FileFormat
from tidegraph.store import materialize

BLANKS = r"[ \t\r]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines from 0, over all splits of a file or of the part files of a folder, in order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    raw = materialize(raw, "lines")  # rows of a split are numbered in a row, so a line is its split's first line and its place there
    splits = raw.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), (before - F.col("_first")).alias("_start"))
    out = raw.join(starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return out.select((F.col("_at") + F.col("_start")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def tokens(df: DataFrame, separators: str = BLANKS) -> DataFrame:
    """Adds ``t``: the tokens of ``value``; lines without any are left out."""
    return df.withColumn("t", F.filter(F.split("value", separators), lambda x: x != "")).where(F.size("t") > 0)


def whole(col: Column) -> Column:
    """A token as a long; null where it isn't a whole decimal number."""
    return F.when(col.rlike("^-?[0-9]+$"), col.try_cast("long"))


def refuse(df: DataFrame, bad, path: str, why: str) -> None:
    """Raise with the first line that is ``bad``."""
    first = df.where(F.coalesce(bad, F.lit(True))).agg(F.min_by("value", "line").alias("value"), F.min("line").alias("line")).first()
    if first.line is not None:
        raise FileFormat(f"{path}:{first.line + 1}: {why}: {first.value[:80]!r}")


def write_lines(df: DataFrame, path: str, single: bool = True) -> None:
    """Write a sorted frame of one text column: as one file, or (``single`` False) as a folder whose parts in order are the file."""
    spark = df.sparkSession
    if not single:
        df.write.mode("overwrite").text(path)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    part = f"{path}._parts"
    df.coalesce(1).write.mode("overwrite").text(part)
    folder, target = hadoop.Path(part), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    files = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if files:
        fs.rename(files[0], target)
    else:
        fs.create(target).close()
    fs.delete(folder, True)
