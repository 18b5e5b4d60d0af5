"""Proportional stratified interleaving: shards of even row counts that each match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import before, groups, id_text, materialize
from tidegraph.store import counted

SEED = "shard-1"


def ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """0-based rank of each row within ``keys`` (nulls are equal), by ``bucket`` (from 0) and then ``order``; no task gets more than a bucket.

    Counts of (keys, bucket) are summed before they are shuffled; ``bucket`` must not fall as ``order`` rises.
    """
    rows = rows.withColumn("_b", bucket)
    count = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    start = before(count, keys, "_b", "_n", "_start").drop("_n")
    for k in [*keys, "_b"]:
        start = start.withColumnRenamed(k, f"{k}_")
    on = F.lit(True)
    for k in [*keys, "_b"]:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    inner = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return inner.join(start, on).withColumn(out, (F.col("_r") + F.col("_start")).cast("long")).drop("_r", "_b", "_start", *[f"{k}_" for k in [*keys, "_b"]])


def shards(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 500,
) -> DataFrame:
    """Deal rows into ``n_shards`` shards under the law ``rows``: counts differ by one at most.

    Rows of a source are shuffled by a digest of seed and id; a row's fractional rank is its rank, plus a part of one drawn from its digest, over
    the rows of its source (so sources of one row don't all meet in the middle). Rows in the order of that rank (ties by source, null last, then
    digest) are cut into even runs, so each shard has every source in proportion. Both rankings work on buckets of about
    ``rows_per_bucket`` rows, so a source with a third of all rows is no single task. Texts don't move: size and crc32 of the text are
    taken where it is read.

    The method deals rows one by one; groups of equal texts aren't held together. A null text has size 1 and the crc32 of no bytes. Rows
    that repeat an id (null is one) are told apart by their place in the table, so that they are dealt evenly as well. Null sources, other columns
    and empty tables are all right.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``), source.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("source"), F.md5(F.concat(F.lit(SEED + "|"), id_text(id_col)).cast("binary")).alias("draw"),
    )
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows, n = counted(rows, "shard-rows")
    again = rows.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id", F.lit(True).alias("again"))
    rows = rows.join(materialize(again, "shard-repeats"), F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    own_draw = F.md5(F.concat(F.col("draw"), F.lit("|"), F.col("place").cast("string")).cast("binary"))
    rows = rows.withColumn("draw", F.when(F.col("again"), own_draw).otherwise(F.col("draw"))).drop("again", "place")
    n_buckets = groups(n, rows_per_bucket, 64)
    uniform = lambda at: F.conv(F.substring("draw", at, 8), 16, 10).cast("double") / float(2**32)
    own = ranked(rows, ["source"], F.floor(uniform(1) * n_buckets).cast("long"), ["draw", "text_crc32", "size"], "r")
    of_source = rows.groupBy(F.col("source").alias("source_")).agg(F.count(F.lit(1)).alias("n_source"))
    own = own.join(of_source, F.col("source").eqNullSafe(F.col("source_"))).withColumn("at", (F.col("r") + uniform(9)) / F.col("n_source"))
    own = materialize(own.select("doc_id", "size", "text_crc32", "source", "draw", "at"), "shard-ranks")
    by_at = F.least(F.floor(F.col("at") * n_buckets), F.lit(n_buckets - 1)).cast("long")
    order = ["at", F.col("source").asc_nulls_last(), "draw", "text_crc32", "size"]
    out = ranked(own, [], by_at, order, "g").withColumn("shard", F.expr(f"int(((g + 1) * {n_shards} - 1) div {max(n, 1)})"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("g") - F.expr(f"(bigint(shard) * {n}) div {n_shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
