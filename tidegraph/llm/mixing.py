"""Mixing sources to target weights by weighted sampling without replacement; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import before, groups, id_text, materialize
from tidegraph.store import counted

WORD = r"[^\x20\x09-\x0D]+"
MARKS = "!|%$#*&"
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def prose_quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 for plain prose, less the more shouting and table marks there are for each word."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.lit(1.0) / (F.lit(1.0) + marks / F.greatest(size, F.lit(1).cast("long")))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality_col: str | None) -> DataFrame:
    """_size, _draw (uniform, from a digest of seed, id and text), _key (exponential over the quality weight: small keys come first)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_size", words(F.col(text_col))).withColumn("_draw", F.md5(F.concat(F.lit(SEED + "|"), id_text(id_col), F.lit("|"), text).cast("binary")))
    quality = F.greatest(F.coalesce(F.col(quality_col).cast("double"), F.lit(1.0)), F.lit(1e-6)) if quality_col else prose_quality(text, F.col("_size"))
    uniform = (F.conv(F.substring("_draw", 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return out.withColumn("_key", -F.log(uniform) / quality).withColumn("_source", F.col(source_col))


def bucket(n: int) -> Column:
    """The bucket of a key among ``n``; in the keys' order, and of even sizes for even weights."""
    return F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * n), F.lit(n - 1)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """_source, source_size, target, epochs, budget (words beyond whole epochs) from (_source, source_size).

    Water-filling: sources in the order of ``most * size / weight`` are full until the level left for the others is below theirs.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("full") / F.col("w"))
    every = Window.partitionBy(F.lit(0))
    filled = every.orderBy("level", "rank")
    t = ranked.withColumn("total", F.sum("source_size").over(every) * share)
    t = t.withColumn("before", F.coalesce(F.sum("full").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left_w", F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("own", (F.col("total") - F.col("before")) / F.col("left_w")).withColumn("is_full", F.col("own") >= F.col("level"))
    t = t.withColumn("common", F.max(F.when(~F.col("is_full"), F.col("own"))).over(every))
    t = t.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("common") * F.col("w")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return t.select("_source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))


def plan(rows: DataFrame, n_buckets: int, weights: list[int], share: float, most: float) -> DataFrame:
    """For each source its target, epochs, and the last key that the fractional epoch takes.

    Sizes are summed by (source, key bucket) before any shuffle; only the one bucket of a source where the budget ends is sorted.
    The tables of one row for each source are written before rows are joined to them, so Spark broadcasts them only while their size allows.
    """
    hist = rows.groupBy("_source", bucket(n_buckets).alias("b")).agg(F.sum("_size").alias("s"))
    goals = targets(hist.groupBy("_source").agg(F.sum("s").alias("source_size")), weights, share, most)
    run = before(hist, ["_source"], "b", "s", "start").withColumn("end", F.col("start") + F.col("s")).withColumnRenamed("_source", "src")
    cut = goals.join(run, goals._source.eqNullSafe(run.src) & (run.end > goals.budget), "left")
    cut = cut.groupBy("_source", "source_size", "target", "epochs", "budget").agg(F.min(F.struct("b", "start")).alias("at"))
    cut = cut.select("_source", "source_size", "target", "epochs", "budget", F.col("at.b").alias("cut_b"), F.col("at.start").alias("start"))
    cut = materialize(cut, "mix-cut")
    edge = cut.select(F.col("_source").alias("src"), "cut_b", "start", "budget")
    inside = rows.withColumn("b", bucket(n_buckets)).join(edge, rows._source.eqNullSafe(edge.src) & (F.col("b") == F.col("cut_b")))
    so_far = F.coalesce(F.sum("_size").over(Window.partitionBy("_source").orderBy("_key", "_draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = inside.withColumn("before", so_far + F.col("start")).where(F.col("before") + F.col("_size") / 2 <= F.col("budget"))
    last = taken.groupBy(F.col("_source").alias("src")).agg(F.max(F.struct("_key", "_draw")).alias("last"))
    out = cut.join(last, cut._source.eqNullSafe(last.src), "left")
    return out.select(F.col("_source").alias("src"), "source_size", "target", "epochs", "cut_b", F.col("last._key").alias("last_key"), F.col("last._draw").alias("last_draw"))


def times_taken(n_buckets: int) -> Column:
    """How often the mix takes a row that is joined to its source's plan: whole epochs, and once more up to the last key."""
    b = bucket(n_buckets)
    up_to = (F.col("_key") < F.col("last_key")) | ((F.col("_key") == F.col("last_key")) & (F.col("_draw") <= F.col("last_draw")))
    more = F.when(F.col("cut_b").isNull() | (b < F.col("cut_b")), 1).when((b == F.col("cut_b")) & F.coalesce(up_to, F.lit(False)), 1).otherwise(0)
    return (F.col("epochs") + more).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None,
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, rows_per_bucket: int = 500,
) -> tuple[DataFrame, DataFrame, int]:
    """Plan a mix of sources by Efraimidis-Spirakis sampling.

    Sources in code-point order (null last, a source of its own) weigh ``weights`` in turn and share ``share`` times all words; no
    target exceeds ``most`` times its source's words. Within a source, rows come in the order of exponential keys over quality weights
    (``quality_col``; a null one is 1; without it marks for each word set the weight). Whole epochs come first; the rest takes rows in
    key order to the one whose end lies nearest the budget. Keys are digests of seed, id and text, so reruns agree; rows that are equal
    in all of these share a key and are all taken alike. Null texts have 0 words and are taken 0 times over. An empty table gives an
    empty mix. The mix is planned on ids, texts, sources and qualities alone, so other columns
    can't clash.

    Returns (compact rows, plan by source, number of buckets).
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *([F.col(quality_col).alias("quality")] if quality_col else []))
    rows = keyed(own, "doc_id", "text", "source", "quality" if quality_col else None).select("doc_id", "_source", "_size", "_key", "_draw")
    rows, n = counted(rows, "mix-rows")
    n = groups(n, rows_per_bucket, 64)
    return rows, materialize(plan(rows, n, list(weights), share, most), "mix-plan"), n


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) for each row of ``docs``; see ``mix``."""
    rows, goals, n = mix(docs, **options)
    out = rows.join(goals, rows._source.eqNullSafe(goals.src))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * times_taken(n)).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns whatever their names, as often as the mix takes them; rows without words are left out."""
    _, goals, n = mix(docs, **options)
    cols = {new: options.get(f"{name}_col", default) for new, name, default in (("doc_id", "id", "doc_id"), ("text", "text", "text"), ("source", "source", "source"), ("quality", "quality", None))}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(c).alias(new) for new, c in cols.items() if c])
    rows = keyed(own, "doc_id", "text", "source", "quality" if cols["quality"] else None).where("_size > 0")
    out = rows.join(goals, F.col("_source").eqNullSafe(F.col("src"))).withColumn("_times", times_taken(n)).where("_times > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (
  SELECT *, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t) AS draw,
         1.0::DOUBLE / (1.0::DOUBLE + (length(t) - length(translate(t, '{MARKS}', '')))::DOUBLE / greatest(size, 1)) AS q FROM d),
e AS (SELECT *, -ln((CAST('0x' || substr(draw, 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / q AS key FROM k),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM e GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(r % 3 AS INT) + 1] AS w, 2.0::DOUBLE * n AS cap FROM s),
l AS (SELECT *, cap / w AS level, sum(n) OVER () * 1.5::DOUBLE AS total FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY level, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
             sum(w) OVER (ORDER BY level, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM l),
o AS (SELECT *, (total - before) / left_w AS own FROM f),
c AS (SELECT *, max(CASE WHEN own < level THEN own END) OVER () AS common FROM o),
g AS (SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN own >= level THEN cap ELSE common * w END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
x AS (
  SELECT e.doc_id, e.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
         coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
