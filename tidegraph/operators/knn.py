"""Similarity graphs: each vector's nearest others by cosine, exact, as a symmetric union."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.errors import InvalidArgument
from tidegraph.store import materialize, measured

BLOCK = 2_048
PANEL = 32  # blocks that a task holds of either side at most, and
PANEL_BYTES = 64 << 20  # bytes


def nearest_by_cosine(vectors: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(u, v, s, rank): the ``k`` largest cosines of each vector with others, ties to the smaller id.

    Vectors are packed in blocks, blocks make panels of bounded size; a task compares the blocks of two panels by matrix products, keeps the best ``k``
    of each vector as it goes and passes these on. Its memory is that of two panels, and vectors travel once for each panel, not for each block.
    All pairs are compared, so the work grows with their square. Null and zero vectors and those with null components take no part.
    """
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good & F.col("id").isNotNull())
    rows, seen = measured(rows, "vectors", F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size"))
    n_blocks = max(1, -(-seen["n"] // BLOCK))
    panel = max(1, min(PANEL, -(-n_blocks // 8), PANEL_BYTES // (8 * BLOCK * (seen["size"] or 1))))
    n_panels = -(-n_blocks // panel)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = np.array(pdf["v"].tolist(), np.float64)
        v /= np.sqrt((v * v).sum(1, keepdims=True))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [v.tobytes()]})

    packed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, x binary")
    packed = materialize(packed, "vector-blocks")
    panels = F.explode(F.sequence(F.lit(0), F.lit(n_panels - 1)))
    own = F.floor(F.col("block") / panel).cast("int")
    left = packed.select(own.alias("p"), panels.alias("q"), "ids", "x").repartition(n_panels * n_panels, "p", "q").groupBy("p", "q")
    right = packed.select(own.alias("q"), panels.alias("p"), "ids", "x").repartition(n_panels * n_panels, "p", "q").groupBy("p", "q")

    def blocks(pdf: pd.DataFrame):
        for ids, x in zip(pdf["ids"], pdf["x"]):
            i = np.frombuffer(ids, np.int64)
            yield i, np.frombuffer(x, np.float64).reshape(len(i), -1)

    def compare(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        out = []
        for li, lx in blocks(lefts):
            best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)  # row, cosine, id
            least = np.full(len(li), -np.inf)
            for ri, rx in blocks(rights):
                s = np.minimum(lx @ rx.T, 1.0)
                s[li[:, None] == ri[None, :]] = -np.inf
                hits = s >= least[:, None]
                if np.count_nonzero(hits) > 8 * k * len(li) and k < s.shape[1]:
                    hits &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                row, col = np.nonzero(hits & (s > -np.inf))
                row, value, ids = (np.concatenate(x) for x in zip(best, (row, s[row, col], ri[col])))
                order = np.lexsort((ids, -value, row))
                row, value, ids = row[order], value[order], ids[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                best = row[nth < k], value[nth < k], ids[nth < k]
                full = nth == k - 1
                least[row[full]] = value[full]
            out.append(pd.DataFrame({"u": li[best[0]], "v": best[2], "s": best[1]}))
        return pd.concat(out) if out else pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64), "s": np.empty(0)})

    near = left.cogroup(right).applyInPandas(compare, "u long, v long, s double")
    best = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_graph(vectors: DataFrame, k: int, negative: str = "drop", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(src, dst, w), both directions of each pair that is near from either end. ``negative``: ``drop`` keeps positive cosines, ``shift``
    weighs (1 + s) / 2."""
    if negative not in ("drop", "shift"):
        raise InvalidArgument(f"unknown rule {negative!r}")
    near = nearest_by_cosine(vectors, k, id_col, vector_col)
    pairs = near.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("s").alias("s"))
    w = F.col("s") if negative == "drop" else (1 + F.col("s")) / 2
    pairs = materialize(pairs.select("a", "b", w.cast("float").alias("w")).where(F.col("w") > 0), "knn")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
