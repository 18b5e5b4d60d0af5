"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard, as flat arrays, and merged results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import groups, materialize
from tidegraph.store import counted

NEAR = 64  # nearest earlier vectors from which links are chosen


def _chosen(vectors: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each row of ``own`` the links among its candidates (-1: none): nearest first, those nearer to a chosen one last.

    Vectors have one length, so larger products are smaller distances.
    """
    ok = cand >= 0
    x = vectors[np.maximum(cand, 0)]
    near = np.where(ok, np.einsum("nkd,nd->nk", x, vectors[own]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    cand, near, ok = (np.take_along_axis(a, order, 1) for a in (cand, near, ok))
    x = np.take_along_axis(x, order[:, :, None], 1)
    between = np.einsum("nkd,njd->nkj", x, x)
    n, k = cand.shape
    closest = np.full((n, k), -np.inf)  # to any chosen so far
    rank = np.full((n, k), np.inf)
    count = np.zeros(n)
    for t in range(k):
        good = ok[:, t] & (closest[:, t] < near[:, t]) & (count < most)
        rank[good, t] = t
        count += good
        closest = np.maximum(closest, np.where(good[:, None], between[:, t, :], -np.inf))
    rank = np.where(ok & np.isinf(rank), k + np.arange(k), rank)
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.isfinite(np.take_along_axis(rank, first, 1)), np.take_along_axis(cand, first, 1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def walk(x: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer from ``entry`` (positions, -1: none): the ``beam`` best positions met for each query and their products.

    ``wide`` open nodes of each query are taken at once, and all queries step together. It ends where no open node is left in the beam.
    """
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    k = min(beam, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("nkd,nd->nk", x[np.maximum(ids[:, :k], 0)], queries), -np.inf)
    seen[np.arange(q)[:, None], ids[:, :k]] = True
    open_ = ids >= 0
    live = np.arange(q)
    while len(live):
        best = np.where(open_[live], sims[live], -np.inf)
        pick = np.argpartition(-best, min(wide, beam) - 1, axis=1)[:, :wide]
        good = np.isfinite(np.take_along_axis(best, pick, 1))
        keep = good.any(1)
        live, pick, good = live[keep], pick[keep], good[keep]
        if not len(live):
            break
        open_[live[:, None], pick] &= ~good
        nodes = np.where(good, ids[live[:, None], pick], -1)
        near = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[live[:, None], near] = True
        seen[:, n] = False
        row, col = np.nonzero(near >= 0)
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, col] = np.einsum("nd,nd->n", x[near[row, col]], queries[live[row]])
        all_s = np.concatenate([sims[live], s], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_o = np.concatenate([open_[live], near >= 0], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_o))
    return ids, sims


def layer(vectors: np.ndarray, links: int, entry: np.ndarray, step: int = 256) -> np.ndarray:
    """Neighbour array (n x links) of one layer. Vectors are inserted in order, ``step`` at a time: a search of the graph so far, from ``entry``
    (positions that the layer above found for each) and the first vector, gives each its ``NEAR`` nearest; those of its own step are compared
    with it. Links go to chosen ones of these and are mutual; a row that overflows chooses again.
    """
    n = len(vectors)
    table = np.full((n, links), -1, np.int32)
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        sims = vectors[rows] @ vectors[rows].T
        sims[np.arange(len(rows))[None, :] >= np.arange(len(rows))[:, None]] = -np.inf
        cand = np.where(np.isfinite(sims), rows[None, :], -1)
        if at:
            begin = np.column_stack([np.zeros(len(rows), np.int64), np.where(entry[rows] < at, entry[rows], -1)])
            begin[:, 1:][begin[:, 1:] == 0] = -1
            found, near = walk(vectors[:at], table[:at], vectors[rows], begin, NEAR, 4)
            sims, cand = np.concatenate([near, sims], 1), np.concatenate([found, cand], 1)
        k = min(NEAR, cand.shape[1])
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        cand = np.where(np.isfinite(np.take_along_axis(sims, best, 1)), np.take_along_axis(cand, best, 1), -1)
        got = _chosen(vectors, rows, cand, links // 2)
        table[rows, : links // 2] = got
        source, target = np.repeat(rows, links // 2), got.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, starts, sizes = np.unique(target, return_index=True, return_counts=True)
        if not len(heads):
            continue
        wide = np.full((len(heads), links + int(sizes.max())), -1, np.int64)
        wide[:, :links] = table[heads]
        wide[np.repeat(np.arange(len(heads)), sizes), links + np.arange(len(source)) - np.repeat(starts, sizes)] = source
        order = np.argsort(wide < 0, axis=1, kind="stable")
        wide = np.take_along_axis(wide, order, 1)
        fits = (wide[:, links:] < 0).all(1) if wide.shape[1] > links else np.ones(len(heads), bool)
        table[heads[fits]] = wide[fits, :links]
        for a in range(0, int((~fits).sum()), step):
            part = np.flatnonzero(~fits)[a : a + step]
            cut = wide[part]
            if cut.shape[1] > 2 * NEAR:  # the nearest of them; the heads of a layer's first vectors are hubs
                x = np.einsum("nkd,nd->nk", vectors[np.maximum(cut, 0)], vectors[heads[part]])
                x[cut < 0] = -np.inf
                cut = np.take_along_axis(cut, np.argsort(-x, axis=1, kind="stable")[:, : 2 * NEAR], 1)
            table[heads[part]] = _chosen(vectors, heads[part], cut, links)
    return table


class Graph:
    """Layers of flat neighbour arrays over unit vectors. ``layers``: (members, neighbours as positions in members), the lowest first."""

    def __init__(self, vectors: np.ndarray, links: int, seed: int = 5):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(vectors)) + 1e-300) / np.log(links)).astype(int)
        self.layers = []
        for h in range(int(level.max(initial=0)), -1, -1):  # from the top down, so that a layer's insertions descend through those above it
            members = np.flatnonzero(level >= h).astype(np.int32)
            entry = np.concatenate([self._entry(self.vectors[members[a : a + 1024]], members) for a in range(0, len(members), 1024)] or [np.zeros((0, 1), np.int64)])
            self.layers.insert(0, (members, layer(self.vectors[members], 2 * links if h == 0 else links, entry)))

    @classmethod
    def packed(cls, vectors: np.ndarray, layers: list) -> Graph:
        g = cls.__new__(cls)
        g.vectors, g.layers = vectors, layers
        return g

    def _entry(self, queries: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Positions in ``lower``, the members of the next layer, at which a descent through all layers there are arrives."""
        entry, last = np.zeros((len(queries), 1), np.int64), None
        for members, table in reversed(self.layers):
            if last is not None:
                entry = np.where(entry >= 0, np.searchsorted(members, last[np.maximum(entry, 0)]), -1)
            entry, last = walk(self.vectors[members], table, queries, entry, 8, 1)[0], members
        return entry if last is None else np.where(entry >= 0, np.searchsorted(lower, last[np.maximum(entry, 0)]), -1)

    def search(self, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Positions and products of the best ``beam`` met for each query (-1: none), by best-first search from the top layer down."""
        if not len(self.vectors):
            return np.full((len(queries), 1), -1), np.full((len(queries), 1), -np.inf, np.float32)
        upper, (members, table) = Graph.packed(self.vectors, self.layers[1:]), self.layers[0]
        return walk(self.vectors, table, queries, upper._entry(queries, members), beam, wide)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component on."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def lifted(vectors: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled and given one more component so that all have length 1: then the largest product is the nearest; and which are too long.

    The scale is the length that ``share`` of the vectors don't exceed. Were it the greatest, one very long vector would press all others
    together; those beyond the scale (a twentieth at most) are compared with each query exactly instead.
    """
    length = np.sqrt((vectors**2).sum(1))
    top = max(float(np.quantile(length, share, method="lower")) if len(length) else 0.0, 1e-300)
    x = vectors[length <= top] / top
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))]).astype(np.float32), length > top


def valid(col: str):
    good = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(col).isNotNull() & good & F.exists(col, lambda x: x != 0)


def nearest(
    rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16_384,
    query_rows: int = 2_048, wave_rows: int = 65_536, links: int = 24, beam: int = 256,
) -> DataFrame:
    """The ``k`` nearest by inner product of each row whose id is divisible by ``every``, among all others.

    Vectors are dealt to shards of about ``shard_rows`` by a hash of the id; each shard builds its graph and is written as flat arrays.
    A task holds one shard and sees up to ``wave_rows`` queries go by in blocks of ``query_rows``, so a graph travels once for so many
    queries; every query meets every shard, and the shards' results are merged. Each shard searches scaled vectors (``lifted``); all that
    it meets is scored in double precision on the original vectors. Equal vectors are one node with their k + 1 smallest ids (no more can be
    asked for), found by ranks in salted groups first. Measured recall is in the README.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors whose number of
    components isn't the most frequent one. Equal rows count once; rows of one id with different vectors are all candidates, and none for
    queries of that id. Ties go to the smaller id. An empty table gives an empty result; other columns are ignored.

    Returns query_id, rank, vec_id, score.
    """
    src = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    src = materialize(src.where(F.col("vec_id").isNotNull() & valid("v")), "vectors")
    sizes = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sizes.d
    src = src.where(F.size("v") == width)
    # k + 1 smallest ids of equal vectors: a third of all rows may be one vector, so ranks are taken in 64 salted parts first
    part = src.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).dropDuplicates(["vec_id", "v"])
    part = part.withColumn("i", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    part = part.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    classes, n_classes = counted(part.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    n_shards = groups(n_classes, shard_rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[int(x[0]) for x in pdf["ids"]]).sort_values("first")
        v = np.array(pdf["v"].tolist(), np.float64).reshape(-1, width)
        x, long = lifted(v)
        order = np.concatenate([np.flatnonzero(~long), np.flatnonzero(long)])  # those in the graph first
        ids = [np.asarray(pdf["ids"].iloc[i], np.int64) for i in order]
        layers = [a.astype(np.int32).tobytes() for pair in Graph(x, links).layers for a in pair]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "v": [v[order].tobytes()], "ids": [np.concatenate(ids).tobytes()], "sizes": [np.array([len(i) for i in ids], np.int32).tobytes()], "layers": [layers]})

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n_shards)).cast("int"))
    index = materialize(dealt.groupBy("shard").applyInPandas(build, "shard int, v binary, ids binary, sizes binary, layers array<binary>"), "vector-graphs")

    asked, n_asked = counted(src.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), "vector-queries")
    n_blocks = groups(n_asked, query_rows)
    n_waves = groups(n_asked, wave_rows)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64).reshape(-1, width)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "qv": [v.tobytes()]})

    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    blocks = materialize(blocks.groupBy("block").applyInPandas(gather, "block int, qids binary, qv binary"), "vector-blocks")
    wave, none = (F.col("block") % n_waves).cast("int"), F.lit(None).cast("binary")
    graphs = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(n_waves - 1)))).select("shard", "wave", F.lit(-1).alias("block"), "v", "ids", "sizes", "layers")
    calls = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select("shard", wave.alias("wave"), "block", F.col("qv").alias("v"), F.col("qids").alias("ids"), none.alias("sizes"), F.lit(None).cast("array<binary>").alias("layers"))
    met = graphs.unionByName(calls).repartition(2 * n_shards * n_waves, "shard", "wave").sortWithinPartitions("shard", "wave", "block")  # a graph, then its queries

    def search(batches):
        held = None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("block", "v", "ids", "sizes", "layers")}
                if r["block"] < 0:
                    held = Shard(r, width)
                    continue
                qids, qv = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], np.float64).reshape(-1, width)
                for at in range(0, len(qids), 256):
                    query, member, score = held.nearest(qids[at : at + 256], qv[at : at + 256], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(member), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """A shard's vectors, those in the graph first, their ids, and the graph."""

    def __init__(self, row: dict, width: int):
        self.v = np.frombuffer(row["v"], np.float64).reshape(-1, width)
        self.ids, self.size = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = [np.frombuffer(x, np.int32) for x in row["layers"]]
        self.graph = Graph.packed(lifted(self.v)[0], [(m, t.reshape(len(m), -1)) for m, t in zip(flat[::2], flat[1::2])])

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the ``k`` best for each query; ``own``: the queries' ids, which they don't find."""
        unit = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]).astype(np.float32)
        found, _ = self.graph.search(unit, max(beam, 2 * k))
        inside = len(self.graph.vectors)
        found = np.column_stack([found, np.tile(np.arange(inside, len(self.v)), (len(q), 1))])
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = products(q[row], self.v[node])
        order = np.lexsort((-score, row))  # k + 1 nodes hold the k best ids, whichever of them is the query's own
        row, node, score = row[order], node[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < 2 * k + 2
        row, node, score = row[keep], node[keep], score[keep]
        size = self.size[node]
        many = np.repeat(np.arange(len(node)), size)
        member = self.ids[self.start[node][many] + np.arange(len(many)) - np.repeat(np.cumsum(size) - size, size)]
        row, score = row[many], score[many]
        keep = member != own[row]
        row, member, score = row[keep], member[keep], score[keep]
        order = np.lexsort((member, -score, row))
        row, member, score = row[order], member[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return own[row[keep]], member[keep], score[keep]


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
