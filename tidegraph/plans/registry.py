"""All queries of the library outside ``llm`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.motifs import class_of_mask
from tidegraph.graph import EdgeBatch, Graph, Properties, Semantics
from tidegraph.operators import bfs, cycles, hyper_sssp, knn, labels, mosp, patterns, sssp, triads, triangles
from tidegraph.operators.components import connected_components
from tidegraph.plans import inputs as I
from tidegraph.store import materialize
from tidegraph.update import update

SOURCE = 1
PREFERENCES = [4, 1, 2]
BOUND = 4

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _paths_sql(graph: str, weight: str, tag: str, source: str = str(SOURCE), start: str = "0") -> str:
    """CTEs d<tag> (v, dist), t<tag> (v, distance, parent) over ``graph`` (src, dst, ...)."""
    return f"""
d{tag}(v, dist) USING KEY (v) AS (
  SELECT CAST({source} AS BIGINT), CAST({start} AS BIGINT)
  UNION SELECT x.dst, min(f.dist + x.{weight}) FROM d{tag} f JOIN {graph} x ON f.v = x.src LEFT JOIN recurring.d{tag} r ON r.v = x.dst
  WHERE r.dist IS NULL OR f.dist + x.{weight} < r.dist GROUP BY x.dst),
t{tag} AS (
  SELECT d.v, d.dist AS distance, coalesce((SELECT min(x.src) FROM {graph} x JOIN d{tag} s ON s.v = x.src WHERE x.dst = d.v AND s.dist + x.{weight} = d.dist AND d.dist > 0), -1) AS parent
  FROM d{tag} d)"""


def _all_parts(tree: str, missing: str = I.INFINITE_SQL) -> str:
    return f"SELECT p_partkey AS v, CAST(coalesce(t.distance, {missing}) AS BIGINT) AS distance, CAST(coalesce(t.parent, -1) AS BIGINT) AS parent FROM part LEFT JOIN {tree} t ON t.v = p_partkey"


# shortest paths


@query(f"WITH RECURSIVE {I.EDGES}, {I.WHOLE}, {_paths_sql('g', 'w0', '0')} {_all_parts('t0')}")
def sssp_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = I.part_graph(spark, sf_dir)
    return sssp.compute(graph, SOURCE).tree()


@query(f"WITH RECURSIVE {I.EDGES}, {I.AFTER}, {_paths_sql('g', 'w0', '0')} {_all_parts('t0')}")
def sssp_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, where="k % 10 <> 9")
    result = sssp.compute(graph, SOURCE)
    sssp.update(graph, I.reweighting(edges), result)
    return result.tree()


def _mosp_sql(graph: str) -> str:
    scale = mosp.scale_of(PREFERENCES)
    terms = " UNION ALL ".join(f"SELECT parent AS src, v AS dst, {scale // p} AS term FROM t{i} WHERE parent >= 0" for i, p in enumerate(PREFERENCES))
    return f"""WITH RECURSIVE {I.EDGES}, {graph}, {', '.join(_paths_sql('g', f'w{i}', str(i)) for i in range(3))},
c AS (SELECT src, dst, {scale * 4} - sum(term) AS w FROM ({terms}) GROUP BY 1, 2),
{_paths_sql('c', 'w', 'c')},
cost(v, c0, c1, c2) AS (
  SELECT CAST({SOURCE} AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT t.v, o.c0 + g.w0, o.c1 + g.w1, o.c2 + g.w2 FROM cost o JOIN tc t ON t.parent = o.v JOIN g ON g.src = o.v AND g.dst = t.v)
SELECT a.*, o.c0, o.c1, o.c2 FROM ({_all_parts('tc')}) a LEFT JOIN cost o ON o.v = a.v"""


def _mosp_rows(result) -> DataFrame:
    return result.combined().join(result.path_costs(), "v")


@query(_mosp_sql(I.WHOLE))
def mosp_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = I.part_graph(spark, sf_dir, 3)
    return _mosp_rows(mosp.compute(graph, SOURCE, preferences=PREFERENCES))


@query(_mosp_sql(I.AFTER))
def mosp_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, 3, "k % 10 <> 9")
    result = mosp.compute(graph, SOURCE, preferences=PREFERENCES)
    mosp.update(graph, I.reweighting(edges, 3), result)
    return _mosp_rows(result)


def _bfs_sql(graph: str) -> str:
    return f"""WITH RECURSIVE {I.EDGES}, {graph}, u AS (SELECT src, dst, 1 AS one FROM g), {_paths_sql('u', 'one', 'b')}
SELECT v, distance AS level, parent FROM ({_all_parts('tb', '-1')})"""


@query(_bfs_sql(I.WHOLE))
def dynamic_bfs_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = I.part_graph(spark, sf_dir)
    return bfs.compute(graph, SOURCE).tree()


@query(_bfs_sql(I.AFTER))
def dynamic_bfs_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, where="k % 10 <> 9")
    result = bfs.compute(graph, SOURCE)
    bfs.update(graph, I.reweighting(edges), result)
    return result.tree()


# cycles and triangles


def _cycles_sql(graph: str, name: str) -> str:
    """A CTE ``name`` (length, count) of cycles of 2 to 4 edges."""
    return f"""{name} AS (
  SELECT 2 AS length, count(*) AS count FROM {graph} a JOIN {graph} b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL SELECT 3, count(*) FROM {graph} a JOIN {graph} b ON b.src = a.dst JOIN {graph} c ON c.src = b.dst AND c.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst
  UNION ALL SELECT 4, count(*) FROM {graph} a JOIN {graph} b ON b.src = a.dst JOIN {graph} c ON c.src = b.dst JOIN {graph} d ON d.src = c.dst AND d.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.src < c.dst AND b.dst <> a.dst AND c.dst <> a.dst AND c.dst <> b.dst)"""


@query(f"WITH {I.EDGES}, {_cycles_sql('e', 'h')} SELECT length, count FROM h WHERE count > 0")
def cycle_count_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = I.part_graph(spark, sf_dir, 0, properties=Properties.structural())
    return cycles.compute(graph, BOUND).frame()


@query(f"""WITH {I.EDGES}, g0 AS (SELECT src, dst FROM e WHERE k % 10 <> 9), g1 AS (SELECT src, dst FROM e WHERE k % 10 <> 0),
kept AS (SELECT src, dst FROM e WHERE k % 10 NOT IN (0, 2, 9)), {_cycles_sql('g0', 'h0')}, {_cycles_sql('g1', 'h1')}, {_cycles_sql('kept', 'hk')}
SELECT h0.length, h0.count AS before, h0.count - hk.count AS removed, h1.count - hk.count AS added, h1.count AS after
FROM h0 JOIN h1 ON h0.length = h1.length JOIN hk ON h0.length = hk.length""")
def cycle_count_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, 0, "k % 10 <> 9", Properties.structural())
    result = cycles.compute(graph, BOUND)
    before = result.counts
    cycles.update(graph, I.structural(edges), result)
    rows = [(k, before[k], result.removed.get(k, 0), result.added.get(k, 0), result.count(k)) for k in range(2, BOUND + 1)]
    return spark.createDataFrame(rows, "length int, before long, removed long, added long, after long")


_TRI = "SELECT count(*) FROM {0} a JOIN {0} b ON b.u = a.v JOIN {0} c ON c.u = a.u AND c.v = b.v"
UNDIRECTED_SETS = Properties(directed=False, semantics=Semantics.sets())


@query(f"WITH {I.EDGES}, {I.PAIRS} SELECT ({_TRI.format('p')}) AS triangles")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles.count_triangles(I.part_pairs(I.part_edges(spark, sf_dir)))


@query(f"""WITH {I.EDGES}, {I.PAIRS}, p0 AS (SELECT u, v FROM p WHERE k % 10 <> 9), p1 AS (SELECT u, v FROM p WHERE k % 10 <> 0), pk AS (SELECT u, v FROM p WHERE k % 10 NOT IN (0, 2, 9)),
c AS (SELECT ({_TRI.format('p0')}) AS before, ({_TRI.format('p1')}) AS after, ({_TRI.format('pk')}) AS kept)
SELECT before, before - kept AS destroyed, after - kept AS created, after FROM c""")
def triangle_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = I.part_edges(spark, sf_dir)
    pairs = materialize(I.part_pairs(edges).select(F.col("u").alias("src"), F.col("v").alias("dst"), "k"), "pairs")
    graph = Graph.from_edges(pairs.where("k % 10 <> 9"), I.num_parts(spark, sf_dir), UNDIRECTED_SETS, [], order="k")
    result = triangles.compute(graph)
    before = result.total
    triangles.update(graph, I.structural(pairs), result)
    return spark.createDataFrame([(before, result.destroyed, result.created, result.total)], "before long, destroyed long, created long, after long")


@query(f"""WITH RECURSIVE {I.EDGES}, x AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
c(id, component) USING KEY (id) AS (
  SELECT DISTINCT src, src FROM x
  UNION SELECT x.dst, min(f.component) FROM c f JOIN x ON x.src = f.id JOIN recurring.c r ON r.id = x.dst WHERE f.component < r.component GROUP BY x.dst)
SELECT id, component FROM c""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(I.part_edges(spark, sf_dir).select(F.col("src").alias("u"), F.col("dst").alias("v")))


# containers and batches


@query(f"""WITH {I.EDGES}, {I.AFTER} SELECT src, dst, w0 FROM g""")
def apply_upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, where="k % 10 <> 9")
    graph.apply(I.reweighting(edges))
    return graph.edges.select("src", "dst", F.col("w0").cast("long").alias("w0"))


@query(f"""WITH {I.EDGES}, s AS (SELECT count(CASE WHEN k % 10 IN (2, 9) THEN 1 END) AS inserted, count(CASE WHEN k % 10 IN (0, 2) THEN 1 END) AS deleted,
  count(CASE WHEN k % 10 = 9 THEN 1 END) AS missing, count(CASE WHEN k % 10 = 1 THEN 1 END) AS present, count(CASE WHEN k % 10 = 2 THEN 1 END) AS cancelled FROM e)
SELECT inserted AS inserted_edges, deleted AS deleted_edges, missing AS ignored_deletions, present AS ignored_insertions, cancelled AS cancelled_pairs,
  CAST(1 AS BIGINT) AS dropped_self_loops, (SELECT count(*) FROM e WHERE k % 10 <> 0) AS edges_after FROM s""")
def apply_set_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, 0, "k % 10 <> 9", Properties.structural())
    s = graph.apply(I.structural(edges))
    row = (s.inserted_edges, s.deleted_edges, s.ignored_deletions, s.ignored_insertions, s.cancelled_pairs, s.dropped_self_loops, graph.edges.count())
    return spark.createDataFrame([row], "inserted_edges long, deleted_edges long, ignored_deletions long, ignored_insertions long, cancelled_pairs long, dropped_self_loops long, edges_after long")


def arrival_batches(pairs: DataFrame, n: int, parts: int = 4) -> list[EdgeBatch]:
    """Vertices by residue; an edge comes with the later of its ends; from the second batch on every 37th vertex of earlier ones leaves."""
    spark = pairs.sparkSession
    ids = spark.range(n).select("id", (F.col("id") % parts).alias("b"))
    rows = materialize(pairs.withColumn("b", F.greatest(F.col("src") % parts, F.col("dst") % parts)), "arrivals")
    seed = F.when(F.col("id") % 10 == 0, F.col("id") % 20 / 10).otherwise(-1).cast("tinyint")
    out = []
    for t in range(parts):
        come = ids.where(F.col("b") == t).select(F.col("id").alias("seq"), "id", seed.alias("label"))
        gone = ids.where((F.col("id") % 37 == 0) & (F.col("b") == t - 1)).select("id")
        new = rows.where(F.col("b") == t).select(F.monotonically_increasing_id().alias("seq"), "src", "dst", "w0")
        out.append(EdgeBatch(new, None, come, gone))
    return out


_ARRIVALS = f"""{I.EDGES}, {I.PAIRS}, x AS (SELECT u, v, greatest(u % 4, v % 4) AS b FROM p),
kept AS (SELECT u, v FROM x WHERE NOT (u % 37 = 0 AND u % 4 < b) AND NOT (v % 37 = 0 AND v % 4 < b)),
live AS (SELECT u, v FROM kept WHERE NOT (u % 37 = 0 AND u % 4 < 3) AND NOT (v % 37 = 0 AND v % 4 < 3))"""


def part_arrivals(spark: SparkSession, sf_dir: str) -> tuple[Graph, list[EdgeBatch]]:
    pairs = I.part_pairs(I.part_edges(spark, sf_dir)).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0.5).cast("float").alias("w0"))
    n = I.num_parts(spark, sf_dir)
    return Graph.with_capacity(spark, n), arrival_batches(pairs, n)


@query(f"WITH {_ARRIVALS} SELECT u AS src, v AS dst FROM live UNION ALL SELECT v, u FROM live")
def apply_vertex_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, batches = part_arrivals(spark, sf_dir)
    for b in batches:
        graph.apply(b)
    return graph.live_edges().select("src", "dst")


@query(f"""WITH {I.EDGES}, deg AS (SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE src = p_partkey) AS n FROM part)
SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM deg
UNION ALL SELECT (SELECT max(p_partkey) + 1 FROM part), (SELECT count(*) FROM e)""")
def graph_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = I.part_graph(spark, sf_dir)
    return graph.csr()[0]


@query(f"""WITH {I.HYPER_AFTER} SELECT string_agg(v, ' ' ORDER BY v) AS members, CAST(1 + any_value(h % 1000000000000) * 7919 % 97 AS INTEGER) AS w FROM i1 GROUP BY h""")
def apply_hyperedge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    h.apply(I.order_batch(spark, sf_dir, h))
    return h.members().join(h.live(), "h").select(F.array_join("members", " ").alias("members"), "w")


# hypergraphs


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS h, l_partkey AS v FROM lineitem)
SELECT a.h AS a, b.h AS b, count(*) AS overlap FROM i a JOIN i b ON a.v = b.v AND a.h < b.h GROUP BY 1, 2""")
def line_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegraph.hypergraph import pairs_of

    return pairs_of(I.incidences(spark, sf_dir))


_MASKS = ", ".join(f"({m}, {k})" for m, k in sorted(class_of_mask().items()))


def _triads_sql(inc: str, tag: str) -> str:
    """CTEs l<tag> (pairs), tri<tag> (triples with their regions) over incidences ``inc``."""
    return f"""s{tag} AS (SELECT h, count(*) AS size FROM {inc} GROUP BY h),
l{tag} AS (SELECT a.h AS a, b.h AS b, count(*) AS n FROM {inc} a JOIN {inc} b ON a.v = b.v AND a.h < b.h GROUP BY 1, 2),
core{tag} AS (SELECT a.h AS a, b.h AS b, c.h AS c, count(*) AS abc FROM {inc} a JOIN {inc} b ON a.v = b.v AND a.h < b.h JOIN {inc} c ON c.v = b.v AND b.h < c.h GROUP BY 1, 2, 3),
tri{tag} AS (
  SELECT x.a, x.b, y.b AS c, x.n AS ab, y.n AS bc, z.n AS ca, coalesce(k.abc, 0) AS abc, sa.size AS size_a, sb.size AS size_b, sc.size AS size_c
  FROM l{tag} x JOIN l{tag} y ON y.a = x.b JOIN l{tag} z ON z.a = x.a AND z.b = y.b
  LEFT JOIN core{tag} k ON k.a = x.a AND k.b = x.b AND k.c = y.b JOIN s{tag} sa ON sa.h = x.a JOIN s{tag} sb ON sb.h = x.b JOIN s{tag} sc ON sc.h = y.b)"""


def _motif_sql(tag: str) -> str:
    """A CTE m<tag> (bin, count)."""
    region = "(size_a - ab - ca + abc > 0)::INT + 2 * (size_b - ab - bc + abc > 0)::INT + 4 * (size_c - bc - ca + abc > 0)::INT + 8 * (ab > abc)::INT + 16 * (bc > abc)::INT + 32 * (ca > abc)::INT + 64 * (abc > 0)::INT"
    return f"m{tag} AS (SELECT k.bin, count(*) AS count FROM tri{tag} t JOIN masks k ON k.mask = {region} GROUP BY 1)"


_MASK_CTE = f"masks(mask, bin) AS (VALUES {_MASKS})"


@query(f"WITH {I.HYPER_BEFORE}, {_MASK_CTE}, {_triads_sql('i0', '0')}, {_motif_sql('0')} SELECT CAST(bin AS INTEGER) AS bin, count FROM m0")
def triad_count_h_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triads.compute(I.order_hypergraph(spark, sf_dir)).frame()


@query(f"""WITH {I.HYPER_BEFORE}, {_triads_sql('i0', '0')}, one AS (SELECT sum(size * (size - 1) * (size - 2) // 6) AS n FROM s0),
two AS (SELECT coalesce(sum(CASE WHEN n >= 2 AND a.size > n AND b.size > n THEN n * (n - 1) // 2 * (a.size - n) * (b.size - n) ELSE 0 END), 0) AS n FROM l0 JOIN s0 a ON a.h = l0.a JOIN s0 b ON b.h = l0.b),
three AS (SELECT coalesce(sum(CASE WHEN ab > abc AND bc > abc AND ca > abc THEN (ab - abc) * (bc - abc) * (ca - abc) ELSE 0 END), 0) AS n FROM tri0)
SELECT CAST(one.n AS BIGINT) AS type1, CAST(two.n AS BIGINT) AS type2, CAST(three.n AS BIGINT) AS type3 FROM one, two, three""")
def triad_count_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    row = tuple(triads.compute(h, kind).total for kind in ("type1", "type2", "type3"))
    return spark.createDataFrame([row], "type1 long, type2 long, type3 long")


@query(f"""WITH {I.HYPER_AFTER}, {_MASK_CTE}, ik AS (SELECT h, v FROM i0 WHERE h NOT IN (SELECT h FROM changed)),
{_triads_sql('i0', '0')}, {_triads_sql('i1', '1')}, {_triads_sql('ik', 'k')}, {_motif_sql('0')}, {_motif_sql('1')}, {_motif_sql('k')}
SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(m0.count, 0) AS before, coalesce(m0.count, 0) - coalesce(mk.count, 0) AS removed, coalesce(m1.count, 0) - coalesce(mk.count, 0) AS added, coalesce(m1.count, 0) AS after
FROM (SELECT DISTINCT bin FROM masks) b LEFT JOIN m0 ON m0.bin = b.bin LEFT JOIN m1 ON m1.bin = b.bin LEFT JOIN mk ON mk.bin = b.bin""")
def triad_count_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    result = triads.compute(h)
    before = result.counts
    triads.update(h, I.order_batch(spark, sf_dir, h), result)
    rows = [(b, before[b], result.removed.get(b, 0), result.added.get(b, 0), result.count(b)) for b in range(result.pattern.bins)]
    return spark.createDataFrame(rows, "bin int, before long, removed long, added long, after long")


@query(f"""WITH {I.HYPER_BEFORE}, {_triads_sql('i0', '0')}, hub AS (SELECT v FROM i0 GROUP BY v ORDER BY count(*) DESC, v LIMIT 1),
pat AS (
  SELECT 'line_graph_triangles' AS pattern, 0 AS bin, count(*) AS count FROM tri0
  UNION ALL SELECT 'strong_pairs', 0, count(*) FROM l0 WHERE n >= 2
  UNION ALL SELECT 'core_triads', least(abc, 2), count(*) FROM tri0 GROUP BY 2
  UNION ALL SELECT 'hub_pairs', 0, count(*) FROM i0 a JOIN i0 b ON a.v = b.v AND a.h < b.h JOIN hub ON hub.v = a.v)
SELECT pattern, CAST(bin AS INTEGER) AS bin, count FROM pat WHERE count > 0""")
def local_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    hub = h.incidence.groupBy("v").count().orderBy(F.desc("count"), "v").first().v
    out = None
    for p in (patterns.line_graph_triangles(), patterns.strong_pairs(2), patterns.core_triads(), patterns.hub_pairs(hub)):
        rows = patterns.compute(h, p).frame().select(F.lit(p.name).alias("pattern"), "bin", "count")
        out = rows if out is None else out.unionByName(rows)
    return out


def _hyper_sql(inc: str) -> str:
    """CTEs lg (src, dst, w), src (the source vertex), hd (h, dist) over incidences ``inc``."""
    return f"""source AS (SELECT min(v) AS v FROM i0),
hw AS (SELECT DISTINCT h, 1 + (h % 1000000000000) * 7919 % 97 AS w FROM {inc}),
lg AS (SELECT DISTINCT a.h AS src, b.h AS dst, hw.w FROM {inc} a JOIN {inc} b ON a.v = b.v AND a.h <> b.h JOIN hw ON hw.h = b.h),
hd(h, dist) USING KEY (h) AS (
  SELECT i.h, hw.w FROM {inc} i JOIN source ON i.v = source.v JOIN hw ON hw.h = i.h
  UNION SELECT x.dst, min(f.dist + x.w) FROM hd f JOIN lg x ON f.h = x.src LEFT JOIN recurring.hd r ON r.h = x.dst WHERE r.dist IS NULL OR f.dist + x.w < r.dist GROUP BY x.dst)"""


def _source(h) -> int:
    return h.incidence.agg(F.min("v")).first()[0]


@query(f"""WITH RECURSIVE {I.HYPER_BEFORE}, {_hyper_sql('i0')}
SELECT hw.h, CAST(coalesce(d.dist, {I.INFINITE_SQL}) AS BIGINT) AS distance,
  CAST(CASE WHEN d.dist IS NULL OR hw.h IN (SELECT i.h FROM i0 i JOIN source ON i.v = source.v) THEN -1
       ELSE (SELECT min(x.src) FROM lg x JOIN hd s ON s.h = x.src WHERE x.dst = hw.h AND s.dist + x.w = d.dist) END AS BIGINT) AS parent
FROM hw LEFT JOIN hd d ON d.h = hw.h""")
def hyper_sssp_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    return hyper_sssp.compute(h, _source(h)).hyperedges()


@query(f"""WITH RECURSIVE {I.HYPER_AFTER}, {_hyper_sql('i1')}
SELECT (SELECT string_agg(v, ' ' ORDER BY v) FROM i1 WHERE i1.h = hw.h) AS members, CAST(coalesce(d.dist, {I.INFINITE_SQL}) AS BIGINT) AS distance FROM hw LEFT JOIN hd d ON d.h = hw.h""")
def hyper_sssp_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    result = hyper_sssp.compute(h, _source(h))
    hyper_sssp.update(h, I.order_batch(spark, sf_dir, h), result)
    return h.members().join(result.hyperedges(), "h").select(F.array_join("members", " ").alias("members"), "distance")


@query(f"""WITH RECURSIVE {I.HYPER_BEFORE}, {_hyper_sql('i0')}
SELECT p_partkey AS v, CAST(CASE WHEN p_partkey = source.v THEN 0 ELSE coalesce(min(d.dist), {I.INFINITE_SQL}) END AS BIGINT) AS distance
FROM part JOIN source ON true LEFT JOIN i0 ON i0.v = p_partkey LEFT JOIN hd d ON d.h = i0.h GROUP BY p_partkey, source.v""")
def hyper_vertex_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    return hyper_sssp.compute(h, _source(h)).vertex_distances()


@query(f"""WITH RECURSIVE {I.EDGES}, {I.AFTER}, u AS (SELECT src, dst, 1 AS one FROM g), {_paths_sql('g', 'w0', '0')}, {_paths_sql('u', 'one', 'b')}
SELECT a.v, a.distance, a.parent, b.distance AS level FROM ({_all_parts('t0')}) a JOIN ({_all_parts('tb', '-1')}) b ON a.v = b.v""")
def multi_result_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, where="k % 10 <> 9")
    paths, levels = sssp.compute(graph, SOURCE), bfs.compute(graph, SOURCE)
    update(graph, I.reweighting(edges), paths, levels)
    return paths.tree().join(levels.tree().select("v", "level"), "v")


# similarity graphs and labels

_KNN = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
z AS (SELECT id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v),
s AS (
  SELECT a.id AS u, b.id AS v, least(1.0, list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y) / (a.norm * b.norm)) AS s
  FROM z a JOIN z b ON a.id <> b.id WHERE a.norm > 0 AND b.norm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS rank FROM s),
p AS (SELECT least(u, v) AS a, greatest(u, v) AS b, CAST(max(s) AS FLOAT) AS w FROM r WHERE rank <= 5 GROUP BY 1, 2),
knn AS (SELECT a AS src, b AS dst, w FROM p WHERE w > 0 UNION ALL SELECT b, a, w FROM p WHERE w > 0)"""


@query(f"WITH {_KNN} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM knn")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.similarity(spark, sf_dir).select("src", "dst", F.col("w").cast("double").alias("w"))


SIMILAR = Properties(directed=False, parallel=True, float_weights=True, semantics=Semantics.arrivals())


@query(f"""WITH RECURSIVE {_KNN},
vert AS (SELECT i.range AS id, CASE WHEN i.range % 10 = 0 AND label IS NOT NULL THEN label % 2 ELSE -1 END AS seed
  FROM range((SELECT max(vec_id) + 1 FROM embeddings)) i LEFT JOIN embeddings ON vec_id = i.range),
total AS (SELECT src, sum(CAST(w AS DOUBLE)) AS total FROM knn JOIN vert ON id = src WHERE seed < 0 GROUP BY src HAVING sum(CAST(w AS DOUBLE)) > 1e-10),
share AS (SELECT src, dst, CAST(w AS DOUBLE) / total AS p FROM knn JOIN total USING (src)),
st(r, id, label, moved) AS (
  SELECT 0, id, CAST(CASE WHEN seed < 0 THEN 0.5 ELSE seed END AS FLOAT), 1.0::DOUBLE FROM vert
  UNION ALL (
    WITH mean AS (SELECT src, CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(p * CAST(label AS DOUBLE)))) AS FLOAT) AS mean FROM share JOIN st ON st.id = dst GROUP BY src)
    SELECT r + 1, st.id, coalesce(mean, label), max(CAST(abs(coalesce(mean, label) - label) AS DOUBLE)) OVER () FROM st LEFT JOIN mean ON mean.src = st.id WHERE moved > 0.001::DOUBLE))
SELECT id AS v, round(CAST(label AS DOUBLE), 4) AS label FROM st WHERE r = (SELECT max(r) FROM st)""")
def label_propagation_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = I.table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1
    graph = Graph.from_edges(I.similarity(spark, sf_dir).where("src < dst"), n, SIMILAR, ["w"])
    seeds = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"))
    return labels.compute(graph, seeds, tolerance=1e-3).labels().select("v", F.round(F.col("label").cast("double"), 4).alias("label"))


def _arrival_labels_sql(t: int, seeds: str, rows: str) -> str:
    """CTEs for batch ``t`` of the two: ``e``: live arcs, ``a``: arrived, ``add``: appended arcs, from which first labels ``first``, the rows ``in``
    before the rounds (``rows`` selects them) and ``st`` after each; ``end``: the state. ``seeds``: (id, seed) of all that have ever arrived."""
    return f"""th{t} AS (SELECT avg(CAST(w AS DOUBLE)) AS th FROM e{t}),
strong{t} AS (SELECT src, dst FROM add{t} JOIN th{t} ON w > th WHERE src IN (SELECT id FROM a{t}) AND dst IN (SELECT id FROM a{t})),
c{t}(id, component) USING KEY (id) AS (
  SELECT id, id FROM a{t}
  UNION SELECT x.dst, min(f.component) FROM c{t} f JOIN strong{t} x ON x.src = f.id JOIN recurring.c{t} o ON o.id = x.dst WHERE f.component < o.component GROUP BY x.dst),
to{t} AS (
  SELECT c.component, sum(CASE WHEN s.seed = 0 THEN CAST(round_even(CAST(w AS DOUBLE) * 4294967296, 0) AS BIGINT) ELSE 0 END) / 4294967296.0::DOUBLE AS l0,
         sum(CASE WHEN s.seed = 1 THEN CAST(round_even(CAST(w AS DOUBLE) * 4294967296, 0) AS BIGINT) ELSE 0 END) / 4294967296.0::DOUBLE AS l1
  FROM add{t} x JOIN c{t} c ON c.id = x.src JOIN {seeds} s ON s.id = x.dst AND s.seed >= 0 GROUP BY 1),
first{t} AS (SELECT a.id, a.seed, CAST(CASE WHEN a.seed >= 0 THEN a.seed WHEN l0 + l1 > 1e-10 THEN l1 / (l0 + l1) ELSE 0.5 END AS FLOAT) AS label
  FROM a{t} a JOIN c{t} c ON c.id = a.id LEFT JOIN to{t} w ON w.component = c.component),
in{t} AS ({rows}),
st{t}(r, id, label, seed, active, front, n) AS (
  SELECT 0, id, label, seed, active, front, sum(CAST(front AS INTEGER)) OVER () FROM in{t}
  UNION ALL (
    WITH mean AS (
      SELECT f.id, sum(CAST(x.w AS DOUBLE)) AS ww, sum(CAST(x.w AS DOUBLE) * CAST(o.label AS DOUBLE)) AS wx FROM st{t} f JOIN e{t} x ON x.src = f.id JOIN st{t} o ON o.id = x.dst WHERE f.front GROUP BY f.id),
    step AS (
      SELECT s.*, CASE WHEN m.id IS NULL THEN s.label ELSE CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        (CAST(s.label AS DOUBLE) + CASE WHEN ww > 1e-10 THEN wx / ww ELSE CAST(s.label AS DOUBLE) END) / 2)) AS FLOAT) END AS now
      FROM st{t} s LEFT JOIN mean m ON m.id = s.id WHERE s.n > 0),
    moved AS (SELECT id FROM step WHERE front AND CAST(abs(now - label) AS DOUBLE) > 0.01::DOUBLE),
    wake AS (SELECT id FROM moved UNION SELECT x.dst FROM moved JOIN e{t} x ON x.src = moved.id),
    nxt AS (SELECT r + 1 AS r, id, now, seed, active, active AND seed < 0 AND id IN (SELECT id FROM wake) AS front FROM step)
    SELECT *, sum(CAST(front AS INTEGER)) OVER () FROM nxt)),
end{t} AS (SELECT id, CASE WHEN seed >= 0 THEN CAST(seed AS FLOAT) ELSE label END AS label, seed, active FROM st{t} WHERE r = (SELECT max(r) FROM st{t}))"""


_SECOND_ARRIVALS = """SELECT id, label, seed, id NOT IN (SELECT id FROM gone) AS active, seed < 0 AND id NOT IN (SELECT id FROM gone) AND id IN (SELECT id FROM touched1) AS front FROM end0
  UNION ALL SELECT id, label, seed, true, seed < 0 FROM first1"""


@query(f"""WITH RECURSIVE {_KNN}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
vert AS (SELECT range AS id, CASE WHEN range % 10 = 0 THEN CAST(range % 20 / 10 AS INTEGER) ELSE -1 END AS seed, range % 2 AS b FROM range((SELECT n FROM n))),
a0 AS (SELECT id, seed FROM vert WHERE b = 0), a1 AS (SELECT id, seed FROM vert WHERE b = 1),
gone AS (SELECT id FROM vert WHERE b = 0 AND id % 37 = 0),
add0 AS (SELECT * FROM knn WHERE src % 2 = 0 AND dst % 2 = 0), e0 AS (SELECT * FROM add0),
add1 AS (SELECT * FROM knn WHERE (src % 2 = 1 OR dst % 2 = 1) AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
e1 AS (SELECT * FROM e0 WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION ALL SELECT * FROM add1),
{_arrival_labels_sql(0, 'a0', 'SELECT id, label, seed, true AS active, seed < 0 AS front FROM first0')},
touched1 AS (SELECT dst AS id FROM e0 WHERE src IN (SELECT id FROM gone) UNION SELECT id FROM a1 UNION SELECT src FROM add1),
{_arrival_labels_sql(1, 'vert', _SECOND_ARRIVALS)}
SELECT vert.id AS v, round(CAST(coalesce(label, 0.5) AS DOUBLE), 4) AS label FROM vert LEFT JOIN end1 ON end1.id = vert.id""")
def label_propagation_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = I.table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1
    graph = Graph.with_capacity(spark, n)
    result = labels.compute(graph, update_schedule="damped", tolerance=1e-2)
    for b in arrival_batches(I.similarity(spark, sf_dir).where("src < dst").withColumnRenamed("w", "w0"), n, 2):
        labels.update(graph, b, result)
    return result.labels().select("v", F.round(F.col("label").cast("double"), 4).alias("label"))


# views, deltas and generators


@query(f"WITH {I.HYPER_BEFORE} SELECT h, string_agg(v, ' ' ORDER BY v) AS members FROM i0 GROUP BY h")
def hypergraph_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.order_hypergraph(spark, sf_dir).members().select("h", F.array_join("members", " ").alias("members"))


@query(f"WITH {I.HYPER_BEFORE} SELECT v, string_agg(h, ' ' ORDER BY h) AS hyperedges FROM i0 GROUP BY v")
def hypergraph_of_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.order_hypergraph(spark, sf_dir).hyperedges_of().select("v", F.array_join("hyperedges", " ").alias("hyperedges"))


@query(f"""WITH {I.EDGES} SELECT src, dst, CASE WHEN k % 10 IN (0, 5) THEN 'dearer' ELSE 'cheaper' END AS change FROM e WHERE k % 10 IN (0, 5, 9) OR (k % 10 = 6 AND w0 > 1)""")
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = I.part_graph(spark, sf_dir, where="k % 10 <> 9")
    dearer, cheaper = sssp.price_changes(graph.commit(I.reweighting(edges)), 0)
    return dearer.withColumn("change", F.lit("dearer")).unionByName(cheaper.withColumn("change", F.lit("cheaper")))


_PAIRS_OF = "{1} AS (SELECT a.h AS a, b.h AS b FROM {0} a JOIN {0} b ON a.v = b.v AND a.h < b.h GROUP BY 1, 2)"


@query(f"""WITH {I.HYPER_AFTER}, {_PAIRS_OF.format('i0', 'l0')}, {_PAIRS_OF.format('i1', 'l1')}
SELECT a, b, (SELECT count(*) FROM (SELECT * FROM l1 EXCEPT SELECT * FROM l0)) AS gained FROM (SELECT * FROM l0 EXCEPT SELECT * FROM l1)""")
def line_graph_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = I.order_hypergraph(spark, sf_dir)
    lost, gained = h.commit(I.order_batch(spark, sf_dir, h)).pair_delta()
    return lost.withColumn("gained", F.lit(gained.count()))


def _draw_sql(seed: int, *keys: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13) AS BIGINT)::DOUBLE / {16**13}.0::DOUBLE)"


@query(f"""WITH d AS (SELECT range AS seq, CAST(floor({_draw_sql(7, 'range', "'s'")} * 500) AS BIGINT) AS s, CAST(floor({_draw_sql(7, 'range', "'t'")} * 499) AS BIGINT) AS t FROM range(2000))
SELECT seq, s AS src, (s + 1 + t) % 500 AS dst FROM d""")
def generate_random_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegraph.sources.generators import random_pairs

    return random_pairs(spark, 500, 2000, 7)


@query(f"""WITH a AS (
  SELECT range AS id, CAST(floor({_draw_sql(42, 'range', "'class'")} * 2) AS INTEGER) AS class, {_draw_sql(42, 'range', "'truth'")} < 0.05::DOUBLE AS first,
         CAST(least(1 + floor({_draw_sql(42, 'range', "'batch'")} * 3), 3) AS INTEGER) AS later, {_draw_sql(42, 'range', "'label'")} < 0.05::DOUBLE AS labelled FROM range(1000))
SELECT id, class, CASE WHEN first THEN 0 ELSE later END AS batch, CAST(CASE WHEN first OR labelled THEN class ELSE -1 END AS INTEGER) AS label FROM a""")
def generate_vertex_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegraph.sources.generators import vertex_arrivals

    return vertex_arrivals(spark, 1000, 4, 4, ground_truth_fraction=0.05).vertices.select("id", "class", "batch", F.col("label").cast("int").alias("label"))
