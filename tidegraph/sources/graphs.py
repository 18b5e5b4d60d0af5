"""Readers and writers of graphs: edge lists, Matrix Market, text CSR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.errors import FileFormat, InvalidArgument
from tidegraph.functions.columns import both_ways
from tidegraph.functions.ordinals import numbered
from tidegraph.graph import Graph, Properties, weight_names
from tidegraph.sources.lines import lines, refuse, tokens, whole, write_lines
from tidegraph.store import materialize

LIST_BLANKS = r"[ \t\r,]+"


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) from a digest of ``seed`` and ``keys``; the same in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def drawn_weights(df: DataFrame, names: list[str], low: int, high: int, seed: int) -> DataFrame:
    """Adds whole weights in [low, high] drawn for each (src, dst)."""
    for n in names:
        df = df.withColumn(n, (low + F.floor(draw(seed, "src", "dst", F.lit(n)) * (high - low + 1))).cast("int"))
    return df


def _vertex_count(edges: DataFrame) -> int:
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if top is None else top + 1


def read_edge_list(
    spark: SparkSession, path: str, num_weights: int = 0, ids: str = "compact", index_base: int = 0, symmetrize: bool = False, drop_self_loops: bool = True,
    duplicates: str = "merge", float_weights: bool = False, properties: Properties | None = None, random_weights: tuple[int, int, int, int] | None = None,
) -> tuple[Graph, DataFrame]:
    """A graph and its id table (id, external). Tokens are split by blanks and commas; ``#`` and ``%`` begin comments.

    ``ids``: ``compact`` numbers the remaining ids in ascending order, ``as_is`` subtracts ``index_base``. ``duplicates``: ``merge`` keeps
    the last of a pair, ``keep`` keeps all. ``random_weights``: (number, low, high, seed).
    """
    if ids not in ("compact", "as_is") or duplicates not in ("merge", "keep"):
        raise InvalidArgument("ids are compact or as_is, duplicates merge or keep")
    rows = tokens(lines(spark, path).where(~F.substring(F.ltrim("value"), 1, 1).isin("#", "%")), LIST_BLANKS)
    number = F.regexp_replace(F.col("t")[0], r"^\+", ""), F.regexp_replace(F.get("t", F.lit(1)), r"^\+", "")
    names = weight_names(num_weights)
    weight = [(F.get("t", F.lit(2 + i)).try_cast("float") if float_weights else whole(F.get("t", F.lit(2 + i)))).alias(n) for i, n in enumerate(names)]
    rows = materialize(rows.select("line", "value", whole(number[0]).alias("src"), whole(number[1]).alias("dst"), *weight), "edge-list")
    bad = F.col("src").isNull() | F.col("dst").isNull()
    for n in names:
        bad |= F.col(n).isNull()
    refuse(rows, bad, path, f"two ids and {num_weights} weights are needed")
    edges = rows.drop("value")
    if drop_self_loops:
        edges = edges.where("src <> dst")
    if symmetrize:
        edges = both_ways(edges)
    if duplicates == "merge":
        edges = edges.groupBy("src", "dst").agg(F.max_by(F.struct("line", *names), "line").alias("r")).select("src", "dst", "r.*")
    if ids == "compact":
        used = edges.select(F.col("src").alias("external")).union(edges.select(F.col("dst").alias("external"))).distinct()
        table = materialize(numbered(used, ["external"], "id"), "ids")
        for c in ("src", "dst"):
            edges = edges.join(table.withColumnsRenamed({"external": c, "id": f"{c}_id"}), c).drop(c).withColumnRenamed(f"{c}_id", c)
    else:
        edges = edges.withColumn("src", F.col("src") - index_base).withColumn("dst", F.col("dst") - index_base)
        table = spark.range(_vertex_count(edges)).select("id", (F.col("id") + index_base).alias("external"))
    if random_weights:
        k, low, high, seed = random_weights
        names = weight_names(k)
        edges = drawn_weights(edges, names, low, high, seed)
    p = properties or Properties(parallel=duplicates == "keep", float_weights=float_weights)
    return Graph.from_edges(edges, table.count() if ids == "compact" else None, p, names, order="line"), table


def write_edge_list(graph: Graph, path: str, single: bool = True) -> None:
    """``src dst w0 ..`` by source and row order; each edge of an undirected graph in both directions."""
    key = ["src", "pos"] if graph.properties.parallel else ["src", "dst", "pos"]
    write_lines(graph.edges.orderBy(*key).select(F.concat_ws(" ", "src", "dst", *graph.weights).alias("value")), path, single)


FIELDS = ("real", "double", "integer", "complex", "pattern")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


def read_matrix_market(spark: SparkSession, path: str, weights: str = "values", random: tuple[int, int, int, int] = (1, 1, 100, 12345), keep_self_loops: bool = False) -> Graph:
    """A square coordinate matrix. Files that aren't general give both directions of entries off the diagonal; the last entry of a pair
    wins. ``weights``: ``values`` (whole numbers), ``none``, or ``random``: (number, low, high, seed)."""
    rows = materialize(lines(spark, path), "matrix")
    first = rows.where("line = 0").first()
    head = first.value.lower().split() if first else []
    if len(head) != 5 or head[:3] != ["%%matrixmarket", "matrix", "coordinate"] or head[3] not in FIELDS or head[4] not in SYMMETRIES:
        raise FileFormat(f"{path}:1: not the header of a coordinate matrix")
    body = tokens(rows.where("line > 0 AND substring(value, 1, 1) <> '%'"))
    size = body.orderBy("line").first()
    if size is None or len(size.t) != 3 or not all(x.isdigit() for x in size.t):
        raise FileFormat(f"{path}: no size line")
    n, m, entries = map(int, size.t)
    if n != m:
        raise FileFormat(f"{path}:{size.line + 1}: {n} rows and {m} columns; a graph's matrix is square")
    cells = body.where(F.col("line") > size.line)
    cells = cells.select("line", "value", (whole(F.col("t")[0]) - 1).alias("src"), (whole(F.get("t", F.lit(1))) - 1).alias("dst"), F.get("t", F.lit(2)).try_cast("double").alias("x"))
    cells = materialize(cells, "entries")
    if cells.count() != entries:
        raise FileFormat(f"{path}: {cells.count()} entries, {entries} announced")
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= n)
    refuse(cells, bad if head[3] == "pattern" else bad | F.col("x").isNull(), path, "not an entry")
    edges = cells.select("line", "src", "dst", "x")
    if head[4] != "general":
        edges = both_ways(edges)
    if not keep_self_loops:
        edges = edges.where("src <> dst")
    edges = edges.groupBy("src", "dst").agg(F.max_by("x", "line").alias("x"), F.max("line").alias("line"))
    names: list[str] = []
    if weights == "values" and head[3] != "pattern":
        names, edges = ["w0"], edges.withColumn("w0", F.col("x").cast("int"))
    elif weights == "random":
        names = weight_names(random[0])
        edges = drawn_weights(edges, names, *random[1:])
    return Graph.from_edges(edges, n, Properties(), names, order="line")


def write_matrix_market(graph: Graph, path: str, weight: int | None = None, single: bool = True) -> None:
    """A general matrix, field pattern or (with ``weight``, a weight's number) integer."""
    spark, n, m = graph.spark, graph.num_vertices, graph.edges.count()
    head = [(0, 0, 0, f"%%MatrixMarket matrix coordinate {'pattern' if weight is None else 'integer'} general"), (1, 0, 0, f"{n} {n} {m}")]
    value = [(F.col("src") + 1), (F.col("dst") + 1)] + ([] if weight is None else [F.col(f"w{weight}")])
    body = graph.edges.select(F.lit(2).cast("long").alias("part"), "src", "dst", F.concat_ws(" ", *value).alias("value"))
    write_lines(spark.createDataFrame(head, "part long, src long, dst long, value string").unionByName(body).orderBy("part", "src", "dst").select("value"), path, single)


def read_csr_triplet(spark: SparkSession, prefix: str, num_weights: int | None = None, properties: Properties | None = None) -> Graph:
    """``<prefix>RowPtr.txt``, ``<prefix>ColInd.txt`` and ``<prefix>Values.txt``: offsets, neighbours, and each edge's weights."""
    ptr, col, val = (materialize(tokens(lines(spark, f"{prefix}{x}.txt")), x) for x in ("RowPtr", "ColInd", "Values"))
    ptr = numbered(ptr.select("line", "value", whole(F.col("t")[0]).alias("at")), ["line"], "v")
    col = numbered(col.select("line", "value", whole(F.col("t")[0]).alias("dst")), ["line"], "e")
    refuse(ptr, F.col("at").isNull(), f"{prefix}RowPtr.txt", "not an offset")
    first = val.orderBy("line").first()
    k = len(first.t) if first else num_weights or 0
    val = numbered(val.select("line", "value", "t"), ["line"], "e")
    names = weight_names(k)
    w = [whole(F.get("t", F.lit(i))).alias(n) for i, n in enumerate(names)]
    bad = F.size("t") != k
    for x in w:
        bad |= x.isNull()
    refuse(val, bad, f"{prefix}Values.txt", f"{k} weights are needed")
    n, m = ptr.count() - 1, col.count()
    nxt = ptr.select((F.col("v") - 1).alias("v"), F.col("at").alias("to"))
    rows = ptr.join(nxt, "v").select("v", "at", "to")
    ends = ptr.agg(F.min_by("at", "v").alias("first"), F.max_by("at", "v").alias("last")).first()
    if n < 0 or ends.first != 0 or ends.last != m or rows.where("at > to").head(1) or val.count() != m:
        raise FileFormat(f"{prefix}: the three files don't agree")
    refuse(col, F.col("dst").isNull() | (F.col("dst") < 0) | (F.col("dst") >= n), f"{prefix}ColInd.txt", "not a vertex")
    owner = rows.where("to > at").select(F.col("v").alias("src"), F.explode(F.sequence("at", F.col("to") - 1)).alias("e"))
    edges = owner.join(col.select("e", "dst"), "e").join(val.select("e", *w), "e")
    return Graph.from_edges(edges, n, properties or Properties.multi_objective(), names, order="e")


def write_csr_triplet(graph: Graph, prefix: str, single: bool = True) -> None:
    ptr, cells = graph.csr()
    write_lines(ptr.orderBy("id").select(F.col("row_ptr").cast("string").alias("value")), f"{prefix}RowPtr.txt", single)
    write_lines(cells.orderBy("e").select(F.col("dst").cast("string").alias("value")), f"{prefix}ColInd.txt", single)
    write_lines(cells.orderBy("e").select(F.concat_ws(" ", *graph.weights).alias("value")), f"{prefix}Values.txt", single)


def widen(graph: Graph, total: int, low: int = 1, high: int = 100, seed: int = 12345) -> Graph:
    """More objectives, up to ``total``, with drawn weights."""
    names = weight_names(total)[graph.num_weights :]
    return Graph(materialize(drawn_weights(graph.edges, names, low, high, seed), "edges"), graph.num_vertices, total, graph.properties, graph.next_pos, graph.version, graph.status)
