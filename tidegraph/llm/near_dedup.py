"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star candidates, prefixes of rare shingles for the rest, exact confirmation."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import batch, bounded_batches, materialize, spare, strings, word_lists
from tidegraph.operators.components import connected_components

BINS = 128
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


PROBES = np.random.default_rng(42).integers(0, BINS, (BINS, 2048))


class _Words(dict):
    """64-bit hashes of words, kept while they take less than 16 MB."""

    used = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self.used += 180 + len(word)
            if self.used > 16 << 20:
                self.clear()
                self.used = 0
            self[word] = h
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words.

    ASCII letters are lowered; words are what ASCII white space separates; with fewer words than ``width`` the whole sequence is one.
    """

    def __init__(self, width: int):
        self.width, self.get = width, _Words().__getitem__

    def __call__(self, text: str) -> np.ndarray:
        h = np.concatenate([np.zeros(0, np.uint64), *[np.fromiter(map(self.get, w), np.uint64, len(w)) for w in word_lists(text.encode().lower())]])
        n = len(h)
        if not n:
            return h
        k = min(self.width, n)
        out = h[: n - k + 1].copy()
        for j in range(1, k):
            out = _mixed(out * _A + h[j : n - k + 1 + j] * _B)
        if k < self.width:
            out = out ^ np.uint64(0x5851F42D4C957F2D + k)
        return np.unique(_mixed(out))


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash in each of 128 bins of a set; an empty bin takes the value of the first full one along its own fixed random path."""
    edges = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    full = np.diff(np.append(edges, len(shingles))) > 0
    out = shingles[np.minimum(edges, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        source = np.empty(len(empty), np.int64)
        open_ = np.arange(len(empty))
        at = 0
        while len(open_) and at < PROBES.shape[1]:
            step = 8 if at < 64 else 256
            paths = PROBES[empty[open_], at : at + step]
            hit = full[paths]
            found = hit.any(1)
            source[open_[found]] = paths[found, hit[found].argmax(1)]
            open_ = open_[~found]
            at += step
        if len(open_):  # all but impossible: 2,048 draws that miss
            source[open_] = np.flatnonzero(full)[0]
        out[empty] = out[source]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins."""
    parts = signature[: len(signature) // rows * rows].reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64) * _B + np.uint64(1)
    for j in range(rows):
        key = _mixed(key * _A + parts[:, j])
    return key


def signed(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shingle = Shingler(width)
        for b in batches:
            schema = pa.schema([b.schema.field("doc_id"), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
            n, d, keys = [], [], []
            for text in strings(b.column("text")):
                s = shingle(text)
                n.append(len(s))
                d.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(band_keys(one_permutation(s), rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            d = np.array(d, np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield batch(schema, [b.column("doc_id"), n, d[:, 0], d[:, 1], bands])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shingle = Shingler(width)
        for b in batches:
            schema = pa.schema([b.schema.field("doc_id"), ("set", pa.binary())])
            yield batch(schema, [b.column("doc_id"), [shingle(t).tobytes() for t in strings(b.column("text"))]])

    return docs.mapInArrow(run, f"doc_id {kind}, set binary")


def buckets(classes: DataFrame) -> DataFrame:
    """(rep, n, key, m): the places of classes in buckets of m >= 2 of them."""
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    full = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return rows.join(full, F.col("key") == F.col("k")).drop("k")


def stars(places: DataFrame) -> DataFrame:
    """(rep, n, hub, hub_n): each member of a bucket with the bucket's hub, the member that meets most others in all its buckets.

    In a group of near copies that is one of the least changed, for all bands alike, so it is similar to as many as can be. Hubs are maxima, reduced
    before the shuffle: a bucket with a third of all rows is one row from each task, and makes as many pairs as it has members.
    """
    met = places.groupBy(F.col("rep").alias("r")).agg(F.sum("m").alias("met"))
    rank = F.struct("met", F.xxhash64("rep").alias("o"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    own = places.join(met, F.col("rep") == F.col("r")).groupBy(F.col("key").alias("k")).agg(F.max(rank).alias("h")).select("k", "h.hub", "h.hub_n")
    return places.join(own, F.col("key") == F.col("k")).where("rep <> hub").select("rep", "n", "hub", "hub_n")


def alike_in_size(percent: int) -> Column:
    """Whether the sizes of two sets alone allow the similarity."""
    return F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent


def ends(pairs: DataFrame) -> DataFrame:
    """(u, v), u < v, each pair of (rep, hub) once."""
    return pairs.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(doc_id, s, n, g): the shingles of each set, with a digest that tells the sets of one id apart and the set's size."""
    kind = sets.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            schema = pa.schema([b.schema.field("doc_id"), ("s", pa.int64()), ("n", pa.int64()), ("g", pa.int64())])
            for i, x in enumerate(b.column("set")):
                raw = x.as_buffer()
                g = np.frombuffer(raw, np.int64)
                yield batch(schema, [b.column("doc_id").take(pa.array(np.full(len(g), i))), np.full(len(g), np.uint64(xxhash.xxh64_intdigest(raw))).view(np.int64), np.full(len(g), len(g)), g])

    return sets.mapInArrow(run, f"doc_id {kind}, s long, n long, g long")


def open_members(places: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, part): the members of buckets of three or more that still hold several components, with theirs; stars compare two with each other
    always."""
    part = labels.select(F.col("id").alias("i"), "component")
    rows = places.where("m > 2").select("rep", "key").join(part, F.col("rep") == F.col("i"), "left").select("rep", "key", F.coalesce("component", "rep").alias("part"))
    several = rows.groupBy(F.col("key").alias("k")).agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").select("k")
    return rows.join(several, F.col("key") == F.col("k"), "left_semi").select("rep", "part").distinct()


def prefixes(sets: DataFrame, parts: DataFrame, percent: int, frequent: int) -> DataFrame:
    """(rep, n, part, g, df, often): for each of ``sets`` the shingles by which it can meet a similar set; ``parts``: (rep, part).

    Shingles are ordered by the number of sets that hold them. The first shingle that two similar sets share is then among the first
    n - ceil(n * percent / 100) + 1 of both, and those of one set alone come first. ``often``: the set's shingles that more than ``frequent`` sets hold.
    """
    rows = materialize(shingle_rows(sets), "near-shingles")
    held = materialize(rows.groupBy(F.col("g").alias("of")).agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-held")
    many = F.col("df") > frequent
    both = rows.join(held.where(~many), F.col("g") == F.col("of")).unionByName(rows.join(held.where(many), F.col("g") == F.col("of")))
    one = both.groupBy("doc_id", "s", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared"))
    length = (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    often = F.transform(F.filter("shared", lambda x: x.df > frequent), lambda x: x.g)
    one = one.where(length > 0).select("doc_id", "n", often.alias("often"), F.explode(F.slice("shared", F.lit(1), length)).alias("at")).join(parts, F.col("doc_id") == F.col("rep"))
    at = one.select("rep", "n", "part", F.col("at.g").alias("g"), F.col("at.df").alias("df"), F.when(F.col("at.df") > frequent, F.col("often")).alias("often"))
    at = materialize(at, "near-prefixes")
    several = at.groupBy(F.col("g").alias("of")).agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").select("of")
    return at.join(several, F.col("g") == F.col("of"), "left_semi")


def rare_pairs(at: DataFrame, percent: int, frequent: int) -> DataFrame:
    """Pairs (u, v) of different components that share one of their rare shingles: at most ``frequent`` partners for each."""
    few = at.where(F.col("df") <= frequent).select("rep", "n", "g", "part")
    other = few.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("g").alias("of"), F.col("part").alias("hub_part"))
    return ends(few.join(other, (F.col("g") == F.col("of")) & (F.col("rep") < F.col("hub"))).where("part <> hub_part").where(alike_in_size(percent)))


def frequent_links(at: DataFrame, percent: int, frequent: int, block: int = 256) -> DataFrame:
    """Links (u, v) between different components for similar sets that share no rare shingle, so that frequent ones make up all they share.

    Sets that meet in a frequent shingle are dealt to blocks of about ``block``, and blocks are compared as matrices in a task. Two blocks
    of the shingle's largest component aren't compared. A task passes on no more links than join its sets, not all pairs.
    """
    rows = at.where(F.col("df") > frequent).select("rep", "n", "part", "g", "often")
    sizes = materialize(rows.groupBy("g", "part").count(), "near-parts")
    main = sizes.groupBy(F.col("g").alias("of")).agg(F.max(F.struct("count", "part")).alias("most"), F.sum("count").alias("m")).select("of", F.col("most.part").alias("main"), (F.floor(F.col("m") / block) + 1).alias("blocks"))
    dealt = rows.join(main, F.col("g") == F.col("of")).select("rep", "n", "part", "g", "often", (F.col("part") == F.col("main")).alias("main"), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"))
    kind = at.schema["rep"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.asarray(x, np.int64) for x in pdf["often"]])
        at_, code = np.unique(codes, return_inverse=True)
        raw = pickle.dumps((pdf["rep"].tolist(), pdf["part"].tolist(), pdf["n"].to_numpy(np.int64), np.array([len(x) for x in pdf["often"]]), at_, code.astype(np.int32)))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "main": [pdf["main"].iloc[0]], "block": [pdf["block"].iloc[0]], "sets": [zstandard.compress(raw, 1)]})

    packed = materialize(dealt.groupBy("g", "main", "block").applyInPandas(pack, "g long, main boolean, block long, sets binary"), "near-blocks")
    left = packed.where("NOT main").select(F.col("g").alias("of"), F.col("block").alias("i"), F.col("sets").alias("own"))
    met = left.join(packed, (F.col("g") == F.col("of")) & (F.col("main") | (F.col("i") <= F.col("block")))).select("own", "sets")
    schema = pa.schema([("u", _arrow(kind)), ("v", _arrow(kind))])

    def compare(batches):
        for b in batches:
            for own, sets in zip(b.column("own"), b.column("sets")):
                (ids, part, n, m, of), (ids2, part2, n2, m2, of2) = (_matrix(x.as_py()) for x in (own, sets))
                both, inv = np.unique(np.concatenate([of, of2]), return_inverse=True)
                a = np.zeros((len(ids), len(both)), np.float32)
                c = np.zeros((len(ids2), len(both)), np.float32)
                a[:, inv[: len(of)]], c[:, inv[len(of) :]] = m, m2
                shared = (a @ c.T).astype(np.int64)
                u, v = np.nonzero(100 * shared >= percent * (n[:, None] + n2[None, :] - shared))
                up: dict = {}

                def root(x):
                    while up.setdefault(x, x) != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                found = []
                for i, j in zip(u.tolist(), v.tolist()):
                    x, y = root(part[i]), root(part2[j])
                    if x != y:
                        up[x] = y
                        found.append((ids[i], ids2[j]))
                if found:
                    yield batch(schema, list(zip(*found)))

    return met.repartition(F.xxhash64("own", "sets")).mapInArrow(compare, f"u {kind}, v {kind}")


def _matrix(packed: bytes) -> tuple:
    """Ids, components, sizes, 0/1 rows and the shingles of their columns."""
    ids, part, n, sizes, of, code = pickle.loads(zstandard.decompress(packed))
    m = np.zeros((len(ids), len(of)), np.float32)
    m[np.repeat(np.arange(len(ids)), sizes), code] = 1
    return ids, part, n, m, of


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar: 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("lid"), F.col("set").alias("a"))
    right = sets.select(F.col("doc_id").alias("rid"), F.col("set").alias("b"))
    both = pairs.join(left, F.col("u") == F.col("lid")).join(right, F.col("v") == F.col("rid")).select("u", "v", "a", "b")
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("u", "v")]

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("a"), b.column("b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both_n = len(x) + len(y)
                merged = np.concatenate([x, y])
                merged.sort()
                shared = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * shared >= percent * (both_n - shared))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, ", ".join(kinds))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 4, frequent: int = 64) -> DataFrame:
    """Components of documents linked by shingle sets with Jaccard similarity of ``percent`` / 100 or more.

    Equal sets are one class first, so copies cost nothing more. Classes are banded by 128 densified bins in bands of ``rows`` (32 bands
    of 4: a pair at 0.8 shares no bucket once in 20 million). A bucket makes a star around its hub, and pairs are confirmed on full sets;
    this joins the large groups with as many pairs as members. Members of buckets that still hold several components are then compared by
    their rarest shingles (``prefixes``), an exact filter: in pairs, where at most ``frequent`` sets hold the shingle, else in blocks inside
    tasks. Two similar sets that share a bucket are always joined.

    Texts are read twice: for signatures, and for the sets of those that have a candidate. Sets travel as sorted 64-bit hashes.
    A null or empty text and one of white space has an empty set and is linked with nothing. Rows that repeat an id are one node. A null
    id is linked with nothing, its component is null. An empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_shingles, component_id (smallest id reachable), kept.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = materialize(signed(src, width, rows), "near-signatures")
    linked = marks.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
    places = materialize(buckets(classes), "near-buckets")
    ids = materialize(places.select(F.col("rep").alias("i")).distinct(), "near-ids")  # its size is known before the join
    sets = materialize(shingle_sets(src.join(ids, F.col("doc_id") == F.col("i"), "left_semi"), width), "near-sets")
    names = classes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep")
    of_class = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    several = linked.groupBy(F.col("doc_id").alias("s")).agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("s")
    own = linked.join(several, F.col("doc_id") == F.col("s"), "left_semi").join(names, of_class)  # one id, several sets
    links = confirmed(ends(stars(places).where(alike_in_size(percent))), sets, percent)
    labels = materialize(connected_components(links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))), "near-labels")
    rest = materialize(open_members(places, labels), "near-open")
    if not rest.isEmpty():
        open_sets = sets.join(rest.select(F.col("rep").alias("i")), F.col("doc_id") == F.col("i"), "left_semi").dropDuplicates(["doc_id", "set"])
        at = prefixes(open_sets, rest, percent, frequent)
        found = confirmed(rare_pairs(at, percent, frequent), sets, percent).unionByName(frequent_links(at, percent, frequent))
        labels = materialize(connected_components(found.unionByName(labels.select(F.col("id").alias("u"), F.col("component").alias("v")))), "near-labels")
    out = marks.join(names, of_class, "left").join(labels, F.col("rep") == F.col("id"), "left")
    alone = F.col("n") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that another of their group stands for; see ``near_duplicates``.

    The row with the smallest id of a group stays. Of rows that repeat an id, which are one node, the one with the smallest text hash
    stays. Rows with a null id and those without words stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "near-gone")
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    twice = materialize(several, "near-repeats")
    own, nth = (spare(n, docs) for n in ("own", "nth"))
    named = lambda ids: ids.select(F.col("id").alias(own))
    left = docs.join(named(gone), F.col(id_col) == F.col(own), "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(named(twice), F.col(id_col) == F.col(own), "left_anti")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))
    more = left.join(named(twice), F.col(id_col) == F.col(own), "left_semi").withColumn(nth, rank).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(more)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
