"""Context-triggered piecewise hashes of texts, and their likeness by edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import batch, bounded_batches, groups, strings

CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW = 7
LEAST = 4  # smallest block size
LONG = 64  # chunks aimed at: more than half of these, and this many at most
COMMON = 4  # a likeness above 0 needs so many equal chunks in a row
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _need(n: int) -> None:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            p = np.full(max(n, 2 * len(_powers[i])), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)


def signature(raw: bytes) -> tuple[int, str, str]:
    """Block size, chunk signature at it and at its double.

    A chunk ends where the low bits of a hash of the last seven bytes are all set, so boundaries depend on nearby bytes alone and those
    at the double are among those at the block size. Each chunk gives one of 64 signs. The block size follows from the length and is
    doubled while there are too many chunks, halved while there are too few (texts that repeat themselves).
    """
    n = len(raw)
    if not n:
        return LEAST, "", ""
    x = np.frombuffer(raw, np.uint8)
    wide = x.astype(np.uint32)
    h = wide.copy()
    for j in range(1, min(WINDOW, n)):
        h[j:] += wide[:-j] * np.uint32(pow(0x01000193, j, 2**32))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    block = LEAST
    while block * LONG < n:
        block *= 2
    hits = np.flatnonzero((h & np.uint32(block - 1)) == block - 1)
    while len(hits) > 2 * LONG:
        block *= 2
        hits = hits[(h[hits] & np.uint32(block - 1)) == block - 1]
    while len(hits) < LONG // 4 and block > LEAST:
        block //= 2
        hits = np.flatnonzero((h & np.uint32(block - 1)) == block - 1)
        if len(hits) > 2 * LONG:  # the next larger size had too few, this one too many: keep what is few
            block *= 2
            hits = hits[(h[hits] & np.uint32(block - 1)) == block - 1]
            break
    _need(n + 1)
    sums = np.cumsum(x * _powers[0][:n], dtype=np.uint64)

    def signs(ends: np.ndarray) -> str:
        if not len(ends) or ends[-1] != n - 1:
            ends = np.append(ends, n - 1)
        starts = np.concatenate([[0], ends[:-1] + 1])
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        v = (sums[ends] - before) * _powers[1][starts]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        return CHARS[(v >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return block, signs(hits), signs(hits[(h[hits] & np.uint32(2 * block - 1)) == 2 * block - 1])


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 or more cells at once in the bits of an integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def alike(a: str, b: str) -> float:
    """1 - edit distance (insert, delete) / both lengths; 0 without ``COMMON`` equal signs in a row, unless they are equal."""
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: tuple[int, str, str], b: tuple[int, str, str]) -> float:
    """Largest likeness of two fingerprints over the block sizes that both have; 0 if they have none, 1 if they are equal."""
    if a == b:
        return 1.0
    mine, other = {a[0]: a[1], 2 * a[0]: a[2]}, {b[0]: b[1], 2 * b[0]: b[2]}
    return max([alike(mine[k], other[k]) for k in mine if k in other], default=0.0)


def show(f: tuple[int, str, str]) -> str:
    return f"{f[0]}:{f[1]}:{f[2]}"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text, in one scan. A null text counts as empty; its fingerprint has no chunks."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            schema = pa.schema([b.schema.field("doc_id"), ("fingerprint", pa.string())])
            yield batch(schema, [b.column("doc_id"), [show(signature(t.encode())) for t in strings(b.column("text"))]])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """The rows (doc_id, text) in parts by ranges of the id, each part followed by the row that comes next after it (``ahead`` = 1).

    Parts hold about ``part_bytes`` of texts, and there are at least twice as many as shuffle partitions. Rows of one id that would fill several parts
    are dealt by ranges of a hash of the text, which is their order. The driver holds the parts' bounds and first rows' keys. Each text is
    shuffled once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), groups(size, part_bytes))
    bounds = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first().q
    cut_at, cut_h = cuts(bounds or [])

    def part(at: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, out = np.searchsorted(cut_at, at), np.searchsorted(cut_at, at, side="right")
        for a in np.unique(at[out > low]):
            own = at == a
            x, y = low[own][0], out[own][0]
            out[own] = x + np.searchsorted(cut_h[x:y], h[own], side="right")
        return out.astype(np.int32)

    part_of = F.pandas_udf(lambda at, h: pd.Series(part(at.to_numpy(), h.to_numpy())), "int")
    least = rows.select("at", "h").withColumn("p", part_of("at", "h")).groupBy("p").agg(F.min(F.struct("at", "h")).alias("k")).select("p", "k.at", "k.h")
    first = sorted((r.p, (r["at"], r.h)) for r in least.collect())
    back = {key: first[i - 1][0] for i, (_, key) in enumerate(first)}  # the smallest key follows the last part

    def places(at: pd.Series, h: pd.Series) -> pd.Series:
        own = part(at.to_numpy(), h.to_numpy()).tolist()
        return pd.Series([[[p, 0], [back[k], 1]] if k in back else [[p, 0]] for k, p in zip(zip(at.tolist(), h.tolist()), own)])

    placed = rows.withColumn("place", F.explode(F.pandas_udf(places, "array<array<int>>")("at", "h")))
    placed = placed.select("doc_id", "text", "at", "h", F.col("place")[0].alias("part"), F.col("place")[1].alias("ahead"))
    return placed.repartition(parts, "part").sortWithinPartitions("part", "ahead", "at", "h")


def cuts(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First keys (id, hash) of all parts but the first. An id that is a bound k times over is cut k - 1 times more, by even ranges of the hash."""
    at, times = np.unique(np.array(bounds, np.int64), return_counts=True)
    step = [(2**64 // int(k)) for k in times]
    return np.repeat(at, times), np.array([-(2**63) + i * s for k, s in zip(times, step) for i in range(int(k))], np.int64)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 64 << 20) -> DataFrame:
    """Fingerprints of all texts and of their edits by the next document (ascending id, null first; after the last the first).

    Rows that repeat an id follow each other in the order of a hash of the text (equal rows stay in one part). A null text is empty. With one row, the next is itself.
    An empty table gives an empty result; other columns are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        held, schema = None, None
        for b in batches:
            schema = schema or pa.schema(
                [b.schema.field("doc_id"), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
            )
            out = []
            for doc, text, part, ahead in zip(b.column("doc_id").to_pylist(), strings(b.column("text")), b.column("part").to_pylist(), b.column("ahead").to_pylist()):
                own = signature(text.encode())
                if held is not None and held[2] == part:
                    raw = edited(held[1], text).encode()
                    new = signature(raw)
                    out.append((held[0], len(held[1]), hashlib.sha256(raw).hexdigest(), show(held[3]), show(new), likeness(held[3], new), likeness(held[3], own)))
                held = None if ahead else (doc, text, part, own)
            if out:
                yield batch(schema, list(zip(*out)))

    kind = src.schema["doc_id"].dataType.simpleString()
    return with_next(src, part_bytes).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
