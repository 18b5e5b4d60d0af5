"""Best-fit packing of token pieces into sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.bpe import Ids, vocabulary
from tidegraph.llm.common import batch, bounded_batches, groups, materialize, strings, texts
from tidegraph.llm.sharding import ranked

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence (largest first), and how many such sequences


def best_fit(counts: dict[int, int], cap: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: the incumbent of the search. Equal sequences are filled alike, many at once."""
    left = dict(counts)
    gaps: dict[int, list[list]] = {}  # room left: [lengths, sequences]
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            rooms = sorted(r for r in gaps if r >= size and gaps[r])
            if rooms:
                lengths, k = gaps[rooms[0]].pop()
                room, use = rooms[0], min(n, k)
                if k > use:
                    gaps[room].append([lengths, k - use])
                gaps.setdefault(room - size, []).append([[*lengths, size], use])
                n -= use
            else:
                each = cap // size
                whole, rest = divmod(n, each)
                if whole:
                    gaps.setdefault(cap - each * size, []).append([[size] * each, whole])
                if rest:
                    gaps.setdefault(cap - rest * size, []).append([[size] * rest, 1])
                n = 0
    return [(tuple(lengths), k) for g in gaps.values() for lengths, k in g]


def fillings(sizes: list[int], left: dict[int, int], room: int, branch: int, nodes: int) -> list[tuple[int, ...]]:
    """At most ``branch`` undominated fillings of ``room``, fullest first; ``sizes`` ascend.

    The search goes from large to small, so of equal sums the first has the larger pieces and dominates the others; a filling that has
    room for a piece that is left over is dominated too. An exact filling dominates all and ends the search, as do ``nodes`` steps.
    """
    found: dict[int, tuple[int, ...]] = {}
    steps = 0

    def go(free: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        more = False
        for i in range(min(top, bisect_right(sizes, free) - 1), -1, -1):
            s = sizes[i]
            if chosen.count(s) < left[s]:
                more = True
                go(free - s, i, (*chosen, s))
            if steps > nodes or room in found:
                break
        if not more:
            found.setdefault(room - free, chosen)

    go(room, len(sizes) - 1, ())
    return [found[k] for k in sorted(found, reverse=True)[:branch]]


def completion(counts: dict[int, int], cap: int, nodes: int = 300, branch: int = 3, tries: int = 12) -> list[Pattern]:
    """Bin completion: the largest length left is completed by an undominated filling, as often as the counts allow.

    Branch and bound: to beat the incumbent (``best_fit`` at first), all sequences together may waste ``(most - 1) * cap - total`` at
    the most, so fillings that waste more are cut. Other fillings wait on a stack; the search ends at the lower bound, when the stack
    is empty, or after ``tries`` descents, and gives the best plan met.
    """
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, cap)
    most, bound = sum(k for _, k in best), -(-total // cap)
    done: list[Pattern] = []
    stack: list[tuple[int, tuple[int, ...]]] = []
    forced: tuple[int, ...] | None = None
    for _ in range(tries):
        if most <= bound:
            break
        left = dict(counts)
        for lengths, times in done:
            for s in lengths:
                left[s] -= times
        sizes = sorted(s for s in left if left[s])
        waste = sum(times * (cap - sum(lengths)) for lengths, times in done)
        while sizes and waste <= (most - 1) * cap - total:
            top = sizes[-1]
            if forced is None:
                left[top] -= 1
                filling, *others = fillings(sizes, left, cap - top, branch, nodes)
                left[top] += 1
                stack += [(len(done), o) for o in reversed(others) if waste + cap - top - sum(o) <= (most - 1) * cap - total]
            else:
                filling, forced = forced, None
            lengths = (top, *filling)
            times = min(left[s] // lengths.count(s) for s in set(lengths))
            for s in lengths:
                left[s] -= times
            sizes = [s for s in sizes if left[s]]
            waste += times * (cap - sum(lengths))
            done.append((lengths, times))
        if not sizes and (used := sum(k for _, k in done)) < most:
            best, most = list(done), used
        if not stack:
            break
        k, forced = stack.pop()
        del done[k:]
    return best


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in a sequence, offset of the first) for each pattern and length."""
    out, rank, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for s in sorted(set(lengths), reverse=True):
            m, at = lengths.count(s), rank.get(s, 0)
            out.append((s, at, at + m * times, sequence, m, offset))
            rank[s] = at + m * times
            offset += m * s
        sequence += times
    return out


def pieces(docs: DataFrame, cap: int, vocab: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; only a document of more than ``cap`` ids has several, the first the short one."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        ids, schema = Ids(vocab), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
            row, nth, start, length, crc = [], [], [], [], []
            for i, text in enumerate(strings(b.column("text"))):
                raw = ids(text) + end
                n = len(raw) // 4
                edges = [0, *range(n % cap or cap, n + 1, cap)]
                for j, (x, y) in enumerate(zip(edges, edges[1:])):
                    row.append(i), nth.append(j), start.append(x), length.append(y - x), crc.append(zlib.crc32(raw[4 * x : 4 * y]))
            yield batch(schema, [b.column("doc_id").take(pa.array(np.array(row, dtype=np.int64))), nth, start, length, crc])

    return docs.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, cap: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 2, rows_per_bucket: int = 500,
) -> DataFrame:
    """Pack the token pieces of all texts into as few sequences of at most ``cap`` tokens as the search finds.

    The driver sees only the histogram of lengths (at most ``cap`` numbers) and solves packing on it, with equal sequences as one
    pattern; a piece takes the place that its rank among the pieces of its length has in the plan. Ranks are taken in buckets, so one
    length may hold any share of the pieces. Texts are tokenized once and never shuffled.

    A null or empty text is one piece, its end token. Repeated rows are packed each; pieces alike in all columns share out their places
    in any order. An empty table gives an empty result; null ids stay null; other columns are ignored.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = materialize(pieces(texts(docs, id_col, text_col), cap, vocab or vocabulary(), end_id), "pack-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``cap`` rows
    plan = runs(completion(counts, cap))
    n_buckets = groups(sum(counts.values()), 4 * rows_per_bucket)
    places = spark.createDataFrame(plan, "len long, rank_from long, rank_to long, sequence long, m long, first long")
    by_id = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets))
    rows = ranked(cut, ["length"], by_id, ["doc_id", "piece", "ids_crc32"], "r")
    at = rows.join(F.broadcast(places), (F.col("length") == F.col("len")) & (F.col("r") >= F.col("rank_from")) & (F.col("r") < F.col("rank_to")))
    k = F.col("r") - F.col("rank_from")
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("m"))).cast("long").alias("sequence_id"),
        (F.col("first") + F.pmod(k, F.col("m")) * F.col("length")).cast("long").alias("offset"),
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
