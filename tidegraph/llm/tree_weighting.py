"""Language-model scores by context-tree weighting over bytes, each byte as eight binary decisions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches, fold, groups, materialize, text_bytes

DEPTH = 5  # bytes of context
TOP = 3  # context bytes that decide a bucket; nodes of this depth and deeper are computed there
END = 10  # ends a text; white space inside is one blank
END_KEY = np.uint64(0x1234567)
_LN2 = math.log(2)
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[65:91] += 32
_BYTE[[9, 10, 11, 12, 13]] = 32
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def laid_out(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case, words with single blanks between them, each as DEPTH end bytes, its bytes, and an end byte; and their starts."""
    n = len(offsets) - 1
    x = np.full(len(raw) + n, END, np.uint8)
    place = np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))
    x[place] = _BYTE[raw]
    ends = offsets[1:] + np.arange(n)
    blank = x == 32
    edge = x == END
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | edge[:-1]))  # after a blank or at a text's start
    if len(x):
        keep[0] = not blank[0]
    kept = np.cumsum(keep)
    stops = kept[ends] - 1
    y = x[keep]
    if len(y) > 1:  # a blank before the end
        last = np.zeros(len(y), bool)
        last[np.maximum(stops - 1, 0)] = (y[np.maximum(stops - 1, 0)] == 32) & (stops > 0)
        gone = np.cumsum(last)
        y, stops = y[~last], stops - gone[stops]
    sizes = np.diff(np.concatenate([[-1], stops]))
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)])
    out = np.full(starts[-1], END, np.uint8)
    out[np.arange(len(y)) + DEPTH * np.repeat(np.arange(1, n + 1), sizes)] = y
    return out, starts


def context_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each byte after a text's first DEPTH: the byte before it, the one before that, ..., then the byte itself."""
    key = np.zeros(len(flat), np.uint64)
    for d in range(1, DEPTH + 1):
        key[d:] |= flat[:-d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    key |= flat
    real = np.ones(len(flat), bool)
    real[(starts[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return key[real]


def word_keys(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the words and the end of each text, text by text, and how many each text has."""
    n = len(starts) - 1
    inside = (flat != END) & (flat != 32)
    before = np.zeros(len(flat), bool)
    before[1:] = inside[:-1]
    first, stop = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)  # a text ends in an end byte
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[flat] * _powers(_P, len(flat)), dtype=np.uint64)])
    h = (sums[stop] - sums[first]) * _powers(_INV, len(flat))[first] if len(first) else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    count = np.searchsorted(first, starts[1:]) - np.searchsorted(first, starts[:-1])
    out = np.full(len(h) + n, END_KEY, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), count)] = h
    return out, count + 1


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys (as differences, byte by byte) and values in one compressed piece."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.int64(len(keys)).tobytes() + np.ascontiguousarray(steps).tobytes() + values.tobytes(), 1)


def unpacked(piece: bytes, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(piece)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(raw, kind, n, 8 + 8 * n)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for j in range(8):
        shift += np.log(x + j)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return np.where(a + b > 0, _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi), 0.0)


class Level:
    """Nodes of one context depth for one bit of the byte: counts of zeros and ones, and each key's node."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, bit: int):
        u, inv = np.unique((keys >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(8) | (keys & np.uint64(255)), return_inverse=True)
        self.path = u >> np.uint64(8 - bit)
        new = np.concatenate([[True], self.path[1:] != self.path[:-1]])
        own = np.cumsum(new) - 1
        ones = ((u >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        c = np.bincount(inv, weights=counts, minlength=len(u))
        self.a, self.b = np.bincount(own, weights=c * (1 - ones)), np.bincount(own, weights=c * ones)
        self.path, self.of = self.path[new], own[inv]
        self.log_e = log_kt(self.a, self.b)
        self.log_w = self.log_e

    def weigh(self, deeper: Level) -> None:
        up = np.empty(len(deeper.a), np.int64)
        up[deeper.of] = self.of
        self.log_w = np.logaddexp(self.log_e, np.bincount(up, weights=deeper.log_w, minlength=len(self.a))) - _LN2


def levels(keys: np.ndarray, counts: np.ndarray, bit: int) -> list[Level]:
    """Depths TOP to DEPTH, weighted from the deepest up; ``keys`` hold whole subtrees of their first TOP context bytes."""
    out = [Level(keys, counts, d, bit) for d in range(TOP, DEPTH + 1)]
    for upper, deeper in zip(out[-2::-1], out[:0:-1]):
        upper.weigh(deeper)
    return out


def roots(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at depth TOP - 1 (context bytes and bit path) and, summed over their children here, zeros, ones, log weighted probability."""
    at, values = [np.zeros(0, np.int64)], [np.zeros((0, 3))]
    for bit in range(8):
        top = levels(keys, counts, bit)[0]
        context, path = top.path >> np.uint64(bit + 8), (top.path & np.uint64(2**bit - 1)) + np.uint64(2**bit)
        at.append((context << np.uint64(8) | path).astype(np.int64))
        values.append(np.column_stack([top.a, top.b, top.log_w]))
    return added(np.concatenate(at), np.concatenate(values))


def added(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes in order, and the sums of their rows."""
    nodes, inv = np.unique(at, return_inverse=True)
    return nodes, np.column_stack([np.bincount(inv, weights=v, minlength=len(nodes)) for v in values.T])


def upper_tables(at: np.ndarray, sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For depths TOP - 1 to 0: the nodes (context bytes and path) in order, and their count, estimate for a one, and weight."""
    out = []
    for _ in range(TOP):
        a, b, low = sums.T
        e = log_kt(a, b)
        w = np.logaddexp(e, low) - _LN2
        out.append((at, np.stack([a + b, (b + 0.5) / (a + b + 1), np.exp(e - _LN2 - w)])))
        at, sums = added((at >> 16) << 8 | (at & 255), np.column_stack([a, b, w]))
    return out


def log_probabilities(keys: np.ndarray, counts: np.ndarray, upper: list) -> np.ndarray:
    """log10 of the mixture's probability of each key's byte after its context: estimates of all depths at which the context was seen."""
    total = np.zeros(len(keys))
    byte, context = (keys & np.uint64(255)).astype(np.int64), (keys >> np.uint64(8)).astype(np.int64)
    for bit in range(8):
        one = ((byte >> (7 - bit)) & 1).astype(bool)
        path = (byte >> (8 - bit)) + (1 << bit)
        p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        steps = [(v.a + v.b, (v.b + 0.5) / (v.a + v.b + 1), np.exp(v.log_e - (v.log_w + (_LN2 if i else 0))), v.of) for i, v in enumerate(reversed(levels(keys, counts, bit)))]
        for depth, (at, values) in zip(range(TOP - 1, -1, -1), upper):
            steps.append((*values, np.searchsorted(at, (context >> (8 * (DEPTH - depth))) << 8 | path)))
        for n, estimate, w, of in steps:
            kt = np.where(one, estimate[of], 1 - estimate[of])
            here = n[of] > 0
            p = np.where(here, np.where(seen, w[of] * kt + (1 - w[of]) * p, kt), p)
            seen |= here
        total += np.log10(p)
    return total


def _slices(texts: pa.Array, step: int = 2 << 20):
    """(first row, end row, layout) of stretches of about ``step`` bytes."""
    raw, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1)
        yield at, to, laid_out(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def counted(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(pid, bucket, piece): for each group of texts its keys with their counts in training texts, in buckets; words come after contexts."""

    def buckets_of(keys: np.ndarray, words: bool) -> np.ndarray:
        head = keys if words else keys >> np.uint64(8 * (DEPTH + 1 - TOP))
        return ((head * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)) % np.uint64(n_buckets)

    def run(batches):
        held: dict[tuple[int, bool], list] = {}

        def add(pid, words, keys, counts):
            parts = held.setdefault((pid, words), [])
            parts.append((keys, counts))
            if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > max(1 << 21, len(parts[0][0])):
                parts[:] = [summed(*(np.concatenate(x) for x in zip(*parts)))]

        for b in batches:
            pids, train = b.column("pid").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
            order = np.argsort(pids * 2 + train, kind="stable")
            texts, group = b.column("text").take(pa.array(order)), (pids * 2 + train)[order]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for x, y in zip(edges, edges[1:]):
                pid, trained = divmod(int(group[x]), 2)
                for _, _, (flat, starts) in _slices(texts.slice(x, y - x)):
                    for words, keys in ((False, context_keys(flat, starts)), (True, word_keys(flat, starts)[0])):
                        keys, n = np.unique(keys, return_counts=True)
                        add(pid, words, keys, n * trained)
        for (pid, words), parts in held.items():
            keys, n = summed(*(np.concatenate(x) for x in zip(*parts)))
            at = buckets_of(keys, words)
            order = np.argsort(at, kind="stable")
            keys, n, at = keys[order], n[order], at[order]
            edges = np.searchsorted(at, np.arange(n_buckets + 1))
            rows = [(i, packed(keys[x:y], n[x:y])) for i, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(rows), pa.int64()), pa.array([i + n_buckets * words for i, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["pid", "bucket", "piece"]
            )

    return docs.mapInArrow(run, "pid long, bucket int, piece binary")


def merged(pieces: DataFrame, n_groups: int, fan: int = 64) -> DataFrame:
    """(bucket, piece): counts over all groups, merged ``fan`` pieces at a time."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*map(unpacked, pdf["piece"]))))
        return pd.DataFrame({"pid": [pdf["pid"].iloc[0] // fan], "bucket": [pdf["bucket"].iloc[0]], "piece": [packed(keys, counts)]})

    while True:
        pieces = pieces.withColumn("up", F.floor(F.col("pid") / fan)).groupBy("bucket", "up").applyInPandas(merge, "pid long, bucket int, piece binary")
        n_groups = -(-n_groups // fan)
        if n_groups <= 1:
            return pieces.drop("pid")


def lm_scores(
    docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 16 << 20, n_buckets: int | None = None,
) -> DataFrame:
    """log10 probabilities of whole texts under a context-tree weighting model and under smoothed word frequencies.

    Text is its words (what ASCII white space separates, ASCII letters lowered) with one blank between two, then an end. The model sees
    its bytes: eight binary decisions each, after up to 5 bytes of context; Krichevsky-Trofimov estimates of all depths are mixed by the
    weights that the training counts give them, leaving out depths at which a context was never seen. ``train`` is an SQL condition on
    ``docs``; every text counts, every text is scored. code length per byte is -score * log2(10) / n_bytes.

    Texts are dealt to groups of about ``group_bytes`` by a hash of id and text. A group's distinct keys go, packed in ``n_buckets`` pieces
    (default: in proportion to the root of the bytes, as distinct contexts grow more slowly than texts), to where counts are summed (64 pieces at a
    time) and probabilities computed, and those of its own keys come back: no task needs the whole model. Contexts are bucketed by their last
    three bytes, so subtrees stay whole and no common pair of bytes fills a bucket. What is above them, nodes of at most two context bytes, doesn't
    grow with the input (at most 65,536 contexts of 255 nodes; some 10^5 in text): it is summed in tasks, weighed on the driver and broadcast.
    Words travel as 64-bit hashes.

    A null or empty text is its end alone. With no training text every bit has probability 1/2. Repeated rows count and are scored each (rows
    equal in id and text are one group); an empty table gives an empty result; other columns are ignored.

    Returns doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, n_bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = groups(total, group_bytes)
    n_buckets = n_buckets or max(48, math.ceil(4 * math.sqrt(total / (1 << 20))))
    src = src.withColumn("pid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("long"))
    pieces = materialize(counted(src.select("text", "train", "pid").repartition(max(n_groups, 1), "pid"), n_buckets), "lm-pieces")
    sums = materialize(merged(pieces, n_groups), "lm-sums")

    def summary(batches):
        for b in batches:
            for bucket, piece in zip(b.column("bucket").to_pylist(), b.column("piece").to_pylist()):
                keys, counts = unpacked(piece)
                if bucket >= n_buckets:
                    rows = [(-1, b"", b"", int((counts > 0).sum()), int(counts.sum()))]
                else:
                    at, sums_ = roots(keys, counts)
                    part = at >> 8 & 15  # by the farther of the two bytes
                    rows = [(int(i), at[part == i].tobytes(), sums_[part == i].tobytes(), 0, 0) for i in np.unique(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "at", "sums", "v", "n"])

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        at, sums_ = added(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["at"]]), np.concatenate([np.frombuffer(x).reshape(-1, 3) for x in pdf["sums"]]))
        return pd.DataFrame({"at": [at.tobytes()], "sums": [sums_.tobytes()], "v": [pdf["v"].sum()], "n": [pdf["n"].sum()]})

    seen = materialize(sums.mapInArrow(summary, "part int, at binary, sums binary, v long, n long"), "lm-roots")
    words = seen.where("part < 0").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tops = seen.where("part >= 0").groupBy("part").applyInPandas(reduce, "at binary, sums binary, v long, n long").collect()  # 16 rows; see above for their size
    at = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["at"], np.int64) for r in tops]])
    upper = spark.sparkContext.broadcast(upper_tables(*added(at, np.concatenate([np.zeros((0, 3)), *[np.frombuffer(r["sums"]).reshape(-1, 3) for r in tops]]))))
    n_train, v_train = words.n, words.v
    floor = n_train + 0.1 * (v_train + 1)

    def valued(batches):
        for b in batches:
            for bucket, piece in zip(b.column("bucket").to_pylist(), b.column("piece").to_pylist()):
                keys, counts = unpacked(piece)
                values = counts.astype(np.float64) if bucket >= n_buckets else log_probabilities(keys, counts, upper.value)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(keys, values)], pa.binary())], names=["bucket", "model"])

    model = materialize(sums.repartition(2 * n_buckets, "bucket").mapInArrow(valued, "bucket int, model binary"), "lm-model")

    def answer(batches):
        for b in batches:
            known, at = None, None
            for pid, bucket, piece, own in zip(*(b.column(c).to_pylist() for c in ("pid", "bucket", "piece", "model"))):
                if bucket != at:
                    known, at = unpacked(own, np.float64), bucket
                keys, _ = unpacked(piece)
                got = known[1][np.searchsorted(known[0], keys)]
                got = got if bucket >= n_buckets else got.astype(np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([bucket >= n_buckets]), pa.array([packed(keys, got.astype(np.float64 if bucket >= n_buckets else np.float32))], pa.binary())], names=["pid", "words", "piece"])

    answers = pieces.join(model, "bucket").mapInArrow(answer, "pid long, words boolean, piece binary")

    def score(own: pd.DataFrame, slices: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for words, kind in ((False, np.float32), (True, np.float64)):
            parts = [unpacked(p, kind) for p in slices.loc[slices["words"] == words, "piece"]]
            keys, values = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            tables[words] = keys[order], values[order]
        texts = pa.array(own["text"], pa.string())
        out = []
        for _, _, (flat, starts) in _slices(texts):
            lengths = np.diff(starts) - DEPTH
            logs = tables[False][1][np.searchsorted(tables[False][0], context_keys(flat, starts))].astype(np.float64)
            keys, tokens = word_keys(flat, starts)
            c = tables[True][1][np.searchsorted(tables[True][0], keys)]
            first = np.cumsum(tokens) - tokens
            out.append(np.column_stack([tokens, np.add.reduceat(c > 0, first, dtype=np.int64), np.add.reduceat(np.log10((c + 0.1) / floor), first), np.add.reduceat(logs, np.cumsum(lengths) - lengths), lengths]))
        t = np.concatenate(out)
        return pd.DataFrame({"doc_id": own["doc_id"], "trained": own["train"], "n_tokens": t[:, 0].astype(np.int64), "n_known": t[:, 1].astype(np.int64), "train_tokens": n_train, "base_score": t[:, 2], "score": t[:, 3], "n_bytes": t[:, 4].astype(np.int64)})

    kind = src.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    return src.groupBy("pid").cogroup(answers.groupBy("pid")).applyInPandas(score, result)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", (fold("doc_id", 10) != 0).alias("learn"))
    out = lm_scores(docs, "learn")
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
