"""Quality scores from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import batch, bounded_batches, fold, materialize, strings
from tidegraph.store import discard

WIDTH = 64
NONZERO = 8
_BLANK = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """The class of a token that has no vector of its own: letter case and length, digits, or marks."""
    if token[0].isdigit():
        return "<digits>" if len(token) < 7 else "<long digits>"
    if token[0].isalpha():
        case = "upper" if token.isupper() and len(token) > 1 else "title" if token[0].isupper() else "lower" if token.islower() else "mixed"
        return f"<{case} {min(len(token) // 6, 3)}>"
    return "<marks>" if len(token) == 1 else "<run>" if len(set(token)) == 1 else "<mix>"


SHAPES = [f"<{c} {n}>" for c in ("upper", "title", "lower", "mixed") for n in range(4)] + ["<digits>", "<long digits>", "<marks>", "<run>", "<mix>"]
AGAIN = "<again>"


def index_vectors(n: int, seed: int) -> np.ndarray:
    """``n`` sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class Vectors:
    """Word vectors: a word's own index vector plus those of its neighbours in the sample, damped, at unit length.

    ``words``: those that have vectors of their own; ``near``: sum over neighbours of log(1 + times) * index vector, a row for each id.
    """

    def __init__(self, words: list[str], seed: int):
        self.ids = {w: i for i, w in enumerate([AGAIN, *SHAPES, *words])}
        self.index = index_vectors(len(self.ids), seed)
        self.table = np.zeros_like(self.index)

    def weigh(self, near: np.ndarray) -> None:
        near = near / np.maximum(1e-6, np.linalg.norm(near, axis=1, keepdims=True))
        both = self.index / np.sqrt(NONZERO) + near
        self.table = (both / np.maximum(1e-6, np.linalg.norm(both, axis=1, keepdims=True))).astype(np.float32)

    def id(self, token: str) -> int:
        got = self.ids.get(token)
        return self.ids[shape(token)] if got is None else got


class _Combos(dict):
    """Stretch without white space to the row of its tokens' summed vectors; at most about ``most`` bytes of each."""

    def __init__(self, vectors: Vectors, most: int):
        super().__init__()
        self.vectors, self.most, self.used = vectors, most, 0
        self.rows, self.table, self.sizes, self.n = {}, np.zeros((1024, WIDTH), np.float32), np.zeros(1024, np.float32), 0

    def __missing__(self, chunk: str) -> int:
        ids = tuple(map(self.vectors.id, _TOKEN.findall(chunk)))
        row = self.rows.get(ids)
        if row is None:
            if self.n == len(self.table):
                self.table, self.sizes = np.vstack([self.table, np.zeros_like(self.table)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            row = self.n
            self.rows[ids] = row
            self.table[row] = self.vectors.table[list(ids)].sum(0) if ids else 0
            self.sizes[row] = len(ids)
            self.n += 1
        if len(chunk) < 100 and self.used < self.most:
            self.used += 200 + len(chunk)
            self[chunk] = row
        return row

    def reset(self) -> None:
        """Start again where a bound is reached; called between stretches, since rows must stay while one is summed."""
        if self.used >= self.most or self.n * 4 * WIDTH > self.most:
            self.clear()
            self.rows, self.n, self.used = {}, 0, 0


class Pool:
    """Mean vector of a whole text's tokens, with a vector for each chunk that repeats the one before it. Long texts are summed in stretches."""

    def __init__(self, vectors: Vectors, most: int = 16 << 20):
        self.again, self.combos = vectors.table[vectors.ids[AGAIN]], _Combos(vectors, most)

    def __call__(self, text: str) -> np.ndarray:
        total, size, again, last = np.zeros(WIDTH, np.float64), 0.0, 0, None
        for chunks in _stretches(text):
            self.combos.reset()
            if not chunks:
                continue
            rows = np.fromiter(map(self.combos.__getitem__, chunks), np.int64, len(chunks))
            again += sum(map(eq, chunks, chunks[1:])) + (chunks[0] == last)
            last = chunks[-1]
            for at in range(0, len(rows), 20_000):
                total += self.combos.table[rows[at : at + 20_000]].sum(0)
            size += float(self.combos.sizes[rows].sum())
        return (total + again * self.again) / max(1.0, size + again)


def _stretches(text: str, step: int = 1 << 20) -> Iterator[list[str]]:
    """What white space separates, from about ``step`` characters at a time."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + step) if at + step < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to].split()
        at = to


class Net:
    """Two layers, trained by Adam on cross-entropy, then a temperature fitted on rows that were set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int, seed: int, steps: int = 1_500):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        self.w = [rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.t = 1.0
        if not len(x):
            return
        aside = np.arange(len(x)) % 5 == 4
        fit_x, fit_y = x[~aside], y[~aside]
        m = [np.zeros_like(w) for w in self.w]
        v = [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(fit_x), min(256, len(fit_x)))
            z = (fit_x[pick] - self.mean) / self.scale
            h = np.tanh(z @ self.w[0] + self.w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - fit_y[pick]) / len(pick)
            back = np.outer(d, self.w[2]) * (1 - h * h)
            for i, g in enumerate([z.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True)]):
                g = g + 1e-4 * self.w[i] if i in (0, 2) else g
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                self.w[i] -= 0.01 * (1 - 0.9 * step / steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            z, own = self.logits(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
            self.t = float(min(grid, key=lambda t: np.logaddexp(0, np.where(own > 0, -z, z) / t).mean()))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.t, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int, words: int, hidden: int, seed: int, reach: int = 2) -> tuple[Vectors, Net]:
    """Vectors and network from at most ``max_rows`` labelled rows (those with the smallest hashes of their ids), read whole in tasks.

    Of rows that repeat a labelled id one counts, by a hash of the text. The driver gets the ``words`` most frequent tokens, sums of index vectors
    (a row for each of them from each task), and one pooled vector for each labelled row.
    """
    bounded_batches(docs.sparkSession)
    picked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows).select(F.col("doc_id").alias("labelled"), "quality")
    rows = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = materialize(rows.select("doc_id", F.col("quality").cast("double").alias("quality"), "t.text"), "quality-sample")

    def tokens(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in strings(b.column("text")):
                for chunks in _stretches(text):
                    seen.update(x for c in chunks for x in _TOKEN.findall(c))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    top = rows.select("text").mapInArrow(tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(words)
    vectors = Vectors([r.token for r in top.collect()], seed)
    n = len(vectors.ids)

    def pairs(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in strings(b.column("text")):
                for chunks in _stretches(text):
                    ids = np.array([vectors.id(x) for c in chunks for x in _TOKEN.findall(c)], np.int64)
                    for d in range(1, min(reach, len(ids) - 1) + 1):
                        pair, count = np.unique(ids[d:] * n + ids[:-d], return_counts=True)
                        seen.update(dict(zip(pair.tolist(), count.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

    def sums(batches):
        out = np.zeros((n, WIDTH))
        for b in batches:
            (a, c), x = np.divmod(b.column("pair").to_numpy(), n), np.log1p(b.column("n").to_numpy())
            np.add.at(out, a, vectors.index[c] * x[:, None])
            np.add.at(out, c, vectors.index[a] * x[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["near"])

    counted = rows.select("text").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").coalesce(8)
    vectors.weigh(sum((np.frombuffer(r.near).reshape(n, WIDTH) for r in counted.mapInArrow(sums, "near binary").collect()), np.zeros((n, WIDTH))))

    def pooled(batches):
        pool = Pool(vectors)
        for b in batches:
            x = [pool(t).tobytes() for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("quality"), pa.array(x, pa.binary())], names=["id", "quality", "x"])

    sample = rows.select(F.col("doc_id").cast("string").alias("id"), "quality", "text").mapInArrow(pooled, "id string, quality double, x binary").collect()
    sample.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id))
    discard(rows)
    x = np.array([np.frombuffer(r.x) for r in sample]).reshape(-1, WIDTH)
    return vectors, Net(x, np.array([r.quality for r in sample]), hidden, seed)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = 5_000,
    words: int = 2_000, hidden: int = 32, seed: int = 11,
) -> DataFrame:
    """Score whole texts for quality.

    Fitted from at most ``max_rows`` labelled rows (``labels``: doc_id, quality 0 or 1), a documented bound, whole texts each: random-indexing
    vectors for ``words`` tokens of the sample (others share the vector of their shape), mean-pooled for each text, then two layers and a
    temperature fitted on a fifth of the sample. Scoring is one scan over whole texts.

    A null or empty text has the zero vector, and its score; without labels scores come from an untrained network. Repeated rows give
    equal rows; null ids stay null; repeated labels of one id count once, the best of them; empty tables give empty results; other columns are ignored.

    Returns doc_id, score, predicted (1 if score >= ``threshold``).
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(src, labels, max_rows, words, hidden, seed))

    def score(batches):
        vectors, net = model.value
        pool, schema = Pool(vectors), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("score", pa.float64()), ("predicted", pa.int32())])
            x = np.array([pool(t) for t in strings(b.column("text"))], np.float64).reshape(-1, WIDTH)
            s = net(x)
            yield batch(schema, [b.column("doc_id"), s, (s >= threshold).astype(np.int32)])

    return src.mapInArrow(score, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels.where(fold("doc_id", 5) != 0))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3, max_rows: int = 5_000, words: int = 2_000, hidden: int = 32, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more; fitted on ``labelled`` (doc_id, text) with ``labels``.

    Empty tables, nulls and repeated rows are as in ``quality_scores``; rows don't move.
    """
    src = labelled.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(src, labels, max_rows, words, hidden, seed))

    def keep(batches):
        vectors, net = model.value
        pool = Pool(vectors)
        for b in batches:
            x = np.array([pool(t or "") for t in strings(b.column(text_col))], np.float64).reshape(-1, WIDTH)
            yield b.filter(pa.array(net(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
