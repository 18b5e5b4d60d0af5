"""Language identification by cross-parsing: the language whose sample parses a text into the fewest phrases wins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import batch, bounded_batches, fold, materialize, text_bytes

BLOCK = 256
_MISS = 1 << 30


def _lower_table() -> np.ndarray:
    """ASCII letters to lower case, other ASCII to a blank, other bytes to themselves."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


_LOWER = _lower_table()


def folded(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with single blanks between them, for texts that end at ``ends`` in ``raw``; and the new ends.

    Two-byte Latin letters are lowered as well. A blank after a blank goes.
    """
    x = _LOWER[raw]
    if len(x) > 1:
        upper = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[1:][upper] += 0x20
    blank = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], kept[ends]


def automaton(sample: np.ndarray, classes: int) -> np.ndarray:
    """Suffix automaton of a sequence of classes as one flat table: ``table[state * classes + class]`` is the next state.

    Where the match can't go on, the entry is the state after the class from the start, with ``_MISS`` set: a new phrase begins. The last
    state is where parsing begins and where a class that the sample lacks, a phrase of its own, leaves it: any next class begins a phrase.
    """
    link, length, nexts = [-1], [0], [{}]
    last = 0
    for c in sample.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.full(classes, len(nexts), np.int32)
    for c, s in nexts[0].items():
        root[c] = s
    table = np.tile(root | _MISS, (len(nexts) + 1, 1)).astype(np.int32)
    for s, row in enumerate(nexts):
        for c, t in row.items():
            table[s, c] = t
    return table.ravel()


class Model:
    """Automata of the languages' samples; ``samples``: language to text."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.classes, self.widths, self.tables, self.bits = [], [], [], []
        for name in self.names:
            raw = np.frombuffer(samples[name].encode(), np.uint8)
            part = folded(raw, np.array([len(raw)]))[0]
            seen = np.unique(part)
            own = np.zeros(256, np.uint8)  # 0: a byte that the sample doesn't have; a UTF-8 text has fewer than 256 values
            own[seen] = np.arange(1, len(seen) + 1)
            self.classes.append(own)
            self.widths.append(len(seen) + 1)
            self.tables.append(automaton(own[part], len(seen) + 1))
            self.bits.append(math.log2(max(2, len(part))))
        self.bits = np.array(self.bits)

    def phrases(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text by each language, as one parse from its first byte to its last.

        Texts are parsed in blocks side by side, each from where the block before it ended. At first all begin anew; as parses soon meet, few blocks
        end elsewhere when they begin where they should, and those after them are parsed once more until nothing changes.
        """
        starts = np.concatenate([[0], ends[:-1]])
        blocks = -(-(ends - starts) // BLOCK)
        owner = np.repeat(np.arange(len(ends)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = starts[owner] + nth * BLOCK
        size = np.minimum(BLOCK, ends[owner] - first)
        out = np.zeros((len(ends), len(self.tables)))
        for k, (table, width, classes) in enumerate(zip(self.tables, self.widths, self.classes)):
            own = classes[symbols]
            begin = np.full(len(first), len(table) // width - 1, np.int32)
            end, count, todo = begin.copy(), np.zeros(len(first), np.int32), np.arange(len(first))
            while len(todo):
                end[todo], count[todo] = self._parse(table, width, own, first[todo], size[todo], begin[todo])
                follows = todo + 1
                follows = follows[follows < len(first)]
                follows = follows[(nth[follows] > 0) & (begin[follows] != end[follows - 1])]
                begin[follows] = end[follows - 1]
                todo = follows
            out[:, k] = np.bincount(owner, weights=count, minlength=len(ends))
        return out

    @staticmethod
    def _parse(table: np.ndarray, width: int, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last state and new phrases of each block."""
        order = np.argsort(-size, kind="stable")
        at, state, count = first[order], begin[order], np.zeros(len(order), np.int32)
        live = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # blocks longer than j come first
        for j in range(BLOCK):
            n = int(live[j])
            if not n:
                break
            got = table[state[:n] * width + symbols[at[:n] + j]]
            count[:n] += got >> 30
            state[:n] = got & (_MISS - 1)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = text_bytes(texts)
        names, scores = [], np.zeros(len(texts))
        at = 0
        while at < len(texts):  # a few MB at a time
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), side="right")) - 1)
            part = raw[offsets[at] : offsets[to]]
            symbols, ends = folded(part, offsets[at + 1 : to + 1] - offsets[at])
            letters = np.concatenate([[0], np.cumsum(symbols != 32)])
            has = letters[ends] - letters[np.concatenate([[0], ends[:-1]])] > 0
            n = np.maximum(1, np.diff(np.concatenate([[0], ends])))
            if self.names:
                rate = self.phrases(symbols, ends) * self.bits / n[:, None]
                best = rate.argmin(1)
                gap = (rate - rate.min(1, keepdims=True)) * np.minimum(n, 50)[:, None]
                scores[at:to] = 1 / np.exp2(-np.minimum(gap, 60)).sum(1)
            for i in range(to - at):
                if self.names and has[i] and any(map(str.isalpha, texts[at + i].as_py())):
                    names.append(self.names[best[i]])
                else:
                    names.append("und")
                    scores[at + i] = 0.0
            at = to
        return names, scores


_models: dict[int, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(samples)
    return _models[key]


def language_samples(docs: DataFrame, docs_each: int, chars_each: int, chars: int) -> dict[str, str]:
    """Up to ``chars`` characters for each language: a stretch of ``chars_each`` from each of ``docs_each`` of its different texts at most.

    ``docs``: doc_id, text, lang. Texts come in the order of a hash, which also says where a stretch lies; copies share a hash and count once. The
    hash's range is narrowed first, so no language is sorted whole.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    count = materialize(known.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n")), "languages")  # its size is known before the join
    h = F.xxhash64("text", F.lit(5))
    draw = F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)
    begin = F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - chars_each, F.lit(0)) + 1) + 1
    near = known.join(count, F.col("lang") == F.col("lang_")).withColumn("draw", draw).where(F.col("draw") < F.lit(32.0 * docs_each) / F.col("n"))
    near = near.select("lang", "draw", F.substring("text", begin.cast("int"), F.lit(chars_each)).alias("text")).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    rows = near.withColumn("nth", nth).where(F.col("nth") <= docs_each)
    out: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.nth)):
        out[r.lang] = f"{out.get(r.lang, '')} {r.text}"[:chars]
    return out


def identify(
    docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_each: int = 64, chars_each: int = 250, chars: int = 16_000,
) -> DataFrame:
    """Predict the language of whole texts by the cross-parsing estimate of relative entropy (Ziv and Merhav).

    ``train`` (default: ``docs``) gives each language's sample of at most ``chars`` characters, a documented bound. In every worker a
    suffix automaton of the sample finds longest matches; a text's phrases times log2 of the sample's length over the text's length is
    its cost, and the cheapest language wins (ties: the first in code-point order). All of a text is parsed as one, after case folding, and
    every byte value of a sample is told apart. The plan is one scan; samples of a fixed size are what tasks receive (a worker's automata take
    about 8 MB for each language).

    ``und`` with score 0: a null text, a text without a letter, or nothing to learn from. Null languages are not learned from. Repeated
    rows give equal rows; empty tables give empty results; other columns are ignored.

    Returns doc_id, lang_pred, score (the winner's share of 2^-cost, over at most 50 bytes, among all languages).
    """
    learn = (train if train is not None else docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(language_samples(learn, docs_each, chars_each, chars))
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def predict(batches):
        model, schema = _model(known.value), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), ("lang_pred", pa.string()), ("score", pa.float64())])
            names, scores = model(b.column("text"))
            yield batch(schema, [b.column("doc_id"), names, scores])

    return src.mapInArrow(predict, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, docs.where(fold("doc_id", 3) != 1))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_known_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5, docs_each: int = 64, chars_each: int = 250, chars: int = 16_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't ``und`` and whose language scores ``least`` or more; see ``identify``.

    Rows don't move. If no row has a language there is nothing to learn from, so nothing can be told apart and no row stays.
    """
    learn = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = docs.sparkSession.sparkContext.broadcast(language_samples(learn, docs_each, chars_each, chars))

    def keep(batches):
        model = _model(known.value)
        for b in batches:
            names, scores = model(b.column(text_col).fill_null(""))
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
