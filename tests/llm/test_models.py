"""Held-out accuracy and exact laws of the models."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidegraph.llm import tree_weighting as tw
from tidegraph.llm.language_id import Model, automaton, folded, identify, language_samples, keep_known_languages, op5_language_id
from tidegraph.llm.quality import fit, keep_good, op3_quality, quality_scores


def test_quality_on_held_out_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op3_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= 0.95 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (12, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(empty, labels).collect() == []
    assert len(quality_scores(odd, labels.where("false")).collect()) == odd.count()
    assert keep_good(odd, odd, labels).columns == odd.columns
    assert keep_good(empty, empty, labels).count() == 0


def test_quality_is_the_plain_network_on_the_plain_mean(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    src = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors, net = fit(src, labels, 400, 300, 16, 3)
    got = {r.doc_id: r.score for r in quality_scores(documents, labels, max_rows=400, words=300, hidden=16, seed=3).collect()}
    for r in documents.limit(60).collect():
        total, n, last = [0.0] * 64, 0, None
        for chunk in (r.text or "").split():
            ids = [vectors.id(t) for t in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", chunk)] + ([vectors.ids["<again>"]] if chunk == last else [])
            last = chunk
            for i in ids:
                total = [a + float(b) for a, b in zip(total, vectors.table[i])]
            n += len(ids)
        x = [(v / max(1, n) - m) / s for v, m, s in zip(total, net.mean, net.scale)]
        hidden = [math.tanh(sum(x[i] * net.w[0][i][j] for i in range(64)) + net.w[1][j]) for j in range(16)]
        z = sum(h * w for h, w in zip(hidden, net.w[2])) + net.w[3][0]
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-max(-30, min(30, z / net.t)))), abs_tol=1e-4)


def phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest matches by search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        n += 1
    return n


def test_automaton_parses_like_a_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sample = rng.integers(1, 4, 60).astype(np.uint8)
        text = rng.integers(1, 5, 80).astype(np.uint8)
        table, n = automaton(sample, 5), 0
        state = len(table) // 5 - 1
        for c in text.tolist():
            got = int(table[state * 5 + c])
            n += got >> 30
            state = got & ((1 << 30) - 1)
        assert n == phrases(sample.tobytes(), text.tobytes())


def test_whole_texts_are_parsed_like_a_search(spark, documents):
    samples = language_samples(documents, 64, 250, 4_000)
    model = Model(samples)
    plain = {k: folded(np.frombuffer(v.encode(), np.uint8), np.array([len(v.encode())]))[0].tobytes() for k, v in samples.items()}
    texts = [r.text or "" for r in documents.limit(40).collect()] + ["日本語 für Ärger " * 90, "q" * 900, ""]
    names, scores = model(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        raw = folded(np.frombuffer(text.encode(), np.uint8), np.array([len(text.encode())]))[0].tobytes()
        n = max(1, len(raw))
        cost = {k: phrases(own, raw) * math.log2(max(2, len(own))) / n for k, own in plain.items()}
        if any(map(str.isalpha, text)):
            assert name == min(sorted(cost), key=cost.get)
            assert math.isclose(score, 1 / sum(2 ** -min((c - min(cost.values())) * min(n, 50), 60) for c in cost.values()), rel_tol=1e-9)
        else:
            assert (name, score) == ("und", 0.0)


def test_language_on_held_out_rows(spark, sf, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = op5_language_id(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    own = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.97 * len(own)


def test_language_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in identify(odd).collect()}
    assert {k for k in got if got[k].lang_pred == "und"} == {4, 5, 8, 12}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(empty).collect() == []
    assert {r.lang_pred for r in identify(odd, odd.where("false")).collect()} == {"und"}
    assert keep_known_languages(odd).columns == odd.columns
    assert not {4, 5, 8, 12} & {r.doc_id for r in keep_known_languages(odd).collect()}


def test_blocks_of_texts_side_by_side_parse_alone():
    model = Model({"a": "abcabcabd " * 30, "b": "xyzzyx " * 40})
    texts = ["abcabd " * 200, "", "xyz", "日本", "abc xyz " * 500]
    together, scores = model(pa.array(texts))
    for t, name, s in zip(texts, together, scores):
        alone = model(pa.array([t]))
        assert alone[0] == [name] and math.isclose(alone[1][0], s)
    assert together[:3] == ["a", "und", "b"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(train, texts):
    """The mixture by dictionaries, one bit at a time."""
    count, kids = {}, {}
    for text in train:
        data = bytes([tw.END] * tw.DEPTH) + " ".join(words(text)).encode() + bytes([tw.END])
        for i in range(tw.DEPTH, len(data)):
            path = 1
            for bit in f"{data[i]:08b}":
                for d in range(tw.DEPTH + 1):
                    key = (data[i - d : i], path)
                    count.setdefault(key, [0, 0])[int(bit)] += 1
                    if d:
                        kids.setdefault((data[i - d + 1 : i], path), set()).add(key)
                path = path * 2 + int(bit)

    def log_e(key):
        a, b = count.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    done = {}

    def log_w(key):
        if key not in done:
            below = sum(log_w(k) for k in kids.get(key, ()))
            done[key] = log_e(key) if len(key[0]) == tw.DEPTH else math.log(0.5 * math.exp(log_e(key)) + 0.5 * math.exp(below))
        return done[key]

    out = []
    for text in texts:
        data = bytes([tw.END] * tw.DEPTH) + " ".join(words(text)).encode() + bytes([tw.END])
        total = 0.0
        for i in range(tw.DEPTH, len(data)):
            path = 1
            for bit in map(int, f"{data[i]:08b}"):
                p, seen = 0.5, False
                for d in range(tw.DEPTH, -1, -1):
                    key = (data[i - d : i], path)
                    if key in count:
                        kt = (count[key][bit] + 0.5) / (sum(count[key]) + 1)
                        w = 1.0 if d == tw.DEPTH else math.exp(log_e(key) - math.log(2) - log_w(key))
                        p, seen = (w * kt + (1 - w) * p if seen else kt), True
                total += math.log10(p)
                path = path * 2 + bit
        out.append(total)
    return out


def test_scores_against_brute_force(spark):
    rows = [(1, "the cat sat"), (2, "The  cat ran\n"), (3, "a dog"), (4, None), (5, "zebra the"), (6, ""), (7, "the cat sat"), (7, "the cat sat"), (None, "cat é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pid", "text AS train", "1 AS words")
    train = [t for i, t in rows if i in (1, 2, 3, 7)]
    got = tw.lm_scores(docs, "doc_id IN (1, 2, 3, 7)", group_bytes=16, n_buckets=3).collect()
    assert len(got) == len(rows)
    freq = Counter(w for t in train for w in [*words(t), None])
    total, distinct = sum(freq.values()), len(freq)
    want = dict(zip([(i, t) for i, t in rows], brute(train, [t for _, t in rows])))
    for (i, t), score in want.items():
        r = next(r for r in got if r.doc_id == i)
        own = [*words(t), None]
        assert math.isclose(r.score, score, rel_tol=1e-5, abs_tol=1e-5)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(freq[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((freq[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), rel_tol=1e-9)


def test_scores_of_odd_rows(odd, empty):
    assert len(tw.lm_scores(odd, "doc_id % 2 = 0").collect()) == odd.count()
    assert tw.lm_scores(empty, "true").collect() == []
    assert len(tw.lm_scores(odd, "false").collect()) == odd.count()


def test_the_model_beats_word_frequencies_on_held_out_text(spark):
    from tidegraph.llm.tree_weighting import op10_lm_scores

    rows = op10_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b
