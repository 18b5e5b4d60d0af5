"""Near duplicates, mixing, shards, fingerprints and neighbours against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegraph.llm import fingerprints as fp
from tidegraph.llm.mixing import mixed_rows, mixed_sizes, op9_mix_sources
from tidegraph.llm.near_dedup import Shingler, keep_one_of_each, near_duplicates, one_permutation
from tidegraph.llm.neighbours import nearest, op7_nearest
from tidegraph.llm.sharding import op4_shards, shards


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups_of(rows, width):
    """Components by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    ids = [i for i, s in sets if s and i is not None]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            where.setdefault(g, []).append(k)
    pairs = Counter((a, b) for m in where.values() for x, a in enumerate(m) for b in m[x + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_all_pairs(documents, width):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = groups_of(rows, width)
    for r in near_duplicates(documents, width=width).collect():
        assert r.component_id == want.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(shingles(dict(rows)[r.doc_id], width))


def test_near_duplicates_that_share_a_passage_with_thousands(spark):
    rng = np.random.default_rng(11)

    def own(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))

    rows, pairs = [], []
    for p in range(4):
        passage, first = own(200), len(rows)
        rows += [(first + i, f"{passage} {own(18)}") for i in range(2)]  # 196 of 232 shingles are the passage's
        rows += [(len(rows) + i, f"{passage} {own(70 + i % 60)}") for i in range(1500)]
        pairs.append(first)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    joined = {r.doc_id: r.component_id for r in near_duplicates(docs).collect() if not r.kept}
    assert joined == {first + 1: first for first in pairs}


def test_near_duplicates_in_a_template(spark):
    """Every document shares 88 words, which alone make no link; pairs share 4 words more, which does."""
    rng = np.random.default_rng(5)

    def own(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    template, rows = own(88), []
    for p in range(2000):
        both = own(4)
        rows += [(2 * p + i, " ".join([*template, *both, *own(7)])) for i in range(2)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    joined = {r.doc_id: r.component_id for r in near_duplicates(docs, width=2).collect() if not r.kept}
    assert joined == {2 * p + 1: 2 * p for p in range(2000)}


def test_near_duplicates_in_a_group_of_changed_copies(spark):
    """Copies with words exchanged at random: some links, many near misses, all shingles frequent."""
    rng = np.random.default_rng(9)
    base = [f"b{x}" for x in range(90)]
    rows = []
    for i in range(700):
        words_ = list(base)
        for at in rng.choice(90, int(rng.integers(0, 12)), replace=False):
            words_[at] = f"e{rng.integers(0, 5)}"
        rows.append((i, " ".join(words_)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_of(rows, 2)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, width=2).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in near_duplicates(odd).collect()}
    assert got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert [got[i].component_id for i in (4, 5, 6, 7, 8)] == [4, 5, 6, 6, 8] and got[4].n_shingles == 0
    assert got[None].component_id is None
    assert near_duplicates(empty).collect() == []
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 8, 9, None, 11, 12, 13])  # 10 repeats the words of 1
    twice = spark.createDataFrame([(3, "a b c"), (11, "a b c"), (11, "x y z"), (12, "x y z")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(twice, width=2).collect()} == {3}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        hits = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(600 * share), dtype=np.uint64)
            own = [rng.integers(0, 2**63, int(300 * (1 - share)), dtype=np.uint64) for _ in range(2)]
            a, b = (one_permutation(np.unique(np.concatenate([both, x]))) for x in own)
            hits.append((a == b).mean())
        exact = len(both) / (len(both) + len(own[0]) + len(own[1]))
        assert abs(np.mean(hits) - exact) < 0.05
    few = one_permutation(Shingler(2)("one two three"))
    assert len(few) == 128 and len(set(few.tolist())) == 2


def test_mix_reaches_its_targets(spark, sf, documents):
    rows = op9_mix_sources(spark, sf).collect()
    text = {r.doc_id: r for r in documents.collect()}
    by = {}
    for r in rows:
        assert r.size == len(words(text[r.doc_id].text)) and r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
        by.setdefault(text[r.doc_id].source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r.size for r in by[s]) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} | {s: share[s] for s in open_ - full}
        left -= sum(2.0 * size[s] for s in full)
        open_ -= full
        if not full or not open_:
            break
    for s in names:
        assert all(r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r.size for r in by[s])
        if target[s] >= size[s]:
            assert all(r.taken >= r.size for r in by[s])  # whole epochs first
    assert sorted(rows) == sorted(op9_mix_sources(spark, sf).collect())


def test_mix_of_odd_rows(odd, empty):
    got = mixed_sizes(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixed_sizes(odd, quality_col="n").count() == odd.count()
    assert mixed_sizes(empty).collect() == []
    own = mixed_rows(odd)
    assert own.columns == odd.columns
    assert sum(len(words(r.text)) for r in own.collect()) == sum(r.taken for r in got)


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 20, "a", 8.0 if i % 2 else 0.25) for i in range(400)] + [(1000 + i, "word " * 60, "b", 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    taken = {r.doc_id: r.taken // r.size for r in mixed_sizes(docs, quality_col="q", weights=(1, 60), share=0.9).collect()}
    good, poor = (sum(taken[i] for i in range(start, 400, 2)) for start in (1, 0))
    assert good > 3 * poor > 0


def test_shards_match_the_mixture(spark, sf, documents):
    rows = shards(documents).collect()
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    n = len(rows)
    by = {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    share = Counter(r.source for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert all(abs(c - share[s] * len(own) / n) <= 2 for s, c in Counter(r.source for r in own).items())
    assert sorted(op4_shards(spark, sf).collect()) == sorted(op4_shards(spark, sf).collect())


def test_shards_of_odd_rows(odd, empty):
    rows = shards(odd, 4).collect()
    assert len(rows) == odd.count() and Counter(r.shard for r in rows).most_common()[0][1] <= 4
    assert shards(empty).collect() == []


def plain_signature(raw):
    """Byte by byte: a chunk ends where the low bits of the hash of the last seven bytes are all set; each chunk gives a sign."""
    if not raw:
        return 4, "", ""
    at = []
    for i in range(len(raw)):
        h = sum(raw[i - j] * pow(0x01000193, j, 2**32) for j in range(min(7, i + 1))) * 0x85EBCA6B % 2**32
        at.append(h ^ h >> 15)
    ends = lambda size: [i for i, h in enumerate(at) if h % size == size - 1]
    block = 4
    while block * 64 < len(raw) or len(ends(block)) > 128:
        block *= 2
    while len(ends(block)) < 16 and block > 4 and len(ends(block // 2)) <= 128:
        block //= 2

    def signs(size):
        cut = ends(size)
        cut = cut if cut and cut[-1] == len(raw) - 1 else [*cut, len(raw) - 1]
        out, start = "", 0
        for end in cut:
            v = 0
            for k in range(end, start - 1, -1):
                v = (v * 0x9E3779B97F4A7C15 + raw[k]) % 2**64
            v ^= v >> 29
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[v * 0xBF58476D1CE4E5B9 % 2**64 >> 58]
            start = end + 1
        return out

    return block, signs(block), signs(2 * block)


def plain_likeness(a, b):
    def alike(x, y):
        if x == y:
            return 1.0
        k = min(4, len(x), len(y))
        if not k or not any(x[i : i + k] in y for i in range(len(x) - k + 1)):
            return 0.0
        row = list(range(len(y) + 1))  # edits by insertions and deletions
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(row[j - 1] if p == q else 1 + min(row[j], new[-1]))
            row = new
        return 1 - row[-1] / (len(x) + len(y))

    mine, other = {a[0]: a[1], 2 * a[0]: a[2]}, {b[0]: b[1], 2 * b[0]: b[2]}
    return 1.0 if a == b else max([alike(mine[k], other[k]) for k in mine if k in other], default=0.0)


def test_fingerprints_follow_the_next_document(spark, sf, documents):
    docs = sorted((r.doc_id, r.text or "") for r in documents.collect())
    got = {r.doc_id: r for r in fp.op8_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(text) + len(following) < 20_000:
            mine, new, other = (plain_signature(t.encode()) for t in (text, edited, following))
            assert (r.fingerprint, r.edited_fingerprint) == tuple("{}:{}:{}".format(*f) for f in (mine, new))
            assert math.isclose(r.near_edited, plain_likeness(mine, new)) and math.isclose(r.near_next, plain_likeness(mine, other))
    long = [r for i, r in got.items() if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.1 > np.mean([r.near_next for r in long])


def test_fingerprints_of_odd_rows(odd, empty):
    got = fp.fingerprint_edits(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert fp.fingerprint_edits(empty).collect() == []
    assert fp.fingerprint_edits(odd.where("doc_id = 1")).first().near_next == 1.0


def test_rows_of_one_id_are_spread(spark):
    docs = spark.range(3_000).selectExpr("CASE WHEN id < 2000 THEN 7 ELSE id END AS doc_id", "repeat(concat('t', cast(id * 7919 % 3000 AS string), ' '), 30) AS text", "'a' AS source")
    placed = fp.with_next(docs.select("doc_id", "text"), 20_000)
    held = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(held) > 15 and max(held) < 500
    got = fp.fingerprint_edits(docs, part_bytes=20_000).collect()
    assert Counter(r.doc_id for r in got)[7] == 2000 and len(got) == 3000
    rows = shards(docs, 16, rows_per_bucket=50).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [187] * 8 + [188] * 8
    ones = spark.range(640).selectExpr("id AS doc_id", "'x' AS text", "cast(id AS string) AS source")  # sources of one row each
    own = shards(ones, 4).groupBy("shard").agg({"doc_id": "count"}).collect()
    assert {r[1] for r in own} == {160}


def test_common_subsequences():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 90))) for _ in range(2))
        assert fp.common_subsequence(a, b) == slow(a, b)


def test_neighbours_are_found(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in op7_nearest(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q, found in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = [int(i) for _, i in sorted(zip(-s, ids))[:20]]
        assert sorted(found) == list(range(1, 21))
        assert all(math.isclose(score, s[ids == i][0], rel_tol=1e-12, abs_tol=1e-12) for i, score in found.values())
        hits += len(set(best) & {i for i, _ in found.values()})
    assert hits >= 0.95 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(60)]
    rows = [*same, (60, None), (61, [0.0, 0.0]), (62, [float("nan"), 1.0]), (63, [None, 1.0]), (64, [1.0]), (65, [-1.0, 3.0]), (65, [-1.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS score", "vec_id AS i", "vec_id AS v")
    got = {}
    for r in nearest(df, 20, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        want = [i for i in range(60) if i != q][:5]
        assert [i for _, i, _ in sorted(found)] == want and all(s == 5.0 for _, _, s in found)
    assert nearest(df.where("false")).collect() == []
    few = nearest(df.where("vec_id IN (0, 65)"), 20, 5).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(0, 65, 5.0)]


def test_pipeline_stages(spark, sf, documents):
    """Each stage on what its predecessor kept: the filters against scores and all pairs, the mix against SQL, the packing against its laws."""
    import duckdb

    import corpus_pipeline as p
    from tests.llm.test_tokens import packed_well
    from tidegraph.llm.language_id import identify
    from tidegraph.llm.mixing import ORACLE
    from tidegraph.llm.quality import quality_scores

    stages, docs = dict(p.STAGES), documents
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def step(name):
        out = stages[name](spark, docs, sf)
        assert out.columns == documents.columns
        return spark.createDataFrame(out.collect(), documents.schema)

    scores = {r.doc_id: r.score for r in quality_scores(documents, labels).collect()}
    good = step("quality_classifier")
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3}
    docs, found = good, {r.doc_id: r for r in identify(good).collect()}
    known = step("language_id")
    assert {r.doc_id for r in known.collect()} == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= 0.5}
    docs, component = known, groups_of([(r.doc_id, r.text) for r in known.collect()], 5)
    once = step("minhash_near_dedup")
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in known.collect() if component.get(r.doc_id, r.doc_id) == r.doc_id}
    docs = once
    mixed = step("mix_sources")
    db = duckdb.connect()
    db.register("documents", once.toPandas())
    want = {i: taken // size for i, size, taken in db.execute(f"SELECT doc_id, size, taken FROM ({ORACLE})").fetchall() if taken}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    docs = mixed
    packed_well(stages["best_fit_packing"](spark, docs, sf).collect(), mixed.collect(), 1024)
    rows = p.run(spark, sf).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == want


def test_pipeline_stages_of_odd_and_empty_tables(spark, sf, odd, empty):
    import corpus_pipeline as p

    for first in (odd, empty):
        docs = first
        for _, stage in p.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), first.schema)
        assert p.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
