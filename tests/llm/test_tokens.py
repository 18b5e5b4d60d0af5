"""Token counts and packing against the library itself."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm.bpe import SPECIAL, Counts, Ids, frequent_units, unit_counts, units, vocabulary
from tidegraph.llm.packing import best_fit, completion, pack
from tidegraph.llm.token_counts import op1_token_counts, token_counts
from tokenizers import Tokenizer

PATH = vocabulary()
WHOLE = Tokenizer.from_file(f"{PATH}.json")


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


ALPHABET = st.text(alphabet=st.sampled_from(list("ab Z9'.!|é日\n\t\r\x0b\x1c  <|>")) , max_size=60) | st.text(max_size=40) | st.just("x <|endoftext|> y")


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_units_give_the_library_s_ids(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    want = ids(text)
    assert Counts(PATH)(text) == len(want)
    assert Ids(PATH)(text) == np.array(want, "<u4").tobytes()


def test_small_caches_change_nothing(documents):
    rows = documents.limit(60).collect()
    few = Counts(PATH, most=10)
    assert [few(r.text) for r in rows] == [len(ids(r.text)) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | ALPHABET.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), max_size=5))
def test_units_of_an_array_are_those_of_its_texts(some):
    want = Counter(u for t in some if t is not None and SPECIAL not in t for u in units(t) if 0 < len(u) < 200)
    got = unit_counts(pa.array(some, pa.string())).to_pylist()
    assert want == {r["unit"]: r["n"] for r in got} and len(want) == len(got)


def test_frequent_units_are_those_of_whole_texts_of_the_whole_table(spark):
    """The most frequent words come after 1,200 other texts, and far inside a long one."""
    rows = [f"early{i} early{i}" for i in range(1_200)] + ["late word late word late word"] * 3 + [None, "", " ", "z " * 15_000 + "deep deep deep deep a"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    assert set(frequent_units(docs, 4, PATH)) == {"z", "late", "word", "deep"}
    few = frequent_units(docs, 5, PATH)
    assert len(few) == 5 and few == {u: Counts(PATH).get(u) for u in few}
    got = token_counts(docs, frequent=3).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(ids(t))) for i, t in enumerate(rows)]


def test_counts_of_all_documents(spark, sf, documents):
    got = {r.doc_id: r for r in op1_token_counts(spark, sf).collect()}
    for r in documents.collect():
        n = len(ids(r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 1024)


def test_counts_of_odd_rows(odd, empty):
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts(odd).collect())
    assert got == Counter((r.doc_id, len(ids(r.text))) for r in odd.collect())
    assert token_counts(empty).collect() == []


def packed_well(rows, docs, cap):
    """Pieces hold the documents' ids; sequences are gapless and within ``cap``."""
    want = Counter()
    for r in docs:
        own = [*ids(r.text), 2]
        edges = [0, *range(len(own) % cap or cap, len(own) + 1, cap)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(r.doc_id, i, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes()))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


@pytest.mark.parametrize("cap", [16, 1024])
def test_packing(documents, cap):
    some = documents.limit(120)
    rows = pack(some, cap).collect()
    used = packed_well(rows, some.collect(), cap)
    assert used <= sum(k for _, k in best_fit(dict(Counter(r.length for r in rows)), cap))


def test_packing_of_odd_rows(odd, empty):
    packed_well(pack(odd, 64).collect(), odd.collect(), 64)
    assert pack(empty).collect() == []


def test_completion_reaches_the_least_number_where_best_fit_does_not():
    counts = {60: 1, 50: 1, 30: 1, 20: 2, 10: 1}  # 60+30+10, 50+... : 190 in two of 100
    assert sum(k for _, k in completion(counts, 100)) == 2
    counts = {7: 1, 6: 1, 5: 1, 4: 1, 3: 2, 2: 1}  # best fit: 7+3, 6+4, 5+3+2
    assert sum(k for _, k in completion(counts, 10)) == 3
    many = Counter((i * 7919) % 1023 + 1 for i in range(50_000))
    plan = completion(dict(many), 1024)
    held = Counter()
    for lengths, k in plan:
        assert sum(lengths) <= 1024
        for s in lengths:
            held[s] += k
    assert held == many
    assert sum(k for _, k in plan) <= 1.01 * sum(s * n for s, n in many.items()) / 1024 + 1
