import base64
import os
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import packing as P
from lumenframe.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.default_vocabulary()), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def pair():
    with open(T.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return T.encoder(T.default_vocabulary()), tiktoken.Encoding("own", pat_str=T.PIECES, mergeable_ranks=ranks, special_tokens={})


TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdefgh  \n\t'.,0123é漢字")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encodes_like_the_public_library(pair, text):
    assert pair[0].encode(text) == pair[1].encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.data())
def test_appends_and_edits_equal_a_fresh_encoding(pair, a, b, data):
    enc, ref = pair
    assert T.PrefixTable(enc, a).append(b).ids() == ref.encode_ordinary(a + b)
    at = data.draw(st.integers(0, len(a)))
    gone = data.draw(st.integers(0, len(a) - at))
    assert T.PrefixTable(enc, a).edit(at, gone, b).ids() == ref.encode_ordinary(a[:at] + b + a[at + gone :])


def test_every_prefix_has_its_own_last_token(pair):
    enc, ref = pair
    data = "unbelievable123".encode()
    table = enc.last_tokens(data)
    for n in range(1, len(data) + 1):
        assert enc.read_back(table[:n]) == enc._merged(data[:n])
    assert enc.last_tokens(data, table[:5]) == table
    long = "z" * 200_000 + " " * 1000 + "<|endoftext|>"
    assert enc.encode(long) == ref.encode_ordinary(long)


def test_corpus_rows(spark, pair):
    docs = spark.createDataFrame([(1, "two words", "t", 1), (2, "", None, 1), (3, None, "t", 1), (1, "two words", "t", 1), (None, " ", "", 1)], "doc_id bigint, text string, title string, ids int")
    got = T.encode_corpus(docs).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted([(1, pair[1].encode_ordinary("two words"))] * 2 + [(2, []), (3, []), (0, pair[1].encode_ordinary(" "))])
    app = {r.doc_id: (r.n_before, r.ids) for r in T.encode_appended(docs).collect()}
    assert app[3] == (0, pair[1].encode_ordinary("\nt")) and app[1] == (2, pair[1].encode_ordinary("two words\nt"))
    assert T.encode_corpus(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plans_place_every_length_and_keep_the_capacity(hist):
    placed = Counter()
    for content, r in P.plan_containers(hist, 40):
        assert r > 0 and sum(s * m for s, m in content.items()) <= 40
        for s, m in content.items():
            placed[s] += m * r
    assert placed == Counter(hist)


def test_plans_waste_little():
    import numpy as np

    lengths = np.random.default_rng(0).gamma(1.5, 60, 20_000).astype(int).clip(1, 511)
    hist = dict(Counter(lengths.tolist()))
    n = sum(r for _, r in P.plan_containers(hist, 512))
    assert n <= 1.005 * np.ceil(lengths.sum() / 512)


def test_posts_are_packed_whole(spark, pair):
    words = lambda n: " ".join(["word"] * n)
    docs = spark.createDataFrame([(i, words(n)) for i, n in enumerate([1, 5, 9, 10, 11, 20, 25, 33, 3, 3, 3])] + [(90, None), (91, ""), (5, words(4)), (None, words(2))], "doc_id bigint, text string")
    limits = spark.createDataFrame([("ten", 10), ("big", 100), ("bad", 0), (None, None)], "plan_name string, capacity int")
    got = P.pack_posts(docs, limits).collect()
    for name, cap in (("ten", 10), ("big", 100)):
        rows = [r for r in got if r.plan_name == name]
        fill = Counter()
        for r in rows:
            assert len(r.ids) == r.n_tokens
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap and sum(fill.values()) == sum([1, 5, 9, 10, 11, 20, 25, 33, 9, 4, 2])
        long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.start)
        assert [r.n_tokens for r in long] == ([10, 10, 10, 3] if cap == 10 else [33])
        assert sum((r.ids for r in long), []) == pair[1].encode_ordinary(words(33))
        assert all(len([r for r in rows if r.doc_id == d]) == 1 for d in (0, 1, 2, 3))
    assert P.pack_posts(docs.limit(0), limits).count() == 0 and P.pack_posts(docs, limits.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [64, 512, 2048, 32768])
def test_patterns_place_most_tokens_and_nothing_is_lost(capacity):
    import collections

    rng = np.random.default_rng(capacity)
    hist = collections.Counter(int(v) for v in np.clip(rng.lognormal(np.log(capacity / 16), 0.9, 40_000), 1, capacity - 1))
    boxes, placed = P.pack_histogram(hist, capacity)
    used, total = collections.Counter(), sum(s * c for s, c in hist.items())
    for content, r in boxes:
        assert r > 0 and sum(s * m for s, m in content.items()) <= capacity
        for s, m in content.items():
            used[s] += m * r
    assert used == hist
    assert placed > (0.3 if capacity < 10_000 else 0.1) * total  # a wide range of lengths has few posts for each
    assert sum(r for _, r in boxes) <= 1.01 * -(-total // capacity) + 1
    assert P.pack_histogram({}, capacity) == ([], 0)
