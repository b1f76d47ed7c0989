import base64

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from morsel.llm.bpe import PATTERN, RANKS_PATH, decode_documents, encode_documents, encoder
from morsel.llm.token_counts import length_histogram, length_quantiles, suffix_sums, truncated_totals

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "  ", "a", "Hello world's end", "a  b", "a\n\n b", " lead", "tail ", "\n", "x\t y", "été Übung 漢字 🙂", "aaaa" * 40, "the&&& of%%%", "1234 567", " wide  space", "a \x1c b", "<|endoftext|>"]


def test_same_ids_as_public_library(peer):
    ids, off = encoder(RANKS_PATH).encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert ids[off[i] : off[i + 1]].tolist() == peer.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab eé\n\t'sRT漢9!&    ")), max_size=90), max_size=5))
def test_random_texts(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS_PATH, "rb"))} if not hasattr(test_random_texts, "r") else test_random_texts.r
    test_random_texts.r = ranks
    enc = encoder(RANKS_PATH)
    ids, off = enc.encode(texts)
    assert enc.decode(ids, off) == texts
    for i, t in enumerate(texts):
        want = [x for p in regex.findall(PATTERN, t) for x in slow(p.encode(), ranks)]
        assert ids[off[i] : off[i + 1]].tolist() == want


def slow(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_long_word_and_heap(peer):
    words = ["ab" * 5000, "abcdefgh" * 30, "x" * 2000]
    ids, off = encoder(RANKS_PATH).encode(words)
    for i, t in enumerate(words):
        assert ids[off[i] : off[i + 1]].tolist() == peer.encode_ordinary(t)


def test_documents(spark, peer):
    rows = [(1, "Hello the world"), (2, None), (3, ""), (1, "Hello the world"), (None, "x y")]
    df = spark.createDataFrame([(a, b, 9) for a, b in rows], DOC + ", ids int")
    got = encode_documents(df).collect()
    assert sorted(map(str, [(r.doc_id, r.n_tokens) for r in got])) == sorted(map(str, [(1, 3), (2, None), (3, 0), (1, 3), (None, 2)]))
    assert all(r.lossless for r in got if r.ids is not None)
    back = decode_documents(encode_documents(df))
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame(rows, DOC).collect()))
    assert decode_documents(spark.createDataFrame([(1, [60000]), (2, [None]), (3, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()[:] == [(1, None), (2, None), (3, "")]
    assert encode_documents(df.limit(0)).count() == 0


def test_histogram(spark, peer):
    rows = [(i, "word " * (i * 37 % 3000)) for i in range(120)] + [(1, None), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, DOC)
    lens = [len(peer.encode_ordinary(t)) for _, t in rows if t is not None]
    sums = suffix_sums(length_histogram(df)).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == lens.count(n) and r.tokens == n * r.n_docs
        assert r.docs_at_least == sum(x >= n for x in lens) and r.tokens_at_least == sum(x for x in lens if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lens) and r.total_tokens == sum(lens) and r.total_docs == len(lens)
        assert r.quantile == pytest.approx(sum(x <= n for x in lens) / len(lens))
    limits = [0, 1, 5, 777, 2048, 10**6]
    for r in truncated_totals(sums, limits).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lens) and r.docs_over == sum(x > r.context_limit for x in lens)
    for r in length_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(n for n in lens if sum(x <= n for x in lens) >= r.share * len(lens))
    assert suffix_sums(length_histogram(df.limit(0))).count() == 0


def test_histogram_of_clashing_columns_and_very_long_texts(spark, peer):
    long = "long text, " * 60000
    df = spark.createDataFrame([("a", 7, long, 1), ("b", 7, "x", 1), (None, 7, "x", 1)], "n_docs string, n_tokens int, text string, doc_id int")
    got = {r.n_tokens: r.n_docs for r in suffix_sums(length_histogram(df)).collect()}
    assert got == {len(peer.encode_ordinary(long)): 1, len(peer.encode_ordinary("x")): 2}
