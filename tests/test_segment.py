import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morsel.functions.text import FLAG
from morsel.operators import decode, segment
from morsel.operators.kernel import joined
from morsel.sources import vocab_files
from morsel.tokenizer import Tokenizer

BYTES = [(i, bytes([i]), -8.0) for i in range(256)]
WORDS = ["hello", "world", " world", "при", "вет", "你好", "😀", "he", "llo", "  ", "\n\n", "tion", "    "]
FULL = BYTES + [(256 + i, w.encode(), -1.0 - 0.1 * i) for i, w in enumerate(WORDS)]


def tok(*words):
    return Tokenizer([(i, w.encode(), p) for i, (w, p) in enumerate(words)])


def brute(t: Tokenizer, text: str):
    """Least (count, cost) over all paths of a short text taken as one stretch."""
    data, best = text.encode(), None
    vocab = t.segmenter.tokens

    def go(at, ids, cost):
        nonlocal best
        if at == len(data):
            key = (len(ids), float(cost))
            if best is None or key < best:
                best = key
            return
        spaced = data[at] == 32 and at + 1 < len(data)
        start = at + 1 if spaced else at
        for end in range(start + 1, len(data) + 1):
            if data[start:end] in vocab:
                i, p = vocab[data[start:end]]
                go(end, [*ids, i | (FLAG if spaced else 0)], cost - p)
        if spaced and b" " in vocab:
            i, p = vocab[b" "]
            go(at + 1, [*ids, i], cost - p)

    go(0, [], np.float32(0))
    return best


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab h", max_size=8))
def test_best_of_all_paths(text):
    t = tok(("a", -1.0), ("b", -1.5), (" ", -2.0), ("h", -1.0), ("ab", -1.25), ("ba", -1.75), ("ha", -0.5), ("abh", -3.0), (" a", -0.25), ("  ", -1.0))
    ids = t.encode_batch([text])[0]
    cost = np.float32(0)
    for i in ids:
        cost = cost - t.segmenter.tokens[t.tokens[i & (FLAG - 1)]][1]
    assert (len(ids), float(cost)) == (brute(t, text) or (0, 0.0))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    t = Tokenizer(FULL)
    ids = t.encode(text)
    assert t.decode(ids) == text and t.encode(text) == ids and bool(ids) == bool(text)
    assert t.decode(t.encode_batch([text])[0]) == text


def test_rules():
    t = tok(("a", -0.5), ("b", -0.5), ("ab", -1.5), (" ", -1.0), ("tok", -1.0), ("hello", -1.0))
    assert t.encode("ab") == [2] and t.encode("hello tok") == [5, 4 | FLAG] and t.encode(" ") == [3] and t.encode("") == []
    # a run of spaces takes the flag and the rest; its parts keep apart from the word
    assert t.encode("  ") == [3 | FLAG] and t.encode("  a") == [3 | FLAG, 0]
    x = tok((" ", -1.0), ("x", -1.0))
    assert x.encode("  x") == [FLAG, 1] and x.encode_batch(["  x"]) == [[0, 1 | FLAG]]


def test_unknown_characters():
    t = tok(("a", -1.0), ("b", -1.0), ("<unk>", 0.0), ("abz", -1.0))
    assert t.encode("aéb") == [0, 2, 1] and t.encode("€") == [2] and t.encode("ab\U0001f600ab") == [0, 1, 2, 0, 1]
    assert t.decode(t.encode("a€b")) == "a<unk>b"
    assert len(t.encode("€" * 5000)) == 5000


def test_errors_and_lookup():
    t = Tokenizer(FULL)
    assert t.vocab_size == len(FULL) and t.token_to_id(b"hello") == 256 and t.token_to_id(b"none") is None
    with pytest.raises(decode.DecodeError):
        t.decode([len(FULL)])
    with pytest.raises(decode.DecodeError):
        t.decode([0xC3])
    with pytest.raises(ValueError):
        segment.Segmenter({b"a": (FLAG, 0.0)})
    assert t.encode_numpy("hello").dtype == np.uint32
    assert t.decode_batch([[256], []]) == ["hello", ""]
    assert Tokenizer([(0, b"a", -1.0), (1, b"a", -2.0)]).encode("a") == [1]


def test_long_text():
    t = Tokenizer(FULL)
    assert t.encode("a" * 100_000) == [97] * 100_000


CASES = ["", " ", "x", "    indent\n\tif a  b:", "hello world", "é€😀 flags 🇩🇪", "a" * 512, '{"k":[1,2]}', "mixed при вет 你好", "\r\nend ", "\0nul"]


def test_table_equals_single_and_lattice(spark):
    t = Tokenizer([(i, chr(i).encode(), -8.0 - i / 512) for i in range(128)] + [(128 + i, w.encode(), -1.0 - 0.1 * i) for i, w in enumerate(WORDS)] + [(200 + i, c.encode(), -9.0) for i, c in enumerate("é€🇩🇪")])
    df = spark.createDataFrame([(i, c, 0) for i, c in enumerate([*CASES, None])], "doc_id int, text string, ids0 int")
    got = {r["doc_id"]: r["ids"] for r in t.encode_table(df).collect()}
    assert got == {**{i: t.encode(c) for i, c in enumerate(CASES)}, len(CASES): None}
    whole = {r["doc_id"]: r["ids"] for r in t.encode_table(df, mode="whole").collect()}
    assert [whole[i] for i in range(len(CASES))] == t.encode_batch(CASES)
    vocab = spark.createDataFrame([(i, bytearray(w), p) for i, w, p in [(i, k, float(p)) for k, (i, p) in t.segmenter.tokens.items()]], "token_id int, token binary, log_prob float")
    sql = {r["doc_id"]: r["ids"] for r in segment.encode_by_units(df, vocab).collect()}
    assert all(sql[i] == got[i] for i in sql if None not in (sql[i] or [None]) and sql[i]) and len(sql) == len(CASES) - 1
    back = t.decode_table(t.encode_table(df)).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    joined = {r["doc_id"]: r["decoded"] for r in decode.decode_by_join(t.encode_table(df.filter("text is not null")), vocab).collect()}
    assert joined == dict(enumerate(CASES))
    with pytest.raises(ValueError):
        segment.encode(df, t.segmenter, mode="other")


def test_decode_table_errors(spark):
    t = Tokenizer(FULL)
    df = spark.createDataFrame([(1, [0xC3]), (2, [256, 99_999]), (3, [256]), (4, None), (5, [])], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in t.decode_table(df, strict=False).orderBy("doc_id").collect()] == [None, None, "hello", None, ""]
    with pytest.raises(Exception, match="DecodeError|unknown token|UTF-8"):
        t.decode_table(df).collect()


def test_files(spark, tmp_path):
    path = f"{tmp_path}/v.bin"
    vocab = spark.createDataFrame([(i, bytearray(w), p) for i, w, p in reversed(FULL)], "token_id int, token binary, log_prob float")
    vocab_files.write_vocab(vocab, path)
    t = Tokenizer.from_file(path)
    assert t.tokens == [w for _, w, _ in FULL] and sorted(map(tuple, vocab_files.read_vocab(spark, path).collect())) == sorted(map(tuple, vocab.collect()))
    vocab_files.write_vocab(vocab, f"{tmp_path}/v.parquet")
    assert Tokenizer.load(spark, f"{tmp_path}/v.parquet").encode("hello") == [256]
    data = open(path, "rb").read()
    assert vocab_files.parse(data + b"more") == vocab_files.parse(data)
    for bad in (b"XXXX" + data[4:], data[:-1], b""):
        with pytest.raises(vocab_files.VocabError):
            vocab_files.parse(bad)
    with pytest.raises(vocab_files.VocabError):
        vocab_files.pack([(b"a" * 256, 0.0)])
    assert os.path.getsize(path) == 8 + sum(5 + len(w) for _, w, _ in FULL)


def test_ties_take_the_smallest_start():
    t = tok(("a", -1.0), ("aa", -1.0))
    assert t.encode("aaa") == [0, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab  h€", max_size=12), max_size=6))
def test_units_of_buffers_are_those_of_the_pattern(texts):
    data, off = joined([t.encode() for t in texts])
    at = segment.cut_units(data, off)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])] == [u for t in texts for u in segment._UNIT.findall(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab hé€", max_size=30), max_size=8), st.sampled_from([True, False]))
def test_many_at_once_equal_one_at_a_time(texts, double):
    words = [("a", -1.0), ("b", -1.1), (" ", -2.3), ("h", -1.7), ("ab", -1.25), ("ba", -1.3), ("hab", -0.7), ("bb", -2.2), ("é", -3.1), ("<unk>", 0.0), *([("  ", -1.0), ("a b", -2.0)] if double else [])]
    t = tok(*words)
    s = t.segmenter
    ids, off = s.encode_texts(*joined([x.encode() for x in texts]), True)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [s.segment(x.encode()) for x in texts]
    ids, off = s.encode_texts(*joined([x.encode() for x in texts]))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [[i for u in segment._UNIT.findall(x) for i in s.segment(u.encode())] for x in texts]


def test_ties_of_long_texts_are_those_of_one_walk():
    """Costs of a long text are so large that single precision rounds differences away: the whole text decides, not its words."""
    rng = np.random.default_rng(0)
    t = tok(*[(w, float(p)) for w, p in zip(["a", "b", "c", " ", "ab", "bc", "ca", "abc", "bca"], -rng.random(9) * 1000 - 1)])
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(2000)) for _ in range(3)]
    assert t.encode_batch(texts) == [t.segmenter.segment(x.encode()) for x in texts]


def test_depth_of_the_trie_changes_nothing():
    for depth in (1, 2, 4):
        a, b = Tokenizer(FULL), Tokenizer(FULL, depth)
        for text in CASES:
            assert a.encode(text) == b.encode(text) and a.encode_batch([text]) == b.encode_batch([text])


def test_byte_fallback():
    rows = [(i, bytes([i]), -8.0) for i in range(256) if i != 0x7A] + [(300, b"ab", -1.0)]
    t = Tokenizer([(i, b, p) for i, b, p in rows if b != b"b"], byte_fallback=True)
    with pytest.raises(ValueError, match="0x7a"):
        t.encode("az")
    assert Tokenizer(FULL, byte_fallback=True).encode("é") == [0xC3, 0xA9]
    few = Tokenizer([(0, b"a", -1.0), (1, b"b", -1.0), (2, b"\xc3", -1.0), (3, b"\xa9", -1.0)], byte_fallback=True)
    assert few.encode("aéb") == [0, 2, 3, 1]


def test_only_the_space_flag_is_taken_out_of_ids(spark):
    t = Tokenizer([(0, b"a", -1.0), (1, b"b", -1.0), (3, b"d", -1.0)])
    assert t.decode([1 | FLAG, 0]) == " ba"
    for bad in ([2**23 + 1], [2**24], [-(2**22) + 1], [-1], [2], [4]):
        with pytest.raises(decode.DecodeError, match="unknown token id"):
            t.decode(bad)
    df = spark.createDataFrame([(k, x) for k, x in enumerate([[2**23 + 1, 2**24], [-(2**22) + 1], [2], [1 | FLAG, 0], [3], None])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in t.decode_table(df, strict=False).collect()}
    assert got == {0: None, 1: None, 2: None, 3: " ba", 4: "d", 5: None}
    vocab = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"b")), (3, bytearray(b"d"))], "token_id int, token binary")
    assert {r["doc_id"]: r["decoded"] for r in decode.decode_by_join(df.filter("ids is not null"), vocab).collect()} == {k: v for k, v in got.items() if k < 5}


def test_counts_are_those_of_the_ids(spark):
    from collections import Counter

    t = Tokenizer(FULL)
    df = spark.createDataFrame([(c,) for c in [*CASES, None]], "text string")
    want = Counter(i for c in CASES for i in t.encode(c))
    assert {r["x"]: r["n"] for r in segment.count_ids(df, t.segmenter).collect()} == dict(want)


def test_long_tokens_are_found_without_a_walk_in_python():
    """Tokens beyond the trie's depth by hashes of windows, as the whole trie finds them; the tables hold no dictionary to walk."""
    import numpy as np

    from morsel.operators.kernel import Trie

    tokens = [b"a", b"abca", b"bcab", b"abcab", b"\xc3\xa9abc", b"cabc", b"b"]
    data = np.frombuffer(b"abcabcab\xc3\xa9abcabca", np.uint8)
    limit = np.repeat(np.array([7, len(data)]), [7, len(data) - 7]).astype(np.int32)
    found = [sorted(zip(*(x.tolist() for x in Trie(tokens, d).matches(data, limit)))) for d in (None, 3, 1)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 8
    assert all(isinstance(x, tuple) for x in Trie(tokens, 3).long.values())


def test_slices_of_a_batch_give_the_same_ids(monkeypatch):
    """However few bytes are worked on together, with nulls and empty texts, and no more of them at once."""
    import pyarrow as pa

    from morsel.operators import segment

    s = segment.Segmenter({b"<unk>": (0, 0.0), b" ": (1, -1.0), b"a": (2, -1.0), b"ab": (3, -2.0), b"b": (4, -1.5)})
    texts = pa.array(["ab a", None, "", "  b ab", "aabb x", "", None], pa.string())
    want = segment.id_lists(s, texts).to_pylist()
    sizes, once = [], s.encode_texts
    monkeypatch.setattr(s, "encode_texts", lambda raw, off, whole: sizes.append(len(raw)) or once(raw, off, whole))
    monkeypatch.setattr(segment, "SLICE", 5)
    assert segment.id_lists(s, texts).to_pylist() == want and want[1] is None and want[2] == []
    assert max(sizes) <= 6


def _no_paths(monkeypatch):
    def refuse(*_):
        raise AssertionError("a word went by Paths")

    monkeypatch.setattr(segment.Segmenter, "_paths", refuse)


def test_words_grow_by_tokens(monkeypatch):
    t = tok(("a", -1.0), ("b", -1.5), ("c", -2.0), ("é", -1.0), ("ab", -1.25), ("bc", -1.75), ("abc", -9.0), ("ca", -0.5), ("<unk>", 0.0))
    texts = ["abcab caabc", "b", "éab abé  abca", "", " ab bcbcca"]
    want = [[i for u in segment._UNIT.findall(x) for i in t.segmenter.segment(u.encode())] for x in texts]
    assert [t.segmenter.encode(x).tolist() for x in texts] == want
    t.segmenter._fresh()
    _no_paths(monkeypatch)
    assert [t.segmenter.encode(x).tolist() for x in texts if "  " not in x] == [w for x, w in zip(texts, want) if "  " not in x]


def test_whole_words_with_clear_paths_are_made_once(monkeypatch):
    t = tok(("a", -1.0), ("b", -1.5), (" ", -3.0), ("ab", -1.25), ("ba", -4.75), ("x", -2.0))
    texts = ["abab ba bab", " xab ab", ""] * 3
    want = [t.segmenter.segment(x.encode()) for x in texts]
    _no_paths(monkeypatch)
    assert [t.segmenter.encode(x, True).tolist() for x in texts] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=9), max_size=40), st.integers(0, 3))
def test_whole_ties_are_those_of_one_walk(parts, kind):
    cost = [[-0.1] * 9, [-0.3, -0.1, -0.2, -0.7] * 3, [-1000.1, -0.1, -999.9, -0.2] * 3, [0.5, -0.25, 0.75] * 3][kind]
    words = ["a", "b", " ", "ab", "ba", "aab", "bb", "aa", "  "]
    t = tok(*zip(words, cost))
    text = "aabab abba " * 30 + " ".join(parts)
    assert t.segmenter.encode(text, True).tolist() == t.segmenter.segment(text.encode())


def test_lattice_in_small_parts(spark, monkeypatch):
    """Slices of a few edges, units in more than one byte a character, and null where no path reaches the end."""
    monkeypatch.setattr(segment, "EDGES", 4)
    words = [("a", -1.0), ("é", -1.5), (" ", -2.0), ("aé", -1.25), ("éa", -1.75), ("aéa", -3.0), ("  ", -1.0)]
    vocab = spark.createDataFrame([(i, w.encode(), p) for i, (w, p) in enumerate(words)], "token_id int, token binary, log_prob float")
    units = ["a", " aéa", "éaéa", "   ", " ", "ax", "x", "aéaaéaéé"]
    rows = segment.lattice_encode(spark.createDataFrame([(u,) for u in units], "unit string").coalesce(1), vocab).collect()
    t = tok(*words)
    assert {r["unit"]: r["ids"] for r in rows} == {u: None if "x" in u else t.segmenter.segment(u.encode()) for u in units}
