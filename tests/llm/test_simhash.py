import glob
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from morsel.llm.common import U64, Scratch, hash_spans, words, text_buffer
from morsel.llm.components import connected_components
from morsel.llm.common import mix64
from morsel.llm.simhash import BITS, MOST, RADIUS, _fingerprint_batches, copies, drop_near_duplicates, fingerprints, near_duplicate_groups, near_links, near_pairs, plan_high, plan_segments

DOC = "doc_id long, text string"


def groups_of(edges):
    p = {}

    def r(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = r(a), r(b)
        p[max(a, b)] = min(a, b)
    return {x: r(x) for x in p}


def test_word_hash_is_the_same_anywhere():
    raw, off = text_buffer(pa.array(["été one two", None, "", "two, one"]))
    s, e, f = words(raw, off)
    h = hash_spans(raw, s, e)
    assert np.diff(f).tolist() == [3, 0, 0, 2] and h[1] == h[4] and h[2] == h[3] and len(set(h.tolist())) == 3


def test_segments_cover_the_radius():
    for n in (1, 1000, 10**6, 10**9, 10**12):
        for radius in (0, 3, 12, 20):
            seg = plan_segments(n, radius)
            assert sum(w for _, w, _ in seg) == BITS and sum(b + 1 for *_, b in seg) == radius + 1


@pytest.mark.parametrize("radius", [3, 12, RADIUS])
def test_pairs_against_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, size=(60, 2), dtype=np.int64)
    fp = [base]
    for flips in (1, 4, radius, radius + 1):
        x = base.copy()
        for row in x:
            for b in rng.choice(BITS, flips, replace=False):
                row[b // 64] ^= np.int64(np.uint64(1 << int(b % 64)).view(np.int64))
        fp.append(x)
    fp = np.unique(np.concatenate(fp), axis=0)
    u = fp.view(U64)
    d = np.bitwise_count(u[:, None] ^ u[None]).sum(-1)
    want = groups_of([(i, j) for i, j in np.argwhere(d <= radius).tolist() if i < j])
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(fp)], "node long, hi long, lo long")
    # every link is counted once, whatever the tasks; a few documents a node
    docs = np.arange(len(fp)) % 3 + 1
    links = ((d <= radius) * docs).sum(1) - docs
    weighed = spark.createDataFrame([(i, int(a), int(b), int(n)) for i, ((a, b), n) in enumerate(zip(fp, docs))], "node long, hi long, lo long, docs long")
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(fp)}
    for most in (MOST, 40, 2):
        got = [(r.a, r.b) for r in near_pairs(df, len(fp), radius, most).collect()]
        # a forest joins nodes that are linked by way of others too
        assert groups_of(got) == want
        have = np.zeros(len(fp), dtype=int)
        for r in near_links(weighed, len(fp), radius, most).filter("b is null").collect():
            have[at[r.hi, r.lo]] += r.links
        assert (have == links).all()


def test_hot_tables_are_cut(spark):
    """A third and more of all fingerprints share their high bits everywhere: their tables go in tiles, links stay whole."""
    rng = np.random.default_rng(2)
    hot = np.full((150, 2), 12345678901234, dtype=np.int64)
    for row in hot:
        for b in rng.choice(16, 5, replace=False):
            row[b % 2] ^= np.int64(1 << int(b * 3))
    fp = np.unique(np.concatenate([hot, rng.integers(0, 2**63, size=(100, 2), dtype=np.int64)]), axis=0)
    u = fp.view(U64)
    d = np.bitwise_count(u[:, None] ^ u[None]).sum(-1)
    df = spark.createDataFrame([(i, int(a), int(b), 1) for i, (a, b) in enumerate(fp)], "node long, hi long, lo long, docs long")
    rows = near_links(df, len(fp), RADIUS, 12).collect()
    at = {(int(a), int(b)): i for i, (a, b) in enumerate(fp)}
    have = np.zeros(len(fp), dtype=int)
    for r in rows:
        if r.b is None:
            have[at[r.hi, r.lo]] += r.links
    assert (have == (d <= RADIUS).sum(1) - 1).all()
    assert groups_of([(r.a, r.b) for r in rows if r.b is not None]) == groups_of([(i, j) for i, j in np.argwhere(d <= RADIUS).tolist() if i < j])


def test_rows_moved_follow_the_nodes():
    for n in (10**5, 10**6, 10**7, 10**8, 10**9):
        assert n / (1 << plan_high(n, plan_segments(n, RADIUS))) <= MOST
    assert copies(10**5) < 20 and copies(236_000) < 20 and copies(10**7) < 30 and copies(10**9) < 400


def test_fingerprint_votes():
    """Each bit is the majority over distinct words of the bit of the word's hash; a tie is 0."""
    text = "red green blue red one two two three"
    raw, off = text_buffer(pa.array([text]))
    s, e, _ = words(raw, off)
    h = {text[a:b]: int(x) for a, b, x in zip(s, e, hash_spans(raw, s, e))}
    feature = mix64(np.array([x >> 20 for x in h.values()], dtype=U64))
    both = [feature, mix64(feature + U64(0x5851F42D4C957F2D))]
    want = [sum(1 << b for b in range(64) if 2 * sum(int(f) >> b & 1 for f in side) > len(h)) for side in both]
    assert len(h) == 6 and fingerprints(pa.array([text]))[0][0].tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 250), (250, 230)]
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.doc_id: r.group_id for r in got.collect()} == groups_of([e for e in edges if e[0] != e[1]])


def test_documents(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}x" for i in range(3000)]
    text = [" ".join(rng.choice(vocab, 300)) for _ in range(30)]
    near = text[0].split()
    near[7] = near[80] = "changed"
    rows = [(i, t) for i, t in enumerate(text)] + [(100, " ".join(near)), (101, text[3].upper()), (102, text[3]), (5, text[5]), (103, None), (104, ""), (105, ""), (106, "  "), (107, "!!!"), (108, "!!!"), (None, text[9]), (109, "long " * 300000), (110, "long " * 300000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], DOC + ", group_id int")
    got = {r.doc_id: (r.group_id, r.group_size) for r in near_duplicate_groups(df).collect()}
    assert got == {0: (0, 2), 100: (0, 2), 3: (3, 3), 101: (3, 3), 102: (3, 3), 107: (107, 2), 108: (107, 2), 109: (109, 2), 110: (109, 2)}
    links = {r.doc_id: r.n_links for r in near_duplicate_groups(df).collect()}
    assert links == {0: 1, 100: 1, 3: 2, 101: 2, 102: 2, 107: 1, 108: 1, 109: 1, 110: 1}
    assert near_duplicate_groups(df.limit(0)).count() == 0


def test_fingerprint_by_definition():
    texts = ["a b c a", "one", None, "", "x " * 700 + " ".join(f"q{i}" for i in range(600))]
    fp, has = fingerprints(pa.array(texts))
    assert has.tolist() == [True, True, False, False, True]
    again, _ = fingerprints(pa.array(["pad " * 50, *texts]))
    assert (again[1:] == fp).all()


def test_narrow_tables_are_few_files(spark, monkeypatch):
    """What many tasks make is put together before it is written: each file and folder costs the executor a process."""
    files, write = {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        files[name] = len(glob.glob(f"{self.root.removeprefix('file:')}/{name}/*.parquet"))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rng = np.random.default_rng(3)
    vocab = [f"w{i}x" for i in range(3000)]
    text = [" ".join(rng.choice(vocab, 200)) for _ in range(100)]
    rows = list(enumerate(text)) + [(200 + i, t + " more") for i, t in enumerate(text[:40])] + [(300, text[0])]
    df = spark.createDataFrame(rows, DOC).repartition(8)
    kept = drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))
    assert files["fp"] <= 2 and files["found"] <= 2 and "drop" not in files


def test_fingerprints_hold_few_bytes_of_a_batch():
    rng = np.random.default_rng(4)
    text = pa.array([" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(3000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), text], names=["doc_id", "text"])
    assert text.nbytes > 6e6
    tracemalloc.start()
    try:
        got = pa.Table.from_batches(_fingerprint_batches(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    whole, _ = fingerprints(text)
    assert got["hi"].to_pylist() == whole[:, 0].view(np.int64).tolist() and got["doc_id"].to_pylist() == list(range(3000))
    assert peak < 40e6
