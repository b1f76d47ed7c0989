import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from morsel.llm import brown as B
from morsel.llm.common import Scratch

RX = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+")


def toy(seed=3, n=300):
    rng = random.Random(seed)
    animals, verbs, foods = ["cat", "dog", "cow", "fox"], ["eats", "likes", "wants"], ["hay", "fish", "corn", "meat", "milk"]
    rows = [(i, " ".join(f"The {rng.choice(animals)} {rng.choice(verbs)} {rng.choice(foods)} ." for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return rows + [(n, "rare1 unseenword été!"), (n + 1, ""), (n + 2, None), (None, "the cat"), (0, rows[0][1])]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = toy()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_words int").repartition(3)
    scratch = Scratch(spark, "t")
    voc = B.build_vocabulary(df, scratch, 1e-3)
    pairs = B.count_pairs(df, voc).cache()
    classes, grid, history = B.cluster(pairs, voc, 5, 6)
    return rows, df, voc, pairs, classes, grid, history


def codes(words):
    return B.tokens(pa.array([" ".join(words)]))[0]


def test_counts(fitted):
    rows, _, voc, pairs, *_ = fitted
    docs = [RX.findall(t.lower()) for _, t in rows if t is not None]
    count = Counter(w for d in docs for w in d)
    total = sum(count.values())
    top = {w: n for w, n in count.items() if n >= np.ceil(1e-3 * total)}
    assert dict(zip(voc.codes.tolist(), voc.counts.tolist())) == dict(zip(codes(top).tolist(), top.values()))
    assert voc.kind_counts.sum() == total - sum(top.values()) and voc.kind_types.sum() == len(count) - len(top)
    want = Counter()
    for d in docs:
        ids = [voc.boundary, *(voc.ids(codes(d)).tolist() if d else []), voc.boundary]
        want.update(zip(ids, ids[1:]))
    assert {(r.key >> B.ID_BITS, r.key & (1 << B.ID_BITS) - 1): r.n for r in pairs.collect()} == dict(want)


def test_exchange_raises_likelihood_and_finds_the_classes(fitted):
    _, _, voc, pairs, classes, grid, history = fitted
    assert len(history) > 1 and all(b > a for a, b in zip(history, history[1:]))
    assert history[-1] == pytest.approx(B.likelihood(grid)) and grid.sum() == sum(r.n for r in pairs.collect())
    of = lambda ws: {int(classes[voc.ids(codes([w]))[0]]) for w in ws}
    a, v, f = of(["cat", "dog", "cow", "fox"]), of(["eats", "likes", "wants"]), of(["hay", "fish", "corn", "meat", "milk"])
    assert not a & v and not v & f and not a & f


def test_sweep_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(1)
    n, k = 12, 4
    pair = rng.integers(0, 9, (n, n))
    classes = rng.integers(0, k, n)
    one = np.eye(k, dtype=int)
    for w in range(n):
        after, before = pair @ one[classes], pair.T @ one[classes]
        new = B.sweep(classes, np.array([w]), after, before, k)
        score = lambda c: B.likelihood(one[c].T @ pair @ one[c])
        if pair[w, w] == 0:
            best = max(score(np.where(np.arange(n) == w, c, classes)) for c in range(k))
            assert score(new) == pytest.approx(best)


def test_perplexity(spark, fitted):
    rows, df, voc, _, classes, grid, _ = fitted
    m = B.estimate(voc, classes, grid)
    assert np.allclose(np.exp(m.transition).sum(1), 1)
    n = len(voc.codes)
    assert np.allclose(np.bincount(classes[:n], weights=np.exp(m.emission[:n]), minlength=len(grid))[np.unique(classes[:n])], 1)
    got = B.score_documents(df, m).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        if t is None:
            want[str((d, None, None))] += 1
            continue
        w = RX.findall(t.lower())
        ids = [voc.boundary, *(voc.ids(codes(w)).tolist() if w else []), voc.boundary]
        lp = sum(m.transition[classes[a], classes[b]] + m.emission[b] for a, b in zip(ids, ids[1:]))
        want[str((d, len(w), round(float(np.exp(-lp / (len(w) + 1))), 6)))] += 1
    assert Counter(str((r.doc_id, r.n_words, r.perplexity if r.perplexity is None else round(r.perplexity, 6))) for r in got) == want


def test_cases(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for x in (df, df.limit(0)):
        m = B.fit(x)
        assert B.score_documents(x, m).count() == x.count()
    long = spark.createDataFrame([(1, "a b " * 200000), (2, "a b")], "doc_id long, text string")
    p = {r.doc_id: r.perplexity for r in B.score_documents(long, B.fit(long)).collect()}
    assert 1 <= p[1] < 1.1 and p[2] > p[1]


def test_rare_words_have_their_own_counts_and_classes(spark):
    rows = toy()
    # rarer than the share: two animals and a word that nothing else is like
    rows += [(1000 + i, "the emu eats hay ." if i % 3 else "the yak likes corn .") for i in range(9)] + [(2000, "oddword emu yak")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = B.fit(df, 1e-2, 5)
    count = Counter(w for _, t in rows if t is not None for w in RX.findall(t.lower()))
    n = len(m.voc.codes)
    table = {r["key"]: (r["class"], r["emission"]) for r in m.rare.collect()}
    rare = {w: table[int(codes([w]).view(np.int64)[0])] for w in count if m.voc.ids(codes([w]))[0] >= n}
    assert len(rare) == len(table) and {"emu", "yak", "oddword"} <= set(rare)
    animals = {int(m.classes[m.voc.ids(codes([w]))[0]]) for w in ("cat", "dog", "cow", "fox")}
    assert {rare["emu"][0], rare["yak"][0]} <= animals
    place = {w: rare[w] if w in rare else (int(m.classes[i]), m.emission[i]) for w in count for i in [m.voc.ids(codes([w]))[0]]}
    size = Counter()
    for w, k in count.items():
        size[place[w][0]] += k
    assert all(e == pytest.approx(np.log(count[w] / size[c])) for w, (c, e) in place.items())
    # class transitions are those of all pairs, each word in its class
    edge = int(m.classes[m.voc.boundary])
    total = len(m.transition)
    grid = np.zeros((total, total))
    seqs = [[edge, *(place[w][0] for w in RX.findall(t.lower())), edge] if t is not None else None for _, t in rows]
    for c in seqs:
        for a, b in zip(c or [], (c or [])[1:]):
            grid[a, b] += 1
    assert np.allclose(B.estimate(m.voc, m.classes, grid).transition, m.transition)
    want = Counter()
    for (d, t), c in zip(rows, seqs):
        e = [place[w][1] for w in RX.findall(t.lower())] if t is not None else []
        want[str((d, None if t is None else round(float(sum(e) + sum(m.transition[a, b] for a, b in zip(c, c[1:]))), 6)))] += 1
    assert Counter(str((r.doc_id, None if r.log_prob is None else round(r.log_prob, 6))) for r in B.score_documents(df, m).collect()) == want
    assert Counter(str((r.doc_id, None if r.log_prob is None else round(r.log_prob, 6))) for r in B.fit_and_score(df, 1e-2, 5).collect()) == want
    # the same where workers hold few rare words, or none, and the others are joined
    for most in (0, 3):
        classed = B.class_documents(df, m.voc, m.classes, m.rare, Scratch(spark, "held"), "text", "doc_id", most)
        assert Counter(str((r.doc_id, None if r.log_prob is None else round(r.log_prob, 6))) for r in B._score_classed(classed, m).collect()) == want
    new = spark.createDataFrame([(1, "neverseen emu")], "doc_id long, text string")
    assert np.isfinite(B.score_documents(new, m).first().log_prob)
